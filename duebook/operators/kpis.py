"""Key figures of a snapshot with movement against the previous one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.functions.columns import mom_pct, number, ratio_pct, rounded

KPIS = ["month_demand", "total_collection", "collection_pct", "strike_pct", "npa_pct", "hard_bucket_pct", "count", "soh", "lcc_pct", "cmd_pct"]

#: Traffic lights: kpi, best is high, green from, amber from.
HEALTH = (("collection_pct", True, 90.0, 75.0), ("npa_pct", False, 3.0, 7.0), ("hard_bucket_pct", False, 10.0, 20.0), ("strike_pct", True, 80.0, 60.0))


def loan_level(df: DataFrame, keys: list[str], sums: dict[str, str], flags: dict[str, Column], rows: dict[str, Column] | None = None) -> DataFrame:
    """One row per keys and loan: sums of columns, whether any row has a flag, how many rows satisfy a condition.

    Counting distinct loans under several conditions then takes a second, small aggregation instead of one Expand per condition.
    """
    made = [F.sum(c).alias(a) for a, c in sums.items()] + [F.max(F.coalesce(f, F.lit(False)).cast("int")).alias(a) for a, f in flags.items()]
    made += [F.count_if(c).alias(a) for a, c in (rows or {}).items()]
    return df.groupBy(*keys, "loan_no").agg(*made)


def total(name: str) -> Column:
    """A decimal sum as double at the end, 0 for no rows."""
    return F.coalesce(F.sum(name).cast("double"), F.lit(0.0))


def kpi_row(df: DataFrame) -> DataFrame:
    """The ten figures in one row; zeros for an empty snapshot."""
    per_loan = loan_level(
        df, [],
        {"demand": "demand", "collection": "collection", "soh": "soh", "cum": "total_cum_coll", "cum_ie": "cum_coll_ie", "due_i": "cum_due_inst", "due_e": "cum_due_exp"},
        {"npa": F.col("curr_bucket") == "NPA", "hard": F.col("arrears_emi") >= 6},
        {"yes": F.col("strike") == "Y", "no": F.col("strike") == "N"},
    )
    loan = F.col("loan_no").isNotNull()
    n = F.count_if(loan)
    flagged = lambda c: F.count_if(loan & (F.col(c) == 1))
    return per_loan.agg(
        total("demand").alias("month_demand"), total("collection").alias("total_collection"),
        ratio_pct(F.sum("collection"), F.sum("demand")).alias("collection_pct"),
        ratio_pct(F.sum("yes"), F.sum("yes") + F.sum("no")).alias("strike_pct"),
        ratio_pct(flagged("npa"), n).alias("npa_pct"), ratio_pct(flagged("hard"), n).alias("hard_bucket_pct"),
        n.cast("double").alias("count"), total("soh").alias("soh"),
        ratio_pct(F.sum("cum"), total("due_i") + total("due_e")).alias("lcc_pct"), ratio_pct(F.sum("cum"), F.sum("cum_ie")).alias("cmd_pct"),
    )


def kpi_table(curr: DataFrame, prev: DataFrame) -> DataFrame:
    """(kpi, value, prev_value, mom_pct), ten rows."""
    before = kpi_row(prev).select(*[F.col(k).alias(f"p_{k}") for k in KPIS])
    both = kpi_row(curr).crossJoin(before)  # one row each
    rows = F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).alias("value"), F.col(f"p_{k}").alias("prev_value")) for k in KPIS])
    return both.select(F.inline(rows)).select("kpi", "value", "prev_value", mom_pct(F.col("value"), F.col("prev_value")).alias("mom_pct"))


def portfolio_health(curr: DataFrame, prev: DataFrame) -> DataFrame:
    """The table of figures with a traffic light for those that have one."""
    light = F.lit(None).cast("string")
    v = F.col("value")
    for kpi, high, green, amber in HEALTH:
        on = F.when(v >= green, "green").when(v >= amber, "amber") if high else F.when(v <= green, "green").when(v <= amber, "amber")
        light = F.when(F.col("kpi") == kpi, on.otherwise("red")).otherwise(light)
    return kpi_table(curr, prev).withColumn("light", light)


def result_kpis(df: DataFrame) -> DataFrame:
    """Figures of a query's rows, before any display projection."""
    return df.agg(
        F.count_distinct("loan_no").alias("accounts"), total("soh").alias("soh"), F.coalesce(rounded(F.avg(number("arrears_emi"))), F.lit(0.0)).alias("avg_arrears"),
        total("demand").alias("demand"), total("collection").alias("collection"), ratio_pct(F.sum("collection"), F.sum("demand")).alias("collection_pct"),
    )
