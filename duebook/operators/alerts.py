"""Six rule alerts in one scan: totals per alert, and the rows behind them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.functions.columns import arrears_ratio_pct, dated, number
from duebook.functions.predicates import is_yes
from duebook.schema import ALERT_COLUMNS


@dataclass(frozen=True)
class Limits:
    """Thresholds of alerts, priorities and the scorecard."""

    easy_settlement: float = 1000.0
    insurance_arrears: float = 5000.0
    high_arrears_ratio: float = 0.5
    recent_months: int = 12
    least_accounts: int = 5


ALERTS = [
    ("non_starter", "critical"), ("insurance", "high"), ("easy_settlement", "medium"), ("recent_advances", "high"), ("colending", "critical"), ("high_arrears", "critical"),
]
#: Severities from worst to mildest.
SEVERITY = {"critical": 0, "high": 1, "medium": 2}


def rules(as_of: datetime, limits: Limits = Limits()) -> dict[str, Column]:
    """A predicate per alert; missing amounts count as 0."""
    zero = lambda c: F.coalesce(number(c), F.lit(0.0))
    arrears, closing = zero("arrears_emi"), zero("closing_arrears")
    amount = zero("loan_amount")
    since = F.add_months(F.lit(as_of.date()), -limits.recent_months).cast("timestamp")
    return {
        "non_starter": is_yes("non_starter"),
        "insurance": (zero("arr_inst") <= 0) & (zero("arr_exp") > limits.insurance_arrears) & (arrears > 0),
        "easy_settlement": (closing > 0) & (closing < limits.easy_settlement),
        "recent_advances": (F.col("ag_date") >= since) & (arrears > 0),
        "colending": is_yes("colending") & (arrears > 0),
        "high_arrears": (amount > 0) & (zero("arr_inst") + zero("arr_exp") + zero("arr_bc") > limits.high_arrears_ratio * amount),
    }


def flagged(df: DataFrame, as_of: datetime, limits: Limits = Limits()) -> DataFrame:
    """A row per alert and loan row it concerns, from one scan."""
    hits = F.array(*[F.when(cond, F.lit(a)) for a, cond in rules(as_of, limits).items()])
    return df.withColumn("alert_id", F.explode(F.filter(hits, lambda x: x.isNotNull())))


def _fixed(spark) -> DataFrame:
    return spark.createDataFrame([(a, s, k + 1) for k, (a, s) in enumerate(ALERTS)], "alert_id string, severity string, place int")


def summary(df: DataFrame, as_of: datetime, limits: Limits = Limits()) -> DataFrame:
    """(alert_id, severity, place, count, soh, closing_arrears): all six alerts, zeros for those without rows."""
    per_loan = flagged(df, as_of, limits).groupBy("alert_id", "loan_no").agg(F.sum("soh").alias("soh"), F.sum("closing_arrears").alias("closing"))
    found = per_loan.groupBy("alert_id").agg(F.count("loan_no").alias("count"), F.sum("soh").cast("double").alias("soh"), F.sum("closing").cast("double").alias("closing_arrears"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return _fixed(df.sparkSession).join(found, "alert_id", "left").select("alert_id", "severity", "place", zero("count"), zero("soh"), zero("closing_arrears"))


def drilldown(df: DataFrame, as_of: datetime, limits: Limits = Limits(), alert: str | None = None) -> DataFrame:
    """The rows behind the alerts with the display columns that exist; the worst ratio first for high arrears alone."""
    rows = flagged(df, as_of, limits)
    if alert:
        rows = rows.where(F.col("alert_id") == alert)
    rows = rows.withColumn("arrears_ratio_pct", F.when(F.col("alert_id") == "high_arrears", arrears_ratio_pct()))
    rows = rows.select("alert_id", *[c for c in ALERT_COLUMNS if c in df.columns], "arrears_ratio_pct")
    return dated(rows.orderBy(F.desc_nulls_last("arrears_ratio_pct"), "loan_no") if alert == "high_arrears" else rows)


def by_severity(alerts: DataFrame) -> DataFrame:
    """How many alerts of each severity have rows."""
    return alerts.groupBy("severity").agg(F.count_if(F.col("count") > 0).alias("active"))


def risk_flags(alerts: DataFrame, n: int = 3) -> DataFrame:
    """The active alerts that matter most: by severity, then by count."""
    order = F.lit(len(SEVERITY))
    for s, k in SEVERITY.items():
        order = F.when(F.col("severity") == s, k).otherwise(order)
    return alerts.where("count > 0").orderBy(order, F.desc("count"), "place").limit(n)
