"""The ranked priority list: every loan under the best rule that any of its rows satisfies."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duebook.functions.columns import dated
from duebook.functions.predicates import is_yes
from duebook.operators.alerts import Limits
from duebook.schema import PRIORITY_COLUMNS

# The rules' names, by rank.
LABELS = [
    "Non Starters", "Easy Settlements", "Recent Advances - High Bucket", "Insurance-Driven Delinquency", "Co-lending at Risk", "No Collection 3 Months", "NPA Accounts",
]


def rules(as_of: datetime, limits: Limits = Limits()) -> list[Column]:
    """A predicate per rank; a missing value satisfies none."""
    arrears, closing = F.col("arrears_emi"), F.col("closing_arrears")
    since = F.add_months(F.lit(as_of.date()), -limits.recent_months).cast("timestamp")
    return [
        is_yes("non_starter"),
        (closing > 0) & (closing < limits.easy_settlement),
        (F.col("ag_date") >= since) & (arrears >= 1),
        (F.col("arr_inst") <= 0) & (F.col("arr_exp") > limits.insurance_arrears) & (arrears > 0),
        is_yes("colending") & (arrears > 0),
        is_yes("no_coll_3m"),
        F.col("curr_bucket") == "NPA",
    ]


def ranked(df: DataFrame, as_of: datetime, limits: Limits = Limits()) -> DataFrame:
    """Adds rank and priority; keeps a row where its own best rule is its loan's best."""
    own = F.array_min(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(rules(as_of, limits), 1)]), lambda x: x.isNotNull()))
    # a row may satisfy several rules: it stays if it satisfies the loan's best one, which is then its own best
    best = F.when(F.col("loan_no").isNull(), F.col("rank")).otherwise(F.min("rank").over(W.partitionBy("loan_no")))
    rows = df.withColumn("rank", own).where(F.col("rank").isNotNull())
    label = F.element_at(F.array(*[F.lit(f"P{k}: {name}") for k, name in enumerate(LABELS, 1)]), F.col("rank"))
    return rows.withColumn("best", best).where("rank = best").drop("best").withColumn("priority", label)


def priority_list(df: DataFrame, as_of: datetime, limits: Limits = Limits()) -> DataFrame:
    """The list with its display columns, by rank and loan number."""
    rows = ranked(df, as_of, limits).orderBy("rank", "loan_no")
    return dated(rows.select(*[c for c in PRIORITY_COLUMNS if c in rows.columns]))


def quota(df: DataFrame, n: int, group: str = "rank") -> DataFrame:
    """n rows dealt over the groups: n div groups each, one more for the first n mod groups; what a group lacks is not dealt again."""
    groups = df.select(group).distinct()
    order = W.orderBy(group)
    shares = groups.withColumn("place", F.row_number().over(order)).withColumn("groups", F.count(F.lit(1)).over(W.partitionBy()))
    share = F.floor(F.lit(n) / F.col("groups")) + (F.col("place") <= F.lit(n) % F.col("groups")).cast("int")
    rows = df.withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy("loan_no"))).where(F.col("rn") <= n)  # the bound reaches the window
    return rows.join(shares.select(group, share.alias("share")), group).where("rn <= share").drop("rn", "share")
