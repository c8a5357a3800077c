"""Branch performance and exposure by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.functions.columns import band, bucket_frame, lakh, ratio_pct, rounded
from duebook.operators.kpis import total


def branch_rates(df: DataFrame) -> DataFrame:
    """(branch, accounts, coll_pct to two places, demand, collection)."""
    return df.where(F.col("unit").isNotNull()).groupBy(F.col("unit").alias("branch")).agg(
        F.count_distinct("loan_no").alias("accounts"), ratio_pct(F.sum("collection"), F.sum("demand")).alias("coll_pct"), total("collection").alias("collection"), total("demand").alias("demand"),
    )


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("branch", "accounts", rounded(F.col("coll_pct"), 1).alias("coll_pct"), lakh(F.col("collection")).alias("collection_lakh"), lakh(F.col("demand")).alias("demand_lakh"))


def light(rate: F.Column) -> F.Column:
    """The report's light of a collection rate."""
    return band(rate, ("green", 100.0), ("amber", 90.0), ("red", 0.0))


def top_branches(df: DataFrame, n: int = 5) -> DataFrame:
    return _shown(branch_rates(df).orderBy(F.desc("coll_pct"), "branch").limit(n))


def bottom_branches(df: DataFrame, n: int = 5) -> DataFrame:
    return _shown(branch_rates(df).orderBy("coll_pct", "branch").limit(n))


def best_branches(df: DataFrame, n: int = 12) -> DataFrame:
    """The n best branches, in ascending order of their rate."""
    return branch_rates(df).orderBy(F.desc("coll_pct"), "branch").limit(n).select("branch", "coll_pct").orderBy("coll_pct", F.desc("branch"))


def _filled(found: DataFrame, value: str) -> DataFrame:
    frame = bucket_frame(found.sparkSession)
    return frame.join(found, "bucket", "left").select("bucket", "place", F.coalesce(F.col(value), F.lit(0)).alias(value)).orderBy("place")


def loans_by_bucket(df: DataFrame) -> DataFrame:
    """Distinct loans per bucket, all six in order."""
    return _filled(df.groupBy(F.col("curr_bucket").alias("bucket")).agg(F.count_distinct("loan_no").alias("loans")), "loans")


def arrears_by_bucket(df: DataFrame) -> DataFrame:
    return _filled(df.groupBy(F.col("curr_bucket").alias("bucket")).agg(total("closing_arrears").alias("closing_arrears")), "closing_arrears")


def exposure_by_bucket(df: DataFrame) -> DataFrame:
    return _filled(df.groupBy(F.col("curr_bucket").alias("bucket")).agg(total("soh").alias("soh")), "soh")
