"""Bucket migration between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.functions.columns import first_bucket, ratio_pct, rounded, score
from duebook.schema import SCORES


def _buckets(df: DataFrame, name: str) -> DataFrame:
    """One bucket per loan; a loaded snapshot has one row per loan, and of repeated rows the first counts."""
    return first_bucket(df, name, F.lit(True).alias(f"has_{name}"))


def compared(curr: DataFrame, prev: DataFrame) -> DataFrame:
    """(loan_no, prev_bucket, curr_bucket, has_prev_bucket, has_curr_bucket) of the loans in either snapshot: one full outer join."""
    return _buckets(prev, "prev_bucket").join(_buckets(curr, "curr_bucket"), "loan_no", "full")


def matched(curr: DataFrame, prev: DataFrame) -> DataFrame:
    """(loan_no, prev_bucket, curr_bucket) of the loans in both whose buckets are known."""
    valid = list(SCORES)
    both = _buckets(prev, "prev_bucket").join(_buckets(curr, "curr_bucket"), "loan_no")
    return both.where(F.col("prev_bucket").isin(valid) & F.col("curr_bucket").isin(valid)).select("loan_no", "prev_bucket", "curr_bucket")


def pairs(curr: DataFrame, prev: DataFrame) -> DataFrame:
    """(prev_bucket, curr_bucket, n), the pairs that occur."""
    return matched(curr, prev).groupBy("prev_bucket", "curr_bucket").agg(F.count(F.lit(1)).alias("n"))


def matrix(curr: DataFrame, prev: DataFrame) -> DataFrame:
    """A row per previous bucket, a column per current one, zeros where nothing moved."""
    columns = {"STD": "std", "1-30 DPD": "dpd_1_30", "SMA-1": "sma_1", "SMA-2": "sma_2", "NPA": "npa"}
    frame = curr.sparkSession.createDataFrame([(b, k) for b, k in SCORES.items()], "prev_bucket string, place int")
    counts = [F.count_if(F.col("curr_bucket") == b).alias(c) for b, c in columns.items()]
    found = matched(curr, prev).groupBy("prev_bucket").agg(*counts)
    return frame.join(found, "prev_bucket", "left").select("prev_bucket", "place", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns.values()]).orderBy("place")


def new_entries(curr: DataFrame, prev: DataFrame) -> DataFrame:
    """Loan numbers of the current snapshot that the previous one lacks."""
    return curr.where(F.col("loan_no").isNotNull()).select("loan_no").distinct().join(prev.select("loan_no"), "loan_no", "left_anti")


def exits(curr: DataFrame, prev: DataFrame) -> DataFrame:
    return new_entries(prev, curr)


def migration_kpis(curr: DataFrame, prev: DataFrame) -> DataFrame:
    """matched, roll_forward_pct, roll_backward_pct (every improvement), npa_formation_pct, new_entries, exits; one row.

    Without a previous snapshot there is nothing to compare with: new_entries is 0 as all else.
    """
    before, now = score(F.col("prev_bucket")), score(F.col("curr_bucket"))
    both = before.isNotNull() & now.isNotNull()
    n = F.count_if(both)
    healthy = both & (F.col("prev_bucket") != "NPA")
    old, new = F.col("has_prev_bucket").isNotNull(), F.col("has_curr_bucket").isNotNull()
    return compared(curr, prev).agg(
        n.alias("matched"), ratio_pct(F.count_if(both & (now > before)), n).alias("roll_forward_pct"), ratio_pct(F.count_if(both & (now < before)), n).alias("roll_backward_pct"),
        ratio_pct(F.count_if(healthy & (F.col("curr_bucket") == "NPA")), F.count_if(healthy)).alias("npa_formation_pct"),
        F.when(F.count_if(old) > 0, F.count_if(new & ~old)).otherwise(0).alias("new_entries"), F.count_if(old & ~new).alias("exits"),
    )


def rates(curr: DataFrame, prev: DataFrame) -> DataFrame:
    """The figures of ``migration_kpis`` without new loans and exits."""
    return migration_kpis(curr, prev).drop("new_entries", "exits")


def intensity(curr: DataFrame, prev: DataFrame) -> DataFrame:
    """Per pair of buckets, the steps moved times the share of matched loans in percent; positive is worse."""
    moves = pairs(curr, prev)
    whole = moves.agg(F.sum("n").alias("whole"))
    steps = score(F.col("curr_bucket")) - score(F.col("prev_bucket"))
    share = F.col("n").cast("double") / F.col("whole").cast("double") * 100
    return moves.crossJoin(F.broadcast(whole)).select("prev_bucket", "curr_bucket", "n", rounded(steps * share, 4).alias("intensity"))  # one row
