"""Executives by branch: collection, strike, roll and default rates with quartile tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.functions.columns import band, lakh, pair_label, ratio_pct, rounded, score
from duebook.operators.kpis import loan_level


def executives(df: DataFrame, least: int = 5) -> DataFrame:
    """A row per executive and branch with ``least`` loans or more. Needs prev_bucket for the roll rates."""
    curr, prev = score(F.col("curr_bucket")), score(F.col("prev_bucket"))
    df = df.where(F.col("mnt_name").isNotNull() & F.col("unit").isNotNull())
    per_loan = loan_level(
        df, ["mnt_name", "unit"], {"demand": "demand", "collected": "collection", "soh": "soh", "pos": "pos"},
        {"npa": F.col("curr_bucket") == "NPA", "sma2": F.col("curr_bucket") == "SMA-2"},
        {"yes": F.col("strike") == "Y", "no": F.col("strike") == "N", "moved": curr.isNotNull() & prev.isNotNull(), "worse": curr > prev, "better": curr < prev},
    )
    loan = F.col("loan_no").isNotNull()
    sums = per_loan.groupBy("mnt_name", "unit").agg(
        F.count_if(loan).alias("accounts"), F.count_if(loan & (F.col("npa") == 1)).alias("npa"), F.count_if(loan & (F.col("sma2") == 1)).alias("sma2"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("demand", "collected", "soh", "pos", "yes", "no", "moved", "worse", "better")],
    ).where(F.col("accounts") >= least)
    pct = lambda a, b: ratio_pct(a, b, 1)
    demand = F.when(F.col("demand") > 0, F.col("demand"))
    return sums.select(
        pair_label("mnt_name", "unit").alias("executive"), "mnt_name", "unit", "accounts", pct(F.col("yes"), F.col("yes") + F.col("no")).alias("strike_pct"),
        pct(F.col("collected"), demand).alias("collection_pct"), pct(F.col("worse"), F.col("moved")).alias("roll_fwd_pct"), pct(F.col("better"), F.col("moved")).alias("roll_bwd_pct"),
        pct(F.col("npa"), F.col("accounts")).alias("npa_pct"), "npa", "sma2", lakh(F.col("pos")).alias("pos_lakh"), lakh(F.col("soh")).alias("soh_lakh"),
        lakh(F.col("demand")).alias("demand_lakh"), lakh(F.col("collected")).alias("collected_lakh"),
    )


def scorecard(df: DataFrame, least: int = 5) -> DataFrame:
    """The executives with their tier: quartiles of the rounded collection rate, the upper one tested first."""
    rows = executives(df, least)
    quartiles = rows.agg(F.percentile("collection_pct", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    rate, q = F.col("collection_pct"), F.col("q")
    tier = F.when(rate >= q[1], "top").when(rate <= q[0], "bottom").otherwise("mid")
    return rows.crossJoin(F.broadcast(quartiles)).withColumn("tier", tier).drop("q")  # one row


def banded(card: DataFrame) -> DataFrame:
    """Adds a light for collection (green above 100, amber from 90), roll forward (red from 20, amber from 10) and roll backward (green from 10,
    amber from 5, else grey)."""
    coll, fwd, bwd = (F.col(c) for c in ("collection_pct", "roll_fwd_pct", "roll_bwd_pct"))
    return card.withColumns({
        "collection_light": F.when(coll > 100, "green").otherwise(band(coll, ("amber", 90.0), ("red", 0.0))),
        "roll_fwd_light": band(fwd, ("red", 20.0), ("amber", 10.0), ("green", 0.0)), "roll_bwd_light": band(bwd, ("green", 10.0), ("amber", 5.0), ("grey", 0.0)),
    })


def summary(card: DataFrame) -> DataFrame:
    """Executives per tier and mean rates."""
    mean = lambda c: F.coalesce(rounded(F.avg(c), 1), F.lit(0.0)).alias(f"avg_{c}")
    tiers = [F.count_if(F.col("tier") == t).alias(t) for t in ("top", "mid", "bottom")]
    return card.agg(F.count(F.lit(1)).alias("executives"), *tiers, mean("collection_pct"), mean("strike_pct"), mean("npa_pct"))


def top(card: DataFrame, n: int = 5) -> DataFrame:
    """The best of the top tier."""
    return card.where("tier = 'top'").orderBy(F.desc("collection_pct"), "executive").limit(n)


def bottom(card: DataFrame, n: int = 5) -> DataFrame:
    """The worst of the bottom tier, worst first."""
    return card.where("tier = 'bottom'").orderBy("collection_pct", "executive").limit(n)
