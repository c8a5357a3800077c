"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Each document gets a 60-bit hash. A source that must give ``r`` times its size gives every document ``floor(r)`` times, and once
more those whose hash lies under the source's threshold. Thresholds are nested: the documents of a smaller budget are among those
of a larger one. A threshold is found without sorting documents: sizes are summed by source and the top 14 bits, a running sum over
at most 16,384 buckets finds the one in which the budget ends, and only that bucket is summed again by the next 14 bits, then by
whole hashes. Three aggregations of slim rows, whatever the number of documents; text is read once.

Null source: a source of its own, last in order. Null text: size 0. Very long texts are counted whole. Columns of the operator's own have names
of their own (m__), so any other column passes. Empty table: no rows. Repeated rows are documents like any other. Documents whose hashes tie (same source and
doc_id) are ordered by size and text hash, numbered among themselves only, and taken until the budget is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duebook.llm.common import bits60, bounded_broadcast, cut, same_columns, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_REPEATS = 2
#: Sources up to this count are broadcast (about 100 bytes each); more are joined by shuffle.
MOST_BROADCAST = 20_000
SHIFTS = (46, 32)


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_REPEATS) -> DataFrame:
    """Target per source from (source, source_size): weights repeat over the sources by code point, null last.

    No target passes ``most`` times its source; the excess goes to the others by weight. In order of cap over weight, the sources
    before some point sit at their caps and the rest share what is left, so two running sums replace the repeated resharing: the level
    rises while capped sources give up their excess and falls from there on, hence its maximum is the one that holds.
    The window runs over one row per source, never over documents.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    level = W.orderBy("ratio", "place")
    before, everything = level.rowsBetween(W.unboundedPreceding, -1), level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    rows = (
        sizes.withColumn("place", F.row_number().over(order))
        .withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("weight_all", F.sum("weight").over(everything))
        .withColumn("open_level", (F.col("budget") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before")))
        .withColumn("water", F.max("open_level").over(everything))
    )
    return rows.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("water")).alias("target"))


def _boundary(sums: DataFrame, left: Column, *keep: str) -> DataFrame:
    """Per source, the bucket in which the budget ends, with what is left of the budget at its start."""
    run = F.sum("part").over(W.partitionBy("m__key").orderBy("bucket"))
    return sums.withColumn("until", run).where((F.col("until") > left) & (F.col("until") - F.col("part") <= left)).select(
        "m__key", *keep, "bucket", "part", (left - F.col("until") + F.col("part")).alias("left")
    )


def _keyed(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the operator's own columns: source key, hash, size, and what orders equal hashes."""
    source, doc_id, text = (F.col(c) for c in ("source", "doc_id", "text"))
    return docs.select(
        *keep, source.alias("m__source"), word_count(text).alias("m__size"),
        # a null source's key equals no other's
        F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)).alias("m__key"),
        bits60(F.coalesce(source, F.lit("")), F.coalesce(doc_id.cast("string"), F.lit("null"))).alias("m__h"),
        F.xxhash64(text).alias("m__tie"),
    )


def mix(docs: DataFrame, *keep: str, weights=WEIGHTS, share=SHARE, most=MOST_REPEATS) -> DataFrame:
    """``keep`` columns of every document, m__size, m__source_size, m__target (its source's), m__copies (how often the mix takes it)."""
    slim = [c for c in keep if c == "doc_id"]
    rows = cut(_keyed(docs, *slim))
    first, second = (F.shiftrightunsigned("m__h", s) for s in SHIFTS)
    histogram = cut(rows.groupBy("m__key", "m__source", first.alias("bucket")).agg(F.sum("m__size").alias("part")))
    sizes = histogram.groupBy("m__key", F.col("m__source").alias("source")).agg(F.sum("part").alias("source_size"))
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("m__key")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = targets(sizes.select("source", "source_size"), weights, share, most).select(key, "source_size", "target", whole.alias("whole"))
    goals = cut(goals.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    n_sources = goals.count()
    small = lambda df: bounded_broadcast(df, n_sources, MOST_BROADCAST)

    b1 = _boundary(histogram.join(small(goals.select("m__key", "budget")), "m__key"), F.col("budget")).drop("part").withColumnRenamed("bucket", "b1")
    sums2 = rows.withColumn("b1", first).join(small(b1), ["m__key", "b1"]).groupBy("m__key", "left", second.alias("bucket")).agg(F.sum("m__size").alias("part"))
    b2 = _boundary(sums2, F.col("left")).drop("part").withColumnRenamed("bucket", "b2")
    # a 2^-28 part of a source: single documents at any size but for ties
    inside = rows.withColumn("b2", second).join(small(b2), ["m__key", "b2"])
    sums3 = inside.groupBy("m__key", "left", F.col("m__h").alias("bucket")).agg(F.sum("m__size").alias("part"), F.count(F.lit(1)).alias("tied"))
    b3 = _boundary(sums3, F.col("left"), "tied")
    # a document is taken if that brings its source nearer to the target
    edge = b3.select("m__key", F.col("bucket").alias("edge"), "left", "tied", ((F.col("part") <= 2 * F.col("left")) & (F.col("left") > 0)).alias("edge_in"))
    plan = cut(goals.join(small(edge), "m__key", "left"))

    frame = rows if slim == list(keep) else _keyed(docs, *keep)
    out = frame.join(small(plan), "m__key")
    at_edge = F.coalesce(F.col("m__h") == F.col("edge"), F.lit(False))
    more = F.coalesce(F.when(at_edge, F.col("edge_in")).otherwise(F.col("m__h") < F.col("edge")), F.lit(False))
    tied = at_edge & (F.col("tied") > 1)
    made = out.withColumn("m__more", more)
    if not plan.where("tied > 1").isEmpty():  # rows that share source and doc_id, numbered among themselves
        ties = W.partitionBy("m__key", "m__h").orderBy("m__size", "m__tie").rowsBetween(W.unboundedPreceding, 0)
        some = out.where(tied).withColumn("run", F.sum("m__size").over(ties))
        nearer = (2 * F.col("run") - F.col("m__size") <= 2 * F.col("left")) & (F.col("left") > 0)
        made = made.where(~tied).unionByName(some.withColumn("m__more", nearer).drop("run"))
    copies = F.least(F.col("whole") + F.col("m__more").cast("long"), F.lit(most).cast("long"))
    return made.select(*keep, "m__size", F.col("source_size").alias("m__source_size"), F.col("target").alias("m__target"), copies.alias("m__copies"))


def op10(docs: DataFrame) -> DataFrame:
    """The contract's columns: taken is size times copies."""
    names = {"m__size": "size", "m__source_size": "source_size", "m__target": "target"}
    return mix(docs, "doc_id").select("doc_id", *[F.col(a).alias(b) for a, b in names.items()], (F.col("m__size") * F.col("m__copies")).alias("taken"))


@same_columns
def repeated(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: every document as often as the mix takes it, unchanged."""
    taken = mix(docs, *docs.columns).where("m__copies > 0")
    return taken.withColumn("m__copy", F.explode(F.sequence(F.lit(1), F.col("m__copies").cast("int")))).select(*docs.columns)


#: Same weights, water level and nearest-document law; md5 is the same in both engines. `tie` is left out: it orders rows that share source and doc_id.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST(concat('0x', substr(md5(concat(coalesce(source, ''), '|', coalesce(CAST(doc_id AS VARCHAR), 'null'))), 1, 15)) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS place FROM s),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, (source_size * 2)::DOUBLE AS cap FROM p),
r AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(weight) OVER b, 0) AS weight_before,
  (SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE AS budget, (SELECT sum(weight) FROM w) AS weight_all FROM w
  WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((budget - cap_before) / (weight_all - weight_before)) AS water FROM r),
t AS (SELECT source, source_size, least(cap, weight * water) AS target FROM w, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS part,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING) AS run
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN part > 0 AND 2 * run - size <= 2 * part THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
