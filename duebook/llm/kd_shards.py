"""Sharding by a k-d tree over document metadata: equal bytes per shard, near metadata together.

A node is split along its widest dimension (spread over the whole table's spread) at the weighted median of that dimension, until
the leaves reach the target bytes. A dimension is a 14-bit cell number followed by 28 hash bits, so a hot value (a third of all rows
may share a source) is split too. Texts become cells by the rank of their distinct values, numbers by their place between the ends.

A level of the tree takes two passes over slim rows, for all its nodes at once: sums of bytes by node, dimension and cell give every
dimension's spread and median cell; sums by 18 hash bits inside the median cell of the widest one give the cut, the nearest to the wanted bytes.
Sums are combined before the shuffle; a node has at most 4 x 16,384 of the first and 262,144 of the second. What reaches the driver is a
few rows per node of the tree, at most one node per shard. Each level is a table (node, dimension, cut) that the rows are joined with.

Null text: no bytes, size 1, checksum 0. Null source, language or doc_id: cell 0, before all others. Empty table: no rows. Equal
rows (ties, repeats) differ in nothing and stay together on one side of a split; a shard's size is off by about a document. Very long texts:
only their length and checksum are kept. Other columns are not read. Slots are numbered by hash bucket: counts per bucket, a running sum
over at most 4,096 buckets a shard, then numbers inside each bucket, so no task ever holds a whole shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duebook.llm.common import bits60, bounded_broadcast, cut, staged

CELL_BITS, HASH_BITS, FINE_BITS = 14, 28, 18
SLOT_BITS = 12
#: Levels between two checkpoints of the rows' nodes.
LEVELS = 6
#: Distinct texts of a dimension up to this count are broadcast with their ranks.
MOST_TEXTS = 500_000
DIMENSIONS = ("doc", "src", "lng", "len")


def ranks(values: DataFrame) -> DataFrame:
    """(dim, value, rank) of the distinct rows (dim, value), in order: numbered inside range partitions, after the counts of those before."""
    parts = staged(values.distinct().repartitionByRange("dim", "value").withColumn("part", F.spark_partition_id()))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    starts = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy("part").orderBy("dim", "value"))
    return parts.withColumn("place", place).join(F.broadcast(starts), "part").select("dim", "value", (F.col("start") + F.col("place")).cast("double").alias("rank"))


def _slim(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, h and a cell per dimension; the texts are read once."""
    raw = cut(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.shiftrightunsigned(bits60(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("source", F.lit(""))), 60 - HASH_BITS).alias("h"),
        F.col("doc_id").cast("double").alias("doc"), F.col("source").alias("src_text"), F.col("lang").alias("lng_text"),
        F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1.0)).alias("len"),
    ))
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"{d}_text").alias("value")) for d in ("src", "lng")])
    ranked = staged(ranks(raw.select(F.inline(pairs)).where("value IS NOT NULL")))
    n = ranked.count()
    rows = raw
    for d in ("src", "lng"):
        mine = ranked.where(F.col("dim") == d).select(F.col("value").alias(f"{d}_text"), F.col("rank").alias(d))
        rows = rows.join(bounded_broadcast(mine, n, MOST_TEXTS), f"{d}_text", "left")
    # the ends of ranks from the ranks, of numbers from the rows; one row
    ends = raw.agg(*[f(d).alias(f"{d}_{k}") for d in ("doc", "len") for k, f in (("lo", F.min), ("hi", F.max))]).first().asDict()
    for r in ranked.groupBy("dim").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).collect():  # two rows
        ends[f"{r['dim']}_lo"], ends[f"{r['dim']}_hi"] = r["lo"], r["hi"]
    most = (1 << CELL_BITS) - 2

    def cell(d: str) -> Column:
        lo, hi = ends.get(f"{d}_lo"), ends.get(f"{d}_hi")
        if lo is None or hi <= lo:
            return F.when(F.col(d).isNull(), F.lit(0)).otherwise(F.lit(1)).cast("int")
        return F.coalesce(F.floor((F.col(d) - F.lit(lo)) / F.lit(hi - lo) * most) + 1, F.lit(0)).cast("int")

    return cut(rows.select("doc_id", "size", "text_crc32", "h", *[cell(d).alias(d) for d in DIMENSIONS]))


def _cuts(rows: DataFrame, nodes: dict[int, tuple[int, int]]) -> dict[int, tuple[str, int]]:
    """(dimension, key of the first row on the right) of every node given with its shards and those that go left."""
    spark = rows.sparkSession
    given = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node long, shards int, on_left int")
    each = F.array(*[F.struct(F.lit(k).alias("dim"), F.col(d).alias("cell")) for k, d in enumerate(DIMENSIONS)])
    here = rows.join(bounded_broadcast(given, len(nodes), MOST_TEXTS), "node")
    sums = here.select("node", "shards", "on_left", "size", F.inline(each)).groupBy("node", "shards", "on_left", "dim", "cell").agg(F.sum("size").alias("part"))
    w = W.partitionBy("node", "dim")
    sums = sums.withColumn("until", F.sum("part").over(w.orderBy("cell"))).withColumn("wanted", F.sum("part").over(w) * F.col("on_left") / F.col("shards"))
    sums = sums.withColumn("spread", F.max("cell").over(w) - F.min("cell").over(w))
    start = F.col("until") - F.col("part")
    middle = sums.where((F.col("until") > F.col("wanted")) & (start <= F.col("wanted")))
    found: dict[int, tuple] = {}
    for r in middle.select("node", "dim", "cell", "spread", (F.col("wanted") - start).alias("left")).collect():  # a row per node and dimension
        if r["node"] not in found or (-r["spread"], r["dim"]) < found[r["node"]][0]:
            found[r["node"]] = ((-r["spread"], r["dim"]), DIMENSIONS[r["dim"]], r["cell"], r["left"])
    inside = spark.createDataFrame([(k, d, c, float(x)) for k, (_, d, c, x) in found.items()], "node long, dim string, cell int, wanted double")
    here = rows.join(bounded_broadcast(inside, len(found), MOST_TEXTS), "node").where(_cell() == F.col("cell"))
    sums = here.groupBy("node", "wanted", F.shiftright("h", HASH_BITS - FINE_BITS).alias("bin")).agg(F.sum("size").alias("part"))
    sums = sums.withColumn("until", F.sum("part").over(W.partitionBy("node").orderBy("bin")))
    sums = sums.where((F.col("until") > F.col("wanted")) & (F.col("until") - F.col("part") <= F.col("wanted")))
    out = {}
    for r in sums.collect():  # a row per node
        # the last bin goes left if most of it is wanted there
        upto = r["bin"] + (2 * (r["wanted"] - (r["until"] - r["part"])) > r["part"])
        _, dim, cell, _ = found[r["node"]]
        out[r["node"]] = (dim, (cell << HASH_BITS) + (int(upto) << (HASH_BITS - FINE_BITS)))
    return out


def _cell() -> Column:
    """The row's cell in the dimension that the column dim names."""
    return F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in DIMENSIONS])


def _step(rows: DataFrame, level: DataFrame, n: int) -> DataFrame:
    """Rows one level further down: node 2k or 2k + 1 where the level (node, dim, key) splits k."""
    key = F.shiftleft(_cell().cast("long"), HASH_BITS) + F.col("h")
    down = 2 * F.col("node") + (key >= F.col("key")).cast("long")
    moved = rows.join(bounded_broadcast(level, n, MOST_TEXTS), "node", "left")
    return moved.withColumn("node", F.coalesce(down, F.col("node"))).drop("dim", "key")


def kd_tree(rows: DataFrame, shards: int, target_bytes: int | None = None) -> tuple[DataFrame, dict[int, tuple[str, int]], dict[int, int]]:
    """(rows with their leaf as node, tree as node: (dimension, key), shard of every leaf). Node 1 is the root, 2k and 2k + 1 are children."""
    spark = rows.sparkSession
    if target_bytes:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    open_nodes, tree, leaves, depth = {1: shards}, {}, {}, 0
    while todo := {k: (n, n // 2) for k, n in open_nodes.items() if n > 1}:
        cuts = _cuts(rows, todo)
        leaves |= {k: n for k, n in open_nodes.items() if k not in cuts}
        if not cuts:
            break
        tree |= cuts
        level = spark.createDataFrame([(k, *v) for k, v in cuts.items()], "node long, dim string, key long")
        rows, depth = _step(rows, level, len(cuts)), depth + 1
        if depth % LEVELS == 0:
            rows = cut(rows)
        open_nodes = {c: m for k in cuts for c, m in ((2 * k, todo[k][1]), (2 * k + 1, todo[k][0] - todo[k][1]))}
    else:
        leaves |= open_nodes
    first, numbers = 0, {}
    for leaf in sorted(leaves, key=lambda k: bin(k)[3:]):  # from the left: the path below the root
        numbers[leaf] = first
        first += leaves[leaf]
    return rows, tree, numbers


def kd_shards(docs: DataFrame, shards: int = 16, target_bytes: int | None = None) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard, slot. ``target_bytes`` sets the number of shards from the table's bytes."""
    rows, _, numbers = kd_tree(_slim(docs), shards, target_bytes)
    shard = docs.sparkSession.createDataFrame(list(numbers.items()), "node long, shard int")
    placed = rows.join(bounded_broadcast(shard, len(numbers), MOST_TEXTS), "node")
    placed = placed.select("doc_id", "size", "text_crc32", "h", "shard", F.shiftright("h", HASH_BITS - SLOT_BITS).alias("bucket"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("shard", "bucket").orderBy("h", "doc_id", "size", "text_crc32")
    numbered = placed.withColumn("place", F.row_number().over(inside))
    # at most 4,096 starts a shard
    starts = bounded_broadcast(starts, len(numbers) << SLOT_BITS, MOST_TEXTS)
    return numbered.join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).alias("slot")
    )


def op9(docs: DataFrame) -> DataFrame:
    return kd_shards(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
