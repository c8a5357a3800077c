"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations are grouped into weighted sequences with lists of who ends there; only one of each goes on. Sequences that are a
proper prefix of another one are dropped by an anti-join, which leaves the leaves. Prefixes, weighted, are then aggregated into nodes. What a
node sums over its subtree comes from the sequences through it: all turns below, by weight, less the turns that a sequence is the first
to have, each of which is one node. So no pair of nodes and no path is ever built, and the work is linear in the turns of unlike conversations.

A prefix goes by its depth and 124 bits: sums of hashes of (place, role, text). Sums can be made in blocks, so a conversation of any length is
spread over tasks: ``BLOCK`` turn numbers, then ``BLOCK`` places, at a time. The end lists are hashed as a stream in the order of their ids, from
strings of the ids that share ``conv_id / CHUNK``: SHA-256 is sequential, so a group's hash is one task's, but never more than a string in memory.

Order: by turn, null first; ties (one turn number twice) go by the MD5 of role and text, so texts are not shuffled. Null role or text: empty. Rows
with a null conv_id belong to no conversation and are left out. Repeated rows are turns like any other; a text of any length is read once, for
its hash and size. Columns other than conv_id, turn, role and text are not read. An empty table has no conversations and no nodes.
Equal hash sums of unlike prefixes (2^-124 a pair) would be taken for one node.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duebook.llm.common import small_batches, staged

BLOCK, CHUNK = 1024, 4096
#: Conversations are rebuilt in families of so many ids, over at most FAMILY_TURNS - 1 shared turns.
FAMILY, FAMILY_TURNS = 5, 9
_LANES = ("t__a", "t__b", "t__c", "t__d")
_KEY = ["depth", "k1", "k2"]


def _running(rows: DataFrame, key: str, block: Column, order: list[Column], sums: list[str]) -> DataFrame:
    """Running sums within ``key``, in the order of ``block`` and then ``order``: inside blocks, plus what the blocks before hold."""
    rows = rows.withColumn("t__block", block)
    upto = W.partitionBy(key, "t__block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(key).orderBy("t__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy(key, "t__block").agg(*[F.sum(s).alias(s) for s in sums])
    blocks = blocks.select(key, "t__block", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_0") for s in sums])
    local = rows.withColumns({f"{s}_1": F.sum(s).over(upto) for s in sums})
    return local.join(blocks, [key, "t__block"]).withColumns({f"{s}_upto": F.col(f"{s}_0") + F.col(f"{s}_1") for s in sums})


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, bytes): every turn's place from 1 on, a hash of its role and text, the UTF-8 bytes of its text. Staged."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"),
    )
    block = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 62)))
    counted = _running(rows, "conv_id", block, [F.asc_nulls_first("turn"), F.asc("digest")], ["one"])
    return staged(counted.select("conv_id", F.col("one_upto").alias("place"), "digest", "bytes"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin alike, from ``placed`` ones: (their turns, their ids).

    Conversation c takes the first h turns of the first id of its family of ``FAMILY`` ids, then its own turns after its first h;
    h = crc32 of c in decimal, modulo ``FAMILY_TURNS``. A family's first id that has no turns gives none.
    """
    c = F.col("conv_id")
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n")).select(
        "conv_id", "n", (c - F.pmod(c, F.lit(FAMILY))).alias("head"), (F.crc32(c.cast("string").cast("binary")) % FAMILY_TURNS).alias("h"))
    heads = convs.select(F.col("conv_id").alias("head"), F.col("n").alias("n_head"))
    convs = staged(convs.join(heads, "head", "left").select("conv_id", "head", "h", F.least("h", F.coalesce("n_head", F.lit(0))).alias("shared")))
    own = turns.join(convs, "conv_id").where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("shared"))
    first = turns.where((F.col("place") < FAMILY_TURNS) & (F.pmod(c, F.lit(FAMILY)) == 0)).withColumnRenamed("conv_id", "head")
    first = first.join(convs, "head").where("place <= shared")
    columns = ["conv_id", "place", "digest", "bytes"]
    return own.select(columns).unionByName(first.select(columns)), convs.select("conv_id")


def _ends(whole: DataFrame) -> DataFrame:
    """By sequence, the SHA-256 of the decimal ids that end there, ascending and comma-joined."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = whole.groupBy(*_KEY, F.floor(F.col("conv_id") / CHUNK).alias("part")).agg(ids.alias("ids"))
    parts = parts.repartition(*_KEY).sortWithinPartitions(*_KEY, "part")

    def run(batches):
        import pandas as pd

        at, digest = None, None
        for pdf in batches:
            made = []
            for *key, ids in zip(*(pdf[c] for c in (*_KEY, "ids")), strict=True):
                if key != at:
                    if at is not None:
                        made.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield pd.DataFrame(made, columns=[*_KEY, "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, digest.hexdigest())], columns=[*_KEY, "ends_sha256"])

    small_batches(whole.sparkSession)
    return parts.select(*_KEY, "ids").mapInPandas(run, "depth long, k1 long, k2 long, ends_sha256 string")


def _keys(suffix: str, less: bool = False) -> list[Column]:
    """Two numbers of 62 bits from the four sums up to a turn; ``less``: up to the turn before."""
    a, b, c, d = ((F.col(f"{x}{suffix}") - F.col(x) if less else F.col(f"{x}{suffix}")).bitwiseAND(F.lit((1 << 31) - 1)) for x in _LANES)
    return [F.shiftleft(a, 31).bitwiseOR(b), F.shiftleft(c, 31).bitwiseOR(d)]


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of conversations given as ``placed`` turns; ``ids`` lists all of them, those without turns too.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree, each node's members but
    one times the bytes of its last text), ends_sha256.
    """
    hashes = {x: F.xxhash64(F.lit(k), "place", "digest").bitwiseAND(F.lit((1 << 32) - 1)) for k, x in enumerate(_LANES)}
    order = [F.asc("place")]
    summed = _running(turns.withColumns(hashes), "conv_id", F.floor(F.col("place") / BLOCK), order, [*_LANES, "bytes"])
    (k1, k2), (p1, p2) = _keys("_upto"), _keys("_upto", less=True)
    prefixes = staged(summed.select(
        "conv_id", F.col("place").alias("depth"), k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "bytes", F.col("bytes_upto").alias("upto")))

    # whole sequences, weighted; the conversation with the smallest id stands for all alike
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2", "upto")).alias("last"))
    zero = F.lit(0).cast("long")
    whole = staged(ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"last.{c}"), zero).alias(c) for c in (*_KEY, "upto")]))
    sequences = staged(whole.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.max("upto").alias("total")))

    one = sequences.select("conv_id", "weight", "total", F.col("depth").alias("length"))
    below = F.col("total") - F.col("upto") + F.col("bytes")  # bytes of the turns from this one on
    paths = prefixes.join(one, "conv_id").select("conv_id", *_KEY, "p1", "p2", "weight", "length", below.alias("below"))
    none = F.lit(None).cast("long")
    roots = one.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), "weight", "length", F.col("total").alias("below"))
    paths = staged(paths.unionByName(roots))

    nodes = staged(paths.groupBy(*_KEY).agg(
        F.sum("weight").alias("n_convs"), F.min(F.struct("conv_id", "below")).alias("first"), F.max("length").alias("deepest"), F.max("p1").alias("p1"), F.max("p2").alias("p2")))
    # leaves: sequences that are no proper prefix of another
    inner = nodes.where("deepest > depth").select(*_KEY)
    leaves = sequences.join(inner, _KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    # the nodes that a sequence is the first to have are all from some depth on
    firsts = nodes.groupBy(F.col("first.conv_id").alias("conv_id")).agg(F.min(F.struct("depth", "first.below")).alias("own"))
    about = sequences.select("conv_id").join(leaves, "conv_id", "left").join(firsts, "conv_id", "left")
    alone = F.when(F.col("depth") >= F.col("own.depth"), F.col("below")).otherwise(F.col("own.below"))
    sums = paths.join(about, "conv_id").groupBy(*_KEY).agg(
        F.count("leaf").alias("n_leaves"), F.sum(F.col("weight") * F.col("below") - F.coalesce(alone, zero)).alias("saved_tokens"))

    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("first.conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, _KEY).join(children, _KEY, "left").join(_ends(whole), _KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
    return out.select(
        F.col("first.conv_id").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op11(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations."""
    return trie(*rebuilt(placed(conversations)))


SQL = r"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS tab),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(role), ':', role, text))) AS pos, concat(length(role), ':', role, text) AS said, strlen(text) AS bytes
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
k AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
h AS (SELECT conv_id AS c, conv_id - (conv_id % 5 + 5) % 5 AS head, xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
  lambda s, x: xor(s >> 8, tab[(xor(s, x) & 255) + 1])), 4294967295) % 9 AS h FROM k, t),
c AS (SELECT c, head, h, least(h, coalesce(n, 0)) AS shared FROM h LEFT JOIN k ON head = conv_id),
r AS (SELECT c, pos - h + shared AS place, said, bytes FROM o JOIN c ON conv_id = c WHERE pos > h UNION ALL SELECT c, pos, said, bytes FROM o JOIN c ON conv_id = head WHERE pos <= shared),
p AS (SELECT c, place AS depth, sha256(string_agg(sha256(said), '' ) OVER (PARTITION BY c ORDER BY place)) AS node, bytes FROM r UNION ALL SELECT c, 0, '', 0 FROM c),
q AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS above, depth = max(depth) OVER (PARTITION BY c) AS ends FROM p),
n AS (SELECT depth, node, min(above) AS above, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, min(c) AS member, bool_and(ends) AS leaf,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY depth, node),
s AS (SELECT a.depth, a.node, count(*) FILTER (n.leaf) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens FROM n JOIN p a ON n.member = a.c AND a.depth <= n.depth GROUP BY a.depth, a.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, (SELECT count(*) FROM n k WHERE k.depth = n.depth + 1 AND k.above = n.node) AS n_children,
  s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.depth = n.depth AND s.node = n.node LEFT JOIN n u ON u.depth = n.depth - 1 AND u.node = n.above
"""
