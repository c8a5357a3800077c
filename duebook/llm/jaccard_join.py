"""Exact n-gram Jaccard join by vertical partitioning.

A document's set: its distinct 5-word shingles (ASCII lower case) as 64-bit hashes; documents with equal sets are one node. The global
order of shingles is: those that few documents share before those that many share (*heavy* ones), by hash within both.

1. One pass reads all texts: set size and 128-bit signature per document, and the lower half of each set by hash, from which it is counted
   how many documents hold a shingle (partial sums before the shuffle). The heaviest (HEAVY or more, at most MOST_HEAVY shingles) go to
   the end of the order. Any fixed choice gives the same links; a good one gives few candidates. A node goes by half of its signature, or
   by the other half where two sets share the first one.
2. A second pass emits each node's prefix in that order: two sets of Jaccard 0.8 share a shingle of their prefixes. Shingles with more
   than one node are kept.
3. Per shingle, every node is compared with the list's first node only (a star, never all pairs). The sets of the nodes concerned are
   cut into fragments of the global order; partial overlaps are counted per pair and fragment and summed per pair.
4. Linked nodes contract to components. Lists whose nodes still lie in several components are then compared across components: lists of
   up to SMALL nodes as pairs, under the length and position bounds, counted likewise; longer ones in blocks of BLOCK nodes or
   BLOCK_SHINGLES shingles, each fragment's partial overlaps as a product of incidence matrices, summed over the fragments, of which only
   links that join components leave the task. Where a list makes more than one block, first each node's shingles that another component of
   the list holds are counted: they bound its overlaps, and so the sizes of sets that it can link with. Blocks are cut by size, and only
   blocks whose sizes and bounds allow a link meet. Many alike nodes that are all just short of linking are dropped there, in linear time.
   A link between two nodes of one component cannot change a component, so no link is lost.

Null or empty text: no shingles, linked with nothing. Null doc_id: counted, component null, linked with nothing. Rows that repeat a
doc_id: each a row of the result; equal texts fall into one node like copies. Ties: none, the smallest id names a component. Long texts:
arrays of 8 bytes a shingle, one text at a time. Columns other than doc_id and text are not read. Empty table: no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duebook.llm.common import bounded_broadcast, cut, discard, free_shuffles, map_rows, release, same_columns, small_batches, staged
from duebook.llm.components import components

WORDS = 5
#: Link: 100 * intersection >= 80 * union, that is 9 * intersection >= 4 * (sum of the set sizes).
HEAVY, MOST_HEAVY = 8, 1 << 20
FRAGMENTS = 8
SMALL, BLOCK, COLUMNS = 12, 400, 8192
#: Set sizes of one class of a long list differ by this factor at most.
RATIO = 1.03
#: Shingles of a block, and documents read at once.
BLOCK_SHINGLES, ROWS = 400_000, 400
#: Wanted documents up to this count are broadcast (16 bytes each) to pick their texts; more are joined by shuffle.
MOST_WANTED = 1_000_000
#: Bytes of text hashed at once.
PIECE = 1 << 19


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Longer words (bytes) are hashed one by one.
LONG_WORD = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word: all words at once, eight bytes after eight bytes through a mixing step."""
    from xxhash import xxh3_64_intdigest

    padded = b" " + raw + b" " * 8
    buf = np.frombuffer(padded, np.uint8)
    eight = np.ndarray(len(buf) - 7, "<u8", padded, strides=(1,))
    space = _SPACE[buf]
    start, end = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    size = end - start
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    who = np.flatnonzero(size <= LONG_WORD)
    at, left = start[who], size[who]
    while len(who):
        chunk = eight[at]
        part = left < 8
        chunk[part] &= (np.uint64(1) << (left[part].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[who] = _mixed(h[who] ^ chunk)
        more = left > 8
        who, at, left = who[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = xxh3_64_intdigest(padded[start[k] : end[k]])
    return h, start - 1


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts are read some megabytes at a time."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < PIECE):
            group.append((texts[at] or "").encode("utf-8", "replace").lower())  # bytes: A-Z only
            size += len(group[-1])
            at += 1
        out += _sets(group) if size < 2 * PIECE else [x for g in group for x in _sets([g])]
    return out


def _sets(group: list[bytes]) -> list[np.ndarray]:
    if len(group) == 1 and len(group[0]) > PIECE:  # one long text: hashes piece by piece, cut at white space
        raw, hashes, at = group[0], [], 0
        while at < len(raw):
            cut_at = at + PIECE
            m = re.search(rb"[\x20\x09-\x0D]", raw[cut_at : cut_at + PIECE]) if cut_at < len(raw) else None
            stop = cut_at + m.start() if m else len(raw)
            hashes.append(_word_hashes(raw[at:stop])[0])
            at = stop
        h, n = np.concatenate(hashes), None
        n = np.array([len(h)])
    else:
        h, start = _word_hashes(b" ".join(group))
        first = np.cumsum([0, *(len(g) + 1 for g in group)])[:-1]
        n = np.bincount(np.searchsorted(first, start, "right") - 1, minlength=len(group)) if len(start) else np.zeros(len(group), np.int64)
    whole = _windows(h, WORDS) if len(h) >= WORDS else np.zeros(0, np.uint64)
    made, at = [], 0
    for k in n.tolist():
        tokens = np.sort(whole[at : at + k - WORDS + 1] if k >= WORDS else _windows(h[at : at + k], k)) if k else np.zeros(0, np.uint64)
        made.append(tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])] if k else tokens)
        at += k
    return made


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return _mixed(out)


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


def signature(tokens: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two independent numbers of a set; ``bits`` of the first (tests give few)."""
    from xxhash import xxh3_128_intdigest

    both = xxh3_128_intdigest(tokens.tobytes())
    return both % (1 << 64) % (1 << bits) - (1 << 63), (both >> 64) - (1 << 63)


class _Names:
    """A node's number: the first half of the signature, or the second where different sets share the first."""

    def __init__(self, clashes: frozenset[int], bits: int):
        self.clashes, self.bits = clashes, bits

    def __call__(self, tokens: np.ndarray) -> int:
        one, two = signature(tokens, self.bits)
        return two if one in self.clashes else one


def _read(bits: int):
    """Pass 1: a row (doc_id, x, n, sig, sig2) per document; per batch a row (low) of the lower halves of its sets."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("sig2", pa.int64()), ("low", pa.list_(pa.int64()))])

    def run(batches):
        release()
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                sizes, sigs, halves, seen = [], [], [], set()
                for tokens in shingle_sets(batch.column("text").to_pylist()):
                    sig = signature(tokens, bits) if len(tokens) else (None, None)
                    sizes.append(len(tokens))
                    sigs.append(sig)
                    if len(tokens) and sig not in seen:
                        seen.add(sig)
                        halves.append(tokens[: (len(tokens) + 1) // 2])
                one, two = zip(*sigs, strict=True)
                none = pa.nulls(batch.num_rows).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("x"), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), none], schema=schema)
                if halves:
                    low = pa.ListArray.from_arrays(pa.array([0, sum(map(len, halves))], pa.int32()), pa.array(np.concatenate(halves).view(np.int64)))
                    none = pa.nulls(1).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, none, none, none, low], schema=schema)

    return run


def heavy_shingles(read: DataFrame) -> np.ndarray:
    """The heaviest shingles, sorted, at most MOST_HEAVY of them."""
    counted = read.where("low IS NOT NULL").select(F.explode("low").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("nodes"))
    counted = cut(counted.where(F.col("nodes") >= HEAVY))
    levels = counted.groupBy(F.floor(F.log2("nodes")).alias("level")).count().orderBy(F.desc("level")).collect()  # at most 40 rows
    total, least = 0, HEAVY
    for r in levels:
        total += r["count"]
        if total > MOST_HEAVY:
            least = 2 ** (r["level"] + 1)
            break
    keys = counted.where(F.col("nodes") >= least).select("t").toArrow().column("t").to_numpy()
    return np.sort(keys.view(np.uint64)) if len(keys) else np.zeros(0, np.uint64)


def _is_heavy(tokens: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(tokens), bool)
    return heavy[np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)] == tokens


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def prefix(tokens: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order that a set of Jaccard 0.8 cannot all miss."""
    p = prefix_length(len(tokens))
    look = min(len(tokens), 2 * p + 16)
    light = tokens[:look][~_is_heavy(tokens[:look], heavy)]
    if len(light) < p and look < len(tokens):
        light = tokens[~_is_heavy(tokens, heavy)]
    if len(light) >= p:
        return light[:p]
    dark = tokens[_is_heavy(tokens, heavy)]
    return np.concatenate([light, dark])[:p]


def _prefixes(held, name: _Names):
    """Pass 2: rows (t, node, n, pos), once per node and batch."""
    import pyarrow as pa

    names = ["t", "node", "n", "pos"]

    def run(batches):
        release()
        heavy = held.value
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                parts, sigs, sizes, seen = [], [], [], set()
                for tokens in shingle_sets(big.slice(at, ROWS).column("text").to_pylist()):
                    if not len(tokens) or (sig := name(tokens)) in seen:
                        continue
                    seen.add(sig)
                    parts.append(prefix(tokens, heavy))
                    sigs.append(sig)
                    sizes.append(len(tokens))
                if parts:
                    k = np.fromiter(map(len, parts), np.int64, len(parts))
                    pos = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(sigs, np.int64), k)),
                        pa.array(np.repeat(np.array(sizes, np.int32), k)), pa.array(pos.astype(np.int32)),
                    ], names=names)

    return run


def _fragmented(held, name: _Names):
    """The sets of texts whose node is wanted, cut at fixed points of the global order: light shingles by hash range, then heavy ones."""

    def compute(batch):
        out = []
        for tokens, node in zip(shingle_sets(batch.column("text").to_pylist()), batch.column("node").to_pylist(), strict=True):
            if not len(tokens) or name(tokens) != node:  # another row under the same doc_id
                out.append([])
                continue
            k = (tokens >> np.uint64(64 - FRAGMENTS.bit_length() + 1)).astype(np.int64)
            k += FRAGMENTS * _is_heavy(tokens, held.value)
            values = tokens.view(np.int64)
            out.append([{"k": int(i), "s": values[k == i].tolist()} for i in np.unique(k)])
        return [out]

    return compute


def _possible(na, pa_, nb, pb) -> F.Column:
    """Length and position bounds: what is left of both sets from a first common shingle on must still suffice."""
    return (5 * na >= 4 * nb) & (5 * nb >= 4 * na) & (9 * F.least(na - pa_, nb - pb) >= 4 * (na + nb))


def _arrays(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, comp, lengths, all shingles one set after the other) of a block's side."""
    sets = table.column("s").combine_chunks()
    length = np.diff(np.asarray(sets.offsets)) if len(sets) else np.zeros(0, np.int64)
    return table.column("node").to_numpy(), table.column("comp").to_numpy(), length.astype(np.int64), sets.flatten().to_numpy().view(np.uint64)


def overlaps(la: np.ndarray, a: np.ndarray, lb: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: partial counts per fragment of the hash range, summed."""
    total = np.zeros((len(la), len(lb)), np.float32)
    row_a, row_b = np.repeat(np.arange(len(la)), la), np.repeat(np.arange(len(lb)), lb)
    shift = np.uint64(64 - FRAGMENTS.bit_length() + 1)
    for k in range(FRAGMENTS):
        in_a, in_b = (a >> shift) == k, (b >> shift) == k
        ta, tb, ra, rb = a[in_a], b[in_b], row_a[in_a], row_b[in_b]
        both = np.intersect1d(ta, tb)
        for lo in range(0, len(both), COLUMNS):
            some = both[lo : lo + COLUMNS]
            sides = []
            for t, r, n in ((ta, ra, len(la)), (tb, rb, len(lb))):
                at = np.minimum(np.searchsorted(some, t), len(some) - 1)
                hit = some[at] == t
                m = np.zeros((n, len(some)), np.float32)
                m[r[hit], at[hit]] = 1
                sides.append(m)
            total += sides[0] @ sides[1].T
    return total


def _block(table):
    """Links between the nodes of two blocks (or within one), as few as join their components in the same way."""
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if not table.num_rows:
        return schema.empty_table()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    left, right = (table.filter(pc.equal(table.column("block"), x)) for x in (i, j))
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    na, ca, la, ta = _arrays(left)
    nb, cb, lb, tb = _arrays(right)
    common = overlaps(la, ta, lb, tb)
    rows, cols = np.nonzero((9 * common >= 4 * (la[:, None] + lb[None])) & (ca[:, None] != cb[None]))
    up: dict[int, int] = {}

    def root(x):
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(ca[rows].tolist(), cb[cols].tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(k)
    return pa.table([na[rows[keep]], nb[cols[keep]]], schema=schema)


class _Join:
    def __init__(self, docs: DataFrame, bits: int = 64):
        self.docs = docs.select("doc_id", "text")
        spark = docs.sparkSession
        small_batches(spark)
        rows = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("x"), "text")
        read = staged(rows.mapInArrow(_read(bits), "doc_id long, x long, n long, sig long, sig2 long, low array<long>"))
        self.heavy = spark.sparkContext.broadcast(heavy_shingles(read))
        rows = read.where("n IS NOT NULL")
        # two sets with one first half: about one for 10^10 documents
        halves = rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min("sig2").alias("lo"), F.max("sig2").alias("hi"))
        clashes = frozenset(r["sig"] for r in halves.where("lo < hi").select("sig").collect())
        node = F.when(F.col("sig").isin(list(clashes)), F.col("sig2")).otherwise(F.col("sig")) if clashes else F.col("sig")
        self.sizes = staged(rows.select("doc_id", "x", "n", node.alias("node"), "sig"))
        if clashes and not self.sizes.groupBy("node").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo < hi").isEmpty():
            raise ValueError("three sets share halves of their signatures")
        discard(read, free=True)
        self.name = _Names(clashes, bits)
        self.repeats = not self.sizes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
        self.first = self.sizes.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))

    def live(self) -> DataFrame:
        """Prefix rows of the shingles that two nodes or more have there, with the list's first node."""
        rows = staged(self.docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_prefixes(self.heavy, self.name), "t long, node long, n int, pos int"))
        ends = rows.groupBy("t").agg(F.min("node").alias("lead"), F.max("node").alias("hi"))
        shared = staged(ends.where("lead < hi").select("t", "lead"))
        free_shuffles(rows.sparkSession)
        out = staged(rows.join(shared, "t"))
        discard(shared)
        discard(rows, free=True)
        return out

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, parts) of the nodes: their sets from one of their texts, cut into fragments."""
        wanted = cut(nodes.join(self.first, "node").select(F.col("first").alias("doc_id"), "node"))
        texts = self.docs.join(bounded_broadcast(wanted, wanted.count(), MOST_WANTED), "doc_id").select("node", "text")
        made = map_rows(texts, _fragmented(self.heavy, self.name), "parts array<struct<k int, s array<long>>>", ["node"], rows=200)
        made = made.where(F.size("parts") > 0)
        # rows that repeat a doc_id and its text give the same set twice
        return staged(made.dropDuplicates(["node"]) if self.repeats else made)

    def links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of the pairs (a, b, na, nb), those that link: partial overlaps per fragment, summed."""
        parts = sets.select("node", F.inline("parts"))
        left = pairs.join(parts.select(F.col("node").alias("a"), "k", F.col("s").alias("sa")), "a")
        both = left.join(parts.select(F.col("node").alias("b"), "k", F.col("s").alias("sb")), ["b", "k"])
        partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common"))
        summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
        return summed.where(9 * F.col("common") >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")

    def block_links(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """Links across components among the nodes of each group (gid, node, n, comp), block by block."""
        whole = sets.select("node", F.flatten(F.transform("parts", lambda x: x["s"])).alias("s"))
        sized = rows.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), _blocks().alias("blocks"))
        sized = staged(sized.where("lo < hi").select("gid", "blocks"))
        rows = staged(rows.join(sized, "gid"))
        one = rows.where("blocks = 1").select("gid", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("block"), "node", "comp")
        placed = one.unionByName(self.in_blocks(rows.where("blocks > 1").drop("blocks"), whole))
        return placed.join(whole, "node").groupBy("gid", "i", "j").applyInArrow(_block, "a long, b long")

    def in_blocks(self, rows: DataFrame, whole: DataFrame) -> DataFrame:
        """(gid, i, j, block, node, comp): the nodes of large groups, once for every pair of blocks that may hold a link.

        A node with m shingles that other components of its group hold links only with sets of up to ``reach`` shingles, as
        9 * overlap >= 4 * (sum of sizes) and the overlap is m at most.
        """
        each = rows.join(whole, "node").select("gid", "node", "n", "comp", F.explode("s").alias("s"))
        held = each.groupBy("gid", "s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        common = staged(held.where("lo < hi").select("gid", "s"))
        mass = each.join(common, ["gid", "s"]).groupBy("gid", "node", "n", "comp").agg(F.count(F.lit(1)).alias("m"))
        able = staged(mass.select(
            "gid", "node", "n", "comp", F.floor(F.col("m") * 9 / 4 - F.col("n")).alias("reach"), F.floor(F.log("n") / F.log(F.lit(RATIO))).alias("class")
        ).where(5 * F.col("reach") >= 4 * F.col("n")))
        classes = staged(able.groupBy("gid", "class").agg(F.min("n").alias("least"), F.max("reach").alias("reach"), _blocks().alias("blocks")))
        side = lambda x: classes.select("gid", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "least", "reach", "blocks")])
        meet = (F.col("class_a") <= F.col("class_b")) & (F.col("least_a") <= F.col("reach_b")) & (F.col("least_b") <= F.col("reach_a"))
        pairs = side("a").join(side("b"), "gid").where(meet & (4 * F.col("least_b") <= 5 * RATIO * F.col("least_a") + 5))
        block = lambda x, k: F.shiftleft(F.col(f"class_{x}").cast("long"), 32) + k
        spread = lambda x: F.explode(F.sequence(F.lit(0), F.col(f"blocks_{x}") - 1))
        pairs = pairs.withColumn("ka", spread("a")).withColumn("kb", spread("b"))
        pairs = pairs.select("gid", block("a", F.col("ka")).alias("i"), block("b", F.col("kb")).alias("j")).where("i <= j")
        ends = staged(pairs.select("gid", "i", "j", F.col("i").alias("block")).union(pairs.where("i < j").select("gid", "i", "j", F.col("j").alias("block"))))
        able = able.join(classes.select("gid", "class", "blocks"), ["gid", "class"])
        able = able.withColumn("block", F.shiftleft(F.col("class").cast("long"), 32) + F.pmod(F.xxhash64("node"), F.col("blocks")))
        return able.join(ends, ["gid", "block"]).select("gid", "i", "j", "block", "node", "comp")


def _blocks() -> F.Column:
    """Blocks that a group's nodes make."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")


def _paired(rows: DataFrame) -> DataFrame:
    """Distinct pairs with the smaller node first."""
    swap = F.col("a") > F.col("b")
    ordered = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))]
    return rows.select(*ordered).distinct()


def groups(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return grouped(docs, bits).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def grouped(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Per row: doc_id, x (a hash of its text), n, component_id, and comp, the component's own number, null for rows linked with nothing."""
    join = _Join(docs, bits)
    live = join.live()
    # the first node's own row in each list
    leads = staged(live.where(F.col("node") == F.col("lead")).groupBy("t").agg(F.min("n").alias("lead_n"), F.min("pos").alias("lead_pos")))
    star = live.where(F.col("node") != F.col("lead")).join(leads, "t").where(_possible(F.col("n"), F.col("pos"), F.col("lead_n"), F.col("lead_pos")))
    tested = staged(_paired(star.select(F.col("lead").alias("a"), F.col("node").alias("b"), F.col("lead_n").alias("na"), F.col("n").alias("nb"))))
    discard(leads)
    nodes = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = join.sets(nodes(tested))
    linked = cut(join.links(tested, sets))
    comps = components(linked)

    placed = staged(live.distinct().join(comps, "node", "left").select("t", "node", "n", "pos", F.coalesce("comp", "node").alias("comp"), "lead"))
    discard(live, free=True)
    home = F.max(F.when(F.col("node") == F.col("lead"), F.col("comp")))
    lists = placed.groupBy("t").agg(home.alias("home"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), (F.count(F.lit(1)) > SMALL).alias("long"))
    lists = staged(lists.where("lo < hi").select("t", "home", "long"))
    mixed = staged(placed.join(lists, "t"))
    discard(lists)
    discard(placed)

    short = mixed.where("NOT long").withColumn("out", F.col("comp") != F.col("home"))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "pos", "comp")]
    apart = short.where("out").select("t", *side("a")).join(short.select("t", "out", *side("b")), "t").where(
        (F.col("comp_a") != F.col("comp_b")) & (~F.col("out") | (F.col("node_a") < F.col("node_b"))) & _possible(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"))
    )
    more = _paired(apart.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("n_a").alias("na"), F.col("n_b").alias("nb")))
    more = staged(more.join(tested.select("a", "b"), ["a", "b"], "left_anti"))

    # lists of one near-copy group mostly have the same lead; those whose lead is itself in an earlier list go with that one
    lists = mixed.where("long").select("lead", "node", "n", "comp").distinct()
    up = staged(lists.groupBy(F.col("node").alias("lead")).agg(F.min("lead").alias("up")))
    gathered = staged(lists.join(up, "lead", "left").select(F.least("lead", "up").alias("gid"), "node", "n", "comp").distinct())
    discard(mixed)
    wanted = nodes(more).union(gathered.select("node")).distinct()
    rest = join.sets(wanted.join(sets.select("node"), "node", "left_anti"))
    sets = sets.unionByName(rest)
    found = cut(join.links(more, sets).union(join.block_links(gathered, sets)))
    comps = components(linked.union(found))

    named = staged(join.first.join(comps, "node", "left").select("node", "first", F.coalesce("comp", "node").alias("comp")))
    least = staged(named.groupBy("comp").agg(F.min("first").alias("component_id")))
    names = staged(named.join(least, "comp").select("node", "component_id", "comp"))
    out = join.sizes.join(names, "node", "left")
    alone = F.col("node").isNull() | F.col("doc_id").isNull()
    return out.select("doc_id", "x", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(~alone, F.col("comp")).alias("comp"))


def op6(docs: DataFrame) -> DataFrame:
    return groups(docs)


@same_columns
def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every group: of its smallest doc_id, and where that has several of the group's texts, the one with the smallest hash.

    Rows without doc_id or without words are in no group and stay, as do unlike texts under one doc_id; of rows that repeat one another, one.
    """
    found = cut(grouped(docs).where("comp IS NOT NULL"))
    best = cut(found.where("doc_id = component_id").groupBy("comp").agg(F.min("x").alias("best")))
    gone = found.join(best, "comp").where((F.col("doc_id") != F.col("component_id")) | (F.col("x") != F.col("best"))).select("doc_id", F.col("x").alias("j__x")).distinct()
    keyed = docs.withColumn("j__x", F.xxhash64("text"))
    kept = keyed.join(gone, ["doc_id", "j__x"], "left_anti")
    again = cut(found.groupBy("doc_id", F.col("x").alias("j__x")).count().where("count > 1").drop("count"))
    if not again.isEmpty():
        kept = kept.join(again, ["doc_id", "j__x"], "left_anti").unionByName(kept.join(again, ["doc_id", "j__x"], "left_semi").dropDuplicates(["doc_id", "j__x"]))
    return kept.select(*docs.columns)
