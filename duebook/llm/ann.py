"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Equal vectors form a class; a class is searched once and answered for by its members with the smallest ids, so copies cost nothing.
Inner products become distances by one more coordinate (the square root of the largest squared norm less one's own). A random
rotation spreads every difference evenly over the coordinates, which are scanned in blocks of columns: after d of D of them, a candidate
whose partial distance times D/d exceeds the query's bound by more than chance allows (factor (1 + EPSILON / sqrt(d))^2 on squared
distances) is abandoned. What survives all blocks is scored exactly, in double precision, on the original vectors. Every answer comes from
these scans.

Lists grow with the table: LISTS * sqrt(classes) of them, in two levels, so centres, lists and what a query meets all grow with the square
root. The coarse centres come from a sample (at most SAMPLE classes and SAMPLE_BYTES, smallest hashes of their ids); the fine ones of a
coarse list from at most TRAIN of its classes each and TRAIN_BYTES in all, in a task per coarse list. Every class is put into a list. How many coarse and fine
lists a query probes is measured: CALIBRATE queries are compared with all classes, and the counts are the least that hold COARSE and FINE
of their true neighbours. The FIRST lists are scanned at once; the best they hold bound the scan of the others. A query that its lists
leave with too few candidates goes through all lists.

Vectors that are null, zero, hold null or non-finite components or have another length than most take no part, nor do rows without id;
of several vectors under one id (repeats) the first in order stays. Ties go to the smaller id. Fewer candidates than k: all of them. Empty
table: no rows. Other columns are not read. Lists are cut into chunks of BLOCK classes and BLOCK queries, so a hot list is many small tasks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duebook.llm.common import bounded_broadcast, cut, staged

SAMPLE, SAMPLE_BYTES = 16_384, 64_000_000
#: Lists per square root of the classes, classes a list has at least on average, fine lists of a coarse one at most, classes that train one.
LISTS, LEAST, MOST_FINE, TRAIN = 2.0, 8, 1024, 16
#: Bytes of vectors that train one coarse list's fine lists: of wide vectors fewer than TRAIN a list.
TRAIN_BYTES = 1 << 26
CALIBRATE, COARSE, FINE = 64, 0.997, 0.985
FIRST = 8
BLOCK, CHUNK, COLUMNS, EPSILON, SEED = 2_000, 20_000, 16, 2.1, 7
#: Lists up to this count (16 bytes each) are broadcast with their chunks.
MOST_LISTS = 1_000_000
#: A fine list's number: its coarse list's times this, and its place there.
SPAN = 1 << 20


def clean(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): one usable vector per id."""
    v = F.col("embedding").cast("array<double>")
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = embeddings.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(usable)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if lengths:
        rows = rows.where(F.size("v") == lengths[0]["n"])
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _kmeans(x: np.ndarray, n: int) -> np.ndarray:
    """n centres of the rows, by eight rounds from a fixed start."""
    rng = np.random.default_rng(SEED)
    centres = x[np.sort(rng.choice(len(x), min(n, len(x)), replace=False))]
    for _ in range(8):
        at = _nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _far(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less each query's own square, which changes no order."""
    return np.einsum("ij,ij->i", centres, centres) - 2 * q @ centres.T


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_far(x[k : k + 4096], centres).argmin(1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """What every task needs: rotation and coarse centres."""

    def __init__(self, v: np.ndarray, most: float, coarse: int):
        self.most = most
        d = v.shape[1] + 1
        self.rotation = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))[0]
        self.centres = _kmeans(self.turned(v), coarse)

    def turned(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.most - np.einsum("ij,ij->i", v, v), 0))
        return np.column_stack([v, rest]) @ self.rotation

    def order(self, q: np.ndarray) -> np.ndarray:
        """Coarse lists by closeness to each query."""
        return np.argsort(_far(q, self.centres), axis=1, kind="stable")

    def scan(self, q: np.ndarray, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, candidate) that no block of columns has abandoned."""
        dims = q.shape[1]
        partial = np.zeros((len(q), len(x)))
        rows = cols = None
        for lo in range(0, dims, COLUMNS):
            hi = min(lo + COLUMNS, dims)
            a, b = q[:, lo:hi], x[:, lo:hi]
            limit = bound * (1 if hi == dims else (1 + EPSILON / np.sqrt(hi)) ** 2 * hi / dims) + 1e-9
            if rows is None:
                partial += np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * a @ b.T
                alive = partial <= limit[:, None]
                if hi == dims or alive.sum() < 0.25 * alive.size:
                    rows, cols = np.nonzero(alive)
                    partial = partial[rows, cols]
            else:
                partial = partial + ((a[rows] - b[cols]) ** 2).sum(1)
                keep = partial <= limit[rows]
                rows, cols, partial = rows[keep], cols[keep], partial[keep]
        return rows, cols


def _top(rows, ids, scores, k):
    """Positions of the best k of each row, by score then id."""
    order = np.lexsort((ids, -scores, rows))
    r = rows[order]
    start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
    place = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
    return order[place < k]


def _least(ranks: list[int], share: float) -> int:
    """How many places from the first hold the share of the ranks (from 0)."""
    ranks = sorted(ranks)
    return ranks[min(len(ranks) - 1, int(share * len(ranks)))] + 1 if ranks else 1


class _Lists:
    """The inverted lists of a table of classes (cid, v, q)."""

    def __init__(self, classes: DataFrame, n: int, most: float, width: int):
        spark = classes.sparkSession
        lists = max(1, min(round(LISTS * math.sqrt(n)), n // LEAST))
        drawn = classes.orderBy(F.xxhash64("cid"), "cid").limit(max(64, min(SAMPLE, SAMPLE_BYTES // (8 * width + 8)))).select("v").toArrow()
        self.index = Index(_matrix(drawn.column("v")), most, math.ceil(math.sqrt(lists)))
        self.held = spark.sparkContext.broadcast(self.index)
        rough = staged(classes.select("cid", "v", "q").mapInArrow(self._coarse(), "cid long, v array<double>, q boolean, coarse int"))
        sizes = rough.groupBy("coarse").agg(F.count(F.lit(1)).alias("n"))
        fine = F.greatest(F.lit(1), F.least(F.lit(MOST_FINE), F.round(F.col("n") * lists / n))).cast("int")
        sizes = F.broadcast(staged(sizes.select("coarse", fine.alias("fine"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))))  # a row per coarse list
        each = max(4, min(TRAIN, TRAIN_BYTES // (8 * width * MOST_FINE)))
        place = F.row_number().over(W.partitionBy("coarse").orderBy(F.xxhash64("cid"), "cid"))
        some = rough.select("coarse", "cid", "v", place.alias("place")).where(F.col("place") <= each * MOST_FINE).join(sizes, "coarse").where(F.col("place") <= each * F.col("fine"))
        self.fine = staged(some.select("coarse", "fine", "v").groupBy("coarse").applyInArrow(self._train(), "coarse int, lst long, centre array<double>"))
        rough = rough.join(sizes.select("coarse", "chunks"), "coarse").withColumn("t", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
        centres = self.fine.join(sizes.select("coarse", "chunks"), "coarse").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        put = rough.select("coarse", "t", "cid", "v", "q").groupBy("coarse", "t").cogroup(centres.select("coarse", "t", "lst", "centre").groupBy("coarse", "t"))
        self.placed = staged(put.applyInArrow(self._put(), "cid long, v array<double>, q boolean, lst long"))

    def _coarse(self):
        import pyarrow as pa

        held = self.held

        def run(batches):
            for b in batches:
                at = _nearest(held.value.turned(_matrix(b.column("v"))), held.value.centres)
                yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("v"), b.column("q"), pa.array(at, pa.int32())], ["cid", "v", "q", "coarse"])

        return run

    def _train(self):
        import pyarrow as pa

        held = self.held

        def run(rows):
            coarse = rows.column("coarse")[0].as_py()
            centres = _kmeans(held.value.turned(_matrix(rows.column("v"))), rows.column("fine")[0].as_py())
            return pa.table({"coarse": pa.array([coarse] * len(centres), pa.int32()), "lst": pa.array(coarse * SPAN + np.arange(len(centres))), "centre": pa.array(list(centres), pa.list_(pa.float64()))})

        return run

    def _put(self):
        import pyarrow as pa

        held = self.held

        def run(rows, fine):
            if not rows.num_rows:
                return pa.table({"cid": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64())), "q": pa.array([], pa.bool_()), "lst": pa.array([], pa.int64())})
            lst = fine.column("lst").to_numpy()[_nearest(held.value.turned(_matrix(rows.column("v"))), _matrix(fine.column("centre")))]
            return pa.table({"cid": rows.column("cid"), "v": rows.column("v"), "q": rows.column("q"), "lst": pa.array(lst)})

        return run

    def _exact(self, ids: np.ndarray, v: np.ndarray, k: int):
        """The best k of every batch for a few queries."""
        import pyarrow as pa

        def run(batches):
            for b in batches:
                if b.num_rows:
                    scores = v @ _matrix(b.column("v")).T
                    cid = b.column("cid").to_numpy()
                    scores[ids[:, None] == cid[None]] = -np.inf
                    q = np.repeat(np.arange(len(ids)), b.num_rows)
                    at = _top(q, np.tile(cid, len(ids)), scores.ravel(), k)
                    yield pa.RecordBatch.from_arrays([pa.array(q[at].astype(np.int32)), pa.array(np.tile(cid, len(ids))[at]), pa.array(np.tile(b.column("lst").to_numpy(), len(ids))[at]), pa.array(scores.ravel()[at])], ["query", "cid", "lst", "score"])

        return run

    def _distances(self, q: np.ndarray):
        import pyarrow as pa

        def run(batches):
            for b in batches:
                if b.num_rows:
                    far = _far(q, _matrix(b.column("centre")))
                    lst = np.tile(b.column("lst").to_numpy(), len(q))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), b.num_rows)), pa.array(lst), pa.array(far.ravel())], ["query", "lst", "far"])

        return run

    def calibrate(self, k: int) -> tuple[int, int]:
        """(coarse lists, fine lists) to probe: what holds the true neighbours of a few queries, found by comparing these with every class."""
        few = self.placed.where("q").orderBy(F.xxhash64("cid"), "cid").limit(CALIBRATE).select("cid", "v").toArrow()
        if not len(few):
            return 1, 1
        ids, v = few.column("cid").to_numpy(), _matrix(few.column("v"))
        first = W.partitionBy("query").orderBy(F.desc("score"), "cid")
        best = self.placed.select("cid", "v", "lst").mapInArrow(self._exact(ids, v, k), "query int, cid long, lst long, score double")
        best = cut(best.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).where("score > double('-Infinity')").select("query", "lst"))
        turned = self.index.turned(v, query=True)
        coarse = np.argsort(self.index.order(turned), axis=1)
        near = [int(coarse[r["query"], r["lst"] // SPAN]) for r in best.collect()]  # k rows a query
        far = self.fine.select("lst", "centre").mapInArrow(self._distances(turned), "query int, lst long, far double")
        ranked = far.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("far", "lst")) - 1)
        ranks = [r["rank"] for r in best.join(ranked, ["query", "lst"]).select("rank").collect()]
        return _least(near, COARSE), _least(ranks, FINE)

    def probes(self, queries: DataFrame, coarse: int, fine: int) -> DataFrame:
        """(cid, v, probes): the nearest fine lists among those of the nearest coarse ones, nearest first."""
        import pyarrow as pa

        held = self.held

        def nearest(batches):
            for b in batches:
                v = _matrix(b.column("v"))
                lists = held.value.order(held.value.turned(v, query=True))[:, :coarse] if len(v) else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("v"), pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32()))], ["cid", "v", "lists"])

        def best(q, centres):
            schema = pa.schema([("cid", pa.int64()), ("lst", pa.int64()), ("far", pa.float64())])
            if not q.num_rows or not centres.num_rows:
                return schema.empty_table()
            far = _far(held.value.turned(_matrix(q.column("v")), query=True), _matrix(centres.column("centre")))
            keep = np.argpartition(far, min(fine, far.shape[1]) - 1, axis=1)[:, :fine]
            rows = np.repeat(np.arange(len(far)), keep.shape[1])
            return pa.table([q.column("cid").to_numpy()[rows], centres.column("lst").to_numpy()[keep.ravel()], far[rows, keep.ravel()]], schema=schema)

        asked = queries.mapInArrow(nearest, "cid long, v array<double>, lists array<int>").select("cid", "v", F.explode("lists").alias("coarse"))
        counts = staged(asked.groupBy("coarse").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))  # a row per coarse list
        asked = asked.join(F.broadcast(counts), "coarse").withColumn("t", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
        centres = self.fine.join(F.broadcast(counts), "coarse").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        found = asked.select("coarse", "t", "cid", "v").groupBy("coarse", "t").cogroup(centres.select("coarse", "t", "lst", "centre").groupBy("coarse", "t"))
        found = found.applyInArrow(best, "cid long, lst long, far double")
        place = F.row_number().over(W.partitionBy("cid").orderBy("far", "lst"))
        found = found.withColumn("place", place).where(F.col("place") <= fine)
        lists = found.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("place", "lst"))).alias("p"))
        return queries.join(lists, "cid").select("cid", "v", F.col("p.lst").alias("probes"))

    def scanned(self, asked: DataFrame, k: int) -> DataFrame:
        """(query, cid, score): the best k of every chunk of a list for the queries (cid, v, bound, lst) that ask it."""
        import pyarrow as pa

        held = self.held
        chunks = lambda rows, name: rows.groupBy("lst").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
        sizes = staged(chunks(asked, "nt").join(chunks(self.placed, "ns"), "lst"))
        sizes = bounded_broadcast(sizes, sizes.count(), MOST_LISTS)
        spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        deal = lambda c: F.pmod(F.xxhash64("cid"), F.col(c)).cast("int")
        left = asked.join(sizes, "lst").withColumn("t", deal("nt")).withColumn("s", spread("ns")).select("lst", "s", "t", "cid", "v", "bound")
        right = self.placed.join(sizes, "lst").withColumn("s", deal("ns")).withColumn("t", spread("nt")).select("lst", "s", "t", "cid", "v")

        def scan(q, x):
            schema = pa.schema([("query", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])
            if not q.num_rows or not x.num_rows:
                return schema.empty_table()
            qv, xv = _matrix(q.column("v")), _matrix(x.column("v"))
            rows, cols = held.value.scan(held.value.turned(qv, query=True), held.value.turned(xv), q.column("bound").to_numpy())
            ids, scores = x.column("cid").to_numpy()[cols], np.einsum("ij,ij->i", qv[rows], xv[cols])
            at = _top(rows, ids, scores, k)
            return pa.table([q.column("cid").to_numpy()[rows[at]], ids[at], scores[at]], schema=schema)

        return left.groupBy("lst", "s", "t").cogroup(right.groupBy("lst", "s", "t")).applyInArrow(scan, "query long, cid long, score double")


def search(embeddings: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which the column ``is_query`` holds."""
    spark = embeddings.sparkSession
    base = staged(clean(embeddings).withColumn("q", is_query))
    classes = staged(base.groupBy("v").agg(F.min("vec_id").alias("cid"), F.max("q").alias("q")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    total = classes.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most"), F.max(F.size("v")).alias("width")).first()
    if not total["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = k + 1
    lists = _Lists(classes, total["n"], total["most"], total["width"])
    coarse, fine = lists.calibrate(k)
    queries = staged(lists.probes(lists.placed.where("q").select("cid", "v"), coarse, fine))
    ask = lambda rows, some: rows.select("cid", "v", "bound", F.explode(some).alias("lst"))
    one = cut(lists.scanned(ask(queries.withColumn("bound", F.lit(float("inf"))), F.slice("probes", 1, FIRST)), best))
    # distance bounds of the best scores: both sides have norms that make the distance |q|^2 + most - 2 score
    first = W.partitionBy("query").orderBy(F.desc("score"), "cid")
    least = one.withColumn("place", F.row_number().over(first)).where(F.col("place") == best).select(F.col("query").alias("cid"), F.col("score").alias("kth"))
    near = norm + F.lit(total["most"]) - 2 * F.col("kth")
    bounded = queries.join(least, "cid", "left").select("cid", "v", "probes", F.coalesce(near, F.lit(float("inf"))).alias("bound"))
    two = lists.scanned(ask(bounded, F.slice("probes", FIRST + 1, max(1, fine))), best)
    # a class is in one list: no pair comes twice
    hits = one.unionByName(two).withColumn("place", F.row_number().over(first)).where(F.col("place") <= best).drop("place")
    hits = cut(hits)
    enough = min(best, total["n"])
    few = queries.join(hits.groupBy(F.col("query").alias("cid")).count().where(F.col("count") >= enough), "cid", "left_anti")
    if not few.isEmpty():
        all_lists = lists.probes(few.select("cid", "v"), len(lists.index.centres), lists.fine.count()).withColumn("bound", F.lit(float("inf")))
        more = lists.scanned(ask(all_lists, F.col("probes")), best)
        hits = hits.join(few.select(F.col("cid").alias("query")), "query", "left_anti").unionByName(more)
        hits = hits.withColumn("place", F.row_number().over(first)).where(F.col("place") <= best).drop("place")
    # at most k + 1 classes a query, then at most k + 1 members a class: no other can be among the first k + 1
    member = W.partitionBy("cid").orderBy("vec_id")
    members = cut(base.join(classes.select("v", "cid"), "v").select("cid", "vec_id", "q"))
    smallest = members.withColumn("place", F.row_number().over(member)).where(F.col("place") <= best).select("cid", "vec_id")
    listed = hits.join(smallest, "cid").groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("found"))
    out = members.where("q").select(F.col("cid").alias("query"), F.col("vec_id").alias("query_id")).join(listed, "query")
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(own).alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score")
    )


def op8(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("vec_id") % 20 == 0, 20)
