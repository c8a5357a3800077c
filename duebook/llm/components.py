"""Connected components of a link table by contraction, on executors only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import discard, staged


#: Rows of a task: a step's table has as many files as its rows need, however many partitions the session gives a shuffle.
TASK_ROWS = 250_000


def _flat(parents: DataFrame, parts: int) -> DataFrame:
    """(u, p) with p the root of u's tree: parents are jumped over, which halves every tree's depth, until nothing moves."""
    while True:
        above = parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jumped = staged(parents.join(above, "p").select("u", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")).coalesce(parts))
        discard(parents)
        parents = jumped
        if parents.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b); comp is the component's smallest node. Self links and repeats change nothing.

    Each round every node picks its smallest neighbour. The picks form trees but for pairs that pick each other, of which the smaller node
    becomes the root (longer cycles cannot be: the pick after the next is never larger, so around a cycle all are equal). Trees are made flat
    and contracted. Each has two nodes or more, so a round at least halves what is left of a component: at most log2 of its nodes rounds of
    at most log2 of a tree's depth jumps; a chain in order takes one round. Every step is a table in the shared folder, so plans stay
    small and sizes known; hot nodes are pre-aggregated or sit on the large side of a join, which AQE splits.
    """
    links = staged(links.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    parts = max(1, math.ceil(2 * links.count() / TASK_ROWS))
    put = lambda rows: staged(rows.coalesce(parts))
    labels = put(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("comp", F.col("node")))
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pick = put(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("u"), "p"))
        back = pick.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        root = (F.col("pp") == F.col("u")) & (F.col("u") < F.col("p"))
        tops = _flat(put(pick.join(back, "p").select("u", F.when(root, F.col("u")).otherwise(F.col("p")).alias("p"))), parts)
        discard(pick)
        tops_of = lambda c: tops.select(F.col("u").alias(c), F.col("p").alias("top"))
        named = put(labels.join(tops_of("comp"), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))
        one = links.join(tops_of("a"), "a").select(F.col("top").alias("a"), "b")
        two = one.join(tops_of("b"), "b").select("a", F.col("top").alias("b"))
        left = put(two.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        for table in (labels, links, tops):
            discard(table)
        labels, links = named, left
    least = labels.groupBy("comp").agg(F.min("node").alias("least"))
    return put(labels.join(least, "comp").select("node", F.col("least").alias("comp")))
