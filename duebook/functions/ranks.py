"""Ranks of any number of rows, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.sources import shared

#: Low bits of ``monotonically_increasing_id``: the place of a row in its partition.
PLACE_BITS = 33


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows in order, written once, with ``__at``: their range partition above ``PLACE_BITS``, their place in it below.

    Spark draws the ranges from a sample of the rows' order, so partitions are of like sizes whatever the values look like; nothing but
    the sample and a row count per partition is known to the driver.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return shared.written(rows.withColumn("__at", F.monotonically_increasing_id()))


#: Rows up to which the ranked result is put in order by one task instead of by ranges.
FEW = 100_000


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``name``, 1 to n in an order that no two rows share, before the columns of ``df``, by rank; the input is computed once."""
    rows = placed(df, order).withColumn("__part", F.shiftright("__at", PLACE_BITS))
    sizes = sorted(tuple(r) for r in rows.groupBy("__part").agg(F.count(F.lit(1))).collect())  # a row per partition
    starts, n = [], 0
    for part, size in sizes:
        starts.append((part, n))
        n += size
    found = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    place = F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    made = rows.join(F.broadcast(found), "__part").withColumn(name, (F.col("__start") + place + 1).cast("int"))
    made = made.coalesce(1).sortWithinPartitions(name) if n <= FEW else made.orderBy(name)
    return made.select(name, *[f"`{c}`" for c in df.columns])
