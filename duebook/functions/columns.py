"""Derived columns and scalar helpers; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from duebook.schema import BUCKETS, SCORES


def rounded(x: Column, places: int = 2) -> Column:
    """Half-even on the scaled double."""
    return F.rint(x * 10**places) / 10**places


def number(x) -> Column:
    """A double; null for text that is none, and for NaN, which Spark would sort above every number."""
    x = F.col(x) if isinstance(x, str) else x
    return F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))


def ratio_pct(part: Column, whole: Column, places: int = 2) -> Column:
    """part / whole in percent; 0 where whole is 0 or missing."""
    return F.coalesce(rounded(F.try_divide(part.cast("double"), whole.cast("double")) * 100, places), F.lit(0.0))


def mom_pct(now: Column, before: Column) -> Column:
    """Movement against the size of the previous value; 0 where that is 0 or missing."""
    return F.coalesce(rounded(F.try_divide(now - before, F.abs(before)) * 100), F.lit(0.0))


def bucket(arrears_emi: Column) -> Column:
    """Delinquency bucket of arrears in instalments."""
    x = arrears_emi
    return F.when(x.isNull(), "NA").when(x <= 0, "STD").when(x < 1, "1-30 DPD").when(x < 2, "SMA-1").when(x < 3, "SMA-2").otherwise("NPA")


def score(name: Column) -> Column:
    """0 for STD to 4 for NPA; null for anything else."""
    out = None
    for b, s in SCORES.items():
        out = F.when(name == b, s) if out is None else out.when(name == b, s)
    return out


def with_buckets(df: DataFrame) -> DataFrame:
    """Adds curr_bucket and curr_score (NA: -1)."""
    df = df.withColumn("curr_bucket", bucket(number("arrears_emi")))
    return df.withColumn("curr_score", F.coalesce(score(F.col("curr_bucket")), F.lit(-1)))


def with_soh(df: DataFrame) -> DataFrame:
    """Adds soh, principal outstanding plus closing arrears; what is missing counts as 0."""
    parts = [F.coalesce(F.col(c), F.lit(0)) for c in ("pos", "closing_arrears") if c in df.columns]
    return df.withColumn("soh", sum(parts[1:], parts[0]) if parts else F.lit(0.0))


def first_bucket(df: DataFrame, name: str, *more: Column) -> DataFrame:
    """(loan_no, ``name``, and aggregates ``more``): the bucket of each loan's first row in the frame's order."""
    rows = df.where(F.col("loan_no").isNotNull()).select("loan_no", "curr_bucket", F.monotonically_increasing_id().alias("__row"))
    return rows.groupBy("loan_no").agg(F.min_by("curr_bucket", "__row").alias(name), *more)


def with_prev_bucket(curr: DataFrame, prev: DataFrame) -> DataFrame:
    """Adds prev_bucket by loan number from the whole previous snapshot; of repeated loans the first row counts."""
    before = first_bucket(prev, "prev_bucket")
    return curr.join(before, "loan_no", "left")


def arrears_ratio_pct() -> Column:
    """All arrears in percent of the loan amount, one place; null without a loan amount."""
    parts = [F.coalesce(number(c), F.lit(0.0)) for c in ("arr_inst", "arr_exp", "arr_bc")]
    return rounded(F.try_divide(parts[0] + parts[1] + parts[2], number("loan_amount")) * 100, 1)


def pair_label(first: str, second: str) -> Column:
    return F.concat(F.col(first).cast("string"), F.lit(" ("), F.col(second).cast("string"), F.lit(")"))


def band(x: Column, *levels: tuple[str, float]) -> Column:
    """The first level whose threshold x reaches; the last one has none. Null stays null."""
    *some, last = levels
    out = None
    for name, least in some:
        out = F.when(x >= least, name) if out is None else out.when(x >= least, name)
    return F.when(x.isNotNull(), out.otherwise(last[0]))


def lakh(x: Column) -> Column:
    return rounded(x.cast("double") / 100000)


def two_places(x: Column) -> Column:
    """A double with two decimals, rounded by its exact value (half-even), as Python and SQL print it: 1.355 lies below its digits and is 1.35.

    ``format_string`` rounds the digits instead (1.36). The fraction's 2^-60ths are whole numbers wherever the second decimal can be in doubt.
    """
    size = F.abs(x)
    part = size % 1
    units, half = (part * 2.0**60).try_cast("bigint"), 1 << 29
    high, low = F.shiftright(units, 30) * 100, units.bitwiseAND(F.lit((1 << 30) - 1)) * 100  # 100 times the fraction, in two halves
    high, low = high + F.shiftright(low, 30), low.bitwiseAND(F.lit((1 << 30) - 1))
    cut, rest = F.shiftright(high, 30), high.bitwiseAND(F.lit((1 << 30) - 1))
    up = (rest > half) | (rest == half) & ((low > 0) | (cut % 2 == 1))
    cut = cut + F.when(up, 1).otherwise(0)
    whole = (size - part).try_cast("bigint") + F.when(cut == 100, 1).otherwise(0)
    exact = F.format_string("%s%d.%02d", F.when(x < 0, "-").otherwise(""), whole, F.when(cut == 100, 0).otherwise(cut))
    return F.when((x != 0) & whole.isNotNull() & cut.isNotNull(), exact).otherwise(F.format_string("%.2f", x))


def money_text(x: Column, kind: str = "money") -> Column:
    """Indian units from a lakh on, thousands separators below; kind money, count or pct. Decimals are ``two_places``."""
    if kind == "pct":
        return two_places(x.cast("double"))
    sign = "₹" if kind == "money" else ""
    x, size = x.cast("double"), F.abs(x.cast("double"))
    small = F.format_number(F.rint(x) if kind == "money" else x.cast("long"), 0)
    unit = F.when(size >= 1e7, "Cr").when(size >= 1e5, "L")
    large = F.concat(F.lit(sign), two_places(x / F.when(size >= 1e7, 1e7).otherwise(1e5)), unit)
    return F.when(unit.isNotNull(), large).otherwise(F.concat(F.lit(sign), small))


def dated(df: DataFrame) -> DataFrame:
    """Timestamps as dates, for results."""
    return df.select(*[F.to_date(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (TimestampType, TimestampNTZType)) else F.col(f"`{f.name}`") for f in df.schema])


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, missing values empty."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def distinct_names(df: DataFrame) -> DataFrame:
    """The first of every column name."""
    seen, keep = set(), []
    for k, c in enumerate(df.columns):
        if c not in seen:
            seen.add(c)
            keep.append(k)
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.select(*[F.col(f"c{k}").alias(df.columns[k]) for k in keep])


def preview(df: DataFrame, rows: int = 1000, order: tuple[str, ...] = ()) -> tuple[list[Row], int]:
    """The first rows - in the frame's order, or in one given - and how many there are, from one pass.

    The count is observed beside the rows; each task keeps its first ones, so no task stops before the count is whole. Rows that come in the
    order given, as out of a join by its columns, would let a task stop at its first ones, so the order is that of a value made from the columns.
    """
    seen, at = Observation(), F.monotonically_increasing_id()
    found = df.observe(seen, F.count(F.lit(1)).alias("total"))
    if order:
        first = found.withColumn("__key", F.struct(*order)).orderBy("__key").limit(rows).drop("__key")
    else:
        found = found.withColumn("__at", at).where(F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) < rows)
        first = found.orderBy("__at").limit(rows).drop("__at")
    return first.collect(), seen.get["total"]


def bucket_frame(spark) -> DataFrame:
    """(bucket, place) in fixed order, to fill what is missing with zeros: six rows."""
    return spark.createDataFrame([(b, k) for k, b in enumerate(BUCKETS)], "bucket string, place int")
