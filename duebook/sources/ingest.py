"""Monthly extracts in, clean snapshots out."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from duebook.functions.columns import number, with_buckets, with_soh
from duebook.schema import ALIASES, DATES, FLOWS, HEADERS, MANDATORY, NUMBERS, SNAPSHOT, UPPER, canonical
from duebook.sources import shared

#: Truncated headers are completed from this length on.
LEAST_PREFIX = 15
#: Files that ``load_files`` reads at once.
FILES_AT_ONCE = 8


class IngestError(ValueError):
    """A file that cannot be used."""


#: A raw row's place: number of the path it was read by, file, block in the file, row in the block. Loading uses it up.
PLACE, LINE = "__place", "__line"
#: Columns that reading adds.
OWN = (PLACE, LINE)


def read_raw(spark: SparkSession, path: str | list[str], kind: str = "csv") -> DataFrame:
    """Files of one kind as they are, with every row's ``PLACE``; CSV columns stay text.

    Each path is read on its own, so headers may differ; of a folder or pattern the files go by name.
    """
    reader = spark.read.option("header", True).option("inferSchema", False) if kind == "csv" else spark.read
    frames = []
    for k, p in enumerate([path] if isinstance(path, str) else path):
        frame = reader.format(kind).load(p)
        frames.append(_with_place(frame, k))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _with_place(frame: DataFrame, number: int) -> DataFrame:
    where = F.struct(
        F.lit(number).alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),  # rises along a block, as one task reads it
    )
    return frame.select(*[F.col(f"`{c}`") for c in frame.columns], where.alias(PLACE))


def match_headers(found: list[str]) -> dict[str, str]:
    """Header in the file to header of the schema, for those that can be told.

    In turn: stripped and known other spellings, equal but for case, and the start of a longer one (the longest unclaimed wins).
    """
    known, claimed, out = set(HEADERS), set(), {}
    stripped = {c: ALIASES.get(c.strip(), c.strip()) for c in found}
    for c, name in stripped.items():
        if name in known and name not in claimed:
            out[c] = name
            claimed.add(name)
    lower: dict[str, str] = {}
    for h in HEADERS:
        lower.setdefault(h.lower(), h)
    for c, name in stripped.items():
        if c in out or name in known:
            continue
        exact = lower.get(name.lower())
        longer = [h for h in HEADERS if len(name) >= LEAST_PREFIX and len(h) > len(name) and h.lower().startswith(name.lower()) and h not in claimed]
        target = exact if exact and exact not in claimed else max(longer, key=len, default=None)
        if target:
            out[c] = target
            claimed.add(target)
    return out


def with_canonical_names(df: DataFrame) -> DataFrame:
    """Known headers under their canonical names; unknown columns pass, stripped and in canonical spelling if that is free."""
    matched = match_headers([c for c in df.columns if c not in OWN])
    used = {canonical(h) for h in matched.values()}
    names = []
    for c in df.columns:
        if c in OWN:
            names.append(c)
            continue
        name = canonical(matched[c]) if c in matched else canonical(c.strip()) or "column"
        while c not in matched and name in used:
            name += "_x"
        used.add(name)
        names.append(name)
    return df.toDF(*names)


def require(df: DataFrame, columns: list[str] | None = None) -> None:
    """Raise with every mandatory header that is missing."""
    missing = [h for h in columns or MANDATORY if canonical(h) not in df.columns]
    if missing:
        raise IngestError("missing columns: " + ", ".join(missing))


def day(df: DataFrame, column: str) -> Column:
    """A timestamp from a date, a text, or a count of days since 1899-12-30 with its fraction; anything else is null."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return c.cast("timestamp")
    serial = c.try_cast("double")
    from_serial = F.when(serial > 0, F.timestamp_seconds(F.rint(serial * 86400) - 2209161600))
    if isinstance(kind, NumericType):
        return from_serial
    text = F.trim(c)
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd-MMM-yyyy")])
    return F.coalesce(parsed, from_serial)


def clean(df: DataFrame) -> DataFrame:
    """The columns of ``SNAPSHOT`` with its types - dates, numbers, canonical text, a missing one null - and then all further columns."""

    def typed(c: str) -> Column:
        if c not in df.columns:
            return F.lit(0.0) if c in FLOWS else F.lit(None).cast(SNAPSHOT[c].dataType)
        if c in DATES:
            return day(df, c)
        if c in NUMBERS:
            return F.coalesce(number(c), F.lit(0.0)) if c in FLOWS else number(c)
        text = F.col(c).cast("string")
        return F.upper(F.trim(text)) if c in UPPER else text

    known = [canonical(h) for h in HEADERS]
    return df.select(*[typed(c).alias(c) for c in known], *[F.col(f"`{c}`") for c in df.columns if c not in known])


def _typed(df: DataFrame) -> DataFrame:
    df = with_canonical_names(df)
    require(df)
    made = with_soh(with_buckets(clean(df)))
    return made.select(*SNAPSHOT.names, *[f"`{c}`" for c in made.columns if c not in SNAPSHOT.names])


def _typed_in_place(df: DataFrame, number: int = 0) -> DataFrame:
    """``_typed`` with ``PLACE``: that of the files the rows come from, or the frame's own order."""
    if PLACE not in df.columns:
        df = df.withColumn(PLACE, F.struct(F.lit(number).alias("path"), F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("row")))
    return _typed(df)


def load(df: DataFrame) -> DataFrame:
    """A raw extract as a snapshot: names, mandatory columns, types, buckets, exposure; of rows that repeat a loan number the first."""
    return first_per_loan(_typed_in_place(df))


def first_per_loan(df: DataFrame) -> DataFrame:
    """The first row, by ``PLACE``, of every loan number; rows without one all stay.

    Spark drops repeats before the shuffle as well as after it, and only columns that are used later are shuffled.
    """
    alone = F.when(F.col("loan_no").isNull(), F.col(PLACE))
    place = F.row_number().over(W.partitionBy("loan_no", alone).orderBy(PLACE))
    return df.withColumn("__nth", place).where("__nth = 1").drop("__nth", PLACE)


def load_many(frames: dict[str, DataFrame]) -> tuple[DataFrame, list[str]]:
    """The union of the extracts that can be used, in order, the first row per loan kept, and what was wrong with the others."""
    good, errors = [], []
    for k, (name, frame) in enumerate(frames.items()):
        try:
            made = _typed_in_place(frame, k)
            good.append(made.withColumn(PLACE, F.col(PLACE).withField("path", F.lit(k))))
        except IngestError as e:
            errors.append(f"{name}: {e}")
    if not good:
        raise IngestError("no usable extract; " + "; ".join(errors))
    return first_per_loan(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good)), errors


ERRORS = "path string, line string, error string"


def load_files(spark: SparkSession, paths: list[str], kind: str = "csv") -> tuple[DataFrame, DataFrame]:
    """(snapshot, errors): the files that can be read, in order, the first row per loan kept; and a row for all that could not be used.

    Every file is read once, typed, and written to the shared folder; whatever fails there - no such file, a missing column, bytes that do not
    decode, a compressed file cut short - leaves out this file and no other. Lines of a CSV file that do not fit its header are errors of
    their own (``line`` is their text) and their other lines stay. Few files are read at a time, each by as many tasks as it has blocks.
    """

    def one(k: int) -> tuple[DataFrame | None, DataFrame | None, str | None]:
        try:
            raw = read_raw(spark, paths[k], kind)
            if kind == "csv":  # once more with the header as a schema, which tells the lines that do not fit it
                names = [c for c in raw.columns if c != PLACE]
                lines = spark.read.schema(StructType([StructField(c, StringType()) for c in (*names, LINE)])).option("columnNameOfCorruptRecord", LINE)
                raw = _with_place(lines.option("header", True).csv(paths[k]), k)
            else:
                raw = raw.withColumn(LINE, F.lit(None).cast("string"))
            made = shared.written(_typed(raw))
            bad = made.where(F.col(LINE).isNotNull()).select(F.lit(paths[k]).alias("path"), F.col(LINE).alias("line"), F.lit("does not fit the header").alias("error"))
            return made.where(F.col(LINE).isNull()).drop(LINE).withColumn(PLACE, F.col(PLACE).withField("path", F.lit(k))), bad, None
        except IngestError as e:
            return None, None, str(e)
        except PySparkException as e:
            return None, None, f"cannot be read: {e.getCondition() or type(e).__name__}"
        except Py4JJavaError as e:
            return None, None, f"cannot be read: {e.java_exception.getClass().getSimpleName()}"

    scope = copy_context()
    with ThreadPoolExecutor(FILES_AT_ONCE) as pool:
        found = list(pool.map(lambda k: scope.copy().run(one, k), range(len(paths))))
    good = [made for made, _, _ in found if made is not None]
    errors = spark.createDataFrame([(paths[k], None, e) for k, (_, _, e) in enumerate(found) if e], ERRORS)
    errors = reduce(DataFrame.unionByName, [errors, *[bad for _, bad, _ in found if bad is not None]])
    if not good:
        raise IngestError("no usable file; " + "; ".join(f"{paths[k]}: {e}" for k, (_, _, e) in enumerate(found)))
    return first_per_loan(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good)), errors


def mandatory_columns(df: DataFrame) -> DataFrame:
    """(header, column, present, filled): the mandatory columns of an extract, and in how many rows each holds something; one pass."""
    df = with_canonical_names(df)
    there = [(h, canonical(h), canonical(h) in df.columns) for h in MANDATORY]
    counts = df.agg(*[(F.count(canonical(h)) if here else F.lit(0).cast("long")).alias(c) for h, c, here in there])
    rows = F.array(*[F.struct(F.lit(h).alias("header"), F.lit(c).alias("column"), F.lit(here).alias("present"), F.col(c).alias("filled")) for h, c, here in there])
    return counts.select(F.inline(rows))


def write_snapshot(df: DataFrame, path: str, month: str) -> None:
    """A month's partition of the snapshot table; written again, it replaces the former one and no other, also by no rows at all.

    The rows are written beside the table first and take the place of the former ones when they are complete (Spark's ``_SUCCESS`` marks that),
    so a write that fails changes nothing.
    """
    spark, at = df.sparkSession, f"{path}/snapshot_month={month}"
    key = uuid.uuid4().hex
    new, old = f"{path}/_new-{key}", f"{path}/_old-{key}"
    try:
        df.write.parquet(new)
    except BaseException:
        shared.remove(spark, new)
        raise
    if shared.exists(spark, at):
        shared.move(spark, at, old)
    shared.move(spark, new, at)
    shared.remove(spark, old)


def create_months(spark: SparkSession, table: str, df: DataFrame, buckets: int, path: str | None = None) -> None:
    """A catalog table of monthly snapshots with the columns of ``df``, dealt and sorted by loan number: joins of months need no shuffle."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    place = f"LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE {table} ({columns}, snapshot_month STRING) USING parquet PARTITIONED BY (snapshot_month) CLUSTERED BY (loan_no) SORTED BY (loan_no) INTO {int(buckets)} BUCKETS {place}")


def write_month(df: DataFrame, table: str, month: str) -> None:
    """Replace a month of such a table; the rows are computed before the former ones go, and no rows empty the month."""
    spark = df.sparkSession
    with shared.Tables():
        rows = shared.written(df)
        rows = rows.repartition(_buckets(spark, table), "loan_no")  # one file per bucket
        view = f"month_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(view)
        columns = ", ".join(f"`{c}`" for c in spark.table(table).columns if c != "snapshot_month")
        spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (snapshot_month = '{month}') SELECT {columns} FROM {view}")
        spark.catalog.dropTempView(view)


def _buckets(spark: SparkSession, table: str) -> int:
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    return int(found["data_type"])


def read_month(spark: SparkSession, table: str, month: str) -> DataFrame:
    """One month of a table of months; the filter prunes the others, the buckets stay."""
    return spark.table(table).where(F.col("snapshot_month") == month)


def read_snapshot(spark: SparkSession, path: str, month: str) -> DataFrame:
    """One month; the filter prunes the other partitions."""
    return spark.read.parquet(path).where(F.col("snapshot_month") == month)
