"""What the operators share: table access, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.sources import shared
from duebook.sources.shared import Tables as Tables

#: Words everywhere in this subpackage: maximal runs without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local master (tests) gets a temporary one; a cluster is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        at = sc._jsc.sc().getCheckpointDir()
        if at.isDefined():
            return at.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint: later steps reread the rows from the shared folder, also after losing executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """As ``cut``, as a Parquet table: smaller, and later steps read only the columns they use.

    The table is of the scope that is open (``with Tables(): ...``), which removes it when it is closed; outside any it stays to the
    application's end.
    """
    spark = df.sparkSession
    path = shared.owned(spark, f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path.rsplit("/", 1)[0]
    return out


def discard(df: DataFrame, free: bool = False) -> None:
    """Delete a staged table that nothing reads any more; ``free``: let Spark drop the shuffle files of finished steps as well."""
    shared.remove(df.sparkSession, df.stage_path)
    if free:
        free_shuffles(df.sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which it does when the driver collects its garbage."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def bounded_broadcast(small: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint if the counted rows are at most ``most``; beyond, the side is shuffled and AQE splits hot keys."""
    return F.broadcast(small) if rows <= most else small


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bits60(*parts: Column) -> Column:
    """A 60-bit number from the MD5 of the parts; DuckDB's md5 gives the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


#: Rows that Arrow hands to a worker at once; the session's setting holds where it is lower.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Few whole texts at a time on both sides of the Arrow stream: with the default of 10,000 rows, long texts fill a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_rows(df: DataFrame, compute, added: str, keep: list[str], rows: int = BATCH_ROWS) -> DataFrame:
    """``keep`` columns as they are, then the columns of the DDL ``added`` from ``compute(batch)``, which returns one list per column.

    Arrow hands over batches; each is cut to ``rows`` rows, so a task holds few texts at a time whatever its share of the table.
    """
    small_batches(df.sparkSession)
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    schema = StructType([*[df.schema[c] for c in keep], *new])
    types = [to_arrow_type(f.dataType) for f in new]
    names = [f.name for f in schema]

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, rows):
                batch = big.slice(at, rows)
                made = [pa.array(x, t) for x, t in zip(compute(batch), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=names)

    return df.mapInArrow(run, schema)


_resident: dict = {}


def resident(key, make):
    """A worker's one large object (a model with its tables): loading another lets the former go."""
    if key not in _resident:
        release()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Give a worker's large object back to the system; called by steps that need none, as workers outlive steps."""
    if _resident:
        import ctypes
        import gc

        import pyarrow as pa

        _resident.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
        if trim:
            trim(0)


def same_columns(stage):
    """For stages that return the columns they got: while the stage runs, columns that it does not know have names of their own."""
    known = ("doc_id", "text", "lang", "source", "n_chars")

    def run(docs: DataFrame) -> DataFrame:
        inside = docs.toDF(*[c if c in known else f"r__{k}" for k, c in enumerate(docs.columns)])
        return stage(inside).toDF(*docs.columns)

    run.__doc__ = stage.__doc__
    return run
