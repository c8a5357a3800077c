"""The corpus pipeline: quality rules, one document per near-duplicate group, personal data out, sources mixed, text encoded.

``run`` applies the stages to ``documents``. Each stage's rows are written as Parquet to the shared folder and read again by the next, so
an executor lost later costs no earlier stage. All stages but the last return the columns of documents. A stage owns the tables that it leaves in the
shared folder: ``run`` removes them when the stage's rows have been written. Where stages are called one by one, a stage removes what the one before it
last left for the same table, unless the rows that it is given still read it; whatever else is left goes at the application's end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duebook.llm import fertility, jaccard_join, mixing, pii, sp_backend
from duebook.llm.common import Tables, discard, staged, table

Work = Callable[[SparkSession, DataFrame, str], DataFrame]


class Stage:
    """A stage that can be called alone; its tables outlive the call, as its rows are read later."""

    def __init__(self, work: Work):
        self.work, self.before, self.left = work, None, {}
        self.__doc__ = work.__doc__

    def __call__(self, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if self.before is not None and (former := self.before.left.get((id(spark), sf_dir))):
            read = docs.inputFiles()
            if not any(path.rsplit("/", 1)[-1] in file for path in former.paths for file in read):
                del self.before.left[id(spark), sf_dir]
                former.close()
        tables = Tables()
        with tables.used():
            out = self.work(spark, docs, sf_dir)
        self.left[id(spark), sf_dir] = tables  # what an earlier call left stays, as its rows may not have been read
        return out


@Stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return fertility.kept_documents(docs)


@Stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of every group linked by shingle Jaccard 0.8 or more."""
    return jaccard_join.one_of_each(docs)


@Stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind in brackets; n_chars follows the text."""
    return pii.redacted(docs)


@Stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, taken once or taken twice."""
    return mixing.repeated(docs)


@Stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, beside the documents' columns but the text itself."""
    keep = [c for c in docs.columns if c != "text"]
    return sp_backend.encoded(docs, *keep)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing sources", mix),
    ("SentencePiece encoding", encode),
]

#: The quality verdict, deobfuscation and encoding are not SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


for _former, _next in zip(STAGES, STAGES[1:], strict=False):
    _next[1].before = _former[1]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        tables = Tables()
        with tables.used():
            rows = stage.work(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return rows  # they still read what the stage and the one before have written
        docs = staged(rows)
        tables.close()
        if before is not None:
            discard(before)
        before = docs
