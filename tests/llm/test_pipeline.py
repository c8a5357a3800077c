"""The pipeline's stages against brute-force versions of their decisions."""

import random

import pytest
from pyspark.sql import functions as F
from test_llm_operators import DOCS, components_of, corpus, prose, sets_of

import corpus_pipeline
from duebook.llm import fertility, mixing, pii


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    # words like those of the other texts: the quality rules judge it by the table's own bands
    usual = prose(random.Random(3), 80)
    extra = [(1000, f"{usual} bob@mail.example.com or +1 (017) 555-7713 {usual[::-1].split()[0][::-1]}", "en", "s1", 0)]
    spark.createDataFrame([*corpus(seed=7, n=60), *extra], DOCS).write.parquet(f"{at}/documents.parquet")
    return at


def test_run_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in fertility.op3(docs).collect() if r["kept"]}
    rows = [r for r in docs.collect() if r["doc_id"] in kept]
    comps = components_of(sets_of([tuple(r) for r in rows]))
    single = {r["doc_id"]: pii.redact(r["text"]) for r in rows if comps[r["doc_id"]] == r["doc_id"]}
    assert "[EMAIL]" in single[1000] and "[PHONE]" in single[1000]
    source = {r["doc_id"]: (r["lang"], r["source"], len(single[r["doc_id"]])) for r in rows if r["doc_id"] in single}
    clean = spark.createDataFrame([(k, t, *source[k]) for k, t in single.items()], DOCS)
    expected = {r["doc_id"]: r["m__copies"] for r in mixing.mix(clean, "doc_id").collect() if r["m__copies"]}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{fertility.TOKENIZER_DIR}/piece_bpe_32k.model")
    out = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == expected
    for r in out.collect():
        assert r["ids"] == model.encode(single[r["doc_id"]]) and r["parity"] and r["round_trip"] and r["n_chars"] == len(single[r["doc_id"]])


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_stages_on_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, "a b c d e f g", "en", "s", 13)] * 3 + [(2, "a b c d e f g", "en", "s", 13)], DOCS)
    _, dedupe = corpus_pipeline.STAGES[1]
    assert sorted((r["doc_id"] or 0) for r in dedupe(spark, docs, "").collect()) == [0, 0, 1]
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, docs, "").count() >= 0


def test_unlike_texts_under_one_id_are_judged_apart(spark):
    a, b, c = ("one two three four five six " * 3, "seven eight nine ten eleven twelve", "alpha beta gamma delta epsilon zeta")
    rows = [(1, a), (5, a), (5, b), (5, b), (5, c), (7, c), (7, ""), (7, ""), (None, a)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS)
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in corpus_pipeline.STAGES[1][1](spark, docs, "").collect())
    assert got == sorted([(0, a), (1, a), (5, b), (5, c), (7, ""), (7, "")])


def left(spark):
    from pathlib import Path

    from duebook.llm.common import shared_dir

    return {p.name for p in Path(shared_dir(spark).removeprefix("file:")).glob("stage-*")}


def test_lazy_results_do_not_lose_their_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    (_, quality), (_, dedupe) = corpus_pipeline.STAGES[:2]
    first, second = quality(spark, docs, folder), quality(spark, docs, folder)
    assert first.count() == second.count() > 0
    # a stage given rows that still read the former's tables leaves them
    chained = dedupe(spark, second, folder)
    assert 0 < chained.count() < second.count() and first.count() == second.count()


def test_two_pipelines_and_the_tables_they_leave(spark, folder, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [x for x in corpus_pipeline.STAGES if x[0] != "n-gram Jaccard join"])  # for time's sake
    before = left(spark)
    one, two = corpus_pipeline.run(spark, folder), corpus_pipeline.run(spark, folder)
    assert one.count() == two.count() > 0
    assert len(left(spark) - before) <= 2  # the last stage's input, which each result still reads


def test_a_scope_leaves_no_table(spark, folder):
    from duebook.llm import jaccard_join
    from duebook.llm.common import Tables

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = left(spark)
    for work in (fertility.op3, jaccard_join.op6):
        with Tables():
            assert work(docs).count() == docs.count()
        assert left(spark) == before
