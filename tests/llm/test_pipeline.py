"""The pipeline's stages, each on what the one before it kept."""

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from eavspark.llm import langid, queries
from eavspark.llm.shared import stage
from tests.llm.test_dups import brute, joined

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, f in corpus_pipeline.STAGES:
        out = stage(f(spark, docs, SF))
        if name == "language id":
            model = langid.fit(docs)
            keeps = {r.doc_id for r in langid.identify(docs, model).where("NOT rejected").collect()}
            assert {r.doc_id for r in out.collect()} == keeps and len(keeps) > 190
        if name == "n-gram jaccard join":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            of = joined([k for k, _ in rows], [(rows[i][0], rows[j][0]) for i, j in brute(rows)])
            assert sorted(r.doc_id for r in out.collect()) == sorted(set(of.values()))
        if name == "substring dedup":
            before = {r.doc_id: r.text for r in docs.collect()}
            after = {r.doc_id: r.text for r in out.collect()}
            assert set(after) <= set(before) and all(len(after[k]) <= len(before[k]) for k in after)
        if name == "mixing to target weights":
            words = lambda d: d.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
            assert abs(words(out) - 1.5 * words(docs)) <= 2 and out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
        if name != "packing":
            assert out.columns == columns
        else:
            assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n <> 2048").count() <= 1
        seen.append(out.count())
        docs = out
    assert all(seen)


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the and of to in is", "en", "s", 0), (3, "the and of to in is", "en", "s", 0), (None, "with the of and by", "en", None, 0), (4, "und der die das ist nicht", "de", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in corpus_pipeline.STAGES:
        docs = stage(f(spark, docs, SF))
        if name == "n-gram jaccard join":
            assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 3, 4]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        empty = stage(f(spark, empty, SF))
    assert empty.count() == 0


def test_columns_with_clashing_names(spark):
    """Columns that a stage uses inside come through with their own values."""
    names = ["_key", "_KEY2", "_spans", "_copy", "_words", "size", "taken", "rejected", "lang_pred", "score", "row", "words", "component", "class_id", "kept"]
    long = " ".join(f"word{k}" for k in range(90))
    rows = [(k, t, "en", "s", 0, *[f"{n}{k}" for n in names]) for k, t in enumerate(["the and of to in is " + long, "with the of and by at on for " + long, "and the cat is in the house", "and the dog is in the garden"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = stage(f(spark, docs, SF))
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in names)
        docs = out
    assert docs.count() > 0 and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_every_query_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {*(f"op{k}" for k in range(1, 11)), "pipeline"} and set(queries.ORACLES) <= set(queries.QUERIES)
