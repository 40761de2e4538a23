"""Language id and quality: accuracy on what was held out, and odd inputs."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from eavspark.llm import langid, quality
from eavspark.llm.shared import crc_mod4

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, words string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_held_out(spark, documents):
    got = langid.predict(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and not any(r.rejected for r in got)
    assert {r.doc_id for r in got} == {r.doc_id for r in documents.where(crc_mod4(F.col("doc_id")) == 2).collect()}


def plain_nearest(model, text):
    """The nearest centroid's language and cosine, n-gram by n-gram."""
    cleaned, last = " ", " "
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or last != " ":
            cleaned += c
        last = c
    cleaned += "" if cleaned.endswith(" ") else " "
    held, wrap = {}, (1 << 64) - 1
    for n in (2, 3):
        for k in range(len(cleaned) - n + 1):
            a, b, *rest = map(ord, cleaned[k : k + n])
            h = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & wrap
            if rest:
                h = (h * 0x165667B19E3779F9 + rest[0] * 0xD6E8FEB86659FD93) & wrap
            held[h >> 51] = held.get(h >> 51, 0) + 1
    weight = {k: np.log1p(n) * float(model.idf[k]) for k, n in held.items()}
    size = sum(v * v for v in weight.values()) ** 0.5
    cosines = [sum(v * float(c[k]) for k, v in weight.items()) / size for c in model.centroids]
    best = int(np.argmax(cosines))
    return model.languages[model.of[best]], min(1, max(0, cosines[best]))


def test_languages_are_of_the_nearest_centroid(spark, documents):
    model = langid.fit(documents)
    some = documents.orderBy("doc_id").limit(60)
    for r in langid.identify(some, model).collect():
        if r.text and any(c.isalpha() for c in r.text):
            lang, cosine = plain_nearest(model, r.text)
            assert r.lang_pred == lang and abs(r.score - cosine) < 1e-4


def test_languages_of_repeated_ids(spark, documents):
    """Rows of one id are documents of their own, and a bounded sample of them is learned."""
    rows = [(7, f"the words of number {k} and the rest" if k % 2 else f"und das sind die worte der nummer {k}", "en" if k % 2 else "de", None, 0, 0.0, "", "") for k in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = langid.predict(docs).collect()
    assert len(got) == 600 and {r.lang_pred for r in got} <= {"en", "de", "und"}


def test_languages_odd_texts(spark, documents):
    model = langid.fit(documents)
    rows = [(1, None), (2, ""), (3, "123 $%"), (4, "ωραία μέρα σήμερα στην πόλη μας " * 9), (5, "the " * 50_000), (None, "the and of to"), (1, None)]
    docs = spark.createDataFrame([(k, t, None, None, None, 1.0, "x", "y") for k, t in rows], SCHEMA)
    got = langid.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "words", "lang_pred", "score", "rejected"]
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert [by[k, t].lang_pred for k, t in rows[:3]] == ["und"] * 3 and all(by[k, t].rejected for k, t in rows[:4])
    assert by[5, rows[4][1]].lang_pred == by[None, rows[5][1]].lang_pred == "en" and got.count() == len(rows)
    assert all(0 <= r.score <= 1 for r in by.values())


def test_languages_without_training(spark):
    docs = spark.createDataFrame([(1, "some text", None, None, None, 1.0, "x", "y")], SCHEMA)
    assert [(r.lang_pred, r.score) for r in langid.predict(docs).collect()] == [("und", 0.0)]
    assert langid.predict(docs.limit(0)).count() == 0


def test_languages_agree_however_dealt(spark, documents):
    pick = lambda d: {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in langid.predict(d).collect()}
    some = documents.limit(200)
    assert pick(some) == pick(some.orderBy(F.desc("doc_id")).repartition(5))


def test_quality_held_out(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.predict(documents, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_quality_is_the_rules_by_hand(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(quality.with_statistics(documents), labels)
    got = {r.doc_id: r for r in quality.predict(documents, labels).collect()}
    for r in documents.orderBy("doc_id").limit(150).collect():
        x = np.array([quality.statistics(r.text)])
        z = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if quality.holds(x, rule)[0])
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-z))) < 1e-9


def test_quality_odd_inputs(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", None, None, None), (None, "x " * 60_000, None, None, None), (10**6, None, None, None, None)], documents.schema)
    got = quality.predict(documents.union(odd), labels.union(labels).union(spark.createDataFrame([(None, 1, 0), (3, None, 0)], labels.schema)))
    assert got.count() == documents.count() + 4 and got.where("score IS NULL OR held_out IS NULL").count() == 0
    none = quality.predict(documents.limit(5), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and quality.predict(documents.limit(0), labels).count() == 0


def test_rules_as_columns_are_the_model(spark):
    rng = np.random.default_rng(2)
    x = rng.random((600, len(quality.NAMES)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.6)).astype(float)
    model = quality.train(x, y)
    assert model.rules and len(model.rules) < 200
    z = model.intercept + sum(w * quality.holds(x, r) for r, w in zip(model.rules, model.weights))
    p = 1 / (1 + np.exp(-z))
    assert ((p > 0.5) == y).mean() > 0.97
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], ["k", *quality.NAMES])
    got = {r.k: r.p for r in df.select("k", model.column().alias("p")).collect()}
    assert np.allclose([got[k] for k in range(len(x))], p)


def test_lasso_drops_what_is_random():
    rng = np.random.default_rng(4)
    z = rng.integers(0, 2, (2000, 20)).astype(float)
    _, w = quality.lasso(z, z[:, 0], 0.02)
    assert w[0] > 1 and np.abs(w[1:]).max() < 0.05


def test_statistics():
    s = dict(zip(quality.NAMES, quality.statistics("HELLO THERE BIG WORLD\nok ok ok ok ok\n")))
    assert s["line_upper"] == 1 and s["line_doubled"] == 1 and s["lines_again"] == 0 and quality.statistics(None) == [0.0] * len(quality.NAMES)
    assert len(quality.statistics("random\n\nwords é")) == len(quality.NAMES) and random
