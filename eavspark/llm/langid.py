"""Language identification by the nearest of several centroids a language.

A text is the TF-IDF vector of its hashed letter 2- and 3-grams, of length one. Each
language has several centroids, found by spherical k-means over a bounded sample. The
nearest by cosine names the language; a text further from it than texts of its length
ever were in training is rejected.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eavspark.llm.shared import crc_mod4, lean, ship

#: Dimensions of a vector.
DIMENSIONS = 1 << 13
#: Documents a language that the model is fitted on, at most; chosen by a hash of their id and text.
SAMPLE = 250
#: Languages that are learned, at most; the most frequent ones.
LANGUAGES = 400
#: Parts into which each language's documents are dealt by that hash; each gives as many.
PARTS = 10
#: Centroids a language.
CENTROIDS = 4
#: A text is rejected below this part of the least cosine that training texts of its length had.
SLACK = 0.6
#: Training texts that a length needs for a bound of its own.
ENOUGH = 20
#: Words of the windows that, besides whole texts, show how cosines depend on length.
WINDOWS = (1, 2, 4, 8, 16, 32, 64)
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of the lower-case text, runs of other characters as one blank; None without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    points = np.where(is_letter, points, 32)
    points = np.concatenate([[32], points, [32]]).astype(np.uint64)
    blank = points == 32
    points = points[~(blank & np.concatenate([[False], blank[:-1]]))]
    two = points[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0x165667B19E3779F9) + points[2:] * np.uint64(0xD6E8FEB86659FD93)
    top = np.uint64(64 - 13)
    return np.bincount(np.concatenate([two >> top, three >> top]).astype(np.int64), minlength=DIMENSIONS)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray  # the language of each centroid
    least: np.ndarray  # the least cosine accepted, by the binary logarithm of the n-grams

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid's language and cosine, for rows of counts."""
        near = unit(np.log1p(rows).astype(np.float32) * self.idf) @ self.centroids.T
        best = near.argmax(1)
        return self.of[best], np.clip(near[np.arange(len(rows)), best], 0, 1)

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.minimum(np.log2(np.maximum(rows.sum(1), 1)).astype(int), len(self.least) - 1)


def clusters(x: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from far-apart rows."""
    picked = [int(np.random.default_rng(seed).integers(len(x)))]
    while len(picked) < min(k, len(x)):
        picked.append(int((x @ x[picked].T).max(1).argmin()))
    centre = x[picked]
    for _ in range(rounds):
        of = (x @ centre.T).argmax(1)
        centre = unit(np.stack([x[of == j].sum(0) if (of == j).any() else centre[j] for j in range(len(centre))]))
    return centre


def fit(documents: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    """Learn from text and non-null lang of the documents whose fold isn't held out.

    The sample is ``sample`` documents at most of each of the LANGUAGES most frequent languages: PARTS
    parts of a language each give their first by a hash, so no task has to order all rows of a language,
    and each task sends only its first. Their n-gram counts, of fixed size, come to the driver;
    rows of one id and text are one. None if there is nothing to learn from.
    """
    ship(documents.sparkSession)
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod4(F.col("doc_id")) != 2))
    known = known.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    frequent = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    by = Window.partitionBy("lang", "part").orderBy("h", "doc_id")
    ids = known.where(F.col("lang").isin([r.lang for r in frequent.select("lang").collect()])).select("lang", "h", "doc_id", F.pmod("h", F.lit(PARTS)).alias("part"))
    ids = ids.withColumn("n", F.row_number().over(by)).where(F.col("n") <= -(-sample // PARTS)).select("lang", "h", "doc_id")
    # at most sample * LANGUAGES small rows
    chosen = known.join(F.broadcast(ids), ["lang", "h", "doc_id"], "left_semi").dropDuplicates(["lang", "h", "doc_id"]).select("doc_id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, wholes, where, what = [], [], [], []
            for doc_id, text, lang in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "lang"))):
                words, rng = text.split(), np.random.default_rng(doc_id % (1 << 32))
                starts = [(int(rng.integers(len(words) - n + 1)), n) for n in WINDOWS if n < len(words)]
                for whole, part in [(True, text), *[(False, " ".join(words[a : a + n])) for a, n in starts]]:
                    found = counts(part)
                    if found is not None:
                        at = np.flatnonzero(found)
                        langs.append(lang), wholes.append(whole), where.append(at.astype(np.int32)), what.append(found[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(wholes, pa.bool_()), pa.array(where, pa.list_(pa.int32())), pa.array(what, pa.list_(pa.int32()))],
                ["lang", "whole", "at", "n"],
            )

    got = chosen.mapInArrow(run, "lang string, whole boolean, at array<int>, n array<int>").toArrow()
    if not got.num_rows:
        return None
    # rows arrive in no fixed order, so put them in one of their own
    got = got.append_column("sum", pa.array([int((x.values.to_numpy().astype(np.int64) * 31 + n.values.to_numpy()).sum()) for x, n in zip(got["at"], got["n"])]))
    got = got.sort_by([("lang", "ascending"), ("sum", "ascending")])

    def dense(t: pa.Table) -> np.ndarray:
        out = np.zeros((t.num_rows, DIMENSIONS), np.float32)
        for k, (at, n) in enumerate(zip(t["at"], t["n"])):
            out[k, at.values.to_numpy()] = n.values.to_numpy()
        return out

    wholes = got.filter(got["whole"])
    langs, x = np.array(wholes["lang"].to_pylist()), dense(wholes)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x = unit(np.log1p(x) * idf)
    names = sorted(set(langs))
    found = [clusters(x[langs == name], centroids) for name in names]
    model = Model(names, idf, np.concatenate(found).astype(np.float32), np.repeat(np.arange(len(names)), [len(c) for c in found]), np.zeros(24))
    cosine, bins = [], []
    for low in range(0, got.num_rows, 512):
        part = dense(got.slice(low, 512))
        cosine.append(model.nearest(part)[1]), bins.append(model.bins(part))
    cosine, bins = np.concatenate(cosine), np.concatenate(bins)
    # longer texts are closer to a centroid: a length of which training has little takes the bound of the next shorter one
    least = np.zeros(len(model.least))
    for b in range(len(least)):
        own = cosine[bins == b]
        least[b] = own.min() if len(own) >= ENOUGH else min([*own, least[b - 1] if b else 0.0])
    model.least = SLACK * least
    return model


def identify(documents: DataFrame, model: Model | None, names: list[str] = ["lang_pred", "score", "rejected"]) -> DataFrame:
    """Add a language, a score and whether it is rejected to every row, under ``names``, from its whole text alone.

    A text which is null or has no letter is ``und``, score 0, rejected; without a model
    so is every text. A text of any length is scored whole. Columns of these names in
    ``documents`` are replaced; others stay as they are.
    """
    kept = documents.drop(*names)
    schema = StructType([*kept.schema.fields]).add(names[0], "string").add(names[1], "double").add(names[2], "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                found = [counts(t.as_py()) if model else None for t in rows["text"]]
                lang, score, reject = [UNKNOWN] * len(found), np.zeros(len(found)), np.ones(len(found), bool)
                some = [k for k, c in enumerate(found) if c is not None]
                if some:
                    x = np.stack([found[k] for k in some])
                    of, cosine = model.nearest(x)
                    score[some], reject[some] = cosine, cosine < model.least[model.bins(x)]
                    for k, j in zip(some, of):
                        lang[k] = model.languages[j]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(reject)], [*rows.schema.names, *names])

    return kept.mapInArrow(lean(run), schema)


def predict(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of all documents, by a model of those not held out."""
    model = fit(documents)
    held = F.coalesce(crc_mod4(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return identify(documents.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score", "rejected")
