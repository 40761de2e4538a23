"""A quality classifier of sparse rules.

Each text has a row of statistics. Small boosted trees over a bounded labelled sample
are taken apart: every path from a root is a rule, a conjunction of bounds on statistics.
A lasso logistic regression gives most rules no weight. Those left are one Spark column
expression over the statistics.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eavspark.llm.shared import crc_mod4, stage

#: Labelled rows that the model is fitted on, at most; chosen by a hash of their id.
SAMPLE = 20_000
TREES, DEPTH, RATE = 40, 3, 0.3
#: The lasso's penalty, a part of the mean loss.
PENALTY = 2e-4
NAMES = [
    "words", "mean_word", "letters", "upper", "digits", "marks", "symbols", "distinct", "top_word", "doubled", "pairs_again",
    "lines", "lines_again", "no_letter", "short_words", "line_upper", "line_symbols", "line_marks", "line_bars", "line_doubled", "bad_lines",
]
BLANK, LOWER, UPPER, DIGIT, MARK, SYMBOL = range(6)


@functools.cache
def kinds() -> np.ndarray:
    """For each code point: a blank, a lower letter (or one without case), an upper one, a digit, a mark of prose, another symbol."""

    def kind(c):
        if c.isspace():
            return BLANK
        if c.isalpha():
            return UPPER if c.isupper() else LOWER
        return DIGIT if c.isdigit() else MARK if c in ".,;:'\"-()?¿¡’“”«»" else SYMBOL

    return np.fromiter((kind(chr(k)) for k in range(0x110000)), np.uint8, 0x110000)


def statistics(text: str | None) -> list[float]:
    """The values of ``NAMES``; all are 0 for an empty text. Those of lines are of the worst line of four words or more."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(NAMES)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kind = kinds()[points]
    line = np.concatenate([[0], np.cumsum(points == 10)[:-1]])
    rows = int(line[-1]) + 1
    of = np.bincount(line * 6 + kind, minlength=6 * rows).reshape(rows, 6).astype(float)
    total, seen = of.sum(0), max(1.0, of[:, 1:].sum())
    n = len(words)
    lines = text.split("\n")[:rows]
    parts = [x.split() for x in lines]
    filled = [x for x in lines if x.strip()]
    often = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    doubled = lambda w: sum(map(str.__eq__, w, w[1:])) / max(1, len(w) - 1)
    long = np.array([k for k, p in enumerate(parts) if len(p) >= 4] or [int(np.argmax([len(p) for p in parts]))])
    some = of[long]
    size = np.maximum(some[:, 1:].sum(1), 1)
    bars = np.array([lines[k].count("|") / max(1, len(parts[k])) for k in long])
    twice = np.array([doubled(parts[k]) for k in long])
    loud = some[:, UPPER] / np.maximum(some[:, LOWER] + some[:, UPPER], 1)
    odd = some[:, SYMBOL] / size
    weight = np.array([len(parts[k]) for k in long], float)
    bad = ((loud > 0.6) | (odd > 0.12) | (twice > 0.3)) @ weight / max(1.0, weight.sum())
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, (total[LOWER] + total[UPPER]) / seen, total[UPPER] / max(1.0, total[LOWER] + total[UPPER]),
        total[DIGIT] / seen, total[MARK] / seen, total[SYMBOL] / seen, len(often) / n, max(often.values()) / n, doubled(words),
        1 - len(pairs) / max(1, n - 1), float(np.log1p(rows)), 1 - len(set(filled)) / max(1, len(filled)),
        sum(not any(map(str.isalpha, w)) for w in often) / len(often), sum(len(w) <= 3 for w in words) / n,
        float(loud.max()), float(odd.max()), float((some[:, MARK] / size).max()), float(bars.max()), float(twice.max()), float(bad),
    ]


def with_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and a column for each of ``NAMES``, from whole texts. Null and empty texts have zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                rows = batch.slice(part, 512)
                found = np.array([statistics(t.as_py()) for t in rows["text"]]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([rows["doc_id"], *map(pa.array, found.T.copy())], ["doc_id", *NAMES])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in NAMES))


#: A rule: bounds (statistic, bound, above) which all hold; above is value > bound, else value <= bound.
Rule = tuple[tuple[int, float, bool], ...]


@dataclass
class Model:
    intercept: float
    rules: list[Rule]
    weights: list[float]

    def column(self) -> Column:
        """The probability of label 1, over the columns of ``NAMES``."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            holds = functools.reduce(Column.__and__, [F.col(NAMES[k]) > b if above else F.col(NAMES[k]) <= b for k, b, above in rule])
            total = total + F.when(holds, F.lit(float(weight))).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    return np.logical_and.reduce([x[:, k] > b if above else x[:, k] <= b for k, b, above in rule])


def grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int) -> tuple[list[Rule], np.ndarray]:
    """One tree on gradients and curvatures: its paths, and its value for each row."""
    value, paths, open_ = np.zeros(len(x)), [], [((), np.arange(len(x)))]
    while open_:
        path, rows = open_.pop()
        best = (1e-6, None)
        if len(path) < depth and len(rows) >= 20:
            G, H = g[rows].sum(), h[rows].sum()
            for k in range(x.shape[1]):
                n = len(edges[k]) + 1
                left = np.cumsum(np.bincount(binned[rows, k], g[rows], n))[:-1]
                low = np.cumsum(np.bincount(binned[rows, k], h[rows], n))[:-1]
                few = np.cumsum(np.bincount(binned[rows, k], minlength=n))[:-1]
                gain = left**2 / (low + 1) + (G - left) ** 2 / (H - low + 1) - G**2 / (H + 1)
                gain[(few < 8) | (len(rows) - few < 8)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (k, int(gain.argmax())))
        if best[1] is None:
            value[rows] = -g[rows].sum() / (h[rows].sum() + 1)
            continue
        k, at = best[1]
        low = binned[rows, k] <= at
        for side, above in ((rows[low], False), (rows[~low], True)):
            longer = (*path, (k, float(edges[k][at]), above))
            paths.append(longer)
            open_.append((longer, side))
    return paths, value


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps; the intercept is free."""
    a = np.concatenate([np.ones((len(z), 1)), z], axis=1)
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(a) / np.linalg.norm(a @ v) ** 2 / 1.05
    w, ahead, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ ahead, -30, 30)))
        new = ahead - step * (a.T @ (p - y)) / len(a)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / nt * (new - w), new, nt
    return w[0], w[1:]


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """A model from rows of statistics and labels 0 and 1; one label alone gives its own, smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return Model(base, [], [])
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 63))) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    score, rules = np.full(len(x), base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        paths, value = grow(x, binned, edges, p - y, p * (1 - p), DEPTH)
        rules |= dict.fromkeys(paths)
        score += RATE * value
    kept = [r for r in rules if 0.002 < holds(x, r).mean() < 0.998]
    if not kept:
        return Model(base, [], [])
    z = np.stack([holds(x, r) for r in kept], axis=1).astype(float)
    b, w = lasso(z, y, PENALTY)
    return Model(float(b), [r for r, v in zip(kept, w) if v], [float(v) for v in w if v])


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn ``labels.quality`` from the rows of statistics whose fold isn't held out.

    A document with several labels has their largest; null labels and ids are left out.
    At most ``sample`` rows, in the order of a hash of their id, come to the driver; of rows of one id the
    one with the least statistics counts.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(crc_mod4(F.col("doc_id")) != 2)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the sample is at most so many pairs of an id and a label
    met = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*NAMES, "quality")).alias("s"))
    got = met.select("doc_id", "s.*").toArrow()
    table = np.stack([got[c].to_numpy().astype(float) for c in ("doc_id", *NAMES, "quality")], axis=1)
    table = table[np.lexsort(table.T[::-1])]
    return train(table[:, 1:-1], (table[:, -1] > 0).astype(float))


def predict(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (likelihood of label 1), predicted (score >= 0.7) of every document.

    Null and empty texts are scored by the rules too, on statistics that are all 0;
    repeated rows are scored one by one; a null id is not held out. Without labels the
    score is 0.5. Other columns are ignored.
    """
    rows = stage(with_statistics(documents), "statistics")
    model = fit(rows, labels)
    held = F.coalesce(crc_mod4(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    scored = rows.select("doc_id", held, model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
