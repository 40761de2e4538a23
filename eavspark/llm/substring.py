"""Passages that repeat across documents, also with small changes, by collinear chaining.

Seeds are sampled runs of SEED words, of which those at PLACES count: of each window of hashed runs the smallest (so two
texts that share WINDOW + SEED - 1 words in a row share a seed). An occurrence of a seed is
matched with one earlier occurrence only, so a passage in very many documents gives
as many matches as it has occurrences, and no pairs: with the first of all, or, of a seed that comes more than
FEW times in CHUNK words of input, with the first of those. Matches on one diagonal are one segment; segments of two documents are
chained in order by a Fenwick tree, with a cost for gaps, from all in reach before each. A chain is
then aligned word by word, across its gaps and past its ends. What repeats but is in no exact passage
by then is matched once more, by all its runs of LEAST words, with the first of each, so that every exact repeat of LEAST words is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavspark.llm.shared import boundaries, drop, lean, map_tables, partitions, release, stage, unused
from eavspark.llm.words import WORD, grams, mix, words_of

SEED, WINDOW = 8, 6
#: The words of a seed that must agree. With gaps between and this WINDOW, 94% of passages of LEAST words
#: with every fifth word changed at random share a seed (simulated; of 60 words 97%; at 10% changed all).
PLACES = (0, 1, 3, 6, 7)
#: Words of a passage at least, and the part of them that must agree.
LEAST, SAME = 50, 0.8
#: Words between the nearest seeds of two segments of a chain at most, in either text; the cost of a word between them.
GAP, GAP_COST = 64, 0.05
#: An end of a chain is extended until it has lost this much; agreeing words gain 1, others lose 2.
DROP, LOSS = 12, 2
#: Equal words in a row at either end of a part of a chain, where the whole doesn't agree.
RUN = 2
#: Words past a chain's ends that alignment sees. Seeds are denser by far, so what agrees further on has matches of its own.
MARGIN = 4 * LEAST
#: Words whose seeds are sorted together before they are sent, and how often one seed is sent from them.
CHUNK, FEW = 1 << 20, 8
#: Buckets of seeds a shuffle partition; a task holds one bucket at a time.
BUCKETS = 8
#: Bytes of a word in the staged texts: different words pass as equal once in 2**24.
BYTES = 3
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def seeds(words: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the seeds of texts that follow one another: the smallest of each WINDOW hashed runs."""
    counts = np.array([len(words)]) if counts is None else counts
    if len(words) < SEED:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed = np.concatenate([spaced(words), np.full(SEED - 1, NONE)])
    ends = np.cumsum(counts)
    for k in range(1, SEED):  # runs that would go past a text's end; SEED - 1 of them, so no window spans two texts
        at = ends - k
        hashed[at[at >= ends - counts]] = NONE
    at = smallest(hashed) if len(hashed) > WINDOW else np.array([int(hashed.argmin())])
    at = at[hashed[at] != NONE]
    return at, hashed[at]


def spaced(words: np.ndarray) -> np.ndarray:
    """A hash of the words at PLACES of each run of SEED words."""
    n = len(words) - SEED + 1
    out = np.zeros(n, np.uint64)
    for k in PLACES:
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return np.minimum(mix(out), NONE - np.uint64(1))


def fresh(value: np.ndarray, place: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places to keep of those sorted by (value, text, place), and after which of them some were left out.

    Where a value comes again within LEAST words, as in a word said over and over, one place in LEAST words counts.
    """
    keep, thin = np.ones(len(value), bool), np.zeros(len(value), bool)
    again = (value[1:] == value[:-1]) & (text[1:] == text[:-1]) & (np.diff(place) < LEAST)
    kept, upto = 0, -1
    for k in (np.flatnonzero(again) + 1).tolist():
        if k - 1 != upto:
            kept = k - 1
        if place[k] - place[kept] < LEAST:
            keep[k], thin[kept] = False, True
        else:
            kept = k
        upto = k
    return keep, thin


def smallest(hashed: np.ndarray) -> np.ndarray:
    """Places of the smallest value of each WINDOW values in a row, the last of equal ones."""
    low = hashed.copy()
    at = np.arange(len(hashed))
    reach = 1
    while reach < WINDOW:
        step = min(reach, WINDOW - reach)
        later = low[step:]
        keep = low[: len(later)] < later
        at = np.where(keep, at[: len(later)], at[step:])
        low = np.where(keep, low[: len(later)], later)
        reach += step
    return at[np.flatnonzero(np.diff(at, prepend=-1))] if (np.diff(at) >= 0).all() else np.unique(at)


def segments(x: np.ndarray, y: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Matches (x, y) that lie on one diagonal, each within GAP words of the last, as (group, first x, first y, last x); sorted by group and x."""
    group = np.zeros(len(x), np.int64) if group is None else group
    order = np.lexsort((x, y - x, group))
    x, y, group = x[order], y[order], group[order]
    new = np.ones(len(x), bool)
    new[1:] = (group[1:] != group[:-1]) | ((y - x)[1:] != (y - x)[:-1]) | (np.diff(x) > GAP)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1 if len(first) else first
    order = np.lexsort((y[first], x[first], group[first]))
    return group[first][order], x[first][order], y[first][order], x[last][order]


class Highest:
    """A Fenwick tree over places 1 to n: the highest value, and whose it is, of a range of them."""

    def __init__(self, n: int):
        self.n = n
        self.own: list[tuple[float, int]] = [LOWEST] * (n + 1)
        self.upto: list[tuple[float, int]] = [LOWEST] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        if value > self.own[at]:
            self.own[at] = value
            while at <= self.n:
                if value > self.upto[at]:
                    self.upto[at] = value
                at += at & -at

    def best(self, low: int, high: int) -> tuple[float, int]:
        found = LOWEST
        while high >= low:
            if high - (high & -high) >= low - 1:
                found = max(found, self.upto[high])
                high -= high & -high
            else:
                found = max(found, self.own[high])
                high -= 1
        return found


LOWEST = (float("-inf"), -1)


def chains(x: list[int], y: list[int], last: list[int]) -> list[list[int]]:
    """Chains of segments, each as its segments in order; every segment is in one.

    Segment k goes from the seed at (x[k], y[k]) to that at last[k] on the same diagonal. The score of a chain
    that ends in it is the words it covers, plus the best chain whose last seed is before its first in both texts, by GAP words at most, less
    GAP_COST for each word from the one to the other in either text. Costs are sums, so the best of all in reach is the highest of score + GAP_COST * (x + y): a
    range of the places in the second text, and a window of those in the first. A Fenwick tree can't forget, so the
    window is two: blocks of GAP words of the first text have a tree each, and for the block before, the queries are answered
    in falling order, as its places come in. The best chain is read back first, then of the rest the next.
    """
    n = len(x)
    tail_y = [y[k] + last[k] - x[k] for k in range(n)]
    rank = {v: k + 1 for k, v in enumerate(sorted(set(tail_y)))}
    sorted_y = sorted(rank)
    ranges = [(int(a) + 1, int(b)) for a, b in zip(np.searchsorted(sorted_y, np.array(y) - GAP), np.searchsorted(sorted_y, y))]
    score, before = [0.0] * n, [-1] * n
    # what is asked at x, and what is known from last + 1 on
    events = sorted([(x[k], 0, k) for k in range(n)] + [(last[k] + 1, -1, k) for k in range(n)])
    starts: dict[int, list[int]] = {}
    for k in range(n):
        starts.setdefault(x[k] // GAP, []).append(k)
    tails: dict[int, list[int]] = {}
    tree, now, earlier = Highest(len(rank)), None, {}
    for at, kind, k in events:
        if at // GAP != now:
            was, now = now, at // GAP
            old = Highest(len(rank))
            # places known in the block before, by falling place; a query has those that are within GAP
            known = sorted(tails.pop(now - 1, []), key=lambda j: -last[j]) if was == now - 1 else []
            tails.clear()
            earlier, p = {}, 0
            if known:
                for q in sorted(starts.get(now, []), key=lambda j: -x[j]):
                    while p < len(known) and last[known[p]] >= x[q] - GAP:
                        j = known[p]
                        old.put(rank[tail_y[j]], (score[j] + GAP_COST * (last[j] + tail_y[j]), j))
                        p += 1
                    earlier[q] = old.best(*ranges[q])
            tree = Highest(len(rank))
        if kind:
            tree.put(rank[tail_y[k]], (score[k] + GAP_COST * (last[k] + tail_y[k]), k))
            tails.setdefault(now, []).append(k)
        else:
            value, j = max(tree.best(*ranges[k]), earlier.get(k, LOWEST))
            gain = value - GAP_COST * (x[k] + y[k])
            score[k] = last[k] - x[k] + SEED + max(gain, 0.0)
            if gain > 0:
                before[k] = j
    out, used = [], [False] * n
    for k in sorted(range(n), key=lambda j: (-score[j], x[j], y[j])):
        path = []
        while k >= 0 and not used[k]:
            used[k] = True
            path.append(k)
            k = before[k]
        if path:
            out.append(path[::-1])
    return out


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far two texts agree from their start on, with changed, added and left-out words between; by x-drop."""
    i = j = best_i = best_j = 0
    score = best = 0
    n, m = len(a), len(b)
    while i < n and j < m and score > best - DROP:
        if a[i] == b[j]:
            i, j, score = i + 1, j + 1, score + 1
            if score > best:
                best, best_i, best_j = score, i, j
            continue
        # the cheapest step after which the next two words agree again
        for d, e in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 0), (0, 2), (3, 3), (4, 4), (5, 5)):
            if i + d < n and j + e < m and a[i + d] == b[j + e] and (i + d + 1 >= n or j + e + 1 >= m or a[i + d + 1] == b[j + e + 1]):
                i, j, score = i + d, j + e, score - LOSS * max(d, e)
                break
        else:
            break
    return best_i, best_j


def common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two short texts."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, w in enumerate(a):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (b == w)))
    out, i, j = [], len(a), len(b)
    while i and j and table[i, j]:
        if table[i, j] == table[i, j - 1]:
            j -= 1
        elif table[i, j] == table[i - 1, j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def aligned(x: np.ndarray, y: np.ndarray, path: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal words, in order, of two texts aligned along a chain's segments (x, y, words): on their diagonals, and by a longest common subsequence between them."""
    held_i, held_j, i, j = [], [], 0, 0
    for p, q, n in [*path, (len(x), len(y), 0)]:
        skip = max(0, i - p, j - q)
        if n and skip >= n or p + skip > len(x) or q + skip > len(y):
            continue
        p, q, n = p + skip, q + skip, min(n - skip, len(x) - p - skip, len(y) - q - skip)
        if p > i and q > j:
            between = common(x[i:p], y[j:q])
            if between:
                u, v = np.array(between).T
                held_i.append(i + u), held_j.append(j + v)
        same = np.flatnonzero(x[p : p + n] == y[q : q + n]) if n > 0 else np.zeros(0, np.int64)
        held_i.append(p + same), held_j.append(q + same)
        i, j = p + max(n, 0), q + max(n, 0)
    return np.concatenate(held_i), np.concatenate(held_j)


def parts(i: np.ndarray, j: np.ndarray, least: int, same: float) -> list[tuple[int, int, int, int, int]]:
    """Stretches that agree by themselves, of aligned places of equal words, as (start, stop, start, stop, agreeing words).

    A stretch begins and ends with RUN equal words in a row. The one that
    agrees in most words comes first, then others until no further run is in any; they may overlap.
    """
    if not len(i):
        return []
    cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1))
    head, tail = np.append(0, cut + 1), np.append(cut, len(i) - 1)
    solid = tail - head + 1 >= RUN
    head, tail = head[solid], tail[solid]
    out = []
    # runs further apart than GAP words are in no stretch together
    far = np.flatnonzero((i[head[1:]] - i[tail[:-1]] > GAP) | (j[head[1:]] - j[tail[:-1]] > GAP)) + 1 if len(head) else []
    for low, high in zip([0, *far], [*far, len(head)]):
        h, t = head[low:high], tail[low:high]
        if len(h) > MANY:
            out += long_parts(i, j, h, t, least, same)
            continue
        agree = t[None, :] - h[:, None] + 1
        length = i[t][None, :] - i[h][:, None] + 1
        span = np.maximum(length, j[t][None, :] - j[h][:, None] + 1)
        fits = (length >= least) & (agree >= same * span)
        open_ = np.ones(len(h), np.int64)
        while fits.any():
            sums = np.append(0, np.cumsum(open_))
            fits &= sums[1:][None, :] > sums[:-1][:, None]
            if not fits.any():
                break
            a, b = np.unravel_index(np.where(fits, agree - span / (1.0 + span.max()), -np.inf).argmax(), fits.shape)
            open_[a : b + 1] = 0
            p, q = h[a], t[b]
            out.append((int(i[p]), int(i[q]) + 1, int(j[p]), int(j[q]) + 1, int(q - p) + 1))
    return out


#: Runs of equal words whose stretches are all tried; of more, those from each run on.
MANY = 400


def long_parts(i: np.ndarray, j: np.ndarray, head: np.ndarray, tail: np.ndarray, least: int, same: float) -> list[tuple[int, int, int, int, int]]:
    """As ``parts`` for very many runs: from each run that is in no stretch yet, the longest stretch that agrees."""
    out, k = [], 0
    while k < len(head):
        p = head[k]
        agree, length = tail[k:] - p + 1, i[tail[k:]] - i[p] + 1
        span = np.maximum(length, j[tail[k:]] - j[p] + 1)
        fits = np.flatnonzero((length >= least) & (agree >= same * span))
        if len(fits):
            q = tail[k + fits[-1]]
            out.append((int(i[p]), int(i[q]) + 1, int(j[p]), int(j[q]) + 1, int(q - p) + 1))
            k += int(fits[-1])
        k += 1
    return out


def exact_runs(i: np.ndarray, j: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of ``least`` aligned places or more that follow one another in both texts, in the first text."""
    cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1))
    head, tail = i[np.append(0, cut + 1)], i[np.append(cut, len(i) - 1)]
    return [(int(p), int(q) + 1) for p, q in zip(head, tail) if q - p + 1 >= least]


def unmatched(start: np.ndarray, stop: np.ndarray, done: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Stretches (start, stop) less the runs of ``least`` words inside one of ``done``."""
    out, done = [], sorted(done)
    for at, end in zip(start.tolist(), stop.tolist()):
        for p, q in done:
            if q - least < at or p > end - least:
                continue
            if p > at and p - 1 + least - at >= least:
                out.append((at, p - 1 + least))
            at = max(at, q - least + 1)
        if end - at >= least:
            out.append((at, end))
    return out


def regions(row: np.ndarray, at: np.ndarray, thin: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop): where runs of ``least`` words may repeat, from the sorted places of seeds that do.

    A passage that repeats has such a seed in each WINDOW runs, so it reaches less than WINDOW words past
    its seeds; where places were left out after one, they were within LEAST words.
    """
    reach = np.where(thin, LEAST, 0) + WINDOW
    new = np.ones(len(row), bool)
    until = np.maximum.accumulate(at + reach + row_offsets(row))
    new[1:] = (row[1:] != row[:-1]) | ((at + row_offsets(row))[1:] > until[:-1])
    first = np.flatnonzero(new)
    start = np.maximum(0, at[first] - WINDOW + 1)
    stop = np.maximum.reduceat(at + reach, first) + SEED - 1 if len(first) else first
    wide = stop - start >= least
    return row[first][wide], start[wide], stop[wide]


def row_offsets(row: np.ndarray) -> np.ndarray:
    """Offsets that keep the places of each row beyond those of the rows before."""
    return np.cumsum(np.append(0, row[1:] != row[:-1])) * (1 << 40) if len(row) else row


def packed(words: np.ndarray) -> bytes:
    return words.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // BYTES, 4), np.uint8)
    out[:, :BYTES] = np.frombuffer(data, np.uint8).reshape(-1, BYTES)
    return out.view("<u4").reshape(-1)


def shrunk(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as bytes: the first byte of all, then the second, so that those of little variety deflate."""
    planes = np.stack(columns).astype(np.int64).view(np.uint8).reshape(len(columns), -1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes())


def grown(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(columns, -1)


def tokenized(documents: DataFrame) -> DataFrame:
    """row, doc_id and words (BYTES each) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 128):
                rows = batch.slice(part, 128)
                words, counts = words_of(rows["text"].to_pylist())
                data = packed(words >> np.uint64(40))
                ends = np.cumsum(np.append(0, counts)) * BYTES
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([rows["doc_id"], texts.cast(pa.binary())], ["doc_id", "words"])

    found = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, words binary")
    return stage(found.withColumn("row", F.monotonically_increasing_id()), "words")


MATCH = "row long, at long, of_row long, of_at long"


def matches(texts: DataFrame) -> DataFrame:
    """row, at, of_row, of_at (an earlier occurrence, or itself for the first), of each seed that comes again.

    ``at`` is twice the place, plus 1 if places of that seed were left out within LEAST words.
    """
    spark = texts.sparkSession
    buckets = BUCKETS * partitions(spark)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                some = batch.slice(part, 256)
                held.append(some)
                size += (pc.sum(pc.binary_length(some["words"])).as_py() or 0) // BYTES
                if size >= CHUNK:
                    yield from sent(held)
                    held, size = [], 0
        if held:
            yield from sent(held)

    def sent(held):
        rows = np.concatenate([x["row"].to_numpy() for x in held])
        data = [w for x in held for w in x["words"].to_pylist()]
        counts = np.array([len(w) // BYTES for w in data])
        at, value = seeds(mix(unpacked(b"".join(data)).astype(np.uint64)), counts)
        ends = np.cumsum(counts)
        text = np.searchsorted(ends, at, "right")
        at = at - (ends - counts)[text]
        order = np.argsort(value, kind="stable")
        value, text, at = value[order], text[order], at[order]
        keep, thin = fresh(value, at, text)
        at = at * 2 + thin
        value, row, at = value[keep], rows[text[keep]], at[keep]
        if not len(value):
            return
        new = np.append(True, value[1:] != value[:-1])
        first = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        few = np.arange(len(value)) - first[which] < FEW
        out = {"bucket": [], "kind": [], "data": []}
        for kind, some in ((0, few), (1, ~few)):
            key = ((value[some] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            columns = [value[some].view(np.int64), row[some], at[some]]
            if kind:  # matched here; where it goes doesn't matter
                key = (row[some] + at[some]) % buckets
                lead = first[which[some]]
                columns = [row[some], at[some], row[lead], at[lead]]
                order = np.argsort(key, kind="stable")
                key, columns = key[order], [c[order] for c in columns]
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
            for low, high in zip(cut, np.append(cut[1:], len(key)) if len(key) else []):
                out["bucket"].append(int(key[low])), out["kind"].append(kind), out["data"].append(shrunk(*[c[low:high] for c in columns]))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())]))

    def match(t: pa.Table) -> pa.Table:
        """All of a bucket, or of several."""
        out = [grown(x.as_py(), 4) for k, x in zip(t["kind"].to_pylist(), t["data"]) if k]
        parts = [grown(x.as_py(), 3) for k, x in zip(t["kind"].to_pylist(), t["data"]) if not k]
        if parts:
            value, row, at = np.concatenate(parts, axis=1)
            order = np.lexsort((at, row, value))
            value, row, at = value[order], row[order], at[order]
            first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            many = np.diff(np.append(first, len(value)))
            lead = np.repeat(first, many)
            some = np.repeat(many > 1, many)
            out.append(np.stack([row[some], at[some], row[lead[some]], at[lead[some]]]))
        out = np.concatenate(out, axis=1)
        return pa.table(list(out), names=["row", "at", "of_row", "of_at"])

    blobs = texts.select("row", "words").mapInArrow(lean(send), "bucket int, kind int, data binary")
    return map_tables(blobs, ["bucket"], match, MATCH)


REQUEST = "kind int, row long, start long, stop long, of_row long, of_start long, of_stop long, path array<long>"


def chained(t: pa.Table, least: int) -> pa.Table:
    """Chains (kind 0) and regions (kind 1) of whole rows of matches."""
    row, at, of, there = (t[c].to_numpy() for c in ("row", "at", "of_row", "of_at"))
    order = np.lexsort((at, row))
    r, a, b = regions(row[order], at[order] >> 1, (at[order] & 1).astype(bool), least)
    out = {"kind": [1] * len(r), "row": r.tolist(), "start": a.tolist(), "stop": b.tolist(), "of_row": [None] * len(r), "of_start": [None] * len(r), "of_stop": [None] * len(r), "path": [None] * len(r)}
    other = (row != of) | (at != there)
    row, x, of, y = row[other], at[other] >> 1, of[other], there[other] >> 1
    if len(row):
        pair = np.lexsort((of, row))
        row, of, x, y = row[pair], of[pair], x[pair], y[pair]
        group = np.cumsum(np.append(True, (row[1:] != row[:-1]) | (of[1:] != of[:-1]))) - 1
        head = np.flatnonzero(np.append(True, np.diff(group) > 0))
        g, x, y, last = segments(x, y, group)
        cut = np.flatnonzero(np.append(True, np.diff(g) > 0))
        for low, high in zip(cut.tolist(), np.append(cut[1:], len(g)).tolist()):
            xs, ys, ends = x[low:high].tolist(), y[low:high].tolist(), last[low:high].tolist()
            of_row, own_row = int(of[head[g[low]]]), int(row[head[g[low]]])
            for path in chains(xs, ys, ends) if high - low > 1 else [[0]]:
                a, b = path[0], path[-1]
                for c, v in zip(out, (0, own_row, xs[a], ends[b] + SEED, of_row, ys[a], ys[b] + ends[b] - xs[b] + SEED, [w for k in path for w in (xs[k], ys[k], ends[k] - xs[k] + SEED)])):
                    out[c].append(v)
    kinds = (pa.int32(), *[pa.int64()] * 6, pa.list_(pa.int64()))
    return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


PASSAGE = "doc_id long, start long, stop long, of_doc_id long, of_start long, of_stop long, agreeing long, row long, of_row long"


def passages(documents: DataFrame, least: int = LEAST, same: float = SAME) -> DataFrame:
    """Later occurrences of passages of at least ``least`` words.

    Returns doc_id, start, stop (words), of_doc_id, of_start, of_stop (an earlier
    occurrence), agreeing (words), row and of_row. Words are those of ``words.WORD``.
    At least ``same`` of a passage's words agree, in order. "Earlier" is by row of the
    input, which is by file. A passage may repeat within one document, if it doesn't reach into itself. Null and empty
    texts have none; equal rows are documents of their own, so the whole text of a later
    one repeats; a null id comes back as null. Other columns are ignored.
    """
    spark = documents.sparkSession
    texts = tokenized(documents)
    asked = stage(map_tables(matches(texts), ["row"], lambda t: chained(t, least), REQUEST).withColumn("id", F.monotonically_increasing_id()), "chains")
    release(spark)

    # One join brings the words that a chain needs of either text, and those of the regions.
    low = lambda start: F.greatest(F.lit(0), F.col(start) - MARGIN)
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("row").alias("of"), F.when(F.col("kind") == 0, low("start")).otherwise(F.col("start")).alias("low"), F.when(F.col("kind") == 0, F.col("stop") + MARGIN).otherwise(F.col("stop")).alias("high")),
        F.struct(F.lit(1).alias("side"), F.col("of_row").alias("of"), low("of_start").alias("low"), (F.col("of_stop") + MARGIN).alias("high")),
    )
    wanted = asked.select("id", "kind", F.explode(sides).alias("s")).select("id", "kind", "s.*").where("of IS NOT NULL")
    cut = F.substring("words", (BYTES * F.col("low")).cast("int") + 1, (BYTES * (F.col("high") - F.col("low"))).cast("int"))
    pieces = stage(wanted.join(texts.withColumnRenamed("row", "of"), "of").select("id", "kind", "side", F.col("of").alias("row"), "low", "doc_id", cut.alias("words")), "pieces")
    drop(texts)
    release(spark)

    plans = asked.where("kind = 0").select("id", F.lit(-1).alias("side"), "row", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("words"), "start", "stop", "of_row", "of_start", "of_stop", "path")
    both = plans.unionByName(pieces.where("kind = 0").drop("kind"), allowMissingColumns=True)
    first = stage(map_tables(both, ["id"], lambda t: align(t, least, same), f"{PASSAGE}, exact array<struct<start: long, stop: long>>", ["side"]), "passages")

    # A passage whose seeds come first in several texts may be in none of them. What is in no exact passage
    # yet is matched by all its runs of least words, so that no repeat of that length is left.
    done = first.select("row", F.explode("exact").alias("e")).select("row", F.col("e.start").alias("low"), F.col("e.stop").alias("high"))
    open_ = pieces.where("kind = 1").select("row", "low", "doc_id", "words").unionByName(done, allowMissingColumns=True)
    long = stage(map_tables(open_, ["row"], lambda t: open_runs(t, least), "row long, doc_id long, at long, seed long"), "runs")
    drop(asked, pieces)
    release(spark)
    # sums up on the map side, so a run that is everywhere arrives once from each task
    firsts = long.groupBy("seed").agg(F.min(F.struct("row", "at", "doc_id")).alias("first"), F.count("*").alias("n")).where("n > 1").select("seed", "first")
    again = long.join(firsts, "seed").select("row", "at", "doc_id", F.col("first.row").alias("of_row"), F.col("first.at").alias("of_at"), F.col("first.doc_id").alias("of_doc_id"))
    again = again.where((F.col("row") != F.col("of_row")) | (F.col("at") != F.col("of_at")))
    second = stage(map_tables(again, ["row"], lambda t: diagonals(t, least), PASSAGE), "passages")
    drop(long)
    return first.drop("exact").unionByName(second)


def align(t: pa.Table, least: int, same: float) -> pa.Table:
    """Passages of chains; t has three rows of each, its plan and the words of either side. exact: runs of ``least`` words or more that are equal."""
    out: dict[str, list] = {k: [] for k in ("doc_id", "start", "stop", "of_doc_id", "of_start", "of_stop", "agreeing", "row", "of_row", "exact")}
    rows = t.to_pylist()
    for plan, own, other in zip(rows[::3], rows[1::3], rows[2::3]):
        x, y, dx, dy = unpacked(own["words"]), unpacked(other["words"]), own["low"], other["low"]
        a, b, c, d = plan["start"] - dx, plan["stop"] - dx, plan["of_start"] - dy, plan["of_stop"] - dy
        alone = plan["row"] == plan["of_row"]
        left, left_of = extend(x[:a][::-1], y[:c][::-1])
        right, right_of = extend(x[b:], y[d:])
        a, c, b, d = a - left, c - left_of, b + right, d + right_of
        if alone and d + dy > a + dx:  # in one document the passage must not reach into itself
            over = d + dy - a - dx
            b, d = b - over, d - over
        if b - a < least // 2 or d <= c:
            continue
        path = plan["path"]
        path = [(p - dx, q - dy, n) for p, q, n in zip(path[::3], path[1::3], path[2::3])]
        near = lambda: aligned(x[a:b], y[c:d], [(p - a, q - c, n) for p, q, n in path])
        i, j = near()
        if b - a >= least and len(i) >= same * max(b - a, d - c):
            agreed = [(0, b - a, 0, d - c, len(i))]
        else:  # with poorer surroundings, or in parts, it may agree
            if not alone:
                a, c, b, d = max(0, a - least), max(0, c - least), min(len(x), b + least), min(len(y), d + least)
                i, j = near()
            agreed = parts(i, j, least, same)
        for p, q, u, v, n in agreed:
            some = (i >= p) & (i < q)
            exact = [{"start": s + a + dx, "stop": e + a + dx} for s, e in exact_runs(i[some], j[some], least)]
            for k, value in zip(out, (own["doc_id"], p + a + dx, q + a + dx, other["doc_id"], u + c + dy, v + c + dy, n, plan["row"], plan["of_row"], exact)):
                out[k].append(value)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table([pa.array(v, spans if k == "exact" else pa.int64()) for k, v in out.items()], names=list(out))


def open_runs(t: pa.Table, least: int) -> pa.Table:
    """Hashes of all runs of ``least`` words of the regions of whole rows, but for those inside exact passages; where one comes again within LEAST words, one place in LEAST words counts."""
    out = {k: [np.zeros(0, np.int64)] for k in ("row", "doc", "at", "seed")}
    ids = []
    ends = np.append(boundaries(t, ["row"]), t.num_rows)
    lows, data = t["low"].to_numpy(), t["words"].to_pylist()
    for first, last in zip(ends[:-1].tolist(), ends[1:].tolist()):
        held = [k for k in range(first, last) if data[k] is not None]
        done = t["high"].slice(first, last - first).to_pylist()
        done = [(int(lows[first + k]), v) for k, v in enumerate(done) if v is not None]
        for k in held:
            words = unpacked(data[k])
            low = int(lows[k])
            for p, q in unmatched(np.array([low]), np.array([low + len(words)]), done, least):
                run = grams(mix(words[p - low : q - low].astype(np.uint64)), least)
                place = np.arange(p, p + len(run))
                order = np.argsort(run, kind="stable")
                keep, _ = fresh(run[order], place[order], np.zeros(len(run), np.int8))
                some = order[keep]
                out["row"].append(np.full(len(some), t["row"][first].as_py())), out["at"].append(place[some]), out["seed"].append(run[some].astype(np.int64))
                ids += [t["doc_id"][k].as_py()] * len(some)
    return pa.table([np.concatenate(out["row"]), pa.array(ids, pa.int64()), np.concatenate(out["at"]), np.concatenate(out["seed"])], names=["row", "doc_id", "at", "seed"])


def diagonals(t: pa.Table, least: int) -> pa.Table:
    """Passages of equal runs of ``least`` words, joined where they follow one another in both texts."""
    row, of, x, y = (t[c].to_numpy() for c in ("row", "of_row", "at", "of_at"))
    order = np.lexsort((x, y - x, of, row))
    row, of, x, y = row[order], of[order], x[order], y[order]
    cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (of[1:] != of[:-1]) | (np.diff(x) != 1) | (np.diff(y) != 1)))
    end = np.append(cut[1:], len(x)) - 1
    start, stop, there, row, of = x[cut], x[end] + least, y[cut], row[cut], of[cut]
    # in one document a passage must not reach into itself
    over = np.where(row == of, np.maximum(0, there + stop - start - start), 0)
    stop = stop - over
    some = stop - start >= least
    take = lambda c: t[c].take(pa.array(order[cut][some]))
    start, stop, there = start[some], stop[some], there[some]
    return pa.table([take("doc_id"), start, stop, take("of_doc_id"), there, there + stop - start, stop - start, row[some], of[some]], names=[c.split()[0] for c in PASSAGE.split(", ")])


def repeats(documents: DataFrame) -> DataFrame:
    """``passages``, one row a document and the document where its passages come first, largest stretch and all spans."""
    found = passages(documents)
    span = F.struct("start", "stop", "of_start", "of_stop", "agreeing")
    return found.groupBy("row", "of_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("of_doc_id").alias("of_doc_id"), F.sort_array(F.collect_list(span)).alias("spans"), F.max(F.col("stop") - F.col("start")).alias("longest")
    ).drop("row", "of_row")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the words of the spans (which may overlap), and less what stands between them."""
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, last = [], 0
    for start, stop in sorted(spans):
        start, stop = min(start, len(at) - 1), min(stop, len(at) - 1)
        if at[start] > last:
            out.append(text[last : at[start]])
        last = max(last, at[stop])
    return "".join([*out, text[last:]])


def remove(documents: DataFrame) -> DataFrame:
    """Cut later occurrences of repeated passages from the texts; rows, other columns and first occurrences stay.

    A document that is all repeated keeps an empty text. Texts without repeats keep every byte; null ones
    stay null. Columns of any name come through as they are.
    """
    key, cuts = unused(documents, "_key"), unused(documents, "_spans")
    numbered = stage(documents.withColumn(key, F.monotonically_increasing_id()), "numbered")
    plain = numbered.select(F.col(key).alias("doc_id"), "text")
    spans = passages(plain).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias(cuts)).withColumnRenamed("doc_id", key)
    both = numbered.join(spans, key, "left").drop(key)
    columns = documents.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t if not s else without(t, [(x["start"], x["stop"]) for x in s]) for t, s in zip(batch["text"].to_pylist(), batch[cuts].to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch[c] for c in columns], columns)

    return both.mapInArrow(lean(cut), documents.schema)
