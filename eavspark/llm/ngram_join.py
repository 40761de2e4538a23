"""Near-duplicate documents by the Jaccard similarity of their word n-grams.

MinHash signatures are cut into bands: each of TREES runs of hashes is matched by a prefix of
fixed depth, and documents that share it meet. The depths come from a formula, before any
data is seen: from full depth, they are shortened one run at a time until a pair at the
threshold is met with the target probability. This is banded LSH and stands in for an LSH
forest, whose tries would let each document shorten its prefixes by what it meets. What meets
is linked if sketches of the signatures allow similar documents to be connected by it; what is so connected is verified by the n-grams themselves, exactly.

Equal sets of n-grams are one row throughout. Candidates are never listed as pairs: a
prefix links its members to its first (to further ones, where they have little in common with that), the groups which that gives are compared
inside blocks of bounded size, and only each row's count of links and the edges that
connect it leave a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavspark.llm.embed_dedup import roots
from eavspark.llm.shared import block_pairs, components, dealt_anew, drop, lean, map_groups, plausible, stage
from eavspark.llm.words import grams, mix, words_of

WORDS, SIMILAR = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.9995
#: Bits of each hash in a sketch. Pairs at the threshold differ in so many standard deviations more than expected at most.
BITS, SPREAD = 4, 6
#: Sets of so many n-grams at most are compared by all 64 bits of them; in larger ones equal halves by chance don't matter.
SMALL = 16


def prefixes(similar: float = SIMILAR, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> list[int]:
    """Depth of the matched prefix in each tree: the longest that reach the recall at the threshold."""
    out, k = [depth] * trees, 0
    while 1 - np.prod([1 - similar**d for d in out]) < recall and out[-1] > 1:
        out[k] -= 1
        k = (k + 1) % trees
    return out


def near_bits(similar: float = SIMILAR) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most.

    Each of the hashes is another one with probability 1 - similar, and then half of its bits differ.
    """
    n, p = TREES * DEPTH, 1 - similar
    return int(np.ceil(n * p * BITS / 2 + SPREAD * np.sqrt(n * (p * (BITS / 4 + BITS**2 / 4) - (p * BITS / 2) ** 2))))


def sketch(signed: np.ndarray) -> list[int]:
    """BITS bits of each hash, as longs."""
    low = (mix(signed) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, -BITS:]).view(np.int64).tolist()


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash values of a set of 32-bit n-grams: each hash is a multiply and shift of its own."""
    rng = np.random.default_rng(1234567)
    factor = rng.integers(0, 1 << 62, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 62, hashes, np.uint64)
    best = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    spread = mix(shingles.astype(np.uint64))
    for low in range(0, len(spread), 256):
        best = np.minimum(best, (spread[low : low + 256, None] * factor + shift >> np.uint64(16)).min(0))
    return best


def sets(documents: DataFrame, words: int, depths: list[int], depth: int, keep: str | None) -> DataFrame:
    """row, doc_id, same (digest of the set), size, shingles (sorted 32-bit, as differences), full (64-bit, of a small set), keys (a tree's prefix each), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.array([k for t, d in enumerate(depths) for k in range(t * depth, t * depth + d)])
        start = np.concatenate([[0], np.cumsum(depths)[:-1]])
        salt = mix(np.arange(1, len(place) + 1, dtype=np.uint64))
        for batch in batches:
            for part in range(0, batch.num_rows, 128):
                rows = batch.slice(part, 128)
                same, size, data, full, keys, sketches = [], [], [], [], [], []
                hashed, counts = words_of(rows["text"].to_pylist())
                for own in np.split(hashed, np.cumsum(counts)[:-1]):
                    whole = np.unique(grams(own, words))
                    found = np.unique((whole >> np.uint64(32)).astype(np.uint32))
                    raw = np.diff(found, prepend=np.uint32(0)).tobytes()
                    size.append(len(found)), data.append(raw), same.append(hashlib.blake2b(whole.tobytes(), digest_size=16).digest())
                    full.append(whole.tobytes() if len(whole) <= SMALL else b"")
                    if len(found):
                        signed = signature(found, len(depths) * depth)
                        keys.append(np.add.reduceat(mix(signed[place] + salt), start).astype(np.int64).tolist()), sketches.append(sketch(signed))
                    else:
                        keys.append([]), sketches.append([])
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["kept_key"], pa.array(same, pa.binary()), pa.array(size, pa.int64()), pa.array(data, pa.binary()), pa.array(full, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                    ["doc_id", "kept_key", "same", "size", "shingles", "full", "keys", "sketch"],
                )

    found = documents.select(F.col("doc_id").cast("long"), (F.col(keep) if keep else F.lit(0)).cast("long").alias("kept_key"), "text")
    found = found.mapInArrow(lean(run), "doc_id long, kept_key long, same binary, size long, shingles binary, full binary, keys array<long>, sketch array<long>")
    return stage(found.withColumn("row", F.monotonically_increasing_id()), "sets")


def shared_counts(of: np.ndarray, what: np.ndarray, n: int) -> np.ndarray:
    """How many elements each two of n sets share; ``of[k]`` is the set that ``what[k]`` is in.

    Elements of many sets are multiplied as a matrix, in slices; those of few are counted pair by pair.
    """
    order = np.argsort(what, kind="stable")
    of, what = of[order], what[order]
    first = np.flatnonzero(np.concatenate([[True], what[1:] != what[:-1]]))
    many = np.diff(np.append(first, len(what)))
    out = np.zeros((n, n), np.float32)
    for p in range(2, 16):
        at = first[many == p]
        for low in range(0, len(at), 1 << 14):
            group = of[at[low : low + (1 << 14), None] + np.arange(p)]
            a, b = np.triu_indices(p, 1)
            out += np.bincount((group[:, a].astype(np.int64) * n + group[:, b]).ravel(), minlength=n * n).reshape(n, n).astype(np.float32)
    big = np.flatnonzero(many >= 16)
    for low in range(0, len(big), 4096):
        some = big[low : low + 4096]
        matrix = np.zeros((n, len(some)), np.float32)
        take = np.concatenate([np.arange(first[k], first[k] + many[k]) for k in some])
        matrix[of[take], np.repeat(np.arange(len(some)), many[some])] = 1
        out += np.triu(matrix @ matrix.T, 1)
    return out + out.T


def links(documents: DataFrame, words: int = WORDS, similar: float = SIMILAR, recall: float = RECALL, keep: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Copies, counts and edges, as of ``embed_dedup.links``, by row.

    copies: (row, doc_id, rep, same, size). counts: (rep, n), the documents linked to a
    rep besides its copies. edges: (a, b) between reps.
    """
    all_sets = sets(documents, words, prefixes(similar, recall), DEPTH, keep)
    slim = all_sets.select("row", "doc_id", "kept_key", F.when(F.col("size") > 0, F.col("same")).otherwise(F.encode(F.col("row").cast("string"), "UTF-8")).alias("same_as"), "size")
    # written, so that the join on a hot key is one which adaptive execution splits
    reps = stage(slim.groupBy("same_as").agg(F.min("row").alias("rep"), F.count("*").alias("same")), "reps", narrow=True)
    copies = stage(slim.join(reps, "same_as").select("row", "doc_id", "kept_key", "rep", "same", "size"), "copies", narrow=True)
    only = copies.where("row = rep AND size > 0").select("row", "same")
    members = stage(all_sets.select("row", "keys").join(only, "row").select(F.explode("keys").alias("key"), F.col("row").alias("node")), "prefixes")
    met = plausible(members, all_sets.select(F.col("row").alias("node"), "sketch"), near_bits(similar))
    drop(members, reps)
    groups = components(met)
    held = groups.join(all_sets.select("row", "size", "shingles", "full"), F.col("node") == F.col("row")).join(only, "row").select("component", "row", "size", "same", "shingles", "full")
    dealt = block_pairs(held, "component", "size", "row")

    def compare(t: pa.Table) -> pa.Table | None:
        rows, size, same, block = (t[c].to_numpy() for c in ("row", "size", "same", "_block"))
        n = len(rows)
        what = np.concatenate([np.cumsum(np.frombuffer(x.as_buffer(), np.uint32), dtype=np.uint32) for x in t["shingles"]])
        common = shared_counts(np.repeat(np.arange(n), size), what, n)
        linked = common >= similar * (size[:, None] + size[None, :] - common) - 1e-9
        whole = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["full"]]
        small = np.flatnonzero([len(x) > 0 for x in whole])
        if len(small):
            n_of = np.array([len(whole[k]) for k in small])
            both = shared_counts(np.repeat(np.arange(len(small)), n_of), np.concatenate([whole[k] for k in small]), len(small))
            linked[np.ix_(small, small)] = both >= similar * (n_of[:, None] + n_of[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        if t["_i"][0].as_py() != t["_j"][0].as_py():
            linked &= block[:, None] != block[None, :]
        total = (linked @ same.astype(np.float64)).astype(np.int64)
        some = np.flatnonzero(total)
        if not len(some):
            return None
        a, b = np.nonzero(linked)
        order = np.argsort(rows)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        root = rows[order][roots(n, rank[a], rank[b])][rank]
        return pa.table({"rep": rows[some], "n": total[some], "to": root[some]})

    found = stage(map_groups(dealt, ["component", "_i", "_j"], compare, "rep long, n long, to long"), "links")
    drop(met, all_sets)
    return copies, dealt_anew(found.groupBy("rep").agg(F.sum("n").alias("n")), "rep"), found.select(F.col("rep").alias("a"), F.col("to").alias("b"))


def classes(documents: DataFrame, words: int = WORDS, similar: float = SIMILAR, recall: float = RECALL, keep: str | None = None) -> DataFrame:
    """One row a document: doc_id, class_id (the smallest doc_id linked to it, over any links), n_links, kept.

    Documents are linked if the Jaccard similarity of their sets of ``words``-word n-grams
    is at least ``similar``; a pair at the bound is found with probability ``recall`` and
    more similar ones more surely. A text of fewer words is one n-gram. Texts without
    words (null, empty) link with nothing. kept is true of one row of each class, one with
    the smallest id. Repeated rows are documents of their own; a null id comes after all
    others, and a class of nothing else has a null class_id. ``keep`` names a long column that comes back; other columns are ignored.
    """
    copies, counts, edges = links(documents, words, similar, recall, keep)
    of = components(edges)
    linked = copies.join(counts, "rep", "left").join(of, F.col("rep") == F.col("node"), "left").select(
        "row", "doc_id", "kept_key", (F.when(F.col("size") > 0, F.col("same") - 1).otherwise(0) + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component", "rep").alias("component"),
    )
    linked = stage(linked, "linked", narrow=True)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    first = dealt_anew(linked.groupBy("component").agg(F.min(place).alias("first")), "component")
    out = ["doc_id", F.col("first.doc_id").alias("class_id"), "n_links", (F.col("row") == F.col("first.row")).alias("kept")]
    return linked.join(first, "component").select(*out, *([F.col("kept_key").alias(keep)] if keep else []))
