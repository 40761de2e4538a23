"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by pseudo-random rotations (sign flips and fast Hadamard transforms,
three times over); its hash is the axis it then lies closest to, with the sign. Each
table joins several such hashes into a bucket, and a vector is looked up in the buckets
of its next-best axes as well. What meets is linked if sketches of 256 bits, sides of random hyperplanes, allow a
pair at the bound; only what is linked so sends its vector, and is compared exactly, in double precision.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavspark.llm.shared import block_pairs, components, dealt_anew, drop, map_groups, plausible, release, stage

LINKED = 0.98
#: The part of pairs at the bound that meet in a bucket; further buckets that are looked up in each table.
RECALL, PROBES = 0.99999, 1
#: Bits of a sketch, each the side of a random hyperplane. Pairs at the bound differ in so many standard deviations more than expected at most.
BITS, SPREAD = 256, 6


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of rows whose length is a power of two."""
    n, x = x.shape[1], x.copy()
    h = 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def padded(dim: int) -> int:
    """A power of two; at least 64, as shorter vectors have too few rotations that differ."""
    return 1 << max(6, int(np.ceil(np.log2(max(2, dim)))))


def signs(dim: int, tables: int, hashes: int) -> np.ndarray:
    return np.random.default_rng(20240607).choice([-1.0, 1.0], (tables, hashes, 3, dim))


@functools.cache
def settings(rows: int, dim: int, least: float = LINKED, recall: float = RECALL, probes: int = PROBES) -> tuple[int, int]:
    """Tables, and hashes in a bucket.

    As many hashes as make more buckets than there are rows, so that a bucket doesn't grow with them; then as many
    tables as the recall asks for, by the part of 2000 random pairs at the bound that meet in a table.
    """
    dim = padded(dim)
    hashes = min(max(2, int(np.ceil(np.log(max(2, rows)) / np.log(2 * dim)))), 62 // int(np.log2(2 * dim)))
    rng = np.random.default_rng(11)
    x, z = rng.standard_normal((2, 2000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = least * x + np.sqrt(1 - least * least) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    a, b = buckets(x, 4, hashes, probes)[0], buckets(y, 4, hashes, probes)[0]
    meets = (a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)
    return max(2, int(np.ceil(np.log(1 - recall) / np.log(1 - min(meets.mean(), 0.9999))))), hashes


def near_bits(least: float = LINKED) -> int:
    """Bits in which the sketches of a pair at the bound differ at most."""
    p = np.arccos(least) / np.pi
    return int(np.ceil(BITS * p + SPREAD * np.sqrt(BITS * p * (1 - p))))


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For unit rows: (rows, tables, 1 + probes) bucket numbers, a vector's own first; and sketches of BITS bits as longs.

    A probe changes one hash to the axis next in size; the cheapest changes come first. Bits of a sketch are
    independent of each other, so those in which two vectors differ are as many as a binomial says.
    """
    dim = padded(x.shape[1])
    x = np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    flips = signs(dim, tables, hashes)
    out = np.zeros((len(x), tables, 1 + probes), np.int64)
    rows = np.arange(len(x))
    for t in range(tables):
        best, losses, axes = [], [], []
        for k in range(hashes):
            y = x
            for s in flips[t, k]:
                y = hadamard(y * s)
            both = np.concatenate([y, -y], axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, : 1 + probes]
            height = np.take_along_axis(both, top, 1)
            best.append(top[:, 0])
            axes.append(top[:, 1:])
            losses.append((height[:, :1] - height[:, 1:]) ** 2)
        own = sum(b * (2 * dim) ** k for k, b in enumerate(best))
        out[:, t, 0] = own
        changed = np.concatenate([own[:, None] + (a - b[:, None]) * (2 * dim) ** k for k, (a, b) in enumerate(zip(axes, best))], axis=1)
        cheap = np.argsort(np.concatenate(losses, axis=1), axis=1, kind="stable")[:, :probes]
        out[:, t, 1:] = changed[rows[:, None], cheap]
    sides = x @ np.random.default_rng(99).standard_normal((dim, BITS)) > 0
    return out, np.packbits(sides, axis=1).view(np.int64)


def links(vectors: DataFrame, least: float = LINKED, recall: float = RECALL, probes: int = PROBES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Copies, counts and edges of the links between distinct vectors of one label, by row.

    copies: (row, vec_id, rep, same) for every row; rep the first row with
    the same label and components, same how many those are; an unusable row has no rep. counts: (rep, n), the rows
    linked to a rep besides its copies. edges: (a, b) that connect each group of links.
    """

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors as little-endian doubles, and those of length one; null where they can't link."""
        for batch in batches:
            raw, units = [], []
            for label, v in zip(batch["label"], batch["embedding"]):
                raw.append(None), units.append(None)
                if v.as_py() is None or not label.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    size = np.linalg.norm(x / big) * big if (big := np.abs(x).max(initial=0)) and np.isfinite(big) else 0
                if size and np.isfinite(size):
                    raw[-1], units[-1] = (x + 0.0).tobytes(), (x / big / np.linalg.norm(x / big)).tobytes()
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(raw, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "label", "raw", "unit"])

    usable = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding").mapInArrow(unit, "vec_id long, label string, raw binary, unit binary")
    usable = stage(usable.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.xxhash64("label").alias("label"), F.sha2(F.concat(F.encode("label", "UTF-8"), F.lit(b"\0"), "raw"), 256).alias("same_as"), "unit"), "vectors")
    slim = usable.select("row", "vec_id", "same_as")
    reps = stage(slim.where("same_as IS NOT NULL").groupBy("same_as").agg(F.min("row").alias("rep"), F.count("*").alias("same")), "reps", narrow=True)
    copies = stage(slim.join(reps, "same_as", "left").select("row", "vec_id", "rep", "same"), "copies", narrow=True)
    only = copies.where("row = rep").select("row", "same")
    distinct = usable.join(only, "row").select(F.col("row").alias("node"), "label", "same", "unit")
    size = distinct.agg(F.count("*"), F.max(F.octet_length("unit"))).first()
    tables, hashes = settings(size[0], (size[1] or 16) // 8, least, recall, probes)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1024):
                rows = batch.slice(part, 1024)
                units = [np.frombuffer(x.as_buffer()) for x in rows["unit"]]
                for dim in sorted({len(x) for x in units}):
                    at = np.array([k for k, x in enumerate(units) if len(x) == dim])
                    own, sketch = buckets(np.stack([units[k] for k in at]), tables, hashes, probes)
                    some = rows.take(pa.array(at))
                    # a bucket's key: label, dimensions, table, number; mixed to 64 bits, and always checked by vectors
                    key = own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (np.arange(tables, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[None, :, None]
                    key ^= (some["label"].to_numpy().astype(np.uint64) * np.uint64(0x165667B19E3779F9) + np.uint64(dim))[:, None, None]
                    key ^= key >> np.uint64(31)
                    key = (key * np.uint64(0xBF58476D1CE4E5B9)).astype(np.int64)
                    ends = pa.array(np.arange(len(at) + 1) * tables * (1 + probes), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [some["node"], pa.ListArray.from_arrays(ends, pa.array(key.reshape(-1))), pa.array(sketch.tolist(), pa.list_(pa.int64()))], ["node", "keys", "sketch"]
                    )

    found = stage(distinct.select("node", "label", "unit").mapInArrow(hashed, "node long, keys array<long>, sketch array<long>"), "buckets")
    met = plausible(found.select(F.explode("keys").alias("key"), "node"), found.select("node", "sketch"), near_bits(least))
    groups = components(met)
    held = groups.join(distinct, "node").withColumn("weight", F.octet_length("unit").cast("long"))
    dealt = block_pairs(held, "component", "weight", "node", most_weight=1 << 23)

    def compare(t: pa.Table) -> pa.Table | None:
        """Links within one pair of blocks of a component."""
        rep, label, same, block = (t[c].to_numpy() for c in ("node", "label", "same", "_block"))
        split = t["_i"][0].as_py() != t["_j"][0].as_py()
        units = [np.frombuffer(x.as_buffer()) for x in t["unit"]]
        width = np.array([len(x) for x in units])
        found_a, found_b = [], []
        for k, w in sorted({*zip(label.tolist(), width.tolist())}):
            at = np.flatnonzero((label == k) & (width == w))
            x = np.stack([units[j] for j in at])
            for low in range(0, len(at), 512):
                a, b = np.nonzero(x[low : low + 512] @ x.T >= least - 1e-9)
                a = a + low
                fine = a < b
                if split:
                    fine &= block[at[a]] != block[at[b]]
                a, b = a[fine], b[fine]
                # the product of a matrix sums in any order: what is close to the bound is summed again
                exact = np.einsum("ij,ij->i", x[a], x[b]) >= least
                found_a.append(at[a[exact]]), found_b.append(at[b[exact]])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        if not len(a):
            return None
        nodes, place = np.unique(np.concatenate([rep[a], rep[b]]), return_inverse=True)
        total = np.bincount(place, np.concatenate([same[b], same[a]])).astype(np.int64)
        root = roots(len(nodes), place[: len(a)], place[len(a) :])
        return pa.table({"rep": nodes, "n": total, "to": nodes[root]})

    verified = stage(map_groups(dealt, ["component", "_i", "_j"], compare, "rep long, n long, to long"), "links")
    drop(found, met, usable, reps)
    release(vectors.sparkSession)
    counts = dealt_anew(verified.groupBy("rep").agg(F.sum("n").alias("n")), "rep")
    return copies, counts, verified.select(F.col("rep").alias("a"), F.col("to").alias("b"))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def dedup(vectors: DataFrame, least: float = LINKED) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a vector.

    Vectors are linked if their labels are equal and not null and their cosine, in double
    precision, is at least ``least``. Null and zero vectors, and those with a null or
    non-finite component, link with nothing, nor do vectors of different length.
    Equal vectors are one row in the search, and their links are multiplied after it.
    Rows of one vec_id are vectors of their own, each with its own links and component; a null vec_id comes after all
    others, and a component of nothing else has a null id. kept is true where vec_id is component_id, both null included.
    Other columns are ignored; an empty table gives an empty result.
    """
    copies, counts, edges = links(vectors, least)
    of = components(edges)
    linked = copies.join(counts, "rep", "left").join(of, F.col("rep") == F.col("node"), "left")
    linked = stage(linked.select("row", "vec_id", (F.coalesce(F.col("same") - 1, F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep", "row").alias("component")), "linked")
    # sums up on the map side, so a large component arrives once from each task
    first = dealt_anew(linked.groupBy("component").agg(F.min("vec_id").alias("component_id")), "component")
    return linked.join(first, "component").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
