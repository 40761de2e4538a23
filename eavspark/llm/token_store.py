"""A content-addressed store of token ids.

A rolling hash over the ids cuts each document into chunks where its content says so.
A chunk is kept once, deflated, under the SHA-256 of its ids; a document is a recipe, the
list of its chunks' digests with a Merkle root over them; a manifest has the Merkle
root of each recipe file and of the whole. Layout under the store's folder:

    chunks/   digest binary, n int, data binary (zstd of 16-bit little-endian ids)
    recipes/  doc_id, start, n_tokens, digests array<binary>, sizes array<long> (ids of each chunk), root binary; files and rows in ascending doc_id
    manifest/ file string, documents long, first long (ids before its first document), root binary
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eavspark.llm import tokens
from eavspark.llm.shared import boundaries, lean, map_groups, partitions, release, running_total, stage

END = 2
#: Ids of a chunk: at least, at most; and the bits that cut, so 64 + 512 on average.
LEAST, MOST, BITS = 64, 4096, 9
CHUNKS = "key binary, n long, data binary"
RECIPES = "doc_id long, start long, n_tokens long, digests array<binary>, sizes array<long>, root binary"
MANIFEST = "file string, documents long, first long, root binary"
#: The rolling window is 2 ** STEPS ids.
STEPS, FACTOR = 4, 0x9E3779B97F4A7C15


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document. A cut depends only on the 16 ids before it."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    rolled = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    rolled ^= rolled >> np.uint64(29)
    factor = FACTOR
    for k in range(STEPS):
        rolled[1 << k :] += rolled[: -(1 << k)] * np.uint64(factor)
        factor = factor * factor % (1 << 64)
    places = np.flatnonzero((rolled >> np.uint64(64 - BITS)) == 0) + 1
    ends, last = [], 0
    for p in [*places.tolist(), n]:
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST or p == n:
            if p > last:
                ends.append(p)
                last = p
    return ends


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary tree; a node without a partner moves up as it is."""
    level = digests or [b""]
    level = [hashlib.sha256(b"\0" + x).digest() for x in level]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[k : k + 2])).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def write(documents: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Encode every whole text, with ``end`` behind it, and write the store.

    One pass encodes and cuts. A task sends a chunk's data once, under its digest, and
    each document's recipe under the document's row: so a chunk that very many documents
    share arrives once from each task, and no key is hot. The same pass keeps the first of
    equal chunks. Null texts are empty ones; ids may be null or repeat.
    """
    vocabulary = vocabulary or tokens.path("byte_bpe_50k.json")
    spark = documents.sparkSession
    tail = np.array([end], "<u2").tobytes()
    schema = "key binary, kind int, doc_id long, n long, data binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_ids, squeeze, sent = tokens.encoders(vocabulary), zstandard.ZstdCompressor(level=1).compress, set()
        for batch in batches:
            for part in tokens.parts(batch["text"]):
                keys, kinds, ids_, ns, datas = [], [], [], [], []
                rows = batch.slice(*part)
                for doc_id, found in zip(rows["doc_id"].to_pylist(), texts_ids([t or "" for t in rows["text"].to_pylist()])):
                    raw = found + tail
                    ids, recipe, last = np.frombuffer(raw, "<u2"), [], 0
                    for stop in (ends := cuts(ids)):
                        data = raw[2 * last : 2 * stop]
                        digest = hashlib.sha256(data).digest()
                        recipe.append(digest)
                        if digest not in sent:
                            if len(sent) > 500_000:  # a repeated send costs bytes only
                                sent.clear()
                            sent.add(digest)
                            keys.append(digest), kinds.append(0), ids_.append(None), ns.append(stop - last), datas.append(squeeze(data))
                        last = stop
                    whole = b"".join(recipe) + np.diff(ends, prepend=0).astype("<u4").tobytes()
                    keys.append(hashlib.sha256(b"%d" % (doc_id or 0) + whole).digest()), kinds.append(1), ids_.append(doc_id), ns.append(len(ids)), datas.append(whole)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(kinds, pa.int32()), pa.array(ids_, pa.int64()), pa.array(ns, pa.int64()), pa.array(datas, pa.binary())],
                    ["key", "kind", "doc_id", "n", "data"],
                )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (kind, key): of equal chunks the first stays, recipes all stay."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            first = np.zeros(table.num_rows, bool)
            first[boundaries(table, ["key"])] = True
            first[0] = table["key"][0].as_py() != last
            last = table["key"][-1].as_py()
            keep = pc.or_(pc.equal(table["kind"], 1), pa.array(first))
            yield from table.filter(keep).combine_chunks().to_batches()

    sent = documents.select("doc_id", "text").mapInArrow(lean(encode), schema)
    kept = sent.repartition(partitions(spark), "key").sortWithinPartitions("kind", "key").mapInArrow(once, schema)
    kept.write.option("compression", "none").partitionBy("kind").parquet(f"{path}/sent")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    at = lambda x: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{x}")
    if not fs.exists(at("sent/kind=1")):  # no documents: three empty tables
        for name, kind in (("chunks", CHUNKS), ("recipes", RECIPES), ("manifest", MANIFEST)):
            spark.createDataFrame([], kind).write.parquet(f"{path}/{name}")
        fs.delete(at("sent"), True)
        return
    fs.rename(at("sent/kind=0"), at("chunks"))
    release(spark)
    # Recipes take their place by id; the ids before each document are a running total.
    recipes = spark.read.schema("key binary, doc_id long, n long, data binary").parquet(f"{path}/sent/kind=1")
    placed = running_total(recipes, ["doc_id", "key"], "n", [], "start")

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch["data"].to_pylist()
            lists = [[x[k : k + 32] for k in range(0, len(x) // 36 * 32, 32)] for x in held]
            sizes = [np.frombuffer(x[len(x) // 36 * 32 :], "<u4").tolist() for x in held]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["start"], batch["n"], pa.array(lists, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64())), pa.array([merkle(x) for x in lists], pa.binary())],
                ["doc_id", "start", "n_tokens", "digests", "sizes", "root"],
            )

    placed.select("doc_id", "start", "n", "data").mapInArrow(root, RECIPES).repartitionByRange(partitions(spark), "start").sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{path}/recipes")
    fs.delete(at("sent"), True)
    roots(spark, path).write.parquet(f"{path}/manifest")


def roots(spark: SparkSession, path: str) -> DataFrame:
    """The manifest that the recipe files ask for as they are; a task holds the roots of one file."""

    def root(t: pa.Table) -> pa.Table:
        return pa.table([t["file"][:1], pa.array([t.num_rows], pa.int64()), t["start"][:1], pa.array([merkle(t["root"].to_pylist())], pa.binary())], names=["file", "documents", "first", "root"])

    held = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    return map_groups(held.select(F.col("_metadata.file_name").alias("file"), "start", "doc_id", "root"), ["file"], root, MANIFEST, ["start", "doc_id", "root"])


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes as they are read back: doc_id, start (no two have the same), digests, sizes, and whether digests and sizes make the root and the count, and the manifest has their file so."""
    said = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    real = roots(spark, path).select("file", F.col("documents").alias("n"), F.col("root").alias("found"))
    files = real.join(said, "file", "left").select("file", F.coalesce((F.col("n") == F.col("documents")) & (F.col("found") == F.col("root")), F.lit(False)).alias("listed"))
    held = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select("*", F.col("_metadata.file_name").alias("file"))

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [merkle(d) == r and sum(s) == n and len(s) == len(d) for d, s, r, n in zip(*(batch[c].to_pylist() for c in ("digests", "sizes", "root", "n_tokens")))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "start", "digests", "sizes", "file")), pa.array(good, pa.bool_())], ["doc_id", "start", "digests", "sizes", "file", "sound"])

    checked = held.mapInArrow(sound, "doc_id long, start long, digests array<binary>, sizes array<long>, file string, sound boolean")
    return checked.join(files, "file", "left").withColumn("sound", F.col("sound") & F.coalesce("listed", F.lit(False))).drop("file", "listed")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks as read back: digest, n, crc (of 32-bit ids), whole (the digest is that of the ids)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            raw = [unpacked(unpack, x) for x in batch["data"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["key"], pa.array([len(x) // 2 for x in raw], pa.int64()),
                    pa.array([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4")) for x in raw], pa.int64()),
                    pa.array([hashlib.sha256(x).digest() == k for x, k in zip(raw, batch["key"].to_pylist())]),
                ],
                ["digest", "n", "crc", "whole"],
            )

    stored = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    return stored.select("key", "data").mapInArrow(read, "digest binary, n long, crc long, whole boolean")


def unpacked(unpack, data: bytes) -> bytes:
    """A chunk's ids; none if it is damaged."""
    try:
        return unpack(data)
    except zstandard.ZstdError:
        return b""


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents put together again from their chunks: doc_id, start, ids (16-bit little-endian bytes; null where a chunk is lost)."""
    stored = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select(F.col("key").alias("digest"), "data")
    parts = recipes(spark, path).select("doc_id", "start", F.posexplode("digests").alias("k", "digest")).join(stored, "digest", "left")
    whole = parts.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "data"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = [None if any(p["data"] is None for p in x) else b"".join(unpacked(unpack, p["data"]) for p in x) for x in batch["parts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    return whole.mapInArrow(join, "doc_id long, start long, ids binary")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, verified.

    Each chunk's ids are unpacked where they lie and checked against their digest. Its checksum, moved by
    the ids that follow it in a document, is its part of the document's checksum, and the parts are summed: so the ids
    themselves don't travel, and a chunk that very many documents share is one row. verified is true
    if each chunk that the recipe names is there and whole, the digests make the recipe's Merkle root, and the manifest's root of
    the recipe's file is that of the recipes in it. No damage takes a row away whose recipe can be read; n_tokens and ids_crc32 are then of what was found.
    """
    held = recipes(spark, path)
    after = F.expr("transform(sizes, (s, k) -> aggregate(slice(sizes, k + 2, size(sizes)), 0L, (x, y) -> x + y))")
    parts = held.select("doc_id", "start", "sound", F.explode(F.arrays_zip(F.col("digests").alias("digest"), F.col("sizes").alias("size"), after.alias("after"))).alias("p"))
    parts = parts.select("doc_id", "start", "sound", "p.*").join(chunks(spark, path), "digest", "left")
    found = F.coalesce(F.col("whole"), F.lit(False)) & (F.col("n") == F.col("size"))
    parts = parts.select("doc_id", "start", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.col("sound") & F.coalesce(found, F.lit(False))).alias("good"), F.coalesce("crc", F.lit(0)).cast("long").alias("crc"), "after")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = with_zeros(batch["crc"].to_numpy().astype(np.uint32), 4 * batch["after"].to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "start", "n", "good")), pa.array(moved.astype(np.int64))], ["doc_id", "start", "n", "good", "crc"])

    moved = parts.mapInArrow(move, "doc_id long, start long, n long, good boolean, crc long")
    of = moved.groupBy("start").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.bool_and("good").alias("verified"))
    return of.select("doc_id", "start", "n_tokens", "ids_crc32", "verified")


def with_zeros(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32s as they are after so many zero bytes: each bit of a length is a linear map of the 32 bits, in four tables."""
    out, k = crcs.astype(np.uint32), 0
    while (lengths >> k).any():
        some = np.flatnonzero(lengths >> k & 1)
        x = out[some]
        out[some] = with_tables(zeros(k), x)
        k += 1
    return out


@functools.cache
def zeros(k: int) -> np.ndarray:
    """Tables, one for each byte of a CRC, of what 2**k zero bytes make of it."""
    values = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    if k:
        once = with_tables(zeros(k - 1), values)
        return with_tables(zeros(k - 1), once)
    out = values.copy()
    for _ in range(8):
        out = np.where(out & np.uint32(1), out >> np.uint32(1) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


def with_tables(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return functools.reduce(np.bitwise_xor, [tables[b][x >> np.uint32(8 * b) & np.uint32(255)] for b in range(4)])
