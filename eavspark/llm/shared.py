"""Helpers that the operators share: the shared folder, distributed running totals,
connected components, and pairs within groups in bounded blocks.

Nothing here brings rows to the driver; what must be cut from its lineage is written
as a table in the shared folder, so a lost executor costs only a re-read.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import eavspark


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset and there are no other machines."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not one_machine(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, if they are other processes."""
    package, context = Path(eavspark.__file__).parent, spark.sparkContext
    if not one_machine(spark) and context.applicationId not in SHIPPED:
        SHIPPED.add(context.applicationId)
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name))


#: Applications that have the package.
SHIPPED: set[str] = set()
#: Folders that this process has made.
MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that nothing else uses; ``clear`` deletes them all."""
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete all folders that this process has made, once no DataFrame that reads them is needed."""
    while MADE:
        delete(spark, MADE.pop())


#: Partitions that go to one file of a table of few bytes a row.
NARROW = 4


def stage(df: DataFrame, name: str = "stage", narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, as it was, with no lineage.

    Each file that an executor writes to a local file system costs it up to three processes (a chmod of the file, of its checksums
    and of their folder), and one that has just been started shares, and is counted with, the JVM's whole memory. So no files of
    checksums are written there, Parquet's own of each page are verified instead; and of a ``narrow`` table, of few bytes a row, some
    partitions go to one file, unshuffled, in as many tasks as there are cores at least. Not for
    what Python workers return: the pipeline's stages so dealt took more of an executor's memory.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-partitions(spark) // NARROW)))
    path = new_path(spark, name)
    plain = {} if spark._jsc.hadoopConfiguration().get("fs.file.impl") else {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    df.write.options(compression="zstd", **plain).option("parquet.page.write-checksum.enabled", "true").parquet(path)
    return spark.read.schema(df.schema).option("parquet.page.verify-checksum.enabled", "true").parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete staged tables which nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            delete(spark, str(spark._jvm.org.apache.hadoop.fs.Path(file).getParent()))


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to: it does so as the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def step(spark: SparkSession, left: list[str]) -> Iterator[None]:
    """Delete the folders named in ``left``, those of the step before, and name those of this one there.

    For steps each of whose results is written before the next begins.
    """
    while left:
        delete(spark, left.pop())
    release(spark)
    known = len(MADE)
    yield
    left += MADE[known:]


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: list[str], value: str, keys: list[str] = [], name: str = "before") -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before this one, by ``order`` within ``keys``.

    Rows are dealt by range of ``order`` into blocks and written once. The sums of the
    blocks are scanned (one row a block and key), and each block is scanned on its own,
    so no key, however large, is brought to one task. ``keys`` must not be null. The
    block count follows ``spark.sql.shuffle.partitions``.
    """
    ranged = stage(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_block", F.spark_partition_id()), "ranged", narrow=True)
    on = ["_block", *keys]
    blocks = ranged.groupBy(*on).agg(F.sum(value).alias("_sum"))
    upto = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*on, F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(blocks, on)
        .withColumn(name, (F.col("_base") + F.col("_in")).cast("long"))
        .drop("_block", "_base", "_in")
    )


def dealt_anew(sums: DataFrame, key: str) -> DataFrame:
    """Sums by a long ``key``, for a join on it which adaptive execution can split where the key is hot.

    It splits a join of two exchanges, but not one that also sums in its stage. Through an expression the planner
    doesn't see that the sums lie by their key already, and deals those few rows once more.
    """
    return sums.withColumn(key, F.bitwise_not(F.bitwise_not(F.col(key))))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components: (node, component), component the smallest node reachable.

    ``edges`` has long columns ``a`` and ``b``. Alternates the large-star and small-star
    steps until nothing changes. Neighbourhoods are never gathered: each step takes a
    minimum per node (which Spark sums before it shuffles) and joins it back, dealt anew
    (``dealt_anew``), so that adaptive execution splits the join on a hot node. Every round is written to the
    shared folder.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", narrow=True)
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = dealt_anew(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "a")
        # large star: the larger neighbours of a node go to the least of its neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = dealt_anew(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
        after = stage(small.where("a <> b").distinct(), "edges", narrow=True)
        drop(now)
        now = after
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def plausible(members: DataFrame, sketches: DataFrame, near: int, rounds: int = 2) -> DataFrame:
    """Links (a, b) such that any two members of one key whose sketches are ``near`` bits apart, or less, are connected.

    ``members`` has long columns key and node, ``sketches`` node and an array of longs. The members of a key are
    compared with its least one, its leader: those within ``near`` join it and are done, those within twice that are linked
    with it, and the others go on without it. Of two that are near each other, one joins a leader
    and the other is then within twice ``near`` of that, so no pair is lost; nor does a key link what has little in
    common. Work is linear in the rows, and a hot key is one minimum and one join. What is still left
    after ``rounds`` is linked with its leader unseen, so that rounds are bounded; such links are more than needed, never fewer.
    """
    other = sketches.select(F.col("node").alias("first"), F.col("sketch").alias("of"))
    apart = F.aggregate(F.zip_with("sketch", "of", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    left, found, made = members, None, []
    for k in range(rounds + 1):
        firsts = dealt_anew(left.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"), "key")
        pairs = stage(left.join(firsts, "key").where("node <> first").select("key", "node", "first"), "pairs", narrow=True)
        made.append(pairs)
        links = pairs.select("node", "first")
        if k < rounds:
            judged = stage(links.distinct().join(sketches, "node").join(other, "first").select("node", "first", apart.alias("apart")), "judged", narrow=True)
            made.append(judged)
            links = judged.where(F.col("apart") <= 2 * near).select("node", "first")
        found = links if found is None else found.unionByName(links)
        if k == rounds or judged.where(F.col("apart") > near).isEmpty():
            break
        left = pairs.join(judged.where(F.col("apart") > near).select("node", "first"), ["node", "first"]).select("key", "node")
    out = stage(found.select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), "plausible", narrow=True)
    drop(*made)
    return out


def block_pairs(df: DataFrame, key: str, weight: str, row: str, most_rows: int = 1024, most_weight: int = 1 << 21) -> DataFrame:
    """Deal the rows of each group so that every pair of a group meets in one bounded task.

    Groups of one row go. A group is cut by a hash of ``row`` into as many blocks as its
    rows and weight ask for; a row goes once for each block, as ``(_i, _j)`` with its own
    block as either. A group of one block is dealt once. Adds ``_block``, ``_i``, ``_j``.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_n"), F.sum(weight).alias("_w")).where("_n > 1")
    blocks = F.greatest(F.ceil(F.col("_n") / most_rows), F.ceil(F.col("_w") / most_weight)).cast("int")
    dealt = df.join(dealt_anew(sizes.select(key, blocks.alias("_blocks")), key), key)
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64(row), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")}).drop("_other", "_blocks")


def lean(fn: Callable) -> Callable:
    """``fn`` of mapInArrow, which at its end gives back the memory that it has freed.

    A worker waits for its next task with what its allocators keep, some 170 MB after a task of long texts,
    and an executor's workers count with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc
        ctypes.CDLL(None).malloc_trim(0)


def map_groups(df: DataFrame, keys: list[str], fn, schema: str, order: list[str] = []) -> DataFrame:
    """Apply ``fn(table) -> table or None`` to the rows of each key, streamed over sorted partitions.

    Unlike a grouped map this costs nothing for the many groups of one or two rows; a
    task holds one group and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            ends = np.concatenate([boundaries(table, keys), [table.num_rows]])
            first = table.slice(0, 1)
            if held and any(held[-1][k][-1].as_py() != first[k][0].as_py() for k in keys):
                yield from out(held)
                held = []
            for start, end in zip(ends[:-1], ends[1:]):
                held.append(table.slice(start, end - start))
                if end < table.num_rows:
                    yield from out(held)
                    held = []
        if held:
            yield from out(held)

    def out(held):
        found = fn(pa.concat_tables(held).combine_chunks())
        if found is not None:
            yield from found.to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(lean(run), schema)


def map_tables(df: DataFrame, keys: list[str], fn, schema: str, order: list[str] = []) -> DataFrame:
    """Apply ``fn(table) -> table`` to rows that are sorted by ``keys``, many keys at a time and each of them whole.

    For what is worked out for all groups of a batch at once. A task holds one batch and one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            last = int(boundaries(table, keys)[-1])
            same = last == 0 and held and all(held[-1][k][-1].as_py() == table[k][0].as_py() for k in keys)
            if held and not same:
                yield from out([*held, table.slice(0, last)])
                held = []
            elif not held and last:
                yield from out([table.slice(0, last)])
            held.append(table.slice(last))
        if held:
            yield from out(held)

    def out(held):
        found = fn(pa.concat_tables(held).combine_chunks())
        if found is not None and found.num_rows:
            yield from found.to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(lean(run), schema)


def boundaries(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key begins, the first included; keys are not null."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = table[k].combine_chunks().to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def crc_mod4(column) -> F.Column:
    """crc32 of an id as text, modulo 4: the fold that is held out when it is 2."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % 4
