"""Stored facts: a Parquet file for each transaction, merged from time to time into sorted ones for each attribute.

Only files that the log names count. A row is (e, v_*, tx, added): exactly one v_* is filled, that of the attribute's type.
A fact is live at a basis if the latest row of its (e, v) up to there is an addition; of
an addition and a retraction in one transaction the addition counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eavspark.functions.values import MEMBER, MEMBERS
from eavspark.sources.base import Attribute, FactSource
from eavspark.sources.schema import TX_PART, Schema, entity_id

COLUMNS = T.StructType(
    [
        T.StructField("e", T.LongType()), *[T.StructField(f"v_{m}", t) for m, t in MEMBERS.items()],
        T.StructField("tx", T.LongType()), T.StructField("added", T.BooleanType()), T.StructField("a", T.LongType()),
    ]
)


class DatomSource(FactSource):
    """``files(attribute id)`` names what holds an attribute's rows; ``schema`` is that of the newest transaction, for every basis.

    ``recent`` has the rows of a store in memory.
    ``retracted`` has the attributes of which any fact was ever retracted, ``touched`` for each transaction that is known the attributes that it has rows of.
    """

    def __init__(
        self, spark: SparkSession, schema: Schema, files: Callable[[int], list[str]] | None = None, recent: list | None = None, retracted: set[int] | None = None, touched: dict[int, set[int]] | None = None
    ):
        self.spark, self.schema, self.files, self.retracted, self.touched = spark, schema, files, retracted, touched or {}
        self.recent = recent if recent is not None else []
        self.known: dict[int, DataFrame] = {}

    def attribute(self, ident):
        return self.schema.attribute(ident)

    def attributes(self):
        return list(self.schema.by_id.values())

    def ident(self, name):
        return self.schema.idents.get(name)

    def unchanged(self, attribute: Attribute, before: int, after: int) -> bool:
        """Whether no transaction between two bases has rows of an attribute; those that are not known may."""
        return all(attribute.id not in self.touched.get(tx, (attribute.id,)) for tx in range(before + 1, after + 1))

    def rows(self, attribute: Attribute) -> DataFrame:
        """All rows of an attribute, in files or in memory: one DataFrame for all scans, so that files are listed and rows in memory handed to Spark once."""
        if attribute.id not in self.known:
            paths = self.files(attribute.id) if self.files else []
            all_ = self.spark.read.schema(COLUMNS).parquet(*paths) if paths else frame(self.spark, [r for r in self.recent if r[-1] == attribute.id])
            self.known[attribute.id] = (all_.where(F.col("a") == attribute.id) if paths else all_).drop("a")
        return self.known[attribute.id]

    def scan(self, attribute, basis=None, with_tx=False):
        v = F.col(f"v_{MEMBER[attribute.kind]}")
        rows = self.rows(attribute).select("e", v.alias("v"), "tx", "added")
        if basis is not None:
            rows = rows.where(F.col("tx") <= basis)
        if not attribute.many and self.retracted is not None and attribute.id not in self.retracted:
            # single values that were never replaced: each row is a fact, and no versions need to meet
            return rows.select("e", "v", *([transaction(F.col("tx"))] if with_tx else []))
        latest = rows.groupBy("e", "v").agg(F.max(F.struct("tx", "added")).alias("last")).where("last.added")
        return latest.select("e", "v", *([transaction(F.col("last.tx"))] if with_tx else []))


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of COLUMNS as a DataFrame, by way of Arrow: no Python worker reads them."""
    schema = to_arrow_schema(COLUMNS)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema), COLUMNS)


def transaction(number: Column) -> Column:
    """The entity of a transaction, which has facts of its own."""
    return (F.lit(entity_id(TX_PART, 0)) + number).alias("tx")


def row(e: int, attribute: Attribute, value, tx: int, added: bool) -> tuple:
    """A row of the table, in the order of ``COLUMNS``."""
    from decimal import Decimal

    from eavspark.functions.values import plain

    value = plain(attribute.kind, value)
    value = Decimal(value) if attribute.kind == "bigint" else value
    return (e, *[value if m == MEMBER[attribute.kind] else None for m in MEMBERS], tx, added, attribute.id)


class Log:
    """The transactions in order, as a JSON line in a file each, named by number.

    A file appears whole under its final name, and only if no other has that name: so of two
    writers one gets the number. What a writer leaves that stops before is hidden and unique, and in
    nobody's way. Without a path the log is in memory. ``parts`` has files of the same kind, which say what
    transactions were merged into, and the state after them, so that opening a store doesn't read the whole log.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path
        self.held: list[dict] = []
        if path:
            self.fs = self._at("log").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _load(self, at) -> dict | None:
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, number: int) -> dict | None:
        """The record of a transaction, if it is there yet."""
        if not self.path:
            return self.held[number] if number < len(self.held) else None
        return self._load(self._at(f"log/{number:020d}.json"))

    def append(self, record: dict) -> bool:
        """Whether the record's number was free, and so is now its own."""
        if not self.path:
            self.held.append(record)
            return True
        return self._put(f"log/{record['tx_id']:020d}.json", record)

    def _put(self, name: str, record: dict) -> bool:
        jvm, final = self.spark._jvm, self._at(name)
        hidden = self._at(f"{name.rpartition('/')[0]}/_{uuid.uuid4().hex}")
        if self.fs.exists(final):
            return False
        out = self.fs.create(hidden, False)
        out.write(bytearray((json.dumps(record) + "\n").encode()))
        out.close()
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(hidden, final, how)
        except Py4JJavaError as e:
            self.fs.delete(hidden, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def put_parts(self, record: dict) -> bool:
        return self._put(f"parts/{record['upto']:020d}.json", record)

    def parts(self) -> dict | None:
        """The newest record of merged transactions."""
        at = self._at("parts") if self.path else None
        if at is None or not self.fs.exists(at):
            return None
        names = [f.getPath().getName() for f in self.fs.listStatus(at)]
        names = sorted(n for n in names if n.endswith(".json") and n[0] not in "._")
        return self._load(self._at(f"parts/{names[-1]}")) if names else None
