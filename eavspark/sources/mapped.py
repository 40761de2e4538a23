"""Tables as facts: a row is an entity, a column an attribute ``:table/column``.

Nothing is loaded or copied: patterns on one entity become one scan of the columns that
they name, and constants become filters of that scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eavspark.sources.base import Attribute, FactSource

#: Files of a table without a key at most: their order is part of an entity id.
MOST_FILES = 1 << 20
#: Rows of a file at most, for the same reason.
FILE_BITS = 40


@dataclass
class Table:
    df: DataFrame
    key: str | None = None
    refs: tuple[str, ...] = ()
    kinds: dict[str, str] = field(default_factory=dict)


def kind_of(t: T.DataType) -> str | None:
    """The value type of a column type; None if it has none."""
    match t:
        case T.BooleanType():
            return "boolean"
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return "long"
        case T.FloatType():
            return "float"
        case T.DoubleType():
            return "double"
        case T.DecimalType():
            return "bigint" if t.scale == 0 else "double"
        case T.StringType():
            return "string"
        case T.BinaryType():
            return "bytes"
        case T.TimestampType() | T.TimestampNTZType() | T.DateType():
            return "instant"
        case T.ArrayType():
            return "vector"
        case T.MapType() | T.StructType():
            return "map"


def value(column: Column, t: T.DataType) -> Column:
    """A column as a value: integers widen, times lose their zone (UTC), compound ones become text."""
    match t:
        case T.ByteType() | T.ShortType() | T.IntegerType():
            return column.cast("long")
        case T.DecimalType():
            return column.cast("decimal(38,0)" if t.scale == 0 else "double")
        case T.TimestampType():
            return F.convert_timezone(F.current_timezone(), F.lit("UTC"), column.cast("timestamp_ntz"))
        case T.DateType():
            return column.cast("timestamp_ntz")
        case T.ArrayType() | T.MapType() | T.StructType():
            return F.to_json(column)
    return column


class MappedTables(FactSource):
    """Virtual facts of tables.

    ``key`` names a column that is unique and not null; its value is the entity id.
    Without one an entity is a row's place: its file, by name, and its number there.
    ``refs`` are columns that hold entity ids of other tables. Null cells are no facts.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.known: dict[str, tuple[Table, str, Attribute]] = {}

    def add(self, name: str, df: DataFrame, key: str | None = None, refs: tuple[str, ...] = ()) -> MappedTables:
        table = self.tables[name] = Table(df, key, refs)
        for f in df.schema.fields:
            kind = kind_of(f.dataType)
            if kind:
                ident = f":{name}/{f.name}"
                unique = "identity" if f.name == key else None
                self.known[ident] = (table, f.name, Attribute(ident, "ref" if f.name in refs else kind, False, unique))
        return self

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, keys: dict[str, str | None], refs: dict[str, tuple[str, ...]] = {}) -> MappedTables:
        out = cls(spark)
        for name, key in keys.items():
            out.add(name, spark.read.parquet(f"{folder}/{name}.parquet"), key, refs.get(name, ()))
        return out

    def attribute(self, ident):
        found = self.known.get(ident)
        return found and found[2]

    def attributes(self):
        return [a for _, _, a in self.known.values()]

    def group(self, attribute):
        return attribute.ident.partition("/")[0]

    def entity(self, table: Table) -> Column:
        if table.key:
            return F.col(f"`{table.key}`").cast("long")
        files = sorted(table.df.inputFiles())
        if len(files) > MOST_FILES:
            raise ValueError(f"a table of {len(files)} files needs a key")
        row = F.col("_metadata.row_index")
        if len(files) <= 1:
            return row
        place = F.array_position(F.array(*[F.lit(f) for f in files]), F.col("_metadata.file_path"))
        # a file under another spelling of its name must not take the ids of another
        known = F.when(place > 0, place - 1).otherwise(F.raise_error(F.concat(F.lit("a file that the table did not list: "), F.col("_metadata.file_path"))).cast("long"))
        return F.shiftleft(known.cast("long"), FILE_BITS) + row

    def star(self, attributes, basis=None):
        table = self.known[attributes[0].ident][0]
        types = {f.name: f.dataType for f in table.df.schema.fields}
        columns = [self.known[a.ident][1] for a in attributes]
        return table.df.select(self.entity(table).alias("e"), *[value(F.col(f"`{c}`"), types[c]).alias(f"v{k}") for k, c in enumerate(columns)])

    def scan(self, attribute, basis=None, with_tx=False):
        found = self.star([attribute]).withColumnRenamed("v0", "v").where("v IS NOT NULL AND e IS NOT NULL")
        return found.withColumn("tx", F.lit(0).cast("long")) if with_tx else found
