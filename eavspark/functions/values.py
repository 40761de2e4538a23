"""Value types, and how each lies in a column.

A variable's column has one type, known when the query is compiled. Where branches of a
query disagree it has the type ``any``: a struct of a tag and one filled member. All
times are timestamps without zone, in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the value types, with the column type of each. ``ref`` is kept as ``long``.
SPARK = {
    "bigint": T.DecimalType(38, 0),
    "boolean": T.BooleanType(),
    "bytes": T.BinaryType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "instant": T.TimestampNTZType(),
    "keyword": T.StringType(),
    "long": T.LongType(),
    "string": T.StringType(),
    "uuid": T.StringType(),
    "vector": T.StringType(),
    "map": T.StringType(),
}
#: The member of ``any`` that each type is kept in. Strings of different types differ by tag.
MEMBER = {
    "bigint": "n", "boolean": "b", "bytes": "x", "double": "d", "float": "f", "instant": "t",
    "keyword": "s", "long": "l", "string": "s", "uuid": "s", "vector": "s", "map": "s",
}
MEMBERS = {m: SPARK[t] for t, m in MEMBER.items()}
ANY = T.StructType([T.StructField("tag", T.StringType()), *[T.StructField(m, t) for m, t in MEMBERS.items()]])
NUMERIC = ("long", "bigint", "double", "float")
#: Types that have an order besides numbers.
ORDERED = ("string", "boolean", "instant")


def spark_type(kind: str) -> T.DataType:
    return ANY if kind == "any" else SPARK.get(kind, T.StringType())


def literal(kind: str, value) -> Column:
    if kind == "instant":
        return F.lit(value).cast("timestamp_ntz") if value is None else F.lit(value.isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")
    if kind == "bigint":
        return F.lit(str(value)).cast(SPARK[kind])
    return F.lit(value).cast(spark_type(kind))


def to_any(value: Column, kind: str) -> Column:
    """The tagged form of a typed column; null stays null."""
    if kind == "any":
        return value
    members = [(value if m == MEMBER[kind] else F.lit(None)).cast(t).alias(m) for m, t in MEMBERS.items()]
    return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("tag"), *members)).otherwise(F.lit(None).cast(ANY))


def of_any(value: Column, kind: str) -> Column:
    """The typed member of a tagged column where it is of that type, else null."""
    return F.when(value["tag"] == kind, value[MEMBER[kind]])


def common(kinds) -> str:
    found = set(kinds)
    return found.pop() if len(found) == 1 else "any"


def type_of(value) -> str:
    """The value type of a Python value."""
    import uuid
    from datetime import datetime

    from eavspark.edn import BigInt, Keyword

    match value:
        case bool():
            return "boolean"
        case BigInt():
            return "bigint"
        case int():
            return "long" if -(1 << 63) <= value < 1 << 63 else "bigint"
        case float():
            return "double"
        case str():
            return "string"
        case Keyword():
            return "keyword"
        case datetime():
            return "instant"
        case uuid.UUID():
            return "uuid"
        case bytes() | bytearray():
            return "bytes"
        case list() | tuple():
            return "vector"
        case dict():
            return "map"
    raise ValueError(f"{type(value).__name__} is not a value")


def plain(kind: str, value):
    """A Python value as it goes into a column of its type."""
    from datetime import UTC

    from eavspark.edn import write

    if kind in ("keyword", "uuid"):
        return str(value)
    if kind in ("vector", "map"):
        return write(value)
    if kind == "instant" and value.tzinfo:
        return value.astimezone(UTC).replace(tzinfo=None)
    return int(value) if kind == "bigint" else value
