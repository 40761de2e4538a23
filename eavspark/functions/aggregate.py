"""Aggregates over a variable's column: (expression, type of the result)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eavspark.functions.values import NUMERIC, ORDERED, of_any, spark_type

EMPTY = {"avg": "avg: no values accumulated", "min": "min: no values accumulated", "max": "max: no values accumulated"}


def failing(why: Column | str, kind: str) -> Column:
    return F.raise_error(F.lit(why) if isinstance(why, str) else why).cast(spark_type(kind))


def aggregate(name: str, value: Column, kind: str) -> tuple[Column, str]:
    """count and count-distinct count; sum of nothing is 0; avg, min and max of nothing fail.

    A sum of longs stays long and fails when it overflows; every other sum is double.
    ``min`` and ``max`` need values of one order; NaN has none.
    """
    if name == "count":
        return F.count(F.lit(1)), "long"
    if name == "count-distinct":
        return F.count_distinct(value), "long"
    if kind == "any":
        return _mixed(name, value)
    if name == "sum":
        if kind not in NUMERIC:
            why = F.concat(F.lit(f"sum: cannot aggregate non-numeric value of type {kind}, "), F.count(F.lit(1)).cast("string"), F.lit(" of them"))
            return F.when(F.count(F.lit(1)) == 0, F.lit(0).cast("long")).otherwise(failing(why, "long")), "long"
        if kind == "long":
            return F.coalesce(F.sum(value), F.lit(0)).cast("long"), "long"
        return F.coalesce(F.sum(value.cast("double")), F.lit(0.0)), "double"
    if name == "avg":
        if kind not in NUMERIC:
            return failing(f"avg: cannot aggregate values of type {kind}", "double"), "double"
        return F.coalesce(F.avg(value.cast("double")), failing(EMPTY[name], "double")), "double"
    pick = F.min if name == "min" else F.max
    if kind in NUMERIC + ORDERED:
        out = F.coalesce(pick(value), failing(EMPTY[name], kind))
        if kind in ("double", "float"):
            unordered = F.sum(F.isnan(value).cast("long")) > 0
            out = F.when(unordered & (F.count(value) > 1), failing(f"{name}: NaN has no order", kind)).otherwise(out)
        return out, kind
    # a value without an order passes as long as it is the only one
    single = F.when(F.count(value) == 1, F.first(value)).when(F.count(value) == 0, failing(EMPTY[name], kind))
    return single.otherwise(failing(f"{name}: values of type {kind} have no order", kind)), kind


def _mixed(name: str, value: Column) -> tuple[Column, str]:
    number = F.coalesce(*[of_any(value, k).cast("double") for k in NUMERIC])
    other = F.count(value) > F.count(number)
    if name in ("sum", "avg"):
        total = F.coalesce(F.sum(number), F.lit(0.0)) if name == "sum" else F.coalesce(F.avg(number), failing(EMPTY[name], "double"))
        return F.when(other, failing(f"{name}: cannot aggregate non-numeric value", "double")).otherwise(total), "double"
    pick = F.min_by if name == "min" else F.max_by
    kinds = F.count_distinct(value["tag"])
    one = F.when(F.first(value["tag"]).isin(*NUMERIC), pick(value, number))
    for k in ORDERED:
        one = one.when(F.first(value["tag"]) == k, pick(value, of_any(value, k)))
    mixed = F.when(other, failing(f"{name}: values of different types have no order", "any")).otherwise(pick(value, number))
    return F.when(F.count(value) == 0, failing(EMPTY[name], "any")).when(kinds == 1, one).otherwise(mixed), "any"
