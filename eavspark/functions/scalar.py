"""Scalar functions as Spark expressions. A null is "no value": what it reaches drops the row.

Typing happens here, before Spark sees an expression: Spark would coerce or raise where
the language says "no value" or false.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from eavspark.functions.values import MEMBER, NUMERIC, ORDERED, common, literal, of_any, to_any
from eavspark.plans import ast as q

COMPARE = ("<", "<=", ">", ">=")
ARITHMETIC = ("+", "-", "*", "/", "quot", "mod")
BINARY = (*COMPARE, *ARITHMETIC, "=", "not=", "!=", "concat")
UNARY = ("not", "abs", "upper", "lower", "strlen", "str", "year", "month")
LONGEST, LEAST = (1 << 63) - 1, -(1 << 63)
#: What the pattern dialect lacks: look-around, back-references, possessive and atomic groups.
ABSENT = re.compile(r"\(\?[=!>]|\(\?<[=!]|(?<!\\)\\[1-9]|[*+?}]\+")

#: A typed column.
Typed = tuple[Column, str]
NOTHING: Typed = (F.lit, "none")


def check_call(e) -> None:
    """Raise for a function that doesn't exist, or not with so many arguments."""
    from eavspark.plans.validate import QueryError

    if not isinstance(e, q.Call):
        return
    n = len(e.args)
    if e.name == "regexp_like":
        if n != 2:
            raise QueryError(f"regexp_like expects 2 args (subject, pattern), got {n}")
        check_call(e.args[0])
        if not (isinstance(e.args[1], q.Const) and e.args[1].type == "string"):
            raise QueryError("regexp_like requires a string literal as second argument (pattern)")
        pattern = e.args[1].value
        try:
            re.compile(pattern)
            if SparkContext._jvm is not None:  # the dialect that runs it
                SparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        except (re.error, Py4JJavaError, PySparkException) as why:
            raise QueryError(f"invalid regex pattern for regexp_like `{pattern}`: {str(why).splitlines()[0]}") from why
        if ABSENT.search(pattern):
            raise QueryError(f"invalid regex pattern for regexp_like `{pattern}`: look-around and back-references are not supported")
        return
    if e.name == "if" and n != 3:
        raise QueryError(f"'if' expects 3 args (condition, then, else), got {n}")
    if not (e.name == "if" or n == 2 and e.name in BINARY or n == 1 and e.name in UNARY):
        raise QueryError(f"Unsupported function '{e.name}' with {n} args")
    for a in e.args:
        check_call(a)


def null(kind: str = "boolean") -> Typed:
    from eavspark.functions.values import spark_type

    return F.lit(None).cast(spark_type(kind)), kind


def compile_expr(e, column: Callable[[q.Var], Typed]) -> Typed:
    """An expression's column and type, given those of its variables."""
    match e:
        case q.Var():
            return column(e)
        case q.Const():
            return literal(e.type, e.value), e.type
    if e.name == "regexp_like":
        return spread([compile_expr(e.args[0], column)], lambda a: (a[0].rlike(e.args[1].value), "boolean") if a[1] == "string" else null())
    args = [compile_expr(a, column) for a in e.args]
    if e.name == "if":
        (test, kind), (yes, a), (no, b) = args
        if kind == "any":
            test, kind = of_any(test, "boolean"), "boolean"
        test = F.coalesce(test, F.lit(False)) if kind == "boolean" else F.lit(False)
        to = common([a, b])
        return F.when(test, yes if to == a else to_any(yes, a)).otherwise(no if to == b else to_any(no, b)), to
    return spread(args, lambda *typed: FUNCTIONS[e.name](*typed))


def spread(args: list[Typed], f: Callable[..., Typed]) -> Typed:
    """Apply ``f`` to typed columns; a tagged one is taken apart by its tag, type by type."""
    for k, (value, kind) in enumerate(args):
        if kind != "any":
            continue
        found = []
        for t in MEMBER:
            out = spread([*args[:k], (of_any(value, t), t), *args[k + 1 :]], f)
            found.append((value["tag"] == t, out))
        to = common(kind for _, (_, kind) in found)
        total = None
        for test, (out, kind) in found:
            out = out if to == kind else to_any(out, kind)
            total = F.when(test, out) if total is None else total.when(test, out)
        return total, to
    return f(*args)


def both(a: Typed, b: Typed, value: Column) -> Column:
    """``value`` where both have one."""
    return F.when(a[0].isNotNull() & b[0].isNotNull(), value)


def equal(a: Typed, b: Typed) -> Typed:
    if a[1] != b[1]:
        return both(a, b, F.lit(False)), "boolean"
    out = a[0] == b[0]
    if a[1] in ("double", "float"):
        out = out & ~F.isnan(a[0])  # Spark has NaN equal to itself
    return out, "boolean"


def unequal(a: Typed, b: Typed) -> Typed:
    return ~equal(a, b)[0], "boolean"


def comparable(a: Typed, b: Typed) -> tuple[Column, Column] | None:
    """Both in the type that they are compared in: the wider float, else the wider integer."""
    kinds = {a[1], b[1]}
    if len(kinds) == 1:
        return (a[0], b[0]) if a[1] in NUMERIC + ORDERED else None
    if not kinds <= set(NUMERIC):
        return None
    to = "double" if "double" in kinds else "float" if "float" in kinds else "decimal(38,0)"
    return a[0].cast(to), b[0].cast(to)


def compare(name: str) -> Callable[[Typed, Typed], Typed]:
    def f(a: Typed, b: Typed) -> Typed:
        pair = comparable(a, b)
        if pair is None:
            return null()
        x, y = pair
        out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[name]
        for side, (_, kind) in ((x, a), (y, b)):
            if kind in ("double", "float"):
                out = F.when(~F.isnan(side), out)
        return out, "boolean"

    return f


def arithmetic(name: str) -> Callable[[Typed, Typed], Typed]:
    def f(a: Typed, b: Typed) -> Typed:
        x, y = a[0], b[0]
        if (a[1], b[1]) == ("long", "long"):
            if name in ("+", "-", "*"):
                return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[name](x, y), "long"
            bad = (y == 0) | (x == LEAST) & (y == -1)
            safe = F.when(~bad, y)
            return (F.try_mod(x, safe) if name == "mod" else F.call_function("div", x, safe)).cast("long"), "long"
        if not {a[1], b[1]} <= {"long", "double"}:
            return null("double")
        x, y = x.cast("double"), y.cast("double")
        if name in ("+", "-", "*"):
            return {"+": x + y, "-": x - y, "*": x * y}[name], "double"
        safe = F.when(y != 0, y)
        return (F.try_mod(x, safe) if name == "mod" else F.try_divide(x, safe)), "double"

    return f


def concat(a: Typed, b: Typed) -> Typed:
    return (F.concat(a[0], b[0]), "string") if a[1] == b[1] == "string" else null("string")


def of(kinds: dict[str, tuple[Callable[[Column], Column], str]], otherwise: str) -> Callable[[Typed], Typed]:
    """A function of one argument, by its type; no value for other types."""

    def f(a: Typed) -> Typed:
        if a[1] not in kinds:
            return null(otherwise)
        g, kind = kinds[a[1]]
        return g(a[0]), kind

    return f


def plain_number(x: Column) -> Column:
    """A double in full, without exponent, and without a fraction if it has none."""
    text = x.cast("string")
    # 1.234E-5 and 1.0E21: the digits move by the exponent
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), r"\.", "")
    digits = F.regexp_replace(digits, r"(?<=[0-9])0$", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    n = F.length(digits)
    large = F.when(n <= power + 1, F.concat(sign, digits, F.repeat(F.lit("0"), power + 1 - n))).otherwise(
        F.concat(sign, F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n))
    )
    known = F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(known, F.when(text.contains("E"), F.when(power < 0, small).otherwise(large)).otherwise(F.regexp_replace(text, r"\.0$", "")))


def as_text(a: Typed) -> Typed:
    if a[1] in ("double", "float"):
        return plain_number(a[0]), "string"
    if a[1] == "bytes":
        return F.hex(a[0]), "string"
    return a[0].cast("string"), "string"


FUNCTIONS: dict[str, Callable[..., Typed]] = {
    "=": equal,
    "not=": unequal,
    "!=": unequal,
    "concat": concat,
    "str": as_text,
    "not": of({"boolean": (lambda x: ~x, "boolean")}, "boolean"),
    "abs": of({"long": (lambda x: F.when(x != LEAST, F.abs(F.when(x != LEAST, x))), "long"), "double": (F.abs, "double")}, "long"),
    "upper": of({"string": (F.upper, "string")}, "string"),
    "lower": of({"string": (F.lower, "string")}, "string"),
    "strlen": of({"string": (lambda x: F.octet_length(x).cast("long"), "long")}, "long"),
    "year": of({"instant": (lambda x: F.year(x).cast("long"), "long")}, "long"),
    "month": of({"instant": (lambda x: F.month(x).cast("long"), "long")}, "long"),
} | {name: compare(name) for name in COMPARE} | {name: arithmetic(name) for name in ARITHMETIC}
