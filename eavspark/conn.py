"""Databases as values: a source of facts at a basis, and queries on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eavspark.plans import ast as q
from eavspark.plans.compile import Compiler
from eavspark.plans.parse import clause, parse, variable
from eavspark.sources.base import FactSource


class Database:
    """An unchanging view of a source; ``basis`` is the last transaction that it shows."""

    def __init__(self, spark: SparkSession, source: FactSource, basis: int | None = None):
        self.spark, self.source, self.basis = spark, source, basis

    def q(self, query: str | q.Query, *args, columns: list[str] | None = None, extensions: bool = False, rules: str | None = None) -> DataFrame:
        """Rows of a query: EDN text in the vector or map form, an argument for each :in binding.

        ``columns`` names the result's columns. ``extensions`` lets in what lies beyond the
        base language; ``rules``, EDN text of ``[[(name ?a ?b) clause ...] ...]``, asks for it.
        """
        query = parse(query) if isinstance(query, str) else query
        if rules:
            query.rules = parse_rules(rules)
        compiler = Compiler(self.spark, self.source, self.basis, extensions or bool(rules), query.rules)
        df = compiler.query(query, list(args))
        return df.toDF(*columns) if columns else df

    def value(self, query: str, *args):
        """The one value of ``:find ?x .``, the list of ``[?x ...]``, the first row of ``[?x ?y]`` (extension)."""
        parsed = parse(query)
        df = self.q(parsed, *args, extensions=True)
        if parsed.shape == "collection":
            return [r[0] for r in df.collect()]
        row = df.first()
        return row if row is None or parsed.shape == "tuple" else row[0]


def parse_rules(text: str) -> dict:
    from eavspark.edn import read

    rules: dict = {}
    for head, *body in read(text):
        rules.setdefault(head[0].name, []).append((tuple(variable(v) for v in head[1:]), tuple(clause(c) for c in body)))
    return rules
