"""What a transaction changes in a query's result, from what it changes in the facts.

Any past basis can be queried, so no operator keeps state: each rule is made of the
relation before, the relation after and its change, a relation with a weight ``_w`` of
+1 or -1 a row.

    join   change(A * B) = change(A) * B after  +  A before * change(B)
    filter, function: of the change alone; so are not and or of filters
    not    of the keys that changed, or whose match did: rows after less rows before
    or     of the rows that changed in a branch: presence after less presence before

Every rule starts from the few rows that changed, so Spark joins them to the facts as
the small side.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eavspark.functions.values import MEMBER
from eavspark.operators.relation import Relation, col
from eavspark.plans import ast as q
from eavspark.plans.compile import Compiler, OneOf, Star, column_names
from eavspark.plans.validate import QueryError, every_clause, mentioned_vars, validate
from eavspark.sources.base import Attribute, FactSource
from eavspark.sources.datoms import DatomSource


def check(query: q.Query) -> None:
    """Raise for what can't be kept up with changes."""
    if query.shape != "relation":
        raise QueryError("Only relational :find is supported for incremental queries")
    for what, there in ((":with", query.with_vars), (":in", query.bindings), (":limit", query.limit), (":order", query.order)):
        if there:
            raise QueryError(f"{what} is not supported for incremental queries")
    if not all(isinstance(e, q.Var) for e in query.find):
        raise QueryError("Aggregates are not supported for incremental queries")
    validate(query, [])


class Changes(FactSource):
    """The facts of a source that came (+1) or went (-1) between two bases."""

    def __init__(self, source: DatomSource, before: int, after: int):
        self.source, self.before, self.after = source, before, after

    def attribute(self, ident):
        return self.source.attribute(ident)

    def scan(self, attribute: Attribute, basis=None, with_tx=False) -> DataFrame:
        v = F.col(f"v_{MEMBER[attribute.kind]}").alias("v")
        rows = self.source.rows(attribute).select("e", v, "tx", "added").where(F.col("tx") <= self.after)
        touched = rows.where(F.col("tx") > self.before).select("e", "v").distinct()
        state = F.struct("tx", "added")
        of = rows.join(touched, ["e", "v"], "left_semi").groupBy("e", "v").agg(F.max(state).alias("new"), F.max(F.when(F.col("tx") <= self.before, state)).alias("old"))
        weight = F.col("new.added").cast("long") - F.coalesce(F.col("old.added"), F.lit(False)).cast("long")
        return of.select("e", "v", weight.alias("_w")).where("_w <> 0")


@dataclass
class Change:
    """A relation before and after, and how it changed. Before and after are made when they are asked for."""

    before: Callable[[], Relation | None]
    after: Callable[[], Relation | None]
    delta: Relation | None  # None: unchanged


def weighted(rel: Relation, weight: int) -> Relation:
    return Relation(rel.df.withColumn("_w", F.lit(weight).cast("long")), rel.types)


def consolidated(rel: Relation) -> Relation:
    """One row for equal ones, with their weights summed; those of 0 go."""
    df = rel.df.groupBy(*map(col, rel.vars)).agg(F.sum("_w").alias("_w")).where("_w <> 0")
    return Relation(df, rel.types)


class DeltaCompiler:
    def __init__(self, spark: SparkSession, source: DatomSource, before: int, after: int):
        self.spark, self.source = spark, source
        self.old, self.new = Compiler(spark, source, before), Compiler(spark, source, after)
        self.changes = Compiler(spark, Changes(source, before, after), None)

    def scope(self, clauses, start: Change | None) -> Change:
        """The change of all clauses together, in the order in which a query takes them."""
        todo = self.new.stars([self.new.merged(c) for c in clauses])
        have = set((start.after() or Relation.unit(self.spark)).types) if start else set()
        state = start
        while todo:
            ready = [c for c in todo if set(self.new.needs(c)) <= have]
            if not ready:
                raise QueryError("Query has clauses whose variables nothing binds")
            best = max(ready, key=lambda c: (isinstance(c, q.Predicate | q.Function | q.Not), len(have & set(self.new.gives(c))), -todo.index(c)))
            todo.remove(best)
            state = self.step(best, state)
            have |= set(self.new.gives(best))
        return state

    def step(self, c, a: Change | None) -> Change:
        old = functools.cache(lambda: self.old.apply(c, a.before() if a else None))
        new = functools.cache(lambda: self.new.apply(c, a.after() if a else None))
        if a is not None and a.delta is not None and isinstance(c, q.Not | q.Or) and (test := self.test(c, a.delta)) is not None:
            return Change(old, new, a.delta.where(test))
        match c:
            case q.Predicate() | q.Function():
                return Change(old, new, a.delta and self.new.apply(c, a.delta))
            case q.Not():
                return Change(old, new, self.without(c, a, old, new))
            case Star():
                same = all(self.source.unchanged(x, self.old.basis, self.new.basis) for x in c.attributes)
                b = Change(lambda: self.old.scan(c), lambda: self.new.scan(c), None if same else self.changes.scan(c))
            case q.Or():
                b = self.union(c, a)
            case _:
                raise QueryError(f"{type(c).__name__} is not supported for incremental queries")
        if a is None:
            return Change(old, new, b.delta)
        parts = []
        if a.delta is not None:
            parts.append(self.joined(a.delta, b.after()))
        if b.delta is not None:
            parts.append(self.joined(a.before(), b.delta))
        return Change(old, new, self.sum(parts))

    def test(self, c, rel: Relation) -> Column | None:
        """Whether a row meets a clause of predicates alone; None if it has others, which need more than the row."""
        if isinstance(c, q.Predicate):
            return F.coalesce(self.new.holds(c, rel), F.lit(False))
        if isinstance(c, q.Not) and c.vars is None:
            tests = [self.test(x, rel) for x in c.clauses]
            return None if any(t is None for t in tests) else ~functools.reduce(operator.and_, tests)
        if isinstance(c, q.Or) and not isinstance(c, OneOf) and c.vars is None:
            tests = [self.test(x, rel) for b in c.branches for x in b]
            if any(t is None for t in tests):
                return None
            return functools.reduce(operator.or_, [functools.reduce(operator.and_, [self.test(x, rel) for x in b]) for b in c.branches])
        return None

    @staticmethod
    def joined(x: Relation, y: Relation) -> Relation:
        """A natural join of which one side has weights; columns in one order whichever it is."""
        return x.join(y)

    @classmethod
    def sum(cls, parts: list[Relation]) -> Relation | None:
        return consolidated(cls.together(parts)) if parts else None

    @staticmethod
    def together(parts: list[Relation]) -> Relation:
        out = parts[0]
        for p in parts[1:]:
            kinds = {v: "any" if out.types[v] != p.types[v] else t for v, t in out.types.items()}
            x, y = out.as_types(kinds), p.as_types(kinds)
            out = Relation(x.df.unionByName(y.df), kinds)
        return out

    def seed(self, a: Change | None, names) -> Change | None:
        """The distinct values of variables, and how the set of them changed."""
        if a is None:
            return None
        of = lambda f: lambda: self.new.seed(f(), names)
        if of(a.after)() is None:
            return None
        delta = None
        if a.delta is not None:
            shared = [v for v in names if v in a.delta.types]
            touched = Relation(a.delta.df.select(*map(col, shared)).distinct(), {v: a.delta.types[v] for v in shared})
            delta = self.presence(touched, of(a.before)(), of(a.after)())
        return Change(of(a.before), of(a.after), delta)

    def presence(self, touched: Relation, before: Relation, after: Relation) -> Relation:
        """+1 for the touched rows that came to be, -1 for those that ceased."""
        return touched.weighted_by(after, 1).weighted_by(before, -1).where(F.col("_w") != 0)

    def union(self, c: q.Or, a: Change | None) -> Change:
        names = list(dict.fromkeys(mentioned_vars(c)))
        before = functools.cache(lambda: self.old.branches(c, None) if self.alone(c) else self._branches(self.old, c, a.before()))
        after = functools.cache(lambda: self.new.branches(c, None) if self.alone(c) else self._branches(self.new, c, a.after()))
        touched = None
        seed = functools.cache(lambda: self.seed(a, names))
        for b in c.branches:
            delta = self.scope(b, None if self.new.alone(b) else seed()).delta
            if delta is None:
                continue
            one = Relation(delta.df.select(*[col(v) for v in names if v in delta.types]), {v: delta.types[v] for v in names if v in delta.types})
            touched = one if touched is None else touched.union(one)
        delta = None if touched is None else self.presence(touched.distinct(), before(), after())
        return Change(before, after, delta)

    def alone(self, c: q.Or) -> bool:
        return isinstance(c, OneOf) or all(self.new.alone(b) for b in c.branches)

    @staticmethod
    def _branches(compiler: Compiler, c: q.Or, rel: Relation) -> Relation:
        """The rows of an ``or`` alone, its branches seeded from the rows around it."""
        names = list(dict.fromkeys(mentioned_vars(c)))
        found = None
        for b in c.branches:
            one = compiler.scope(b, None if compiler.alone(b) else compiler.seed(rel, names)).select(names)
            found = one if found is None else found.union(one)
        return found.distinct()

    def without(self, c: q.Not, a: Change, old, new) -> Relation | None:
        names = list(dict.fromkeys(mentioned_vars(c)))
        body = self.scope(c.clauses, None if self.new.alone(c.clauses) else self.seed(a, names))
        keys = []
        for d in (a.delta, body.delta):
            if d is not None:
                shared = [v for v in names if v in d.types]
                keys.append(Relation(d.df.select(*map(col, shared)), {v: d.types[v] for v in shared}))
        if not keys:
            return None
        touched = keys[0] if len(keys) == 1 else keys[0].union(keys[1])
        touched = touched.distinct()
        # the rows of touched keys come from the two relations restricted to them, which Spark reads as a join with the few
        return consolidated(self.together([weighted(new(), 1), weighted(old(), -1)]).semi(touched))


def attributes(query: q.Query, source: FactSource) -> set[int]:
    """Attributes whose facts a query's result depends on."""
    out = set()
    for c in every_clause(query.where):
        if isinstance(c, q.Pattern):
            found = source.attribute(c.attribute.value)
            if found is None:
                raise QueryError(f"Unknown attribute: {c.attribute.value}")
            out.add(found.id)
    return out


def delta(spark: SparkSession, source: DatomSource, query: q.Query, before: int, after: int) -> DataFrame | None:
    """Rows of :find that came or went between two bases, with their weights in ``_w``; None if nothing can have changed.

    Weights count rows of the bag that :find is.
    """
    change = DeltaCompiler(spark, source, before, after).scope(query.where, None).delta
    if change is None:
        return None
    names = column_names(query.find)
    df = change.df.select(*[col(v).alias(f"c{k}") for k, v in enumerate(query.find)], "_w").toDF(*names, "_w")
    return df.groupBy(*names).agg(F.sum("_w").alias("_w")).where("_w <> 0")
