"""From a query to one DataFrame.

Rewrites that Catalyst cannot make are made here, on the clauses: patterns on one entity
of one table become one scan; clauses are taken in an order that shares variables, so no
product arises that the query doesn't ask for; types are settled, so Spark neither
coerces nor raises; branches of an ``or`` that differ in a constant become one filter.
Everything else is left to Catalyst and adaptive execution.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eavspark.functions.aggregate import aggregate
from eavspark.functions.scalar import compile_expr, equal
from eavspark.functions.values import NUMERIC, ORDERED, common, literal, plain, spark_type, to_any, type_of
from eavspark.operators.relation import Relation, col
from eavspark.plans import ast as q
from eavspark.plans.validate import QueryError, binding_vars, bound_vars, expr_vars, mentioned_vars, validate
from eavspark.sources.base import Attribute, FactSource


@dataclass(frozen=True)
class Star:
    """Patterns on one entity whose values one scan gives."""

    patterns: tuple
    attributes: tuple

    @property
    def vars(self) -> list[q.Var]:
        return list(dict.fromkeys(v for p in self.patterns for v in bound_vars(p)))


class Compiler:
    def __init__(self, spark: SparkSession, source: FactSource, basis: int | None, extensions: bool = False, rules: dict | None = None):
        self.spark, self.source, self.basis, self.extensions = spark, source, basis, extensions
        self.rules = rules or {}
        #: Variables that :in gives one value to; they are constants of the query.
        self.given: dict[q.Var, q.Const] = {}
        self.fresh = itertools.count()

    # ---- scans

    def attribute(self, place) -> Attribute:
        found = self.source.attribute(place.value) if isinstance(place, q.Const) else None
        if found is None:
            raise QueryError(f"Unknown attribute: {getattr(place, 'value', place)}")
        return found

    def constant(self, place):
        return self.given.get(place, place) if isinstance(place, q.Var) else place

    def stars(self, clauses: list) -> list:
        """Clauses with patterns put together into stars, each where its first pattern was."""
        out: list = []
        place: dict = {}
        for c in clauses:
            if not isinstance(c, q.Pattern) or not isinstance(c.attribute, q.Const) or c.tx != q.BLANK:
                out.append(c)
                continue
            a = self.attribute(c.attribute)
            group = None if a.many or c.entity == q.BLANK else self.source.group(a)
            key = group and (group, c.entity)
            if key and key in place:
                old = out[place[key]]
                out[place[key]] = Star((*old.patterns, c), (*old.attributes, a))
            else:
                if key:
                    place[key] = len(out)
                out.append(Star((c,), (a,)))
        return out

    def scan(self, star: Star) -> Relation:
        """The facts that match: a column a variable, filters for constants, one row each."""
        unique = list(dict.fromkeys(star.attributes))
        if len(star.patterns) == 1 and self.source.group(unique[0]) is None:
            df = self.source.scan(unique[0], self.basis).withColumnRenamed("v", "v0")
        else:
            df = self.source.star(unique, self.basis).where(" AND ".join(f"v{k} IS NOT NULL" for k in range(len(unique))))
        columns: dict[q.Var, tuple] = {}
        blank = False
        tests = []

        def place(term, column, kind):
            nonlocal blank
            term = self.constant(term)
            if isinstance(term, q.Const):
                term = self.ident_value(term, kind)
                tests.append(column == literal(term.type, term.value) if term.type == kind else F.lit(False))
                if term.type in ("double", "float") and term.value != term.value:
                    tests[-1] = F.isnan(column) if term.type == kind else F.lit(False)
            elif term == q.BLANK:
                blank = True
            elif term in columns:
                other, kind_ = columns[term]
                tests.append(column == other if kind_ == kind else F.lit(False))
            else:
                columns[term] = (column, kind)

        place(star.patterns[0].entity, F.col("e"), "long")
        for p, a in zip(star.patterns, star.attributes):
            place(p.value, F.col(f"v{unique.index(a)}"), a.kind)
        for t in tests:
            df = df.where(t)
        df = df.select(*[c.alias(v.name) for v, (c, _) in columns.items()], *(["_w"] if "_w" in df.columns else []))
        out = Relation(df, {v: kind for v, (_, kind) in columns.items()})
        return out.distinct() if blank else out

    def ident_value(self, term: q.Const, kind: str) -> q.Const:
        """With extensions a keyword where an entity stands is the entity that it names."""
        if self.extensions and term.type == "keyword" and kind == "long":
            found = self.source.ident(term.value)
            return q.Const("long", found) if found is not None else term
        return term

    def wide_scan(self, p: q.Pattern) -> Relation:
        """A pattern with its transaction, or with a variable as its attribute (extensions)."""
        wanted = [self.attribute(p.attribute)] if isinstance(self.constant(p.attribute), q.Const) else self.source.attributes()
        out = None
        for a in wanted:
            found = self.source.scan(a, self.basis, with_tx=p.tx != q.BLANK).withColumnRenamed("v", "v0")
            terms = [(p.entity, F.col("e"), "long"), (p.value, F.col("v0"), a.kind)]
            if p.tx != q.BLANK:
                terms.append((p.tx, F.col("tx"), "long"))
            if isinstance(p.attribute, q.Var):
                terms.append((p.attribute, F.lit(a.ident), "keyword"))
            columns, kinds = [], {}
            for term, column, kind in terms:
                term = self.constant(term)
                if isinstance(term, q.Const):
                    found = found.where(column == literal(kind, term.value) if term.type == kind else F.lit(False))
                elif isinstance(term, q.Var):
                    columns.append(column.alias(term.name))
                    kinds[term] = kind
            one = Relation(found.select(*columns), kinds)
            out = one if out is None else out.union(one)
        return out.distinct()

    # ---- scopes

    def typed(self, rel: Relation):
        return lambda v: (literal(self.given[v].type, self.given[v].value), self.given[v].type) if v in self.given else rel.typed(v)

    def free(self, vars) -> list[q.Var]:
        return [v for v in vars if v not in self.given]

    def scope(self, clauses, incoming: Relation | None) -> Relation:
        """Rows of all clauses together, joined to ``incoming``."""
        todo, rel = self.stars([self.merged(c) for c in clauses]), incoming
        while todo:
            have = set(rel.types) if rel else set()
            ready = [c for c in todo if set(self.needs(c)) <= have]
            if not ready:
                raise QueryError("Query has clauses whose variables nothing binds: " + ", ".join(sorted({str(v) for c in todo for v in self.needs(c) if v not in have})))
            # what only filters or extends goes first, then what shares most; ties by the query's order
            best = max(ready, key=lambda c: (isinstance(c, q.Predicate | q.Function | q.Not | q.TypeOf), len(have & set(self.free(self.gives(c)))), -todo.index(c)))
            todo.remove(best)
            rel = self.apply(best, rel)
        return rel if rel is not None else Relation.unit(self.spark)

    def gives(self, c) -> list[q.Var]:
        return c.vars if isinstance(c, Star) else bound_vars(c)

    def needs(self, c) -> list[q.Var]:
        """Variables that must have values before a clause can be applied."""
        match c:
            case q.Predicate():
                return self.free(expr_vars(c.expr))
            case q.Function():
                return self.free(expr_vars(c.expr))
            case q.TypeOf() | q.Not():
                return self.free(mentioned_vars(c))
            case q.Or() if c.vars is None:
                own = set(bound_vars(c))
                return self.free(v for v in mentioned_vars(c) if v not in own)
        return []

    def apply(self, c, rel: Relation | None) -> Relation:
        match c:
            case Star():
                found = self.scan(c)
                return found if rel is None else rel.join(found) if found.types else rel.semi(found)
            case q.Pattern():
                found = self.wide_scan(c)
                return found if rel is None else rel.join(found)
            case q.Predicate():
                rel = rel or Relation.unit(self.spark)
                return rel.where(self.holds(c, rel))
            case q.Function():
                return self.function(c, rel or Relation.unit(self.spark))
            case q.TypeOf():
                kind = rel.types[c.var]
                return rel.where(col(c.var)["tag"] == c.type.name) if kind == "any" else rel.where(F.lit(kind == c.type.name.replace("ref", "long")))
            case q.Not():
                names = self.free(mentioned_vars(c))
                body = self.scope(c.clauses, None if self.alone(c.clauses) else self.seed(rel, names))
                return rel.anti(body.select([v for v in names if v in body.types]))
            case q.Or():
                return self.branches(c, rel)
            case q.Rule():
                found = self.rule(c)
                return found if rel is None else rel.join(found)
        raise QueryError(f"unsupported clause {c}")

    def holds(self, c: q.Predicate, rel: Relation) -> Column:
        """Whether a predicate is true of a row; null where it has no value."""
        value, kind = compile_expr(c.expr, self.typed(rel))
        return F.when(value["tag"] == "boolean", value["b"]) if kind == "any" else value if kind == "boolean" else F.lit(False)

    def function(self, c: q.Function, rel: Relation) -> Relation:
        value, kind = compile_expr(c.expr, self.typed(rel))
        out = c.binding.var
        if out in self.given or out in rel.types:
            other = self.typed(rel)(out)
            if "any" in (kind, other[1]) and kind != other[1]:
                return rel.where(to_any(value, kind) == to_any(*other))
            return rel.where(equal((value, kind), other)[0])
        return rel.extend(out, value, kind)

    def seed(self, rel: Relation | None, names) -> Relation | None:
        shared = [v for v in names if rel and v in rel.types]
        return rel.select(shared).distinct() if shared else None

    def alone(self, clauses) -> bool:
        """Whether clauses bind all that they name, and so can be evaluated by themselves."""
        bound = {v for c in clauses for v in bound_vars(c)}
        inner = all(self.alone(b) for c in clauses if isinstance(c, q.Or) for b in c.branches)
        return inner and all(set(self.free(mentioned_vars(c))) <= bound for c in clauses) and all(not isinstance(c, q.Not) or set(self.free(mentioned_vars(c))) <= bound for c in clauses)

    def merged(self, c):
        """An ``or`` of one pattern with several constants, as one pattern with a set of them."""
        if not isinstance(c, q.Or) or c.vars is not None or not all(len(b) == 1 and isinstance(b[0], q.Pattern) for b in c.branches):
            return c
        patterns = [b[0] for b in c.branches]
        first = patterns[0]
        same = all((p.entity, p.attribute, p.tx, p.source) == (first.entity, first.attribute, q.BLANK, None) and isinstance(p.value, q.Const) for p in patterns)
        if not same or not isinstance(first.entity, q.Var) or first.entity in self.given:
            return c
        return OneOf(first.entity, first.attribute, tuple(p.value for p in patterns))

    def branches(self, c: q.Or, rel: Relation | None) -> Relation:
        explicit = c.vars is not None
        names = self.free(mentioned_vars(c))
        if isinstance(c, OneOf):
            found = self.one_of(c)
        else:
            found = None
            for b in c.branches:
                one = self.scope(b, None if self.alone(b) or explicit else self.seed(rel, names))
                if explicit and (missing := [v for v in names if v not in one.types]):
                    raise QueryError(f"or-join branch doesn't bind {missing[0]}")
                one = one.select([v for v in names if v in one.types])
                found = one if found is None else found.union(one)
            found = found.distinct()
        if rel is None:
            return found
        return rel.semi(found) if set(found.types) <= set(rel.types) else rel.join(found)

    def one_of(self, c: OneOf) -> Relation:
        a = self.attribute(c.attribute)
        values = [literal(v.type, v.value) for v in map(lambda v: self.ident_value(v, a.kind), c.values) if v.type == a.kind]
        facts = self.source.scan(a, self.basis)
        facts = facts.where(F.col("v").isin(*values) if values else F.lit(False)).select(F.col("e").alias(c.entity.name))
        found = Relation(facts, {c.entity: "long"})
        return found.distinct() if a.many else found

    def rule(self, c: q.Rule, depth: int = 0) -> Relation:
        """Rows of a rule's arguments: rounds of its bodies until no new row comes (extension)."""
        return Fixpoint(self).rows(c)

    # ---- a whole query

    def inputs(self, query: q.Query, args: list) -> Relation | None:
        rel = None
        for b, arg in zip(query.bindings, args):
            match b:
                case q.Scalar():
                    kind = type_of(arg)
                    self.given[b.var] = q.Const(kind, plain(kind, arg))
                    continue
                case q.Coll():
                    rows = [(x,) for x in arg]
                case q.Tuple():
                    rows = [tuple(arg)]
                case q.Rel():
                    rows = [tuple(x) for x in arg]
            vars_ = [b.var] if isinstance(b, q.Coll) else list(b.vars)
            if any(len(r) != len(vars_) for r in rows):
                raise QueryError(f"Binding {b} expects rows of {len(vars_)} values")
            one = self.values(vars_, rows)
            rel = one if rel is None else rel.join(one)
        return rel

    def values(self, vars_: list, rows: list[tuple]) -> Relation:
        """Distinct rows of values as a relation; one column a variable, tagged if types differ."""
        kinds = [common([type_of(r[k]) for r in rows] or ["string"]) for k in range(len(vars_))]
        data = []
        for r in rows:
            data.append(tuple(self.cell(v, kind) for v, kind in zip(r, kinds)))
        from pyspark.sql import types as T

        schema = T.StructType([T.StructField(f"c{k}", spark_type(kind)) for k, kind in enumerate(kinds)])
        df = self.spark.createDataFrame(data, schema)
        kept = [(k, v) for k, v in enumerate(vars_) if isinstance(v, q.Var)]
        return Relation(df.select(*[F.col(f"c{k}").alias(v.name) for k, v in kept]).distinct(), {v: kinds[k] for k, v in kept})

    @staticmethod
    def cell(value, kind):
        from decimal import Decimal

        from eavspark.functions.values import MEMBER, MEMBERS

        own = type_of(value)
        value = plain(own, value)
        value = Decimal(value) if own == "bigint" else value
        return value if kind != "any" else (own, *[value if m == MEMBER[own] else None for m in MEMBERS])

    def query(self, query: q.Query, args: list) -> DataFrame:
        validate(query, args, self.extensions)
        rel = self.scope(query.where, self.inputs(query, args))
        for b in query.bindings:
            if isinstance(b, q.Scalar):
                kind = self.given[b.var].type
                rel = Relation(rel.df.withColumn(b.var.name, literal(kind, self.given[b.var].value)), rel.types | {b.var: kind})
        for b in query.bindings:
            for v in binding_vars(b):
                if v not in rel.types:
                    raise QueryError(f"{v} has no values")
        return self.find(query, rel, args)

    def find(self, query: q.Query, rel: Relation, args: list) -> DataFrame:
        names = column_names(query.find)
        if any(isinstance(e, q.Aggregate | q.The) for e in query.find):
            keys = list(dict.fromkeys(e for e in query.find if isinstance(e, q.Var)))
            made = []
            for e, name in zip(query.find, names):
                if isinstance(e, q.Aggregate):
                    made.append(aggregate(e.name, *rel.typed(e.args[0]))[0].alias(name))
                elif isinstance(e, q.The):
                    made.append(F.first(col(e.var)).alias(name))
            grouped = rel.df.groupBy(*map(col, keys)).agg(*made)
            df = grouped.select(*[(col(e) if isinstance(e, q.Var) else F.col(f"`{name}`")).alias(name) for e, name in zip(query.find, names)])
        else:
            df = rel.df.select(*[col(e.var if isinstance(e, q.Pull) else e).alias(f"c{k}") for k, e in enumerate(query.find)]).toDF(*names)
        for e, name in zip(query.find, names):
            if isinstance(e, q.Pull):
                df = self.pull(df, name, e)
        if query.order is not None:
            keys = []
            for v, up in query.order:
                kind, name = rel.types[v], names[query.find.index(v)]
                if kind not in NUMERIC + ORDERED:
                    raise QueryError(f"values of type {kind} have no order (ORDER BY {v})")
                key = F.col(f"`{name}`")
                if kind in ("double", "float"):
                    key = F.when(F.isnan(key), F.raise_error(F.lit("NaN has no order")).cast("double")).otherwise(key)
                keys.append(key.asc() if up else key.desc())
            df = df.orderBy(*keys)
        limit = args[query.bindings.index(q.Scalar(query.limit))] if isinstance(query.limit, q.Var) else query.limit
        return df if limit is None else df.limit(limit)

    def pull(self, df: DataFrame, name: str, e: q.Pull) -> DataFrame:
        """An entity's attributes as a struct: a value, or an array of a many-valued one (extension)."""
        fields = []
        for item, alias in e.attributes:
            wanted = self.source.attributes() if item == "*" else [self.attribute(q.Const("keyword", str(item)))]
            for a in wanted:
                held = f"_p{next(self.fresh)}"
                of = self.source.scan(a, self.basis).groupBy(F.col("e").alias(held + "e")).agg((F.collect_list("v") if a.many else F.first("v")).alias(held))
                df = df.join(of, F.col(f"`{name}`") == F.col(held + "e"), "left").drop(held + "e")
                fields.append((held, alias or a.ident))
        return df.withColumn(name, F.struct(*[F.col(h).alias(a) for h, a in fields])).drop(*[h for h, _ in fields])


class OneOf(q.Or):
    """One attribute of an entity with one of several values; made of an ``or``."""

    def __init__(self, entity, attribute, values):
        branches = tuple((q.Pattern(entity, attribute, v),) for v in values)
        object.__setattr__(self, "branches", branches)
        object.__setattr__(self, "vars", None)
        object.__setattr__(self, "entity", entity)
        object.__setattr__(self, "attribute", attribute)
        object.__setattr__(self, "values", values)


class Fixpoint:
    """Rules by rounds: each evaluates the bodies over the rows that the round before found, until none is new.

    A body that calls its rule more than once takes the new rows in one call after the other, and all rows in the others.
    """

    MOST = 10_000

    def __init__(self, compiler: Compiler):
        self.c = compiler

    def rows(self, call: q.Rule) -> Relation:
        c = self.c
        heads = [q.Var(f"?__{call.name}_{k}") for k in range(len(call.args))]
        known = new = self.settled(self.round(call.name, heads, None, None))
        if known is None:
            raise QueryError(f"rule {call.name} has no body without itself")
        for _ in range(self.MOST):
            found = self.round(call.name, heads, known, new)
            if found is None:
                break
            every = known.union(found)
            if every.types == known.types:
                new = self.settled(Relation(found.df.distinct().join(known.df, found.df.columns, "left_anti").select(*known.df.columns), known.types))
            else:  # a type that joins two others: all rows are new under it
                new = self.settled(Relation(every.df.distinct(), every.types))
            if new.df.isEmpty():
                break
            known = self.settled(Relation(known.df.unionByName(new.df), known.types), known) if every.types == known.types else new
        else:
            raise QueryError(f"rule {call.name} did not settle in {self.MOST} rounds")
        columns, kinds = [], {}
        df = known.df
        for h, a in zip(heads, call.args):
            a = c.constant(a)
            if isinstance(a, q.Const):
                df = df.where(col(h) == literal(a.type, a.value) if a.type == known.types[h] else F.lit(False))
            elif isinstance(a, q.Var):
                columns.append(col(h).alias(a.name))
                kinds[a] = known.types[h]
        return Relation(df.select(*columns).distinct(), kinds)

    def round(self, name: str, heads: list, known: Relation | None, new: Relation | None) -> Relation | None:
        """What the bodies give: of the first round those without the rule itself, of others those with it."""
        c, out = self.c, None
        for formal, body in c.rules[name]:
            own = [x for x in body if isinstance(x, q.Rule) and x.name == name]
            if bool(own) != (known is not None):
                continue
            for turn in range(max(1, len(own))):
                renamed = {v: h for v, h in zip(formal, heads)}
                inner = [rename(x, renamed, next(c.fresh)) for x in body]
                calls = [x for x in inner if isinstance(x, q.Rule) and x.name == name]
                rel = None
                for k, x in enumerate(calls):
                    of = new if k == turn else known
                    one = Relation(of.df.select(*[col(h).alias(a.name) for h, a in zip(heads, x.args)]), {a: of.types[h] for h, a in zip(heads, x.args)})
                    rel = one if rel is None else rel.join(one)
                one = c.scope([x for x in inner if x not in calls], rel).select(heads)
                out = one if out is None else out.union(one)
        return out and Relation(out.df.distinct(), out.types)

    def settled(self, rel: Relation | None, old: Relation | None = None) -> Relation | None:
        """The rows, cut from their lineage in the checkpoint folder; without one they are cached, and those before let go."""
        if rel is None:
            return None
        if self.c.spark.sparkContext.getCheckpointDir():
            return Relation(rel.df.checkpoint(), rel.types)
        out = Relation(rel.df.persist(), rel.types)
        out.df.count()
        if old is not None:
            old.df.unpersist()
        return out


def rename(x, names: dict, n: int):
    """A rule's clause with its formal variables renamed, and the others made its own."""
    match x:
        case q.Var():
            return names.setdefault(x, q.Var(f"{x.name}__{n}"))
        case q.Call():
            return q.Call(x.name, tuple(rename(a, names, n) for a in x.args))
        case q.Pattern():
            return q.Pattern(*[rename(y, names, n) for y in (x.entity, x.attribute, x.value, x.tx)], x.source)
        case q.Predicate():
            return q.Predicate(rename(x.expr, names, n))
        case q.Function():
            return q.Function(rename(x.expr, names, n), q.Scalar(rename(x.binding.var, names, n)))
        case q.Or():
            return q.Or(tuple(tuple(rename(c, names, n) for c in b) for b in x.branches), x.vars and tuple(rename(v, names, n) for v in x.vars))
        case q.Not():
            return q.Not(tuple(rename(c, names, n) for c in x.clauses), x.vars and tuple(rename(v, names, n) for v in x.vars))
        case q.Rule():
            return q.Rule(x.name, tuple(rename(a, names, n) for a in x.args))
    return x


def column_names(find: list) -> list[str]:
    """``?name`` is name; ``(sum ?x)`` is sum_x; a name that comes again gets a number."""
    out: list[str] = []
    for e in find:
        match e:
            case q.Var():
                name = e.name[1:]
            case q.Aggregate():
                name = f"{e.name.replace('-', '_')}_{e.args[0].name[1:]}"
            case _:
                name = f"{type(e).__name__.lower()}_{e.var.name[1:]}"
        name, k = name.replace("-", "_"), 2
        base = name
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out
