"""Relations between query stages: a DataFrame with a column and a type for each variable.

The full relation of a scope is a set; only the projection to :find makes a bag of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eavspark.functions.values import common, spark_type, to_any
from eavspark.plans.ast import Var


def col(v: Var) -> Column:
    return F.col(f"`{v.name}`")


@dataclass
class Relation:
    df: DataFrame
    types: dict[Var, str]

    @staticmethod
    def unit(spark: SparkSession) -> Relation:
        """No column, one row: what a scope starts from."""
        return Relation(spark.range(1).select(), {})

    @staticmethod
    def empty(spark: SparkSession, types: dict[Var, str]) -> Relation:
        return Relation(spark.range(0).select(*[F.lit(None).cast(spark_type(t)).alias(v.name) for v, t in types.items()]), types)

    @property
    def vars(self) -> list[Var]:
        return list(self.types)

    def typed(self, v: Var) -> tuple[Column, str]:
        return col(v), self.types[v]

    def select(self, vars: list[Var]) -> Relation:
        return Relation(self.df.select(*map(col, vars), *self.weight), {v: self.types[v] for v in vars})

    @property
    def weight(self) -> list[str]:
        """The column of weights, which relations of changes have besides their variables."""
        return ["_w"] if "_w" in self.df.columns else []

    def distinct(self) -> Relation:
        return Relation(self.df.distinct(), self.types) if self.types else Relation(self.df.limit(1), {})

    def where(self, test: Column) -> Relation:
        return Relation(self.df.where(test), self.types)

    def extend(self, v: Var, value: Column, kind: str) -> Relation:
        """Add a variable; rows for which it has no value go."""
        df = self.df.withColumn(v.name, value)
        return Relation(df.where(col(v).isNotNull()), self.types | {v: kind})

    def as_types(self, types: dict[Var, str]) -> Relation:
        """The same rows, with typed columns tagged where ``types`` says any."""
        columns = [(to_any(col(v), t) if types.get(v, t) == "any" else col(v)).alias(v.name) for v, t in self.types.items()]
        return Relation(self.df.select(*columns, *self.weight), {v: types.get(v, t) for v, t in self.types.items()})

    def _aligned(self, other: Relation, on: list[Var]) -> tuple[Relation, Relation] | None:
        """Both with equal types of the shared variables; None if no rows can meet."""
        to = {v: common([self.types[v], other.types[v]]) for v in on}
        if any(t == "any" and "any" not in (self.types[v], other.types[v]) for v, t in to.items()):
            return None  # two plain types that differ are never the same value
        return (self if all(self.types[v] == t for v, t in to.items()) else self.as_types(to)), (
            other if all(other.types[v] == t for v, t in to.items()) else other.as_types(to)
        )

    def join(self, other: Relation) -> Relation:
        """Natural join; without shared variables the product."""
        if not self.types and not other.types:
            return Relation(self.df.crossJoin(other.df), {})
        on = [v for v in self.types if v in other.types]
        if not on:
            return Relation(self.df.crossJoin(other.df), self.types | other.types)
        sides = self._aligned(other, on)
        if sides is None:
            return Relation.empty(self.df.sparkSession, self.types | other.types)
        left, right = sides
        return Relation(left.df.join(right.df, [v.name for v in on]), {v: left.types[v] for v in on} | {v: t for v, t in left.types.items() if v not in on} | {v: t for v, t in right.types.items() if v not in on})

    def _filtering(self, other: Relation, how: str, missing: bool) -> Relation:
        on = [v for v in self.types if v in other.types]
        if not on:
            # all rows or none, by whether the other has any
            return Relation(self.df.join(other.df.select().limit(1), F.lit(True), how), self.types)
        sides = self._aligned(other, on)
        if sides is None:
            return self if missing else Relation.empty(self.df.sparkSession, self.types)
        left, right = sides
        kept = left.df.join(right.df.select(*map(col, on)), [v.name for v in on], how)
        return Relation(kept, left.types)

    def semi(self, other: Relation) -> Relation:
        """Rows whose shared variables are in the other."""
        return self._filtering(other, "left_semi", False)

    def anti(self, other: Relation) -> Relation:
        """Rows whose shared variables aren't in the other."""
        return self._filtering(other, "left_anti", True)

    def weighted_by(self, other: Relation, weight: int) -> Relation:
        """All rows; those whose shared variables are in the other, which is a set, get a weight added to theirs."""
        on = [v for v in self.types if v in other.types]
        own = F.col("_w") if self.weight else F.lit(0).cast("long")
        sides = self._aligned(other, on)
        if sides is None:
            return Relation(self.df.withColumn("_w", own), self.types)
        left, right = sides
        found = right.df.select(*map(col, on))
        if len(on) < len(other.types) or not on:
            found = found.distinct() if on else found.limit(1)
        found = found.withColumn("_more", F.lit(weight).cast("long"))
        joined = left.df.join(found, [v.name for v in on] if on else F.lit(True), "left_outer")
        return Relation(joined.select(*map(col, left.vars), (own + F.coalesce("_more", F.lit(0).cast("long"))).alias("_w")), left.types)

    def union(self, other: Relation) -> Relation:
        """Rows of both, with the columns of this one by name; types that differ are tagged."""
        to = {v: common([t, other.types[v]]) for v, t in self.types.items()}
        left, right = self.as_types(to), other.select(self.vars).as_types(to)
        return Relation(left.df.union(right.df), to)
