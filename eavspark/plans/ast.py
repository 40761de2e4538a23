"""What a query is made of, as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field

from eavspark.edn import Keyword


@dataclass(frozen=True, order=True)
class Var:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    """A value; ``type`` is the name of its value type."""

    type: str
    value: object


@dataclass(frozen=True)
class Blank:
    """The place ``_``."""


BLANK = Blank()


@dataclass(frozen=True)
class Call:
    """A function of expressions: Var, Const or Call."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Pattern:
    entity: object
    attribute: object
    value: object
    tx: object = BLANK
    source: str | None = None


@dataclass(frozen=True)
class Predicate:
    expr: Call


@dataclass(frozen=True)
class Function:
    expr: Call
    binding: object


@dataclass(frozen=True)
class Or:
    """Branches, each a tuple of clauses; ``vars`` are those of or-join."""

    branches: tuple
    vars: tuple | None = None


@dataclass(frozen=True)
class Not:
    clauses: tuple
    vars: tuple | None = None


@dataclass(frozen=True)
class TypeOf:
    var: Var
    type: Keyword


@dataclass(frozen=True)
class Rule:
    """A call of a rule of the query's rule set."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Scalar:
    var: Var


@dataclass(frozen=True)
class Coll:
    var: Var


@dataclass(frozen=True)
class Tuple:
    vars: tuple


@dataclass(frozen=True)
class Rel:
    vars: tuple


@dataclass(frozen=True)
class Aggregate:
    name: str
    args: tuple


@dataclass(frozen=True)
class Pull:
    var: Var
    attributes: tuple  # of (Keyword or "*", alias or None)


@dataclass(frozen=True)
class The:
    var: Var


@dataclass
class Query:
    find: list
    where: list
    shape: str = "relation"  # or scalar, collection, tuple
    bindings: list = field(default_factory=list)
    with_vars: list = field(default_factory=list)
    order: list | None = None  # of (Var, ascending)
    limit: object = None  # int or Var
    rules: dict = field(default_factory=dict)  # name to [(vars, clauses)]
