"""A query as EDN text again: ``parse(text(query)) == query``."""

from __future__ import annotations

import uuid

from eavspark.edn import BigInt, write
from eavspark.plans import ast as q


def term(x) -> str:
    match x:
        case q.Var():
            return x.name
        case q.Blank():
            return "_"
        case q.Const("keyword", value):
            return value
        case q.Const("bigint", value):
            return write(BigInt(value))
        case q.Const("uuid", value):
            return write(uuid.UUID(value))
        case q.Const():
            return write(x.value)
        case q.Call():
            return "(" + " ".join([x.name, *map(term, x.args)]) + ")"
    return str(x)


def binding(b) -> str:
    match b:
        case q.Scalar():
            return b.var.name
        case q.Coll():
            return f"[{b.var.name} ...]"
        case q.Tuple():
            return "[" + " ".join(map(term, b.vars)) + "]"
    return "[[" + " ".join(map(term, b.vars)) + "]]"


def clause(c) -> str:
    match c:
        case q.Pattern():
            places = [c.entity, c.attribute, c.value, c.tx]
            while len(places) > 2 and places[-1] == q.BLANK:
                places.pop()
            return "[" + " ".join([*([c.source] if c.source else []), *map(term, places)]) + "]"
        case q.Predicate():
            return f"[{term(c.expr)}]"
        case q.Function():
            return f"[{term(c.expr)} {binding(c.binding)}]"
        case q.TypeOf():
            return f"[(type {c.var} {c.type})]"
        case q.Rule():
            return "(" + " ".join([c.name, *map(term, c.args)]) + ")"
        case q.Or():
            inner = [clause(b[0]) if len(b) == 1 else "(and " + " ".join(map(clause, b)) + ")" for b in c.branches]
            return _joined("or", c.vars, inner)
        case q.Not():
            return _joined("not", c.vars, list(map(clause, c.clauses)))
    raise TypeError(f"{type(c).__name__} is not a clause")


def _joined(name: str, given, inner: list[str]) -> str:
    head = name if given is None else f"{name}-join [{' '.join(v.name for v in given)}]"
    return f"({head} {' '.join(inner)})"


def element(e) -> str:
    match e:
        case q.Aggregate():
            return "(" + " ".join([e.name, *map(term, e.args)]) + ")"
        case q.The():
            return f"(the {e.var})"
        case q.Pull():
            parts = [f"{a}" + (f" :as {alias}" if alias else "") for a, alias in e.attributes]
            return f"(pull {e.var} [{' '.join(parts)}])"
    return e.name


def text(query: q.Query) -> str:
    find = " ".join(map(element, query.find))
    find = {"scalar": f"{find} .", "collection": f"[{find} ...]", "tuple": f"[{find}]"}.get(query.shape, find)
    parts = [":find", find]
    if query.bindings:
        parts += [":in", *map(binding, query.bindings)]
    if query.with_vars:
        parts += [":with", *map(term, query.with_vars)]
    parts += [":where", *map(clause, query.where)]
    if query.order is not None:
        parts += [":order", *[f"[{v} {':asc' if up else ':desc'}]" for v, up in query.order]]
    if query.limit is not None:
        parts += [":limit", term(query.limit) if isinstance(query.limit, q.Var) else str(query.limit)]
    return "[" + " ".join(parts) + "]"


