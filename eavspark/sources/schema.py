"""Attributes, idents and partitions of stored facts, kept on the driver.

What is known before the first transaction is fixed; the rest is itself facts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from eavspark.sources.base import Attribute

# Entity ids of the built-in idents, and the layout of an entity id.
DB_PART, TX_PART, USER_PART = 0, 1, 2
COUNTER_BITS = 42
FIRST_DB_ID = 1000
IDENTS = {
    ":db/ident": 1, ":db/valueType": 2, ":db/cardinality": 3, ":db/unique": 4,
    ":db.type/keyword": 10, ":db.type/string": 11, ":db.type/long": 12, ":db.type/ref": 13, ":db.type/boolean": 14, ":db.type/double": 15,
    ":db.type/float": 16, ":db.type/instant": 17, ":db.type/uuid": 18, ":db.type/bytes": 19, ":db.type/bigint": 20, ":db.type/vector": 21, ":db.type/map": 22,
    ":db.cardinality/one": 30, ":db.cardinality/many": 31, ":db.unique/value": 32, ":db.unique/identity": 33,
    ":db/txInstant": 40, ":db/txId": 41, ":db/txResult": 42, ":db/txError": 43,
    ":db.tx/committed": 50, ":db.tx/aborted": 51,
}
BUILT_IN = {
    ":db/ident": ("keyword", "identity"), ":db/valueType": ("ref", None), ":db/cardinality": ("ref", None), ":db/unique": ("ref", None),
    ":db/txInstant": ("instant", None), ":db/txId": ("long", None), ":db/txResult": ("ref", None), ":db/txError": ("string", None),
}
SCHEMA_ATTRIBUTES = (":db/ident", ":db/valueType", ":db/cardinality", ":db/unique")
TYPE_OF = {v: k.rpartition("/")[2] for k, v in IDENTS.items() if k.startswith(":db.type/")}


class TxError(ValueError):
    """The transaction is refused."""


def entity_id(partition: int, counter: int) -> int:
    return partition << COUNTER_BITS | counter


@dataclass
class Schema:
    idents: dict[str, int] = field(default_factory=lambda: dict(IDENTS))
    by_id: dict[int, Attribute] = field(default_factory=dict)
    #: The next counter of each partition.
    counters: dict[int, int] = field(default_factory=lambda: {DB_PART: FIRST_DB_ID, TX_PART: 0, USER_PART: 0})

    def __post_init__(self):
        for ident, (kind, unique) in BUILT_IN.items():
            self.by_id.setdefault(IDENTS[ident], Attribute(ident, kind, False, unique, IDENTS[ident]))

    def copy(self) -> Schema:
        return Schema(dict(self.idents), dict(self.by_id), dict(self.counters))

    def attribute(self, ident: str | int) -> Attribute | None:
        return self.by_id.get(ident if isinstance(ident, int) else self.idents.get(ident))

    def need(self, ident: str) -> Attribute:
        found = self.attribute(ident)
        if found is None:
            raise TxError(f"Unknown attribute: {ident}")
        return found

    def allocate(self, partition: int) -> int:
        n = self.counters[partition]
        self.counters[partition] = n + 1
        return entity_id(partition, n)

    def allocated(self, e: int) -> bool:
        partition, counter = e >> COUNTER_BITS, e & (1 << COUNTER_BITS) - 1
        return e >= 0 and counter < self.counters.get(partition, 0)

    def name_of(self, e: int) -> str | None:
        return next((k for k, v in self.idents.items() if v == e), None)

    def install(self, datoms) -> None:
        """Take in the schema facts of a committed transaction, which are checked here first."""
        found: dict[int, dict] = {}
        taken = set(self.idents.values())
        for d in datoms:
            if d.a not in SCHEMA_ATTRIBUTES:
                continue
            if d.e in taken:
                raise TxError(f"Cannot modify schema entity {d.e} ({self.name_of(d.e)})")
            if not d.add:
                raise TxError(f"Schema retractions are not supported for attribute {d.a}")
            found.setdefault(d.e, {})[d.a] = d.v
        made = []
        for e, facts in found.items():
            ident = facts.pop(":db/ident", None)
            ident = str(ident) if ident is not None else None
            if facts:
                made.append((e, self._checked(e, ident, facts)))
            if ident:
                self.idents[ident] = e
        for e, attribute in made:
            self.by_id[e] = attribute

    def _checked(self, e: int, ident: str | None, facts: dict) -> Attribute:
        of = f" for '{ident or '<unknown>'}'"
        for needed in (":db/valueType", ":db/cardinality"):
            if needed not in facts:
                raise TxError(f"attribute install needs {needed}{of}")
        if ident is None:
            raise TxError(f"attribute install needs :db/ident{of}")
        kind = TYPE_OF.get(facts[":db/valueType"])
        if kind is None:
            raise TxError(f"{facts[':db/valueType']} is not a value type{of}")
        many = {IDENTS[":db.cardinality/one"]: False, IDENTS[":db.cardinality/many"]: True}.get(facts[":db/cardinality"])
        if many is None:
            raise TxError(f"{facts[':db/cardinality']} is not a cardinality{of}")
        unique = None
        if ":db/unique" in facts:
            unique = {IDENTS[":db.unique/value"]: "value", IDENTS[":db.unique/identity"]: "identity"}.get(facts[":db/unique"])
            if unique is None:
                raise TxError(f"{facts[':db/unique']} is not a uniqueness{of}")
        return Attribute(ident, kind, many, unique, e)
