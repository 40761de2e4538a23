"""What a query needs of a place that holds facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Attribute:
    """``type`` is a value type; a ref is ``long`` in columns, as entity ids are."""

    ident: str
    type: str
    many: bool = False
    unique: str | None = None
    id: int | None = None

    @property
    def kind(self) -> str:
        return "long" if self.type == "ref" else self.type


class FactSource:
    """Facts (e, a, v) of one value type an attribute, at a basis."""

    def attribute(self, ident: str | int) -> Attribute | None:
        raise NotImplementedError

    def attributes(self) -> list[Attribute]:
        raise NotImplementedError

    def scan(self, attribute: Attribute, basis: int | None, with_tx: bool = False) -> DataFrame:
        """Columns e (long), v and, if asked for, tx (long); distinct live facts."""
        raise NotImplementedError

    def group(self, attribute: Attribute) -> str | None:
        """Single-valued attributes of one group come from one scan."""
        return None

    def star(self, attributes: list[Attribute], basis: int | None) -> DataFrame:
        """e, and for each attribute its value as v0, v1, ...; null where there is no fact."""
        raise NotImplementedError

    def ident(self, name: str) -> int | None:
        """The entity that a keyword names."""
        return None
