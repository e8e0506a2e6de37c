"""Schemas, triple patterns and their orders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Open end of an interval of versions.
OPEN = 2147483647
TRIPLE = ["s", "p", "o"]
TRIPLE_DDL = "s string, p string, o string"
CHANGE_DDL = f"version int, {TRIPLE_DDL}, op int"
PRESENCE_DDL = f"{TRIPLE_DDL}, v_from int, v_to int"


@dataclass(frozen=True)
class TriplePattern:
    """Terms to be equal; None, the empty string and anything that starts with ``?`` stand for any term."""

    s: str | None = None
    p: str | None = None
    o: str | None = None

    def bound(self) -> dict[str, str]:
        return {c: v for c in TRIPLE if (v := getattr(self, c)) and not v.startswith("?")}

    def where(self) -> Column | None:
        out = None
        for c, v in self.bound().items():
            out = F.col(c) == v if out is None else out & (F.col(c) == v)
        return out

    def filter(self, df):
        condition = self.where()
        return df if condition is None else df.where(condition)

    def shape(self) -> str:
        return "".join(c.upper() if c in self.bound() else "?" for c in TRIPLE)

    def order(self) -> list[str]:
        """The order in which deltas and version lists come: that of the index which serves the shape."""
        return {"?PO": ["p", "o", "s"], "?P?": ["p", "o", "s"], "S?O": ["o", "s", "p"], "??O": ["o", "s", "p"]}.get(self.shape(), TRIPLE)

    def snapshot_order(self) -> list[str]:
        return {"?P?": ["s", "o"], "??O": ["p", "s"]}.get(self.shape(), TRIPLE)


ANY = TriplePattern()


def pattern(x: TriplePattern | tuple | None) -> TriplePattern:
    return x if isinstance(x, TriplePattern) else TriplePattern(*(x or ()))
