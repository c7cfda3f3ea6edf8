"""What a store's properties are made of: entity tables and the quads table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ast import QueryError


@dataclass
class EntityTable:
    """Rows are objects, columns are properties."""

    name: str
    df: DataFrame
    id: str | Column | None = None
    null_means_absent: bool = False
    references: dict[str, str] = field(default_factory=dict)  # property -> table it refers to

    def id_column(self) -> Column:
        if self.id is None:
            raise QueryError(f"table {self.name} has no id")
        return F.col(self.id) if isinstance(self.id, str) else self.id


@dataclass
class Catalog:
    """Entity tables by name, and at most one quads table (s, p, o, ot, c, listpos)."""

    tables: dict[str, EntityTable] = field(default_factory=dict)
    quads: DataFrame | None = None

    def table_of(self, props: set[str], named: str | None) -> EntityTable | None:
        """The entity table with all of ``props``; None stands for the quads table."""
        if named is not None and named in self.tables:
            return self.tables[named]
        real = {p for p in props if p not in ("*", "type")} | ({"type"} & props if named is None else set())
        if self.tables:
            fit = [t for t in self.tables.values() if real and real <= set(t.df.columns)]
            if len(fit) == 1:
                return fit[0]
            if len(fit) > 1:
                if self.quads is not None:
                    return None
                raise QueryError(f"properties {sorted(real)} are in tables {', '.join(t.name for t in fit)}: add type = 'name'")
        if self.quads is not None:
            return None
        if not real and len(self.tables) == 1:
            return next(iter(self.tables.values()))
        raise QueryError(f"no table has the properties {sorted(real)}" if real else "the query names no property: add type = 'name'")
