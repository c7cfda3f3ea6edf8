"""Rows of a compiled query to JSON values. Only this runs on the driver, on collected results."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Row

from .functions.values import BNODE, BOOLEAN, LITERAL, NULL, NUMERIC, REF, XSD
from .plans.compiler import Compiled, Field

#: Fixed value: the prefix of ids of objects embedded in another one.
EMBEDDED = BNODE + "j:e:"
NIL = "rdf:nil"


class Renderer:
    """``expand``: objects by id, for embedded objects and DEPTH."""

    def __init__(self, compiled: Compiled, objects: dict | None = None, for_update: bool = False, depth: int = 0, names: dict | None = None):
        self.q, self.objects, self.for_update, self.depth = compiled, objects or {}, for_update, depth
        self.back = {v: k for k, v in (names or {}).items() if isinstance(v, str)}
        names = names or {}
        self.id_name = names["id"] if isinstance(names.get("id"), str) else "id"
        self.prop_patterns = {**(names.get("sharedpatterns") or {}), **(names.get("propertypatterns") or {})}
        self.id_patterns = {**(names.get("sharedpatterns") or {}), **(names.get("idpatterns") or {})}

    @staticmethod
    def short(text: str, patterns: dict) -> str:
        for k, full in patterns.items():
            if text.startswith(full):
                return k + text[len(full) :]
        return text

    def name(self, prop: str) -> str:
        return self.back.get(prop) or self.short(prop, self.prop_patterns)

    # -- values
    def value(self, v, kind: str = "any", depth: int | None = None):
        depth = self.depth if depth is None else depth
        if v is None:
            return None
        if isinstance(v, Row) and "ot" in v.__fields__:
            ot, s = v["ot"], v["s"]
            if ot == NULL:
                return None
            if ot == REF:
                return self.ref(s, depth)
            if ot == BOOLEAN:
                return s == "true"
            if ot in NUMERIC:
                return int(s) if ot == XSD + "integer" or ot == XSD + "int" or ot == XSD + "long" else float(s)
            if ot == LITERAL:
                return s
            return {"datatype": ot, "value": s}
        if kind == "ref":
            return self.ref(v, depth)
        if isinstance(v, Row):
            return {k: self.value(x) for k, x in v.asDict().items()}
        if isinstance(v, Decimal):
            return int(v) if v == v.to_integral_value() else float(v)
        if isinstance(v, (datetime, date)):
            return v.isoformat()
        if isinstance(v, list):
            return [self.value(x, kind, depth) for x in v]
        return v

    def ref(self, uri: str, depth: int):
        if uri.startswith(EMBEDDED) and uri in self.objects:
            return self.object(uri, depth)
        if uri == NIL:
            return []
        if depth > 0:
            return self.object(uri, depth - 1) if uri in self.objects else {self.id_name: uri}
        return "@" + self.short(uri, self.id_patterns)

    def object(self, uri: str, depth: int) -> dict | list:
        """A stored object: properties with lists restored."""
        props = self.objects[uri]
        if props and all(p.startswith("rdf:_") for p in props):
            return [self.value(props[p][0], "any", depth) for p in sorted(props, key=lambda p: int(p[5:]))]
        out = {self.name(p): self.listed(vals, False, depth) for p, vals in props.items()}
        if self.for_update or not uri.startswith(BNODE):
            out[self.id_name] = uri
        return out

    def listed(self, vals: list, force: bool, depth: int | None = None):
        """The values of a property: positions restore list order and repeats."""
        spread = []
        is_list = False
        for v in vals:
            pos = v["pos"] if isinstance(v, Row) and "pos" in v.__fields__ else None
            if pos:
                is_list = True
                spread += [(p, v) for p in pos]
            else:
                spread.append((1 << 60, v))
        spread.sort(key=lambda x: x[0])
        out = [self.value(v, "any", depth) for _, v in spread]
        if len(out) == 1 and out[0] == [] and isinstance(spread[0][1], Row) and spread[0][1]["s"] == NIL:
            return []
        if len(out) == 1 and not force and not is_list:
            return out[0]
        return out

    def field(self, f: Field, row: Row):
        v = row[f.column]
        if f.kind == "nested":
            if not f.many:
                return self.shape(f, v)
            made = [self.shape(f, x) for x in v or []]
            if f.force_list:
                return made
            return None if not made else made[0] if len(made) == 1 else made
        if f.kind == "star":
            return self.star(f, row, v)
        if f.many:
            vals = v or []
            if f.listed:
                out = self.listed(vals, f.force_list)
                return (None if not f.force_list else []) if not vals else out
            out = [self.value(x, f.value_kind) for x in vals]
            if f.force_list:
                return out
            return None if not out else out[0] if len(out) == 1 else out
        out = self.value(v, f.value_kind)
        if f.force_list:
            return [] if out is None else out if isinstance(out, list) else [out]
        return out

    def star(self, f: Field, row: Row, v) -> dict:
        if f.value_kind == "struct":
            out = {k: self.value(x) for k, x in v.asDict().items()}
        else:
            props: dict[str, list] = {}
            for e in v:
                props.setdefault(e["p"], []).append(e["v"])
            out = {self.name(p): self.listed(sorted(vals, key=lambda x: (x["pos"] or [1 << 60], x["r"], x["s"] or "")), False) for p, vals in sorted(props.items())}
        uri = row["__id"] if "__id" in row.__fields__ else None
        if uri is not None and (self.for_update or not str(uri).startswith(BNODE)):
            out[self.id_name] = uri
        return out

    def shape(self, f: Field, v) -> object:
        if f.shape == "value":
            return self.field(f.fields[0], v)
        if f.shape == "array":
            return [self.field(x, v) for x in f.fields] if f.fields else []
        return self.items(f.fields, v)

    def items(self, fields: list[Field], row: Row) -> dict:
        out: dict = {}
        for f in fields:
            v = self.field(f, row)
            if f.kind == "star" and f.name is None and f.dynamic is None:
                for k, x in v.items():
                    out.setdefault(k, x)
                continue
            name = row[f.dynamic] if f.dynamic else f.name
            if name is None or f.omitnull and (v is None or v == []):
                continue
            if name == "id" and f.name == "id" and not f.dynamic:
                name = self.id_name
                v = v[1:] if isinstance(v, str) and v.startswith("@") else v
            out[name] = v
        return out

    def rows(self, rows: list[Row]) -> list:
        c = self.q.construct
        out: list = []
        for row in rows:
            if c.shape == "object":
                out.append(self.items(self.q.fields, row))
            elif c.shape == "array":
                made = []
                for f in self.q.fields:
                    v = self.field(f, row)
                    if f.kind == "star":
                        made += [x for k, x in v.items() if k != self.id_name]
                    elif not (f.omitnull and v is None):
                        made.append(v)
                out.append(made)
            else:
                out.append(self.field(self.q.fields[0], row))
        if c.mergeall:
            if c.shape == "object":
                one: dict = {}
                for x in out:
                    one.update(x)
                return [one]
            return [[y for x in out for y in (x if isinstance(x, list) else [x])]]
        return out
