"""Typed values and the expression semantics of the language, as Column builders.

A ``Val`` is a Column with a kind known while planning, so typed tables get
native Spark expressions that push down. Values of the quads layout are structs
(rank, n, s, ot) of kind ``any``; their order is null < numbers and booleans <
strings < references.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Datatype codes of the quads layout.
XSD = "http://www.w3.org/2001/XMLSchema#"
REF, LITERAL, NULL = "R", "L", "N"
INTEGER, DOUBLE, BOOLEAN = XSD + "integer", XSD + "double", XSD + "boolean"
NUMERIC = [INTEGER, DOUBLE, XSD + "int", XSD + "float", XSD + "decimal", XSD + "long"]

VALUE_TYPE = "struct<r:tinyint,n:double,s:string,ot:string>"
_RANK = {"null": 0, "num": 1, "bool": 1, "str": 2, "other": 2, "ref": 3}


@dataclass(frozen=True)
class Val:
    """A value while planning. kind: num str bool null ref other any; ``many``: an array of them."""

    col: Column
    kind: str
    many: bool = False
    literal: object = None
    constant: bool = False
    listed: bool = False  # elements carry list positions
    prop: bool = False  # a bare property, for typed equality


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "num"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "str"
    if isinstance(t, T.NullType):
        return "null"
    return "other"


def literal(value: object) -> Val:
    if value is None:
        return Val(F.lit(None).cast("string"), "null", False, None, True)
    if isinstance(value, bool):
        return Val(F.lit(value), "bool", False, value, True)
    if isinstance(value, (int, float)):
        return Val(F.lit(value), "num", False, value, True)
    if isinstance(value, str):
        return Val(F.lit(value), "str", False, value, True)
    if isinstance(value, (list, tuple)):
        inner = [to_any(literal(v)) for v in value]
        return Val(F.array(*inner) if inner else F.array().cast(f"array<{VALUE_TYPE}>"), "any", True, value, True)
    raise TypeError(f"no literal for {type(value).__name__}")


def reference(uri: str) -> Val:
    return Val(F.lit(uri), "ref", False, uri, True)


def _struct(rank, n, s, ot) -> Column:
    return F.struct(F.lit(rank).cast("tinyint").alias("r"), n.cast("double").alias("n"), s.cast("string").alias("s"), F.lit(ot).alias("ot") if isinstance(ot, str) else ot.alias("ot"))


def float_text(n: Column) -> Column:
    """A number as text the way Python writes it, for the common magnitudes."""
    return n.cast("double").cast("string")


def to_any(v: Val) -> Column:
    """The element as a (rank, n, s, ot) struct."""
    none = _struct(0, F.lit(None), F.lit(None), NULL)
    if v.kind == "any":
        return F.coalesce(F.struct(v.col["r"].alias("r"), v.col["n"].alias("n"), v.col["s"].alias("s"), v.col["ot"].alias("ot")), none) if not v.constant else v.col
    if v.kind == "null":
        return none
    if v.kind == "num":
        whole = isinstance(v.literal, int) if v.constant else None
        text = v.col.cast("string")
        kind = F.lit(INTEGER if whole else DOUBLE) if v.constant else F.when(text.rlike(r"^-?\d+$"), F.lit(INTEGER)).otherwise(F.lit(DOUBLE))
        full = _struct(1, v.col, text, kind)
    elif v.kind == "bool":
        full = _struct(1, v.col.cast("double"), v.col.cast("string"), BOOLEAN)
    elif v.kind == "ref":
        full = _struct(3, F.lit(None), v.col, REF)
    else:
        full = _struct(2, F.lit(None), v.col.cast("string"), LITERAL)
    return full if v.constant else F.when(v.col.isNull(), none).otherwise(full)


def order_key(v: Val) -> Column:
    """What a value sorts by."""
    if v.many:
        inner = (lambda x: F.struct(x["r"], x["n"], x["s"])) if v.kind == "any" else (lambda x: x)
        out = F.transform(v.col, inner)
        return F.when(F.size(v.col) > 0, out)
    if v.kind == "any":
        return F.when(v.col["r"] > 0, F.struct(v.col["r"], v.col["n"], v.col["s"]))
    return v.col


# -- single values ---------------------------------------------------------

_FLOAT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def text_number(s: Column) -> Column:
    """float() of a text, 0.0 where it is none."""
    return F.when(s.rlike(_FLOAT), s.try_cast("double")).otherwise(F.lit(0.0))


def number(v: Val) -> Column:
    """Lenient number: null stays null, other text is 0.0."""
    if v.constant and v.kind == "num":
        return F.lit(float(v.literal))
    if v.kind == "null":
        return F.lit(None).cast("double")
    if v.kind == "num":
        return v.col.cast("double")
    if v.kind == "bool":
        return v.col.cast("double")
    if v.kind == "any":
        return F.when(v.col["r"] == 1, v.col["n"]).when(v.col["r"] > 1, text_number(v.col["s"]))
    return F.when(v.col.isNotNull(), text_number(v.col.cast("string")))


def is_null(v: Val) -> Column:
    if v.constant:
        return F.lit(v.literal is None)
    return (v.col.isNull() | (v.col["r"] == 0)) if v.kind == "any" else v.col.isNull()


def truthy(v: Val) -> Column:
    """Python truth, false for null."""
    if v.many:
        return F.size(v.col) > 0
    if v.kind == "null":
        return F.lit(False)
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.kind == "num":
        return F.coalesce(v.col != 0, F.lit(False))
    if v.kind == "any":
        return F.coalesce(F.when(v.col["r"] == 1, v.col["n"] != 0).when(v.col["r"] > 1, v.col["s"] != ""), F.lit(False))
    if v.kind in ("str", "ref"):
        return F.coalesce(v.col != "", F.lit(False))
    return v.col.isNotNull()


def string(v: Val) -> Val:
    if v.kind == "bool":
        return Val(F.initcap(v.col.cast("string")), "str")
    if v.kind == "any":
        plain = F.when(v.col["ot"] == BOOLEAN, F.initcap(v.col["s"])).otherwise(v.col["s"])
        return Val(F.when(v.col["r"] > 0, plain), "str")
    return Val(v.col.cast("string"), "str")


def equal(a: Val, b: Val, typed: bool = False) -> Column:
    """null = null is true. ``typed``: lexical form and datatype must agree (quads layout)."""
    if a.constant and b.constant and not a.many and not b.many and "any" not in (a.kind, b.kind):
        same = (a.kind == "ref") == (b.kind == "ref") and a.literal == b.literal
        return F.lit(bool(same) and (isinstance(a.literal, str) == isinstance(b.literal, str)))
    if "any" in (a.kind, b.kind):
        x, y = to_any(a), to_any(b)
        if typed:
            return (x["ot"] == y["ot"]) & ((x["r"] == 0) | (x["s"] == y["s"]))
        return (x["r"] == y["r"]) & F.when(x["r"] == 0, F.lit(True)).when(x["r"] == 1, x["n"] == y["n"]).otherwise(x["s"] == y["s"])
    if a.kind == "null" or b.kind == "null":
        return is_null(a if b.kind == "null" else b)
    kinds = {a.kind, b.kind}
    if kinds == {"num", "bool"}:
        return a.col.cast("double").eqNullSafe(b.col.cast("double"))
    if len(kinds) == 1 or kinds <= {"str", "other"} or kinds <= {"str", "ref"} and not (a.constant or b.constant) or "other" in kinds:
        if a.constant or b.constant:  # the other side's null is simply not equal
            return a.col == b.col
        return a.col.eqNullSafe(b.col)
    if kinds == {"ref", "num"} or kinds == {"ref", "str"}:
        # An id written as a reference matches the column that holds it.
        r, o = (a, b) if a.kind == "ref" else (b, a)
        return o.col.cast("string") == r.col
    return a.col.isNull() & b.col.isNull()


def compare(op: str, a: Val, b: Val) -> Column:
    """Order across types; null is below everything."""
    if op == ">":
        return compare("<", b, a)
    if op in ("<=", ">="):
        x, y = (a, b) if op == "<=" else (b, a)
        return compare("<", x, y) | F.coalesce(equal(x, y), F.lit(False))
    if "any" in (a.kind, b.kind):
        x, y = to_any(a), to_any(b)
        return (x["r"] < y["r"]) | ((x["r"] == y["r"]) & F.when(x["r"] == 1, x["n"] < y["n"]).when(x["r"] > 1, x["s"] < y["s"]).otherwise(F.lit(False)))
    if a.kind == "null":
        return ~is_null(b)
    if b.kind == "null":
        return F.lit(False)
    same = a.kind == b.kind or {a.kind, b.kind} == {"num", "bool"} or "other" in (a.kind, b.kind)
    x, y = (a.col.cast("double"), b.col.cast("double")) if {a.kind, b.kind} == {"num", "bool"} else (a.col, b.col)
    less = (x < y) if same else F.lit(_RANK[a.kind] < _RANK[b.kind]) & b.col.isNotNull()
    if a.constant:
        return less if same else F.coalesce(less, F.lit(False))
    return a.col.isNull() & b.col.isNotNull() | F.coalesce(less, F.lit(False)) if not b.constant else a.col.isNull() | less


def lift(fn: Callable[..., Val], vals: list[Val]) -> Val:
    """``fn`` over the cartesian product of many-valued arguments."""
    at = next((i for i, v in enumerate(vals) if v.many), None)
    if at is None:
        return fn(*vals)
    seen: list[Val] = []

    def inner(x: Column) -> Column:
        one = replace(vals[at], col=x, many=False, constant=False)
        out = lift(fn, [*vals[:at], one, *vals[at + 1 :]])
        seen.append(out)
        return out.col

    col = F.transform(vals[at].col, inner)
    out = seen[0]
    if out.many:
        col = F.flatten(col)
    return Val(col, out.kind, True)


def holds(v: Val) -> Column:
    """A predicate value as a condition on the object: any of its values is true."""
    if v.many:
        return F.exists(v.col, lambda x: truthy(Val(x, v.kind)))
    if v.kind == "bool":
        return v.col
    return truthy(v)


# -- functions of the language --------------------------------------------


def _arithmetic(op: str) -> Callable[[Val, Val], Val]:
    def run(a: Val, b: Val) -> Val:
        x, y = number(a), number(b)
        if op == "+":
            out = x + y
        elif op == "-":
            out = x - y
        elif op == "*":
            out = x * y
        elif op == "/":
            out = x / y
        else:  # the sign of a remainder follows the divisor
            out = x - y * F.floor(x / y)
        return Val(out, "num")

    return run


def _strip(fn: str) -> Callable[..., Val]:
    def run(s: Val, chars: Val | None = None) -> Val:
        text = s.col["s"] if s.kind == "any" else s.col.cast("string")
        if chars is None or chars.kind == "null":
            left, right = fn != "rtrim", fn != "ltrim"
            out = text
            if left:
                out = F.regexp_replace(out, r"^\s+", "")
            if right:
                out = F.regexp_replace(out, r"\s+$", "")
            return Val(out, "str")
        what = chars.col["s"] if chars.kind == "any" else chars.col
        return Val({"trim": F.btrim, "ltrim": F.ltrim, "rtrim": F.rtrim}[fn](text, what), "str")

    return run


def _case(fn: Callable[[Column], Column]) -> Callable[[Val], Val]:
    return lambda a: Val(fn(string(a).col), "str")


def as_ref(v: Val) -> Val:
    if v.kind == "any":
        return Val(F.when(v.col["r"] > 0, v.col["s"]), "ref")
    return replace(v, col=v.col.cast("string"), kind="ref", literal=None if v.literal is None else str(v.literal))


def _is_ref(v: Val) -> Val:
    return Val(v.col["ot"] == REF, "bool") if v.kind == "any" else Val(F.lit(v.kind == "ref"), "bool")


#: Fixed value: the prefix of ids of anonymous objects.
BNODE = "bnode:"


def _is_bnode(v: Val) -> Val:
    text = v.col["s"] if v.kind == "any" else v.col.cast("string")
    return Val(F.coalesce(text.startswith(BNODE), F.lit(False)), "bool")


def common(vals: list[Val]) -> tuple[str, list[Column]]:
    """One kind for several values."""
    kinds = {v.kind for v in vals if v.kind != "null"}
    if len(kinds) <= 1:
        kind = kinds.pop() if kinds else "null"
        return kind, [to_any(v) if kind == "any" else (F.lit(None) if v.kind == "null" else v.col) for v in vals]
    return "any", [to_any(v) for v in vals]


def _if(c: Val, a: Val, b: Val) -> Val:
    kind, (x, y) = common([a, b])
    return Val(F.when(truthy(c), x).otherwise(y), kind)


def null_first(fn: Callable[..., Val], count: int | None) -> Callable[..., Val]:
    """Null in the first ``count`` arguments gives null."""

    def run(*args: Val) -> Val:
        checked = args if count is None else args[:count]
        if any(v.kind == "null" for v in checked):
            return literal(None)
        out = fn(*args)
        nulls = [is_null(v) for v in checked if not v.constant]
        return replace(out, col=F.when(~reduce(lambda a, b: a | b, nulls), out.col)) if nulls else out

    return run


@dataclass(frozen=True)
class Function:
    """A scalar function: builds a Val from Vals. ``nulls``: arguments whose null gives null (None: all, 0: none)."""

    build: Callable[..., Val]
    least: int
    most: int
    nulls: int | None = None


FUNCTIONS: dict[str, Function] = {
    "add": Function(_arithmetic("+"), 2, 2, 0),
    "sub": Function(_arithmetic("-"), 2, 2, 0),
    "mul": Function(_arithmetic("*"), 2, 2, 0),
    "div": Function(_arithmetic("/"), 2, 2, 0),
    "mod": Function(_arithmetic("%"), 2, 2, 0),
    "negate": Function(lambda a: Val(-number(a), "num"), 1, 1, 0),
    "bool": Function(lambda a: Val(truthy(a), "bool"), 1, 1),
    "number": Function(lambda a: Val(number(a), "num"), 1, 1, 0),
    "string": Function(string, 1, 1),
    "ref": Function(as_ref, 1, 1),
    "upper": Function(_case(F.upper), 1, 1),
    "lower": Function(_case(F.lower), 1, 1),
    "trim": Function(_strip("trim"), 1, 2, 1),
    "ltrim": Function(_strip("ltrim"), 1, 2, 1),
    "rtrim": Function(_strip("rtrim"), 1, 2, 1),
    "if": Function(_if, 3, 3, 0),
    "isref": Function(_is_ref, 1, 1, 0),
    "isbnode": Function(_is_bnode, 1, 1, 0),
}
OPERATORS = {"+": "add", "-": "sub", "*": "mul", "/": "div", "%": "mod"}


def finite(x: object) -> bool:
    return isinstance(x, (int, float)) and math.isfinite(x)
