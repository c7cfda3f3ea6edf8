"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field


class QueryError(ValueError):
    """A query that cannot be parsed or planned."""


class Node:
    """Base of all expression nodes."""


@dataclass(frozen=True)
class Lit(Node):
    value: object


@dataclass(frozen=True)
class RefLit(Node):
    uri: str


@dataclass(frozen=True)
class Bind(Node):
    name: str


@dataclass(frozen=True)
class Label(Node):
    """``?name``: the id of the objects of that label."""

    name: str


@dataclass(frozen=True)
class Prop(Node):
    """``[?label.]a.b.c``; path ('id',) is the object's id, ('*',) all of its properties."""

    path: tuple[str, ...]
    label: str | None = None
    quoted: bool = False

    @property
    def is_id(self) -> bool:
        return self.path == ("id",) and not self.quoted


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Op(Node):
    """op: and or not neg pos maybe = != < <= > >= + - * / % in notin."""

    op: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class FilterSet(Node):
    label: str | None
    where: Node | None


@dataclass
class Item:
    """One entry of a construct."""

    value: object  # Node or Construct
    name: object = None  # str, Node (computed name) or None
    force_list: bool = False
    maybe: bool = False
    omitnull: bool = False


@dataclass
class Construct:
    shape: str  # object, array, value
    items: list[Item] = field(default_factory=list)
    label: str | None = None
    where: Node | None = None
    group: Node | None = None
    order: list[tuple[Node, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    depth: int = 0
    mergeall: bool = False
    namemap: dict = field(default_factory=dict)


#: The aggregate functions of the language.
AGGREGATES = {"count", "sum", "total", "avg", "min", "max"}


def children(node) -> list:
    if isinstance(node, (Call, Op)):
        return list(node.args)
    if isinstance(node, FilterSet):
        return [node.where] if node.where is not None else []
    return []


def walk(node):
    """The node and all below it, not into constructs."""
    if node is None or isinstance(node, Construct):
        return
    yield node
    for c in children(node):
        yield from walk(c)


def conjuncts(node) -> list[Node]:
    if node is None:
        return []
    if isinstance(node, Op) and node.op == "and":
        return [x for a in node.args for x in conjuncts(a)]
    return [node]


def has_aggregate(node, extra: frozenset[str] = frozenset()) -> bool:
    return any(isinstance(n, Call) and (n.name in AGGREGATES or n.name in extra) for n in walk(node))
