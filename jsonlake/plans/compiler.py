"""From syntax tree to DataFrame.

1. Every property gets its label; labels that must be the same object are
   unified; each conjunct is local to a label, a join condition between labels,
   a semi/anti condition, or constant.
2. All properties of a label come from one source (star collapse): a projection
   of an entity table, or one conditional aggregation of the quads table.
3. Labels are joined along their conditions, equi conditions as join keys. A
   label without a link is reduced to one row first.
4. Grouping, aggregates, ordering, slicing and the construct are columns of the
   joined frame. Physical strategy is left to Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import Val
from ..operators.rangejoin import range_join
from .ast import AGGREGATES, Bind, Call, Construct, FilterSet, Item, Label, Lit, Node, Op, Prop, QueryError, RefLit, conjuncts, has_aggregate, walk
from .catalog import Catalog, EntityTable

#: Fixed value: ids of list resources start so.
LISTS = V.BNODE + "j:e:list:"
#: Objects of an unlinked label that one row may hold; more are refused with an error.
MOST_UNLINKED = 100_000


@dataclass
class Source:
    """All that a query wants from the objects of one label."""

    label: str
    props: dict[str, bool] = field(default_factory=dict)  # property -> must exist
    local: list[tuple[Node, bool]] = field(default_factory=list)  # predicate, maybe
    absent: list[str] = field(default_factory=list)
    semi: list[tuple[Node, FilterSet, bool]] = field(default_factory=list)
    table: str | None = None
    star: bool = False
    nested: bool = False
    optional: bool = False
    filtered: bool = False  # by anything but what its construct lists


@dataclass
class Cond:
    node: Node
    labels: frozenset[str]
    maybe: bool


@dataclass
class Field:
    """How a result column is rendered."""

    name: str | None
    column: str
    kind: str  # value, nested, star
    shape: str = "value"
    force_list: bool = False
    omitnull: bool = False
    many: bool = False
    value_kind: str = "any"
    listed: bool = False
    dynamic: str | None = None  # column with the computed name
    fields: list[Field] = field(default_factory=list)


@dataclass
class Compiled:
    df: DataFrame
    fields: list[Field]
    construct: Construct
    id_column: str | None = None


Getter = Callable[[str, str], Val]  # (label, property or 'id')


def any_of(tests: list[Callable[[Column], Column]]) -> Callable[[Column], Column]:
    return lambda x: reduce(lambda a, b: a | b, [t(x) for t in tests])


def key_of(kind: str, text: bool) -> Callable[[Column], Column]:
    """A value as a join key; as text where either side is an id or of mixed kinds."""
    if not text:
        return lambda x: x
    return (lambda x: x["s"]) if kind == "any" else (lambda x: x.cast("string"))


def same_as(v: Val, kind: str) -> Callable[[Column], Column]:
    return lambda y: F.coalesce(V.equal(v, Val(y, kind)), F.lit(False))


class Compiler:
    """Compiles one query against a catalog."""

    def __init__(self, spark: SparkSession, catalog: Catalog, binds: dict | None = None, functions: dict | None = None, aggregates: dict | None = None, grouped: bool = False, revisions: DataFrame | None = None):
        self.spark, self.catalog, self.binds = spark, catalog, binds or {}
        self.functions = {**V.FUNCTIONS, **(functions or {})}
        self.aggregates = aggregates or {}
        self.grouped = grouped  # collect joined objects per main object, as JSON results do
        self.revisions = revisions
        self.sources: dict[str, Source] = {}
        self.conds: list[Cond] = []
        self.constants: list[Node] = []
        self.alias: dict[str, str] = {}
        self.fresh = 0
        self.paths: dict[tuple[str, str, str], str] = {}
        self.label_of: dict[int, str] = {}
        self.follows: dict[Call, str] = {}
        self.prefixes: dict[str, str] = {}
        self.soft: set[tuple[str, str]] = set()

    # ---- analysis

    def new_label(self, tag: str = "") -> str:
        self.fresh += 1
        return f"${tag}{self.fresh}"

    def find(self, label: str) -> str:
        while label in self.alias:
            label = self.alias[label]
        return label

    def source(self, label: str) -> Source:
        label = self.find(label)
        if label not in self.sources:
            self.sources[label] = Source(label)
        return self.sources[label]

    def want(self, label: str, prop: str, must: bool, hard: bool = False) -> None:
        s = self.source(label)
        if must and not hard and (self.find(label), prop) in self.soft:
            must = False  # the construct says maybe: absent counts as null
        if prop == "*":
            s.star = True
        else:
            s.props[prop] = s.props.get(prop, False) or must

    def rename(self, prop: str) -> str:
        """Apply the namemap of the query: a name, or a prefix before a colon."""
        if prop in self.prefixes and isinstance(self.prefixes[prop], str):
            return self.prefixes[prop]
        for kind in ("sharedpatterns", "propertypatterns"):
            for k, v in (self.prefixes.get(kind) or {}).items():
                if prop.startswith(k):
                    return v + prop[len(k) :]
        for k, v in self.prefixes.items():
            if k.endswith(":") and isinstance(v, str) and prop.startswith(k):
                return v + prop[len(k) :]
        return prop

    def bound(self, node: Node, default: str, must: bool = True) -> Node:
        """The node with a label on every property; paths become joins. Wanted properties are recorded."""
        if isinstance(node, Prop):
            label = self.find(node.label or default)
            if node.is_id:
                self.source(label)
                return Label(label)
            path = list(node.path)
            while len(path) > 1:
                if path[1:] == ["id"]:
                    path = path[:1]
                    break
                label = self._hop(label, self.rename(path.pop(0)), must)
            prop = path[0] if path[0] == "*" else self.rename(path[0])
            self.want(label, prop, must and prop != "*")
            return Prop((prop,), label, True)
        if isinstance(node, RefLit):
            for kind in ("sharedpatterns", "idpatterns"):
                for k, v in (self.prefixes.get(kind) or {}).items():
                    if node.uri.startswith(k):
                        return RefLit(v + node.uri[len(k) :])
            return node
        if isinstance(node, Label):
            self.source(node.name)
            return Label(self.find(node.name))
        if isinstance(node, Bind):
            if node.name not in self.binds:
                raise QueryError(f"unbound variable :{node.name}")
            value = self.binds[node.name]
            if isinstance(value, str) and value.startswith("@"):
                return RefLit(value[1:])
            return Lit(tuple(value) if isinstance(value, list) else value)
        if isinstance(node, Call):
            if node.name in ("follow", "rfollow"):
                return self._follow(node, default)
            if node.name not in AGGREGATES and node.name not in self.aggregates and node.name not in self.functions and not node.name.startswith("getTransaction"):
                raise QueryError(f"unknown function {node.name}")
            if node.name in AGGREGATES or node.name in self.aggregates:
                return Call(node.name, tuple(a if isinstance(a, Prop) and a.path == ("*",) else self.bound(a, default, False) for a in node.args))
            return Call(node.name, tuple(self.bound(a, default, must) for a in node.args))
        if isinstance(node, Op):
            inner = must and node.op not in ("or", "maybe")
            return Op(node.op, tuple(self.bound(a, default, inner) for a in node.args))
        if isinstance(node, FilterSet):
            label = node.label or self.new_label("set")
            self._where(node.where, label)
            self.source(label).filtered = True
            return Label(self.find(label))
        return node

    def _hop(self, label: str, prop: str, must: bool) -> str:
        key = (label, prop, "in" if must else "maybe")
        if key not in self.paths:
            target = self.new_label("path")
            self.paths[key] = target
            self.want(label, prop, must)
            self.source(target).optional = not must
            t = self._named_table(label, prop)
            if t is not None:
                self.source(target).table = t
            self.conds.append(Cond(Op("=", (Prop((prop,), label, True), Label(target))), frozenset((label, target)), not must))
        return self.paths[key]

    def _named_table(self, label: str, prop: str) -> str | None:
        for t in self.catalog.tables.values():
            if prop in t.references:
                return t.references[prop]
        return None

    def _follow(self, node: Call, default: str) -> Node:
        if len(node.args) < 2 or not isinstance(node.args[1], Prop):
            raise QueryError(f"{node.name} needs a start and a property")
        start = self.bound(node.args[0], default)
        flags = [bool(a.value) if isinstance(a, Lit) else False for a in node.args[2:4]]
        return Call(node.name, (start, Prop((self.rename(node.args[1].path[-1]),), None, True), *(Lit(f) for f in flags)))

    def labels_in(self, node: Node) -> set[str]:
        out = set()
        for n in walk(node):
            if isinstance(n, Label):
                out.add(self.find(n.name))
            elif isinstance(n, Prop) and n.label is not None:
                out.add(self.find(n.label))
        return out

    def _unify(self, node, default: str) -> None:
        """Labels declared equal are one object."""
        for c in conjuncts(node):
            if isinstance(c, Op) and c.op == "=":
                pair = []
                for a in c.args:
                    if isinstance(a, Prop) and a.is_id:
                        pair.append(a.label or default)
                    elif isinstance(a, Label):
                        pair.append(a.name)
                if len(pair) == 2:
                    a, b = (self.find(x) for x in pair)
                    if a != b:
                        keep, drop = (a, b) if not a.startswith("$") or b.startswith("$") else (b, a)
                        if self.main in (a, b):
                            keep, drop = (self.main, b if a == self.main else a)
                        self.alias[drop] = keep

    def _where(self, node, default: str, nested: bool = False) -> None:
        self._unify(node, default)
        default = self.find(default)
        for c in conjuncts(node):
            self._conjunct(c, self.find(default))

    def _conjunct(self, c: Node, default: str) -> None:
        maybe = isinstance(c, Op) and c.op == "maybe"
        if maybe:
            c = c.args[0]
            if isinstance(c, Prop):
                self.bound(c, default, False)
                return
            if not isinstance(c, Op):
                raise QueryError("maybe needs a property or a comparison")
        while isinstance(c, Op) and c.op == "not" and isinstance(c.args[0], Op) and c.args[0].op == "not":
            c = c.args[0].args[0]
        if isinstance(c, FilterSet):
            label = c.label or self.new_label("set")
            self.source(label).filtered = True
            self._where(c.where, label)
            return
        if isinstance(c, Op) and c.op == "=" and len(c.args) == 2 and isinstance(c.args[0], Prop) and c.args[0].path == ("type",) and isinstance(c.args[1], (Lit, Bind)):
            value = c.args[1].value if isinstance(c.args[1], Lit) else self.binds.get(c.args[1].name)
            if isinstance(value, str) and value in self.catalog.tables and "type" not in self.catalog.tables[value].df.columns:
                self.source(c.args[0].label or default).table = value
                return
        if isinstance(c, Op) and c.op in ("in", "notin") and len(c.args) == 2 and isinstance(c.args[1], FilterSet):
            x = self.bound(c.args[0], default)
            labels = self.labels_in(x)
            if len(labels) != 1:
                raise QueryError("in {...} needs a property on its left")
            self.source(labels.pop()).semi.append((x, c.args[1], c.op == "in"))
            return
        if isinstance(c, Op) and c.op == "not" and isinstance(c.args[0], Prop) and not c.args[0].is_id and len(c.args[0].path) == 1:
            p = c.args[0]
            label = self.find(p.label or default)
            prop = self.rename(p.path[0])
            self.want(label, prop, False)
            self.source(label).absent.append(prop)
            return
        b = self.bound(c, default, not maybe and not (isinstance(c, Op) and c.op == "or") and not (isinstance(c, Op) and c.op == "not"))
        if isinstance(b, Prop):
            if not maybe:
                self.want(b.label or default, b.path[0], True, hard=True)
            return  # existence is recorded
        if isinstance(b, Op) and b.op == "=" and b.args[0] == b.args[1] and isinstance(b.args[0], (Label, Prop)):
            return  # a = a
        labels = self.labels_in(b)
        if isinstance(b, Label):
            return
        if len(labels) > 1:
            self.conds.append(Cond(b, frozenset(labels), maybe))
        elif labels:
            label = labels.pop()
            self.source(label).local.append((b, maybe))
            self.source(label).filtered = True
        else:
            self.constants.append(b)

    def _items(self, c: Construct, main: str) -> None:
        """Bind the values of a construct in place."""
        for item in c.items:
            if isinstance(item.value, Construct):
                inner = item.value
                own = inner.label or self.new_label("in")
                plain = inner.label is None and inner.where is None and inner.group is None  # the parent's own rows
                if plain:
                    own = main
                before = len(self.conds)
                if not plain:
                    self.source(own).nested = True
                    self.source(own).optional = item.maybe
                    self._where(inner.where, own)
                    for k in self.conds[before:]:
                        k.maybe = k.maybe or item.maybe
                    self.source(own).nested = True
                self.label_of[id(inner)] = own
                self._items(inner, own)
                if not plain and inner.group is not None:
                    raise QueryError("GROUP BY in a nested construct is not supported")
            else:
                shown = not item.maybe
                item.value = self.bound(item.value, main, shown and not has_aggregate(item.value, frozenset(self.aggregates)) and not (isinstance(item.value, Op) and item.value.op == "or"))
                if isinstance(item.value, Op) and item.value.op == "maybe":
                    item.value = item.value.args[0]
            if isinstance(item.name, Node):
                item.name = self.bound(item.name, main)

    # ---- sources

    def _absolute(self, s: Source, prop: str) -> str:
        return f"{s.label}|{prop}"

    def frame(self, s: Source) -> tuple[DataFrame, Getter]:
        """The objects of a label with all wanted properties, filtered by its local predicates."""
        props = set(s.props)
        table = self.catalog.table_of(props | ({"*"} if s.star else set()), s.table)
        return self._entity(s, table) if table is not None else self._quads(s)

    def _entity(self, s: Source, table: EntityTable) -> tuple[DataFrame, Getter]:
        df = table.df
        kinds = {f.name: f.dataType for f in df.schema.fields}
        missing = [p for p in s.props if p not in kinds]
        if any(s.props[p] for p in missing):
            raise QueryError(f"table {table.name} has no property {missing[0]}")
        names = list(df.columns) if s.star else [p for p in s.props if p in kinds]
        cols = {p: f"{s.label}|{p}" for p in names}
        id_name = f"{s.label}|id"
        chosen = [F.col(f"`{p}`").alias(cols[p]) for p in names]
        if table.id is not None:
            chosen.append(table.id_column().alias(id_name))
        df = df.select(*chosen)

        def get(label: str, prop: str) -> Val:
            if prop == "id":
                if table.id is None:
                    raise QueryError(f"table {table.name} has no id")
                return Val(F.col(f"`{id_name}`"), V.kind_of(df.schema[id_name].dataType))
            if prop not in cols:
                return V.literal(None)
            t = kinds[prop]
            if t.typeName() == "array":
                return Val(F.col(f"`{cols[prop]}`"), V.kind_of(t.elementType), True, prop=True)
            return Val(F.col(f"`{cols[prop]}`"), V.kind_of(t), prop=True)

        if table.null_means_absent:
            for p, must in s.props.items():
                if must and p in cols:
                    df = df.where(F.col(f"`{cols[p]}`").isNotNull())
            for p in s.absent:
                df = df.where(F.col(f"`{cols[p]}`").isNull()) if p in cols else df
        elif any(p in cols for p in s.absent):
            df = df.where(F.lit(False))
        for node, _ in s.local:
            df = df.where(self.condition(node, get))
        s.columns = names  # type: ignore[attr-defined]
        return self._semi(s, df, get), get

    def _quads(self, s: Source) -> tuple[DataFrame, Getter]:
        q = self.catalog.quads
        if q is None:
            raise QueryError(f"no table for {s.label}")
        names = sorted(s.props)
        id_name = f"{s.label}|id"
        element = F.struct(F.col("listpos").alias("pos"), F.when(F.col("ot") == V.NULL, F.lit(0)).when(F.col("ot").isin([*V.NUMERIC, V.BOOLEAN]), F.lit(1)).when(F.col("ot") == V.REF, F.lit(3)).otherwise(F.lit(2)).cast("tinyint").alias("r"), F.when(F.col("ot").isin(V.NUMERIC), F.col("o").try_cast("double")).when(F.col("ot") == V.BOOLEAN, F.when(F.col("o") == "true", 1.0).otherwise(0.0)).alias("n"), F.col("o").alias("s"), F.col("ot").alias("ot"))
        q = q.where(~F.col("s").startswith(LISTS))  # list resources are values, not objects
        if self.revisions is not None:
            # Each statement carries the commit of its last change.
            q = q.join(self.revisions, ["s", "p", "o", "ot", "c"], "left")
            element = element.withField("tx", F.col("tx"))
        rows = q if s.star else (q.where(F.col("p").isin(names)) if names and any(s.props.values()) else q)
        def get(label: str, prop: str) -> Val:
            if prop == "id":
                return Val(F.col(f"`{id_name}`"), "ref")
            return Val(F.col(f"`{s.label}|{prop}`"), "any", True, listed=True, prop=True)

        # Values that fail every test of a required property leave before the shuffle; who keeps none fails the tests below.
        for p, tests in self._needed(s, get).items():
            rows = rows.where((F.col("p") != p) | any_of(tests)(element))
        aggs = [F.sort_array(F.collect_list(F.when(F.col("p") == p, element))).alias(f"{s.label}|{p}") for p in names]
        if s.star:
            aggs.append(F.collect_list(F.struct(F.col("p").alias("p"), element.alias("v"))).alias(f"{s.label}|*"))
        if not aggs:
            df = rows.select(F.col("s").alias(id_name)).distinct()
        else:
            df = rows.groupBy(F.col("s").alias(id_name)).agg(*aggs)

        for p in names:
            if s.props[p]:
                df = df.where(F.size(f"`{s.label}|{p}`") > 0)
        for p in s.absent:
            df = df.where(F.size(f"`{s.label}|{p}`") == 0)
        # Values that a predicate on one property matches; several predicates add up.
        matched: dict[str, list[Callable[[Column], Column]]] = {}
        keep_all = {p for p in s.absent}
        for node, maybe in s.local:
            single = self._single(node)
            if single is None:
                df = df.where(self.condition(node, get))
                continue
            optional = not s.props.get(single, False)

            test = self._tester(node, single, get)

            arr = F.col(f"`{s.label}|{single}`")
            some = F.exists(arr, test)
            if optional:
                none = F.size(arr) == 0
                some = some | (none & test(V.to_any(V.literal(None))))
            df = df.where(some)
            matched.setdefault(single, []).append(test)
        df = self._semi(s, df, get)
        for p, tests in matched.items():
            if p not in keep_all and p not in self.bare.get(s.label, set()):
                df = df.withColumn(f"{s.label}|{p}", F.filter(F.col(f"`{s.label}|{p}`"), any_of(tests)))
        return df, get

    def _needed(self, s: Source, get: Getter) -> dict[str, list[Callable[[Column], Column]]]:
        """Tests by property where only values that pass one are ever looked at."""
        tests: dict[str, list[Callable[[Column], Column]]] = {}
        whole = set(s.absent) | self.bare.get(s.label, set()) | {n.path[0] for x, _, _ in s.semi for n in walk(x) if isinstance(n, Prop)}
        for node, _ in s.local:
            single = self._single(node)
            if single is None:
                whole |= {n.path[0] for n in walk(node) if isinstance(n, Prop)}
            elif s.props.get(single, False):
                tests.setdefault(single, []).append(self._tester(node, single, get))
            else:
                whole.add(single)
        return {} if s.star else {p: t for p, t in tests.items() if p not in whole}

    def _tester(self, node: Node, single: str, get: Getter) -> Callable[[Column], Column]:
        """A predicate on one value of the property ``single``."""

        def test(x: Column) -> Column:
            one = Val(x, "any", False, prop=True)
            return F.coalesce(V.holds(self.value(node, lambda lab, p: one if p == single else get(lab, p))), F.lit(False))

        return test

    def _single(self, node: Node) -> str | None:
        """The one property that a value predicate tests, if it tests just that."""
        props = {n.path[0] for n in walk(node) if isinstance(n, Prop)}
        if len(props) != 1 or any(isinstance(n, Label) for n in walk(node)) or any(isinstance(n, Op) and n.op in ("and", "or") for n in walk(node)):
            return None
        return props.pop()

    def _semi(self, s: Source, df: DataFrame, get: Getter) -> DataFrame:
        for x, fs, wanted in s.semi:
            inner = Compiler(self.spark, self.catalog, self.binds, self.functions, self.aggregates, revisions=self.revisions)
            inner.prefixes = self.prefixes
            label = fs.label or "$set"
            inner.main = label
            inner.bare = {}
            inner._where(fs.where, label)
            # What stands on the left is the id, or the key property that the set alone determines.
            left = self.value(x, get)
            src = inner.source(label)
            other, oget = inner.joined(inner.find(label))
            key = oget(inner.find(label), "id") if self._is_key(inner, src, oget) else None
            if key is None:
                raise QueryError("the set needs an id")
            right = other.select(key.col.alias("__set")).distinct()
            if left.many:
                exploded = df.select(F.col(f"`{s.label}|id`").alias("__obj"), F.explode(F.transform(left.col, lambda v: v["s"]) if left.kind == "any" else left.col).alias("__v"))
                hit = exploded.join(right, F.col("__v") == F.col("__set"), "left_semi").select("__obj").distinct()
                df = df.join(hit, F.col(f"`{s.label}|id`") == F.col("__obj"), "left_semi" if wanted else "left_anti")
            else:
                value = left.col["s"] if left.kind == "any" else left.col
                df = df.join(right, value == F.col("__set"), "left_semi" if wanted else "left_anti")
        return df

    @staticmethod
    def _is_key(inner: Compiler, src: Source, get: Getter) -> bool:
        try:
            get(src.label, "id")
        except QueryError:
            return False
        return True

    # ---- expressions

    def condition(self, node: Node, get: Getter) -> Column:
        """A predicate on an object: boolean connectives work on objects, comparisons on any of their values."""
        if isinstance(node, Op):
            if node.op == "and":
                return reduce(lambda a, b: a & b, [self.condition(a, get) for a in node.args])
            if node.op == "or":
                return reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), [self.condition(a, get) for a in node.args])
            if node.op == "not" and not (isinstance(node.args[0], Op) and node.args[0].op in ("=", "!=", "<", "<=", ">", ">=", "in", "notin")):
                return ~F.coalesce(self.condition(node.args[0], get), F.lit(False))
        if isinstance(node, Prop):
            v = get(node.label or "", node.path[0])
            return F.size(v.col) > 0 if v.many else v.col.isNotNull()
        if isinstance(node, Op) and node.op in ("in", "notin") and len(node.args) == 2 and isinstance(node.args[1], Call) and node.args[1].name in ("follow", "rfollow"):
            raise QueryError("in follow(...) is handled as a join")
        return V.holds(self.value(node, get))

    def value(self, node: Node, get: Getter) -> Val:
        if isinstance(node, Lit):
            return V.literal(list(node.value) if isinstance(node.value, tuple) else node.value)
        if isinstance(node, RefLit):
            return V.reference(node.uri)
        if isinstance(node, Label):
            return get(self.find(node.name), "id")
        if isinstance(node, Prop):
            return get(self.find(node.label or ""), node.path[0])
        twice = self._repeated(node)
        if twice:
            vals = {n: self.value(n, get) for n in twice}
            many = [n for n, v in vals.items() if v.many]
            if many:
                # A property that stands twice in an expression has one value at a time.
                def bound(*ones: Val) -> Val:
                    table = {(self.find(n.label or "") if isinstance(n, Prop) else self.find(n.name), n.path[0] if isinstance(n, Prop) else "id"): v for n, v in zip(many, ones, strict=True)}
                    return self.value(node, lambda lab, p: table[lab, p] if (lab, p) in table else get(lab, p))

                return V.lift(bound, [vals[n] for n in many])
        if isinstance(node, Call):
            if node in self.follows:
                return get(self.follows[node], "id")
            return self.call(node.name, [self.value(a, get) for a in node.args])
        if isinstance(node, Op):
            return self.op(node, get)
        raise QueryError(f"cannot evaluate {node}")

    @staticmethod
    def _repeated(node: Node) -> list[Node]:
        """Properties that stand more than once in an expression."""
        seen: dict[Node, int] = {}
        for n in walk(node):
            if isinstance(n, (Prop, Label)):
                seen[n] = seen.get(n, 0) + 1
        return [n for n, k in seen.items() if k > 1]

    def call(self, name: str, args: list[Val]) -> Val:
        f = self.functions[name]
        if not f.least <= len(args) <= f.most:
            raise QueryError(f"{name} takes {f.least} to {f.most} arguments")
        build = f.build if f.nulls == 0 else V.null_first(f.build, f.nulls)
        if name in ("add", "sub", "mul", "div", "mod", "negate", "number") and any(v.kind == "null" for v in args):
            return Val(F.lit(None).cast("double"), "num")
        return V.lift(build, args)

    def op(self, node: Op, get: Getter) -> Val:
        op = node.op
        if op in V.OPERATORS:
            return self.call(V.OPERATORS[op], [self.value(a, get) for a in node.args])
        if op == "neg":
            return self.call("negate", [self.value(node.args[0], get)])
        if op in ("pos", "maybe"):
            return self.value(node.args[0], get)
        if op == "not":
            inner = self.value(node.args[0], get)
            if inner.many and inner.prop:
                return Val(F.size(inner.col) == 0, "bool")
            return V.lift(lambda v: Val(~V.truthy(v), "bool"), [inner])
        if op in ("and", "or"):
            vals = [self.value(a, get) for a in node.args]

            def both(a: Val, b: Val) -> Val:
                if a.kind == b.kind == "bool":
                    return Val(V.truthy(a) & V.truthy(b) if op == "and" else V.truthy(a) | V.truthy(b), "bool")
                kind, (x, y) = V.common([a, b])
                if op == "or":
                    return Val(F.when(V.truthy(a), x).otherwise(y), kind)
                no = V.to_any(V.literal(False)) if kind == "any" else F.lit(False)
                if kind in ("any", "bool"):
                    return Val(F.when(V.truthy(a) & V.truthy(b), y).otherwise(no), kind)
                return Val(F.when(V.truthy(a) & V.truthy(b), V.to_any(b)).otherwise(V.to_any(V.literal(False))), "any")

            return reduce(lambda a, b: V.lift(both, [a, b]), vals)
        if op in ("=", "!="):
            a, b = (self.value(x, get) for x in node.args)
            typed = a.prop and b.constant or b.prop and a.constant
            if a.many and b.many and not a.constant and not b.constant and a.prop and b.prop:
                # Two lists are equal as sets, or one holds the other's single value.
                key = lambda x: F.struct(x["r"], x["n"], F.when(x["r"] != 1, x["s"])) if a.kind == "any" else x
                x, y = F.array_sort(F.transform(a.col, key)), F.array_sort(F.transform(b.col, key))
                same = F.when((F.size(x) == 1) | (F.size(y) == 1), F.arrays_overlap(x, y)).otherwise(x == y)
                return Val(same if op == "=" else ~same, "bool")

            def one(x: Val, y: Val) -> Val:
                same = V.equal(x, y, typed)
                if op == "=":
                    return Val(same, "bool")
                if x.kind not in ("any", "null") and y.kind not in ("any", "null") and x.kind == y.kind and not (x.constant and y.constant):
                    return Val(~x.col.eqNullSafe(y.col), "bool")
                return Val(~F.coalesce(same, F.lit(False)), "bool")

            return V.lift(one, [a, b])
        if op in ("<", "<=", ">", ">="):
            return V.lift(lambda x, y: Val(V.compare(op, x, y), "bool"), [self.value(x, get) for x in node.args])
        if op in ("in", "notin"):
            x = self.value(node.args[0], get)
            options: list[Val] = []
            for a in node.args[1:]:
                if isinstance(a, Lit) and isinstance(a.value, tuple):
                    options += [V.reference(v[1:]) if isinstance(v, str) and v.startswith("@") else V.literal(v) for v in a.value]
                else:
                    options.append(self.value(a, get))

            def member(v: Val) -> Val:
                plain = [o for o in options if o.constant and not o.many and o.kind == v.kind and o.kind in ("num", "str")]
                tests = [v.col.isin([o.literal for o in plain])] if plain else []
                for o in options:
                    if not any(o is k for k in plain):
                        tests.append(F.exists(o.col, same_as(v, o.kind)) if o.many else F.coalesce(V.equal(v, o), F.lit(False)))
                hit = reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
                return Val(hit if op == "in" else ~F.coalesce(hit, F.lit(False)), "bool")

            return V.lift(member, [x])
        raise QueryError(f"unknown operator {op}")

    # ---- joins

    def joined(self, root: str, wanted: set[str] | None = None) -> tuple[DataFrame, Getter]:
        """All labels joined, one row per combination. Labels not in ``wanted`` only filter."""
        df, get = self.frame(self.source(root))
        getters: dict[str, Getter] = {root: get}

        def pick(label: str, prop: str) -> Val:
            if label not in getters:
                raise QueryError(f"label ?{label} is not linked to the query")
            return getters[label](label, prop)

        waiting = [x for x in self.sources if x != root and x not in self.alias]
        conds = list(self.conds)
        self.cells: dict[str, DataFrame] = {}
        while waiting:
            # Inner joins before outer ones, keyed before unkeyed.
            ready = []
            for label in waiting:
                own = [c for c in conds if label in c.labels and c.labels - {label} <= set(getters)]
                if own:
                    s = self.source(label)
                    ready.append((s.optional or any(c.maybe for c in own), not any(self._equi(c, label) for c in own), len(ready), label, own))
            if not ready:
                break
            outer, _, _, label, own = min(ready)
            df = self._join(df, label, own, outer, getters, wanted, pick)
            waiting.remove(label)
            conds = [c for c in conds if c not in own]
        for c in list(conds):
            if c.labels <= set(getters):
                df = df.where(self.condition(c.node, pick))
                conds.remove(c)
        for label in waiting:  # no link: one row with all objects, or a test that there are any
            s = self.source(label)
            other, oget = self.frame(s)
            if wanted is None or label not in wanted:
                if s.filtered or s.props:
                    df = df.join(F.broadcast(other.limit(1).select(F.lit(1).alias("__any"))), how="cross").drop("__any")
                continue
            cell = f"{label}|cell"
            # One object more than may be gathered is enough to refuse; nothing is cut off.
            all_of = F.collect_list(F.struct(*[F.col(f"`{c}`").alias(c) for c in other.columns]))
            one = other.limit(MOST_UNLINKED + 1).agg(all_of.alias(cell))
            refuse = F.raise_error(F.lit(f"{label} is not linked and has more than {MOST_UNLINKED} objects: add a join condition"))
            one = one.withColumn(cell, F.when(F.size(f"`{cell}`") > MOST_UNLINKED, refuse).otherwise(F.col(f"`{cell}`")))
            if not s.optional:
                one = one.where(F.size(f"`{cell}`") > 0)
            df = df.join(F.broadcast(one), how="cross")
            getters[label] = self._cell_getter(cell, label, oget)
        if conds:
            raise QueryError("a join condition names labels that are not linked")
        return df, pick

    def _cell_getter(self, cell: str, label: str, inner: Getter) -> Getter:
        """Properties of all objects in an array cell."""

        def get(lab: str, prop: str) -> Val:
            v = inner(lab, prop)
            name = f"{label}|{prop}"
            col = F.transform(F.col(f"`{cell}`"), lambda x: x[name])
            return replace(v, col=F.flatten(col) if v.many else col, many=True, listed=False)

        return get

    def _equi(self, c: Cond, label: str) -> bool:
        n = c.node
        return isinstance(n, Op) and n.op == "=" and any(self.labels_in(a) == {label} and label not in self.labels_in(b) and self.labels_in(b) for a, b in (n.args, n.args[::-1]))

    def _join(self, df: DataFrame, label: str, own: list[Cond], outer: bool, getters: dict[str, Getter], wanted: set[str] | None, pick: Getter) -> DataFrame:
        other, oget = self.frame(self.source(label))
        both = dict(getters)
        both[label] = oget
        look: Getter = lambda lab, prop: both[lab](lab, prop)
        keys, rest, exploded = [], [], False
        for k, c in enumerate(own):
            if not self._equi(c, label):
                rest.append(self.condition(c.node, look))
                continue
            a, b = c.node.args
            mine, theirs = (a, b) if self.labels_in(a) == {label} else (b, a)
            lv, rv = self.value(theirs, pick), self.value(mine, oget)
            lk, rk = f"__l{k}", f"__r{k}"
            for v, name, left in ((lv, lk, True), (rv, rk, False)):
                text = lv.kind in ("any", "ref") or rv.kind in ("any", "ref")
                plain = key_of(v.kind, text)
                if v.many:
                    exploded = True
                    col = F.explode_outer(F.array_distinct(F.transform(v.col, plain)))
                else:
                    col = plain(v.col)
                if left:
                    df = df.withColumn(name, col)
                else:
                    other = other.withColumn(name, col)
            keys.append((lk, rk, c))
        on = [F.col(a) == F.col(b) for a, b, _ in keys] + rest
        cond = reduce(lambda a, b: a & b, on)
        used = wanted is None or label in wanted or any(label in c.labels for c in self.conds if c not in own)
        if not used and not outer:
            out = df.join(other, cond, "left_semi")
            out = out.drop(*[a for a, _, _ in keys])
            return out.dropDuplicates() if exploded else out
        bounds = None if outer else next((b for c in own if (b := self._bounds(c, label, pick, oget))), None)
        if bounds is not None:
            out = range_join(df, other, [(a, b) for a, b, _ in keys], *bounds, reduce(lambda a, b: a & b, rest))
        else:
            out = df.join(other, cond, "left" if outer else "inner").drop(*[x for a, b, _ in keys for x in (a, b)])
        getters[label] = oget
        return out.dropDuplicates() if exploded else out

    def _bounds(self, c: Cond, label: str, pick: Getter, oget: Getter) -> tuple[Column, Column, bool, bool] | None:
        """Low and high side of a comparison between a label and those before it, whether the label's is the high one, and whether equals are out."""
        n = c.node
        if not isinstance(n, Op) or n.op not in ("<", "<=", ">", ">="):
            return None
        low, high = n.args if n.op in ("<", "<=") else n.args[::-1]
        sides = [self.labels_in(x) for x in (low, high)]
        if {label} not in sides or not all(sides) or label in sides[0] & sides[1] or any(label in x and len(x) > 1 for x in sides):
            return None
        last = sides[1] == {label}
        lv, hv = (self.value(low, pick if last else oget), self.value(high, oget if last else pick))
        if lv.many or hv.many or lv.constant or hv.constant or lv.kind != hv.kind or lv.kind not in ("num", "str"):
            return None
        return lv.col, hv.col, last, n.op in ("<", ">")

    # ---- follow

    def _edges(self, prop: str) -> DataFrame:
        for t in self.catalog.tables.values():
            if prop in t.df.columns and t.id is not None:
                return t.df.select(t.id_column().cast("string").alias("src"), F.col(prop).cast("string").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
        if self.catalog.quads is None:
            raise QueryError(f"no references in {prop}")
        return self.catalog.quads.where((F.col("p") == prop) & (F.col("ot") == V.REF)).select(F.col("s").alias("src"), F.col("o").alias("dst"))

    def _reach(self, node: Call, starts: DataFrame | None) -> DataFrame:
        from ..operators.graph import follow

        start, prop, *flags = node.args
        exclude = bool(flags and flags[0].value)
        leaves = bool(len(flags) > 1 and flags[1].value)
        edges = self._edges(prop.path[0])
        if isinstance(start, (RefLit, Lit)):
            ids = [start.uri] if isinstance(start, RefLit) else list(start.value) if isinstance(start.value, tuple) else [start.value]
            starts = self.spark.createDataFrame([(str(i).removeprefix("@"),) for i in ids], "start string")
        elif starts is None:
            starts = edges.select(F.col("src").alias("start")).union(edges.select("dst")).distinct()
        return follow(edges, starts, reverse=node.name == "rfollow", exclude_start=exclude, leaves_only=leaves)

    def _attach_follows(self, df: DataFrame, get: Getter, nodes: list[Node], root: str) -> tuple[DataFrame, Getter]:
        """A column with the array of reached ids for every follow call; a call on a constant is one row."""
        extra: dict[Call, Val] = {}
        for k, call in enumerate(dict.fromkeys(n for x in nodes for n in walk(x) if isinstance(n, Call) and n.name in ("follow", "rfollow"))):
            name = f"__follow{k}"
            start = call.args[0]
            if isinstance(start, (RefLit, Lit)):
                one = self._reach(call, None).agg(F.sort_array(F.collect_set("node")).alias(name))
                df = df.join(F.broadcast(one), how="cross")
            else:
                v = self.value(start, get)
                key = v.col if not v.many else F.explode_outer(F.transform(v.col, key_of(v.kind, True)))
                df = df.withColumn("__start", (key["s"] if v.kind == "any" and not v.many else key).cast("string"))
                starts = df.select(F.col("__start").alias("start")).where("start IS NOT NULL").distinct()
                lists = self._reach(call, starts).groupBy("start").agg(F.sort_array(F.collect_set("node")).alias(name))
                df = df.join(lists, F.col("__start") == F.col("start"), "left").drop("start", "__start").withColumn(name, F.coalesce(F.col(name), F.array().cast("array<string>")))
            extra[call] = Val(F.col(name), "ref", True)
            self.follows[call] = name

        def look(label: str, prop: str) -> Val:
            for call, name in self.follows.items():
                if label == name and call in extra:
                    return extra[call]
            return get(label, prop)

        return df, look

    # ---- the query

    def compile(self, c: Construct) -> Compiled:
        self.prefixes = {k: v for k, v in c.namemap.items() if k not in ("id",)}
        self.main = c.label or "$main"
        self.bare: dict[str, set[str]] = {}
        for item in c.items:  # labels that nested constructs equate are known before any is bound
            if isinstance(item.value, Construct):
                item.value.label = item.value.label or self.new_label("in")
                plain = item.value.where is None and item.value.label.startswith("$in")
                if plain:
                    item.value.label = None
        self._unify(c.where, self.main)
        for item in c.items:
            if isinstance(item.value, Construct) and item.value.where is not None:
                self._unify(item.value.where, item.value.label)
        for x in conjuncts(c.where):
            if isinstance(x, Prop) and not x.is_id and len(x.path) == 1:
                self.bare.setdefault(self.find(x.label or self.main), set()).add(self.rename(x.path[0]))
        for item in c.items:
            if item.maybe and isinstance(item.value, Prop) and not item.value.is_id and len(item.value.path) == 1:
                self.soft.add((self.find(item.value.label or self.main), self.rename(item.value.path[0])))
        self._where(c.where, self.main)
        self._items(c, self.main)
        group = self.bound(c.group, self.main) if c.group is not None else None
        order = [(self.bound(k, self.main, False), down) for k, down in c.order]
        main = self.find(self.main)
        aggs = frozenset(self.aggregates)
        constant = main not in self.sources and not self.sources
        if constant:
            df, get = self.spark.range(1).select(F.lit(1).alias("__one")), lambda lab, prop: V.literal(None)
            for n in self.constants:
                df = df.where(self.condition(n, get))
        else:
            self.source(main)
            outputs = [i.value for i in c.items] + [i.name for i in c.items if isinstance(i.name, Node)] + [k for k, _ in order] + ([group] if group is not None else [])
            wanted = {main}
            for o in outputs:
                wanted |= self._labels_out(o)
            nodes = [o for o in outputs if isinstance(o, Node)]
            later = [n for s in self.sources.values() for n in s.local if any(isinstance(x, Call) and x.name in ("follow", "rfollow") for x in walk(n[0]))]
            for s in self.sources.values():
                s.local = [n for n in s.local if n not in later]
            ahead = [n for n in self.constants if any(isinstance(x, Call) and x.name in ("follow", "rfollow") for x in walk(n))]
            df, get = self.joined(main, wanted)
            if not hasattr(self.source(main), "columns"):  # embedded objects show inside their owners only
                df = df.where(~F.col(f"`{main}|id`").startswith(V.BNODE + "j:e:"))
            df, get = self._attach_follows(df, get, [*nodes, *[n for n, _ in later], *ahead], main)
            for n, _ in later:
                df = df.where(self.condition_follow(n, get))
            for n in self.constants:
                df = df.where(self.condition_follow(n, get) if n in ahead else self.condition(n, get))
            df, get = self._collect(df, get, main, wanted, c)
        if group is not None:
            return self._grouped(c, df, get, group, order, main)
        if any(not isinstance(i.value, Construct) and has_aggregate(i.value, aggs) for i in c.items):
            if all(not isinstance(i.value, Construct) and has_aggregate(i.value, aggs) for i in c.items):
                fields, cols = self._fields(c, lambda node: self.aggregated(node, get, None), get, main)
                return self._finish(c, df.agg(*cols), fields)
            parts = {}
            for i in c.items:
                for n in walk(i.value) if not isinstance(i.value, Construct) else ():
                    if isinstance(n, Call) and (n.name in AGGREGATES or n.name in aggs):
                        parts.setdefault(n, f"__agg{len(parts)}")
            vals = {n: self.aggregate(n, get, None) for n in parts}
            one = df.agg(*(vals[n].col.alias(name) for n, name in parts.items()))
            df = df.join(F.broadcast(one), how="cross")
            self.done = {n: replace(vals[n], col=F.col(name)) for n, name in parts.items()}
        df = self._ordered(df, get, order, c)
        fields, cols = self._fields(c, lambda node: self.plain(node, get), get, main)
        return self._finish(c, df.select(*cols), fields)

    def condition_follow(self, node: Node, get: Getter) -> Column:
        if isinstance(node, Op) and node.op in ("in", "notin") and len(node.args) == 2 and isinstance(node.args[1], Call):
            x, reach = self.value(node.args[0], get), self.value(node.args[1], get)
            text = lambda v: v["s"] if x.kind == "any" else v.cast("string")
            hit = F.arrays_overlap(F.transform(x.col, text), reach.col) if x.many else F.array_contains(reach.col, text(x.col))
            hit = F.coalesce(hit, F.lit(False))
            return hit if node.op == "in" else ~hit
        return self.condition(node, get)

    def plain(self, node: Node, get: Getter) -> Val:
        """A value in which finished aggregates stand for their calls."""
        done = getattr(self, "done", {})
        if node in done:
            return done[node]
        if isinstance(node, Op) and node.args and done:
            return self.op_over(node, lambda n: self.plain(n, get))
        return self.value(node, get)

    def op_over(self, node: Op, see: Callable[[Node], Val]) -> Val:
        """An operator over already evaluated operands."""
        names = {id(a): see(a) for a in node.args}
        marks = tuple(Label(f"__arg{k}") for k in range(len(node.args)))
        table = {m.name: names[id(a)] for m, a in zip(marks, node.args, strict=True)}
        return self.op(Op(node.op, marks), lambda lab, prop: table[lab])

    def _labels_out(self, o) -> set[str]:
        if isinstance(o, Construct):
            own = {self.find(self.label_of.get(id(o), self.main))}
            for i in o.items:
                own |= self._labels_out(i.value)
            return own
        return self.labels_in(o) if isinstance(o, Node) else set()

    def _collect(self, df: DataFrame, get: Getter, main: str, wanted: set[str], c: Construct) -> tuple[DataFrame, Getter]:
        """Gather joined labels as arrays of structs by main object, where the result wants lists."""
        flat = [x for x in wanted if x != main and x in self.sources and any(col.startswith(f"{x}|") and not col.endswith("|cell") for col in df.columns)]
        chosen = [x for x in flat if self.grouped or self.source(x).nested]
        if not chosen:
            return df, get
        cols = {x: [col for col in df.columns if col.startswith(f"{x}|")] for x in chosen}
        gone = {col for v in cols.values() for col in v}
        keys = [col for col in df.columns if col not in gone and any(col.startswith(f"{x}|") for x in [main, *flat]) or col.startswith("__follow") or col.endswith("|cell")]
        keys = [k for k in dict.fromkeys(keys) if k not in gone]
        some = lambda x: reduce(lambda a, b: a | b, [F.col(f"`{col}`").isNotNull() for col in cols[x]])
        aggs = [F.array_sort(F.array_distinct(F.collect_list(F.when(some(x), F.struct(*[F.col(f"`{col}`").alias(col) for col in cols[x]]))))).alias(f"{x}|cell") for x in chosen]
        out = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*aggs)
        cells = {x: self._cell_getter(f"{x}|cell", x, get) for x in chosen}
        return out, lambda lab, prop: cells[lab](lab, prop) if lab in cells else get(lab, prop)

    # ---- aggregates

    def aggregate(self, node: Call, get: Getter, key: Node | None) -> Val:
        """One aggregate call over the rows of a group. Many-valued arguments are folded within the row first."""
        name = node.name
        if name == "count" and (not node.args or isinstance(node.args[0], Prop) and node.args[0].path == ("*",) or node.args[0] == key):
            return Val(F.count(F.lit(1)), "num")
        v = self.value(node.args[0], get)
        if name in self.aggregates:
            arr = F.flatten(F.collect_list(F.filter(F.transform(v.col, lambda x: V.number(Val(x, v.kind))), lambda x: x.isNotNull()))) if v.many else F.collect_list(V.number(v))
            return Val(self.aggregates[name](arr), "num")
        one = (lambda x: Val(x, v.kind)) if v.many else None
        if name == "count":
            if v.many:
                return Val(F.sum(F.size(F.filter(v.col, lambda x: ~V.is_null(one(x))))), "num")
            return Val(F.count(F.when(~V.is_null(v), F.lit(1))), "num")
        if name in ("sum", "total", "avg"):
            num = (lambda w: w.col if w.kind == "num" else V.number(w))
            if v.many:
                arr = F.filter(F.transform(v.col, lambda x: num(one(x))), lambda x: x.isNotNull())
                zero = F.lit(0.0)
                row = F.when(F.size(arr) > 0, F.aggregate(F.transform(arr, lambda x: x.cast("double")), zero, lambda a, x: a + x))
                total, n = F.sum(row), F.sum(F.size(arr))
            else:
                total, n = F.sum(num(v)), F.count(num(v))
            if name == "sum":
                return Val(total, "num")
            if name == "total":
                return Val(F.coalesce(total.cast("double"), F.lit(0.0)), "num")
            return Val(F.coalesce(total.cast("double") / F.when(n != 0, n), F.lit(0.0)), "num")
        best = F.min if name == "min" else F.max
        if v.many:
            pick = F.array_min if name == "min" else F.array_max
            arr = F.filter(v.col, lambda x: ~V.is_null(one(x)))
            return Val(best(pick(F.transform(arr, lambda x: F.struct(x["r"].alias("r"), x["n"].alias("n"), x["s"].alias("s"), x["ot"].alias("ot")) if v.kind == "any" else x))), v.kind)
        return Val(best(v.col), v.kind)

    def aggregated(self, node: Node, get: Getter, key: Node | None) -> Val:
        """An expression whose leaves are aggregates and constants."""
        if isinstance(node, Call) and (node.name in AGGREGATES or node.name in self.aggregates):
            return self.aggregate(node, get, key)
        if isinstance(node, Op):
            return self.op_over(node, lambda n: self.aggregated(n, get, key))
        if isinstance(node, Call):
            return self.call(node.name, [self.aggregated(a, get, key) for a in node.args])
        return self.value(node, get)

    def _grouped(self, c: Construct, df: DataFrame, get: Getter, group: Node, order: list, main: str) -> Compiled:
        key = self.value(group, get)
        aggs = frozenset(self.aggregates)
        col = F.explode(F.transform(key.col, lambda x: F.struct(x["r"].alias("r"), x["n"].alias("n"), x["s"].alias("s"), x["ot"].alias("ot")) if key.kind == "any" else x)) if key.many else key.col
        df = df.withColumn("__key", col)
        got = Val(F.col("__key"), key.kind)

        def see(node: Node) -> Val:
            if node == group or node == Label(main):
                return got
            if has_aggregate(node, aggs):
                return self.aggregated(node, get, group)
            if not any(isinstance(n, (Prop, Label)) for n in walk(node)):
                return self.value(node, get)
            v = self.value(node, get)
            if v.many:
                return replace(v, col=F.flatten(F.collect_list(v.col)), many=True, listed=False)
            listed = V.to_any(v)
            return Val(F.transform(F.collect_list(F.struct(v.col.alias("v"))), lambda x: x["v"]), v.kind, True) if v.kind != "null" else Val(F.collect_list(listed), "any", True)

        fields, cols = self._fields(c, see, get, main, in_group=True)
        names = [f.column for f in fields]
        plain = []
        for f, x in zip(fields, cols, strict=False):
            plain.append(x)
        sort_cols = []
        for k, (node, down) in enumerate(order):
            v = see(node)
            sort_cols.append((f"__sort{k}", V.order_key(v), down))
        # The key and constants are no aggregates: they go in front of the grouping or after it.
        keyed, rest = [], []
        for item, f, x in zip(c.items, fields, cols[: len(fields)], strict=True):
            is_key = not isinstance(item.value, Construct) and (item.value == group or item.value == Label(main))
            const = not isinstance(item.value, Construct) and not any(isinstance(n, (Prop, Label, Call)) for n in walk(item.value))
            (keyed if is_key or const else rest).append((f.column, x))
        sort_keyed = [(n, col, down) for (n, col, down), (node, _) in zip(sort_cols, order, strict=True) if node == group or node == Label(main)]
        sort_rest = [x for x in sort_cols if x not in sort_keyed]
        aggs_ = [x for _, x in rest] + [col.alias(n) for n, col, _ in sort_rest]
        out = df.groupBy("__key").agg(*aggs_) if aggs_ else df.select("__key").distinct()
        out = out.select("*", *[x for _, x in keyed], *[col.alias(n) for n, col, _ in sort_keyed])
        if sort_cols:
            out = out.orderBy(*[F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, _, down in sort_cols])
        out = self._slice(out, c)
        return self._finish(c, out.select(*[F.col(f"`{n}`") for n in names]), fields, sliced=True)

    def _ordered(self, df: DataFrame, get: Getter, order: list, c: Construct) -> DataFrame:
        if order:
            keys = [V.order_key(self.plain(node, get)) for node, _ in order]
            df = df.orderBy(*[k.desc_nulls_last() if down else k.asc_nulls_first() for k, (_, down) in zip(keys, order, strict=True)])
        return self._slice(df, c)

    @staticmethod
    def _slice(df: DataFrame, c: Construct) -> DataFrame:
        if c.offset:
            df = df.offset(c.offset)
        return df if c.limit is None else df.limit(c.limit)

    # ---- output

    def _fields(self, c: Construct, see: Callable[[Node], Val], get: Getter, main: str, in_group: bool = False) -> tuple[list[Field], list[Column]]:
        fields, cols = [], []
        for k, item in enumerate(c.items):
            name = item.name if isinstance(item.name, str) else None
            column = name if name is not None and c.shape == "object" else "value" if c.shape == "value" else f"_{k + 1}"
            if column in [f.column for f in fields]:
                column = f"{column}_{k + 1}"
            f = Field(name, column, "value", c.shape, item.force_list, item.omitnull)
            if isinstance(item.value, Construct):
                f.kind = "nested"
                label = self.find(self.label_of[id(item.value)])
                f.shape = item.value.shape
                f.fields, inner = self._nested(item.value, label, get, main)
                f.many = label != main
                cols.append(inner.alias(column))
            elif isinstance(item.value, Prop) and item.value.path == ("*",):
                f.kind = "star"
                f.column = column = column if name else f"*{k + 1}"
                v = self._star(self.find(item.value.label or main), f)
                cols.append(v.alias(f.column))
            else:
                v = see(item.value)
                f.many, f.value_kind, f.listed = v.many, v.kind, v.listed
                cols.append(v.col.alias(column))
            if isinstance(item.name, Node):
                f.dynamic = f"__name{k}"
                cols.append(V.string(see(item.name)).col.alias(f.dynamic) if not see(item.name).many else V.string(Val(F.element_at(see(item.name).col, 1), see(item.name).kind)).col.alias(f.dynamic))
            fields.append(f)
        if c.shape == "object" and any(f.kind == "star" for f in fields) and not in_group:
            cols.append(get(main, "id").col.alias("__id") if self._has_id(get, main) else F.lit(None).cast("string").alias("__id"))
        return fields, cols

    @staticmethod
    def _has_id(get: Getter, main: str) -> bool:
        try:
            get(main, "id")
            return True
        except QueryError:
            return False

    def _star(self, label: str, f: Field) -> Column:
        s = self.source(label)
        if hasattr(s, "columns"):
            f.value_kind = "struct"
            return F.struct(*[F.col(f"`{s.label}|{p}`").alias(p) for p in s.columns])
        f.value_kind = "quads"
        return F.col(f"`{s.label}|*`")

    def _nested(self, c: Construct, label: str, get: Getter, main: str) -> tuple[list[Field], Column]:
        """A struct of the construct's items, or an array of them where the label was gathered in a cell."""
        if label == main:
            fields, cols = self._fields(c, lambda n: self.value(n, get), get, label)
            return fields, F.struct(*cols) if cols else F.struct(F.lit(None).alias("none"))
        cell = f"{label}|cell"
        holder: list = []

        def element(x: Column) -> Column:
            def inner(lab: str, prop: str) -> Val:
                if lab != label:
                    return get(lab, prop)
                base = self._element_val(label, prop, get)
                return replace(base, col=x[f"{label}|{prop}"])

            fields, cols = self._fields_in(c, inner, label, x)
            holder.append(fields)
            return F.struct(*cols) if cols else F.struct(F.lit(None).alias("none"))

        rows = F.col(f"`{cell}`")
        if c.order:
            key, down = self.bound(c.order[0][0], label, False), c.order[0][1]
            name = f"{label}|{key.path[0]}" if isinstance(key, Prop) else f"{label}|id"
            rows = F.transform(F.sort_array(F.transform(rows, lambda x: F.struct(x[name].alias("k"), x.alias("x"))), not down), lambda x: x["x"])
        if c.limit is not None or c.offset:
            rows = F.slice(rows, (c.offset or 0) + 1, c.limit if c.limit is not None else 1 << 30)
        col = F.transform(rows, element)
        return holder[0], col

    def _element_val(self, label: str, prop: str, get: Getter) -> Val:
        v = get(label, prop)
        s = self.source(label)
        many = not hasattr(s, "columns") and prop != "id"
        return replace(v, many=many, listed=many, prop=True)

    def _fields_in(self, c: Construct, get: Getter, label: str, x: Column) -> tuple[list[Field], list[Column]]:
        fields, cols = [], []
        for k, item in enumerate(c.items):
            name = item.name if isinstance(item.name, str) else None
            f = Field(name, f"_{k + 1}" if name is None else name, "value", c.shape, item.force_list, item.omitnull)
            if isinstance(item.value, Construct):
                f.kind, f.shape, f.many = "nested", item.value.shape, self.find(self.label_of[id(item.value)]) not in (label,)
                f.fields, col = self._nested(item.value, self.find(self.label_of[id(item.value)]), get, label)
            elif isinstance(item.value, Prop) and item.value.path == ("*",):
                s = self.source(label)
                f.kind, f.value_kind = "star", "struct" if hasattr(s, "columns") else "quads"
                col = F.struct(*[x[f"{label}|{p}"].alias(p) for p in s.columns]) if hasattr(s, "columns") else x[f"{label}|*"]
                f.column = f"*{k + 1}"
                cols.append(x[f"{label}|id"].alias("__id"))
            else:
                v = self.value(item.value, get)
                f.many, f.value_kind, f.listed = v.many, v.kind, v.listed
                col = v.col
            cols.append(col.alias(f.column))
            fields.append(f)
        return fields, cols

    def _finish(self, c: Construct, df: DataFrame, fields: list[Field], sliced: bool = False) -> Compiled:
        return Compiled(df, fields, c, "__id" if "__id" in df.columns else None)


def compile_query(spark: SparkSession, catalog: Catalog, construct: Construct, **how) -> Compiled:
    return Compiler(spark, catalog, **how).compile(construct)


__all__ = ["Compiled", "Compiler", "Field", "Item", "compile_query"]
