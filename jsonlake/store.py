"""The public store: query, write, history."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values as V
from .functions.values import BNODE, REF, Function, Val
from .operators.sets import QUAD, union, without
from .plans.ast import Construct, QueryError
from .plans.catalog import Catalog, EntityTable
from .plans.compiler import Compiled, Compiler
from .plans.parser import parse
from .render import EMBEDDED, Renderer
from .sources import formats
from .sources.docjson import QUADS, DocReader, to_quads
from .sources.files import stored, work_dir
from .streaming.history import History, changes_after, last_revision

#: Revision functions of the language: field of a commit, kind of its value.
REVISION_FUNCTIONS = {"getTransactionId": ("rev", "str"), "getTransactionTime": ("at", "num"), "getTransactionAuthor": ("author", "str"), "getTransactionComment": ("comment", "str")}


class Store:
    """Objects of entity tables and of a quads table, behind one query language.

    Entity tables are read only. Writes go to the quads; each write makes a delta and
    replaces the snapshot (a Parquet folder below ``folder``, or a plan in memory).
    """

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, tables: dict[str, EntityTable] | None = None, folder: str | None = None, history: History | None = None, read_only: list[DataFrame] | None = None):
        self.spark = spark
        self.catalog = Catalog(dict(tables or {}), quads)
        self.folder, self.history = folder, history
        self.read_only = read_only or []  # more quads tables that are read with this one
        self.functions: dict[str, Function] = {}
        self.aggregates: dict[str, Callable[[Column], Column]] = {}
        self.hooks: dict[str, list[Callable]] = {k: [] for k in ("before-add", "before-remove", "before-new", "before-commit", "finalize-commit", "after-commit", "after-abort")}
        self._batch: list | None = None

    # -- making stores

    @classmethod
    def from_json(cls, spark: SparkSession, doc, namemap: dict | None = None, **how) -> Store:
        """A store in memory from a JSON document (text or values)."""
        if isinstance(doc, str):
            doc = json.loads(doc)
        rows = DocReader(namemap).quads(doc)
        return cls(spark, spark.createDataFrame(rows, QUADS), **how)

    @classmethod
    def from_tables(cls, spark: SparkSession, tables: dict[str, DataFrame], ids: dict[str, str | Column] | None = None, references: dict[str, dict[str, str]] | None = None, null_means_absent: bool = False) -> Store:
        ids, references = ids or {}, references or {}
        return cls(spark, None, {n: EntityTable(n, df, ids.get(n), null_means_absent, references.get(n, {})) for n, df in tables.items()})

    @classmethod
    def open(cls, spark: SparkSession, url: str, **how) -> Store:
        """``mem:`` (empty), or a folder or file of quads: a snapshot folder of this library, or any format with a reader."""
        if url.startswith("mem:"):
            return cls(spark, spark.createDataFrame([], QUADS), **how)
        path = url.removeprefix("file://") if url.startswith("file:///") else url
        pointer = cls._pointer(spark, path)
        if pointer is not None:
            return cls(spark, spark.read.schema(QUADS).parquet(f"{path}/{pointer}"), folder=path, **how)
        if formats.format_of(path) != "ntriples" or path.endswith(".nt"):
            return cls(spark, formats.read(spark, path), **how)
        return cls(spark, spark.createDataFrame([], QUADS), folder=path, **how)

    @staticmethod
    def _pointers(spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []
        return fs, [n for n in names if n[:1].isdigit()]

    @classmethod
    def _pointer(cls, spark: SparkSession, folder: str) -> str | None:
        """The snapshot that the last pointer names. Pointers are only added, so a crash leaves the one before."""
        _, names = cls._pointers(spark, folder)
        return names[-1].split("_", 1)[1] if names else None

    def _point(self, snapshot: str) -> None:
        """Add a pointer: an empty file whose name is a number and the snapshot, made in one step."""
        fs, names = self._pointers(self.spark, self.folder)
        number = int(names[-1].split("_", 1)[0]) + 1 if names else 0
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/CURRENT/{number:012d}_{snapshot}")
        fs.create(path, False).close()

    def with_history(self, folder: str, branch: str = "A") -> Store:
        self.history = History(self.spark, folder, branch)
        return self

    # -- reading

    @property
    def quads(self) -> DataFrame:
        base = self.catalog.quads if self.catalog.quads is not None else self.spark.createDataFrame([], QUADS)
        return union(base, *self.read_only) if self.read_only else base

    def _compile(self, query: str | Construct, binds: dict | None, grouped: bool) -> Compiled:
        tree = parse(query) if isinstance(query, str) else query
        catalog = Catalog(self.catalog.tables, self.quads if self.catalog.quads is not None or self.read_only else None)
        functions = {**self.functions, **self._revision_functions()}
        asked = any(name in repr(tree) for name in REVISION_FUNCTIONS)
        return Compiler(self.spark, catalog, binds, functions, self.aggregates, grouped, self._statement_revisions() if asked else None).compile(tree)

    def query_df(self, query: str, binds: dict | None = None, grouped: bool | None = None) -> DataFrame:
        """The result as a distributed DataFrame. Joined objects give a row each unless ``grouped``."""
        got = self._compile(query, binds, self.catalog.quads is not None if grouped is None else grouped)
        df = got.df
        c = got.construct
        if c.shape == "object" and c.mergeall:
            pairs = [F.struct((F.col(f.dynamic) if f.dynamic else F.lit(f.name)).alias("k"), F.col(f"`{f.column}`").cast("string").alias("v")) for f in got.fields]
            rows = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.k", "x.v").where("k IS NOT NULL")
            merged = rows.groupBy("k").agg(F.max("v").alias("v"))
            return merged.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("merged"))
        for f in got.fields:
            if f.kind == "star" and f.value_kind == "struct" and f.name is None:
                others = [x for x in df.columns if x not in (f.column, "__id")]
                df = df.select(*[F.col(f"`{x}`") for x in others], F.col(f"`{f.column}`.*"), *([F.col("__id").alias("id")] if "__id" in df.columns and "id" not in others else []))
            if f.dynamic:
                df = df.withColumn(f.column, F.map_from_arrays(F.array(f.dynamic), F.array(F.col(f"`{f.column}`")))).drop(f.dynamic)
        return df.drop("__id")

    def query(self, query: str, binds: dict | None = None, explain: bool = False, for_update: bool = False, capture_errors: bool = False, debug: bool = False):
        """The result as JSON values on the driver; with ``explain``, ``debug`` or ``capture_errors`` a response with its parts."""
        began = time.process_time()
        response: dict = {"errors": []}
        try:
            tree = parse(query)
            got = self._compile(tree, binds, True)
            if explain:
                response["explain"] = got.df._jdf.queryExecution().toString()
            if debug:
                response["ast"] = repr(tree)
            rows = got.df.collect()
            names = tree.namemap
            objects = self._objects(got, rows, tree.depth)
            results = Renderer(got, objects, for_update, tree.depth, names).rows(rows)
        except QueryError as e:
            if not capture_errors:
                raise
            response["errors"].append(str(e))
            results = []
        if not (explain or capture_errors or debug):
            return results
        return response | {"results": results, "elapsed": time.process_time() - began}

    def _objects(self, got: Compiled, rows: list, depth: int) -> dict:
        """Objects that results embed or, up to ``depth``, refer to: one semi-join a level."""
        if self.catalog.quads is None:
            return {}
        found: dict[str, dict[str, list]] = {}

        def refs(v):
            if v is None:
                return
            if hasattr(v, "__fields__"):
                d = v.asDict()
                if "ot" in d:
                    if d["ot"] == REF:
                        yield d["s"]
                else:
                    for x in d.values():
                        yield from refs(x)
            elif isinstance(v, list):
                for x in v:
                    yield from refs(x)
            elif isinstance(v, str) and v.startswith(EMBEDDED):
                yield v

        level = {r for row in rows for r in refs(row)}
        left = depth
        while True:
            wanted = sorted(u for u in level if u not in found and (u.startswith(EMBEDDED) or left > 0))
            if not wanted:
                return found
            if not any(u.startswith(EMBEDDED) for u in wanted) or left > 0:
                left -= 1
            ids = self.spark.createDataFrame([(u,) for u in wanted], "s string")
            element = F.struct(F.col("listpos").alias("pos"), F.lit(0).alias("r"), F.col("o").alias("s"), F.col("ot").alias("ot"))
            got_rows = self.quads.join(F.broadcast(ids), "s", "left_semi").groupBy("s", "p").agg(F.sort_array(F.collect_list(element)).alias("v")).orderBy("s", "p").collect()
            level = set()
            for r in got_rows:
                found.setdefault(r.s, {})[r.p] = r.v
                level |= {x.s for x in r.v if x.ot == REF}

    # -- functions

    def register_function(self, name: str, build: Callable[..., Column] | None = None, kind: str = "num", udf: Callable | None = None, least: int = 1, most: int | None = None, nulls: int | None = None) -> None:
        """A scalar function: ``build`` makes a Column from Columns, or ``udf`` is a Spark UDF called on them.

        The kind tells what comes out: num, str, bool or ref. Names may have a namespace (``ns:name``).
        """
        make = build or udf
        if make is None:
            raise ValueError("give build or udf")

        def run(*args: Val) -> Val:
            cols = [V.number(a) if a.kind == "any" and kind == "num" else a.col["s"] if a.kind == "any" else a.col for a in args]
            return Val(make(*cols), kind)

        self.functions[name] = Function(run, least, most if most is not None else max(least, 8), nulls)

    def register_aggregate(self, name: str, fold: Callable[[Column], Column]) -> None:
        """An aggregate: ``fold`` makes the result from a group's array of numbers."""
        self.aggregates[name] = fold

    def register_fold(self, name: str, initial: float, step: Callable[[Column, Column], Column], final: Callable[[Column], Column] | None = None) -> None:
        """An aggregate from an initial value, a step and a final function."""
        self.aggregates[name] = lambda arr: F.aggregate(F.filter(arr, lambda x: x.isNotNull()), F.lit(initial).cast("double"), step, final or (lambda x: x))

    def _revision_functions(self) -> dict[str, Function]:
        """Metadata of the last commit of the statement behind a property; null without history."""
        out = {}
        for name, (field, kind) in REVISION_FUNCTIONS.items():

            def look(v: Val, field=field, kind=kind) -> Val:
                known = self.history is not None and self.history.tip and v.kind == "any" and v.prop
                return Val(v.col["tx"][field] if known else F.lit(None).cast("double" if kind == "num" else "string"), kind)

            out[name] = Function(look, 1, 1, 0)
        return out

    def _statement_revisions(self) -> DataFrame | None:
        """s, p, o, ot, c, tx: the commit that changed a statement last."""
        h = self.history
        if h is None or not h.tip:
            return None
        rows = last_revision(h.changes(), h.order()).join(h.revisions(), "rev")
        return rows.select(*QUAD, F.struct("rev", "at", "author", "comment").alias("tx"))

    # -- writing

    def _delta(self, data) -> DataFrame:
        if isinstance(data, DataFrame):
            return data.select(*QUAD, "listpos")
        return to_quads(self.spark, data)

    def _fire(self, hook: str, *args) -> None:
        for f in self.hooks[hook]:
            f(*args)

    def _apply(self, added: DataFrame | None, removed: DataFrame | None, author: str = "", comment: str = "") -> tuple[DataFrame | None, DataFrame | None]:
        """One write: removed first, then added; kept together in a batch, else committed."""
        base = self.quads
        if removed is not None:
            self._fire("before-remove", removed)
            base = without(base, removed, QUAD)
        if added is not None:
            self._fire("before-add", added)
            added = without(added, base, QUAD) if base is not None else added
            base = base.unionByName(added)
        if self._batch is not None:
            self._batch.append((added, removed))
            self.catalog.quads = base
            return added, removed
        self._commit(base, added, removed, author, comment)
        return added, removed

    def _commit(self, state: DataFrame, added: DataFrame | None, removed: DataFrame | None, author: str, comment: str, logged: bool = False) -> None:
        """Make a state the store's; ``logged``: the history has its changes already."""
        self._fire("before-commit", added, removed)
        folder = self.folder or work_dir(self.spark, "store")
        name = f"snapshot-{uuid.uuid4().hex[:12]}"
        # A snapshot sorted by property prunes scans of one property; the pointer names it once it is whole.
        fresh = stored(state.select(*QUAD, "listpos").repartitionByRange("p", "s").sortWithinPartitions("p", "s", "o"), f"{folder}/{name}")
        if self.history is not None and not logged:
            self.history.commit(added, removed, author, comment)
        self._fire("finalize-commit", added, removed)
        if self.folder is not None:
            self._point(name)
        self.catalog.quads = fresh
        self._fire("after-commit", added, removed)

    def add(self, data, **meta):
        """Add statements that are not there yet."""
        return self._apply(self._delta(data), None, **meta)

    def create(self, data, **meta):
        """Add objects; an id that exists is an error."""
        delta = self._delta(data)
        clash = delta.select("s").distinct().join(self.quads.select("s"), "s", "left_semi").limit(1).collect()
        if clash:
            raise ValueError(f"{clash[0].s} already exists")
        self._fire("before-new", delta)
        return self._apply(delta, None, **meta)

    def _embedded_below(self, removed: DataFrame) -> DataFrame:
        """The statements of embedded objects that go with their parents."""
        quads, out, frontier = self.quads, removed, removed
        for _ in range(64):
            below = frontier.where((F.col("ot") == REF) & F.col("o").startswith(EMBEDDED)).select(F.col("o").alias("s")).distinct()
            frontier = quads.join(below, "s", "left_semi").select(*QUAD, "listpos")
            if frontier.isEmpty():
                return out
            out = out.unionByName(frontier)
        return out

    def _keep_identity(self, delta: DataFrame, old: DataFrame) -> DataFrame:
        """Give a new embedded object the id of the one it replaces, by owner and property."""
        is_inner = (F.col("ot") == REF) & F.col("o").startswith(EMBEDDED + "object:")
        key = F.element_at(F.coalesce("listpos", F.array(F.lit(0))), 1).alias("k")
        fresh = delta.where(is_inner).select("s", "p", key, F.col("o").alias("__new"))
        before = old.where(is_inner).select("s", "p", key, F.col("o").alias("__old"))
        names = fresh.join(before, ["s", "p", "k"]).select("__new", "__old").dropDuplicates(["__new"])
        out = delta.join(F.broadcast(names), F.col("s") == F.col("__new"), "left").withColumn("s", F.coalesce("__old", "s")).drop("__new", "__old")
        return out.join(F.broadcast(names), (F.col("o") == F.col("__new")) & (F.col("ot") == REF), "left").withColumn("o", F.coalesce("__old", "o")).select(*QUAD, "listpos")

    def update(self, data, **meta):
        """Per object and property, replace the old values by the new ones."""
        return self.update_all(update=data, **meta)

    def replace(self, data, **meta):
        """Replace all properties of the objects; an object without properties is deleted."""
        return self.update_all(replace=data, **meta)

    def remove(self, data, **meta):
        """An id removes the object, a value that value, a null all values of the property."""
        return self.update_all(removed=data, **meta)

    def update_all(self, update=None, replace=None, removed=None, **meta):
        """Update, replace and remove as one write; returns (added, removed)."""
        quads = self.quads
        gone: list[DataFrame] = []
        adds: list[DataFrame] = []
        if update is not None:
            delta = self._delta(update)
            inner = delta.where(F.col("s").startswith(EMBEDDED)).select("s").distinct()
            touched = delta.join(inner, "s", "left_anti").select("s", "p").distinct()
            old = quads.join(touched, ["s", "p"], "left_semi").select(*QUAD, "listpos")
            gone.append(self._embedded_below(old))
            adds.append(self._keep_identity(delta, old))
        if replace is not None:
            delta = self._delta(replace)
            ids = [str(x["id"]).removeprefix("@") for x in (replace if isinstance(replace, list) else [replace]) if isinstance(x, dict) and "id" in x] if not isinstance(replace, DataFrame) else []
            subjects = delta.where(~F.col("s").startswith(BNODE)).select("s").union(self.spark.createDataFrame([(i,) for i in ids], "s string")).distinct()
            old = quads.join(subjects, "s", "left_semi").select(*QUAD, "listpos")
            gone.append(self._embedded_below(old))
            adds.append(self._keep_identity(delta, old))
        if removed is not None:
            if isinstance(removed, DataFrame):
                gone.append(removed.select(*QUAD, F.lit(None).cast("array<int>").alias("listpos")))
            else:
                gone.append(self._embedded_below(self._removals(removed)))
        out = reduce(lambda a, b: a.unionByName(b), gone) if gone else None
        new = reduce(lambda a, b: a.unionByName(b), adds) if adds else None
        return self._apply(new, out, **meta)

    def _removals(self, data) -> DataFrame:
        quads = self.quads
        parts = []
        ids, props, values = [], [], []
        for x in data if isinstance(data, list) else [data]:
            if isinstance(x, str):
                ids.append((x.removeprefix("@"),))
                continue
            body = {k: v for k, v in x.items() if k != "id"}
            sid = str(x["id"]).removeprefix("@")
            if not body:
                ids.append((sid,))
            for p, v in body.items():
                if v is None:
                    props.append((sid, p))
                else:
                    values.append({"id": sid, p: v})
        if ids:
            parts.append(quads.join(self.spark.createDataFrame(ids, "s string"), "s", "left_semi").select(*QUAD, "listpos"))
        if props:
            parts.append(quads.join(self.spark.createDataFrame(props, "s string, p string"), ["s", "p"], "left_semi").select(*QUAD, "listpos"))
        for v in values:
            want = to_quads(self.spark, v, check_ids=False)
            parts.append(quads.join(want.select("s", "p", "o", "ot"), ["s", "p", "o", "ot"], "left_semi").select(*QUAD, "listpos"))
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else self.spark.createDataFrame([], QUADS)

    @contextmanager
    def batch(self, author: str = "", comment: str = ""):
        """Several writes as one commit; readers inside see them, an error undoes them."""
        before = self.catalog.quads
        self._batch = []
        try:
            yield self
            writes, self._batch = self._batch, None
            if writes:
                state = self.quads
                added = [a for a, _ in writes if a is not None]
                removed = [r for _, r in writes if r is not None]
                join = lambda parts: reduce(lambda a, b: a.unionByName(b), parts) if parts else None
                self._commit(state, join(added), join(removed), author, comment)
        except BaseException:
            self._batch, self.catalog.quads = None, before
            self._fire("after-abort")
            raise

    def merge(self, changeset: dict) -> bool:
        """Apply a changeset of another branch to the history and to this store."""
        if self.history is None:
            raise ValueError("merge needs a history")
        before = self.history.tip
        done = self.history.merge(changeset)
        if done:
            # What this and the changesets that waited for it changed; data that the history never held stays.
            net = changes_after(self.history.changes(), self.history.order(), before)
            added, removed = (net.where(F.col("op") == op).select(*QUAD, "listpos") for op in ("add", "del"))
            rest = without(self.quads, removed, QUAD)
            self._commit(rest.unionByName(without(added, rest, QUAD)), added, removed, "", "", logged=True)
        return done

    def dump(self, path: str, form: str | None = None, mode: str = "errorifexists") -> None:
        """Write all statements in a text format."""
        formats.write(self.quads, path, form, mode)

    def mirror(self, *others: Store) -> None:
        """Repeat every commit of this store in other stores, which are read on their own."""

        def repeat(added: DataFrame | None, removed: DataFrame | None) -> None:
            for o in others:
                o._apply(added, removed)

        self.hooks["finalize-commit"].append(repeat)

    def view(self, condition: Column) -> Store:
        """A store that sees the statements under a condition and writes through to this one."""
        out = Store(self.spark, self.quads.where(condition))
        out.hooks["before-commit"].append(lambda added, removed: self._apply(added, removed))
        return out

    def log_lines(self, rev: str) -> DataFrame:
        """A commit as N-Triples lines, removals marked."""
        rows = self.history.changes().where(F.col("rev") == rev).orderBy("op", "s", "p")
        return formats.ntriples_lines(rows, F.col("op") == "del")

    def describe(self, uri: str) -> dict | None:
        """One stored object as JSON."""
        from .sources.docjson import serialize

        rows = [tuple(r) for r in self.quads.where(F.col("s") == uri).select(*QUAD, "listpos").collect()]
        found = serialize(rows, inline=False)
        return found[0] if found else None

    def handle(self, requests: list[dict]) -> list:
        """JSON-RPC style requests ``{method, params}`` in one transaction."""
        out: list = []
        with self.batch():
            for r in requests:
                method, params = r["method"], r.get("params")
                if method == "query":
                    out.append(self.query(params if isinstance(params, str) else params["query"], None if isinstance(params, str) else params.get("bindvars")))
                elif method in ("update", "replace", "add", "create", "remove"):
                    added, removed = getattr(self, method)(params)
                    out.append({"added": added.count() if added is not None else 0, "removed": removed.count() if removed is not None else 0})
                elif method == "transaction_info":
                    out.append({"writes": len(self._batch or [])})
                else:
                    out.append({"error": f"unknown method {method}"})
        return out

