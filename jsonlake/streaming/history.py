"""Revision history and change streams.

A change log is a table of (s, p, o, ot, c, listpos, op, rev); revisions are vector
clocks written as text, ``A00001,B00002``. A changeset is one JSON record with
the statements of one commit; a stream of them is applied by ``foreachBatch`` with
its state in Parquet tables, exactly once per revision.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import QUAD

CHANGESET = "revision string, baserevision string, timestamp double, origin string, statements array<struct<s:string,p:string,o:string,ot:string,c:string,op:string>>"
CHANGES = "s string, p string, o string, ot string, c string, listpos array<int>, op string, rev string"
REVISIONS = "rev string, base string, at double, author string, comment string, origin string, batch string"
_PART = re.compile(r"([A-Za-z]+)(\d{5,})")
#: Fixed value: out-of-order changesets that may wait.
MOST_PENDING = 1000


class MergeConflict(ValueError):
    """A changeset touches what this branch changed since their common base."""


# -- revision text ------------------------------------------------------------


def parse_revision(text: str) -> dict[str, int]:
    return {m[1]: int(m[2]) for m in _PART.finditer(text or "")}


def format_revision(parts: dict[str, int]) -> str:
    return ",".join(f"{b}{n:05d}" for b, n in sorted(parts.items()))


def next_revision(text: str, branch: str) -> str:
    parts = parse_revision(text)
    parts[branch] = parts.get(branch, 0) + 1
    return format_revision(parts)


def merge_revisions(a: str, b: str) -> str:
    x, y = parse_revision(a), parse_revision(b)
    return format_revision({k: max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}})


def includes(a: str, b: str) -> bool:
    """Revision ``a`` holds all that ``b`` holds."""
    x, y = parse_revision(a), parse_revision(b)
    return all(x.get(k, 0) >= n for k, n in y.items())


# -- views of a change log ------------------------------------------------------


def net(changes: DataFrame) -> DataFrame:
    """Of each statement and revision the last change; an add and a remove in one revision cancel."""
    return changes.groupBy(*QUAD, "rev").agg(F.count_if(F.col("op") == "add").alias("a"), F.count_if(F.col("op") == "del").alias("d"), F.any_value("listpos").alias("listpos")).where("a <> d").select(*QUAD, "listpos", F.when(F.col("a") > F.col("d"), "add").otherwise("del").alias("op"), "rev")


def state_at(changes: DataFrame, order: DataFrame, rev: str | None = None) -> DataFrame:
    """Quads visible at a revision. ``order``: (rev, n) with n ascending in commit order."""
    upto = order if rev is None else order.where(F.col("n") <= F.lit(order.where(F.col("rev") == rev).first().n))
    rows = net(changes).join(upto, "rev")
    last = rows.groupBy(*QUAD).agg(F.max_by(F.struct("op", "listpos"), "n").alias("x"))
    return last.where("x.op = 'add'").select(*QUAD, F.col("x.listpos").alias("listpos"))


def revisions_of(changes: DataFrame, subject: str | None = None, context: str | None = None) -> DataFrame:
    out = changes
    if subject is not None:
        out = out.where(F.col("s") == subject)
    if context is not None:
        out = out.where(F.col("c") == context)
    return out.select("rev").distinct()


def modified_after(changes: DataFrame, order: DataFrame, rev: str) -> DataFrame:
    """Subjects with a change after a revision."""
    at = order.where(F.col("rev") == rev).first()
    return changes.join(order, "rev").groupBy("s").agg(F.max("n").alias("n")).where(F.col("n") > F.lit(at.n if at else -1)).select("s")


def last_revision(changes: DataFrame, order: DataFrame) -> DataFrame:
    """The revision of the last change of each statement."""
    return changes.join(order, "rev").groupBy(*QUAD).agg(F.max_by("rev", "n").alias("rev"))


def changes_after(changes: DataFrame, order: DataFrame, rev: str) -> DataFrame:
    """Net adds and removes after a branch revision."""
    at = order.where(F.col("rev") == rev).first()
    later = net(changes).join(order.where(F.col("n") > F.lit(at.n if at else -1)), "rev")
    return later.groupBy(*QUAD).agg(F.max_by(F.struct("op", "listpos"), "n").alias("x")).select(*QUAD, "x.op", "x.listpos")


# -- a versioned store in a folder -----------------------------------------------


class History:
    """A change log and a revision table below one folder, with merge of changesets.

    Appending a commit writes one Parquet part of changes under an id of its own, then
    the row that names revision and id: changes whose id has no row are not read, so
    a failed commit leaves nothing visible, also if its revision is tried again.
    """

    def __init__(self, spark: SparkSession, folder: str, branch: str = "A"):
        self.spark, self.folder, self.branch = spark, folder.rstrip("/"), branch
        self._revisions: list[tuple] = []
        self.pending: list[dict] = []
        try:
            rows = self.spark.read.schema(REVISIONS + ", n bigint").parquet(f"{self.folder}/revisions").orderBy("n").collect()
            self._revisions = [tuple(r)[:7] for r in rows]
        except Exception as e:  # a new history has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise

    @property
    def tip(self) -> str:
        return self._revisions[-1][0] if self._revisions else ""

    def order(self) -> DataFrame:
        return self.spark.createDataFrame([(r[0], k) for k, r in enumerate(self._revisions)], "rev string, n int")

    def revisions(self) -> DataFrame:
        return self.spark.createDataFrame(self._revisions, REVISIONS)

    def changes(self) -> DataFrame:
        if not self._revisions:
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES + ", batch string").parquet(f"{self.folder}/changes").join(self.revisions().select("rev", "batch"), ["rev", "batch"], "left_semi").select("s", "p", "o", "ot", "c", "listpos", "op", "rev")

    def state(self, rev: str | None = None) -> DataFrame:
        return state_at(self.changes(), self.order(), rev)

    def commit(self, added: DataFrame | None, removed: DataFrame | None, author: str = "", comment: str = "", revision: str | None = None, base: str | None = None, origin: str | None = None, at: float | None = None) -> str:
        rev = revision or next_revision(self.tip, self.branch)
        rows = self.spark.createDataFrame([], CHANGES)
        for df, op in ((removed, "del"), (added, "add")):
            if df is not None:
                pos = F.col("listpos") if "listpos" in df.columns else F.lit(None).cast("array<int>")
                rows = rows.unionByName(df.select(*QUAD, pos.alias("listpos"), F.lit(op).alias("op"), F.lit(rev).alias("rev")))
        batch = uuid.uuid4().hex
        net(rows).select("s", "p", "o", "ot", "c", "listpos", "op", "rev", F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.folder}/changes")
        row = (rev, self.tip if base is None else base, time.time() if at is None else at, author, comment, origin or self.branch, batch)
        self.spark.createDataFrame([(*row, len(self._revisions))], REVISIONS + ", n bigint").write.mode("append").parquet(f"{self.folder}/revisions")
        self._revisions.append(row)
        return rev

    def changeset(self, rev: str) -> dict:
        """The changeset of one revision, as published."""
        r = next(x for x in self._revisions if x[0] == rev)
        rows = self.changes().where(F.col("rev") == rev).orderBy("op", *QUAD).collect()
        return {"revision": rev, "baserevision": r[1], "timestamp": r[2], "origin": r[5], "statements": [{k: x[k] for k in ("s", "p", "o", "ot", "c", "op")} for x in rows]}

    def publish(self, rev: str, folder: str) -> None:
        """Write a changeset as one JSON record into a stream folder."""
        self.spark.createDataFrame([(json.dumps(self.changeset(rev)),)], "value string").coalesce(1).write.mode("append").text(folder)

    def merge(self, changeset: dict) -> bool:
        """Apply a changeset of another branch. False: it waits for its base, or is known.

        Base = tip: fast-forward. Else it must not touch subjects and properties changed
        here since the base; then it is applied and a merge revision is added.
        """
        if changeset["origin"] == self.branch:
            raise MergeConflict("a changeset of this very branch")
        if any(r[0] == changeset["revision"] for r in self._revisions):
            return False
        base = changeset["baserevision"] or ""
        if base and not any(r[0] == base for r in self._revisions):
            if all(p["revision"] != changeset["revision"] for p in self.pending):
                if len(self.pending) >= MOST_PENDING:
                    raise MergeConflict("too many changesets wait for their base")
                self.pending.append(changeset)
            return False
        kind = "s string, p string, o string, ot string, c string, op string"
        rows = self.spark.createDataFrame([tuple(x[k] for k in ("s", "p", "o", "ot", "c", "op")) for x in changeset["statements"]], kind)
        tip = self.tip
        forward = base == tip
        if not forward:
            mine = changes_after(self.changes(), self.order(), base).select("s", "p").distinct()
            both = rows.join(mine, ["s", "p"], "left_semi").limit(5).collect()
            if both:
                raise MergeConflict(f"both branches changed {both[0].s} {both[0].p}")
        self.commit(rows.where("op = 'add'"), rows.where("op = 'del'"), revision=changeset["revision"], base=base, origin=changeset["origin"], at=changeset["timestamp"])
        if not forward:
            self.commit(None, None, comment="merge", revision=next_revision(merge_revisions(tip, changeset["revision"]), self.branch), base=tip)
        for p in [p for p in self.pending if p["baserevision"] == changeset["revision"]]:
            self.pending.remove(p)
            self.merge(p)
        return True

    def rebuild(self, log: DataFrame) -> None:
        """History of a change log that has CHANGES' columns, one revision after the other."""
        # A revision that holds another has larger counters in sum, so sums are an order of commits.
        revs = sorted((r.rev for r in log.select("rev").distinct().collect()), key=lambda x: (sum(parse_revision(x).values()), x))
        for rev in revs:
            part = log.where(F.col("rev") == rev)
            self.commit(part.where("op = 'add'"), part.where("op = 'del'"), revision=rev)


def subscribe(spark: SparkSession, folder: str, history: History, checkpoint: str, once: bool = True):
    """Apply every changeset that appears in a stream folder; known revisions are skipped, early ones wait."""
    stream = spark.readStream.schema("value string").text(folder)

    def apply(batch: DataFrame, _: int) -> None:
        rows = batch.select(F.from_json("value", CHANGESET).alias("x")).select("x.*").orderBy("timestamp", "revision").collect()  # a changeset is one commit
        for r in rows:
            if r.origin != history.branch:
                history.merge(r.asDict(recursive=True))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query
