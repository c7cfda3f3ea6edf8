"""Text formats: N-Triples with directives, ntjson, RDF/JSON, multipart JSON; readers, writers, sniffing."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import LITERAL, REF
from .docjson import QUADS, DocReader, serialize, to_quads

#: Formats by file extension, and the directives of N-Triples files.
EXTENSIONS = {".nt": "ntriples", ".nj": "ntjson", ".rdf": "rdfxml", ".json": "pjson", ".mjson": "mjson", ".yaml": "yaml"}
GRAPH, REMOVE, JSON_LINE = "#!graph", "#!remove", "#!json"
MULTIPART = "=multipart-json"


def format_of(path: str) -> str:
    m = re.search(r"\.\w+$", path)
    return EXTENSIONS.get(m[0].lower() if m else "", "ntriples")


def sniff(text: str) -> str:
    """The format of a text from its start."""
    head = text.lstrip()
    if head.startswith(MULTIPART):
        return "mjson"
    if head[:1] in ("{", "["):
        return "pjson"
    return "rdfxml" if head.startswith("<") and re.match(r"<(\?xml|!--|\w+[:>\s])", head) and not re.match(r"<[^>]*>\s*<", head) else "ntriples"


# -- N-Triples ----------------------------------------------------------------

_TERM = r'(?:<([^>\s]*)>|_:(\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z][\w-]*)|\^\^<([^>]*)>)?)'
_LINE = re.compile(rf"\s*(?:<([^>\s]*)>|_:(\S+))\s+<([^>\s]*)>\s+{_TERM}\s*\.\s*$")
_ESCAPE = re.compile(r'\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[tnr"\\])')


def unescape(text: str) -> str:
    plain = {"t": "\t", "n": "\n", "r": "\r", '"': '"', "\\": "\\"}
    return _ESCAPE.sub(lambda m: plain.get(m[1]) or chr(int(m[1][1:], 16)), text)


def parse_line(line: str) -> tuple[str, str, str, str] | None:
    """(s, p, o, ot) of an N-Triples line."""
    m = _LINE.match(line)
    if not m:
        return None
    s = m[1] if m[1] is not None else f"bnode:{m[2]}"
    if m[4] is not None:
        return s, m[3], m[4], REF
    if m[5] is not None:
        return s, m[3], f"bnode:{m[5]}", REF
    return s, m[3], unescape(m[6]), m[8] or m[7] or LITERAL


def read_ntriples(spark: SparkSession, path: str, context: str = "") -> DataFrame:
    """Quads of N-Triples or ntjson files. ``#!graph``, ``#!remove`` and ``#!json`` apply within their file, in order.

    Lines are parsed on the executors. Where a file has removals, the last line about a statement counts.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, file, at in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "at")), strict=True):
                text = value.strip()
                removed = text.startswith(REMOVE)
                body = text[len(REMOVE) :].strip() if removed else text
                if body.startswith(GRAPH):
                    rows.append((None, None, body[len(GRAPH) :].strip().strip("<>"), "graph", None, None, False, file, at))
                elif body.startswith(JSON_LINE) or body.startswith("{"):
                    doc = body[len(JSON_LINE) :].strip() if body.startswith(JSON_LINE) else body
                    if doc:
                        rows += [(*q, removed, file, at) for q in DocReader(seed=body, context=None).quads(json.loads(doc))]
                elif body and not body.startswith("#"):
                    got = parse_line(body)
                    if got is None:
                        raise ValueError(f"not an N-Triples line: {body[:80]}")
                    rows.append((*got, None, None, removed, file, at))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.string()] * 5 + [pa.list_(pa.int32()), pa.bool_(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["s", "p", "o", "ot", "c", "listpos", "removed", "file", "at"])

    parsed = lines.mapInArrow(run, f"{QUADS}, removed boolean, file string, at bigint")
    graphs = parsed.where("ot = 'graph' AND s IS NULL")
    marked = parsed
    if not graphs.isEmpty():  # a directive holds until the next one of its file
        w = Window.partitionBy("file").orderBy("at")
        marked = parsed.withColumn("c", F.coalesce("c", F.last(F.when(F.col("s").isNull(), F.col("o")), ignorenulls=True).over(w)))
    rows = marked.where("s IS NOT NULL").withColumn("c", F.coalesce("c", F.lit(context)))
    last = rows.groupBy("s", "p", "o", "ot", "c").agg(F.max_by(F.struct("removed", "listpos"), "at").alias("x"))
    return last.where("NOT x.removed").select("s", "p", "o", "ot", "c", F.col("x.listpos").alias("listpos"))


def _escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ntriples_lines(quads: DataFrame, removed: Column | None = None) -> DataFrame:
    """One line per statement, written by Spark alone; white space in an id is an error."""
    node = lambda c: F.when(F.col(c).rlike(r"\s"), F.raise_error(F.concat(F.lit("white space in id "), F.col(c)))).when(F.col(c).startswith("bnode:"), F.concat(F.lit("_:"), F.substring(F.col(c), 7, 1 << 30))).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    text = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'))
    kind = F.when(F.col("ot") == LITERAL, F.lit("")).when(F.col("ot").rlike(r"^[A-Za-z]{2,3}(-\w+)*$"), F.concat(F.lit("@"), F.col("ot"))).otherwise(F.concat(F.lit("^^<"), F.col("ot"), F.lit(">")))
    line = F.concat(node("s"), F.lit(" <"), F.col("p"), F.lit("> "), F.when(F.col("ot") == REF, node("o")).otherwise(F.concat(text, kind)), F.lit(" ."))
    if removed is not None:
        line = F.when(removed, F.concat(F.lit(REMOVE + " "), line)).otherwise(line)
    return quads.select(line.alias("value"))


def write_ntriples(quads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    ntriples_lines(quads).write.mode(mode).text(path)


def json_lines(quads: DataFrame) -> DataFrame:
    """One JSON object per subject, references kept as @id: aggregated and rendered on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, rows in zip(batch.column("s").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                objects = serialize([(s, r["p"], r["o"], r["ot"], r["c"], r["listpos"]) for r in rows], inline=False, blank_ids=True)
                out.append(json.dumps(objects[0], ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    grouped = quads.groupBy("s").agg(F.collect_list(F.struct("p", "o", "ot", "c", "listpos")).alias("rows"))
    return grouped.mapInArrow(run, "value string")


def write_pjson(quads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_lines(quads).write.mode(mode).text(path)


# -- RDF/JSON -----------------------------------------------------------------


def read_rdfjson(spark: SparkSession, text_or_path: str, context: str = "") -> DataFrame:
    """``{subject: {property: [{type, value, datatype|lang, context?}]}}``, by from_json and explode."""
    raw = spark.createDataFrame([(text_or_path,)], "value string") if text_or_path.lstrip().startswith("{") else spark.read.text(text_or_path, wholetext=True)
    return rdfjson_quads(raw, context)


def rdfjson_quads(raw: DataFrame, context: str = "") -> DataFrame:
    """Quads of rows that each hold one such JSON text as ``value``, as write_rdfjson makes them."""
    kind = "map<string, map<string, array<struct<type:string,value:string,datatype:string,lang:string,context:string>>>>"
    rows = raw.select(F.explode(F.from_json("value", kind)).alias("s", "ps")).select("s", F.explode("ps").alias("p", "vs")).select("s", "p", F.explode("vs").alias("v"))
    ot = F.when(F.col("v.type").isin("uri", "bnode"), F.lit(REF)).otherwise(F.coalesce("v.datatype", "v.lang", F.lit(LITERAL)))
    return rows.select("s", "p", F.col("v.value").alias("o"), ot.alias("ot"), F.coalesce("v.context", F.lit(context)).alias("c"), F.lit(None).cast("array<int>").alias("listpos"))


def write_rdfjson(quads: DataFrame) -> DataFrame:
    """One JSON text per subject."""
    v = F.struct(F.when(F.col("ot") == REF, F.lit("uri")).otherwise(F.lit("literal")).alias("type"), F.col("o").alias("value"), F.when(F.col("ot").contains(":"), F.col("ot")).alias("datatype"), F.when(~F.col("ot").contains(":") & ~F.col("ot").isin(REF, LITERAL), F.col("ot")).alias("lang"))
    by_p = quads.groupBy("s", "p").agg(F.collect_list(v).alias("vs"))
    return by_p.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("p", "vs"))).alias("ps")).select(F.to_json(F.map_from_arrays(F.array("s"), F.array("ps"))).alias("value"))


# -- multipart JSON -------------------------------------------------------------


def parse_multipart(text: str) -> object:
    """A JSON document whose ``{"$blob": name}`` values are texts of later parts.

    Parts are parted by a line ``--boundary`` named in the first line; a part starts with ``name:`` and a blank line.
    """
    first, _, rest = text.partition("\n")
    if not first.startswith(MULTIPART):
        raise ValueError("no multipart header")
    boundary = "\n--" + first[len(MULTIPART) :].strip() + "\n"
    parts = rest.split(boundary)
    blobs = {}
    for part in parts[1:]:
        head, _, body = part.partition("\n\n")
        blobs[head.strip().removeprefix("name:").strip()] = body

    def fill(v):
        if isinstance(v, dict):
            return blobs[v["$blob"]] if set(v) == {"$blob"} else {k: fill(x) for k, x in v.items()}
        return [fill(x) for x in v] if isinstance(v, list) else v

    return fill(json.loads(parts[0]))


def write_multipart(doc, longest: int = 256, boundary: str = "part") -> str:
    """The opposite: strings over ``longest`` characters become parts."""
    blobs: list[str] = []

    def move(v):
        if isinstance(v, str) and len(v) > longest:
            blobs.append(v)
            return {"$blob": f"b{len(blobs)}"}
        if isinstance(v, dict):
            return {k: move(x) for k, x in v.items()}
        return [move(x) for x in v] if isinstance(v, list) else v

    head = json.dumps(move(doc), ensure_ascii=False)
    while any(f"\n--{boundary}\n" in f"\n{b}\n" for b in blobs):
        boundary += "x"
    return f"{MULTIPART} {boundary}\n{head}" + "".join(f"\n--{boundary}\nname: b{k + 1}\n\n{b}" for k, b in enumerate(blobs))


def read(spark: SparkSession, path: str, form: str | None = None, context: str = "") -> DataFrame:
    """Quads of files in any format with a reader."""
    form = form or format_of(path)
    if form in ("ntriples", "ntjson"):
        return read_ntriples(spark, path, context)
    if form == "rdfjson":
        return read_rdfjson(spark, path, context)
    if form in ("pjson", "mjson", "yaml"):
        # Whole documents with headers are small; bulk data is one object per line (read_json_lines).
        texts = [r.value for r in spark.read.text(path, wholetext=True).collect()]
        if form == "yaml":
            import yaml

            docs = [yaml.safe_load(t) for t in texts]
        else:
            docs = [parse_multipart(t) if t.startswith(MULTIPART) else json.loads(t) for t in texts]
        out = None
        for d in docs:
            q = to_quads(spark, d, context=context)
            out = q if out is None else out.unionByName(q)
        return out if out is not None else spark.createDataFrame([], QUADS)
    raise ValueError(f"no reader for {form}")


def write(quads: DataFrame, path: str, form: str | None = None, mode: str = "errorifexists") -> None:
    form = form or format_of(path)
    if form == "ntriples":
        write_ntriples(quads, path, mode)
    elif form in ("pjson", "ntjson"):
        write_pjson(quads, path, mode)
    elif form == "rdfjson":
        write_rdfjson(quads).write.mode(mode).text(path)
    else:
        raise ValueError(f"no writer for {form}")
