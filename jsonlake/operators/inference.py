"""Schema inference over quads: subclass and subproperty expansion, domain and range, basic entailments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import REF
from .graph import transitive_closure

#: Fixed values of the schema vocabulary.
RDF, RDFS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
TYPE, PROPERTY = RDF + "type", RDF + "Property"
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"
RESOURCE, CLASS = RDFS + "Resource", RDFS + "Class"


def _closure(quads: DataFrame, prop: str) -> DataFrame:
    edges = quads.where((F.col("p") == prop) & (F.col("ot") == REF)).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    return transitive_closure(edges)


def expand_types(quads: DataFrame, type_property: str = TYPE) -> DataFrame:
    """Quads plus the types that follow from subclasses."""
    up = _closure(quads, SUBCLASS)
    more = quads.where(F.col("p") == type_property).join(up, F.col("o") == F.col("src")).select("s", "p", F.col("dst").alias("o"), "ot", "c", F.lit(None).cast("array<int>").alias("listpos"))
    return quads.unionByName(more).dropDuplicates(["s", "p", "o", "ot", "c"])


def expand_properties(quads: DataFrame) -> DataFrame:
    """Quads plus the statements that follow from subproperties."""
    up = _closure(quads, SUBPROPERTY)
    more = quads.join(F.broadcast(up), F.col("p") == F.col("src")).select("s", F.col("dst").alias("p"), "o", "ot", "c", "listpos")
    return quads.unionByName(more).dropDuplicates(["s", "p", "o", "ot", "c"])


def _typed(s, kind) -> list:
    return [s.alias("s"), F.lit(TYPE).alias("p"), kind.alias("o"), F.lit(REF).alias("ot"), F.lit("").alias("c"), F.lit(None).cast("array<int>").alias("listpos")]


def entail(quads: DataFrame) -> DataFrame:
    """Inferred statements only: types from domain and range, properties are Property, subjects are Resource. Recomputed, so removals need nothing."""
    wide = expand_properties(quads)
    domain = quads.where(F.col("p") == DOMAIN).select(F.col("s").alias("__p"), F.col("o").alias("__c"))
    rng = quads.where(F.col("p") == RANGE).select(F.col("s").alias("__p"), F.col("o").alias("__c"))
    out = wide.join(domain, F.col("p") == F.col("__p")).select(*_typed(F.col("s"), F.col("__c")))
    out = out.unionByName(wide.where(F.col("ot") == REF).join(rng, F.col("p") == F.col("__p")).select(*_typed(F.col("o"), F.col("__c"))))
    out = out.unionByName(quads.select("p").distinct().select(*_typed(F.col("p"), F.lit(PROPERTY))))
    out = out.unionByName(quads.select("s").distinct().select(*_typed(F.col("s"), F.lit(RESOURCE))))
    every = expand_types(quads.unionByName(out)).where(F.col("p") == TYPE)
    return every.join(quads.select("s", "p", "o"), ["s", "p", "o"], "left_anti").dropDuplicates(["s", "p", "o"])


def compatible(quads: DataFrame, want: str, sub: str = SUBCLASS) -> DataFrame:
    """All types (or properties) that count as ``want``: itself, those below it, or with ``prefix*`` those that start so."""
    if want.endswith("*"):
        return quads.select(F.col("o").alias("t")).where(F.col("p") == TYPE).union(quads.select("p")).where(F.col("t").startswith(want[:-1])).distinct()
    below = _closure(quads, sub).where(F.col("dst") == want).select(F.col("src").alias("t"))
    return below.union(quads.sparkSession.createDataFrame([(want,)], "t string")).distinct()
