"""Selectors for the schema statements in a triples table (s, p, o)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as v


def types_of(triples: DataFrame) -> DataFrame:
    """rdf:type rows as (s, cls)."""
    return triples.where(F.col("p") == v.TYPE).select("s", F.col("o").alias("cls"))


def sameas_of(triples: DataFrame) -> DataFrame:
    """owl:sameAs rows as distinct (x, y)."""
    rows = triples.where(F.col("p") == v.SAME_AS)
    return rows.select(F.col("s").alias("x"), F.col("o").alias("y")).distinct()


def select_axioms(triples: DataFrame) -> DataFrame:
    """Every schema row, in one scan; the predicates are pushed down to a columnar source."""
    states = (F.col("p") == v.TYPE) & F.col("o").isin(list(v.PROPERTY_CLASSES))
    wanted = triples.where(F.col("p").isin(list(v.AXIOM_PREDICATES)) | states)
    return wanted.select("s", "p", "o").distinct()


def axiom(triples: DataFrame, predicate: str) -> DataFrame:
    """Pairs (s, o) stated with ``predicate``."""
    return triples.where(F.col("p") == predicate).select("s", "o").distinct()


def property_set(triples: DataFrame, characteristic: str) -> DataFrame:
    """Properties (p) declared to be of the class ``characteristic``."""
    rows = triples.where((F.col("p") == v.TYPE) & (F.col("o") == characteristic))
    return rows.select(F.col("s").alias("p")).distinct()


def inverse_pairs(triples: DataFrame) -> DataFrame:
    """(p, q) for each inverseOf row, read forward and backward."""
    forward = axiom(triples, v.INVERSE_OF).toDF("p", "q")
    return forward.union(forward.select("q", "p")).distinct()


def hierarchy(triples: DataFrame, sub: str, equivalent: str) -> DataFrame:
    """Edges (src, dst) of a hierarchy: the stated ones, and equivalences in both directions."""
    equal = axiom(triples, equivalent)
    edges = axiom(triples, sub).union(equal).union(equal.select("o", "s"))
    return edges.toDF("src", "dst").distinct()


def new_equivalents(equal: DataFrame, stated: DataFrame) -> DataFrame:
    """The pairs (s, o) of equivalent nodes (src, dst) that are not stated either way."""
    known = stated.union(stated.select("o", "s"))
    return equal.select(F.col("src").alias("s"), F.col("dst").alias("o")).join(known, on=["s", "o"], how="left_anti")


def restrictions(triples: DataFrame) -> DataFrame:
    """(kind, cls, prop, filler) for hasValue, someValuesFrom and allValuesFrom restrictions."""
    kind = (
        F.when(F.col("p") == v.HAS_VALUE, "hasValue")
        .when(F.col("p") == v.SOME_VALUES_FROM, "some")
        .when(F.col("p") == v.ALL_VALUES_FROM, "all")
    )
    fillers = triples.select(kind.alias("kind"), F.col("s").alias("cls"), F.col("o").alias("filler"))
    on_property = axiom(triples, v.ON_PROPERTY).toDF("cls", "prop")
    return (
        fillers.where(F.col("kind").isNotNull()).distinct()
        .join(on_property, on="cls").select("kind", "cls", "prop", "filler")
    )
