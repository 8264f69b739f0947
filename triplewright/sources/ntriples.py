"""N-Triples text to triples (s, p, o), as an ingest job of column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..plans.workspace import Workspace


def _content(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor a comment."""
    return lines.where(~F.col("value").rlike(r"^\s*(?:#|$)"))


def parse_lines(lines: DataFrame, lexical_only: bool = False) -> DataFrame:
    """Triples of the lines (value) that hold one; blank lines, comments and rejects are left out.

    With ``lexical_only`` a literal is only its quoted part, so "5", "5"@en and "5"^^<t> are one term.
    """
    # Exploding the at most one match runs the long pattern once per line; a filter on it would run it twice.
    found = F.explode(F.regexp_extract_all("value", F.lit(terms.LINE_PATTERN), F.lit(1)))
    return lines.select("value", found.alias("o")).select(
        F.regexp_extract("value", terms.SUBJECT_PATTERN, 1).alias("s"),
        F.regexp_extract("value", terms.PREDICATE_PATTERN, 1).alias("p"),
        (terms.lexical(F.col("o")) if lexical_only else F.col("o")).alias("o"),
    )


def reject_lines(lines: DataFrame) -> DataFrame:
    """(value, reason) for each line that is not a triple."""
    bad = _content(lines).where(~F.col("value").rlike(terms.LINE_PATTERN)).select(
        "value", F.regexp_extract("value", terms.SUBJECT_PATTERN, 1).alias("s"),
        F.regexp_extract("value", terms.PREDICATE_PATTERN, 1).alias("p"))
    return bad.select("value", _reason().alias("reason"))


def _reason():
    """Why a line is not a triple, from its columns s and p."""
    return (F.when(F.col("s") == "", "no subject").when(F.col("p") == "", "no predicate")
            .otherwise("no object or bad end of line"))


def route_lines(lines: DataFrame, lexical_only: bool = False) -> DataFrame:
    """Every line (value) with content, parsed once: (s, p, o, value, reason, part).

    ``part`` is "triple", with its terms, or "reject", with the line and the reason.
    """
    found = F.explode_outer(F.regexp_extract_all("value", F.lit(terms.LINE_PATTERN), F.lit(1)))
    cut = _content(lines).select("value", found.alias("o")).select(
        "value", "o", F.regexp_extract("value", terms.SUBJECT_PATTERN, 1).alias("s"),
        F.regexp_extract("value", terms.PREDICATE_PATTERN, 1).alias("p"))
    held = F.col("o").isNotNull()
    return cut.select(
        F.when(held, F.col("s")).alias("s"), F.when(held, F.col("p")).alias("p"),
        F.when(held, terms.lexical(F.col("o")) if lexical_only else F.col("o")).alias("o"),
        F.when(~held, F.col("value")).alias("value"), F.when(~held, _reason()).alias("reason"),
        F.when(held, "triple").otherwise("reject").alias("part"))


def stage_lines(lines: DataFrame, ws: Workspace, lexical_only: bool = False,
                rows_per_file: int = 0) -> tuple[DataFrame, DataFrame]:
    """(triples, rejects) of the lines (value), written side by side in one pass over them and read back."""
    routed = ws.save(route_lines(lines, lexical_only), ws.unique("lines"), partition_by="part", rows_per_file=rows_per_file)
    return (routed.where("part = 'triple'").select("s", "p", "o"),
            routed.where("part = 'reject'").select("value", "reason"))


def read_triples(spark: SparkSession, path: str, lexical_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(triples, rejects) of an N-Triples file, folder or glob. Each reads the text; ``stage_lines`` reads it once."""
    lines = spark.read.text(path)
    return parse_lines(lines, lexical_only), reject_lines(lines)
