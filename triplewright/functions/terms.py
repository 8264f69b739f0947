"""Column expressions on terms in surface form: ``<iri>``, ``_:b``, ``"literal"`` with its tail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the N-Triples grammar. The quantifiers inside literals are possessive, so that
# the matcher runs as a loop and a literal of any length is safe. A blank node's label may hold full stops,
# but does not end with one.
IRI = r"<[^<>\s]*+>"
BLANK = r"_:[^\s<>\".]++(?:\.++[^\s<>\".]++)*+"
QUOTED = r'"(?:[^"\\]|\\.)*+"'
LITERAL_TAIL = rf"(?:@[A-Za-z]++(?:-[A-Za-z0-9]++)*+|\^\^{IRI})?+"

SUBJECT_PATTERN = rf"^\s*+({IRI}|{BLANK})"
PREDICATE_PATTERN = rf"^\s*+(?:{IRI}|{BLANK})\s*+({IRI})"
LINE_PATTERN = (
    rf"^\s*+(?:{IRI}|{BLANK})\s*+{IRI}\s*+"
    rf"({IRI}|{BLANK}|{QUOTED}{LITERAL_TAIL})\s*+(?:\.\s*+(?:#.*)?+)?+$"
)


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def is_iri(term: Column) -> Column:
    return term.startswith("<")


def lexical(term: Column) -> Column:
    """The quoted part of a literal, without language tag or datatype; other terms as they are."""
    return F.when(is_literal(term), F.regexp_extract(term, rf"^({QUOTED})", 1)).otherwise(term)


def literal(text: Column) -> Column:
    """A quoted literal holding ``text``, with the four characters N-Triples must escape escaped."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, code in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return F.concat(F.lit('"'), out, F.lit('"'))


def line(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws(" ", s, p, o, F.lit("."))
