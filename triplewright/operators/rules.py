"""The entailment rules as joins of facts (s, p, o) with rule rows (see plans.rulebook).

``small`` says whether the rule rows were measured to fit a broadcast, ``side`` which of two fact inputs was.
Each function returns candidate facts (s, p, o), possibly with rows that are known already or repeated;
the caller removes those once for all rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..settings import Settings
from .closure import compose
from .joins import lookup_join, skew_join
from .sets import union_all

TYPE = f"'{v.TYPE}'"

#: Writes a frame to a table of its own and reads it back.
Save = Callable[[DataFrame], DataFrame]


def by_property(facts: DataFrame, table: DataFrame, small: bool, settings: Settings,
                rows: int | None = None) -> DataFrame:
    """Subproperty, inverse, symmetric, domain and range rules: one lookup on the predicate.

    Also returns ``place`` and ``closed`` of the rule row.
    """
    keyed = table.selectExpr("k1 as p", "place", "hp", "ho", "closed")
    return lookup_join(facts.select("s", "p", "o"), keyed, ["p"], small, settings, rows).selectExpr(
        "if(place in ('keep', 'subject'), s, o) as s", "hp as p",
        "case place when 'keep' then o when 'swap' then s else ho end as o", "place", "closed")


def by_class(types: DataFrame, table: DataFrame, small: bool, settings: Settings,
             rows: int | None = None) -> DataFrame:
    """Subclass and hasValue (type to triple) rules: one lookup on the class. Also returns ``closed``."""
    keyed = table.selectExpr("k1 as o", "hp", "ho", "closed")
    return lookup_join(types.select("s", "o"), keyed, ["o"], small, settings, rows).selectExpr(
        "s", "hp as p", "ho as o", "closed")


def by_value(facts: DataFrame, table: DataFrame, small: bool, settings: Settings,
             rows: int | None = None) -> DataFrame:
    """The hasValue (triple to type) rule: one lookup on predicate and object. Also returns ``closed``."""
    keyed = table.selectExpr("k1 as p", "k2 as o", "hp", "ho", "closed")
    return lookup_join(facts.select("s", "p", "o"), keyed, ["p", "o"], small, settings, rows).selectExpr(
        "s", "hp as p", "ho as o", "closed")


def of_keys(facts: DataFrame, column: str, keys: DataFrame, small: bool, settings: Settings) -> DataFrame:
    """Facts whose ``column`` is one of the values of the one-column frame ``keys``."""
    facts, keys = facts.select("s", "p", "o"), keys.toDF(column)
    if small:
        return facts.join(F.broadcast(keys), on=column, how="left_semi").select("s", "p", "o")
    return lookup_join(facts, keys.distinct(), [column], small, settings).select("s", "p", "o")


def chain(left: DataFrame, right: DataFrame, hot_left=(), hot_right=(), salts: int = 32,
          side: str | None = None) -> DataFrame:
    """Transitive step: x p y from ``left`` and y p z from ``right`` give x p z, x != z.

    ``hot_left`` and ``hot_right`` are the cells of the hot values of y on the two sides.
    """
    left, right = (df.selectExpr("s as src", "p", "o as dst") for df in (left, right))
    step = compose(left, right, ["p"], hot_left, hot_right, salts, side)
    return step.selectExpr("src as s", "p", "dst as o")


def _closed(table: DataFrame) -> str:
    """``closed`` of rule rows; rows without it have open heads."""
    return "closed" if "closed" in table.columns else "false as closed"


def of_fillers(types: DataFrame, table: DataFrame, small: bool, settings: Settings) -> DataFrame:
    """The types whose class is a filler in use; all of them where the rule rows are many."""
    return of_keys(types, "o", table.select("k2"), small, settings) if small else types


def some_values(triples: DataFrame, types: DataFrame, table: DataFrame, small: bool, settings: Settings,
                hot_left=(), hot_right=(), side: str | None = None, save: Save | None = None) -> DataFrame:
    """u p x, x type filler, cls some(filler) on p: u type cls. ``triples`` are those of the properties in use.

    The types are first cut to the fillers in use. The restriction is looked up after the join, so a
    property with many restrictions does not multiply the triples that are shuffled. Many restrictions cannot be
    broadcast, and the rows that met are looked at for hot keys; ``save`` then writes them, so that triples and types
    are joined once. Also returns ``closed``.
    """
    members = triples.selectExpr("s as u", "p", "o as x")
    fillers = of_fillers(types, table, small, settings).selectExpr("s as x", "o as filler")
    met = skew_join(members, fillers, ["x"], "x", hot_left, hot_right, settings.salts, side)
    if save and not small:
        met = save(met)
    keyed = table.selectExpr("k1 as p", "k2 as filler", "ho as cls", _closed(table))
    return lookup_join(met, keyed, ["p", "filler"], small, settings).selectExpr(
        "u as s", f"{TYPE} as p", "cls as o", "closed")


def bound_types(types: DataFrame, table: DataFrame, small: bool, settings: Settings) -> DataFrame:
    """(s, p, filler, closed): what each member of a class with an allValuesFrom restriction demands of the values of p."""
    keyed = table.selectExpr("k1 as o", "k2 as p", "ho as filler", _closed(table))
    return lookup_join(types.select("s", "o"), keyed, ["o"], small, settings).select("s", "p", "filler", "closed")


def all_values(triples: DataFrame, types: DataFrame, table: DataFrame, small: bool, settings: Settings,
               hot_left=(), hot_right=(), side: str | None = None) -> DataFrame:
    """u type cls, cls all(filler) on p, u p x: x type filler. ``triples`` are those of the properties in use.

    Heat is that of subject and property together: a subject with many values of one property is spread in the
    rows of this property only. Also returns ``closed``.
    """
    bound = bound_types(types, table, small, settings)
    met = skew_join(triples.select("s", "p", "o"), bound, ["s", "p"], ["s", "p"], hot_left, hot_right, settings.salts,
                    side)
    return met.selectExpr("o as s", f"{TYPE} as p", "filler as o", "closed")


def two_sided(rule, newest: tuple[DataFrame | None, DataFrame | None], known: tuple[DataFrame, DataFrame],
              older: tuple[DataFrame, DataFrame] | None,
              small: tuple[bool, bool] = (False, False)) -> DataFrame | None:
    """Semi-naive form of a rule with two body atoms: new left with all right, older left with new right.

    ``small`` says of the new left and new right whether they may be broadcast; ``rule`` gets the side. A new side
    that is None has no rows; without any new rows there is no result.
    """
    steps = []
    if newest[0] is not None:
        steps.append(rule(newest[0], known[1], "left" if small[0] else None))
    if older is not None and newest[1] is not None:
        steps.append(rule(older[0], newest[1], "right" if small[1] else None))
    return union_all(steps) if steps else None
