"""Join forms that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import Settings

#: Bits of a bitmap for each row that it marks, and in all.
MARK_BITS = 32
MOST_MARK_BITS = 1 << 28


def hot_values(df: DataFrame, column: str, settings: Settings, rows: int | None = None) -> dict[str, int]:
    """Values of ``column`` holding more than ``settings.hot_share`` of the rows, with their number of cells.

    The frequent-items sketch keeps a bounded map per partition and misses no value above the share,
    so the candidates are few; their exact counts then remove the false ones and give the number of cells.
    Neither step shuffles the rows, and at most 1 / hot_share + 1 rows reach the driver. ``rows`` is the row
    count, if known, or more.
    """
    if rows is not None and rows * rows <= 4 * settings.pairs_per_task:
        return {}
    candidates = df.select(column).freqItems([column], settings.hot_share).first()[0]
    if not candidates:
        return {}
    named = F.when(F.col(column).isin(list(candidates)), F.col(column)).alias("value")
    counts = df.select(named).groupBy("value").agg(F.count("*").alias("n")).collect()
    total = sum(r.n for r in counts)
    if total * total <= 4 * settings.pairs_per_task:
        return {}
    hot = {r.value: r.n for r in counts if r.value is not None and r.n > total * settings.hot_share}
    return {k: max(settings.salts, -(-hot[k] // settings.cell_rows)) for k in sorted(hot)}


@dataclass(frozen=True)
class Counts:
    """Rows of the most frequent values, by value or ``meeting_key``; any other value has at most ``rest``."""
    listed: dict
    rest: int

    @classmethod
    def of(cls, top: list[tuple], limit: int) -> "Counts":
        """From the ``limit`` most frequent values, or all if there are fewer."""
        listed = dict(top)
        return cls(listed, min(listed.values()) if len(listed) >= limit else 0)

    def get(self, value) -> int:
        return self.listed.get(value, self.rest)


def grid(left: Counts, right: Counts, settings: Settings) -> tuple[dict, dict]:
    """Cells for the values that give one task too many pairs, or too many rows of one side.

    A value with l and r rows on the two sides gets i x j cells: enough for its pairs, and divided so that the
    copies, l * j + r * i, are few. A value that occurs on one side only is left whole.
    """
    pairs, most = max(1, settings.pairs_per_task), 10 * settings.cell_rows
    cells: tuple[dict, dict] = ({}, {})
    for value in sorted({*left.listed, *right.listed}):
        l, r = left.get(value), right.get(value)
        if not l or not r or (l * r <= pairs and max(l, r) <= most):
            continue
        i, j = (-(-n // settings.cell_rows) if n > most else 1 for n in (l, r))
        needed = -(-l * r // pairs)
        if i * j < needed:
            i = min(needed, max(i, round(math.sqrt(needed * l / r))))
            j = max(j, -(-needed // i))
        for side, n in zip(cells, (i, j)):
            if n > 1:
                side[value] = n
    return cells


def meeting_key(*columns: str) -> Column:
    """One number for what rows meet on. Different values may by chance share one; they are then spread alike."""
    return F.xxhash64(*columns)


def may_match(left: DataFrame, right: DataFrame, on: list[str], rows: int) -> DataFrame:
    """The rows of ``left`` whose ``on`` is in ``right``, and a few others, without a shuffle of ``left``.

    ``right`` is made known to all tasks as one bitmap with MARK_BITS for each of its ``rows`` rows, so about one row
    in MARK_BITS passes by chance. An exact join has to follow. Over MOST_MARK_BITS in all, more rows pass by chance.
    """
    bits = min(MOST_MARK_BITS, max(1, rows) * MARK_BITS)
    place = F.pmod(F.xxhash64(*on), F.lit(bits)) + 1
    marks = right.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_marks"))
    placed = left.withColumn("_place", place).withColumn("_bucket", F.bitmap_bucket_number("_place"))
    bit = "cast(bitmap_bit_position(_place) as int)"
    marked = f"getbit(cast(conv(hex(substring(_marks, {bit} div 8 + 1, 1)), 16, 10) as int), {bit} % 8) = 1"
    return placed.join(F.broadcast(marks), "_bucket").where(marked).select(*left.columns)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], hot_on: str | list[str], hot_left=(), hot_right=(),
              salts: int = 32, small: str | None = None) -> DataFrame:
    """Inner join on ``on`` with the rows of hot keys spread over a grid of cells.

    ``small`` names the side ("left" or "right") that the caller has measured to fit a broadcast; the other
    side is then not shuffled at all.

    ``hot_left`` and ``hot_right`` map hot values of ``hot_on``, or as numbers their ``meeting_key``, to their cells,
    or list them to get ``salts`` each. A row
    whose value is hot on its own side goes to one of the value's cells by a hash of the row; a row whose value
    is hot on the other side is copied to each of that side's cells. All other rows keep a single cell, and
    without hot values this is the plain join.
    """
    if small == "left":
        return F.broadcast(left).join(right, on=on)
    if small == "right":
        return left.join(F.broadcast(right), on=on)
    if not hot_left and not hot_right:
        return left.join(right, on=on)
    columns = [hot_on] if isinstance(hot_on, str) else hot_on
    value = meeting_key(*columns) if isinstance(next(iter([*hot_left, *hot_right])), int) else F.col(*columns)

    def cells(hot):
        hot = dict(hot) if isinstance(hot, dict) else dict.fromkeys(hot, salts)
        count = F.lit(1)
        for number in sorted(set(hot.values())):
            count = F.when(value.isin([k for k, n in hot.items() if n == number]), number).otherwise(count)
        return count

    def cell(df, count):
        return F.pmod(F.xxhash64(*df.columns), count).cast("int")

    def copies(count):
        return F.explode(F.sequence(F.lit(0), count - 1))

    i, j = cells(hot_left), cells(hot_right)
    spread_left = left.withColumn("_i", cell(left, i)).withColumn("_j", copies(j))
    spread_right = right.withColumn("_j", cell(right, j)).withColumn("_i", copies(i))
    return spread_left.join(spread_right, on=[*on, "_i", "_j"]).drop("_i", "_j")


def measured_small(df: DataFrame, rows: int, settings: Settings, factor: int = 1) -> bool:
    """Whether ``factor`` copies of ``df``, of ``rows`` rows, fit both broadcast limits.

    Its bytes are only summed when the rows fit already.
    """
    if rows * factor > settings.broadcast_rows:
        return False
    width = " + ".join(f"octet_length({c})" for c in df.columns)
    return (df.selectExpr(f"coalesce(sum({width}), 0)").first()[0]) * factor <= settings.broadcast_bytes


def lookup_join(facts: DataFrame, table: DataFrame, on: list[str], small: bool,
                settings: Settings, rows: int | None = None) -> DataFrame:
    """Join facts with a rule table: broadcast when it was measured small, else a shuffle join.

    The facts' first key column may be hot (one property or class with most rows); the rule rows of
    such a key are few compared with the facts and are copied to the cells the facts are spread over.
    ``rows`` bounds the number of facts, if known.
    """
    if small:
        return facts.join(F.broadcast(table), on=on)
    hot = hot_values(facts, on[0], settings, rows)
    return skew_join(facts, table, on, on[0], hot_left=hot, salts=settings.salts)
