"""Quality rules: text statistics in Spark expressions and a learned decision list over them.

The list is learned by sequential covering. Each rule is a conjunction of thresholds that is grown, one
condition at a time, on two thirds of the labelled rows by information gain, then pruned from its end on the
other third. Every step weighs all thresholds between neighbouring values with windows, and one row comes back.
The finished list is an ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.workspace import Workspace

_SPACE = " \t\n\x0b\f\r"
_SPACES = "[\\x20\\x09-\\x0D]+"

#: Labelled rows used at most for learning, those with the smallest hash of their id. Bounds the fit.
LEARNING_ROWS = 20_000
MAX_RULES = 8
MAX_CONDITIONS = 3
#: A rule must be right for this share of the rows it rejects on the pruning rows, and reject this many of them, or
#: this share of the bad ones if that is less.
MIN_PRECISION = 0.95
MIN_REJECTED = 5
MIN_SHARE = 0.1

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_OTHERS = ("n_lines", "n_upper", "n_marks", "n_distinct")


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the counts ``MEASURES``, n_lines, n_upper, n_marks and n_distinct of each whole text.

    A null text counts as empty, and all counts of an empty text are 0. Arrays that a later expression reads
    more than once are made in a projection of their own, so none is computed again for each element.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.trim(body, F.lit(_SPACE))
    none = F.array().cast("array<string>")
    rows = docs.select(*keep, body.alias("_text"), F.when(bare == "", none).otherwise(F.split(bare, _SPACES))
                       .alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.trim(line, F.lit(_SPACE)) != "")
    rows = rows.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_text", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_codes"),
    )
    starts = F.sequence(F.lit(0), F.size("_codes") - 3)
    windows = F.transform(starts, lambda i: F.xxhash64(F.get("_codes", i), F.get("_codes", i + 1),
                                                       F.get("_codes", i + 2)))
    counted = (*keep, "n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_distinct")
    rows = rows.select(
        *counted,
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_codes") >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    counted = (*counted, "n_lines", "n_dup_lines")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.select(*counted, F.when(repeats, F.sort_array(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"))
    same = F.filter("_sorted", lambda x, k: F.coalesce(x["h"] == F.get("_sorted", k + 1)["h"], F.lit(False))
                    | F.coalesce(x["h"] == F.get("_sorted", k - 1)["h"], F.lit(False)))
    rows = rows.select(*counted, F.sort_array(F.transform(same, lambda x: x["i"])).alias("_starts"))
    covered = F.transform("_starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(*counted, F.coalesce(total, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _statistics() -> dict[str, Column]:
    """What the rules test, from the counts; all are 0 where the divisor is."""
    def ratio(a, b):
        return F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"), "word_length": ratio("word_chars", "n_words"),
        "symbols": ratio("n_symbols", "n_words"), "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeats": ratio("n_repeat_words", "n_words"), "upper": ratio("n_upper", "word_chars"),
        "marks": ratio("n_marks", "n_words"), "distinct": ratio("n_distinct", "n_words"),
        "line_words": ratio("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool  # at least the threshold, else below it
    threshold: float

    def column(self) -> Column:
        value = _statistics()[self.statistic]
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.threshold:.6g}"


def _both(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def _grow(rows: DataFrame, refused: set[tuple[str, bool]]) -> tuple[Condition, ...]:
    """Add the condition of highest gain until no good row is left or nothing is gained.

    Thresholds lie half-way between neighbouring values of the rows that the rule rejects so far, so they are
    as fine as the labels need. A rule does not begin with a statistic and direction in ``refused``.
    """
    rule: tuple[Condition, ...] = ()
    along = Window.partitionBy("s").orderBy("value")
    until, whole = along.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("s")
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), v.alias("value")) for s, v in _statistics().items()]))
    for _ in range(MAX_CONDITIONS):
        counts = rows.where(_both(rule)).select(cells.alias("c"), "bad").groupBy("c.s", "c.value").agg(
            F.sum("bad").alias("b"), F.count("*").alias("n"))
        steps = counts.select(
            "s", ((F.col("value") + F.lead("value").over(along)) / 2).alias("threshold"),
            F.sum("b").over(until).alias("b"), F.sum("n").over(until).alias("n"),
            F.sum("b").over(whole).alias("bad"), F.sum("n").over(whole).alias("every"))
        sides = steps.where("threshold is not null and bad < every").select(
            "s", "threshold", "bad", "every", F.explode(F.array(
                F.struct(F.lit(False).alias("above"), F.col("b"), F.col("n")),
                F.struct(F.lit(True).alias("above"), (F.col("bad") - F.col("b")).alias("b"),
                         (F.col("every") - F.col("n")).alias("n")))).alias("side")).select(
            "s", "threshold", "bad", "every", "side.*").where("b > 0")
        if not rule:
            for name, above in sorted(refused):
                sides = sides.where((F.col("s") != name) | (F.col("above") != above))
        gain = F.expr("b * (log2(b / n) - log2(bad / every))")
        best = (sides.withColumn("gain", gain).where("gain > 1e-9")
                .orderBy(F.desc("gain"), "s", "above", "threshold").first())
        if best is None:
            break
        rule = (*rule, Condition(best.s, best.above, best.threshold))
    return rule


def _pruned(rows: DataFrame, rule: tuple[Condition, ...]) -> tuple[tuple[Condition, ...], float, int]:
    """The prefix of the rule that is worth most on the pruning rows, its precision and rejected rows."""
    counts = rows.agg(*[F.sum(F.when(_both(rule[:k]), F.col("bad"))).alias(f"b{k}") for k in range(1, len(rule) + 1)],
                      *[F.count(F.when(_both(rule[:k]), 1)).alias(f"n{k}") for k in range(1, len(rule) + 1)]).first()
    best = max(range(1, len(rule) + 1), key=lambda k: ((2 * (counts[f"b{k}"] or 0) + 1) / (counts[f"n{k}"] + 2), -k))
    n, bad = counts[f"n{best}"], counts[f"b{best}"] or 0
    return rule[:best], bad / n if n else 0.0, n


def learn_rules(statistics: DataFrame, labels: DataFrame, ws: Workspace) -> list[tuple[Condition, ...]]:
    """The ordered rules that reject, from counts of ``text_statistics`` and (doc_id, quality 0 or 1).

    Rows that fail the base rules, have no label or a null one teach nothing; of several labels of a document
    the lowest counts. Every third row of either kind is held out, and a rule joins the list if it is right for
    MIN_PRECISION of the held-out rows it rejects and rejects MIN_REJECTED of them, or MIN_SHARE of the held-out
    bad rows where that is less. One that does not is refused, and the next best first condition is tried. Without a
    good row and two bad ones, one to learn from and one to hold out, there are no rules.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    rows = statistics.where(~base_failed()).join(known, "doc_id").select(
        F.xxhash64("doc_id").alias("mark"), (F.col("quality") == 0).cast("int").alias("bad"),
        *MEASURES, *_OTHERS)
    order = ("mark", *MEASURES, *_OTHERS)
    # At most LEARNING_ROWS rows from here on: one partition holds them, and no step shuffles.
    turn = F.row_number().over(Window.partitionBy("bad").orderBy(*order))
    rows = rows.orderBy(*order, "bad").limit(LEARNING_ROWS).withColumn("held", turn % 3 == 2)
    rows = ws.save(rows, ws.unique("labelled")).coalesce(1)
    held_bad = rows.where("held and bad = 1").count()
    if not held_bad or not rows.where("bad = 0").count():
        return []
    least = min(MIN_REJECTED, max(1, math.ceil(MIN_SHARE * held_bad)))
    rules: list[tuple[Condition, ...]] = []
    refused: set[tuple[str, bool]] = set()
    left = rows
    while len(rules) < MAX_RULES:
        grown = _grow(left.where("not held"), refused)
        if not grown:
            break
        rule, precision, rejected = _pruned(left.where("held"), grown)
        if precision < MIN_PRECISION or rejected < least:
            refused.add((grown[0].statistic, grown[0].above))
            continue
        rules.append(rule)
        left = left.where(~_both(rule))
    return rules


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """Whether a document is kept: the first rule that fits rejects it, and none keeps it."""
    kept = F.when(base_failed(), F.lit(False))
    for rule in rules:
        kept = kept.when(_both(rule), F.lit(False))
    return kept.otherwise(F.lit(True))


def apply_quality(docs: DataFrame, labels: DataFrame, ws: Workspace, text: str = "text",
                  keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, list[tuple[Condition, ...]]]:
    """(``keep``, the measures, base_failed, kept) of each row of ``docs``, and the learned rules."""
    statistics = ws.save(text_statistics(docs, text, keep), ws.unique("statistics"))
    rules = learn_rules(statistics, labels, ws)
    return statistics.select(*keep, *MEASURES, base_failed().alias("base_failed"), verdict(rules).alias("kept")), rules
