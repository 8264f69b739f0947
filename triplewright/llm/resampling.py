"""Importance resampling towards a target: hashed n-gram weights, Gumbel noise, and the k highest scores.

A document's features are kept as an array of bucket numbers, so texts are read once and a weight is a sum over
an array lookup. The k highest scores are found without sorting all of them: a quantile sketch gives a bracket
around the cutoff, exact counts outside the bracket show whether the cutoff lies in it or else widen it, and only
the rows in it are sorted to find the cutoff.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.workspace import Workspace
from .words import texts

BUCKETS = 10_000
MAX_WORDS = 1
MIN_WORDS = 20
SEED = 2024
PERCENT = 10
#: Entries of the sketch per unit of rank, as in ``approx_percentile``; the first bracket is two of them to each side.
ACCURACY = 1000
#: Words whose bucket a worker remembers, in two generations of this size.
REMEMBERED = 400_000

FEATURES = "doc_id long, n_words long, n_features long, buckets binary"
SCORED = "doc_id long, n_words long, n_features long, weight long, score long"
#: A-Z become lower case; of ASCII only digits and letters belong to words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))
_PART = 33  # monotonically_increasing_id() holds the partition above this bit


class Buckets(dict):
    """The bucket of a feature; looked up among the features of this and the last generation first."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets, self.older = buckets, {}

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        found = self.older.get(feature)
        if found is None:
            found = zlib.crc32(feature) % self.buckets
        self[feature] = found
        return found


def features(docs: DataFrame, text: str = "text", doc_id: str | None = "doc_id", buckets: int = BUCKETS,
             max_words: int = MAX_WORDS) -> DataFrame:
    """Rows of ``FEATURES``: the bucket of every run of 1 to ``max_words`` words, as 32-bit numbers.

    A null text, or one without words, has no features. Only the two named columns are read.
    """

    def of(batches):
        known = Buckets(buckets)
        for batch in batches:
            counts, sizes, out = [], [], []
            for content in texts(batch.column(1)):
                words = (content or b"").translate(_WORD_BYTES).split()
                found = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                if max_words > 1:
                    runs = [b" ".join(words[i:i + n]) for n in range(2, max_words + 1)
                            for i in range(len(words) - n + 1)]
                    found = np.concatenate([found, np.fromiter((zlib.crc32(r) % buckets for r in runs), np.uint32,
                                                               len(runs))])
                counts.append(len(words))
                sizes.append(len(found))
                out.append(found.astype(dtype).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())],
                ["doc_id", "n_words", "n_features", "buckets"])

    dtype = _dtype(buckets)
    key = F.lit(None) if doc_id is None else F.col(doc_id)
    return docs.select(key.cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(of, FEATURES)


def _dtype(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features in each bucket. Every task adds up its own, so at most one row for each bucket leaves it."""
    dtype = _dtype(buckets)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(raw, dtype), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    sums = found.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for row in sums.collect():  # bounded by the number of buckets
        out[row.bucket] = row.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """For each bucket 1000 times the log ratio of its smoothed share of the target to that of the source."""
    buckets, all_source, all_target = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (all_source + buckets) / ((s + 1) * (all_target + buckets))))
            for s, t in zip(source, target)]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise that depends on the id alone, in thousandths; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(found: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """Rows of ``SCORED``: a document's weight is the sum of the gains of its features."""
    table, dtype = np.array(gain, np.int64), _dtype(len(gain))

    def score(batches):
        for batch in batches:
            weights = [int(table[np.frombuffer(raw, dtype)].sum()) for raw in batch.column(3).to_pylist()]
            total = [w + noise(i, seed) for w, i in zip(weights, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(weights, pa.int64()), pa.array(total, pa.int64())],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    return found.mapInArrow(score, SCORED)


def numbered(df: DataFrame, ws: Workspace, order: list[Column]) -> DataFrame:
    """``df`` with ``position``, from 0 in this order; ``order`` must tell any two rows apart.

    Rows are sorted by range. A row's place in its own part is known when it is written, and only the counts of
    whole parts are added up in one task.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = ws.save(placed, ws.unique("sorted")).withColumn("_part", F.shiftright("_at", _PART))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    bases = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _PART) - 1))
    return placed.join(bases, "_part").select(*df.columns, (F.col("_base") + inside).cast("long").alias("position"))


def bracket(pool: DataFrame, rows: int, k: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(low, high, above): the k-th highest score lies from ``low`` to ``high``, and ``above`` rows are over ``high``.

    The sketch's bounds are taken only if exact counts agree: fewer than k rows over ``high`` and k or more not
    under ``low``. Otherwise the bracket gets eight times as wide, in the end as wide as all scores.
    """
    width = 2 / accuracy
    while True:
        at = 1 - k / rows
        low, high = max(0.0, at - width), min(1.0, at + width)
        named = pool.agg(F.percentile_approx("score", [low, high], accuracy).alias("q"), F.min("score").alias("least"),
                         F.max("score").alias("most")).first()
        low, high = (named.least if low == 0 else named.q[0]), (named.most if high == 1 else named.q[1])
        over = pool.agg(F.count_if(F.col("score") > high).alias("above"), F.count_if(F.col("score") >= low).alias("held")).first()
        if over.above < k <= over.held:
            return low, high, over.above
        width *= 8


def draw(rows: DataFrame, ws: Workspace, k: int, pool: Column, accuracy: int = ACCURACY) -> DataFrame:
    """Adds ``rank`` to saved ``rows`` (doc_id, score, row, ...): 1 to k for the k highest scores among the rows
    that ``pool`` admits, ties to smaller doc_id (a null one first), null for all others.

    ``row`` holds different values, so that repeated rows are told apart and a large group of them is sorted
    by many tasks. With fewer rows than k all are drawn.
    """
    undrawn = F.lit(None).cast("long").alias("rank")
    held = rows.where(pool)
    n = held.count()
    k = min(k, n)
    if k <= 0:
        return rows.select("*", undrawn)
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    low, high, above = bracket(held, n, k, accuracy)
    near = numbered(held.where(F.col("score").between(low, high)), ws, order)
    sure = numbered(held.where(F.col("score") > high), ws, order)
    return (
        sure.select(*rows.columns, (F.col("position") + 1).alias("rank"))
        .unionByName(near.select(*rows.columns, F.when(F.col("position") < k - above, F.col("position") + above + 1)
                                 .alias("rank")))
        .unionByName(held.where(F.col("score") < low).select("*", undrawn))
        .unionByName(rows.where(~F.coalesce(pool, F.lit(False))).select("*", undrawn))
    )


def resample(docs: DataFrame, target: DataFrame, ws: Workspace, percent: int = PERCENT, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS, max_words: int = MAX_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, row, rank) of every row of ``docs``.

    Of the documents with ``min_words`` words or more, ``percent`` in a hundred are drawn (rounded down). Empty
    tables give no rows; an empty target leaves all its buckets at their smoothed share.
    """
    found = ws.save(features(docs, buckets=buckets, max_words=max_words), ws.unique("features"))
    aim = ws.save(features(target, doc_id=None, buckets=buckets, max_words=max_words), ws.unique("target"))
    gain = gains(bucket_counts(found, buckets), bucket_counts(aim, buckets))
    rows = ws.save(scored(found, gain, seed).withColumn("row", F.monotonically_increasing_id()), ws.unique("scored"))
    enough = F.col("n_words") >= min_words
    return draw(rows, ws, rows.where(enough).count() * percent // 100, enough)
