"""Removal of long passages that repeat across documents, by seeds and extension.

Every window of 50 words picks one anchor, the word run of ``ANCHOR`` words in it with the smallest hash
(winnowing), so two equal windows pick equal anchors at equal places. Documents meet on anchors. A run of
windows that picks one anchor is first compared as a whole, context included on both sides; documents with the
same run are settled by the smallest id among them. Where an anchor has different runs, only one document of
each run goes on, and its windows are extended one by one. No pair of documents is ever formed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.workspace import Workspace
from .words import mixed, texts, window_hashes, word_codes

WINDOW = 50
ANCHOR = 8

_CHUNK = 1 << 23
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
ANCHORS = "anchor long, run long, doc_id long, mark int, lo int, hi int"


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Spans:
    """Hashes of any spans of one text's words, from prefix sums."""

    def __init__(self, codes: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64),
                                        np.cumsum(mixed(codes) * _powers(_BASE, len(codes)), dtype=np.uint64)])
            self.back = _powers(_INVERSE, len(codes) + 1)

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[last] - self.sums[first]) * self.back[first]
                         + (last - first).astype(np.uint64))


def mark(body: bytes) -> int:
    """Tells rows of one id but different texts apart."""
    return xxhash.xxh32_intdigest(body) - (1 << 31)


def anchor_runs(codes: np.ndarray, width: int = WINDOW, anchor: int = ANCHOR):
    """(anchor hash, run hash, lo, hi): windows lo to hi pick the same anchor; one array each."""
    parts = []
    for base in range(0, max(0, len(codes) - width + 1), _CHUNK):
        part = codes[base:base + _CHUNK + width - 1]
        grams = window_hashes(part, anchor)
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        span, covered = width - anchor + 1, 1
        while 2 * covered <= span:
            keys = np.minimum(keys[:-covered], keys[covered:])
            covered *= 2
        count = len(part) - width + 1
        keys = np.minimum(keys[:count], keys[span - covered:span - covered + count])
        place = (keys & _PLACE).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        hi = np.concatenate([lo[1:] - 1, [count - 1]])
        parts.append((grams[place[lo]], _Spans(part).hashes(lo, hi + width), lo + base, hi + base))
    if not parts:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    return tuple(np.concatenate(x) for x in zip(*parts))


def _seed_rows(width: int, anchor: int):
    def rows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            columns, counts, marks = [], [], []
            for body in texts(batch.column(1)):
                found = anchor_runs(word_codes(body.split()), width, anchor)
                columns.append(found)
                counts.append(len(found[0]))
                marks.append(mark(body))
            if sum(counts):
                hashes, runs, lo, hi = (np.concatenate(x) for x in zip(*columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(runs.view(np.int64)), pa.array(np.repeat(ids, counts)),
                     pa.array(np.repeat(np.array(marks, np.int32), counts)), pa.array(lo.astype(np.int32)),
                     pa.array(hi.astype(np.int32))], ["anchor", "run", "doc_id", "mark", "lo", "hi"])

    return rows


def _window_rows(width: int):
    def rows(batches):
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [[], [], [], []]
            for key, label, body, ranges in zip(ids, marks, texts(batch.column(2)), batch.column(3)):
                if mark(body) != label:
                    continue
                spans = _Spans(word_codes(body.split()))
                both = ranges.values.to_numpy()
                lo, hi = both >> 32, both & 0xFFFFFFFF
                lengths = hi - lo + 1
                starts = np.arange(lengths.sum()) + np.repeat(lo - (np.cumsum(lengths) - lengths), lengths)
                out[0].append(spans.hashes(starts, starts + width).view(np.int64))
                out[1].append(np.full(len(starts), key, np.int64))
                out[2].append(np.full(len(starts), label, np.int32))
                out[3].append(starts.astype(np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out],
                                                 ["span", "doc_id", "mark", "start"])

    return rows


def covered_words(count: int, ranges: np.ndarray, width: int) -> np.ndarray:
    """Which of ``count`` words lie in windows lo to hi, given as lo << 32 | hi."""
    steps = np.zeros(count + 1, np.int64)
    np.add.at(steps, ranges >> 32, 1)
    np.add.at(steps, np.minimum((ranges & 0xFFFFFFFF) + width, count), -1)
    return np.cumsum(steps)[:count] > 0


def _range(lo: str, hi: str):
    return F.shiftleft(F.col(lo).cast("long"), 32).bitwiseOR(F.col(hi).cast("long"))


def repeated_windows(docs: DataFrame, ws: Workspace, width: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, mark, ranges): the windows of each text that also start in a document with a smaller id.

    Only texts with such windows have a row. ``ranges`` holds lo << 32 | hi for windows lo to hi.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    with ws.inner() as first:
        seeds = first.save(docs.mapInArrow(_seed_rows(width, anchor), ANCHORS), "seeds")
        met = seeds.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                          F.min("run").alias("a"), F.max("run").alias("b"))
        met = first.save(met.where("first < last").select("anchor", (F.col("a") != F.col("b")).alias("differs")),
                         "met")
        shared = ws.save(seeds.join(met, "anchor"), ws.unique("shared"))
    runs = shared.groupBy("anchor", "run").agg(F.min("doc_id").alias("least"))
    runs = ws.save(runs, ws.unique("runs"))
    settled = ws.save(shared.join(runs, ["anchor", "run"]).where("doc_id > least or differs").select(
        "doc_id", "mark", _range("lo", "hi").alias("range"), (F.col("doc_id") > F.col("least")).alias("whole")),
        ws.unique("settled"))
    whole = settled.where("whole").select("doc_id", "mark", "range")
    open_runs = settled.where(~F.col("whole")).groupBy("doc_id", "mark").agg(F.collect_list("range").alias("ranges"))
    opened = docs.join(open_runs, "doc_id").select("doc_id", "mark", "text", "ranges")
    windows = ws.save(opened.mapInArrow(_window_rows(width), "span long, doc_id long, mark int, start int"),
                      ws.unique("windows"))
    least = windows.groupBy("span").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"))
    least = ws.save(least.where("least < last").select("span", "least"), ws.unique("spans"))
    single = windows.join(least, "span").where("doc_id > least").select("doc_id", "mark",
                                                                       _range("start", "start").alias("range"))
    return whole.unionByName(single).groupBy("doc_id", "mark").agg(F.collect_list("range").alias("ranges"))


def dedup_substrings(docs: DataFrame, ws: Workspace, width: int = WINDOW, anchor: int = ANCHOR,
                     carry: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row (doc_id, text).

    With ``carry``, also kept_text, which is the text as it was where nothing is removed, and these columns
    of the input.

    Words of any window of ``width`` words whose word sequence also starts in a document of smaller id are
    removed; the others, joined by one space, are kept. Windows are judged on the input. Null and empty texts
    have no words, shorter texts have no window. Rows with one id do not count against each other, and a row
    without an id neither removes nor loses words. Windows are compared by 64-bit hashes.
    """
    with ws.inner() as step:
        found = repeated_windows(docs, step, width, anchor).select("doc_id", "ranges", F.col("mark").alias("found"))
        # Rows of one id but different texts each see the ranges of all; the mark says whose they are.
        found = ws.save(found.groupBy("doc_id").agg(F.collect_list("found").alias("marks"),
                                                    F.collect_list("ranges").alias("ranges")), ws.unique("found"))

    def rows(batches):
        for batch in batches:
            out = [[], [], [], []]
            for body, marks, ranges in zip(texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3)):
                words = (body or b"").split()
                removed = 0
                if marks and body and mark(body) in marks:
                    own = ranges.values[marks.index(mark(body))].values.to_numpy()
                    gone = covered_words(len(words), own, width)
                    removed = int(gone.sum())
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    kept = words
                joined = b" ".join(kept)
                text = joined if removed else body
                for column, value in zip(out, (len(words), removed, hashlib.sha256(joined).hexdigest(), text)):
                    column.append(value)
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if carry is not None:
                arrays += [pa.array(out[3], pa.binary()).cast(pa.string()), *batch.columns[4:]]
                names += ["kept_text", *carry]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string")
    named = docs.select(F.col("doc_id").cast("long"), "text", *(carry or ()))
    if carry is not None:
        schema = T.StructType([*schema, T.StructField("kept_text", T.StringType()), *named.schema[2:]])
    return named.join(found, "doc_id", "left").select(
        "doc_id", "text", "marks", "ranges", *(carry or ())).mapInArrow(rows, schema)
