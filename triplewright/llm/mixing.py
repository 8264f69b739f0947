"""Mixing of sources to target weights by a low-discrepancy schedule.

Targets come from weights by water filling. The schedule gives each of its slots one van der Corput point;
the source whose interval of cumulative target share holds the point gets the slot. Since the points of all
slots are the multiples of a power of two in bit-reversed order, each source lists its own slots, and no
task needs the table of sources. The documents of a source, shuffled by a hash, form a stream of words cut
into blocks of equal size. The r-th slot of a source takes the r-th block, and starts again after the last.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.workspace import Workspace
from .running import running_total
from .words import texts

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 32
#: The mix takes this many half words for each word there is, and at most CEILING times any source.
HALVES = 3
CEILING = 2

_SHARE_BITS = 52
_SPACE = " \t\n\x0b\f\r"
_CHUNK = 1 << 16


def word_count(text: str = "text") -> Column:
    """Number of words of the whole text; 0 if null or without words."""
    bare = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, ws: Workspace) -> DataFrame:
    """(source, source_size, source_no, target) from rows (source, size).

    Sources are numbered by code point, null last, and take the weights in turn. Each round of water filling
    is one aggregate; rounds go on until no target is above its ceiling.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    numbered = running_total(totals, ws, order, "source_size")
    turn = F.pmod(F.col("position"), F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (turn + 1).cast("int")).cast("long")
    table = ws.save(numbered.select("source", "source_size", F.col("position").alias("source_no"),
                                    weight.alias("weight")), ws.unique("sources"))
    ceiling = F.col("source_size") * CEILING
    wanted = (table.agg(F.sum("source_size")).first()[0] or 0) * HALVES / 2
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) > ceiling
        held, weights = table.agg(F.coalesce(F.sum(F.when(full, ceiling)), F.lit(0)),
                                  F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        raised = (wanted - held) / weights if weights else level
        if raised <= level:
            break
        level = raised
    full = F.col("weight") * F.lit(level) > ceiling
    target = F.when(full, ceiling.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return table.select("source", "source_size", "source_no", target.alias("target"))


def _reversed(column: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a long in reverse order."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F),
                        (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        column = (F.shiftleft(column.bitwiseAND(F.lit(mask)), shift)
                  .bitwiseOR(F.shiftrightunsigned(column, shift).bitwiseAND(F.lit(mask))))
    column = F.shiftleft(column, 32).bitwiseOR(F.shiftrightunsigned(column, 32))
    return F.shiftrightunsigned(column, 64 - bits)


def schedule(targets: DataFrame, ws: Workspace, words: float, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source_no, slot): which source each slot of the mix takes, for a mix of ``words`` words."""
    slots = max(1, int(-(-words // block_words)))
    bits = max(1, (slots - 1).bit_length())
    share = F.floor(F.col("target") / F.lit(max(words, 1.0)) * F.lit(float(1 << _SHARE_BITS))).cast("long")
    shares = running_total(targets.select("source_no", share.alias("share")), ws, [F.col("source_no")], "share")
    up = (1 << (_SHARE_BITS - bits)) - 1
    first = F.shiftright(F.col("ahead") + up, _SHARE_BITS - bits)
    last = F.shiftright(F.col("ahead") + F.col("share") + up, _SHARE_BITS - bits) - 1
    ranges = shares.select("source_no", first.alias("first"), last.alias("last")).where("first <= last")
    chunks = ranges.select("source_no", "last", F.explode(F.sequence("first", "last", F.lit(_CHUNK))).alias("lo"))
    points = (
        chunks.repartition("source_no", "lo")
        .select("source_no", F.explode(F.sequence("lo", F.least("last", F.col("lo") + (_CHUNK - 1)))).alias("point"))
    )
    return points.select("source_no", _reversed(F.col("point"), bits).alias("slot")).where(F.col("slot") < slots)


def _slot_ranks(slots: DataFrame, ws: Workspace) -> DataFrame:
    """Adds ``rank``, the number of earlier slots of the same source, counted in stretches of slots."""
    slots = slots.withColumn("stretch", F.shiftright("slot", 12))
    cells = slots.groupBy("source_no", "stretch").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_no").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("source_no", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    local = Window.partitionBy("source_no", "stretch").orderBy("slot")
    return (
        slots.withColumn("at", F.row_number().over(local) - 1).join(bases.hint("merge"), ["source_no", "stretch"])
        .select("source_no", "slot", (F.col("ahead") + F.col("at")).alias("rank"))
    )


def _streams(rows: DataFrame, targets: DataFrame, ws: Workspace, count: int) -> DataFrame:
    """Adds ``begin``, the place of a document's first word in its source's shuffled stream."""
    buckets = max(64, count // 4096)
    rows = (
        rows.join(targets.select("source", "source_no"), rows.source.eqNullSafe(targets.source))
        .select(rows["*"], "source_no")
        .withColumn("mark", F.xxhash64("doc_id"))
        .withColumn("bucket", F.pmod("mark", F.lit(buckets)))
    )
    cells = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("source_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    local = (Window.partitionBy("source_no", "bucket").orderBy("mark", "doc_id", "size", "row")
             .rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("upto", F.sum("size").over(local)).join(bases, ["source_no", "bucket"])
        .select("row", "doc_id", "source_no", "size", (F.col("ahead") + F.col("upto") - F.col("size")).alias("begin"))
    )


def mix(docs: DataFrame, ws: Workspace, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs``, whose columns are row (unique), doc_id, source and size (words).

    Returns (row, doc_id, size, source_size, target, taken) for every row, and (row, epoch, lo, hi) for the
    parts that are taken: words lo to hi (exclusive) of the document in pass ``epoch`` (0 or 1) over its
    source. A document of no words takes part with size 0, a null source is a source, and repeated rows are
    documents of their own. An empty table gives no rows. The result depends on the rows alone.
    """
    docs = ws.save(docs.select("row", "doc_id", "source", "size"), ws.unique("sizes"))
    count = docs.count()
    targets = ws.save(source_targets(docs.select("source", "size"), ws), ws.unique("targets"))
    words = (targets.agg(F.sum("source_size")).first()[0] or 0) * HALVES / 2
    # Written, as Spark takes generated rows for as few as their sources and would broadcast them.
    ranked = _slot_ranks(ws.save(schedule(targets, ws, words, block_words), ws.unique("slots")), ws)
    blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    takes = (
        ranked.join(targets.select("source_no", blocks.alias("blocks")), "source_no")
        .where(F.col("rank") < F.col("blocks") * CEILING)
        .groupBy("source_no", F.pmod("rank", "blocks").alias("block")).agg(F.count("*").alias("takes"))
    )
    streams = ws.save(_streams(docs, targets, ws, count), ws.unique("streams"))
    end = F.col("begin") + F.col("size")
    width = F.lit(block_words)
    pieces = streams.where("size > 0").select(
        "row", "source_no", "begin", end.alias("end"),
        F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((end - 1) / width))).alias("block"))
    taken = pieces.join(takes.hint("merge"), ["source_no", "block"]).select(
        "row", "takes", (F.greatest("begin", F.col("block") * width) - F.col("begin")).alias("lo"),
        (F.least("end", (F.col("block") + 1) * width) - F.col("begin")).alias("hi"))
    # A later pass stops somewhere in the stream, so the blocks it takes of a document lie side by side.
    parts = taken.select("row", F.explode(F.sequence(F.lit(0), (F.col("takes") - 1).cast("int"))).alias("epoch"),
                         "lo", "hi").groupBy("row", "epoch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    parts = ws.save(parts, ws.unique("parts"))
    sums = parts.groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    named = streams.join(targets.select("source_no", "source_size", "target"), "source_no").join(sums, "row", "left")
    return named.select("row", "doc_id", "size", "source_size", "target",
                        F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), parts


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_slice(body: bytes, lo: int, hi: int) -> bytes:
    """The text from its word ``lo`` to the one before ``hi``, with the white space between them."""
    first = last = 0
    for number, word in enumerate(_WORD.finditer(body)):
        if number == lo:
            first = word.start()
        if number == hi - 1:
            last = word.end()
            break
    return body[first:last]


def mixed_documents(docs: DataFrame, ws: Workspace, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents of the mix: rows of ``docs`` (with doc_id, text and source) with the taken text.

    A document has a row for each pass that takes words of it, with all its columns and the taken words as
    text; a whole document keeps its text as it is. ``n_chars``, if there is one, follows the text.
    """
    sized = ws.save(docs.withColumn("_size", word_count("text")).withColumn("_row", F.monotonically_increasing_id()),
                    ws.unique("rows"))
    parts = mix(sized.select(F.col("_row").alias("row"), "doc_id", "source", F.col("_size").alias("size")), ws,
                block_words)[1]
    taken = sized.join(parts.select(F.col("row").alias("_row"), F.col("lo").alias("_lo"),
                                    F.col("hi").alias("_hi")), "_row")
    names, at = docs.columns, docs.columns.index("text")

    def cut(batches):
        for batch in batches:
            lo, hi, size = (batch.column(c).to_pylist() for c in ("_lo", "_hi", "_size"))
            bodies = [body if (a, b) == (0, n) else word_slice(body, a, b)
                      for body, a, b, n in zip(texts(batch.column("text")), lo, hi, size)]
            columns = [batch.column(c) for c in names]
            columns[at] = pa.array(bodies, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    out = taken.select(*names, "_lo", "_hi", "_size").mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
