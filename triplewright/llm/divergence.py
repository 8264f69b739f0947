"""How the sources of a language differ in their words, by chunk factorization.

Texts are cut at white space only, and documents are kept in blocks: a block has a list of its distinct chunks,
and for each document the numbers of its chunks with their counts. Blocks deal their chunks to buckets by a hash,
and a bucket, where equal chunks of all blocks meet, cuts every distinct one into terms once and hands the terms
back to the blocks. Each block then counts distinct documents and occurrences of its terms and deals the counts
to buckets of terms, where those of all blocks are added up and the terms of too few documents are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..plans.workspace import Workspace
from ..settings import Settings
from .words import texts

MIN_DOCUMENTS = 30
RANKS = 50
#: A block ends after this many bytes of text.
BLOCK_BYTES = 24_000_000
#: Bytes of text of a block that are split at the same time, about.
AT_ONCE = 4_000_000
#: Chunks of the documents of a block whose terms are counted at the same time, about, and rows handed on at once.
ENTRIES_AT_ONCE = 250_000
ROWS_AT_ONCE = 20_000
#: Buckets are as many as it takes for each to get about this many bytes of the blocks' chunks.
BUCKET_BYTES = 8_000_000
SCALE = 1_000_000_000
SMOOTH = 5

BLOCKS = ("block long, chunks array<string>, langs array<string>, sources array<string>, postings binary, "
          "chunk_bytes long")
TERMS = "chunk string, terms string"
#: Cells are rows as a compressed Arrow stream: the chunks of a block in one bucket (number, chunk), or their terms
#: (number, terms), or rows of ``PARTIAL`` of a block in one bucket.
CHUNK_CELLS = "block long, bucket int, cell binary"
TERM_CELLS = "of_block long, cell binary"
PARTIAL = "lang string, term string, docs long, sources array<string>, occurrences array<long>"
COUNT_CELLS = "bucket int, cell binary"
COUNTS = "lang string, term string, held array<struct<source: string, occurrences: long>>"
#: A-Z become lower case; of ASCII only letters belong to terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_IN_TERMS = r"[A-Za-z]|[^\x00-\x7F]"


class _Numbers(dict):
    """Numbers new keys from 0."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


class _Block:
    """Documents as numbered chunks with counts; chunks without a character of a term are left out."""

    def __init__(self):
        self.groups, self.size = _Numbers(), 0
        self.doc_group, self.contents, self.doc_size, self.names, self.ids, self.counts = [], [], [], [], [], []
        self.waiting = 0

    def add(self, group: tuple[bytes, bytes], content: bytes) -> None:
        self.size += len(content)
        self.waiting += len(content)
        self.doc_group.append(self.groups[group])
        self.contents.append(content)
        if self.waiting >= AT_ONCE:
            self._count()

    def _count(self) -> None:
        """Number and count the chunks of the documents that wait; numbers are those of ``names`` for now."""
        split = pc.ascii_split_whitespace(_strings(self.contents))
        found = split.flatten().dictionary_encode()
        document = np.repeat(np.arange(len(split), dtype=np.int64), np.diff(split.offsets.to_numpy()))
        width = max(1, len(found.dictionary))
        each, counts = np.unique(document * width + found.indices.to_numpy(), return_counts=True)
        useful = pc.match_substring_regex(found.dictionary, _IN_TERMS).to_numpy(zero_copy_only=False)
        kept = useful[each % width] if len(each) else np.zeros(0, bool)
        each, counts = each[kept], counts[kept]
        self.doc_size.append(np.bincount(each // width, minlength=len(split)).astype(np.uint32))
        before = sum(map(len, self.names))
        self.names.append(found.dictionary.filter(pa.array(useful)))
        self.ids.append(((np.cumsum(useful) - 1)[each % width] + before).astype(np.int32))
        self.counts.append(counts.astype(np.uint32))
        self.contents, self.waiting = [], 0

    def record(self) -> pa.RecordBatch:
        if self.contents:
            self._count()
        coded = pa.concat_arrays(self.names).dictionary_encode()
        numbers, self.names = coded.indices.to_numpy(), []
        for i, (sizes, ids) in enumerate(zip(self.doc_size, self.ids)):
            # Ids rise within a document.
            ids = numbers[ids]
            document = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
            order = np.argsort(document * max(1, len(coded.dictionary)) + ids)
            self.ids[i], self.counts[i] = ids[order], self.counts[i][order]
        packed = _pack(np.array(self.doc_group), *map(np.concatenate, (self.doc_size, self.ids, self.counts)))
        langs, sources = (_strings([g[i] for g in self.groups]) for i in (0, 1))
        lists = coded.dictionary, langs, sources
        return pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int64()),
             *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists),
             pa.array([packed], pa.binary()), pa.array([pc.binary_length(coded.dictionary).to_numpy().sum()], pa.int64())],
            [c.split()[0] for c in BLOCKS.split(", ")])


def _pack(doc_group: np.ndarray, doc_size: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Postings as four arrays, compressed. Ids rise within a document and are kept as steps, halves apart."""
    steps = np.diff(ids, prepend=ids.dtype.type(0))
    starts = (np.cumsum(doc_size, dtype=np.int64) - doc_size)[doc_size > 0]
    steps[starts] = ids[starts]
    steps = steps.astype("<u4")
    planes = [doc_group.astype("<u4"), doc_size.astype("<u4"), (steps & 0xFFFF).astype("<u2"),
              (steps >> 16).astype("<u2"), counts.astype("<u4")]
    sizes = np.array([len(doc_size), len(ids)], "<u8")
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(p.tobytes() for p in planes))


def _unpacked(packed: bytes, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_group, doc_size, ids and counts of some documents after the others, with about ``at_once`` ids each time."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    documents, n = np.frombuffer(raw, "<u8", 2).tolist()
    at, planes = 16, []
    for dtype, length in (("<u4", documents), ("<u4", documents), ("<u2", n), ("<u2", n), ("<u4", n)):
        planes.append(np.frombuffer(raw, dtype, length, at))
        at += length * int(dtype[2])
    doc_group, doc_size, low, high, counts = planes
    ends = np.cumsum(doc_size, dtype=np.int64)
    first = lo = 0
    while first < documents:
        last = max(first + 1, int(np.searchsorted(ends, lo + at_once, "right")))
        hi, sizes = int(ends[last - 1]), doc_size[first:last].astype(np.int64)
        total = np.cumsum(low[lo:hi].astype(np.int64) | high[lo:hi].astype(np.int64) << 16)
        before = np.concatenate([[0], total])[np.cumsum(sizes) - sizes]
        yield (doc_group[first:last].astype(np.int64), sizes, total - np.repeat(before, sizes),
               counts[lo:hi].astype(np.int64))
        first, lo = last, hi


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_group, doc_size, ids and counts of all documents of a block."""
    return next(_unpacked(packed, 1 << 62))


def blocks(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``BLOCKS``: documents as counted white-space chunks, several documents to a block.

    Chunks are runs of other bytes than the six ASCII white-space characters; no term reaches over one of these.
    A null text, lang or source is an empty one.
    """

    def of(batches):
        block = _Block()
        for batch in batches:
            for group, content in _documents(batch):
                block.add(group, content)
                if block.size >= block_bytes:
                    yield block.record()
                    block = _Block()
                    pa.default_memory_pool().release_unused()
        if block.doc_group:
            yield block.record()
        del block
        pa.default_memory_pool().release_unused()

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                          for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    return plain.mapInArrow(of, BLOCKS).withColumn("block", F.monotonically_increasing_id())


def _documents(batch: pa.RecordBatch, at_once: int = 256) -> Iterator[tuple[tuple[bytes, bytes], bytes]]:
    for at in range(0, batch.num_rows, at_once):
        part = batch.slice(at, at_once)
        for one_lang, one_source, content in zip(*(texts(part.column(i)) for i in range(3))):
            yield (one_lang, one_source), content


def _cut(chunks: pa.Array) -> pa.Array:
    """The terms of each chunk in order, with repeats, joined by one space: less work to shuffle than an array."""
    # A chunk holds no white space, so what is split here are its terms.
    return _strings([b" ".join(c.translate(_TERM_BYTES).split()) for c in texts(chunks)])


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """(chunk, terms): the terms of each chunk in order, with repeats, as an array; chunks without terms are left out."""

    def cut(batches):
        for batch in batches:
            terms = _cut(batch.column(0))
            out = pa.RecordBatch.from_arrays([batch.column(0), terms], ["chunk", "terms"])
            yield out.filter(pc.greater(pc.binary_length(terms), 0))

    return chunks.select("chunk").mapInArrow(cut, TERMS).select("chunk", F.split("terms", " ").alias("terms"))


def _dealt(rows: pa.Table, by: str, buckets: int) -> tuple[pa.Array, pa.Array]:
    """The buckets that get some of these rows, by the hash of a string column, and the cell of each."""
    values = pa.concat_arrays(rows.column(by).chunks or [pa.array([], pa.string())])
    bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, texts(values)), np.uint64, len(values)) % np.uint64(buckets)
    bucket = bucket.astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows.take(pa.array(order))
    starts = np.flatnonzero(np.diff(bucket, prepend=np.int32(-1)))
    cells = [_cell(rows.slice(lo, hi - lo)) for lo, hi in zip(starts, [*starts[1:], len(order)])]
    return pa.array(bucket[starts], pa.int32()), pa.array(cells, pa.binary())


def _cell(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _rows(cells: pa.ChunkedArray) -> list[pa.Table]:
    """The rows of each cell."""
    return [pa.ipc.open_stream(c.as_buffer()).read_all() for c in cells]


def _chunk_cells(held: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``CHUNK_CELLS``: the chunks of each block by bucket."""

    def deal(batches):
        for batch in batches:
            for block, chunks in zip(batch.column(0), batch.column(1)):
                numbered = pa.table([pa.array(np.arange(len(chunks), dtype=np.int32)), chunks.values], ["number", "chunk"])
                found, cells = _dealt(numbered, "chunk", buckets)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(found), pa.int64()), found, cells],
                                                 ["block", "bucket", "cell"])

    return held.select("block", "chunks").mapInArrow(deal, CHUNK_CELLS)


def _cut_bucket(cells: pa.Table) -> pa.Table:
    """Rows of ``TERM_CELLS`` for the chunks of one bucket; each distinct chunk is cut once."""
    parts = _rows(cells.column("cell"))
    coded = pa.concat_arrays([c for p in parts for c in p.column("chunk").chunks]).dictionary_encode()
    terms, at, out = _cut(coded.dictionary), 0, []
    for part in parts:
        mine = terms.take(coded.indices.slice(at, len(part)))
        out.append(_cell(pa.table([part.column("number"), mine], ["number", "terms"])))
        at += len(part)
    return pa.table([cells.column("block"), pa.array(out, pa.binary())], ["of_block", "cell"])


def _count_block(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows of ``PARTIAL`` of one block, from its postings and from the terms of its chunks."""
    columns = [c.split()[0] for c in PARTIAL.split(", ")]
    empty = pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()),
                                                pa.list_(pa.int64()))], names=columns)
    if not left.num_rows or not right.num_rows:
        return empty
    row = left.select(["langs", "sources", "postings"]).to_pylist()[0]

    # Terms of chunk i are codes[first[i]:first[i] + size[i]]; a chunk without a row has none.
    lists = pc.ascii_split_whitespace(right.column("terms").combine_chunks())
    coded = lists.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary
    place = right.column("number").to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    first, size = np.zeros(int(place.max()) + 2, np.int64), np.zeros(int(place.max()) + 2, np.int64)
    first[place], size[place] = np.cumsum(sizes) - sizes, sizes

    # Groups numbered so that those of a language follow each other.
    order = sorted(range(len(row["langs"])), key=lambda g: (row["langs"][g], row["sources"][g]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    langs = [row["langs"][g] for g in order]
    lang_of = np.cumsum([False, *(a != b for a, b in zip(langs, langs[1:]))])

    # Some documents at a time: one entry for each of them, chunk and term of it; then one for each document and term;
    # then one for each language, term and group, with its documents and occurrences.
    parts = []
    for doc_group, doc_size, ids, counts in _unpacked(row["postings"], ENTRIES_AT_ONCE):
        ids = np.minimum(ids, len(size) - 1)
        each = size[ids]
        if not each.sum():
            continue
        inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        held = codes[np.repeat(first[ids], each) + inside].astype(np.int64)
        held += np.repeat(np.repeat(np.arange(len(doc_size)), doc_size), each) * len(names)
        held, occurrences = _summed(held, np.repeat(counts, each))
        group = rank[doc_group[held // len(names)]]
        wide = (lang_of[group] * len(names) + held % len(names)) * len(order) + group
        parts.append(_summed(wide, occurrences, np.ones(len(wide), np.int64)))
    if not parts:
        return empty
    found, sums, docs = _summed(*map(np.concatenate, zip(*parts)))
    by_term = found // len(order)
    starts = np.flatnonzero(np.diff(by_term, prepend=-1))
    ends = pa.array(np.append(starts, len(found)).astype(np.int32))
    lang_names = pa.array(list(dict.fromkeys(langs)), pa.string())
    sources = pa.array([row["sources"][g] for g in order], pa.string())
    out = pa.table([
        lang_names.take(pa.array(by_term[starts] // len(names))),
        names.cast(pa.string()).take(pa.array(by_term[starts] % len(names))),
        pa.array(np.add.reduceat(docs, starts)),
        pa.ListArray.from_arrays(ends, sources.take(pa.array(found % len(order)))),
        pa.ListArray.from_arrays(ends, pa.array(sums)),
    ], names=columns)
    pa.default_memory_pool().release_unused()
    return pa.Table.from_batches(out.to_batches(max_chunksize=ROWS_AT_ONCE))


def _count_cells(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    """Rows of ``COUNT_CELLS`` of one block, from its postings and its rows of ``TERM_CELLS``."""
    none = pa.table([pa.array([], pa.int32()), pa.array([], pa.string())], ["number", "terms"])
    counted = _count_block(None, left, pa.concat_tables([none, *_rows(right.column("cell"))])).combine_chunks()
    return pa.table(_dealt(counted, "term", buckets), ["bucket", "cell"])


def _add_cells(cells: pa.Table, min_documents: int) -> pa.Table:
    """Rows of ``COUNTS`` for the terms of one bucket that ``min_documents`` documents of the language hold."""
    partial = pa.concat_tables(_rows(cells.column("cell"))).combine_chunks()
    lang, term = (pa.concat_arrays(partial.column(c).chunks).dictionary_encode() for c in ("lang", "term"))
    key = lang.indices.to_numpy().astype(np.int64) * len(term.dictionary) + term.indices.to_numpy()
    keys, docs = _summed(key, partial.column("docs").to_numpy())
    keys = keys[docs >= min_documents]

    # One entry for each row of a kept term and source of it, then one for each kept term and source.
    mine = np.isin(key, keys)
    partial, key = partial.filter(pa.array(mine)), key[mine]
    listed, sums = (pa.concat_arrays(partial.column(c).chunks or [pa.array([], partial.schema.field(c).type)])
                    for c in ("sources", "occurrences"))
    sources = listed.flatten().dictionary_encode()
    width = max(1, len(sources.dictionary))
    entry = np.repeat(np.searchsorted(keys, key), listed.value_lengths().to_numpy()) * width + sources.indices.to_numpy()
    if len(entry):
        entry, sums = _summed(entry, sums.flatten().to_numpy())
    else:
        sums = np.zeros(0, np.int64)
    ends = np.searchsorted(entry // width, np.arange(len(keys) + 1)).astype(np.int32)
    held = pa.StructArray.from_arrays([sources.dictionary.take(pa.array(entry % width)), pa.array(sums, pa.int64())],
                                      ["source", "occurrences"])
    out = pa.table([lang.dictionary.take(pa.array(keys // len(term.dictionary))),
                    term.dictionary.take(pa.array(keys % len(term.dictionary))),
                    pa.ListArray.from_arrays(pa.array(ends), held)], ["lang", "term", "held"])
    pa.default_memory_pool().release_unused()
    return pa.Table.from_batches(out.to_batches(max_chunksize=ROWS_AT_ONCE), out.schema)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], *(np.add.reduceat(v[order], starts) for v in values)


def term_counts(docs: DataFrame, ws: Workspace, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, held) of the terms that ``min_documents`` documents of the language hold; ``held`` has an entry
    (source, occurrences) for each source with the term.

    Chunks and counts travel as cells, one for each block and bucket, so no step has a row for each chunk of a block.
    """
    with ws.inner() as step:
        held = step.save(blocks(docs), "blocks")
        nbytes = held.agg(F.sum("chunk_bytes").alias("n")).first().n or 0
        buckets = -(-nbytes // BUCKET_BYTES) or 1
        terms = _chunk_cells(held, buckets).groupBy("bucket").applyInArrow(_cut_bucket, TERM_CELLS)
        counted = held.drop("chunks", "chunk_bytes").groupBy("block").cogroup(terms.groupBy("of_block")).applyInArrow(
            lambda left, right: _count_cells(left, right, buckets), COUNT_CELLS)
        counts = counted.groupBy("bucket").applyInArrow(lambda cells: _add_cells(cells, min_documents), COUNTS)
        return ws.save(counts, ws.unique("counts"))


def _share(count: str, total: str, terms: str) -> str:
    """The smoothed share of a count, as an integer; decimals hold any count exactly."""
    return (f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + {SMOOTH} as decimal(20, 0))) "
            f"div cast({total} + {SMOOTH} * {terms} as decimal(20, 0))")


def _pair_sums(batches):
    """Sums of the differences of any two sources, one row for each pair of a language in this task."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        zero, held = batch.column(1), batch.column(2)
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in dict.fromkeys(langs):
            mine = np.flatnonzero(langs == lang)
            base = np.array(zero[int(mine[0])].as_py(), np.int64)
            total = totals.setdefault(lang, np.zeros((len(base), len(base)), np.int64))
            step = max(1, 4_000_000 // len(base))
            for at in range(0, len(mine), step):
                lists = held.take(pa.array(mine[at:at + step]))
                flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
                shares = np.tile(base, (len(lists), 1))
                shares[np.repeat(np.arange(len(lists)), sizes), flat.field(0).to_numpy()] = flat.field(1).to_numpy()
                shares = np.ascontiguousarray(shares.T)
                for i in range(len(base)):
                    total[i] += np.abs(shares - shares[i]).sum(axis=1)
    for lang, total in totals.items():
        i, j = np.nonzero(~np.eye(len(total), dtype=bool))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
            ["lang", "i", "j", "value"])


def audit(docs: DataFrame, ws: Workspace, min_documents: int = MIN_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far any two sources of a language are apart (part ``pair``),
    and the terms that a source has more of than its language (part ``term``).

    Every (lang, source) that occurs is a group, with texts or without. Null values count as empty strings and
    an empty table gives no rows. The pairs of a language's sources are the result itself, so they are formed.
    """
    settings = Settings.of(docs.sparkSession)
    per_term = term_counts(docs, ws, min_documents).withColumn(
        "lang_count", F.aggregate("held", F.lit(0).cast("long"), lambda n, h: n + h["occurrences"]))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = per_term.select("lang", F.inline("held")).groupBy("lang", "source").agg(F.sum("occurrences").alias("n"))
    groups = ws.save(groups.join(sums, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)).alias("n")), ws.unique("groups"))
    sizes = per_term.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_count").alias("lang_n"))
    # One row for each language that has kept terms: its sources in order, with their totals and shares of no occurrence.
    langs = ws.save(
        groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("s"))
        .join(sizes, "lang").selectExpr("lang", "terms", "lang_n", "s.source as names", "s.n as totals",
                                        f"transform(s.n, n -> {_share('0', 'n', 'terms')}) as zero"), ws.unique("langs"))
    fits = langs.selectExpr("coalesce(sum(24 * size(names)), 0) as b").first().b <= settings.broadcast_bytes
    placed = ws.save(lookup_join(per_term, langs, ["lang"], fits, settings).selectExpr(
        "lang", "term", "names", "zero", f"{_share('lang_count', 'lang_n', 'terms')} as q",
        f"""transform(transform(held, h -> struct(cast(array_position(names, h.source) - 1 as int) as i,
                                                  h.occurrences as c)),
                      h -> struct(h.i as i, {_share('h.c', 'totals[h.i]', 'terms')} as p)) as held"""), ws.unique("shares"))

    apart = placed.select("lang", "zero", "held").mapInArrow(_pair_sums, "lang string, i int, j int, value long")
    named = langs.selectExpr("lang as l", "names")
    apart = (apart.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
             .join(named, F.col("lang") == F.col("l"))
             .selectExpr("lang", "names[i] as source", "names[j] as item", "value"))
    other = groups.selectExpr("lang", "source as item")
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item")
    pairs = pairs.join(apart, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    more = placed.select("lang", "term", "names", "q", F.inline("held")).where("p > q").selectExpr(
        "lang", "names[i] as source", "'term' as part", "term as item", "p - q as value")
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(best)) for df in (pairs, more)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= ranks))
