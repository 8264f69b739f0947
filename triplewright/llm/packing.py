"""Best-fit packing of documents into sequences of a fixed number of tokens.

A packing of pieces depends on their lengths alone, and there are at most ``capacity`` lengths. So Spark
counts the pieces of each length, the driver packs those counts (never the pieces), and every piece finds
its place from its rank among the pieces of its length. The plan has a few thousand rows at any input size.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from ..plans.workspace import Workspace
from .words import texts

CAPACITY = 2048
#: Words, and parts of words, whose ids a task remembers in each of two generations: what was not met since the last
#: one began is forgotten.
REMEMBERED_WORDS = 250_000
REMEMBERED_PARTS = 400_000
#: Bytes of documents that are split into words at the same time, about.
AT_ONCE = 4_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, first_rank long, last_rank long, per_bin long, first_bin long, base long"


class _Remembered(dict):
    """A dictionary of two generations. Keys that are met again move to the younger one; the older one goes when the
    younger is full, so that frequent keys stay however many rare ones pass."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def missing(self, keys: set) -> list:
        """The keys that neither generation has; those of the older one are known from now on."""
        keys = keys.difference(self)
        again = keys & self.older.keys()
        self.update((key, self.older[key]) for key in again)
        return list(keys - again)

    def make_room(self) -> None:
        """Begin a new generation if this one is full. Before the keys of a batch are looked for, not after."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()

    def forget(self) -> None:
        self.clear()
        self.older = {}


class _WordIds:
    """Token ids of white-space separated words as little-endian bytes.

    The vocabulary's pre-tokenizer never joins characters across white space and drops the white space, so
    the ids of a text are those of its words one after the other. It also cuts a word into letters, digits
    and signs, whose ids do not depend on each other; words of plain Latin characters are cut here the
    same way, because far fewer different parts than words need the tokenizer itself. Each different word of some
    documents is looked at once: letters with signs behind them or not as columns, any other word by itself.
    """

    #: Fixed value: the pattern in the vocabulary file.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: The same for lower-case words of the ASCII characters that ``PLAIN`` admits.
    ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
    ASCII = re.compile(rb"(?:(?!<\|)[!-~])+")
    #: Normalised as they are but for case; anything else goes to the tokenizer as a whole word.
    PLAIN = regex.compile(r"(?:(?!<\|)[!-~\u00A1-\u012F\u0131-\u024F])+")

    #: ASCII signs, and the bytes of Latin-1 characters but signs and digits.
    SIGNS = bytes(b for b in range(33, 127) if not bytes([b]).isalnum())
    LATIN = bytes(b for b in range(256) if bytes([b]).isalpha() or 0x80 <= b <= 0xBF or b in (0xC2, 0xC3))
    #: Words of the letters that ``PLAIN`` admits, without the signs behind them.
    LETTERS = "^[A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+$"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words, self.parts = _Remembered(REMEMBERED_WORDS), _Remembered(REMEMBERED_PARTS)

    def forget(self) -> None:
        """Forget all words and parts, but not the vocabulary."""
        self.words.forget()
        self.parts.forget()

    def _encode(self, parts: list[bytes]) -> Iterator[bytes]:
        """Ids of each part, as the vocabulary's pre-tokenizer gives it to the model."""
        model = self.tokenizer.model
        for part in parts:
            text = part.decode()
            if not text.isascii():
                text = self.as_bytes.pre_tokenize_str(text)[0][0]
            yield array("I", [token.id for token in model.tokenize(text)]).tobytes()

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _cut(self, word: bytes) -> list | None:
        """The parts of a word; None if the tokenizer must have it whole."""
        core = word.rstrip(self.SIGNS)  # most words are letters, with signs behind them or not
        if core.isalpha():
            letters = core.lower()
        elif core and not core.translate(None, self.LATIN) and (text := core.decode()).isalpha():
            letters = text.lower().encode()
        else:
            letters = None
        if letters is not None:
            return [letters] if len(core) == len(word) else [letters, word[len(core):]]
        if self.ASCII.fullmatch(word):
            return self.ASCII_PARTS.findall(word.lower())
        text = word.decode()
        return [x.encode() for x in self.PARTS.findall(text.lower())] if self.PLAIN.fullmatch(text) else None

    def _learn(self, new: list[bytes]) -> None:
        self.parts.make_room()
        cut = list(map(self._cut, new))
        missing = self.parts.missing({x for parts in cut if parts for x in parts})
        self.parts.update(zip(missing, self._encode(missing)))
        known = self.parts.__getitem__
        for word, parts in zip(new, cut):
            if parts is None:
                self.words[word] = self._whole(word.decode())
            elif len(parts) == 1:
                self.words[word] = known(parts[0])
            else:
                self.words[word] = b"".join(map(known, parts))

    def of(self, documents: list[bytes | None]) -> Iterator[bytes]:
        first = size = 0
        for at, document in enumerate(documents):
            size += len(document or b"")
            if size >= AT_ONCE or at + 1 == len(documents):
                yield from self._of(documents[first:at + 1])
                first, size = at + 1, 0

    def _of(self, documents: list[bytes | None]) -> Iterator[bytes]:
        split = pc.ascii_split_whitespace(pa.array([d or b"" for d in documents], pa.binary()).cast(pa.string()))
        found = split.flatten().dictionary_encode()
        ids, starts, sizes = self._of_words(found.dictionary)
        word = found.indices.to_numpy()
        ends = 4 * np.concatenate([[0], np.cumsum(sizes[word])])[split.offsets.to_numpy()]
        stream = _gathered(ids, starts[word], sizes[word]).tobytes()
        for first, last in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield stream[first:last]

    def _of_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, and where those of each begin and how many they are."""
        core = pc.ascii_rtrim(words, characters=self.SIGNS.decode())
        easy = pc.match_substring_regex(core, self.LETTERS)
        odd = texts(words.filter(pc.invert(easy)))
        self.words.make_room()
        self._learn(self.words.missing(set(odd)))
        signs = pc.replace_substring_regex(words.filter(easy), self.LETTERS[:-1], "")
        cut = pa.concat_arrays([pc.utf8_lower(core.filter(easy)), signs]).dictionary_encode()
        parts = texts(cut.dictionary)
        self.parts.make_room()
        missing = self.parts.missing(set(parts))
        self.parts.update(zip(missing, self._encode(missing)))

        # Every word is two of these, of which the second may be empty.
        known = [*map(self.parts.__getitem__, parts), *map(self.words.__getitem__, odd), b""]
        easy = easy.to_numpy(zero_copy_only=False)
        two = np.full((len(words), 2), len(known) - 1)
        two[easy] = cut.indices.to_numpy().reshape(2, -1).T
        two[~easy, 0] = len(parts) + np.arange(len(odd))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, two = np.cumsum(sizes) - sizes, two.ravel()
        ids = _gathered(np.frombuffer(b"".join(known), "<u4"), starts[two], sizes[two])
        sizes = sizes[two].reshape(-1, 2).sum(axis=1)
        return ids, np.cumsum(sizes) - sizes, sizes


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start:start + size] of each start and size, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(sizes.sum())]


@lru_cache(maxsize=2)
def _word_ids(path: str) -> _WordIds:
    """One for each worker process, which Spark keeps between tasks."""
    return _WordIds(path)


def _piece_rows(tokenizer_path: str, capacity: int):
    def rows(batches):
        ids = _word_ids(tokenizer_path)
        for batch in batches:
            out = [[], [], [], [], []]
            for key, stream in zip(batch.column(0).to_pylist(), ids.of(texts(batch.column(1)))):
                stream += b"\0\0\0\0"
                view = memoryview(stream)
                for number, at in enumerate(range(0, len(stream), 4 * capacity)):
                    part = view[at:at + 4 * capacity]
                    for column, value in zip(out, (key, number, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])
        # Spark keeps the worker, and what runs in it next has its memory.
        ids.forget()
        pa.default_memory_pool().release_unused()

    return rows


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text",
                     doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``PIECES``: the token ids of each document, then id 0, cut only where longer than ``capacity``.

    A null or empty text gives one piece of one token. Repeated rows give repeated pieces.
    """

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(
        _piece_rows(tokenizer_path, capacity), PIECES)


class _Gaps:
    """Open bins by the room left in them, as ranges of bin numbers."""

    def __init__(self):
        self.ranges = defaultdict(list)
        self.bins = 0

    def new(self, count: int) -> int:
        self.bins += count
        return self.bins - count

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            self.ranges[gap].append((first, count))

    def tightest(self, length: int) -> int | None:
        return min((g for g, r in self.ranges.items() if g >= length and r), default=None)


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of ``PLAN`` that place ``counts[length]`` pieces of each length.

    Pieces over a third of the capacity come first, longest first, each with the longest other one that
    still fits; no bin can hold three of them. All smaller ones, longest first, go to the bin with the
    smallest gap that holds them, or to a new bin. Ranks ``first_rank`` to ``last_rank`` of a length lie in
    bins from ``first_bin`` on, ``per_bin`` to a bin, from offset ``base``.
    """
    left = {k: v for k, v in counts.items() if v}
    used: dict[int, int] = defaultdict(int)
    plan, gaps = [], _Gaps()

    def put(length, count, per_bin, first_bin, base):
        plan.append((length, used[length], used[length] + count - 1, per_bin, first_bin, base))
        used[length] += count
        left[length] -= count

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for length in large:
        while left[length]:
            mate = next((k for k in large if k <= min(length, capacity - length) and left[k] > (k == length)), None)
            if mate is None:
                count = left[length]
                first = gaps.new(count)
                put(length, count, 1, first, 0)
                gaps.add(capacity - length, first, count)
            elif mate == length:
                count = left[length] // 2
                first = gaps.new(count)
                put(length, 2 * count, 2, first, 0)
                gaps.add(capacity - 2 * length, first, count)
            else:
                count = min(left[length], left[mate])
                first = gaps.new(count)
                put(length, count, 1, first, 0)
                put(mate, count, 1, first, length)
                gaps.add(capacity - length - mate, first, count)
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            gap = gaps.tightest(length)
            if gap is None:
                per_bin = capacity // length
                gaps.add(capacity, gaps.new(-(-left[length] // per_bin)), -(-left[length] // per_bin))
                continue
            first, bins = gaps.ranges[gap].pop()
            per_bin = gap // length
            full = min(bins, left[length] // per_bin)
            if full:
                put(length, full * per_bin, per_bin, first, capacity - gap)
                gaps.add(gap - per_bin * length, first, full)
                gaps.add(gap, first + full, bins - full)
            else:
                some = left[length]
                put(length, some, some, first, capacity - gap)
                gaps.add(gap - some * length, first, 1)
                gaps.add(gap, first + 1, bins - 1)
    return plan


def pack(pieces: DataFrame, ws: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of ``PIECES``.

    Ranks within a length are counted in hash buckets and added up, so a length that most pieces have is
    spread over all buckets. Repeated rows are packed as often as they occur; an empty table gives none.
    """
    spark = pieces.sparkSession
    pieces = ws.save(pieces, ws.unique("pieces"))
    buckets = max(64, pieces.count() // 4096)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    cells = ws.save(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), ws.unique("cells"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    counts = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = F.broadcast(spark.createDataFrame(packing_plan(counts, capacity), PLAN))  # bounded by the capacity
    local = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("at", F.row_number().over(local) - 1)
        .join(bases, ["length", "bucket"])
        .withColumn("rank", F.col("ahead") + F.col("at"))
    )
    inside = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(plan, (ranked.length == plan.length) & F.col("rank").between(F.col("first_rank"),
                                                                                F.col("last_rank")))
        .select("doc_id", "piece", "start", ranked.length, "ids_crc32",
                (F.col("first_bin") + F.floor(inside / F.col("per_bin"))).cast("long").alias("sequence_id"),
                (F.col("base") + F.pmod(inside, F.col("per_bin")) * ranked.length).cast("long").alias("offset"))
    )
