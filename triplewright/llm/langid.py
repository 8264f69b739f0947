"""Language identification by compression.

Each language has a raw-content zstandard dictionary of labelled text. A text is compressed once with each
dictionary, and the language whose dictionary leaves the fewest bytes is its language.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of what is learned from: documents and characters of each for a language, bytes of a dictionary.
SAMPLE_DOCS = 256
SAMPLE_CHARS = 2048
DICTIONARY_BYTES = 1 << 17
SHARES = 64
LEVEL = 3
#: Best and second best must differ by this share of the second, or the prediction is not accepted.
MIN_MARGIN = 0.01
UNKNOWN = "und"
_OTHER = regex.compile(r"\P{L}+")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _letters(text: str | None) -> bytes:
    """The text's letters in lower case, with one space for any run of other characters."""
    return _OTHER.sub(" ", (text or "").lower()).strip().encode()


def learn(docs: DataFrame) -> list[tuple[str, bytes]]:
    """(language, dictionary), the language with most rows first, from rows (doc_id, text, lang).

    Rows without language, letters or id, and held-out ones, teach nothing. The rows of a language with the
    smallest hashes are taken, so a large language sends no more than its share out of any task.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
                        & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    order = ("mark", "doc_id", "part")
    rows = usable.select("lang", F.xxhash64("doc_id").alias("mark"), "doc_id",
                         F.substring("text", 1, SAMPLE_CHARS).alias("part"))
    # First within shares of a language, so that what many tasks send of one language meets in no single task.
    for share in ((F.pmod("mark", F.lit(SHARES)),), ()):
        ranked = Window.partitionBy("lang", *share).orderBy(*order)
        rows = rows.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= SAMPLE_DOCS)
    rows = rows.collect()
    found: dict[str, list] = {}
    for r in rows:
        found.setdefault(r.lang, []).append((r.n, _letters(r.part)))
    return [(lang, b" ".join(part for _, part in sorted(found[lang]))[:DICTIONARY_BYTES])
            for lang in sorted(found, key=lambda x: (-sizes[x], x))]


@lru_cache(maxsize=1)
def _compressors(languages: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in languages:
        # Zstandard takes no dictionary under 8 bytes.
        known = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(dict_data=known, write_content_size=False)))
    return out


def predict(docs: DataFrame, languages: list[tuple[str, bytes]]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every row, from its whole text alone.

    The score is the share by which the best language beats the next one, 1 if there is no other. Equal
    sizes go to the language with more rows. ``und`` with score 0 is the answer for a text that is null or
    has no letter, and for every text when nothing was learned.
    """
    learned = tuple(languages)

    def run(batches):
        compressors = _compressors(learned)
        for batch in batches:
            out = [[], [], []]
            for text in batch.column(2).to_pylist():
                body = _letters(text)
                sizes = sorted((len(c.compress(body)), i) for i, (_, c) in enumerate(compressors)) if body else []
                if not sizes:
                    name, score = UNKNOWN, 0.0
                else:
                    name = compressors[sizes[0][1]][0]
                    score = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
                for column, value in zip(out, (name, score, bool(sizes) and score >= MIN_MARGIN)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()),
                 pa.array(out[2], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    schema = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"
    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, schema)
