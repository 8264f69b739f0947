"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.workspace import Workspace
from . import (divergence, html_extract, langid, licenses, mixing, ngram_join, packing, quality, resampling, sharding,
               substring, topk, url_trust)
from .shipping import ship_package


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """The component of every document under five-word Jaccard links."""
    return ngram_join.jaccard_components(_table(spark, folder, "documents"), Workspace(spark))


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = _table(spark, folder, "pages")
    return html_extract.extract(pages, html_extract.learn(pages, Workspace(spark)))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pieces of at most 2048 tokens, with their places in shared sequences."""
    pieces = packing.tokenized_pieces(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces, Workspace(spark))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Text statistics of every document and whether the base rules and the learned list keep it."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    return quality.apply_quality(docs, labels, Workspace(spark))[0]


def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five best other vectors of every 50th one by integer inner product."""
    ws = Workspace(spark)
    vectors = ws.save(topk.quantised(_table(spark, folder, "embeddings")), "vectors")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document the mix takes."""
    ws = Workspace(spark)
    docs = _table(spark, folder, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    docs = ws.save(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    return mixing.mix(docs, ws)[0].drop("row")


def op7_url_trust(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_trust.judge(_table(spark, folder, "pages").select("page_id", "url", "html"), Workspace(spark))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without passages that a smaller one has."""
    return substring.dedup_substrings(_table(spark, folder, "documents"), Workspace(spark))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    docs = _table(spark, folder, "documents")
    return langid.predict(docs, langid.learn(docs))


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The licenses that every document names, joined by commas, and its number of known sentences."""
    found = licenses.scan_licenses(_table(spark, folder, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_licenses", "n_sentences")


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """The weight of every document towards the benchmark, and the ranks of the tenth that is drawn."""
    docs, target = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    return resampling.resample(docs, target, Workspace(spark)).select("doc_id", "n_features", "weight", "score", "rank")


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every document, and its place there."""
    placed = sharding.shard_by_bytes(_table(spark, folder, "documents"), Workspace(spark))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How far any two sources of a language are apart, and the terms that each has more of."""
    return divergence.audit(_table(spark, folder, "documents"), Workspace(spark))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_html_extraction, op3_best_fit_packing, op4_quality_rules, op5_exact_top_k, op6_source_mixing, op7_url_trust, op8_substring_dedup,
    op9_language_id, op10_license_scan, op11_importance_resampling, op12_sharding, op13_source_divergence)}
ORACLES = {
    "op5_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
                   AS rank, vec_id, score
            FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    # CRC-32 of a word: the table of the 256 bytes, then one step for each byte.
    "op11_importance_resampling": r"""
        WITH steps AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS crc),
        words AS (
            SELECT 'd' AS side, rowid AS row, unnest(regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
            FROM (SELECT row_number() OVER () AS rowid, text FROM documents)
            UNION ALL
            SELECT 'b', 0, unnest(regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
            FROM benchmark),
        placed AS (
            SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(word) + 1),
                       lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT)),
                       lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
            FROM (SELECT DISTINCT word FROM words), steps),
        counts AS (
            SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
            FROM words JOIN placed USING (word) GROUP BY bucket),
        totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
        gains AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
            FROM counts, totals),
        weights AS (
            SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight
            FROM words JOIN placed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
        scored AS (
            SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                   coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
                       + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) LEFT JOIN weights USING (row)),
        ranked AS (
            SELECT *, n_features >= 20 AS enough,
                   row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                   count(*) OVER (PARTITION BY n_features >= 20) AS n
            FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= 10 * n // 100 THEN place END AS rank
        FROM ranked""",
    "op13_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents),
        held AS (
            SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM docs),
        kept AS (SELECT lang, term FROM held GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
        sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM held JOIN kept USING (lang, term) GROUP BY ALL),
        sources AS (SELECT DISTINCT lang, source FROM docs),
        totals AS (
            SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n
            FROM sources LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
        shares AS (
            SELECT t.lang, t.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)) // (n + 5 * v) AS p
            FROM totals t JOIN kept k ON k.lang = t.lang JOIN sizes s ON s.lang = t.lang
            LEFT JOIN counts x ON x.lang = t.lang AND x.source = t.source AND x.term = k.term),
        whole AS (
            SELECT lang, term, 1 + (1000000000 * (sum(c)::HUGEINT + 5)) // ((sum(sum(c)) OVER (PARTITION BY lang))::HUGEINT + 5 * any_value(v)) AS q
            FROM counts JOIN sizes USING (lang) GROUP BY lang, term),
        apart AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE C)::INTEGER AS rank
            FROM found)
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
