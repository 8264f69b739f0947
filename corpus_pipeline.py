"""A pipeline from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. The stages hand on
the columns of ``documents``; the last one returns the pieces of the documents with their places in sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplewright.llm import mixing, ngram_join, packing, quality, substring
from triplewright.llm.shipping import ship_package
from triplewright.plans.workspace import Workspace

VOCABULARY = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("document"))
    judged, _ = quality.apply_quality(whole, labels, Workspace(spark), keep=("doc_id", "document"))
    return judged.where("kept").select("document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, and of these with the smallest hash of its text.

    Rows count, not ids: where rows of one id have different texts, each stays or goes by its own text. Documents
    without words are no copies of each other; of rows with the same id and text the first by all columns stays.
    Rows without an id all stay.
    """
    ship_package(spark)
    ws = Workspace(spark)
    groups = ws.save(ngram_join.jaccard_rows(docs, ws).where("doc_id is not null"), ws.unique("groups"))
    first = groups.where("part is not null").groupBy("part").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    alone = groups.where("part is null").select("doc_id", "text_hash").distinct()
    stay = ws.save(first.select("row.*").unionByName(alone), ws.unique("stay"))
    whole = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*docs.columns).alias("document"))
    same = Window.partitionBy("doc_id", "text_hash").orderBy(*[f"document.`{c}`" for c in docs.columns])
    kept = whole.join(stay, ["doc_id", "text_hash"], "left_semi").withColumn("turn", F.row_number().over(same))
    return kept.where("turn = 1").select("document.*").unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has; none is dropped."""
    ship_package(spark)
    others = [c for c in docs.columns if c != "text"]
    whole = docs.select("doc_id", "text", F.struct(*others).alias("document"))
    left = substring.dedup_substrings(whole, Workspace(spark), carry=("document",))
    out = left.select("document.*", F.col("kept_text").alias("text"))
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each document and pass over its source, with the words taken."""
    ship_package(spark)
    return mixing.mixed_documents(docs, Workspace(spark))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    ship_package(spark)
    pieces = packing.tokenized_pieces(docs, public_tokenizers.path(VOCABULARY))
    return packing.pack(pieces, Workspace(spark))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates),
          ("substring_dedup", substring_dedup), ("source_mixing", source_mixing),
          ("best_fit_packing", best_fit_packing)]

#: SQL cannot express the learned list, the schedule or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), ws.unique(name))
    return STAGES[-1][1](spark, docs, sf_dir)
