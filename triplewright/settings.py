"""Limits that decide between physical forms of the same join. None of them changes a result."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "spark.triplewright."


@dataclass(frozen=True)
class Settings:
    # A rule table is broadcast only while its measured size is under both limits.
    broadcast_rows: int = 1_000_000
    broadcast_bytes: int = 64 * 1024 * 1024
    # At most this many predicate names are put into a scan filter; more go into a broadcast semi join.
    filter_values: int = 200
    # A rule table is broadcast to the newest facts while it has no more rows than they, or than this.
    lookup_rows: int = 10_000
    # Files of a round are cut at this many rows, so that the next round can split the work evenly.
    rows_per_file: int = 4_000_000
    # Known facts are kept in buckets of about this many rows, sorted, and a large step gets as many partitions: what a
    # task sorts or adds up, a few candidates for each fact, must fit its memory.
    bucket_rows: int = 500_000
    # As many rounds of about one size, in rows, are merged into one table.
    merge_fanout: int = 4
    # Consequences of a class are written into the rules that lead to it while that makes no more rows than this.
    compose_rows: int = 1_000_000
    # Pairs of a class of equal nodes are formed from blocks of about this many nodes.
    pair_block: int = 2_000
    # A join key holding more than this share of the rows that a join reads is spread over cells of about
    # `cell_rows` of its rows, and over `salts` cells at least.
    hot_share: float = 0.01
    salts: int = 32
    cell_rows: int = 100_000
    # A key is spread so that no cell gives more pairs than this, and none is looked for while even one that
    # holds half of the rows on each side would give no more.
    pairs_per_task: int = 25_000_000

    @classmethod
    def of(cls, spark: SparkSession) -> "Settings":
        """The defaults, with those replaced that the session sets as spark.triplewright.<name>."""
        given = {f.name: spark.conf.get(PREFIX + f.name, None) for f in fields(cls)}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in given.items() if v is not None})


def session_conf() -> dict[str, str]:
    """Session settings that suit the rule loop; apply them to the SparkSession builder."""
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Joins whose partitions turn out small need no sort.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        # The two parts of a round are written side by side instead of sorting the rows first.
        "spark.sql.maxConcurrentOutputFileWriters": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
