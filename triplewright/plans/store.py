"""The facts of the rule loop, in tables that are laid out by the whole fact.

A large table is bucketed and sorted by (p, o, s). Candidates are shuffled once, into the same buckets, and every
table of known facts is then merged past them as it is on disk: known facts are never shuffled or sorted again.
Sorting by predicate first also lets a scan for a few predicates skip the rest. Small rounds are plain
tables, which are broadcast; when several have come together they are merged into one, so that a long tail of
rounds leaves a logarithmic number of tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..operators.sets import union_all
from ..settings import Settings
from .workspace import (SHUFFLE_PARTITIONS, SHUFFLED_AT_ONCE, Workspace, partitions_for, session_values,
                        shuffles_freed)

#: The order of a fact's terms in buckets and files.
ORDER = ("p", "o", "s")
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
#: Sorted buckets of one file each are read as sorted.
AS_WRITTEN = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


@dataclass(frozen=True)
class Kinds:
    """Facts of one round, by what they say. ``open`` ones have consequences that are not worked out yet."""
    rows: int
    types: int
    sameas: int
    open: int


@dataclass(frozen=True)
class Level:
    """One table: facts of one or more rounds that follow each other."""
    folder: str
    df: DataFrame
    rows: int
    bucketed: bool
    last: int  # its newest round


def distinct_facts(candidates: DataFrame) -> DataFrame:
    """Each candidate once; done by any rule that found it is done.

    The condition always holds. It keeps a predicate that is the same literal for all candidates among the keys, which
    the planner would else drop, and then the buckets would not fit.
    """
    candidates = candidates.withColumn("p", F.when(F.octet_length("s") >= 0, F.col("p")))
    return candidates.groupBy(*ORDER).agg(F.max("property_done").alias("property_done"),
                                          F.max("class_done").alias("class_done"))


class FactStore:
    """Rounds of facts (s, p, o, property_done, class_done, round).

    ``base`` has the facts of round 0, ``newest`` those of the last round and ``levels`` all between them, the
    older ones first. ``counts`` has the number of facts of every round, and ``kinds`` says of what kind they are.
    """

    def __init__(self, workspace: Workspace, settings: Settings, rows: int):
        """``rows`` is the number of facts to start with; it decides the number of buckets."""
        self.workspace, self.settings = workspace, settings
        self.buckets = partitions_for(workspace.spark, rows, settings.bucket_rows)
        self.base: Level | None = None
        self.newest: Level | None = None
        self.levels: list[Level] = []
        self.counts: list[int] = []
        self.kinds: list[Kinds] = []

    @property
    def last(self) -> int:
        return len(self.counts) - 1

    @property
    def total(self) -> int:
        return sum(self.counts)

    def tables(self) -> list[Level]:
        """Every table, each fact in one of them."""
        newest = [self.newest] if self.newest not in (None, self.base) else []
        return [self.base, *self.levels, *newest]

    def known(self) -> DataFrame:
        return _all(self.tables())

    def older(self) -> DataFrame | None:
        """All facts but the newest; None in round 0."""
        return _all([self.base, *self.levels]) if self.last else None

    def derived(self) -> DataFrame:
        """Facts of round 1 and later."""
        return _all(self.tables()[1:]) if len(self.tables()) > 1 else self.base.df.limit(0)

    def since(self, number: int) -> DataFrame:
        """Facts of round ``number`` and later."""
        found = [t for t in self.tables() if t.last >= number]
        return _all(found).where(F.col("round") >= number) if found else self.base.df.limit(0)

    def start(self, facts: DataFrame) -> int:
        """Write round 0."""
        self.base = self.newest = self._write(distinct_facts(facts), 0)
        return self._count()

    def add(self, candidates: DataFrame, narrow: Callable[[DataFrame], DataFrame] = lambda known: known) -> int:
        """Write the candidates (s, p, o, property_done, class_done) that are not known as the next round.

        ``narrow`` may leave out known facts that no candidate can be. After a round with many open facts, candidates
        go straight into their buckets and past the known facts. After another one they are few as a rule: they are
        written and measured first, and if they fit a broadcast the known facts are only scanned for them.
        """
        number = len(self.counts)
        if self.newest is not self.base:
            self.levels.append(self.newest)
        self.newest = None
        fresh, held = distinct_facts(candidates), None
        if self.kinds[-1].open <= self.settings.broadcast_rows:
            held = self.workspace.unique("candidates")
            fresh = self.workspace.save(fresh, held)
            rows, small = self._measured(fresh)
            if rows and small:
                spo = F.broadcast(fresh.select(*ORDER))
                among = narrow(self.known()).select(*ORDER).join(spo, on=list(ORDER), how="left_semi")
                new = fresh.join(among, on=list(ORDER), how="left_anti")
                self.newest = self._write(new, number, bucketed=False)
        if held is None or (rows and not small):
            self.newest = self._write(self.unknown(fresh, narrow), number)
        if held is not None:
            self.workspace.drop(held)
        self._merge()  # nothing that was made from the tables before this round is read any more
        return self._count()

    def add_none(self) -> int:
        """Note a round that found nothing."""
        if self.newest not in (None, self.base):
            self.levels.append(self.newest)
        self.newest = None
        return self._count()

    def _count(self) -> int:
        """Note what the newest round has. Subjects and objects are not read for this."""
        found = Kinds(0, 0, 0, 0)
        if self.newest and self.newest.rows:
            is_type = F.col("p") == v.TYPE
            done = F.when(is_type, F.col("class_done")).otherwise(F.col("property_done"))
            found = Kinds(*self.newest.df.agg(F.count("*"), F.count_if(is_type), F.count_if(F.col("p") == v.SAME_AS),
                                              F.count_if(~done)).first())
        self.counts.append(found.rows)
        self.kinds.append(found)
        return found.rows

    def unknown(self, fresh: DataFrame, narrow: Callable[[DataFrame], DataFrame] = lambda known: known) -> DataFrame:
        """Those of the distinct candidates that no table has, by one merge per large table.

        With as many shuffle partitions as buckets, which ``_write`` sees to, only the candidates are exchanged.
        """
        for level in self.tables():
            known = narrow(level.df).select(*ORDER)
            fresh = fresh.join(known if level.bucketed else F.broadcast(known), on=list(ORDER), how="left_anti")
        return fresh

    def _merge(self) -> None:
        """Merge the last levels where they are alike in size."""
        fanout, rows, alike = self.settings.merge_fanout, 0, 0
        for level in reversed(self.levels):
            if rows and level.rows > fanout * rows:
                break
            rows, alike = rows + level.rows, alike + 1
        if alike >= fanout:
            merged = self.levels[-alike:]
            both = _all(merged)
            small = all(not m.bucketed for m in merged) and self._measured(both)[1]
            self.levels[-alike:] = [self._write(both, merged[-1].last, bucketed=not small, merging=True)]
            for level in merged:
                self.workspace.drop(level.folder)

    def _measured(self, facts: DataFrame) -> tuple[int, bool]:
        """Rows, and whether they and a few times as many fit a broadcast."""
        n, nbytes = facts.selectExpr(
            "count(*)", "coalesce(sum(octet_length(s) + octet_length(p) + octet_length(o)), 0)").first()
        room = self.settings.merge_fanout
        return n, n * room <= self.settings.broadcast_rows and nbytes * room <= self.settings.broadcast_bytes

    def _write(self, facts: DataFrame, number: int, bucketed: bool = True, merging: bool = False) -> Level:
        """Write a table. ``number`` is its newest round, and of all its rows unless tables are merged."""
        spark, folder = self.workspace.spark, self.workspace.unique("facts")
        path = f"{self.workspace.root}/{folder}"
        own = F.col("round") if merging else F.lit(number).alias("round")
        facts = facts.select("s", "p", "o", "property_done", "class_done", own)
        if bucketed:
            # The catalog's name is needed only to write and to open a bucketed table; the files are the workspace's.
            name = f"triplewright_{uuid.uuid4().hex}"
            width = {SHUFFLE_PARTITIONS: str(self.buckets)} | AS_WRITTEN | SHUFFLED_AT_ONCE
            with shuffles_freed(spark), session_values(spark, width):
                if merging:
                    facts = facts.repartition(self.buckets, *ORDER)
                (facts.write.format("parquet").mode("errorifexists").option("path", path).option("maxRecordsPerFile", 0)
                 .options(**PACKED).bucketBy(self.buckets, *ORDER).sortBy(*ORDER).saveAsTable(name))
            df = spark.table(name)
            spark.sql(f"DROP TABLE {name}")
        else:
            df = self.workspace.save(facts.coalesce(1), folder)
        return Level(folder, df, df.count(), bucketed, number)


def _all(levels: list[Level]) -> DataFrame:
    return union_all([level.df for level in levels])
