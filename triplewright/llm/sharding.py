"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record's slot is a hash of its id and content, and there are always ``SLOTS`` of them. What changes is only the
map, a table of one row for each slot: when shards differ too much in bytes, or when there is to be one shard
more, some slots are given to other shards and the edited map is stored as the next version. Everything here is
DataFrame functions; what the map needs are byte and row totals of the slots, so its size never depends on the
input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.workspace import Workspace

SLOTS = 4096
SHARDS = 8
#: Rows that one cell of the numbering should have; slots with more rows have more cells.
CELL_ROWS = 4096


def records(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row; other columns are not read.

    The size is the UTF-8 bytes of the text plus 1. A null text is one without bytes. Rows with the same id and
    text have the same slot, and a null id is one more id.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                        (F.octet_length(content) + 1).cast("long").alias("size"),
                        F.crc32(content).cast("long").alias("text_crc32"))
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def slot_loads(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows) of the slots in use, summed in each task before anything is shuffled."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


class SlotMaps:
    """Versions of a slot-to-shard map, (virtual_slot, shard), each a Parquet folder under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [f.getPath().getName() for f in files.listStatus(path)]
        return sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-"))

    def read(self, version: int | None = None) -> DataFrame:
        """A stored version, by default the newest."""
        version = self.versions()[-1] if version is None else version
        return self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.folder}/version-{version:06d}")

    def store(self, table: DataFrame) -> DataFrame:
        """Write ``table`` as the next version."""
        known = self.versions()
        version = known[-1] + 1 if known else 0
        table.select("virtual_slot", "shard").coalesce(1).write.parquet(f"{self.folder}/version-{version:06d}")
        return self.read(version)

    def first(self, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
        """The map to start with: slots dealt out in turn."""
        return self.store(self.spark.range(slots).selectExpr("cast(id as int) as virtual_slot",
                                                             f"cast(id % {int(shards)} as int) as shard"))

    def rebalance(self, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
        """Store the newest map edited so that the bytes of the shards are nearly equal.

        A shard over the mean gives up its smallest slots until it is not over it any more, and what was given
        up goes, largest first, to the shard that has the least. All other slots stay where they are.
        """
        held = _held(self.read(), loads, shards)
        stay = held.where("stays").select("virtual_slot", "shard")
        return self.store(stay.unionByName(_placed(held, shards)))

    def grow(self, loads: DataFrame, shards: int) -> DataFrame:
        """Store the newest map with shard number ``shards`` added: slots move to the new shard only."""
        held = _held(self.read(), loads, shards + 1)
        return self.store(held.select(
            "virtual_slot", F.when(F.col("stays"), F.col("shard")).otherwise(F.lit(shards)).alias("shard")))


def _held(table: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The map with the bytes of each slot, and whether a slot stays when no shard may exceed the mean.

    A shard's largest slot stays anyway, as no other shard would be better for it.
    """
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    everything = Window.partitionBy()  # the slots, never the records
    return (
        table.join(loads, "virtual_slot", "left")
        .select("virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
        .withColumn("running", F.sum("bytes").over(largest_first))
        .withColumn("mean", F.sum("bytes").over(everything) / shards)
        .withColumn("stays", (F.col("shard") < shards) & (
            (F.col("running") <= F.col("mean")) | (F.row_number().over(largest_first) == 1)))
        .select("virtual_slot", "shard", "bytes", "stays")
    )


def _placed(held: DataFrame, shards: int) -> DataFrame:
    """(virtual_slot, shard) for the slots that do not stay: each goes to the shard with the least bytes so far.

    The arrays have one entry for each shard, and at most one for each slot.
    """
    given_up = F.when(~F.col("stays"), F.struct("bytes", "virtual_slot"))
    parts = held.groupBy("shard").agg(F.sum(F.when(F.col("stays"), F.col("bytes"))).alias("kept"),
                                      F.collect_list(given_up).alias("waiting"))
    every = held.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    state = every.join(parts, "shard", "full").agg(
        F.expr(f"""transform(filter(sort_array(collect_list(struct(shard, coalesce(kept, 0L) as kept))),
                                    x -> x.shard < {int(shards)}), x -> x.kept)""").alias("loads"),
        F.expr("sort_array(flatten(collect_list(waiting)), false)").alias("pool"))
    return state.select(F.inline(F.expr("""
        aggregate(pool, struct(loads, cast(array() as array<struct<virtual_slot: int, shard: int>>) as put),
            (held, x) -> struct(
                transform(held.loads, (b, i) -> if(i + 1 = array_position(held.loads, array_min(held.loads)),
                                                   b + x.bytes, b)) as loads,
                concat(held.put, array(struct(x.virtual_slot as virtual_slot,
                    cast(array_position(held.loads, array_min(held.loads)) - 1 as int) as shard))) as put),
            held -> held.put)""")))


def place(rows: DataFrame, table: DataFrame, loads: DataFrame) -> DataFrame:
    """Adds ``shard`` and ``slot``, the row's place in its shard from 0 without gaps, to saved ``records``.

    ``rows`` needs a column ``row`` with different values. Slots are cut into cells of about ``CELL_ROWS`` rows by
    that column, so neither a large shard nor a slot with many repeated rows is numbered by one task; the
    cells' counts are added up within slots, and the slots' counts within shards.
    """
    in_shard = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = table.join(loads, "virtual_slot").select(
        "virtual_slot", "shard", F.greatest(F.lit(1), F.ceil(F.col("rows") / CELL_ROWS)).alias("cells"),
        F.coalesce(F.sum("rows").over(in_shard), F.lit(0)).alias("before_slot"))
    celled = rows.join(F.broadcast(slots), "virtual_slot").withColumn("cell", F.pmod(F.xxhash64("row"), F.col("cells")))
    in_slot = Window.partitionBy("virtual_slot").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = celled.groupBy("virtual_slot", "cell").agg(F.count("*").alias("n"))
    bases = counts.select("virtual_slot", "cell", F.coalesce(F.sum("n").over(in_slot), F.lit(0)).alias("before_cell"))
    in_cell = Window.partitionBy("virtual_slot", "cell").orderBy("doc_id", "size", "text_crc32", "row")
    at = F.col("before_slot") + F.col("before_cell") + F.row_number().over(in_cell) - 1
    return celled.join(bases, ["virtual_slot", "cell"]).select(*rows.columns, "shard", at.cast("long").alias("slot"))


def shard_by_bytes(docs: DataFrame, ws: Workspace, shards: int = SHARDS, slots: int = SLOTS,
                   maps: SlotMaps | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, row, shard, slot) for every row of ``docs``.

    The newest map in ``maps`` is rebalanced for these rows and stored as its next version; without one the maps
    are kept in the workspace. An empty table gives no rows, and a map all the same. One slot cannot be
    divided, so rows that repeat one id and text stay together even if they outweigh a shard.
    """
    rows = ws.save(records(docs, slots=slots).withColumn("row", F.monotonically_increasing_id()), ws.unique("records"))
    loads = ws.save(slot_loads(rows), ws.unique("loads"))
    maps = maps or SlotMaps(docs.sparkSession, f"{ws.root}/{ws.unique('slot-maps')}")
    if not maps.versions():
        maps.first(slots, shards)
    return place(rows, maps.rebalance(loads, shards), loads)
