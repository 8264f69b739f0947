"""Durable intermediate tables.

Every round of a loop is written as Parquet under the shared checkpoint folder and read back, so the
next plan starts from files: lineage is cut, lost executors only cost a re-read, and later rounds get
column pruning and filter pushdown that a serialised checkpoint would not give.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructType

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
#: Terms repeat so much that shuffled rows take a few bytes each; partitions put together to Spark's 64 MB would have
#: millions of them.
SHUFFLED_AT_ONCE = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}
#: Largest number of buckets that Spark accepts without further settings.
MOST_BUCKETS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. A temporary one is made only on a local master."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="triplewright-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def session_values(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside only."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shuffles_freed(spark: SparkSession) -> AbstractContextManager[None]:
    """Writes inside leave no shuffle files behind: once a table is written, nothing reads them again."""
    return session_values(spark, {SHUFFLE_CLEANUP: "true"})


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions that give each task about ``per_task`` of ``rows``, no fewer than the session asks for."""
    return min(MOST_BUCKETS, max(int(spark.conf.get(SHUFFLE_PARTITIONS)), -(-rows // per_task)))


def sized_shuffles(spark: SparkSession, rows: int, per_task: int) -> AbstractContextManager[None]:
    """Shuffles inside have partitions for ``rows`` and leave no files behind when the job that they are for ends.

    Adaptive execution puts partitions together again where a shuffle turns out small.
    """
    return session_values(spark, {SHUFFLE_PARTITIONS: str(partitions_for(spark, rows, per_task)),
                                  SHUFFLE_CLEANUP: "true"} | SHUFFLED_AT_ONCE)


class Workspace:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = f"{(root or shared_folder(spark)).rstrip('/')}/run-{uuid.uuid4().hex}"
        self._names = 0

    def unique(self, name: str) -> str:
        """A table name not used before in this workspace."""
        self._names += 1
        return f"{name}-{self._names}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None, rows_per_file: int = 0) -> DataFrame:
        writer = df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with shuffles_freed(self.spark):
            writer.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        self._delete(f"{self.root}/{name}")

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @contextmanager
    def inner(self) -> Iterator["Workspace"]:
        """A workspace for one step, whose tables are deleted when the step ends.

        What outlives the step must be saved in the outer workspace before the end.
        """
        step = Workspace(self.spark, self.root)
        try:
            yield step
        finally:
            self._delete(step.root)

    def rounds(self, name: str, schema: StructType, rows_per_file: int) -> "Rounds":
        return Rounds(self, name, schema, rows_per_file)


class Rounds:
    """A table that grows by one ``round=n`` folder per iteration of a loop."""

    def __init__(self, workspace: Workspace, name: str, schema: StructType, rows_per_file: int):
        self.workspace = workspace
        self.path = f"{workspace.root}/{workspace.unique(name)}"
        self.schema = StructType(list(schema.fields)).add("round", IntegerType())
        self.rows_per_file = rows_per_file
        self.counts: list[int] = []

    @property
    def last(self) -> int:
        return len(self.counts) - 1

    def append(self, df: DataFrame) -> int:
        """Write the next round and return its row count, read from the written files."""
        number = len(self.counts)
        with shuffles_freed(self.workspace.spark):
            (df.write.mode("errorifexists").option("maxRecordsPerFile", self.rows_per_file)
             .parquet(f"{self.path}/round={number}"))
        self.counts.append(-1)
        self.counts[number] = self.read(number, number).count()
        return self.counts[number]

    def read(self, first: int = 0, last: int | None = None) -> DataFrame:
        """Rounds ``first`` to ``last``, both included, as one scan."""
        last = self.last if last is None else last
        paths = [f"{self.path}/round={n}" for n in range(first, last + 1) if self.counts[n] or n == 0]
        if not paths:
            return self.workspace.spark.createDataFrame([], self.schema).drop("round")
        reader = self.workspace.spark.read.schema(self.schema).option("basePath", self.path)
        return reader.parquet(*paths).drop("round")
