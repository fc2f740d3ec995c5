"""Shared-folder checkpoints and distributed ranks.

Intermediate results that are read more than once are written to the folder that the cluster names
in ``spark.checkpoint.dir``, which the driver and all executors see, so that a lost executor costs
no more than the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Most rows of a table that passes through the driver on its way to all tasks, some 100 bytes each.
BROADCAST_ROWS = 1 << 15


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  Only a local session, which has one machine, may do without and gets a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark deletes an execution's shuffle files when it ends, instead of when the driver's garbage is next collected.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables that were written since the innermost ``passing`` of this thread began.
_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


@contextmanager
def _cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts the lineage.  What its shuffles wrote goes at once."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with _cleaned_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if (written := _written.get()) is not None:
        written.append(out)
    return out


class Passing:
    """What ``passing`` keeps: tables that it is called with, or all of them."""

    def __init__(self):
        self.written: list[DataFrame] = []
        self.kept: set[str] = set()

    def __call__(self, table: DataFrame) -> DataFrame:
        self.kept.add(table._written_to)
        return table

    def everything(self) -> None:
        self.kept.update(t._written_to for t in self.written)


@contextmanager
def passing() -> Iterator[Passing]:
    """Delete what is materialized inside at its end, but for the tables that are kept.

    Those belong to the ``passing`` around it, if there is one.  Nothing that is read later may still be computed
    from the others.
    """
    keep = Passing()
    token = _written.set(keep.written)
    try:
        yield keep
    finally:
        _written.reset(token)
        stays = [t for t in keep.written if t._written_to in keep.kept]
        discard(*[t for t in keep.written if t._written_to not in keep.kept])
        if (around := _written.get()) is not None:
            around.extend(stays)


def only(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``materialize(make(), label)`` without the tables that were written on the way."""
    with passing() as keep:
        return keep(materialize(make(), label))


def by_rows(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``table``, a materialized one, for a join that only sends it to all tasks if it has at most ``most`` rows.

    Spark goes by the size of files, which says little about the memory that columns of few values take.
    """
    return table if table.count() <= most else table.hint("merge")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(context._jsc.hadoopConfiguration()).delete(found, True)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing will read it again."""
    for table in tables:
        remove(table.sparkSession, table._written_to)


def with_rank(df: DataFrame, order: list[Column], name: str, label: str = "rank", kept: list[str] | None = None) -> DataFrame:
    """Add ``name``: the row's 0-based position in the global order of ``order``.  Columns that aren't ``kept`` go.

    Rows are range partitioned (a hot key value is split as long as later order columns differ),
    numbered inside their partition, and written to the shared folder once; the offset of each
    partition comes from one count per partition, which is all that is ever brought together.
    Rows that tie on every order column are numbered in an arbitrary but fixed way.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spot = F.monotonically_increasing_id()
    placed = materialize(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*(kept or df.columns), spot.alias("_spot")), label
    )
    part = F.shiftright("_spot", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    table = counts.select("_part", before.alias("_offset"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_offset") + F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_offset", "_spot")
    )
