"""Vectors that were embedded before, in a bucketed table that outlives runs and sessions.

A vector belongs to the embedder's name and dimension, the task prefix, and the hash of the text; texts are
never embedded twice.  The table is bucketed by that hash: looking up vectors shuffles the hashes that are
asked for, never the vectors.  What is new is embedded bucket by bucket, so it is written where it belongs
without moving a vector either.

Vectors are appended before the catalog's state that needs them is published.  A writer that stops in between
leaves vectors that nothing needs yet, which are right and are found the next time.  Two writers that embed the
same text at once both append it; look-ups return one of the two, and ``compact`` keeps one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.functions import text
from mergewell.operators.embed import Embedder, embed_texts
from mergewell.sources.pointer import LostRace, Pointer
from mergewell.workspace import discard, materialize

COLUMNS = "text_hash string, vector array<float>"


class VectorStore:
    """``root`` is any path that Spark reads and writes; ``buckets`` is fixed by whoever creates the store, by default as many as shuffles have partitions."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder, prefix: str = text.TASK_PREFIX, buckets: int | None = None, conditional_create: bool = False):
        self.spark, self.embedder, self.prefix = spark, embedder, prefix
        about = {"model": embedder.name, "dimension": embedder.dimension, "prefix": prefix}
        key = hashlib.sha256(repr(sorted(about.items())).encode()).hexdigest()[:24]
        self.root = f"{root.rstrip('/')}/{key}"
        self.pointer = Pointer(spark, f"{self.root}/_published", conditional_create)
        if not self.pointer.numbers():
            try:
                self.pointer.publish(1, about | {"folder": "vectors-1", "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))})
            except LostRace:
                pass  # created by another writer just now

    def _table(self) -> tuple[str, str, int]:
        """The current table's name in this session, where it lies, and its buckets."""
        _, found = self.pointer.current()
        place = f"{self.root}/{found['folder']}"
        name = f"vectors_{hashlib.sha256(place.encode()).hexdigest()[:24]}"
        if not self.spark.catalog.tableExists(name):
            self.pointer.fs.mkdirs(self.pointer.path(place))
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet CLUSTERED BY (text_hash) INTO {found['buckets']} BUCKETS LOCATION '{place}'")
        return name, place, found["buckets"]

    def table(self) -> DataFrame:
        name, _, _ = self._table()
        self.spark.catalog.refreshTable(name)  # other sessions append too
        return self.spark.table(name)

    def _hashed(self, identities: DataFrame) -> DataFrame:
        return identities.select("identity", F.sha2(F.concat(F.lit(self.prefix), "identity"), 256).alias("text_hash"))

    def _append(self, rows: DataFrame, place: str, name: str, buckets: int) -> None:
        """``rows`` are dealt by the hash of their bucket already, so each task writes one bucket."""
        writer = rows.select("text_hash", "vector").write.mode("append").format("parquet")
        writer.bucketBy(buckets, "text_hash").option("path", place).saveAsTable(name)

    def ensure(self, identities: DataFrame) -> int:
        """Embed what the store lacks of ``identities (identity)``; how many that were."""
        name, place, buckets = self._table()
        lacking = self._hashed(identities).distinct().join(self.table().select("text_hash"), "text_hash", "left_anti")
        new = materialize(lacking.select(F.concat(F.lit(self.prefix), "identity").alias("text"), "text_hash"), "new-texts")
        n = new.count()
        if n:
            dealt = new.repartition(buckets, "text_hash").select("text")
            embedded = embed_texts(dealt, self.embedder)
            self._append(embedded.select(F.sha2("text", 256).alias("text_hash"), "vector"), place, name, buckets)
        discard(new)
        return n

    def vectors(self, identities: DataFrame) -> DataFrame:
        """``identity, vector`` of the distinct ``identities`` that the store holds."""
        found = self._hashed(identities).distinct().join(self.table(), "text_hash")
        return found.groupBy("text_hash").agg(F.first("identity").alias("identity"), F.first("vector").alias("vector")).drop("text_hash")

    def compact(self) -> None:
        """Write each bucket as one file, without repeats, and publish that; appends meanwhile are lost, and embedded again."""
        number, about = self.pointer.current()
        place, buckets = f"{self.root}/vectors-{number + 1}", about["buckets"]
        kept = self.table().groupBy("text_hash").agg(F.first("vector").alias("vector"))  # in place: it is bucketed so
        name = f"vectors_{hashlib.sha256(place.encode()).hexdigest()[:24]}"
        self._append(kept.repartition(buckets, "text_hash"), place, name, buckets)
        self.pointer.publish(number + 1, about | {"folder": f"vectors-{number + 1}"})
