"""The first row of each key of a stream, as keyed state.

A key's row is the least by the order columns among the rows of the micro-batch that first holds the key; the
state keeps its place, so later batches, replays and restarts add nothing.  If lots arrive in order, the
rows so far are those of the least place in all of them.  Nulls are keys of their own and sort last in the
order; rows that agree in all order columns are one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Fixed value: the state store that keyed state needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _least(keys: list[str], order: list[str]):
    """At most one row a key of each Arrow batch goes into the shuffle, so a hot key stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch]).sort_by([(c, "ascending") for c in order])
                named = pa.table([*[rows[c] for c in keys], pa.array(range(len(rows)))], [*[f"k{i}" for i in range(len(keys))], "at"])
                firsts = named.group_by(named.column_names[:-1]).aggregate([("at", "min")])["at_min"]
                yield from rows.take(firsts).combine_chunks().to_batches()

    return run


class _First(StatefulProcessor):
    def __init__(self, order: list[str], place: StructType):
        self.order, self.place = order, place

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", self.place)

    def _sorted(self, row: Row) -> tuple:
        return tuple((row[c] is None, row[c]) if row[c] is not None else (True,) for c in self.order)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if not self.first.exists():
            row = min(rows, key=self._sorted)
            self.first.update(tuple(row[c] for c in self.order))
            yield row

    def close(self) -> None:
        pass


def first_rows(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The stream of first rows; its session needs ``ROCKS`` as state store when it is started."""
    place = StructType([stream.schema[c] for c in order])
    least = stream.mapInArrow(_least(keys, order), stream.schema)
    return least.groupBy(*keys).transformWithState(_First(order, place), stream.schema, "Append", "None")


def start_firsts(stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Write the first rows of what has arrived to Parquet files, each once, and stop."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:  # a started stream has settings of its own
        writer = first_rows(stream, keys, order).writeStream.format("parquet").option("path", path)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before)
