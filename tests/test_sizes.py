"""Joins go by rows where the size of files says little."""

from pyspark.sql import functions as F

from mergewell.workspace import BROADCAST_ROWS, by_rows, materialize


def _plan(joined):
    return joined._jdf.queryExecution().executedPlan().toString()


def test_a_long_table_of_few_values_is_not_broadcast(spark):
    records = spark.range(1 << 22).withColumnRenamed("id", "record_index")
    marks = records.filter(f"record_index % 8 = 0 and record_index < {16 * BROADCAST_ROWS}").select("record_index", F.lit("refused").alias("reason"))
    long, short = materialize(marks, "marks"), materialize(marks.limit(100), "marks")
    assert "Broadcast" in _plan(records.join(long, "record_index", "left"))  # what Spark would do: its file is small
    assert "Broadcast" not in _plan(records.join(by_rows(long), "record_index", "left"))
    assert "Broadcast" in _plan(records.join(by_rows(short), "record_index", "left"))
