"""Records are joined with the catalog where they lie, and go through one aggregate instead of joins with themselves."""

from pyspark.sql import functions as F

from mergewell import queries
from mergewell.operators import updates
from mergewell.plans import calibrate
from mergewell.schemas import FLAGS
from mergewell.sources import driver_tables as tables
from mergewell.workspace import materialize

SF = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_cleaned_records_are_not_moved_for_the_catalog(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cleaned, entries = _plan(queries._resolved(spark, SF)).split("MapInArrow", 1)
        matched = _plan(queries._matched(spark, SF)).split("MapInArrow", 1)[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in cleaned and "Join" not in cleaned
    assert entries.count("Exchange hashpartitioning(true_product") == 3  # lines, parts and the catalog, each once
    assert "hashpartitioning(pid" not in matched and "hashpartitioning(true_product" not in matched


def test_overwriting_is_one_aggregate(spark):
    rows = [(1, k, b, c, [], None, c0, True) for k, (b, c, c0) in enumerate([("", "x", None), ("b", "y", None), ("d", "z", None)])]
    shape = f"pid long, record_index long, brand string, category string, flags {FLAGS}, base_brand string, base_category string, in_vocabulary boolean"
    found = updates.changes_of(spark.createDataFrame(rows, shape), "overwrite")
    assert "Join" not in _plan(found)
    assert [tuple(r) for r in found.select("pid", "brand_at", "brand_new", "category_at", "category_new").collect()] == [(1, 1, "b", 0, "x")]


def test_records_are_not_moved_to_find_their_matches(spark):
    records = materialize(spark.range(1 << 20).select(F.col("id").alias("record_index"), F.concat(F.lit("Náme "), F.col("id") % 7).alias("name")), "records")
    products = spark.range(5).select("id", F.concat(F.lit("name"), "id").alias("name"))
    chosen = records.filter("record_index % 100000 = 6").select("record_index", F.lit(99).cast("long").alias("product_id"))
    found = calibrate.known_matches(records, products, chosen)
    assert "hashpartitioning" not in _plan(found)
    assert {tuple(r) for r in found.filter("record_index < 14").collect()} == {(k, k % 7) for k in range(14) if k % 7 < 5 and k != 6} | {(6, 99)}


def test_entries_keep_no_columns_that_only_order_them(spark):
    assert "l_shipdate" not in _plan(tables.entries(spark, SF))


def test_decided_records_are_not_written_again(spark, monkeypatch):
    from mergewell.operators import resolve

    labels = []
    monkeypatch.setattr(resolve, "materialize", lambda frame, label: labels.append(label) or materialize(frame, label))
    queries.QUERIES["ingest_results"](spark, SF)
    assert "states" in labels and "followed" not in labels
