"""Tables and shuffles go when nothing reads them any more, and wide rows are shuffled once for their key."""

import os

import pytest
from pyspark.sql import functions as F

from mergewell import queries
from mergewell.operators import links as link_ops
from mergewell.operators import validate
from mergewell.operators.embed import HashEmbedder
from mergewell.plans.ingest import ingest
from mergewell.plans.settle import ingest_refused, settle
from mergewell.schemas import FIELDS, LINK, PRODUCT, RAW
from mergewell.workspace import CLEANED, discard, materialize, only, passing, shared_dir

SF = "/root/testdata/sf0.001"
UUID = "00000000-0000-0000-0000-{:012d}"


def _tables(spark):
    return {n.rsplit("-", 1)[0] + "-" + n.rsplit("-", 1)[1] for n in os.listdir(shared_dir(spark))}


def _labels(spark, before):
    return sorted(n.rsplit("-", 1)[0] for n in _tables(spark) - before)


def _records(spark, names):
    rows = [(k, UUID.format(k), "s", n, "b", "c") for k, n in enumerate(names)]
    entries = spark.createDataFrame(rows, "record_index long, " + ", ".join(f"{RAW[f]} string" for f in FIELDS))
    return validate.records(entries)


def test_only_what_is_kept_stays(spark):
    os.makedirs(shared_dir(spark), exist_ok=True)
    before = _tables(spark)
    with passing() as outer:
        materialize(spark.range(3), "gone")
        with passing() as keep:
            stays = outer(keep(materialize(spark.range(3), "stays")))
            inner = keep(materialize(spark.range(3), "inner"))
            materialize(spark.range(3), "gone")
        assert _labels(spark, before) == ["gone", "inner", "stays"] and inner.count() == 3
    assert _labels(spark, before) == ["stays"] and stays.count() == 3
    with pytest.raises(ValueError), passing():
        materialize(spark.range(3), "gone")
        raise ValueError
    found = only(lambda: materialize(spark.range(5), "gone").filter("id > 1"), "only")
    assert _labels(spark, before) == ["only", "stays"] and found.count() == 3
    with passing() as keep:
        materialize(spark.range(3), "all")
        keep.everything()
    assert _labels(spark, before) == ["all", "only", "stays"]


def test_a_written_table_leaves_no_shuffle(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    seen, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: seen.append(spark.conf.get(CLEANED)) or write(self, path))
    before = spark.conf.get(CLEANED)
    assert materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted").count() == 7
    assert seen == ["true"] and spark.conf.get(CLEANED) == before


def test_deciders_are_found_in_one_shuffle_without_a_join(spark):
    rows = [(0, "s", "a", "x", True), (1, "s", "a", "y", False), (2, "s", "a", "z", False), (3, "s", "b", "x", True), (4, None, "a", "x", False), (5, "t", "a", "q", False)]
    frame = materialize(spark.createDataFrame(rows, "record_index long, seller_name string, seller_product_id string, identity string, fails boolean"), "rows")
    found = link_ops.with_decider(frame)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    of = {r["identity"]: r["h"] for r in frame.select("identity", F.xxhash64("identity").alias("h")).collect()}
    got = {r["record_index"]: (r["first_index"], r["_decider"]) for r in found.collect()}
    assert got == {0: (0, of["x"]), 1: (1, of["y"]), 2: (1, of["y"]), 3: (3, of["x"]), 5: (5, of["q"])}


def test_results_do_not_read_the_records_again(spark):
    records = materialize(_records(spark, ["old", "new", "", "new"]), "records")
    done = ingest(records, spark.createDataFrame([(1, "old", "b", "c")], PRODUCT), spark.createDataFrame([], LINK), HashEmbedder(), 0.975, "none")
    discard(records)
    got = [tuple(r) for r in done.results.orderBy("record_index").select("outcome", "product_id", "reason").collect()]
    assert got == [("linked", 1, None), ("inserted", 2, None), ("rejected", None, "Name: blank"), ("linked", 2, None)]


def test_a_run_that_is_decided_again_leaves_nothing(spark):
    records = _records(spark, ["old", "new", "new", "other"])
    before, rounds = _tables(spark), []

    def refuse(done):
        rounds.append(1)
        return done.results.filter("record_index = 1").select("record_index", F.lit("other").alias("err_kind"), F.lit("no").alias("reason")).filter("1 = 1")

    done = ingest_refused(records, spark.createDataFrame([(1, "old", "b", "c")], PRODUCT), spark.createDataFrame([], LINK), HashEmbedder(), 0.975, "none", refuse=refuse)
    assert len(rounds) == 2 and _labels(spark, before).count("accepted") == 1
    assert [(r["outcome"], r["product_id"]) for r in done.results.orderBy("record_index").collect()] == [("linked", 1), ("failed", None), ("inserted", 2), ("inserted", 3)]


def test_settled_rows_stay_where_they_lie_for_products(spark):
    records = _records(spark, ["old", "gone", "new", "taken", "twice"])
    names = ["old", "gone", "taken", "twice"]
    products = spark.createDataFrame([(k + 1, n, "b", "c") for k, n in enumerate(names)], PRODUCT)
    done = ingest(records, products, spark.createDataFrame([], LINK), HashEmbedder(), 0.975, "none")
    links = spark.createDataFrame([(9, "s", 1, UUID.format(3))], LINK)
    left = products.filter("id <> 2").unionByName(products.filter("id = 4"))
    before = _tables(spark)
    got = settle(done, (4, 0), left, links, (10, 9)).results
    assert {"not-once", "own"} <= set(_labels(spark, before))
    rows = sorted((r["record_index"], r["outcome"], r["err_kind"], r["product_id"]) for r in got.collect())
    twice = (4, "linked", None, 4)  # as a join with a catalog that has a product twice
    assert rows == [(0, "linked", None, 1), (1, "failed", "not found", None), (2, "inserted", None, 11), (3, "failed", "conflict", None), twice, twice]


def test_lots_leave_neither_their_files_nor_their_tables(spark):
    before = _tables(spark)
    queries.QUERIES["streamed_links"](spark, SF)
    assert _labels(spark, before) == ["catalog", "progress"]
