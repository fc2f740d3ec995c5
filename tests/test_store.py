"""Catalog states made of a base and changes, the pointer, and the store of vectors."""

import os
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergewell.operators import constraints
from mergewell.operators.embed import HashEmbedder
from mergewell.schemas import LINK, PRODUCT
from mergewell.sources import snapshots
from mergewell.sources.pointer import LostRace, Pointer
from mergewell.sources.snapshots import CatalogStore
from mergewell.sources.vector_store import VectorStore

CHANGED = "id long, brand string, category string"


@dataclass
class CountingEmbedder(HashEmbedder):
    """Notes every text that is embedded in a file."""

    log: str = ""
    name: str = "counting"

    def embed(self, texts: list[str]) -> np.ndarray:
        if texts != ["probe"]:
            with open(self.log, "a") as out:
                out.writelines(f"{t!r}\n" for t in texts)
        return super().embed(texts)

    def noted(self) -> list[str]:
        if not os.path.exists(self.log):
            return []
        with open(self.log) as found:
            lines = found.read().splitlines()
        os.remove(self.log)
        return lines


def frames(spark, products=(), changed=(), links=()):
    kinds = ((products, PRODUCT), (changed, CHANGED), (links, LINK))
    return [spark.createDataFrame(list(rows), schema) for rows, schema in kinds]


def state(store):
    now = store.current()
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    return rows(now.products, "id", "name", "brand", "category"), rows(now.links, "id", "seller_name", "product_id", "seller_product_id"), now.high_water, now.batches


def started(spark, folder, products=((1, "a", None, None), (2, "b", "B", None)), links=((1, "s", 1, "x"),)):
    store = CatalogStore(spark, f"{folder}/catalog")
    store.commit(spark.createDataFrame(list(products), PRODUCT), spark.createDataFrame(list(links), LINK))
    return store


def test_changes_on_a_base(spark, folder, monkeypatch):
    store = started(spark, folder)
    store.commit_changes(*frames(spark, [(3, "c", None, "C")], [(1, "A", None)], [(2, "s", 3, "y"), (3, "t", 1, "x")]), read=1, batch=0)
    store.commit_changes(*frames(spark, [], [(1, None, "K"), (3, "Z", None)], []), read=2, batch=1)
    expected = (
        [(1, "a", "A", "K"), (2, "b", "B", None), (3, "c", "Z", "C")],
        [(1, "s", 1, "x"), (2, "s", 3, "y"), (3, "t", 1, "x")],
        (3, 3),
        1,
    )
    assert state(store) == expected
    assert [len(store.manifest()[t]["deltas"]) for t in ("products", "links")] == [2, 1]
    store.compact()
    assert state(store) == expected and store.manifest()["products"]["deltas"] == [] == store.manifest()["links"]["deltas"]
    gone = store.vacuum(keep=1)
    assert len(gone) == 3 and state(store) == expected  # the first base and two commits of changes
    monkeypatch.setattr(snapshots, "MOST_DELTAS", 1)
    for k in range(3):
        store.commit_changes(*frames(spark, [(10 + k, "n", None, None)], [], [(10 + k, "u", 10 + k, str(k))]), read=store.current().number)
    assert len(store.manifest()["links"]["deltas"]) <= 1 and store.products().count() == 6 and store.links().count() == 6


def test_changes_keep_the_constraints(spark, folder):
    store = started(spark, folder)
    store.commit_changes(*frames(spark, [], [], [(2, "s", 2, "y")]), read=1)
    before = state(store)
    for products, changed, links, message in (
        ([], [], [(3, "s", 2, "x")], "linked before"),  # in the base
        ([], [], [(3, "s", 2, "y")], "linked before"),  # in a change
        ([], [], [(3, "q", 2, "y"), (4, "q", 1, "y")], "repeated"),
        ([], [], [(3, "q", 9, "y")], "without product"),
        ([], [], [(3, "q", 2, "")], "bad lengths"),
        ([], [], [(2, "q", 2, "z")], "old ids"),
        ([(3, None, None, None)], [], [], "without id or name"),
        ([(3, "c", None, None), (3, "d", None, None)], [], [], "repeated product"),
        ([], [(7, "B", None)], [], "aren't there"),
    ):
        with pytest.raises(constraints.ConstraintError, match=message):
            store.commit_changes(*frames(spark, products, changed, links), read=2)
    assert state(store) == before


def test_a_small_commit_reads_and_writes_little(spark, folder, monkeypatch):
    monkeypatch.setattr(snapshots, "SLOT_ROWS", 500)
    store = CatalogStore(spark, f"{folder}/catalog")
    n = 20_000
    products = spark.range(1, n + 1).select("id", F.lit("p").alias("name"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("category"))
    links = spark.range(1, 5 * n + 1).select("id", (F.col("id") % 7).cast("string").alias("seller_name"), (F.col("id") % n + 1).alias("product_id"), F.col("id").cast("string").alias("seller_product_id"))
    store.commit(products, links)
    new = spark.createDataFrame([(5 * n + 1 + k, "new", 1 + 1000 * k, str(k)) for k in range(10)], LINK)
    near = store.near("links", new)
    assert near.count() <= 10 * 500 * 2 and near.select(F.input_file_name()).distinct().count() <= 10
    assert "slot" in near._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    wanted = new.select(F.col("product_id").alias("id"))
    assert store.near("products", wanted).count() <= 10 * 500 * 2
    assert store.near("products", wanted).join(wanted, "id", "left_semi").count() == 10
    store.commit_changes(*frames(spark)[:2], new, read=1)
    delta = store.manifest()["links"]["deltas"]
    assert len(delta) == 1 and spark.read.parquet(f"{folder}/catalog/{delta[0]}").count() == 10
    assert store.links().count() == 5 * n + 10
    taken = spark.createDataFrame([(5 * n + 99, "3", 5, "3")], LINK)  # seller 3 has its id 3 in the base
    with pytest.raises(constraints.ConstraintError, match="linked before"):
        store.commit_changes(*frames(spark)[:2], taken, read=2)


def test_one_of_two_writers_wins(spark, folder):
    store, other = started(spark, folder), CatalogStore(spark, f"{folder}/catalog")
    read = store.current().number
    other.commit_changes(*frames(spark, [], [], [(2, "s", 2, "y")]), read=read)
    for lost in (lambda: store.commit_changes(*frames(spark, [], [], [(2, "s", 2, "z")]), read=read), lambda: store.commit(*frames(spark)[::2], read=read)):
        with pytest.raises(LostRace):
            lost()
    store._require_current = lambda: (read, Pointer(spark, f"{folder}/catalog/_published").read(read))  # saw the state before the other's commit
    with pytest.raises(LostRace):
        store.commit_changes(*frames(spark, [], [], [(2, "s", 2, "z")]), read=read)
    assert [r["seller_product_id"] for r in other.links().orderBy("id").collect()] == ["x", "y"]


@pytest.mark.parametrize("step", ["commit", "changes", "compact"])
def test_a_writer_that_stops_leaves_the_state(spark, folder, step):
    store = started(spark, folder)
    store.commit_changes(*frames(spark, [], [], [(2, "s", 2, "y")]), read=1)
    before = state(store)

    def stop(*_):
        raise KeyboardInterrupt  # after all files are written, before the pointer moves

    store.pointer.publish = stop
    with pytest.raises(KeyboardInterrupt):
        if step == "commit":
            store.commit(store.products(), store.links())
        elif step == "changes":
            store.commit_changes(*frames(spark, [(5, "e", None, None)]), read=2)
        else:
            store.compact()
    again = CatalogStore(spark, f"{folder}/catalog")
    assert state(again) == before
    assert len(again.vacuum()) == 1 and state(again) == before
    again.commit_changes(*frames(spark, [(5, "e", None, None)]), read=2)
    assert again.products().count() == 3


def test_pointer(spark, folder):
    pointer = Pointer(spark, f"{folder}/p")
    assert pointer.current() == (0, None)
    pointer.publish(1, {"a": 1})
    pointer.publish(2, {"a": "é"})
    with pytest.raises(LostRace):
        pointer.publish(2, {"a": 3})
    pointer._write(pointer.path(f"{folder}/p/_draft-of-a-dead-writer"), "{")
    assert pointer.current() == (2, {"a": "é"}) and pointer.numbers() == [1, 2]
    pointer.scheme = "s3a"
    with pytest.raises(RuntimeError, match="conditionally"):
        pointer.publish(3, {})
    pointer.conditional_create = True
    pointer.publish(3, {})
    with pytest.raises(LostRace):
        pointer.publish(3, {})


def test_states_of_the_first_format_are_read(spark, folder):
    products, _, links = frames(spark, [(1, "a", None, None)], [], [(1, "s", 1, "x")])
    products.write.parquet(f"{folder}/catalog/snapshot-1/products")
    links.write.parquet(f"{folder}/catalog/snapshot-1/links")
    Pointer(spark, f"{folder}/catalog/_published").publish(4, {"folder": "snapshot-1", "version": 2, "high_water": [1, 1], "batches": 3})
    store = CatalogStore(spark, f"{folder}/catalog")
    store.commit_changes(*frames(spark, [(2, "b", None, None)], [(1, "B", None)], [(2, "s", 2, "y")]), read=4)
    assert state(store) == ([(1, "a", "B", None), (2, "b", None, None)], [(1, "s", 1, "x"), (2, "s", 2, "y")], (2, 2), 3)
    store.compact()
    assert store.links().count() == 2 and store.vacuum(1)


def identities(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "identity string")


def test_texts_are_embedded_once(spark, folder):
    embedder = CountingEmbedder(log=f"{folder}/log")
    store = VectorStore(spark, f"{folder}/v", embedder, buckets=4)
    assert store.ensure(identities(spark, "a", "b", "b", "c")) == 3 and len(embedder.noted()) == 3
    assert store.ensure(identities(spark, "a", "b", "c")) == 0 and embedder.noted() == []
    again = VectorStore(spark.newSession(), f"{folder}/v", embedder)  # another session, as after a restart
    spark.sql(f"DROP TABLE {store._table()[0]}")
    assert again.ensure(identities(spark, "c", "d é")) == 1
    assert [eval(t) for t in embedder.noted()] == [store.prefix + "d é"]
    wanted = identities(spark, "a", "d é", "a", "unknown")
    got = {r["identity"]: r["vector"] for r in again.vectors(wanted).collect()}
    assert set(got) == {"a", "d é"}
    assert np.allclose(got["a"], HashEmbedder().embed([store.prefix + "a"])[0])
    other = VectorStore(spark, f"{folder}/v", HashEmbedder(), buckets=4)
    assert other.root != store.root and other.ensure(identities(spark, "a")) == 1


def test_two_writers_of_one_text_and_compaction(spark, folder):
    store = VectorStore(spark, f"{folder}/v", HashEmbedder(), buckets=4)
    store.ensure(identities(spark, "a", "b"))
    name, place, buckets = store._table()
    store._append(store.table().filter("true").repartition(buckets, "text_hash"), place, name, buckets)  # as by another writer at once
    assert store.table().count() == 4
    assert store.vectors(identities(spark, "a", "b")).count() == 2
    store.compact()
    assert store.table().count() == 2 and store.vectors(identities(spark, "a", "b")).count() == 2
    assert store.ensure(identities(spark, "a", "b", "c")) == 1


def test_vectors_are_not_shuffled(spark, folder):
    store = VectorStore(spark, f"{folder}/v", HashEmbedder(), buckets=4)
    store.ensure(identities(spark, *(f"t{k}" for k in range(300))))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = store.vectors(identities(spark, "t1", "t2"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Bucketed: true" in plan
    for part in plan.split("\n\n"):
        if ") Exchange" in part:
            assert "vector" not in part, part
