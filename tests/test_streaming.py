import json
import os
import random
import uuid

from mergewell.operators.embed import HashEmbedder
from mergewell.sources.snapshots import CatalogStore
from mergewell.sources.vector_store import VectorStore
from mergewell.streaming.firsts import PROVIDER, start_firsts
from mergewell.streaming.incremental import IncrementalIngest
from tests.test_store import CountingEmbedder

PRODUCT = "id long, name string, brand string, category string"
LINK = "id long, seller_name string, product_id long, seller_product_id string"


def payload(path, entries):
    with open(path, "w") as out:
        json.dump([{"Id": i, "SellerName": s, "Name": n} for i, s, n in entries], out)


def test_batches_see_earlier_ones(spark, folder):
    inbox = f"{folder}/in"
    os.makedirs(inbox)
    ids = [str(uuid.UUID(int=k)) for k in range(4)]
    store = CatalogStore(spark, f"{folder}/catalog")
    store.commit(spark.createDataFrame([(5, "Fan", None, None)], PRODUCT), spark.createDataFrame([], LINK))
    job = IncrementalIngest(store, HashEmbedder(), 0.975, results=f"{folder}/results")
    payload(f"{inbox}/a.json", [(ids[0], "s", "Fan"), (ids[1], "s", "Lamp"), ("bad", "s", "x")])
    job.start(inbox, f"{folder}/check").awaitTermination()
    payload(f"{inbox}/b.json", [(ids[2], "t", "Lamp"), (ids[0], "s", "Fan"), (ids[3], "t", "Desk")])
    job.start(inbox, f"{folder}/check").awaitTermination()
    rows = spark.read.parquet(f"{folder}/results").orderBy("batch", "record_index").collect()
    assert [(r["outcome"], r["product_id"]) for r in rows] == [
        ("linked", 5), ("inserted", 6), ("rejected", None), ("linked", 6), ("existing", 5), ("inserted", 7),
    ]
    assert {tuple(r) for r in store.products().select("id", "name").collect()} == {(5, "Fan"), (6, "Lamp"), (7, "Desk")}
    assert store.links().count() == 4
    files = spark.read.format("binaryFile").load(inbox)
    job.run_batch(files, store.last_batch())  # delivered again: nothing happens
    assert store.links().count() == 4


def test_each_key_keeps_its_first_row(spark, folder):
    """Over restarts, with null keys and places, repeats, and a key that most rows have."""
    schema = "user long, kind string, lot int, place long, note string"
    draw = random.Random(5)
    rows, provider = [], spark.conf.get(PROVIDER)
    for lot in range(3):
        new = [(draw.choice([7] * 6 + [None, *range(3 * lot + 3)]), draw.choice(["a", None]), lot, draw.choice([None, draw.randrange(1 << 60)]), f"{lot}-{k}") for k in range(400)]
        spark.createDataFrame(new + new[:50], schema).write.mode("append").parquet(f"{folder}/in")
        rows += new
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        for _ in range(2):  # the second start finds nothing new
            start_firsts(stream, ["user", "kind"], ["lot", "place", "note"], f"{folder}/out", f"{folder}/check").awaitTermination()
    assert spark.conf.get(PROVIDER) == provider
    want = {}
    for row in sorted(rows, key=lambda r: (r[2], r[3] is None, r[3] or 0, r[4])):
        want.setdefault(row[:2], row)
    got = [tuple(r) for r in spark.read.schema(schema).parquet(f"{folder}/out").collect()]
    assert len(got) == len(want) and set(got) == set(want.values())


def test_a_batch_embeds_new_texts_only(spark, folder):
    """Also after a restart with a new store, and whatever the size of the catalog."""
    inbox = f"{folder}/in"
    os.makedirs(inbox)
    embedder = CountingEmbedder(log=f"{folder}/log")
    CatalogStore(spark, f"{folder}/catalog").commit(spark.createDataFrame([(k, f"product {k}", None, None) for k in range(1, 201)], PRODUCT), spark.createDataFrame([], LINK))
    counts = []
    for lot in range(3):
        payload(f"{inbox}/{lot}.json", [(str(uuid.UUID(int=lot)), "s", f"new {lot // 2}")])
        vectors = VectorStore(spark, f"{folder}/catalog/vectors", embedder, buckets=4)
        job = IncrementalIngest(CatalogStore(spark, f"{folder}/catalog"), embedder, 0.975, vectors=vectors)
        job.start(inbox, f"{folder}/check").awaitTermination()
        counts.append(len(embedder.noted()))
    assert counts == [201, 0, 1]
    assert job.store.products().count() == 202 and job.store.links().count() == 3


def test_a_batch_that_loses_the_race_is_decided_again(spark, folder):
    inbox = f"{folder}/in"
    os.makedirs(inbox)
    ids = [str(uuid.UUID(int=k)) for k in range(3)]
    payload(f"{inbox}/a.json", [(ids[0], "s", "Fan"), (ids[1], "s", "Lamp"), ("x" * 70, "s", "Desk"), (ids[2], "t", "Lamp")])
    store = CatalogStore(spark, f"{folder}/catalog")
    store.commit(spark.createDataFrame([(5, "Fan", None, None)], PRODUCT), spark.createDataFrame([], LINK))
    job = IncrementalIngest(store, HashEmbedder(), 0.975, results=f"{folder}/results", vectors=VectorStore(spark, f"{folder}/v", HashEmbedder(), buckets=4))
    commit, raced = store.commit_changes, []

    def late(*args, **settings):
        if not raced:  # another writer inserts the lamp and links one of the keys first
            raced.append(1)
            other = CatalogStore(spark, store.root)
            lamp = spark.createDataFrame([(6, "Lamp", None, None)], PRODUCT), spark.createDataFrame([], "id long, brand string, category string")
            other.commit_changes(*lamp, spark.createDataFrame([(1, "s", 6, ids[1])], LINK), read=other.current().number)
        return commit(*args, **settings)

    store.commit_changes = late
    job.start(inbox, f"{folder}/check").awaitTermination()
    rows = spark.read.parquet(f"{folder}/results").orderBy("record_index").collect()
    assert [(r["outcome"], r["product_id"]) for r in rows] == [("linked", 5), ("existing", 6), ("rejected", None), ("linked", 6)]
    assert sorted(r["id"] for r in store.links().collect()) == [1, 2, 3] and store.products().count() == 2
