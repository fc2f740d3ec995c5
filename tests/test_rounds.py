"""What a round of the resolver holds: products of one identity together, places of records instead of records."""

import numpy as np

from mergewell.operators import resolve, validate
from mergewell.operators.embed import HashEmbedder
from mergewell.schemas import FIELDS, LINK, PRODUCT, RAW


def test_first_open_product_at_any_time():
    rng = np.random.default_rng(7)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        after = rng.integers(-1, 30, n)
        until = after + rng.integers(1, 20, n)
        found = resolve._first_open(np.arange(n), after, until)
        for at in range(55):
            open_ = [p for p in range(n) if after[p] < at <= until[p]]
            assert [p for p, a, b in found if a < at <= b] == open_[:1]


def test_versions_of_one_identity_are_one(spark):
    versions = spark.range(3000).selectExpr("id as pid", "-1L as after", f"{resolve.NEVER}L as until", "concat('name ', id % 2) as identity")
    assert sorted(tuple(r) for r in resolve._distinct_versions(versions, 8).collect()) == [(0, -1, resolve.NEVER, "name 0"), (1, -1, resolve.NEVER, "name 1")]


def test_places_are_one_row_for_records_that_decide_alike(spark):
    uuid = lambda k: f"00000000-0000-0000-0000-{k:012d}"
    rows = [(k, uuid(k), "seller", f"thing {k % 3}", "brand", "category", None) for k in range(300)]
    entries = spark.createDataFrame(rows, "record_index long, " + ", ".join(f"{RAW[f]} string" for f in FIELDS) + ", nothing string").drop("nothing")
    products, links = spark.createDataFrame([], PRODUCT), spark.createDataFrame([], LINK)
    resolver = resolve.Resolver(validate.records(entries), products, links, HashEmbedder(), 0.9, "fill")
    places = resolver.places.collect()
    assert len(places) == 3 and sorted(s["at"] for r in places for s in r["spots"]) == list(range(300))
    _, touched = resolver.run()
    assert sorted(r["born"] for r in touched.collect()) == [0, 1, 2]
