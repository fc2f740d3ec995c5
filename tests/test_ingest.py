import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergewell.operators import constraints, links, search, similarity
from mergewell.operators.embed import HashEmbedder, cache_rows, checked, embed_distinct, preflight
from mergewell.plans import report
from mergewell.plans.ingest import ingest, summary
from mergewell.sources.snapshots import CatalogStore, NotMigrated
from tests.model import sequential

RECORD = "record_index long, seller_name string, seller_product_id string, name string, brand string, category string, identity string, reason string, flags array<struct<field:string,reason:string>>"
PRODUCT = "id long, name string, brand string, category string"
LINK = "id long, seller_name string, product_id long, seller_product_id string"


class Coarse:
    """Few dimensions and values, so that near and equal scores are common."""

    name, dimension = "coarse", 3

    def embed(self, texts):
        out = np.zeros((len(texts), 3), np.float32)
        for k, t in enumerate(texts):
            t = t.removeprefix("clustering: ")
            out[k] = [1 + t.count("a") + 2 * t.count("X"), 1 + 2 * t.count("b") + t.count("Y"), 1 + 3 * t.count("c") + t.count("k")]
        return out


def workload(seed, n=60):
    rng = random.Random(seed)
    brands, categories = ["", "", "X", "x", "Y", "XY"], ["", "k", "K", "kk", "z"]
    name = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    products = [(k + 1, name(), rng.choice(brands) or None, rng.choice(categories[:4]) or None) for k in range(rng.choice([0, 3, 8]))]
    records = []
    for i in range(n):
        n_, b, c = name(), rng.choice(brands), rng.choice(categories)
        reason = "Id: blank" if rng.random() < 0.05 else None
        flags = [("Brand", "x")] if rng.random() < 0.1 else []
        ident = " | ".join([n_] + ([f"brand: {b}"] if b else []) + ([f"category: {c}"] if c else []))
        records.append((i, rng.choice("pq"), str(rng.randint(0, 30)), n_, b, c, None if reason else ident, reason, flags))
    linked = [(k + 1, "p", rng.choice(products)[0], str(90 + k)) for k in range(2)] if products else []
    linked += [(9, "q", 999, "5")]
    return records, products, linked


@pytest.mark.parametrize("mode", ["fill", "none", "overwrite"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_sequential_run(spark, mode, seed):
    records, products, linked = workload(seed * 7 + len(mode))
    threshold = [0.999, 0.97, 0.9][seed - 1]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((records, RECORD), (products, PRODUCT), (linked, LINK))]
    done = ingest(*frames, Coarse(), threshold, mode)
    got = {r["record_index"]: r for r in done.results.collect()}
    as_dicts = [f.collect() for f in frames]
    model = Coarse()
    want, catalog = sequential([r.asDict(True) for r in as_dicts[0]], [r.asDict() for r in as_dicts[1]], [r.asDict() for r in as_dicts[2]],
                               lambda t: model.embed([t])[0], threshold, mode)
    for i, row in want.items():
        r = got[i]
        seen = {"outcome": r["outcome"], "product_id": r["product_id"], "match_id": r["match_id"], "changes": [tuple(c) for c in r["changes"]], "notes": r["notes"]}
        assert seen == row, (i, seen, row)
    assert {tuple(r) for r in done.products.collect()} == {(p["id"], p["name"], p["brand"], p["category"]) for p in catalog.values()}
    s = summary(done.results).first()
    assert s["records"] == s["inserted"] + s["linked"] + s["existing"] + s["rejected"] + s["failed"]
    assert done.links.count() == len(linked) + s["inserted"] + s["linked"]


def test_dry_run_and_rerun(spark):
    records, products, _ = workload(5, 30)
    r, p, none = spark.createDataFrame(records, RECORD), spark.createDataFrame(products, PRODUCT), spark.createDataFrame([], LINK)
    dry, real = ingest(r, p, none, Coarse(), 0.99, "fill", dry_run=True), ingest(r, p, none, Coarse(), 0.99, "fill")
    assert summary(dry.results).first() == summary(real.results).first()
    assert dry.products.count() == len(products) and dry.links.count() == 0
    provisional = [x["product_id"] for x in dry.results.filter("outcome = 'inserted'").orderBy("record_index").collect()]
    assert provisional == [-k - 1 for k in range(len(provisional))]
    again = summary(ingest(r, real.products, real.links, Coarse(), 0.99, "fill").results).first()
    assert (again["inserted"], again["linked"]) == (0, 0)


def test_threshold_is_checked(spark):
    empty = [spark.createDataFrame([], s) for s in (RECORD, PRODUCT, LINK)]
    with pytest.raises(ValueError):
        ingest(*empty, Coarse(), 0.0)
    assert summary(ingest(*empty, Coarse(), 1.0).results).first()["records"] == 0


def test_report_text(spark):
    """Every outcome some times over; the lines are put together here from the format's rules."""
    rng = random.Random(31)
    rows, lines = [], {name: [] for name in report.SECTIONS}
    counts, decisions, updated = dict.fromkeys(("inserted", "linked", "existing", "rejected", "failed", "suspicious"), 0), [], set()
    for i in range(40):
        outcome = rng.choice(["inserted", "linked", "existing", "rejected", "failed"])
        seller, own, name, other = rng.choice(["Northwind", "Tailspin"]), f"k{i * 7}", f"Desk lamp {i}", f"Shade {i}"
        score, match, product = rng.randint(1, 999) / 1000 + 0.0004, rng.randint(1, 99), rng.randint(100, 199)
        flags = [("Name", "markup-like content")] * rng.randint(0, 2)
        changes = [("category", "Office", "Home"), ("brand", "", "Lumo")][: rng.randint(0, 2)] if outcome in ("linked", "existing") else []
        notes = ["brand: kept Lumo"] if outcome == "linked" and rng.random() < 0.5 else []
        reason = {"rejected": "Name: blank", "failed": "writing the link"}.get(outcome)
        kind = rng.choice(["conflict", "not found", "other"]) if outcome == "failed" else None
        searched = outcome in ("inserted", "linked")
        rows.append((i, seller, own, name, reason, flags, outcome, {"inserted": "novel", "linked": "duplicate"}.get(outcome), score if searched else None, match if searched else None,
                     other if searched else None, product if outcome not in ("rejected", "failed") else None, changes, notes, kind))
        counts[outcome] += 1
        counts["suspicious"] += bool(flags)
        who = f"#{i} {seller} {own}"
        if outcome == "rejected":
            lines["rejected"].append(f"{who}: {reason}")
            decisions.append(f"#{i} rejected: {reason}")
        elif outcome == "failed":
            lines["failed"].append(f"{who}: {kind}: {reason}")
            decisions.append(f"#{i} failed: {kind}: {reason}")
        elif outcome == "existing":
            decisions.append(f"#{i} existing → product {product}")
        else:
            decisions.append(f'#{i} {outcome} {rows[-1][7]} {score:.3f} → product {product} "{name}", nearest {match} "{other}"')
        if flags:
            lines["suspicious"].append(f"{who}: " + "; ".join(": ".join(f) for f in flags))
        if outcome == "inserted":
            lines["inserted"].append(f'{who} → product {product} "{name}" (nearest {match} at {score:.3f})')
        lines["changes"] += [f"#{i} product {product}: {f}: {old or '(null)'} → {new}" for f, old, new in changes]
        lines["notes"] += [f"#{i} product {product}: {n}" for n in notes]
        updated |= {product} if changes else set()
    schema = ("record_index long, seller_name string, seller_product_id string, identity string, reason string, flags array<struct<field:string,reason:string>>, outcome string, kind string, "
              "score float, match_id long, match_identity string, product_id long, changes array<struct<field:string,old:string,new:string>>, notes array<string>, err_kind string")  # fmt: skip
    want = ["Ingest report", "threshold 0.800, update overwrite, catalog 12 products"]
    want += ["records 40: " + ", ".join(f"{k} {n}" for k, n in counts.items()) + f", products updated {len(updated)}"]
    for name, own in lines.items():
        want += ["", f"{name} ({len(own)}):", *[f"  {line}" for line in own]]
    want += ["", "decisions:", *[f"  {line}" for line in decisions]]
    frame = spark.createDataFrame(rows, schema)
    assert report.text_report(frame, 0.8, "overwrite", 12, verbose=True) == "\n".join(want) + "\n"
    stopped = report.text_report(frame, 0.8, "overwrite", 12, dry_run=True, stopped=("embedding", 40, "no answer")).splitlines()
    assert stopped[0] == "Ingest report (DRY RUN: nothing written)" and stopped[3] == "stopped: embedding at record 40: no answer; 40 records processed"


def test_nearest(spark):
    schema = "id long, vector array<float>"
    catalog = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], schema)
    queries = spark.createDataFrame([(10, [5.0, 0.0]), (11, [0.1, 1.0]), (12, [-1.0, 0.0])], schema)
    got = {r["id"]: (r["match_id"], round(r["score"], 4)) for r in search.nearest(queries, catalog).collect()}
    assert got == {10: (1, 1.0), 11: (2, 0.995), 12: (2, 0.0)}
    assert {tuple(r) for r in search.nearest(queries, catalog.limit(0)).collect()} == {(10, None, None), (11, None, None), (12, None, None)}
    assert {(r["id"], r["match_id"]) for r in search.leave_one_out(catalog).collect()} == {(1, 3), (3, 1), (2, 1)}


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in np.round(rng.normal(size=4), 1)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    whole = {tuple(r) for r in search.leave_one_out(df).collect()}
    edges = {tuple(r) for r in similarity.in_batch_edges(df, 0.8).collect()}
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 500)
    assert {tuple(r) for r in search.leave_one_out(df).collect()} == whole
    assert {tuple(r) for r in similarity.in_batch_edges(df, 0.8).collect()} == edges
    joined = {(max(r["id"], r["match_id"]), min(r["id"], r["match_id"])) for r in similarity.threshold_join(df, df, 0.8).collect() if r["id"] != r["match_id"]}
    assert joined == {(i, j) for i, j, _ in edges}


def test_embedders(spark):
    model = HashEmbedder(8)
    v = model.embed(["", "a", "a"])
    assert (v[1] == v[2]).all() and (v[0] != v[1]).any() and (np.abs(v) <= 1).all()
    # splitmix64 from the FNV-1a offset basis: the first value by hand
    z = (0xCBF29CE484222325 + 0x9E3779B97F4A7C15) % 2**64
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) % 2**64
    z ^= z >> 31
    assert v[0, 0] == np.float32(2 * ((z >> 40) / 2**24) - 1)
    preflight(model)
    with pytest.raises(ValueError):
        checked(np.zeros((2, 3)), 2, 4)
    texts = spark.createDataFrame([("x",), ("y",), ("x",)], "text string")
    first = embed_distinct(texts, model)
    cache = cache_rows(first.filter("text = 'x'"), model).withColumn("vector", F.array(*[F.lit(9.0).cast("float")] * 8))
    got = {r["text"]: r["vector"] for r in embed_distinct(texts, model, cache).collect()}
    assert got["x"] == [9.0] * 8 and got["y"] == pytest.approx(list(model.embed(["y"])[0]))


def test_first_per_key_ignores_rejected(spark):
    rows = [(0, "s", "1", "n", "", "", None, "bad", []), (1, "s", "1", "n", "", "", "n", None, []), (2, "s", "1", "n", "", "", "n", None, [])]
    assert [r["first_index"] for r in links.first_per_key(spark.createDataFrame(rows, RECORD)).collect()] == [1]


def test_constraints(spark):
    products = spark.createDataFrame([(1, "a", None, None)], PRODUCT)
    good = [(1, "s", 1, "x")]
    for bad in ((2, "s", 1, "x"), (2, "s", 7, "y"), (2, "s", 1, ""), (2, "s", 1, "y" * 65), (2, None, 1, "y")):
        with pytest.raises(constraints.ConstraintError):
            constraints.check_links(spark.createDataFrame([*good, bad], LINK), products)
    constraints.check_links(spark.createDataFrame([*good, (2, "t", 1, "x"), (3, "s", 1, "y" * 64)], LINK), products)


def test_store_commits_and_migrates(spark, folder):
    store = CatalogStore(spark, f"{folder}/catalog")
    products = spark.createDataFrame([(1, "a", None, None)], PRODUCT)
    legacy = spark.createDataFrame([(4, "s", 1, 77)], "id long, seller_name string, product_id long, seller_product_id long")
    store.commit(products, legacy, version=1, check=False)
    with pytest.raises(NotMigrated):
        store.links()
    assert store.migrate() and not store.migrate()
    assert [tuple(r) for r in store.links().collect()] == [(4, "s", 1, "77")]
    assert store.high_water() == (1, 4)
    before = store.manifest()
    with pytest.raises(constraints.ConstraintError):
        store.commit(products, spark.createDataFrame([(5, "s", 2, "x")], LINK))
    assert store.manifest() == before


def test_a_chain_of_dependent_records_settles(spark):
    """Each record changes the product so that only the next one matches it: record after record depends on the one before."""
    n = 20
    products = [(k + 1, f"p{k}", None, None) for k in range(n)]
    ident = lambda name, brand: name + (f" | brand: {brand}" if brand else "")
    # record 2k fills the brand of product k, record 2k+1 matches the filled product only
    records = []
    for k in range(n):
        records.append((2 * k, "s", f"a{k}", f"p{k}", "b", "", ident(f"p{k}", "b"), None, []))
        records.append((2 * k + 1, "s", f"b{k}", f"p{k}", "b", "", ident(f"p{k}", "b"), None, []))
    linked = [(k + 1, "s", k + 1, f"a{k}") for k in range(n)]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((records, RECORD), (products, PRODUCT), (linked, LINK))]
    done = ingest(*frames, HashEmbedder(), 0.975, "fill")
    got = {r["record_index"]: (r["outcome"], r["product_id"]) for r in done.results.collect()}
    assert got == {i: (("existing", "linked")[i % 2], i // 2 + 1) for i in range(2 * n)}


def test_large_ids_and_search_that_prunes(spark):
    big = 1 << 60
    frames = [spark.createDataFrame(rows, schema) for rows, schema in (
        ([(0, "s", "1", "n", "", "", "n", None, []), (1, "s", "2", "m", "", "", "m", None, [])], RECORD), ([(big, "n", None, None)], PRODUCT), ([], LINK))]
    got = {r["record_index"]: (r["outcome"], r["product_id"]) for r in ingest(*frames, HashEmbedder(), 0.975).results.collect()}
    assert got == {0: ("linked", big), 1: ("inserted", big + 1)}
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 64))
    rows = [(k, [float(x) for x in centres[k % 12] + 0.1 * rng.normal(size=64)]) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    m = np.array([v for _, v in rows], np.float32).astype(np.float64)
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    want = {(i, j) for i, j in zip(*np.nonzero(m @ m.T >= 0.9))}
    assert {(r["id"], r["match_id"]) for r in similarity.threshold_join(df, df, 0.9).collect()} == want
    a, b = similarity.cells(df, df, 0.9)
    key = ["_cell", "_row", "_column"]
    compared = a.groupBy(*key).count().join(b.groupBy(*key).agg(F.count("*").alias("m")), key).agg(F.sum(F.col("count") * F.col("m"))).first()[0]
    assert len(want) <= compared < 600 * 600 / 4, "most pairs are never compared"


def test_a_model_server(spark):
    import http.server
    import json
    import threading

    from mergewell.operators.embed import HttpEmbedder, embed_texts

    answers = {"status": 200, "change": lambda v: v}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert self.path == "/api/embed" and asked["model"] == "m" and len(asked["input"]) <= 64
            body = json.dumps({"embeddings": answers["change"]([[len(t), 1.0] for t in asked["input"]])}).encode()
            self.send_response(answers["status"])
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = HttpEmbedder(f"http://127.0.0.1:{server.server_port}", "m", 2)
    texts = spark.createDataFrame([("x" * (1 + k),) for k in range(150)], "text string")
    assert {r["text"]: list(r["vector"]) for r in embed_texts(texts, model).collect()} == {"x" * (1 + k): [1.0 + k, 1.0] for k in range(150)}
    with pytest.raises(ValueError, match="blank"):
        model.embed(["a", " "])
    for change, message in ((lambda v: v[:-1], "vectors for"), (lambda v: [[1.0]] * len(v), "shape"), (lambda v: [[0.0] * 2] * 10**6, "exceeds")):
        answers["change"] = change
        with pytest.raises(ValueError, match=message):
            HttpEmbedder(model.url, "m", 2, most_bytes=1 << 20).embed(["a", "b"])
    answers |= {"change": lambda v: v, "status": 503}
    with pytest.raises(OSError):
        model.embed(["a"])
    server.shutdown()
