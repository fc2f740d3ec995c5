"""Near duplicates, components, fingerprints, mixing, archives and the pipeline: rows that depend on others."""

import collections
import gzip
import hashlib
import math
import os
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from mergewell.llm import fingerprints, mixing, near_dup, quality, secret_scan, textkernel, warc
from mergewell.llm.components import connected_components
from mergewell.workspace import fresh_path, with_rank
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
DOC = "doc_id long, text string"


def family(rng, n, size, edits):
    base = [f"w{rng.randint(0, 500)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(size)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    texts = []
    for size, n, edits in ((40, 25, 2), (80, 20, 5), (200, 12, 9), (12, 6, 1), (60, 30, 0)):
        texts += family(rng, n, size, edits)
    passage = " ".join(f"p{k}" for k in range(60))
    for k in range(40):  # a passage that many documents share, with more or less of their own
        texts.append(passage + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.choice([3, 8, 15, 30, 60]))))
    texts += [" ".join(f"r{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 90))) for _ in range(40)]
    texts += [None, "", " \n", "one two", "one  two", "ONE TWO", "one two three four five", "one two three four five"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_near_duplicates(spark, monkeypatch, limit):
    monkeypatch.setattr(near_dup, "BROADCAST_NODES", limit)
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], f"{DOC}, n_shingles int")
    got = {r["doc_id"]: r for r in near_dup.deduplicate(df).collect()}
    want = brute.components(docs)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["n_shingles"] == len(brute.shingles(t)) and got[d]["kept"] == (want[d] == d) for d, t in docs for r in [got[d]])
    assert len(set(want.values())) < len(docs) - 80


def test_near_duplicates_of_odd_tables(spark):
    assert near_dup.deduplicate(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f"), (9, "z")]
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_dup.deduplicate(spark.createDataFrame(rows, DOC)).collect())
    assert got == [("2", "2", True), ("3", "2", False), ("3", "2", False), ("9", "9", True), ("None", "None", True)]


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (300, 200)]
    random.Random(2).shuffle(edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(60)} | {200: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_hashes_see_whole_words():
    import pyarrow as pa

    texts = ["The quick  brown\tfox jumps over", "the QUICK brown fox jumps over", "the quick brown foxjumps over", None, "é" * 10, "x " * 3 + "y" * 100, "b a", "ab"]
    sets = []
    for block in (textkernel.BLOCK, 7):
        out = {}
        old, textkernel.BLOCK = textkernel.BLOCK, block
        for i, j, h, at in textkernel.shingles(pa.array(texts), 5):
            h, at = textkernel.distinct(h, at)
            out |= {i + k: tuple(h[at[k] : at[k + 1]]) for k in range(j - i)}
        textkernel.BLOCK = old
        sets.append(out)
    assert sets[0] == sets[1]
    assert sets[0][0] == sets[0][1] != sets[0][2] and sets[0][3] == () and [len(sets[0][k]) for k in (0, 2, 4, 5)] == [2, 1, 1, 1]
    assert sets[0][6] != sets[0][7]


def test_ranks(spark):
    rows = [(x % 3, x) for x in range(50)] + [(1, 7)] * 5
    got = with_rank(spark.createDataFrame(rows, "a long, b long"), [F.col("a").desc(), F.col("b")], "r").orderBy("r").collect()
    assert [r["r"] for r in got] == list(range(55)) and [(r["a"], r["b"]) for r in got] == sorted(rows, key=lambda x: (-x[0], x[1]))


def _hash64(value, seed=42):
    signed = value if value < 2**63 else value - 2**64
    return xxhash.xxh64_intdigest(struct.pack("<q", signed), seed)


def brute_fingerprint(text, coordinates):
    counts = collections.Counter(brute.words(text, lower=False))
    if not counts:
        return ""
    out = []
    for k in range(coordinates):
        least = None
        for word, n in counts.items():
            term, u = xxhash.xxh64_intdigest(word.encode(), 42), []
            for j in range(3):
                h = xxhash.xxh64_intdigest(struct.pack("<i", 3 * k + j), _hash64(term))
                u += [((h & 0xFFFFFFFF) + 0.5) / 2**32, ((h >> 32) + 0.5) / 2**32]
            r, log_c = -math.log(u[0] * u[1]), math.log(-math.log(u[2] * u[3]))
            key = log_c - r * (math.floor(math.log(n) / r + u[4]) - u[4]) - r
            least = key if least is None or key < least else least
        spot = _hash64(math.floor(least * 2**30) % 2**64)
        out.append(f"{xxhash.xxh64_intdigest(struct.pack('<i', k), spot) & 0xFFFF:04x}")
    return "".join(out)


def test_fingerprints(spark):
    rng = random.Random(4)
    docs = [(k * 3, " ".join(rng.choice("a b c d e fé g h ij k".split()) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 60)))) for k in range(12)]
    docs += [(100, None), (101, "  "), (102, "same words"), (103, "same words"), (104, "é" * 7), (105, "x")]
    rows = [(d, t, "x") for d, t in docs] + [(102, "same words", "x"), (None, "last", "x")]
    got = fingerprints.fingerprint(spark.createDataFrame(rows, f"{DOC}, fingerprint string"), 8).collect()
    order = sorted(docs, key=lambda x: -x[0]) + [(None, "last")]
    assert len(got) == len(rows), "a row for each repeat"
    by = {r["doc_id"]: r for r in got}
    assert len({tuple(r) for r in got}) == len(order)
    like = lambda a, b: 1.0 if a == b else 0.0 if not a or not b else sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 32, 4)) / 8
    for k, (d, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        r = by[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest()), d
        prints = brute_fingerprint(text, 8), brute_fingerprint(edited, 8)
        assert (r["fingerprint"], r["edited_fingerprint"]) == prints, d
        assert r["near_edited"] == pytest.approx(like(*prints)) and r["near_next"] == pytest.approx(like(prints[0], brute_fingerprint(after, 8)))
    assert by[102]["fingerprint"] == by[103]["fingerprint"]
    single = fingerprints.fingerprint(spark.createDataFrame([(1, "abcdef")], DOC), 4).first()
    assert single["near_next"] == 1.0 and single["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprints.fingerprint(spark.createDataFrame([], DOC), 4).count() == 0


def test_likeness_estimates_generalised_jaccard(spark):
    a, b = "x y z " * 10 + "p q r", "x y " * 10 + "z p s t"
    x, y = (collections.Counter(t.split()) for t in (a, b))
    true = sum((x & y).values()) / sum((x | y).values())
    got = fingerprints.fingerprint(spark.createDataFrame([(2, a), (1, b)], DOC), 256).filter("doc_id = 2").first()
    assert got["near_next"] == pytest.approx(true, abs=0.12)


def test_mixing(spark):
    rng = random.Random(8)
    docs = [(k, rng.choice(["b", "a", "a", "a", "é", None, "z"]), "w " * int(rng.expovariate(0.02))) for k in range(300)]
    docs += [(900, "empty", ""), (901, "empty", None), (902, "a", "w w"), (902, "a", "w w")]
    df = spark.createDataFrame([(d, s, t, 1) for d, s, t in docs], "doc_id long, source string, text string, size int")
    got = mixing.mix(df).collect()
    want = brute.mix(docs)
    assert sorted(map(str, [(r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["copies"]) for r in got])) == sorted(
        str((*w[:4], round(w[4], 6), w[5])) for w in want
    )
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    for r in got:
        assert abs(taken[r["source"]] - r["target"]) <= max(x["size"] for x in got if x["source"] == r["source"]) * 2
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r["target"] for r in mixing.mix(df.filter("source = 'empty'")).collect()} == {0.0}


PAGES = [
    (1, "http://a/\r\nX: y", "a" * 2000), (2, None, "a" * 2000), (5, "u", "a" * 2000), (5, "u", "a" * 2000), (3, "u", None), (4, "u", ""), (7, "é", "short"), (8, "u", "short"),
    (None, "u", "a" * 2000), (9, "b", "\r\n\r\nx" * 1000), (10, "c", "WARC/1.1\r\n" * 300), (11, "d", "é" * 500), (12, "d", "é" * 500), (13, "e", "y" * 3_000_000), (14, "f", "b" * 999), (15, "f", "b" * 999),
]


def test_archives_round_trip(spark):
    df = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, payload_bytes int")
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        last = max((p[0] for p in PAGES if p[2] == html and p[0] is not None), default=None)
        back = last if len(body) >= 1000 and i is not None and i < last else None
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if back is None else "revisit", back))
    got = warc.round_trip(df).collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archive_filters_and_other_writers(spark, folder):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = fresh_path(spark, "archive")
    warc.write_warc(warc.page_records(df), path, roll_bytes=3000)
    revisits = warc.read_warc(spark, path).filter("record_type = 'revisit' and page_id in (1, 11)")
    assert {(r["page_id"], r["refers_to"]) for r in revisits.collect()} == {(1, 5), (11, 12)}
    bare = warc.read_warc(spark, path, payload="false").collect()
    assert len(bare) == len(PAGES) and all(r["payload"] is None for r in bare)
    assert warc.read_warc(spark, path).filter("page_id = 1").first()["target_uri"] == "http://a/%0D%0AX: y"
    reader = warc.PushingReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    kept = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("page_id",), 3)]))
    assert len(kept) == 1 and reader.tests == [("record_type", frozenset(["revisit"]))]
    fs, base = warc.open_folder(path)
    members = [gzip.open(os.path.join(base, n)).read() for n in os.listdir(base) if n.endswith(".gz")]
    assert len(members) > 1
    with open(f"{folder}/a.warc", "wb") as plain, open(f"{folder}/b.warc.gz", "wb") as packed, open(f"{folder}/c.warc.gz", "wb") as whole:
        plain.write(b"".join(members))
        packed.write(b"".join(gzip.compress(m) for m in members))
        whole.write(gzip.compress(b"".join(members)))
    counts = warc.read_warc(spark, folder).groupBy("page_id").agg(F.count("*").alias("n"), F.min(F.octet_length("payload")).alias("b"), F.max(F.octet_length("payload")).alias("c"))
    sizes = {r["page_id"]: (r["n"], r["b"], r["c"]) for r in counts.collect()}
    assert sizes[13] == (3, 3_000_000, 3_000_000) and sizes[9] == (3, 5000, 5000) and sizes[5][0] == 6


@data
def test_pipeline_against_a_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.train(spark.read.parquet(f"{DATA}/documents.parquet"), labels.select("doc_id", F.col("quality").alias("label")))
    import numpy as np

    kept = []
    for row in docs:
        body = np.frombuffer((row[1] or "").encode(), np.uint8)
        if model.score(*quality.passages(body, np.array([0, len(body)])))[0] >= 0.3:
            kept.append(row)
    assert 0 < len(kept) < len(docs)
    root = brute.components([r[:2] for r in kept])
    kept = [r for r in kept if root[r[0]] == r[0]]
    bad = {d for d, _, _ in brute.contaminated([r[:2] for r in kept], items)}
    kept = [r for r in kept if r[0] not in bad]
    clean = []
    for d, text, lang, source, n in kept:
        found = brute.spans(text, secret_scan.KINDS)
        clean.append((d, brute.masked(text, found), lang, source, len(brute.masked(text, found)) if found else n))
    by = {r[0]: r for r in clean}
    want = []
    for d, _, _, _, _, copies in brute.mix([(r[0], r[3], r[1]) for r in clean]):
        want += [(*by[d], c + 1) for c in range(copies)]
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_stages_on_odd_documents(spark, folder):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13), (4, "A b c d e f g", None, "s", 13), (None, "x y", "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "no such words in here at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", "), name
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "2", "3", "None"]
    assert corpus_pipeline.mixed(spark, docs, folder).count() >= 1
    assert corpus_pipeline.mixed(spark, docs.limit(0), folder).count() == 0
