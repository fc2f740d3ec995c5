"""Results that are whole: nothing listed is cut."""

import json
import os

import pytest

from mergewell import queries
from mergewell.plans import calibrate as cal

TABLES = "/root/testdata/sf0.001"


def test_all_missed_matches_are_listed(spark):
    positives = spark.createDataFrame([(k, 0.1 if k % 2 else 0.9) for k in range(500)], "record_index long, score float")
    negatives = spark.createDataFrame([(0.2,)], "score float")
    want = list(range(1, 500, 2))
    row = cal.shipped(positives, negatives, 0.42).first()
    assert row["safe"] and row["missed"] == want
    assert sorted(r["record_index"] for r in cal.missed(positives, 0.42).collect()) == want


def against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    con = duckdb.connect()
    for file in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{TABLES}/{file}'")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, TABLES)
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(map(tuple, got.select(*columns).collect()), key=repr)
    assert rows == sorted(found.fetchall(), key=repr)
    return rows


def test_missed_matches_of_the_tables(spark):
    assert len(against_sql(spark, "threshold_missed")) > 100
    against_sql(spark, "threshold_check")


def test_texts_are_taken_whole(spark):
    docs = spark.createDataFrame([(1, "é" * 400 + "a"), (2, "é" * 400 + "b"), (3, " " * 400 + "late\x07")], "doc_id long, text string")
    ladder = {r["doc_id"]: r for r in queries._ladder(docs).collect()}
    assert all(ladder[1][level] != ladder[2][level] for level in ("exact", "collapsed", "folded", "alphanumeric"))
    assert ladder[1]["folded"] == "e" * 400 + "a"
    dirty = {r["doc_id"]: r for r in queries._sanitized_dirty(docs).collect()}
    assert dirty[3]["value"].endswith(" late") and dirty[3]["flags"]


@pytest.mark.parametrize("name", ["match_ladder_whole_texts", "sanitize_dirty_whole_texts"])
def test_whole_texts_of_the_tables(spark, name):
    against_sql(spark, name)


def test_whole_vectors(spark):
    assert all(len(row) == 29 for row in against_sql(spark, "letter_whole_vectors"))


def plain_json(r):
    row = {"index": r["record_index"], "id": r["seller_product_id"], "sellerName": r["seller_name"], **{c: r[c] for c in ("name", "brand", "category", "identity", "reason")}}
    row["flags"] = [f.asDict() for f in r["flags"]]
    return {c: v for c, v in row.items() if v not in (None, "", [])}


def test_whole_json_lines(spark):
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    records = {r["record_index"]: plain_json(r) for r in queries._records(spark, TABLES).collect()}
    lines = {r["record_index"]: json.loads(r["line"]) for r in queries.QUERIES["json_lines"](spark, TABLES).collect()}
    assert lines == records and any("flags" in x for x in lines.values()) and any("reason" in x for x in lines.values())


def plain_lines(r):
    who = f"#{r['record_index']} {r['seller_name']} {r['seller_product_id']}"
    product = f"#{r['record_index']} product {r['product_id']}: "
    if r["outcome"] == "rejected":
        yield "rejected", 0, f"{who}: {r['reason']}"
    if r["outcome"] == "failed":
        yield "failed", 0, f"{who}: {r['err_kind']}: {r['reason']}"
    if r["flags"]:
        yield "suspicious", 0, f"{who}: " + "; ".join(f"{f['field']}: {f['reason']}" for f in r["flags"])
    if r["outcome"] == "inserted":
        near = "" if r["match_id"] is None else f" (nearest {r['match_id']} at {r['score']:.3f})"
        yield "inserted", 0, f"{who} → product {r['product_id']} \"{r['identity']}\"{near}"
    for k, c in enumerate(r["changes"] or []):
        yield "changes", k, f"{product}{c['field']}: {c['old'] or '(null)'} → {c['new']}"
    for k, n in enumerate(r["notes"] or []):
        yield "notes", k, product + n


def test_all_report_lines(spark):
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    results = queries.QUERIES["ingest_fill"](spark, TABLES).collect()
    want = sorted((section, r["record_index"], part, line) for r in results for section, part, line in plain_lines(r))
    got = sorted((r["section"], r["record_index"], r["part"], r["line"]) for r in queries.QUERIES["report_all_lines"](spark, TABLES).collect())
    assert got == want
    assert {x[0] for x in got} >= {"rejected", "suspicious", "inserted"}, {x[0] for x in got}
