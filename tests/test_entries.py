import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mergewell.functions import text
from mergewell.operators import validate
from mergewell.plans import report
from mergewell.sources import payloads
from mergewell.streaming.incremental import FILES

ID = "0f8fad5b-d9cb-469f-a165-70867728950e"
DEFAULT = {"Id": ID, "SellerName": "Northwind", "Name": "Desk lamp", "Brand": "Lumo", "Category": "Office"}
#: The states that a field can be in; what isn't a string can be anything else.
STATES = {"missing": ..., "null": None, "number": 3.5, "list": ["q"], "object": {"q": 1}, "true": True, "blank": " \t", "unseen": "\u200b\x00", "text": "own"}


def element(**changes):
    row = DEFAULT | changes
    return json.dumps({k: v for k, v in row.items() if v is not ...})


def judged(**changes):
    """The reason to reject and the identity, field by field as the rules say."""
    row = DEFAULT | changes
    for field, value in row.items():
        needed = field in ("Id", "SellerName", "Name")
        text_value = isinstance(value, str)
        if value is ... or value is None:
            if needed:
                return f"{field}: {'missing' if value is ... else 'null'}", None
        elif not text_value:
            return f"{field}: not a string", None
        elif needed and not value.strip(" \t\u200b\x00"):
            return f"{field}: blank", None
        elif field == "Id" and value != ID:
            return "Id: not a UUID", None
    parts = [row["Name"]] + [f"{f.lower()}: {row[f]}" for f in ("Brand", "Category") if isinstance(row[f], str) and row[f].strip(" \t\u200b\x00")]
    return None, " | ".join(parts)


def changed():
    fields = list(DEFAULT)
    one = [{f: v} for f in fields for v in STATES.values()]
    two = [{f: v, g: w} for k, f in enumerate(fields) for g in fields[k + 1 :] for v, w in ((None, 3.5), (..., None), (" \t", ...), (["q"], {"q": 1}))]
    return one + two


CASES = [(element(**c), *judged(**c)) for c in changed()]
CASES += [(element(Id=f"\n{ID.upper()} "), None, judged()[1]), (element(Weight=2), None, judged()[1]), (element(Id=..., ID=ID), "Id: missing", None)]
CASES += [(element()[:-1] + f', {json.dumps(f)}: "twice"}}', f'duplicate key "{f}"', None) for f in DEFAULT]
CASES += [(element()[:-1] + ', "inner": {"k": 0, "k": 1}}', None, judged()[1])]
CASES += [(value, "not an object", None) for value in ("0", "false", "null", '"lamp"', "[]", "[[{}]]")]


def write(folder, *contents):
    for k, content in enumerate(contents):
        with open(os.path.join(folder, f"p{k:02d}.json"), "wb") as out:
            out.write(content if isinstance(content, bytes) else content.encode())
    return folder


def test_elements(spark, folder):
    path = write(folder, "[" + ",".join(e for e, _, _ in CASES) + "]")
    found = validate.records(payloads.elements(payloads.read_payloads(spark, path)))
    rows = {r["record_index"]: r for r in found.collect()}
    assert len(rows) == len(CASES)
    for k, (_, reason, identity) in enumerate(CASES):
        assert (rows[k]["reason"], rows[k]["identity"]) == (reason, identity), CASES[k]
    assert rows[len(changed())]["seller_product_id"] == ID
    unseen = rows[[c for c, _, _ in CASES].index(element(Name=STATES["unseen"]))]
    assert [(f["field"], f["reason"]) for f in unseen["flags"]] == [("Name", text.CONTROLS)]


def test_lines_agree_with_arrays(spark, folder):
    path = write(folder, "\n".join(e for e, _, _ in CASES) + "\nnot json\n\n")
    rows = validate.records(payloads.read_lines(spark, path)).orderBy("record_index").collect()
    assert [r["reason"] for r in rows] == [reason for _, reason, _ in CASES] + ["not an object"]


def test_flags_of_rejected_entries(spark, folder):
    path = write(folder, "[" + element(Id="17", Brand="Lumo /* new") + "]")
    row = validate.records(payloads.read_payloads(spark, path)).first()
    assert (row["reason"], row["flags"][0]["field"], row["brand"]) == ("Id: not a UUID", "Brand", "Lumo /* new")


@pytest.mark.parametrize("content, kept", [
    (" \n", 0), ("{0}", 0), ("17", 0), ("[{0}, {0}, }", 2), ("[{0},{0}", 2), ("[{0}]]", 1), ("[{0}] {0}", 1), ("[{0}, Infinity]", 1), ("[{0}; {0}]", 1), ("[,{0}]", 0), ("[{0},,{0}]", 1),
])
def test_payload_errors(content, kept):
    rows = list(payloads.split_array(content.replace("{0}", element()).encode()))
    assert sum(r["payload_error"] is None for r in rows) == kept
    assert rows[-1]["payload_error"]


def test_empty_array_and_limit():
    assert list(payloads.split_array(b" [ ] ")) == []
    content = f"[{element()}]".encode()
    assert all(r["payload_error"] is None for r in payloads.split_array(content, len(content)))
    for limit in (len(content) - 1, len(content) // 2, 1):
        assert "exceeds" in list(payloads.split_array(content, limit))[-1]["payload_error"]


def test_many_payloads_keep_their_valid_prefix(spark, folder):
    path = write(folder, f"[{element()}]", f"[{element()},", b"[" + element(Name="a").encode().replace(b'"a"', b'"a\xff"') + b"]")
    found = payloads.read_payloads(spark, path).cache()
    assert payloads.elements(found).count() == 3
    assert payloads.payload_errors(found).count() == 1
    assert "a�" in {r["raw_name"] for r in found.collect()}


def test_a_file_over_the_limit_harms_no_other(spark, folder):
    """3 GiB, which no row of a table holds: its elements within the limit and one error."""
    path = write(folder, f"[{element()}]", f"[{element()}, {element(Name='b')},")
    with open(f"{path}/p01.json", "r+b") as out:
        out.truncate(3 << 30)
    os.rename(f"{path}/p01.json", f"{path}/p 1%20é.json")
    found = payloads.read_payloads(spark, path, 10_000).collect()
    assert sorted((r["raw_name"] or r["payload_error"], r["record_index"]) for r in found if "p00" in r["payload_id"]) == [("Desk lamp", 0)]
    rest = sorted((r["record_index"] is None, r["record_index"], r["payload_error"]) for r in found if "p00" not in r["payload_id"])
    assert rest == [(False, 0, None), (False, 1, None), (True, None, "exceeds 10000 bytes")]


def test_a_stream_loads_no_file_over_the_limit(spark, folder):
    path = write(folder, f"[{element()}]", f"[{element()},")
    with open(f"{path}/p01.json", "r+b") as out:
        out.truncate(3 << 30)
    files = spark.readStream.format("binaryFile").schema(FILES).load(path)
    seen = []
    run = payloads.bounded(files, 1000).writeStream.foreachBatch(lambda batch, _: seen.extend(payloads.decode_files(batch, 1000).collect()))
    run.option("checkpointLocation", f"{folder}/../{os.path.basename(folder)}-check").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["payload_error"] or "" for r in seen) == ["", "", "exceeds 1000 bytes"]


def test_lines_keep_their_place_however_files_are_split(spark, folder):
    path = write(folder, *["".join(f"{k}-{n}{'x' * (n % 37)}\n" * (n % 3) for n in range(200)) for k in range(5)], "", "last")
    want = [line for name in sorted(os.listdir(path)) for line in open(f"{path}/{name}").read().splitlines()]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in (kept, "300b", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            rows = payloads.numbered_lines(spark, path).collect()
            assert [r["value"] for r in sorted(rows)] == want
            assert [r["record_index"] for r in sorted(rows)] == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_json_records_leave_out_empty_fields(spark, folder):
    path = write(folder, f"[{element(Brand=None)}, {element(Id=1)}]")
    lines = [json.loads(r["line"]) for r in report.json_records(validate.records(payloads.elements(payloads.read_payloads(spark, path)))).orderBy("record_index").collect()]
    assert lines[0] == {"index": 0, "id": ID, "sellerName": "Northwind", "name": "Desk lamp", "category": "Office", "identity": "Desk lamp | category: Office"}
    assert lines[1]["reason"] == "Id: not a string" and "identity" not in lines[1]


def test_counts(spark):
    rows = [(0, "s", "bad", "n", None, None), (1, "s", ID, "n", "x;", None), (2, "s", "bad", "<script", None, None)]
    found = validate.records(spark.createDataFrame(rows, "record_index long, raw_seller string, raw_id string, raw_name string, raw_brand string, raw_category string"))
    assert [tuple(r) for r in validate.reason_counts(found).collect()] == [("Id: not a UUID", 2)]
    assert {tuple(r) for r in validate.flag_counts(found).collect()} == {("Brand", text.SQL_LIKE, 1), ("Name", text.MARKUP, 1)}
    assert validate.suspicious(found).count() == 2 and found.filter(F.size("flags") == 0).count() == 1


def test_fields_are_cleaned_once_whatever_is_asked_of_them(spark):
    rows = [(0, "shop", ID, "lamp​", "x'; DROP TABLE", "  a  b "), (1, None, "nope", "y" * 300, None, "javascript:")]
    found = validate.records(spark.createDataFrame(rows, "record_index long, raw_seller string, raw_id string, raw_name string, raw_brand string, raw_category string"))
    for asked in (validate.suspicious(validate.accepted(found)), validate.flag_counts(found), validate.reason_counts(found)):
        plan = asked._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1
    flagged = validate.suspicious(found).orderBy("record_index").collect()
    assert [[tuple(f) for f in r["flags"]] for r in flagged] == [[("Name", text.CONTROLS), ("Brand", text.SQL_LIKE)], [("Name", text.TRUNCATED), ("Category", text.MARKUP)]]
    assert (flagged[0]["category"], flagged[0]["identity"], flagged[1]["reason"]) == ("a b", "lamp | brand: x'; DROP TABLE | category: a b", "Id: not a UUID")


def test_rows_of_small_payloads_share_batches(monkeypatch):
    batches = []

    class Files:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            files = pa.RecordBatch.from_pydict({"path": [str(k) for k in range(500)], "content": [f"[{element()}]".encode()] * 499 + [b"{}"]})
            batches.extend(run(iter([files])))

    payloads.decode_files(Files())
    assert [b.num_rows for b in batches] == [500]
    assert batches[0].column("payload_id").to_pylist() == [str(k) for k in range(500)] and batches[0].column("payload_error")[499].as_py() == "top level is not an array"
    batches.clear()
    monkeypatch.setattr(payloads, "FLUSH_BYTES", 1000)
    payloads.decode_files(Files())
    assert sum(b.num_rows for b in batches) == 500 and max(b.num_rows for b in batches) < 20
