import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from mergewell.functions import text, vectors

#: What the rules name, to be strung together at random.
BLANKS = ["\t", "\n", "\r", " ", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u3000"]
REMOVED = ["\x00", "\x1b", "\x7f", "\xad", "\u200b", "\u2060", "\ufeff", "\x9f"]
LETTERS = ["kettle", "n\u0303", "Å", "ß", "5.5mm", "'", "(", "東", "e\u0301", "½"]


def plainly(raw):
    """Blanks to spaces, controls out, composed, single spaces, none at the ends, 256 code points."""
    spaced = "".join(" " if c in BLANKS or c in "\v\f" else c for c in raw)
    kept = "".join(c for c in spaced if unicodedata.category(c) not in ("Cc", "Cf"))
    words = [w for w in unicodedata.normalize("NFC", kept).split(" ") if w]
    return " ".join(words)[:256].rstrip(" ")


def strings(n, seed):
    rng = random.Random(seed)
    pieces = [*BLANKS, *REMOVED, *LETTERS, *LETTERS, *LETTERS]
    return ["".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 4, 12, 90]))) for _ in range(n)] + ["q" * n for n in (255, 256, 257, 1000)] + ["q" * 255 + " r"]


def test_sanitize(spark):
    raw = strings(300, 17)
    df = spark.createDataFrame(list(enumerate(raw)), "k long, raw string")
    once = df.select("k", text.sanitize(F.col("raw")).alias("v"))
    assert {r["k"]: r["v"] for r in once.collect()} == {k: plainly(t) for k, t in enumerate(raw)}
    again = once.select("k", "v", text.sanitize(F.col("v")).alias("w")).filter("v <> w")
    assert again.count() == 0


def test_null_stays_null(spark):
    assert spark.createDataFrame([(None,)], "raw string").select(text.sanitize(F.col("raw")).alias("v")).first()["v"] is None


def test_repair():
    """Each run of bytes that don't decode becomes one replacement character."""
    rng = random.Random(23)
    good, bad = ["v", "ö", "文", "🐈"], [b"\x80", b"\xc1", b"\xf8", b"\xfe", b"\xbf\xbf"]
    for _ in range(200):
        raw, want, broken = b"", "", False
        for _ in range(rng.randint(0, 9)):
            if rng.random() < 0.5:
                piece = rng.choice(good)
                raw, want, broken = raw + piece.encode(), want + piece, False
            else:
                raw, want, broken = raw + rng.choice(bad), want if broken else want + "\ufffd", True
        assert text.repair_utf8(raw) == (want, "\ufffd" in want)
    began = time.time()
    assert text.repair_utf8(b"\xfez" * 500_000) == ("\ufffdz" * 500_000, True) and time.time() - began < 10


def test_repair_column(spark):
    r = spark.createDataFrame([(bytearray(b"a\xff\xfeb"),)], "b binary").select(text.repair("b").alias("r")).first()["r"]
    assert (r["text"], r["repaired"]) == ("a�b", True)


WORDS = ("select", "insert", "update", "delete", "drop", "union", "exec", "alter", "create", "truncate")


def flagged():
    """(raw, reasons): every alternative of the rules, and what only looks like one."""
    out = [(f"desk {mark} lamp", [text.SQL_LIKE]) for mark in (";", "--", "/*", "*/")]
    out += [(f"desk{quote}{gap}{word.upper()} lamp", [text.SQL_LIKE]) for word in WORDS for quote, gap in (("'", " "), ('"', ") "), ("`", ""))]
    out += [("lamp' or 7=7", [text.SQL_LIKE]), ("lamp' OR 'b", [text.SQL_LIKE]), ("lamp' oracle", []), ("lamp or 7", []), ("lamp - 7", [])]
    out += [(f"{word} a lamp", []) for word in WORDS] + [(f"lamp' {word}ed", []) for word in WORDS] + [("lamp's shade", []), ("7\" lamp", [])]
    out += [(tag, [text.MARKUP]) for tag in ("lamp <script", "lamp < / ScRiPt >", "JavaScript:lamp()")] + [("<b>lamp</b>", []), ("java script lamp", [])]
    out += [("lamp" + c, [text.CONTROLS]) for c in REMOVED] + [("lamp" + c + "shade", []) for c in BLANKS]
    out += [("l" * 256, []), ("l" * 300, [text.TRUNCATED]), ("\x00" + "l" * 256 + ";", [text.CONTROLS, text.TRUNCATED]), (";\x00 <script", [text.CONTROLS, text.SQL_LIKE, text.MARKUP])]
    return out


FLAGGED = flagged()


def test_flags(spark):
    df = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(FLAGGED)], "k long, raw string")
    full = df.withColumn("f", text.uncapped(F.col("raw"))).withColumn("v", text.capped(F.col("f")))
    for r in full.select("k", text.flags("Brand", F.col("raw"), F.col("f"), F.col("v")).alias("flags")).collect():
        assert [f["reason"] for f in r["flags"]] == FLAGGED[r["k"]][1]
        assert all(f["field"] == "Brand" for f in r["flags"])


def test_identity_and_keys(spark):
    rows = [(n, b, c) for n in ("Über-Lampe №9", "Desk") for b in ("Lumo", "", None) for c in ("Office", "", None)]
    df = spark.createDataFrame(rows, "n string, b string, c string")
    got = [tuple(r) for r in df.select(text.identity(F.col("n"), F.col("b"), F.col("c")), text.match_key(F.col("n"))).collect()]
    keys = {"Über-Lampe №9": "uberlampeno9", "Desk": "desk"}
    assert got == [(n + (f" | brand: {b}" if b else "") + (f" | category: {c}" if c else ""), keys[n]) for n, b, c in rows]


def test_vectors(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, []), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {r["id"]: r for r in df.select("id", vectors.problem(F.col("v"), 2).alias("p"), vectors.unit(F.col("v")).alias("u")).collect()}
    assert [got[k]["p"] for k in range(1, 8)] == [None, "zero", "empty", "empty", "not finite", "not finite", "dimension"]
    assert got[1]["u"] == pytest.approx([0.6, 0.8])
    pair = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in pair.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.70710678), None]


def test_decision_is_inclusive_in_single_precision(spark):
    df = spark.createDataFrame([(0.975,), (0.97499,), (None,)], "s float")
    assert [r[0] for r in df.select(vectors.kind(F.col("s"), 0.975)).collect()] == ["duplicate", "novel", "novel"]
