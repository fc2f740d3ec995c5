"""Source divergence audit against a plain loop over exact integers."""

import random
import re
from collections import Counter, defaultdict
from math import floor
from fractions import Fraction

from mergewell.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, rank string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=3, top=200):
    counts, langs, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    sources = defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        found = Counter(t.translate(LOWER) for t in TERM.findall(text or ""))
        counts[lang, source].update(found)
        langs[lang].update(found)
        docs[lang].update(found.keys())
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(found):
            below = sum(found[t] for t in kept) + len(kept)
            return {t: 1 + floor(Fraction(10**9 * (found[t] + 1), below)) for t in kept}

        q = shares(langs[lang])
        p = {s: shares(counts[lang, s]) for s in names}
        f = lambda a, b: (a - b) ** 2 // b
        for s in names:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in names - {s}]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(k, *r, "x", 1, "y") for k, r in enumerate(rows)], SCHEMA).repartition(5)
    got = divergence.audit(df, **settings)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


def corpus():
    rng = random.Random(4)
    words = ["Wort", "mot", "word", "éa", "Éa", "ſ", "日本", "x" * 30, "aß", "ZZ", "\U0001f600"] + [f"t{chr(97 + k)}{chr(97 + k % 5)}" for k in range(26)]
    rows = []
    for k in range(400):
        lang = rng.choice(["en", "de", "fr", None])
        source = "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", "ß", None, "", "\U0001f600"])
        glue = rng.choice([" ", "-", "\x00", "1", "\x7f", "\n", "@", "_"])
        rows.append((glue.join(rng.choice(words[:: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))), lang, source))
    rows += [(None, "en", "only null"), ("", "en", "only empty"), ("123 --- 4", "it", "alone"), ("rare", "es", "a"), ("words", "es", "b")]
    rows += [("the same text", "pt", s) for s in "abcabcabc"]  # ties
    rows += [("a b c " * 400_000 + "x" * 2_000_000 + " end", "pt", "long")]
    return rows


def test_against_a_plain_loop(spark):
    rows = corpus()
    assert run(spark, rows) == plain(rows)


def test_buckets_tables_and_pieces_change_nothing(spark, monkeypatch):
    rows = corpus()[:-1] + [("some words of a text " * 30, "en", "s1")]
    expected = plain(rows, top=5)
    monkeypatch.setattr(divergence, "CELLS", 20)
    monkeypatch.setattr(divergence, "ENTRIES", 10)
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert run(spark, rows, top=5) == expected


def test_empty_table(spark):
    assert run(spark, []) == []


def test_terms_in_pieces(monkeypatch):
    text = "Ein Überblick, éé word\x00Word".encode()
    whole = divergence.term_counts(text)
    assert whole == Counter({b"ein": 1, "Überblick".encode(): 1, "éé".encode(): 1, b"word": 2})
    for size in range(1, 12):
        monkeypatch.setattr(divergence, "PIECE", size)
        assert divergence.term_counts(text) == whole


def test_shares_of_large_counts():
    import numpy as np

    n, total = np.array([[3 * 10**14, 0]]), np.array([10**15, 10**15])
    assert divergence.shares(n, total).tolist() == [[1 + 10**9 * (3 * 10**14 + 1) // 10**15, 1]]


def test_full_tables_are_sent_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "ENTRIES", 3)
    rows = [(b"a b a", "en", "s"), (b"b c d e", "en", "s"), (b"", "en", "empty"), (b"a", "de", "s"), (b"a b", "en", "s")]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k]]) for k in range(3)], ["text", "lang", "source"]) for r in rows]
    sent = [row for batch in divergence._sums(iter(batches)) for row in batch.to_pylist()]
    docs, counts = Counter(), Counter()
    for row in sent:
        if row["term"] is not None:
            docs[row["lang"], row["source"], row["term"]] += row["docs"]
            counts[row["lang"], row["source"], row["term"]] += row["n"]
    assert counts == {("en", "s", "a"): 3, ("en", "s", "b"): 3, ("en", "s", "c"): 1, ("en", "s", "d"): 1, ("en", "s", "e"): 1, ("de", "s", "a"): 1}
    assert docs["en", "s", "a"] == 2 and docs["en", "s", "b"] == 3
    assert {(r["lang"], r["source"]) for r in sent if r["term"] is None} == {("en", "s"), ("en", "empty"), ("de", "s")}
