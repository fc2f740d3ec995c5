"""How far the sources of each language are from each other, and the terms that set a source apart.

Terms are runs of ASCII letters and of characters beyond ASCII.  One translation of a text's bytes lowers
``A-Z`` and blanks everything else, splitting at blanks gives the terms, and a counter a document gives its
counts.  Tasks add documents up for each language and source in bounded tables, so the shuffle carries sums,
one row for each term of a source, however often it occurs.  A language's sources then stand side by side in
rows of one term each (as many entries as sources have it); these are dealt into buckets of a language, so
that no language is one task, and each bucket adds up its terms' differences of all pairs of sources at once.

All arithmetic is on integers.  Probabilities are parts of a billion, at least one, so terms that a source
lacks count as well.

Defined results: null text, language and source are empty strings; empty texts have no terms but make their
source occur; repeated rows are documents of their own; equal values are ranked by the item's UTF-8 bytes;
a language of one source has no pairs, and one without kept terms has pairs of value 0; very long texts are
split into terms about a megabyte at a time; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergewell.workspace import discard, materialize

#: Letters in lower case and bytes beyond ASCII stay; all others become blanks.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE = 1 << 20
#: Entries of a task's tables before they are sent on.
ENTRIES = 1 << 18
#: Entries of the matrix of terms and sources that a bucket works on, about.
CELLS = 1 << 21
SUMS = "lang string, source string, term string, docs long, n long"
NAMES = [c.split()[0] for c in SUMS.split(", ")]


def term_counts(text: bytes) -> Counter[bytes]:
    """The terms of one document and how often they occur."""
    if len(text) <= PIECE:
        return Counter(text.translate(TABLE).split())
    counts: Counter[bytes] = Counter()
    rest = b""
    for i in range(0, len(text), PIECE):
        terms = (rest + text[i : i + PIECE].translate(TABLE)).rsplit(b" ", 1)
        rest = terms.pop()  # may go on in the next piece
        if terms:
            counts.update(terms[0].split())
    counts.update([rest] if rest else [])
    return counts


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, docs, n`` of a task's documents; a row without term for each source."""
    tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, counts) in tables.items():
            terms = list(counts)
            if terms:
                columns = [
                    pa.array([lang]).take(pa.array(np.zeros(len(terms), np.int64))),
                    pa.array([source]).take(pa.array(np.zeros(len(terms), np.int64))),
                    pa.array(terms, pa.binary()).cast(pa.string(), safe=False),
                    pa.array([docs[t] for t in terms], pa.int64()),
                    pa.array([counts[t] for t in terms], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, NAMES)
                docs.clear()
                counts.clear()

    for batch in batches:
        for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source"))):
            docs, counts = tables.setdefault((lang, source), (Counter(), Counter()))
            own = term_counts(text)
            docs.update(own.keys())
            counts.update(own)
        if sum(len(counts) for _, counts in tables.values()) > ENTRIES:
            yield from flush()
        if len(tables) > ENTRIES:
            yield _sources(tables)
            tables.clear()
    yield from flush()
    yield _sources(tables)


def _sources(tables: dict) -> pa.RecordBatch:
    keys = list(tables)
    none = pa.nulls(len(keys))
    columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), none.cast(pa.string()), none.cast(pa.int64()), none.cast(pa.int64())]
    return pa.RecordBatch.from_arrays(columns, NAMES)


#: 1 + floor(10^9 (count + 1) / (total + terms)), on decimals that no count of longs leaves.
SHARE = "1 + (cast(1000000000 as decimal(10,0)) * cast({} + 1 as decimal(20,0))) div cast({} + terms as decimal(20,0))"


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same for arrays: a long division, so that no product leaves 64 bits."""
    rest, out = counts + 1, np.zeros(np.broadcast(counts, totals).shape, np.int64)
    for _ in range(3):  # a billion is a thousand three times
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest = rest % totals
    return out + 1


def _pair_sums(key: tuple, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """``lang, a, b, value``: the summed differences of a bucket's terms for each ordered pair of sources."""
    lang, _ = (k.as_py() for k in key)
    groups = groups.sort_by("place")
    size, total = groups.num_rows, groups.column("total").to_numpy() + groups.column("terms").to_numpy()
    value = np.zeros((size, size), np.int64)
    lists = terms.column("counts").combine_chunks()
    if terms.num_rows and size > 1:
        at = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        row, place, n = np.repeat(np.arange(len(at)), at), flat.field("place").to_numpy() - 1, flat.field("n").to_numpy()
        step = max(1, CELLS // size)
        for i in range(0, len(at), step):
            own = slice(*np.searchsorted(row, [i, i + step]))
            counts = np.zeros((min(step, len(at) - i), size), np.int64)
            counts[row[own] - i, place[own]] = n[own]
            p = shares(counts, total)
            for a in range(size):
                gap = p[:, [a]] - p
                value[a] += (gap * gap // p).sum(axis=0)
    a, b = np.nonzero(~np.eye(size, dtype=bool))
    lang_column = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(a), np.int64)))
    return pa.table({"lang": lang_column, "a": a.astype(np.int32) + 1, "b": b.astype(np.int32) + 1, "value": value[a, b]})


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every language and source of ``docs (text, lang, source)``.

    Part ``pair``: every other source of the language by its difference, all ranks.  Part ``term``: the
    source's ``top`` terms whose share exceeds the language's.  Terms count from ``least_docs`` documents on.
    """
    filled = docs.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
    )
    sums = filled.mapInArrow(_sums, SUMS).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    sums = materialize(sums, "term-counts")
    whole_lang = Window.partitionBy("lang")  # a row for each of its sources
    placed = sums.filter("term is null").select("lang", "source").withColumns(
        {"place": F.row_number().over(whole_lang.orderBy("source")), "size": F.count("*").over(whole_lang)}
    )
    # a term's sources side by side: at most one entry a source
    each = sums.filter("term is not null").join(placed.select("lang", "source", "place"), ["lang", "source"]).groupBy("lang", "term")
    wide = each.agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("place", "n")).alias("counts"))
    kept = materialize(wide.filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    flat = kept.select("lang", "term", "lang_n", F.inline("counts"))
    totals = flat.groupBy("lang", "place").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    filled_in = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = placed.join(totals, ["lang", "place"], "left").join(langs, "lang", "left")
    groups = materialize(groups.select("lang", "source", "place", "size", *map(filled_in, ("total", "terms", "lang_total"))), "sources")
    discard(sums)

    # every language is dealt into as many buckets of terms as the matrix of its terms and sources needs
    buckets = F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("size") / CELLS)).cast("int")
    about = groups.filter("place = 1").select("lang", buckets.alias("buckets"))
    rows = kept.join(about, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "counts")
    sides = groups.join(about, "lang").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    parts = rows.groupBy("lang", "bucket").cogroup(sides.groupBy("lang", "bucket")).applyInArrow(_pair_sums, "lang string, a int, b int, value long")
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    named = lambda place, name: groups.select("lang", F.col("place").alias(place), F.col("source").alias(name))
    pairs = pairs.join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    own = flat.join(groups.select("lang", "source", "place", "total", "terms", "lang_total"), ["lang", "place"])
    shared = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(SHARE.format("n", "total")).alias("p"), F.expr(SHARE.format("lang_n", "lang_total")).alias("q"))
    terms = shared.filter("p > q").select("lang", "source", "part", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))


ORACLE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
),
groups AS (SELECT DISTINCT lang, source FROM docs),
terms AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM terms t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
langs AS (SELECT lang, sum(n) + count(*) AS below FROM kept GROUP BY lang),
below AS (
    SELECT g.lang, g.source, coalesce(sum(c.n), 0) + (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS below
    FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source
),
shares AS (
    SELECT b.lang, b.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // b.below::HUGEINT AS p,
           1 + (1000000000::HUGEINT * (k.n + 1)) // l.below::HUGEINT AS q
    FROM below b JOIN kept k ON b.lang = k.lang JOIN langs l ON b.lang = l.lang
    LEFT JOIN counts c ON c.lang = b.lang AND c.source = b.source AND c.term = k.term
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
),
results AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM results)
WHERE part = 'pair' OR rank <= 200
"""
