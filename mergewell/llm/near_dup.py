"""Near-duplicate documents: MinHash signatures joined through an inverted index.

1. Every text becomes its set of distinct word shingles and a signature of ``COORDINATES`` minima.
   Equal sets collapse to one node, whatever the ids of their rows.
2. A node is posted under its coordinate-value pairs.  A link needs at least ``MATCHES`` equal
   coordinates (at a similarity of 0.75 fewer have a chance of about three in a million), so two
   linked nodes meet in the ``COORDINATES - MATCHES + 1`` rarest pairs of both: only this prefix is
   posted, and pairs that one node has are skipped.
3. Every list is merged around two of its members (the one that most texts resemble and one of the
   smallest set):
   the others are compared with these by full sets, which costs as many comparisons as postings.
   What is linked becomes components.
4. What lists still hold in several components is finished exactly, by full sets: shingles are
   ordered rarest first, and a prefix and position filter on them says which nodes of different
   components can still be linked.  Of a list's largest component only pairs with others are
   looked at.  First the best pair of each node with each component is confirmed, then, where
   components still differ, all pairs.

No list, group of copies or component is ever in one task as a whole, no pair inside a component is
made, and nothing is dropped or capped.

Defined results: null text and text without words have an empty set and are linked with nothing;
fewer words than a shingle are one shingle, the whole sequence; a null ``doc_id`` is linked with
nothing, has a null component and is kept; rows that repeat a ``doc_id`` are returned each and linked
each by its own text, so two texts of one ``doc_id`` can be in different components; a component is
named by its smallest ``doc_id``, and ties in anything else change no result; very long texts are
hashed in blocks and compared whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.llm.components import connected_components
from mergewell.llm.textkernel import constants, distinct, mix, reduce_rows, shingles
from mergewell.workspace import discard, materialize

WORDS = 5
COORDINATES = 96
MATCHES = 53
#: Up to so many candidate ids (8 bytes each), or rows to leave out (16 bytes each), are broadcast to find their texts; beyond, texts are shuffled.
BROADCAST_NODES = 1_000_000
FACTOR = constants(1, 101)[0]


def _marks(h: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """128 bits that tell each row's set, from a sum and an exclusive or over its hashes."""
    sums = reduce_rows(np.add, mix(h + np.uint64(5)), at, np.uint64(0))
    tied = reduce_rows(np.bitwise_xor, mix(h * FACTOR + np.uint64(9)), at, np.uint64(0))
    return [pa.array(sums.view(np.int64)), pa.array(tied.view(np.int64))]


def _sets(words: int, coordinates: int):
    factors, marks = constants(coordinates, 101), constants(coordinates, 202)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, at in shingles(batch.column("text"), words):
                h, at = distinct(h, at)
                n = np.diff(at)
                keys = np.empty((j - i, coordinates), np.int64)
                for k in range(coordinates):
                    least = reduce_rows(np.minimum, h * factors[k], at, np.uint64(0))
                    keys[:, k] = mix(least ^ marks[k]).view(np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, coordinates, 0))]), pa.int32()),
                    pa.array(keys[n > 0].ravel(), pa.int64()),
                )
                kept = [batch.column(c).slice(i, j - i) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(n, pa.int64()), *_marks(h, at), lists],
                    ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "keys"],
                )

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, at in shingles(batch.column("text"), words):
                h, at = distinct(h, at)
                full = [h[at[k] : at[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [*_marks(h, at), pa.array(np.diff(at), pa.int64()), pa.array(full, pa.binary())],
                    ["set_a", "set_b", "n", "shingles"],
                )

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_x"), batch.column("set_y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of each node."""
    for batch in batches:
        for node, n, full in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("shingles")):
            own = np.frombuffer(full.as_buffer(), np.int64)
            for k in range(0, len(own), 1 << 16):
                part = own[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), node)), pa.array(np.full(len(part), n)), pa.array(part)], ["node", "n", "shingle"]
                )


def _comparable(a: Column, b: Column, percent: int) -> Column:
    """Set sizes that allow a link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _linked(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    left = full.select(F.col("node").alias("a"), F.col("shingles").alias("set_x"))
    right = full.select(F.col("node").alias("b"), F.col("shingles").alias("set_y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_confirm(percent), "a long, b long")


def prefixes(nodes: DataFrame, matches: int) -> DataFrame:
    """``key, node, n, common``: the rarest coordinate-value pairs of each node, as far as a link needs them.

    ``common`` is the number of postings in all lists of the node: it is high for a text that many resemble.
    """
    posted = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    # written, so that the join deals out both sides and can split a long list
    shared = materialize(posted.groupBy("key").agg(F.count("*").alias("listed")).filter("listed > 1"), "listed")
    ordered = (
        posted.join(shared, "key")
        .groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("listed", "key"))).alias("own"))  # at most one entry a coordinate
        .filter(F.size("own") >= matches)
    )
    common = F.aggregate("own", F.lit(0).cast("long"), lambda total, e: total + e["listed"])
    first = F.explode(F.slice("own", F.lit(1), F.size("own") - matches + 1))
    return ordered.select("node", "n", common.alias("common"), first.alias("e")).select(F.col("e.key").alias("key"), "node", "n", "common")


def star_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """Each list's members with its most common node and with a node of its smallest set.

    The most common texts of a group of near copies are in most of its lists, so these share few centres.
    """
    typical, small = F.struct("common", F.col("node")), F.struct("n", "node")
    centres = posted.groupBy("key").agg(
        F.max_by("node", typical).alias("c1"), F.max_by("n", typical).alias("n1"),
        F.min_by("node", small).alias("c2"), F.min("n").alias("n2"), F.count("*").alias("m"),
    ).filter("m > 1")
    centre = F.explode(F.array(F.struct(F.col("c1").alias("b"), F.col("n1").alias("nb")), F.struct(F.col("c2").alias("b"), F.col("n2").alias("nb"))))
    return (
        posted.join(centres, "key")
        .select(F.col("node").alias("a"), "n", centre.alias("c"))
        .select("a", "c.b", "n", "c.nb")
        .filter((F.col("a") != F.col("b")) & _comparable(F.col("n"), F.col("nb"), percent))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def rest_pairs(rest: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of nodes of different components that a prefix and position filter on full sets leaves.

    ``rest`` has ``node, n, shingles, component``.  The result has ``a, b``, their components and
    ``room``, the most that the two sets can share; the tables under it can be discarded once it is written.
    """
    each = materialize(rest.select("node", "n", "shingles").mapInArrow(_spread, "node long, n long, shingle long"), "shingles")
    shared = materialize(each.groupBy("shingle").agg(F.count("*").alias("held")).filter("held > 1"), "held")
    # a text's shingles come together, rarest first; those that no other node has precede them all
    ordered = each.join(shared, "shingle").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("own"))
    probe = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    index = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    own = ordered.select("node", "n", probe.alias("probe"), index.alias("index"), F.posexplode("own").alias("k", "e"), F.size("own").alias("s"))
    spot = F.col("n") - F.col("s") + F.col("k")
    posted = (
        own.withColumn("spot", spot)
        .filter("spot < probe")
        .select(F.col("e.shingle").alias("shingle"), "node", "n", "spot", (F.col("spot") < F.col("index")).alias("indexed"))
        .join(rest.select("node", "component"), "node")
    )
    spots = posted = materialize(posted, "rest")
    sizes = posted.groupBy("shingle", "component").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("shingle").agg(F.max_by("component", "m").alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    mixed = materialize(mixed, "mixed")
    # written, so that the join of the lists with themselves deals out both sides and can split a long list
    posted = materialize(posted.join(mixed, "shingle"), "rest-lists")
    main = F.col("component") == F.col("main")
    out = None
    for left, right in ((posted.filter(~main), posted), (posted.filter(main), posted.filter(~main))):
        a = left.select("shingle", *[F.col(c).alias(f"a_{c}") for c in ("node", "n", "spot", "component")])
        b = right.filter("indexed").select("shingle", *[F.col(c).alias(f"b_{c}") for c in ("node", "n", "spot", "component")])
        room = 1 + F.least(F.col("a_n") - F.col("a_spot") - 1, F.col("b_n") - F.col("b_spot") - 1)
        smaller = (F.col("b_n") < F.col("a_n")) | ((F.col("b_n") == F.col("a_n")) & (F.col("b_node") < F.col("a_node")))
        enough = (100 + percent) * room >= percent * (F.col("a_n") + F.col("b_n"))
        same = (a["shingle"] == b["shingle"]) & (F.col("a_component") != F.col("b_component")) & smaller
        found = a.join(b, same & _comparable(F.col("a_n"), F.col("b_n"), percent) & enough).select(
            F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_component", "b_component", room.alias("room")
        )
        out = found if out is None else out.unionByName(found)
    return out.groupBy("a", "b", "a_component", "b_component").agg(F.max("room").alias("room")), [each, shared, spots, mixed, posted]


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after ``links (a, b)`` between components."""
    joined = connected_components(links)
    merged = joined.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return labels.join(merged, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))


def hashed(docs: DataFrame, words: int, coordinates: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_a, set_b, keys`` for every row of ``docs (doc_id, text)``."""
    shape = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, keys array<long>"
    return _texts(docs).withColumn("text_hash", text_hash()).mapInArrow(_sets(words, coordinates), shape)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def components(docs: DataFrame, sets: DataFrame, words: int, matches: int, percent: int) -> DataFrame:
    """``set_a, set_b, component, component_id`` for every distinct non-empty set."""
    groups = sets.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")
    )
    groups = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    posted = materialize(prefixes(groups, matches), "prefixes")
    pairs = materialize(star_pairs(posted, percent), "pairs")
    members = materialize(posted.select("node", "n").distinct().join(groups.select("node", "set_a", "set_b", "least"), "node"), "nodes")
    chosen = members.select(F.col("least").alias("doc_id")).distinct()
    if members.count() <= BROADCAST_NODES:
        chosen = F.broadcast(chosen)
    full = _texts(docs).join(chosen, "doc_id").mapInArrow(_full_sets(words), "set_a long, set_b long, n long, shingles binary")
    full = full.join(members.drop("least"), ["set_a", "set_b", "n"]).dropDuplicates(["node"]).select("node", "n", "shingles")
    full = materialize(full, "full-sets")

    labels = members.select("node", F.col("node").alias("component"))
    labels = materialize(_relabelled(labels, _linked(pairs, full, percent)), "labels")
    lists = posted.join(labels, "node").groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_nodes = posted.join(lists.filter("low < high").select("key"), "key").select("node").distinct()
    rest = full.join(open_nodes, "node").join(labels, "node")
    left, under = rest_pairs(rest, percent)
    left = materialize(left, "rest-pairs")
    discard(*under)
    best = left.groupBy("a", "b_component").agg(F.max_by("b", "room").alias("b"))
    for tested in () if left.isEmpty() else (best, left):
        at = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        bt = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        found = _linked(tested.join(at, "a").join(bt, "b").filter("ca <> cb").select("a", "b"), full, percent)
        links = found.join(at, "a").join(bt, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        labels = materialize(_relabelled(labels, links), "labels")
    discard(posted, pairs, full, left)
    own = groups.select("node", "set_a", "set_b", "least")
    names = own.join(labels, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    named = own.join(labels.join(names, "component"), "node", "left").select(
        "set_a", "set_b", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "least").alias("component_id")
    )
    named = materialize(named, "components")
    discard(groups, members)
    return named


def linked_rows(docs: DataFrame, words: int, percent: int, coordinates: int, matches: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component, component_id`` for every row of ``docs``; rows that nothing can link have no component."""
    sets = materialize(hashed(docs, words, coordinates), "sets")
    found = components(docs, sets, words, matches, percent)
    own = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return sets.drop("keys").join(found, ["set_a", "set_b"], "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(~own, F.col("component")).alias("component"),
        F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def deduplicate(
    docs: DataFrame, words: int = WORDS, percent: int = 75, coordinates: int = COORDINATES, matches: int = MATCHES
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text)``."""
    return linked_rows(docs, words, percent, coordinates, matches).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def keep_one(
    docs: DataFrame, words: int = WORDS, percent: int = 75, coordinates: int = COORDINATES, matches: int = MATCHES
) -> DataFrame:
    """``docs``, with all columns, less all but one row of every component.

    The row with the smallest ``doc_id`` stays, of several texts with that id the one with the smallest
    hash, and of rows that repeat id and text some one.  Rows without words or id all stay.
    """
    rows = materialize(linked_rows(docs, words, percent, coordinates, matches).filter("component is not null"), "near-dup")
    row = F.struct("doc_id", "text_hash")
    first = rows.groupBy("component").agg(F.min(row).alias("first"), F.count("*").alias("m")).filter("m > 1").drop("m")
    several = rows.join(materialize(first, "first"), "component").withColumn("stays", row == F.col("first"))
    key = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")]
    dropped = materialize(several.filter(~F.col("stays")).select(*key).distinct(), "left-out")
    repeated = materialize(several.filter("stays").groupBy(*key).count().filter("count > 1").drop("count"), "repeated")
    whole = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), text_hash().alias("_hash")
    )  # no column of theirs can clash
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_NODES else df
    kept = whole.join(small(dropped), ["_id", "_hash"], "left_anti")
    if not repeated.isEmpty():
        repeated = small(repeated)
        once = kept.join(repeated, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
        kept = kept.join(repeated, ["_id", "_hash"], "left_anti").unionByName(once)
    return kept.select("_doc.*")


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
meets AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM meets JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, m) AS component_id, d.doc_id = least(d.doc_id, m) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON r.x = d.doc_id
"""
