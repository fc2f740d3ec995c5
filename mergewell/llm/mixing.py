"""Mixing sources to target weights by systematic sampling.

Within a source every document expects the same number of copies, target over size.  Documents are
put in order of size, so that the sample is spread evenly over short and long texts; the running sum
of the expected copies, shifted by one random offset a source, crosses a number of integers at each
document, and it is taken that many times.  The running sum needs only the document's position in its
source, which comes from a range-partitioned rank: a source that holds a third of all rows is spread
over as many tasks as its share.

Defined results: null and empty text have size 0 and take nothing; a null source is a source of its
own and sorts last; a source without words has target 0; documents that tie on source and size are
ordered by ``doc_id``, then by a hash of the text; repeated rows are separate documents; a very long text
is one document like any other and taken whole; extra columns are ignored by ``mix`` and kept by
``sample``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.workspace import materialize, with_rank

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources (a row of a few dozen bytes each) their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def source_targets(by_source: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Add ``weight`` and ``target`` to ``by_source (source, source_size)``, one row a source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all
    words; no target exceeds ``most`` times its source's size, and what one can't take is shared
    again among the others.  Each round of sharing is one aggregate over the sources.
    """
    ranked = with_rank(by_source, [F.col("source").isNull(), F.col("source")], "_rank", "sources")
    choice = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialize(
        ranked.withColumn("weight", F.element_at(choice, (F.col("_rank") % len(weights) + 1).cast("int"))).drop("_rank"),
        "weights",
    )
    cap = most * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, full, open_weight, seen = share * total, 0.0, None, -1
    while True:
        level = F.lit(False) if open_weight is None else F.col("weight") * (budget - full) / open_weight > cap
        row = ranked.agg(
            F.sum(F.when(level, 1).otherwise(0)), F.sum(F.when(level, cap)), F.sum(F.when(~level, F.col("weight")))
        ).first()
        if row[0] == seen or not row[2]:
            break
        seen, full, open_weight = row[0], row[1] or 0.0, row[2]
    fair = F.col("weight") * (budget - full) / open_weight if open_weight else F.lit(0.0)
    return ranked.withColumn("target", F.least(cap, fair))


def _mixed(sized: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: str) -> DataFrame:
    """``sized`` with ``source_size, target, copies``; it has ``source, size``, the tie breakers ``_id, _hash`` and what is to be kept."""
    order = [F.col("source").isNull(), *[F.col(c) for c in ("source", "size", "_id", "_hash")]]
    placed = with_rank(sized, order, "_rank", "mix")
    by_source = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("_rank").alias("_first"))
    by_source = materialize(by_source, "source-sizes")
    targets = source_targets(by_source, weights, share, most)
    spread = F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce("source", F.lit("")))), 1, 5)
    offset = (F.conv(spread, 16, 10).cast("double") + 0.5) / float(1 << 20)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    table = targets.select(
        F.col("source").alias("_source"), "source_size", "target", "_first", rate.alias("_rate"), offset.alias("_offset")
    )
    if by_source.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    spot = F.col("_rank") - F.col("_first")
    crossed = F.floor((spot + 1) * F.col("_rate") + F.col("_offset")) - F.floor(spot * F.col("_rate") + F.col("_offset"))
    return placed.join(table, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", crossed.cast("long"))


def _sized(docs: DataFrame, *keep: Column) -> DataFrame:
    return docs.select(
        *keep,
        F.col("doc_id").cast("long").alias("_id"),
        F.xxhash64("text").alias("_hash"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix"
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs (doc_id, source, text)``."""
    return _mixed(materialize(_sized(docs), "sizes"), weights, share, most, seed).select(
        F.col("_id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def sample(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix"
) -> DataFrame:
    """The mix itself: a row of ``docs``, with all its columns, for each copy that is taken, numbered by ``copy``.

    A column of that name is replaced.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns if c != "copy"]).alias("_doc")  # no column of theirs can clash
    taken = _mixed(_sized(docs, whole), weights, share, most, seed).filter("copies > 0")
    return taken.select("_doc.*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size,
                     CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
              FROM sized GROUP BY source),
filled AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM by_source)::DOUBLE AS budget, (SELECT sum(weight) FROM by_source) AS all_weight,
                  coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS s_before, coalesce(sum(weight) OVER before, 0) AS w_before
           FROM by_source WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, 2.0::DOUBLE * source_size * (all_weight - w_before) < weight * (budget - s_before) AS capped FROM filled),
level AS (SELECT coalesce(sum(CASE WHEN capped THEN 2.0::DOUBLE * source_size END), 0) AS s, sum(CASE WHEN NOT capped THEN weight END) AS w FROM marked),
targets AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * (budget - s) / w) AS target,
                   (('0x' || substr(md5('mix|' || coalesce(source, '')), 1, 5))::BIGINT::DOUBLE + 0.5::DOUBLE) / 1048576.0::DOUBLE AS shift
            FROM marked, level),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS spot FROM sized)
SELECT doc_id, p.size::BIGINT AS size, source_size, target,
       (size * (floor((spot + 1)::DOUBLE * (CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) + shift)
              - floor(spot::DOUBLE * (CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) + shift)))::BIGINT AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
"""
