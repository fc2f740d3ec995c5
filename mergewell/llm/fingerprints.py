"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is a weighted set: its words and how often each occurs.  For every coordinate each word draws
two gamma variates and a uniform one from hashes of the word and the coordinate; the improved
consistent sampling of Ioffe (2010) turns them and the weight into a key, and the least key is the
sample.  Two texts agree in a coordinate with a probability that equals their generalised Jaccard
similarity, so the share of equal coordinates estimates it.  A key depends on the word and on the
quantised weight alone, hence a hash of the least key stands for the sample.

Everything that is known of a text is computed in the partition that holds it: texts are dealt by
document once, and only the piece of the next text that an edited text needs is dealt again.

Defined results: null text is empty; a text without words has the fingerprint ``''``, which is fully
like itself and unlike all others; rows that agree in ``doc_id`` and text are one document in the
order, and a row is returned for each; documents that tie on ``doc_id`` are ordered by a hash of the
text; a null ``doc_id`` comes last; a single document is its own next one; very long texts are split
into words by the task that holds them; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.workspace import materialize, with_rank

COORDINATES = 48
#: Coordinates that one aggregate computes: all at once make a method that is too long to be compiled well.
GROUP = 4
HEX = 4  # 16 bits a coordinate: two samples look equal by chance once in 65536
NO_ID = -(1 << 63)
KEY = ["_id", "_hash"]
#: Up to so many documents that have repeats (16 bytes each) are broadcast to find their rows; beyond, texts are shuffled.
BROADCAST_REPEATED = 1_000_000
SPACE = "[\\x20\\x09-\\x0D]+"


def _uniforms(k: int) -> list[Column]:
    """Six uniform variates in (0, 1) from three hashes of the word's hash and coordinate ``k`` of the row's group."""
    out = []
    for j in range(3):
        h = F.xxhash64("term", F.col("_group") * (3 * GROUP) + F.lit(3 * k + j))
        out += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return [(u.cast("double") + 0.5) / float(1 << 32) for u in out]


def _least_keys(weights: dict[str, str]) -> list[Column]:
    """For each coordinate of a group and each weight column, the least key over the rows where it is positive."""
    out = []
    for k in range(GROUP):
        u = _uniforms(k)
        r = -F.ln(u[0] * u[1])
        log_c = F.ln(-F.ln(u[2] * u[3]))
        for name, log_weight in weights.items():
            level = F.floor(F.col(log_weight) / r + u[4])
            out.append(F.min(log_c - r * (level - u[4]) - r).alias(f"{name}_{k}"))
    return out


def _printed(name: str) -> Column:
    """Hex of a hash of each least key of a group, one after the other."""
    mask = F.lit((1 << (4 * HEX)) - 1)
    hashes = [F.xxhash64(F.floor(F.col(f"{name}_{k}") * float(1 << 30)), F.col("_group") * GROUP + F.lit(k)) for k in range(GROUP)]
    parts = [F.lpad(F.lower(F.hex(h.bitwiseAND(mask))), HEX, "0") for h in hashes]
    return F.when(F.col(f"{name}_0").isNull(), "").otherwise(F.concat(*parts))


def sample_words(texts: DataFrame, keys: list[str], sides: dict[str, str], coordinates: int) -> DataFrame:
    """One fingerprint column a side for every row of ``texts``, whose ``keys`` are distinct.

    ``sides`` maps the names of the fingerprints to the text columns.  If ``texts`` is dealt out by
    ``keys`` there is no further exchange.
    """
    names = list(sides)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("text")) for k, c in enumerate(sides.values())]))
    words = (
        texts.select(*keys, each.alias("s"))
        .select(*keys, "s.side", F.explode(F.split("s.text", SPACE)).alias("word"))
        .filter("word <> ''")
        .select(*keys, "side", F.xxhash64("word").alias("term"))
    )
    counts = words.groupBy(*keys, "term").agg(
        *[F.ln(F.sum(F.when(F.col("side") == k, 1.0))).alias(f"_ln_{name}") for k, name in enumerate(names)]
    )
    groups = range(-(-coordinates // GROUP))
    each_group = counts.withColumn("_group", F.explode(F.array(*[F.lit(g) for g in groups])))
    least = each_group.groupBy(*keys, "_group").agg(*_least_keys({name: f"_ln_{name}" for name in names}))
    printed = least.select(*keys, "_group", *[_printed(name).alias(name) for name in names])
    whole = lambda name: F.concat(*[F.max(F.when(F.col("_group") == g, F.col(name))) for g in groups])
    return printed.groupBy(*keys).agg(*[F.substring(whole(name), 1, HEX * coordinates).alias(name) for name in names])


def likeness(a: Column, b: Column, coordinates: int) -> Column:
    """The share of equal coordinates of two fingerprints."""
    same = sum(
        (F.when(F.substring(a, 1 + HEX * k, HEX) == F.substring(b, 1 + HEX * k, HEX), 1.0).otherwise(0.0) for k in range(coordinates)),
        F.lit(0.0),
    )
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(same / float(coordinates))


def successions(own: DataFrame) -> DataFrame:
    """Every document of ``own (_id, _hash, ...)`` and the next one in descending ``_id`` (after the last: the first)."""
    placed = materialize(with_rank(own, [F.col("_id").desc(), F.col("_hash")], "_rank", "ids"), "order")
    last = placed.agg(F.max("_rank")).first()[0] or 0
    following = placed.select(F.col("_rank").alias("_next_rank"), F.col("_id").alias("_next_id"), F.col("_hash").alias("_next_hash"))
    return placed.withColumn("_next_rank", F.when(F.col("_rank") == last, 0).otherwise(F.col("_rank") + 1)).join(
        following, "_next_rank"
    ).drop("_next_rank", "_rank")


def _once(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` without the repeats of the keys in ``repeated``, which are combined before they are dealt out."""
    if repeated.isEmpty():
        return rows
    small = F.broadcast(repeated) if repeated.count() <= BROADCAST_REPEATED else repeated
    once = rows.join(small, KEY, "left_semi").groupBy(*KEY).agg(F.first("_text").alias("_text"))
    return rows.join(small, KEY, "left_anti").unionByName(once)


def fingerprint(docs: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """Fingerprints of every text of ``docs (doc_id, text)`` and of its edited text.

    The edited text has its last third replaced by as many first characters of the next document.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
    ).withColumn("_hash", F.xxhash64("_text"))
    own = rows.groupBy(*KEY).agg(F.first(F.char_length("_text")).alias("_chars"), F.count("*").alias("_repeats"))
    order = materialize(successions(own), "successions")
    repeated = materialize(order.filter("_repeats > 1").select(*KEY), "repeated")
    cut = F.floor(F.col("_chars") / 3).cast("int")
    wanted = order.select(
        F.col("_next_id").alias("_id"), F.col("_next_hash").alias("_hash"), F.col("_id").alias("_for_id"), F.col("_hash").alias("_for_hash"), "_chars"
    )
    # word counts take several times the space of their texts: smaller partitions keep them in memory
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _once(rows, repeated).repartition(parts, *KEY)
    pieces = dealt.join(wanted, KEY).select(
        F.col("_for_id").alias("_id"), F.col("_for_hash").alias("_hash"), "_chars", F.substring(F.col("_text"), F.lit(1), cut).alias("_piece")
    )
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), F.col("_chars") - cut), F.col("_piece"))
    texts = dealt.join(pieces, KEY).select(*KEY, "_text", edited.alias("_edited"))
    prints = sample_words(texts, KEY, {"fingerprint": "_text", "edited_fingerprint": "_edited"}, coordinates)
    # the same columns as for the words, so that both read the same exchanges
    digests = texts.groupBy(*KEY).agg(F.first(F.sha2("_edited", 256)).alias("edited_sha256"))
    known = materialize(digests.join(prints, KEY, "left").na.fill("", ["fingerprint", "edited_fingerprint"]), "prints")
    following = known.select(
        F.col("_id").alias("_next_id"), F.col("_hash").alias("_next_hash"), F.col("fingerprint").alias("_next")
    )
    out = known.join(order, KEY).join(following, ["_next_id", "_next_hash"]).select(
        *KEY,
        F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"),
        F.col("_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), coordinates).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next"), coordinates).alias("near_next"),
    )
    if not repeated.isEmpty():  # a row for each repeat: the rows are joined, so that many repeats can be split
        out = rows.select(*KEY).join(materialize(out, "documents"), KEY)
    return out.drop(*KEY)
