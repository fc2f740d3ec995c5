"""Secret scans with multipart credential linking, in DataFrame operations only.

Three kinds of strong candidates are always reported.  Weak candidates - bare identifiers, long
mixed strings and endpoints - are reported only where complementary parts of a credential start
within ``scope`` characters of them in the same text: an identifier needs a secret, a bare string
needs an identifier, an endpoint needs both.  The parts meet in an interval join on the text and a
``scope``-wide slot of the position.

Positions come from splitting a text by its matches: the running sum of the lengths of gaps and
matches.  Defined results: null text is empty; without matches the counts are 0 and both strings
stand for no span; every row is scanned on its own, repeated rows and null ids included; spans that tie
on their start come in the order of ``KINDS``; very long texts are scanned whole, and only the lengths of
gaps and matches leave the scan; extra columns are ignored by ``digest`` and kept by ``redact``, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergewell.workspace import materialize

SCOPE = 400


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    part: str  # identifier, secret or endpoint
    value: int = 0  # the group whose length counts
    least: int = 1
    weak: bool = False
    needs: tuple[str, ...] = ()  # patterns that a match must hold as well


#: In the order that breaks ties between spans of one start.
KINDS = (
    Kind(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "secret", 2, 12,
    ),
    Kind("access", r"AKIA[A-Z0-9]+", "identifier", 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", "secret"),  # runs are maximal, so shorter ones can be left out here
    Kind(
        "ident",
        r"""(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}|(?:[Uu]ser(?:name)?|[Cc]lient_?[Ii]d|[Ll]ogin)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
        "identifier", weak=True,
    ),
    Kind("blob", r"[A-Za-z0-9+/]{32,}={0,2}", "secret", weak=True, needs=("[A-Z]", "[a-z]", "[0-9]")),
    Kind("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9/._~-]*", "endpoint", weak=True),
)
ORDER = {kind.name: k for k, kind in enumerate(KINDS)}


def _found(text: Column, k: int, kind: Kind) -> Column:
    """The kind's matches in a text: lengths of the gaps before them, their lengths, whether they count."""
    pattern = F.lit(kind.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    values = matches if kind.value == 0 else F.regexp_extract_all(text, pattern, F.lit(kind.value))

    def counts(match: Column, value: Column) -> Column:
        good = F.char_length(value) >= kind.least
        for need in kind.needs:
            good = good & match.rlike(need)
        return F.struct(F.char_length(match).alias("length"), good.alias("good"))

    found = F.struct(
        F.lit(k).alias("kind"),
        F.transform(F.split(text, kind.pattern, -1), F.char_length).alias("gaps"),
        F.zip_with(matches, values, counts).alias("matches"),
    )
    return F.when(text.rlike(kind.pattern), found)


def candidates(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The numbered rows with ``columns``, and all candidates ``_row, kind, start, end`` that count."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.filter(F.array(*[_found(F.col("_text"), k, kind) for k, kind in enumerate(KINDS)]), lambda x: x.isNotNull())
    rows = materialize(
        docs.select(*columns, text.alias("_text"))
        .select(*columns, F.monotonically_increasing_id().alias("_row"), found.alias("_found")),
        "secrets",
    )
    one = rows.filter(F.size("_found") > 0).select("_row", F.explode("_found").alias("f"))
    each = one.select(
        "_row",
        F.col("f.kind").alias("kind"),
        F.posexplode(F.arrays_zip(F.slice("f.gaps", F.lit(1), F.size("f.matches")).alias("gap"), F.col("f.matches").alias("match"))),
    )
    running = Window.partitionBy("_row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("col.gap") + F.col("col.match.length")).over(running)
    spans = each.select("_row", "kind", "col.match.*", end.alias("end")).filter("good")
    return rows, spans.select("_row", "kind", (F.col("end") - F.col("length")).alias("start"), "end")


def _is(test) -> Column:
    return F.col("kind").isin([k for k, kind in enumerate(KINDS) if test(kind)])


def link(spans: DataFrame, scope: int) -> DataFrame:
    """The weak candidates of ``spans`` whose complementary parts are near."""
    part = F.when(_is(lambda k: k.part == "identifier"), "identifier").when(_is(lambda k: k.part == "secret"), "secret")
    parts = spans.select("_row", F.col("start").alias("_start"), part.alias("_part")).filter("_part is not null")
    parts = parts.withColumn("_slot", F.floor(F.col("_start") / scope))
    weak = spans.filter(_is(lambda k: k.weak))
    slot = F.floor(F.col("start") / scope)
    near = (
        weak.withColumn("_slot", F.explode(F.array(slot - 1, slot, slot + 1)))
        .join(parts, ["_row", "_slot"])
        .filter(F.abs(F.col("_start") - F.col("start")) <= scope)
        .groupBy("_row", "kind", "start", "end")
        .agg(F.max(F.col("_part") == "identifier").alias("_identifier"), F.max(F.col("_part") == "secret").alias("_secret"))
    )
    needed = (
        F.when(_is(lambda k: k.part == "identifier"), F.col("_secret"))
        .when(_is(lambda k: k.part == "secret"), F.col("_identifier"))
        .otherwise(F.col("_secret") & F.col("_identifier"))
    )
    return near.filter(needed).select("_row", "kind", "start", "end")


def scan(docs: DataFrame, columns: list[str], scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """Two parts of the rows, those without any candidate and the others: ``columns`` of every row of ``docs`` and ``spans``, an array of (start, kind, end) in order.

    ``kind`` is the position in ``KINDS``; starts count code points and ends are exclusive.  A text's
    spans come together in one array, which is never longer than the text.
    """
    rows, spans = candidates(docs, columns)
    kept = spans.filter(~_is(lambda k: k.weak)).unionByName(link(spans, scope))
    listed = kept.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    suspects = rows.filter(F.size("_found") > 0).select(*columns, "_row").join(listed, "_row", "left")
    return (
        rows.filter(F.size("_found") == 0).select(*columns, none.alias("spans")),
        suspects.withColumn("spans", F.coalesce("spans", none)).drop("_row"),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def digest(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs``."""
    plain, suspects = scan(docs, ["doc_id"], scope)
    scanned = plain.unionByName(suspects)
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[count(ORDER[name]).alias(f"n_{name}") for name in ("assign", "access", "hex")],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, scope: int = SCOPE, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span of ``text`` masked and ``n_chars``, if there, counted again."""
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("_doc")  # no column of theirs can clash
    plain, suspects = scan(docs.select(whole, "text"), ["_doc"], scope)
    return plain.select("_doc.*").unionByName(_masked(suspects, docs.columns, mask))


def _masked(scanned: DataFrame, columns: list[str], mask: str) -> DataFrame:
    start = F.struct(F.lit(0).cast("bigint").alias("to"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("gaps"))
    # spans may overlap: what stays lies between the furthest end so far and the next start
    walked = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["to"], s["end"]).alias("to"),
            F.when(
                s["start"] >= acc["to"],
                F.concat(acc["gaps"], F.array(F.struct(acc["to"].alias("from"), s["start"].alias("to")))),
            )
            .otherwise(acc["gaps"])
            .alias("gaps"),
        ),
    )
    text = F.col("_doc.text")
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    masked = F.concat(
        F.concat_ws("", F.transform("_walked.gaps", lambda g: F.concat(cut(g["from"], g["to"]), F.lit(mask)))),
        cut(F.col("_walked.to"), F.char_length(text).cast("bigint")),
    )
    found = F.size("spans") > 0
    out = scanned.withColumn("_walked", walked).withColumn("_masked", F.when(found, masked).otherwise(text))
    new = {"text": F.col("_masked")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(found, F.char_length("_masked").cast("bigint")).otherwise(F.col("_doc").getField("n_chars"))
    return out.select(*[new[c].alias(c) if c in new else F.col("_doc").getField(c).alias(c) for c in columns])


def oracle(scope: int = SCOPE) -> str:
    """The digest in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for k, kind in enumerate(KINDS):
        p = quoted(kind.pattern)
        needs = "".join(f" AND regexp_matches(m, '{n}')" for n in kind.needs)
        parts.append(
            f"SELECT row_id, {k} AS kind, unnest(g) AS gap, unnest(ms) AS m, unnest(vs) AS v, generate_subscripts(ms, 1) AS pos, "
            f"{kind.least} AS least FROM (SELECT row_id, regexp_extract_all(text, {p}, 0) AS ms, regexp_extract_all(text, {p}, {kind.value}) AS vs, "
            f"regexp_split_to_array(text, {p})[1:len(regexp_extract_all(text, {p}, 0))] AS g FROM docs)"
        )
        if needs:
            parts[-1] = f"SELECT row_id, kind, gap, m, CASE WHEN true{needs} THEN v ELSE '' END AS v, pos, least FROM ({parts[-1]})"
    case = lambda column: "CASE " + " ".join(f"WHEN {column} = {k} THEN '{kind.part}'" for k, kind in enumerate(KINDS)) + " END"
    name = "CASE " + " ".join(f"WHEN kind = {k} THEN '{kind.name}'" for k, kind in enumerate(KINDS)) + " END"
    weak = ", ".join(str(k) for k, kind in enumerate(KINDS) if kind.weak)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT row_id, kind, length(m) AS n, length(v) >= least AS good,
                  sum(length(gap) + length(m)) OVER (PARTITION BY row_id, kind ORDER BY pos) AS e FROM matched),
spans AS (SELECT row_id, kind, (e - n)::BIGINT AS s, e::BIGINT AS e, {case('kind')} AS part FROM placed WHERE good),
linked AS (SELECT w.row_id, w.kind, w.s, w.e FROM spans w JOIN spans p ON w.row_id = p.row_id AND abs(w.s - p.s) <= {scope}
           WHERE w.kind IN ({weak}) GROUP BY w.row_id, w.kind, w.s, w.e, w.part
           HAVING CASE w.part WHEN 'identifier' THEN bool_or(p.part = 'secret') WHEN 'secret' THEN bool_or(p.part = 'identifier')
                  ELSE bool_or(p.part = 'secret') AND bool_or(p.part = 'identifier') END),
kept AS (SELECT row_id, kind, s, e FROM spans WHERE kind NOT IN ({weak}) UNION ALL SELECT row_id, kind, s, e FROM linked),
listed AS (SELECT row_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                  string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
                  string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM kept GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (row_id)
"""
