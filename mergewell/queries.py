"""The registered queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.functions import text, vectors
from mergewell.operators import constraints, search, similarity, updates, validate
from mergewell.operators import links as link_ops
from mergewell.operators.embed import HashEmbedder, LetterEmbedder, NgramEmbedder, cache_rows, embed_distinct
from mergewell.plans import calibrate as cal
from mergewell.plans import profile as prof
from mergewell.plans import report
from mergewell.plans.ingest import Ingested, ingest, summary
from mergewell.plans.settle import ingest_refused, settle, writing
from mergewell.schemas import FIELDS, LINK, RAW
from mergewell.sources import driver_tables as tables
from mergewell.sources import payloads
from mergewell.sources.driver_tables import ENTRIES_SQL, PRODUCT_SQL
from mergewell.sources.snapshots import CatalogStore
from mergewell.sources.vector_store import VectorStore
from mergewell.streaming.firsts import start_firsts
from mergewell.streaming.incremental import IncrementalIngest
from mergewell.workspace import discard, fresh_path, materialize, only, passing, remove

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
THRESHOLD = 0.42  # what the test vectors' similarities allow
MATCH = 0.975


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


# --- SQL that several oracles share ---------------------------------------------------------------

_SPACES = text.SPACES.replace("\\t-\\r ", "\\t\\n\\v\\f\\r ")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _full(c: str) -> str:
    spaced = f"regexp_replace({c}, {_q(_SPACES)}, ' ', 'g')"
    return f"trim(regexp_replace(nfc_normalize(regexp_replace({spaced}, {_q(text.REMOVED)}, '', 'g')), ' +', ' ', 'g'))"


def _cap(c: str) -> str:
    return f"CASE WHEN length({c}) > 256 THEN rtrim(substr({c}, 1, 256)) ELSE {c} END"


def _flags(field: str, raw: str, full: str, clean: str) -> str:
    spaced = f"regexp_replace({raw}, {_q(_SPACES)}, ' ', 'g')"
    tests = (
        (f"regexp_matches({spaced}, {_q(text.REMOVED)})", text.CONTROLS),
        (f"length({full}) > 256", text.TRUNCATED),
        (f"regexp_matches({clean}, {_q(text.SQL_PATTERN)})", text.SQL_LIKE),
        (f"regexp_matches({clean}, {_q(text.MARKUP_PATTERN)})", text.MARKUP),
    )
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{field}: {r}' END" for t, r in tests) + "], lambda x: x IS NOT NULL)"


def _identity(name: str, brand: str, category: str) -> str:
    return (
        f"concat_ws(' | ', nullif({name}, ''), CASE WHEN coalesce({brand}, '') <> '' THEN 'brand: ' || {brand} END, "
        f"CASE WHEN coalesce({category}, '') <> '' THEN 'category: ' || {category} END)"
    )


def _key(c: str) -> str:
    return f"lower(regexp_replace(strip_accents({c}), '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"


_F = [(f, RAW[f]) for f in FIELDS]
RECORDS_SQL = f"""{ENTRIES_SQL},
cleaned AS (SELECT *, {', '.join(f"{_full(f"coalesce({r}, '')")} AS full_{f}" for f, r in _F)} FROM entries),
capped AS (SELECT *, {', '.join(f'{_cap(f"full_{f}")} AS c_{f}' for f, _ in _F)} FROM cleaned),
judged AS (SELECT *, CASE WHEN raw_id IS NULL THEN 'Id: null' WHEN c_Id = '' THEN 'Id: blank' WHEN NOT regexp_matches(c_Id, {_q(text.UUID_PATTERN)}) THEN 'Id: not a UUID'
    WHEN raw_seller IS NULL THEN 'SellerName: null' WHEN c_SellerName = '' THEN 'SellerName: blank' WHEN raw_name IS NULL THEN 'Name: null' WHEN c_Name = '' THEN 'Name: blank' END AS reason,
    list_concat({', '.join(_flags(f, f"coalesce({r}, '')", f'full_{f}', f'c_{f}') for f, r in _F)}) AS flags FROM capped),
records AS (SELECT record_index, c_SellerName AS seller_name, CASE WHEN regexp_matches(c_Id, {_q(text.UUID_PATTERN)}) THEN lower(c_Id) ELSE c_Id END AS seller_product_id,
    c_Name AS name, c_Brand AS brand, c_Category AS category, CASE WHEN reason IS NULL THEN {_identity('c_Name', 'c_Brand', 'c_Category')} END AS identity,
    reason, flags, true_product FROM judged)"""
FIRST_SQL = "firsts AS (SELECT seller_name, seller_product_id, min(record_index) AS first_index FROM records WHERE reason IS NULL GROUP BY ALL)"
SEED_SQL = f"""{FIRST_SQL},
links AS (SELECT f.first_index AS id, f.seller_name, r.true_product AS product_id, f.seller_product_id FROM firsts f JOIN records r ON r.record_index = f.first_index WHERE f.first_index % 10 = 0)"""
BASE = f"WITH {PRODUCT_SQL}, {RECORDS_SQL}, {SEED_SQL} "
RESULTS_SQL = f"""WITH {PRODUCT_SQL}, {RECORDS_SQL}, {FIRST_SQL},
named AS (SELECT id, {_identity('name', 'brand', 'category')} AS identity FROM product),
oldest AS (SELECT identity, min(id) AS id FROM named GROUP BY identity),
asked AS (SELECT r.record_index, r.identity, o.id FROM records r JOIN firsts f ON f.first_index = r.record_index LEFT JOIN oldest o ON o.identity = r.identity),
born AS (SELECT identity, min(record_index) AS born FROM asked WHERE id IS NULL GROUP BY identity),
numbered AS (SELECT identity, born, (SELECT max(id) FROM product) + row_number() OVER (ORDER BY born) AS id FROM born),
decided AS (SELECT a.record_index, coalesce(a.id, n.id) AS product_id, CASE WHEN n.born = a.record_index THEN 'inserted' ELSE 'linked' END AS outcome
            FROM asked a LEFT JOIN numbered n ON n.identity = a.identity AND a.id IS NULL),
results AS (SELECT r.*, CASE WHEN r.reason IS NOT NULL THEN 'rejected' WHEN d.record_index IS NOT NULL THEN d.outcome ELSE 'existing' END AS outcome,
                   coalesce(d.product_id, e.product_id)::BIGINT AS product_id
            FROM records r LEFT JOIN decided d ON d.record_index = r.record_index
            LEFT JOIN firsts f ON r.reason IS NULL AND f.seller_name = r.seller_name AND f.seller_product_id = r.seller_product_id
            LEFT JOIN decided e ON e.record_index = f.first_index)
"""


# --- tables --------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.records(tables.entries(spark, sf_dir), ("record_index", "true_product"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with what the catalog has for their product, joined while entries lie by product."""
    found = link_ops.resolve_products(tables.entries(spark, sf_dir), tables.products(spark, sf_dir), "true_product")
    return validate.records(found, ("record_index", "true_product", "product_name", "product_brand", "product_category"))


def _seed_links(records: DataFrame) -> DataFrame:
    firsts = link_ops.first_per_key(records).filter("first_index % 10 = 0").select(F.col("first_index").alias("record_index"))
    return records.join(firsts, "record_index").select(
        F.col("record_index").alias("id"), "seller_name", F.col("true_product").alias("product_id"), "seller_product_id"
    )


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = materialize(_records(spark, sf_dir), "records")
    return records, _seed_links(records)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = _vectors(spark, sf_dir)
    return v.filter("id % 5 = 0"), v.filter("id % 5 <> 0")


SIDES_SQL = "WITH v AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS vector FROM embeddings), q AS (SELECT * FROM v WHERE id % 5 = 0), c AS (SELECT * FROM v WHERE id % 5 <> 0) "


def _flag_text(c: str = "flags") -> F.Column:
    return F.array_join(F.transform(c, lambda f: F.concat_ws(": ", f["field"], f["reason"])), "; ")


# --- sources, projections, filters ----------------------------------------------------------------


@query(f"WITH {PRODUCT_SQL} SELECT * FROM product")
def list_products(spark, sf_dir):
    return tables.products(spark, sf_dir)


@query(BASE + "SELECT * FROM links")
def seller_links(spark, sf_dir):
    return _both(spark, sf_dir)[1]


@query(
    BASE + "SELECT record_index, seller_name, seller_product_id, name, brand, category, identity, reason, array_to_string(flags, '; ') AS flags FROM records"
)
def decoded_lines(spark, sf_dir):
    """Entries as JSON lines, decoded and cleaned again."""
    fields = F.struct(*[F.col(RAW[f]).alias(f) for f in FIELDS])
    lines = tables.entries(spark, sf_dir).select("record_index", F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))
    found = validate.records(payloads.parse_lines(lines, ("record_index",)))
    return found.withColumn("flags", _flag_text())


@query(f"WITH {ENTRIES_SQL} SELECT raw_seller AS seller, record_index // 1000 AS block, count(*) AS elements, 0::BIGINT AS errors FROM entries GROUP BY ALL")
def payload_elements(spark, sf_dir):
    """Array payloads of at most a thousand entries, written as files and decoded."""
    fields = F.to_json(F.struct(*[F.col(RAW[f]).alias(f) for f in FIELDS]), {"ignoreNullFields": "false"})
    each = tables.entries(spark, sf_dir).withColumn("block", F.floor(F.col("record_index") / 1000))
    body = F.concat(F.lit("["), F.array_join(F.collect_list(fields), ","), F.lit("]"))
    path = fresh_path(spark, "payloads")
    arrays = each.groupBy(F.col("raw_seller").alias("seller"), "block").agg(body.alias("value"))
    arrays.write.parquet(path)
    stored = spark.read.parquet(path).select(F.concat_ws("/", "seller", "block").alias("path"), F.encode("value", "utf-8").alias("content"))
    decoded = payloads.decode_files(stored)
    parts = F.split("payload_id", "/")
    return decoded.groupBy(parts[0].alias("seller"), parts[1].cast("long").alias("block")).agg(
        F.count("record_index").alias("elements"), F.count("payload_error").alias("errors")
    )


@query(
    f"WITH s AS (SELECT doc_id, text, {_full('text')} AS f FROM documents) SELECT doc_id, {_cap('f')} AS value, length(f) > 256 AS truncated, "
    f"regexp_matches(regexp_replace(text, {_q(_SPACES)}, ' ', 'g'), {_q(text.REMOVED)}) AS controls FROM s"
)
def sanitize_texts(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text", text.uncapped(F.col("text")).alias("f"))
    return docs.select("doc_id", text.capped(F.col("f")).alias("value"), (F.char_length("f") > text.MAX_POINTS).alias("truncated"), text.had_controls(F.col("text")).alias("controls"))


@query(
    f"WITH d AS (SELECT doc_id, 'Ca' || chr(770) || chr(8203) || '  ' || text AS t FROM documents), s AS (SELECT doc_id, t, {_full('t')} AS f FROM d), "
    f"c AS (SELECT doc_id, t, f, {_cap('f')} AS v FROM s) SELECT doc_id, v AS value, array_to_string({_flags('Name', 't', 'f', 'v')}, '; ') AS flags FROM c"
)
def sanitize_dirty_texts(spark, sf_dir):
    """Combining marks and a control character are put in, as the tables have none."""
    return _sanitized_dirty(tables.table(spark, sf_dir, "documents"))


QUERIES["sanitize_dirty_whole_texts"] = sanitize_dirty_texts  # its name while the other took prefixes
ORACLES["sanitize_dirty_whole_texts"] = ORACLES["sanitize_dirty_texts"]


def _sanitized_dirty(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", F.concat(F.lit("Ca\u0302\u200b  "), F.col("text")).alias("t"))
    docs = docs.withColumn("f", text.uncapped(F.col("t"))).withColumn("v", text.capped(F.col("f")))
    return docs.select("doc_id", F.col("v").alias("value"), text.flags("Name", F.col("t"), F.col("f"), F.col("v")).alias("flags")).withColumn("flags", _flag_text())


@query(f"SELECT page_id, regexp_matches(html, {_q(text.MARKUP_PATTERN)}) AS markup, regexp_matches(url, {_q(text.MARKUP_PATTERN)}) AS url_markup, regexp_matches(url, {_q(text.SQL_PATTERN)}) AS url_sql FROM pages")
def markup_flags(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select(
        "page_id", text.markup_like(F.col("html")).alias("markup"), text.markup_like(F.col("url")).alias("url_markup"), text.sql_like(F.col("url")).alias("url_sql")
    )


@query(BASE + "SELECT record_index, reason, array_to_string(flags, '; ') AS flags FROM records")
def field_flags_and_reasons(spark, sf_dir):
    return _records(spark, sf_dir).select("record_index", "reason", _flag_text().alias("flags"))


@query(BASE + "SELECT record_index, identity, 'clustering: ' || identity AS embedded FROM records WHERE reason IS NULL")
def identity_strings(spark, sf_dir):
    return validate.accepted(_records(spark, sf_dir)).select("record_index", "identity", text.prefixed(F.col("identity")).alias("embedded"))


@query(BASE + "SELECT record_index, seller_product_id, reason FROM records WHERE reason IS NOT NULL")
def rejected_records(spark, sf_dir):
    return validate.rejected(_records(spark, sf_dir)).select("record_index", "seller_product_id", "reason")


@query(BASE + "SELECT record_index, brand, reason FROM records WHERE len(flags) > 0")
def suspicious_records(spark, sf_dir):
    return validate.suspicious(_records(spark, sf_dir)).select("record_index", "brand", "reason")


@query(BASE + "SELECT reason, count(*) AS records FROM records WHERE reason IS NOT NULL GROUP BY reason")
def reason_counts(spark, sf_dir):
    return validate.reason_counts(_records(spark, sf_dir))


@query(BASE + "SELECT split_part(f, ': ', 1) AS field, split_part(f, ': ', 2) AS reason, count(*) AS records FROM (SELECT unnest(flags) AS f FROM records) GROUP BY ALL")
def flag_counts(spark, sf_dir):
    return validate.flag_counts(_records(spark, sf_dir))


@query(f"SELECT doc_id, {_key('text')} AS match_key FROM documents")
def match_keys(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.match_key(F.col("text")).alias("match_key"))


@query(
    f"SELECT doc_id, text AS exact, lower(trim(regexp_replace(text, ' +', ' ', 'g'))) AS collapsed, "
    f"lower(strip_accents(trim(regexp_replace(text, ' +', ' ', 'g')))) AS folded, {_key('text')} AS alphanumeric FROM documents"
)
def match_ladder(spark, sf_dir):
    return _ladder(tables.table(spark, sf_dir, "documents"))


QUERIES["match_ladder_whole_texts"] = match_ladder  # its name while the other took prefixes
ORACLES["match_ladder_whole_texts"] = ORACLES["match_ladder"]


def _ladder(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", *[form(F.col("text")).alias(level) for level, form in text.LADDER.items()])


@query(BASE + "SELECT r.record_index, lower(coalesce(p.brand, '')) = lower(upper(r.brand)) AS same_brand, nullif(r.brand, '') AS brand FROM records r JOIN product p ON p.id = r.true_product")
def folded_equality(spark, sf_dir):
    return _resolved(spark, sf_dir).select("record_index", text.same_folded(F.col("product_brand"), F.upper("brand")).alias("same_brand"), text.blank_to_null(F.col("brand")).alias("brand"))


@query(SIDES_SQL + ", n AS (SELECT id, vector, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS norm FROM v) SELECT id, round(norm, 4) AS norm, round(vector[1] / norm, 4) AS first, len(vector) AS dimension FROM n")
def unit_vectors(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id", F.round(vectors.norm(F.col("vector")), 4).alias("norm"), vectors.unit(F.col("vector")).alias("u"))
    return v.select("id", "norm", F.round(F.element_at("u", 1).cast("double"), 4).alias("first"), F.size("u").cast("long").alias("dimension"))


@query(SIDES_SQL + "SELECT a.id, round(list_cosine_similarity(a.vector, b.vector), 4) AS cosine FROM v a JOIN v b ON b.id = a.id + 1")
def cosine_pairs(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    other = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    return v.join(other, "id").select("id", F.round(vectors.cosine(F.col("vector"), F.col("other")), 4).alias("cosine"))


# --- joins ----------------------------------------------------------------------------------------

NEAREST_SQL = SIDES_SQL + ", s AS (SELECT q.id, c.id AS match_id, list_cosine_similarity(q.vector, c.vector) AS score FROM q, c), n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, match_id) = 1) "
OTHERS_SQL = SIDES_SQL + ", s AS (SELECT a.id, b.id AS match_id, list_cosine_similarity(a.vector, b.vector) AS score FROM v a JOIN v b ON a.id <> b.id), n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, match_id) = 1) "


@query(NEAREST_SQL + f"SELECT id, match_id, round(score, 4) AS score, CASE WHEN score >= {THRESHOLD} THEN 'duplicate' ELSE 'novel' END AS kind FROM n")
def nearest_product(spark, sf_dir):
    found = search.nearest(*_sides(spark, sf_dir))
    return found.select("id", "match_id", F.round(F.col("score").cast("double"), 4).alias("score"), vectors.kind(F.col("score"), THRESHOLD).alias("kind"))


@query(OTHERS_SQL + "SELECT id, match_id, round(score, 4) AS score FROM n")
def nearest_other(spark, sf_dir):
    found = search.leave_one_out(_vectors(spark, sf_dir))
    return found.select("id", "match_id", F.round(F.col("score").cast("double"), 4).alias("score"))


@query(OTHERS_SQL + "SELECT id, match_id, round(score, 4) AS score, true AS within FROM n")
def nearest_pruned(spark, sf_dir):
    """The nearest other vector by cells and bounds, and that no query met more than the whole table."""
    v = _vectors(spark, sf_dir)
    found = search.search(v, v, exclude_self=True, pivots=48, same=True).join(v.agg(F.count("*").alias("n")), F.lit(True))  # one row
    return found.select("id", "match_id", F.round(F.col("score").cast("double"), 4).alias("score"), (F.col("compared") <= F.col("n")).alias("within"))


@query(SIDES_SQL + f"SELECT q.id, c.id AS match_id, round(list_cosine_similarity(q.vector, c.vector), 4) AS score FROM q, c WHERE list_cosine_similarity(q.vector, c.vector) >= {THRESHOLD}")
def similar_pairs(spark, sf_dir):
    found = similarity.threshold_join(*_sides(spark, sf_dir), THRESHOLD)
    return found.select("id", "match_id", F.round(F.col("score").cast("double"), 4).alias("score"))


@query(SIDES_SQL + f"SELECT a.id AS i, b.id AS j, round(list_cosine_similarity(a.vector, b.vector), 4) AS score FROM v a JOIN v b ON b.id < a.id WHERE list_cosine_similarity(a.vector, b.vector) >= {THRESHOLD}")
def in_batch_edges(spark, sf_dir):
    found = similarity.in_batch_edges(_vectors(spark, sf_dir), THRESHOLD)
    return found.select("i", "j", F.round(F.col("score").cast("double"), 4).alias("score"))


@query(BASE + "SELECT r.record_index, l.product_id AS linked_product FROM records r JOIN links l USING (seller_name, seller_product_id) WHERE r.reason IS NULL")
def existing_links(spark, sf_dir):
    records, links = _both(spark, sf_dir)
    return link_ops.existing(validate.accepted(records), links).filter("linked_product is not null").select("record_index", "linked_product")


@query(BASE + "SELECT record_index FROM records r WHERE reason IS NULL AND NOT EXISTS (SELECT 1 FROM links l WHERE l.seller_name = r.seller_name AND l.seller_product_id = r.seller_product_id)")
def unlinked_records(spark, sf_dir):
    records, links = _both(spark, sf_dir)
    return link_ops.unlinked(validate.accepted(records), links).select("record_index")


@query(BASE + "SELECT * FROM firsts")
def first_per_key(spark, sf_dir):
    return link_ops.first_per_key(_records(spark, sf_dir))


@query(BASE + "SELECT r.record_index, f.first_index, x.true_product AS product_id FROM records r JOIN firsts f USING (seller_name, seller_product_id) JOIN records x ON x.record_index = f.first_index WHERE r.reason IS NULL AND r.record_index > f.first_index")
def repeats_follow_first(spark, sf_dir):
    records = materialize(_records(spark, sf_dir), "records")
    leads = records.select(F.col("record_index").alias("first_index"), F.col("true_product").alias("product_id"))
    return link_ops.with_first(records).filter("record_index > first_index").select("record_index", "first_index").join(leads, "first_index")


@query(BASE + f", k AS (SELECT {_key('name')} AS mk, max(id) AS id FROM product GROUP BY ALL) SELECT r.record_index, CASE WHEN r.record_index % 1000 = 0 THEN r.true_product ELSE k.id END AS product_id FROM records r JOIN k ON k.mk = {_key('r.name')} WHERE r.reason IS NULL")
def known_matches(spark, sf_dir):
    records = materialize(validate.accepted(_records(spark, sf_dir)).select("record_index", "name", "true_product"), "records")
    overrides = records.filter("record_index % 1000 = 0").select("record_index", F.col("true_product").alias("product_id"))
    return cal.known_matches(records, tables.products(spark, sf_dir), overrides)


def _funnel_sql() -> str:
    forms = {
        "exact": "{0}", "collapsed": "lower(trim(regexp_replace({0}, ' +', ' ', 'g')))", "folded": "lower(strip_accents(trim(regexp_replace({0}, ' +', ' ', 'g'))))",
        "alphanumeric": _key("{0}").replace("\\p{L}\\p{Nd}", "\\p{{L}}\\p{{Nd}}"),
    }
    parts = []
    for level, form in forms.items():
        f = lambda c: form.format(f"coalesce({c}, '')")  # noqa: B023, E731
        parts.append(
            f"SELECT '{level}' AS level, count(*) FILTER (EXISTS (SELECT 1 FROM product p WHERE {f('p.name')} = {f('e.raw_name')})) AS names, "
            f"count(*) FILTER (EXISTS (SELECT 1 FROM product p WHERE {f('p.name')} = {f('e.raw_name')} AND {f('p.brand')} = {f('e.raw_brand')} AND {f('p.category')} = {f('e.raw_category')})) AS products FROM entries e"
        )
    return f"WITH {PRODUCT_SQL}, {ENTRIES_SQL} " + " UNION ALL ".join(parts)


@query(_funnel_sql())
def match_funnel(spark, sf_dir):
    raw = tables.entries(spark, sf_dir, indexed=False).select(*[F.col(f"raw_{c}").alias(c) for c in ("name", "brand", "category")])
    return prof.match_funnel(raw, tables.products(spark, sf_dir))


@query(BASE + f"SELECT record_index, {_key('name')} AS match_key, brand, category FROM records r WHERE reason IS NULL AND EXISTS (SELECT 1 FROM product p WHERE {_key('p.name')} = {_key('r.name')}) AND NOT EXISTS (SELECT 1 FROM product p WHERE {_key('p.name')} = {_key('r.name')} AND coalesce(p.brand, '') = r.brand AND coalesce(p.category, '') = r.category)")
def attribute_drift(spark, sf_dir):
    return prof.drift(materialize(validate.accepted(_records(spark, sf_dir)).select("record_index", "name", "brand", "category"), "records"), tables.products(spark, sf_dir)).select("record_index", "match_key", "brand", "category")


@query(BASE + f"SELECT record_index, true_product, p.name AS product_name, p.brand AS product_brand, p.category AS product_category, {_identity('p.name', 'p.brand', 'p.category')} AS product_identity FROM records r JOIN product p ON p.id = r.true_product WHERE reason IS NULL")
def resolved_products(spark, sf_dir):
    found = validate.accepted(_resolved(spark, sf_dir))
    named = text.identity(F.col("product_name"), F.col("product_brand"), F.col("product_category"))
    return found.select("record_index", "true_product", "product_name", "product_brand", "product_category", named.alias("product_identity"))


# --- aggregates, profile --------------------------------------------------------------------------


@query(f"WITH {PRODUCT_SQL} SELECT DISTINCT lower(category) AS folded FROM product WHERE category IS NOT NULL")
def category_vocabulary(spark, sf_dir):
    return updates.vocabulary(tables.products(spark, sf_dir))


@query(BASE + "SELECT record_index, lower(category) IN (SELECT lower(category) FROM product WHERE category IS NOT NULL) AS in_vocabulary FROM records WHERE reason IS NULL")
def in_vocabulary(spark, sf_dir):
    records = validate.accepted(_records(spark, sf_dir))
    return updates.mark_vocabulary(records, updates.vocabulary(tables.products(spark, sf_dir))).select("record_index", "in_vocabulary")


def _profile_sql() -> str:
    part = (
        "SELECT '{f}' AS field, count(*) FILTER ({r} IS NULL) AS nulls, count(*) FILTER (regexp_full_match(regexp_replace({r}, {s}, ' ', 'g'), ' *')) AS blanks, "
        "count(*) FILTER (regexp_matches({r}, '^' || {s}) OR regexp_matches({r}, {s} || '$')) AS edge_spaces, max(length({r})) AS longest FROM entries"
    )
    return f"WITH {ENTRIES_SQL} " + " UNION ALL ".join(part.format(f=f, r=r, s=_q(_SPACES)) for f, r in _F)


@query(_profile_sql())
def column_profile(spark, sf_dir):
    return prof.column_profile(tables.entries(spark, sf_dir, indexed=False))


@query(f"WITH {PRODUCT_SQL} SELECT CASE WHEN brand IS NULL THEN 'null' ELSE 'text' END AS brand, CASE WHEN category IS NULL THEN 'null' ELSE 'text' END AS category, count(*) AS products FROM product GROUP BY 1, 2")
def null_combinations(spark, sf_dir):
    return prof.null_combinations(tables.products(spark, sf_dir))


@query(f"WITH {PRODUCT_SQL} SELECT count(*) AS products, count(DISTINCT name) AS names, count(DISTINCT {_key('name')}) AS loose_names, count(DISTINCT brand) AS brands, count(DISTINCT category) AS categories FROM product")
def distinct_counts(spark, sf_dir):
    return prof.distinct_counts(tables.products(spark, sf_dir))


@query(f"WITH {PRODUCT_SQL} SELECT category, count(*) AS n FROM product GROUP BY category")
def category_sizes(spark, sf_dir):
    return prof.sizes(tables.products(spark, sf_dir), "category")


@query(f"WITH {ENTRIES_SQL} SELECT raw_seller, count(*) AS n FROM entries GROUP BY raw_seller")
def seller_sizes(spark, sf_dir):
    return prof.sizes(tables.entries(spark, sf_dir, indexed=False), "raw_seller")


@query(f"WITH {PRODUCT_SQL} SELECT category, count(*) AS n FROM product GROUP BY category ORDER BY n DESC, category NULLS FIRST LIMIT 3")
def largest_categories(spark, sf_dir):
    return prof.largest(tables.products(spark, sf_dir), "category", 3)


@query(BASE + "SELECT seller_product_id, count(*) AS entries, count(DISTINCT seller_name) AS sellers, CASE WHEN count(DISTINCT seller_name) > 1 THEN 'other seller' ELSE 'same seller' END AS kind FROM records GROUP BY seller_product_id HAVING count(*) > 1")
def reused_ids(spark, sf_dir):
    return prof.reused_ids(_records(spark, sf_dir))


@query(BASE + f"SELECT {_key('name')} AS match_key, count(*) AS entries FROM records GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return prof.duplicate_names(_records(spark, sf_dir))


@query(BASE + f"SELECT seller_name, {_key('name')} AS match_key, count(DISTINCT seller_product_id) AS ids FROM records GROUP BY 1, 2 HAVING count(DISTINCT seller_product_id) > 1")
def same_seller_product(spark, sf_dir):
    return prof.same_seller_product(materialize(_records(spark, sf_dir).select("seller_name", "name", "seller_product_id"), "records"))


@query(BASE + "SELECT category, count(*) AS n FROM records WHERE category <> '' AND category NOT IN (SELECT category FROM product WHERE category IS NOT NULL) GROUP BY category")
def foreign_categories(spark, sf_dir):
    return prof.foreign_categories(_records(spark, sf_dir), tables.products(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT count(*) FILTER (regexp_matches(raw_name, '[^\\x{{00}}-\\x{{7F}}]')) AS non_ascii, count(*) FILTER (contains(raw_name, '  ')) AS doubled_spaces, count(*) FILTER (regexp_matches(regexp_replace(raw_name, {_q(_SPACES)}, ' ', 'g'), {_q(text.REMOVED)})) AS controls FROM entries")
def string_oddities(spark, sf_dir):
    return prof.string_oddities(tables.entries(spark, sf_dir, indexed=False), "raw_name")


@query()
def full_profile(spark, sf_dir):
    entries = materialize(tables.entries(spark, sf_dir), "entries")
    # every measure reads the records, which are cleaned once
    return prof.profile(entries, materialize(validate.records(entries), "records"), tables.products(spark, sf_dir))


# --- calibration ----------------------------------------------------------------------------------

_SCORES_SQL = OTHERS_SQL + ", p AS (SELECT a.id AS record_index, list_cosine_similarity(a.vector, b.vector)::FLOAT AS score FROM v a JOIN v b ON b.id = a.id + 1), m AS (SELECT id, match_id, score::FLOAT AS score FROM n) "


def _positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of neighbours by id as the known matches."""
    v = _vectors(spark, sf_dir)
    other = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    return v.join(other, "id").select(F.col("id").alias("record_index"), vectors.cosine(F.col("vector"), F.col("other")).cast("float").alias("score"))


def _scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The known matches, and scores of nearest others as the different products."""
    return materialize(_positives(spark, sf_dir), "positives"), materialize(search.leave_one_out(_vectors(spark, sf_dir)), "negatives")


def _quantile_sql(side: str, rows: str, spots: dict[str, float]) -> str:
    at = ", ".join(f"round(max(score) FILTER (k = least(n - 1, floor({p} * n))), 4) AS {name}" for name, p in spots.items())
    return f"SELECT '{side}' AS side, max(n) AS n, {at} FROM (SELECT score::DOUBLE AS score, row_number() OVER (ORDER BY score) - 1 AS k, count(*) OVER () AS n FROM {rows})"


@query(_SCORES_SQL + _quantile_sql("positives", "p", {"extreme": 0.0, "tail1": 0.01, "tail5": 0.05, "median": 0.5}) + " UNION ALL " + _quantile_sql("negatives", "m", {"extreme": 1.0, "tail1": 0.99, "tail5": 0.95, "median": 0.5}))
def calibration_quantiles(spark, sf_dir):
    found = cal.distribution(*_scores(spark, sf_dir))
    return found.select("side", "n", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("extreme", "tail1", "tail5", "median")])


SWEEP = (0.1, 0.2, 0.3, 0.35, 0.4, 0.45)


@query(_SCORES_SQL + f"SELECT round(t, 4) AS threshold, (SELECT count(*) FROM p WHERE score < t::FLOAT) AS missed, (SELECT count(*) FROM m WHERE score >= t::FLOAT) AS wrong FROM (SELECT unnest({list(SWEEP)})::DOUBLE AS t)")
def threshold_sweep(spark, sf_dir):
    found = cal.sweep(*_scores(spark, sf_dir), SWEEP)
    return found.select(F.round(F.col("threshold").cast("double"), 4).alias("threshold"), "missed", "wrong")


@query(_SCORES_SQL + "SELECT (SELECT max(score) < 0.42::FLOAT FROM m) AS safe, (SELECT array_to_string(list(record_index ORDER BY record_index), ',') FROM (SELECT record_index FROM p WHERE score < -0.3::FLOAT)) AS missed")
def threshold_check(spark, sf_dir):
    pos, neg = _scores(spark, sf_dir)
    safe = cal.shipped(pos, neg, THRESHOLD).select("safe")
    return safe.join(F.broadcast(cal.shipped(pos, neg, -0.3).select(F.array_join("missed", ",").alias("missed"))))


@query(_SCORES_SQL + f"SELECT record_index FROM p WHERE score < {THRESHOLD}::FLOAT")
def threshold_missed(spark, sf_dir):
    """All known matches that the checked threshold misses, a row each."""
    return cal.missed(_positives(spark, sf_dir), THRESHOLD).select("record_index")


@query(_SCORES_SQL + "(SELECT 'lowest' AS side, round(score::DOUBLE, 4) AS score, record_index AS id FROM p ORDER BY score, record_index LIMIT 5) UNION ALL (SELECT 'highest', round(score::DOUBLE, 4), id FROM m ORDER BY score DESC, id DESC LIMIT 10)")
def hardest_pairs(spark, sf_dir):
    pos, neg = _scores(spark, sf_dir)
    row = lambda df, side: df.select(F.lit(side).alias("side"), F.round(F.col("score").cast("double"), 4).alias("score"), F.col("description").alias("id"))
    low = cal.hardest(pos.select("score", F.col("record_index").alias("description")), True, 5)
    return row(low, "lowest").unionByName(row(cal.hardest(neg.select("score", F.col("id").alias("description")), False, 10), "highest"))


@query()
def calibrate(spark, sf_dir):
    records = only(lambda: _records(spark, sf_dir), "records")
    return cal.distribution(*cal.measure(records, tables.products(spark, sf_dir), NgramEmbedder(), True))


# --- updates, ids, constraints --------------------------------------------------------------------

MATCHED_SQL = BASE + """, u AS (SELECT r.record_index, r.true_product AS pid, r.brand, r.category, r.flags, p.brand AS b0, p.category AS c0,
    lower(r.category) IN (SELECT lower(category) FROM product WHERE category IS NOT NULL) AS known FROM records r JOIN product p ON p.id = r.true_product WHERE r.reason IS NULL) """


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _resolved(spark, sf_dir).withColumnsRenamed({"true_product": "pid", "product_brand": "base_brand", "product_category": "base_category"})
    return updates.mark_vocabulary(validate.accepted(found), updates.vocabulary(tables.products(spark, sf_dir)))


_FILL_SQL = MATCHED_SQL + """SELECT pid, min(record_index) FILTER (b) AS brand_at, arg_min(brand, record_index) FILTER (b) AS brand_new, min(record_index) FILTER (c) AS category_at, arg_min(category, record_index) FILTER (c) AS category_new
    FROM (SELECT *, b0 IS NULL AND brand <> '' AND len(flags) = 0 AS b, c0 IS NULL AND category <> '' AND len(flags) = 0 AS c FROM u) GROUP BY pid HAVING brand_at IS NOT NULL OR category_at IS NOT NULL"""


@query(_FILL_SQL)
def update_fill(spark, sf_dir):
    return updates.changes_of(_matched(spark, sf_dir), "fill")


@query(MATCHED_SQL + """, o AS (SELECT *, len(flags) = 0 AND brand <> '' AND lower(brand) <> lower(coalesce(b0, '')) AS b, len(flags) = 0 AND category <> '' AND lower(category) <> lower(coalesce(c0, '')) AND (c0 IS NULL OR known) AS c FROM u),
    f AS (SELECT pid, min(record_index) AS at FROM o WHERE b OR c GROUP BY pid),
    l AS (SELECT f.pid, f.at, CASE WHEN o.b THEN o.brand END AS lb, CASE WHEN o.c THEN o.category END AS lc FROM f JOIN o ON o.pid = f.pid AND o.record_index = f.at),
    x AS (SELECT l.pid, min(u.record_index) FILTER (u.brand <> '' AND b0 IS NULL AND lb IS NULL) AS ab, arg_min(u.brand, u.record_index) FILTER (u.brand <> '' AND b0 IS NULL AND lb IS NULL) AS nb,
                 min(u.record_index) FILTER (u.category <> '' AND c0 IS NULL AND lc IS NULL) AS ac, arg_min(u.category, u.record_index) FILTER (u.category <> '' AND c0 IS NULL AND lc IS NULL) AS nc
          FROM l JOIN u ON u.pid = l.pid AND u.record_index > l.at AND len(u.flags) = 0 GROUP BY l.pid)
    SELECT l.pid, CASE WHEN lb IS NOT NULL THEN l.at ELSE ab END AS brand_at, coalesce(lb, nb) AS brand_new, CASE WHEN lc IS NOT NULL THEN l.at ELSE ac END AS category_at, coalesce(lc, nc) AS category_new
    FROM l LEFT JOIN x ON x.pid = l.pid""")
def update_overwrite(spark, sf_dir):
    return updates.changes_of(_matched(spark, sf_dir), "overwrite")


def _ruled(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows = _matched(spark, sf_dir).withColumnsRenamed({"base_brand": "current_brand", "base_category": "current_category"})
    out = updates.plan_update(rows.withColumn("updated_by", F.lit(None).cast("long")), mode)
    shown = F.array_join(F.transform("changes", lambda c: F.concat_ws(">", c["field"], c["old"], c["new"])), "; ")
    return out.select("record_index", F.array_join("notes", "; ").alias("notes"), shown.alias("changes"))


def _rule_sql(mode: str) -> str:
    def field(name: str, cur: str, new: str) -> tuple[str, str]:
        cases = [f"WHEN {new} = '' OR lower({new}) = lower(coalesce({cur}, '')) THEN NULL", f"WHEN len(flags) > 0 THEN '{name}: flagged input, not applied'"]
        if mode == "none":
            cases.append(f"WHEN {cur} IS NULL THEN '{name} missing in catalog: ' || {new} || ' (entry), kept'")
        if mode != "overwrite":
            cases.append(f"WHEN {cur} IS NOT NULL THEN '{name} differs: ' || {new} || ' (entry) vs ' || {cur} || ' (catalog), kept'")
        elif name == "category":
            cases.append(f"WHEN {cur} IS NOT NULL AND NOT known THEN 'category: ' || {new} || ' is not a catalog category, kept ' || {cur}")
        note = "CASE " + " ".join(cases) + " END"
        return note, f"CASE WHEN {new} <> '' AND lower({new}) <> lower(coalesce({cur}, '')) AND {note} IS NULL THEN '{name}>' || coalesce({cur}, '') || '>' || {new} END"

    b, c = field("brand", "b0", "brand"), field("category", "c0", "category")
    return MATCHED_SQL + f"SELECT record_index, concat_ws('; ', {b[0]}, {c[0]}) AS notes, concat_ws('; ', {b[1]}, {c[1]}) AS changes FROM u"


@query(_rule_sql("fill"))
def rule_fill(spark, sf_dir):
    return _ruled(spark, sf_dir, "fill")


@query(_rule_sql("none"))
def rule_none(spark, sf_dir):
    return _ruled(spark, sf_dir, "none")


@query(_rule_sql("overwrite"))
def rule_overwrite(spark, sf_dir):
    return _ruled(spark, sf_dir, "overwrite")


@query(_FILL_SQL.replace("SELECT pid, min(record_index)", ", f AS (SELECT pid, min(record_index)", 1) + ") SELECT p.id, p.name, coalesce(f.brand_new, p.brand) AS brand, coalesce(f.category_new, p.category) AS category FROM product p LEFT JOIN f ON f.pid = p.id")
def updated_products(spark, sf_dir):
    changed = updates.changes_of(_matched(spark, sf_dir), "fill")
    changed = changed.select(F.col("pid").alias("id"), F.col("brand_new").alias("brand"), F.col("category_new").alias("category"))
    return updates.apply_updates(tables.products(spark, sf_dir), changed)


@query(BASE + "SELECT record_index, (SELECT max(id) FROM product) + row_number() OVER (ORDER BY record_index) AS product_id, -row_number() OVER (ORDER BY record_index) AS dry_id FROM records WHERE len(flags) > 0 AND reason IS NULL")
def new_product_ids(spark, sf_dir):
    rows = materialize(validate.suspicious(validate.accepted(_records(spark, sf_dir))).select("record_index"), "new")
    high = tables.products(spark, sf_dir).agg(F.max("id")).first()[0]
    dry = link_ops.new_product_ids(rows, high, dry_run=True).withColumnRenamed("product_id", "dry_id")
    return link_ops.new_product_ids(rows, high).join(dry, "record_index")


@query(BASE + ", broken AS (SELECT id, seller_name, CASE WHEN id % 70 = 0 THEN -product_id ELSE product_id END AS product_id, CASE WHEN id % 110 = 0 THEN repeat('x', 65) ELSE seller_product_id END AS seller_product_id FROM links) SELECT 'orphan' AS problem, id FROM broken b WHERE NOT EXISTS (SELECT 1 FROM product p WHERE p.id = b.product_id) UNION ALL SELECT 'bad value', id FROM broken WHERE length(seller_product_id) NOT BETWEEN 1 AND 64 UNION ALL SELECT 'repeated key', count(*) FROM broken GROUP BY seller_name, seller_product_id HAVING count(*) > 1")
def constraint_violations(spark, sf_dir):
    links = _both(spark, sf_dir)[1]
    broken = links.withColumn("product_id", F.when(F.col("id") % 70 == 0, -F.col("product_id")).otherwise(F.col("product_id")))
    broken = materialize(broken.withColumn("seller_product_id", F.when(F.col("id") % 110 == 0, "x" * 65).otherwise(F.col("seller_product_id"))), "broken")
    row = lambda df, problem, column: df.select(F.lit(problem).alias("problem"), F.col(column).alias("id"))
    return (
        row(constraints.orphans(broken, tables.products(spark, sf_dir)), "orphan", "id")
        .unionByName(row(constraints.bad_values(broken), "bad value", "id"))
        .unionByName(row(constraints.repeated_keys(broken), "repeated key", "links"))
    )


@query(f"WITH {PRODUCT_SQL} SELECT o_orderkey + 1 AS id FROM orders WHERE o_orderkey + 1 NOT IN (SELECT id FROM product)")
def missing_products(spark, sf_dir):
    wanted = tables.table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("id"))
    return updates.missing_products(wanted, tables.products(spark, sf_dir))


@query("SELECT vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN 'dimension' WHEN vec_id % 11 = 0 THEN 'not finite' WHEN vec_id % 13 = 0 THEN 'zero' END AS problem FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0")
def vector_problems(spark, sf_dir):
    v, i = _vectors(spark, sf_dir), F.col("id")
    spoiled = (
        F.when(i % 7 == 0, F.slice("vector", 1, 3))
        .when(i % 11 == 0, F.transform("vector", lambda x: F.lit(float("nan")).cast("float")))
        .when(i % 13 == 0, F.transform("vector", lambda x: F.lit(0.0).cast("float")))
        .otherwise(F.col("vector"))
    )
    return similarity.quarantine(v.withColumn("vector", spoiled), v.select(F.size("vector")).first()[0])[1]


@query("SELECT o_orderkey AS id, 'seller' || (o_custkey % 20) AS seller_name, o_custkey AS product_id, o_orderkey::VARCHAR AS seller_product_id FROM orders")
def migrated_links(spark, sf_dir):
    legacy = tables.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("seller"), (F.col("o_custkey") % 20).cast("string")).alias("seller_name"),
        F.col("o_custkey").alias("product_id"), F.col("o_orderkey").alias("seller_product_id"),
    )
    return constraints.text_links(legacy)


@query("SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY user_id, event_type")
def first_events(spark, sf_dir):
    """The stream is started anew for each of three lots."""
    events = tables.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    path, firsts, progress = (fresh_path(spark, name) for name in ("arriving", "firsts", "progress"))
    third = events.agg(F.max("event_id")).first()[0] // 3 + 1
    for lot in range(3):
        events.filter(F.floor(F.col("event_id") / third) == lot).write.mode("append").parquet(path)
        start_firsts(spark.readStream.schema(events.schema).parquet(path), ["user_id", "event_type"], ["event_id"], firsts, progress).awaitTermination()
    return spark.read.schema(events.schema).parquet(firsts).withColumnRenamed("event_id", "first_event")


# --- embedding ------------------------------------------------------------------------------------

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query(
    f"WITH {PRODUCT_SQL}, t AS (SELECT DISTINCT {_identity('name', 'brand', 'category')} AS text FROM product) SELECT text, "
    + ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{c}', '')))::DOUBLE AS n_{c}" for c in _LETTERS[:8])
    + ", length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE AS digits FROM t"
)
def letter_vectors(spark, sf_dir):
    """Distinct identities, embedded with half of them in the cache."""
    named = tables.products(spark, sf_dir).select(text.identity(F.col("name"), F.col("brand"), F.col("category")).alias("text"))
    model = LetterEmbedder()
    cache = materialize(cache_rows(embed_distinct(named.filter(F.xxhash64("text") % 2 == 0), model), model), "cache")
    v = embed_distinct(named, model, cache)
    counts = [F.element_at("vector", k + 1).cast("double").alias(f"n_{c}") for k, c in enumerate(_LETTERS[:8])]
    return v.select("text", *counts, F.element_at("vector", 27).cast("double").alias("digits"))


@query(
    f"WITH {PRODUCT_SQL}, t AS (SELECT DISTINCT {_identity('name', 'brand', 'category')} AS text FROM product) SELECT text, "
    + ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{c}', '')))::DOUBLE AS n_{c}" for c in _LETTERS)
    + ", length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE AS digits, 1::DOUBLE AS one FROM t"
)
def letter_whole_vectors(spark, sf_dir):
    """``letter_vectors`` with all coordinates."""
    named = tables.products(spark, sf_dir).select(text.identity(F.col("name"), F.col("brand"), F.col("category")).alias("text"))
    v = embed_distinct(named, LetterEmbedder())
    names = [*[f"n_{c}" for c in _LETTERS], "digits", "one"]
    return v.select("text", *[F.element_at("vector", k + 1).cast("double").alias(n) for k, n in enumerate(names)])


# --- whole runs -----------------------------------------------------------------------------------


def _ingested(spark: SparkSession, sf_dir: str, mode: str, embedder=None, threshold: float = MATCH, dry_run: bool = False) -> Ingested:
    records = only(lambda: _records(spark, sf_dir).drop("true_product"), "records")
    links = spark.createDataFrame([], "id long, seller_name string, product_id long, seller_product_id string")
    done = ingest(records, tables.products(spark, sf_dir), links, embedder or HashEmbedder(), threshold, mode, dry_run)
    discard(records)
    return done


@query(RESULTS_SQL + "SELECT count(*) AS records, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'linked') AS linked, count(*) FILTER (outcome = 'existing') AS existing, count(*) FILTER (outcome = 'rejected') AS rejected, 0::BIGINT AS failed, count(*) FILTER (len(flags) > 0) AS suspicious, 0::BIGINT AS updated FROM results")
def ingest_summary(spark, sf_dir):
    return summary(_ingested(spark, sf_dir, "none").results)


@query(RESULTS_SQL + "SELECT record_index, outcome, product_id, reason FROM results")
def ingest_results(spark, sf_dir):
    return _ingested(spark, sf_dir, "none").results.select("record_index", "outcome", "product_id", "reason")


@query(RESULTS_SQL + "SELECT record_index, outcome, CASE WHEN product_id > (SELECT max(id) FROM product) THEN (SELECT max(id) FROM product) - product_id ELSE product_id END AS product_id FROM results")
def ingest_dry_run(spark, sf_dir):
    return _ingested(spark, sf_dir, "none", dry_run=True).results.select("record_index", "outcome", "product_id")


@query(RESULTS_SQL + "SELECT * FROM product UNION ALL SELECT product_id, name, nullif(brand, ''), nullif(category, '') FROM results WHERE outcome = 'inserted'")
def ingest_products(spark, sf_dir):
    return _ingested(spark, sf_dir, "none").products


@query(RESULTS_SQL + "SELECT row_number() OVER (ORDER BY record_index) AS id, seller_name, product_id, seller_product_id FROM results WHERE outcome IN ('inserted', 'linked')")
def ingest_links(spark, sf_dir):
    return _ingested(spark, sf_dir, "none").links


@query(RESULTS_SQL + """, adding AS (SELECT * FROM results WHERE outcome IN ('inserted', 'linked')),
    taken AS (SELECT seller_name, seller_product_id, true AS is_taken FROM adding WHERE record_index % 10 = 1),
    alive AS (SELECT id AS product_id, true AS is_there FROM product WHERE id % 7 <> 0
        UNION ALL SELECT product_id, true FROM adding LEFT JOIN taken USING (seller_name, seller_product_id) WHERE outcome = 'inserted' AND is_taken IS NULL),
    fates AS (SELECT r.*, CASE WHEN outcome = 'rejected' THEN NULL WHEN is_taken THEN 'conflict' WHEN is_there IS NULL THEN 'not found' END AS err_kind
        FROM results r LEFT JOIN taken USING (seller_name, seller_product_id) LEFT JOIN alive USING (product_id))
    SELECT record_index, CASE WHEN err_kind IS NOT NULL THEN 'failed' ELSE outcome END AS outcome, err_kind,
        CASE WHEN err_kind IS NULL THEN product_id + CASE WHEN product_id > (SELECT max(id) FROM product) THEN 5 ELSE 0 END END AS product_id FROM fates""")
def settled_results(spark, sf_dir):
    """Another writer has linked every tenth key and deleted every seventh product since the batch was decided."""
    done, products = _ingested(spark, sf_dir, "none"), tables.products(spark, sf_dir)
    taken = done.results.filter("outcome in ('inserted', 'linked') and record_index % 10 = 1")
    links = taken.select(F.col("record_index").alias("id"), "seller_name", F.lit(1).cast("long").alias("product_id"), "seller_product_id")
    top, last = products.agg(F.max("id")).first()[0], links.agg(F.max("id")).first()[0] or 0
    got = settle(done, (top, 0), products.filter("id % 7 <> 0"), links, (top + 5, last))
    return got.results.select("record_index", "outcome", "err_kind", "product_id")


@query(RESULTS_SQL + """, lines AS (SELECT 'rejected' AS section, record_index, '#' || record_index || ' ' || seller_name || ' ' || seller_product_id || ': ' || reason AS line FROM results WHERE outcome = 'rejected'
    UNION ALL SELECT 'suspicious', record_index, '#' || record_index || ' ' || seller_name || ' ' || seller_product_id || ': ' || array_to_string(flags, '; ') FROM results WHERE len(flags) > 0) SELECT * FROM lines""")
def report_lines(spark, sf_dir):
    lines = report.report_lines(_ingested(spark, sf_dir, "none").results)
    return lines.filter("section in ('rejected', 'suspicious')").select("section", "record_index", "line")


@query()
def report_all_lines(spark, sf_dir):
    """The lines of all sections, of a run that changes products."""
    return report.report_lines(_ingested(spark, sf_dir, "fill").results)


@query()
def decision_lines(spark, sf_dir):
    return report.decision_lines(_ingested(spark, sf_dir, "overwrite").results)


@query()
def ingest_fill(spark, sf_dir):
    return _ingested(spark, sf_dir, "fill").results


@query()
def ingest_overwrite(spark, sf_dir):
    return _ingested(spark, sf_dir, "overwrite").results


@query()
def ingest_similar(spark, sf_dir):
    """With vectors that are close for close names."""
    return _ingested(spark, sf_dir, "fill", NgramEmbedder(64), 0.97).results


@query(RESULTS_SQL + "SELECT count(*) FILTER (outcome IN ('inserted', 'linked')) * 0 AS inserted_or_linked, count(*) FILTER (outcome <> 'rejected') AS existing, count(*) FILTER (outcome = 'rejected') AS rejected FROM results")
def rerun_changes_nothing(spark, sf_dir):
    with passing() as keep:
        first = _ingested(spark, sf_dir, "none")
        links, products = keep(materialize(first.links, "links")), keep(materialize(first.products, "products"))
    records = only(lambda: _records(spark, sf_dir).drop("true_product"), "records")
    again = ingest(records, products, links, HashEmbedder(), MATCH, "none")
    discard(records)
    s = summary(again.results)
    return s.select((F.col("inserted") + F.col("linked")).alias("inserted_or_linked"), "existing", "rejected")


def _json_sql() -> str:
    fields = (("id", "seller_product_id"), ("sellerName", "seller_name"), ("name", "name"), ("brand", "brand"), ("category", "category"), ("identity", "identity"), ("reason", "reason"))
    parts = ["'\"index\":' || record_index"]
    parts += [f"CASE WHEN {c} <> '' THEN '\"{key}\":' || to_json({c})::VARCHAR END" for key, c in fields]
    flag = "'{\"field\":\"' || split_part(f, ': ', 1) || '\",\"reason\":\"' || split_part(f, ': ', 2) || '\"}'"
    parts.append(f"CASE WHEN len(flags) > 0 THEN '\"flags\":[' || array_to_string(list_transform(flags, lambda f: {flag}), ',') || ']' END")
    return BASE + f"SELECT record_index, '{{' || concat_ws(',', {', '.join(parts)}) || '}}' AS line FROM records"


@query(_json_sql())
def json_records(spark, sf_dir):
    """Records as whole JSON lines."""
    return report.json_records(_records(spark, sf_dir))


QUERIES["json_lines"], ORACLES["json_lines"] = json_records, ORACLES["json_records"]  # its name while the other kept the first field


# --- files, store, stream --------------------------------------------------------------------------


def _payload_files(entries: DataFrame, path: str, bad: bool) -> None:
    """Array files of at most a thousand entries; with ``bad`` some lack the closing bracket and some are objects."""
    fields = F.to_json(F.struct(*[F.col(RAW[f]).alias(f) for f in FIELDS]), {"ignoreNullFields": "false"})
    block = F.floor(F.col("record_index") / 1000)
    each = entries.select(F.lpad(block.cast("string"), 9, "0").alias("block"), F.struct("record_index", fields.alias("value")).alias("e"))
    own = each.groupBy("block").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["value"]).alias("values"))
    number, body = F.col("block").cast("long"), F.array_join("values", ",\n")
    value = F.concat(F.lit("["), body, F.lit("]"))
    if bad:
        value = F.when(number % 7 == 3, F.concat(F.lit("["), body)).when(number % 7 == 5, F.concat(F.lit('{"a": ['), body, F.lit("]}"))).otherwise(value)
    own.select("block", value.alias("value")).write.mode("append").partitionBy("block").text(path)


@query(f"""WITH {ENTRIES_SQL}, placed AS (SELECT *, record_index // 1000 AS block, record_index % 1000 AS place FROM entries)
SELECT block, place, raw_id, raw_seller, raw_name, raw_brand, raw_category, NULL AS error FROM placed WHERE block % 7 <> 5
UNION ALL SELECT DISTINCT block, NULL::BIGINT, NULL, NULL, NULL, NULL, NULL, CASE block % 7 WHEN 3 THEN 'reading the closing bracket' ELSE 'top level is not an array' END FROM placed WHERE block % 7 IN (3, 5)""")
def payload_files(spark, sf_dir):
    """Entries as JSON files, bad ones among them, read back."""
    path = fresh_path(spark, "payloads")
    _payload_files(tables.entries(spark, sf_dir), path, True)
    found = payloads.read_payloads(spark, path)
    block = F.regexp_extract("payload_id", "block=([0-9]+)/", 1).cast("long")
    return found.select(block.alias("block"), F.col("record_index").alias("place"), *[RAW[f] for f in FIELDS], F.col("payload_error").alias("error"))


@query(f"WITH {ENTRIES_SQL} SELECT record_index, raw_id, raw_seller, raw_name, raw_brand, raw_category FROM entries")
def stored_lines(spark, sf_dir):
    """Entries as files of JSON lines; their places come from the files alone."""
    path = fresh_path(spark, "lines")
    fields = F.to_json(F.struct(*[F.col(RAW[f]).alias(f) for f in FIELDS]), {"ignoreNullFields": "false"})
    block = F.lpad(F.floor(F.col("record_index") / 1000).cast("string"), 9, "0")
    each = tables.entries(spark, sf_dir).groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("record_index", fields.alias("value")))).alias("rows"))
    each.select("block", F.array_join(F.transform("rows", lambda r: r["value"]), "\n").alias("value")).write.partitionBy("block").text(path)
    return payloads.read_lines(spark, path).select("record_index", *[RAW[f] for f in FIELDS])


@query(ORACLES["migrated_links"])
def migrated_store(spark, sf_dir):
    """A stored catalog with numeric seller ids, migrated and read back."""
    orders = tables.table(spark, sf_dir, "orders")
    legacy = orders.select(
        F.col("o_orderkey").cast("long").alias("id"), F.concat(F.lit("seller"), (F.col("o_custkey") % 20).cast("string")).alias("seller_name"),
        F.col("o_custkey").cast("long").alias("product_id"), F.col("o_orderkey").cast("long").alias("seller_product_id"),
    )
    none = F.lit(None).cast("string")
    sold = orders.select(F.col("o_custkey").cast("long").alias("id")).distinct().select("id", F.lit("sold").alias("name"), none.alias("brand"), none.alias("category"))
    store = CatalogStore(spark, fresh_path(spark, "catalog"))
    store.commit(sold, legacy, version=1, check=False)
    store.migrate()
    return store.links()


def _streamed(spark: SparkSession, sf_dir: str) -> IncrementalIngest:
    """All entries as files that arrive in three lots, ingested as a stream that is started anew for each."""
    entries = only(lambda: tables.entries(spark, sf_dir), "entries")
    path, progress, root = (fresh_path(spark, name) for name in ("arriving", "progress", "catalog"))
    third = (entries.agg(F.max("record_index")).first()[0] // 3000 + 1) * 1000
    CatalogStore(spark, root).commit(tables.products(spark, sf_dir), spark.createDataFrame([], LINK))
    for lot in range(3):
        _payload_files(entries.filter(F.floor(F.col("record_index") / third) == lot), path, False)
        if lot == 2:
            discard(entries)
        vectors = VectorStore(spark, f"{root}/vectors", HashEmbedder(), buckets=8)
        job = IncrementalIngest(CatalogStore(spark, root), HashEmbedder(), MATCH, "none", vectors=vectors)
        job.start(path, progress, third // 1000).awaitTermination()
        remove(spark, path)  # its records are decided and committed
    return job


@query(ORACLES["ingest_links"])
def streamed_links(spark, sf_dir):
    """What the commits of three lots have added up to."""
    return _streamed(spark, sf_dir).store.links()


@query(ORACLES["ingest_products"])
def streamed_products(spark, sf_dir):
    """The catalog after three lots, folded into a new base."""
    store = _streamed(spark, sf_dir).store
    store.compact()
    return store.products()


@query(
    BASE + f"SELECT DISTINCT sha256('{text.TASK_PREFIX}' || identity) AS text_hash, 1 AS times, 32 AS dimension FROM (SELECT {_identity('name', 'brand', 'category')} AS identity FROM product "
    "UNION ALL SELECT r.identity FROM firsts f JOIN records r ON r.record_index = f.first_index)"
)
def stored_vectors(spark, sf_dir):
    """What three lots have embedded, each text once."""
    stored = _streamed(spark, sf_dir).vectors.table()
    return stored.groupBy("text_hash").agg(F.count("*").cast("int").alias("times"), F.max(F.size("vector")).alias("dimension"))


@query(
    RESULTS_SQL.replace("records WHERE reason IS NULL GROUP", "records WHERE reason IS NULL AND record_index % 7 <> 3 GROUP")
    + "SELECT record_index, CASE WHEN fails THEN 'failed' ELSE outcome END AS outcome, CASE WHEN NOT fails THEN product_id END AS product_id, CASE WHEN fails THEN 'other' END AS err_kind "
    "FROM (SELECT r.*, r.reason IS NULL AND r.record_index % 7 = 3 AND (f.first_index IS NULL OR r.record_index < f.first_index) AS fails FROM results r LEFT JOIN firsts f USING (seller_name, seller_product_id))"
)
def refused_results(spark, sf_dir):
    """A run against a store that refuses what every seventh record writes."""
    records = only(lambda: _records(spark, sf_dir).drop("true_product"), "records")

    def refuse(done: Ingested) -> DataFrame:
        return writing(done).filter("record_index % 7 = 3").select("record_index", F.lit("other").alias("err_kind"), F.lit("refused").alias("reason"))

    done = ingest_refused(records, tables.products(spark, sf_dir), spark.createDataFrame([], LINK), HashEmbedder(), MATCH, "none", refuse=refuse)
    discard(records)
    return done.results.select("record_index", "outcome", "product_id", "err_kind")


# --- runs with links from before -------------------------------------------------------------------


def _rounds_sql(mode: str, rounds: int = 8) -> str:
    """A run over seeded links with embedder vectors that are alike for equal identities only.

    Each round decides all records under the products that the last one touched; the last two agree.
    """
    ident = lambda b, c: _identity("name", b, c)
    never = 1 << 62
    sql = f"""WITH {PRODUCT_SQL}, {RECORDS_SQL}, {SEED_SQL},
top AS (SELECT max(id) + 1 AS k FROM product),
named AS MATERIALIZED (SELECT *, {ident('brand', 'category')} AS identity FROM product),
good AS MATERIALIZED (SELECT r.record_index, r.name, r.brand, r.category, r.identity, len(r.flags) > 0 AS flagged, l.product_id AS linked_product, f.first_index,
    lower(r.category) IN (SELECT lower(category) FROM product WHERE category IS NOT NULL) AS known
    FROM records r JOIN firsts f USING (seller_name, seller_product_id) LEFT JOIN links l USING (seller_name, seller_product_id) WHERE r.reason IS NULL),
asked AS MATERIALIZED (SELECT record_index, identity FROM good WHERE linked_product IS NULL AND record_index = first_index),
touched0 AS (SELECT id AS pid, name, brand AS bb, category AS bc, -1 AS born, NULL::BIGINT AS brand_at, NULL AS brand_new, NULL::BIGINT AS category_at, NULL AS category_new FROM product WHERE false)"""
    for k in range(rounds):
        then = lambda f, at: f"CASE WHEN {f}_at <= {at} THEN {f}_new ELSE b{f[0]} END"
        low = f"least(coalesce(brand_at, {never}), coalesce(category_at, {never}))"
        high = "greatest(coalesce(brand_at, -1), coalesce(category_at, -1))"
        offer = lambda f: f"NOT flagged AND {f} <> ''"
        if mode == "fill":
            changes = f"""ch{k} AS (SELECT pid, min(record_index) FILTER (b) AS brand_at, arg_min(brand, record_index) FILTER (b) AS brand_new,
    min(record_index) FILTER (c) AS category_at, arg_min(category, record_index) FILTER (c) AS category_new
    FROM (SELECT *, {offer('brand')} AND bb IS NULL AS b, {offer('category')} AND bc IS NULL AS c FROM m{k}) GROUP BY pid)"""
        else:
            changes = f"""o{k} AS MATERIALIZED (SELECT *, {offer('brand')} AND lower(brand) <> lower(coalesce(bb, '')) AS b,
    {offer('category')} AND lower(category) <> lower(coalesce(bc, '')) AND (bc IS NULL OR known) AS c FROM m{k}),
lead{k} AS (SELECT x.pid, x.record_index AS at, CASE WHEN b THEN brand END AS lb, CASE WHEN c THEN category END AS lc FROM o{k} x
    JOIN (SELECT pid, min(record_index) AS at FROM o{k} WHERE b OR c GROUP BY pid) y ON y.pid = x.pid AND y.at = x.record_index),
later{k} AS (SELECT l.pid, min(record_index) FILTER (b2) AS ab, arg_min(brand, record_index) FILTER (b2) AS nb, min(record_index) FILTER (c2) AS ac, arg_min(category, record_index) FILTER (c2) AS nc
    FROM (SELECT l.pid, u.record_index, u.brand, u.category, {offer('brand')} AND bb IS NULL AND lb IS NULL AS b2, {offer('category')} AND bc IS NULL AND lc IS NULL AS c2
          FROM lead{k} l JOIN m{k} u ON u.pid = l.pid AND u.record_index > l.at) l GROUP BY l.pid),
ch{k} AS (SELECT l.pid, CASE WHEN lb IS NOT NULL THEN l.at ELSE ab END AS brand_at, coalesce(lb, nb) AS brand_new,
    CASE WHEN lc IS NOT NULL THEN l.at ELSE ac END AS category_at, coalesce(lc, nc) AS category_new FROM lead{k} l LEFT JOIN later{k} x ON x.pid = l.pid)"""
        sql += f""",
v{k} AS MATERIALIZED (SELECT id AS pid, -1 AS after, {never} AS until, identity FROM named WHERE id NOT IN (SELECT pid FROM touched{k})
    UNION ALL SELECT pid, born, {low}, {ident('bb', 'bc')} FROM touched{k}
    UNION ALL SELECT pid, {low}, CASE WHEN {high} > {low} THEN {high} ELSE {never} END, {ident(then('brand', low), then('category', low))} FROM touched{k} WHERE {low} < {never}
    UNION ALL SELECT pid, {high}, {never}, {ident(then('brand', high), then('category', high))} FROM touched{k} WHERE {low} < {never} AND {high} > {low}),
d{k} AS MATERIALIZED (SELECT a.record_index, min(v.pid) AS pid FROM asked a LEFT JOIN v{k} v ON v.identity = a.identity AND v.after < a.record_index AND a.record_index <= v.until GROUP BY 1),
f{k} AS MATERIALIZED (SELECT g.*, coalesce(g.linked_product, d.pid, (SELECT k FROM top) + d.record_index) AS pid,
    g.linked_product IS NULL AND d.pid IS NULL AND g.record_index = g.first_index AS inserts, d.pid IS NOT NULL AND g.record_index = g.first_index AS links_now
    FROM good g LEFT JOIN d{k} d ON d.record_index = g.first_index),
b{k} AS MATERIALIZED (SELECT id AS pid, name, brand AS bb, category AS bc, -1 AS born FROM product
    UNION ALL SELECT pid, name, nullif(brand, ''), nullif(category, ''), record_index FROM f{k} WHERE inserts),
m{k} AS MATERIALIZED (SELECT f.pid, f.record_index, f.brand, f.category, f.flagged, f.known, b.bb, b.bc FROM f{k} f JOIN b{k} b ON b.pid = f.pid WHERE NOT f.inserts),
{changes},
touched{k + 1} AS MATERIALIZED (SELECT b.pid, b.name, b.bb, b.bc, b.born, c.brand_at, c.brand_new, c.category_at, c.category_new FROM b{k} b LEFT JOIN ch{k} c ON c.pid = b.pid
    WHERE b.born >= 0 OR c.brand_at IS NOT NULL OR c.category_at IS NOT NULL)"""
    last = rounds - 1
    as_of = lambda f: f"CASE WHEN {f}_at < m.record_index THEN {f}_new ELSE m.b{f[0]} END"

    def field(name: str) -> tuple[str, str]:
        cur, new = f"cur_{name}", name
        cases = [f"WHEN {new} = '' OR lower({new}) = lower(coalesce({cur}, '')) THEN NULL", f"WHEN flagged THEN '{name}: flagged input, not applied'"]
        if mode == "fill":
            cases.append(f"WHEN {cur} IS NOT NULL THEN '{name} differs: ' || {new} || ' (entry) vs ' || {cur} || ' (catalog), kept'")
        else:
            cases.append(f"WHEN {cur} IS NOT NULL AND by_record IS NOT NULL THEN '{name}: already updated by record ' || by_record || ', kept ' || {cur}")
            if name == "category":
                cases.append(f"WHEN {cur} IS NOT NULL AND NOT known THEN 'category: ' || {new} || ' is not a catalog category, kept ' || {cur}")
        note = "CASE " + " ".join(cases) + " END"
        return note, f"CASE WHEN {new} <> '' AND lower({new}) <> lower(coalesce({cur}, '')) AND {note} IS NULL THEN '{name}>' || coalesce({cur}, '') || '>' || {new} END"

    (bn, bc), (cn, cc) = field("brand"), field("category")
    return sql + f""",
seen AS (SELECT m.*, {as_of('brand')} AS cur_brand, {as_of('category')} AS cur_category,
    CASE WHEN least(brand_at, category_at) < m.record_index THEN least(brand_at, category_at) END AS by_record FROM m{last} m LEFT JOIN touched{last} t ON t.pid = m.pid),
ruled AS (SELECT record_index, list_filter([{bn}, {cn}], lambda x: x IS NOT NULL) AS note_list, list_filter([{bc}, {cc}], lambda x: x IS NOT NULL) AS change_list FROM seen),
born AS (SELECT pid, (SELECT k FROM top) - 1 + row_number() OVER (ORDER BY record_index) AS product_id FROM f{last} WHERE inserts),
runs AS (SELECT r.record_index, r.reason, r.flags, CASE WHEN r.reason IS NOT NULL THEN 'rejected' WHEN f.inserts THEN 'inserted' WHEN f.links_now THEN 'linked' ELSE 'existing' END AS outcome,
    coalesce(n.product_id, f.pid)::BIGINT AS product_id, u.change_list, u.note_list, coalesce(array_to_string(u.change_list, '; '), '') AS changes, coalesce(array_to_string(u.note_list, '; '), '') AS notes
    FROM records r LEFT JOIN f{last} f ON f.record_index = r.record_index LEFT JOIN born n ON n.pid = f.pid LEFT JOIN ruled u ON u.record_index = r.record_index)
"""


def _seeded(spark: SparkSession, sf_dir: str, mode: str) -> Ingested:
    records, links = _both(spark, sf_dir)
    return ingest(records.drop("true_product"), tables.products(spark, sf_dir), materialize(links, "links"), HashEmbedder(), MATCH, mode)


def _run_rows(done: Ingested) -> DataFrame:
    shown = F.array_join(F.transform("changes", lambda c: F.concat_ws(">", c["field"], c["old"], c["new"])), "; ")
    return done.results.select("record_index", "outcome", "product_id", shown.alias("changes"), F.array_join("notes", "; ").alias("notes"))


@query(_rounds_sql("fill") + "SELECT record_index, outcome, product_id, changes, notes FROM runs")
def seeded_fill(spark, sf_dir):
    return _run_rows(_seeded(spark, sf_dir, "fill"))


@query(_rounds_sql("overwrite") + "SELECT record_index, outcome, product_id, changes, notes FROM runs")
def seeded_overwrite(spark, sf_dir):
    return _run_rows(_seeded(spark, sf_dir, "overwrite"))


@query(_rounds_sql("overwrite") + """SELECT count(*) AS records, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'linked') AS linked, count(*) FILTER (outcome = 'existing') AS existing,
    count(*) FILTER (outcome = 'rejected') AS rejected, 0::BIGINT AS failed, count(*) FILTER (len(flags) > 0) AS suspicious, count(DISTINCT product_id) FILTER (changes <> '') AS updated FROM runs""")
def seeded_summary(spark, sf_dir):
    return summary(_seeded(spark, sf_dir, "overwrite").results)


@query(_rounds_sql("fill") + """, lines AS (SELECT 'changes' AS section, record_index, unnest(change_list) AS c, product_id FROM runs
    UNION ALL SELECT 'notes', record_index, unnest(note_list), product_id FROM runs)
    SELECT section, record_index, '#' || record_index || ' product ' || product_id || ': ' || CASE section WHEN 'notes' THEN c
    ELSE split_part(c, '>', 1) || ': ' || CASE WHEN split_part(c, '>', 2) = '' THEN '(null)' ELSE split_part(c, '>', 2) END || ' → ' || split_part(c, '>', 3) END AS line FROM lines""")
def seeded_report(spark, sf_dir):
    """The report's sections of changes and notes."""
    lines = report.report_lines(_seeded(spark, sf_dir, "fill").results)
    return lines.filter("section in ('changes', 'notes')").select("section", "record_index", "line")
