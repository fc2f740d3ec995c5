"""Measures of entries and catalog: columns, keys, names, the match funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.functions import text
from mergewell.schemas import FIELDS, RAW
from mergewell.workspace import materialize


def column_profile(entries: DataFrame) -> DataFrame:
    """One pass: NULLs, blanks, white space at the edges and the longest value of each raw field."""
    aggs = []
    for f in FIELDS:
        c = F.col(RAW[f])
        edge = c.rlike(f"^{text.SPACES}|{text.SPACES}$")
        aggs.append(
            F.struct(
                F.lit(f).alias("field"), F.count_if(c.isNull()).alias("nulls"), F.count_if(text.spaced(c).rlike("^ *$")).alias("blanks"),
                F.count_if(edge).alias("edge_spaces"), F.max(F.char_length(c)).cast("long").alias("longest"),
            )
        )
    return entries.agg(F.array(*aggs).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def null_combinations(products: DataFrame) -> DataFrame:
    kind = lambda c: F.when(F.col(c).isNull(), "null").otherwise("text")
    return products.groupBy(kind("brand").alias("brand"), kind("category").alias("category")).agg(F.count("*").alias("products"))


def distinct_counts(products: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return products.agg(
        F.count("*").alias("products"), count("name").alias("names"), count(text.match_key(F.col("name"))).alias("loose_names"),
        count("brand").alias("brands"), count("category").alias("categories"),
    )


def sizes(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def largest(rows: DataFrame, column: str, k: int = 3) -> DataFrame:
    return sizes(rows, column).orderBy(F.desc("n"), column).limit(k)


def reused_ids(records: DataFrame) -> DataFrame:
    """Ids on several records, and whether with one seller or more."""
    each = records.groupBy("seller_product_id").agg(F.count("*").alias("entries"), F.count_distinct("seller_name").alias("sellers"))
    return each.filter("entries > 1").withColumn("kind", F.when(F.col("sellers") > 1, "other seller").otherwise("same seller"))


def _keys(records: DataFrame) -> DataFrame:
    """``_name, match_key`` of the distinct names."""
    names = records.select(F.col("name").alias("_name")).distinct()
    return materialize(names.select("_name", text.match_key(F.col("_name")).alias("match_key")), "keys")


def duplicate_names(records: DataFrame) -> DataFrame:
    """Names that several records share under the loosest form."""
    each = records.groupBy("name").agg(F.count("*").alias("_n"))  # a form is taken of distinct names only
    return each.groupBy(text.match_key(F.col("name")).alias("match_key")).agg(F.sum("_n").alias("entries")).filter("entries > 1")


def same_seller_product(records: DataFrame) -> DataFrame:
    """One seller's product under different ids."""
    each = records.select("seller_name", "name", "seller_product_id").distinct()
    keyed = each.join(_keys(records), F.col("name").eqNullSafe(F.col("_name"))).groupBy("seller_name", "match_key")
    return keyed.agg(F.count_distinct("seller_product_id").alias("ids")).filter("ids > 1")


def foreign_categories(records: DataFrame, products: DataFrame) -> DataFrame:
    known = products.select("category").distinct()
    return sizes(records.filter("category <> ''").join(known, "category", "left_anti"), "category")


def string_oddities(entries: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return entries.agg(
        F.count_if(c.rlike("[^\\x{00}-\\x{7F}]")).alias("non_ascii"), F.count_if(c.contains("  ")).alias("doubled_spaces"),
        F.count_if(text.had_controls(c)).alias("controls"),
    )


def _times(found: str) -> Column:
    """How many rows the texts with a value in ``found`` stand for."""
    return F.coalesce(F.sum(F.when(F.col(found).isNotNull(), F.col("_n"))), F.lit(0).cast("long"))


def match_funnel(entries: DataFrame, products: DataFrame) -> DataFrame:
    """``level, names, products``: entries whose name, and whose name, brand and category, are in the catalog.

    ``entries`` has ``name, brand, category``.  Both sides are reduced to one row a key before each join, and the
    entries to their distinct texts before any form of them is taken.
    """
    out = None
    empty = lambda c: F.coalesce(c, F.lit(""))
    entries = materialize(entries.groupBy("name", "brand", "category").agg(F.count("*").alias("_n")), "texts")
    products = materialize(products.select("name", "brand", "category").distinct(), "known")
    for level, form in text.LADDER.items():
        keys = [form(empty(F.col(c))).alias(f"_{c}") for c in ("name", "brand", "category")]
        known = products.select(*keys).groupBy("_name", "_brand", "_category").agg(F.lit(1).alias("_full"))
        names = known.groupBy("_name").agg(F.lit(1).alias("_known"))
        joined = entries.select(*keys, "_n").join(names, "_name", "left").join(known, ["_name", "_brand", "_category"], "left")
        row = joined.agg(F.lit(level).alias("level"), _times("_known").alias("names"), _times("_full").alias("products"))
        out = row if out is None else out.unionByName(row)
    return out


def drift(records: DataFrame, products: DataFrame) -> DataFrame:
    """Records whose name is in the catalog but never with their brand and category."""
    key = text.match_key(F.col("name"))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    known = products.select(key.alias("match_key"), empty("brand").alias("brand"), empty("category").alias("category")).distinct()
    named = known.select("match_key").distinct()
    rows = records.select("record_index", "name", empty("brand").alias("brand"), empty("category").alias("category"))
    keyed = rows.join(_keys(records), F.col("name") == F.col("_name")).select("record_index", "match_key", "brand", "category")
    return keyed.join(named, "match_key", "left_semi").join(known, ["match_key", "brand", "category"], "left_anti")


def profile(entries: DataFrame, records: DataFrame, products: DataFrame) -> DataFrame:
    """All measures as ``metric, level, value``."""
    tidy = lambda df, metric, level, value: df.select(F.lit(metric).alias("metric"), level.cast("string").alias("level"), value.cast("long").alias("value"))
    parts = []
    columns = column_profile(entries)
    for c in ("nulls", "blanks", "edge_spaces", "longest"):
        parts.append(tidy(columns, c, F.col("field"), F.col(c)))
    parts.append(tidy(null_combinations(products), "null_combination", F.concat_ws("/", "brand", "category"), F.col("products")))
    funnel = match_funnel(records, products)
    parts += [tidy(funnel, "name_matches", F.col("level"), F.col("names")), tidy(funnel, "product_matches", F.col("level"), F.col("products"))]
    parts.append(tidy(sizes(products, "category"), "category_size", F.coalesce("category", F.lit("(null)")), F.col("n")))
    parts.append(tidy(sizes(records, "seller_name"), "seller_size", F.col("seller_name"), F.col("n")))
    parts.append(tidy(reused_ids(records).groupBy("kind").agg(F.count("*").alias("n")), "reused_ids", F.col("kind"), F.col("n")))
    parts.append(tidy(duplicate_names(records).agg(F.count("*").alias("n")), "duplicate_names", F.lit("groups"), F.col("n")))
    parts.append(tidy(same_seller_product(records).agg(F.count("*").alias("n")), "same_seller_product", F.lit("groups"), F.col("n")))
    parts.append(tidy(foreign_categories(records, products), "foreign_category", F.col("category"), F.col("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
