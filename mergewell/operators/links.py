"""Which records are already linked, which come first for their key, and what links they add."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergewell.workspace import with_rank

KEY = ["seller_name", "seller_product_id"]


def existing(records: DataFrame, links: DataFrame) -> DataFrame:
    """``records`` with ``linked_product``, the product that their key is linked to, or NULL."""
    known = links.select(*KEY, F.col("product_id").alias("linked_product"))
    return records.join(known, KEY, "left")


def unlinked(records: DataFrame, links: DataFrame) -> DataFrame:
    return records.join(links.select(*KEY), KEY, "left_anti")


def first_per_key(records: DataFrame) -> DataFrame:
    """The first accepted record of each key: one combinable minimum, no window."""
    return records.filter(F.col("reason").isNull()).groupBy(*KEY).agg(F.min("record_index").alias("first_index"))


def with_first(records: DataFrame) -> DataFrame:
    """Accepted records with the index of their key's first one; repeats follow its product."""
    return records.filter(F.col("reason").isNull()).join(first_per_key(records), KEY)


def with_decider(records: DataFrame) -> DataFrame:
    """Accepted records with ``first_index``, the record that decides for them; ``fails`` marks those that can't be written.

    A key is decided by its first record that can be written.  One that can't and comes before that decides
    for itself, and nothing follows from it.  ``_decider``: the hash of the deciding record's identity.

    Most keys come once, so a table of the firsts would be about as large as the records: each key's records are
    brought together once instead.
    """
    index = F.col("record_index")
    able = F.when(~F.col("fails"), index)
    same = Window.partitionBy(*KEY)
    whole = records.dropna(subset=KEY)  # no key equals one that lacks a part
    found = whole.withColumns({"_first": F.min(able).over(same), "_of": F.min_by(F.xxhash64("identity"), able).over(same)})
    alone = F.col("fails") & (F.col("_first").isNull() | (index < F.col("_first")))
    decider = {"first_index": F.when(alone, index).otherwise(F.col("_first")), "_decider": F.when(alone, F.xxhash64("identity")).otherwise(F.col("_of"))}
    return found.withColumns(decider).drop("_first", "_of")


def union_catalog(products: DataFrame, inserted: DataFrame) -> DataFrame:
    return products.unionByName(inserted.select(*products.columns))


def union_links(links: DataFrame, added: DataFrame) -> DataFrame:
    return links.unionByName(added.select(*links.columns))


def numbered(rows: DataFrame, order: str, name: str, after: int, step: int = 1) -> DataFrame:
    """``rows`` with ids that continue after ``after`` in the order of ``order``, without a single-task window."""
    return with_rank(rows, [F.col(order)], "_rank", "ids").withColumn(name, F.lit(after) + F.lit(step) * (F.col("_rank") + 1)).drop("_rank")


def new_product_ids(inserted: DataFrame, high_water: int, dry_run: bool = False) -> DataFrame:
    """``product_id`` for inserted records by ``record_index``: above every id ever used, or -1, -2, ... in a dry run."""
    return numbered(inserted, "record_index", "product_id", 0 if dry_run else high_water, -1 if dry_run else 1)


def resolve_products(records: DataFrame, products: DataFrame, column: str) -> DataFrame:
    """``records`` with the current name, brand and category of the product in ``column``."""
    named = products.select(F.col("id").alias(column), *[F.col(c).alias(f"product_{c}") for c in ("name", "brand", "category")])
    return records.join(named, column)
