"""The ingest job: decide a batch of seller records, and the catalog and links that follow from it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.operators import links as link_ops
from mergewell.operators import updates
from mergewell.operators.embed import Embedder, preflight
from mergewell.operators.resolve import Resolver, outcomes
from mergewell.sources.vector_store import VectorStore
from mergewell.workspace import materialize


class Ingested:
    """``results``: a row per record; ``products`` and ``links``: the catalog afterwards, unchanged by a dry run.

    Links are numbered when they are first asked for: that sorts all records that add one.  Who reads these before
    asks for ``linking``, and then they are decided once for both.
    """

    def __init__(self, results: DataFrame, products: DataFrame, links: DataFrame, new_products: DataFrame, new_links: Callable[[DataFrame], DataFrame], updates: DataFrame, dry_run: bool = False):
        """``links`` are those from before the run, ``new_links`` makes new ones of the records that add one."""
        self.results, self.products, self.new_products, self.updates = results, products, new_products, updates
        self._links, self._new, self._dry_run = links, new_links, dry_run

    def _adding(self) -> DataFrame:
        return self.results.filter("outcome in ('inserted', 'linked')").select("record_index", "seller_name", "product_id", "seller_product_id")

    @cached_property
    def linking(self) -> DataFrame:
        """The records that add a link, written to the shared folder."""
        return materialize(self._adding(), "linking")

    @cached_property
    def new_links(self) -> DataFrame:
        return self._new(self.linking if "linking" in self.__dict__ else self._adding())

    @cached_property
    def links(self) -> DataFrame:
        return self._links if self._dry_run else link_ops.union_links(self._links, self.new_links)


def ingest(
    records: DataFrame, products: DataFrame, links: DataFrame, embedder: Embedder, threshold: float, mode: str = "fill",
    dry_run: bool = False, high_water: tuple[int, int] | None = None, cache: DataFrame | None = None, store: VectorStore | None = None,
    failing: DataFrame | None = None,
) -> Ingested:
    """Decide ``records`` in their order; ``high_water``: the largest product and link id ever used.

    Texts are embedded once a run, or with a ``store`` of vectors once and for all.  What a record in
    ``failing (record_index, err_kind, reason)`` would write is not written: it fails, and later records are
    decided without it.  The results are computed from tables of the run; they don't read ``records`` again.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold {threshold}: want a value in (0, 1]")
    preflight(embedder)
    resolver = Resolver(records, products, links, embedder, threshold, mode, cache=cache, store=store, failing=failing)
    followed, touched = resolver.run()
    found = outcomes(resolver, followed, touched)
    if high_water is None:
        high_water = (products.agg(F.max("id")).first()[0] or 0, links.agg(F.max("id")).first()[0] or 0)

    inserted = touched.filter("born >= 0").select(F.col("born").alias("record_index"), "pid")
    ids = materialize(link_ops.new_product_ids(inserted, high_water[0], dry_run).drop("record_index"), "ids")
    named = lambda frame, pid, column: (
        frame.join(ids.select(F.col("pid").alias(pid), F.col("product_id").alias("_new")), pid, "left")
        .withColumn(column, F.when(F.col(pid) >= resolver.inserted, F.col("_new")).otherwise(F.col(pid)))
        .drop("_new")
    )
    results = named(named(found, "pid", "product_id"), "match_pid", "match_id")

    final = {f: F.coalesce(f"{f}_new", f"base_{f}") for f in ("brand", "category")}
    changed = touched.filter((F.col("pid") < resolver.inserted) & (F.col("brand_at").isNotNull() | F.col("category_at").isNotNull()))
    changed = changed.select(F.col("pid").alias("id"), F.col("brand_new").alias("brand"), F.col("category_new").alias("category"))
    new_products = touched.filter(F.col("pid") >= resolver.inserted).join(ids, "pid")
    new_products = new_products.select(F.col("product_id").alias("id"), "name", final["brand"].alias("brand"), final["category"].alias("category"))
    results = results.drop("pid", "match_pid")

    def new_links(linking: DataFrame) -> DataFrame:
        return link_ops.numbered(linking, "record_index", "id", high_water[1]).select("id", "seller_name", "product_id", "seller_product_id")

    after = products if dry_run else link_ops.union_catalog(updates.apply_updates(products, changed), new_products)
    return Ingested(results, after, links, new_products, new_links, changed, dry_run)


def summary(results: DataFrame) -> DataFrame:
    """Counts of a run, one row; every record has exactly one outcome."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return results.agg(
        F.count("*").alias("records"),
        *[count(o) for o in ("inserted", "linked", "existing", "rejected", "failed")],
        F.count_if(F.size("flags") > 0).alias("suspicious"),
        F.count_distinct(F.when(F.size("changes") > 0, F.col("product_id"))).alias("updated"),
    )
