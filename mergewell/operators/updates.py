"""What a matched record may change on its product: rules ``fill``, ``none`` and ``overwrite``.

Per record the rule is one ordered case per field.  Over a run it has a closed form, because a field
changes at most once: ``changes_of`` finds for every product when each field changes and to what, with
combinable aggregates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.functions.text import same_folded
from mergewell.schemas import CHANGES
from mergewell.workspace import materialize

MODES = ("fill", "none", "overwrite")


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"update mode {mode!r}: want fill, none or overwrite")
    return mode


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


#: The wording of the notes below is fixed.
def field_rule(mode: str, field: str, current: Column, value: Column, flagged: Column, updated_by: Column, known: Column) -> tuple[Column, Column]:
    """The note and whether the change is applied, for one field; ``known``: the value is in the vocabulary."""
    empty = _blank(current)
    nothing = _blank(value) | same_folded(current, value)
    note = F.when(nothing, None).when(flagged, f"{field}: flagged input, not applied")
    if mode == "none":
        note = note.when(empty, F.format_string(f"{field} missing in catalog: %s (entry), kept", value))
    if mode != "overwrite":
        note = note.when(~empty, F.format_string(f"{field} differs: %s (entry) vs %s (catalog), kept", value, current))
    note = note.when(~empty & updated_by.isNotNull(), F.format_string(f"{field}: already updated by record %d, kept %s", updated_by, current))
    if field == "category":
        note = note.when(~empty & ~known, F.format_string(f"{field}: %s is not a catalog category, kept %s", value, current))
    return note, ~nothing & note.isNull()


def plan_update(rows: DataFrame, mode: str) -> DataFrame:
    """Add ``changes`` and ``notes``.

    ``rows`` has the record's ``brand, category, flags``, the product's ``current_brand,
    current_category`` as of the record, ``updated_by`` (the record that changed the product first, or
    NULL) and ``in_vocabulary``.
    """
    check_mode(mode)
    flagged = F.size("flags") > 0
    notes, changes = [], []
    for field in ("brand", "category"):
        current, value = F.col(f"current_{field}"), F.col(field)
        note, change = field_rule(mode, field, current, value, flagged, F.col("updated_by"), F.coalesce("in_vocabulary", F.lit(False)))
        notes.append(note)
        entry = F.struct(F.lit(field).alias("field"), F.coalesce(current, F.lit("")).alias("old"), value.alias("new"))
        changes.append(F.when(change, entry))
    present = lambda parts: F.filter(F.array(*parts), lambda x: x.isNotNull())
    return rows.withColumns({"changes": present(changes).cast(CHANGES), "notes": present(notes)})


def vocabulary(products: DataFrame) -> DataFrame:
    return products.filter("category is not null").select(F.lower("category").alias("folded")).distinct()


def mark_vocabulary(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``in_vocabulary``: whether the record's category is one of the catalog's, whatever its case.

    ``words`` are written first: only then it shows how few they are, and that records can stay where they lie.
    """
    known = materialize(words, "vocabulary").select(F.col("folded").alias("_folded"), F.lit(True).alias("in_vocabulary"))
    return rows.join(known, F.lower("category") == F.col("_folded"), "left").drop("_folded").na.fill(False, ["in_vocabulary"])


def changes_of(matched: DataFrame, mode: str) -> DataFrame:
    """``pid, brand_at, brand_new, category_at, category_new`` of the products that a run changes.

    ``matched`` has a row for each record that follows a product: ``pid, record_index, brand, category,
    flags, base_brand, base_category, in_vocabulary``, with the product as it was before the run.
    """
    check_mode(mode)
    index = F.col("record_index")
    good = F.size("flags") == 0
    empty = "pid long, brand_at long, brand_new string, category_at long, category_new string"
    if mode == "none":
        return matched.sparkSession.createDataFrame([], empty)
    offers = {f: good & ~_blank(F.col(f)) for f in ("brand", "category")}
    if mode == "fill":
        open_ = {f: F.when(offers[f] & F.col(f"base_{f}").isNull(), index) for f in offers}
        return (
            matched.groupBy("pid")
            .agg(*[x for f in offers for x in (F.min(open_[f]).alias(f"{f}_at"), F.min_by(f, open_[f]).alias(f"{f}_new"))])
            .filter("brand_at is not null or category_at is not null")
        )
    differs = {f: offers[f] & ~same_folded(F.col(f"base_{f}"), F.col(f)) for f in offers}
    differs["category"] = differs["category"] & (F.col("base_category").isNull() | F.col("in_vocabulary"))
    first = F.when(differs["brand"] | differs["category"], index)
    value = lambda f: F.when(differs[f], F.col(f))
    # the first that differs leads; a field without a value that it leaves alone is filled by the first to offer one, which comes later
    spot = {f: F.when(offers[f] & F.col(f"base_{f}").isNull(), index) for f in offers}
    both = matched.groupBy("pid").agg(
        F.min(first).alias("_first"),
        F.min_by(F.struct(value("brand").alias("brand"), value("category").alias("category")), first).alias("_lead"),
        *[x for f in offers for x in (F.min(spot[f]).alias(f"_at_{f}"), F.min_by(f, spot[f]).alias(f"_new_{f}"))],
    ).filter("_first is not null")
    out = [F.col("pid")]
    for f in ("brand", "category"):
        lead = F.col(f"_lead.{f}")
        out.append(F.when(lead.isNotNull(), F.col("_first")).otherwise(F.col(f"_at_{f}")).alias(f"{f}_at"))
        out.append(F.coalesce(lead, F.col(f"_new_{f}")).alias(f"{f}_new"))
    return both.select(*out)


def apply_updates(products: DataFrame, updates: DataFrame) -> DataFrame:
    """``products`` with ``coalesce(new, old)`` of brand and category; names never change."""
    u = updates.select(F.col("id"), F.col("brand").alias("_brand"), F.col("category").alias("_category"))
    joined = products.join(u, "id", "left")
    new = {"brand": F.coalesce("_brand", "brand"), "category": F.coalesce("_category", "category")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in products.columns])


def missing_products(updates: DataFrame, products: DataFrame) -> DataFrame:
    """Updates of products that aren't there."""
    return updates.join(products.select("id"), "id", "left_anti")


def current(field: str, index: Column) -> Column:
    """A field as of a record: what earlier records changed, else the base value."""
    return F.when(F.col(f"{field}_at") < index, F.col(f"{field}_new")).otherwise(F.col(f"base_{field}"))
