"""Decoded entries to records: clean fields, flags, the first reason to reject, the identity."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.functions import text
from mergewell.schemas import CLEAN, FIELDS, FLAGS, RAW, REQUIRED

#: What a field can be flagged for, in order.
FLAGGED = (text.CONTROLS, text.TRUNCATED, text.SQL_LIKE, text.MARKUP)
SHAPE = ", ".join([*[f"{CLEAN[f]} string" for f in ("SellerName", "Id", "Name", "Brand", "Category")], "identity string", "reason string", f"flags {FLAGS}"])


def _cleaned(values: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """``values`` as ``text.sanitize`` has them, and a mask for each of ``FLAGGED``; each distinct value is looked at once."""
    coded = values.dictionary_encode()
    raw = full = coded.dictionary
    controls = pa.repeat(False, len(raw))
    if pc.any(pc.match_substring_regex(raw, text.BEYOND_PLAIN)).as_py():
        spaced = pc.replace_substring_regex(raw, text.SPACES, " ")
        controls = pc.match_substring_regex(spaced, text.REMOVED)
        bare = pc.replace_substring_regex(spaced, text.REMOVED, "").to_pylist()
        full = pa.array([s if s.isascii() else unicodedata.normalize("NFC", s) for s in bare], pa.string())
    full = pc.utf8_trim(pc.replace_substring_regex(full, " +", " "), " ")
    over = pc.greater(pc.utf8_length(full), text.MAX_POINTS)
    clean = pc.if_else(over, pc.utf8_rtrim(pc.utf8_slice_codeunits(full, 0, text.MAX_POINTS), " "), full)
    masks = [controls, over, pc.match_substring_regex(clean, text.SQL_PATTERN), pc.match_substring_regex(clean, text.MARKUP_PATTERN)]
    return clean.take(coded.indices), [m.take(coded.indices) for m in masks]


def _where(mask: pa.Array, value: str) -> pa.Array:
    return pc.if_else(mask, pa.scalar(value), pa.scalar(None, pa.string()))


def _reason(states: dict[str, pa.Array], clean: dict[str, pa.Array], shaped: pa.Array, object_reason: pa.Array) -> pa.Array:
    """The first problem in field order, or NULL."""
    found = [object_reason]
    for field in FIELDS:
        needed = field in REQUIRED
        state = states[field]
        if needed:
            found += [_where(pc.equal(state, "missing"), f"{field}: missing"), _where(pc.equal(state, "null"), f"{field}: null")]
        found.append(_where(pc.equal(state, "other"), f"{field}: not a string"))
        if needed:
            found.append(_where(pc.and_(pc.equal(state, "text"), pc.equal(clean[field], "")), f"{field}: blank"))
        if field == "Id":
            found.append(_where(pc.invert(shaped), "Id: not a UUID"))
    return pc.coalesce(*found)


def _identity(name: pa.Array, brand: pa.Array, category: pa.Array) -> pa.Array:
    """As ``text.identity``, of texts that are all there."""
    part = lambda label, c: pc.if_else(pc.equal(c, ""), "", pc.binary_join_element_wise(f" | {label}", c, ""))
    return pc.utf8_slice_codeunits(pc.binary_join_element_wise(part("", name), part("brand: ", brand), part("category: ", category), ""), 3)


def _flag_lists(masks: list[pa.Array]) -> pa.Array:
    """A list of flags for each row; ``masks`` has one for each field and each of ``FLAGGED``."""
    table = np.column_stack([m.to_numpy(zero_copy_only=False) for m in masks])
    which = np.nonzero(table)[1]
    place = lambda names, k: pa.array(names, pa.string()).take(pa.array(k))
    flags = pa.StructArray.from_arrays([place(FIELDS, which // len(FLAGGED)), place(FLAGGED, which % len(FLAGGED))], ["field", "reason"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(table.sum(axis=1))]), pa.int32()), flags)


def records(entries: DataFrame, keep: tuple[str, ...] = ("record_index",)) -> DataFrame:
    """Clean records of ``entries``, which has the raw field columns.

    Optional columns: ``<raw>_state`` (missing, null, other, text; otherwise from the value) and
    ``object_reason`` (an element that isn't an object with distinct keys).  Result: ``keep``,
    ``seller_name, seller_product_id, name, brand, category, identity, reason, flags``; texts that
    aren't there are empty strings, as for a blank one.

    One Arrow pass, so that what reads a record's reason or flags never cleans its fields again.
    """
    used = [c for c in (*RAW.values(), *[f"{r}_state" for r in RAW.values()], "object_reason") if c in entries.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = lambda c: batch.column(len(keep) + used.index(c))  # noqa: B023, E731
            object_reason = column("object_reason") if "object_reason" in used else pa.nulls(n, pa.string())
            states, clean, masks = {}, {}, []
            for f in FIELDS:
                raw = column(RAW[f]).cast(pa.string())
                states[f] = column(f"{RAW[f]}_state") if f"{RAW[f]}_state" in used else pc.if_else(pc.is_null(raw), "null", "text")
                there = pc.and_(pc.is_null(object_reason), pc.equal(states[f], "text"))
                clean[f], found = _cleaned(pc.fill_null(pc.if_else(there, raw, ""), ""))
                masks += found
            shaped = pc.match_substring_regex(clean["Id"], text.UUID_PATTERN)
            reason = _reason(states, clean, shaped, object_reason)
            identity = pc.if_else(pc.is_null(reason), _identity(clean["Name"], clean["Brand"], clean["Category"]), pa.scalar(None, pa.string()))
            ids = pc.if_else(shaped, pc.ascii_lower(clean["Id"]), clean["Id"])
            columns = [*batch.columns[: len(keep)], clean["SellerName"], ids, clean["Name"], clean["Brand"], clean["Category"], identity, reason, _flag_lists(masks)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, CLEAN["SellerName"], CLEAN["Id"], CLEAN["Name"], CLEAN["Brand"], CLEAN["Category"], "identity", "reason", "flags"])

    kept = ", ".join(f"{c} {entries.schema[c].dataType.simpleString()}" for c in keep)
    return entries.select(*keep, *used).mapInArrow(run, f"{kept}, {SHAPE}")


def accepted(found: DataFrame) -> DataFrame:
    return found.filter(F.col("reason").isNull())


def rejected(found: DataFrame) -> DataFrame:
    return found.filter(F.col("reason").isNotNull())


def suspicious(found: DataFrame) -> DataFrame:
    """Records with flags, rejected ones included."""
    return found.filter(F.size("flags") > 0)


def reason_counts(found: DataFrame) -> DataFrame:
    return rejected(found).groupBy("reason").agg(F.count("*").alias("records"))


def flag_counts(found: DataFrame) -> DataFrame:
    each = found.select(F.explode("flags").alias("f")).select("f.field", "f.reason")
    return each.groupBy("field", "reason").agg(F.count("*").alias("records"))
