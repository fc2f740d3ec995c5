"""The run as a plain loop over records, to hold the parallel one against."""

from __future__ import annotations

import numpy as np


def identity(name, brand, category):
    return " | ".join(([name] if name else []) + ([f"brand: {brand}"] if brand else []) + ([f"category: {category}"] if category else []))


def unit(v):
    v = np.asarray(v, np.float64)
    return (v / np.sqrt((v * v).sum())).astype(np.float32).astype(np.float64)


def rule(mode, product, record, words, updated_by):
    changes, notes = [], []
    for field in ("brand", "category"):
        cur, new = product[field] or "", record[field]
        if not new or cur.lower() == new.lower():
            continue
        if record["flags"]:
            notes.append(f"{field}: flagged input, not applied")
        elif mode == "none" and not cur:
            notes.append(f"{field} missing in catalog: {new} (entry), kept")
        elif cur and mode != "overwrite":
            notes.append(f"{field} differs: {new} (entry) vs {cur} (catalog), kept")
        elif cur and updated_by is not None:
            notes.append(f"{field}: already updated by record {updated_by}, kept {cur}")
        elif cur and field == "category" and new.lower() not in words:
            notes.append(f"{field}: {new} is not a catalog category, kept {cur}")
        else:
            changes.append((field, cur, new))
    return changes, notes


def sequential(records, products, links, embed, threshold, mode, failing=()):
    """``embed(identity)`` gives a vector; the store refuses what records in ``failing`` write.  Results by record index; products afterwards by id."""
    catalog = {p["id"]: dict(p) for p in products}
    order = [p["id"] for p in sorted(products, key=lambda p: p["id"])]
    vec = {i: unit(embed(identity(p["name"], p["brand"], p["category"]))) for i, p in catalog.items()}
    words = {p["category"].lower() for p in products if p["category"]}
    linked = {(x["seller_name"], x["seller_product_id"]): x["product_id"] for x in links}
    updated, out, top = {}, {}, max(order, default=0)
    for r in sorted(records, key=lambda r: r["record_index"]):
        key = (r["seller_name"], r["seller_product_id"])
        row = {"outcome": None, "product_id": None, "changes": [], "notes": [], "match_id": None}
        out[r["record_index"]] = row
        if r["reason"]:
            row["outcome"] = "rejected"
            continue
        if key in linked:
            row["outcome"], row["product_id"] = "existing", linked[key]
        else:
            v = unit(embed(r["identity"]))
            best, score = None, None
            for i in order:
                s = np.float32(np.clip(np.float32(v @ vec[i]), -1, 1))
                if best is None or s > score:
                    best, score = i, s
            row["match_id"] = best
            if best is not None and score >= np.float32(threshold):
                row["outcome"], row["product_id"] = "linked", best
                if r["record_index"] not in failing:
                    linked[key] = best
            elif r["record_index"] in failing:
                row["outcome"] = "failed"
                continue
            else:
                top += 1
                catalog[top] = {"id": top, "name": r["name"], "brand": r["brand"] or None, "category": r["category"] or None}
                order.append(top)
                vec[top] = v
                linked[key] = top
                row["outcome"], row["product_id"] = "inserted", top
                continue
        pid = row["product_id"]
        if pid in catalog:
            row["changes"], row["notes"] = rule(mode, catalog[pid], r, words, updated.get(pid))
            if r["record_index"] in failing and (row["outcome"] == "linked" or row["changes"]):
                row |= {"outcome": "failed", "product_id": None, "changes": []}
                continue
            for field, _, new in row["changes"]:
                catalog[pid][field] = new
            if row["changes"]:
                updated.setdefault(pid, r["record_index"])
                p = catalog[pid]
                vec[pid] = unit(embed(identity(p["name"], p["brand"], p["category"])))
    return out, catalog
