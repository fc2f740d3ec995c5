"""The text report of a run and records as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.plans.ingest import summary

#: The sections and the wording of their lines.
SECTIONS = ("rejected", "failed", "suspicious", "inserted", "changes", "notes")


def _who() -> Column:
    return F.format_string("#%d %s %s", "record_index", "seller_name", "seller_product_id")


def report_lines(results: DataFrame) -> DataFrame:
    """``section, record_index, part, line``: the lines of all sections."""
    nearest = F.format_string(" (nearest %d at %.3f)", F.col("match_id"), F.col("score").cast("double"))
    inserted = F.concat(
        F.format_string('%s → product %d "%s"', _who(), F.col("product_id"), F.col("identity")),
        F.when(F.col("match_id").isNotNull(), nearest).otherwise(""),
    )
    flags = F.array_join(F.transform("flags", lambda f: F.concat_ws(": ", f["field"], f["reason"])), "; ")
    single = [
        ("rejected", F.col("outcome") == "rejected", F.concat(_who(), F.lit(": "), F.col("reason"))),
        ("failed", F.col("outcome") == "failed", F.concat(_who(), F.lit(": "), F.col("err_kind"), F.lit(": "), F.col("reason"))),
        ("suspicious", F.size("flags") > 0, F.concat(_who(), F.lit(": "), flags)),
        ("inserted", F.col("outcome") == "inserted", inserted),
    ]
    row = lambda section, part, line: F.struct(F.lit(section).alias("section"), part.alias("part"), line.alias("line"))
    ones = [F.when(test, row(name, F.lit(0), line)) for name, test, line in single]
    product = F.format_string("#%d product %d: ", "record_index", "product_id")
    change = lambda c, k: row(
        "changes", k, F.concat(product, c["field"], F.lit(": "), F.coalesce(F.nullif(c["old"], F.lit("")), F.lit("(null)")), F.lit(" → "), c["new"])
    )
    note = lambda n, k: row("notes", k, F.concat(product, n))
    every = F.concat(F.filter(F.array(*ones), lambda x: x.isNotNull()), F.transform("changes", change), F.transform("notes", note))
    return results.select("record_index", F.explode(every).alias("e")).select("e.section", "record_index", "e.part", "e.line")


def decision_lines(results: DataFrame) -> DataFrame:
    """``record_index, line``: one line for each record with its decision."""
    index = F.format_string("#%d", "record_index")
    match = F.format_string(
        '%s %s %s %.3f → product %d "%s", nearest %d "%s"', index, F.col("outcome"), F.col("kind"), F.col("score").cast("double"),
        F.col("product_id"), F.col("identity"), F.coalesce("match_id", F.lit(0)), F.coalesce("match_identity", F.lit("")),
    )
    line = (
        F.when(F.col("outcome") == "rejected", F.concat(index, F.lit(" rejected: "), F.col("reason")))
        .when(F.col("outcome") == "failed", F.concat(index, F.lit(" failed: "), F.col("err_kind"), F.lit(": "), F.col("reason")))
        .when(F.col("outcome") == "existing", F.format_string("%s existing → product %d", index, F.col("product_id")))
        .otherwise(match)
    )
    return results.select("record_index", line.alias("line"))


def text_report(
    results: DataFrame, threshold: float, mode: str, catalog_size: int, dry_run: bool = False, verbose: bool = False, most_lines: int = 1000,
    stopped: tuple[str, int, str] | None = None,
) -> str:
    """The report as text.  The driver gets at most ``most_lines`` lines of each section.

    ``stopped``: the stage, the record and the reason where a run ended early; ``results`` has what it did before.
    """
    counts = summary(results).first().asDict()
    out = ["Ingest report" + (" (DRY RUN: nothing written)" if dry_run else "")]
    out.append(f"threshold {threshold:.3f}, update {mode}, catalog {catalog_size} products")
    shown = ("inserted", "linked", "existing", "rejected", "failed", "suspicious")
    out.append(f"records {counts['records']}: " + ", ".join(f"{k} {counts[k]}" for k in shown) + f", products updated {counts['updated']}")
    if stopped:
        out.append("stopped: {} at record {}: {}; {} records processed".format(*stopped, counts["records"]))
    lines = report_lines(results)
    sizes = {r["section"]: r["count"] for r in lines.groupBy("section").count().collect()}
    for section in SECTIONS:
        if section in sizes:
            out += ["", f"{section} ({sizes[section]}):"]
            part = lines.filter(F.col("section") == section).orderBy("record_index", "part").limit(most_lines)
            out += [f"  {r['line']}" for r in part.collect()]
    if verbose and counts["records"]:
        out += ["", "decisions:"]
        out += [f"  {r['line']}" for r in decision_lines(results).orderBy("record_index").limit(most_lines).collect()]
    return "\n".join(out) + "\n"


def write_report(results: DataFrame, path: str) -> None:
    """All lines of all sections, a folder for each, without going through the driver."""
    lines = report_lines(results).repartitionByRange("section", "record_index", "part").sortWithinPartitions("section", "record_index", "part")
    lines.select("section", F.col("line").alias("value")).write.partitionBy("section").text(path)


def json_records(records: DataFrame) -> DataFrame:
    """``record_index, line``: records as JSON without empty fields."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    fields = [("id", "seller_product_id"), ("sellerName", "seller_name"), ("name", "name"), ("brand", "brand"), ("category", "category"),
              ("identity", "identity"), ("reason", "reason")]
    row = F.struct(F.col("record_index").alias("index"), *[blank(c).alias(n) for n, c in fields], F.when(F.size("flags") > 0, F.col("flags")).alias("flags"))
    return records.select("record_index", F.to_json(row).alias("line"))
