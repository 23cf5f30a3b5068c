"""Results for readers: flat records, masking, JSON and Parquet, spreadsheets where a library for them is there."""

from __future__ import annotations

import importlib.util

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import mask_pii
from ..operators.outcome import is_technical, status_counts

FLAT = ("id", "status", "rule_id", "rule_type", "section", "subsection", "item", "matched", "match_score", "di_kind", "di_section", "di_key", "di_value", "page", "message")


def masked(rows: DataFrame, columns: list[str], on: bool = True) -> DataFrame:
    return rows.withColumns({c: mask_pii(c) for c in columns}) if on else rows


def masked_checks(checks: Column) -> Column:
    """Checks with their texts masked too."""
    return F.transform(checks, lambda c: F.struct(c["name"].alias("name"), c["status"].alias("status"), *(mask_pii(c[n]).alias(n) for n in ("expected", "actual", "message"))))


def flat_records(rows: DataFrame, mask: bool = True) -> DataFrame:
    """The rules' rows in fifteen columns, with the document."""
    kept = rows.filter((F.col("rule_type") != "UNMATCHED_FIELD") & (F.coalesce("rule_id", F.lit("")) != ""))
    return masked(kept.select("doc_id", *FLAT), ["di_value", "message"], mask)


def results(rows: DataFrame, mask: bool = True) -> DataFrame:
    """The reviewer's view: one row for each rule that can be checked, expected the item and actual the printed value."""
    out = rows.filter(~is_technical()).select(
        "doc_id", "id", "status", F.col("rule_type").alias("category"), "sheet", "section", "item", F.col("item").alias("expected"), F.col("di_value").alias("actual"), "message", "page", "bbox", "confidence",
        F.struct("rule_id", "rule_type", "subsection", "di_key", "match_score", "matched", "internal_status", "review_reason").alias("metadata"),
    )
    return masked(out, ["expected", "actual", "message"], mask)


def summary(rows: DataFrame) -> DataFrame:
    return status_counts(rows, ["doc_id"]).orderBy("doc_id", "status")


def result_rows(results: DataFrame) -> DataFrame:
    """Results with flat columns only: the box's corners as bbox_x0 to bbox_y1, and the metadata's fields."""
    corners = [F.col(f"bbox.{n}").alias(f"bbox_{n}") for n in ("x0", "y0", "x1", "y1")]
    return results.select(*(c for c in results.columns if c not in ("bbox", "metadata")), *corners, "metadata.*")


def comparison_documents(rows: DataFrame, mask: bool = True) -> DataFrame:
    """One object for each document: total, summary (rows by status) and records (the flat comparison, by id)."""
    records = flat_records(rows, mask)
    fields = [c for c in records.columns if c != "doc_id"]
    counts = records.groupBy("doc_id", "status").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("summary"), F.sum("n").alias("total"))
    listed = records.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("records"))
    return counts.join(listed, "doc_id").select("doc_id", "total", "summary", "records")


def write_documents(rows: DataFrame, path: str, mask: bool = True) -> None:
    """The comparison objects, a JSON line for each document."""
    comparison_documents(rows, mask).write.mode("overwrite").json(path)


def write_json(rows: DataFrame, path: str, mask: bool = True, legacy_mask: bool = False) -> None:
    """One JSON object for each row. Texts inside checks are masked as well, unless legacy_mask leaves them."""
    out = masked(rows, [c for c in ("di_value", "actual", "expected", "message") if c in rows.columns], mask)
    if mask and not legacy_mask and "checks" in rows.columns:
        out = out.withColumn("checks", masked_checks(F.col("checks")))
    out.write.mode("overwrite").json(path)


def write_parquet(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_workbook(rows: DataFrame, path: str) -> None:
    """Summary and comparisons of one document as a spreadsheet, on the driver; needs a spreadsheet library."""
    if not any(importlib.util.find_spec(m) for m in ("xlsxwriter", "openpyxl")):
        raise RuntimeError("writing spreadsheets needs xlsxwriter or openpyxl")
    import pandas as pd

    with pd.ExcelWriter(path) as writer:
        summary(rows).toPandas().to_excel(writer, index=False, sheet_name="Summary")
        flat_records(rows).toPandas().to_excel(writer, index=False, sheet_name="Comparisons")
        result_rows(results(rows)).toPandas().to_excel(writer, index=False, sheet_name="Results")
