"""Which sheet of a workbook holds the rules of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import metric
from ..functions.text import norm
from ..lookups import FORM_HINTS

TEXT_HEAD, SHEET_HEAD, NAME_HEAD = 6000, 10000, 2000


def suggest(documents: DataFrame, sheets: DataFrame) -> DataFrame:
    """Ranks the sheets for each document: doc_id, sheet, score, rank. documents: doc_id, workbook, full_text; sheets: workbook, sheet, sheet_text. The heads of the texts count, then the sheet's name, then phrases of the form that the name is like."""
    ts = metric("token_set")
    pairs = documents.select("doc_id", "workbook", norm("full_text").alias("d")).join(sheets.select("workbook", "sheet", norm("sheet_text").alias("s"), norm("sheet").alias("n")), "workbook")
    base = ts(F.substring("d", 1, TEXT_HEAD), F.substring("s", 1, SHEET_HEAD)) * 0.45 + ts(F.substring("d", 1, NAME_HEAD), F.col("n")) * 0.10
    scored = pairs.withColumn("score", base)
    for i, (form, phrases) in enumerate(FORM_HINTS.items()):
        like = scored.withColumn(f"__l{i}", ts(F.col("n"), F.upper(F.lit(form))) > 80)
        bonus = sum(F.when(F.contains("d", F.lit(p.upper())), 20).otherwise(0) + F.when(F.contains("s", F.lit(p.upper())), 5).otherwise(0) for p in phrases)
        scored = like.withColumn("score", F.col("score") + F.when(F.col(f"__l{i}"), bonus).otherwise(0)).drop(f"__l{i}")
    out = scored.select("doc_id", "sheet", F.round(F.least("score", F.lit(100.0)), 2).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "sheet")))
