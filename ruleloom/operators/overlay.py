"""Where a result is shown: the printed label, found among the page's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import center_x
from ..functions.text import alnum_norm
from .assign import greedy

STEM_LEAST = 4


def label_variants(*labels: Column | str) -> Column:
    """The printed forms that a label may have: whole, before a dash, before a part's name, before what tells how to tick; each once by its letters and digits."""

    def forms(text: Column) -> Column:
        tidy = lambda s: F.regexp_replace(s, r"[ \-–—,:()]+$", "")
        stems = [F.trim(F.split(text, sep, 2)[0]) for sep in (" - ", " – ", " — ")]
        part = F.when(text.rlike(r"(?i)\b(?:FIRST|MIDDLE|LAST|SUFFIX|TITLE)\b"), tidy(F.split(text, r"(?i)\b(?:FIRST|MIDDLE|LAST|SUFFIX|TITLE)\b", 2)[0]))
        asked = tidy(F.split(text, r"(?i)\bCHECK\s+ALL\b|\bCHOOSE\s+ONE\b|\(ENTER\s+THE\s+HIGHEST", 2)[0])
        rest = F.filter(F.array(*stems, part, asked), lambda v: v.isNotNull() & (F.length(alnum_norm(v)) >= STEM_LEAST))
        return F.concat(F.array(text), rest)

    given = F.filter(F.array(*(F.trim(F.col(c) if isinstance(c, str) else c) for c in labels)), lambda t: F.coalesce(t, F.lit("")) != "")
    all_ = F.filter(F.flatten(F.transform(given, forms)), lambda v: alnum_norm(v) != "")
    keys = F.transform(all_, alnum_norm)
    return F.filter(all_, lambda v, i: F.array_position(keys, alnum_norm(v)) == i + 1)


def label_targets(results: DataFrame, lines: DataFrame) -> DataFrame:
    """Each result's place: doc_id, result_id, label, page, bbox. A line goes to one result.

    results: doc_id, result_ord, result_id, di_key, item, page, bbox. A variant fits a line that holds it; longer variants
    weigh more, the result's own page most, and among repeats the line beside where the value was found.
    """
    wanted = results.select("doc_id", "result_ord", "result_id", F.col("page").alias("p"), center_x("bbox").alias("hx"), F.col("bbox").isNotNull().alias("hinted"), F.posexplode(label_variants("di_key", "item")).alias("v_ord", "v"))
    l = lines.select("doc_id", "page", "line_ord", "bbox", alnum_norm("text").alias("t"))  # noqa: E741
    met = wanted.withColumn("n", alnum_norm("v")).join(l, "doc_id").filter(F.contains("t", F.col("n")))
    score = F.length("n") * 10.0 + F.when(F.col("p") == F.col("page"), 10000.0).otherwise(0.0) - F.when(F.col("hinted"), 1000 * F.pow(F.col("bbox.x0") - F.col("hx"), 2)).otherwise(0.0)
    options = met.select("doc_id", "result_ord", "result_id", "v_ord", F.col("v").alias("label"), "page", "line_ord", "bbox", score.alias("score"))
    best = greedy(options, ["doc_id"], "result_ord", "line_ord", [("result_ord", True), ("score", False), ("v_ord", True), ("page", True), ("line_ord", True)])
    return best.select("doc_id", "result_id", "label", "page", "bbox")


def overlay(results: DataFrame, lines: DataFrame, statuses: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rectangles to draw for results of the enabled statuses, with pages from 0, and an audit for each document: how many results, how many placed."""
    shown = results.filter(F.col("status").isin(*statuses))
    placed = label_targets(shown, lines).join(shown.select("doc_id", "result_id", "status"), ["doc_id", "result_id"]).withColumn("page_index", F.greatest(F.col("page") - 1, F.lit(0)))
    audit = shown.join(placed.select("doc_id", "result_id", F.lit(True).alias("hit")), ["doc_id", "result_id"], "left").groupBy("doc_id").agg(F.count("*").alias("eligible"), F.count("hit").alias("located"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("result_id")))).alias("missing"))
    return placed, audit
