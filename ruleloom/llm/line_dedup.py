"""Line deduplication by winnowing, in DataFrame functions only.

The least line hash of each window of RUN_LINES lines (the last of equal ones) is a fingerprint; only the positions so
selected are stored, and equal runs of as many lines are sure to hold equal ones. Positions are joined on their
fingerprint. Those that others share are extended to both sides, a line at a time, as long as an earlier place holds the
same lines: of all that agree only the first is met, so that a frequent line costs no pairs. Whatever a later place has in
common with an earlier one, for RUN_LINES lines or more, is deleted there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

RUN_LINES = 2


#: White space that doesn't count at the ends of a line.
BLANK = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(rows: DataFrame, text: Column, run: int) -> DataFrame:
    """row_id, doc_id, at (numbers of the lines that aren't blank), h (128-bit hashes of them), of documents with as many lines as a run."""
    numbered = F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANK)).alias("l")))
    held = rows.select("row_id", "doc_id", F.filter(numbered, lambda x: x["l"] != "").alias("lines")).filter(F.size("lines") >= run)
    return held.select("row_id", "doc_id", F.transform("lines", lambda x: x["i"]).alias("at"), F.transform("lines", lambda x: F.unhex(F.md5(x["l"]))).alias("h"))


def positions(lines: DataFrame, run: int) -> DataFrame:
    """row_id, p, fp: the winnowed positions. p counts lines that aren't blank."""
    marked = F.transform("h", lambda x, i: F.struct(x.alias("h"), (-i).alias("back")))
    least = F.transform(F.sequence(F.lit(0), F.size("h") - run), lambda s: F.array_min(F.slice(F.col("marked"), s + 1, F.lit(run))))
    return lines.withColumn("marked", marked).select("row_id", F.explode(F.array_distinct(least)).alias("x")).select("row_id", (-F.col("x.back")).alias("p"), F.col("x.h").alias("fp"))


def extended(lines: DataFrame, shared: DataFrame, run: int) -> DataFrame:
    """row_id, doc_id, s, key, at: runs of lines to both sides of the shared positions (row_id, p), each once; at: their line numbers."""
    per_row = shared.groupBy("row_id").agg(F.collect_set("p").alias("ps"))
    starts = F.flatten(F.transform("ps", lambda p: F.sequence(F.greatest(p - (run - 1), F.lit(0)), F.least(p, F.size("h") - run))))
    each = lines.hint("merge").join(per_row, "row_id").select("row_id", "doc_id", "at", "h", F.explode(F.array_distinct(starts)).alias("s"))
    joined = F.array_join(F.transform(F.slice("h", F.col("s") + 1, F.lit(run)), F.hex), "")
    return each.select("row_id", "doc_id", "s", F.unhex(F.md5(joined)).alias("key"), F.slice("at", F.col("s") + 1, F.lit(run)).alias("at"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN_LINES) -> DataFrame:
    """Deletes runs of run or more lines that an earlier document, or an earlier part of the same one, holds already.

    Returns the input's rows, with all columns and the text without those lines, and n_lines and n_removed (columns of
    these names in the input are replaced, whatever the case of their letters). Lines are compared without BLANK at their
    ends; lines with nothing else are neither compared nor deleted, and don't part a run. Shorter documents than a run
    keep all of their lines. A null text stays null, and has one line. Earlier is by id, nulls first, then by place in the
    input; so of repeated rows the first stays whole. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    rows = written(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*names).alias("doc")), "rows")
    lines = written(hashed_lines(rows.withColumn("doc_id", F.col("doc")[id_col]), F.col("doc")[text_col], run), "lines")
    chosen = written(positions(lines, run), "positions")

    # tables that grow with the corpus are never broadcast
    repeated = written(chosen.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "fingerprints")
    shared = chosen.hint("merge").join(repeated.hint("merge"), "fp").select("row_id", "p")
    runs = written(extended(lines, shared, run), "runs")
    for done in (lines, chosen, repeated):
        discard(done)
    place = F.struct("doc_id", "row_id", "s")
    firsts = runs.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    firsts = written(firsts, "firsts")
    later = written(runs.hint("merge").join(firsts.hint("merge"), "key").filter(place > F.col("first")).select("row_id", "at"), "later")
    for done in (runs, firsts):
        discard(done)
    gone = later.groupBy("row_id").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("gone"))

    joined = rows.hint("merge").join(gone, "row_id", "left").withColumn("split", _lines(F.col("doc")[text_col]))
    # lines and deleted numbers in one sorted array: a line stays unless its number stands right before it
    marks = F.concat(
        F.transform("split", lambda x, i: F.struct(i.alias("i"), F.lit(1).alias("k"), x.alias("l"))),
        F.transform("gone", lambda i: F.struct(i.alias("i"), F.lit(0).alias("k"), F.lit("").alias("l"))),
    )
    sorted_ = joined.withColumn("marks", F.when(F.col("gone").isNotNull(), F.array_sort(marks)))
    stays = F.filter("marks", lambda x, j: (x["k"] == 1) & ((j == 0) | (F.get("marks", j - 1)["i"] != x["i"])))
    left = F.array_join(F.transform(stays, lambda x: x["l"]), "\n")
    fields = [F.when(F.col("gone").isNull(), F.col("doc")[c]).otherwise(left).alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in names]
    return sorted_.select(*fields, F.size("split").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
