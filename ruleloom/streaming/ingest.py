"""Audits of analyses as they arrive: a file stream, each content once, each batch through the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.layout import split_composites, structure
from ..plans.audit import audit
from ..sources import analysis


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Analysis files below path, each content once: doc_id, content_key and the parsed columns."""
    files = spark.readStream.format("text").option("wholetext", "true").load(path).select(F.input_file_name().alias("doc_id"), "value")
    return analysis.parse(files).dropDuplicates(["content_key"])


def audited(analyses: DataFrame, rules: DataFrame, sheet: str) -> DataFrame:
    kv, lines = analysis.kv_pairs(analyses), analysis.lines(analyses)
    documents = analyses.select("doc_id", F.lit(sheet).alias("sheet"), "full_text")
    return audit(rules, split_composites(structure(kv, lines)), documents, kv)


def run(spark: SparkSession, path: str, rules: DataFrame, sheet: str, out: str, state: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Writes the outcomes of each batch to out/batch=<id>; a batch that runs again after a failure replaces its own files."""

    def batch(analyses: DataFrame, epoch: int) -> None:
        rows = audited(analyses, rules, sheet)
        rows.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        if after:
            after(rows, epoch)

    return arrivals(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def counts(events: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Rows by window and keys, for streams with event times."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))
