"""A corpus pipeline: quality, exact copies, near copies, mixing, packing. Each stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ruleloom.llm.exact_dedup import keep_one
from ruleloom.llm.line_quality import fit, keep_good
from ruleloom.llm.mixing import keep_sampled
from ruleloom.llm.near_dedup import keep_one_of_each
from ruleloom.llm.packing import pack_documents
from ruleloom.llm.queries import table, vocabulary
from ruleloom.llm.shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model scores below a half go."""
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest id stays."""
    return keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the least id stays."""
    return keep_one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics come nearer to each other in weight."""
    return keep_sampled(docs, repeat=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents in sequences of 2048 tokens."""
    return pack_documents(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [("line quality", quality), ("exact dedup", exact_copies), ("near dedup", near_copies), ("mixing", mixture), ("packing", packing)]

#: SQL can express neither the models nor the tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
