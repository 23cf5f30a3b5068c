"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .line_quality import fit, quality_scores
from .mixing import mix
from .near_dedup import near_dedup
from .packing import CAPACITY, pack_documents
from .secret_scan import secret_scan
from .shared import written
from .substring_dedup import substring_dedup
from .vector_search import search
from .warc import archive_pages


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies on this machine; every executor has them at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op9_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "history_rank")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("gone")


def mixing_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token shares of every source and language in the mixture that op3 draws, as expected of its copies."""
    mixed = mix(table(spark, sf_dir, "documents"))
    each = mixed.select(F.explode(F.array(*(F.struct(F.lit(m).alias("marginal"), F.col(m).alias("value")) for m in ("source", "lang")))).alias("x"), "n_tokens", (F.col("n_tokens") * F.col("expected")).alias("e"))
    totals = each.groupBy("x.marginal", "x.value").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("e").alias("e"))
    whole = totals.groupBy(F.col("marginal").alias("m")).agg(F.sum("e").alias("all"))
    return totals.join(F.broadcast(whole), F.col("marginal") == F.col("m")).select("marginal", "value", "n_tokens", F.round(F.col("e") / F.col("all"), 6).alias("share"))  # two rows


def packing_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document that op4 packs: whether its pieces follow each other without a gap, all but the last as long as a sequence; and whether the sequences that hold them have neither gap nor overlap, nor more than the capacity."""
    pieces = written(op4_best_fit_packing(spark, sf_dir), "packed")
    in_sequence = Window.partitionBy("sequence_id").orderBy("offset")
    ends = F.coalesce(F.lag(F.col("offset") + F.col("length")).over(in_sequence), F.lit(0))
    sound = (F.col("offset") == ends) & (F.col("offset") + F.col("length") <= CAPACITY)
    in_document = Window.partitionBy("doc_id").orderBy("piece")
    before = F.coalesce(F.sum("length").over(in_document.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("piece"))) == 1
    cut = (F.col("start") == before) & (last | (F.col("length") == CAPACITY)) & (F.col("piece") == F.row_number().over(in_document) - 1)
    return pieces.withColumns({"sound": sound, "cut": cut}).groupBy("doc_id").agg(F.min("cut").alias("whole"), F.min("sound").alias("gapless"))


def vector_search_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 returns with a list for each 25 vectors, so that lists, graph and pruning decide, against all vectors compared: true neighbours, and whether nine tenths of them are returned."""
    vectors = table(spark, sf_dir, "embeddings")
    found, true = (written(search(vectors, per_list=n).select("query_id", "vec_id"), "found") for n in (25, 2**40))
    hits = true.join(found.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hits.agg(F.count("*").alias("neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("recalled"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_line_quality": op5_line_quality,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_vector_search": op8_vector_search,
    "op9_warc_index_merge": op9_warc_index_merge,
    "op10_substring_dedup": op10_substring_dedup,
    "mixing_marginals": mixing_marginals,
    "packing_invariants": packing_invariants,
    "vector_search_recall": vector_search_recall,
}
