"""Exact deduplication by deterministic block naming.

Texts are cut into fixed-size blocks, the distinct blocks of the corpus are sorted and numbered, and adjacent pairs of
numbers are numbered again, level by level, until each text is one integer. Two texts have one integer exactly when all
of their blocks agree, so no hash decides equality. Blocks travel once (for numbering); documents meet the numbers over
a digest whose uniqueness on the distinct blocks is checked first, and over the blocks themselves if it ever fails.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, written

BLOCK_CHARS = 8192


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes empty. All-ASCII texts take the built-in's fast path."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def blocks_of(text: Column, block_chars: int) -> Column:
    return F.when(F.length(text) <= block_chars, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))


def _numbered(distinct: DataFrame, keys: list[str], label: str, near: DataFrame | None = None) -> DataFrame:
    """Gives each row of a table of distinct keys an integer, in sort order within its partition."""
    return written(distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), label, near)


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each input row: row_id, doc_id, n_blocks, name, text_sha256. (n_blocks, name) is equal exactly for equal normalised texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm"))
    cut = rows.select("doc_id", "norm", blocks_of(F.col("norm"), block_chars).alias("blocks"))

    def digest(c: Column) -> Column:
        return F.unhex(F.sha2(c, 256))

    distinct = cut.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.lit(1).alias("one")).drop("one")
    named = distinct.sortWithinPartitions("block").select(digest(F.col("block")).alias("key"), F.monotonically_increasing_id().alias("name"))
    names = written(named, "block-names")
    by_digest = names.groupBy("key").count().filter("count > 1").isEmpty()
    if not by_digest:
        names = _numbered(distinct.withColumnRenamed("block", "key"), ["key"], "block-names")

    keys = F.transform("blocks", digest) if by_digest else F.col("blocks")
    sha = F.when(F.size("blocks") == 1, F.lower(F.hex(F.col("keys")[0]))).otherwise(F.sha2("norm", 256)) if by_digest else F.sha2("norm", 256)
    exploded = (
        cut.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "norm", "blocks", keys.alias("keys"))
        .select("row_id", "doc_id", F.size("blocks").alias("n_blocks"), sha.alias("text_sha256"), "keys")
        .select("row_id", "doc_id", "n_blocks", F.posexplode("keys").alias("pos", "key"), "text_sha256")
        .withColumn("text_sha256", F.when(F.col("pos") == 0, F.col("text_sha256")))
    )
    level = written(exploded.join(names, "key").select("row_id", "doc_id", "n_blocks", "pos", "name", "text_sha256"), "level-0")
    single = level.filter("n_blocks = 1").select("row_id", "doc_id", "n_blocks", "name", "text_sha256")
    heads = level.filter("n_blocks > 1 and pos = 0").select("row_id", "doc_id", "n_blocks", "text_sha256")
    parts = level.filter("n_blocks > 1").select("row_id", "pos", "name")
    longest = level.agg(F.max("n_blocks")).first()[0] or 1
    step = 0
    while longest > 1:
        step += 1
        pairs = parts.groupBy("row_id", F.expr("pos div 2").cast("int").alias("at")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")
        )
        pairs = written(pairs, f"pairs-{step}", level)
        pair_names = _numbered(pairs.select("left", "right").distinct(), ["left", "right"], f"pair-names-{step}", pairs)
        parts = pairs.join(pair_names, ["left", "right"]).select("row_id", F.col("at").alias("pos"), "name")
        longest = (longest + 1) // 2
    return single.unionByName(heads.join(parts.drop("pos"), "row_id").select("row_id", "doc_id", "n_blocks", "name", "text_sha256")) if step else single


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Groups texts that are equal after lower-casing A-Z; of each group the row with the largest id stays.

    Returns one row for each input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text). A null
    text counts as empty. Of repeated rows with one id and text exactly one is kept; a null id is smaller than any other.
    An empty table gives an empty result. Other columns of the input are not read, whatever their names.
    """
    named = name_documents(docs, id_col, text_col, block_chars)
    groups = named.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_id")).alias("keep"))
    # written, the groups of several rows meet their members in a plain join, whose hot side Spark can split
    several = written(groups.filter("group_size > 1"), "groups")
    keep = F.coalesce("keep", F.struct("doc_id", "row_id"))
    return named.join(several, ["n_blocks", "name"], "left").select(
        "doc_id", keep["doc_id"].alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (F.col("row_id") == keep["row_id"]).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all of their columns, whatever these are called. Repeated rows with one id and text stay once."""
    found = written(exact_dedup(docs, id_col, text_col), "exact-dedup")
    key, sha, kept_sha = (fresh(docs, c) for c in ("kept_id", "sha_of_text", "kept_sha"))
    kept = found.filter("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(kept_sha))
    same = F.col(id_col).eqNullSafe(F.col(key))
    if found.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.join(kept, same, "left_semi")
    marked = docs.withColumn(sha, F.sha2(ascii_lower(F.col(text_col)), 256))
    return marked.join(kept, same & (F.col(sha) == F.col(kept_sha)), "left_semi").dropDuplicates([id_col, sha]).drop(sha)
