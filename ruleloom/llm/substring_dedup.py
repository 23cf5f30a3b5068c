"""Incremental substring deduplication over a log-structured fingerprint index.

Every window of 13 words has one fingerprint: the least hash among its 4-word grams. Equal windows have equal
fingerprints, and neighbouring windows mostly share theirs, so the index holds about a sixth of the windows' number and
still misses none. Each batch of documents, in the order of their ids, becomes an immutable run of sorted fingerprints,
bucketed so that it is merge-joined with the older runs without a shuffle; runs of one level are compacted by a merge.
Only windows whose fingerprint was met in two documents are then verified: their 128-bit hashes are compared, and a
window goes where an equal one starts in a document with a smaller id.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import discard, new_path, remove, shuffles_dropped, small_batches, tidied, written

WINDOW = 13
GRAM = 4
BATCHES = 4
FANOUT = 2
_ODD = [int(x) | 1 for x in np.random.default_rng(20240101).integers(0, 2**63, 64)]


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and \\x09-\\x0D, unchanged; bytes.split() parts at just these."""
    return (text or "").encode().split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grams(h: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """A 64-bit hash of each n consecutive word hashes."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j : j + len(out)] * np.uint64(_ODD[(first + j) % len(_ODD)])
    return _mixed(out)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    width, out = 1, x
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def fingerprints(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The fingerprint of each window of a document's word hashes."""
    return _sliding_min(_grams(hashes, gram), window - gram + 1) if len(hashes) >= window else np.zeros(0, np.uint64)


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def sketch(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text -> doc_id, n_words, sha (of all words joined by a space), fps (distinct fingerprints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, fps = [], [], []
            for text in batch["text"]:
                words = words_of(text.as_py())
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).digest())
                fps.append(np.unique(fingerprints(_hashed(words), window, gram)).view(np.int64) if len(words) >= window else ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "n_words", "sha", "fps"])

    return docs.mapInArrow(tidied(run), f"doc_id {_kind(docs)}, n_words long, sha binary, fps array<long>")


class FingerprintIndex:
    """Immutable runs (fp, first_doc), each sorted and bucketed by fp; a batch is one run, and FANOUT runs of a level become one of the next."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str, str]] = []  # level, table, path

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"run_{uuid.uuid4().hex}", new_path(self.spark, "run")
        with shuffles_dropped(self.spark):
            rows.write.option("compression", "zstd").option("path", path).bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        return name, path

    def add(self, sketches: DataFrame) -> DataFrame:
        """Takes in a batch; returns the fingerprints (fp) that it has in two documents, or shares with an earlier batch."""
        rows = sketches.select(F.explode("fps").alias("fp"), "doc_id")
        own, path = self._write(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")))
        run = self.spark.table(own)
        met = [run.filter("first_doc < last_doc").select("fp")]
        met += [run.select("fp").hint("merge").join(self.spark.table(older).select("fp"), "fp") for _, older, _ in self.runs]
        hits = written(reduce(DataFrame.unionByName, met).distinct(), "hits")
        self.runs.append((0, own, path))
        self._compact()
        return hits

    def _compact(self) -> None:
        level = 0
        while len(same := [r for r in self.runs if r[0] == level]) >= self.fanout:
            merged = self.spark.table(same[0][1]).select("fp", "first_doc", "last_doc")
            for _, name, _ in same[1:]:
                other = self.spark.table(name).select("fp", F.col("first_doc").alias("f"), F.col("last_doc").alias("l"))
                merged = merged.hint("merge").join(other, "fp", "full").select("fp", F.least("first_doc", "f").alias("first_doc"), F.greatest("last_doc", "l").alias("last_doc"))
            made = self._write(merged)
            for _, name, path in same:
                self._drop(name, path)
            self.runs = [r for r in self.runs if r not in same] + [(level + 1, *made)]
            level += 1

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, path)

    def close(self) -> None:
        for _, name, path in self.runs:
            self._drop(name, path)
        self.runs = []


def suspects(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, text, hot -> doc_id, text, starts and two 64-bit hashes of each window whose fingerprint is among hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[], [], []]
            for text, hot in zip(batch["text"], batch["hot"], strict=True):
                h = _hashed(words_of(text.as_py()))
                wanted = np.asarray(hot.values).view(np.uint64) if hot.is_valid else np.zeros(0, np.uint64)
                at = np.flatnonzero(np.isin(fingerprints(h, window, gram), wanted))
                a, b = (_grams(x, window, k)[at].view(np.int64) if len(at) else () for x, k in ((h, 8), (_mixed(h + np.uint64(1)), 32)))
                for column, values in zip(columns, (at, a, b), strict=True):
                    column.append(values)
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "text", "starts", "a", "b"])

    return rows.mapInArrow(tidied(run), f"doc_id {_kind(rows)}, text string, starts array<int>, a array<long>, b array<long>")


def cut(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text, gone (starts of windows that go) -> doc_id, sha (of all words), n_removed, kept_sha256, kept_text, gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, removed, sha, texts = [], [], [], []
            for text, gone in zip(batch["text"], batch["gone"], strict=True):
                words = words_of(text.as_py())
                edge = np.zeros(len(words) + 1, np.int64)
                if gone.is_valid:
                    starts = np.asarray(gone.values)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                covered = np.cumsum(edge)[:-1] > 0
                kept = b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c)
                whole.append(hashlib.sha256(b" ".join(words)).digest())
                removed.append(int(covered.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(whole, pa.binary()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string()), batch["gone"]], names=["doc_id", "sha", "n_removed", "kept_sha256", "kept_text", "gone"]
            )

    return rows.select("doc_id", "text", "gone").mapInArrow(tidied(run), f"doc_id {_kind(rows)}, sha binary, n_removed long, kept_sha256 string, kept_text string, gone array<int>")


def _batches(originals: DataFrame, sketches: DataFrame, batches: int) -> Iterator[DataFrame]:
    """The rows of originals in parts, by rising ranges of doc_id."""
    bounds = sorted({int(x) for x in sketches.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)}) if batches > 1 else []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = originals if low is None else originals.filter(F.col("doc_id") > low)
        yield part if high is None else part.filter(F.col("doc_id") <= high)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """Removes each word that is covered by a window of words that also starts in a document with a smaller id.

    Returns one row for each input row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), and
    gone, the starts of the removed windows (null where none goes, or where the document is a whole copy, all of whose
    words go). Windows are judged on the input. A null text has no words; texts shorter than a window keep all of theirs;
    ids are whole numbers or texts, and a null id
    counts as smaller than any other; rows with one id don't remove each other's words, whether they are
    repeated or differ. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType
    whole = isinstance(kind, IntegralType)
    # a value below all others stands for a null id; other ids than numbers are told from it by a mark before them
    least = F.lit(-(2**63)) if whole else F.lit("0")
    key = F.col(id_col).cast("long") if whole else F.concat(F.lit("1"), F.col(id_col).cast("string"))
    rows = docs.select(F.coalesce(key, least).alias("doc_id"), F.col(text_col).alias("text"))
    sketches = written(sketch(rows, window, gram), "sketches")

    # whole copies: all windows of all but those with the smallest id go, and these need not be looked at
    firsts = written(sketches.filter(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("sha", "first"), "copied")
    marked = sketches.join(firsts, "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    originals = written(marked.filter(~F.col("copy") & (F.size("fps") > 0)).select("doc_id", "fps"), "originals")

    index, hot = FingerprintIndex(spark), None
    for part in _batches(originals, sketches, batches if whole else 1):
        hits = index.add(part)
        hot = hits if hot is None else hot.unionByName(hits)
    index.close()
    hot = written(hot.distinct(), "hot")

    met = written(originals.select("doc_id", F.explode("fps").alias("fp")).join(hot, "fp"), "met")
    discard(originals)
    per_doc = met.groupBy("doc_id").agg(F.collect_set("fp").alias("hot"))
    found = suspects(rows.join(per_doc, "doc_id").select("doc_id", "text", "hot"), window, gram)
    suspected = written(found.withColumn("row_id", F.monotonically_increasing_id()), "suspects")

    each = suspected.select("row_id", "doc_id", F.explode(F.arrays_zip("starts", "a", "b")).alias("w")).select("row_id", "doc_id", "w.starts", "w.a", "w.b")
    repeated = written(each.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("a", "b", "first"), "repeated")
    gone = written(each.join(repeated, ["a", "b"]).filter(F.col("doc_id") > F.col("first")).select("row_id", "starts"), "gone")
    discard(repeated)
    per_row = gone.groupBy("row_id").agg(F.array_sort(F.collect_list("starts")).alias("gone"))
    left = written(cut(suspected.select("row_id", "doc_id", "text").join(per_row, "row_id"), window).drop("kept_text"), "left").dropDuplicates(["doc_id", "sha"])

    nothing = hashlib.sha256(b"").hexdigest()
    out = marked.select("doc_id", "sha", "n_words", "copy").join(left, ["doc_id", "sha"], "left")
    return out.select(
        F.when(F.col("doc_id") != least, F.col("doc_id") if whole else F.expr("substring(doc_id, 2)")).cast(kind).alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(~F.col("copy"), F.col("gone")).alias("gone"),
    )
