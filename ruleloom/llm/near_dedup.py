"""Near-duplicate detection: DartMinHash signatures, banded joining, exact verification, connected components.

Texts with one sequence of words are one node. Nodes that share a band's hash share a bucket. In a bucket only its most
popular node is compared with the others, not all with all, and a comparison is spared where components already join the
two. Of what is then still apart, small buckets compare all pairs; the members of large ones go through an exact join on
the rarest shingles of each text (prefixes as long as the similarity asks for, with bounds by length and place), which
finds every pair that can be as similar as asked for without pairing what merely shares a bucket. Every comparison takes
the weighted Jaccard similarity of the whole texts' five-word shingles, counted as often as they occur.
"""

from __future__ import annotations

import hashlib
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import merged
from .dart_minhash import band_hashes, mixed, signatures
from .shared import fresh, small_batches, tidied, written

SHINGLE = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 a pair shares no bucket with a probability of 3e-6.
BANDS, ROWS = 42, 6
FIRST_BANDS = 8
SMALL_BUCKET = 8  # of those the pairs are compared one by one; what larger ones hold goes through the exact join
SIZE_STEP = 1.05  # ratio of the classes of length in that join
AT_ONCE = 150_000  # shingles, and tenths of darts, that are worked on together
_ODD = [np.uint64(int(x) | 1) for x in np.random.default_rng(7).integers(0, 2**63, 16)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def shingles(words: list[bytes], n: int) -> Counter:
    """Runs of n words with their counts; a shorter text is one shingle."""
    if len(words) < n:
        return Counter([tuple(words)]) if words else Counter()
    return Counter(zip(*(words[j:] for j in range(n)), strict=False))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard; two texts without words are alike."""
    if len(a) > len(b):
        a, b = b, a
    least = sum(min(n, b[x]) for x, n in a.items() if x in b)
    most = a.total() + b.total() - least
    return least / most if most else 1.0


def _elements(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles and their counts."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        total += h[j : j + len(total)] * _ODD[j]
    return np.unique(mixed(total), return_counts=True)


def bands_of(texts: list[list[bytes]], n: int, bands: int, rows: int, seed: int) -> list:
    """Band hashes of each list of words; none for a text without words."""
    out: list = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> None:
        if held:
            sets = np.repeat(np.arange(len(held)), [len(e) for e, _ in held])
            signed = signatures(np.concatenate([e for e, _ in held]), sets, np.concatenate([c for _, c in held]).astype(float), len(held), bands * rows, seed)
            out.extend(band_hashes(signed, bands, rows).view(np.int64))
            held.clear()

    for words in texts:
        if not words:
            flush()
            out.append(())
            continue
        held.append(_elements(words, n))
        size += len(held[-1][0]) + bands * rows
        if size >= AT_ONCE:
            flush()
            size = 0
    flush()
    return out


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text -> doc_id, digest (of the words), packed (the words, compressed), bands."""
    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [words_of(t.as_py()) for t in part["text"]]
                whole = [b" ".join(w) for w in texts]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([hashlib.blake2b(w, digest_size=16).digest() for w in whole], pa.binary()), pa.array([pack.compress(w) for w in whole], pa.binary()), pa.array(bands_of(texts, shingle, BANDS, ROWS, 1), pa.list_(pa.int64()))],
                    names=["doc_id", "digest", "packed", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidied(run), f"doc_id {kind}, digest binary, packed binary, bands array<long>")


def tokens_of(texts: DataFrame, shingle: int) -> DataFrame:
    """node, packed -> node, size, tokens: the shingles as a set, in which a shingle's second occurrence is another token than its first."""

    def tokens(words: list[bytes]) -> np.ndarray:
        elements, counts = _elements(words, shingle)
        again = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return mixed(np.repeat(elements, counts) + again.astype(np.uint64) * _ODD[0]).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found = [tokens(unpack.decompress(p.as_py()).split()) for p in part["packed"]]
                yield pa.RecordBatch.from_arrays([part["node"], pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "size", "tokens"])

    return texts.select("node", "packed").mapInArrow(tidied(run), "node long, size long, tokens array<long>")


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """a, b -> the pairs whose whole texts are as similar as least, or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, known = zstandard.ZstdDecompressor(), OrderedDict()

        def of(node: int, packed: pa.Scalar) -> Counter:
            if node not in known:
                known[node] = shingles(unpack.decompress(packed.as_py()).split(), shingle)
                if len(known) > 16:
                    known.popitem(last=False)
            known.move_to_end(node)
            return known[node]

        for batch in batches:
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            alike = [similarity(of(x, p), of(y, q)) >= least for x, y, p, q in zip(a, b, batch["pa"], batch["pb"], strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(alike)) for c in (batch["a"], batch["b"])], names=["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("pa"))
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("pb"))
    # pairs grow with the corpus, so they are never broadcast
    return pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(tidied(run), "a long, b long")


def buckets(signed: DataFrame) -> DataFrame:
    """node, bands -> bucket, band, node of the buckets with several nodes."""
    each = signed.select("node", F.posexplode("bands").alias("band", "bucket"))
    several = each.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return each.join(several, "bucket").select("bucket", "band", "node", "n")


def apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their components, of those buckets that still hold several components."""
    now = members.join(labels, "node")
    split = now.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).filter("low < high").select("bucket", "size")
    return now.join(split, "bucket")


def star_pairs(members: DataFrame, labels: DataFrame, popularity: DataFrame, near: DataFrame) -> DataFrame:
    """Each bucket's leader with each member outside its component."""
    now = written(apart(members.select("bucket", "node"), labels).join(popularity, "node").select("bucket", "node", "comp", "popular"), "apart", near)
    leaders = now.groupBy("bucket").agg(F.max(F.struct("popular", "node", "comp")).alias("lead"))
    # written, so that the members of a hot bucket meet its leader in a plain join, which Spark can split
    leaders = written(leaders.select("bucket", F.col("lead.node").alias("leader"), F.col("lead.comp").alias("lead_comp")), "leaders", now)
    others = written(now.join(leaders, "bucket").filter("comp <> lead_comp").select("bucket", "node", "leader"), "others", now)
    return others.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def small_pairs(members: DataFrame, labels: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs across components within the small buckets, and the members of the large ones."""
    now = written(apart(members.select("bucket", "node"), labels), "apart", near)
    small = now.filter(F.col("size") <= SMALL_BUCKET).select("bucket", "node", "comp")
    other = small.select("bucket", F.col("node").alias("b"), F.col("comp").alias("other"))
    pairs = small.join(other, "bucket").filter("node < b and comp <> other").select(F.col("node").alias("a"), "b").distinct()
    return pairs, now.filter(F.col("size") > SMALL_BUCKET).select("bucket", "node")


def prefix_pairs(nodes: DataFrame, labels: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """All pairs of nodes across components that can be as similar as least, and few others.

    With each text's tokens sorted by rarity, a pair of sizes n and m and a similarity of t shares t / (1 + t) * (n + m)
    tokens, so that its first common token stands early in both: at place i of the one, m is at most (n - i) * (1 + t) / t - n.
    Texts meet over tokens that stand so early, the longer one (probe) asking for sizes up to its own.
    """
    tokens = written(tokens_of(texts.join(nodes, "node"), shingle), "tokens")
    each = tokens.select("node", "size", F.explode("tokens").alias("token"))
    shared = written(each.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    sorted_ = each.hint("merge").join(shared, "token").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("s"))
    # the tokens of no other text come first; what is left of the first (1 - least) of all places holds shared ones
    own = F.col("size") - F.size("s")
    wide = F.greatest(F.lit(0), (F.col("size") + 1 - F.ceil(F.col("size") * least - 1e-6) - own).cast("int"))
    early = sorted_.select("node", "size", own.alias("own"), F.posexplode(F.slice("s", F.lit(1), wide)).alias("j", "x"))
    place = F.col("own") + F.col("j")
    cap = F.floor((F.col("size") - place) * ((1 + least) / least) - F.col("size") + 1e-6)
    early = early.select("node", "size", F.col("x.token").alias("token"), cap.alias("cap"))
    entries = written(early.join(labels, "node").select("token", "node", "size", "cap", "comp"), "prefixes")

    def step(size: F.Column) -> F.Column:
        return F.floor(F.log(size.cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")

    held = entries.filter("cap >= size").withColumn("step", step(F.col("size")))
    low, high = F.ceil(F.col("size") * least - 1e-6), F.least("size", "cap")
    probes = entries.filter(low <= high).withColumn("step", F.explode(F.sequence(step(low), step(high))))
    bounds = held.groupBy("token", "step").agg(F.min("size").alias("shortest"), F.max("cap").alias("reach"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    met = probes.join(bounds.hint("merge"), ["token", "step"]).filter("shortest <= cap and reach >= size and (low <> comp or high <> comp)")
    met = written(met.select("token", "step", F.col("node").alias("x"), F.col("size").alias("n"), F.col("cap").alias("most"), F.col("comp").alias("mine")), "probes")
    fits = (F.col("size") <= F.col("most")) & (F.col("n") <= F.col("cap")) & (F.col("comp") != F.col("mine")) & ((F.col("size") < F.col("n")) | (F.col("node") < F.col("x")))
    found = held.hint("merge").join(met, (held["token"] == met["token"]) & (held["step"] == met["step"]) & fits)
    return found.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()


def link(signed: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """node, bands -> node, comp for the nodes that share a bucket with another."""
    members = written(buckets(signed), "members")
    labels = written(members.select("node").distinct().select("node", F.col("node").alias("comp")), "labels", members)
    involved = written(texts.join(labels.select("node").hint("merge"), "node"), "involved")
    popularity = written(members.groupBy("node").agg(F.sum("n").alias("popular")), "popularity", members)
    done = None

    def compare(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        nonlocal done
        new = written(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs", members)
        if new.isEmpty():
            return labels
        done = new if done is None else done.unionByName(new)
        return merged(labels, verify(new, involved, shingle, least))

    # the first bands join most of a large group; the others then have less to compare
    for part in (members.filter(F.col("band") < FIRST_BANDS), members):
        labels = compare(star_pairs(part, labels, popularity, members), labels)
    pairs, large = small_pairs(members, labels, members)
    labels = compare(pairs, labels)
    large = written(apart(large, labels).select("node").distinct(), "large", members)
    if large.isEmpty():
        return labels
    pairs = written(prefix_pairs(large, labels, involved, shingle, least), "pairs", members)
    return labels if pairs.isEmpty() else merged(labels, verify(pairs, involved, shingle, least))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Classes of texts that links of that similarity or more join, directly or through others.

    Returns one row for each input row: doc_id, class_id (the least id of the class), class_size (rows), kept (true for
    exactly one row of each class, one with that id). Texts with the same words are always of one class, and so are all
    texts without words, null among them. Texts shorter than a shingle are one shingle. Ids are of any type that has an
    order; a null id counts as smaller than any other; repeated rows are rows of one class. An empty table gives an empty
    result; other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketches = written(sketch(rows, shingle).withColumn("row_id", F.monotonically_increasing_id()), "sketches")
    # the least of structs, in which null comes first
    firsts = sketches.groupBy("digest").agg(F.min("row_id").alias("row_id"), F.min(F.struct("doc_id")).alias("least_id"), F.count("*").alias("copies"))
    nodes = written(firsts.select(F.col("row_id").alias("node"), "digest", "least_id", "copies"), "nodes")
    one_each = sketches.join(nodes.select(F.col("node").alias("row_id")).hint("merge"), "row_id", "left_semi").withColumnRenamed("row_id", "node")
    labels = link(one_each.select("node", "bands"), one_each.select("node", "packed"), shingle, least)
    named = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classes = named.groupBy("comp").agg(F.min("least_id")["doc_id"].alias("class_id"), F.sum("copies").alias("class_size"))
    of_digest = written(named.join(classes, "comp").select("digest", "comp", "class_id", "class_size"), "classes", nodes)
    all_rows = written(sketches.select("row_id", "doc_id", "digest").join(of_digest, "digest"), "rows")
    stays = written(all_rows.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("comp").agg(F.min("row_id").alias("stays")), "stays", nodes)
    return all_rows.join(stays, "comp").select("doc_id", "class_id", "class_size", (F.col("row_id") == F.col("stays")).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_dedup keeps, with all of their columns, whatever these are called. Repeated rows with one id and one text stay once."""
    found = written(near_dedup(docs, id_col, text_col), "near-dedup")
    key, first = fresh(docs, "kept_id"), fresh(docs, "first_of_id")
    kept = found.filter("kept").select(F.col("doc_id").alias(key))
    left = docs.join(kept, F.col(id_col).eqNullSafe(F.col(key)), "left_semi")
    if found.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left
    # an id in several rows: its kept row is the one of its own class, of which there may be several texts; the least stays
    order = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_first())
    return left.withColumn(first, F.row_number().over(order)).filter(F.col(first) == 1).drop(first)
