"""Best-fit packing of tokenised documents into sequences, with large-item matching.

The plan is made from the number of pieces of each length alone, so it is as small as the capacity, whatever the corpus:
pieces above a third of the capacity are matched greedily (at most two such fit one sequence), smaller ones then go, by
falling length, into the tightest gap that takes them. Pieces find their place by their rank within their length; ranks
are counted within salted parts of a length, so that a length that most pieces share is still spread over many tasks.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, tidied, written

CAPACITY = 2048
LEAST_SALTS = 64
#: Chunks of text whose ids a worker remembers in each of two generations, and their longest length.
REMEMBERED, LONGEST_REMEMBERED = 100_000, 48
AT_ONCE = 2_000_000  # bytes of text that are worked on together

# The tokenizer's own description of what makes its ids those of the chunks between ASCII white space.
PARTS_AT_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ("NFC", "Replace", "Lowercase")
#: Words of these letters alone stay letters when normalised, so that punctuation after them is a token of its own. U+0130 is not among them: it becomes a letter and a mark.
LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}"
PARTED = rf"^(?P<core>[{LETTERS}]+)(?P<tail>[!-/:-@\[-`{{-~]*)$"


def parts_at_space(vocabulary: str) -> bool:
    """Whether the file describes a tokenizer that drops white space, so that no token spans it, and parts letters from what follows."""
    with open(vocabulary, encoding="utf-8") as f:
        said = json.load(f)
    first = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    kinds = tuple(n.get("type") for n in (said.get("normalizer") or {}).get("normalizers", ()))
    dropped = first.get("behavior") == "Removed" and first.get("invert") is True
    return dropped and first.get("pattern") == {"Regex": PARTS_AT_SPACE} and kinds == NORMALIZERS and said.get("post_processor") is None


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function texts -> all their ids in order, and how many ids each text has; exactly those of the tokenizer for the whole texts.

    Where the tokenizer drops white space, ids are those of the chunks between, each of which is encoded once for the texts
    at hand and remembered. Chunks not met before are first parted into letters and the punctuation at their end, which the
    tokenizer parts too. With any other tokenizer each whole text is encoded.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    young: dict[str, bytes] = {}
    old: dict[str, bytes] = {}

    def cut(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw = values.astype("<u4").tobytes()
        edges = (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *edges[:-1]], edges, strict=True)]

    def of_words(words: list[str]) -> list[bytes]:
        """Of words of LETTERS alone, each of which the tokenizer takes as one."""
        found = tokenizer.encode(" ".join(words), add_special_tokens=False)
        return cut(np.asarray(found.ids), np.searchsorted(np.asarray(found.word_ids), np.arange(len(words)), side="right"))

    def of_chunks(chunks: list[str]) -> list[bytes]:
        found = tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        ends = np.cumsum([len(c) + 1 for c in chunks])
        return cut(np.asarray(found.ids), np.searchsorted(np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids)), ends))

    def known(chunks: list[str], is_word: np.ndarray) -> list[bytes]:
        nonlocal young, old
        out = list(map(young.get, chunks))
        new = []
        for i, x in enumerate(out):
            if x is None:
                if (x := old.get(chunks[i])) is None:
                    new.append(i)
                else:
                    out[i] = young[chunks[i]] = x
        for some, learn in (([i for i in new if is_word[i]], of_words), ([i for i in new if not is_word[i]], of_chunks)):
            if some:
                for i, x in zip(some, learn([chunks[i] for i in some]), strict=True):
                    out[i] = x
                    if len(chunks[i]) <= LONGEST_REMEMBERED:
                        young[chunks[i]] = x
        if len(young) > REMEMBERED:
            young, old = {}, young
        return out

    def gathered(flat: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of flat, whose lengths are size, in the order of place; and their lengths."""
        lengths = size[place]
        shift = (np.cumsum(size) - size)[place] - (np.cumsum(lengths) - lengths)
        return flat[np.repeat(shift, lengths) + np.arange(lengths.sum())], lengths

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        named = words.flatten().dictionary_encode()
        chunks = named.dictionary
        split = pc.extract_regex(chunks, PARTED)
        whole = pc.is_null(split)
        core = pc.if_else(whole, chunks, pc.utf8_lower(pc.struct_field(split, "core")))
        parts = pa.concat_arrays([core, pc.fill_null(pc.struct_field(split, "tail"), "")]).dictionary_encode()
        two = np.asarray(parts.indices, np.int64).reshape(2, -1)  # core and tail of each chunk
        is_word = np.zeros(len(parts.dictionary), bool)
        is_word[two[0][~np.asarray(whole)]] = True
        found = known(strings(parts.dictionary), is_word)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, lengths = gathered(np.frombuffer(b"".join(found), "<u4"), size, two.T.reshape(-1))
        flat, lengths = gathered(flat, lengths.reshape(-1, 2).sum(axis=1), np.asarray(named.indices, np.int64))
        before = np.concatenate([[0], np.cumsum(lengths)])
        edges = np.asarray(words.offsets) - words.offsets[0].as_py()
        return flat, np.diff(before[edges])

    def ids(text: str) -> np.ndarray:
        return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode_whole(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [ids(t.as_py() or "") for t in texts]
        return np.concatenate([*found, np.zeros(0, "<u4")]), np.fromiter(map(len, found), np.int64, len(found))

    return encode if parts_at_space(vocabulary) else encode_whole


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def slices(texts: pa.Array, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Where to cut an array of texts (first, number) so that a slice has some most bytes, or one text."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(sizes):
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right"))
        end = max(end, at + 1)
        yield at, end - at
        at = end


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenises whole texts, ends each with id 0 and cuts those longer than the capacity: doc_id, piece, start, length, ids_crc32 (and ids)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for first, number in slices(batch["text"]):
                here = batch.slice(first, number)
                ids, sizes = encode(here["text"])
                closed = np.zeros(len(ids) + number, "<u4")  # each document ends with id 0
                closed[np.arange(len(ids)) + np.repeat(np.arange(number), sizes)] = ids
                sizes = sizes + 1
                n = -(-sizes // capacity)
                of = np.repeat(np.arange(number), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(sizes[of] - start, capacity)
                begin = (np.cumsum(sizes) - sizes)[of] + start
                parts = [closed[a : a + k].tobytes() for a, k in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [here["doc_id"].take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(list(map(zlib.crc32, parts)), pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())] if with_ids else columns, names=[*names, "ids"] if with_ids else names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(cut), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first_rank, n, first_sequence, per_sequence, first_offset): the n pieces of that length from that rank on go, per_sequence at a time, into consecutive sequences, from that offset on."""
    left = {s: n for s, n in counts.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    order: list[int] = []  # the gaps in use, sorted
    opened = 0

    def put(s: int, n: int, first: int, per: int, offset: int) -> None:
        steps.append((s, rank[s], n, first, per, offset))
        rank[s] += n
        left[s] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    for a in reversed(large):
        while left[a]:
            k = bisect_left(large, capacity - a + 1) - 1
            while k >= 0 and (large[k] > a or not left[large[k]] or (large[k] == a and left[a] < 2)):
                k -= 1
            if k < 0:
                n = left[a]
                put(a, n, opened, 1, 0)
                leave(capacity - a, opened, n)
            else:
                b = large[k]
                n = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, n, opened, 1, 0)
                put(b, n, opened, 1, a)
                leave(capacity - a - b, opened, n)
            opened += n

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(order, s)
            if at == len(order):
                per = capacity // s
                first, n, gap = opened, -(-left[s] // per), capacity
                opened += n
            else:
                gap = order[at]
                per = gap // s
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            full, rest = min(n, left[s] // per), 0
            if full:
                put(s, full * per, first, per, capacity - gap)
                leave(gap - per * s, first, full)
            if full < n and left[s]:
                rest = left[s]
                put(s, rest, first + full, rest, capacity - gap)
                leave(gap - rest * s, first + full, 1)
            leave(gap, first + full + (rest > 0), n - full - (rest > 0))
    return steps


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, start, length, ids_crc32) that is cheap to read twice."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length up to the capacity
    steps = spark.createDataFrame(plan(counts, capacity) or [], "p_length long, first_rank long, n long, first_sequence long, per long, first_offset long")
    salts = max(LEAST_SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = parts.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("within", within).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    here = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    k = F.col("rank") - F.col("first_rank")
    # the steps are as many as the capacity allows, not the corpus: broadcasting them is bounded
    return ranked.join(F.broadcast(steps), here).select(
        *pieces.columns,
        (F.col("first_sequence") + F.expr("(rank - first_rank) div per")).alias("sequence_id"),
        (F.col("first_offset") + k % F.col("per") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs all documents: a row for each piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, as little-endian unsigned 32-bit, if asked for).

    A null text counts as empty and gives one piece of length 1 (the end id 0). Only documents longer than the capacity
    are cut. Repeated rows are packed as often as they occur; an empty table gives an empty result; columns other than
    the id and the text are not read. Pieces of one length are interchangeable in the plan, so ties don't change its size.
    """
    return pack(written(pieces_of(docs, vocabulary, capacity, id_col, text_col, with_ids), "pieces"), capacity)
