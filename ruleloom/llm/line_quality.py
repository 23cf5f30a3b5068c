"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad; its potential comes from the shares of character kinds in the line, at the starts and at the
ends of its words, in its two neighbours, and from its length and repetition. Labels exist for documents only, so every
line of a labelled document carries its document's label in training. A document's score is the mean of its lines'
probabilities of being good, from the forward-backward recursion, weighted by the lines' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import few, small_batches, tidied, written

#: Bounds of the training sample: labelled documents, and lines of all of them.
SAMPLE_DOCUMENTS = 4000
SAMPLE_LINES = 200_000
ITERATIONS, RATE, RIDGE = 250, 0.08, 1e-3
AT_ONCE = 1_000_000  # bytes of text whose features are taken together

# The kinds of bytes whose shares are features.
KINDS = ("other", "lower", "upper", "digit", "space", "ending", "comma", "bang", "mark", "pipe", "quote", "bracket", "slash", "lead", "follow")
_SETS = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "ending": b".?", "comma": b",;:", "bang": b"!", "mark": b"#$%&*@^~+=_", "pipe": b"|", "quote": b"'\"`", "bracket": b"()[]{}<>", "slash": b"/\\"}
TABLE = np.zeros(256, np.int64)
for _k, _bytes in _SETS.items():
    TABLE[list(_bytes)] = KINDS.index(_k)
TABLE[0x80:0xC0], TABLE[0xC0:] = KINDS.index("follow"), KINDS.index("lead")
N = len(KINDS)
SPACE = KINDS.index("space")


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text, the length of each line (bytes), and the number of lines of each text (1 at least)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1  # each text is closed by a newline
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    newline = data == 10
    ends = np.flatnonzero(newline)
    n_lines = np.diff(np.searchsorted(ends, np.cumsum(lengths)), prepend=0) if len(texts) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    size = ends - starts
    line = np.repeat(np.arange(len(ends)), size + 1)
    kind = TABLE[data]
    gap = newline | (kind == SPACE)
    total = len(ends)

    def shares(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.bincount(line[at] * N + kind[at], minlength=total * N).reshape(total, N).astype(float)
        n = counts.sum(axis=1, keepdims=True)
        return counts / np.maximum(n, 1), n[:, 0]

    text_at, first_at, last_at = ~newline, ~gap & np.concatenate([[True], gap[:-1]]), ~gap & np.concatenate([gap[1:], [True]])
    chars, _ = shares(text_at)
    first, n_words = shares(first_at)
    last, _ = shares(last_at)
    raw = data.tobytes()
    seen: set[tuple[int, int]] = set()
    again, same, distinct = np.zeros(total), np.zeros(total), np.ones(total)
    doc = np.repeat(np.arange(len(texts)), n_lines)
    for i, (d, a, b) in enumerate(zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True)):
        if b - a > 1:
            text = raw[a:b]
            key = (d, xxhash.xxh3_64_intdigest(text))
            if key in seen:
                again[i] = 1
            seen.add(key)
            words = text.split()
            if len(words) > 1:
                same[i] = sum(map(eq, words, words[1:])) / (len(words) - 1)
                distinct[i] = len(set(words)) / len(words)
    opening = np.concatenate([[True], doc[1:] != doc[:-1]]) if total else np.zeros(0, bool)
    closing = np.concatenate([opening[1:], [True]]) if total else np.zeros(0, bool)
    before, after = np.zeros_like(chars), np.zeros_like(chars)
    before[1:], after[:-1] = chars[:-1], chars[1:]
    before[opening], after[closing] = 0, 0
    plain = np.stack([np.ones(total), np.log1p(size) / 5, np.log1p(n_words) / 4, size / np.maximum(n_words, 1) / 10, again, same, distinct, opening, closing], axis=1).astype(float)
    plain[:, 3] = np.minimum(plain[:, 3], 5)
    return np.concatenate([plain, chars, first, last, before, after], axis=1), size.astype(float), n_lines


@dataclass(frozen=True)
class Chain:
    """weights: the potential of good against bad for each feature; moves[a, b]: that of b (1 good) after a."""

    weights: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def marginals(self, features: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        # summed feature by feature: a matrix product's last bits would depend on which lines are at hand together
        score = np.zeros(len(features))
        for j, w in enumerate(self.weights):
            score += (features[:, j] - self.mean[j]) / self.scale[j] * w
        return _forward_backward(score, self.moves, n_lines)[0]


def _forward_backward(score: np.ndarray, moves: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each line to be good, and the expected number of each move; all chains step together."""
    begin = np.cumsum(n_lines) - n_lines
    order = np.argsort(-n_lines, kind="stable")
    begin, sizes = begin[order], n_lines[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest)]  # chains of more than t lines
    high = np.clip(score, -30, 30)
    psi = np.stack([1 / (1 + np.exp(high)), 1 / (1 + np.exp(-high))], axis=1)
    step = np.exp(moves - moves.max())
    ahead, back = np.empty_like(psi), np.ones_like(psi)
    def moved(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return x[:, :1] * by[0] + x[:, 1:] * by[1]

    for t in range(longest):
        at = begin[: active[t]] + t
        a = psi[at] if t == 0 else psi[at] * moved(ahead[at - 1], step)
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        b = moved(psi[at + 1] * back[at + 1], step.T)
        back[at] = b / b.sum(axis=1, keepdims=True)
    both = ahead * back
    p = both / both.sum(axis=1, keepdims=True)
    follows = np.ones(len(score), bool)
    follows[begin] = False
    at = np.flatnonzero(follows)
    pairs = ahead[at - 1][:, :, None] * step[None] * (psi[at] * back[at])[:, None, :]
    return p[:, 1], (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def train(features: np.ndarray, n_lines: np.ndarray, labels: np.ndarray) -> Chain:
    """Maximises the conditional likelihood of the lines' labels, with a ridge. Without both labels all potentials stay 0, and every score is 0.5."""
    width = features.shape[1]
    mean, scale = (features.mean(axis=0), features.std(axis=0)) if len(features) else (np.zeros(width), np.ones(width))
    mean[0], scale = 0, np.where(scale < 1e-9, 1, scale)
    weights, moves = np.zeros(width), np.zeros((2, 2))
    if len(set(labels.tolist())) == 2:
        x, y = (features - mean) / scale, np.repeat(labels, n_lines).astype(float)
        doc = np.repeat(np.arange(len(n_lines)), n_lines)
        inner = np.flatnonzero(doc[1:] == doc[:-1])
        seen = np.bincount((y[inner] * 2 + y[inner + 1]).astype(int), minlength=4).reshape(2, 2)
        v = [np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.zeros((2, 2))]
        for i in range(1, ITERATIONS + 1):  # Adam
            p, moved = _forward_backward(x @ weights, moves, n_lines)
            for j, (param, grad) in enumerate(((weights, (y - p) @ x), (moves, seen - moved))):
                g = grad / len(y) - RIDGE * param
                v[j] = 0.9 * v[j] + 0.1 * g
                v[j + 2] = 0.999 * v[j + 2] + 0.001 * g * g
                param += RATE * (v[j] / (1 - 0.9**i)) / (np.sqrt(v[j + 2] / (1 - 0.999**i)) + 1e-8)
    return Chain(weights, moves, mean, scale)


def _nothing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros((0, line_features([b""])[0].shape[1])), np.zeros(0, np.int64), np.zeros(0, np.int64)


def parts(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts in their order, some million bytes at a time."""
    held, size = [], 0
    for t in texts:
        held.append((t.as_py() or "").encode())
        size += len(held[-1])
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def scores_of(chain: Chain, texts: pa.Array) -> np.ndarray:
    out = []
    for part in parts(texts):
        features, size, n_lines = line_features(part)
        p, weight = chain.marginals(features, n_lines), size + 1  # an empty line weighs as its newline
        doc = np.repeat(np.arange(len(part)), n_lines)
        out.append(np.bincount(doc, p * weight, len(part)) / np.bincount(doc, weight, len(part)))  # line by line
    return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def held_out(id_col: str) -> F.Column:
    """Rows that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCUMENTS, lines: int = SAMPLE_LINES) -> Chain:
    """Fits on labelled documents outside the held-out third, sample of them at most, chosen by a hash of their id, with lines lines in all at most. Only the text is a feature. Rows without an id or a label aren't used, nor is a document with more lines than are left of the bound; of several labels for an id the least counts."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = written(known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label")), "known")
    chosen = few(known, "id", sample)
    # the sample's size is a parameter, so broadcasting it is bounded
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    texts = written(rows.select("id", "label", "text", F.size(F.split("text", "\n", -1)).alias("lines"), F.sha2("text", 256).alias("sha")), "labelled")
    left, fitting = lines, []
    for r in sorted(texts.select("id", "label", "sha", "lines").distinct().collect(), key=lambda r: (r["sha"], r["id"])):  # rows of the sample
        if r["lines"] <= left:
            left -= r["lines"]
            fitting.append((r["id"], r["sha"]))
    if not fitting:
        return train(*_nothing())
    texts = texts.dropDuplicates(["id", "sha"]).join(F.broadcast(docs.sparkSession.createDataFrame(fitting, StructType([StructField("id", docs.schema[id_col].dataType), StructField("sha", StringType())]))), ["id", "sha"])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in parts(batch["text"]):
                features, _, n_lines = line_features(part)
                rows = np.split(features.astype(np.float32), np.cumsum(n_lines)[:-1])
                here = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([here["id"], here["label"], pa.array(n_lines, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "label", "n", "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.select("id", "label", "text").mapInArrow(tidied(featured), f"id {kind}, label int, n long, features binary").collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["features"])))
    width = _nothing()[0].shape[1]
    features = np.frombuffer(b"".join(bytes(r["features"]) for r in rows), np.float32).reshape(-1, width).astype(float)
    return train(features, np.array([r["n"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64))


def quality_scores(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted. Equal texts have equal scores, whatever rows they lie among. A null text counts as empty, and that is one empty line; a null id is not held out. Other columns aren't read; an empty table gives an empty result."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scores_of(chain, batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, chain: Chain, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is least or more."""
    small_batches(docs.sparkSession)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores_of(chain, batch.column(where)) >= least))

    return docs.mapInArrow(tidied(run), docs.schema)
