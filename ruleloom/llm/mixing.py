"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted in cells of source, language and topic. Raking scales the cells, one marginal after another, until
their token shares meet the targets of all three. A document's raked weight, times the budget's scale, is how often it is
expected in the mixture: the whole part for sure, the rest by a draw from a hash of its id, so that the same documents
come out every time and the mixture meets all targets. Where no document may occur twice, probabilities are raked under
the limit of 1 instead, and come as near to the targets as what there is allows. Values that given targets don't name
share one category; targets taken from the corpus name every value. Up to MOST_CELLS cells are raked on the driver, more
as tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import discard, few, fresh, small_batches, tidied, written

OTHER = "(other)"
TOPICS = 8
WIDTH = 256  # hashed words
UNIT = 32_767  # vectors are held as whole numbers, so that sums over any partitions are the same
SEEDS = 4000  # documents that the first topic centres are chosen from; all documents then move them
PASSES = 4
MOST_CELLS = 50_000  # that the driver rakes, and workers hold
FLATTENING = 0.7
KEPT_SHARE = 0.8  # of the corpus's tokens, unless a budget is given
ROUNDS, PRECISION = 1000, 1e-10
TABLE_ROUNDS, TABLE_PRECISION = 200, 1e-7  # where cells are raked as tables
MARGINALS = ("source", "lang", "topic")


def bag(text: bytes) -> tuple[int, np.ndarray]:
    """Number of words, and damped counts of hashed words as a vector of length UNIT, in whole numbers."""
    words = text.split()
    counts = np.sqrt(np.bincount(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(WIDTH), minlength=WIDTH))
    return len(words), np.rint(counts * (UNIT / (np.sqrt(counts @ counts) or 1))).astype("<i2")


def vectors_of(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, v (the bytes of the bag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, v = zip(*(bag((t.as_py() or "").encode()) for t in batch["text"]), strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], batch["lang"], pa.array(n, pa.int64()), pa.array([x.tobytes() for x in v], pa.binary())], names=["doc_id", "source", "lang", "n_tokens", "v"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit(OTHER)).alias("source"), F.coalesce(F.col(lang_col), F.lit(OTHER)).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), f"doc_id {kind}, source string, lang string, n_tokens long, v binary")


def _matrix(v: pa.Array | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x if isinstance(x, bytes) else x.as_py() for x in v), "<i2").reshape(-1, WIDTH).astype(np.float64)


def topic_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector; one without words is of topic 0."""
    return (x @ centres.T).argmax(axis=1) if len(x) else np.zeros(0, np.int64)


def _unit(sums: np.ndarray) -> np.ndarray:
    return sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)


def fit_topics(vectors: DataFrame, topics: int = TOPICS, seeds: int = SEEDS, passes: int = PASSES) -> np.ndarray:
    """Centres of a spherical k-means over all documents (doc_id, v), from first ones chosen among seeds documents by a hash of the ids; one row of zeros if there is nothing to fit."""
    chosen = few(vectors.filter("doc_id is not null").select("doc_id", "v"), "doc_id", seeds).collect()
    x = np.unique(_matrix([bytes(r["v"]) for r in chosen]), axis=0) if chosen else np.zeros((0, WIDTH))
    x = x[x.any(axis=1)]
    if not len(x):
        return np.zeros((1, WIDTH))
    x /= UNIT
    rng = np.random.default_rng(11)
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < min(topics, len(x)):  # far points make good first centres
        gap = np.maximum(1 - (x @ centres.T).max(axis=1), 0) ** 2
        if gap.sum() <= 0:
            break
        centres = np.concatenate([centres, x[[int(rng.choice(len(x), p=gap / gap.sum()))]]])
    for _ in range(25):
        own = topic_of(x, centres)
        centres = _unit(np.stack([x[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))]))
    for _ in range(passes):

        def run(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(centres), WIDTH), np.int64)
            for batch in batches:
                x = _matrix(batch["v"])
                own = topic_of(x, centres)
                for c in range(len(centres)):
                    sums[c] += x[own == c].sum(axis=0).astype(np.int64)
            c, j = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[c, j], pa.int64())], names=["c", "j", "s"])

        found = vectors.select("v").mapInArrow(tidied(run), "c int, j int, s long").groupBy("c", "j").agg(F.sum("s").alias("s")).collect()  # topics times WIDTH rows at most
        sums = np.zeros_like(centres)
        for r in found:
            sums[r["c"], r["j"]] = r["s"]
        moved = np.where(sums.any(axis=1, keepdims=True), _unit(sums), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def with_topics(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topic = [f"topic{t}" for t in topic_of(_matrix(batch["v"]), centres)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], batch["lang"], pa.array(topic, pa.string()), batch["n_tokens"]], names=["doc_id", "source", "lang", "topic", "n_tokens"])

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.mapInArrow(tidied(run), f"doc_id {kind}, source string, lang string, topic string, n_tokens long")


def flattened_targets(measured: DataFrame, power: float = FLATTENING) -> dict[str, dict[str, float]]:
    """Targets that lessen the corpus's own imbalance: each value's token share to a power below 1. Every value is named."""
    targets = {}
    for marginal in MARGINALS:
        totals = {r[marginal]: r["n"] for r in measured.groupBy(marginal).agg(F.sum("n_tokens").alias("n")).collect()}  # of MOST_CELLS cells at most
        everything = sum(totals.values()) or 1
        powers = {k: (n / everything) ** power for k, n in totals.items()}
        whole = sum(powers.values()) or 1
        targets[marginal] = {k: p / whole for k, p in powers.items()}
    return targets


def rake(tokens: dict[tuple[str, ...], float], targets: dict[str, dict[str, float]]) -> dict[tuple[str, ...], float]:
    """The factor of each cell. Target values without tokens are left out, and the others of their marginal share what they were to get. Iterates to PRECISION, or, where no factors meet all targets, for ROUNDS rounds."""
    cells = sorted(c for c, n in tokens.items() if n > 0)
    if not cells:
        return {}
    mass = np.array([tokens[c] for c in cells], float)
    mass /= mass.sum()
    start = mass.copy()
    axes = []
    for k, marginal in enumerate(MARGINALS):
        names = sorted({c[k] for c in cells})
        wanted = np.array([targets[marginal].get(v, 0.0) for v in names])
        wanted = wanted / wanted.sum() if wanted.sum() > 0 else np.full(len(names), 1 / len(names))
        place = {v: i for i, v in enumerate(names)}
        axes.append((np.array([place[c[k]] for c in cells]), wanted))
    for _ in range(ROUNDS):
        worst = 0.0
        for at, wanted in axes:
            now = np.bincount(at, mass, len(wanted))
            worst = max(worst, float(np.abs(now - wanted).max()))
            mass *= np.where(now > 0, wanted / np.where(now > 0, now, 1), 0)[at]
        if worst < PRECISION:
            break
    return dict(zip(cells, (mass / start).tolist(), strict=True))


def within_capacity(held: np.ndarray, wanted: np.ndarray, budget: float) -> np.ndarray:
    """What each value gets of the budget: in proportion to wanted, and what it holds where that would exceed it."""
    got = np.zeros(len(held))
    full = np.zeros(len(held), bool)
    while not full.all():
        rest = np.where(full, 0, wanted)
        got = np.where(full, held, rest / rest.sum() * (budget - held[full].sum()) if rest.sum() > 0 else 0)
        over = ~full & (got >= held)
        if not over.any():
            break
        full |= over
    return np.minimum(got, held)


def sampling(tokens: dict[tuple[str, ...], float], targets: dict[str, dict[str, float]], factors: dict[tuple[str, ...], float], budget: float) -> dict[tuple[str, ...], float]:
    """The probability of each cell, raked under the limit of 1 such that budget tokens are expected.

    Values wanted more than they have are kept whole; all others of their marginal share the rest in proportion to their
    targets. Where cells leave no such probabilities, the last marginal raked is met and the others are near."""
    cells = [c for c in factors if factors[c] > 0]
    held = np.array([tokens[c] for c in cells], float)
    budget = min(budget, held.sum())
    if budget <= 0:
        return dict.fromkeys(factors, 0.0)
    axes, whole = [], np.zeros(len(cells), bool)
    for k, marginal in enumerate(MARGINALS):
        names, at = np.unique([c[k] for c in cells], return_inverse=True)
        total = np.bincount(at, held, len(names))
        wanted = np.array([targets[marginal].get(str(v), 0.0) for v in names])
        # a marginal without any target among its values is raked evenly, as the factors are
        gets = within_capacity(total, wanted if wanted.sum() > 0 else np.ones(len(names)), budget)
        axes.append((at, gets))
        whole |= (gets >= total * (1 - 1e-12))[at]
    raised = np.array([factors[c] for c in cells])
    raised = raised * (budget / (held @ raised))

    def probabilities() -> np.ndarray:
        return np.where(whole, 1.0, np.minimum(1.0, raised))

    for _ in range(ROUNDS):
        worst = 0.0
        for at, gets in axes:
            now = np.bincount(at, held * probabilities(), len(gets))
            ratio = gets / np.where(now > 0, now, 1)
            worst = max(worst, float(np.abs(now - gets).max()) / budget)
            raised = np.clip(raised * ratio[at], 0, 1e100)
        if worst < PRECISION:
            break
    low, high = -60.0, 60.0  # the budget is met in any case: exponents of a common factor
    for _ in range(200):
        middle = (low + high) / 2
        expected = held @ np.where(whole, 1.0, np.minimum(1.0, raised * np.exp(middle)))
        low, high = (middle, high) if expected < budget else (low, middle)
    raised *= np.exp((low + high) / 2)
    return dict.fromkeys(factors, 0.0) | dict(zip(cells, probabilities().tolist(), strict=True))


def scale_of(tokens: dict[tuple[str, ...], float], factors: dict[tuple[str, ...], float], budget: float) -> float:
    """Expected copies for a weight of 1, such that the documents that occur at all are expected to have budget tokens."""
    cells = sorted((c for c in factors if factors[c] > 0), key=lambda c: -factors[c])
    kept, rest = 0.0, sum(tokens[c] * factors[c] for c in cells)
    budget = min(budget, sum(tokens[c] for c in cells))
    for c in cells:
        scale = (budget - kept) / rest
        if scale * factors[c] <= 1:
            return max(scale, 0.0)
        kept, rest = kept + tokens[c], rest - tokens[c] * factors[c]
        if rest <= 0 or c == cells[-1]:
            return 1 / factors[cells[-1]]
    return 0.0


def rake_tables(cells: DataFrame, budget: float, power: float = FLATTENING, repeat: bool = True) -> DataFrame:
    """source, lang, topic, n_tokens (a table from written()) -> source, lang, topic, weight, expected (copies): as rake with flattened_targets and scale_of, or sampling without repeat, in joins and aggregates, for any number of values.

    Iterates to TABLE_PRECISION of the tokens, or until rounds no longer come nearer, for TABLE_ROUNDS rounds at most."""
    held = cells.filter("n_tokens > 0")
    total = held.agg(F.sum("n_tokens")).first()[0] or 0
    budget = min(budget, total)
    state = held.select(*MARGINALS, F.col("n_tokens").cast("double").alias("n"), F.lit(1.0).alias("weight"), F.lit(budget / max(total, 1)).alias("raised"), F.lit(False).alias("whole"))
    goals = {}
    for m in MARGINALS:
        values = held.groupBy(m).agg(F.sum("n_tokens").cast("double").alias("held")).withColumn("share", F.pow(F.col("held") / F.lit(float(total)), F.lit(power)))
        values = written(values, "values", cells)
        shares = values.agg(F.sum("share")).first()[0] or 1.0
        level, full = budget / shares, 0  # tokens for a share of one; values that hold less are kept whole
        while True:
            over = F.col("held") <= F.col("share") * level
            found = values.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("held"))).alias("kept"), F.sum(F.when(~over, F.col("share"))).alias("rest")).first()
            if found["n"] == full or not found["rest"]:
                break
            full, level = found["n"], (budget - (found["kept"] or 0.0)) / found["rest"]
        over = F.col("held") <= F.col("share") * level
        goals[m] = written(values.select(m, (F.col("share") / shares * total).alias("wanted"), F.least("held", F.col("share") * level).alias("gets"), over.alias("over")), "goals", cells)
        state = state.join(goals[m].select(m, "over"), m).withColumn("whole", F.col("whole") | F.col("over")).drop("over")
    probability = F.when(F.col("whole"), 1.0).otherwise(F.least(F.lit(1.0), F.col("raised")))
    state, last = written(state, "cells", cells), float("inf")
    for _ in range(TABLE_ROUNDS if total else 0):
        new = state.withColumn("off", F.lit(0.0))
        for m in MARGINALS:
            now = new.groupBy(m).agg(F.sum(F.col("n") * F.col("weight")).alias("weighs"), F.sum(F.col("n") * probability).alias("taken")).join(goals[m], m)
            off = F.greatest(F.abs(F.col("weighs") - F.col("wanted")), F.lit(0.0) if repeat else F.abs(F.col("taken") - F.col("gets"))) / total
            now = now.select(m, (F.col("wanted") / F.col("weighs")).alias("up"), (F.col("gets") / F.col("taken")).alias("more"), off.alias("now_off"))
            new = new.join(now, m).select(*MARGINALS, "n", (F.col("weight") * F.col("up")).alias("weight"), F.least(F.lit(1e100), F.col("raised") * F.col("more")).alias("raised"), "whole", F.greatest("off", "now_off").alias("off"))
        new = written(new, "raked", cells)
        worst = new.agg(F.max("off")).first()[0]
        state = new.drop("off")
        if worst < TABLE_PRECISION or worst > 0.999 * last:
            break
        last = worst
    if repeat:
        scale = budget / max(total, 1)
        while total:
            over = F.col("weight") * scale > 1
            kept, rest = state.agg(F.sum(F.when(over, F.col("n"))), F.sum(F.when(~over, F.col("n") * F.col("weight")))).first()
            more = (budget - (kept or 0.0)) / rest if rest else scale
            if more <= scale * (1 + PRECISION):
                break
            scale = more
        return written(state.select(*MARGINALS, "weight", (F.col("weight") * scale).alias("expected")), "cells", cells)
    for _ in range(50):  # the budget is met in any case
        free = ~F.col("whole") & (F.col("raised") < 1)
        kept, rest = state.agg(F.sum(F.when(~free, F.col("n"))), F.sum(F.when(free, F.col("n") * F.col("raised")))).first()
        more = (budget - (kept or 0.0)) / rest if rest else 1.0
        if abs(more - 1) < PRECISION or more <= 0:
            break
        state = state.withColumn("raised", F.col("raised") * more)
    return written(state.select(*MARGINALS, "weight", probability.alias("expected")), "cells", cells)


@dataclass(frozen=True)
class Mixture:
    centres: np.ndarray
    targets: dict[str, dict[str, float]]
    factors: dict[tuple[str, ...], float]
    expected: dict[tuple[str, ...], float]  # copies of a document of the cell
    cells: DataFrame | None = None  # in place of the dicts, where there are more than MOST_CELLS

    @property
    def probabilities(self) -> dict[tuple[str, ...], float]:
        return {c: min(1.0, e) for c, e in self.expected.items()}

    def cell(self, source: str, lang: str, topic: str) -> tuple[str, ...]:
        return tuple(v if v in self.targets[m] else OTHER for m, v in zip(MARGINALS, (source, lang, topic), strict=True))


def calibrate(measured: DataFrame, centres: np.ndarray, targets: dict[str, dict[str, float]] | None = None, budget: float | None = None, repeat: bool = True) -> Mixture:
    """Rakes the cells of a measured table. The documents that occur in the mixture are expected to have budget tokens (KEPT_SHARE of all if none is given).

    With repeat the expected copies are the raked weights at one scale, so that the mixture meets all targets. Without, no
    document occurs twice: values that the targets want more of than there is are kept whole, and the others of their
    marginal meet the targets among themselves."""
    if targets:
        named = [F.when(F.col(m).isin([*targets[m]]), F.col(m)).otherwise(OTHER).alias(m) for m in MARGINALS]
        cells = measured.select(*named, "n_tokens").groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("n_tokens"))
    else:
        cells = written(measured.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("n_tokens")), "cells")
        if cells.count() > MOST_CELLS:
            budget = KEPT_SHARE * cells.agg(F.sum("n_tokens")).first()[0] if budget is None else budget
            return Mixture(centres, {}, {}, {}, rake_tables(cells, budget, repeat=repeat))
        targets = flattened_targets(cells)
    rows = cells.withColumnRenamed("n_tokens", "n").collect()  # a row for each cell of the targets, or MOST_CELLS at most
    tokens = {tuple(r[m] for m in MARGINALS): float(r["n"]) for r in rows}
    factors = rake(tokens, targets)
    budget = KEPT_SHARE * sum(tokens.values()) if budget is None else budget
    if repeat:
        scale = scale_of(tokens, factors, budget)
        found = {c: scale * f for c, f in factors.items()}
    else:
        found = sampling(tokens, targets, factors, budget)
    # a cell without tokens weighs nothing, so its documents stay
    return Mixture(centres, targets, factors, {c: found.get(c, 1.0) for c in tokens})


def uniform(id_col: Column, seed: int = 1) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11) * F.lit(2.0**-53)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topics: int = TOPICS, seeds: int = SEEDS) -> tuple[DataFrame, np.ndarray]:
    vectors = written(vectors_of(docs, id_col, text_col, source_col, lang_col), "vectors")
    centres = fit_topics(vectors, topics, seeds)
    measured = written(with_topics(vectors, centres), "measured")
    discard(vectors)
    return measured, centres


def mix(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = 1, repeat: bool = True, topics: int = TOPICS, seeds: int = SEEDS
) -> DataFrame:
    """One row for each input row: doc_id, source, lang, topic, n_tokens, weight (the raked factor), expected (copies), probability (of at least one), copies (drawn), sampled (whether there is one).

    Null sources and languages, and values without a target, are of the category (other). A null or empty text has no
    tokens; where a whole cell has none, its documents have weight 0 and stay. Repeated rows, having one id, are sampled together. An empty
    table gives an empty result; columns other than the four named are not read.
    """
    measured, centres = measure(docs, id_col, text_col, source_col, lang_col, topics, seeds)
    found = calibrate(measured, centres, targets, budget, repeat)
    draw = (uniform(F.col("doc_id"), seed) < F.col("expected") - F.floor("expected")).cast("long")
    drawn = [F.least(F.lit(1.0), F.col("expected")).alias("probability"), (F.floor("expected") + draw).alias("copies"), (F.floor("expected") + draw > 0).alias("sampled")]
    if found.cells is not None:
        joined = measured.join(found.cells, [*MARGINALS], "left").fillna({"weight": 0.0, "expected": 1.0})
        return joined.select("doc_id", *MARGINALS, "n_tokens", "weight", "expected", *drawn)
    rows = [(*c, float(found.factors.get(c, 0.0)), float(e)) for c, e in found.expected.items()]
    table = docs.sparkSession.createDataFrame(rows, "c0 string, c1 string, c2 string, weight double, expected double")
    for i, m in enumerate(MARGINALS):
        measured = measured.withColumn(f"m{i}", F.when(F.col(m).isin([*targets[m]]), F.col(m)).otherwise(OTHER) if targets else F.col(m))
    joined = measured.join(F.broadcast(table), [F.col(f"m{i}") == F.col(f"c{i}") for i in range(3)])  # as many rows as cells of the targets, or MOST_CELLS at most
    return joined.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "expected", *drawn)


def keep_sampled(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = 1, repeat: bool = True, topics: int = TOPICS, seeds: int = SEEDS
) -> DataFrame:
    """The sampled rows of docs, each once, with all their columns, whatever these are called. Without repeat, probabilities are such that the rows as they come, each once, are nearest to the targets."""
    measured, centres = measure(docs, id_col, text_col, source_col, lang_col, topics, seeds)
    found = calibrate(measured, centres, targets, budget, repeat)
    drawn, topic = fresh(docs, "drawn"), fresh(docs, "topic_of_text")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = topic_of(_matrix([bag((t.as_py() or "").encode())[1].tobytes() for t in batch.column(at)]), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f"topic{t}" for t in own], pa.string())], names=[*batch.schema.names, topic])

    rows = docs.withColumn(drawn, uniform(F.col(id_col), seed))
    rows = rows.mapInArrow(tidied(run), StructType([*rows.schema.fields, StructField(topic, StringType())]))
    mine = [F.coalesce(F.col(source_col), F.lit(OTHER)), F.coalesce(F.col(lang_col), F.lit(OTHER)), F.col(topic)]
    if found.cells is None:
        # as many rows as cells of the targets, or MOST_CELLS at most
        table = F.broadcast(docs.sparkSession.createDataFrame([(*c, e) for c, e in found.expected.items()], "cell0 string, cell1 string, cell2 string, expected_copies double"))
        mine = [F.when(c.isin([*found.targets[m]]), c).otherwise(OTHER) if targets else c for c, m in zip(mine, MARGINALS, strict=True)]
    else:
        table = found.cells.select(*(F.col(m).alias(f"cell{i}") for i, m in enumerate(MARGINALS)), F.col("expected").alias("expected_copies"))
    table = table.toDF(*(fresh(docs, c) for c in table.columns))
    cell0, cell1, cell2, expected = table.columns
    joined = rows.join(table, [c == F.col(k) for c, k in zip(mine, (cell0, cell1, cell2), strict=True)], "left")
    return joined.filter(F.col(drawn) < F.coalesce(F.col(expected), F.lit(1.0))).select(*docs.columns)


def cells_of(targets: dict[str, dict[str, float]]) -> int:
    """The most cells that targets can have."""
    return len(list(product(*({*targets[m], OTHER} for m in MARGINALS))))
