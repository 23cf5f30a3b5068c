"""Approximate nearest neighbours by inner product over balanced posting lists.

Centres are fitted on a bounded sample with a penalty on large lists, and are kept in memory as a graph that is searched
from several entry points. A vector near a boundary goes to the lists of several centres; lists are cut into chunks of
bounded size. A query visits the lists whose centre is, by ratio, not much farther than the nearest; that ratio is the
one which finds RECALL of the true neighbours in the sample, so it is small where vectors cluster and large where they
do not. Inner products become distances by one more component that gives all candidates the same norm. Of equal vectors
only those with the smallest ids can be among the nearest, so only these are searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import few, tidied, written

NEAREST = 20
QUERY_STEP = 20
#: Bounds of what the driver fits on and of the lists, whose centres every task holds.
SAMPLE, MOST_LISTS = 40_000, 8192
PER_LIST, CHUNK = 1000, 4000
COPIES = 2  # lists that a vector near a boundary goes to at most
BOUNDARY = 1.25  # ... if their centres are no farther than this times the nearest
RECALL = 0.97
FIRST_VISITS = 4  # a query's nearest lists, whose results bound what the others need to report
SAMPLE_QUERIES = 300
DEGREE, BEAM, ROWS_IN_STEP = 24, 64, 1000


@dataclass
class Lists:
    centres: np.ndarray  # with the added component
    graph: np.ndarray
    entries: np.ndarray
    norm: float  # the greatest norm of a candidate
    ratio: float

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Adds the component; squared distances between queries and candidates then fall as inner products rise."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, more[:, None]], axis=1)

    def near(self, x: np.ndarray, width: int, reach: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The width nearest centres of each lifted vector, nearest first, and their distances. Centres beyond reach times the nearest need not be among them."""
        found = [self._near(x[at : at + ROWS_IN_STEP], width, reach) for at in range(0, max(len(x), 1), ROWS_IN_STEP)]
        most = max(ids.shape[1] for ids, _ in found)
        ids = np.concatenate([np.pad(i, ((0, 0), (0, most - i.shape[1])), constant_values=-1) for i, _ in found])
        return ids, np.concatenate([np.pad(d, ((0, 0), (0, most - d.shape[1])), constant_values=np.inf) for _, d in found])

    def _near(self, x: np.ndarray, width: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search over the graph, all rows in step."""
        n, c = len(x), len(self.centres)
        wanted, width = min(width, c), min(max(width, BEAM), c)
        if n == 0:
            return np.zeros((0, wanted), np.int64), np.zeros((0, wanted))
        squares = (self.centres * self.centres).sum(axis=1)
        own = (x * x).sum(axis=1)[:, None]

        def distance(ids: np.ndarray) -> np.ndarray:
            return squares[ids] - 2 * np.einsum("nd,nkd->nk", x, self.centres[ids])

        seen = np.zeros((n, c), bool)
        rows = np.arange(n)[:, None]
        ids = np.repeat(self.entries[None, :], n, axis=0)
        seen[rows, ids] = True
        dist, done = distance(ids), np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :width]
            ids, dist, done = (np.take_along_axis(a, order, axis=1) for a in (ids, dist, done))
            open_ = ~done & np.isfinite(dist)
            if np.isfinite(reach):
                open_ &= (dist + own <= (1.1 * reach) ** 2 * np.maximum(dist[:, :1] + own, 1e-24)) | (np.arange(dist.shape[1]) < BEAM)
            if not open_.any():
                break
            step = min(4, ids.shape[1])
            first = np.argsort(~open_, axis=1, kind="stable")[:, :step]  # the nearest centres that are not yet opened
            mine = np.take_along_axis(open_, first, axis=1)
            np.put_along_axis(done, first, True, axis=1)
            new = self.graph[np.take_along_axis(ids, first, axis=1)].reshape(n, -1)
            fresh = np.repeat(mine, self.graph.shape[1], axis=1) & ~seen[rows, new]
            key = np.where(fresh, new, -1)
            rank = np.argsort(key, axis=1, kind="stable")
            ordered = np.take_along_axis(key, rank, axis=1)
            once = np.concatenate([np.ones((n, 1), bool), ordered[:, 1:] != ordered[:, :-1]], axis=1) & (ordered >= 0)
            new = np.where(once, ordered, 0)
            r, k = np.nonzero(once)
            seen[r, new[r, k]] = True
            dist = np.concatenate([dist, np.where(once, distance(new), np.inf)], axis=1)
            ids, done = np.concatenate([ids, new], axis=1), np.concatenate([done, ~once], axis=1)
        return ids[:, :wanted], np.sqrt(np.maximum(dist + own, 0))[:, :wanted]

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        """The lists of each candidate: -1 where it has fewer than COPIES."""
        ids, dist = self.near(self.lift(x, False), COPIES)
        return np.where(dist <= BOUNDARY * dist[:, :1] + 1e-12, ids, -1)

    def visits_of(self, x: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """The lists that each query visits; -1 beyond the ratio, unless the nearer ones hold fewer than least candidates (a candidate is in COPIES lists at most)."""
        ids, dist = self.near(self.lift(x, True), len(self.centres), self.ratio)
        held = np.where(ids >= 0, sizes[np.maximum(ids, 0)], 0)
        before = np.cumsum(held, axis=1) - held
        return np.where((dist <= self.ratio * dist[:, :1] + 1e-12) | (before < COPIES * least), ids, -1)


def _balanced_centres(x: np.ndarray, n: int) -> np.ndarray:
    rng = np.random.default_rng(5)
    centres = x[np.sort(rng.choice(len(x), n, replace=False))]
    penalty = np.zeros(n)
    for _ in range(15):
        squares = (centres * centres).sum(axis=1)
        own = np.concatenate([(squares + penalty - 2 * part @ centres.T).argmin(axis=1) for part in np.array_split(x, max(1, len(x) // 4000))])
        sizes = np.bincount(own, minlength=n)
        spread = float(np.mean(((x - centres[own]) ** 2).sum(axis=1)))
        penalty += 0.05 * spread * (sizes * n / len(x) - 1).clip(-1, 2)  # a large list looks farther next time
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _neighbours(centres: np.ndarray, degree: int) -> np.ndarray:
    """The nearest other centres of each, nearest first, from some rows of the distance matrix at a time."""
    squares, n, out = (centres * centres).sum(axis=1), len(centres), []
    for at in range(0, n, 256):
        part = centres[at : at + 256]
        apart = squares[at : at + 256, None] + squares[None, :] - 2 * part @ centres.T
        apart[np.arange(len(part)), np.arange(at, at + len(part))] = np.inf
        some = np.sort(np.argpartition(apart, degree - 1, axis=1)[:, :degree], axis=1)
        out.append(np.take_along_axis(some, np.argsort(np.take_along_axis(apart, some, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out)


def fit(sample: np.ndarray, n_vectors: int, norm: float, per_list: int | None = None) -> Lists:
    """Fits centres, graph and ratio on a sample of the candidates."""
    dim = sample.shape[1]
    n = int(np.clip(n_vectors // (per_list or PER_LIST), 1, min(MOST_LISTS, max(1, len(sample) // 2))))
    lists = Lists(np.zeros((1, dim + 1)), np.zeros((1, 1), np.int64), np.zeros(1, np.int64), norm, 1.0)
    if not len(sample):
        return lists
    lifted = lists.lift(sample, False)
    lists.centres = _balanced_centres(lifted, n)
    near = _neighbours(lists.centres, max(1, min(DEGREE, n - 1))) if n > 1 else np.zeros((1, 1), np.int64)
    ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n], axis=1)  # whatever the neighbours, every centre can be reached
    lists.graph = np.concatenate([near, ring], axis=1)
    lists.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))
    # the ratio: over queries from the sample, how far the lists of their true neighbours are from them
    queries = sample[:: max(1, len(sample) // SAMPLE_QUERIES)]
    ids, dist = lists.near(lists.lift(queries, True), n)
    place = np.full((len(ids), n), ids.shape[1] - 1)
    np.put_along_axis(place, ids, np.arange(ids.shape[1])[None, :].repeat(len(ids), axis=0), axis=1)
    # a neighbour among the vectors is less rare than one among the sample; the nearest few of the sample stand for them
    top = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, 1 : 1 + max(5, NEAREST * len(sample) // max(n_vectors, 1))]
    held, back = np.unique(top, return_inverse=True)
    holds = lists.lists_of(sample[held])[back.reshape(top.shape)]
    needed = []
    for q, options in enumerate(holds):
        ranks = np.where(options >= 0, place[q][np.maximum(options, 0)], ids.shape[1] - 1)
        needed.extend((dist[q][ranks.min(axis=1)] / max(dist[q][0], 1e-12)).tolist())
    lists.ratio = float(np.quantile(needed, RECALL)) * (1 + 1e-9) if needed else 1.0
    return lists


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _spread(vectors: DataFrame, lists: Lists, sizes: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """id, e -> list, place (0 for the nearest), id, e: a row for each list that a candidate is in or, with the lists' sizes, a query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                x = _matrix(part["e"])
                found = lists.lists_of(x) if sizes is None else lists.visits_of(x, sizes, least)
                row, column = np.nonzero(found >= 0)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(found[row, column], pa.int32()), pa.array(column, pa.int32()), part["id"].take(take), part["e"].take(take)], names=["list", "place", "id", "e"])

    return vectors.mapInArrow(tidied(run), "list int, place int, id long, e array<double>")


def _search(visits: pa.Table, held: pa.Table, nearest: int) -> pa.Table:
    """The nearest of one chunk for each of its queries, as far as their scores reach the query's bound."""
    out: list[tuple[np.ndarray, ...]] = []
    if len(visits) and len(held):
        x, ids = _matrix(held["e"].combine_chunks()), np.asarray(held["id"])
        queries, names, bounds = _matrix(visits["e"].combine_chunks()), np.asarray(visits["id"]), np.asarray(visits["bound"], np.float64)
        for at in range(0, len(queries), 512):
            q = queries[at : at + 512]
            rough = q @ x.T
            k = min(nearest, len(x))
            cut = np.maximum(np.partition(rough, len(x) - k, axis=1)[:, len(x) - k], bounds[at : at + 512])
            row, column = np.nonzero(rough >= (cut - 1e-9 * (1 + np.abs(cut)))[:, None])
            # matrix products may differ in the last bits between equal vectors; sums in the order of the components do not
            exact = np.zeros(len(row))
            for j in range(x.shape[1]):
                exact += q[row, j] * x[column, j]
            order = np.lexsort((ids[column], -exact, row))
            row, column, exact = row[order], column[order], exact[order]
            start = np.searchsorted(row, np.arange(len(q)))
            best = np.arange(len(row)) - start[row] < k
            out.append((names[at + row[best]], ids[column[best]], exact[best]))
    q, v, s = map(np.concatenate, zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"q": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})


def search(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST, query_step: int = QUERY_STEP, per_list: int | None = None) -> DataFrame:
    """The nearest candidates by inner product of every row whose id is divisible by query_step: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id; a query with fewer candidates gets all of them. Vectors that are null, zero or hold a
    null or a non-finite component take no part, nor do rows without an id or with another number of components than
    most rows have (the greater of two as frequent). Repeated ids count once, with the least vector. A table without
    vectors gives an empty result; other columns are not read. per_list: how many vectors there are for a list (PER_LIST
    unless given), up to MOST_LISTS lists; where there is but one, every vector is compared.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e")).filter("id is not null and size(e) > 0")
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    sound_rows = rows.filter(sound)
    usual = sound_rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kept = sound_rows.filter(F.size("e") == (usual["d"] if usual else 0))
    if not kept.groupBy("id").count().filter("count > 1").isEmpty():
        kept = kept.groupBy("id").agg(F.min("e").alias("e"))
    vectors = written(kept.select("id", "e", F.xxhash64("e").alias("k1"), F.xxhash64(F.lit(1), "e").alias("k2")), "vectors")
    candidates = _without_late_copies(vectors, nearest + 1).select("id", "e")

    facts = candidates.agg(F.count("*").alias("n"), F.max(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).first()
    chosen = few(candidates.select("id"), "id", SAMPLE)
    sample = candidates.join(chosen, "id", "left_semi").toArrow()  # as many rows as the sample's bound
    order = np.argsort(np.asarray(sample["id"]), kind="stable")
    lists = fit(_matrix(sample["e"].combine_chunks())[order] if len(order) else np.zeros((0, 1)), facts["n"], float(np.sqrt(facts["most"] or 0.0)), per_list)

    postings = written(_spread(candidates, lists), "postings")
    counts = written(postings.groupBy("list").agg(F.count("*").alias("n")), "sizes")
    sizes = np.zeros(len(lists.centres), np.int64)
    for r in counts.collect():  # a row for each list, of which there are MOST_LISTS at most
        sizes[r["list"]] = r["n"]
    chunks = F.broadcast(counts.select("list", F.ceil(F.col("n") / F.lit(CHUNK)).cast("int").alias("chunks")))
    held = postings.join(chunks, "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))

    asking = vectors.filter(F.col("id") % query_step == 0)
    each = asking.groupBy("k1", "k2").agg(F.min("id").alias("id"))
    distinct = written(asking.join(each.select("id"), "id", "left_semi").select("id", "e"), "queries")
    visits = written(_spread(distinct, lists, sizes, nearest + 1).join(chunks, "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))), "visits")

    def of_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(left, right, nearest + 1)

    def searched(some: DataFrame, name: str) -> DataFrame:
        return written(some.groupBy("list", "chunk").cogroup(held.groupBy("list", "chunk")).applyInArrow(of_chunk, "q long, vec_id long, score double"), name)

    def best_of(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        return found.dropDuplicates(["q", "vec_id"]).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= nearest + 1)

    near = written(best_of(searched(visits.filter(F.col("place") < FIRST_VISITS).withColumn("bound", F.lit(float("-inf"))), "near")), "near")
    bounds = near.filter(F.col("r") == nearest + 1).select(F.col("q").alias("id"), F.col("score").alias("bound"))
    later = visits.filter(F.col("place") >= FIRST_VISITS).join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    found = near.drop("r").unionByName(searched(later, "far"))
    top = written(best_of(found).drop("r"), "top")

    # every query of one vector has that vector's nearest, less itself
    asked = asking.select(F.col("id").alias("query_id"), "k1", "k2").join(each.withColumnRenamed("id", "q"), ["k1", "k2"]).select("query_id", "q")
    answers = asked.join(top, "q").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= nearest)


def _without_late_copies(vectors: DataFrame, most: int) -> DataFrame:
    """Leaves out those of equal vectors that as many smaller ids precede: no query's nearest can hold them. Ranks are taken within salted parts first."""
    many = written(vectors.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("k1", "k2"), "copied")
    if many.isEmpty():
        return vectors
    salts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = vectors.select("k1", "k2", "id").join(many, ["k1", "k2"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    for keys in (["k1", "k2", "salt"], ["k1", "k2"]):
        copies = copies.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("r") <= most)
    firsts = written(copies.select("id"), "firsts")
    single = vectors.join(many, ["k1", "k2"], "left_anti").select("id", "e")
    return written(single.unionByName(vectors.join(firsts, "id", "left_semi").select("id", "e")), "candidates")
