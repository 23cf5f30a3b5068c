import numpy as np

from ruleloom.llm import vector_search as vs
from ruleloom.llm.queries import op8_vector_search, table

ROWS = "vec_id long, embedding array<float>, label int, id long, e string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "x") for i, v in rows], ROWS)


def brute(rows, nearest=20, step=20):
    held = {i: np.asarray(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and None not in list(v) and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float) != 0)}
    ids = np.array(sorted(held), np.int64)
    x = np.stack([held[i] for i in ids.tolist()]) if len(ids) else np.zeros((0, 1))
    out = []
    for i in ids[ids % step == 0].tolist():
        s = np.einsum("nd,nd->n", x, np.repeat(held[i][None], len(x), axis=0))
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:nearest]
        out += [(i, r + 1, int(ids[k]), float(s[k])) for r, k in enumerate(order)]
    return out


def rows_of(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def same(got, wanted):
    assert [g[:3] for g in got] == [w[:3] for w in sorted(wanted)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(wanted)], rtol=0, atol=1e-12)


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    same(rows_of(op8_vector_search(spark, sf)), brute(rows))


def test_left_out_vectors_norms_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * (1 + i % 5)).astype(np.float32)) for i in range(100)]
    rows += [(i, np.full(6, 2.0, np.float32)) for i in range(100, 260)]  # copies, queries among them
    rows += [(260, None), (280, [0.0] * 6), (300, [1, None, 1, 1, 1, 1]), (320, [float("nan")] * 6), (340, [float("inf")] * 6)]
    short = [(400, [1.0, 2.0]), (None, [1.0] * 6)]
    same(rows_of(vs.search(frame(spark, rows + short))), brute(rows))


def test_few_rows_repeated_rows_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])]
    same(rows_of(vs.search(frame(spark, rows + rows[:1]))), brute(rows))
    assert rows_of(vs.search(frame(spark, []))) == []
    assert rows_of(vs.search(frame(spark, [(1, None)]))) == []


def test_recall_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(vs, "PER_LIST", 60)
    monkeypatch.setattr(vs, "CHUNK", 90)
    rng = np.random.default_rng(4)
    for spread, low in ((0.15, 0.95), (30.0, 0.9)):
        centres = rng.normal(size=(12, 16))
        rows = [(i, (centres[i % 12] + spread * rng.normal(size=16)).astype(np.float32)) for i in range(3000)]
        wanted = {(q, v) for q, _, v, _ in brute(rows)}
        got = rows_of(vs.search(frame(spark, rows)))
        assert len({(q, v) for q, _, v, _ in got} & wanted) / len(wanted) >= low


def test_graph_search_finds_the_nearest_centres():
    rng = np.random.default_rng(8)
    lists = vs.fit(rng.normal(size=(4000, 8)), 200_000, 9.0)
    x = lists.lift(rng.normal(size=(50, 8)), True)
    ids, dist = lists.near(x, 10)
    true = np.sqrt(((x[:, None, :] - lists.centres[None]) ** 2).sum(axis=2))
    want = np.sort(true, axis=1)[:, :10]
    assert (np.abs(dist - want) < 1e-6).mean() > 0.9


def test_a_query_beside_a_tiny_list_gets_all_its_neighbours(spark, monkeypatch):
    """The nearest list of the queries holds three vectors, and the ratio is as small as can be; still each query gets 20."""
    monkeypatch.setattr(vs, "PER_LIST", 50)
    monkeypatch.setattr(vs, "RECALL", 0.0)
    rng = np.random.default_rng(3)
    rows = [(i, (np.array([9.0, 0, 0, 0]) + 0.2 * rng.normal(size=4)).astype(np.float32)) for i in range(1, 600) if i % 20]
    rows += [(i, (np.array([0, 9.0, 0, 0]) + 0.001 * rng.normal(size=4)).astype(np.float32)) for i in (600, 620, 640)]
    got = rows_of(vs.search(frame(spark, rows)))
    assert [sum(g[0] == q for g in got) for q in (600, 620, 640)] == [20, 20, 20]


def test_neighbours_of_centres_in_blocks():
    c = np.random.default_rng(6).normal(size=(700, 5))
    apart = ((c[:, None] - c[None]) ** 2).sum(axis=2)
    np.fill_diagonal(apart, np.inf)
    assert (vs._neighbours(c, 7) == np.argsort(apart, axis=1, kind="stable")[:, :7]).all()
