import random

import numpy as np
import pytest

from ruleloom.llm import near_dedup as nd
from ruleloom.llm.components import components
from ruleloom.llm.dart_minhash import signatures
from ruleloom.llm.queries import op7_minhash_near_dedup, table
from ruleloom.llm.shared import written


def brute(rows, least=0.8):
    """class id of each row, by comparing all distinct texts that share a shingle."""
    nodes = {}
    for i, t in rows:
        nodes.setdefault(tuple(nd.words_of(t)), []).append(i)
    keys = list(nodes)
    sets = [nd.shingles(list(k), 5) for k in keys]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = {}
    for x, s in enumerate(sets):
        for y in {y for e in s for y in holders.get(e, ())}:
            if find(x) != find(y) and nd.similarity(s, sets[y]) >= least:
                root[find(x)] = find(y)
        for e in s:
            holders.setdefault(e, []).append(x)
    lowest = {}
    for x, k in enumerate(keys):
        lowest[find(x)] = min([lowest.get(find(x), 2**63), *nodes[k]])
    return sorted((i, lowest[find(x)]) for x, k in enumerate(keys) for i in nodes[k])


def found(df):
    rows = df.collect()
    kept = [r.class_id for r in rows if r.kept]
    assert len(kept) == len(set(kept)) == len({r.class_id for r in rows})
    assert all(r.doc_id == r.class_id for r in rows if r.kept)
    return sorted((r.doc_id, r.class_id) for r in rows)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    wanted = brute(rows)
    assert any(a != b for a, b in wanted)
    assert found(op7_minhash_near_dedup(spark, sf)) == wanted


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**9)}"
    return " ".join(out)


def test_a_large_group_of_near_copies(spark, docs, words, monkeypatch):
    rng = random.Random(9)
    base = words(1, 120)
    rows = [(k, edited(base, rng, rng.randrange(0, 9))) for k in range(160)] + [(1000 + k, " ".join(words(50 + k, 80))) for k in range(20)]
    monkeypatch.setattr(nd, "SMALL_BUCKET", 6)
    assert found(nd.near_dedup(docs(rows))) == brute(rows)


def test_links_of_texts_that_share_only_large_buckets(spark, docs, words, monkeypatch):
    base = words(1, 100)
    rows = [(2 * k + copy, " ".join([*base, *words(100 + k, 14), f"end{2 * k + copy}"])) for k in range(24) for copy in (0, 1)]
    wanted = brute(rows)
    assert len({c for _, c in wanted}) == 24
    monkeypatch.setattr(nd, "BANDS", 4)
    monkeypatch.setattr(nd, "ROWS", 1)
    assert found(nd.near_dedup(docs(rows))) == wanted


def test_pairs_by_prefix_are_all_pairs_that_are_alike(spark):
    """Candidates of the exact join against all pairs, over texts of mixed lengths that share rare and frequent words."""
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(60)}" for _ in range(n)] for n in (3, 7, 30, 31, 33, 120)]
    texts = []
    for base in bases * 12:
        out = list(base)
        for _ in range(rng.randrange(0, 1 + len(out) // 12)):
            at = rng.randrange(len(out) + 1)
            out[at : at + rng.randrange(2)] = [f"w{rng.randrange(60)}"] * rng.randrange(3)
        texts.append(b" ".join(x.encode() for x in out))
    pack = nd.zstandard.ZstdCompressor()
    rows = written(spark.createDataFrame([(i, bytearray(pack.compress(t))) for i, t in enumerate(texts)], "node long, packed binary"), "texts")
    nodes = written(rows.select("node"), "nodes")
    labels = rows.select("node", rows.node.alias("comp"))
    sets = [nd.shingles(t.split(), 5) for t in texts]
    alike = {(a, b) for b in range(len(sets)) for a in range(b) if nd.similarity(sets[a], sets[b]) >= 0.8}
    got = {(r.a, r.b) for r in nd.prefix_pairs(nodes, labels, rows, 5, 0.8).collect()}
    assert len(alike) > 100 and alike <= got
    assert len(got) < len(texts) * (len(texts) - 1) // 4


def test_columns_with_clashing_names_and_ids_of_text(spark):
    rows = [("b", "one two three four five six", 1, 2, 3), ("a", "one two three four five six", 4, 5, 6), ("c", None, 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id string, text string, kept_id int, __id int, first_of_ID int")
    kept = nd.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[2]], key=str)
    twice = nd.keep_one_of_each(df.unionByName(df))
    assert sorted(map(tuple, twice.collect()), key=str) == sorted([rows[1], rows[2]], key=str)


def test_nulls_short_and_long_texts_ties_and_empty_tables(spark, docs, words):
    long = words(3, 20000)
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "one two"), (6, "one  two"), (7, "two one"), (8, " ".join(long)), (9, " ".join([*long[:-1], "x"])), (10, "a " * 400), (11, "a " * 390)]
    assert found(nd.near_dedup(docs(rows))) == brute(rows)
    assert found(nd.near_dedup(docs([]))) == []
    got = nd.near_dedup(docs([(5, "p q r s t u"), (5, "p q r s t u"), (None, "p q r s t u")])).collect()
    assert sorted((r.doc_id is None, r.class_id, r.class_size, r.kept) for r in got) == [(False, None, 3, False)] * 2 + [(True, None, 3, True)]


@pytest.mark.parametrize(("top", "want"), [(1, 0.5), (5, 0.75)])
def test_signatures_estimate_weighted_similarity(top, want):
    got = []
    for seed in range(12):
        rng = np.random.default_rng(seed)
        e = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a = rng.integers(1, top + 1, 300).astype(float)
        b = a.copy()
        b[rng.permutation(300)[: 300 // 2]] = 0 if top == 1 else 1
        held = b > 0
        s = signatures(np.concatenate([e, e[held]]), np.concatenate([np.zeros(300, int), np.ones(held.sum(), int)]), np.concatenate([a, b[held]]), 2, 256, seed)
        got.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(got)) < 0.03


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict((r.node, r.comp) for r in components(written(spark.createDataFrame(edges, "a long, b long"), "edges")).collect())
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100}
