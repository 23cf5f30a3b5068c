import random

import pytest

from ruleloom.llm import mixing
from ruleloom.llm.mixing import OTHER, calibrate, cells_of, keep_sampled, mix, rake
from ruleloom.llm.queries import op3_mixing, table


def shares(tokens, factors, k):
    out = {}
    for c, n in tokens.items():
        out[c[k]] = out.get(c[k], 0) + n * factors.get(c, 0)
    total = sum(out.values())
    return {v: n / total for v, n in out.items()}


def test_raking_meets_every_marginal():
    rng = random.Random(1)
    tokens = {(s, g, t): rng.randrange(1, 1000) for s in "abcd" for g in "xy" for t in "123"}
    targets = {"source": dict(a=0.1, b=0.2, c=0.3, d=0.4), "lang": dict(x=0.7, y=0.3), "topic": {"1": 0.2, "2": 0.5, "3": 0.3}}
    factors = rake(tokens, targets)
    for k, m in enumerate(mixing.MARGINALS):
        assert shares(tokens, factors, k) == pytest.approx(targets[m], abs=1e-8)
    assert rake({}, targets) == {}
    assert set(rake({("a", "x", "1"): 5.0}, targets)) == {("a", "x", "1")}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = op3_mixing(spark, sf).collect()
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.n_tokens == len((docs[r.doc_id].text or "").encode().split()) for r in rows)
    tokens = {}
    for r in rows:
        c = (r.source, r.lang, r.topic)
        tokens[c] = tokens.get(c, 0) + r.n_tokens
    total = sum(tokens.values())
    for k, m in enumerate(mixing.MARGINALS):
        own = {}
        for c, n in tokens.items():
            own[c[k]] = own.get(c[k], 0) + n / total
        power = {v: s**mixing.FLATTENING for v, s in own.items()}
        target = {v: p / sum(power.values()) for v, p in power.items()}
        weight = {(r.source, r.lang, r.topic): r.weight for r in rows}
        assert shares(tokens, weight, k) == pytest.approx(target, abs=1e-6)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(mixing.KEPT_SHARE * total, rel=1e-6)
    scale = max(r.probability / r.weight for r in rows if r.weight)
    assert all(r.probability == pytest.approx(min(1, scale * r.weight)) for r in rows if r.weight)
    assert abs(sum(r.n_tokens for r in rows if r.sampled) / total - mixing.KEPT_SHARE) < 0.05
    again = {r.doc_id: r.sampled for r in op3_mixing(spark, sf).collect()}
    assert again == {r.doc_id: r.sampled for r in rows}


def test_budget_named_targets_nulls_and_empty_tables(spark, docs, words):
    rows = [(k, " ".join(words(k, 30))) for k in range(200)] + [(300, None), (301, ""), (301, "")]
    df = docs(rows)
    targets = {"source": {"src0": 0.5, "none": 0.5}, "lang": {"en": 1.0}, "topic": {f"topic{k}": 1 / 8 for k in range(8)}}
    got = mix(df, targets, budget=3000).collect()
    assert sum(r.n_tokens * r.probability for r in got) == pytest.approx(3000, rel=1e-6)
    kept = keep_sampled(df, targets, budget=3000)
    assert kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.sampled)
    assert cells_of(targets) == 3 * 2 * 9
    assert mix(docs([])).collect() == []
    nulls = spark.createDataFrame([(1, "a b", None, None), (2, "a c", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.source for r in mix(nulls).collect()} == {1: OTHER, 2: "s"}
    measured = spark.createDataFrame([("s", "en", "topic0", 0)], "source string, lang string, topic string, n_tokens long")
    assert calibrate(measured, None).probabilities == {("s", "en", "topic0"): 1.0}


def test_sampled_marginals_meet_targets_within_capacity():
    rng = random.Random(4)
    tokens = {(s, g, t): float(rng.randrange(50, 150) * size * much) for s in "abcd" for g, size in (("x", 4), ("y", 1)) for t, much in (("1", 8), ("2", 4), ("3", 0.5))}
    targets = {"source": dict(a=0.3, b=0.3, c=0.2, d=0.2), "lang": dict(x=0.7, y=0.3), "topic": {"1": 0.5, "2": 0.3, "3": 0.2}}
    total = sum(tokens.values())
    found = mixing.sampling(tokens, targets, rake(tokens, targets), 0.6 * total)
    assert max(found.values()) == 1 and sum(n * found[c] for c, n in tokens.items()) == pytest.approx(0.6 * total)
    got = [shares(tokens, found, k) for k in range(3)]
    assert got[0] == pytest.approx(targets["source"], abs=1e-6)
    assert got[1] == pytest.approx(targets["lang"], abs=1e-6)
    # there is less of topic 3 than its target wants: it is kept whole, and the others meet theirs among themselves
    assert all(found[c] == 1 for c in tokens if c[2] == "3")
    assert got[2]["1"] / got[2]["2"] == pytest.approx(5 / 3, abs=1e-6)
    clipped = {c: min(1, 0.75 * f) for c, f in rake(tokens, targets).items()}
    assert abs(shares(tokens, clipped, 0)["a"] - 0.3) > 1e-3 or abs(shares(tokens, clipped, 1)["y"] - 0.3) > 1e-3


def test_the_mixture_with_its_copies_meets_the_targets(spark):
    """Shares of the expected copies, of every source, language and topic, against the targets; and the drawn ones near them."""
    sf = "/root/testdata/sf0.01"
    rows = op3_mixing(spark, sf).collect()
    assert all(r.copies in (int(r.expected), int(r.expected) + 1) and r.sampled == (r.copies > 0) for r in rows)
    for m in mixing.MARGINALS:
        own, wants, draws = {}, {}, {}
        for r in rows:
            own[r[m]] = own.get(r[m], 0) + r.n_tokens
            wants[r[m]] = wants.get(r[m], 0) + r.n_tokens * r.expected
            draws[r[m]] = draws.get(r[m], 0) + r.n_tokens * r.copies
        power = {v: (n / sum(own.values())) ** mixing.FLATTENING for v, n in own.items()}
        target = {v: p / sum(power.values()) for v, p in power.items()}
        assert {v: n / sum(wants.values()) for v, n in wants.items()} == pytest.approx(target, abs=1e-6)
        assert {v: n / sum(draws.values()) for v, n in draws.items()} == pytest.approx(target, abs=0.03)


def test_topics_are_those_of_a_second_derivation(spark):
    """Topics of the whole table from the centres of the same documents in other partitions, one document at a time."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got, centres = mixing.measure(docs.repartition(5))
    again = mixing.measure(docs.coalesce(1))[1]
    assert (centres == again).all()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in got.collect():
        n, v = mixing.bag(texts[r.doc_id])
        near = [sum(float(a) * float(b) for a, b in zip(v, c)) for c in centres]
        assert r.n_tokens == n and near[int(r.topic[5:])] == pytest.approx(max(near), rel=1e-9)


def test_clashing_names_long_texts_and_repeats(spark):
    rows = [(1, "a b c " * 30_000, "en", "s", 1.0, "x", 2), (1, "a b c " * 30_000, "en", "s", 1.0, "x", 2), (2, None, None, None, 0.0, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, DRAWN double, topic_of_text string, cell0 int")
    kept = keep_sampled(df, budget=10**9, repeat=False)
    assert kept.columns == df.columns and kept.count() == 3


def many_sources(spark):
    rng = random.Random(6)
    return spark.createDataFrame([(f"src{k}", g, f"topic{t}", rng.randrange(5, 50) * (2000 if k == 0 else 1 + k % 7)) for k in range(400) for g in ("en", "de") for t in range(2)], "source string, lang string, topic string, n_tokens long")


def test_every_source_has_its_marginal(spark):
    measured = many_sources(spark)
    tokens = {(r.source, r.lang, r.topic): r.n_tokens for r in measured.collect()}
    own = shares(tokens, dict.fromkeys(tokens, 1), 0)
    power = {v: s**mixing.FLATTENING for v, s in own.items()}
    want = {v: p / sum(power.values()) for v, p in power.items()}
    assert shares(tokens, calibrate(measured, None).factors, 0) == pytest.approx(want, abs=1e-7)


def test_tables_are_raked_as_on_the_driver(spark, docs, words, monkeypatch):
    measured = many_sources(spark)
    small = calibrate(measured, None)
    df = docs([(k, " ".join(words(k, 20))) for k in range(30)], "a").unionByName(docs([(100 + k, " ".join(words(k, 30))) for k in range(20)], "")).unionByName(docs([(200, None), (201, "a b")], None))
    before = sorted((r.doc_id, r.source, r.topic, r.sampled) for r in mix(df).collect())
    monkeypatch.setattr(mixing, "MOST_CELLS", 1)
    large = {(r.source, r.lang, r.topic): r for r in calibrate(measured, None).cells.collect()}
    assert {c: r.weight for c, r in large.items()} == pytest.approx(small.factors, rel=1e-3)
    assert {c: min(1, r.expected) for c, r in large.items()} == pytest.approx(small.probabilities, abs=1e-3)
    assert {c: r.expected for c, r in large.items()} == pytest.approx(small.expected, rel=2e-3)
    monkeypatch.setattr(mixing, "MOST_CELLS", 50_000)
    once = calibrate(measured, None, repeat=False).expected
    monkeypatch.setattr(mixing, "MOST_CELLS", 1)
    assert {(r.source, r.lang, r.topic): r.expected for r in calibrate(measured, None, repeat=False).cells.collect()} == pytest.approx(once, abs=1e-3)
    got = mix(df).collect()
    assert len(got) == 52 and sum(a != (r.doc_id, r.source, r.topic, r.sampled) for a, r in zip(before, sorted(got, key=lambda r: r.doc_id), strict=True)) <= 1
    kept = keep_sampled(df)
    assert kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.sampled)
