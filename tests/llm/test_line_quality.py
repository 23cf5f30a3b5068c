import zlib

import numpy as np
import pyarrow as pa

from ruleloom.llm.line_quality import _forward_backward, fit, keep_good, line_features, quality_scores, scores_of, train
from ruleloom.llm.queries import op5_line_quality, table


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    n_lines = np.array([3, 1, 5])
    score, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    got, pairs = _forward_backward(score, moves, n_lines)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in n_lines:
        want, total = np.zeros(n), 0.0
        here = np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(score[at + k] * y[k] for k in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total += w
            want += w * np.array(y)
            for a, b in zip(y, y[1:]):
                here[a, b] += w
        assert np.allclose(got[at : at + n], want / total)
        want_pairs += here / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_features_follow_lines():
    features, size, n_lines = line_features([b"ab CD\nx", b"", b"q\n\nq"])
    assert n_lines.tolist() == [2, 1, 3]
    assert size.tolist() == [5, 1, 0, 1, 0, 1]
    assert features.shape[0] == 6
    alone = line_features([b"q\n\nq"])[0]
    assert np.array_equal(features[3:], alone)


def test_whole_table_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op5_line_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert len(rows) == table(spark, sf, "documents").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.5)
    right = [rows[i].predicted == q for i, q in labels.items() if rows[i].held_out]
    assert np.mean(right) > 0.95


def test_nulls_empty_and_long_texts(spark, docs, words):
    chain = fit(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels"))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, " ".join(words(1, 20000))), (5, "WORDS!! OF!! JUNK!!\n" * 3000), (5, "WORDS!! OF!! JUNK!!\n" * 3000), (None, "x")]
    df = docs(rows)
    got = quality_scores(df, chain).collect()
    assert len(got) == len(rows)
    assert got[0].score == got[1].score
    assert [r.predicted for r in got if r.doc_id == 5] == [0, 0]
    kept = keep_good(df, chain)
    assert kept.schema == df.schema
    assert kept.count() == sum(r.predicted for r in got)
    assert quality_scores(docs([]), chain).collect() == []


def test_scores_do_not_depend_on_partitions_or_batches(spark):
    """Each distinct text has one score under every partitioning, batch size and order, also when scored alone."""
    docs, labels = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    chain = fit(docs, labels)
    both = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 1_000_000))
    scores = {}
    rows = {r.doc_id: r.text for r in both.select("doc_id", "text").collect()}
    for n, at_once in ((1, "10000"), (7, "3"), (3, "50")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
        for r in quality_scores(both.repartition(n, "doc_id"), chain).collect():
            scores.setdefault(rows[r.doc_id] or "", set()).add(r.score)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(len(s) == 1 for s in scores.values())
    assert all(scores_of(chain, pa.array([t]))[0] in s for t, s in list(scores.items())[:60])


def test_the_sample_is_bounded_in_lines(spark, docs):
    df = docs([(k, "good words here\n" * (1 + 40 * (k % 2))) for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    assert fit(df, labels, lines=30).weights.any() == fit(df, labels, lines=0).weights.any() == False  # noqa: E712  only one label fits, or none
    assert fit(df, labels, lines=2000).weights.any()


def test_without_labels_every_score_is_a_half(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    chain = fit(docs([(1, "a b")]), labels)
    assert scores_of(chain, pa.array(["some text", None])).tolist() == [0.5, 0.5]
    assert train(*[np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros(0, np.int64)]).weights.tolist() == [0, 0, 0]


def test_few_rows_are_those_of_the_least_hashes(spark):
    from pyspark.sql import functions as F

    from ruleloom.llm.shared import few

    ids = spark.range(5000).withColumn("h", F.xxhash64("id"))
    want = {r.id for r in ids.orderBy("h").limit(300).collect()}
    assert {r.id for r in few(spark.range(5000), "id", 300).collect()} == want
    assert few(spark.range(200), "id", 300).count() == 200
    assert few(spark.range(0), "id", 300).count() == 0
