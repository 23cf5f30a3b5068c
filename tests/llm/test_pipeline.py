import corpus_pipeline
from ruleloom.llm.exact_dedup import keep_one
from ruleloom.llm.line_quality import fit, quality_scores
from ruleloom.llm.mixing import mix
from ruleloom.llm.near_dedup import keep_one_of_each
from ruleloom.llm.queries import table
from ruleloom.llm.shared import written

from .test_near_dedup import brute as classes

SF = "/root/testdata/sf0.01"


def az(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_stages_one_after_another(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    chain = fit(docs, table(spark, SF, "labels"))
    wanted = {r.doc_id for r in quality_scores(docs, chain).collect() if r.predicted}
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test")
        assert docs.columns == names, name
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert ids[0] == wanted
    last = {}
    for i in sorted(ids[0]):
        last[az(rows[i])] = i
    assert ids[1] == set(last.values())
    assert ids[2] == {i for i, c in classes([(i, rows[i]) for i in sorted(ids[1])]) if i == c}
    kept = spark.createDataFrame([(i,) for i in ids[2]], "doc_id long")
    assert ids[3] == {r.doc_id for r in mix(table(spark, SF, "documents").join(kept, "doc_id", "left_semi"), repeat=False).collect() if r.sampled}
    assert 0.6 * len(ids[2]) < len(ids[3]) < len(ids[2])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in out} == ids[3]
    assert sorted((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.piece, r.length) for r in out)


def test_clean_documents_stay_and_junk_goes(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).select("doc_id").collect()}
    right = [(r.doc_id in kept) == bool(r.quality) for r in labels.collect()]
    assert sum(right) / len(right) > 0.97


def test_filters_with_repeated_rows_nulls_and_empty_tables(spark, docs):
    rows = [(1, "Some text"), (2, "some TEXT"), (2, "some TEXT"), (3, None), (4, ""), (None, "Some text"), (5, "other")]
    assert sorted((r.doc_id or 0) for r in keep_one(docs(rows)).collect()) == [2, 4, 5]
    assert sorted((r.doc_id or 0, r.text) for r in keep_one(docs([(1, "a"), (1, "b"), (2, "B")])).collect()) == [(1, "a"), (2, "B")]
    near = keep_one_of_each(docs(rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in near) == [(0, "Some text"), (2, "some TEXT"), (3, ""), (5, "other")]
    for f in (keep_one, keep_one_of_each):
        assert f(docs([])).collect() == []
        assert f(docs(rows)).columns == docs(rows).columns
