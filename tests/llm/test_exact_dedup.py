import hashlib
import random

import pytest

from ruleloom.llm.exact_dedup import exact_dedup, keep_one
from ruleloom.llm.queries import op6_exact_dedup, table


def az(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(az(t), []).append(i)
    return sorted((i, max(groups[az(t)]), len(groups[az(t)]), i == max(groups[az(t)]), hashlib.sha256(az(t).encode()).hexdigest()) for i, t in rows)


def found(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    wanted = brute(rows)
    assert any(r[2] > 1 for r in wanted)
    assert found(op6_exact_dedup(spark, sf)) == wanted


@pytest.mark.parametrize("block", [1, 3, 7])
def test_names_of_every_length(spark, docs, block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("aAbÉé") for _ in range(rng.randrange(0, 24))) for _ in range(60)]
    rows = [*enumerate(texts + [t.upper() for t in texts] + [None, ""])]
    assert found(exact_dedup(docs(rows), block_chars=block)) == brute(rows)


def test_long_texts_repeated_rows_null_ids_and_empty_tables(spark, docs):
    long = "Abc é\n" * 30000
    rows = [(1, long), (2, long.lower()), (3, long + "x"), (4, "x" + long)]
    assert found(exact_dedup(docs(rows))) == brute(rows)
    got = exact_dedup(docs([(7, "a"), (7, "A"), (None, "a"), (None, "b")])).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == sorted([(7, 7, 3, False), (7, 7, 3, True), (None, 7, 3, False), (None, None, 1, True)], key=str)
    assert exact_dedup(docs([])).collect() == []


def test_clashing_names_and_null_ids(spark):
    rows = [(1, "A", 1, 2, 3, 4), (2, "a", 1, 2, 3, 4), (None, "b", 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id int, text string, __sha int, __id int, KEPT_ID int, sha_of_text int")
    for some in (df, df.unionByName(df)):
        kept = keep_one(some)
        assert kept.columns == df.columns
        assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:], key=str)
