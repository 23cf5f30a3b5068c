import hashlib
import random
import re

import numpy as np
import pytest

from ruleloom.llm.queries import op10_substring_dedup, table
from ruleloom.llm.substring_dedup import _sliding_min, substring_dedup, words_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window=13):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    wanted = brute(rows)
    assert sum(r[2] for r in wanted)
    assert found(op10_substring_dedup(spark, sf)) == wanted


def test_planted_passages_copies_ties_and_odd_spaces(spark, docs, words):
    rng = random.Random(3)
    passage = words(100, 60)
    rows = []
    for i in range(40):
        own = words(i, rng.randrange(0, 120))
        at = rng.randrange(len(own) + 1)
        cut = rng.randrange(50)
        rows.append((i * 3, " ".join(own[:at] + passage[cut : cut + rng.randrange(8, 20)] + own[at:])))
    rows += [(500 + k, rows[k][1]) for k in range(8)]
    rows += [(600, "a a a a a a a a a a a a a a a a"), (601, "a " * 14), (602, None), (603, ""), (604, " ".join(passage)), (605, "\x0b\x0c ".join(passage)), (606, " ".join(passage * 30))]
    assert found(substring_dedup(docs(rows))) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark, docs, words):
    text = " ".join(words(7, 40))
    got = found(substring_dedup(docs([(5, text), (5, text), (9, text), (9, "x " + text)])))
    assert [g[:3] for g in got] == [(5, 40, 0), (5, 40, 0), (9, 40, 40), (9, 41, 40)]
    assert substring_dedup(docs([])).collect() == []
    removed = {r.doc_id: r.n_removed for r in substring_dedup(docs([(None, text), (1, text)])).collect()}
    assert removed == {None: 0, 1: 40}


@pytest.mark.parametrize("n", range(1, 14))
def test_sliding_min(n):
    x = np.random.default_rng(n).integers(0, 99, 40)
    assert _sliding_min(x, n).tolist() == [x[k : k + n].min() for k in range(41 - n)]


def test_words():
    assert words_of("a\x0b b c\r\nd\x1ce") == [w.encode() for w in WORD.findall("a\x0b b c\r\nd\x1ce")]


def test_ids_of_text_and_clashing_names(spark, words):
    long = " ".join(words(2, 30))
    df = spark.createDataFrame([("b", f"x {long} y", 1, "p"), ("a", long, 2, "q"), (None, f"{long} z", 3, "r")], "doc_id string, text string, fps int, SHA string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(df).collect()}
    assert got == {None: (31, 0), "a": (30, 30), "b": (32, 30)}
