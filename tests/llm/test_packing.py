import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ruleloom.llm import packing
from ruleloom.llm.packing import encoder, pack_documents, plan
from ruleloom.llm.queries import op4_best_fit_packing, table, vocabulary


def library(text):
    return np.asarray([*Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def place(steps):
    bins = {}
    for s, _, n, first, per, offset in steps:
        for k in range(n):
            bins.setdefault(first + k // per, []).append((offset + k % per * s, s))
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_gapless_and_near_the_bound(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 2049): rng.randrange(1, 60) for _ in range(rng.randrange(1, 80))}
    bins = place(plan(counts))
    assert sorted(s for b in bins.values() for _, s in b) == sorted(s for s, n in counts.items() for _ in range(n))
    for b in bins.values():
        end = 0
        for offset, size in sorted(b):
            assert offset == end
            end += size
        assert end <= 2048
        assert sum(3 * s > 2048 for _, s in b) <= 2
    bound = max(-(-sum(s * n for s, n in counts.items()) // 2048), sum(n for s, n in counts.items() if s > 1024))
    assert len(bins) <= 1.25 * bound + 2


def test_large_items_are_matched():
    assert len(place(plan({1300: 3, 700: 3}))) == 3
    assert len(place(plan({700: 5}))) == 3
    assert len(place(plan({1000: 2, 1048: 1, 1049: 1}))) == 3
    assert plan({}) == []


def texts_of(seed, n):
    """Random texts of letters, marks, white space and punctuation from all of Unicode, U+0130 and decomposing letters among them."""
    rng = random.Random(seed)

    def one():
        k = rng.random()
        if k < 0.35:
            return chr(rng.randrange(32, 127))
        if k < 0.55:
            return rng.choice(" \n\t\r\x0b\x0c\u00a0\u3000\x85\x1c'\"<|>.,;!?s$")
        if k < 0.85:
            return rng.choice("aB'sÉé漢😀ßΣςİıक़̇Kſŉǰﬁẞ" + chr(rng.randrange(0xA0, 0x600)))
        return chr(rng.choice([rng.randrange(0x600, 0xD800), rng.randrange(0xE000, 0x110000)]))

    return ["".join(one() for _ in range(rng.randrange(24))) for _ in range(n)]


def encoded(texts, path):
    ids, sizes = encoder(path)(pa.array(texts, pa.string()))
    ends = np.cumsum(sizes)
    return [ids[b - n : b].tolist() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


@pytest.mark.parametrize("seed", range(4))
def test_chunked_encoding_is_the_tokenizers(seed):
    tokenizer = Tokenizer.from_file(vocabulary())
    texts = [*texts_of(seed, 8000), "İ?", "KEDİ. EV", "KEDİ EV", "x<|endoftext|>.y", "it's. we'll! 's 't", "", None, "a" * 5000 + ". " + "b" * 60]
    for t, got in zip(texts, encoded(texts, vocabulary()), strict=True):
        assert got == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    texts = texts_of(9, 300)
    encode = encoder.__wrapped__(vocabulary())
    whole = encoded(texts, vocabulary())
    assert [encode(pa.array([t]))[0].tolist() for t in texts + texts] == whole + whole


def test_a_tokenizer_that_keeps_white_space_gets_whole_texts():
    path = vocabulary("byte_bpe_50k.json")
    assert packing.parts_at_space(vocabulary()) and not packing.parts_at_space(path)
    texts = ["two  words. here", " İ?", "", None]
    assert encoded(texts, path) == [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]


def check(rows, wanted):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_seq.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert set(by_doc) == set(wanted)
    for doc_id, text in wanted.items():
        ids = library(text)
        found = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in found] == [(k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    return len(by_seq)


def test_whole_table(spark, sf):
    wanted = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    rows = op4_best_fit_packing(spark, sf).collect()
    assert check(rows, wanted) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_nulls_long_texts_ties_and_empty_tables(spark, docs, words):
    rows = [(1, None), (2, ""), (3, " \n"), (4, " ".join(words(1, 9000))), (2**60 + 1, "same text"), (6, "same text")]
    check(pack_documents(docs(rows), vocabulary()).collect(), dict(rows))
    assert len(pack_documents(docs([(1, "a b"), (1, "a b"), (None, "a b")]), vocabulary()).collect()) == 3
    assert pack_documents(docs([]), vocabulary()).collect() == []
    ids = pack_documents(docs([(1, "to be")]), vocabulary(), with_ids=True).first().ids
    assert bytes(ids) == library("to be").tobytes()
