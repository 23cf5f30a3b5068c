import random

from ruleloom.llm import line_dedup as module
from ruleloom.llm.line_dedup import BLANK, line_dedup
from ruleloom.llm.queries import op2_line_dedup, table


def brute(rows, run=2):
    """(id, lines, removed, text) of each row, by looking every window up among all windows."""
    first, split = {}, []
    for place, (i, t) in enumerate(rows):
        lines = (t or "").split("\n")
        full = [(k, x.strip(BLANK)) for k, x in enumerate(lines) if x.strip(BLANK)]
        split.append((i, t, lines, full))
    order = sorted(range(len(rows)), key=lambda p: (rows[p][0] is not None, rows[p][0] or 0, p))
    for p in order:
        full = split[p][3]
        for s in range(len(full) - run + 1):
            first.setdefault(tuple(x for _, x in full[s : s + run]), (p, s))
    out = []
    for p, (i, t, lines, full) in enumerate(split):
        gone = set()
        for s in range(len(full) - run + 1):
            if first[tuple(x for _, x in full[s : s + run])] != (p, s):
                gone.update(k for k, _ in full[s : s + run])
        out.append((i, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t))
    return out


def found(df):
    return sorted((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in df.collect())


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    wanted = brute(rows)
    assert sum(r[2] for r in wanted)
    assert found(op2_line_dedup(spark, sf)) == sorted(wanted)


def test_random_runs(spark, docs):
    rng = random.Random(4)
    rows = [(k, "\n".join(rng.choice(["a", "b", "c", "d", " e ", "", "f\r", "\tg\x0b", "g", "a\rz", "az", "longer line"]) for _ in range(rng.randrange(12)))) for k in range(120)]
    assert found(line_dedup(docs(rows))) == sorted(brute(rows))
    assert found(line_dedup(docs(rows), run=3)) == sorted(brute(rows, 3))


def test_nulls_ties_long_texts_and_empty_tables(spark, docs):
    rows = [(1, None), (2, ""), (3, "x\ny"), (4, "x\ny"), (5, "x\n\ny\nz"), (6, "q\n" * 4000)]
    got = found(line_dedup(docs(rows)))
    assert got == sorted((i, n, g, t or "") for i, n, g, t in brute(rows))
    assert sorted(r.n_removed for r in line_dedup(docs([(7, "x\ny"), (7, "x\ny")])).collect()) == [0, 2]
    assert [r.n_removed for r in line_dedup(docs([(1, "x\ny"), (None, "x\ny")])).orderBy("doc_id").collect()] == [0, 2]
    assert line_dedup(docs([])).collect() == []
    df = docs(rows)
    assert line_dedup(df).columns == [*df.columns, "n_lines", "n_removed"]


def test_only_selected_positions_are_stored(spark, docs, monkeypatch):
    """What is written of windows: one position for each minimum, and runs only around positions that several places share."""
    rng = random.Random(8)
    rows = [(k, "\n".join(f"line {rng.randrange(10**9)}" for _ in range(40))) for k in range(20)]
    rows.append((99, "\n".join(["x", *rows[0][1].split("\n")[10:14], "y"])))
    tables = {}

    def kept(df, name, *more):
        tables[name] = df.collect()
        return df.sparkSession.createDataFrame(tables[name], df.schema)

    monkeypatch.setattr(module, "written", kept)
    monkeypatch.setattr(module, "discard", lambda df: None)
    assert found(line_dedup(docs(rows), run=4)) == sorted(brute(rows, 4))
    lines = {r.row_id: r.h for r in tables["lines"]}
    minima = {(i, max(range(s, s + 4), key=lambda k: ([255 - b for b in h[k]], k))) for i, h in lines.items() for s in range(len(h) - 3)}
    assert {(r.row_id, r.p) for r in tables["positions"]} == minima and len(tables["positions"]) == len(minima)
    assert len(minima) < 0.6 * sum(map(len, lines.values()))
    shared = [r for r in tables["positions"] if r.fp in {f.fp for f in tables["fingerprints"]}]
    assert 0 < len(tables["runs"]) <= 4 * len(shared) < 40
    assert "windows" not in tables


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a\nb", 5, 6, 7), (2, "a\nb", 5, 6, 7)], "doc_id int, text string, N_LINES int, row_id int, doc int")
    got = line_dedup(df)
    assert got.columns == ["doc_id", "text", "row_id", "doc", "n_lines", "n_removed"]
    assert sorted(r.n_removed for r in got.collect()) == [0, 2]
