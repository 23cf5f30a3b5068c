"""Text, date, value and geometry functions on small tables of cases."""

import pytest
from pyspark.sql import functions as F

from ruleloom.functions import dates, fuzzy, geometry, text, values


def column(spark, inputs, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_clean(spark):
    assert column(spark, [None, "  a \t b c\x1cd ", ""], text.clean) == ["", "a b c d", ""]
    assert column(spark, ["Salt & pepper-mill"], text.label_norm) == ["SALT AND PEPPER MILL"]
    assert column(spark, ["DATE of the Last Marriage"], text.distinctive_tokens) == [["last", "marriage"]]
    assert column(spark, ["AB", "NOTE", "<x> note", "1234"], text.likely_static_label) == [False, True, False, False]


def test_dates(spark):
    cases = [("FORMAT: MM/DD/YYYY", "MM/DD/YYYY"), ("month, a comma and a year", "MONTH DD, YYYY"), ("MONTH DD YYYY", "MONTH DD YYYY"), ("MAY 5, 2020", "MONTH DD, YYYY"), ("nothing", None)]
    assert column(spark, [c for c, _ in cases], lambda c: dates.infer_pattern(c, F.lit(""), F.lit(""))) == [w for _, w in cases]
    for pattern, good in (("MM/DD/YYYY", "04/27/2026"), ("MONTH DD, YYYY", "April 27, 2026"), ("MONTH DD YYYY", "APRIL 27 2026")):
        assert column(spark, [good, "x", None], lambda c, p=pattern: dates.matches_pattern(c, F.lit(p))) == [True, False, False]
    assert column(spark, ["05/06/2020 MAY 5, 2020 MAY 5, 2020"], dates.extract) == [["MAY 5, 2020", "05/06/2020"]]


def test_placeholders_and_shapes(spark):
    cases = {"": True, "N/A": True, "Unknown, UNKNOWN": True, "99999": True, "999 99": True, ": none :": True, "\x18\x18": True, "UNKNOWN street": False, "98": False}
    assert column(spark, [*cases], values.is_placeholder) == [*cases.values()]
    assert column(spark, ["NOVEMBER 30, 1999", "É1"], values.format_signature) == ["A 9, 9", "A9"]
    assert column(spark, ["10 pt", "x", "4.5 or shrink"], values.first_number) == [10.0, None, 4.5]
    assert column(spark, ["a 123-45-6789 b", None], values.mask_pii) == ["a ***-**-**** b", None]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Yes-unselected;No-selected", [("Yes", "unselected"), ("No", "selected")]),
        ("Divorce:unselected, Death:selected", [("Divorce", "unselected"), ("Death", "selected")]),
        ("Divorce :unselected: Death :selected:", [("Divorce", "unselected"), ("Death", "selected")]),
        ("", []),
    ],
)
def test_checkbox_options(spark, value, want):
    assert [(o["label"], o["state"]) for o in column(spark, [value], values.checkbox_options)[0]] == want


@pytest.mark.parametrize(
    ("example", "kind", "options"),
    [("Divorce:unselected, Death:selected", "checkbox_group", ["Divorce", "Death"]), ("Yes / No", "checkbox_group", ["Yes", "No"]), ("[divorce, death]", "checkbox_group", ["divorce", "death"]), ("Smith, John", "text", []), ("NOVEMBER 30, 1999", "date", []), ("", None, []), ("First Name", "text", [])],
)
def test_examples(spark, example, kind, options):
    got = column(spark, [example], values.parse_example)[0]
    assert (got["kind"], got["options"]) == (kind, options)
    if example == "First Name":
        assert column(spark, [example], lambda c: values.parse_example(c, None, True))[0]["options"] == ["First", "Name"]


def test_options_from_instruction(spark):
    assert column(spark, ["place an X in the Groom checkbox or in the Mail to A checkbox, in the groom checkbox"], values.options_from_instruction) == [["Groom", "Mail to A"]]


def test_similarity():
    assert round(fuzzy.sequence("COUNTRY", "COUNTY"), 2) == 92.31
    assert round(fuzzy.token_set("WISCONSIN MARRIAGE LICENSE APPLICATION", "LICENSE FEE"), 2) == 77.78
    assert fuzzy.token_set("", "A") == 0
    assert fuzzy.token_set("A B", "B A C") == 100
    assert fuzzy.token_sort("B A", "A B") == 100


@pytest.mark.parametrize("seed", range(20))
def test_lcs(seed):
    import random

    rng = random.Random(seed)
    a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert fuzzy.lcs(a, b) == table[-1][-1]


def test_scores_meet_their_pairs(spark):
    df = spark.createDataFrame([("A B", "B A"), ("A", None), (None, None), ("X", "Y")], "a string, b string")
    got = {(r.a, r.b): r.s for r in fuzzy.with_scores(df, "a", "b", "s").collect()}
    assert got == {("A B", "B A"): 100.0, ("A", None): 0.0, (None, None): 0.0, ("X", "Y"): 0.0}


def test_boxes(spark):
    df = spark.range(1).select(geometry.box(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.0)).alias("a"), geometry.box(F.lit(1.0), F.lit(0.0), F.lit(3.0), F.lit(1.0)).alias("b"), F.array(*map(F.lit, [1.0, 5.0, 3.0, 2.0])).alias("p"))
    row = df.select(geometry.overlap_ratio("a", "b").alias("o"), geometry.overlap_ratio("a", "a").alias("s"), geometry.center_inside("a", "a").alias("i"), geometry.center_inside("b", "a", 0.1).alias("j"), geometry.from_polygon("p").alias("q")).first()
    assert (row.o, row.s, row.i, row.j, tuple(row.q)) == (0.5, 1.0, True, True, (1.0, 2.0, 3.0, 5.0))
