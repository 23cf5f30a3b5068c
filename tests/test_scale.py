"""Work that grows with what is asked for, not with the pairs behind it."""

import random

from pyspark.sql import functions as F

from ruleloom.functions.fuzzy import token_set
from ruleloom.operators import assign
from ruleloom.operators import rules as R
from ruleloom.plans import derived
from ruleloom.plans import queries as Q

RULES = "doc_id string, rule_id string, rule_ord int, item string, label_printed string, section string, subsection string, expected_kind string, rule_type string"
PRINTED = "doc_id string, field_ord int, key string, value string, section string, subsection string, kind string"


def test_alike_rules_and_fields_are_scored_once(spark):
    n = assign.CLASS_ROWS + 5
    rules = [("d", f"r{k}", k, "NAME OF SPOUSE", None, "", "", "text", "FIELD_TEXT") for k in range(n)] + [("d", "s", n, "COUNTY", "Name", "A", "", "text", "FIELD_TEXT"), ("e", "r0", 0, "PLACE", None, "", "", "text", "FIELD_TEXT")]
    fields = [("d", k, "name of the spouse", "x", "", "", "text") for k in range(3)] + [("d", 3, "of", "County", "b", "", "composite"), ("d", 4, "COUNTY", "UNKNOWN", "", "", None), ("d", 5, "", "x", "", "", "text"), ("e", 0, "county", "x", "", "", "text")]
    r, f = spark.createDataFrame(rules, RULES), spark.createDataFrame(fields, PRINTED)
    classes = assign.candidate_classes(r, f).collect()
    assert all(len(x["r_members"]) <= assign.CLASS_ROWS for x in classes)
    assert len(classes) == 2 * 2 + 3  # two rows of the alike rules for alike fields and for "of"; "s" with the first, with County and COUNTY
    pairs = assign.expanded(assign.candidate_classes(r, f)).collect()
    got = {(x["doc_id"], x["rule_id"], x["field_ord"]): x["score"] for x in pairs}
    spouse = token_set("NAME OF SPOUSE", "NAME OF THE SPOUSE")
    want = {("d", f"r{k}", o): spouse for k in range(n) for o in range(3)} | {("d", f"r{k}", 3): 100.0 for k in range(n)}
    want |= {("d", "s", o): 100.0 for o in range(3)} | {("d", "s", 3): 80.0 - 15.0, ("d", "s", 4): 100.0 - 5.0}
    assert got == want
    assert len(pairs) == len(want)
    assert sorted(pairs) == sorted(assign.candidates(r, f).collect())


def test_names_meet_once_however_often_they_occur(spark, tmp_path):
    copies = spark.range(3000).selectExpr("id AS p_partkey", "concat('name ', id % 3) AS p_name", "'B' AS p_brand", "'TYPE' AS p_type", "1 AS p_size", "1e0 AS p_retailprice")
    copies.write.parquet(str(tmp_path / "part.parquet"))
    pairs = derived._name_pairs(spark, str(tmp_path))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join") :].count("Aggregate") == 2  # both sides are distinct before they meet
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(f"name {k}", "TYPE name 0") for k in range(3)]
    assert sorted((r["a"], r["contained"]) for r in derived.fuzzy_containment(spark, str(tmp_path)).collect()) == [("name 0", True), ("name 1", False), ("name 2", False)]


def test_pictures_find_the_nearest_rule_without_meeting_all(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_AT_ONCE", 4)
    dice = random.Random(7)
    rules = [(s, f"r{k}", dice.randrange(100), dice.randrange(1, 200)) for s in "ab" for k in range(25)] + [("a", "odd", 3, None)]
    images = [(s, dice.randrange(-5, 220), dice.randrange(3)) for s in "abc" for _ in range(80)]
    r, i = spark.createDataFrame(rules, "sheet string, rule_id string, rule_ord int, row_index int"), spark.createDataFrame(images, "sheet string, row0 int, image_ord int")
    found = R.attach_images(r, i)
    want = {}
    for sheet, row0, image in images:
        near = [(abs(row - 1 - row0), o, rule) for s, rule, o, row in rules if s == sheet and row is not None]
        if near:
            want[sheet, row0, image] = (min(near)[2], min(near)[0] == 0)
    got = found.collect()
    assert len(got) == len(want)
    assert {(x["sheet"], x["row0"], x["image_ord"]): (x["rule_id"], x["exact_row"]) for x in got} == want
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and all(" AND " in x for x in joins)  # nothing meets by its sheet alone


def test_pairs_of_two_sides_are_accepted_without_being_made(spark):
    dice = random.Random(11)
    sides = [[(dice.choice("gh"), k, dice.randrange(9)) for k in dice.sample(range(1000), n)] for n in (90, 60)]
    left, right = spark.createDataFrame([*sides[0], ("g", None, 1), sides[0][0]], "g string, l long, l_class int"), spark.createDataFrame(sides[1] + [("i", 1, 1)], "g string, r long, r_class int")
    score = F.when(F.col("l_class") + F.col("r_class") != 5, (F.col("l_class") * F.col("r_class")) % 4)  # several classes meet at a score, and some have none
    pairs = left.filter("l is not null").distinct().join(right, "g").select("g", "l", "r", score.alias("score"))
    want = assign.greedy(pairs, ["g"], "l", "r", [("score", False), ("l", True), ("r", True)]).collect()
    got = assign.greedy_between(left, right, ["g"], score).collect()
    assert len(want) == len(got) >= 50
    assert {tuple(x) for x in got} == {tuple(x) for x in want}


def test_one_to_one_makes_no_pairs(spark, tmp_path):
    spark.range(60000).selectExpr("id AS c_custkey", "1 AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(50000).selectExpr("id AS s_suppkey", "1 AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = Q.QUERIES["one_to_one"](spark, str(tmp_path)).toPandas()  # of three thousand million pairs
    assert len(got) == got["s_suppkey"].nunique() == got["c_custkey"].nunique() == 50000
    assert ((got["c_custkey"] * 7 + got["s_suppkey"] * 13) % 50 == got["score"]).all()


def test_one_to_one_of_keys_below_zero(spark, tmp_path):
    spark.range(-40, 30).selectExpr("id AS c_custkey", "CAST(abs(id) % 3 AS INT) AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(-25, 50).selectExpr("id AS s_suppkey", "CAST(abs(id) % 3 AS INT) AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    one, two = (sorted(Q.QUERIES[n](spark, str(tmp_path)).collect()) for n in ("one_to_one", "one_to_one_by_rounds"))
    assert one and one == two
