"""The audit's operators on hand-made pages, and their expectations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ruleloom.operators import assign as A
from ruleloom.operators import checkboxes, checks, guard, layout, outcome, providers
from ruleloom.operators import rules as R
from ruleloom.operators.containment import contained, diff, nearest
from ruleloom.operators.overlay import label_variants, overlay
from ruleloom.plans.audit import audit, coverage, flat_fields
from ruleloom.schemas import FIELDS, KV_PAIRS, LINES, RULES
from ruleloom.sources import analysis, sinks
from ruleloom.streaming import ingest

NAMES = [c.split()[0] for c in RULES.split(", ")]


def rule(n, item, **more):
    given = {"sheet": "S", "rule_ord": n, "rule_id": f"S-{n:04d}", "row_index": n + 1, "item": item, "expected_options": [], "part_labels": [], "part_separators": [], "rule_type": "UNKNOWN"} | more
    return tuple(given.get(c) for c in NAMES)


def rules_table(spark, *rows):
    return spark.createDataFrame([*rows], RULES)


def box(x0, y0, x1, y1):
    return (x0, y0, x1, y1)


def field(n, key, value, kind="text", page=1, at=None, section=None, subsection=None, doc="d"):
    return (doc, n, page, kind, section, subsection, key, value, None, at or box(0.1, 0.2 + n * 0.05, 0.5, 0.21 + n * 0.05), None, 0.9, None)


CASE_RULES = [
    rule(1, "LICENSE FEE", instruction="PRINT <Fee>", max_chars="4"),
    rule(2, "REISSUE LICENSE FEE", instruction="PRINT <Reissue Fee>"),
    rule(3, "DATE OF BIRTH", instruction="FORMAT: <month> space <dd> comma space <yyyy>", example="NOVEMBER 30, 1999", expected_kind="date", part_labels=["month", "dd", "yyyy"], part_separators=["", " ", ", "]),
    rule(4, "PHONE NUMBER", instruction="PRINT <Phone Number>"),
    rule(5, "NOTICE TEXT"),
]
CASE_FIELDS = [field(0, "LICENSE FEE", "50.00"), field(1, "REISSUE LICENSE FEE", ""), field(2, "DATE OF BIRTH", "APRIL 27, 2026"), field(3, "PHONE NUMBER", "UNKNOWN"), field(4, "EXTRA NOTE", "ABC")]


@pytest.fixture(scope="module")
def case(spark):
    documents = spark.createDataFrame([("d", "S", "")], "doc_id string, sheet string, full_text string")
    rows = audit(R.classify(rules_table(spark, *CASE_RULES)), spark.createDataFrame(CASE_FIELDS, FIELDS), documents)
    return rows.cache()


def test_golden_case(case):
    got = {r.id: r for r in case.collect()}
    assert {k: (r.internal_status, r.reviewer_status, r.match_score) for k, r in got.items()} == {
        "CMP-0001": ("FAIL", "FAIL", 100.0), "CMP-0002": ("MISSING_DATA", "PASS", 95.0), "CMP-0003": ("PASS", "PASS", 100.0), "CMP-0004": ("UNKNOWN_DATA", "PASS", 95.0), "CMP-0005": ("NOT_VALIDATED", None, 0.0), "CMP-0006": ("NOT_VALIDATED", None, 0.0),
    }
    assert got["CMP-0003"].source == "ATOMIC_COMPLETE_LABEL"
    assert got["CMP-0006"].di_value == "ABC"
    assert got["CMP-0001"].sequence_state == "MATCHED"
    assert {(r.status, r.n) for r in sinks.summary(case).collect()} == {("FAIL", 1), ("PASS", 3)}
    assert tuple(coverage(case).first()) == ("d", 5, 4, 0, 1)
    assert sinks.flat_records(case).count() == 5
    assert sinks.results(case).count() == 4


def test_result_does_not_depend_on_row_order(spark, case):
    rng = random.Random(2)
    documents = spark.createDataFrame([("d", "S", "")], "doc_id string, sheet string, full_text string")
    rows = audit(R.classify(rules_table(spark, *rng.sample(CASE_RULES, 5))).repartition(3), spark.createDataFrame(rng.sample(CASE_FIELDS, 5), FIELDS).repartition(3), documents)
    same = ["id", "status", "di_key", "di_value", "match_score"]
    assert sorted(map(tuple, rows.select(same).collect())) == sorted(map(tuple, case.select(same).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_rounds_are_greedy(spark, seed):
    rng = random.Random(seed)
    pairs = spark.createDataFrame([("g", a, b, float(rng.randrange(5))) for a in range(7) for b in range(6) if rng.random() < 0.7], "g string, a int, b int, score double")
    order = [("score", False), ("a", True), ("b", True)]
    one = A.greedy(pairs, ["g"], "a", "b", order).collect()
    assert sorted(one) == sorted(A.by_rounds(pairs, ["g"], "a", "b", order).collect())


def composite(spark, parts, fields, item="APPLICANT NAME"):
    r = rules_table(spark, rule(1, item, part_labels=parts, part_separators=[""] + [" "] * (len(parts) - 1), rule_type="FIELD_TEXT")).withColumn("doc_id", F.lit("d"))
    return A.assign(r, flat_fields(spark.createDataFrame(fields, FIELDS))).collect()


def test_parts_on_one_line_become_one_value(spark):
    line = [field(n, k, v, at=box(x, 0.2, x + 0.1, 0.21)) for n, (k, v, x) in enumerate([("APPLICANT NAME First", "ALICE", 0.1), ("Middle", "B", 0.25), ("Last", "SMITH", 0.4), ("Suffix", "", 0.55)])]
    (got,) = composite(spark, ["First", "Middle", "Last", "Suffix"], line)
    assert (got.value, got.key, got.complete, len(got.members)) == ("ALICE B SMITH", "APPLICANT NAME", True, 4)
    gap = [line[0], line[1][:7] + ("",) + line[1][8:], *line[2:]]
    parts = composite(spark, ["First", "Middle", "Last", "Suffix"], gap)[0].parts
    df = spark.createDataFrame([([(p.key, p.value) for p in parts],)], "p array<struct<key:string,value:string>>")
    assert df.select(checks.part_gaps(F.col("p")).alias("c")).first().c.actual == "blank: Middle"


def test_a_lone_part_is_incomplete_and_a_full_label_is_whole(spark):
    assert composite(spark, ["First", "Last"], [field(0, "APPLICANT NAME First", "A")])[0].complete is False
    assert composite(spark, ["First", "Last"], [field(0, "APPLICANT NAME", "A B")])[0].complete is True
    siblings = [field(0, "WITNESS 1 NAME - First, Middle, Last", "A", at=box(0.1, 0.2, 0.2, 0.21)), field(1, "WITNESS 2 NAME - First, Middle, Last", "B", at=box(0.4, 0.2, 0.5, 0.21))]
    assert len(composite(spark, ["First", "Middle", "Last"], siblings, "WITNESS 1 NAME - First, Middle, Last")[0].members) == 1


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (dict(item="Waiver", instruction="THEN place X in Yes checkbox"), "CHECKBOX"),
        (dict(item="BIRTHPLACE - U.S. State/Territory", instruction="PRINT <Value>"), "FIELD_TEXT"),
        (dict(item="OFFICIANT MAILING ADDRESS", instruction="PRINT <Address> FORMAT: <Street> comma <City>", example="a comma-separated US address"), "FIELD_TEXT"),
        (dict(item="DATE OF MARRIAGE", instruction="FORMAT: <month> space <dd> comma space <yyyy>", example="APRIL 27, 2026"), "DATE_FORMAT"),
        (dict(item="Applicant 1 Name:", instruction="FORMAT: <First> + <Last>", expected_kind="date", part_labels=["First", "Middle", "Last", "Suffix"]), "FIELD_TEXT"),
        (dict(item="DATE OF EVENT", instruction="FORMAT: <month> <dd> <yyyy>", example="APRIL 27, 2026", expected_kind="date", part_labels=["month", "dd", "yyyy"]), "DATE_FORMAT"),
        (dict(item="A NOTICE"), "STATIC_TEXT"),
        (dict(item="X", if_missing="Leave blank"), "NO_PRINT_RULE"),
        (dict(item="X", instruction="see form"), "TEXT_OR_LAYOUT"),
    ],
)
def test_rule_types(spark, given, want):
    item = given.pop("item")
    assert R.classify(rules_table(spark, rule(1, item, **given))).first().rule_type == want


def identity_of(spark, item, key, **more):
    given = {"item": item, "di_key": key, "section": None, "subsection": None, "di_section": None, "di_subsection": None} | more
    return guard.identity(spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given))).first().identity


def test_identity(spark):
    assert identity_of(spark, "DATE LAST MARRIAGE ENDED", "DATE OF MARRIAGE", section="A", di_section="B").confident is False
    assert identity_of(spark, "OFFICIANT NAME", "Officiant Name", section="A", di_section="A").confident is True
    lone = identity_of(spark, "COUNTRY", "County")
    assert lone.confident is False
    assert "generic-only" in lone.reasons[0]
    assert identity_of(spark, "COUNTRY", "Country").confident is True
    assert spark.range(1).select(guard.clamp_score(F.lit("122"))).first()[0] == 100.0


ROW = "doc_id string, rule_id string, rule_type string, section string, subsection string, item string, instruction string, if_unknown string, matched boolean, match_score double, status string, di_kind string, di_section string, di_subsection string, di_key string, di_value string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, confidence double, checks array<struct<name:string,status:string,expected:string,actual:string,message:string>>, message string, expected_parts array<string>, complete boolean, payload_ok boolean, instruction_mode string, subsection_conflict boolean, sequence_state string, recovered boolean"


def outcome_of(spark, guarded=True, **more):
    given = {"doc_id": "d", "rule_id": "r", "rule_type": "FIELD_TEXT", "item": "OFFICIANT NAME", "matched": True, "match_score": 100.0, "status": "PASS", "di_kind": "text", "di_key": "OFFICIANT NAME", "di_value": "X", "page": 1, "bbox": (0.1, 0.1, 0.2, 0.2), "checks": [("presence", "PASS", "", "", "ok")], "expected_parts": []} | more
    names = [c.split()[0] for c in ROW.split(", ")]
    df = spark.createDataFrame([tuple(given.get(n) for n in names)], ROW)
    df = guard.reject_unsafe(df) if guarded else df.withColumn("identity", F.lit(None).cast("struct<confident:boolean,label_score:double,rule_coverage:double,field_coverage:double,reasons:array<string>>"))
    return outcome.reviewed(guard.shared_boxes(df)).first()


def test_outcomes(spark):
    fail = [("max_chars", "FAIL", "", "", "too long")]
    line = dict(expected_parts=["First", "Last"], complete=True, if_unknown="print on a single line")
    assert outcome_of(spark, status="MISSING_DATA", di_value="", checks=[("presence", "MISSING_DATA", "", "", "blank")]).status == "PASS"
    assert outcome_of(spark, di_key="WITNESS ADDRESS").status == "REVIEW_REQUIRED"
    rejected = outcome_of(spark, expected_parts=["First", "Last"], complete=False)
    assert (rejected.status, rejected.di_key, rejected.match_score) == ("REVIEW_REQUIRED", None, 0.0)
    assert outcome_of(spark, rule_type="CHECKBOX", di_kind="checkbox_group", di_value="options-selected;score-unselected").status == "REVIEW_REQUIRED"
    assert outcome_of(spark, di_value="UNKNOWN", bbox=None, **line).status == "REVIEW_REQUIRED"
    assert outcome_of(spark, di_value="UNKNOWN UNKNOWN", **line).status == "FAIL"
    assert outcome_of(spark, di_value="UNKNOWN", **line).status == "PASS"
    assert outcome_of(spark, status="FAIL", checks=fail).status == "FAIL"
    assert outcome_of(spark, status="FAIL", checks=fail, instruction_mode="FORMAT_EXAMPLE_ONLY").status == "REVIEW_REQUIRED"
    assert outcome_of(spark, sequence_state="REVIEW_REQUIRED").status == "REVIEW_REQUIRED"
    assert outcome_of(spark, guarded=False, match_score=70.0).status == "REVIEW_REQUIRED"
    assert outcome_of(spark, rule_type="UNMATCHED_FIELD", status="NOT_VALIDATED").reviewer_status is None


def test_one_box_for_two_keys_is_not_trusted(spark):
    df = spark.createDataFrame([("d", True, "A", 1, (0.1, 0.1, 0.2, 0.2)), ("d", True, "B", 1, (0.1, 0.1, 0.2, 0.2)), ("d", True, "C", 1, (0.3, 0.1, 0.4, 0.2))], "doc_id string, matched boolean, di_key string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert {r.di_key: (r.geometry_trusted, r.bbox is None) for r in guard.shared_boxes(df).collect()} == {"A": (False, True), "B": (False, True), "C": (True, False)}


def kv(n, key, value, x0, y0, x1, y1, page=1, doc="d"):
    return (doc, page, n, key, value, box(x0, y0, x1, y1), box(x0, y0, x1, y1), 0.9)


def test_options_beside_a_label(spark):
    boxes = [kv(n, k, v, cx - 0.01, 0.50, cx + 0.01, 0.51) for n, (k, v, cx) in enumerate([("Divorce", ":selected:", 0.4206), ("Death", ":unselected:", 0.4935), ("Annulment", ":unselected:", 0.5723)])]
    pairs = spark.createDataFrame(boxes, KV_PAIRS)
    anchors = spark.createDataFrame([("d", 1, box(0.399, 0.50, 0.604, 0.51), ["Divorce", "Death", "Annulment", "Other"], 1)], "doc_id string, page int, label_bbox struct<x0:double,y0:double,x1:double,y1:double>, options array<string>, k int")
    got = checkboxes.regroup(anchors, pairs, ["k"]).first()
    assert [(o.label, o.state) for o in got.found] == [("Divorce", "selected"), ("Death", "unselected"), ("Annulment", "unselected")]
    assert (got.matched, got.expected, got.confidence) == (3, 4, 0.75)
    assert [b.dx for b in checkboxes.boxes_on_row(anchors, pairs, ["k"]).first().boxes] == pytest.approx([0.0216, 0.0945, 0.1733])
    assert [tuple(o) for o in spark.range(1).select(F.array(*(checkboxes.normalize_option(F.lit(t)) for t in ("Yes-selected", "No:unselected", "Maybe")))).first()[0]] == [("Yes", True), ("No", False), ("Maybe", False)]


def page(spark):
    lines = [("d", 1, 0, "SECTION ONE", box(0.02, 0.1, 0.04, 0.5)), ("d", 1, 1, "PARTY A", box(0.06, 0.1, 0.08, 0.5)), ("d", 1, 2, "ENDED BY", box(0.2, 0.26, 0.29, 0.275)), ("d", 1, 3, "FULL NAME", box(0.2, 0.14, 0.3, 0.15)), ("d", 1, 4, "FEE", box(0.2, 0.40, 0.25, 0.41))]
    pairs = [kv(0, "Divorce", ":selected:", 0.2, 0.30, 0.22, 0.31), kv(1, "Death", ":unselected:", 0.3, 0.30, 0.32, 0.31), kv(2, "First", "ANN", 0.2, 0.18, 0.28, 0.19), kv(3, "Last", "LEE", 0.4, 0.181, 0.48, 0.191), kv(4, "FEE", "5", 0.2, 0.40, 0.4, 0.41), kv(5, "Race", ":selected:", 0.7, 0.8, 0.72, 0.81)]
    return spark.createDataFrame(pairs, KV_PAIRS), spark.createDataFrame(lines, LINES)


def test_structure_of_a_page(spark):
    got = layout.structure(*page(spark)).orderBy("field_ord").collect()
    assert [(r.kind, r.key, r.value_text, r.section, r.subsection) for r in got] == [("composite", None, None, "SECTION ONE", "PARTY A"), ("checkbox_group", "ENDED BY", "Divorce-selected;Death-unselected", "SECTION ONE", "PARTY A"), ("text", "FEE", "5", "SECTION ONE", "PARTY A"), ("checkbox_group", "Race", "Race-selected", None, None)]
    assert [(p.key, p.value) for p in got[0].value_parts] == [("First", "ANN"), ("Last", "LEE")]
    assert tuple(got[1].label_bbox) == (0.2, 0.26, 0.29, 0.275)
    assert tuple(got[2].label_bbox) == (0.2, 0.40, 0.25, 0.41)
    kv_pairs, lines = page(spark)
    again = layout.structure(kv_pairs.orderBy(F.rand(1)).repartition(3), lines.orderBy(F.rand(2))).orderBy("field_ord").collect()
    assert again == got


def test_over_merged_rows_are_split(spark):
    kv_pairs = spark.createDataFrame([kv(0, "MAILING ADDRESS", "X", 0.5, 0.2, 0.6, 0.21), kv(1, "First", "A", 0.1, 0.2, 0.2, 0.21)], KV_PAIRS)
    lines = spark.createDataFrame([], LINES)
    got = layout.split_composites(layout.structure(kv_pairs, lines)).orderBy("field_ord").collect()
    assert [(r.field_ord, r.kind, r.key, r.value_text) for r in got] == [(0, "text", "First", "A"), (1, "text", "MAILING ADDRESS", "X")]


def test_rows_reach_from_their_first_item_only(spark):
    df = spark.createDataFrame([("k", 0.100, 1), ("k", 0.108, 2), ("k", 0.116, 3), ("k", 0.118, 4)], "g string, y double, i int")
    assert {r.i: r.row_no for r in layout.row_groups(df, ["g"], "y", ["i"]).collect()} == {1: 1, 2: 1, 3: 2, 4: 2}


def test_boxes_are_repaired_in_rule_order(spark):
    kv_pairs, lines = page(spark)
    fields = layout.structure(kv_pairs, lines).withColumn("label_bbox", F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"))
    r = rules_table(spark, rule(1, "ENDED BY", expected_options=["Death", "Divorce"], expected_kind="checkbox_group")).withColumn("doc_id", F.lit("d"))
    got = {x.key: x.value_text for x in checkboxes.repair(r, fields, kv_pairs).collect()}
    assert got["ENDED BY"] == "Death-unselected;Divorce-selected"


def test_sheet_to_rules(spark):
    head = ["Section", "Item Name and Number", "Printing Instructions", "Example", "Max. Chars.", "If Shrink to fit needed Char size", "Char. Size"]
    rows = [["Attachment E"], head, ["ONE", "FEE", "PRINT <Fee>", "50.00", "4", "6", "10"], [], ["", "STATUS", "place an X in the Yes checkbox and in the No checkbox"], ["TWO", "NAME - First, Last", "FORMAT: <First> + <Last>", "JO LEE"]]
    cells = [("b", "S", 0, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row) if t]
    grid = spark.createDataFrame(cells, "workbook string, sheet string, sheet_ord int, row0 int, col0 int, text string")
    assert R.header_rows(grid).first().header_row == 1
    got = R.parse_rules(grid).orderBy("rule_ord").collect()
    assert [(r.rule_id, r.row_index, r.section, r.item, r.expected_kind, r.expected_options, r.part_labels) for r in got] == [
        ("S-0001", 3, "ONE", "FEE", "text", [], []), ("S-0002", 5, "ONE", "STATUS", "checkbox_group", ["Yes", "No"], []), ("S-0003", 6, "TWO", "NAME - First, Last", "text", [], ["First", "Last"]),
    ]
    assert (got[0].max_chars, got[0].char_size, got[0].shrink_size) == ("4", "10", "6")
    report = R.schema_report(R.headers(grid), R.resolve_roles(R.headers(grid))).first()
    assert (report.usable, report.missing_roles, report.unmapped) == (True, [], [])
    assert R.sheet_text(grid).first().sheet_text.split("\n")[3] == ""


def test_sections_carry_down(spark):
    rows = [rule(1, "a", section="X", subsection="s"), rule(2, "b"), rule(3, "c", section="Y"), rule(4, "d"), rule(5, "e", subsection="No PRINT Rules in this Section"), rule(6, "f")]
    df = rules_table(spark, *rows)
    plain = [(r.section, r.subsection) for r in R.fill_sections(df, ["sheet"]).orderBy("rule_ord").collect()]
    assert plain == [("X", "s"), ("X", "s"), ("Y", "s"), ("Y", "s"), ("Y", "No PRINT Rules in this Section"), ("Y", "No PRINT Rules in this Section")]
    reset = [(r.section, r.subsection) for r in R.strip_markers(R.fill_sections(df, ["sheet"], True)).orderBy("rule_ord").collect()]
    assert reset == [("X", "s"), ("X", "s"), ("Y", None), ("Y", None), ("Y", ""), ("Y", None)]
    again = R.fill_sections(R.fill_sections(df, ["sheet"]), ["sheet"]).orderBy("rule_ord").collect()
    assert [(r.section, r.subsection) for r in again] == plain


def test_sheet_issues_and_pictures(spark):
    df = rules_table(spark, rule(1, "PARTY B NAME", instruction="PRINT <Party A Name>"), rule(2, "OFFCIANT"), rule(5, "x"))
    assert sorted(r.rule_id for r in R.issues(df).collect()) == ["S-0001", "S-0002"]
    pictures = spark.createDataFrame([("S", 1, 0), ("S", 4, 1), ("S", 90, 2)], "sheet string, row0 int, image_ord int")
    assert {r.image_ord: (r.rule_id, r.exact_row) for r in R.attach_images(df, pictures).collect()} == {0: ("S-0001", True), 1: ("S-0005", False), 2: ("S-0005", False)}


def test_text_containment_nearest_and_diff(spark, monkeypatch):
    from ruleloom.operators import containment

    items = spark.createDataFrame([(1, "abc"), (2, "bcd"), (3, "zz"), (4, None), (5, "abc")], "item_id int, needle string")
    texts = spark.createDataFrame([("p", "xabcdx"), ("q", "abc"), ("r", None)], "doc_id string, haystack string")
    want = {(1, "p"), (5, "p"), (2, "p"), (1, "q"), (5, "q")}
    assert {tuple(r) for r in contained(items, texts).collect()} == want
    monkeypatch.setattr(containment, "AT_ONCE", 2)
    assert {tuple(r) for r in contained(items, texts).collect()} == want
    left = spark.createDataFrame([("k", 1, 10), ("k", 5, 11), ("z", 5, 12)], "k string, v int, a int")
    right = spark.createDataFrame([("k", 3, 7), ("k", 3, 6), ("k", 9, 8)], "k string, w int, b int")
    assert sorted((r.a, r.b, r.gap) for r in nearest(left, right, ["k"], "v", "w", "a", "b").collect()) == [(10, 6, 2), (11, 6, 2)]
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, "n")], "k int, v string")
    assert {(r.k, r.change) for r in diff(a, b, ["k"], ["v"]).collect()} == {(2, "changed"), (3, "removed"), (4, "added")}


def test_labels_are_found_on_the_page(spark, case):
    variants = spark.range(1).select(label_variants(F.lit("RACE - Check all that apply"), F.lit("FULL NAME First"))).first()[0]
    assert variants == ["RACE - Check all that apply", "RACE", "FULL NAME First", "FULL NAME"]
    lines = spark.createDataFrame([("d", 1, 0, "LICENSE FEE", box(0.1, 0.2, 0.2, 0.21)), ("d", 1, 1, "REISSUE LICENSE FEE", box(0.1, 0.25, 0.2, 0.26))], LINES)
    rows = case.withColumn("result_id", F.col("id")).withColumn("result_ord", F.col("row_ord"))
    placed, report = overlay(rows, lines, ["PASS", "FAIL"])
    assert {r.result_id: r.page_index for r in placed.collect()} == {"CMP-0001": 0, "CMP-0002": 0}
    assert tuple(report.first())[1:] == (4, 2, ["CMP-0003", "CMP-0004"])


def test_models_only_change_what_holds(spark):
    fields = spark.createDataFrame([field(0, "Husband", "X"), field(1, "Wife", "Y")], FIELDS)
    texts = spark.createDataFrame([("d", 1, ["Bride", "Groom"])], "doc_id string, page int, texts array<string>")

    def model(requests):
        return [{"kind": "text", "section": "S1", "subsection": None, "key": "Bride" if r["key"] == "Wife" else "Nowhere"} for r in requests]

    got = {r.field_ord: (r.key, r.section, r.value_text) for r in providers.reconstruct(fields, texts, model).collect()}
    assert got == {0: ("Husband", "S1", "X"), 1: ("Bride", "S1", "Y")}
    assert providers.reconstruct(fields, texts, None).select("key").collect() == fields.select("key").collect()
    failing = providers.ask(spark.createDataFrame([(1,)], "k int"), ["k"], lambda r: 1 / 0, "string").first()
    assert (failing.answer, failing.error) == (None, "ZeroDivisionError: division by zero")
    rules = R.classify(rules_table(spark, rule(1, "OFFCIANT NAME", instruction="PRINT <X>")))
    fixed = providers.repair_rules(rules, R.issues(rules), lambda rs: [{"item": "OFFICIANT NAME"} for _ in rs]).first()
    assert (fixed.item, fixed.instruction, fixed.original.item) == ("OFFICIANT NAME", "PRINT <X>", "OFFCIANT NAME")


def test_static_text_is_recovered(spark):
    documents = spark.createDataFrame([("d", "S", "a  form must be\nsigned here")], "doc_id string, sheet string, full_text string")
    rows = audit(R.classify(rules_table(spark, rule(1, "must be signed", example="x"))), spark.createDataFrame([], FIELDS), documents)
    got = {r.id: r for r in rows.collect()}
    assert (got["CMP-0001"].reviewer_status, got["CMP-0001"].di_kind) == ("PASS", "static_text")


def test_masks(spark, tmp_path):
    rows = spark.createDataFrame([("d", "A 123-45-6789", [("n", "PASS", "", "123-45-6789", "")])], "doc_id string, message string, checks array<struct<name:string,status:string,expected:string,actual:string,message:string>>")
    sinks.write_json(rows, str(tmp_path / "out"))
    got = json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*.json")))
    assert (got["message"], got["checks"][0]["actual"]) == ("A ***-**-****", "***-**-****")


ANALYSIS = {"full_text": "FEE 5", "pages": 1, "page_sizes": {"1": [8.5, 11]}, "key_value_pairs": [{"page": 1, "key": "FEE", "value": "5", "bbox": [0.1, 0.3, 0.2, 0.31], "confidence": 0.9}], "lines": [{"page": 1, "text": "FEE", "bbox": [0.1, 0.3, 0.15, 0.31]}]}


def test_saved_analyses_and_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name in ("a", "b"):
        (source / f"{name}.json").write_text(json.dumps(ANALYSIS))
    (source / "c.json").write_text(json.dumps(ANALYSIS | {"full_text": "other"}))
    read = analysis.read(spark, str(source))
    assert (analysis.kv_pairs(read).count(), analysis.lines(read).count(), analysis.page_sizes(read).first().height) == (3, 3, 11.0)
    rules = R.classify(rules_table(spark, rule(1, "FEE", instruction="PRINT <Fee>")))
    query = ingest.run(spark, str(source), rules, "S", str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(400)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("doc_id").distinct().count() == 2
    assert {r.reviewer_status for r in got.collect()} == {"PASS"}


def test_styles_of_values(spark):
    values = spark.createDataFrame([("d", 1, 0, 5), ("d", 2, 9, 12)], "doc_id string, value_id int, start int, stop int")
    styles = spark.createDataFrame([("d", 0, 0, 3, "Arial", None, "bold", None), ("d", 1, 2, 6, "Times", None, None, None)], "doc_id string, style_ord int, start int, stop int, font_family string, font_style string, font_weight string, color string")
    assert {r.value_id: (r.font_family, r.is_bold, r.is_italic) for r in analysis.style_of_values(values, styles).collect()} == {1: ("Times", True, None), 2: (None, None, None)}


def test_labels_nearby_and_marks(spark):
    items = spark.createDataFrame([("d", 1, 7, box(0.2, 0.3, 0.4, 0.31))], "doc_id string, page int, k int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    lines = spark.createDataFrame([("d", 1, 0, "FAR", box(0.2, 0.1, 0.3, 0.11)), ("d", 1, 1, "NEAR", box(0.2, 0.28, 0.3, 0.29)), ("d", 1, 2, "NEARER", box(0.2, 0.29, 0.3, 0.3)), ("d", 1, 3, "NEAR", box(0.2, 0.25, 0.3, 0.26)), ("d", 1, 4, "BESIDE", box(0.5, 0.29, 0.6, 0.3))], LINES)
    assert layout.nearby_labels(items, lines, "k").first().texts == ["NEARER", "NEAR"]
    assert layout.nearby_labels(items, lines, "k", most=1).first().texts == ["NEARER"]
    marks = spark.createDataFrame([("i", 0, "selected", 0.1, 0.5, 0.02), ("i", 1, "unselected", 0.5, 0.5, 0.02), ("i", 2, "unselected", 0.1, 0.9, 0.02)], "i string, mark_ord int, state string, cx double, cy double, h double")
    words = spark.createDataFrame([("i", "Not", 0.2, 0.5), ("i", "Related", 0.3, 0.51), ("i", "Yes", 0.6, 0.5)], "i string, text string, x0 double, cy double")
    assert layout.marks_with_words(marks, words, ["i"]).first().text == "Not Related:selected, Yes:unselected, ?:unselected"


def test_older_matchers(spark):
    pairs = spark.createDataFrame([("d", "r1", 1, 0, 80.0), ("d", "r2", 2, 0, 100.0), ("d", "r2", 2, 1, 75.0), ("d", "r3", 3, 1, 60.0)], "doc_id string, rule_id string, rule_ord int, field_ord int, score double")
    assert sorted((r.rule_id, r.field_ord) for r in A.in_order(pairs).collect()) == [("r1", 0), ("r2", 1)]
    kv_pairs = spark.createDataFrame([kv(0, "NAME", "ANN", 0.0, 0.0, 1.0, 1.0), kv(1, "NAME", "BOB", 0.0, 0.0, 1.0, 1.0), kv(2, "BORN", "MAY 5, 2020", 0.0, 0.0, 1.0, 1.0)], KV_PAIRS)
    labels = spark.createDataFrame([("d", "a", 1, ["NAME"], "B", None), ("d", "b", 2, ["NAME"], "A", None), ("d", "c", 3, ["BORN"], None, "DATE_FORMAT")], "doc_id string, rule_id string, rule_ord int, labels array<string>, party string, rule_type string")
    got = {r.rule_id: (r.kv_ord, round(r.score, 2)) for r in A.key_matches(labels, kv_pairs).collect()}
    assert got == {"a": (1, 109.96), "b": (0, 109.96), "c": (2, 114.96)}


def workbook(path):
    import zipfile

    parts = {
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Item</t></si><si><r><t>Print </t></r><r><t>Rule</t></r></si></sst>',
        "xl/worksheets/sheet1.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>FEE</t></is></c><c r="AB3"><v>5</v></c><c r="B3"/></row></sheetData></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="../drawings/drawing1.xml"/></Relationships>',
        "xl/drawings/drawing1.xml": '<d:wsDr xmlns:d="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><d:oneCellAnchor><d:from><d:col>3</d:col><d:row>2</d:row></d:from><d:pic><a:blip r:embed="p1"/></d:pic></d:oneCellAnchor></d:wsDr>',
        "xl/drawings/_rels/drawing1.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="p1" Target="../media/image1.png"/></Relationships>',
        "xl/media/image1.png": "PNG",
    }
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_workbooks_are_read_as_cells_and_pictures(spark, tmp_path):
    from ruleloom.sources import sheets

    workbook(tmp_path / "w.xlsx")
    assert sorted((r.sheet, r.row0, r.col0, r.text) for r in sheets.cells(spark, str(tmp_path)).collect()) == [("S", 0, 0, "Item"), ("S", 0, 27, "Print Rule"), ("S", 2, 0, "FEE"), ("S", 2, 27, "5")]
    assert [(r.sheet, r.row0, r.col0, bytes(r.content)) for r in sheets.images(spark, str(tmp_path)).collect()] == [("S", 2, 3, b"PNG")]
    got = R.parse_rules(sheets.cells(spark, str(tmp_path))).first()
    assert (got.item, got.instruction, got.row_index) == ("FEE", "5", 3)
