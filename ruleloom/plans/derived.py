"""Operators over forms, sheets, boxes and results that fixed expressions derive from the scale tables.

Each Derived table is one list of expressions that Spark and DuckDB read alike, so that both sides start from the same
rows; what the operator under test does is then written out in SQL anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy, geometry, text, values
from ..lookups import FORM_HINTS, LEAKED_MARKER
from ..operators import assign, checkboxes, checks, guard, layout, outcome, overlay, providers, sheetmatch
from ..operators import rules as R
from ..schemas import CHECK, FIELDS
from ..sources import analysis, sinks
from . import queries as Q
from .audit import audit
from .queries import query, table


class Derived:
    """Columns over one table, as expressions of both dialects."""

    def __init__(self, source: str, where: str = "true", **columns: str) -> None:
        self.source, self.where, self.columns = source, where, columns
        self.sql = f"(SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source} WHERE {where})"

    def __call__(self, spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, self.source).filter(self.where).selectExpr(*(f"{e} AS {n}" for n, e in self.columns.items()))


def box(x0: str, y0: str, x1: str, y1: str) -> F.Column:
    return geometry.box(*(F.expr(e) for e in (x0, y0, x1, y1)))


# ---------------------------------------------------------------------------------------------------------- similarity
def lcs_sql(pairs: str) -> str:
    """Common table expressions for l(p, q, n): the longest common subsequence of the texts p and q of pairs, a character of q at a time."""
    return f"""s0 AS (SELECT DISTINCT p, q FROM {pairs}),
r0 AS (SELECT p, q, 0 AS i, list_transform(range(length(p) + 1), lambda k: 0) AS d FROM s0
UNION ALL SELECT p, q, i + 1, list_reduce(range(1, length(p) + 1), lambda acc, k: list_append(acc, CASE WHEN p[k] = q[i + 1] THEN d[k] + 1 ELSE greatest(d[k + 1], acc[k]) END), [0]) FROM r0 WHERE i < length(q)),
l AS (SELECT p, q, d[length(p) + 1] AS n FROM r0 WHERE i = length(q))"""


def word_lists(a: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({a}, ' '), lambda w: w <> '')))"


def token_set_sql(pairs: str) -> str:
    """Common table expressions for token_set(a, b, score) of the pairs (a, b)."""
    return f"""w AS (SELECT DISTINCT a, b, {word_lists("a")} AS x, {word_lists("b")} AS y FROM {pairs}),
z AS (SELECT a, b, len(x) AS nx, len(y) AS ny, array_to_string(list_filter(x, lambda t: list_contains(y, t)), ' ') AS s, array_to_string(list_filter(x, lambda t: NOT list_contains(y, t)), ' ') AS p, array_to_string(list_filter(y, lambda t: NOT list_contains(x, t)), ' ') AS q FROM w),
{lcs_sql("z")},
g AS (SELECT z.*, l.n, CASE WHEN s = '' THEN 0 ELSE 1 END AS gap FROM z JOIN l USING (p, q)),
t AS (SELECT *, length(s) + gap + length(p) AS wa, length(s) + gap + length(q) AS wb FROM g),
token_set AS (SELECT a, b, CASE WHEN nx = 0 OR ny = 0 THEN 0e0 WHEN s <> '' AND (p = '' OR q = '') THEN 1e2 ELSE greatest(1e2 - 1e2 * (length(p) + length(q) - 2 * n) / (wa + wb), CASE WHEN s <> '' THEN 1e2 - 1e2 * (gap + length(p)) / (length(s) + wa) ELSE 0 END, CASE WHEN s <> '' THEN 1e2 - 1e2 * (gap + length(q)) / (length(s) + wb) ELSE 0 END) END AS score FROM t)"""


def _name_pairs(spark, sf):
    u = table(spark, sf, "part").select("p_size", "p_brand", F.col("p_name").alias("a")).distinct()
    v = table(spark, sf, "part").filter("p_partkey % 3 = 0").select("p_size", "p_brand", F.concat_ws(" ", "p_type", "p_name").alias("b")).distinct()
    return u.join(v, ["p_size", "p_brand"]).select("a", "b").distinct()


NAME_PAIRS = "(SELECT DISTINCT u.p_name AS a, v.p_type || ' ' || v.p_name AS b FROM part u JOIN part v ON u.p_size = v.p_size AND u.p_brand = v.p_brand WHERE v.p_partkey % 3 = 0)"


@query(f"WITH RECURSIVE {token_set_sql(NAME_PAIRS)} SELECT a, b, round(score, 6) AS score FROM token_set")
def word_set_similarity(spark, sf):
    return fuzzy.with_scores(_name_pairs(spark, sf), "a", "b", "s").select("a", "b", F.round("s", 6).alias("score"))


@query(f"""WITH RECURSIVE n AS (SELECT a, b, a AS p, b AS q FROM {NAME_PAIRS} UNION SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS p, array_to_string(list_sort(string_split(b, ' ')), ' ') AS q FROM {NAME_PAIRS}),
{lcs_sql("n")},
r AS (SELECT p, q, round(1e2 - 1e2 * (length(p) + length(q) - 2 * n) / (length(p) + length(q)), 6) AS score FROM l)
SELECT a, b, u.score AS ratio, v.score AS token_sort FROM {NAME_PAIRS} x JOIN r u ON u.p = a AND u.q = b JOIN r v ON v.p = array_to_string(list_sort(string_split(a, ' ')), ' ') AND v.q = array_to_string(list_sort(string_split(b, ' ')), ' ')""")
def character_similarity(spark, sf):
    return _name_pairs(spark, sf).select("a", "b", *(F.round(fuzzy.metric(m)("a", "b"), 6).alias(m) for m in ("ratio", "token_sort")))


# ------------------------------------------------------------------------------------------------------------ matching
def greedy_sql(pairs: str, group: str, left: str, right: str, order: str) -> str:
    return f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS i FROM {pairs}),
r AS (SELECT {group}, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS l, CAST([] AS BIGINT[]) AS u FROM p GROUP BY {group}
UNION ALL SELECT r.{group}, p.i, CASE WHEN list_contains(l, {left}) OR list_contains(u, {right}) THEN l ELSE list_append(l, {left}) END, CASE WHEN list_contains(l, {left}) OR list_contains(u, {right}) THEN u ELSE list_append(u, {right}) END FROM r JOIN p ON p.{group} = r.{group} AND p.i = r.i + 1),
e AS (SELECT {group}, unnest(l) AS {left}, unnest(u) AS {right} FROM (SELECT * FROM r QUALIFY i = max(i) OVER (PARTITION BY {group})))
SELECT p.* EXCLUDE (i) FROM p JOIN e ON p.{group} = e.{group} AND p.{left} = e.{left} AND p.{right} = e.{right}"""


for _name in ("one_to_one", "one_to_one_by_rounds"):
    Q.ORACLES[_name] = greedy_sql(Q.PAIR_SQL, "g", "c_custkey", "s_suppkey", "score DESC, c_custkey, s_suppkey")


@query(greedy_sql(f"(SELECT CAST(g AS VARCHAR) AS doc_id, c_custkey AS rule_id, s_suppkey AS field_ord, CAST(score * 2 AS DOUBLE) AS score FROM {Q.PAIR_SQL} WHERE score * 2 >= 70)", "doc_id", "rule_id", "field_ord", "rule_id, score DESC, field_ord"))
def in_order_match(spark, sf):
    pairs = Q._pairs(spark, sf).select(F.col("g").cast("string").alias("doc_id"), F.col("c_custkey").alias("rule_id"), F.col("c_custkey").alias("rule_ord"), F.col("s_suppkey").alias("field_ord"), (F.col("score") * 2).cast("double").alias("score"))
    return assign.in_order(pairs).drop("rule_ord")


# rules are parts, fields are parts of the same size and brand; a third of the fields lacks a letter, so that words differ
RULE_PARTS = Derived("part", "p_partkey % 4 = 0", doc_id="p_brand", rule_id="'r' || CAST(p_partkey AS STRING)", rule_ord="CAST(p_partkey AS INT)", item="p_type || ' ' || p_name", section="CASE WHEN p_size < 25 THEN 'SMALL' ELSE 'LARGE' END")
FIELD_PARTS = Derived("part", "p_partkey % 4 = 1", doc_id="p_brand", field_ord="CAST(p_partkey AS INT)", key="CASE WHEN p_partkey % 3 = 0 THEN p_type || ' ' || substr(p_name, 2) ELSE p_name || ' ' || p_type END", section="CASE WHEN p_size < 25 THEN 'small size' ELSE '' END", value="CASE WHEN p_partkey % 5 = 0 THEN 'UNKNOWN' ELSE p_name END", kind="CASE WHEN p_partkey % 7 = 0 THEN 'checkbox_group' ELSE 'text' END")


@query(f"""WITH RECURSIVE m AS (SELECT r.doc_id, r.rule_id, f.field_ord, upper(r.item) AS a, upper(f.key) AS b, r.section AS rs, upper(f.section) AS fs, f.value, f.kind FROM {RULE_PARTS.sql} r JOIN {FIELD_PARTS.sql} f ON r.doc_id = f.doc_id),
{token_set_sql("m")},
k AS (SELECT m.*, CASE WHEN contains(m.a, m.b) OR contains(m.b, m.a) THEN 100 ELSE token_set.score END AS raw FROM m JOIN token_set ON m.a = token_set.a AND m.b = token_set.b)
SELECT doc_id, rule_id, field_ord, round(raw + CASE WHEN kind = 'text' THEN 0 ELSE -60 END + CASE WHEN fs = '' THEN 0 WHEN contains(fs, rs) THEN 12 ELSE -15 END + CASE WHEN value = 'UNKNOWN' THEN -5 ELSE 0 END, 6) AS score FROM k WHERE raw >= 60""")
def fuzzy_candidates(spark, sf):
    r = RULE_PARTS(spark, sf).withColumns({"label_printed": F.lit(None).cast("string"), "subsection": F.lit(""), "expected_kind": F.lit("text"), "rule_type": F.lit("FIELD_TEXT")})
    f = FIELD_PARTS(spark, sf).withColumn("subsection", F.lit(""))
    classes = assign.candidate_classes(r, f).withColumn("score", F.round("score", 6))
    return assign.expanded(classes).select("doc_id", "rule_id", "field_ord", "score")


SHEET_DOCS = Derived("customer", "c_custkey % 2 = 0", doc_id="c_custkey", full_text="CASE c_custkey % 4 WHEN 0 THEN 'Wisconsin  Marriage License ' || lower(c_mktsegment) ELSE c_mktsegment || ' and certificate' END", workbook="'w'")
SHEETS = [("w", "Marriage License", "ISSUED BY COUNTY CLERK"), ("w", "Machinery list", "machinery and building parts")]
SHEET_BONUS = f"""CASE WHEN n = 'MARRIAGE LICENSE' THEN {" + ".join(f"CASE WHEN contains(d, '{p}') THEN 20 ELSE 0 END + CASE WHEN contains(s, '{p}') THEN 5 ELSE 0 END" for p in FORM_HINTS["Marriage License"])} ELSE 0 END"""


@query(f"""WITH RECURSIVE d0 AS (SELECT doc_id, trim(regexp_replace(upper(full_text), ' +', ' ', 'g')) AS d FROM {SHEET_DOCS.sql}),
x AS (SELECT doc_id, d, sheet, upper(sheet) AS n, upper(sheet_text) AS s FROM d0, (VALUES ('Marriage License', 'ISSUED BY COUNTY CLERK'), ('Machinery list', 'machinery and building parts')) v(sheet, sheet_text)),
pairs AS (SELECT d AS a, s AS b FROM x UNION SELECT d, n FROM x),
{token_set_sql("pairs")},
y AS (SELECT x.doc_id, x.sheet, round(least(u.score * 0.45 + v.score * 0.10 + {SHEET_BONUS}, 100), 2) AS score FROM x JOIN token_set u ON u.a = d AND u.b = s JOIN token_set v ON v.a = d AND v.b = n)
SELECT doc_id, sheet, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sheet) AS INT) AS rank FROM y""")
def sheets_by_text(spark, sf):
    return sheetmatch.suggest(SHEET_DOCS(spark, sf), spark.createDataFrame(SHEETS, "workbook string, sheet string, sheet_text string"))


ORDER_FIELDS = Derived("orders", doc_id="CAST(o_orderkey AS STRING)", rule_id="'r' || CAST(o_orderkey AS STRING)", ord="CAST(o_orderkey AS INT)", item="'ORDER ' || CAST(o_orderkey AS STRING)", section="CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE '' END", f_section="CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END", before="CAST(o_orderkey % 12 AS INT)")
SEQUENCE = "round(0.65 + CASE WHEN section = '' OR section = f_section THEN 0.20 ELSE 0 END + 0.15 * greatest(0, 1 - before / 8.0), 4)"


@query(f"""SELECT doc_id, rule_id, ord AS field_ord, {SEQUENCE} AS score, CASE WHEN {SEQUENCE} >= 0.55 THEN 'MATCHED' ELSE 'REVIEW_REQUIRED' END AS state FROM {ORDER_FIELDS.sql}""")
def sequence_states(spark, sf):
    """A rule and its field for each order, with up to eleven other fields before it: section and order decide the score."""
    o = ORDER_FIELDS(spark, sf)
    r = o.select("doc_id", "rule_id", F.col("ord").alias("rule_ord"), "item", "section", F.lit("FIELD_TEXT").alias("rule_type"))
    others = o.filter("before > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("before"))).alias("n"))
    place = box("0.1", "y", "0.2", "y")
    f = o.select("doc_id", F.col("ord").alias("field_ord"), F.col("item").alias("key"), F.col("f_section").alias("section"), F.lit(0.9).alias("y")).unionByName(others.select("doc_id", (-F.col("n")).alias("field_ord"), F.lit("").alias("key"), F.lit("C").alias("section"), (F.col("n") / 100).alias("y")))
    return assign.sequence_match(r, f.select("doc_id", "field_ord", "key", "section", F.lit(1).alias("page"), place.alias("bbox"), place.alias("label_bbox")))


# ---------------------------------------------------------------------------------------------------------- checkboxes
LABELS = ("ALPHA", "BRAVO", "CHARLIE", "DELTA", "ECHO", "FOXTROT", "GOLF")
LABEL = "CASE l_linenumber % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(LABELS)) + " END"
#: One checkbox for each line of an order: its column from the line's number, its row from the supplier, its state from the return flag.
BOXES = Derived("lineitem", doc_id="CAST(l_orderkey AS STRING)", kv_ord="l_linenumber", label=LABEL, state="CASE WHEN l_returnflag = 'R' THEN 'selected' ELSE 'unselected' END", x="0.1e0 + l_linenumber * 0.05e0", y="CASE WHEN l_suppkey % 3 = 0 THEN 0.30e0 ELSE 0.60e0 END", part="l_partkey", k="l_suppkey")
#: ... of repeated line numbers the first.
FIRST_BOXES = f"(SELECT * FROM {BOXES.sql} QUALIFY row_number() OVER (PARTITION BY doc_id, kv_ord ORDER BY part, k, state, y) = 1)"


def _boxes(spark, sf):
    first = F.min_by(F.struct("label", "state", "x", "y"), F.struct("part", "k", "state", "y"))
    boxes = BOXES(spark, sf).groupBy("doc_id", "kv_ord").agg(first.alias("b")).select("doc_id", "kv_ord", "b.*")
    return boxes.select("doc_id", F.lit(1).alias("page"), "kv_ord", F.col("label").alias("key"), F.concat(F.lit(":"), "state", F.lit(":")).alias("value"), box("x", "y", "x", "y").alias("bbox"), "state", "y")


def _anchors(spark, sf, *options):
    docs = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id")).distinct()
    return docs.select("doc_id", F.lit(1).alias("page"), box("0.1e0", "0.29e0", "0.5e0", "0.31e0").alias("label_bbox"), F.array(*map(F.lit, options)).cast("array<string>").alias("options"), F.lit(1).alias("k"))


@query(f"""SELECT doc_id, string_agg(label || '=' || state, '|' ORDER BY kv_ord) AS boxes FROM {FIRST_BOXES} WHERE y = 0.30e0 GROUP BY doc_id""")
def boxes_beside_labels(spark, sf):
    found = checkboxes.boxes_on_row(_anchors(spark, sf), _boxes(spark, sf), ["k"])
    return found.select("doc_id", F.array_join(F.transform("boxes", lambda b: F.concat_ws("=", b["label"], b["state"])), "|").alias("boxes"))


@query(f"""SELECT doc_id, string_agg(label || '=' || state, '|' ORDER BY CASE label WHEN 'CHARLIE' THEN 1 WHEN 'ALPHA' THEN 2 ELSE 3 END) AS options, CAST(count(*) AS INT) AS matched, 4 AS expected, round(count(*) / 4.0, 3) AS confidence FROM {FIRST_BOXES} WHERE y = 0.30e0 AND label IN ('CHARLIE', 'ALPHA', 'GOLF') GROUP BY doc_id""")
def options_beside_labels(spark, sf):
    found = checkboxes.regroup(_anchors(spark, sf, "CHARLIE", "ALPHA", "GOLF", "ZULU"), _boxes(spark, sf), ["k"])
    return found.select("doc_id", F.array_join(F.transform("found", lambda o: F.concat_ws("=", o["label"], o["state"])), "|").alias("options"), "matched", "expected", F.col("confidence").cast("double").alias("confidence"))


@query(f"""SELECT d.doc_id, coalesce(b.v, 'NAME-unselected') AS value_text, coalesce(b.n, 0) AS n_children FROM (SELECT DISTINCT doc_id FROM {FIRST_BOXES}) d LEFT JOIN
(SELECT doc_id, string_agg(label || '-' || state, ';' ORDER BY CASE label WHEN 'CHARLIE' THEN 1 WHEN 'ALPHA' THEN 2 ELSE 3 END) AS v, CAST(count(*) AS INT) AS n FROM {FIRST_BOXES} WHERE y = 0.30e0 AND label IN ('CHARLIE', 'ALPHA', 'GOLF') GROUP BY doc_id) b USING (doc_id)""")
def checkbox_repair(spark, sf):
    anchors = _anchors(spark, sf, "CHARLIE", "ALPHA", "GOLF", "ZULU")
    r = anchors.select("doc_id", F.lit(1).alias("rule_ord"), F.lit("NAME").alias("item"), F.lit("").alias("section"), F.col("options").alias("expected_options"))
    children = "array<struct<label:string,value:string,selected:boolean,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"
    f = anchors.select("doc_id", F.lit(0).alias("field_ord"), "page", F.lit("checkbox_group").alias("kind"), F.lit("NAME").alias("key"), F.lit("").alias("section"), F.lit("NAME-unselected").alias("value_text"), F.col("label_bbox").alias("bbox"), "label_bbox", F.array().cast(children).alias("children"))
    return checkboxes.repair(r, f, _boxes(spark, sf).drop("state", "y")).select("doc_id", "value_text", F.size("children").alias("n_children"))


@query(f"""WITH b AS (SELECT doc_id, string_agg(label || ' (' || state || ')', ', ' ORDER BY kv_ord) AS shown, bool_or(state = 'selected') AS any_, list_sort(list_distinct(list(label))) AS names FROM {FIRST_BOXES} WHERE y = 0.30e0 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN b.names IS NULL OR names <> ['ALPHA', 'BRAVO'] THEN 'NOT_VALIDATED' WHEN any_ THEN 'PASS' ELSE 'MISSING_DATA' END AS status, coalesce(shown, 'ALPHA, BRAVO') AS actual FROM (SELECT DISTINCT doc_id FROM {FIRST_BOXES}) d LEFT JOIN b USING (doc_id)""")
def checkbox_positions(spark, sf):
    """Each group claims ALPHA and BRAVO; the boxes on its row say whether that is so."""
    anchors = _anchors(spark, sf)
    on_row = checkboxes.boxes_on_row(anchors, _boxes(spark, sf), ["k"])
    check = checkboxes.position_check(F.lit("ALPHA-selected;BRAVO-unselected"), F.col("boxes"))
    return anchors.select("doc_id").join(on_row, "doc_id", "left").select("doc_id", check["status"].alias("status"), check["actual"].alias("actual"))


HELD = Derived("orders", o_orderkey="o_orderkey", word="split_part(substr(o_orderpriority, 3), ' ', 1)", ticked="CASE WHEN o_orderkey % 3 = 0 THEN 'selected' ELSE 'unselected' END")


@query(f"""WITH h AS (SELECT *, CASE WHEN word = 'LOW' THEN ticked = 'selected' WHEN word = 'HIGH' THEN ticked = 'selected' ELSE FALSE END AS on_ FROM {HELD.sql})
SELECT o_orderkey, CASE WHEN on_ THEN 'PASS' ELSE 'MISSING_DATA' END AS status, CASE WHEN word IN ('LOW', 'HIGH') THEN CASE word WHEN 'LOW' THEN 'Low' ELSE 'High' END || '=' || word || ' (' || ticked || ')' ELSE '' END AS actual, 'Low, High' AS expected,
CASE WHEN on_ THEN 'Selected: ' || CASE word WHEN 'LOW' THEN 'Low' ELSE 'High' END || '.' ELSE 'Nothing is selected.' END || ' Not found: ' || CASE word WHEN 'LOW' THEN 'High.' WHEN 'HIGH' THEN 'Low.' ELSE 'Low, High.' END AS message FROM h""")
def option_alignment(spark, sf):
    h = HELD(spark, sf).withColumn("held", F.array(F.struct(F.col("word").alias("label"), F.col("ticked").alias("state"))))
    wanted = F.array(F.lit("Low"), F.lit("High"))
    check = checkboxes.alignment_check(wanted, checkboxes.aligned_options(wanted, F.col("held")))
    return h.select("o_orderkey", *(check[n].alias(n) for n in ("status", "actual", "expected", "message")))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag || ' ' || l_linestatus AS option, l_linenumber % 2 = 0 AS selected, l_linenumber % 3 <> 0 AS listed FROM lineitem""")
def option_texts(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    name, n = F.concat_ws(" ", "l_returnflag", "l_linestatus"), F.col("l_linenumber")
    written = F.concat(F.lit(" "), name, F.when(n % 2 == 0, F.when(n % 4 == 0, "-Selected").otherwise(":SELECTED")).otherwise(F.when(n % 3 == 0, " unselected").otherwise("")), F.lit(" "))
    one = checkboxes.normalize_option(written)
    listed = checkboxes.normalize_options(F.array(F.struct(name.alias("option"), F.when(n % 3 == 0, ":no:").otherwise(":Checked:").alias("state")), F.struct(F.lit(" -").alias("option"), F.lit("x").alias("state"))))
    return l.select("l_orderkey", "l_linenumber", one["option"].alias("option"), one["selected"].alias("selected"), (listed[0]["selected"] & (F.size(listed) == 1)).alias("listed"))


# --------------------------------------------------------------------------------------------------------------- pages
#: Lines of a customer's page: one for each order, its height from its key, and a group at a fixed place.
PAGE_LINES = Derived("orders", doc_id="CAST(o_custkey AS STRING)", page="1", line_ord="CAST(o_orderkey AS INT)", text="CASE WHEN o_orderkey % 5 = 0 THEN '>' ELSE substr(o_orderpriority, 3) || ' ' || CAST(o_orderkey % 4 AS STRING) END", x0="(o_orderkey % 7) / 10e0", y0="(o_orderkey % 41) / 100e0", x1="(o_orderkey % 7) / 10e0 + 0.15e0", y1="(o_orderkey % 41) / 100e0 + 0.01e0")


def _lines(spark, sf):
    return PAGE_LINES(spark, sf).select("doc_id", "page", "line_ord", "text", box("x0", "y0", "x1", "y1").alias("bbox"))


def _groups(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc_id")).distinct()
    return docs.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("g"), box("0.2e0", "0.25e0", "0.5e0", "0.30e0").alias("bbox"), F.lit("HIGH 2").alias("label"))


@query(f"""SELECT doc_id, arg_min(text, struct_pack(s := 0.25e0 - (y0 + y1) / 2 + 0.5 * abs((x0 + x1) / 2 - 0.35e0) / greatest(0.5e0 - 0.2e0, 1e-6) * 0.055, o := line_ord)) AS label FROM {PAGE_LINES.sql}
WHERE text <> '>' AND NOT text LIKE 'LOW%' AND 0.25e0 - (y0 + y1) / 2 > 0 AND 0.25e0 - (y0 + y1) / 2 <= 0.055 AND least(x1, 0.5e0) - greatest(x0, 0.2e0) > 0 GROUP BY doc_id""")
def labels_above_groups(spark, sf):
    lines = _lines(spark, sf)
    excluded = lines.filter("text like 'LOW%'").select("doc_id", "page", "text")
    return layout.parent_labels(_groups(spark, sf), lines, excluded, "g").select("doc_id", "label")


@query(f"""SELECT doc_id, arg_max(y0, struct_pack(r := CAST(least(length(text), 6) AS DOUBLE) / greatest(length(text), 6), d := -abs((y0 + y1) / 2 - (0.25e0 + 0.30e0) / 2), o := -line_ord)) AS y0 FROM {PAGE_LINES.sql} WHERE contains(upper(text), 'HIGH 2') OR contains('HIGH 2', upper(text)) GROUP BY doc_id""")
def boxes_of_key_labels(spark, sf):
    return layout.key_labels(_groups(spark, sf), _lines(spark, sf), "g").select("doc_id", F.col("label_bbox.y0").alias("y0"))


@query(f"""WITH m AS (SELECT doc_id, text, arg_min(struct_pack(d := abs(0.25e0 - y0), o := line_ord), struct_pack(d := abs(0.25e0 - y0), o := line_ord)) AS best FROM {PAGE_LINES.sql} WHERE x1 >= 0.2e0 - 0.02 AND x0 <= 0.5e0 + 0.02 AND 0.25e0 - y0 BETWEEN -0.01 AND 0.08 GROUP BY doc_id, text)
SELECT doc_id, string_agg(text, '|' ORDER BY best.d, best.o) AS texts FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY best.d, best.o) <= 3) GROUP BY doc_id""")
def labels_nearby(spark, sf):
    return layout.nearby_labels(_groups(spark, sf), _lines(spark, sf), "g", most=3).select("doc_id", F.array_join("texts", "|").alias("texts"))


@query(f"""SELECT doc_id, text, y0 FROM {PAGE_LINES.sql} WHERE y1 - y0 <= 0.03 AND x1 - x0 >= 0.10 AND len(string_split(text, ' ')) <= 6""")
def header_lines(spark, sf):
    return layout.wide_headers(_lines(spark, sf)).select("doc_id", "text", "y0")


#: Results of a customer: the label of a result is the text of one line, or stands nowhere.
RESULTS = Derived("orders", doc_id="CAST(o_custkey AS STRING)", result_ord="CAST(o_orderkey AS INT)", result_id="'c' || CAST(o_orderkey AS STRING)", status="CASE WHEN o_orderkey % 3 = 0 THEN 'FAIL' ELSE 'PASS' END", item="CASE WHEN o_orderkey % 4 = 0 THEN 'NOWHERE AT ALL' ELSE 'NUMBER ' || CAST(1000000 + o_orderkey AS STRING) || ' - First, Last' END", page="1 + CAST(o_orderkey % 3 AS INT)")


@query(f"SELECT doc_id, result_id, 'NUMBER ' || CAST(1000000 + result_ord AS VARCHAR) AS label, page - 1 AS page_index, result_ord / 1e6 AS y0 FROM {RESULTS.sql} WHERE status = 'FAIL' AND result_ord % 4 <> 0")
def overlay_rectangles(spark, sf):
    r = RESULTS(spark, sf)
    lines = r.select("doc_id", "page", F.col("result_ord").alias("line_ord"), F.concat(F.lit("the number "), (F.col("result_ord") + 1000000).cast("string"), F.lit(":")).alias("text"), box("0.1e0", "result_ord / 1e6", "0.5e0", "result_ord / 1e6 + 0.01").alias("bbox"))
    results = r.withColumn("di_key", F.lit(None).cast("string")).withColumn("bbox", F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"))
    placed, _ = overlay.overlay(results, lines, ["FAIL"])
    return placed.select("doc_id", "result_id", "label", "page_index", F.col("bbox.y0").alias("y0"))


@query(f"SELECT doc_id, count(*) AS eligible, count(*) FILTER (result_ord % 4 <> 0) AS located, coalesce(string_agg(result_id, '|' ORDER BY result_id) FILTER (result_ord % 4 = 0), '') AS missing FROM {RESULTS.sql} WHERE status = 'FAIL' GROUP BY doc_id")
def overlay_audit(spark, sf):
    r = RESULTS(spark, sf)
    lines = r.select("doc_id", "page", F.col("result_ord").alias("line_ord"), F.concat(F.lit("the number "), (F.col("result_ord") + 1000000).cast("string")).alias("text"), box("0.1e0", "0.1e0", "0.5e0", "0.2e0").alias("bbox"))
    results = r.withColumn("di_key", F.lit(None).cast("string")).withColumn("bbox", F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"))
    return overlay.overlay(results, lines, ["FAIL"])[1].withColumn("missing", F.array_join("missing", "|"))


@query("""SELECT p_partkey, min(p_size, 30) AS x0, 0.5e0 AS y1, p_size * 7.2e0 AS points, p_size / 85e-1 AS x, p_size * 2e0 AS back FROM (SELECT p_partkey, p_size FROM part)""".replace("min(p_size, 30)", "CAST(least(p_size, 30) AS DOUBLE)").replace("p_size * 7.2e0", "round((p_size / 1e2) * 10 * 72, 1)"))
def boxes_of_polygons(spark, sf):
    """Regions as boxes, in page fractions and back, and the points that a height in inches stands for."""
    s = F.col("p_size").cast("double")
    p = table(spark, sf, "part").withColumn("b", geometry.from_polygon(F.array(s, F.lit(0.25), F.lit(30.0), F.lit(0.5), s, F.lit(0.5), F.lit(30.0), F.lit(0.25))))
    line = geometry.box(F.lit(0), F.lit(0), F.lit(1), s / 100)
    page = geometry.normalize(geometry.box(s, F.lit(0), s, F.lit(1)), F.lit(8.5), F.lit(0))
    back = geometry.denormalize(geometry.box(s, F.lit(0), s, F.lit(1)), F.lit(2.0), F.lit(1.0))
    return p.select("p_partkey", F.col("b.x0").alias("x0"), F.col("b.y1").alias("y1"), geometry.font_size(line, F.lit(10.0)).alias("points"), page["x0"].alias("x"), back["x0"].alias("back"))


#: Composites of three parts; a key that names no part takes its composite apart.
COMPOSITES = Derived("part", doc_id="p_brand", field_ord="CAST(p_partkey AS INT)", third="CASE WHEN p_partkey % 3 = 0 THEN 'Fee of ' || p_type ELSE 'Last of ' || p_type END", y="p_partkey / 1e6")


@query(f"""WITH e AS (SELECT doc_id, field_ord, third, y, CASE WHEN field_ord % 3 = 0 THEN 'text' ELSE 'composite' END AS kind, unnest(CASE WHEN field_ord % 3 = 0 THEN [0, 1] ELSE [0] END) AS sub FROM {COMPOSITES.sql})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y, field_ord, sub) - 1 AS INT) AS field_ord, kind, CASE WHEN kind = 'text' THEN CASE sub WHEN 0 THEN 'FIRST' ELSE third END END AS key, CASE WHEN kind = 'text' THEN CASE sub WHEN 0 THEN 'a' ELSE 'c' END END AS value FROM e""")
def composites_split(spark, sf):
    parts = F.array(*(F.struct(k.alias("key"), F.lit(v).alias("value")) for k, v in ((F.lit("FIRST"), "a"), (F.lit(" "), "b"), (F.col("third"), "c"))))
    names = [c.split()[0] for c in ("doc_id", "field_ord", "page", "kind", "section", "subsection", "key", "value_text", "value_parts", "bbox", "label_bbox", "confidence", "children")]
    given = {"doc_id": F.col("doc_id"), "field_ord": F.col("field_ord"), "page": F.lit(1), "kind": F.lit("composite"), "value_parts": parts, "bbox": box("0e0", "y", "1e0", "y"), "children": F.array()}
    schema = {f.name: f.dataType for f in spark.createDataFrame([], FIELDS).schema}
    fields = COMPOSITES(spark, sf).select(*(given.get(n, F.lit(None)).cast(schema[n]).alias(n) for n in names))
    return layout.split_composites(fields).select("doc_id", "field_ord", "kind", "key", F.col("value_text").alias("value"))


@query("SELECT p_partkey, p_partkey % 4 <> 3 AS is_part FROM part")
def part_labels(spark, sf):
    k = F.col("p_partkey") % 4
    key = F.when(k == 0, "first  name").when(k == 1, F.concat(F.lit("Zip Code of "), "p_name")).when(k == 2, ":Suffix.").otherwise(F.concat("p_name", F.lit(" of FIRST")))
    return table(spark, sf, "part").select("p_partkey", layout.is_part_label(key).alias("is_part"))


MARKS = Derived("lineitem", pic="l_orderkey", mark_ord="l_linenumber", cx="l_linenumber / 10e0", state="CASE WHEN l_returnflag = 'R' THEN 'selected' ELSE 'unselected' END", word="l_returnflag || l_linestatus", part="l_partkey", supp="l_suppkey")


@query(f"""WITH m AS (SELECT * FROM {MARKS.sql} QUALIFY row_number() OVER (PARTITION BY pic, mark_ord ORDER BY part, supp, state, word) = 1)
SELECT pic, string_agg(CASE WHEN mark_ord % 2 = 0 THEN 'the ' || word ELSE '?' END || ':' || state, ', ' ORDER BY cx) AS text FROM m GROUP BY pic""")
def marks_and_words(spark, sf):
    m = MARKS(spark, sf).groupBy("pic", "mark_ord").agg(F.min_by(F.struct("cx", "state", "word"), F.struct("part", "supp", "state", "word")).alias("b")).select("pic", "mark_ord", "b.*")
    marks = m.select("pic", "mark_ord", "state", "cx", F.lit(0.5).alias("cy"), F.lit(0.01).alias("h"))
    even = m.filter("mark_ord % 2 = 0")
    words = even.select("pic", F.col("word").alias("text"), (F.col("cx") + 0.05).alias("x0"), F.lit(0.51).alias("cy")).unionByName(even.select("pic", F.lit("the").alias("text"), (F.col("cx") + 0.01).alias("x0"), F.lit(0.5).alias("cy"))).unionByName(even.select("pic", F.lit("low").alias("text"), F.col("cx").alias("x0"), F.lit(0.9).alias("cy")))
    return layout.marks_with_words(marks, words, ["pic"])


@query(f"SELECT doc_id, page, string_agg(text, '|' ORDER BY line_ord) AS texts, count(*) AS n_lines FROM (SELECT doc_id, 1 + line_ord % 2 AS page, line_ord, text FROM {PAGE_LINES.sql}) GROUP BY doc_id, page")
def lines_by_page(spark, sf):
    lines = _lines(spark, sf).withColumn("page", F.expr("1 + line_ord % 2"))
    return providers.page_texts(lines).select("doc_id", "page", F.array_join("texts", "|").alias("texts"), F.size("texts").cast("long").alias("n_lines"))


# --------------------------------------------------------------------------------------------------------- rule sheets
CELLS = Derived("lineitem", sheet="'s' || CAST(l_orderkey % 100 AS STRING)", row0="CAST(l_orderkey % 7 + l_linenumber AS INT)", col0="l_linenumber", text="CASE WHEN l_tax > 0.05 THEN ' ' ELSE l_returnflag || '  ' || CAST(l_linenumber AS STRING) END", part="l_partkey", supp="l_suppkey", q="l_quantity", key="l_orderkey")
FIRST_CELLS = f"(SELECT sheet, row0, col0, text FROM {CELLS.sql} QUALIFY row_number() OVER (PARTITION BY sheet, row0, col0 ORDER BY key, part, supp, q, text) = 1)"


def _sheet_cells(spark, sf):
    first = F.min_by("text", F.struct("key", "part", "supp", "q", "text"))
    cells = CELLS(spark, sf).groupBy("sheet", "row0", "col0").agg(first.alias("text"))
    return cells.select(F.lit("w").alias("workbook"), "sheet", F.expr("CAST(substr(sheet, 2) AS INT)").alias("sheet_ord"), "row0", "col0", "text")


@query(f"""WITH c AS (SELECT sheet, row0, col0, trim(regexp_replace(text, ' +', ' ', 'g')) AS t FROM {FIRST_CELLS}), l AS (SELECT sheet, row0, string_agg(t, ' ' ORDER BY col0) FILTER (t <> '') AS line FROM c GROUP BY sheet, row0),
a AS (SELECT sheet, unnest(range(max(row0) + 1)) AS row0 FROM c GROUP BY sheet)
SELECT 'w' AS workbook, a.sheet, string_agg(coalesce(line, ''), chr(10) ORDER BY a.row0) AS sheet_text FROM a LEFT JOIN l ON a.sheet = l.sheet AND a.row0 = l.row0 GROUP BY a.sheet""")
def sheet_texts(spark, sf):
    return R.sheet_text(_sheet_cells(spark, sf)).select("workbook", "sheet", "sheet_text")


@query(f"SELECT DISTINCT 'w' AS workbook, CAST(substr(sheet, 2) AS INT) AS sheet_ord, sheet FROM {CELLS.sql}")
def sheet_lists(spark, sf):
    return R.sheet_names(_sheet_cells(spark, sf))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Item Name ' || p_brand WHEN 1 THEN 'Max. Chars' WHEN 2 THEN 'If = Unknown; print' ELSE p_name END AS named, CASE p_partkey % 4 WHEN 0 THEN 'ITEM NAME ' || upper(p_brand) WHEN 1 THEN 'MAX CHARS' WHEN 2 THEN 'IF UNKNOWN' ELSE upper(p_name) END AS canon FROM part""".replace("'If = Unknown; print'", "'If = Unknown'"))
def header_names(spark, sf):
    k = F.col("p_partkey") % 4
    header = F.when(k == 0, F.concat(F.lit("Item Name "), "p_brand", F.lit(" (note the number)"))).when(k == 1, "Max. Chars -").when(k == 2, "If = Unknown; print NOTE: x").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" note it well")))
    return table(spark, sf, "part").select("p_partkey", R.without_note(header).alias("named"), R.canonical(header).alias("canon"))


RULE_ROWS = Derived("events", sheet="CAST(user_id AS STRING)", rule_ord="CAST(event_id AS INT)", section="CASE WHEN event_id % 5 = 0 THEN event_type END", subsection=f"CASE WHEN event_id % 4 = 0 THEN 'sub ' || CAST(event_id % 3 AS STRING) WHEN event_id % 13 = 0 THEN '{LEAKED_MARKER.lower()}!' END", item="CASE WHEN event_id % 6 = 0 THEN '' ELSE event_type END", instruction="CASE WHEN event_id % 7 < 3 THEN 'PRINT <' || event_type || '>' ELSE '' END", example="CASE WHEN event_id % 7 = 3 THEN 'x' END")


@query(f"""WITH a AS (SELECT *, last_value(section IGNORE NULLS) OVER w AS s FROM {RULE_ROWS.sql} WINDOW w AS (PARTITION BY sheet ORDER BY rule_ord ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER (PARTITION BY sheet ORDER BY rule_ord) AND s IS NOT NULL THEN 1 ELSE 0 END AS turn FROM a),
c AS (SELECT *, sum(turn) OVER (PARTITION BY sheet ORDER BY rule_ord ROWS UNBOUNDED PRECEDING) AS run FROM b),
d AS (SELECT *, last_value(CASE WHEN NOT contains(upper(subsection), '{LEAKED_MARKER}') THEN subsection END IGNORE NULLS) OVER (PARTITION BY sheet, run ORDER BY rule_ord ROWS UNBOUNDED PRECEDING) AS u FROM c)
SELECT rule_ord, s AS section, CASE WHEN contains(upper(subsection), '{LEAKED_MARKER}') THEN '' ELSE coalesce(subsection, u) END AS subsection, CASE WHEN item <> '' AND (instruction <> '' OR coalesce(example, '') <> '') THEN 'FIELD_TEXT' ELSE 'NO_PRINT_RULE' END AS rule_type FROM d""")
def normalized_rules(spark, sf):
    rules = RULE_ROWS(spark, sf).withColumns({"label_printed": F.lit(None).cast("string"), "rule_type": F.lit("FIELD_TEXT")})
    return R.normalize_rules(rules, ["sheet"]).select("rule_ord", "section", "subsection", "rule_type")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'CHECKBOX' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'DATE_FORMAT' ELSE 'FIELD_TEXT' END ELSE CASE WHEN p_partkey % 2 = 0 THEN 'NO_PRINT_RULE' ELSE 'STATIC_TEXT' END END AS rule_type FROM part""")
def rule_types_of_parts(spark, sf):
    k = F.col("p_partkey")
    instruction = F.when(k % 3 == 0, F.concat(F.lit("Place an x in the "), "p_name", F.lit(" box"))).when(k % 3 == 1, F.when(k % 2 == 0, "FORMAT: <month> space <dd> comma <yyyy>").otherwise(F.concat(F.lit("PRINT <"), "p_name", F.lit(">")))).otherwise("")
    missing = F.when((k % 3 == 2) & (k % 2 == 0), "leave blank")
    rules = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("item"), instruction.alias("instruction"), F.lit(None).cast("string").alias("example"), missing.alias("if_missing"), F.lit(None).cast("string").alias("if_unknown"), F.lit("text").alias("expected_kind"), F.array().cast("array<string>").alias("expected_options"), F.array().cast("array<string>").alias("part_labels"))
    return R.classify(rules).select("p_partkey", "rule_type")


@query("""SELECT p_partkey, issue FROM (SELECT p_partkey, unnest(CASE WHEN p_partkey % 10 = 0 THEN ['Rule of party B refers to a field of party A'] ELSE [] END || CASE WHEN p_partkey % 4 = 0 THEN ['Possible typo: ORIGN'] ELSE [] END) AS issue FROM part)""")
def issues_of_parts(spark, sf):
    k = F.col("p_partkey")
    rules = table(spark, sf, "part").select(k.alias("rule_id"), k.alias("row_index"), F.lit("x").alias("section"), F.when(k % 2 == 0, "party b").otherwise("party c").alias("subsection"), F.when(k % 4 == 0, "Orign").otherwise("origin").alias("item"), F.when(k % 5 == 0, "PRINT <Party A Name>").otherwise("").alias("instruction"), F.lit(None).cast("string").alias("example"))
    return R.issues(rules).select(F.col("rule_id").alias("p_partkey"), "issue")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) WHEN 1 THEN 'City|State' ELSE '' END AS parts, CASE p_partkey % 3 WHEN 0 THEN '| ' WHEN 1 THEN '|, ' ELSE '' END AS separators FROM part""")
def format_clauses(spark, sf):
    k, first, second = F.col("p_partkey") % 3, F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    item = F.when(k == 0, F.concat(F.lit("12. Thing - "), first, F.lit(" and "), second)).when(k == 1, "HOME TOWN").otherwise(F.col("p_name"))
    instruction = F.when(k == 0, "PRINT <Thing>").when(k == 1, "<City> comma <State>").otherwise(F.concat(F.lit("PRINT <Party A "), "p_name", F.lit(">")))
    clause = table(spark, sf, "part").withColumn("c", R._format_clause_column()(item, instruction))
    return clause.select("p_partkey", F.array_join("c.labels", "|").alias("parts"), F.array_join("c.separators", "|").alias("separators"))


IMAGES = Derived("supplier", sheet="'S' || CAST(s_nationkey % 4 AS STRING)", row0="CAST(s_suppkey AS INT)", image_ord="CAST(s_suppkey AS INT)")
IMAGE_RULES = Derived("nation", sheet="'S' || CAST(n_nationkey % 4 AS STRING)", rule_id="n_name", rule_ord="n_nationkey", row_index="n_nationkey * 3 + 1")


@query(f"""SELECT i.image_ord, arg_min(r.rule_id, struct_pack(g := abs(r.row_index - 1 - i.row0), o := r.rule_ord)) AS rule_id, min(abs(r.row_index - 1 - i.row0)) = 0 AS exact_row FROM {IMAGES.sql} i JOIN {IMAGE_RULES.sql} r ON i.sheet = r.sheet GROUP BY i.image_ord""")
def images_to_rules(spark, sf):
    return R.attach_images(IMAGE_RULES(spark, sf), IMAGES(spark, sf)).select("image_ord", "rule_id", "exact_row")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || CASE WHEN contains(lower(p_name), lower(p_type)) THEN '' ELSE ' ' || p_type END ELSE p_type END AS appended FROM part""")
def recognised_texts(spark, sf):
    k = F.col("p_partkey") % 3
    found = F.when(k == 0, F.upper(F.substring("p_name", 1, 3))).when(k == 1, F.concat(F.lit(" "), "p_type")).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", R.append_text(F.when(k != 2, F.col("p_name")), found).alias("appended"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'checkbox_group' ELSE 'text' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN p_type || '|Other' ELSE '' END AS options, p_partkey % 2 = 0 AS recognised FROM part""")
def pictured_examples(spark, sf):
    """Rules whose example is a picture, through a recogniser: what it reads is added to the example, which is parsed again."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    rules = p.select(F.lit("S").alias("sheet"), k.cast("string").alias("rule_id"), k.cast("int").alias("rule_ord"), (k + 1).cast("int").alias("row_index"), F.lit("sample").alias("example"), F.lit("text").alias("expected_kind"), F.array().cast("array<string>").alias("expected_options"))
    images = p.filter(k % 2 == 0).select(F.lit("S").alias("sheet"), k.cast("int").alias("row0"), F.lit(0).alias("image_ord"), F.encode("p_type", "utf-8").alias("content"))
    exact = providers.recognise_examples(rules, images, lambda asked: [f"{bytes(a['content']).decode()}:selected, Other:unselected" for a in asked])
    return exact.select(F.col("rule_id").cast("long").alias("p_partkey"), F.col("expected_kind").alias("kind"), F.array_join("expected_options", "|").alias("options"), F.col("recognised").isNotNull().alias("recognised"))


# --------------------------------------------------------------------------------------------------- checks and outcomes
@query("""SELECT p_partkey, CASE WHEN abs(p_size - 12) <= 1.5 THEN 'PASS' ELSE 'NOT_VALIDATED' END AS size, CASE WHEN p_size BETWEEN 8 - 1.5 AND 12 + 1.5 THEN 'PASS' ELSE 'NOT_VALIDATED' END AS shrunk, CASE WHEN p_type IN ('SMALL', 'STANDARD') THEN CASE WHEN p_type = 'SMALL' THEN 'PASS' ELSE 'FAIL' END ELSE 'FAIL' END AS font, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size > 20 THEN 'PASS' ELSE 'FAIL' END END AS bold FROM part""")
def print_checks(spark, sf):
    size = F.col("p_size").cast("double")
    one, shrunk = checks.char_size(F.lit("12 pt"), F.lit(None).cast("string"), size), checks.char_size(F.lit("12"), F.lit("8"), size)
    return table(spark, sf, "part").select(
        "p_partkey", one["status"].alias("size"), shrunk["status"].alias("shrunk"), checks.font(F.lit("small caps"), F.col("p_type"))["status"].alias("font"), checks.bold(F.when(F.col("p_partkey") % 3 == 0, " Yes ").otherwise("no"), F.col("p_size") > 20)["status"].alias("bold")
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'blank: part 1' WHEN o_orderkey % 4 = 2 THEN 'blank: middle' END AS gaps, CASE WHEN o_orderkey % 3 = 0 THEN 'PASS' WHEN o_orderkey % 3 = 1 THEN 'FAIL' END AS specified,
CASE o_orderkey % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN CASE WHEN o_orderstatus = 'F' THEN 'PASS' ELSE 'FAIL' END END AS instructed FROM orders""".replace("CASE WHEN o_orderstatus = 'F' THEN 'PASS' ELSE 'FAIL' END", "CASE WHEN length(o_orderstatus) = 1 THEN 'PASS' ELSE 'FAIL' END"))
def value_checks(spark, sf):
    k, v = F.col("o_orderkey"), F.col("o_orderstatus")
    part = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    gaps = checks.part_gaps(F.array(part("", F.when(k % 4 != 1, v)), part("middle", F.when(k % 4 != 2, v).otherwise("")), part("last", F.when(k % 4 != 3, v))))
    text_ = F.when(k % 3 == 0, F.concat(F.lit("Other (specify): selected; "), v)).otherwise("Other (specify)-selected")
    specified = checks.specify_text(F.when(k % 3 == 2, F.array(F.lit("None"))).otherwise(F.array(F.lit("Other (specify)"))), text_, F.array().cast("array<struct<key:string,value:string>>"))
    verdict = F.when(k % 5 == 0, "pass").when(k % 5 == 1, "fail").when(k % 5 == 2, "unsure")
    instructed = checks.instruction(F.lit("text"), F.lit("PRINT <Status>"), F.lit(None).cast("string"), v, F.lit("A"), verdict, F.lit("because"))
    return table(spark, sf, "orders").select("o_orderkey", gaps["actual"].alias("gaps"), specified["status"].alias("specified"), instructed["status"].alias("instructed"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS option, CASE WHEN o_orderkey % 4 IN (1, 2) THEN 'Name' END AS key, o_orderkey % 2 = 0 AS on_page FROM orders""".replace("o_orderkey % 4 IN (1, 2)", "o_orderkey % 4 = 1"))
def model_answers(spark, sf):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    option = providers.accepted_option(F.when(k % 3 == 0, p).otherwise("other"), F.array(F.lit("x"), p))
    key = providers.accepted_key(F.when(k % 4 == 1, "Name").when(k % 4 == 2, "name").otherwise("City"), F.array(F.lit("Name"), F.lit("City")), F.array(F.lit("CITY")))
    on_page = providers.key_on_page(F.when(k % 2 == 0, F.concat(p, F.lit("  IS"))).otherwise("nowhere"), F.array(F.lit("this"), F.lower(p), F.lit("is it")))
    return table(spark, sf, "orders").select("o_orderkey", option.alias("option"), key.alias("key"), on_page.alias("on_page"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'a ' || c_mktsegment END AS longer, upper(c_name) || '-' || c_mktsegment AS dashed, lower(trim(regexp_replace(upper(c_name), '[^A-Z0-9]+', ' ', 'g'))) || ' and' AS label, c_custkey % 3 = 0 AS shaped FROM customer""")
def norms_and_shapes(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    longer = analysis.longer_text("service", "native")
    rows = c.withColumn("service", F.when(k % 2 == 0, "x").otherwise(F.concat(F.lit("a "), "c_mktsegment"))).withColumn("native", F.when(k % 2 == 0, F.col("c_name")))
    shape = values.format_matches(F.col("c_name"), F.when(k % 3 == 0, "Supplier#1").otherwise("Supplier 1"))
    return rows.select("c_custkey", longer.alias("longer"), text.dash_norm(F.concat("c_name", F.lit(" – "), F.lower("c_mktsegment"))).alias("d"), F.lower(text.label_norm(F.concat("c_name", F.lit(" &")))).alias("label"), shape.alias("shaped")).select("c_custkey", "longer", F.replace("d", F.lit(" - "), F.lit("-")).alias("dashed"), "label", "shaped")


STATIC = Derived("customer", doc_id="CAST(c_custkey AS STRING)", segment="c_mktsegment", item="CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE 'nothing' END", rule_type="CASE WHEN c_custkey % 3 = 0 THEN 'FIELD_TEXT' WHEN c_custkey % 3 = 1 THEN 'STATIC_TEXT' ELSE 'TEXT_OR_LAYOUT' END", instruction="CASE WHEN c_custkey % 5 = 0 THEN 'PRINT' END", k="c_custkey")


@query(f"""SELECT doc_id, k % 2 = 0 AND k % 3 <> 0 AND k % 5 <> 0 AS recovered, CASE WHEN k % 2 = 0 AND k % 3 <> 0 AND k % 5 <> 0 THEN 'PASS' ELSE 'MISSING_DATA' END AS status, CASE WHEN k % 2 = 0 AND k % 3 <> 0 AND k % 5 <> 0 THEN item END AS di_value FROM {STATIC.sql}""")
def static_texts_recovered(spark, sf):
    rows = STATIC(spark, sf)
    empty = {"matched": F.lit(False), "status": F.lit("MISSING_DATA"), "di_kind": F.lit(None).cast("string"), "di_key": F.lit(None).cast("string"), "di_value": F.lit(None).cast("string"), "match_score": F.lit(0.0), "page": F.lit(None).cast("int"), "checks": F.array().cast(f"array<{CHECK}>"), "message": F.lit("")}
    documents = rows.select("doc_id", F.concat(F.lit("issued  by the "), "segment", F.lit(" desk")).alias("full_text"))
    return outcome.recover_static(rows.withColumns(empty), documents).select("doc_id", "recovered", "status", "di_value")


#: Rows before review: matched or not, sure of identity or not, with a failed check or not, technical or not.
REVIEW = Derived("orders", doc_id="CAST(o_custkey AS STRING)", k="o_orderkey", rule_id="CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'r' || CAST(o_orderkey AS STRING) END", matched="o_orderkey % 3 <> 0", sure="o_orderkey % 5 <> 0", failed="o_orderkey % 7 = 0")


@query(f"""SELECT k, CASE WHEN k % 11 = 0 THEN NULL WHEN matched AND sure THEN CASE WHEN failed THEN 'FAIL' ELSE 'PASS' END ELSE 'REVIEW_REQUIRED' END AS reviewer_status, CASE WHEN failed THEN 'FAIL' ELSE 'PASS' END AS internal_status,
CASE WHEN k % 11 <> 0 AND NOT (matched AND sure) THEN concat_ws(' ', CASE WHEN NOT matched THEN 'No field was matched with confidence.' END, CASE WHEN matched AND NOT sure THEN 'section mismatch' END, CASE WHEN failed THEN 'too long' END) END AS review_reason FROM {REVIEW.sql}""")
def reviewer_outcomes(spark, sf):
    return outcome.reviewed(_before_review(spark, sf)).select("k", "reviewer_status", "internal_status", "review_reason")


def _before_review(spark, sf):
    text_of = lambda v: F.lit(v).cast("string")
    check = checks.check("max_chars", F.when(F.col("failed"), "FAIL").otherwise("PASS"), "", "", F.when(F.col("failed"), "too long").otherwise("")).cast(CHECK)
    identity = F.when(F.col("matched"), F.struct(F.col("sure").alias("confident"), F.lit(100.0).alias("label_score"), F.lit(100.0).alias("rule_coverage"), F.lit(100.0).alias("field_coverage"), F.when(F.col("sure"), F.array().cast("array<string>")).otherwise(F.array(F.lit("section mismatch"))).alias("reasons")))
    given = {
        "rule_type": F.lit("FIELD_TEXT"), "sheet": F.lit("S"), "section": text_of(None), "subsection": text_of(None), "item": F.lit("NAME"), "di_kind": F.when(F.col("matched"), "text"), "di_section": text_of(None), "di_key": F.when(F.col("matched"), "NAME"), "di_value": F.concat(F.lit("no 123-45-6789 of "), F.col("k").cast("string")),
        "match_score": F.when(F.col("matched"), 100.0).otherwise(0.0), "page": F.lit(1), "bbox": F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"), "confidence": F.lit(0.9), "checks": F.array(check), "status": F.when(F.col("failed"), "FAIL").otherwise("PASS"), "message": F.lit(""), "instruction": text_of(None), "if_unknown": text_of(None), "expected_parts": F.lit(None).cast("array<string>"),
        "complete": F.lit(None).cast("boolean"), "payload_ok": F.lit(None).cast("boolean"), "subsection_conflict": F.lit(None).cast("boolean"), "instruction_mode": text_of(None), "sequence_state": F.lit("MATCHED"), "recovered": F.lit(False), "identity": identity, "geometry_trusted": F.lit(True), "id": F.concat(F.lit("CMP-"), F.col("k").cast("string")),
    }
    return REVIEW(spark, sf).withColumns(given)


@query(f"""SELECT doc_id, 'CMP-' || k AS id, CASE WHEN failed THEN 'FAIL' ELSE 'PASS' END AS status, matched, CASE WHEN matched THEN 'NAME' END AS di_key, 'no ***-**-**** of ' || k AS di_value FROM {REVIEW.sql} WHERE k % 11 <> 0""")
def flat_comparison(spark, sf):
    return sinks.flat_records(_before_review(spark, sf)).select("doc_id", "id", "status", "matched", "di_key", "di_value")


@query(f"""SELECT doc_id, 'CMP-' || k AS id, 'FIELD_TEXT' AS category, 'NAME' AS expected, 'no ***-**-**** of ' || k AS actual, CASE WHEN failed THEN 'FAIL' ELSE 'PASS' END AS internal FROM {REVIEW.sql} WHERE k % 11 <> 0""")
def result_records(spark, sf):
    out = sinks.results(outcome.reviewed(_before_review(spark, sf)))
    return out.select("doc_id", "id", "category", "expected", "actual", F.col("metadata.internal_status").alias("internal"))


@query(f"""WITH r AS (SELECT doc_id, k, CASE WHEN matched AND sure THEN CASE WHEN failed THEN 'FAIL' ELSE 'PASS' END ELSE 'REVIEW_REQUIRED' END AS status FROM {REVIEW.sql} WHERE k % 11 <> 0)
SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'REVIEW_REQUIRED') AS n_review, string_agg('CMP-' || k || '=' || status, '|' ORDER BY 'CMP-' || k || '=' || status) AS records FROM r GROUP BY doc_id""")
def comparison_documents(spark, sf):
    """The comparison of a document as one object: its summary and its records."""
    d = sinks.comparison_documents(outcome.reviewed(_before_review(spark, sf)))
    n = lambda s: F.coalesce(F.try_element_at("summary", F.lit(s)), F.lit(0).cast("long"))
    return d.select("doc_id", "total", n("PASS").alias("n_pass"), n("FAIL").alias("n_fail"), n("REVIEW_REQUIRED").alias("n_review"), F.array_join(F.array_sort(F.transform("records", lambda r: F.concat_ws("=", r["id"], r["status"]))), "|").alias("records"))


@query(f"""SELECT doc_id, 'CMP-' || k AS id, CASE WHEN k % 2 = 0 THEN 0.25e0 END AS bbox_x0, CASE WHEN k % 2 = 0 THEN 0.75e0 END AS bbox_y1 FROM {REVIEW.sql} WHERE k % 11 <> 0""")
def result_sheet(spark, sf):
    """Results with the box in columns of their own, as the workbook's sheet of results has them."""
    rows = outcome.reviewed(_before_review(spark, sf).withColumn("bbox", F.when(F.col("k") % 2 == 0, geometry.box(F.lit(0.25), F.lit(0.5), F.lit(0.5), F.lit(0.75)))))
    return sinks.result_rows(sinks.results(rows)).select("doc_id", "id", "bbox_x0", "bbox_y1")


# ------------------------------------------------------------------------------------------------------------ analyses
#: An analysis of two pairs and a line, as JSON text.
JSONS = Derived("customer", doc_id="c_custkey", value="""'{"full_text":"' || c_name || '","page_sizes":{"1":[8.5,11.0]},"key_value_pairs":[{"page":1,"key":"  Name  of ","value":"' || c_name || '","bbox":[0.1,0.2,0.3,0.4],"confidence":0.5},{"key":"' || c_mktsegment || '","bbox":[0.1,0.2]}],"lines":[{"page":2,"text":" ","bbox":[0,0,1,1]},{"text":"' || c_mktsegment || '  line","bbox":[0.0,0.5,1.0,0.6]}]}'""")


@query(f"""SELECT c.doc_id, content_key, kv_ord, 1 AS page, CASE kv_ord WHEN 0 THEN 'Name of' ELSE c_mktsegment END AS key, CASE kv_ord WHEN 0 THEN c_name ELSE '' END AS value, CASE kv_ord WHEN 0 THEN 0.4e0 END AS y1, CASE kv_ord WHEN 0 THEN 0.1e0 END AS value_x0 FROM (SELECT doc_id, substr(md5(value), 1, 16) AS content_key, unnest([0, 1]) AS kv_ord FROM {JSONS.sql}) c JOIN customer ON c_custkey = c.doc_id""")
def analysis_pairs(spark, sf):
    parsed = analysis.parse(JSONS(spark, sf))
    pairs = analysis.kv_pairs(parsed).join(parsed.select("doc_id", "content_key"), "doc_id")
    return pairs.select("doc_id", "content_key", "kv_ord", "page", "key", "value", F.col("bbox.y1").alias("y1"), F.col("value_bbox.x0").alias("value_x0"))


@query("SELECT c_custkey AS doc_id, 1 AS page, 1 AS line_ord, c_mktsegment || ' line' AS text, 8.5e0 AS width, 0.6e0 AS y1 FROM customer")
def analysis_lines(spark, sf):
    parsed = analysis.parse(JSONS(spark, sf))
    sizes = analysis.page_sizes(parsed).select("doc_id", "page", "width")
    return analysis.lines(parsed).join(sizes, ["doc_id", "page"]).select("doc_id", "page", "line_ord", "text", "width", F.col("bbox.y1").alias("y1"))


@query("SELECT c_custkey AS doc_id, 2 AS n_pairs, 2 AS n_lines, 0 AS n_styles, 1 AS n_checkboxes FROM customer".replace("1 AS n_checkboxes", "0 AS n_checkboxes"))
def analysis_counts(spark, sf):
    return analysis.element_counts(analysis.parse(JSONS(spark, sf))).select("doc_id", "n_pairs", "n_lines", "n_styles", "n_checkboxes")


SPANS = Derived("lineitem", doc_id="CAST(l_orderkey AS STRING)", style_ord="l_linenumber", start="l_linenumber * 3", stop="l_linenumber * 3 + CAST(l_quantity AS INT) % 9", font="CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END", weight="CASE WHEN l_linestatus = 'O' THEN 'Bold' WHEN l_tax > 0.04 THEN 'normal' END", part="l_partkey", supp="l_suppkey")
FIRST_SPANS = f"(SELECT * FROM {SPANS.sql} QUALIFY row_number() OVER (PARTITION BY doc_id, style_ord ORDER BY part, supp, stop, font, weight) = 1)"


@query(f"""SELECT doc_id, value_id, arg_max(font, style_ord) FILTER (hit AND font IS NOT NULL) AS font_family, lower(arg_max(weight, style_ord) FILTER (hit AND weight IS NOT NULL)) = 'bold' AS is_bold FROM
(SELECT v.doc_id, v.value_id, s.style_ord, s.font, s.weight, v.start < s.stop AND s.start < v.stop AS hit FROM (SELECT DISTINCT doc_id, unnest([1, 2]) AS value_id, value_id * 6 AS start, value_id * 6 + 5 AS stop FROM {FIRST_SPANS}) v JOIN {FIRST_SPANS} s ON v.doc_id = s.doc_id) GROUP BY doc_id, value_id""")
def value_styles(spark, sf):
    first = F.min_by(F.struct("start", "stop", "font", "weight"), F.struct("part", "supp", "stop", F.col("font"), F.col("weight")))
    s = SPANS(spark, sf).withColumns({"font": F.coalesce("font", F.lit("~")), "weight": F.coalesce("weight", F.lit("~"))}).groupBy("doc_id", "style_ord").agg(first.alias("b")).select("doc_id", "style_ord", "b.*")
    styles = s.select("doc_id", "style_ord", "start", "stop", F.nullif("font", F.lit("~")).alias("font_family"), F.lit(None).cast("string").alias("font_style"), F.nullif("weight", F.lit("~")).alias("font_weight"), F.lit(None).cast("string").alias("color"))
    v = s.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("value_id")).withColumns({"start": F.col("value_id") * 6, "stop": F.col("value_id") * 6 + 5})
    return analysis.style_of_values(v, styles).select("doc_id", "value_id", "font_family", "is_bold")


# ---------------------------------------------------------------------------------------------------------- whole audit
FORM_RULES = [
    {"item": "ACCOUNT BALANCE", "instruction": "PRINT <Balance>", "max_chars": "6", "rule_type": "FIELD_TEXT"},
    {"item": "MARKET SEGMENT", "instruction": "PRINT <Segment>", "rule_type": "FIELD_TEXT"},
    {"item": "ISSUED ON", "instruction": "FORMAT: MM/DD/YYYY", "example": "01/02/1999", "expected_kind": "date", "rule_type": "DATE_FORMAT"},
    {"item": "Sealed by the clerk", "rule_type": "STATIC_TEXT"},
    {"item": "HOUSEHOLD SIZE", "instruction": "PRINT <Size>", "rule_type": "FIELD_TEXT"},
]
#: A form for each customer: its balance, its segment (blank, unknown or printed), a date of two patterns, and a seal on some.
FORMS = Derived("customer", doc_id="CAST(c_custkey AS STRING)", k="c_custkey", balance="CAST(CAST(floor(c_acctbal) AS INT) AS STRING)", segment="CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'UNKNOWN' ELSE c_mktsegment END", dated="CASE WHEN c_custkey % 3 = 0 THEN 'May 5 2020' ELSE '05/05/2020' END", full_text="CASE WHEN c_custkey % 2 = 0 THEN 'this is sealed  by the CLERK' ELSE 'not sealed' END")
FORM_SQL = f"""SELECT doc_id, 'S-0001' AS rule_id, CASE WHEN length(balance) <= 6 THEN 'PASS' ELSE 'FAIL' END AS internal, CASE WHEN length(balance) <= 6 THEN 'PASS' ELSE 'FAIL' END AS reviewer, balance AS value FROM {FORMS.sql}
UNION ALL SELECT doc_id, 'S-0002', CASE k % 4 WHEN 0 THEN 'MISSING_DATA' WHEN 1 THEN 'UNKNOWN_DATA' ELSE 'PASS' END, 'PASS', segment FROM {FORMS.sql}
UNION ALL SELECT doc_id, 'S-0003', CASE WHEN k % 3 = 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN k % 3 = 0 THEN 'FAIL' ELSE 'PASS' END, dated FROM {FORMS.sql}
UNION ALL SELECT doc_id, 'S-0004', 'NOT_VALIDATED', NULL, NULL FROM {FORMS.sql}
UNION ALL SELECT doc_id, 'S-0005', 'MISSING_DATA', 'REVIEW_REQUIRED', NULL FROM {FORMS.sql}"""


def audited_customers(spark: SparkSession, sf: str) -> DataFrame:
    forms = FORMS(spark, sf)
    printed = F.array(*(F.struct(F.lit(n).alias("field_ord"), F.lit(key).alias("key"), F.col(c).alias("v")) for n, (key, c) in enumerate((("ACCOUNT BALANCE", "balance"), ("MARKET SEGMENT", "segment"), ("ISSUED ON", "dated")))))
    each = forms.select("doc_id", F.explode(printed).alias("x")).select("doc_id", "x.*")
    schema = {f.name: f.dataType for f in spark.createDataFrame([], FIELDS).schema}
    given = {"doc_id": F.col("doc_id"), "field_ord": F.col("field_ord"), "page": F.lit(1), "kind": F.lit("text"), "key": F.col("key"), "value_text": F.col("v"), "bbox": box("0.1e0", "0.2e0 + field_ord * 0.05e0", "0.5e0", "0.21e0 + field_ord * 0.05e0"), "confidence": F.lit(0.9)}
    fields = each.select(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in schema.items()))
    return audit(Q._rules(spark, *FORM_RULES), fields, forms.select("doc_id", F.lit("S").alias("sheet"), "full_text"))


@query(FORM_SQL)
def audited_forms(spark, sf):
    """The whole audit, from matching to outcomes, over a form for each customer."""
    return audited_customers(spark, sf).select("doc_id", "rule_id", F.col("internal_status").alias("internal"), F.col("reviewer_status").alias("reviewer"), F.col("di_value").alias("value"))


# ------------------------------------------------------------------------------------------------- identity and siblings
IDENTITY = Derived("part", k="p_partkey", item="p_type || ' ' || p_name", di_key="CASE p_partkey % 4 WHEN 0 THEN lower(p_type) || ' - ' || p_name WHEN 1 THEN p_name WHEN 2 THEN 'Date' ELSE p_type || ', ' || p_name END", section="CASE WHEN p_partkey % 4 = 3 THEN 'Groom' ELSE '' END", di_section="CASE WHEN p_partkey % 8 = 3 THEN 'Bride' ELSE 'the groom' END", name="p_name", kind="p_type")


@query(f"""WITH a AS (SELECT *, CASE WHEN k % 4 = 2 THEN 'NAME' ELSE upper(item) END AS i, CASE WHEN k % 4 = 2 THEN 'DATE' WHEN k % 4 = 1 THEN upper(name) ELSE upper(item) END AS d, contains(lower(name), lower(kind)) AS twice FROM {IDENTITY.sql}),
b AS (SELECT *, CASE WHEN k % 4 = 2 THEN 50e0 WHEN k % 4 = 1 THEN 2e2 * length(d) / (length(i) + length(d)) ELSE 1e2 END AS ratio, CASE WHEN k % 4 = 2 THEN 0e0 WHEN k % 4 = 1 AND NOT twice THEN 1e2 * 2 / 3 ELSE 1e2 END AS cover_rule, CASE WHEN k % 4 = 2 THEN 0e0 ELSE 1e2 END AS cover_field FROM a),
c AS (SELECT *, CASE WHEN k % 4 = 2 THEN FALSE ELSE ratio >= 72 OR (cover_rule >= 75 AND cover_field >= 60) END AS lexical FROM b)
SELECT k, lexical AND k % 8 <> 3 AS confident, round(ratio, 2) AS label_score, round(cover_rule, 2) AS rule_coverage, round(cover_field, 2) AS field_coverage,
concat_ws('; ', CASE WHEN k % 4 = 2 THEN 'generic-only labels differ: NAME / DATE' WHEN NOT lexical THEN 'weak label similarity (' || printf('%.1f', ratio) || '%)' END, CASE WHEN k % 4 = 2 THEN 'distinctive words do not agree' END, CASE WHEN k % 4 = 1 AND NOT twice THEN 'words not found: ' || lower(kind) END, CASE WHEN k % 8 = 3 THEN 'section mismatch' END) AS reasons FROM c""")
def identity_of_parts(spark, sf):
    rows = IDENTITY(spark, sf).withColumn("item", F.when(F.col("k") % 4 == 2, "Name").otherwise(F.col("item"))).withColumns({"subsection": F.lit(""), "di_subsection": F.lit(None).cast("string")})
    found = guard.identity(rows)
    return found.select("k", *(F.col(f"identity.{n}").alias(n) for n in ("confident", "label_score", "rule_coverage", "field_coverage")), F.array_join("identity.reasons", "; ").alias("reasons"))


NAMES = Derived("customer", doc_id="CAST(c_custkey AS STRING)", k="c_custkey", a="c_name", b="c_mktsegment")


@query(f"""SELECT doc_id, 'NAME - First, Last' AS key, a || ', ' || b || CASE WHEN k % 2 = 0 THEN ' last' ELSE '' END AS value, CASE WHEN k % 2 = 0 THEN '0|1|2' ELSE '0|1' END AS members, TRUE AS complete, 'NAME' AS anchor_key FROM {NAMES.sql}""")
def sibling_parts(spark, sf):
    """A rule of two parts, whose fields stand on its line; the last one on another line for every second form."""
    n = NAMES(spark, sf)
    each = F.array(*(F.struct(F.lit(i).alias("field_ord"), F.lit(key).alias("key"), v.alias("value"), y.alias("y")) for i, (key, v, y) in enumerate((("NAME", F.col("a"), F.lit(0.2)), ("First", F.col("b"), F.lit(0.205)), ("Last", F.lit("last"), F.when(F.col("k") % 2 == 0, 0.2).otherwise(0.3)), ("First name of the very best man", F.lit("x"), F.lit(0.2))))))
    place = geometry.box(F.col("field_ord") * 0.1, F.col("y"), F.col("field_ord") * 0.1 + 0.05, F.col("y"))
    fields = n.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*").select("doc_id", "field_ord", F.lit(1).alias("page"), F.lit("text").alias("kind"), "key", "value", place.alias("bbox"))
    rules = n.select("doc_id", F.lit("r").alias("rule_id"), F.lit("NAME - First, Last").alias("item"), F.array(F.lit("First"), F.lit("Last")).alias("part_labels"), F.array(F.lit(""), F.lit(", ")).alias("part_separators"))
    bound = assign.assign(rules, fields, n.select("doc_id", F.lit("r").alias("rule_id"), F.lit(0).alias("field_ord"), F.lit(90.0).alias("score")))
    return bound.select("doc_id", "key", "value", F.array_join(F.transform("members", lambda m: m.cast("string")), "|").alias("members"), "complete", "anchor_key")


@query(f"""SELECT doc_id, 'r' AS rule_id, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS kv_ord, CASE WHEN k % 2 = 0 THEN 109.89e0 ELSE 103.89e0 END AS score FROM {NAMES.sql}""")
def keys_by_party(spark, sf):
    """A key that occurs twice: its first half is party A's; the second one's value is a placeholder."""
    n = NAMES(spark, sf)
    kv = n.select("doc_id", F.explode(F.array(*(F.struct(F.lit(i).alias("kv_ord"), F.lit(key).alias("key"), v.alias("value")) for i, (key, v) in enumerate((("Balance  due", F.col("a")), ("BALANCE DUE", F.lit("unknown")), ("OTHER", F.lit("x"))))))).alias("x")).select("doc_id", "x.*")
    labels = n.select("doc_id", F.lit("r").alias("rule_id"), F.lit(1).alias("rule_ord"), F.array(F.lit("Balance")).alias("labels"), F.when(F.col("k") % 2 == 0, "A").otherwise("B").alias("party"), F.lit("FIELD_TEXT").alias("rule_type"))
    return assign.key_matches(labels, kv).withColumn("score", F.round("score", 6))


# ----------------------------------------------------------------------------------------------------- answers of models
@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Origin' ELSE p_name END AS item, CASE WHEN p_partkey % 4 = 0 THEN 'Orign' END AS was, 'FIELD_TEXT' AS rule_type FROM part""")
def rules_mended_by_model(spark, sf):
    k = F.col("p_partkey")
    rules = table(spark, sf, "part").select(k.alias("rule_id"), k.alias("row_index"), F.lit("s").alias("section"), F.lit("").alias("subsection"), F.when(k % 4 == 0, "Orign").otherwise(F.col("p_name")).alias("item"), F.lit("PRINT <it>").alias("instruction"), *(F.lit(None).cast("string").alias(c) for c in ("example", "if_missing", "if_unknown")), F.lit("text").alias("expected_kind"), F.array().cast("array<string>").alias("expected_options"), F.array().cast("array<string>").alias("part_labels"))
    mended = providers.repair_rules(rules, R.issues(rules), lambda asked: [{**{c: a[c] for c in providers.REPAIRABLE}, "item": a["item"].replace("Orign", "Origin")} for a in asked])
    return mended.select(F.col("rule_id").alias("p_partkey"), "item", F.col("original.item").alias("was"), "rule_type")


@query(f"""SELECT doc_id, CASE WHEN k % 3 = 0 THEN b ELSE 'old' END AS key, CASE WHEN k % 3 = 2 THEN 'old section' ELSE 'new section' END AS section FROM {NAMES.sql}""")
def fields_named_by_model(spark, sf):
    """A model names sections and keys; a key counts where it stands on the page, and an answer where its kind is known."""
    n = NAMES(spark, sf)
    fields = n.select("doc_id", F.lit(0).alias("field_ord"), F.lit(1).alias("page"), F.lit("text").alias("kind"), F.lit("old section").alias("section"), F.lit("").alias("subsection"), F.lit("old").alias("key"), F.concat_ws("|", F.col("k").cast("string"), "b").alias("value_text"))
    lines = n.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("line_ord"), F.concat(F.lit("the "), "b", F.lit(" line")).alias("text"))

    def provider(asked: list[dict]) -> list:
        out = []
        for a in asked:
            k, b = a["value_text"].split("|")
            out.append({"kind": "text" if int(k) % 3 < 2 else "number", "section": "new section", "subsection": "", "key": b if int(k) % 3 == 0 else "not on the page"})
        return out

    return providers.reconstruct(fields, providers.page_texts(lines), provider).select("doc_id", "key", "section")


@query(f"""SELECT doc_id, CASE WHEN k % 2 = 0 THEN 'Yes=SI/selected|No=NO/unselected' ELSE 'Yes=/|No=NO/unselected' END AS aligned, CASE WHEN k % 3 = 0 THEN b ELSE 'KEY' END AS key FROM {NAMES.sql}""")
def options_and_keys_by_model(spark, sf):
    """Options that no label fits, and the key of a checkbox group: a model's answer counts if it is a label held, or a text printed nearby that is no option."""
    n = NAMES(spark, sf)
    pair = lambda o, x, s: F.struct(F.lit(o).alias("option"), F.lit(x).cast("string").alias("label"), F.lit(s).cast("string").alias("state"))
    held = lambda x, s: F.struct(F.lit(x).alias("label"), F.lit(s).alias("state"))
    rows = n.select("doc_id", F.lit("r").alias("rule_id"), F.when(F.col("k") % 2 == 0, "a").otherwise("b").alias("item"), F.array(pair("Yes", None, None), pair("No", "NO", "unselected")).alias("aligned"), F.array(held("SI", "selected"), held("NO", "unselected")).alias("held"))
    aligned = providers.align_with_model(rows, lambda asked: [{"Yes": "SI" if a["item"] == "a" else "NO"} for a in asked])
    shown = F.array_join(F.transform("aligned", lambda a: F.concat(a["option"], F.lit("="), F.coalesce(a["label"], F.lit("")), F.lit("/"), F.coalesce(a["state"], F.lit("")))), "|")
    child = F.struct(F.lit("SI").alias("label"))
    fields = n.select("doc_id", F.lit(0).alias("field_ord"), F.lit("checkbox_group").alias("kind"), F.lit("KEY").alias("key"), F.array(child).alias("children"))
    near = n.select("doc_id", F.lit(0).alias("field_ord"), F.when(F.col("k") % 3 == 0, F.array("b", F.lit("SI"))).when(F.col("k") % 3 == 1, F.array(F.lit("SI"), F.col("b"))).otherwise(F.array(F.lit("elsewhere"))).alias("texts"))
    named = providers.repair_keys(fields, near, lambda asked: [a["texts"][0] if a["texts"][0] != "elsewhere" else "made up" for a in asked])
    return aligned.select("doc_id", shown.alias("aligned")).join(named.select("doc_id", "key"), "doc_id")


@query(f"""SELECT doc_id, 'r' AS rule_id, CASE k % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'unsure' END AS verdict, CASE WHEN k % 5 = 0 THEN 'if unknown' ELSE '' END AS reason FROM {NAMES.sql}""")
def verdicts_by_model(spark, sf):
    n, k = NAMES(spark, sf), F.col("k")
    bound = n.select("doc_id", F.lit("r").alias("rule_id"), F.concat_ws(":", F.lit("item"), k.cast("string")).alias("item"), F.lit("text").alias("kind"), F.lit("PRINT <it>").alias("instruction"), F.lit("if  unknown").alias("if_unknown"), F.when(k % 5 == 0, "UNKNOWN").otherwise(F.col("a")).alias("value"), F.lit(None).cast("string").alias("example"), F.lit(None).cast("string").alias("max_chars"))
    said = ("Pass", "UNSURE", "perhaps")
    return providers.instruction_verdicts(bound, lambda asked: [{"verdict": said[int(a["item"].split(":")[1]) % 3], "reason": a["if_unknown"]} for a in asked], calls=3)


@query("""SELECT CAST(o_custkey AS VARCHAR) AS doc_id, 'r' || (1000000 + o_orderkey) AS rule_id, 'NAME ' || o_orderstatus AS finding FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) <= 200""")
def pairs_seen_by_model(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.concat(F.lit("r"), (k + 1000000).cast("string")).alias("rule_id"), F.lit("name").alias("item"), F.col("o_orderstatus").alias("di_value"), (k % 2 == 0).alias("matched"))
    return providers.pair_findings(rows, lambda asked: [f"{a['item']} {a['di_value']}" if a["di_value"] != "P" else None for a in asked])


# ------------------------------------------------------------------------------------------------ reports for a reader
@query(f"WITH RECURSIVE u AS (SELECT upper(a) AS a, upper(b) AS b FROM {NAME_PAIRS}), {token_set_sql('u')} SELECT x.a, x.b, contains(x.b, x.a) OR score >= 85 AS contained FROM {NAME_PAIRS} x JOIN token_set t ON upper(x.a) = t.a AND upper(x.b) = t.b")
def fuzzy_containment(spark, sf):
    return fuzzy.with_contained(_name_pairs(spark, sf), "b", "a", "contained")


@query("SELECT 'w' AS workbook, n_name AS sheet, 1 + n_nationkey % 3 AS col0 FROM nation WHERE n_nationkey % 4 <> 0")
def example_columns(spark, sf):
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    heads = [F.struct(F.lit(0).alias("col0"), F.lit("Section").alias("text")), F.struct(F.lit(7).alias("col0"), F.lit("Item, e.g. an example").alias("text")), F.struct((k % 3 + 1).alias("col0"), F.lit(" Example  value").alias("text"))]
    cells = n.select(F.lit("w").alias("workbook"), F.col("n_name").alias("sheet"), F.explode(F.when(k % 4 == 0, F.array(heads[0])).otherwise(F.array(*heads))).alias("x")).select("workbook", "sheet", F.lit(2).alias("row0"), "x.*")
    return R.example_columns(cells)


@query(f"SELECT sheet, rule_ord, item FROM {RULE_ROWS.sql} ORDER BY sheet, rule_ord LIMIT 500")
def rules_previewed(spark, sf):
    """The first 500 rules, which is what a preview is."""
    return R.preview(RULE_ROWS(spark, sf).withColumn("label_printed", F.lit("x"))).select("sheet", "rule_ord", "item")


@query("SELECT l_orderkey, count(*) AS total_selection_marks, count(*) FILTER (l_returnflag <> 'N') AS selected_marks FROM lineitem GROUP BY l_orderkey")
def selection_marks(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("text", F.when(F.col("l_returnflag") == "R", ":Selected:").when(F.col("l_returnflag") == "A", ":unselected:"))  # noqa: E741
    return checkboxes.mark_summary(l, ["l_orderkey"], "text")


@query("SELECT s_nationkey, count(*) AS images_total, count(*) FILTER (s_suppkey % 3 <> 0) AS images_with_text, count(*) FILTER (s_suppkey % 2 = 0) AS checkbox_example_images, count(DISTINCT s_suppkey % 5) FILTER (s_suppkey % 4 <> 1) AS image_only_rows FROM supplier GROUP BY s_nationkey")
def recognition_counts(spark, sf):
    k = F.col("s_suppkey")
    seen = table(spark, sf, "supplier").select("s_nationkey", (k % 5).alias("row0"), F.when(k % 3 == 1, "x").when(k % 3 == 2, "y").alias("text"), F.when(k % 2 == 0, "structured_checkbox").otherwise("plain").alias("mode"), (k % 4 == 1).alias("exact_row"))
    return providers.recognition_metrics(seen, ["s_nationkey"])


@query("SELECT c_custkey AS doc_id, c_name AS full_text, 'Name of'  AS key, c_mktsegment || ' line' AS line FROM customer")
def analysis_dump(spark, sf):
    dumped = analysis.dump(analysis.parse(JSONS(spark, sf)))
    path = lambda p: F.trim(F.regexp_replace(F.get_json_object("json", p), " +", " "))
    return dumped.select("doc_id", path("$.full_text").alias("full_text"), path("$.key_value_pairs[0].key").alias("key"), path("$.lines[1].text").alias("line"))


@query("SELECT o_custkey % 20 AS doc_id, least(count(*), 50) || ' from ' || min(o_orderkey) AS summary FROM orders GROUP BY 1")
def issues_summarised(spark, sf):
    issues = table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("doc_id"), F.col("o_orderkey").alias("issue_ord"), F.col("o_orderkey").cast("string").alias("issue"))
    return providers.summarised(issues, lambda asked: [f"{len(a['issues'])} from {a['issues'][0]}" for a in asked])


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 'CMP-1' AS id, c_mktsegment || ': ' || c_name AS explanation FROM customer")
def rows_explained(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit("CMP-1").alias("id"), F.col("c_mktsegment").alias("item"), F.lit("FAIL").alias("status"), F.col("c_name").alias("message"))
    return providers.explained(rows, lambda asked: [f"{a['item']}: {a['message']}" for a in asked])
