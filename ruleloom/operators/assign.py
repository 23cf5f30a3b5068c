"""One-to-one assignment, best pairs first.

greedy() takes the pairs of a group in one order and accepts each whose two sides are still free. by_rounds() gives the
same from joins alone: it accepts, again and again, all pairs that come first for both of their sides. The first needs a
group's pairs in one task, which for a document or a sheet is little; the second serves groups of any size. Where each of
one side meets each of the other and few classes decide the score, greedy_between() gives the same without the pairs.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.fuzzy import token_set, with_scores
from ..functions.text import clean, contains_either, norm
from ..functions.values import is_placeholder
from ..lookups import (
    ACCEPT_FLOOR, KIND_PENALTY, LABEL_FLOOR, MONTHS, PART_FLOOR, PART_LINE, PLACEHOLDER_PENALTY, SECTION_BONUS, SECTION_PENALTY, SEQUENCE_FLOOR, SEQUENCE_SPAN, SEQUENCE_WEIGHTS, SUBSECTION_BONUS, SUBSECTION_PENALTY, VALUE_CAP, VALUE_DISCOUNT,
)
from ..session import checkpointed
from .grouped import by_group

Order = list[tuple[str, bool]]  # column, ascending


def greedy(pairs: DataFrame, group: list[str], left: str, right: str, order: Order) -> DataFrame:
    """The accepted rows of pairs. The order must decide every tie; nulls come last.

    Pairs stream through each task sorted by group and order, so that small groups cost no call each, and a large one no
    more memory than the sides it has taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used_left, used_right = None, set(), set()
        for batch in batches:
            kept = []
            for key, a, b in zip(zip(*(batch[c].to_pylist() for c in group), strict=True), batch[left].to_pylist(), batch[right].to_pylist(), strict=True):
                if key != now:
                    now, used_left, used_right = key, set(), set()
                free = a not in used_left and b not in used_right
                if free:
                    used_left.add(a)
                    used_right.add(b)
                kept.append(free)
            yield batch.filter(pa.array(kept, pa.bool_()))

    by = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    return pairs.repartition(*group).sortWithinPartitions(*group, *by).mapInArrow(run, pairs.schema)


def greedy_between(left: DataFrame, right: DataFrame, group: list[str], score: Column) -> DataFrame:
    """What greedy() accepts of all pairs of a group's two sides by score (the highest first, null last), left and right, without making the pairs: group, l, r, score.

    left: group, l, l_class; right: group, r, r_class. An id has one class, and the classes alone decide the score, an
    expression of l_class and r_class. Classes are paired instead; of those that meet at a score, the least left id takes
    the least right id that is free, and so on. Rows without an id take no part. A task holds the ids of one group.
    """
    classes = left.filter("l is not null").select(*group, "l_class").distinct().join(right.filter("r is not null").select(*group, "r_class").distinct(), group)
    met = classes.select(*group, "l_class", "r_class", score.alias("score"))
    sides = left.filter("l is not null").select(*group, "l_class", "l", F.lit(0).alias("side")).unionByName(right.filter("r is not null").select(*group, "r_class", "r", F.lit(1).alias("side")), allowMissingColumns=True)
    rows = sides.unionByName(met.withColumn("side", F.lit(2)), allowMissingColumns=True)
    columns = [*group, "side", "l_class", "l", "r_class", "r", "score"]
    schema = StructType([rows.schema[c] for c in (*group, "l", "r", "score")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, level, pairs, lefts, rights = None, None, [], {}, {}

        def settled() -> list[tuple]:
            """What is accepted of the pairs of classes at one score."""
            near: dict = {}
            for a, b in pairs:
                if lefts.get(a) and rights.get(b):
                    near.setdefault(a, []).append(b)
            heads, out = [(lefts[a][0], n, a) for n, a in enumerate(near)], []
            heapify(heads)
            while heads:
                _, n, a = heappop(heads)
                near[a] = [b for b in near[a] if rights[b]]
                if near[a]:
                    b = min(near[a], key=lambda b: rights[b][0])
                    out.append((*now, lefts[a].popleft(), rights[b].popleft(), level))
                    if lefts[a]:
                        heappush(heads, (lefts[a][0], n, a))
            return out

        for batch in batches:
            out = []
            for *key, side, l_class, l, r_class, r, value in zip(*(batch[c].to_pylist() for c in columns), strict=True):  # noqa: E741
                if key != now or side == 2 and value != level:
                    out += settled()
                    level, pairs = value, []
                if key != now:
                    now, lefts, rights = key, {}, {}
                if side == 2:
                    pairs.append((l_class, r_class))
                    continue
                ids = lefts.setdefault(l_class, deque()) if side == 0 else rights.setdefault(r_class, deque())
                if not ids or ids[-1] != (l if side == 0 else r):
                    ids.append(l if side == 0 else r)
            yield from tables(out)
        yield from tables(settled())

    def tables(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return rows.repartition(*group).sortWithinPartitions(*group, "side", "l", "r", F.col("score").desc_nulls_last()).select(*columns).mapInArrow(run, schema)


def by_rounds(pairs: DataFrame, group: list[str], left: str, right: str, order: Order) -> DataFrame:
    """The same rows as greedy(), by mutual firsts; each round is kept in the checkpoint folder."""
    by = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    rest, taken = checkpointed(pairs), None
    while not rest.isEmpty():
        place = lambda side: F.row_number().over(Window.partitionBy(*group, side).orderBy(*by))
        ranked = rest.withColumn("__l", place(left)).withColumn("__r", place(right))
        mutual = checkpointed(ranked.filter("__l = 1 and __r = 1").drop("__l", "__r"))
        taken = mutual if taken is None else taken.unionByName(mutual)
        rest = checkpointed(rest.join(mutual.select(*group, left), [*group, left], "left_anti").join(mutual.select(*group, right), [*group, right], "left_anti"))
    return taken if taken is not None else pairs.limit(0)


def expected_kind(kind: str = "expected_kind", rule_type: str = "rule_type"):
    return F.when((F.coalesce(F.col(kind), F.lit("")) == "checkbox_group") | (F.upper(F.coalesce(F.col(rule_type), F.lit(""))) == "CHECKBOX"), "checkbox_group").otherwise("text")


def kinds_compatible(rule_kind, field_kind):
    """Text rules take text and composite fields, checkbox rules checkbox groups; an unknown kind fits all."""
    known = F.coalesce(field_kind, F.lit(""))
    return (known == "") | F.when(rule_kind == "checkbox_group", known == "checkbox_group").otherwise(known.isin("text", "composite"))


R_TRAITS, F_TRAITS = ["r_section", "r_subsection", "r_kind"], ["f_kind", "f_section", "f_subsection", "hollow"]


def _labels_and_targets(rules: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each label a of a rule, and for each text b of a field, with what else counts for their score."""
    labels = F.filter(F.array(clean("item"), clean("label_printed")), lambda x: F.length(x) >= 3)
    r = rules.filter("rule_type <> 'NO_PRINT_RULE'").select("doc_id", "rule_id", "rule_ord", F.explode(labels).alias("label"), norm("section").alias("r_section"), norm("subsection").alias("r_subsection"), expected_kind().alias("r_kind")).withColumn("a", F.upper("label")).drop("label")
    target = F.array(F.struct(clean("key").alias("t"), F.lit(False).alias("of_value")), F.when(F.col("kind") == "composite", F.struct(clean("value").alias("t"), F.lit(True).alias("of_value"))))
    f = fields.select("doc_id", "field_ord", F.coalesce("kind", F.lit("")).alias("f_kind"), norm("section").alias("f_section"), norm("subsection").alias("f_subsection"), is_placeholder("value").alias("hollow"), F.explode(F.filter(target, lambda x: x.isNotNull())).alias("x"))
    return r, f.select("*", F.upper("x.t").alias("b"), "x.of_value").drop("x").filter("b <> ''")


def _raw_scores(pairs: DataFrame) -> DataFrame:
    return with_scores(pairs, "a", "b", "raw", known=F.when(contains_either(F.col("a"), F.col("b")), 100.0))


def _best_label() -> Column:
    return F.max(F.when(F.col("of_value"), F.least(F.col("raw"), F.lit(VALUE_CAP)) - VALUE_DISCOUNT).otherwise(F.col("raw"))).alias("label_score")


def _whole_score(r: str = "", f: str = "") -> Column:
    """label_score with what kinds, sections and a hollow value add to it. r and f: prefixes of the traits' names."""

    def agreement(name: str, bonus: float, penalty: float):
        a, b = F.col(f"{r}r_{name}"), F.col(f"{f}f_{name}")
        return F.when((a == "") | (b == ""), 0.0).when(contains_either(a, b), bonus).otherwise(penalty)

    return (
        F.col("label_score")
        + F.when(kinds_compatible(F.col(f"{r}r_kind"), F.col(f"{f}f_kind")), 0.0).otherwise(KIND_PENALTY)
        + agreement("section", SECTION_BONUS, SECTION_PENALTY)
        + agreement("subsection", SUBSECTION_BONUS, SUBSECTION_PENALTY)
        + F.when(F.col(f"{f}hollow"), PLACEHOLDER_PENALTY).otherwise(0.0)
    ).alias("score")


def candidates(rules: DataFrame, fields: DataFrame) -> DataFrame:
    """Scores every rule of a document's sheet against the document's fields: doc_id, rule_id, rule_ord, field_ord, score.

    rules carry doc_id or are joined by it beforehand; both sides meet on doc_id, so documents of any number are spread
    by key. Labels that hold one another score 100 without the metric; the metric runs once for each distinct other pair.
    Every pair of a document is made, which for a form is few; expanded(candidate_classes()) gives the same for documents
    of many rules and fields.
    """
    r, f = _labels_and_targets(rules, fields)
    keys = ["doc_id", "rule_id", "rule_ord", "field_ord", *R_TRAITS, *F_TRAITS]
    best = _raw_scores(r.join(f, "doc_id")).groupBy(*keys).agg(_best_label()).filter(F.col("label_score") >= LABEL_FLOOR)
    return best.select("doc_id", "rule_id", "rule_ord", "field_ord", _whole_score())


#: Members of a class in one row, at most.
CLASS_ROWS = 1000


def _alike(rows: DataFrame, own: list[str], traits: list[str], text: Column, name: str) -> DataFrame:
    """A row for all rows of a document that share traits and texts: doc_id, the traits, <name>_texts, <name>_class (which tells classes of a document apart), <name>_members (structs of own)."""
    each = rows.groupBy("doc_id", *own, *traits).agg(F.sort_array(F.collect_set(text)).alias(f"{name}_texts"))
    classes = each.groupBy("doc_id", *traits, f"{name}_texts").agg(F.min(F.struct(*own)).alias("__least"), F.collect_list(F.struct(*own)).alias(f"{name}_members"))
    return classes.withColumn(f"{name}_class", F.struct("__least", *traits)).drop("__least")


def _members(classes: DataFrame, name: str) -> DataFrame:
    """The members of each class, CLASS_ROWS to a row."""
    m = F.col(f"{name}_members")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / CLASS_ROWS).cast("int")), lambda i: F.slice(m, i * CLASS_ROWS + 1, F.lit(CLASS_ROWS)))
    return classes.select("doc_id", f"{name}_class", F.explode(pieces).alias(f"{name}_members"))


def candidate_classes(rules: DataFrame, fields: DataFrame) -> DataFrame:
    """What candidates() gives, before rules and fields that are alike are told apart: doc_id, score, r_members (rule_id, rule_ord) and f_members (field_ord), each of which makes a pair with each.

    Texts are compared once for each distinct pair, and classes of rules with classes of fields, so that only the pairs
    asked for grow with the square of a document.
    """
    r, f = _labels_and_targets(rules, fields)
    rc, fc = _alike(r, ["rule_id", "rule_ord"], R_TRAITS, F.col("a"), "r"), _alike(f, ["field_ord"], F_TRAITS, F.struct("b", "of_value"), "f")
    near = _raw_scores(r.select("doc_id", "a").distinct().join(f.select("doc_id", "b").distinct(), "doc_id")).filter(F.col("raw") >= LABEL_FLOOR)
    left = rc.select("doc_id", "r_class", F.explode("r_texts").alias("a"))
    right = fc.select("doc_id", "f_class", F.explode("f_texts").alias("x")).select("doc_id", "f_class", "x.*")
    best = left.join(near, ["doc_id", "a"]).join(right, ["doc_id", "b"]).groupBy("doc_id", "r_class", "f_class").agg(_best_label()).filter(F.col("label_score") >= LABEL_FLOOR)
    # a given number of partitions, since these few rows become many
    spread = best.select("doc_id", "r_class", "f_class", _whole_score("r_class.", "f_class.")).repartition(4 * rules.sparkSession.sparkContext.defaultParallelism, "doc_id", "r_class", "f_class")
    return spread.join(_members(rc, "r"), ["doc_id", "r_class"]).join(_members(fc, "f"), ["doc_id", "f_class"]).select("doc_id", "score", "r_members", "f_members")


def expanded(classes: DataFrame) -> DataFrame:
    """The pairs of candidate_classes(): doc_id, rule_id, rule_ord, field_ord, score."""
    by_rule = classes.select("doc_id", F.explode("r_members").alias("r"), "f_members", "score")
    return by_rule.select("doc_id", "r", F.explode("f_members").alias("f"), "score").select("doc_id", "r.*", "f.field_ord", "score")


def part_score(part: str, key: str) -> float:
    p, k = " ".join(part.split()).upper(), " ".join(key.split()).upper()
    if not k:
        return 0.0
    if p == k:
        return 100.0
    return 96.0 if p and (p in k or k in p) else token_set(p, k)


def siblings(anchor: dict, parts: list[str], fields: list[dict], used: set[int]) -> list[dict]:
    """The fields that print one rule's parts, from left to right: the anchor, and for each part its best short field on the anchor's line."""

    def middle(f: dict) -> float | None:
        return None if f["bbox"] is None else (f["bbox"]["y0"] + f["bbox"]["y1"]) / 2

    def is_part(f: dict) -> bool:
        return sum(part_score(p, f["key"]) >= PART_FLOOR for p in parts) == 1 and len(f["key"].split()) <= 4

    y = middle(anchor)
    free = [
        f for f in fields
        if y is not None and f["field_ord"] != anchor["field_ord"] and f["field_ord"] not in used and f["kind"] != "checkbox_group" and f["page"] == anchor["page"] and middle(f) is not None and abs(middle(f) - y) <= PART_LINE and is_part(f)
    ]
    group = [anchor]
    for part in parts:
        ranked = sorted(((part_score(part, f["key"]), -n, f) for n, f in enumerate(free) if f not in group), key=lambda x: x[:2], reverse=True)
        if ranked and ranked[0][0] > PART_FLOOR:
            group.append(ranked[0][2])
    return sorted(group, key=lambda f: f["bbox"]["x0"] if f["bbox"] is not None else 0.0)


def merge(group: list[dict], parts: list[str], separators: list[str], item: str | None) -> dict:
    """One field out of several: values joined by the rule's separators, the rule's item as key, and whether the parts are complete."""
    tidy = lambda s: " ".join((s or "").split())
    head = group[0]
    shown = [{"key": f["key"], "value": tidy(f["value"])} for f in group]
    if len(group) == 1:
        exact = bool(item) and tidy(head["key"]).upper() == tidy(item).upper()
        return {"key": head["key"], "value": head["value"], "parts": shown, "members": [head["field_ord"]], "expected_parts": list(parts), "detected_parts": [head["key"]], "complete": exact or len(parts) <= 1, "source": "ATOMIC_COMPLETE_LABEL" if exact and parts else None, "anchor_key": None}
    text = ""
    for k, part in enumerate(shown):
        if part["value"]:
            text += ((separators[k] if k < len(separators) and separators[k] else " ") if text else "") + part["value"]
    expected = [t for t in map(tidy, parts) if t]
    return {
        "key": tidy(item) or head["key"], "value": text, "parts": shown, "members": [f["field_ord"] for f in group], "expected_parts": expected, "detected_parts": [tidy(p["key"]) for p in shown if tidy(p["key"])], "complete": len(group) >= min(2, len(expected)),
        "source": "WORKBOOK_PARTS_AND_SAME_LINE_GEOMETRY" if item else None, "anchor_key": head["key"] if item else None,
    }


BOUND = "doc_id string, rule_id string, field_ord int, match_score double, key string, value string, parts array<struct<key:string,value:string>>, members array<int>, expected_parts array<string>, detected_parts array<string>, complete boolean, source string, anchor_key string"


def assign(rules: DataFrame, fields: DataFrame, pairs: DataFrame | None = None, floor: float = ACCEPT_FLOOR) -> DataFrame:
    """Binds each rule to at most one field, and a rule of several parts also to the fields of its parts (BOUND).

    Best scores first over a whole document; then the lesser rule id, then the earlier field. Accepting a rule of several
    parts takes its siblings away from the others, so a document's pairs are walked in order, one document in a task.
    """
    pairs = (candidates(rules, fields) if pairs is None else pairs).filter(F.col("score") >= floor)
    by_doc = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("rule_id", "field_ord", "score")).alias("pairs"))
    r = rules.groupBy("doc_id").agg(F.collect_list(F.struct("rule_id", "item", "part_labels", "part_separators")).alias("rules"))
    f = fields.groupBy("doc_id").agg(F.collect_list(F.struct("field_ord", "page", "kind", F.coalesce(clean("key"), F.lit("")).alias("key"), F.col("value"), "bbox")).alias("fields"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, ps, rs, fs in zip(batch["doc_id"], batch["pairs"], batch["rules"], batch["fields"], strict=True):
                rule = {x["rule_id"]: x for x in rs}
                all_ = sorted(fs, key=lambda x: x["field_ord"])
                field = {x["field_ord"]: x for x in all_}
                used: set[int] = set()
                bound: set[str] = set()
                for p in sorted(ps, key=lambda x: (-x["score"], x["rule_id"], x["field_ord"])):
                    if p["rule_id"] in bound or p["field_ord"] in used:
                        continue
                    x = rule[p["rule_id"]]
                    parts = list(x["part_labels"]) if x["part_labels"] is not None else []
                    separators = list(x["part_separators"]) if x["part_separators"] is not None else []
                    anchor = field[p["field_ord"]]
                    m = merge(siblings(anchor, parts, all_, used) if parts else [anchor], parts, separators, x["item"])
                    bound.add(p["rule_id"])
                    used.update(m["members"])
                    out.append({"doc_id": doc, "rule_id": p["rule_id"], "field_ord": p["field_ord"], "match_score": round(p["score"], 2), **m})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BOUND.split(", ")])

    return by_doc.join(r, "doc_id").join(f, "doc_id").mapInPandas(walk, BOUND)


def unused_fields(fields: DataFrame, bound: DataFrame) -> DataFrame:
    taken = bound.select("doc_id", F.explode("members").alias("field_ord"))
    return fields.join(taken, ["doc_id", "field_ord"], "left_anti")


def reading_order(fields: DataFrame) -> DataFrame:
    """Adds order_index: from 0, by page, top and left edge of the label, then the field's own order."""
    box = F.coalesce("label_bbox", "bbox")
    at = Window.partitionBy("doc_id").orderBy("page", F.coalesce(box["y0"], F.lit(0.0)), F.coalesce(box["x0"], F.lit(0.0)), "field_ord")
    return fields.withColumn("order_index", F.row_number().over(at) - 1)


def sequence_match(rules: DataFrame, fields: DataFrame) -> DataFrame:
    """A second opinion that also weighs the order of rules and fields: doc_id, rule_id, field_ord, score, state (MATCHED or REVIEW_REQUIRED).

    Rules that print nothing or have no item are left out before they are counted; documents without fields have no states.
    """
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("rule_ord")) - 1
    r = rules.filter("rule_type <> 'NO_PRINT_RULE' and coalesce(item, '') <> ''").select("doc_id", "rule_id", "rule_ord", norm("item").alias("a"), norm("section").alias("rs"), order.alias("r_at"))
    f = reading_order(fields).select("doc_id", "field_ord", norm("key").alias("b"), norm("section").alias("fs"), "order_index")
    scored = with_scores(r.join(f, "doc_id"), "a", "b", "label", known=F.when((F.col("a") == F.col("b")) & (F.col("a") != ""), 100.0))
    label, section, near = SEQUENCE_WEIGHTS
    total = label * F.col("label") / 100 + section * F.when((F.col("rs") == "") | (F.col("rs") == F.col("fs")), 1).otherwise(0) + near * F.greatest(F.lit(0.0), 1 - F.abs(F.col("r_at") - F.col("order_index")) / SEQUENCE_SPAN)
    pairs = scored.select("doc_id", "rule_id", "rule_ord", "field_ord", "order_index", total.alias("score"))
    best = greedy(pairs, ["doc_id"], "rule_id", "field_ord", [("score", False), ("rule_ord", True), ("order_index", True)])
    joined = r.select("doc_id", "rule_id").join(f.select("doc_id").distinct(), "doc_id", "left_semi").join(best.select("doc_id", "rule_id", "field_ord", F.round("score", 4).alias("score")), ["doc_id", "rule_id"], "left")
    return joined.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("state", F.when(F.col("score") >= SEQUENCE_FLOOR, "MATCHED").otherwise("REVIEW_REQUIRED"))


def in_order(pairs: DataFrame, floor: float = ACCEPT_FLOOR) -> DataFrame:
    """The older way: rule after rule takes its best field that is still free. pairs: doc_id, rule_id, rule_ord, field_ord, score."""
    good = pairs.filter(F.col("score") >= floor)
    return greedy(good, ["doc_id"], "rule_id", "field_ord", [("rule_ord", True), ("score", False), ("field_ord", True)])


KEY_FLOOR, USED_PENALTY = 78.0, 40.0


def key_matches(labels: DataFrame, kv_pairs: DataFrame) -> DataFrame:
    """Rule after rule takes the raw pair whose key fits its labels best: doc_id, rule_id, kv_ord, score. A pair that was taken before may be taken again, at a discount.

    labels: doc_id, rule_id, rule_ord, labels (texts), party (A, B or null), rule_type. Of keys that recur, the first half
    counts as party A's. Values that look like what the rule prints gain, placeholders and long keys lose.
    """
    occurrence = Window.partitionBy("doc_id", "k")
    kv = kv_pairs.select("doc_id", "kv_ord", F.upper(clean("key")).alias("k"), clean("value").alias("v")).withColumn("of", F.count("*").over(occurrence)).withColumn("nth", F.row_number().over(occurrence.orderBy("kv_ord")) - 1)
    each = labels.select("doc_id", "rule_id", "rule_ord", "party", "rule_type", F.explode(F.filter(F.transform("labels", lambda x: F.upper(clean(x))), lambda x: F.length(x) >= 3)).alias("l"))
    pairs = each.join(kv, "doc_id").filter("k <> ''")
    scored = with_scores(pairs, "l", "k", "raw", known=F.when(contains_either(F.col("l"), F.col("k")), 100.0))
    best = scored.groupBy("doc_id", "rule_id", "rule_ord", "party", "rule_type", "kv_ord", "k", "v", "of", "nth").agg(F.max("raw").alias("raw")).filter(F.col("raw") >= KEY_FLOOR)
    first_half = F.col("nth") < F.col("of") / 2
    party = F.when(F.col("party").isNull() | (F.col("of") < 2), 0.0).when((F.col("party") == "A") == first_half, 10.0).otherwise(-10.0)
    dated = F.upper("v").rlike(r"\d{4}|\d{1,2}/\d{1,2}|" + "|".join(MONTHS))
    plausible = F.when(F.col("rule_type") == "CHECKBOX", F.when(F.contains(F.lower("v"), F.lit("selected")), 15.0).otherwise(-6.0)).when(F.col("rule_type") == "DATE_FORMAT", F.when(dated, 15.0).otherwise(-4.0)).otherwise(0.0)
    score = F.col("raw") + party + plausible - F.when(is_placeholder("v"), 6.0).otherwise(0.0) - 0.01 * F.length("k")
    out = best.select("doc_id", "rule_id", "rule_ord", "kv_ord", score.alias("score"))

    def run(rows: list[dict]) -> list[dict]:
        used, kept = set(), []
        for _, mine in groupby(rows, key=lambda x: x["rule_ord"]):
            best = max(({**x, "score": x["score"] - (USED_PENALTY if x["kv_ord"] in used else 0.0)} for x in mine), key=lambda x: (x["score"], -x["kv_ord"]))
            used.add(best["kv_ord"])
            kept.append(best)
        return kept

    return by_group(out, ["doc_id"], ["rule_ord", "kv_ord"], run, out.schema).select("doc_id", "rule_id", "kv_ord", "score")
