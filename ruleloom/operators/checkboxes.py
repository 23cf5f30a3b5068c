"""Checkbox options rebuilt from where the boxes are printed, and set against the options that a rule names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import token_set, token_sort
from ..functions.geometry import center_x, center_y
from ..functions.text import clean, norm
from ..functions.values import checkbox_labels, checkbox_options
from ..lookups import BOX_LABEL_FLOOR, BOX_LEFT, BOX_MOST, BOX_RIGHT, BOX_ROW, OPTION_FLOOR, SELECTED_WORDS, WRAPPER_WORDS

OPTIONS = "array<struct<option:string,label:string,state:string,score:double>>"


def is_checkbox(value: Column) -> Column:
    v = F.lower(F.coalesce(value, F.lit("")))
    return F.contains(v, F.lit(":select")) | F.contains(v, F.lit(":unselect"))


def state_of(value: Column) -> Column:
    v = F.lower(F.coalesce(value, F.lit("")))
    return F.when(F.contains(v, F.lit("select")) & ~F.contains(v, F.lit("unselect")), "selected").otherwise("unselected")


def row_tolerance(n_options: Column) -> Column:
    """The height of the band that a list of options may fill: one row more for every three."""
    return F.lit(BOX_ROW) * (1 + F.greatest(F.floor((n_options - 1) / 3), F.lit(0)))


def _near(anchors: DataFrame, kv_pairs: DataFrame, tolerance: Column) -> DataFrame:
    """anchors (doc_id, page, label_bbox, ...) with the checkboxes beside them: dx from the label's left edge, dy from its middle."""
    boxes = kv_pairs.filter(is_checkbox(F.col("value")) & F.col("bbox").isNotNull()).select("doc_id", "page", "kv_ord", clean("key").alias("box_label"), state_of(F.col("value")).alias("box_state"), center_x("bbox").alias("bx"), center_y("bbox").alias("by"))
    met = anchors.join(boxes, ["doc_id", "page"]).withColumn("dx", F.col("bx") - F.col("label_bbox.x0")).withColumn("dy", F.abs(F.col("by") - center_y("label_bbox")))
    return met.filter((F.col("dy") <= tolerance) & F.col("dx").between(-BOX_LEFT, BOX_RIGHT))


def option_score(option: str, label: str) -> float:
    a, b = (" ".join((t or "").split()).upper() for t in (option, label))
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    return 95.0 if len(a) >= 4 and len(b) >= 4 and (a in b or b in a) else token_sort(a, b)


def resolve_options(options: list[str], boxes: list[dict]) -> list[dict]:
    """Gives each option, in turn, the free box with the best label, then the nearest by height, by side and by order."""
    free, found = sorted(boxes, key=lambda b: b["kv_ord"]), []
    for option in options:
        ranked = [((-s, b["dy"], b["dx"], b["kv_ord"]), b) for b in free if (s := option_score(option, b["label"])) >= BOX_LABEL_FLOOR]
        if ranked:
            rank, box = min(ranked, key=lambda x: x[0])
            free.remove(box)
            found.append({"option": option, "label": box["label"] or option, "state": box["state"], "score": round(-rank[0], 1)})
    return found


def regroup(anchors: DataFrame, kv_pairs: DataFrame, key: list[str]) -> DataFrame:
    """Adds to key the options found beside each anchor, how many, of how many, and their share; anchors without any are left out. anchors: doc_id, page, label_bbox, options, and key."""
    wanted = anchors.withColumn("options", F.filter("options", lambda o: clean(o) != "")).filter((F.size("options") > 0) & F.col("label_bbox").isNotNull())
    near = _near(wanted, kv_pairs, row_tolerance(F.size("options")))
    boxes = near.groupBy("doc_id", *key, "options").agg(F.collect_list(F.struct("kv_ord", F.col("box_label").alias("label"), F.col("box_state").alias("state"), F.abs("dx").alias("dx"), "dy")).alias("boxes"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for options, held in batches:
            yield pd.Series([resolve_options(list(o), list(b)) for o, b in zip(options, held, strict=True)])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    found = boxes.withColumn("found", F.pandas_udf(run, OPTIONS)("options", "boxes")).filter(F.size("found") > 0)
    return found.select("doc_id", *key, "found", F.size("found").alias("matched"), F.size("options").alias("expected"), F.round(F.size("found") / F.size("options"), 3).alias("confidence"))


def boxes_on_row(anchors: DataFrame, kv_pairs: DataFrame, key: list[str], most: int = BOX_MOST) -> DataFrame:
    """All checkboxes on each anchor's own row, from left to right; anchors with none, or with more than most, are left out."""
    near = _near(anchors.filter("label_bbox is not null"), kv_pairs, F.lit(BOX_ROW)).filter("box_label <> ''")
    row = F.array_sort(F.collect_list(F.struct("dx", "kv_ord", F.col("box_label").alias("label"), F.col("box_state").alias("state"))))
    return near.groupBy("doc_id", *key).agg(row.alias("boxes")).filter(F.size("boxes") <= most)


def mark_summary(marks: DataFrame, keys: list[str], text: str) -> DataFrame:
    """How many selection marks there are, and how many speak of "selected". So does "unselected": the count is of marks with a state."""
    return marks.groupBy(*keys).agg(F.count("*").alias("total_selection_marks"), F.count_if(F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("selected"))).alias("selected_marks"))


def normalize_option(text: Column) -> Column:
    """An option written as "label-state", "label:state" or "label state", as (option, selected); without a state it is unselected."""
    t = F.trim(text)
    tail = F.lower(F.regexp_extract(t, r"(?is)[:\- ]((?:un)?selected)$", 1))
    label = F.when(tail != "", F.regexp_replace(t, r"(?i)[:\- ](?:un)?selected$", "")).otherwise(t)
    return F.struct(F.regexp_replace(label, r"^[ :\-]+|[ :\-]+$", "").alias("option"), (tail == "selected").alias("selected"))


def normalize_options(options: Column) -> Column:
    """An array of (option, state text) as (option, selected), without nameless ones."""
    tidy = lambda s: F.regexp_replace(F.lower(F.trim(F.coalesce(s, F.lit("")))), "^:+|:+$", "")
    named = F.transform(options, lambda o: F.struct(F.regexp_replace(F.coalesce(o["option"], F.lit("")), r"^[ :\-]+|[ :\-]+$", "").alias("option"), tidy(o["state"]).isin(*SELECTED_WORDS).alias("selected")))
    return F.filter(named, lambda o: o["option"] != "")


def payload_valid(value: Column) -> Column:
    """Whether no label of a serialised checkbox group is a word of a reconstruction's wrapper."""
    return ~F.exists(F.transform(checkbox_labels(value), norm), lambda x: F.lower(x).isin(*WRAPPER_WORDS))


def repair(rules: DataFrame, fields: DataFrame, kv_pairs: DataFrame) -> DataFrame:
    """Rewrites the options of checkbox fields from the boxes beside them: each rule with options, in rule order, takes the field that fits its label, options and section best, as earlier rules left it. A document is one task's work.

    rules: doc_id, rule_ord, item, section, expected_options. Returns fields with value_text, children and payload_ok.
    """
    child = fields.schema["children"].dataType.simpleString()
    r = rules.filter(F.size("expected_options") > 0).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule_ord", norm("item").alias("item"), norm("section").alias("section"), "expected_options"))).alias("r"))
    group = fields.filter("kind = 'checkbox_group'")
    f = group.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field_ord", "page", norm("key").alias("key"), norm("section").alias("section"), "value_text", F.coalesce("label_bbox", "bbox").alias("box")))).alias("f"))
    boxes = kv_pairs.filter(is_checkbox(F.col("value")) & F.col("bbox").isNotNull())
    k = boxes.groupBy("doc_id").agg(F.collect_list(F.struct("kv_ord", "page", clean("key").alias("label"), state_of(F.col("value")).alias("state"), center_x("bbox").alias("x"), center_y("bbox").alias("y"))).alias("k"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy = lambda s: " ".join((s or "").split())
        for batch in batches:
            out = []
            for doc, rs, fs, ks in zip(batch["doc_id"], batch["r"], batch["f"], batch["k"], strict=True):
                value = {x["field_ord"]: x["value_text"] for x in fs}
                changed: dict[int, list[dict]] = {}
                for rule in rs:
                    options = [t for t in map(tidy, rule["expected_options"]) if t]
                    names = {o.upper() for o in options}
                    if not options:
                        continue

                    def fit(x: dict, rule=rule, names=names) -> float:
                        now = {tidy(p.rpartition("-")[0] if "-" in p else p).upper() for p in (value[x["field_ord"]] or "").split(";") if p.strip()}
                        return token_set(rule["item"], x["key"]) + 35 * len(names & now) / max(1, len(names)) + (20 if not rule["section"] or rule["section"] == x["section"] else 0)

                    best = max(fs, key=lambda x: (fit(x), -x["field_ord"]))
                    box = best["box"]
                    if box is None or ks is None:
                        continue
                    tall = BOX_ROW * (1 + max(0, (len(options) - 1) // 3))
                    beside = [{**b, "dy": abs(b["y"] - (box["y0"] + box["y1"]) / 2), "dx": abs(b["x"] - box["x0"])} for b in ks if b["page"] == best["page"] and -BOX_LEFT <= b["x"] - box["x0"] <= BOX_RIGHT]
                    found = resolve_options(options, [b for b in beside if b["dy"] <= tall])
                    if found:
                        changed[best["field_ord"]] = found
                        value[best["field_ord"]] = ";".join(f"{o['label']}-{o['state']}" for o in found)
                out += [(doc, n, value[n], [{"label": o["label"], "value": None, "selected": o["state"] == "selected", "bbox": None} for o in found], not any(o["label"].lower() in WRAPPER_WORDS for o in found)) for n, found in changed.items()]
            yield pd.DataFrame(out, columns=["doc_id", "field_ord", "new_value", "new_children", "payload_ok"])

    schema = f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, field_ord int, new_value string, new_children {child}, payload_ok boolean"
    new = r.join(f, "doc_id").join(k, "doc_id", "left").mapInPandas(run, schema)
    joined = fields.join(new, ["doc_id", "field_ord"], "left")
    return joined.withColumn("value_text", F.coalesce("new_value", "value_text")).withColumn("children", F.coalesce("new_children", "children")).select(*fields.columns, "payload_ok")


def align(expected: list[str], held: list[dict]) -> list[tuple[str, str | None, str | None]]:
    """For each expected option the held option (label, state) whose label fits best, if well enough."""
    out = []
    for option in expected:
        a = (option or "").upper()
        scores = [100.0 if (b := h["label"].upper()) in a or a in b else token_set(b, a) for h in held]
        best = max(range(len(held)), key=lambda i: (scores[i], -i), default=None)
        fits = best is not None and scores[best] >= OPTION_FLOOR
        out.append((option, held[best]["label"] if fits else None, held[best]["state"] if fits else None))
    return out


def aligned_options(expected: Column, held: Column) -> Column:
    """align() for columns: array of (option, label, state)."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for e, h in batches:
            yield pd.Series([[dict(zip(("option", "label", "state"), x, strict=True)) for x in align(list(a), list(b))] if a is not None and b is not None else [] for a, b in zip(e, h, strict=True)])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<struct<option:string,label:string,state:string>>")(expected, held)


def alignment_check(expected: Column, aligned: Column) -> Column:
    """PASS if any expected option is selected, else MISSING_DATA; options that weren't found are only named."""
    selected = F.transform(F.filter(aligned, lambda a: a["state"] == "selected"), lambda a: a["option"])
    missing = F.transform(F.filter(aligned, lambda a: a["label"].isNull()), lambda a: a["option"])
    shown = F.transform(F.filter(aligned, lambda a: a["label"].isNotNull()), lambda a: F.format_string("%s=%s (%s)", a["option"], a["label"], a["state"]))
    message = F.concat_ws(" ", F.when(F.size(selected) > 0, F.concat(F.lit("Selected: "), F.array_join(selected, ", "), F.lit("."))).otherwise("Nothing is selected."), F.when(F.size(missing) > 0, F.concat(F.lit("Not found: "), F.array_join(missing, ", "), F.lit("."))))
    return F.struct(F.lit("checkbox_alignment").alias("name"), F.when(F.size(selected) > 0, "PASS").otherwise("MISSING_DATA").alias("status"), F.array_join(expected, ", ").alias("expected"), F.array_join(shown, "; ").alias("actual"), message.alias("message"))


def position_check(value: Column, boxes: Column) -> Column:
    """For rules that name no options: the boxes on the field's row against those the group claims. A difference, or a claim without boxes, is NOT_VALIDATED; else PASS if one is selected, MISSING_DATA if none; null if there is nothing to say."""
    claimed = F.array_sort(F.array_distinct(F.transform(checkbox_options(value), lambda o: norm(o["label"]))))
    row = F.array_sort(F.array_distinct(F.transform(boxes, lambda b: norm(b["label"]))))
    there = F.coalesce(F.size(boxes), F.lit(0)) > 0
    shown = F.array_join(F.transform(boxes, lambda b: F.format_string("%s (%s)", b["label"], b["state"])), ", ")

    def check(status: str, actual: Column, message: str) -> Column:
        return F.struct(F.lit("checkbox_position").alias("name"), F.lit(status).alias("status"), F.lit("boxes on the field's row, one of them selected").alias("expected"), actual.alias("actual"), F.lit(message).alias("message"))

    return (
        F.when(~there & (F.size(claimed) > 0), check("NOT_VALIDATED", F.array_join(claimed, ", "), "No boxes are printed on this field's row."))
        .when(there & (F.size(claimed) > 0) & (claimed != row), check("NOT_VALIDATED", shown, "The boxes on this row are not those of the field's group."))
        .when(there & F.exists(boxes, lambda b: b["state"] == "selected"), check("PASS", shown, "A box on the row is selected."))
        .when(there, check("MISSING_DATA", shown, "No box on the row is selected."))
    )
