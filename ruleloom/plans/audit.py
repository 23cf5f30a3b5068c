"""The whole audit: rules against structured fields, from matching to reviewer outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, norm
from ..functions.values import checkbox_options, field_value, is_placeholder
from ..operators import checkboxes, checks, guard, outcome
from ..operators.assign import assign, candidates, sequence_match, unused_fields
from ..operators.providers import Provider, instruction_verdicts
from ..operators.rules import normalize_rules
from ..schemas import CHECK
from ..session import checkpointed


def rules_of_documents(rules: DataFrame, documents: DataFrame) -> DataFrame:
    """The rules of each document's sheet, normalised once for the sheet."""
    return documents.select("doc_id", "sheet").join(normalize_rules(rules, ["sheet"]), "sheet")


def flat_fields(fields: DataFrame) -> DataFrame:
    """Fields with their value as text, in the column value."""
    return fields.withColumn("value", field_value("value_text", "value_parts"))


def _options_check(rows: DataFrame, kv_pairs: DataFrame | None) -> DataFrame:
    """Adds options_check: named options against the boxes beside the label, or the group's own where there are none; without named options the boxes on the row."""
    named = (F.col("expected_kind") == "checkbox_group") & (F.size("expected_options") > 0)
    group = rows.filter("kind = 'checkbox_group'").withColumn("anchor", F.coalesce("label_bbox", "bbox"))
    anchors = group.select("doc_id", "rule_id", "page", F.col("anchor").alias("label_bbox"), F.col("expected_options").alias("options"), named.alias("named"))
    empty = rows.sparkSession.createDataFrame([], "doc_id string, rule_id string")
    if kv_pairs is None:
        near = empty.withColumn("found", F.lit(None).cast(checkboxes.OPTIONS))
        on_row = empty.withColumn("boxes", F.lit(None).cast("array<struct<dx:double,kv_ord:int,label:string,state:string>>"))
    else:
        near = checkboxes.regroup(anchors.filter("named"), kv_pairs, ["rule_id"]).select("doc_id", "rule_id", "found")
        on_row = checkboxes.boxes_on_row(anchors.filter("not named"), kv_pairs, ["rule_id"])
    joined = rows.join(near, ["doc_id", "rule_id"], "left").join(on_row, ["doc_id", "rule_id"], "left")
    held = F.when(F.col("found").isNotNull(), F.transform("found", lambda o: F.struct(o["label"].alias("label"), o["state"].alias("state")))).otherwise(checkbox_options("value"))
    aligned = joined.withColumn("aligned", checkboxes.aligned_options(F.col("expected_options"), held))
    is_group = F.coalesce("kind", F.lit("")) == "checkbox_group"
    position = checkboxes.position_check(F.col("value"), F.col("boxes")) if kv_pairs is not None else F.lit(None).cast(CHECK)
    check = F.when(is_group & named, checkboxes.alignment_check(F.col("expected_options"), F.col("aligned")).cast(CHECK)).when(is_group, position.cast(CHECK))
    return aligned.withColumn("options_check", check).drop("found", "boxes", "aligned")


def compare(rules: DataFrame, fields: DataFrame, kv_pairs: DataFrame | None = None, model: Provider | None = None, shape_without_model: bool = False) -> DataFrame:
    """One row for each rule, then one for each printed field without a rule: the comparison before any guard.

    rules: RULES with doc_id, normalised; fields: FIELDS with value (and payload_ok if boxes were repaired).
    """
    fields = fields if "payload_ok" in fields.columns else fields.withColumn("payload_ok", F.lit(None).cast("boolean"))
    bound = checkpointed(assign(rules, fields, candidates(rules, fields)))
    sources = fields.select("doc_id", "field_ord", "page", "kind", F.col("section").alias("f_section"), F.col("subsection").alias("f_subsection"), "bbox", "label_bbox", "confidence", "payload_ok")
    rows = rules.join(bound, ["doc_id", "rule_id"], "left").join(sources, ["doc_id", "field_ord"], "left")
    rows = _options_check(rows, kv_pairs)
    verdicts = instruction_verdicts(rows.filter("field_ord is not null"), model)
    rows = rows.join(verdicts, ["doc_id", "rule_id"], "left")
    found, c = F.col("field_ord").isNotNull(), F.col
    presence = checks.presence(found, c("value"))
    all_ = checks.gathered(
        presence, c("options_check"), checks.part_gaps(c("parts")), checks.date_pattern(c("instruction"), c("example"), c("item"), c("value")), checks.max_chars(c("max_chars"), c("value")),
        checks.instruction(c("kind"), c("instruction"), c("if_unknown"), c("value"), c("example"), c("verdict"), c("reason"), shape_without_model),
    )
    silent = checks.check("no_print_rule", "NOT_VALIDATED", "no printing instructions", "skipped", "There is nothing to print.").cast(CHECK)
    nothing = c("rule_type") == "NO_PRINT_RULE"
    rows = rows.withColumn("checks", F.when(nothing, F.array(silent)).otherwise(all_)).withColumn("status", F.when(nothing, "NOT_VALIDATED").otherwise(checks.rollup(c("checks"))))
    conflict = (norm("subsection") != "") & (norm("f_subsection") != "") & (norm("subsection") != norm("f_subsection"))
    mode = F.when(F.contains(norm("instruction"), F.lit("DROPDOWN VALUE SELECTED")) & (F.coalesce(F.size("expected_options"), F.lit(0)) == 0), "FORMAT_EXAMPLE_ONLY").otherwise("STANDARD")
    of_rules = rows.select(
        "doc_id", c("rule_ord").alias("row_ord"), F.format_string("CMP-%04d", "rule_ord").alias("id"), "status", "sheet", "rule_id", "rule_type", "section", "subsection", "item", found.alias("matched"), F.coalesce("match_score", F.lit(0.0)).alias("match_score"),
        c("kind").alias("di_kind"), c("f_section").alias("di_section"), c("f_subsection").alias("di_subsection"), c("key").alias("di_key"), c("value").alias("di_value"), "page", F.coalesce("label_bbox", "bbox").alias("bbox"), "confidence", "checks", checks.messages(c("checks")).alias("message"),
        "instruction", "if_unknown", "expected_parts", "detected_parts", "complete", "payload_ok", F.when(found, conflict).alias("subsection_conflict"), F.when(found, mode).alias("instruction_mode"), c("anchor_key").alias("observed_key"), "source",
    )
    return of_rules.unionByName(extra_rows(rules, fields, bound), allowMissingColumns=True)


def extra_rows(rules: DataFrame, fields: DataFrame, bound: DataFrame) -> DataFrame:
    """Printed fields that no rule took and that are not boilerplate, numbered on after the document's rules."""
    left = unused_fields(fields, bound).join(checks.boilerplate(fields, rules), ["doc_id", "field_ord"], "left_anti")
    counts = rules.groupBy("doc_id", "sheet").agg(F.count("*").alias("n_rules"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("field_ord"))
    numbered = left.join(counts, "doc_id").withColumn("row_ord", F.col("n_rules").cast("int") + at)
    value: Column = F.coalesce("value", F.lit(""))
    note = F.when(clean("value") == "", "A field without a rule, and without a value.").when(is_placeholder("value"), "A field without a rule, with a placeholder.").otherwise("A printed value without a rule.")
    check = checks.check("unmatched_field", "NOT_VALIDATED", "a rule for this field", F.coalesce(F.nullif(value, F.lit("")), F.lit("(blank)")), note).cast(CHECK)
    return numbered.select(
        "doc_id", "row_ord", F.format_string("CMP-%04d", "row_ord").alias("id"), F.lit("NOT_VALIDATED").alias("status"), "sheet", F.lit("").alias("rule_id"), F.lit("UNMATCHED_FIELD").alias("rule_type"), F.coalesce(F.nullif(F.col("key"), F.lit("")), value).alias("item"), F.lit(False).alias("matched"), F.lit(0.0).alias("match_score"),
        F.col("kind").alias("di_kind"), F.col("section").alias("di_section"), F.col("subsection").alias("di_subsection"), F.col("key").alias("di_key"), value.alias("di_value"), "page", F.coalesce("label_bbox", "bbox").alias("bbox"), "confidence", F.array(check).alias("checks"), note.alias("message"),
    )


def audit(rules: DataFrame, fields: DataFrame, documents: DataFrame, kv_pairs: DataFrame | None = None, model: Provider | None = None) -> DataFrame:
    """From typed rules and structured fields to reviewer outcomes: repair, compare, weigh the order, recover static text, guard, decide.

    Most steps read their input several times, so what they share is kept once in the checkpoint folder.
    """
    r = checkpointed(rules_of_documents(rules, documents))
    if kv_pairs is not None:
        kv_pairs, fields = checkpointed(kv_pairs), checkpointed(fields)
        fields = checkboxes.repair(r, fields, kv_pairs)
    f = checkpointed(flat_fields(fields))
    rows = checkpointed(compare(r, f, kv_pairs, model))
    order = sequence_match(r, f).select("doc_id", "rule_id", F.col("state").alias("sequence_state"), F.col("score").alias("sequence_score"))
    recovered = checkpointed(outcome.recover_static(rows.join(order, ["doc_id", "rule_id"], "left"), documents))
    return outcome.reviewed(checkpointed(guard.shared_boxes(guard.reject_unsafe(recovered))))


def coverage(rows: DataFrame) -> DataFrame:
    """Both directions for each document: rules, matched rules, rules without a field, fields without a rule."""
    rule = ~F.col("rule_type").isin("UNMATCHED_FIELD")
    return rows.groupBy("doc_id").agg(
        F.count_if(rule).alias("n_rules"), F.count_if(rule & F.col("matched")).alias("n_matched"), F.count_if(rule & ~F.col("matched") & (F.col("rule_type") != "NO_PRINT_RULE")).alias("n_rules_without_field"), F.count_if(~rule).alias("n_fields_without_rule")
    )
