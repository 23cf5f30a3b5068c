"""What a reviewer sees: PASS and FAIL only where the field's identity is sure, else REVIEW_REQUIRED."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import with_scores
from ..functions.text import dash_norm, norm
from ..lookups import LINE_PLACEHOLDERS, REVIEW_LABEL_FLOOR, REVIEW_MATCH_FLOOR


def is_technical() -> Column:
    return F.col("rule_type").isin("UNMATCHED_FIELD", "NO_PRINT_RULE") | (F.coalesce("rule_id", F.lit("")) == "")


def recover_static(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rules of static text without an instruction, unmatched, pass where their item stands in the document's text."""
    texts = documents.select("doc_id", norm("full_text").alias("__full"))
    static = F.col("rule_type").isin("STATIC_TEXT", "TEXT_OR_LAYOUT") & (norm("instruction") == "")
    item = norm("item")
    joined = rows.join(texts, "doc_id", "left").withColumn("recovered", ~F.col("matched") & static & (item != "") & F.coalesce(F.contains("__full", item), F.lit(False)))
    check = F.struct(*(v.cast("string").alias(n) for n, v in (("name", F.lit("static_text_presence")), ("status", F.lit("PASS")), ("expected", F.col("item")), ("actual", F.lit("found in the text")), ("message", F.lit("The text is printed.")))))
    values = {"status": F.lit("PASS"), "di_kind": F.lit("static_text"), "di_key": F.col("item"), "di_value": F.col("item"), "match_score": F.lit(100.0), "page": F.lit(1), "checks": F.array(check), "message": F.lit("The text is printed."), "matched": F.lit(True)}
    for c, v in values.items():
        joined = joined.withColumn(c, F.when(F.col("recovered"), v).otherwise(F.col(c)))
    return joined.drop("__full")


def safe_recovery() -> Column:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    same = (dash_norm("item") == dash_norm("di_value")) & (dash_norm("item") == dash_norm("di_key"))
    static = (F.col("rule_type") == "STATIC_TEXT") | ((F.col("rule_type") == "TEXT_OR_LAYOUT") & same)
    return ~F.coalesce("recovered", F.lit(False)) | (blank("section") & blank("subsection") & static)


def reviewed(rows: DataFrame) -> DataFrame:
    """Adds reviewer_status, internal_status, identity_confident and review_reason; technical rows keep their status and have no reviewer status."""
    scored = with_scores(rows.withColumn("__a", dash_norm("item")).withColumn("__b", dash_norm("di_key")), "__a", "__b", "__label", known=F.when(F.col("identity").isNotNull(), F.col("identity.label_score")).when(F.coalesce("di_kind", F.lit("")) == "static_text", F.when(F.col("__a") == F.col("__b"), 100.0).otherwise(0.0)).when(F.col("__b") == "", 0.0))
    guarded, static = F.col("identity").isNotNull(), F.coalesce("di_kind", F.lit("")) == "static_text"
    none = F.array().cast("array<string>")
    doubts = F.filter(
        F.concat(
            F.array(
                F.when(~F.col("matched"), "No field was matched with confidence."),
                F.when(F.coalesce("sequence_state", F.lit("")) == "REVIEW_REQUIRED", "The order of rules and fields speaks against this field."),
                F.when(~safe_recovery(), "Text on the page does not validate a field of a section."),
                F.when(~guarded & ~static & F.col("matched") & (F.col("__label") < REVIEW_LABEL_FLOOR), F.format_string("The labels agree by only %.1f%%.", "__label")),
                F.when(~guarded & ~static & F.col("matched") & (F.coalesce("match_score", F.lit(0.0)) < REVIEW_MATCH_FLOOR), F.format_string("The match scores only %.1f.", F.coalesce("match_score", F.lit(0.0)))),
            ),
            F.when(guarded & F.col("matched") & ~F.col("identity.confident"), F.col("identity.reasons")).otherwise(none),
        ),
        lambda r: r.isNotNull(),
    )
    out = scored.withColumn("__doubts", F.array_distinct(doubts))
    sure = F.size("__doubts") == 0
    statuses = F.transform("checks", lambda c: c["status"])
    failed = F.array_contains(statuses, "FAIL")
    parts = F.size(F.coalesce("expected_parts", none)) > 1
    tokens = F.filter(F.split(F.upper(F.coalesce("di_value", F.lit(""))), r"[\s,]+"), lambda t: t != "")
    one_line = parts & (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.isin(*LINE_PLACEHOLDERS)) & F.contains(dash_norm("if_unknown"), F.lit("SINGLE LINE"))
    placed = F.col("bbox").isNotNull() & F.coalesce("geometry_trusted", F.lit(True))
    harmless = F.forall(statuses, lambda s: s.isin("PASS", "UNKNOWN_DATA", "MISSING_DATA"))
    review = F.lit("REVIEW_REQUIRED")
    if_sure = lambda s: F.when(sure, s).otherwise(review)
    final = (
        F.when(parts & ~F.coalesce("complete", F.lit(True)), review)
        .when((F.col("rule_type") == "CHECKBOX") & ~F.coalesce("payload_ok", F.lit(True)), review)
        .when((F.coalesce("instruction_mode", F.lit("")) == "FORMAT_EXAMPLE_ONLY") & failed, review)
        .when(one_line & (F.size(tokens) > 1), if_sure("FAIL"))
        .when(one_line & ~placed, review)
        .when(one_line, if_sure("PASS"))
        .when((F.col("status") == "FAIL") | failed, if_sure("FAIL"))
        .when(sure & F.col("matched") & F.col("status").isin("PASS", "UNKNOWN_DATA", "MISSING_DATA") & harmless, "PASS")
        .otherwise(review)
    )
    open_ = F.transform(F.filter("checks", lambda c: c["status"] != "PASS"), lambda c: c["message"])
    conflict = F.when(F.coalesce("subsection_conflict", F.lit(False)), "The sheet and the page name different subsections.")
    why = F.array_distinct(F.filter(F.concat("__doubts", F.array(conflict), open_), lambda m: F.coalesce(m, F.lit("")) != ""))
    reason = F.when(F.size(why) > 0, F.array_join(why, " ")).otherwise(F.coalesce(F.nullif(F.col("message"), F.lit("")), F.lit("The result is not conclusive.")))
    technical = is_technical()
    done = out.withColumn("internal_status", F.col("status")).withColumn("reviewer_status", F.when(~technical, final)).withColumn("identity_confident", F.when(~technical, sure & ~(parts & ~F.coalesce("complete", F.lit(True)))))
    done = done.withColumn("review_reason", F.when(F.col("reviewer_status") == "REVIEW_REQUIRED", reason)).withColumn("status", F.coalesce("reviewer_status", "status"))
    return done.drop("__a", "__b", "__label", "__doubts")


def status_counts(rows: DataFrame, keys: list[str], technical: bool = False) -> DataFrame:
    """Rows by status; technical ones only if asked for."""
    kept = rows if technical else rows.filter(~is_technical())
    return kept.groupBy(*keys, "status").agg(F.count("*").alias("n"))
