"""Whether a bound field is the one that the rule means: label evidence, rejection of unsafe rows, shared boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import with_scores
from ..functions.geometry import signature
from ..functions.text import contains_either, distinctive_tokens, label_norm, label_tokens
from ..functions.values import checkbox_labels
from ..lookups import IDENTITY_FIELD_COVER, IDENTITY_RATIO, IDENTITY_RULE_COVER, WRAPPER_WORDS
from ..schemas import CHECK


def coverage(a: Column, b: Column) -> tuple[Column, Column]:
    """The shares of either word set that the other holds, in percent."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    some = (F.size(x) > 0) & (F.size(y) > 0)
    return F.when(some, 100.0 * both / F.size(x)).otherwise(0.0), F.when(some, 100.0 * both / F.size(y)).otherwise(0.0)


def sections_agree(a: Column | str, b: Column | str) -> Column:
    x, y = label_norm(a), label_norm(b)
    return (x == "") | (y == "") | contains_either(x, y)


def identity(rows: DataFrame) -> DataFrame:
    """Adds the struct identity (confident, label_score, rule_coverage, field_coverage, reasons) from item, section, subsection and di_key, di_section, di_subsection."""
    scored = with_scores(rows.withColumn("__i", label_norm("item")).withColumn("__k", label_norm("di_key")), "__i", "__k", "__ratio", "sequence")
    ti, tk, di, dk = label_tokens("item"), label_tokens("di_key"), distinctive_tokens("item"), distinctive_tokens("di_key")
    cover_rule, cover_field = coverage(ti, tk)
    exact = (F.col("__i") == F.col("__k")) & (F.col("__i") != "")
    shared, lacking = F.array_intersect(di, dk), F.array_except(di, dk)
    collides = (F.size(ti) > 0) & (F.size(tk) > 0) & (F.size(di) == 0) & (F.size(dk) == 0) & ~exact
    lexical = ~collides & (exact | (F.col("__ratio") >= IDENTITY_RATIO) | ((cover_rule >= IDENTITY_RULE_COVER) & (cover_field >= IDENTITY_FIELD_COVER)))
    distinct = exact | F.when(F.size(di) >= 2, F.size(shared) >= 2).otherwise(~collides & ((F.size(di) == 0) | (F.size(shared) > 0)))
    section, subsection = sections_agree("section", "di_section"), sections_agree("subsection", "di_subsection")
    reasons = F.filter(
        F.array(
            F.when(collides, F.concat(F.lit("generic-only labels differ: "), "__i", F.lit(" / "), "__k")).when(~lexical, F.format_string("weak label similarity (%.1f%%)", "__ratio")),
            F.when(~distinct, "distinctive words do not agree"),
            F.when((F.size(lacking) > 0) & ~exact, F.concat(F.lit("words not found: "), F.array_join(F.array_sort(lacking), ", "))),
            F.when(~section, "section mismatch"),
            F.when(~subsection, "subsection mismatch"),
        ),
        lambda r: r.isNotNull(),
    )
    found = F.struct((lexical & distinct & section & subsection).alias("confident"), F.round(F.least(F.col("__ratio"), F.lit(100.0)), 2).alias("label_score"), F.round(cover_rule, 2).alias("rule_coverage"), F.round(cover_field, 2).alias("field_coverage"), reasons.alias("reasons"))
    return scored.withColumn("identity", found).drop("__i", "__k", "__ratio")


def clamp_score(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(score.try_cast("double"), F.lit(0.0)))), 2)


def reject_unsafe(rows: DataFrame) -> DataFrame:
    """Takes the field away from rows that can't be trusted: doubtful identity, boxes that don't belong to the row, incomplete parts, malformed options. Such rows need review; their identity stays for the record."""
    judged = identity(rows).withColumn("match_score", clamp_score(F.col("match_score")))
    confident = F.col("identity.confident")
    incomplete = (F.size(F.coalesce("expected_parts", F.array().cast("array<string>"))) > 1) & ~F.coalesce("complete", F.lit(True))
    boxes = (F.upper(F.coalesce("rule_type", F.lit(""))) == "CHECKBOX") | (F.coalesce("di_kind", F.lit("")) == "checkbox_group")
    warned = F.exists("checks", lambda c: (c["name"] == "checkbox_position") & (c["status"] != "PASS"))
    labels = checkbox_labels("di_value")
    tokens = F.flatten(F.transform(labels, distinctive_tokens))
    wanted = distinctive_tokens("item")
    foreign = (F.size(tokens) > 0) & (F.size(wanted) > 0) & ~F.arrays_overlap(tokens, wanted) & ~confident
    malformed = boxes & (F.exists(labels, lambda x: F.lower(label_norm(x)).isin(*WRAPPER_WORDS)) | ~F.coalesce("payload_ok", F.lit(True)))
    mismatch = boxes & (warned | foreign)
    more = F.filter(
        F.array(
            F.when(incomplete, F.concat(F.lit("incomplete parts: expected "), F.array_join("expected_parts", ", "))),
            F.when(malformed, "options hold a wrapper's words"),
            F.when(mismatch, "the checkbox group does not belong to this row"),
        ),
        lambda r: r.isNotNull(),
    )
    why = F.array_join(F.array_distinct(F.concat("identity.reasons", more)), "; ")
    flagged = judged.withColumn("identity", F.when(F.col("matched"), F.col("identity"))).withColumn("__why", why)
    flagged = flagged.withColumn("rejected", F.col("matched") & (~confident | incomplete | malformed | mismatch))
    check = F.struct(*(v.cast("string").alias(n) for n, v in (("name", F.lit("identity_guard")), ("status", F.lit("MISSING_DATA")), ("expected", F.col("item")), ("actual", F.lit("candidate rejected")), ("message", F.col("__why")))))
    out = flagged.withColumn("checks", F.when(F.col("rejected"), F.array(check).cast(f"array<{CHECK}>")).otherwise(F.col("checks")))
    out = out.withColumn("message", F.when(F.col("rejected"), F.concat(F.lit("The field was rejected: "), "__why")).otherwise(F.col("message")))
    out = out.withColumn("status", F.when(F.col("rejected"), "REVIEW_REQUIRED").otherwise(F.col("status"))).withColumn("match_score", F.when(F.col("rejected"), 0.0).otherwise(F.col("match_score")))
    for c in ("di_kind", "di_section", "di_subsection", "di_key", "di_value", "page", "bbox", "confidence"):
        out = out.withColumn(c, F.when(~F.col("rejected"), F.col(c)))
    return out.withColumn("matched", F.col("matched") & ~F.col("rejected")).drop("__why")


def shared_boxes(rows: DataFrame) -> DataFrame:
    """Adds geometry_trusted and shared_keys, and drops the box where several keys of a document claim the very same one."""
    key = F.when(F.col("matched") & F.col("bbox").isNotNull(), F.nullif(label_norm("di_key"), F.lit("")))
    here = Window.partitionBy("doc_id", signature(F.col("page"), "bbox"))
    keys = F.when(F.col("matched") & F.col("bbox").isNotNull(), F.array_sort(F.collect_set(key).over(here)))
    marked = rows.withColumn("shared_keys", keys)
    several = F.coalesce(F.size("shared_keys") > 1, F.lit(False))
    return marked.withColumn("geometry_trusted", ~several).withColumn("bbox", F.when(~several, F.col("bbox"))).withColumn("shared_keys", F.when(several, F.col("shared_keys")))
