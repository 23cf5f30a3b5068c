"""Validation of bound values: one struct for each check that applies, null for those that don't, and the roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import infer_pattern, looks_like_date, matches_pattern
from ..functions.text import any_contains, clean, contains_either, norm
from ..functions.values import character_limit, first_number, format_matches, is_placeholder
from ..lookups import BOLD_WORDS, ROLLUP_ORDER, SPECIFY_PHRASES, TEXT_LEAST, TOP_OF_PAGE
from ..schemas import CHECK


def check(name: str, status: Column | str, expected: Column | str, actual: Column | str, message: Column | str) -> Column:
    values = [F.lit(name), *(v if isinstance(v, Column) else F.lit(v) for v in (status, expected, actual, message))]
    return F.struct(*(v.cast("string").alias(n) for n, v in zip(("name", "status", "expected", "actual", "message"), values, strict=True)))


def _passes(ok: Column, otherwise: str = "FAIL") -> Column:
    return F.when(ok, "PASS").otherwise(otherwise)


def presence(found: Column, value: Column) -> Column:
    blank = clean(value) == ""
    missing = lambda actual, why: check("presence", "MISSING_DATA", "printed value", actual, why)
    return (
        F.when(~found, missing("(not located)", "No field could be located with confidence."))
        .when(blank, missing("(blank)", "The field is there, its value is blank."))
        .when(is_placeholder(value), check("presence", "UNKNOWN_DATA", "printed value", value, "The value is a placeholder."))
        .otherwise(check("presence", "PASS", "printed value", value, "A value is printed."))
    )


def date_pattern(instruction: Column, example: Column, item: Column, value: Column) -> Column:
    """Applies where the rule asks for a pattern, unless its example shows something other than a date."""
    pattern = infer_pattern(instruction, example, item)
    applies = pattern.isNotNull() & ((clean(example) == "") | looks_like_date(clean(example)))
    ok = matches_pattern(value, pattern)
    return F.when(applies, check("date_pattern", _passes(ok), pattern, F.coalesce(F.nullif(value, F.lit("")), F.lit("(none)")), F.when(ok, "The date has the pattern.").otherwise("No date of the pattern.")))


def max_chars(limit_cell: Column, value: Column) -> Column:
    limit, n = character_limit(limit_cell), F.length(F.coalesce(value, F.lit("")))
    ok = n <= limit
    return F.when(limit.isNotNull(), check("max_chars", _passes(ok), F.format_string("<= %d chars", limit), F.format_string("%d chars", n), F.when(ok, "Within the limit.").otherwise("Longer than the limit.")))


def char_size(size_cell: Column, shrink_cell: Column, points: Column) -> Column:
    """Advisory, since points are estimated: never a failure."""
    want, least = first_number(size_cell), first_number(shrink_cell)
    shrinks = least.isNotNull() | F.lower(clean(size_cell)).contains("shrink")
    ok = F.when(shrinks, points.between(F.coalesce(least, F.lit(0.0)) - 1.5, want + 1.5)).otherwise(F.abs(points - want) <= 1.5)
    return F.when(want.isNotNull() & points.isNotNull(), check("char_size", _passes(ok, "NOT_VALIDATED"), F.concat(want.cast("string"), F.lit(" pt")), F.concat(points.cast("string"), F.lit(" pt (estimated)")), F.when(ok, "The size fits.").otherwise("The estimated size is outside the range.")))


def font(want: Column, family: Column) -> Column:
    a, b = norm(want), norm(family)
    ok = contains_either(a, b)
    return F.when((a != "") & (b != ""), check("font", _passes(ok), want, family, F.when(ok, "The font matches.").otherwise("Another font is printed.")))


def bold(want: Column, is_bold: Column) -> Column:
    return F.when(F.lower(clean(want)).isin(*BOLD_WORDS) & is_bold.isNotNull(), check("bold", _passes(is_bold), "bold", F.when(is_bold, "bold").otherwise("not bold"), F.when(is_bold, "The value is bold.").otherwise("The value is not bold.")))


def part_gaps(parts: Column) -> Column:
    """Fails where a blank part precedes a filled one."""
    filled = lambda p: F.coalesce(p["value"], F.lit("")) != ""
    last = F.array_max(F.transform(parts, lambda p, i: F.when(filled(p), i).otherwise(-1)))
    gaps = F.transform(F.filter(F.transform(parts, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), filled(p).alias("on"))), lambda x: ~x["on"] & (x["i"] < last)), lambda x: F.when(F.coalesce(x["key"], F.lit("")) != "", x["key"]).otherwise(F.format_string("part %d", x["i"] + 1)))
    names = F.array_join(gaps, ", ")
    return F.when((F.size(parts) >= 2) & (F.size(gaps) > 0), check("part_gaps", "FAIL", "no blank part before a filled one", F.concat(F.lit("blank: "), names), F.concat(F.lit("Blank before a printed part: "), names)))


def specify_text(selected: Column, value: Column, others: Column) -> Column:
    """For a selected option that asks to specify: text must be left in the value, or stand in another field of the page that asks for it. others: array of (key, value)."""
    asks = lambda t: any_contains(F.lower(clean(t)), SPECIFY_PHRASES)
    wanted = F.exists(selected, asks)
    rest = reduce(lambda v, t: F.regexp_replace(v, t, " "), (r"(?i)(?:un)?selected", r"[;:,\-]"), F.coalesce(value, F.lit("")))
    left = F.aggregate(selected, F.lower(rest), lambda acc, s: F.replace(acc, F.lower(s), F.lit("")))
    found = (clean(left) != "") | F.exists(others, lambda o: asks(o["key"]) & (clean(o["value"]) != ""))
    return F.when(wanted, check("specify_text", _passes(found), "text beside the selected option", F.when(found, "present").otherwise("(none)"), F.when(found, "Text is given.").otherwise("The selected option asks for text, and none is printed.")))


def instruction(kind: Column, instruction_cell: Column, unknown_cell: Column, value: Column, example: Column, verdict: Column, reason: Column, without_model: bool = False) -> Column:
    """A model's verdict, where a provider gave one; a verdict other than pass or fail falls back to the example's shape. Without a verdict nothing is checked, unless without_model asks for the shape alone."""
    applies = (F.coalesce(kind, F.lit("")) != "checkbox_group") & ((clean(instruction_cell) != "") | (clean(unknown_cell) != ""))
    given = verdict.isNotNull() | F.lit(without_model)
    shape = F.coalesce(format_matches(value, example), F.lit(True))
    ok = F.when(verdict == "pass", True).when(verdict == "fail", False).otherwise(shape)
    return F.when(applies & given, check("instruction", _passes(ok), F.coalesce(F.nullif(clean(instruction_cell), F.lit("")), unknown_cell), F.coalesce(F.nullif(value, F.lit("")), F.lit("(blank)")), F.coalesce(reason, F.when(shape, "The shape agrees with the example.").otherwise("The shape differs from the example."))))


def gathered(first: Column, *others: Column) -> Column:
    """The checks that apply, as an array; none besides presence where data is missing."""
    rest = F.filter(F.array(*(o.cast(CHECK) for o in others)), lambda c: c.isNotNull())
    return F.when(first["status"] == "MISSING_DATA", F.array(first.cast(CHECK))).otherwise(F.concat(F.array(first.cast(CHECK)), rest))


def rollup(checks: Column) -> Column:
    """The first of FAIL, MISSING_DATA, UNKNOWN_DATA, PASS that any check has; PASS for none of them."""
    statuses = F.transform(checks, lambda c: c["status"])
    out = F.lit("PASS")
    for s in reversed(ROLLUP_ORDER):
        out = F.when(F.array_contains(statuses, s), s).otherwise(out)
    return out


def messages(checks: Column) -> Column:
    return F.array_join(F.filter(F.transform(checks, lambda c: c["message"]), lambda m: F.coalesce(m, F.lit("")) != ""), "; ")


def boilerplate(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, field_ord of fields that print no value of their own: at the top of a page, of one text on several pages, or of a text that a rule uses as a label."""
    text = norm(F.coalesce(F.nullif(F.col("value"), F.lit("")), "key"))
    f = fields.select("doc_id", "field_ord", "page", "bbox", text.alias("t"), norm("value").alias("v"))
    shown = f.filter("t <> ''")
    several = shown.groupBy("doc_id", "t").agg(F.min("page").alias("a"), F.max("page").alias("b")).filter("a < b").select("doc_id", "t")
    labels = rules.select("doc_id", F.explode(F.array(norm("item"), norm("label_printed"), norm("section"), norm("subsection"))).alias("v")).filter(F.length("v") >= TEXT_LEAST).distinct()
    top = shown.filter(F.col("bbox.y0") <= TOP_OF_PAGE)
    parts = [top, shown.join(several, ["doc_id", "t"], "left_semi"), f.join(labels, ["doc_id", "v"], "left_semi")]
    return reduce(DataFrame.unionByName, (p.select("doc_id", "field_ord") for p in parts)).distinct()
