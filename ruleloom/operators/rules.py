"""From a cell grid to typed rules: header rows, column roles, parsing, filling, typing, issues."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import COMPONENTS, WHOLE
from ..functions.fuzzy import token_set, with_scores
from ..functions.text import any_contains, clean, joined, norm
from ..functions.values import options_from_instruction, parse_example
from ..lookups import DATE_PARTS, HEADER_PHRASES, HEADER_PUNCTUATION, LEAKED_MARKER, NO_PRINT_PHRASES, NOTE_DELIMITERS, REQUIRED_ROLES, ROLE_FLOOR, ROLE_PHRASES, TYPOS, YEAR_PARTS
from .assign import greedy

SHEET = ["workbook", "sheet"]
VALUE_ROLES = ("section", "subsection", "item", "if_missing", "if_unknown", "instruction", "label_printed", "example", "max_chars", "shrink_size", "char_size", "bold", "font")


def sheet_names(cells: DataFrame) -> DataFrame:
    return cells.select("workbook", "sheet_ord", "sheet").distinct()


def sheet_text(cells: DataFrame) -> DataFrame:
    """The non-blank cells of each sheet, by spaces and lines. A row without text among the sheet's rows is an empty line."""
    rows = cells.select(*SHEET, "row0", "col0", clean("text").alias("t")).groupBy(*SHEET, "row0")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("col0", "t")))), lambda x: x["t"]), " ")
    lines = rows.agg(line.alias("line"))
    by_row = lines.groupBy(*SHEET).agg(F.map_from_entries(F.collect_list(F.struct("row0", "line"))).alias("m"), F.max("row0").alias("last"))
    every = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    return by_row.select(*SHEET, F.array_join(every, "\n").alias("sheet_text"))


def header_rows(cells: DataFrame) -> DataFrame:
    """The row of each sheet in which most roles have a phrase; of equals the first."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col0", F.lower(clean("text")).alias("t")))), lambda x: x["t"]), " | ")
    rows = cells.groupBy(*SHEET, "row0").agg(line.alias("line"))
    score = sum(F.when(any_contains(F.col("line"), phrases), 1).otherwise(0) for phrases in HEADER_PHRASES.values())
    return rows.withColumn("score", score).groupBy(*SHEET).agg(F.max_by("row0", F.struct("score", -F.col("row0"))).alias("header_row"), F.max("score").alias("header_score"))


def headers(cells: DataFrame) -> DataFrame:
    found = cells.join(header_rows(cells), SHEET).filter("row0 = header_row")
    return found.select(*SHEET, "header_row", "col0", clean("text").alias("header")).filter("header <> ''")


def without_note(header: Column) -> Column:
    """A header up to the first delimiter of a note, unless that opens it."""
    text = clean(header)
    low = F.lower(text)
    places = [F.when(F.instr(low, d) > 1, F.instr(low, d) - 1) for d in NOTE_DELIMITERS]
    cut = F.least(*places, F.length(text))
    return F.regexp_replace(F.substring(text, F.lit(1), cut), r"^[ ,:\-]+|[ ,:\-]+$", "")


def canonical(header: Column) -> Column:
    return clean(F.translate(norm(without_note(header)), HEADER_PUNCTUATION, " " * len(HEADER_PUNCTUATION)))


def role_scores(headers: DataFrame) -> DataFrame:
    """The best score of every role for every header: 100 for its phrase, 95 if it holds the phrase's words, else word-set similarity."""
    phrases = [(i, r, p) for i, (r, ps) in enumerate(ROLE_PHRASES.items()) for p in ps]
    literal = F.array(*(F.struct(F.lit(i).alias("role_ord"), F.lit(r).alias("role"), F.lit(p).alias("phrase")) for i, r, p in phrases))
    each = headers.withColumn("x", F.explode(literal)).select("*", "x.*").drop("x").withColumn("h", canonical(F.col("header"))).withColumn("p", canonical(F.col("phrase")))
    subset = F.size(F.array_except(F.split("p", " "), F.split("h", " "))) == 0
    known = F.when(F.col("h") == "", 0.0).when(F.col("h") == F.col("p"), 100.0).when(subset, 95.0)
    scored = with_scores(each, "p", "h", "score", known=known)
    return scored.groupBy(*SHEET, "col0", "header", "role_ord", "role").agg(F.max("score").alias("score"))


def resolve_roles(headers: DataFrame) -> DataFrame:
    """Each role's header, at most one to one, best scores first: workbook, sheet, role, header, col0, score."""
    pairs = role_scores(headers).filter(F.col("score") >= ROLE_FLOOR)
    # columns with one and the same header are one choice, the first of them
    first = pairs.groupBy(*SHEET, "role_ord", "role", "header").agg(F.max("score").alias("score"), F.min("col0").alias("col0"))
    return greedy(first, SHEET, "role", "header", [("score", False), ("role_ord", True), ("col0", True)]).select(*SHEET, "role", "header", "col0", "score")


def schema_report(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """For each sheet: whether all required roles have a column, which are missing, which headers no role took, warnings."""
    roles = mapping.groupBy(*SHEET).agg(F.collect_set("role").alias("roles"), F.collect_set("header").alias("taken"))
    all_ = headers.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("col0", "header"))).alias("h")).join(roles, SHEET, "left")
    none = F.array().cast("array<string>")
    has = F.coalesce("roles", none)
    missing = F.filter(F.array(*map(F.lit, REQUIRED_ROLES)), lambda r: ~F.array_contains(has, r))
    unmapped = F.filter(F.transform("h", lambda x: x["header"]), lambda x: ~F.array_contains(F.coalesce("taken", none), x))
    warnings = F.filter(
        F.array(
            F.when(~F.array_contains(has, "example"), "no example column"),
            F.when(~F.array_contains(has, "if_unknown"), "no column for unknown values"),
            F.when(F.size(unmapped) > 0, F.concat(F.lit("columns without a role: "), F.array_join(unmapped, ", "))),
        ),
        lambda w: w.isNotNull(),
    )
    return all_.select(*SHEET, (F.size(missing) == 0).alias("usable"), missing.alias("missing_roles"), unmapped.alias("unmapped"), warnings.alias("warnings"))


def roles_by_phrase(headers: DataFrame) -> DataFrame:
    """The fallback: role by role and phrase by phrase the first free header equal to the phrase, else the first that holds it."""
    phrases = [(i, r, k, p) for i, (r, ps) in enumerate(HEADER_PHRASES.items()) for k, p in enumerate(ps)]
    literal = F.array(*(F.struct(F.lit(i).alias("role_ord"), F.lit(r).alias("role"), F.lit(k).alias("phrase_ord"), F.lit(p).alias("phrase")) for i, r, k, p in phrases))
    each = headers.withColumn("x", F.explode(literal)).select("*", "x.*").drop("x").withColumn("h", F.lower("header"))
    met = each.filter(F.contains("h", F.col("phrase"))).withColumn("inexact", (F.col("h") != F.col("phrase")).cast("int"))
    best = met.groupBy(*SHEET, "role_ord", "role", "header", "col0").agg(F.min(F.struct("phrase_ord", "inexact")).alias("best"))
    ranked = best.select(*SHEET, "role_ord", "role", "header", "col0", "best.phrase_ord", "best.inexact")
    return greedy(ranked, SHEET, "role", "col0", [("role_ord", True), ("phrase_ord", True), ("inexact", True), ("col0", True)]).select(*SHEET, "role", "header", "col0", F.lit(None).cast("double").alias("score"))


def column_roles(headers: DataFrame) -> DataFrame:
    """The resolved roles where the required ones were found, else those by phrase; the numbers' column is left out."""
    resolved = resolve_roles(headers)
    usable = schema_report(headers, resolved).filter("usable").select(*SHEET)
    good = resolved.join(usable, SHEET, "left_semi").withColumn("role", F.when(F.col("role") == "shrink_char_size", "shrink_size").otherwise(F.col("role"))).filter("role <> 'item_number'")
    return good.unionByName(roles_by_phrase(headers.join(usable, SHEET, "left_anti")))


def example_columns(cells: DataFrame) -> DataFrame:
    """The first column of each sheet whose header names examples, to which pictures anchored there belong: workbook, sheet, col0. Sheets without one have no row."""
    named = headers(cells).filter(any_contains(F.lower("header"), HEADER_PHRASES["example"]))
    return named.groupBy(*SHEET).agg(F.min("col0").alias("col0"))


PREVIEW_ROWS = 500
BULKY = ("label_printed", "expected_kind", "part_labels", "part_separators")


def preview(rules: DataFrame, most: int = PREVIEW_ROWS) -> DataFrame:
    """The first rules of a sheet as a reader sees them, without columns of internal use."""
    return rules.orderBy("sheet", "rule_ord").limit(most).drop(*BULKY)


_TAIL = re.compile(r"[-–—]\s*([^-–—]+)$")
_TOKEN = re.compile(r"<\s*([^>]+?)\s*>")
_OPENING = re.compile(r"\bformat\s*:", re.IGNORECASE)
_COMMA = re.compile(r"\bcomma\b", re.IGNORECASE)
_QUALIFIER = re.compile(r"\bparty\s+[ab]\b|\bdecedent\b|\bofficiant\b", re.IGNORECASE)


def _squeezed(text: str | None) -> str:
    return " ".join((text or "").split())


def item_head(item: str | None) -> str:
    """An item without its list of parts and its number."""
    text = _squeezed(item)
    tail = _TAIL.search(text)
    return _squeezed(re.sub(r"^\s*\d+[.)]\s*", "", text[: tail.start()] if tail else text))


def names_source(token: str, head: str) -> bool:
    """Whether a <token> says where the value comes from, as the item does, and not a part of what is printed."""
    a, b = _squeezed(_QUALIFIER.sub(" ", token)).upper(), head.upper()
    return bool(a and b) and (a in b or b in a or token_set(a, b) >= 88)


def format_clause(item: str | None, instruction: str | None) -> tuple[list[str], list[str]]:
    """The parts that a rule prints and what stands before each; none for a rule of one part."""
    text = _squeezed(instruction)
    opening = _OPENING.search(text)
    head = "" if opening else item_head(item)
    labels, separators, end = [], [], 0
    for m in _TOKEN.finditer(text, opening.end() if opening else 0):
        label = _squeezed(m[1])
        if label and len(label) <= 30 and not (head and names_source(label, head)):
            separators.append((", " if _COMMA.search(text[end : m.start()]) else " ") if labels else "")
            labels.append(label)
            end = m.end()
    if len(labels) > 1:
        return labels, separators
    tail = _TAIL.search(_squeezed(item))
    parts = [p for p in map(_squeezed, re.split(r",|\band\b", tail[1] if tail else "")) if p and len(p) <= 30]
    return (parts, [""] + [" "] * (len(parts) - 1)) if len(parts) > 1 else ([], [])


def _format_clause_column():
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for items, instructions in batches:
            yield pd.DataFrame([format_clause(a, b) for a, b in zip(items, instructions, strict=True)], columns=["labels", "separators"])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "labels array<string>, separators array<string>")


def parse_rules(cells: DataFrame) -> DataFrame:
    """One rule for each row below the header that has any text: the schema's RULES, without a type, and the workbook."""
    heads = headers(cells)
    roles = column_roles(heads)
    below = cells.join(heads.select(*SHEET, "header_row").distinct(), SHEET).filter("row0 > header_row")
    values = below.join(roles.select(*SHEET, "col0", "role"), [*SHEET, "col0"]).withColumn("text", clean("text"))
    wide = values.groupBy(*SHEET, "row0").pivot("role", [*VALUE_ROLES]).agg(F.first("text"))
    wide = wide.select(*SHEET, "row0", *(F.nullif(F.col(r), F.lit("")).alias(r) for r in VALUE_ROLES))
    so_far = Window.partitionBy(*SHEET).orderBy("row0").rowsBetween(Window.unboundedPreceding, 0)
    kept = wide.filter(F.coalesce(*VALUE_ROLES).isNotNull())
    own_section = kept.withColumn("own_section", F.col("section"))
    filled = own_section.withColumn("section", F.last("section", True).over(so_far)).withColumn("subsection", F.last("subsection", True).over(so_far))
    parsed = filled.withColumn("item", F.coalesce("item", "label_printed", "instruction", "own_section")).withColumn("shown", parse_example("example")).withColumn("mined", options_from_instruction("instruction"))
    from_instruction = (F.size("shown.options") == 0) & (F.size("mined") >= 2)
    parsed = parsed.withColumn("expected_kind", F.when(from_instruction, "checkbox_group").otherwise(F.col("shown.kind"))).withColumn("expected_options", F.when(from_instruction, F.col("mined")).otherwise(F.col("shown.options")))
    parsed = parsed.withColumn("clause", _format_clause_column()("item", "instruction"))
    order = F.row_number().over(Window.partitionBy(*SHEET).orderBy("row0"))
    numbered = parsed.withColumn("rule_ord", order)
    return numbered.select(
        *SHEET, "rule_ord", F.format_string("%s-%04d", "sheet", "rule_ord").alias("rule_id"), (F.col("row0") + 1).alias("row_index"), "section", "subsection", "item", "if_missing", "if_unknown", "instruction", "label_printed", "example", "expected_kind", "expected_options",
        F.col("clause.labels").alias("part_labels"), F.col("clause.separators").alias("part_separators"), "max_chars", "shrink_size", "char_size", "bold", "font", F.lit("UNKNOWN").alias("rule_type"),
    )


def fill_sections(rules: DataFrame, keys: list[str], carry_reset: bool = False) -> DataFrame:
    """Sections and subsections carried down from the rows that have them. With carry_reset a new section ends the carried subsection, and a leaked marker is not carried."""
    order = Window.partitionBy(*keys).orderBy("rule_ord")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    section, subsection = F.nullif(clean("section"), F.lit("")), F.nullif(clean("subsection"), F.lit(""))
    marked = rows_marked = rules.withColumn("__s", F.last(section, True).over(so_far))
    if not carry_reset:
        filled = marked.withColumn("subsection", F.last(subsection, True).over(so_far))
    else:
        turn = ~F.col("__s").eqNullSafe(F.lag("__s").over(order)) & F.col("__s").isNotNull()
        run = rows_marked.withColumn("__run", F.sum(F.when(turn, 1).otherwise(0)).over(so_far))
        carried = F.when(~F.contains(F.upper(F.col("__b")), F.lit(LEAKED_MARKER)), F.col("__b"))
        within = Window.partitionBy(*keys, "__run").orderBy("rule_ord").rowsBetween(Window.unboundedPreceding, 0)
        filled = run.withColumn("__b", subsection).withColumn("subsection", F.coalesce("__b", F.last(carried, True).over(within))).drop("__run", "__b")
    return filled.withColumn("section", F.col("__s")).drop("__s")


def strip_markers(rules: DataFrame) -> DataFrame:
    leaked = F.contains(norm("subsection"), F.lit(LEAKED_MARKER))
    return rules.withColumn("subsection", F.when(~leaked, F.col("subsection")).when(leaked, F.lit("")))


def mark_empty(rules: DataFrame) -> DataFrame:
    """Rules without a label, or with neither instruction nor example, print nothing that could be checked."""
    label, rule = clean(joined("item", "label_printed")) != "", clean(joined("instruction", "example")) != ""
    return rules.withColumn("rule_type", F.when(label & rule, F.col("rule_type")).otherwise("NO_PRINT_RULE"))


def normalize_rules(rules: DataFrame, keys: list[str], carry_reset: bool = True) -> DataFrame:
    return mark_empty(strip_markers(fill_sections(rules, keys, carry_reset)))


def classify(rules: DataFrame) -> DataFrame:
    """Types each rule, by the first that applies: nothing to print, checkbox, parts other than of a date, date, field text, static text, layout."""
    blob = norm(joined("item", "instruction", "example", "if_missing", "if_unknown"))
    orders = norm(joined("instruction", "if_missing", "if_unknown"))
    has = lambda c, t: F.contains(c, F.lit(t))
    checkbox = ((F.col("expected_kind") == "checkbox_group") & (F.size("expected_options") >= 2)) | has(orders, "CHECKBOX") | (has(orders, "PLACE") & has(orders, "X")) | has(orders, "CHECK ALL")
    parts = F.filter(F.transform(F.coalesce("part_labels", F.array().cast("array<string>")), norm), lambda p: p != "")
    of_date = (F.size(parts) > 0) & F.forall(parts, lambda p: p.isin(*DATE_PARTS)) & F.exists(parts, lambda p: p.isin(*YEAR_PARTS))
    date = (F.col("expected_kind") == "date") | F.coalesce("example", F.lit("")).rlike(WHOLE) | F.coalesce("instruction", F.lit("")).rlike(COMPONENTS)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    kind = (
        F.when(any_contains(blob, NO_PRINT_PHRASES), "NO_PRINT_RULE")
        .when(F.coalesce(checkbox, F.lit(False)), "CHECKBOX")
        .when((F.coalesce(F.size("part_labels"), F.lit(0)) > 0) & ~of_date, "FIELD_TEXT")
        .when(F.coalesce(date, F.lit(False)), "DATE_FORMAT")
        .when(any_contains(blob, ("PRINT <", "PRINT PARTY", "FORMAT:")), "FIELD_TEXT")
        .when(~blank("item") & blank("instruction") & ~blob.rlike("<[^>]+>"), "STATIC_TEXT")
        .otherwise("TEXT_OR_LAYOUT")
    )
    return rules.withColumn("rule_type", kind)


def issues(rules: DataFrame) -> DataFrame:
    """What looks wrong in the sheet itself: rule_id, row_index, issue."""
    blob = norm(joined("section", "subsection", "item", "instruction", "example"))
    has = lambda t: F.contains(F.col("__blob"), F.lit(t))
    found = F.array(
        F.when(has("PARTY B") & has("<PARTY A"), "Rule of party B refers to a field of party A"),
        F.when(has("OTHER/ALTERNATE") & has("EMAIL TO OFFICIANT CHECKBOX"), "Other/Alternate leads to the Email to Officiant checkbox"),
        *(F.when(has(t), f"Possible typo: {t}") for t in TYPOS),
    )
    return rules.withColumn("__blob", blob).select("rule_id", "row_index", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))


#: Rows of a sheet that one group of the search for the nearest rule takes.
ROWS_AT_ONCE = 4096


def attach_images(rules: DataFrame, images: DataFrame) -> DataFrame:
    """Each picture's rule: the one of its row, else the one nearest by row, of equals the first. images: sheet, row0, image_ord.

    Only the last rule up to a picture's row and the first from it on can be nearest. They are sought among ROWS_AT_ONCE
    rows of the sheet; what lies beyond comes from the first and last rules of such stretches, so sheets may have any length.
    """
    stretch = F.floor(F.col("at") / ROWS_AT_ONCE).alias("stretch")
    here = F.struct("at", "rule_ord", "rule_id")
    r = rules.select("sheet", (F.col("row_index") - 1).cast("long").alias("at"), "rule_ord", "rule_id").filter("at is not null").groupBy("sheet", "at").agg(F.min(here).alias("r")).select("sheet", stretch, "at", "r")
    i = images.select("sheet", F.col("row0").cast("long").alias("at")).filter("at is not null").distinct().select("sheet", stretch, "at", F.lit(None).cast(r.schema["r"].dataType).alias("r"))
    both = r.unionByName(i)

    def up_to(w) -> Column:
        return F.last("r", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))

    within = Window.partitionBy("sheet", "stretch")
    seen = both.withColumns({"asked": F.col("r").isNull(), "before": up_to(within.orderBy("at")), "after": up_to(within.orderBy(F.col("at").desc()))}).filter("asked")
    ends = both.groupBy("sheet", "stretch").agg(F.max("r").alias("last"), F.min("r").alias("first"))
    along = Window.partitionBy("sheet")
    earlier, later = (along.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("stretch").asc(), F.col("stretch").desc()))
    beyond = ends.select("sheet", "stretch", F.last("last", True).over(earlier).alias("earlier"), F.last("first", True).over(later).alias("later"))
    sides = F.array(F.coalesce("before", "earlier"), F.coalesce("after", "later"))
    gaps = F.transform(F.filter(sides, lambda x: x.isNotNull()), lambda x: F.struct(F.abs(x["at"] - F.col("at")).alias("gap"), x["rule_ord"].alias("rule_ord"), x["rule_id"].alias("rule_id")))
    found = seen.join(beyond, ["sheet", "stretch"]).select("sheet", F.col("at").alias("row0"), F.array_min(gaps).alias("r")).filter("r is not null")
    return images.select("sheet", "row0", "image_ord").distinct().join(found, ["sheet", "row0"]).select("sheet", "row0", "image_ord", F.col("r.rule_id").alias("rule_id"), (F.col("r.gap") == 0).alias("exact_row"))


def append_text(old: Column, new: Column) -> Column:
    """Adds recognised text to a cell unless the cell holds it already, whatever the case."""
    a, b = clean(old), clean(new)
    return F.when(b == "", a).when(a == "", b).when(F.contains(F.lower(a), F.lower(b)), a).otherwise(F.concat_ws(" ", a, b))
