"""Printed values: placeholders, format shapes, numbers, option lists, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lookups import PLACEHOLDER_VALUES, PLACEHOLDER_WORDS, SSN, SSN_MASK
from .dates import HINT
from .text import SPACE, clean, col

STATE = r"(?i):?\s*(?:un)?selected\s*:?"
OPTION = r"(?is)^(.*?)[\s:;\-–—]*:?\s*((?:un)?selected)\s*:?$"
TRIM_OPTION = r"^[ :,\-–—]+|[ :,\-–—]+$"


def is_placeholder(c: Column | str) -> Column:
    """Blank, made of the cancel character, a not-available value, or only placeholder words and nines."""
    v = clean(c)
    upper = F.regexp_replace(F.upper(v), "^[: ]+|[: ]+$", "")
    tokens = F.filter(F.split(upper, r"[\s,]+"), lambda t: t != "")
    filler = lambda t: t.isin(*PLACEHOLDER_WORDS) | t.rlike("^9+$")
    return (v == "") | v.rlike(r"^\x18+$") | upper.isin(*PLACEHOLDER_VALUES) | ((F.size(tokens) > 0) & F.forall(tokens, filler))


def format_signature(c: Column | str) -> Column:
    """The shape of a text: runs of letters as A, of digits as 9, the rest as it is."""
    return F.trim(F.regexp_replace(F.regexp_replace(clean(c), r"\p{L}+", "A"), r"\p{Nd}+", "9"))


def format_matches(value: Column | str, example: Column | str) -> Column:
    """Whether the shapes agree; null if either text is blank."""
    v, e = format_signature(value), format_signature(example)
    return F.when((v != "") & (e != ""), v == e)


def first_number(c: Column | str) -> Column:
    return F.try_cast(F.nullif(F.regexp_extract(clean(c), r"(\d+(?:\.\d+)?)", 1), F.lit("")), "double") if hasattr(F, "try_cast") else F.nullif(F.regexp_extract(clean(c), r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def character_limit(c: Column | str) -> Column:
    """The first one to three digits of a limit cell."""
    return F.nullif(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(\d{1,3})", 1), F.lit("")).try_cast("int")


def mask_pii(c: Column | str) -> Column:
    """Social security numbers become asterisks; masking twice changes nothing."""
    return F.regexp_replace(col(c), SSN, SSN_MASK)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, TRIM_OPTION, "")


def checkbox_options(c: Column | str) -> Column:
    """A checkbox value as an array of (label, state). Options are parted by semicolons, else by commas if a state is named, else after each state; without a state an option is unselected."""
    text = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    chunks = F.when(F.contains(text, F.lit(";")), F.split(text, ";")).when(F.contains(text, F.lit(",")) & text.rlike(STATE), F.split(text, ",")).otherwise(F.split(text, r"(?i)(?<=selected)\s*:?\s+"))

    def option(chunk: Column) -> Column:
        state = F.lower(F.regexp_extract(chunk, OPTION, 2))
        named = state != ""
        label = F.when(named, clean(F.regexp_extract(chunk, OPTION, 1))).otherwise(F.regexp_replace(chunk, STATE, ""))
        return F.struct(_stripped(label).alias("label"), F.when(named & ~state.startswith("un"), "selected").otherwise("unselected").alias("state"))

    cleaned = F.filter(F.transform(chunks, clean), lambda x: x != "")
    return F.filter(F.transform(cleaned, option), lambda o: o["label"] != "")


def checkbox_labels(c: Column | str) -> Column:
    """The labels before the last dash of each part of a serialised checkbox group."""
    parts = F.filter(F.split(F.coalesce(col(c).cast("string"), F.lit("")), ";"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.when(F.contains(p, F.lit("-")), F.regexp_extract(p, r"(?s)^(.*)-", 1)).otherwise(p))


def serialize_options(options: Column) -> Column:
    """An array of (option, selected) as label-state, parted by semicolons."""
    return F.array_join(F.transform(options, lambda o: F.concat(o["option"], F.when(o["selected"], "-selected").otherwise("-unselected"))), ";")


def field_value(text: Column | str, parts: Column | str) -> Column:
    """A field's value as text: that of a composite is key=value of its non-empty parts, the last of repeated keys."""
    p = col(parts)
    last = F.filter(p, lambda x, i: (F.coalesce(x["value"], F.lit("")) != "") & ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["key"] == x["key"]))
    return F.when(p.isNotNull(), F.array_join(F.transform(last, lambda x: F.concat_ws("=", x["key"], x["value"])), " ")).otherwise(clean(text))


def parse_example(example: Column | str, ocr: Column | str | None = None, from_image: bool = False) -> Column:
    """What an example shows, as (kind, options): label:state lists and lists of two or more short choices are checkbox groups, dates are dates, the rest is text; a blank has no kind."""
    text = clean(example)
    source = F.when(clean(ocr) != "", clean(ocr)).otherwise(text) if ocr is not None else text
    none = F.array().cast("array<string>")
    stated = F.filter(F.transform(F.split(source, ","), lambda p: F.trim(F.split(p, ":")[0])), lambda p: (p != "") & (p != "?"))
    is_stated = source.rlike(r"(?i):(?:un)?selected") & (F.size(stated) > 0)
    bare = F.regexp_replace(source, r"^[\[\](){}]+|[\[\](){}]+$", "")
    bracketed = source.rlike(r"^[\[({]") & source.rlike(r"[\])}]$")
    listed = F.filter(F.transform(F.split(bare, r"[/|,]"), lambda t: F.trim(t)), lambda p: p != "")
    parted = bare.rlike(r"[/|]") | (bracketed & F.contains(bare, F.lit(",")) & (F.length(bare) <= 60) & ~bare.rlike(HINT))
    is_listed = parted & (F.size(listed) >= 2) & F.forall(listed, lambda p: F.length(p) <= 30)
    tokens = F.filter(F.split(bare, SPACE), lambda t: t != "")
    is_strip = F.lit(from_image) & F.size(tokens).between(2, 6) & F.forall(tokens, lambda t: t.rlike(r"^\p{L}{1,15}$"))

    def out(kind: str | None, options: Column) -> Column:
        return F.struct(F.lit(kind).cast("string").alias("kind"), options.alias("options"))

    return (
        F.when(source == "", out(None, none))
        .when(is_stated, out("checkbox_group", stated))
        .when(is_listed, out("checkbox_group", listed))
        .when(source.rlike(HINT), out("date", none))
        .when(is_strip, out("checkbox_group", tokens))
        .otherwise(out("text", none))
    )


def options_from_instruction(c: Column | str) -> Column:
    """The labels between "in the" and "checkbox", up to 40 characters, each once whatever its case."""
    found = F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?i)in the\s+(.+?)\s+checkbox"), F.lit(1)), clean)
    short = F.filter(found, lambda x: (x != "") & (F.length(x) <= 40))
    lowered = F.transform(short, F.lower)
    return F.filter(short, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
