"""Date patterns in text. Dates are shapes here, not values: nothing checks the calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lookups import MONTHS
from .text import col, joined

_MONTH = "|".join(MONTHS)
COMMA = rf"(?i)\b(?:{_MONTH})\s+\d{{1,2}},\s+\d{{4}}\b"
PLAIN = rf"(?i)\b(?:{_MONTH})\s+\d{{1,2}}\s+\d{{4}}\b"
NUMERIC = r"\b\d{2}/\d{2}/\d{4}\b"
PATTERNS = {"MM/DD/YYYY": NUMERIC, "MONTH DD, YYYY": COMMA, "MONTH DD YYYY": PLAIN}
#: A month's name, a numeric date, or any word of four digits.
EVIDENCE = rf"(?i)\b(?:{_MONTH})\b|\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b|\b\d{{4}}\b"
#: What an example cell is taken for a date by.
HINT = rf"(?i)\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}[/-]\d{{1,2}}[/-]\d{{1,2}}|mm/dd/yyyy|dd/mm/yyyy|yyyy|{_MONTH})\b"
#: What a rule is typed as a date by: a whole date in the example, or its components in order in the instruction.
WHOLE = rf"(?i)\b(?:{_MONTH})\s+\d{{1,2}},?\s+\d{{4}}\b|\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b"
COMPONENTS = r"(?is)\b(?:MONTH|MM)\b.*\b(?:DD|DAY)\b.*\b(?:YYYY|YEAR)\b"


def infer_pattern(instruction: Column | str, example: Column | str, item: Column | str) -> Column:
    """Which of the three patterns a rule asks for, or null. The word COMMA alone asks for the comma form."""
    blob = F.upper(joined(instruction, example, item))
    comma = F.contains(blob, F.lit("COMMA"))
    return (
        F.when(F.contains(blob, F.lit("MM/DD/YYYY")) | blob.rlike(NUMERIC), "MM/DD/YYYY")
        .when(blob.rlike(COMMA) | comma, "MONTH DD, YYYY")
        .when(blob.rlike(PLAIN) | (F.contains(blob, F.lit("MONTH")) & F.contains(blob, F.lit("YYYY"))), "MONTH DD YYYY")
    )


def matches_pattern(value: Column | str, pattern: Column | str) -> Column:
    """Whether a date of that pattern occurs anywhere in the value."""
    v, p = F.coalesce(col(value), F.lit("")), col(pattern)
    out = F.lit(False)
    for name, regex in PATTERNS.items():
        out = F.when(p == name, v.rlike(regex)).otherwise(out)
    return out


def extract(value: Column | str) -> Column:
    """All dates of the three patterns, pattern by pattern, each text once."""
    v = F.coalesce(col(value), F.lit(""))
    return F.array_distinct(F.concat(*(F.regexp_extract_all(v, F.lit(r), F.lit(0)) for r in (COMMA, PLAIN, NUMERIC))))


def looks_like_date(value: Column | str) -> Column:
    return F.coalesce(col(value), F.lit("")).rlike(EVIDENCE)
