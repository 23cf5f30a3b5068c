"""Text expressions. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lookups import GENERIC_WORDS, STOP_WORDS

SPACE = r"(?U)[\s\x1c-\x1f]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """White space runs become one space, ends are trimmed, null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), SPACE, " "))


def norm(c: Column | str) -> Column:
    return F.upper(clean(c))


def joined(*cols: Column | str) -> Column:
    """The texts with spaces between, nulls as empty."""
    return F.concat_ws(" ", *(F.coalesce(col(c).cast("string"), F.lit("")) for c in cols))


def label_norm(c: Column | str) -> Column:
    """Upper case, ampersand as a word, everything but A-Z and 0-9 as space."""
    upper = F.replace(F.upper(F.coalesce(col(c).cast("string"), F.lit(""))), F.lit("&"), F.lit(" AND "))
    return F.trim(F.regexp_replace(upper, "[^A-Z0-9]+", " "))


def alnum_norm(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(col(c).cast("string"), F.lit(""))), "[^A-Z0-9]+", " "))


def dash_norm(c: Column | str) -> Column:
    """Upper case, one kind of dash, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.upper(F.coalesce(col(c).cast("string"), F.lit(""))), "–—", "--"), SPACE, " "))


def words(c: Column | str) -> Column:
    """The non-empty parts between spaces."""
    return F.filter(F.split(col(c), " "), lambda w: w != "")


def label_tokens(c: Column | str) -> Column:
    """Lower-case words of a label, without stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(words(F.lower(label_norm(c))), lambda w: ~F.array_contains(stop, w))


def distinctive_tokens(c: Column | str) -> Column:
    """Those label words that tell one field from another, each once."""
    generic = F.array(*map(F.lit, GENERIC_WORDS))
    return F.array_distinct(F.filter(label_tokens(c), lambda w: (F.length(w) > 1) & ~F.array_contains(generic, w)))


def contains_either(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def any_contains(c: Column, phrases) -> Column:
    return reduce(lambda x, y: x | y, (F.contains(c, F.lit(p)) for p in phrases))


def likely_static_label(c: Column | str) -> Column:
    """Longer than three characters, no <placeholder>, at least one letter."""
    n = norm(c)
    return (F.length(n) > 3) & ~n.rlike("<[^>]+>") & n.rlike(r"\p{L}")


def detect_party(*cols: Column | str) -> Column:
    """B if any text speaks of party B or the bride, else A for party A or the groom, else null."""
    blob = F.upper(clean(joined(*cols)))
    return F.when(any_contains(blob, ("PARTY B", "BRIDE")), "B").when(any_contains(blob, ("PARTY A", "GROOM")), "A")
