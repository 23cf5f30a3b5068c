"""Similarity of short texts, 0 to 100.

The metrics are exact longest-common-subsequence ratios. They run as Arrow-batched functions, and with_scores() calls them
once for each distinct pair that cheaper, native tests leave undecided.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import norm


#: Pairs of texts longer than this together are not remembered, so that a worker's cache stays within some MB.
REMEMBERED_LENGTH = 200


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each character of a."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    all_ = (1 << len(a)) - 1
    state = all_
    for ch in b:
        here = state & masks.get(ch, 0)
        state = ((state + here) | (state - here)) & all_
    return len(a) - state.bit_count()


def _share(distance: int, length: int) -> float:
    return 100.0 - 100.0 * distance / length if length else 100.0


def ratio(a: str, b: str) -> float:
    return _share(len(a) + len(b) - 2 * lcs(a, b), len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Compares what both word sets share with what each has besides; 0 if either is empty. Scores of short texts are remembered."""
    return _short_token_set(a, b) if len(a) + len(b) <= REMEMBERED_LENGTH else _token_set(a, b)


def _token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_a, only_b = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (only_a and only_b):
        return 100.0
    gap = 1 if both else 0
    whole_a, whole_b = len(both) + gap + len(only_a), len(both) + gap + len(only_b)
    best = _share(len(only_a) + len(only_b) - 2 * lcs(only_a, only_b), whole_a + whole_b)
    if both:
        best = max(best, _share(gap + len(only_a), len(both) + whole_a), _share(gap + len(only_b), len(both) + whole_b))
    return best


_short_token_set = lru_cache(maxsize=50_000)(_token_set)


def sequence(a: str, b: str) -> float:
    """The longest-matching-block ratio; the order of its arguments matters."""
    return 100.0 * SequenceMatcher(None, a, b).ratio()


METRICS = {"token_set": token_set, "token_sort": token_sort, "ratio": ratio, "sequence": sequence}


def metric(name: str):
    """A column function of two texts; nulls count as empty."""
    score = METRICS[name]

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([score(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def with_scores(rows: DataFrame, a: str, b: str, out: str, name: str = "token_set", known: Column | None = None) -> DataFrame:
    """Adds the score of columns a and b. Where known is not null it is the score; the metric runs once for each distinct pair of the rest."""
    known = known if known is not None else F.lit(None).cast("double")
    marked = rows.withColumn("__fuzzy_known", known)
    pairs = marked.filter("__fuzzy_known is null").select(F.col(a).alias("__fuzzy_a"), F.col(b).alias("__fuzzy_b")).distinct().withColumn("__fuzzy_score", metric(name)("__fuzzy_a", "__fuzzy_b"))
    joined = marked.join(pairs, (marked["__fuzzy_known"].isNull()) & F.col(a).eqNullSafe(F.col("__fuzzy_a")) & F.col(b).eqNullSafe(F.col("__fuzzy_b")), "left")
    return joined.withColumn(out, F.coalesce("__fuzzy_known", "__fuzzy_score")).drop("__fuzzy_known", "__fuzzy_a", "__fuzzy_b", "__fuzzy_score")


CONTAINED = 85.0


def with_contained(rows: DataFrame, haystack: str, needle: str, out: str, threshold: float = CONTAINED) -> DataFrame:
    """Adds whether the needle stands in the haystack, whatever the case and spacing, or the two are as alike as threshold. Nothing contains an empty needle."""
    h, n = norm(haystack), norm(needle)
    known = F.when(n == "", 0.0).when(F.contains(h, n), 100.0)
    scored = with_scores(rows.withColumns({"__haystack": h, "__needle": n}), "__haystack", "__needle", "__alike", known=known)
    return scored.withColumn(out, F.col("__alike") >= threshold).drop("__haystack", "__needle", "__alike")
