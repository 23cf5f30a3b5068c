"""Which of many short texts stand in which long ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Short texts, and their characters, that one automaton holds, about; more are taken in several passes over the long ones.
AT_ONCE, CHARS_AT_ONCE = 50_000, 20_000_000
ROWS_OUT = 20_000


def contained(items: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, doc_id for every item that occurs in a text. items: item_id, needle; texts: doc_id, haystack, both normalised. Empty needles occur nowhere.

    Each pass reads the texts once, against an automaton of some AT_ONCE needles, so time is linear in the texts and a
    task's memory bounded. Needles are dealt to passes by their hash.
    """
    import ahocorasick

    spark = items.sparkSession
    needles = items.filter("coalesce(needle, '') <> ''").select("item_id", "needle")
    count, chars = needles.agg(F.count("*"), F.sum(F.length("needle"))).first()
    if not count:
        return items.join(texts.limit(0), F.lit(False)).select("item_id", "doc_id")
    passes = max(-(-count // AT_ONCE), -(-chars // CHARS_AT_ONCE))
    numbered = needles.withColumn("pass", F.pmod(F.xxhash64("needle"), F.lit(passes)))
    out = None
    for k in range(passes):
        held = [(r["item_id"], r["needle"]) for r in numbered.filter(F.col("pass") == k).collect()]
        words: dict[str, list] = {}
        for item_id, needle in held:
            words.setdefault(needle, []).append(item_id)
        shared = spark.sparkContext.broadcast(words)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automaton = ahocorasick.Automaton()
            for needle, ids in shared.value.items():
                automaton.add_word(needle, ids)
            automaton.make_automaton()
            rows: list[tuple] = []
            for batch in batches:
                for d, t in zip(batch["doc_id"], batch["haystack"], strict=True):
                    rows += [(i, d) for i in sorted({i for _, ids in automaton.iter(t) for i in ids})] if t else []
                    if len(rows) >= ROWS_OUT:
                        yield pd.DataFrame(rows, columns=["item_id", "doc_id"])
                        rows = []
            yield pd.DataFrame(rows, columns=["item_id", "doc_id"])

        schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id {texts.schema['doc_id'].dataType.simpleString()}"
        part = texts.select("doc_id", "haystack").mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, left_id: str, right_id: str) -> DataFrame:
    """For each row of left the row of right with the least distance between at and right_at within the same keys, of equals the lesser right_id: keys, left_id, right_id, gap. Each side is sorted once: only the neighbours before and after can be nearest."""
    l = left.select(*keys, F.col(at).alias("v"), F.col(left_id).alias("lid"), F.lit(None).cast(right.schema[right_id].dataType).alias("rid"))  # noqa: E741
    r = right.groupBy(*keys, F.col(right_at).alias("v")).agg(F.min(right_id).alias("rid")).withColumn("lid", F.lit(None).cast(left.schema[left_id].dataType))
    both = l.unionByName(r.select(l.columns))
    pair = F.when(F.col("rid").isNotNull(), F.struct("v", "rid"))
    forward = Window.partitionBy(*keys).orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    backward = Window.partitionBy(*keys).orderBy("v").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    seen = both.withColumn("b", F.last(pair, True).over(forward)).withColumn("a", F.first(pair, True).over(backward)).filter("lid is not null")
    gap = lambda c: F.abs(F.col("v") - F.col(f"{c}.v"))
    options = F.filter(F.array(*(F.when(F.col(c).isNotNull(), F.struct(gap(c).alias("gap"), F.col(f"{c}.rid").alias("rid"))) for c in ("b", "a"))), lambda x: x.isNotNull())
    best = F.array_min(options)
    return seen.withColumn("best", best).filter("best is not null").select(*keys, F.col("lid").alias(left_id), F.col("best.rid").alias(right_id), F.col("best.gap").alias("gap"))


def diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of either side whose values differ, by key: keys, change (added, removed or changed), and the values before and after."""
    b = before.select(*keys, F.struct(*values).alias("before"))
    a = after.select(*keys, F.struct(*values).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return b.join(a, keys, "full").withColumn("change", change).filter("change is not null")
