"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Each whole text is scanned once. Candidates leave the scan as lengths and hashes, never as plain secrets. Over the whole
corpus each candidate hash is counted by distinct repositories and owners: a value that many owners hold is a copied
example, a value that stays with one owner looks live. Opaque tokens outside any base span are added where the corpus
says that they look live, or where the same value is a base secret elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

# The three base kinds, in order, and the added one.
KINDS = ("assign", "access", "hex", "opaque")
KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"""({KEYWORDS})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # a maximal run of 24 or more: what is left of [0-9a-f]+ once shorter matches are dropped
OPAQUE = "[A-Za-z0-9+/_=-]{20,}"
LEAST = {"assign": 6, "access": 20, "hex": 24, "opaque": 20}
WIDELY_COPIED_OWNERS = 3


def _matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Array of (gap before the match, length of the match, length of the value, hash of the value, mixed: it has a letter and a digit); lengths in code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    each = F.zip_with(F.transform(whole, F.length), values, lambda m, v: F.struct(m.alias("m"), F.length(v).alias("v"), F.sha2(v, 256).alias("h"), (v.rlike("[0-9]") & v.rlike("[A-Za-z]")).alias("mixed")))
    found = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), each, lambda g, x: F.struct(g.alias("g"), x["m"].alias("m"), x["v"].alias("v"), x["h"].alias("h"), x["mixed"].alias("mixed")))
    none = F.from_json(F.lit("[]"), "array<struct<g:int,m:int,v:int,h:string,mixed:boolean>>")
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(none)


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str | None = None) -> DataFrame:
    """One row for each input row, with the matches of each kind; the only pass over the texts."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col or id_col).cast("string").alias("repo"), F.col(text_col).alias("__text"))
    patterns = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "opaque": (OPAQUE, 0)}
    return written(rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "owner", "repo", *(_matches(text, *p).alias(k) for k, p in patterns.items())), "secret-matches")


def spans_of(scanned: DataFrame) -> DataFrame:
    """One row for each match that is long enough: row_id, owner, repo, kind, kind_ord, start, end (code points, end exclusive), h."""
    each = None
    for i, kind in enumerate(KINDS):
        part = scanned.filter(F.size(kind) > 0).select("row_id", "owner", "repo", F.lit(i).alias("kind_ord"), F.lit(kind).alias("kind"), F.lit(LEAST[kind]).alias("least"), F.posexplode(kind).alias("i", "x"))
        each = part if each is None else each.unionByName(part)
    order = Window.partitionBy("row_id", "kind_ord").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.when(F.col("kind") == "assign", F.col("x.v")).otherwise(F.col("x.m"))
    return (
        each.withColumn("end", F.sum(F.col("x.g") + F.col("x.m")).over(order))
        .filter((size >= F.col("least")) & ((F.col("kind") != "opaque") | F.col("x.mixed")))
        .select("row_id", "owner", "repo", "kind", "kind_ord", (F.col("end") - F.col("x.m")).alias("start"), "end", F.col("x.h").alias("h"))
    )


def ownership(spans: DataFrame, widely_copied: int = WIDELY_COPIED_OWNERS) -> DataFrame:
    """Corpus-wide counts for each candidate hash: h, n_spans, n_repos, n_owners, n_base, standing (example, shared or live)."""
    by_repo = spans.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") != "opaque", 1)).alias("b"))
    by_owner = by_repo.groupBy("h", "owner").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("repos"))
    by_hash = by_owner.groupBy("h").agg(F.sum("n").alias("n_spans"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("b").alias("n_base"))
    standing = F.when(F.col("n_owners") >= widely_copied, "example").when(F.col("n_owners") > 1, "shared").otherwise("live")
    return by_hash.withColumn("standing", standing)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, widely_copied: int = WIDELY_COPIED_OWNERS) -> DataFrame:
    """Finds secrets in every whole text and says of each document how far its candidates have spread.

    Returns one row for each input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared,
    n_example. base_sha256 is of kind:start:end of the base spans, by start, then kind, comma-joined; spans holds these
    and the added opaque ones. A null text counts as empty; the repository is the document unless repo_col names one,
    and a null owner is one owner. Overlapping spans of different kinds all stay; repeated rows each give a row; an empty
    table gives an empty result.
    """
    scanned = scan(docs, id_col, text_col, owner_col, repo_col)
    spans = written(spans_of(scanned), "secret-spans")
    judged = spans.join(ownership(spans, widely_copied).select("h", "standing", "n_base"), "h")
    span = F.struct("start", "kind_ord", "end", "kind", ((F.col("kind") != "opaque") | (F.col("n_base") > 0) | (F.col("standing") == "live")).alias("wanted"), "standing")
    per_doc = judged.groupBy("row_id").agg(F.array_sort(F.collect_list(span)).alias("all"))
    base = F.filter("all", lambda x: x["kind"] != "opaque")
    with_base = per_doc.select("row_id", "all", base.alias("base"))
    covered = lambda x: F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    chosen = with_base.select("row_id", "base", F.filter("all", lambda x: (x["kind"] != "opaque") | (x["wanted"] & ~covered(x))).alias("chosen"))

    def line(name: str) -> Column:
        return F.array_join(F.transform(name, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(name: str, field: str, value: str) -> Column:
        return F.coalesce(F.size(F.filter(name, lambda x: x[field] == F.lit(value))).cast("long"), F.lit(0).cast("long"))

    out = scanned.select("row_id", "doc_id").join(chosen, "row_id", "left")
    empty = F.coalesce(line("base"), F.lit(""))
    return out.select(
        "doc_id",
        *(count("base", "kind", k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(empty, 256).alias("base_sha256"),
        F.coalesce(line("chosen"), F.lit("")).alias("spans"),
        *(count("chosen", "standing", s).alias(f"n_{s}") for s in ("live", "shared", "example")),
    )
