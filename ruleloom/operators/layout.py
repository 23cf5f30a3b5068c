"""Structure of printed pages: margin bands, sections, labels, checkbox groups, composite rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.geometry import center_x, center_y
from ..functions.text import clean, words
from ..functions.values import serialize_options
from ..lookups import (
    BAND_HEIGHT, BAND_RIGHT, BAND_SLACK, COLUMN_SHIFT, COLUMN_STEP, COMPOSITE_ROW, GLYPHS, HEADER_HEIGHT, HEADER_WIDTH, HEADER_WORDS, LABEL_ABOVE, PART_WORDS, ROW_GAP, SAME_ROW, TIER_SPREAD,
)
from ..schemas import BOX
from .grouped import by_group

PAGE = ["doc_id", "page"]


def is_selected(value: Column) -> Column:
    """The state of a raw checkbox value; null where it is none."""
    v = F.lower(F.coalesce(value, F.lit("")))
    return F.when(F.contains(v, F.lit(":selected:")), True).when(F.contains(v, F.lit(":unselected:")), False)


def margin_bands(lines: DataFrame) -> DataFrame:
    """Tall lines in the left margin, in two tiers where their centres fall into two columns: doc_id, page, band_ord, text, y0, y1, tier (0 section, 1 subsection).

    The columns part at the widest gap between distinct centres, the first of equal ones, if the centres spread at all.
    """
    tall = lines.withColumn("cx", center_x("bbox")).withColumn("t", clean("text")).filter((F.col("cx") <= BAND_RIGHT) & (F.col("bbox.y1") - F.col("bbox.y0") >= BAND_HEIGHT) & (F.col("t") != ""))
    xs = F.array_sort(F.collect_set(F.round("cx", 4)))
    per_page = tall.groupBy(*PAGE).agg(xs.alias("xs"))
    gaps = F.transform(F.slice("xs", F.lit(1), F.size("xs") - 1), lambda a, i: F.struct((F.col("xs")[i + 1] - a).alias("gap"), (-a).alias("left"), ((a + F.col("xs")[i + 1]) / 2).alias("middle")))
    spread = F.element_at("xs", -1) - F.col("xs")[0]
    split = per_page.select(*PAGE, F.when((F.size("xs") >= 2) & (spread > TIER_SPREAD), F.array_max(gaps)["middle"]).alias("split"))
    tiered = tall.join(split, PAGE).withColumn("tier", F.when(F.col("cx") > F.col("split"), 1).otherwise(0))
    order = Window.partitionBy(*PAGE).orderBy("tier", "bbox.y0", "line_ord")
    return tiered.select(*PAGE, F.row_number().over(order).alias("band_ord"), F.col("t").alias("text"), F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"), "tier")


def wide_headers(lines: DataFrame) -> DataFrame:
    """Short flat lines of some width: doc_id, page, text, y0."""
    t = clean("text")
    flat = (F.col("bbox.y1") - F.col("bbox.y0") <= HEADER_HEIGHT) & (F.col("bbox.x1") - F.col("bbox.x0") >= HEADER_WIDTH)
    return lines.filter((t != "") & (F.size(words(t)) <= HEADER_WORDS) & flat).select(*PAGE, t.alias("text"), F.col("bbox.y0").alias("y0"))


def sections_of(items: DataFrame, bands: DataFrame, key: str, y: str = "cy") -> DataFrame:
    """The section and subsection of each item: of the bands of a tier that reach its height, the one whose middle is nearest, of equals the first. items: doc_id, page, key, y."""
    met = items.select(*PAGE, key, F.col(y).alias("__y")).join(bands, PAGE, "left")
    inside = F.col("__y").between(F.col("y0") - BAND_SLACK, F.col("y1") + BAND_SLACK)
    rank = F.struct(F.abs(F.col("__y") - (F.col("y0") + F.col("y1")) / 2), F.col("band_ord"))

    def nearest(tier: int) -> Column:
        here = inside & (F.col("tier") == tier)
        return F.min_by(F.when(here, F.col("text")), F.when(here, rank))

    return met.groupBy(*PAGE, key).agg(nearest(0).alias("section"), nearest(1).alias("subsection"))


def looks_like_label(t: Column) -> Column:
    return (F.length(t) > 1) & t.rlike(r"[\p{L}\p{N}]") & ~t.isin(*GLYPHS)


def parent_labels(groups: DataFrame, lines: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """The printed label above each group that overlaps it sideways: nearest above, less so the farther its centre is off, the first of equals. groups: doc_id, page, key, bbox; excluded: doc_id, page, text (upper case) that no label may be."""
    up = F.upper(clean("text"))
    labels = lines.withColumn("t", clean("text")).filter(looks_like_label(F.col("t"))).withColumn("up", up)
    labels = labels.join(excluded.select(*PAGE, F.col("text").alias("up")).distinct(), [*PAGE, "up"], "left_anti").select(*PAGE, "line_ord", "t", F.col("bbox").alias("__l"))
    met = groups.select(*PAGE, key, F.col("bbox").alias("__g")).join(labels, PAGE)
    above = F.col("__g.y0") - center_y("__l")
    overlap = F.least("__l.x1", "__g.x1") - F.greatest("__l.x0", "__g.x0")
    width = F.greatest(F.col("__g.x1") - F.col("__g.x0"), F.lit(1e-6))
    score = above + 0.5 * F.abs(center_x("__l") - center_x("__g")) / width * LABEL_ABOVE
    best = met.filter((above > 0) & (above <= LABEL_ABOVE) & (overlap > 0)).groupBy(*PAGE, key).agg(F.min_by(F.struct("t", "__l"), F.struct(score, F.col("line_ord"))).alias("b"))
    return best.select(*PAGE, key, F.col("b.t").alias("label"), F.col("b.__l").alias("label_bbox"))


def key_labels(items: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """The box of the line that prints an item's label: equal text, else text that holds or is held by it, the closer in length the better, then the nearer in height. items: doc_id, page, key, label, bbox."""
    i = items.select(*PAGE, key, F.upper(clean("label")).alias("k"), center_y("bbox").alias("cy")).filter(F.length("k") >= 3)
    l = lines.select(*PAGE, "line_ord", F.upper(clean("text")).alias("t"), F.col("bbox").alias("__l")).filter("t <> ''")  # noqa: E741
    a, b = F.length("t"), F.length("k")
    met = i.join(l, PAGE).filter(F.contains("t", F.col("k")) | F.contains("k", F.col("t")))
    rank = F.struct((F.least(a, b) / F.greatest(a, b)), -F.abs(center_y("__l") - F.col("cy")), -F.col("line_ord"))
    return met.groupBy(*PAGE, key).agg(F.max_by("__l", rank).alias("label_bbox"))


def checkbox_clusters(boxes: DataFrame) -> DataFrame:
    """Adds cluster, the least kv_ord of the boxes that hang together: side by side in a row, or one above the other in a column. boxes: doc_id, page, kv_ord, bbox."""

    def run(rows: list[dict]) -> list[dict]:
        boxes = [(b["x0"], b["x1"], (b["y0"] + b["y1"]) / 2) for b in (r["bbox"] for r in rows)]
        # only boxes of nearly one height can hang together, so each looks back over those
        order = sorted(range(len(boxes)), key=lambda i: boxes[i][2])
        root = list(range(len(boxes)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for n, i in enumerate(order):
            for j in reversed(order[:n]):
                dy = boxes[i][2] - boxes[j][2]
                if dy > max(SAME_ROW, COLUMN_STEP):
                    break
                apart = max(boxes[i][0], boxes[j][0]) - min(boxes[i][1], boxes[j][1])
                side = dy <= SAME_ROW and apart <= ROW_GAP
                stacked = dy <= COLUMN_STEP and apart <= COLUMN_SHIFT and abs(boxes[i][0] - boxes[j][0]) <= COLUMN_SHIFT
                if side or stacked:
                    a, b = top(i), top(j)
                    root[max(a, b)] = min(a, b)
        return [{**r, "cluster": rows[top(i)]["kv_ord"]} for i, r in enumerate(rows)]

    return by_group(boxes, PAGE, ["kv_ord"], run, StructType([*boxes.schema.fields, StructField("cluster", IntegerType())]))


def union_box(b: str) -> Column:
    return F.struct(F.min(f"{b}.x0").alias("x0"), F.min(f"{b}.y0").alias("y0"), F.max(f"{b}.x1").alias("x1"), F.max(f"{b}.y1").alias("y1"))


def row_groups(items: DataFrame, keys: list[str], y: str, order: list[str], tolerance: float = COMPOSITE_ROW) -> DataFrame:
    """Adds row_no: from the top, each item opens a row unless it lies within tolerance of the item that opened the last one. A fold: a row reaches from its first item only, it does not chain."""
    sorted_ = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(y).alias("y"), *order))).alias("s"))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        opens = acc["top"].isNull() | (x["y"] - acc["top"] > tolerance)
        n = acc["n"] + opens.cast("int")
        return F.struct(F.when(opens, x["y"]).otherwise(acc["top"]).alias("top"), n.alias("n"), F.concat(acc["out"], F.array(n)).alias("out"))

    numbered = sorted_.withColumn("n", F.aggregate("s", start, step, lambda acc: acc["out"]))
    return numbered.select(*keys, F.explode(F.arrays_zip("s", "n")).alias("z")).select(*keys, *(F.col(f"z.s.{o}").alias(o) for o in order), F.col("z.n").alias("row_no"))


def structure(kv_pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Fields of each page (schema FIELDS): checkbox groups, single texts, and composites of texts in one row, in reading order."""
    bands = margin_bands(lines)
    state = kv_pairs.withColumn("selected", is_selected(F.col("value"))).withColumn("cy", center_y("bbox")).withColumn("cx", center_x("bbox"))
    boxes = state.filter("selected is not null").withColumn("option", clean("key"))
    texts = state.filter("selected is null").withColumn("k", clean("key")).withColumn("v", clean("value"))
    excluded = bands.select(*PAGE, F.upper("text").alias("text")).unionByName(wide_headers(lines).select(*PAGE, F.upper("text").alias("text"))).unionByName(boxes.select(*PAGE, F.upper("option").alias("text"))).distinct()

    child = f"struct<label:string,value:string,selected:boolean,bbox:{BOX}>"
    clustered = checkbox_clusters(boxes.select(*PAGE, "kv_ord", "bbox", "option", "selected", "confidence", "cy", "cx"))
    members = F.array_sort(F.collect_list(F.struct("cy", "cx", "kv_ord", "option", "selected", "bbox")))
    groups = clustered.groupBy(*PAGE, F.col("cluster").alias("g")).agg(members.alias("m"), union_box("bbox").alias("bbox"), F.round(F.min("confidence"), 4).alias("confidence"))
    groups = groups.withColumn("kind", F.lit("checkbox_group")).withColumn("cy", center_y("bbox")).select(
        *PAGE, "g", "kind", "cy", "bbox", "confidence", F.col("m")[0]["option"].alias("own_key"), serialize_options(F.col("m")).alias("value_text"), F.lit(None).cast("array<struct<key:string,value:string>>").alias("value_parts"),
        F.transform("m", lambda x: F.struct(x["option"].alias("label"), F.lit(None).cast("string").alias("value"), x["selected"].alias("selected"), x["bbox"].alias("bbox"))).cast(f"array<{child}>").alias("children"),
    )

    rowed = row_groups(texts, PAGE, "cy", ["cx", "kv_ord"]).select(*PAGE, "kv_ord", "row_no").join(texts, [*PAGE, "kv_ord"])
    across = F.array_sort(F.collect_list(F.struct("cx", "kv_ord", "k", "v", "bbox")))
    first = F.min_by("cy", F.struct("cy", "cx", "kv_ord"))
    rows = rowed.groupBy(*PAGE, "row_no").agg(across.alias("m"), union_box("bbox").alias("bbox"), F.min("confidence").alias("c"), first.alias("cy"), F.min("kv_ord").alias("g"))
    single = F.size("m") == 1
    rows = rows.select(
        *PAGE, "g", F.when(single, "text").otherwise("composite").alias("kind"), "cy", "bbox", F.when(single, F.col("c")).otherwise(F.round("c", 4)).alias("confidence"), F.when(single, F.col("m")[0]["k"]).alias("own_key"), F.when(single, F.col("m")[0]["v"]).alias("value_text"),
        F.when(~single, F.transform("m", lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value")))).alias("value_parts"),
        F.when(~single, F.transform("m", lambda x: F.struct(x["k"].alias("label"), x["v"].alias("value"), F.lit(None).cast("boolean").alias("selected"), x["bbox"].alias("bbox")))).cast(f"array<{child}>").alias("children"),
    )

    all_ = groups.unionByName(rows)
    above = parent_labels(all_.filter("kind <> 'text'"), lines, excluded, "g")
    beside = key_labels(all_.filter("kind = 'text'").withColumn("label", F.col("own_key")), lines, "g").select(*PAGE, "g", F.col("label_bbox").alias("own_box"))
    out = all_.join(sections_of(all_, bands, "g"), [*PAGE, "g"], "left").join(above, [*PAGE, "g"], "left").join(beside, [*PAGE, "g"], "left")
    key = F.when(F.col("kind") == "checkbox_group", F.coalesce("label", "own_key")).when(F.col("kind") == "text", F.col("own_key"))
    order = Window.partitionBy("doc_id").orderBy("page", "bbox.y0", "bbox.x0", "g")
    return out.select(
        "doc_id", (F.row_number().over(order) - 1).alias("field_ord"), "page", "kind", "section", "subsection", key.alias("key"), "value_text", "value_parts", "bbox", F.when(F.col("kind") == "text", F.col("own_box")).otherwise(F.col("label_bbox")).alias("label_bbox"), "confidence", "children"
    )


def is_part_label(c: Column) -> Column:
    """Whether a key, or what stands before its first " OF ", names a part of a name, an address or a date."""
    k = F.regexp_replace(F.upper(clean(c)), r"^[:.\-]+|[:.\-]+$", "")
    return (k != "") & (k.isin(*PART_WORDS) | F.trim(F.split(k, " OF ")[0]).isin(*PART_WORDS))


def split_composites(fields: DataFrame) -> DataFrame:
    """Composites with a key that names no part become one text field for each part, in reading order."""
    named = F.filter(F.coalesce("value_parts", F.array().cast("array<struct<key:string,value:string>>")), lambda p: clean(p["key"]) != "")
    apart = (F.col("kind") == "composite") & (F.size("value_parts") >= 2) & (F.size(named) > 0) & F.exists(named, lambda p: ~is_part_label(p["key"]))
    marked = fields.withColumn("__split", F.coalesce(apart, F.lit(False)))
    whole = marked.filter("not __split").withColumn("__sub", F.lit(0)).drop("__split")
    each = marked.filter("__split").withColumn("__n", named).select("*", F.posexplode("__n").alias("__sub", "__p"))
    own = F.filter("children", lambda c: F.upper(clean(c["label"])) == F.upper(clean(F.col("__p.key"))))
    parts = each.withColumn("kind", F.lit("text")).withColumn("key", clean("__p.key")).withColumn("value_text", clean("__p.value")).withColumn("bbox", F.coalesce(F.get(own, F.lit(0))["bbox"], F.col("bbox")))
    empty = {f.name: f.dataType for f in fields.schema}
    parts = parts.withColumn("value_parts", F.lit(None).cast(empty["value_parts"])).withColumn("children", F.lit(None).cast(empty["children"])).select(*fields.columns, "__sub")
    order = Window.partitionBy("doc_id").orderBy("page", "bbox.y0", "bbox.x0", "field_ord", "__sub")
    return whole.unionByName(parts).withColumn("__o", F.row_number().over(order) - 1).withColumn("field_ord", F.col("__o")).drop("__o", "__sub")


def nearby_labels(items: DataFrame, lines: DataFrame, key: str, most: int = 8, above: float = 0.08) -> DataFrame:
    """The texts printed at or above each item that reach over it, each once, the nearest first, at most that many: key, texts. items: doc_id, page, key, bbox."""
    i = items.select(*PAGE, key, F.col("bbox").alias("__b"))
    l = lines.select(*PAGE, "line_ord", clean("text").alias("t"), F.col("bbox").alias("__l")).filter("t <> ''")  # noqa: E741
    up = F.col("__b.y0") - F.col("__l.y0")
    met = i.join(l, PAGE).filter((F.col("__l.x1") >= F.col("__b.x0") - 0.02) & (F.col("__l.x0") <= F.col("__b.x1") + 0.02) & up.between(-0.01, above))
    once = met.groupBy(*PAGE, key, "t").agg(F.min(F.struct(F.abs(up).alias("d"), "line_ord")).alias("at"))
    at = Window.partitionBy(*PAGE, key).orderBy("at.d", "at.line_ord")
    first = once.withColumn("n", F.row_number().over(at)).filter(F.col("n") <= most)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"])
    return first.groupBy(*PAGE, key).agg(texts.alias("texts"))


def marks_with_words(marks: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """The marks of each picture as "label:state, ...": a label is the words on the mark's line from the mark to the next one, or "?". marks: keys, mark_ord, state, cx, cy, h; words: keys, text, x0, cy."""
    tolerance = F.greatest(F.lit(0.02), F.col("h") * 0.9)
    others = marks.select(*keys, F.col("mark_ord").alias("o"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    after = (F.col("ox") > F.col("cx")) & (F.abs(F.col("oy") - F.col("cy")) <= tolerance) & (F.col("o") != F.col("mark_ord"))
    bounded = marks.join(others, keys, "left").groupBy(*keys, "mark_ord", "state", "cx", "cy", "h").agg(F.min(F.when(after, F.col("ox"))).alias("edge"))
    w = words.select(*keys, F.col("text").alias("w"), F.col("x0").alias("wx"), F.col("cy").alias("wy"))
    on = (F.abs(F.col("wy") - F.col("cy")) <= tolerance) & (F.col("wx") >= F.col("cx")) & (F.col("edge").isNull() | (F.col("wx") < F.col("edge")))
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("wx", "w")))), lambda x: x["w"]), " ")
    labelled = bounded.join(w, keys, "left").groupBy(*keys, "mark_ord", "state", "cx", "cy").agg(label.alias("label"))
    shown = F.concat_ws(":", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("?")), "state")
    row = F.array_sort(F.collect_list(F.struct(F.round("cy", 2).alias("y"), "cx", "mark_ord", shown.alias("s"))))
    return labelled.groupBy(*keys).agg(F.array_join(F.transform(row, lambda x: x["s"]), ", ").alias("text"))
