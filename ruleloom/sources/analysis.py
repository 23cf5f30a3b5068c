"""Saved layout analyses: JSON documents with key-value pairs and lines, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import from_array
from ..functions.text import clean

ANALYSIS = (
    "full_text string, pages int, page_sizes map<string,array<double>>, "
    "key_value_pairs array<struct<page:int,key:string,value:string,is_checkbox:boolean,bbox:array<double>,value_bbox:array<double>,confidence:double>>, "
    "lines array<struct<page:int,text:string,bbox:array<double>>>, "
    "styles array<struct<offset:int,length:int,font_family:string,font_style:string,font_weight:string,color:string,background_color:string,is_handwritten:boolean,confidence:double>>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each analysis file: doc_id (the path), content_key (for what was seen before) and the parsed columns."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), "value")
    return parse(files)


def content_key(value):
    """What tells one content from another: the first sixteen hex digits of its MD5."""
    return F.substring(F.md5(value), 1, 16)


def parse(texts: DataFrame) -> DataFrame:
    """doc_id, value (JSON text) -> doc_id, content_key and the analysis' columns."""
    parsed = texts.select("doc_id", content_key("value").alias("content_key"), F.from_json("value", ANALYSIS).alias("a"))
    return parsed.select("doc_id", "content_key", "a.*")


def kv_pairs(analyses: DataFrame) -> DataFrame:
    each = analyses.select("doc_id", F.posexplode("key_value_pairs").alias("kv_ord", "kv"))
    zero = F.array(*[F.lit(0.0)] * 4)
    bbox = F.coalesce("kv.bbox", zero)
    return each.select(
        "doc_id", F.coalesce("kv.page", F.lit(1)).alias("page"), "kv_ord", clean("kv.key").alias("key"), F.coalesce("kv.value", F.lit("")).alias("value"), from_array(bbox).alias("bbox"), from_array(F.coalesce("kv.value_bbox", bbox)).alias("value_bbox"), F.col("kv.confidence").alias("confidence")
    )


def lines(analyses: DataFrame) -> DataFrame:
    each = analyses.select("doc_id", F.posexplode("lines").alias("line_ord", "l"))
    return each.select("doc_id", F.coalesce("l.page", F.lit(1)).alias("page"), "line_ord", clean("l.text").alias("text"), from_array("l.bbox").alias("bbox")).filter("text <> '' and bbox is not null")


def page_sizes(analyses: DataFrame) -> DataFrame:
    each = analyses.select("doc_id", F.explode("page_sizes").alias("page", "size"))
    return each.select("doc_id", F.col("page").try_cast("int").alias("page"), F.col("size")[0].alias("width"), F.col("size")[1].alias("height"))


def element_counts(analyses: DataFrame) -> DataFrame:
    """How many pairs, checkboxes among them, lines, styles and pages each analysis has."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    pairs = F.coalesce("key_value_pairs", F.array())
    return analyses.select("doc_id", size(pairs).alias("n_pairs"), F.size(F.filter(pairs, lambda p: F.coalesce(p["is_checkbox"], F.lit(False)))).alias("n_checkboxes"), size(F.coalesce("lines", F.array())).alias("n_lines"), size(F.coalesce("styles", F.array())).alias("n_styles"), F.coalesce("pages", F.lit(0)).alias("n_pages"))


def dump(analyses: DataFrame) -> DataFrame:
    """doc_id and the whole analysis as one JSON text."""
    return analyses.select("doc_id", F.to_json(F.struct(*(c for c in analyses.columns if c not in ("doc_id", "content_key")))).alias("json"))


def longer_text(service: str, native: str):
    """The native text of a file where it is longer than the service's."""
    a, b = F.coalesce(F.col(service), F.lit("")), F.coalesce(F.col(native), F.lit(""))
    return F.when(F.length(b) > F.length(a), b).otherwise(a)


def style_of_values(values: DataFrame, styles: DataFrame) -> DataFrame:
    """values (doc_id, value_id, start, stop) with the attributes of the styles (doc_id, style_ord, start, stop, ...) that overlap them; of several, the last one that has the attribute. Bold and italic are unknown where nothing says."""
    s = styles.select("doc_id", "style_ord", F.col("start").alias("s0"), F.col("stop").alias("s1"), "font_family", "font_style", "font_weight", "color")
    met = values.join(s, "doc_id", "left").withColumn("on", (F.col("start") < F.col("s1")) & (F.col("s0") < F.col("stop")))

    def last(name: str):
        return F.max_by(F.when(F.col("on"), F.col(name)), F.when(F.col("on") & F.col(name).isNotNull(), F.col("style_ord"))).alias(name)

    out = met.groupBy("doc_id", "value_id").agg(*(last(n) for n in ("font_family", "font_style", "font_weight", "color")))
    bold, italic = F.lower("font_weight"), F.lower("font_style")
    return out.withColumn("is_bold", F.when(bold.isNotNull(), bold == "bold")).withColumn("is_italic", F.when(italic.isNotNull(), italic == "italic"))
