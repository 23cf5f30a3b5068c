"""Hooks for outside services: text recognition and language models. Without a provider nothing is called and nothing changes.

A provider is a function from a list of requests to a list of answers of the same length, null where it has none. It is
called within each partition, at most batch requests at a time. What it answers is checked here before it counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, norm
from ..functions.values import is_placeholder, parse_example
from .rules import append_text, attach_images, classify

Provider = Callable[[list[dict]], list]

FIELD_BATCH, PAIR_BATCH = 120, 200


def ask(requests: DataFrame, keys: list[str], provider: Provider | None, answer: str, batch: int = FIELD_BATCH, calls: int | None = None) -> DataFrame:
    """requests with a column "answer" of the given type. calls bounds how many partitions, and so calls, run side by side. A provider that fails, or answers too few, gives nulls and an error text."""
    if provider is None:
        return requests.withColumn("answer", F.lit(None).cast(answer)).withColumn("error", F.lit(None).cast("string"))
    spread = requests.repartition(calls, *keys) if calls else requests
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + f", answer {answer}, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                try:
                    answers, error = list(provider(part.to_dict("records"))), None
                    if len(answers) != len(part):
                        answers, error = [None] * len(part), f"{len(answers)} answers to {len(part)} requests"
                except Exception as e:  # noqa: BLE001  a service's failure is an answer here, not this job's end
                    answers, error = [None] * len(part), f"{type(e).__name__}: {e}"
                yield part.assign(answer=pd.Series(answers, index=part.index, dtype=object), error=error)

    return spread.mapInPandas(run, schema)


def instruction_requests(bound: DataFrame) -> DataFrame:
    """What a model is asked about each bound value that has an instruction and is not a checkbox group. The unknown rule goes along for placeholders only."""
    unknown = is_placeholder("value")
    asked = bound.filter((F.coalesce("kind", F.lit("")) != "checkbox_group") & ((clean("instruction") != "") | (clean("if_unknown") != "")))
    return asked.select("doc_id", "rule_id", "item", clean("instruction").alias("instruction"), "value", "example", "max_chars", unknown.alias("is_unknown"), F.when(unknown, clean("if_unknown")).otherwise("").alias("if_unknown"))


def instruction_verdicts(bound: DataFrame, provider: Provider | None, calls: int = 6) -> DataFrame:
    """doc_id, rule_id, verdict, reason; a verdict counts if it is pass, fail or unsure."""
    answered = ask(instruction_requests(bound), ["doc_id", "rule_id"], provider, "struct<verdict:string,reason:string>", calls=calls)
    verdict = F.lower(F.col("answer.verdict"))
    return answered.select("doc_id", "rule_id", F.when(verdict.isin("pass", "fail", "unsure"), verdict).alias("verdict"), F.col("answer.reason").alias("reason"))


def accepted_option(answer: Column, held: Column) -> Column:
    """A label counts if it is one of those held."""
    return F.when(F.array_contains(held, answer), answer)


def accepted_key(answer: Column, candidates: Column, options: Column) -> Column:
    """A key counts if it is one of the candidates, word for word, and not an option."""
    return F.when(F.array_contains(candidates, answer) & ~F.array_contains(F.transform(options, F.upper), F.upper(answer)), answer)


def key_on_page(key: Column, page_texts: Column) -> Column:
    """Whether a key stands in one of the page's lines, or runs over several."""
    tidy = lambda c: F.lower(clean(c))
    k = tidy(key)
    return (k != "") & (F.exists(page_texts, lambda t: F.contains(tidy(t), k)) | F.contains(tidy(F.array_join(page_texts, " ")), k))


def page_texts(lines: DataFrame) -> DataFrame:
    """doc_id, page, texts: the lines of each page in their order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_ord", clean("text").alias("t")))), lambda x: x["t"])
    return lines.filter(clean("text") != "").groupBy("doc_id", "page").agg(texts.alias("texts"))


def recognise_examples(rules: DataFrame, images: DataFrame, recogniser: Provider | None, calls: int = 4) -> DataFrame:
    """Adds what a recogniser reads in each rule's pictures to the rule's example, and parses the example again; the text itself is in "recognised", null where nothing was read.

    images: sheet, row0, image_ord, content. Texts of several pictures of a rule are joined in their order.
    """
    place = ["sheet", "row0", "image_ord"]
    requests = images.join(attach_images(rules, images), place).select(*place, "rule_id", "content")
    answered = ask(requests, place, recogniser, "string", calls=calls).withColumn("t", clean("answer")).filter("t <> ''")
    read = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row0", "image_ord", "t"))), lambda x: x["t"]), " ")
    joined = rules.join(answered.groupBy("sheet", "rule_id").agg(read.alias("recognised")), ["sheet", "rule_id"], "left")
    there = F.col("recognised").isNotNull()
    shown = joined.withColumn("__shown", F.when(there, parse_example("example", "recognised", True)))
    changes = {"expected_kind": F.col("__shown.kind"), "expected_options": F.col("__shown.options"), "example": append_text(F.col("example"), F.col("recognised"))}
    return shown.withColumns({c: F.when(there, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("__shown")


def reconstruct(fields: DataFrame, texts: DataFrame, provider: Provider | None) -> DataFrame:
    """Lets a model name sections and keys. Kinds, values, boxes and counts never change; a key is taken only if it stands on its page. texts: doc_id, page, texts, as from page_texts()."""
    asked = fields.join(texts, ["doc_id", "page"], "left")
    requests = asked.select("doc_id", "page", "field_ord", "kind", "section", "subsection", "key", "value_text", "texts")
    answered = ask(requests, ["doc_id", "page"], provider, "struct<kind:string,section:string,subsection:string,key:string>")
    sound = answered.filter(F.col("answer.kind").isin("text", "composite", "checkbox_group"))
    new = sound.select("doc_id", "field_ord", F.col("answer.section").alias("__s"), F.col("answer.subsection").alias("__u"), F.when(key_on_page(F.col("answer.key"), F.coalesce("texts", F.array().cast("array<string>"))), clean("answer.key")).alias("__k"))
    out = fields.join(new, ["doc_id", "field_ord"], "left")
    for c, n in (("section", "__s"), ("subsection", "__u"), ("key", "__k")):
        out = out.withColumn(c, F.coalesce(F.nullif(clean(n), F.lit("")), F.col(c)))
    return out.drop("__s", "__u", "__k")


def align_with_model(rows: DataFrame, provider: Provider | None) -> DataFrame:
    """Asks a model for those expected options that no held label fits: aligned with the labels that it names, if they are among those held and no other option has them.

    rows: doc_id, rule_id, item, aligned (array of option, label, state), held (array of label, state).
    """
    labels = F.transform("held", lambda h: h["label"])
    open_ = F.transform(F.filter("aligned", lambda a: a["label"].isNull()), lambda a: a["option"])
    requests = rows.select("doc_id", "rule_id", "item", open_.alias("options"), labels.alias("labels")).filter("size(options) > 0 and size(labels) > 0")
    answered = ask(requests, ["doc_id", "rule_id"], provider, "map<string,string>", batch=PAIR_BATCH).select("doc_id", "rule_id", F.col("answer").alias("__answer"))
    joined = rows.join(answered, ["doc_id", "rule_id"], "left")
    taken = F.transform("aligned", lambda a: a["label"])

    def option(a: Column) -> Column:
        named = accepted_option(F.try_element_at("__answer", a["option"]), F.array_except(labels, taken))
        state = F.get(F.filter("held", lambda h: h["label"] == named), F.lit(0))["state"]
        return F.struct(a["option"].alias("option"), F.coalesce(a["label"], named).alias("label"), F.coalesce(a["state"], state).alias("state"))

    return joined.withColumn("aligned", F.when(F.col("__answer").isNull(), F.col("aligned")).otherwise(F.transform("aligned", option))).drop("__answer")


def repair_keys(fields: DataFrame, candidates: DataFrame, provider: Provider | None) -> DataFrame:
    """Lets a model choose a checkbox group's key among the texts printed near it; the key stays where its choice is none of them, or is an option. candidates: doc_id, field_ord, texts."""
    options = F.transform(F.coalesce("children", F.array()), lambda c: c["label"])
    asked = fields.filter("kind = 'checkbox_group'").join(candidates, ["doc_id", "field_ord"]).select("doc_id", "field_ord", "key", options.alias("options"), "texts")
    answered = ask(asked, ["doc_id", "field_ord"], provider, "string", batch=PAIR_BATCH)
    chosen = answered.select("doc_id", "field_ord", accepted_key(F.col("answer"), F.col("texts"), F.col("options")).alias("__key"))
    return fields.join(chosen, ["doc_id", "field_ord"], "left").withColumn("key", F.coalesce("__key", "key")).drop("__key")


REPAIRABLE = ("item", "instruction", "example", "if_missing", "if_unknown")


def repair_rules(rules: DataFrame, issues: DataFrame, provider: Provider | None) -> DataFrame:
    """Lets a model correct the texts of rules with an issue; other texts stay. The original texts are kept in "original", and rules are typed anew."""
    flagged = issues.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_list("issue")), "; ").alias("issue"))
    requests = rules.join(flagged, "rule_id").select("rule_id", "issue", *REPAIRABLE)
    answered = ask(requests, ["rule_id"], provider, "struct<" + ",".join(f"{c}:string" for c in REPAIRABLE) + ">").select("rule_id", "answer")
    joined = rules.join(answered, "rule_id", "left").withColumn("original", F.when(F.col("answer").isNotNull(), F.struct(*REPAIRABLE)))
    for c in REPAIRABLE:
        joined = joined.withColumn(c, F.coalesce(F.col(f"answer.{c}"), F.col(c)))
    return classify(joined.drop("answer"))


def pair_findings(rows: DataFrame, provider: Provider | None, most: int = PAIR_BATCH) -> DataFrame:
    """A model's remarks on matched pairs, the first most of each document by rule: flags only, nothing else changes."""
    first = rows.filter("matched").withColumn("n", F.expr("row_number() over (partition by doc_id order by rule_id)")).filter(F.col("n") <= most)
    answered = ask(first.select("doc_id", "rule_id", norm("item").alias("item"), "di_value"), ["doc_id"], provider, "string", batch=most)
    return answered.filter("answer is not null").select("doc_id", "rule_id", F.col("answer").alias("finding"))


def recognition_metrics(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Of the pictures that a recogniser saw (keys, row0, text, mode, exact_row): all, those with text, those read as checkboxes, and the distinct rows of those that stand beside no rule's row."""
    lonely = F.count_distinct(F.when(~F.coalesce("exact_row", F.lit(False)), F.col("row0")))
    return evidence.groupBy(*keys).agg(F.count("*").alias("images_total"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("images_with_text"), F.count_if(F.col("mode") == "structured_checkbox").alias("checkbox_example_images"), lonely.alias("image_only_rows"))


ISSUES_AT_ONCE = 50


def explained(rows: DataFrame, provider: Provider | None) -> DataFrame:
    """doc_id, id, explanation: a model's words on each row, null without a provider."""
    return ask(rows.select("doc_id", "id", "item", "status", "message"), ["doc_id", "id"], provider, "string").select("doc_id", "id", F.col("answer").alias("explanation"))


def summarised(issues: DataFrame, provider: Provider | None, most: int = ISSUES_AT_ONCE) -> DataFrame:
    """doc_id, summary: a model's words on the first most issues (doc_id, issue_ord, issue) of each document."""
    first = issues.withColumn("n", F.expr("row_number() over (partition by doc_id order by issue_ord)")).filter(F.col("n") <= most)
    listed = first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "issue"))), lambda x: x["issue"]).alias("issues"))
    return ask(listed, ["doc_id"], provider, "string").select("doc_id", F.col("answer").alias("summary"))
