"""The whole way of a prescription's text: blocks, lines, attributes, noise, duplicates, report, quality gate, rendering.

Each step is a DataFrame transformation, over all texts at once; a text's items are some tens. A text that is null, empty
or without a form word has no items and a failed gate; repeated rows of one rx_id are read as one text after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import attributes as A, classes as C, names as N, steps as S, texts as T
from ..functions.strings import first_text
from ..operators import dedupe, gates, interactions, rules
from ..operators.lookup import each_once
from ..streaming.buffer import written

KINDS = "般|外|麻|向"


def line_lists(texts: DataFrame) -> DataFrame:
    """texts (rx_id, text) -> rx_id, lines: of each text the lines with a form word, an array of (pos, raw)."""
    whole = F.array(F.struct(F.lit(0).alias("number"), F.col("text").alias("content")))
    blocks = T.let(T.numbered_blocks(F.col("text"), KINDS), lambda b: F.when(F.size(b) > 0, b).otherwise(whole))
    of_block = lambda b: F.transform(F.split(b.content, "\n"), lambda raw, n: F.struct((b.number.cast("long") * 1000 + n).alias("pos"), raw.alias("raw")))
    own = F.filter(F.flatten(F.transform(blocks, of_block)), lambda x: A.has_form_word(x.raw))
    return texts.select("rx_id", F.coalesce(own, F.array().cast("array<struct<pos:bigint,raw:string>>")).alias("lines"))


def lines(texts: DataFrame) -> DataFrame:
    """texts (rx_id, text) -> rx_id, pos, raw: a row for each line with a form word."""
    return line_lists(texts).select("rx_id", F.inline("lines"))


def attributes(raws: DataFrame) -> DataFrame:
    """raws (raw) -> raw, generic (null for noise), form, strength, dose, freq, days, route, confidence."""
    c = F.col("raw")
    generic = F.trim(T.found(A.item_name(c), r"\A\S+"))
    rows = raws.select("raw", F.when(~N.is_noise(generic), N.generic_name(generic)).alias("generic"), A.form(c).alias("form"), A.strength(c).alias("strength"), A.dose(c).alias("dose"), A.frequency(c).alias("freq"), T.first_integer(T.found(c, r"\d+\s*日分")).alias("days"))
    sure = 0.5 + 0.3 * F.col("strength").isNotNull().cast("int") + 0.2 * F.col("freq").isNotNull().cast("int")
    return rows.withColumn("route", N.route(c)).withColumn("confidence", F.round(sure, 2))


def items(texts: DataFrame) -> DataFrame:
    """texts (rx_id, text) -> a row for each line with a form word: rx_id, pos, raw, generic, form, strength, dose, freq, days, route, confidence."""
    rows = lines(texts)
    known = each_once(rows, ["raw"], attributes).where("generic IS NOT NULL")
    return rows.join(known, "raw").select("rx_id", "pos", *known.columns)


def _key():
    return N.same_key(F.col("generic"), F.col("raw"), F.col("route"))


def distinct_items(rows: DataFrame) -> DataFrame:
    """The best mention of each medicine and route, in the place of its first."""
    best = F.col("strength").isNotNull().cast("int") + F.col("confidence")
    return dedupe.best_per_key(rows.withColumn("key", _key()), ["rx_id", "key"], [F.desc(best), F.col("pos"), F.col("raw")], "pos").drop("key")


def judged_lines(raws: DataFrame) -> DataFrame:
    """raws (raw) -> what the gate and the report need of a line: key, known, best, confidence, classified, no_id, name, shown, marks (null without classes); key is null for noise."""
    name = first_text("generic", "raw")
    classified = S.mapped(F.col("name"), C.CLASS_OF).isNotNull() | S.mapped(F.col("name"), C.FALLBACK).isNotNull()
    rows = attributes(raws).withColumn("name", name).withColumn("tags", interactions.class_tags(F.col("name")))
    known = F.col("strength").isNotNull()
    return rows.select(
        "raw", F.when(F.col("generic").isNotNull(), _key()).alias("key"), known.alias("known"), (known.cast("int") + F.col("confidence")).alias("best"), "confidence", classified.alias("classified"), S.mapped(F.col("name"), C.ENGLISH).isNull().alias("no_id"),
        "name", N.shown(F.col("name")).alias("shown"), F.when(F.size("tags") > 0, interactions.MARKS.of(F.col("tags"))).alias("marks"),
    )


def diagnose(texts: DataFrame) -> DataFrame:
    """texts (rx_id, text) -> rx_id, n_items, issues, passed, retry, human, strategy, report (findings by priority, one a line; empty if none), for every text.

    An item is known if it has a strength, classified if the dictionary has its class, and has an id if its name can be
    looked up. Texts are cut into lines once, and each different line is read once. Both tables are written to the shared
    folder: the first as it is read twice, the second so that Spark knows its size before the join: a short one goes to
    all tasks, a long one is shuffled. The lines of a text are gathered once; the best mention of each medicine and
    route, the gate and the report come from the same row.
    """
    lists = written(line_lists(texts), "texts")
    rows = lists.select("rx_id", F.inline("lines"))
    rows = rows.join(written(each_once(rows, ["raw"], judged_lines), "lines"), "raw")
    mention = F.struct("key", (-F.col("best")).alias("worse"), "pos", "raw", "known", "confidence", "classified", "no_id", "name", "shown", "marks")
    mention = F.when(F.col("key").isNotNull(), mention).alias("mention")
    without = lists.where(F.size("lines") == 0).select("rx_id", F.lit(None).cast(rows.select(mention).schema[0].dataType).alias("mention"))
    g = rows.select("rx_id", mention).union(without).groupBy("rx_id").agg(F.sort_array(F.collect_list("mention")).alias("all"))
    g = g.select("rx_id", F.filter("all", lambda x, i: (i == 0) | (x.key != F.col("all")[F.greatest(i - 1, F.lit(0))].key)).alias("best"))
    marked = F.transform(F.filter("best", lambda x: x.marks.isNotNull()), lambda x: F.struct(x["name"].alias("name"), x.shown.alias("shown"), x.marks.alias("marks")))
    g = g.select("rx_id", *gates.measures_of(F.col("best")), F.sort_array(F.array_distinct(marked)).alias("items"))
    g = g.withColumn("have", interactions.MARKS.held_by(F.col("items")))
    report = F.when(F.size("items") > 0, interactions.report_lines()).otherwise("")
    return g.select("rx_id", F.col("n").cast("long").alias("n_items"), *gates.judged(), report.alias("report"))
