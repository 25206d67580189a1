"""The quality gate of whole baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Limits: share of items with an amount, share of classified items, confidence, number of items.
COVERAGE, CLASSIFIED, CONFIDENCE, FEWEST, MOST = 0.98, 0.90, 0.8, 1, 20


def measures(known: Column, classified: Column, no_id: Column) -> list[Column]:
    """What the gate judges, as aggregates over a basket's items (with confidence): n, coverage, classified, low, no_id."""
    n = F.count("*")
    return [n.alias("n"), (F.count_if(known) / n).alias("coverage"), (F.count_if(classified) / n).alias("classified"), F.count_if(F.col("confidence") < CONFIDENCE).alias("low"), F.count_if(no_id).alias("no_id")]


def measures_of(items: Column) -> list[Column]:
    """The same of a basket that is an array of items with confidence, known, classified and no_id; of an empty one all are 0."""
    n = F.size(items)
    count = lambda test: F.size(F.filter(items, test))
    share = lambda test: F.when(n > 0, count(test) / n).otherwise(0.0)
    return [n.alias("n"), share(lambda x: x.known).alias("coverage"), share(lambda x: x.classified).alias("classified"), count(lambda x: x.confidence < CONFIDENCE).alias("low"), count(lambda x: x.no_id).alias("no_id")]


def judged() -> list[Column]:
    """issues, passed, retry, human, strategy from the measures; of a basket without items n and both shares are 0."""
    thin, unclear, unsure, few, many = F.col("coverage") < COVERAGE, F.col("classified") < CLASSIFIED, F.col("low") > 0, F.col("n") < FEWEST, F.col("n") > MOST
    issues = F.concat_ws(",", F.when(thin, "low_coverage:high"), F.when(unclear, "low_classification:medium"), F.when(unsure, "low_confidence:medium"), F.when(few, "too_few:high"), F.when(many, "too_many:medium"), F.when(F.col("no_id") > 0, "missing_id:low"))
    strategy = F.concat_ws(",", F.when(thin | unsure, "extraction"), F.when(unclear, "classification"), F.when(unclear, "lookup"), F.when(thin | unsure, "alternative"))
    return [issues.alias("issues"), (~thin & ~few).alias("passed"), (thin | unclear | few).alias("retry"), (unsure | many).alias("human"), strategy.alias("strategy")]


def gate(items: DataFrame, known: Column, classified: Column, no_id: Column) -> DataFrame:
    """items (rx_id, confidence, and what the tests read) -> rx_id, issues, passed, retry, human, strategy.

    Issues are "kind:severity", joined by commas; only a high one fails the gate. Baskets without items don't appear.
    """
    return items.groupBy("rx_id").agg(*measures(known, classified, no_id)).select("rx_id", *judged())
