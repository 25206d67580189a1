"""The best labels of a dictionary for names: candidates by shared pieces, then a score of several likenesses and bonuses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import analysis as A, medicines as M, strings as T

SIZE = 3
BONUS = {"english": 25, "piece": 15, "ending": 20}
#: Endings of names and what a label must hold then; the first ending that a name has and whose word the label holds counts.
BONUS_ENDINGS = [("ゾラム", "alprazolam"), ("パム", "pam"), ("ラム", "lam")]


def pieces(c: Column) -> Column:
    """The distinct pieces of SIZE characters of a text, in lower case; a shorter text is one piece."""
    return F.array_distinct(F.when(F.length(c) < SIZE, F.array(F.lower(c))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - SIZE + 1, F.lit(1))), lambda i: F.lower(F.substring(c, i, F.lit(SIZE))))))


def label_score(name: Column, english: Column, label: Column) -> Column:
    """The best of five ratios, plus bonuses for an English name, a shared piece of a name of over SIZE characters, and an ending."""
    low, has = F.lower(name), F.lower(label)
    best = F.greatest(T.char_overlap_ratio(low, has), T.partial_ratio(low, has), T.token_sort_ratio(low, has), T.token_set_ratio(low, has), T.char_overlap_ratio(F.lower(M.katakana(name)), has))
    said = F.exists(english, lambda e: F.contains(has, F.lower(e)))
    shared = (F.length(name) > SIZE) & F.exists(pieces(name), lambda g: F.contains(has, g))
    ending = F.lit(False)
    for end, word in BONUS_ENDINGS:
        ending = ending | (F.endswith(name, F.lit(end)) & F.contains(has, F.lit(word)))
    points = lambda test, what: F.when(test, BONUS[what]).otherwise(0)
    return (best + points(said, "english") + points(shared, "piece") + points(ending, "ending")).cast("long")


def best_labels(names: DataFrame, labels: DataFrame) -> DataFrame:
    """names (name), labels (id, label) -> (name, id, label, score): the label with the highest score for each name that has a candidate.

    Candidates share a piece with the name or with one of its English names; labels with a word of NO_MEDICINES are none.
    Ties go to the smallest label, then id. Equal names are scored once, and equal labels by their smallest id, so the
    work follows the different texts. A null name or label has no candidates.
    """
    asked = names.select("name").distinct().withColumn("english", A.english_names(F.col("name")))
    no_medicine = F.lower("label").rlike("|".join(map(re.escape, A.NO_MEDICINES)))
    known = labels.where(~no_medicine).groupBy("label").agg(F.min("id").alias("id"))
    own = F.flatten(F.transform(F.concat(F.array(F.col("name")), F.col("english")), pieces))
    left = asked.select("name", "english", F.explode(F.array_distinct(own)).alias("piece"))
    right = known.select("id", "label", F.explode(pieces(F.col("label"))).alias("piece"))
    pairs = left.join(right, "piece").select("name", "english", "id", "label").distinct()
    scored = pairs.withColumn("score", label_score(F.col("name"), F.col("english"), F.col("label")))
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("less"), "label", "id")).alias("b"))
    return best.select("name", "b.id", "b.label", (-F.col("b.less")).alias("score"))
