"""Queries on what comes out of extraction: candidates, names that are mixed up, suggestions, tags of items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes as C, medicines as M, steps as S
from ..operators import knowledge as K, normalize, validation as V
from .pool import NAMES_SQL, names, per_name, picked
from .record_queries import EXISTS_SQL
from .registry import query
from .risk_queries import TAG_SQL

Q = S.quoted
CONFIDENCE_SQL = "0.7 + (k % 4) * 0.1"


@query("validated_candidates", EXISTS_SQL + f", v AS (SELECT *, round({CONFIDENCE_SQL}, 2) AS confidence FROM x JOIN (SELECT k AS k2, name AS n2 FROM nm) ON k = k2) SELECT k, CASE WHEN reason = 'known_bad' THEN fix ELSE n2 END AS text, confidence, CASE WHEN reason = 'known_bad' THEN n2 END AS original, CASE WHEN reason = 'known_bad' THEN reason END AS reason FROM v WHERE confidence >= {V.SURE} AND length(n2) >= 2 AND regexp_matches(n2, {Q(M.SOME_PATTERN)}) AND reason IN ('passed', 'known_bad')", with_mentions=False)
def _(spark, sf):
    """Sure candidates that look like a name and exist, or what they are corrected to."""
    rows = names(spark, sf).withColumn("confidence", F.round(0.7 + (F.col("k") % 4) * 0.1, 2)).withColumnRenamed("name", "text")
    return V.validated_candidates(rows, F.col("text").isin(*C.ENGLISH)).drop("maker")


BRANDS = ["アスパラＣＡ錠", "アスパラ CA", "アスパラ-K錠", "ロキソニンテープ", "デビゴ", "", "アムロジピン"]
BOTH_SQL = "brand || ' ' || name"


@query("names_told_apart", f"WITH {NAMES_SQL}, {S.values_sql('br', 'bi, brand', list(enumerate(BRANDS)))}, b AS (SELECT k, name, brand FROM nm JOIN br ON bi = k % {len(BRANDS)}) SELECT k, CASE " + " ".join(f"WHEN regexp_matches({BOTH_SQL}, {Q(p)}) THEN {Q(v)}" for p, v in V.MIXED_UP) + f" ELSE name END AS name, coalesce({S.first_contained_sql('name', V.GENERIC_OF)}, name) AS generic FROM b", with_mentions=False)
def _(spark, sf):
    """Names that brand or raw text tells apart, and the generic names of brands."""
    brand = picked(BRANDS, F.col("k"))
    return names(spark, sf).select("k", V.told_apart(F.col("name"), brand, F.col("name")).alias("told"), V.generic_name(F.col("name")).alias("generic")).withColumnRenamed("told", "name")


SUGGESTED = [(k, v, "known_bad", 0.95, 0) for k, v in C.KNOWN_BAD.items()] + [(k, right, "candidate", sure, i) for k, found in normalize.CANDIDATES.items() for i, (right, sure) in enumerate(found, 1)]


@query("correction_suggestions", f"WITH {NAMES_SQL}, {S.values_sql('s', 'name, corrected, reason, confidence, place', SUGGESTED)} SELECT k, string_agg(corrected || ':' || reason || ':' || CAST(round(100 * confidence) AS INTEGER), '|' ORDER BY confidence DESC, place, corrected) AS suggestions FROM nm JOIN s USING (name) GROUP BY k", with_mentions=False)
def _(spark, sf):
    """What a name may be meant for, surest first."""
    said = F.transform(V.suggestions(F.col("name")), lambda x: F.concat_ws(":", x.corrected, x.reason, F.round(100 * x.confidence).cast("int").cast("string")))
    return per_name(names(spark, sf), lambda d: d.select("name", said.alias("s"))).where("size(s) > 0").select("k", F.array_join("s", "|").alias("suggestions"))


ITEM_SQL = "CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'タケキャブ錠' ELSE 'センナ・アスピリン' END"


@query("item_tags", f"WITH {NAMES_SQL}{TAG_SQL}, a AS (SELECT k, unnest([name, {ITEM_SQL}, 'ニフェジピン']) AS said FROM nm), pt AS (SELECT DISTINCT k, unnest(regexp_split_to_array(said, '[・/＋+\\s　]')) AS part FROM a WHERE said IS NOT NULL), ti AS (SELECT DISTINCT k, tag FROM pt JOIN tg ON part = key OR (part NOT IN (SELECT key FROM tg) AND contains(part, key)) WHERE part <> '') SELECT k, string_agg(tag, ',' ORDER BY tag) AS tags FROM ti GROUP BY k", with_mentions=False)
def _(spark, sf):
    """The tags of all three names of an item."""
    k = F.col("k")
    brand = F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, "タケキャブ錠").otherwise("センナ・アスピリン")
    rows = names(spark, sf).withColumn("brand", brand)
    tags = lambda d: d.withColumn("tags", F.array_join(K.tags_of_item(F.col("name"), F.col("brand"), F.lit("ニフェジピン")), ","))
    known = tags(rows.select("name", "brand").distinct())
    return rows.join(known, rows["name"].eqNullSafe(known["name"]) & rows["brand"].eqNullSafe(known["brand"])).select("k", known["tags"])
