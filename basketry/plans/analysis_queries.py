"""Queries on the analysis of names: English names, category, confidence, search order, and the best labels of a dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import analysis as A, classes as C, medicines as M, steps as S
from ..operators import rerank
from ..sources.tables import read
from .name_queries import RATIO_SQL, SHORT_SQL
from .pool import POOL, picked
from .registry import query

Q = S.quoted
#: Names of every category in the places of parts, beside those of the pool.
MEDICINES = [*POOL, *(f"{name}錠10mg" for name in C.CATEGORIES), "アスピリン", "インスリン", "塩酸モルヒネ", "パム", "g"]
MEDICINES_SQL = S.values_sql("mp", "i, name", list(enumerate(MEDICINES))) + f", nm AS (SELECT p_partkey AS k, name FROM part JOIN mp ON i = p_partkey % {len(MEDICINES)}), dn AS (SELECT DISTINCT name FROM nm)"
list_sql = lambda xs: "CAST([" + ", ".join(map(Q, xs)) + "] AS VARCHAR[])"


def medicines(spark, sf):
    """k, name: a row for each part."""
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(k.alias("k"), picked(MEDICINES, k).alias("name"))


def once(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


def _ends(column: str, words, test: str) -> str:
    return "(" + " OR ".join(f"{test}({column}, {Q(w)})" for w in words) + ")"


RUNGS_SQL = "CASE " + " ".join(f"WHEN {S.any_of_sql('n', w)} THEN {Q(v)}" for w, v in reversed(A.FORCED)) + " " + " ".join(f"WHEN {S.any_of_sql('lower(n)', words)} THEN {Q(label)}" for label, words in C.LADDER) + " ELSE 'unknown' END"
ENGLISH_SQL = f"""en AS ({" UNION ALL ".join(f"SELECT {i} AS o, {Q(k)} AS key, {list_sql(v)} AS names" for i, (k, v) in enumerate(A.VARIANTS.items()))}),
made AS (SELECT name, n, {S.sql('n', M.PLAIN_STEPS)} AS plain, {RUNGS_SQL} AS category,
  coalesce((SELECT names FROM en WHERE key = n), []) || coalesce((SELECT flatten(list(names ORDER BY o)) FROM en WHERE contains(key, n) OR contains(n, key)), [])
  || CASE {" ".join(f"WHEN ends_with(n, {Q(e)}) THEN [lower(left(n, length(n) - {cut})) || {Q(word)}]" for e, cut, word in A.ENGLISH_ENDINGS)} ELSE [] END AS en0
  FROM (SELECT name, {SHORT_SQL} AS n FROM dn)),
eng AS (SELECT *, {once('en0')} AS english FROM made),
pts AS (SELECT *, least(CASE WHEN length(n) >= 4 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN category <> 'unknown' THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN length(plain) >= 3 THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN len(english) > 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN {_ends('n', A.ENDINGS, 'ends_with')} THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN {_ends('n', A.BEGINNINGS, 'starts_with')} THEN 0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE) AS conf FROM eng)"""
COMMON_SQL = "lower(x) IN (" + ", ".join(map(Q, A.COMMON)) + ")"
PRIORITY_SQL = f"""pr AS (SELECT *, CASE WHEN conf >= 0.4 THEN [n] ELSE [] END || CASE WHEN conf >= 0.5 THEN list_reverse(list_filter(english, lambda x: {COMMON_SQL})) ELSE [] END
  || CASE WHEN plain <> n AND conf >= 0.3 THEN [plain] ELSE [] END || CASE WHEN conf >= 0.5 THEN list_filter(english, lambda x: NOT {COMMON_SQL}) ELSE [] END AS p0,
  CASE WHEN conf >= 0.6 THEN CASE category {" ".join(f"WHEN {Q(k)} THEN {list_sql(v)}" for k, v in A.PATTERNS.items())} ELSE [] END ELSE [] END AS parts,
  CASE WHEN conf >= 0.7 THEN list_filter({list_sql(A.ENDINGS)}, lambda x: ends_with(n, x)) ELSE [] END AS ends FROM pts),
p1 AS (SELECT *, p0 || list_filter(parts, lambda x: NOT list_contains(p0, x)) AS p1 FROM pr),
p2 AS (SELECT *, p1 || list_filter(ends, lambda x: NOT list_contains(p1, x)) AS p2 FROM p1)"""


@query("analysed_names", f"WITH {MEDICINES_SQL}, {ENGLISH_SQL}, {PRIORITY_SQL} SELECT k, n AS corrected, plain, category, array_to_string(english, '|') AS english, round(conf, 2) AS confidence, array_to_string(CASE WHEN conf < 0.2 THEN [] ELSE p2[1:least(3, CAST(floor(conf * 5) AS INT))] END, '|') AS priority FROM nm JOIN p2 USING (name)", with_mentions=False)
def _(spark, sf):
    """Each different name is analysed once."""
    rows = medicines(spark, sf)
    done = rows.select("name").distinct().withColumn("a", A.analysed(F.col("name")))
    said = lambda c: F.array_join(F.col(f"a.{c}"), "|").alias(c)
    return rows.join(done, "name").select("k", "a.corrected", "a.plain", "a.category", said("english"), F.round("a.confidence", 2).alias("confidence"), said("priority"))


WORDS = [x for names in A.ENGLISH_NAMES.values() for x in names[:2]] + ["castor oil", "lactose hydrate", "sodium picosulfate", "zolpidem acid"]


def labels(spark, sf):
    """(id, label): an English name and a word of each part's own name."""
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(F.concat(F.lit("dr:D"), F.lpad(k.cast("string"), 7, "0")).alias("id"), F.concat(picked(WORDS, k), F.lit(" "), F.substring_index("p_name", " ", -1)).alias("label"))


PIECES_SQL = "CASE WHEN length({c}) < 3 THEN [lower({c})] ELSE list_transform(range(1, CAST(length({c}) AS BIGINT) - 1), lambda i: lower(substr({c}, i, 3))) END"
BARE_SQL = S.sql("name", A.BARE_STEPS)
TOKENS_SQL = "array_to_string(list_sort(string_split({c}, ' ')), ' ')"


def _label_sql() -> str:
    ratio = lambda a, b: RATIO_SQL.format(a=a, b=b)
    whole = ratio("a", "b")
    ending = " OR ".join(f"(ends_with(name, {Q(e)}) AND contains(b, {Q(w)}))" for e, w in rerank.BONUS_ENDINGS)
    english = "CASE bare " + " ".join(f"WHEN {Q(k)} THEN {list_sql(v)}" for k, v in A._by_bare_key().items()) + " ELSE [] END"
    return f"""WITH {MEDICINES_SQL}, {S.values_sql('wp', 'i, word', list(enumerate(WORDS)))},
asked AS (SELECT name, {english} AS english FROM (SELECT name, {BARE_SQL} AS bare FROM (SELECT name FROM dn UNION SELECT p_name FROM part))),
known AS (SELECT word || ' ' || split_part(p_name, ' ', -1) AS label, min('dr:D' || lpad(CAST(p_partkey AS VARCHAR), 7, '0')) AS id FROM part JOIN wp ON i = p_partkey % {len(WORDS)} GROUP BY 1),
kept AS (SELECT * FROM known WHERE NOT {S.any_of_sql('lower(label)', A.NO_MEDICINES)}),
l AS (SELECT DISTINCT name, english, unnest(flatten(list_transform([name] || english, lambda c: {PIECES_SQL.format(c='c')}))) AS piece FROM asked),
r AS (SELECT DISTINCT id, label, unnest({PIECES_SQL.format(c='label')}) AS piece FROM kept),
pairs AS (SELECT DISTINCT name, english, id, label, lower(name) AS a, lower(label) AS b, lower({S.sql('name', M.KATAKANA_STEPS)}) AS kana FROM l JOIN r USING (piece)),
toks AS (SELECT *, {TOKENS_SQL.format(c='a')} AS sa, {TOKENS_SQL.format(c='b')} AS sb FROM pairs),
scored AS (SELECT name, id, label, CAST(greatest({whole}, CASE WHEN contains(a, b) OR contains(b, a) THEN 100 ELSE {whole} END, {ratio('sa', 'sb')},
    CAST(floor(100 * len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(string_split(a, ' ') || string_split(b, ' ')))) AS BIGINT), CASE WHEN kana = '' THEN 0 ELSE {ratio('kana', 'b')} END)
  + CASE WHEN len(list_filter(english, lambda e: contains(b, lower(e)))) > 0 THEN 25 ELSE 0 END
  + CASE WHEN length(name) > 3 AND len(list_filter({PIECES_SQL.format(c='name')}, lambda g: contains(b, g))) > 0 THEN 15 ELSE 0 END
  + CASE WHEN {ending} THEN 20 ELSE 0 END AS BIGINT) AS score FROM toks)
SELECT name, id, label, score FROM scored QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, label, id) = 1"""


@query("best_labels", _label_sql(), with_mentions=False)
def _(spark, sf):
    """Medicines and the parts' own names against labels made of English names; labels of no medicines are left out."""
    asked = medicines(spark, sf).select("name").union(read(spark, sf, "part").select(F.col("p_name").alias("name")))
    return rerank.best_labels(asked, labels(spark, sf))
