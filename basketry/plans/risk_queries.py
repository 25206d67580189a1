"""Queries of pairs, class risks, tags and rules as data, over baskets of medicines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import classes as C, medicines as M, steps as S
from ..operators import knowledge as K, pairs, rules
from ..sources.tables import mentions, read
from ..streaming.buffer import shared_folder
from .pool import NAMES_SQL, POOL, names, picked
from .registry import query

Q = S.quoted
#: Names of pair rules and class risks in the places of parts.
RISKY = list(dict.fromkeys(["タダラフィル", "ニコランジル", "タケキャブ", "ランソプラゾール", "ボノプラザン", "エナラプリル", "エンレスト", "テラムロ", "バルサルタン", "ワルファリン", "アスピリン", "ジゴキシン", "アミオダロン", "シンバスタチン", "ベルソムラ", "ロゼレム", "デエビゴ", "フルボキサミン", "クラリスロマイシン", "アムロジピン", "センノシド", "リナクロチド", "芍薬甘草湯", "イブプロフェン", "アトルバスタチン", "ニフェジピン", "リオナ", "炭酸ランタン", "沈降炭酸カルシウム", "メトホルミン", "プレドニゾロン", "サクビトリル/バルサルタン", "センナ・センナ実", "不明薬", "エチゾラム", "フェノバルビタール", "リスペリドン", "デュロキセチン"]))
RISKY_SQL = ", " + S.values_sql("rp", "i, name", list(enumerate(RISKY))) + f", r AS (SELECT m.* REPLACE (rp.name AS name) FROM m JOIN rp ON i = part % {len(RISKY)})"


def risky(spark, sf):
    return mentions(spark, sf).withColumn("name", picked(RISKY, F.col("part")))


def _pairs_sql(table: list[tuple], more: tuple[str, ...] = ()) -> str:
    more = "".join(f", string_split(what, '|')[{i}] AS {name}" for i, name in enumerate(more, 3))
    return RISKY_SQL + ", " + S.values_sql("p0", "ord, x, y, what", [(i, a, b, w) for i, (a, b, w) in enumerate(table)]) + ", d AS (SELECT ord, x, y, what FROM p0 UNION ALL SELECT ord, y, x, what FROM p0), f AS (SELECT x, y, arg_min(what, ord) AS what FROM d GROUP BY x, y) SELECT a.rx_id, a.name AS first, b.name AS second, string_split(what, '|')[1] AS risk, string_split(what, '|')[2] AS description" + more + " FROM r a JOIN r b ON a.rx_id = b.rx_id AND a.pos < b.pos JOIN f ON a.name = x AND b.name = y"


def _paired(spark, sf, table, more: tuple[str, ...] = ()):
    found = pairs.apply_pair_rules(pairs.item_pairs(risky(spark, sf), ["name"]), "name", table)
    what = F.split("risk", r"\|")
    return found.select("rx_id", F.col("a_name").alias("first"), F.col("b_name").alias("second"), what[0].alias("risk"), what[1].alias("description"), *(what[i].alias(name) for i, name in enumerate(more, 2)))


MORE = ("mechanism", "impact")


@query("medicine_pairs", _pairs_sql(K.pair_rules(), MORE))
def _(spark, sf):
    """Pairs of a basket that a directed rule names, in either direction; the earliest rule counts."""
    return _paired(spark, sf, K.pair_rules(), MORE)


@query("same_effect_medicines", _pairs_sql(K.same_effect_rules()))
def _(spark, sf):
    return _paired(spark, sf, K.same_effect_rules())


CATEGORY_SQL = f"coalesce({S.first_contained_sql('lower(name)', {k.lower(): v for k, v in C.SPECIAL.items()})}, CASE " + " ".join(f"WHEN contains(lower(name), {Q(k.lower())}) OR contains(lower(bare), {Q(k.lower())}) THEN {Q(v)}" for k, v in C.CATEGORIES.items()) + " END, CASE WHEN lower(name) <> '' THEN CASE " + " ".join(f"WHEN contains({Q(k.lower())}, lower(name)) THEN {Q(v)}" for k, v in C.CATEGORIES.items()) + " END END, 'unknown')"
LADDER_SQL = "CASE " + " ".join(f"WHEN {S.any_of_sql('lower(name)', words)} THEN {Q(label)}" for label, words in C.LADDER) + " ELSE 'unknown' END"


#: Every name of the category table, with a form and an amount, beside the pool's.
CATEGORIZED = [*POOL, *(f"{name}錠10mg" for name in C.CATEGORIES)]
CATEGORIZED_SQL = S.values_sql("cp", "i, name", list(enumerate(CATEGORIZED))) + f", nm AS (SELECT p_partkey AS k, name FROM part JOIN cp ON i = p_partkey % {len(CATEGORIZED)})"


@query("category_prediction", f"WITH {CATEGORIZED_SQL}, p AS (SELECT *, {S.sql('name', M.PLAIN_STEPS)} AS bare FROM nm), c AS (SELECT k, {CATEGORY_SQL} AS category, {LADDER_SQL} AS rung FROM p) SELECT *, coalesce({S.mapped_sql('category', C.CATEGORY_LABELS)}, category) AS label FROM c", with_mentions=False)
def _(spark, sf):
    """The category of a name by a dictionary and by the ladder, and the first one's label; each different name is looked up once."""
    c, k = F.col("name"), F.col("p_partkey")
    rows = read(spark, sf, "part").select(k.alias("k"), picked(CATEGORIZED, k).alias("name"))
    known = rows.select("name").distinct().select("name", C.category(c, M.plain(c)).alias("category"), C.ladder(c).alias("rung"))
    return rows.join(F.broadcast(known), "name").select("k", "category", "rung", F.coalesce(S.mapped(F.col("category"), C.CATEGORY_LABELS), "category").alias("label"))


CLASSED_SQL = RISKY_SQL + f", w AS (SELECT DISTINCT rx_id, name, {S.sql('name', M.PLAIN_STEPS)} AS bare FROM r), g AS (SELECT rx_id, name, {CATEGORY_SQL} AS category FROM w)"
RISK_ROWS = [(n, lv, p, t, c) for n, cs, lv, p, t in K.RISKS for c in cs]
RISKS_SQL = CLASSED_SQL + ", " + S.values_sql("k", "risk, level, priority, description, category", RISK_ROWS) + ", f AS (SELECT rx_id, risk, level, priority, description, array_to_string(list_sort(list(name)), '、') AS targets FROM g JOIN k USING (category) GROUP BY ALL HAVING count(*) >= 2), s AS (SELECT rx_id, " + f"{Q(K.SLEEP[0])} AS risk, {Q(K.SLEEP[2])} AS level, {K.SLEEP[3]} AS priority, {Q(K.SLEEP[4])} AS description, array_to_string(list_sort(list(name)), '、') AS targets FROM g WHERE category IN (" + ", ".join(map(Q, K.SLEEP[1])) + f") GROUP BY rx_id HAVING count(*) >= 2), a AS (SELECT * FROM f UNION ALL SELECT * FROM s WHERE rx_id NOT IN (SELECT rx_id FROM f WHERE risk = {Q(K.SLEEP[0])}))"


def clinical_risks(spark, sf):
    """Each different name is classified once; an item goes to the risks of its category, and to the one for sleeping aids of both kinds."""
    items = risky(spark, sf).select("rx_id", "name").distinct()
    classed = items.select("name").distinct().withColumn("category", C.category(F.col("name"), M.plain(F.col("name"))))
    return K.class_risks(items.join(F.broadcast(classed), "name"))


@query("clinical_risks", RISKS_SQL + f" SELECT *, {S.mapped_sql('risk', {k: v[0] for k, v in K.RISK_TEXTS.items()})} AS impact, {S.mapped_sql('risk', {k: v[1] for k, v in K.RISK_TEXTS.items()})} AS recommendation FROM a")
def _(spark, sf):
    return clinical_risks(spark, sf)


TAG_SQL = ", " + S.values_sql("tg", "key, tag", [(k, t) for k, ts in K.TAGS.items() for t in ts])
PARTS_SQL = RISKY_SQL + TAG_SQL + ", pt AS (SELECT rx_id, name, unnest(regexp_split_to_array(name, '[・/＋+\\s　]')) AS part FROM (SELECT DISTINCT rx_id, name FROM r)), ti AS (SELECT DISTINCT rx_id, name, tag FROM pt JOIN tg ON part = key OR (part NOT IN (SELECT key FROM tg) AND contains(part, key)) WHERE part <> '' UNION ALL SELECT DISTINCT rx_id, name, '~' || t FROM r JOIN (VALUES " + ", ".join(f"({Q(x)})" for x in K.BINDERS) + ") AS v(t) ON contains(name, t))"


@query("medicine_tag_counts", PARTS_SQL + " SELECT rx_id, tag, count(DISTINCT name) AS n FROM ti WHERE tag NOT LIKE '~%' GROUP BY rx_id, tag")
def _(spark, sf):
    """How many differently named medicines of a basket have each tag; parts of combined names count."""
    return K.tag_items(risky(spark, sf)).where(~F.startswith("tag", F.lit("~"))).groupBy("rx_id", "tag").agg(F.countDistinct("name").alias("n"))


TAG_HITS_SQL = PARTS_SQL + ", h AS (" + rules.evaluate_sql([r for r, _, _ in K.TAG_RULES], "ti") + ")"


@query("medicine_tag_rules", TAG_HITS_SQL + f" SELECT rx_id, rule_id, severity, targets, {S.mapped_sql('rule_id', K.advice())} AS advice FROM h")
def _(spark, sf):
    """The eleven tag rules with their advice."""
    found = rules.evaluate(K.tag_items(risky(spark, sf)), [r for r, _, _ in K.TAG_RULES])
    return found.select("rx_id", "rule_id", "severity", "targets", S.mapped(F.col("rule_id"), K.advice()).alias("advice"))


@query("interaction_summary", TAG_HITS_SQL + " SELECT rx_id, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity <> 'major') AS moderate, concat_ws('、', CASE WHEN count(*) FILTER (severity = 'major') > 0 THEN '重大な相互作用: ' || count(*) FILTER (severity = 'major') || '件' END, CASE WHEN count(*) FILTER (severity <> 'major') > 0 THEN '注意すべき相互作用: ' || count(*) FILTER (severity <> 'major') || '件' END) || 'が検出されました。' AS summary FROM h GROUP BY rx_id")
def _(spark, sf):
    found = rules.evaluate(K.tag_items(risky(spark, sf)), [r for r, _, _ in K.TAG_RULES])
    g = found.groupBy("rx_id").agg(F.count_if(F.col("severity") == "major").alias("major"), F.count_if(F.col("severity") != "major").alias("moderate"))
    said = lambda c, text: F.when(F.col(c) > 0, F.concat(F.lit(text), F.col(c).cast("string"), F.lit("件")))
    return g.withColumn("summary", F.concat(F.concat_ws("、", said("major", "重大な相互作用: "), said("moderate", "注意すべき相互作用: ")), F.lit("が検出されました。")))


RESOLVED = [r for r, _, _ in K.TAG_RULES if r.id in ("raas_contraindicated", "gastric_acid_suppression_duplicate", "antihypertensive_multi_drug", "pde5_nitrate_contraindicated")]


@query("resolved_targets", PARTS_SQL + ", h AS (" + rules.evaluate_sql(RESOLVED, "ti") + ") SELECT rx_id, count(*) AS n, string_agg(rule_id || '=' || targets, ';' ORDER BY rule_id) AS targets FROM h GROUP BY rx_id")
def _(spark, sf):
    """The targets of some rules of a basket in one text."""
    found = rules.evaluate(K.tag_items(risky(spark, sf)), RESOLVED)
    g = found.groupBy("rx_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rule_id", "targets"))).alias("x"))
    return g.select("rx_id", "n", F.array_join(F.transform("x", lambda r: F.concat(r.rule_id, F.lit("="), r.targets)), ";").alias("targets"))


@query("tag_descriptions", f"WITH {NAMES_SQL}{TAG_SQL}, pt AS (SELECT DISTINCT name, unnest(regexp_split_to_array(name, '[・/＋+\\s　]')) AS part FROM nm), ti AS (SELECT DISTINCT name, tag FROM pt JOIN tg ON part = key OR (part NOT IN (SELECT key FROM tg) AND contains(part, key)) WHERE part <> '') SELECT name, tag, coalesce({S.mapped_sql('tag', K.TAG_TEXTS)}, '相互作用の可能性あり') AS description FROM ti", with_mentions=False)
def _(spark, sf):
    rows = names(spark, sf).select("name").distinct().select("name", F.explode(K.tags_of(F.col("name"))).alias("tag"))
    return rows.withColumn("description", F.coalesce(S.mapped(F.col("tag"), K.TAG_TEXTS), F.lit("相互作用の可能性あり")))


#: A rule of each part; every seventh lacks an advice, every eleventh a condition.
RULES_SQL = "SELECT 'r' || p_partkey AS id, p_name AS name, CASE WHEN p_size > 30 THEN 'major' WHEN p_size > 10 THEN 'moderate' ELSE 'minor' END AS severity, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS advice, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 2 = 0 THEN {list}(p_type, p_brand) END AS requires, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 2 = 1 THEN {list}(p_type) END AS match_any FROM part"


def stored_rules(spark, sf):
    """The rules as a table that was written before and is read again."""
    made = spark.sql(RULES_SQL.format(list="array").replace("FROM part", "FROM {part}"), part=read(spark, sf, "part"))
    path = f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}"
    K.write_rules(made, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return K.read_rules(spark, path)


@query("rule_stats", f"WITH r AS ({RULES_SQL.format(list='list_value')}) SELECT severity AS level, count(*) AS n, count(*) FILTER (advice IS NOT NULL AND (requires IS NOT NULL OR match_any IS NOT NULL)) AS valid FROM r GROUP BY severity", with_mentions=False)
def _(spark, sf):
    """Stored rules by severity, and how many of them are valid."""
    return stored_rules(spark, sf).groupBy(F.col("severity").alias("level")).agg(F.count("*").alias("n"), F.count_if(K.valid_rule()).alias("valid"))


@query("added_rules", f"WITH r AS ({RULES_SQL.format(list='list_value')}), o AS (SELECT * FROM r WHERE CAST(substr(id, 2) AS BIGINT) % 3 = 0), n AS (SELECT * FROM r WHERE CAST(substr(id, 2) AS BIGINT) % 2 = 0) SELECT id, severity FROM o UNION ALL SELECT id, severity FROM n WHERE advice IS NOT NULL AND (requires IS NOT NULL OR match_any IS NOT NULL) AND id NOT IN (SELECT id FROM o)", with_mentions=False)
def _(spark, sf):
    """Valid new rules come in; those without advice or condition and those whose id is taken don't."""
    rules_ = stored_rules(spark, sf)
    number = F.substring("id", 2, 100).cast("long")
    return K.added_rules(rules_.where(number % 3 == 0), rules_.where(number % 2 == 0)).select("id", "severity")
