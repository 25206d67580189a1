"""Queries of order rows: corrections, validation, existence, classification, codes, gates, statistics, buffers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..functions import attributes as A, classes as C, labels as L, medicines as M, steps as S
from ..operators.validation import completed_records, enriched_dictionary, validated_records
from ..operators import lookup, postprocess
from ..sources.sinks import write_csv
from ..sources.tables import SAMPLE, read, sample_dictionary
from ..streaming.buffer import TTL_DAYS, drain_reads, shared_folder
from .pool import BASKETS_SQL, NAMES_SQL, POOL, baskets, names, per_name, picked
from .registry import query

Q = S.quoted
GENERICS = ["ピコスルファートナトリウム", "ナルフラフィン塩酸塩", "トラマドール・アセトアミノフェン", "サクビトリル/バルサルタン", "沈降炭酸カルシウム", "キックリン", "アスピリン腸溶", "アスピリン", "アムロジピン"]
RAWS = ["ラキソベロン内用液", "錠 10mg / 5mg", "テープ", ""]
DOSES = ["2錠", "1錠", "3包"]
FREQS = ["朝夕食後", "眠前", "食直前", "食後朝・夕", "1日3回食後", "食後朝夕", "食前"]
STRENGTHS = ["2.5μg/錠", "不明", "81 mg", ""]


def _list_sql(items, number: str) -> str:
    return "[" + ", ".join(map(Q, items)) + f"][CAST({number} % {len(items)} AS INTEGER) + 1]"


ROWS_SQL = f"WITH o AS (SELECT p_partkey AS k, {_list_sql(GENERICS, 'p_partkey')} AS generic, {_list_sql(RAWS, 'p_size')} AS raw, '' AS brand, {_list_sql(DOSES, 'p_partkey // 9')} AS dose, {_list_sql(FREQS, 'p_partkey // 3')} AS freq, {_list_sql(STRENGTHS, 'p_partkey // 5')} AS strength, '' AS dose_form, CASE WHEN p_size % 2 = 0 THEN '分類未設定' ELSE 'x' END AS final_classification FROM part)"


def order_rows(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    div = lambda x: F.floor(k / x)
    return read(spark, sf, "part").select(
        k.alias("k"), picked(GENERICS, k).alias("generic"), picked(RAWS, n).alias("raw"), F.lit("").alias("brand"), picked(DOSES, div(9)).alias("dose"), picked(FREQS, div(3)).alias("freq"), picked(STRENGTHS, div(5)).alias("strength"),
        F.lit("").alias("dose_form"), F.when(n % 2 == 0, "分類未設定").otherwise("x").alias("final_classification"),
    )


PAIN_SQL = "contains(generic, 'トラマドール') AND contains(generic, 'アセトアミノフェン')"
TIMES_SQL = "CASE WHEN contains(freq, '朝夕') AND NOT contains(freq, '朝・夕') THEN replace(freq, '朝夕', '朝・夕') WHEN contains(freq, '眠前') THEN replace(freq, '眠前', '就寝前') {more} ELSE freq END"
LATER_SQL = "WHEN contains(freq, '食後朝・夕') THEN replace(freq, '食後朝・夕', '食後／朝・夕') WHEN contains(freq, '食後朝夕') THEN replace(freq, '食後朝夕', '食後／朝・夕')"


@query("post_processors", ROWS_SQL + f""", p1 AS (SELECT * REPLACE (CASE WHEN pico AND contains(raw, '液') THEN '0.75mg/mL' WHEN pico AND contains(raw, '錠') THEN coalesce(nullif(strength, ''), '2.5mg') ELSE strength END AS strength, CASE WHEN pico AND contains(raw, '液') THEN '液' WHEN pico AND contains(raw, '錠') THEN '錠' ELSE dose_form END AS dose_form) FROM (SELECT *, contains(generic, 'ピコスルファート') OR contains(raw, 'ラキソベロン') AS pico FROM o)),
p2 AS (SELECT * REPLACE (CASE WHEN contains(generic, 'ナルフラフィン') THEN '1カプセル' ELSE dose END AS dose, CASE WHEN contains(generic, 'ナルフラフィン') THEN 'カプセル' ELSE dose_form END AS dose_form, CASE WHEN contains(generic, 'ナルフラフィン') THEN replace(replace(strength, '/錠', '/カプセル'), '錠', 'カプセル') ELSE strength END AS strength) FROM p1),
p3 AS (SELECT * REPLACE ({TIMES_SQL.format(more='')} AS freq) FROM p2),
p5 AS (SELECT * REPLACE (CASE WHEN {PAIN_SQL} THEN '1回1錠' WHEN contains(generic, 'サクビトリル') AND contains(generic, 'バルサルタン') AND dose = '2錠' THEN '1錠' WHEN contains(generic, '沈降炭酸カルシウム') AND dose = '2錠' THEN '3錠' WHEN contains(generic, 'キックリン') AND dose = '2錠' THEN '2カプセル' ELSE dose END AS dose, CASE WHEN {PAIN_SQL} THEN '1日3回' WHEN contains(generic, '沈降炭酸カルシウム') AND freq = '食直前' THEN '食直後' ELSE freq END AS freq, CASE WHEN {PAIN_SQL} THEN NULL ELSE strength END AS strength, CASE WHEN contains(generic, 'キックリン') THEN 'カプセル' ELSE dose_form END AS dose_form) FROM p3),
p9 AS (SELECT * REPLACE ({TIMES_SQL.format(more=LATER_SQL)} AS freq) FROM p5)
SELECT k, dose, freq, strength, dose_form, CASE WHEN contains(freq, '食直前') OR contains(freq, '食前') THEN 'before_meal' WHEN contains(freq, '食後') OR contains(freq, '食直後') THEN 'after_meal' END AS timing,
 CASE WHEN {PAIN_SQL} AND final_classification = '分類未設定' THEN '鎮痛薬（弱オピオイド＋解熱鎮痛薬）' WHEN starts_with(generic, 'アスピリン') AND (contains(generic, '腸溶') OR contains(replace(strength, ' ', ''), '81mg')) THEN '抗血小板薬' ELSE final_classification END AS class,
 CASE WHEN contains(raw, '10mg / 5mg') THEN '10mg|5mg' ELSE '' END AS parts FROM p9""", with_mentions=False)
def _(spark, sf):
    """Thirteen ordered corrections of rows that need them."""
    out = postprocess.post_process(order_rows(spark, sf))
    return out.select("k", "dose", "freq", "strength", "dose_form", F.col("timing_norm").alias("timing"), F.col("final_classification").alias("class"), F.coalesce(F.array_join("component_strengths", "|"), F.lit("")).alias("parts"))


@query("record_validation", ROWS_SQL + ", v AS (SELECT k, CASE WHEN k % 5 = 0 THEN '  ' WHEN k % 7 = 0 THEN NULL ELSE ' ' || generic || ' ' END AS g, CASE WHEN k % 7 = 0 THEN '' ELSE 'b' END AS b, raw, CASE WHEN k % 3 = 0 THEN '' ELSE strength END AS s, k % 4 AS c FROM o) SELECT k, trim(g) AS generic, nullif(trim(b), '') AS brand, CASE WHEN contains(raw, 'テープ') THEN '不明' END AS quantity, CASE WHEN contains(g, '/') AND s = '' THEN '配合錠' ELSE s END AS strength, CAST(c AS DOUBLE) / 4 AS confidence FROM v WHERE trim(g) <> ''", with_mentions=False)
def _(spark, sf):
    """Rows without a name go; texts are trimmed; tapes and combined tablets get what is missing."""
    k = F.col("k")
    rows = order_rows(spark, sf).select("k", F.when(k % 5 == 0, "  ").when(k % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), "generic", F.lit(" "))).alias("g"), F.when(k % 7 == 0, "").otherwise("b").alias("b"), "raw", F.when(k % 3 == 0, "").otherwise(F.col("strength")).alias("s"))
    none = F.lit(None).cast("string")
    rows = rows.select("k", F.col("g").alias("generic"), F.col("b").alias("brand"), "raw", F.col("s").alias("strength"), *(none.alias(c) for c in ("dose", "freq", "days", "class_hint", "dose_form", "quantity", "size")), ((k % 4) / 4).alias("confidence"))
    return completed_records(validated_records(rows)).select("k", "generic", "brand", "quantity", "strength", "confidence")


def _any_sql(expr: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({expr}, {Q(p)})" for p in patterns) + ")"


def _overlap_sql(ps) -> str:
    return "(" + " OR ".join(f"contains(name, {Q(p)}) OR contains({Q(p)}, name)" for p in ps) + ")"


ALL_PRODUCTS = [p for ps in C.PRODUCTS.values() for p in ps]
EXISTS_SQL = f"WITH {NAMES_SQL}, s AS (SELECT *, name IN (" + ", ".join(map(Q, C.ENGLISH)) + ") AS found, greatest(CASE WHEN " + " OR ".join(f"(maker = {Q(m)} AND {_overlap_sql(ps)})" for m, ps in C.PRODUCTS.items()) + " THEN 0.9 ELSE 0 END, CASE WHEN maker IN (" + ", ".join(map(Q, C.PRODUCTS)) + ") THEN 0.8 ELSE 0 END, CASE WHEN name IN (" + ", ".join(map(Q, ALL_PRODUCTS)) + f") THEN 0.9 ELSE 0 END, CASE WHEN {_overlap_sql(ALL_PRODUCTS)} THEN 0.85 ELSE 0 END) AS score FROM nm), e AS (SELECT k, name, {S.mapped_sql('name', C.KNOWN_BAD)} AS fix, {_any_sql('name', C.BAD_ENDINGS)} AS bad, {_any_sql('name', C.GOOD_PATTERNS)} AS good, found, maker = '' AS nobody, score FROM s), x AS (SELECT k, CASE WHEN fix IS NOT NULL THEN 'known_bad' WHEN bad THEN 'bad_ending' WHEN NOT found THEN 'not_found' WHEN NOT nobody AND score < 0.8 THEN 'other_maker' ELSE 'passed' END AS reason, fix, good, nobody, score FROM e)"


def checked(spark, sf):
    found = F.col("name").isin(*C.ENGLISH)
    return names(spark, sf).select("k", C.existence(F.col("name"), F.col("maker"), found).alias("e")).select("k", "e.*")


@query("existence_checks", EXISTS_SQL + " SELECT k, reason = 'passed' AS exists, CAST(CASE reason WHEN 'known_bad' THEN 0.95 WHEN 'bad_ending' THEN 0.9 WHEN 'not_found' THEN 0.8 WHEN 'other_maker' THEN 0.6 ELSE least(CASE WHEN good THEN 0.8 ELSE 0.5 END, 0.7, 0.9, CASE WHEN nobody THEN 0.5 ELSE score END) END AS DOUBLE) AS confidence, CASE WHEN reason = 'known_bad' THEN fix END AS corrected, reason FROM x", with_mentions=False)
def _(spark, sf):
    """Does a name exist: the first of four checks that speaks, the correction of a known misreading, the confidence."""
    return checked(spark, sf)


@query("existence_stats", EXISTS_SQL + " SELECT k % 10 AS g, count(*) AS total, count(*) FILTER (reason = 'passed') AS valid, count(*) FILTER (reason = 'known_bad') AS corrected, count(*) FILTER (reason NOT IN ('passed', 'known_bad')) AS invalid, round(count(*) FILTER (reason = 'passed') / count(*), 6) AS validity_rate, round(count(*) FILTER (reason = 'known_bad') / count(*), 6) AS correction_rate FROM x GROUP BY 1", with_mentions=False)
def _(spark, sf):
    ok, fixed = F.count_if(F.col("exists")), F.count_if(F.col("corrected").isNotNull())
    bad = F.count_if(~F.col("exists") & F.col("corrected").isNull())
    return checked(spark, sf).groupBy((F.col("k") % 10).alias("g")).agg(F.count("*").alias("total"), ok.alias("valid"), fixed.alias("corrected"), bad.alias("invalid"), F.round(ok / F.count("*"), 6).alias("validity_rate"), F.round(fixed / F.count("*"), 6).alias("correction_rate"))


HINTS = ["降圧薬", "睡眠薬", "不明", "他", ""]
CODE_LISTS = [["C08CA01"], ["A02BC06", "A02"], [], ["N05CM19"], ["X9"]]


def _label_sql(leaf: str) -> str:
    return "coalesce(" + ", ".join(S.mapped_sql(x, A.CODE_LABELS) for x in (leaf, f"left({leaf}, 5)", f"left({leaf}, 3)", f"left({leaf}, 1)")) + ")"


LEAVES = {0: "C08CA01", 1: "A02BC06", 3: "N05CM19", 4: "X9"}
LEAF_SQL = "CASE k % 5 " + " ".join(f"WHEN {k} THEN {Q(v)}" for k, v in LEAVES.items()) + " END"
OWN_SQL = f"coalesce(CASE WHEN k % 2 = 0 THEN nullif({S.sql('name', M.DOSAGE_STEPS)}, '') END, {S.first_contained_sql('name', C.SYNONYMS)}, name)"
HINT_SQL = _list_sql(HINTS, "k")


@query("classification_cascade", f"WITH {NAMES_SQL}, d AS (SELECT k, name, {OWN_SQL} AS g, {LEAF_SQL} AS leaf, {HINT_SQL} AS hint FROM nm) SELECT k, coalesce({S.mapped_sql('g', C.CLASS_OF)}, CASE WHEN {S.any_of_sql('name', C.EXTERNAL_WORDS)} AND {S.any_of_sql('g', C.EXTERNAL_NSAIDS)} THEN 'NSAIDs外用' END, {_label_sql('leaf')}, CASE WHEN leaf IS NULL THEN {_label_sql(Q('B01AC04'))} END, {S.mapped_sql('g', C.FALLBACK)}, CASE WHEN {S.any_of_sql('hint', C.HINTS)} THEN hint || '（AI推定）' END, '分類未設定') AS class FROM d", with_mentions=False)
def _(spark, sf):
    """Dictionary, external forms, codes, further codes, second dictionary, hint: the first that knows."""
    k, c = F.col("k"), F.col("name")
    generic = F.when(k % 2 == 0, F.nullif(S.run(c, M.DOSAGE_STEPS), F.lit("")))
    codes = F.element_at(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in CODE_LISTS)), (k % 5).cast("int") + 1)
    label = C.classified(generic, c, F.lit(""), codes, F.array(F.lit("B01AC04")), picked(HINTS, k))
    return names(spark, sf).select("k", F.coalesce(label, F.lit("分類未設定")).alias("class"))


SALTED_SQL = S.sql("trim(name)", C.SALTS)


@query("classification_by_form", f"WITH {NAMES_SQL}, d AS (SELECT k, name, {SALTED_SQL} AS g, {LEAF_SQL} AS leaf, {HINT_SQL} AS hint FROM nm), t AS (SELECT *, CASE WHEN {S.any_of_sql('name', ('ゲル', '外用', '貼付', '軟膏', 'クリーム'))} THEN coalesce({S.first_contained_sql('g', C.TAGGED_NSAIDS)}, g) ELSE g END AS tagged FROM d), z AS (SELECT k, coalesce({S.mapped_sql('tagged', C.CLASS_OF)}, {S.mapped_sql('g', C.CLASS_OF)}, CASE WHEN k % 3 = 0 THEN coalesce({S.mapped_sql('left(leaf, 1)', C.LETTERS)}, '心臓薬') END, CASE WHEN NOT {S.any_of_sql('hint', C.NO_HINTS)} AND ({S.any_of_sql('hint', C.MORE_HINTS)} OR length(hint) >= 3) THEN hint || '（AI推定）' END, '分類未設定') AS class FROM t) SELECT class, count(*) AS n, bool_and(contains(class, '（AI推定）')) AS estimated FROM z GROUP BY class", with_mentions=False)
def _(spark, sf):
    """The second cascade, and how many names each class has."""
    k, c = F.col("k"), F.col("name")
    codes = F.element_at(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in CODE_LISTS)), (k % 5).cast("int") + 1)
    label = F.coalesce(C.classified_by_form(F.lit(None).cast("string"), c, codes, F.when(k % 3 == 0, "心臓薬"), picked(HINTS, k)), F.lit("分類未設定"))
    return names(spark, sf).select(label.alias("class")).groupBy("class").agg(F.count("*").alias("n"), F.bool_and(F.contains("class", F.lit("（AI推定）"))).alias("estimated"))


ASKED = sorted(set(C.ENGLISH.values()))


@query("best_codes", f"WITH {NAMES_SQL}, n AS (SELECT DISTINCT name, coalesce({S.mapped_sql('name', C.CODE_CORRECTIONS)}, name) AS fixed FROM nm), q AS (SELECT name, {S.mapped_sql('fixed', C.ENGLISH)} AS query FROM n), {S.values_sql('e', 'i, query', list(enumerate(ASKED)))}, b AS (SELECT query, min(p_partkey) AS k FROM part JOIN e ON i = p_partkey % {len(ASKED)} GROUP BY query) SELECT name, 'dr:D' || k AS id, p_brand AS codes FROM q LEFT JOIN b USING (query) LEFT JOIN part ON p_partkey = k", with_mentions=False)
def _(spark, sf):
    """A name's first hit in a lookup table by its English name, with the sorted codes of the hit."""
    own = names(spark, sf).select("name").distinct()
    part = read(spark, sf, "part")
    found = part.select(picked(ASKED, F.col("p_partkey")).alias("query"), F.col("p_partkey").alias("ord"), F.concat(F.lit("dr:D"), "p_partkey").alias("id"), F.lit("x").alias("label"))
    links = part.select(F.concat(F.lit("drug:D"), "p_partkey").alias("id"), F.explode(F.array(F.concat(F.lit("atc:"), "p_brand"), F.lit("brite:x"))).alias("code"))
    return C.best_code(own, found, links).select("name", "id", F.array_join("codes", ",").alias("codes"))


@query("code_confidences", f"WITH c AS (SELECT p_partkey AS k, {LEAF_SQL.replace('k % 5', 'p_partkey % 5')} AS leaf FROM part) SELECT k, CASE WHEN leaf IS NULL THEN 0.5 WHEN length(leaf) >= 7 THEN 0.9 WHEN length(leaf) >= 5 THEN 0.7 ELSE 0.5 END AS confidence FROM c", with_mentions=False)
def _(spark, sf):
    k = F.col("p_partkey")
    codes = F.element_at(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in CODE_LISTS)), (k % 5).cast("int") + 1)
    return read(spark, sf, "part").select(k.alias("k"), C.code_confidence(codes).alias("confidence"))


GATE_SQL = ", g AS (SELECT rx_id, count(*) AS n, count(*) FILTER (qty > 5) / count(*) AS coverage, count(*) FILTER (cls <> 'STANDARD') / count(*) AS classified, count(*) FILTER (confidence < 0.8) AS low, count(*) FILTER (part % 10 = 0) AS no_id FROM m GROUP BY rx_id)"


@query("quality_gate_full", GATE_SQL + " SELECT rx_id, concat_ws(',', CASE WHEN coverage < 0.98 THEN 'low_coverage:high' END, CASE WHEN classified < 0.9 THEN 'low_classification:medium' END, CASE WHEN low > 0 THEN 'low_confidence:medium' END, CASE WHEN n > 20 THEN 'too_many:medium' END, CASE WHEN no_id > 0 THEN 'missing_id:low' END) AS issues, coverage >= 0.98 AS passed, coverage < 0.98 OR classified < 0.9 AS retry, low > 0 OR n > 20 AS human, concat_ws(',', CASE WHEN coverage < 0.98 OR low > 0 THEN 'extraction' END, CASE WHEN classified < 0.9 THEN 'classification' END, CASE WHEN classified < 0.9 THEN 'lookup' END, CASE WHEN coverage < 0.98 OR low > 0 THEN 'alternative' END) AS strategy FROM g")
def _(spark, sf):
    """Six checks of a basket: issues with their severity, whether it passes, is tried again or seen by a person, and how it is tried again."""
    from ..operators.gates import gate

    return gate(baskets(spark, sf), F.col("qty") > 5, F.col("cls") != "STANDARD", F.col("part") % 10 == 0)


@query("basket_statistics", BASKETS_SQL + f" SELECT rx_id, count(DISTINCT cls) AS blocks, count(*) AS items, round(count(*) / count(DISTINCT cls), 6) AS mean, least(1.0, count(*) / 10.0) AS coverage, round(count(*) FILTER (name <> {S.sql('name', M.PLAIN_STEPS)}) / count(*), 6) AS changed_rate, round(count(*) FILTER (confidence >= 0.8) / count(*), 6) AS sure_rate, round(count(*) / greatest(count(*) FILTER (qty > 5), 1), 6) AS efficiency, count(*) FILTER (cls <> 'STANDARD') AS classified, round(count(*) FILTER (cls <> 'STANDARD') / count(*), 6) AS classification_rate FROM b GROUP BY rx_id")
def _(spark, sf):
    """Statistics of parsing, normalizing, processing and classifying, all from one aggregation."""
    n = F.count("*")
    share = lambda t: F.round(F.count_if(t) / n, 6)
    c = F.col
    rows = per_name(baskets(spark, sf), lambda d: d.select("name", (c("name") != M.plain(c("name"))).alias("changed")))
    return rows.groupBy("rx_id").agg(
        F.countDistinct("cls").alias("blocks"), n.alias("items"), F.round(n / F.countDistinct("cls"), 6).alias("mean"), F.least(F.lit(1.0), n / 10.0).alias("coverage"), share(c("changed")).alias("changed_rate"), share(c("confidence") >= 0.8).alias("sure_rate"),
        F.round(n / F.greatest(F.count_if(c("qty") > 5), F.lit(1)), 6).alias("efficiency"), F.count_if(c("cls") != "STANDARD").alias("classified"), share(c("cls") != "STANDARD").alias("classification_rate"),
    )


EXPECTED = ("ルパフィン", "アムロジピン", "ベニジピン", "ニフェジピン", "アルファカルシドール", "フェブキソスタット", "リオナ", "炭酸ランタン", "タケキャブ")
FAMILIAR = ("クラリス", "ベルソム", "デビゴ", "ロゼレム", "フルボキサ", "アムロジ", "エソメプラ", "タダラフィル", "ニコランジル", "エンレスト", "テラムロ", "エナラプリル", "タケキャブ", "ランソプラ", "アトルバスタ", "クロピドグレル", "ビソプロロール", "アスパラ", "ロキソニン", "テープ", "錠", "カプセル", "散", "シロップ")
VALID_SQL = f"(length(name) >= 3 AND NOT {S.any_of_sql('name', M.NOT_NAMES)} AND ({S.any_of_sql('name', M.SURE_NAMES)} OR length(regexp_replace(name, '[^゠-ヿ]', '', 'g')) >= length(name) * 0.5))"
BARE_SQL = S.sql("name", M.SYMBOL_STEPS)
FAMILIAR_SQL = "(" + " OR ".join(f"contains({BARE_SQL}, {Q(w)}) OR contains({Q(w)}, {BARE_SQL})" for w in FAMILIAR) + ")"


@query("extraction_confidence", BASKETS_SQL + f" SELECT rx_id, concat_ws(',', CASE WHEN count(*) < 2 THEN 'few' WHEN count(*) > 20 THEN 'many' END, CASE WHEN count(*) FILTER ({VALID_SQL}) < count(*) * 0.5 THEN 'invalid' END, CASE WHEN count(*) FILTER ({FAMILIAR_SQL}) < count(*) * 0.3 THEN 'unfamiliar' END, CASE WHEN bool_or(length(name) < 3) THEN 'short' END, CASE WHEN bool_or(length(name) > 50) THEN 'long' END) AS issues, least(round(count(*) FILTER ({S.any_of_sql('lower(name)', [e.lower() for e in EXPECTED])}) / 9 + CASE WHEN count(*) BETWEEN 7 AND 11 THEN 0.2 ELSE 0 END + CASE WHEN count(*) FILTER ({S.any_of_sql('name', ('mg', 'g', 'µg', 'μg'))}) >= 7 THEN 0.1 ELSE 0 END, 6), 1.0) AS quality FROM b GROUP BY rx_id")
def _(spark, sf):
    """What speaks against a basket's names, and how many of the expected ones it has."""
    c, n = F.col("name"), F.count("*")
    bare = M.without_symbols(c)
    familiar = F.lit(False)
    for w in FAMILIAR:
        familiar = familiar | F.contains(bare, F.lit(w)) | F.contains(F.lit(w), bare)
    said = lambda d: d.select("name", M.valid_name(c).alias("valid"), familiar.alias("familiar"), S.any_of(F.lower(c), [e.lower() for e in EXPECTED]).alias("expected"), S.any_of(c, ("mg", "g", "µg", "μg")).alias("amount"))
    issues = F.concat_ws(",", F.when(n < 2, "few").when(n > 20, "many"), F.when(F.count_if("valid") < n * 0.5, "invalid"), F.when(F.count_if("familiar") < n * 0.3, "unfamiliar"), F.when(F.bool_or(F.length(c) < 3), "short"), F.when(F.bool_or(F.length(c) > 50), "long"))
    some = F.count_if("expected") / 9
    quality = F.round(some + F.when((n >= 7) & (n <= 11), 0.2).otherwise(0) + F.when(F.count_if("amount") >= 7, 0.1).otherwise(0), 6)
    return per_name(baskets(spark, sf), said).groupBy("rx_id").agg(issues.alias("issues"), F.least(quality, F.lit(1.0)).alias("quality"))


@query("merge_summary", BASKETS_SQL + " SELECT rx_id, CASE WHEN count(*) > count(DISTINCT name) THEN '✅ ' || count(DISTINCT name) || '剤検出しました（重複 ' || (count(*) - count(DISTINCT name)) || ' 件を自動統合）' ELSE '✅ ' || count(DISTINCT name) || '剤検出しました' END AS summary FROM b GROUP BY rx_id")
def _(spark, sf):
    kept = F.countDistinct("name")
    return baskets(spark, sf).groupBy("rx_id").agg(kept.alias("kept"), (F.count("*") - kept).alias("removed")).select("rx_id", M.merged_summary(F.col("kept"), F.col("removed")).alias("summary"))


@query("insert_if_absent", BASKETS_SQL + " SELECT rx_id, name, min(pos) AS pos FROM b GROUP BY rx_id, name")
def _(spark, sf):
    """A name enters a basket's buffer only if it isn't there yet: its first place."""
    return lookup.inserted_if_absent(baskets(spark, sf), ["rx_id", "name"], "pos")


@query("candidate_limits", BASKETS_SQL + " SELECT rx_id, pos, row_number() OVER (PARTITION BY rx_id ORDER BY confidence DESC, pos) AS place FROM b QUALIFY (confidence >= 0.3 OR row_number() OVER (PARTITION BY rx_id, confidence >= 0.3 ORDER BY confidence DESC, pos) <= 10) AND row_number() OVER (PARTITION BY rx_id ORDER BY confidence DESC, pos) <= 5")
def _(spark, sf):
    """All candidates of .3 and more and at most ten others, of these the best five."""
    order = [F.desc("confidence"), F.col("pos")]
    sure = F.col("confidence") >= 0.3
    rows = baskets(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("rx_id", sure).orderBy(*order))).withColumn("place", F.row_number().over(Window.partitionBy("rx_id").orderBy(*order)).cast("long"))
    return rows.where((sure | (F.col("n") <= 10)) & (F.col("place") <= 5)).select("rx_id", "pos", "place")


@query("array_heads", BASKETS_SQL + ", a AS (SELECT rx_id, list(name ORDER BY pos) AS x FROM b GROUP BY rx_id) SELECT rx_id, array_to_string(x[1:5], '|') AS five, array_to_string(x[1:3], '|') AS three FROM a")
def _(spark, sf):
    g = baskets(spark, sf).groupBy("rx_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("x"))
    return g.select("rx_id", F.array_join(F.slice("x.name", 1, 5), "|").alias("five"), F.array_join(F.slice("x.name", 1, 3), "|").alias("three"))


@query("class_difference", "SELECT rx_id, coalesce(array_to_string(list_sort(list_distinct(list(name) FILTER (cls = 'PROMO' AND name NOT IN (SELECT name FROM m i WHERE i.rx_id = m.rx_id AND i.cls = 'SMALL')))), ','), '') AS only FROM m GROUP BY rx_id")
def _(spark, sf):
    """Names of one class that another class of the basket doesn't have."""
    of = lambda c: F.collect_set(F.when(F.col("cls") == c, F.col("name")))
    from ..sources.tables import mentions

    g = mentions(spark, sf).groupBy("rx_id").agg(of("PROMO").alias("a"), of("SMALL").alias("b"))
    return g.select("rx_id", F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("only"))


SEVERITIES, SOURCES, RISKS = [*M.SEVERITY_LABELS, "軽微"], [*M.SOURCE_LABELS, "その他"], ["critical", "urgent", "high", "medium", "low", "other"]
LABELS_SQL = f"SELECT p_partkey AS k, {_list_sql(SEVERITIES, 'p_partkey')} AS s, {_list_sql(SOURCES, 'p_partkey')} AS o, {_list_sql(RISKS, 'p_partkey')} AS r, CASE WHEN p_partkey % 3 = 0 THEN [] ELSE string_split(p_name, ' ') END AS t FROM part"


@query("severity_labels", f"SELECT k, coalesce({S.mapped_sql('s', M.SEVERITY_CODES)}, s) AS code, coalesce({S.mapped_sql('s', M.SEVERITY_LABELS)}, {Q(L.OTHER_LABEL)}) AS label, coalesce({S.mapped_sql('o', M.SOURCE_LABELS)}, '') AS source, coalesce({S.mapped_sql('r', L.RISK_MARKS)}, {Q(L.OTHER_RISK)}) AS risk, coalesce({S.mapped_sql('r', L.PRIORITY_MARKS)}, {Q(L.OTHER_PRIORITY)}) AS priority, CASE WHEN len(t) > 0 THEN array_to_string(t, '、') ELSE {Q(L.NO_TARGETS)} END AS targets FROM ({LABELS_SQL})", with_mentions=False)
def _(spark, sf):
    """A severity's code for the audit and its label for the reader, what is shown for sources, risks and priorities, and targets as text."""
    k = F.col("p_partkey")
    s, r = picked(SEVERITIES, k), picked(RISKS, k)
    targets = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.split("p_name", " "))
    return read(spark, sf, "part").select(k.alias("k"), L.severity_code(s).alias("code"), L.severity_label(s).alias("label"), L.source_label(picked(SOURCES, k)).alias("source"), L.risk_mark(r).alias("risk"), L.priority_mark(r).alias("priority"), L.shown_targets(targets).alias("targets"))


@query("enriched_dictionary", f"WITH {NAMES_SQL}, d AS (SELECT k, name, CASE k % 4 WHEN 0 THEN '不明' WHEN 1 THEN '下剤' WHEN 2 THEN '降圧薬' END AS category, CASE WHEN k % 3 = 0 THEN '不明' ELSE name END AS generic FROM nm), f AS (SELECT name, 'G' || min(k) AS generic_name, 'C' || max(k) AS category FROM nm WHERE k % 2 = 0 GROUP BY name) SELECT k, d.name AS drug_name, CASE WHEN d.category IN ('不明', '解熱鎮痛薬', '下剤') AND f.name IS NOT NULL THEN f.category ELSE d.category END AS category, CASE WHEN d.category IN ('不明', '解熱鎮痛薬', '下剤') AND f.name IS NOT NULL AND generic = '不明' THEN f.generic_name ELSE generic END AS generic_name FROM d LEFT JOIN f USING (name)".replace("d.name AS drug_name", "name AS drug_name").replace("f.name IS NOT NULL", "f.category IS NOT NULL"), with_mentions=False)
def _(spark, sf):
    """A dictionary whose coarse rows are filled up from what was found elsewhere, written and read again."""
    k = F.col("k")
    rows = names(spark, sf)
    own = rows.select("k", F.col("name").alias("drug_name"), F.when(k % 4 == 0, "不明").when(k % 4 == 1, "下剤").when(k % 4 == 2, "降圧薬").alias("category"), F.when(k % 3 == 0, "不明").otherwise(F.col("name")).alias("generic_name"))
    found = rows.where(k % 2 == 0).groupBy(F.col("name").alias("drug_name")).agg(F.concat(F.lit("G"), F.min("k")).alias("generic_name"), F.concat(F.lit("C"), F.max("k")).alias("category"))
    path = f"{shared_folder(spark)}/dictionary-{uuid.uuid4().hex}"
    write_csv(enriched_dictionary(own, found), path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.csv(path, header=True, schema="k long, drug_name string, category string, generic_name string")


@query("image_scores", "WITH s AS (SELECT p_partkey AS k, greatest(least(p_retailprice / 300, 1), 0.3) AS sharp, greatest(least(p_size / 30.0, 1), 0.3) AS contrast, greatest(0, 1 - (p_partkey % 25) / 20.0) AS noise, 0.8 AS complexity FROM part) SELECT k, round((sharp + contrast + noise + complexity) / 4, 6) AS score, CASE WHEN (sharp + contrast + noise + complexity) / 4 >= 0.75 THEN 'high' WHEN (sharp + contrast + noise + complexity) / 4 >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM s", with_mentions=False)
def _(spark, sf):
    """Four scores of a picture from its measures, their mean and its level."""
    lim = lambda c, by: F.greatest(F.least(c / by, F.lit(1.0)), F.lit(0.3))
    mean = (lim(F.col("p_retailprice"), 300) + lim(F.col("p_size"), 30.0) + F.greatest(F.lit(0.0), 1 - (F.col("p_partkey") % 25) / 20.0) + 0.8) / 4
    return read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.round(mean, 6).alias("score"), F.when(mean >= 0.75, "high").when(mean >= 0.5, "medium").otherwise("low").alias("level"))


@query("sample_lookup", f"WITH {NAMES_SQL}, " + S.values_sql("sd", "ord, drug_name, generic_name, category", [(i, *r[:3]) for i, r in enumerate(SAMPLE)]) + " SELECT DISTINCT name AS q, coalesce((SELECT arg_min(category, ord) FROM sd WHERE drug_name = name OR generic_name = name), 'none') AS category FROM nm", with_mentions=False)
def _(spark, sf):
    """Names in the built-in sample dictionary, the last resort where no dictionary file is found."""
    book = sample_dictionary(spark)
    keys = book.select(F.explode(F.array_distinct(F.array("drug_name", "generic_name"))).alias("q"), "ord", "category").groupBy("q").agg(F.min_by("category", "ord").alias("category"))
    own = names(spark, sf).select(F.col("name").alias("q")).distinct()
    return own.join(F.broadcast(keys), "q", "left").select("q", F.coalesce("category", F.lit("none")).alias("category"))


@query("streaming_read_buffer", f"WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM events) SELECT r.user_id, r.event_id, count(a.event_id) AS items, coalesce(round(sum(a.value), 2), 0.0) AS total FROM s r LEFT JOIN s a ON a.user_id = r.user_id AND a.seg = r.seg AND a.event_type = 'purchase' AND (a.ts < r.ts OR (a.ts = r.ts AND a.event_id < r.event_id)) AND a.ts > r.ts - INTERVAL {TTL_DAYS} DAY WHERE r.event_type = 'click' GROUP BY r.user_id, r.event_id", with_mentions=False)
def _(spark, sf):
    """What a user's buffer holds at each read command; items live for some days."""
    return drain_reads(spark, sf, shared_folder(spark))


__all__ = ["POOL"]
