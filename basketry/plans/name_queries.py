"""Queries on names: keys, corrections, cascades, validity, makers, extraction from texts, triage, display."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import medicines as M, names as N, steps as S, strings as T, texts as X
from ..operators import lookup, normalize
from ..sources.tables import read
from .pool import BASKETS_SQL, NAMES_SQL, POOL, baskets, names, per_name
from .registry import query

Q = S.quoted


@query("name_keys", f"WITH {NAMES_SQL} SELECT k, {S.sql('name', M.PLAIN_STEPS)} AS plain, {S.sql('name', M.MISREAD_STEPS)} AS misread, coalesce(nullif({S.sql('name', M.DOSAGE_STEPS)}, ''), name) AS short, trim(coalesce({S.first_contained_sql(S.sql('name', M.VOTED_STEPS), M.VOTED)}, {S.sql('name', M.VOTED_STEPS)})) AS voted, {S.sql('name', M.SYMBOL_STEPS)} AS bare, {S.sql('name', M.KATAKANA_STEPS)} AS kana FROM nm", with_mentions=False)
def _(spark, sf):
    c = F.col("name")
    keys = lambda d: d.select("name", M.plain(c).alias("plain"), M.misread(c).alias("misread"), M.without_dosage(c).alias("short"), M.voted_name(c).alias("voted"), M.without_symbols(c).alias("bare"), M.katakana(c).alias("kana"))
    return per_name(names(spark, sf), keys).drop("name", "maker")


FOLD_SQL = S.sql("name", [("replace", a, b) for a, b in M.ALIASES.items()])
ALIAS_SQL = f"coalesce({S.mapped_sql('name', M.ALIASES)}, {FOLD_SQL})"
RATIO_SQL = "CAST(floor(200.0 * len(list_filter(string_split({a}, ''), lambda x: x <> '' AND contains({b}, x))) / (length({a}) + length({b}))) AS BIGINT)"
NEAR_SQL = "CASE " + " ".join(f"WHEN {RATIO_SQL.format(a='lower(name)', b=Q(k.lower()))} >= 80 THEN {Q(v)}" for k, v in M.CORRECTIONS.items()) + " END"
SHORT_SQL = "(CASE " + " ".join(f"WHEN name = {Q(k)} THEN {Q(v)}" for k, v in M.CORRECTIONS.items()) + f" ELSE coalesce({S.first_contained_sql('name', M.CORRECTIONS, True)}, {NEAR_SQL}, name) END)"


@query("name_corrections", f"WITH {NAMES_SQL} SELECT k, {SHORT_SQL} AS corrected, {ALIAS_SQL} AS alias, {S.sql(ALIAS_SQL, M.ENDING_STEPS)} AS prepared FROM nm", with_mentions=False)
def _(spark, sf):
    c = F.col("name")
    return per_name(names(spark, sf), lambda d: d.select("name", M.corrected(c).alias("corrected"), M.alias_fixed(c).alias("alias"), M.prepared(c).alias("prepared"))).drop("name", "maker")


def _score_sql(n: str) -> str:
    return RATIO_SQL.format(a="p", b=Q(n))


@query("best_of_sixteen", f"WITH {NAMES_SQL}, p AS (SELECT k, {S.sql('name', M.MISREAD_STEPS)} AS p FROM nm), s AS (" + " UNION ALL ".join(f"SELECT k, {Q(n)} AS best, {_score_sql(n)} AS score, {i} AS i FROM p WHERE p <> ''" for i, n in enumerate(M.SIXTEEN)) + ") SELECT k, best, score FROM s WHERE score >= 70 QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, i) = 1", with_mentions=False)
def _(spark, sf):
    """The best of sixteen names by overlap, at least 70."""
    best = M.best_of(M.misread(F.col("name")))
    return per_name(names(spark, sf), lambda d: d.select("name", best.alias("b"))).where("b IS NOT NULL").select("k", F.col("b.name").alias("best"), "b.score")


MAKER_SQL = "CASE " + " ".join(f"WHEN {S.any_of_sql('maker', words)} THEN {Q(n)}" for n, words in M.MAKERS.items()) + " END"
MADE_SQL = "CASE WHEN maker IS NULL OR maker = '' THEN w " + " ".join(f"WHEN {S.any_of_sql('maker', M.MAKERS[n])} AND ({S.first_contained_sql('w', {p: p for p in ps}, True)}) IS NOT NULL THEN {S.first_contained_sql('w', {p: p for p in ps}, True)}" for n, ps in M.MADE_BY.items()) + " ELSE w END"
AMOUNT_SQL = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(maker, '[0-9]+\\.?[0-9]*[\\s　]*{u}') THEN regexp_extract(maker, '([0-9]+\\.?[0-9]*)[\\s　]*{u}', 1) || '{u}' END" for u in ("mg", "g", "ml", "μg")) + ")"
FORCED_SQL = "CASE " + " ".join(f"WHEN regexp_matches(p, {Q(p)}) THEN {Q(v)}" for p, v in M.CONFUSED.items()) + " ELSE p END"
KNOWN = ("ボノプラザン", "ニコランジル", "テラムロAP", "サクビトリル/バルサルタン", "レンボレキサント")


@query("normalized_names", f"WITH {NAMES_SQL}, a AS (SELECT *, {ALIAS_SQL} AS a FROM nm), w AS (SELECT *, coalesce({S.mapped_sql('a', M.NORMAL_NAMES)}, a) AS w FROM a), d AS (SELECT *, {MADE_SQL} AS d FROM w), p AS (SELECT *, coalesce({S.first_contained_sql('d', M.PARTS)}, d) AS p FROM d), f AS (SELECT *, {FORCED_SQL} AS f FROM p) SELECT k, concat_ws('>', a, w, d, p, f) AS steps, f AS result, {MAKER_SQL} AS made_by, {AMOUNT_SQL} AS amount, least(round(0.5 + CASE WHEN maker <> '' THEN 0.3 ELSE 0 END + CASE WHEN f IN (" + ", ".join(sorted({Q(v) for v in M.NORMAL_NAMES.values()})) + ") THEN 0.2 ELSE 0 END + CASE WHEN f IN (" + ", ".join(map(Q, KNOWN)) + ") THEN 0.2 ELSE 0 END, 2), 1.0) AS confidence FROM f", with_mentions=False)
def _(spark, sf):
    """Five ordered steps with their results; the confidence from maker, map and a list of names known to exist."""
    steps = M.normalized(F.col("name"), F.col("maker"))
    out = per_name(names(spark, sf), lambda d: d.withColumn("s", steps), ("name", "maker")).withColumn("result", F.element_at("s", -1).result)
    point = lambda test, x: F.when(test, x).otherwise(0.0)
    conf = 0.5 + point(F.col("maker") != "", 0.3) + point(F.col("result").isin(*sorted(set(M.NORMAL_NAMES.values()))), 0.2) + point(F.col("result").isin(*KNOWN), 0.2)
    return out.select("k", F.array_join(F.col("s.result"), ">").alias("steps"), "result", M.maker(F.col("maker")).alias("made_by"), M.amount(F.col("maker")).alias("amount"), F.least(F.round(conf, 2), F.lit(1.0)).alias("confidence"))


def _noise_sql(patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(name, {Q(p)})" for p in patterns) + ")"


@query("validity_predicates", f"WITH {NAMES_SQL} SELECT k, length(name) >= 2 AND NOT {_noise_sql(M.NOISE_CLASSES)} AND regexp_matches(name, {Q(M.FORM_PATTERN)}) AND regexp_matches(name, {Q(M.NAME_CHARACTERS)}) AS candidate, length(name) < 2 OR {_noise_sql(M.MORE_NOISE_CLASSES)} AS noise, length(name) >= 3 AND NOT {S.any_of_sql('name', M.NOT_NAMES)} AND ({S.any_of_sql('name', M.SURE_NAMES)} OR length(regexp_replace(name, '[^゠-ヿ]', '', 'g')) >= length(name) * 0.5) AS named, length(name) >= 2 AND regexp_matches(name, {Q(M.SOME_PATTERN)}) AS some_name, length(name) >= 2 AND NOT {S.any_of_sql('name', M.PROMPT_WORDS)} AS no_prompt, NOT (contains(name, 'ジクロフェナク') AND NOT {S.any_of_sql('maker', ('ゲル', '外用', '貼付'))}) AS stays FROM nm", with_mentions=False)
def _(spark, sf):
    c = F.col("name")
    return names(spark, sf).select("k", M.valid_candidate(c).alias("candidate"), M.noise(c).alias("noise"), M.valid_name(c).alias("named"), M.some_name(c).alias("some_name"), M.no_prompt(c).alias("no_prompt"), M.external_only(c, F.col("maker")).alias("stays"))


#: Pool names as they must come out: composed by hand, then cleaned by the rules.
CANONICAL = [
    ("タダラフィル「サンド」", "タダラフィル"), ("アムロジピン5mg", "アムロジピン"), ("ｱﾑﾛｼﾞﾋﾟﾝ ２．５ｍｇ", "アムロジピン"), ("エンレスト(心不全)", "サクビトリル/バルサルタン"), ("テラムロAP", "テルミサルタン/アムロジピン"),
    ("アムロジピン・テルミサルタン", "テルミサルタン/アムロジピン"), ("テラムロ OD", "テラムロ"), ("センナ，センナ実", "センナ/センナ実"), ("ランソプラゾールOD", "ランソプラゾール"), ("タケキャブ10MG", "ボノプラザン"),
]


@query("canonical_names", "WITH " + S.values_sql("c", "i, name", [(i, v) for i, (_, v) in enumerate(CANONICAL)]) + f" SELECT p_partkey AS k, name FROM part JOIN c ON i = p_partkey % {len(CANONICAL)}", with_mentions=False)
def _(spark, sf):
    """Names with makers, amounts, full and half width against names worked out by hand."""
    k = F.col("p_partkey")
    raw = F.element_at(F.array(*(F.lit(a) for a, _ in CANONICAL)), (k % len(CANONICAL)).cast("int") + 1)
    return read(spark, sf, "part").select(k.alias("k"), N.canonical(raw).alias("name"))


@query("maker_hints", f"WITH {NAMES_SQL}, made AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{p}')" for m, ps in M.MADE_BY.items() for p in ps) + f") AS v(company, product)) SELECT k, company, max(CASE WHEN name = product THEN 0.9 ELSE 0.85 END) AS score FROM nm JOIN made ON contains(name, product) OR contains(product, name) WHERE length(name) >= 3 GROUP BY k, company", with_mentions=False)
def _(spark, sf):
    """Makers of a name, by products that are the name or hold it or are held by it."""
    table = F.array(*(F.struct(F.lit(m).alias("company"), F.lit(p).alias("product")) for m, ps in M.MADE_BY.items() for p in ps))
    fits = lambda e: F.contains(F.col("name"), e["product"]) | F.contains(e["product"], F.col("name"))
    hit = names(spark, sf).where("length(name) >= 3").select("k", "name", F.explode(F.filter(table, fits)).alias("e"))
    return hit.groupBy("k", "e.company").agg(F.max(F.when(F.col("name") == F.col("e.product"), 0.9).otherwise(0.85)).alias("score"))


SCORE_SQL = "round({r} * 0.4 + CASE WHEN contains(b, a) OR contains(a, b) THEN 100 ELSE {r} END * 0.3 + {t} * 0.2 + CASE WHEN contains(b, a) OR contains(a, b) THEN 10 ELSE 0 END * 0.03 + CASE WHEN {s} THEN 15 ELSE 0 END * 0.02, 6)"
SORTED_SQL = "array_to_string(list_sort(string_split({x}, ' ')), ' ')"
PAIRS_SQL = "WITH n AS (SELECT DISTINCT p_name AS name FROM part), q0 AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON split_part(a.name, ' ', 1) = split_part(b.name, ' ', 1)), q AS (SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb FROM q0)"


@query("match_scores", PAIRS_SQL + " SELECT a, b, " + RATIO_SQL.format(a="sa", b="sb") + " AS token_sort, " + SCORE_SQL.format(r=RATIO_SQL.format(a="a", b="b"), t=RATIO_SQL.format(a="sa", b="sb"), s=" OR ".join(f"(ends_with(a, {Q(x)}) AND contains(b, {Q(x)}))" for x in M.SUFFIXES)) + " AS score FROM q", with_mentions=False)
def _(spark, sf):
    """The weighted score of two names and its parts; no English name is given."""
    n = read(spark, sf, "part").select(F.col("p_name").alias("a")).distinct().withColumn("g", F.substring_index("a", " ", 1))
    a, b = F.col("a"), F.col("b")
    held = F.when(F.contains(b, a) | F.contains(a, b), 10).otherwise(0)
    token = T.token_sort_ratio(a, b)
    score = T.char_overlap_ratio(a, b) * 0.4 + T.partial_ratio(a, b) * 0.3 + token * 0.2 + held * 0.03 + M.suffix_bonus(a, b) * 0.02
    return n.join(n.withColumnRenamed("a", "b"), "g").select("a", "b", token.alias("token_sort"), F.round(score, 6).alias("score"))


@query("nearest_names", "WITH n AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT DISTINCT replace(p_name, 'e', 'a') || 's' AS q FROM part) SELECT q, name, CAST(levenshtein(q, name) AS INTEGER) AS distance FROM q, n QUALIFY row_number() OVER (PARTITION BY q ORDER BY levenshtein(q, name), name) = 1", with_mentions=False)
def _(spark, sf):
    """The dictionary's nearest name by edits, whatever the dictionary's size."""
    parts = read(spark, sf, "part")
    asked = parts.select(F.concat(F.replace("p_name", F.lit("e"), F.lit("a")), F.lit("s")).alias("q")).distinct()
    return lookup.nearest(asked, parts.select(F.col("p_name").alias("name")).distinct())


@query("normalizer_cascade")
def _(spark, sf):
    """Each distinct name by the dictionary, by curated candidates, by similarity, or unknown, with the confidence."""
    return normalize.normalize(names(spark, sf).select("name").distinct())


@query("line_triage", f"WITH {NAMES_SQL}, l AS (SELECT k, name, CASE k % 4 WHEN 0 THEN name || ' 2錠 7日分' WHEN 1 THEN name || ' 3枚' WHEN 2 THEN name || 'テープ 20mg 2錠' ELSE name || ' ゾロ ゾラ' END AS line, round((k % 11) / 10.0, 1) AS conf, CASE k % 3 WHEN 0 THEN name WHEN 1 THEN 'x' ELSE '' END AS normal FROM nm), f AS (SELECT *, CASE WHEN name = normal THEN 1.0 WHEN normal <> '' THEN 0.8 ELSE 0.0 END AS agree, CASE WHEN regexp_matches(line, 'テープ|パップ') THEN 'テープ' WHEN contains(line, '錠') THEN '錠' END AS form, regexp_replace(regexp_extract(line, '[0-9]+\\s*(?:錠|枚)'), '\\s', '', 'g') AS qty FROM l), s AS (SELECT k, round(0.5 * conf + 0.3 * agree + 0.2 * (CASE WHEN agree >= 0.8 THEN 1 ELSE 0 END + CASE WHEN qty = '' OR form IS NULL OR (form = '錠' AND contains(qty, '錠')) OR (form = 'テープ' AND contains(qty, '枚')) THEN 1 ELSE 0 END + CASE WHEN contains(line, 'ゾロ') AND contains(line, 'ゾラ') THEN 0 ELSE 1 END) / 3, 3) AS score FROM f) SELECT k, score, CASE WHEN score >= 0.85 THEN 'auto_confirm' WHEN score >= 0.6 THEN 'needs_review' ELSE 'fail' END AS status FROM s", with_mentions=False)
def _(spark, sf):
    k, c = F.col("k"), F.col("name")
    line = F.concat(c, F.when(k % 4 == 0, " 2錠 7日分").when(k % 4 == 1, " 3枚").when(k % 4 == 2, "テープ 20mg 2錠").otherwise(" ゾロ ゾラ"))
    normal = F.when(k % 3 == 0, c).when(k % 3 == 1, "x").otherwise("")
    out = X.triage(line, c, normal, F.round((k % 11) / 10.0, 1), {"錠": ("錠",), "テープ": ("枚",)}, [("ゾロ", "ゾラ")])
    return names(spark, sf).select("k", out.alias("t")).select("k", "t.*")


DISPLAY_SQL = "CASE WHEN contains(name, 'アスピリン') THEN CASE WHEN contains(name, '腸溶') THEN 'アスピリン腸溶' ELSE 'アスピリン' END WHEN contains(name, 'ファモチジン') THEN CASE WHEN contains(name, '口腔内崩壊') OR contains(name, 'OD錠') THEN 'ファモチジン口腔内崩壊' ELSE 'ファモチジン' END WHEN contains(name, 'センナ') THEN CASE WHEN contains(name, 'センナ実') THEN 'センナ実配合' ELSE 'センナ' END ELSE name END"


@query("display_summary", f"WITH {NAMES_SQL}, g AS (SELECT k // 40 AS g, {DISPLAY_SQL} AS shown, min(k) AS first FROM nm GROUP BY ALL), a AS (SELECT g, list(shown ORDER BY first) AS l FROM g GROUP BY g) SELECT g, CASE WHEN len(l) <= 5 THEN len(l) || '剤検出: ' || array_to_string(l, ', ') ELSE len(l) || '剤検出: ' || array_to_string(l[1:3], ', ') || ' 他' || (len(l) - 3) || '剤' END AS summary FROM a", with_mentions=False)
def _(spark, sf):
    """Names as they are shown, and the summary of each list in the order of first appearance."""
    shown = M.displayed_one(F.col("name"), F.col("name"))
    g = names(spark, sf).groupBy(F.floor(F.col("k") / 40).alias("g")).agg(F.array_sort(F.collect_list(F.struct("k", shown.alias("s")))).alias("x"))
    return g.select("g", M.summary(F.col("x.s")).alias("summary"))


LEFT_SQL = S.sql("trim(" + S.sql("replace(name, 'ロ腔', '口腔')", S.replaced(N.PLAIN_FORMS)) + ")", S.replaced(N.FORMS))
KEY_SQL = "CASE WHEN contains(g, 'スボレキサント') THEN 'スボレキサント' WHEN contains(g, 'レンボレキサント') THEN 'レンボレキサント' ELSE replace(g, ' ', '') END"


@query("form_agnostic_dedupe", BASKETS_SQL + f", l AS (SELECT rx_id, pos, name, confidence, {LEFT_SQL} AS l FROM b), g AS (SELECT *, coalesce({S.first_contained_sql('l', N.SYNONYMS)}, l) AS g FROM l), r AS (SELECT *, {KEY_SQL} AS key, {S.any_of_sql('name', N.EXTERNAL)} AS outside FROM g), one AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rx_id, key, outside ORDER BY confidence DESC, pos) = 1) SELECT rx_id, key, name, pos FROM one QUALIFY row_number() OVER (PARTITION BY rx_id, key ORDER BY confidence DESC, pos) = 1")
def _(spark, sf):
    """Best row of each name and route, then of each name whatever the form; two sleeping aids are told apart."""
    key = N.form_agnostic_key(F.col("name"))
    best = [F.desc("confidence"), F.col("pos")]
    b = baskets(spark, sf).select("rx_id", "pos", "name", "confidence").withColumn("route", N.route(F.col("name"))).withColumn("key", key)
    one = b.withColumn("n", F.row_number().over(Window.partitionBy("rx_id", "key", "route").orderBy(*best))).where("n = 1")
    return one.withColumn("n", F.row_number().over(Window.partitionBy("rx_id", "key").orderBy(*best))).where("n = 1").select("rx_id", "key", "name", "pos")


CLEAN_SQL = "replace(replace(replace(content, '（医療用）', ''), '次頁に続く', ''), '医療用', '')"


def _names_sql(pattern: str, least: int) -> str:
    found = f"list_filter(list_transform(regexp_extract_all(t, {Q(pattern)}, 1), lambda x: trim(x)), lambda x: length(x) >= {least})"
    return f"list_filter(list_transform({found}, lambda x: regexp_replace(x, '^[0-9]', '')), lambda x: length(x) >= {least})"


#: Without a look ahead the amount itself is passed over, which only loses pieces of numbers that are too short to count.
ALL_NAMES_SQL = " || ".join([_names_sql(X.BEFORE_FORMS, 2), *(_names_sql(p.replace("(?=", "(?:"), 3) for p in X.BEFORE_AMOUNTS)])


@query("block_names", f"WITH {NAMES_SQL}, bl AS (SELECT k, 1 AS number, name || '錠 1日3回' AS content FROM nm UNION ALL SELECT k, 2, '7オルケディア錠1mg ツムラ芍薬甘草湯エキス顆粒' FROM nm UNION ALL SELECT k, 3, 'センノシド 12mg 眠前' FROM nm WHERE k % 3 = 0), al AS (SELECT k, number, {ALL_NAMES_SQL} AS l FROM (SELECT k, number, {CLEAN_SQL} AS t FROM bl)) SELECT k, number, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS names FROM al", with_mentions=False)
def _(spark, sf):
    """Names before form words in numbered blocks made of each part's names."""
    text = F.concat(F.lit("1 "), F.col("name"), F.lit("錠 1日3回\n2 7オルケディア錠1mg ツムラ芍薬甘草湯エキス顆粒\n"), F.when(F.col("third"), "3 センノシド 12mg 眠前").otherwise(""))
    named = lambda b: F.struct(b.number.alias("number"), F.array_join(X.names_before_forms(b.content), "|").alias("names"))
    blocks = lambda d: d.select("name", "third", F.transform(X.numbered_blocks(text), named).alias("b"))
    rows = names(spark, sf).select("k", "name", (F.col("k") % 3 == 0).alias("third"))
    return per_name(rows, blocks, ("name", "third")).select("k", F.explode("b").alias("b")).select("k", "b.number", "b.names")


def _cut_sql() -> str:
    out = "[line]"
    for words in X.FORM_FAMILIES:
        out = f"flatten(list_transform({out}, lambda x: CASE WHEN regexp_matches(x, {Q(words)}) THEN list_filter(list_transform(regexp_extract_all(x, {Q(f'(?s).*?(?:{words})')}), lambda y: trim(y)), lambda y: y <> '') ELSE [x] END))"
    return out


@query("form_split", f"WITH {NAMES_SQL} SELECT k, array_to_string({_cut_sql()}, '|') AS parts FROM (SELECT k, name || '錠 テープ' || name || '軟膏の残り' AS line FROM nm)", with_mentions=False)
def _(spark, sf):
    """Lines cut behind form words, family after family of forms; what follows the last one goes."""
    line = F.concat("name", F.lit("錠 テープ"), "name", F.lit("軟膏の残り"))
    return names(spark, sf).select("k", F.array_join(X.cut_behind_forms(line), "|").alias("parts"))


def _candidates_sql() -> str:
    noise = "length(x) < 2 OR " + " OR ".join(f"regexp_matches(x, {Q(p)})" for p in M.MORE_NOISE_CLASSES)
    found = " || ".join(f"regexp_extract_all(t, {Q(p)}, 1)" for p in X.NAME_PATTERNS)
    held = "[" + ", ".join(f"CASE WHEN contains(t, {Q(k)}) THEN {Q(v)} END" for k, v in M.VOTED.items()) + "]"
    hits = " || ".join(f"regexp_extract_all(t, {Q('(?i)' + p)})" for p in X.EXPECTED)
    lines = "list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '錠|mg|µg|g') AND regexp_matches(x, '[0-9]'))"
    return f"array_to_string(list_sort(list_distinct(list_transform(list_filter({found}, lambda x: NOT ({noise})), lambda x: trim(x)))), '|') AS regex, coalesce(array_to_string(list_sort(list_distinct(list_filter({held}, lambda x: x IS NOT NULL))), '|'), '') AS dictionary, array_to_string(CASE WHEN len({hits}) > 0 THEN {hits} ELSE {lines} END, '|') AS fixed"


@query("pattern_candidates", f"WITH {NAMES_SQL} SELECT k, {_candidates_sql()} FROM (SELECT k, '処方 ' || name || '錠 と ツムラ大建中湯エキス顆粒' || chr(10) || 'アムロジピン口腔内崩壊錠 5mg' || chr(10) || '数量 3錠' AS t FROM nm)", with_mentions=False)
def _(spark, sf):
    """Names by patterns and by a dictionary, and lines of fixed form; three sources of a vote."""
    text = F.concat(F.lit("処方 "), "name", F.lit("錠 と ツムラ大建中湯エキス顆粒\nアムロジピン口腔内崩壊錠 5mg\n数量 3錠"))
    found = lambda d: d.select("name", F.array_join(X.pattern_names(text), "|").alias("regex"), F.array_join(X.dictionary_names(text, M.VOTED), "|").alias("dictionary"), F.array_join(X.expected_lines(text), "|").alias("fixed"))
    return per_name(names(spark, sf), found).drop("name", "maker")


@query("direct_tokens", "SELECT p_partkey AS k, len(string_split(p_name || ' ' || p_type, ' ')) >= 2 AS direct, string_split(p_name || ' ' || p_type, ' ')[1] AS first FROM part", with_mentions=False)
def _(spark, sf):
    """Names typed with blanks between them: two at least are a direct input."""
    t = F.split(F.trim(F.concat(F.lit(" "), "p_name", F.lit("  "), "p_type")), r"\s+")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.size(t) >= 2).alias("direct"), t[0].alias("first"))


__all__ = ["POOL"]
