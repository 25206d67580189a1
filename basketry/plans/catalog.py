"""The registered queries of the rule engine over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import strings as S
from ..operators import dedupe, pairs, rules
from ..operators.rules import Rule
from ..sources.tables import mentions, read
from ..streaming.buffer import drain_events, shared_folder
from .pool import baskets
from .registry import ORACLES, QUERIES, query  # noqa: F401

FLAGSHIP = "class_rule_report"

TAGS = {"PROMO": ("A", "X"), "ECONOMY": ("B", "X"), "SMALL": ("C",), "LARGE": ("D",), "MEDIUM": ("E",), "STANDARD": ("F",)}
PAIR_RULES = [("PROMO", "SMALL", "contraindicated"), ("SMALL", "PROMO", "caution"), ("LARGE", "ECONOMY", "caution"), ("MEDIUM", "MEDIUM", "duplicate"), ("STANDARD", "PROMO", "monitor")]
TAG_RULES = [Rule("all_tags", "all_of", ("A", "C"), severity="major", priority=0), Rule("summed_tags", "tag_sum", ("A", "X", "D"), least=3), Rule("two_named", "at_least", ("B", "E"), least=2, severity="minor", priority=3)]
SET_RULES = [Rule("requires", "all_of", ("PROMO", "LARGE")), Rule("any_with_any", "any_any", ("SMALL", "MEDIUM"), ("STANDARD",)), Rule("threshold", "at_least", ("PROMO", "ECONOMY", "SMALL"), least=3)]
CLASS_RULES = [
    Rule("contra", "all_of", ("PROMO", "SMALL"), severity="major", priority=0),
    Rule("overlap", "at_least", ("PROMO", "SMALL", "LARGE"), least=2, unless=("contra",)),
    Rule("poly", "at_least", ("PROMO", "SMALL", "LARGE", "ECONOMY"), least=3),
    Rule("mixed", "any_any", ("ECONOMY", "MEDIUM"), ("STANDARD",), priority=1),
    Rule("dup_medium", "at_least", ("MEDIUM",), least=2),
    Rule("dup_standard", "at_least", ("STANDARD",), least=2, priority=3),
]
TAGGED_SQL = "t AS (SELECT rx_id, name, tag FROM m JOIN (VALUES " + ", ".join(f"('{k}', '{t}')" for k, ts in TAGS.items() for t in ts) + ") AS v(cls, tag) USING (cls))"


def score():
    return F.when(F.col("qty") >= 25, 1).otherwise(0) + F.when(F.col("tax") > 0.02, 1).otherwise(0) + F.col("confidence")


SCORE_SQL = "(CASE WHEN qty >= 25 THEN 1 ELSE 0 END + CASE WHEN tax > 0.02 THEN 1 ELSE 0 END + confidence)"
BEST = lambda: [F.desc(score()), F.col("pos")]


@query("dedupe_best_per_key", f"SELECT rx_id, brand, name, min(pos) OVER (PARTITION BY rx_id, brand) AS pos FROM m QUALIFY row_number() OVER (PARTITION BY rx_id, brand ORDER BY {SCORE_SQL} DESC, pos) = 1")
def _(spark, sf):
    return dedupe.best_per_key(mentions(spark, sf), ["rx_id", "brand"], BEST(), "pos").select("rx_id", "brand", "name", "pos")


@query("dedupe_two_stage", f", a AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY rx_id, brand, name ORDER BY {SCORE_SQL} DESC, pos) = 1) SELECT rx_id, brand, name, pos FROM a QUALIFY row_number() OVER (PARTITION BY rx_id, brand ORDER BY {SCORE_SQL} DESC, pos) = 1")
def _(spark, sf):
    return dedupe.two_stage(mentions(spark, sf), ["rx_id", "brand", "name"], ["rx_id", "brand"], BEST()).select("rx_id", "brand", "name", "pos")


@query("dedupe_first_by_name", "SELECT rx_id, name, pos FROM m QUALIFY row_number() OVER (PARTITION BY rx_id, name ORDER BY pos) = 1")
def _(spark, sf):
    return dedupe.first_by(mentions(spark, sf), ["rx_id", "name"]).select("rx_id", "name", "pos")


@query("collapse_variants", "SELECT rx_id, cls, name, pos FROM m QUALIFY row_number() OVER (PARTITION BY rx_id, cls ORDER BY qty DESC, confidence DESC, pos) = 1")
def _(spark, sf):
    return dedupe.best_per_key(mentions(spark, sf), ["rx_id", "cls"], [F.desc("qty"), F.desc("confidence"), F.col("pos")]).select("rx_id", "cls", "name", "pos")


@query("combo_collapse_antijoin", ", w AS (SELECT rx_id, pos, name FROM m UNION ALL SELECT rx_id, 100 + pos, split_part(name, ' ', 2) FROM m WHERE pos % 2 = 1), p AS (SELECT rx_id, flatten(list(string_split(name, ' '))) AS parts FROM w WHERE contains(name, ' ') GROUP BY rx_id) SELECT rx_id, pos, w.name FROM w LEFT JOIN p USING (rx_id) WHERE parts IS NULL OR NOT list_contains(parts, w.name)")
def _(spark, sf):
    m = mentions(spark, sf)
    single = m.where("pos % 2 = 1").select("rx_id", (F.col("pos") + 100).alias("pos"), F.substring_index("name", " ", -1).alias("name"))
    return dedupe.collapse_combos(m.select("rx_id", "pos", "name").union(single), "rx_id", "name").select("rx_id", "pos", "name")


@query("pair_rules", ", r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{k}')" for i, (a, b, k) in enumerate(PAIR_RULES)) + ") AS v(ord, x, y, risk)), d AS (SELECT ord, x, y, risk FROM r UNION ALL SELECT ord, y, x, risk FROM r), f AS (SELECT x, y, arg_min(risk, ord) AS risk FROM d GROUP BY x, y) SELECT a.rx_id, a.pos AS a_pos, b.pos AS b_pos, risk FROM m a JOIN m b ON a.rx_id = b.rx_id AND a.pos < b.pos JOIN f ON a.cls = x AND b.cls = y")
def _(spark, sf):
    return pairs.apply_pair_rules(pairs.item_pairs(mentions(spark, sf), ["cls"]), "cls", PAIR_RULES).select("rx_id", "a_pos", "b_pos", "risk")


@query("same_effect_pairs", "SELECT a.rx_id, a.pos AS a_pos, b.pos AS b_pos, a.brand AS brand FROM m a JOIN m b ON a.rx_id = b.rx_id AND a.pos < b.pos AND a.brand = b.brand")
def _(spark, sf):
    return pairs.item_pairs(mentions(spark, sf), ["brand"]).where("a_brand = b_brand").select("rx_id", "a_pos", "b_pos", F.col("a_brand").alias("brand"))


@query("capped_pairs", ", c AS (SELECT * FROM m WHERE pos < 10), n AS (SELECT rx_id FROM c GROUP BY rx_id HAVING count(*) * (count(*) - 1) / 2 <= 20) SELECT a.rx_id, a.pos AS a_pos, b.pos AS b_pos FROM c a JOIN c b ON a.rx_id = b.rx_id AND a.pos < b.pos WHERE a.rx_id IN (SELECT rx_id FROM n)")
def _(spark, sf):
    return pairs.item_pairs(mentions(spark, sf), [], 10, 20).select("rx_id", "a_pos", "b_pos")


@query("category_duplicates", "SELECT rx_id, cls, count(*) AS n, array_to_string(list_sort(list_distinct(list(name))), ', ') AS names FROM m GROUP BY rx_id, cls HAVING count(*) >= 2")
def _(spark, sf):
    g = mentions(spark, sf).groupBy("rx_id", "cls").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    return g.where("n >= 2")


@query("tag_counts", f", {TAGGED_SQL} SELECT rx_id, tag, count(DISTINCT name) AS n FROM t GROUP BY rx_id, tag")
def _(spark, sf):
    return rules.tagged(mentions(spark, sf), TAGS, "cls").groupBy("rx_id", "tag").agg(F.countDistinct("name").alias("n"))


@query("tag_rule_hits", f", {TAGGED_SQL} " + rules.evaluate_sql(TAG_RULES, "t"))
def _(spark, sf):
    return rules.evaluate(rules.tagged(mentions(spark, sf), TAGS, "cls"), TAG_RULES)


CLS_SQL = ", c AS (SELECT rx_id, name, cls AS tag FROM m) "


@query("set_rule_hits", CLS_SQL + rules.evaluate_sql(SET_RULES, "c"))
def _(spark, sf):
    return rules.evaluate(mentions(spark, sf).withColumn("tag", F.col("cls")), SET_RULES)


def class_findings(spark, sf):
    kept = dedupe.best_per_key(mentions(spark, sf), ["rx_id", "brand"], BEST())
    return rules.evaluate(kept.withColumn("tag", F.col("cls")), CLASS_RULES)


REPORT_SQL = f", c AS (SELECT rx_id, name, cls AS tag FROM m QUALIFY row_number() OVER (PARTITION BY rx_id, brand ORDER BY {SCORE_SQL} DESC, pos) = 1), f AS (" + rules.evaluate_sql(CLASS_RULES, "c") + ") "


@query("class_rule_report", REPORT_SQL + "SELECT rx_id, rule_id, severity, priority, targets, row_number() OVER (PARTITION BY rx_id ORDER BY priority, rule_id) AS rank FROM f")
def _(spark, sf):
    w = Window.partitionBy("rx_id").orderBy("priority", "rule_id")
    return class_findings(spark, sf).withColumn("rank", F.row_number().over(w).cast("long"))


@query("priority_sort_render", REPORT_SQL + "SELECT rx_id, string_agg('[' || severity || '] ' || rule_id || ': ' || targets, chr(10) ORDER BY priority, rule_id) AS report FROM f GROUP BY rx_id")
def _(spark, sf):
    line = F.concat(F.lit("["), "severity", F.lit("] "), "rule_id", F.lit(": "), "targets")
    lines = class_findings(spark, sf).groupBy("rx_id").agg(F.array_sort(F.collect_list(F.struct("priority", "rule_id", line.alias("line")))).alias("x"))
    return lines.select("rx_id", F.array_join(F.col("x.line"), "\n").alias("report"))


@query("overall_risk", REPORT_SQL + ", s AS (SELECT rx_id, CAST(100 * max(CASE WHEN priority = 0 THEN 1 ELSE 0 END) + 30 * count(*) FILTER (priority IN (1, 2)) + 10 * count(*) FILTER (priority = 3) AS BIGINT) AS score, count(*) FILTER (priority IN (1, 2)) AS high, count(*) FILTER (priority = 0) AS crit FROM f GROUP BY rx_id) SELECT rx_id, score, CASE WHEN crit > 0 THEN 'critical' WHEN high > 0 THEN 'high' ELSE 'low' END AS level FROM s")
def _(spark, sf):
    n = lambda c: F.count_if(c)
    g = class_findings(spark, sf).groupBy("rx_id").agg(n(F.col("priority") == 0).alias("crit"), n(F.col("priority").isin(1, 2)).alias("high"), n(F.col("priority") == 3).alias("medium"))
    score_ = 100 * F.when(F.col("crit") > 0, 1).otherwise(0) + 30 * F.col("high") + 10 * F.col("medium")
    return g.select("rx_id", score_.cast("long").alias("score"), F.when(F.col("crit") > 0, "critical").when(F.col("high") > 0, "high").otherwise("low").alias("level"))


@query("similar_finding_antijoin", ", a AS (SELECT rx_id, list_sort(list_distinct(list(name))) AS t FROM m WHERE cls IN ('PROMO', 'SMALL') GROUP BY rx_id), b AS (SELECT rx_id, cls, list_sort(list_distinct(list(name))) AS t FROM m GROUP BY rx_id, cls) SELECT b.rx_id, b.cls, array_to_string(b.t, ', ') AS targets FROM b LEFT JOIN a USING (rx_id) WHERE a.t IS NULL OR NOT (len(list_intersect(a.t, b.t)) >= 2 OR (len(a.t) <= 2 AND len(list_intersect(a.t, b.t)) = len(a.t)))")
def _(spark, sf):
    m = mentions(spark, sf)
    names = F.array_sort(F.collect_set("name"))
    a = m.where(F.col("cls").isin("PROMO", "SMALL")).groupBy("rx_id").agg(names.alias("old"))
    b = m.groupBy("rx_id", "cls").agg(names.alias("t"))
    both = F.size(F.array_intersect("old", "t"))
    similar = (both >= 2) | ((F.size("old") <= 2) & (both == F.size("old")))
    return b.join(a, "rx_id", "left").where(F.col("old").isNull() | ~similar).select("rx_id", "cls", F.array_join("t", ", ").alias("targets"))


@query("confidence_gate", "SELECT rx_id, count(*) FILTER (c < 0.6 AND cls = 'STANDARD') AS flagged, bool_or(c < 0.6 AND cls = 'STANDARD') AS warn FROM (SELECT *, CASE WHEN confidence IS NULL OR confidence = 0 THEN 1.0 ELSE confidence END AS c FROM m) GROUP BY rx_id")
def _(spark, sf):
    c = F.when(F.col("confidence").isNull() | (F.col("confidence") == 0), 1.0).otherwise(F.col("confidence"))
    low = (c < 0.6) & (F.col("cls") == "STANDARD")
    return mentions(spark, sf).groupBy("rx_id").agg(F.count_if(low).alias("flagged"), F.bool_or(low).alias("warn"))


@query("quality_gate", ", g AS (SELECT rx_id, count(*) FILTER (cls <> 'STANDARD') / count(*) AS coverage, count(*) FILTER (confidence < 0.8) AS low, count(*) AS n FROM m GROUP BY rx_id) SELECT rx_id, n, low, concat_ws(',', CASE WHEN coverage < 0.9 THEN 'low_coverage' END, CASE WHEN low > 0 THEN 'low_confidence' END, CASE WHEN n > 20 OR n < 1 THEN 'count_out_of_range' END) AS issues, coverage >= 0.9 AS passed FROM g")
def _(spark, sf):
    g = mentions(spark, sf).groupBy("rx_id").agg((F.count_if(F.col("cls") != "STANDARD") / F.count("*")).alias("coverage"), F.count_if(F.col("confidence") < 0.8).alias("low"), F.count("*").alias("n"))
    issues = F.concat_ws(",", F.when(F.col("coverage") < 0.9, "low_coverage"), F.when(F.col("low") > 0, "low_confidence"), F.when((F.col("n") > 20) | (F.col("n") < 1), "count_out_of_range"))
    return g.select("rx_id", "n", "low", issues.alias("issues"), (F.col("coverage") >= 0.9).alias("passed"))


RATIO_SQL = "CAST(floor(200.0 * len(list_filter(string_split({a}, ''), lambda x: x <> '' AND contains({b}, x))) / (length({a}) + length({b}))) AS BIGINT)"
NAMES_SQL = "WITH n AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON split_part(a.name, ' ', 1) = split_part(b.name, ' ', 1)) "


def name_pairs(spark, sf):
    n = read(spark, sf, "part").select(F.col("p_name").alias("a")).distinct().withColumn("k", F.substring_index("a", " ", 1))
    return n.join(n.withColumnRenamed("a", "b"), "k")


@query("fuzzy_ratios", NAMES_SQL + f"SELECT a, b, {RATIO_SQL.format(a='a', b='b')} AS ratio, CASE WHEN contains(b, a) OR contains(a, b) THEN 100 ELSE {RATIO_SQL.format(a='a', b='b')} END AS partial, CAST(floor(100.0 * len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))) AS BIGINT) AS token_set FROM q", with_mentions=False)
def _(spark, sf):
    a, b = F.col("a"), F.col("b")
    return name_pairs(spark, sf).select("a", "b", S.char_overlap_ratio(a, b).alias("ratio"), S.partial_ratio(a, b).alias("partial"), S.token_set_ratio(a, b).alias("token_set"))


@query("prefix_longest_match", "WITH p AS (SELECT DISTINCT p_brand AS code FROM part), k AS (SELECT * FROM (VALUES ('Brand', 'any'), ('Brand#1', 'ones'), ('Brand#12', 'twelve'), ('Brand#2', 'twos')) AS v(prefix, label)) SELECT code, label FROM p JOIN k ON starts_with(code, prefix) QUALIFY row_number() OVER (PARTITION BY code ORDER BY length(prefix) DESC) = 1", with_mentions=False)
def _(spark, sf):
    table = {"Brand": "any", "Brand#1": "ones", "Brand#12": "twelve", "Brand#2": "twos"}
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    code = F.col("code")
    longest = F.coalesce(*(m[F.substring(code, 1, n)] for n in sorted({len(k) for k in table}, reverse=True)))
    return read(spark, sf, "part").select(F.col("p_brand").alias("code")).distinct().select("code", longest.alias("label"))


@query("classify_cascade", "SELECT p_partkey, CASE WHEN p_name LIKE '%widget%' THEN 'dictionary' WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'class' WHEN p_size > 25 THEN 'size' END AS label FROM part", with_mentions=False)
def _(spark, sf):
    label = F.coalesce(F.when(F.contains(F.col("p_name"), F.lit("widget")), "dictionary"), F.when(F.col("p_type").isin("PROMO", "ECONOMY"), "class"), F.when(F.col("p_size") > 25, "size"))
    return read(spark, sf, "part").select("p_partkey", label.alias("label"))


@query("consensus_vote", "WITH c AS (SELECT p_partkey AS k, split_part(p_name, ' ', 2) AS v, 'regex' AS s FROM part UNION ALL SELECT p_partkey, lower(p_type), 'dictionary' FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE lower(p_type) END, 'model' FROM part) SELECT k, v, count(*) AS votes, array_to_string(list_sort(list_distinct(list(s))), '+') AS sources, CASE WHEN count(*) >= 2 THEN round(least(0.95, 0.7 + 0.1 * (count(*) - 2)), 2) ELSE 0.5 END AS conf FROM c GROUP BY k, v", with_mentions=False)
def _(spark, sf):
    p = read(spark, sf, "part")
    noun, kind = F.substring_index("p_name", " ", -1), F.lower("p_type")
    sources = [p.select("p_partkey", noun, F.lit("regex")), p.where("p_size > 10").select("p_partkey", kind, F.lit("dictionary")), p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, noun).otherwise(kind), F.lit("model"))]
    c = sources[0].union(sources[1]).union(sources[2]).toDF("k", "v", "s")
    g = c.groupBy("k", "v").agg(F.count("*").alias("votes"), F.array_join(F.array_sort(F.collect_set("s")), "+").alias("sources"))
    conf = F.when(F.col("votes") >= 2, F.round(F.least(F.lit(0.95), 0.7 + 0.1 * (F.col("votes") - 2)), 2)).otherwise(0.5)
    return g.withColumn("conf", conf)


def events(spark, sf):
    return read(spark, sf, "events")


@query("last_n_history", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10", with_mentions=False)
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 10").select("user_id", "event_id", "ts")


@query("top5_per_user", "WITH g AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS first FROM events GROUP BY user_id, event_type) SELECT user_id, event_type, n FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first, event_type) <= 5", with_mentions=False)
def _(spark, sf):
    g = events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "first", "event_type"))).where("r <= 5").select("user_id", "event_type", "n")


@query("session_reset_buffer", "WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM events) SELECT user_id, CAST(seg AS BIGINT) AS seg, count(*) FILTER (event_type = 'purchase') AS added, max(ts) AS last_ts FROM s GROUP BY user_id, seg", with_mentions=False)
def _(spark, sf):
    seg = F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events(spark, sf).withColumn("seg", seg.cast("long")).groupBy("user_id", "seg").agg(F.count_if(F.col("event_type") == "purchase").alias("added"), F.max("ts").alias("last_ts"))


@query("retention_cleanup", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY", with_mentions=False)
def _(spark, sf):
    e = events(spark, sf)
    newest = F.broadcast(e.agg(F.max("ts").alias("newest")))  # one row
    return e.join(newest, F.col("ts") >= F.col("newest") - F.expr("INTERVAL 7 DAYS")).select("event_id", "ts")


@query("audit_summary_by_date", "SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS sessions, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY 1", with_mentions=False)
def _(spark, sf):
    return events(spark, sf).groupBy(F.to_date("ts").alias("date")).agg(F.countDistinct("user_id").alias("sessions"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))


@query("json_extract_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events", with_mentions=False)
def _(spark, sf):
    return events(spark, sf).select("event_id", F.from_json("props", "k int").k.alias("k"))


@query("learn_upsert_latest", "SELECT user_id, event_type AS kind, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type", with_mentions=False)
def _(spark, sf):
    return events(spark, sf).groupBy("user_id", F.col("event_type").alias("kind")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("union_sources", "SELECT rx_id, pos, name, 'a' AS source FROM m WHERE cls = 'PROMO' UNION ALL SELECT rx_id, pos, name, 'b' FROM m WHERE qty > 40")
def _(spark, sf):
    m = mentions(spark, sf)
    return m.where("cls = 'PROMO'").select("rx_id", "pos", "name", F.lit("a").alias("source")).unionByName(m.where("qty > 40").select("rx_id", "pos", "name", F.lit("b").alias("source")))


@query("first_nonempty_source", "SELECT rx_id, pos, name FROM (SELECT *, bool_or(cls = 'PROMO') OVER (PARTITION BY rx_id) AS any_a FROM m) WHERE CASE WHEN any_a THEN cls = 'PROMO' ELSE qty > 40 END")
def _(spark, sf):
    m = mentions(spark, sf).withColumn("any_a", F.bool_or(F.col("cls") == "PROMO").over(Window.partitionBy("rx_id")))
    return m.where(F.when(F.col("any_a"), F.col("cls") == "PROMO").otherwise(F.col("qty") > 40)).select("rx_id", "pos", "name")


@query("noise_filter", "SELECT conv_id, turn, length(text) >= 2 AND NOT regexp_matches(text, '^[0-9\\s.,-]*$') AND contains(lower(text), 'tion') AS valid FROM conversations", with_mentions=False)
def _(spark, sf):
    ok = (F.length("text") >= 2) & ~F.col("text").rlike("^[0-9\\s.,-]*$") & F.contains(F.lower("text"), F.lit("tion"))
    return read(spark, sf, "conversations").select("conv_id", "turn", ok.alias("valid"))


@query("normalize_text_chain", "SELECT doc_id, md5(regexp_replace(lower(regexp_replace(text, '[0-9]+', '#', 'g')), '\\s+', ' ', 'g')) AS h FROM documents", with_mentions=False)
def _(spark, sf):
    t = F.regexp_replace(F.lower(F.regexp_replace("text", "[0-9]+", "#")), "\\s+", " ")
    return read(spark, sf, "documents").select("doc_id", F.md5(t).alias("h"))


@query("extract_names_regex", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS BIGINT) AS n, regexp_extract_all(text, '[A-Z][a-z]+')[1] AS first FROM documents", with_mentions=False)
def _(spark, sf):
    found = F.expr("regexp_extract_all(text, '[A-Z][a-z]+', 0)")
    return read(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.get(found, 0).alias("first"))


@query("streaming_user_buffer", "WITH s AS (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seg FROM events) SELECT user_id, event_id, seg, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) AS BIGINT) AS held FROM s", with_mentions=False)
def _(spark, sf):
    return drain_events(spark, sf, shared_folder(spark))


@query("greedy_similarity_dedupe")
def _(spark, sf):
    return dedupe.greedy_similarity(baskets(spark, sf).select("rx_id", "pos", "name", "confidence"), "rx_id", "name", "pos", "confidence")


from . import analysis_queries, basket_queries, lookup_queries, name_queries, record_queries, record_text_queries, risk_queries, text_queries, validation_queries  # noqa: E402, F401 (they register theirs)
