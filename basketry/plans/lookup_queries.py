"""Queries that look names up: dictionaries, tags, prefixes, layers, cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts as T
from ..operators import fragments, interactions, lookup, rules
from ..sources import audit
from ..sources.tables import mentions, read
from . import prescription
from .registry import query

BOOK_SQL = "book AS (SELECT p_name AS drug_name, p_brand AS generic_name, min(p_partkey) AS ord FROM part GROUP BY ALL)"
ASK_SQL = "ask AS (SELECT DISTINCT unnest([p_name, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_brand, p_type, lower(p_type), p_name || '-' || p_type, p_type || p_brand]) AS q FROM part)"
TAGS = {"PROMO": ("A", "X"), "ECONOMY": ("B", "X"), "SMALL": ("C",), "Brand#1": ("D",), "widget": ("E",)}
PREFIXES = {"Brand": "any", "Brand#1": "ones", "Brand#12": "twelve", "Brand#2": "twos"}


def book(spark, sf):
    return read(spark, sf, "part").groupBy(F.col("p_name").alias("drug_name"), F.col("p_brand").alias("generic_name")).agg(F.min("p_partkey").alias("ord"))


def ask(spark, sf):
    n, t, b = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    each = F.array(n, F.substring_index(n, " ", 1), F.substring_index(n, " ", -1), b, t, F.lower(t), F.concat_ws("-", n, t), F.concat(t, b))
    return read(spark, sf, "part").select(F.explode(each).alias("q")).distinct()


@query("dictionary_lookup_exact_then_contains", f"WITH {BOOK_SQL}, {ASK_SQL}, e AS (SELECT q, arg_min(drug_name, ord) AS a FROM ask JOIN book ON q = drug_name OR q = generic_name GROUP BY q), c AS (SELECT q, arg_max(drug_name, ord) AS b FROM ask JOIN book ON contains(drug_name, q) AND length(q) >= 3 GROUP BY q) SELECT q, coalesce(a, b) AS found, CASE WHEN a IS NOT NULL THEN 'exact' WHEN b IS NOT NULL THEN 'contains' ELSE 'none' END AS how FROM ask LEFT JOIN e USING (q) LEFT JOIN c USING (q)", with_mentions=False)
def _(spark, sf):
    return lookup.exact_then_contains(ask(spark, sf), book(spark, sf))


TAG_ROWS = ", ".join(f"('{k}', '{t}')" for k, ts in TAGS.items() for t in ts)


@query("tag_lookup_exact_else_contained", f"WITH {ASK_SQL}, t AS (SELECT * FROM (VALUES {TAG_ROWS}) AS v(k, tag)), h AS (SELECT q, tag, q = k AS same FROM ask JOIN t ON contains(q, k)), g AS (SELECT q, list(tag) AS x FROM h WHERE same OR q NOT IN (SELECT k FROM t) GROUP BY q) SELECT q, coalesce(array_to_string(list_sort(list_distinct(x)), ','), '') AS tags FROM ask LEFT JOIN g USING (q)", with_mentions=False)
def _(spark, sf):
    return lookup.tags_exact_else_contained(ask(spark, sf), TAGS).withColumn("tags", F.array_join("tags", ","))


@query("prefix_first_match", "SELECT DISTINCT p_brand || p_size AS code, CASE p_brand || p_size " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PREFIXES.items()) + " ELSE CASE " + " ".join(f"WHEN starts_with(p_brand, '{k}') THEN '{v}'" for k, v in PREFIXES.items()) + " ELSE 'other' END END AS label FROM part", with_mentions=False)
def _(spark, sf):
    code = F.concat("p_brand", F.col("p_size").cast("string"))
    return read(spark, sf, "part").select(code.alias("code")).distinct().select("code", lookup.first_prefix(F.col("code"), PREFIXES, F.lit("other")).alias("label"))


@query("multi_layer_match", "WITH h AS (SELECT p_partkey AS k, p_name AS name, 'a' AS layer, 0.8 AS score FROM part UNION ALL SELECT p_partkey, p_name, 'b', 0.8 FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, split_part(p_name, ' ', 2), 'c', 0.7 FROM part UNION ALL SELECT p_partkey, p_type, 'd', 0.9 FROM part WHERE p_brand = 'Brand#12'), c AS (SELECT k, name, score, count(DISTINCT layer) AS layers FROM h GROUP BY k, name, score), g AS (SELECT * FROM c QUALIFY score = max(score) OVER (PARTITION BY k, name)) SELECT k, name, CAST(score AS DOUBLE) AS score, CAST(layers AS INTEGER) AS layers, CAST(round(least(score + least(0.05 * layers, 0.2), 1.0), 6) AS DOUBLE) AS confidence FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, name) = 1", with_mentions=False)
def _(spark, sf):
    p = read(spark, sf, "part").withColumnRenamed("p_partkey", "k")
    layer = lambda rows, name, kind, score: rows.select("k", name, F.lit(kind), F.lit(score))
    noun = F.substring_index("p_name", " ", -1)
    hits = layer(p, F.col("p_name"), "a", 0.8).union(layer(p.where("p_size > 25"), F.col("p_name"), "b", 0.8)).union(layer(p, noun, "c", 0.7)).union(layer(p.where("p_brand = 'Brand#12'"), F.col("p_type"), "d", 0.9))
    return lookup.layered(hits.toDF("k", "name", "layer", "score"), "k")


ALIASES = {"cold widget": "cool widget", "small widget": "tiny widget"}
MISREAD = [("rn", "m"), ("0", "o"), ("widget", "w1dget"), ("w1", "wi")]


@query("normalize_cascade", "WITH q AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, 'e', 'a') ELSE p_name || ' 10mg' END AS q FROM part), b AS (SELECT DISTINCT p_name AS n FROM part), s AS (SELECT q, trim(regexp_replace(q, '[0-9]+mg', '')) AS t FROM q) SELECT q, CASE q " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items()) + " ELSE coalesce(x.n, y.n, z.n, q) END AS result, CASE WHEN q IN (" + ", ".join(f"'{k}'" for k in ALIASES) + ") THEN 'alias' WHEN x.n IS NOT NULL THEN 'exact' WHEN y.n IS NOT NULL THEN 'stripped' WHEN z.n IS NOT NULL THEN 'case' ELSE 'none' END AS step FROM s LEFT JOIN b x ON q = x.n LEFT JOIN b y ON t = y.n LEFT JOIN b z ON lower(t) = z.n", with_mentions=False)
def _(spark, sf):
    """Alias, exact, without strength, without case: three equi-joins and one literal map; the step is kept."""
    n, k = F.col("p_name"), F.col("p_partkey") % 4
    q = read(spark, sf, "part").select(F.when(k == 0, n).when(k == 1, F.upper(n)).when(k == 2, F.replace(n, F.lit("e"), F.lit("a"))).otherwise(F.concat(n, F.lit(" 10mg"))).alias("q")).distinct()
    q = q.withColumn("t", F.trim(F.regexp_replace("q", "[0-9]+mg", ""))).withColumn("l", F.lower("t"))
    b = read(spark, sf, "part").select("p_name").distinct()
    for key, out in (("q", "x"), ("t", "y"), ("l", "z")):
        q = q.join(b.select(F.col("p_name").alias(key), F.col("p_name").alias(out)), key, "left")
    alias = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))[F.col("q")]
    result, step = lookup.staged(F.col("q"), [("alias", alias), ("exact", F.col("x")), ("stripped", F.col("y")), ("case", F.col("z"))])
    return q.select("q", result.alias("result"), step.alias("step"))


@query("existence_check", "SELECT p_partkey, CASE WHEN p_name = 'cold widget' THEN 'known_bad' WHEN regexp_matches(p_name, '(bolt|ring)$') THEN 'bad_suffix' WHEN p_size > 40 THEN 'not_in_source' WHEN p_brand = 'Brand#12' THEN 'maker_differs' WHEN p_retailprice < 950 THEN 'unsure' ELSE 'valid' END AS verdict FROM part", with_mentions=False)
def _(spark, sf):
    """Verdicts in strict order: the first that speaks decides."""
    v = F.when(F.col("p_name") == "cold widget", "known_bad").when(F.col("p_name").rlike("(bolt|ring)$"), "bad_suffix").when(F.col("p_size") > 40, "not_in_source")
    return read(spark, sf, "part").select("p_partkey", v.when(F.col("p_brand") == "Brand#12", "maker_differs").when(F.col("p_retailprice") < 950, "unsure").otherwise("valid").alias("verdict"))


@query("replace_fold", "SELECT DISTINCT p_name, replace(replace(replace(replace(p_name, 'rn', 'm'), '0', 'o'), 'widget', 'w1dget'), 'w1', 'wi') AS fixed FROM part", with_mentions=False)
def _(spark, sf):
    return read(spark, sf, "part").select("p_name").distinct().withColumn("fixed", T.replace_fold(F.col("p_name"), MISREAD))


MEDICINES = [*interactions.CLASSES, "レボフロキサシン"]
ITEMS_SQL = "MEDS AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(MEDICINES)) + ") AS v(i, name)), cls AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}')" for n, ts in [*interactions.CLASSES.items(), ("レボフロキサシン", ("CHELATED",))] for t in ts) + ") AS v(name, tag)), items AS (SELECT rx_id, MEDS.name || CASE pos % 3 WHEN 1 THEN '「サンド」' WHEN 2 THEN ' 5mg' ELSE '' END AS name, tag FROM m JOIN MEDS ON i = part % 27 LEFT JOIN cls ON MEDS.name = cls.name AND NOT (contains(MEDS.name, '・') AND pos % 3 <> 0))"
TITLES_SQL = "CASE rule_id " + " ".join(f"WHEN '{r.id}' THEN {i}" for i, r in enumerate(interactions.RULES)) + " END"
ACTIONS_SQL = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in interactions.ACTIONS.items()) + " END"
SHOWN_SQL = "array_to_string(list_sort(list_distinct(list_transform(string_split(targets, ', '), lambda x: CASE replace(replace(x, '「サンド」', ''), ' 5mg', '') WHEN 'ニフェジピン' THEN 'ニフェジピン徐放' ELSE replace(replace(x, '「サンド」', ''), ' 5mg', '') END))), '、')"


@query("interaction_report", f", {ITEMS_SQL}, f AS ({rules.evaluate_sql(interactions.RULES, 'items')}), g AS (SELECT rx_id, rule_id, string_split(rule_id, '#')[1] AS title, severity, priority, {SHOWN_SQL} AS targets, CAST(row_number() OVER (PARTITION BY rx_id ORDER BY priority, {TITLES_SQL}) AS INTEGER) AS rank FROM f) SELECT * EXCLUDE (rule_id), replace({ACTIONS_SQL}, '{{why}}', CASE WHEN contains(targets, '{interactions.WHY[0]}') THEN '{interactions.WHY[1]}' ELSE '' END) AS action FROM g")
def _(spark, sf):
    """Every basket's report, with medicines in the places of parts, every third with a maker and every third with an amount.

    A name with a dot between its parts is known as it is written only: cleaning makes the dot a slash.
    """
    return interactions.report(_medicines(spark, sf))


def _medicines(spark, sf):
    m = mentions(spark, sf)
    name = F.element_at(F.array(*map(F.lit, MEDICINES)), (F.col("part") % len(MEDICINES)).cast("int") + 1)
    name = F.concat(name, F.when(F.col("pos") % 3 == 1, "「サンド」").when(F.col("pos") % 3 == 2, " 5mg").otherwise(""))
    none = F.lit(None).cast("string")
    return m.select("rx_id", name.alias("generic"), none.alias("name"), none.alias("brand"), none.alias("raw"))


@query("audit_trace", f", {ITEMS_SQL}, f AS ({rules.evaluate_sql(interactions.RULES, 'items')}), c AS (SELECT rx_id, count(*) AS n, count(*) FILTER (severity = '重大') AS major FROM f GROUP BY rx_id), d AS (SELECT rx_id, array_to_string(list_sort(list_distinct(list(name))), '|') AS drugs FROM items GROUP BY rx_id) SELECT rx_id, drugs, CAST(coalesce(n, 0) AS INTEGER) AS total_interactions, CAST(coalesce(major, 0) AS INTEGER) AS major_interactions, CAST(coalesce(n - major, 0) AS INTEGER) AS moderate_interactions FROM d LEFT JOIN c USING (rx_id)")
def _(spark, sf):
    """What the audit keeps of each basket's report: names, and counts by severity."""
    items = _medicines(spark, sf)
    out = audit.audit_trace(interactions.report(items), items.select("rx_id", F.col("generic").alias("name")))
    return out.select("rx_id", F.array_join("matched_drugs", "|").alias("drugs"), "total_interactions", "major_interactions", "moderate_interactions")




CUT_PAIRS = [(a, b) for a in ("cold", "small", "red", "large", "fast") for b in ("widget", "bolt", "gear")]


@query("fragment_merge")
def _(spark, sf):
    """Every word of a basket's names, cut apart and put together where the pair is known."""
    m = mentions(spark, sf)
    words = m.select("rx_id", F.posexplode(F.split("name", " ")).alias("k", "w"), "pos").select("rx_id", (F.col("pos") * 2 + F.col("k")).alias("pos"), F.col("w").alias("name"))
    return fragments.merge_fragments(words, CUT_PAIRS)


@query("prescription_diagnosis")
def _(spark, sf):
    """The whole way from texts to reports: each basket is written out as a text of blocks, with medicines in the places of parts, and read again."""
    m = mentions(spark, sf)
    name = F.element_at(F.array(*map(F.lit, MEDICINES)), (F.col("part") % len(MEDICINES)).cast("int") + 1)
    line = F.concat((F.col("pos") + 1).cast("string"), F.lit("【般】"), name, F.lit("錠 "), F.when(F.col("qty") > 5, F.concat(F.col("qty").cast("int").cast("string"), F.lit("mg "))).otherwise(""), F.lit("1錠 朝食後 7日分"))
    texts = m.groupBy("rx_id").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("x"))
    return prescription.diagnose(texts.select("rx_id", F.array_join(F.col("x.line"), "\n").alias("text")))
