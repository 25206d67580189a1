"""Queries that sum up, judge and render whole baskets: risks, profiles, clusters, gates, statistics, post-processing."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from ..operators import pairs
from ..sources.tables import mentions, read
from .registry import query

#: Class risks: (name, level, order, classes). A risk needs two items of its classes in all, not one of each.
CLASS_RISKS = [
    ("promo_small", "critical", 0, ("PROMO", "SMALL")),
    ("large_economy", "high", 1, ("LARGE", "ECONOMY")),
    ("medium", "medium", 2, ("MEDIUM",)),
]
CONDITIONS = [("hypertension", ("PROMO", "ECONOMY")), ("insomnia", ("SMALL",)), ("pain", ("LARGE", "MEDIUM"))]
CLUSTERS = {"PROMO": "cv", "ECONOMY": "cv", "SMALL": "cns", "LARGE": "gi", "MEDIUM": "gi", "STANDARD": "other"}
MONITORING = {"critical": ("pressure", "ecg"), "high": ("pressure", "kidney"), "medium": ("symptoms",)}


def names_of(terms) -> str:
    return ", ".join(f"'{t}'" for t in terms)


def listed(c: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), ", ")


def among(terms) -> Column:
    return F.col("cls").isin(*terms)


RISKS_SQL = ", k AS (" + " UNION ALL ".join(f"SELECT rx_id, '{n}' AS risk, '{lv}' AS level, {o} AS ord, count(*) AS n, array_to_string(list_sort(list_distinct(list(name))), ', ') AS targets FROM m WHERE cls IN ({names_of(c)}) GROUP BY rx_id HAVING count(*) >= 2" for n, lv, o, c in CLASS_RISKS) + ") "


def class_risks(spark, sf):
    """One shuffle for all risks: an item is exploded to the risks of its class, then counted by basket and risk."""
    table = F.array(*(F.struct(F.lit(n).alias("risk"), F.lit(lv).alias("level"), F.lit(o).alias("ord"), F.array(*map(F.lit, c)).alias("classes")) for n, lv, o, c in CLASS_RISKS))
    hit = mentions(spark, sf).select("rx_id", "name", F.explode(F.filter(table, lambda r: F.array_contains(r.classes, F.col("cls")))).alias("r"))
    return hit.groupBy("rx_id", "r.risk", "r.level", "r.ord").agg(F.count("*").alias("n"), listed("name").alias("targets")).where("n >= 2")


@query("class_risk_summary", RISKS_SQL + "SELECT * FROM k")
def _(spark, sf):
    return class_risks(spark, sf)


@query("monitoring_union", RISKS_SQL + ", v AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{x}')" for k, xs in MONITORING.items() for x in xs) + ") AS t(level, item)) SELECT rx_id, array_to_string(list_sort(list_distinct(list(item))), ', ') AS items FROM k JOIN v USING (level) GROUP BY rx_id")
def _(spark, sf):
    table = F.create_map(*(x for k, v in MONITORING.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return class_risks(spark, sf).select("rx_id", F.explode(table[F.col("level")]).alias("item")).groupBy("rx_id").agg(listed("item").alias("items"))


@query("safety_alerts", RISKS_SQL + "SELECT rx_id, 0 AS kind, 'emergency' AS alert FROM k GROUP BY rx_id HAVING bool_or(level = 'critical') UNION ALL SELECT rx_id, 1, risk || ': ' || targets FROM k WHERE level IN ('critical', 'high') UNION ALL SELECT rx_id, 2, 'monitor' FROM k GROUP BY rx_id HAVING count(*) >= 2")
def _(spark, sf):
    g = class_risks(spark, sf).groupBy("rx_id").agg(F.collect_list(F.struct("ord", "level", "risk", "targets")).alias("k"))
    each = F.transform(F.filter("k", lambda x: x.level.isin("critical", "high")), lambda x: F.struct(F.lit(1).alias("kind"), F.concat(x.risk, F.lit(": "), x.targets).alias("alert")))
    row = lambda kind, alert: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(alert).alias("alert")))
    none = F.slice(row(0, ""), 1, 0)
    first = F.when(F.exists("k", lambda x: x.level == "critical"), row(0, "emergency")).otherwise(none)
    last = F.when(F.size("k") >= 2, row(2, "monitor")).otherwise(none)
    return g.select("rx_id", F.explode(F.concat(first, each, last)).alias("a")).select("rx_id", "a.*")


@query("patient_profile", "SELECT rx_id, concat_ws(',', " + ", ".join(f"CASE WHEN bool_or(cls IN ({names_of(c)})) THEN '{n}' END" for n, c in CONDITIONS) + ") AS conditions, CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS polypharmacy FROM m GROUP BY rx_id")
def _(spark, sf):
    has = [F.when(F.bool_or(among(c)), n) for n, c in CONDITIONS]
    n = F.count("*")
    return mentions(spark, sf).groupBy("rx_id").agg(F.concat_ws(",", *has).alias("conditions"), F.when(n >= 5, "high").when(n >= 3, "medium").otherwise("low").alias("polypharmacy"))


CLUSTER_SQL = "CASE cls " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLUSTERS.items()) + " END"


@query("cluster_buckets", f"SELECT rx_id, {CLUSTER_SQL} AS cluster, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS risk FROM m GROUP BY ALL")
def _(spark, sf):
    table = F.create_map(*(F.lit(x) for kv in CLUSTERS.items() for x in kv))
    g = mentions(spark, sf).groupBy("rx_id", table[F.col("cls")].alias("cluster")).agg(F.count("*").alias("n"))
    return g.withColumn("risk", F.when(F.col("n") >= 3, "high").when(F.col("n") >= 2, "medium").otherwise("low"))


@query("scenarios_and_alternatives", f"SELECT rx_id, count(*) FILTER ({CLUSTER_SQL} = 'cv') >= 3 AS cv, count(*) FILTER ({CLUSTER_SQL} = 'gi') >= 2 AS gi, bool_or(cls = 'PROMO') AND bool_or(cls = 'SMALL') AS both_pd, bool_or(cls = 'LARGE') AND bool_or(cls = 'ECONOMY') AS both_acid FROM m GROUP BY rx_id")
def _(spark, sf):
    has = lambda c: F.bool_or(F.col("cls") == c)
    return mentions(spark, sf).groupBy("rx_id").agg(
        (F.count_if(among(("PROMO", "ECONOMY"))) >= 3).alias("cv"), (F.count_if(among(("LARGE", "MEDIUM"))) >= 2).alias("gi"), (has("PROMO") & has("SMALL")).alias("both_pd"), (has("LARGE") & has("ECONOMY")).alias("both_acid")
    )


@query("threshold_warnings", "SELECT rx_id, unnest(list_filter([CASE WHEN count(*) FILTER (cls IN ('PROMO', 'ECONOMY', 'LARGE')) >= 3 THEN 'pressure' END, CASE WHEN count(*) FILTER (cls IN ('SMALL', 'MEDIUM')) >= 2 THEN 'gastric' END, CASE WHEN count(*) FILTER (cls = 'STANDARD') >= 2 THEN 'psych' END], lambda x: x IS NOT NULL)) AS warning FROM m GROUP BY rx_id")
def _(spark, sf):
    n = lambda *c: F.count_if(among(c))
    w = F.array_compact(F.array(F.when(n("PROMO", "ECONOMY", "LARGE") >= 3, "pressure"), F.when(n("SMALL", "MEDIUM") >= 2, "gastric"), F.when(n("STANDARD") >= 2, "psych")))
    return mentions(spark, sf).groupBy("rx_id").agg(w.alias("w")).select("rx_id", F.explode("w").alias("warning"))


@query("diagnosis_union", RISKS_SQL + "SELECT rx_id, risk AS finding, targets FROM k UNION ALL SELECT rx_id, 'same ' || cls, array_to_string(list_sort(list_distinct(list(name))), ', ') FROM m GROUP BY rx_id, cls HAVING count(*) >= 2")
def _(spark, sf):
    same = mentions(spark, sf).groupBy("rx_id", "cls").agg(F.count("*").alias("n"), listed("name").alias("targets")).where("n >= 2")
    return class_risks(spark, sf).select("rx_id", F.col("risk").alias("finding"), "targets").unionByName(same.select("rx_id", F.concat(F.lit("same "), "cls").alias("finding"), "targets"))


@query("duplicate_findings", RISKS_SQL + "SELECT rx_id, targets, min(ord) AS ord, arg_min(risk, ord) AS risk FROM k GROUP BY rx_id, targets")
def _(spark, sf):
    """Findings on the same sorted names count once; the earliest stays."""
    return class_risks(spark, sf).groupBy("rx_id", "targets").agg(F.min("ord").alias("ord"), F.min_by("risk", "ord").alias("risk"))


@query("severity_sort", RISKS_SQL + "SELECT rx_id, risk, row_number() OVER (PARTITION BY rx_id ORDER BY CASE level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, risk) AS place FROM k")
def _(spark, sf):
    rank = F.when(F.col("level") == "critical", 0).when(F.col("level") == "high", 1).otherwise(2)
    return class_risks(spark, sf).select("rx_id", "risk", F.row_number().over(Window.partitionBy("rx_id").orderBy(rank, "risk")).cast("long").alias("place"))


@query("conditional_rule", "SELECT rx_id, CASE WHEN bool_or(contains(name, 'widget')) THEN 'binder with widget' ELSE 'binder' END AS title, CAST(CASE WHEN bool_or(contains(name, 'widget')) THEN 1 ELSE 3 END AS INTEGER) AS priority, array_to_string(list_sort(list_distinct(list(name) FILTER (cls = 'LARGE'))), ', ') AS targets FROM m GROUP BY rx_id HAVING bool_or(cls = 'LARGE')")
def _(spark, sf):
    """One class is enough; title and priority depend on whether any name of the basket has a keyword."""
    g = mentions(spark, sf).groupBy("rx_id").agg(F.bool_or(F.contains(F.col("name"), F.lit("widget"))).alias("with"), F.array_sort(F.collect_set(F.when(F.col("cls") == "LARGE", F.col("name")))).alias("t"))
    title, order = F.when(F.col("with"), "binder with widget").otherwise("binder"), F.when(F.col("with"), 1).otherwise(3)
    return g.where("size(t) > 0").select("rx_id", title.alias("title"), order.alias("priority"), F.array_join("t", ", ").alias("targets"))


@query("layered_findings", ", one AS (SELECT a.rx_id, a.name AS x, b.name AS y FROM m a JOIN m b ON a.rx_id = b.rx_id AND a.pos < b.pos AND a.cls = 'PROMO' AND b.cls = 'SMALL'), two AS (SELECT a.rx_id, a.name AS x, b.name AS y FROM m a JOIN m b ON a.rx_id = b.rx_id AND a.pos < b.pos AND a.brand = b.brand), three AS (SELECT rx_id, min(name) AS x, max(name) AS y FROM m GROUP BY rx_id HAVING count(*) >= 3) SELECT DISTINCT rx_id, x, y, 1 AS layer FROM one UNION ALL SELECT DISTINCT rx_id, x, y, 2 FROM two ANTI JOIN one USING (rx_id, x, y) UNION ALL SELECT rx_id, x, y, 3 FROM three WHERE rx_id NOT IN (SELECT rx_id FROM one UNION ALL SELECT rx_id FROM two)")
def _(spark, sf):
    """Layer 2 adds what layer 1 lacks; layer 3 speaks only of baskets of three items where both are silent. One shuffle: the layer is settled within a basket."""
    m = mentions(spark, sf)
    p = pairs.item_pairs(m, ["name", "cls", "brand"])
    layer = F.when((F.col("a_cls") == "PROMO") & (F.col("b_cls") == "SMALL"), 1).when(F.col("a_brand") == F.col("b_brand"), 2)
    found = p.withColumn("layer", layer).where("layer IS NOT NULL").groupBy("rx_id", F.col("a_name").alias("x"), F.col("b_name").alias("y")).agg(F.min("layer").alias("layer"))
    third = m.groupBy("rx_id").agg(F.min("name").alias("x"), F.max("name").alias("y"), F.count("*").alias("n")).where("n >= 3").drop("n")
    third = third.join(found.select("rx_id").distinct(), "rx_id", "left_anti").withColumn("layer", F.lit(3))
    return found.unionByName(third)


@query("report_bundle", "SELECT rx_id, CAST(sum(CASE WHEN b_pos IS NULL OR a_cls <> 'PROMO' OR b_cls <> 'SMALL' THEN 0 ELSE 1 END) AS BIGINT) AS n_pairs, CAST(sum(CASE WHEN a_brand = b_brand THEN 1 ELSE 0 END) AS BIGINT) AS n_same FROM (SELECT a.rx_id, a.cls AS a_cls, a.brand AS a_brand, b.pos AS b_pos, b.cls AS b_cls, b.brand AS b_brand FROM m a LEFT JOIN m b ON a.rx_id = b.rx_id AND a.pos < b.pos) GROUP BY rx_id")
def _(spark, sf):
    """Counts of pair findings within the basket's array: no self-join."""
    g = mentions(spark, sf).groupBy("rx_id").agg(F.array_sort(F.collect_list(F.struct("pos", "cls", "brand"))).alias("i"))
    count = lambda test: F.aggregate("i", F.lit(0).cast("long"), lambda n, a: n + F.size(F.filter("i", lambda b: (a.pos < b.pos) & test(a, b))))
    return g.select("rx_id", count(lambda a, b: (a.cls == "PROMO") & (b.cls == "SMALL")).alias("n_pairs"), count(lambda a, b: a.brand == b.brand).alias("n_same"))


@query("extraction_stats", "SELECT rx_id, count(*) AS n, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS middle, count(*) FILTER (confidence < 0.5) AS low, least(1.0, count(*) / 10) AS coverage FROM m GROUP BY rx_id")
def _(spark, sf):
    c = F.col("confidence")
    return mentions(spark, sf).groupBy("rx_id").agg(F.count("*").alias("n"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("middle"), F.count_if(c < 0.5).alias("low"), F.least(F.lit(1.0), F.count("*") / 10).alias("coverage"))


@query("classification_stats", "SELECT brand, count(*) AS n, count(*) FILTER (cls <> 'STANDARD') AS classified, count(*) FILTER (cls = 'STANDARD' AND qty > 40) AS estimated, round(count(*) FILTER (cls <> 'STANDARD') / count(*), 6) AS rate FROM m GROUP BY brand")
def _(spark, sf):
    done = F.count_if(F.col("cls") != "STANDARD")
    return mentions(spark, sf).groupBy("brand").agg(F.count("*").alias("n"), done.alias("classified"), F.count_if((F.col("cls") == "STANDARD") & (F.col("qty") > 40)).alias("estimated"), F.round(done / F.count("*"), 6).alias("rate"))


QUALITY_SQL = "SELECT rx_id, min(confidence) AS least, max(confidence) AS most, CASE WHEN count(*) FILTER (qty > 5) = 0 THEN 0.0 ELSE round(0.4 * avg(confidence) + 0.3 * count(*) FILTER (confidence >= 0.8) / count(*) + 0.2 * min(confidence) + 0.1 * count(*) / count(*) FILTER (qty > 5), 6) END AS score, bool_or(confidence >= 0.8) AS valid FROM m GROUP BY rx_id"


@query("quality_metrics", QUALITY_SQL)
def _(spark, sf):
    """Without candidates the whole score is 0, not only its last part."""
    c, n, cand = F.col("confidence"), F.count("*"), F.count_if(F.col("qty") > 5)
    score = 0.4 * F.avg(c) + 0.3 * F.count_if(c >= 0.8) / n + 0.2 * F.min(c) + 0.1 * n / cand
    return mentions(spark, sf).groupBy("rx_id").agg(F.min(c).alias("least"), F.max(c).alias("most"), F.when(cand == 0, 0.0).otherwise(F.round(score, 6)).alias("score"), F.bool_or(c >= 0.8).alias("valid"))


@query("validate_list", "SELECT rx_id, CASE WHEN confidence >= 0.85 THEN 'valid' WHEN confidence >= 0.75 THEN 'uncertain' ELSE 'invalid' END AS level, count(*) AS n, round(avg(CASE WHEN confidence >= 0.85 THEN confidence END), 6) AS mean FROM m GROUP BY ALL")
def _(spark, sf):
    c = F.col("confidence")
    level = F.when(c >= 0.85, "valid").when(c >= 0.75, "uncertain").otherwise("invalid")
    return mentions(spark, sf).groupBy("rx_id", level.alias("level")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(c >= 0.85, c)), 6).alias("mean"))


@query("confidence_evaluation", ", e AS (SELECT rx_id, (count(*) FILTER (cls <> 'STANDARD') + count(*) FILTER (qty >= 10) + count(*) FILTER (tax > 0.02)) / (3 * count(*)) + least(0.1 * count(*), 0.3) AS s, count(*) FILTER (cls = 'STANDARD') > floor(count(*) / 2) AS critic FROM m GROUP BY rx_id) SELECT rx_id, CASE WHEN round(s, 9) >= 0.8 THEN 'high' WHEN round(s, 9) >= 0.6 THEN 'medium' ELSE 'low' END AS level, critic FROM e")
def _(spark, sf):
    n, gaps = F.count("*"), F.count_if(F.col("cls") == "STANDARD")
    s = F.round((F.count_if(F.col("cls") != "STANDARD") + F.count_if(F.col("qty") >= 10) + F.count_if(F.col("tax") > 0.02)) / (3 * n) + F.least(0.1 * n, F.lit(0.3)), 9)
    return mentions(spark, sf).groupBy("rx_id").agg(F.when(s >= 0.8, "high").when(s >= 0.6, "medium").otherwise("low").alias("level"), (gaps > F.floor(n / 2)).alias("critic"))


@query("low_confidence_rank", "SELECT rx_id, pos FROM m QUALIFY confidence >= 0.9 OR row_number() OVER (PARTITION BY rx_id, confidence >= 0.9 ORDER BY confidence DESC, pos) <= 2")
def _(spark, sf):
    """All that are sure, and the best two of the others."""
    sure = F.col("confidence") >= 0.9
    r = F.row_number().over(Window.partitionBy("rx_id", sure).orderBy(F.desc("confidence"), "pos"))
    return mentions(spark, sf).withColumn("r", r).where(sure | (F.col("r") <= 2)).select("rx_id", "pos")


@query("priority_list_order", "SELECT rx_id, pos, row_number() OVER (PARTITION BY rx_id ORDER BY CASE cls WHEN 'SMALL' THEN 0 WHEN 'PROMO' THEN 1 ELSE 999 END, pos) AS place FROM m")
def _(spark, sf):
    known = F.when(F.col("cls") == "SMALL", 0).when(F.col("cls") == "PROMO", 1).otherwise(999)
    return mentions(spark, sf).select("rx_id", "pos", F.row_number().over(Window.partitionBy("rx_id").orderBy(known, "pos")).cast("long").alias("place"))


@query("post_process_chain", "SELECT rx_id, pos, CASE WHEN cls = 'PROMO' AND qty <= 10 THEN 'capsule' ELSE 'tablet' END AS form, CASE WHEN brand = 'Brand#12' AND qty = 2 THEN 1.0 WHEN cls = 'LARGE' AND qty > 30 THEN 30.0 ELSE qty END AS dose, CASE WHEN cls IN ('SMALL', 'MEDIUM') THEN 'bedtime' WHEN pos % 2 = 0 THEN 'morning' END AS timing, coalesce(CASE WHEN cls = 'STANDARD' THEN NULL ELSE cls END, 'unset') AS label FROM m")
def _(spark, sf):
    """Ordered row maps, each a column rule; a later one sees what an earlier one wrote."""
    when = F.when
    out = mentions(spark, sf).withColumn("form", when((F.col("cls") == "PROMO") & (F.col("qty") <= 10), "capsule").otherwise("tablet"))
    out = out.withColumn("dose", when((F.col("brand") == "Brand#12") & (F.col("qty") == 2), 1.0).otherwise(F.col("qty")))
    out = out.withColumn("dose", when((F.col("cls") == "LARGE") & (F.col("dose") > 30), 30.0).otherwise(F.col("dose")))
    out = out.withColumn("timing", when(F.col("cls").isin("SMALL", "MEDIUM"), "bedtime").when(F.col("pos") % 2 == 0, "morning"))
    return out.select("rx_id", "pos", "form", "dose", "timing", F.coalesce(F.nullif("cls", F.lit("STANDARD")), F.lit("unset")).alias("label"))


@query("display_precedence", "SELECT rx_id, pos, CASE WHEN cls <> 'STANDARD' THEN cls WHEN qty > 40 THEN brand WHEN tax > 0.02 THEN name || ' (estimated)' ELSE 'unknown' END AS shown FROM m")
def _(spark, sf):
    shown = F.coalesce(F.when(F.col("cls") != "STANDARD", F.col("cls")), F.when(F.col("qty") > 40, F.col("brand")), F.when(F.col("tax") > 0.02, F.concat("name", F.lit(" (estimated)"))), F.lit("unknown"))
    return mentions(spark, sf).select("rx_id", "pos", shown.alias("shown"))


@query("enrich_where_unknown", "SELECT p_partkey, CASE WHEN p_type NOT IN ('STANDARD', 'LARGE') OR c IS NULL THEN p_type ELSE c END AS category FROM part LEFT JOIN (SELECT p_brand, min(p_type) AS c FROM part WHERE p_type NOT IN ('STANDARD', 'LARGE') GROUP BY p_brand) USING (p_brand)", with_mentions=False)
def _(spark, sf):
    """Only unknown or coarse categories are replaced, by the first known one of the brand."""
    p = read(spark, sf, "part")
    coarse = F.col("p_type").isin("STANDARD", "LARGE")
    known = F.min(F.when(~coarse, F.col("p_type"))).over(Window.partitionBy("p_brand"))
    return p.select("p_partkey", F.when(coarse, F.coalesce(known, "p_type")).otherwise(F.col("p_type")).alias("category"))


@query("learn_tag_merge", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS tags FROM events GROUP BY user_id", with_mentions=False)
def _(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("tags"))


@query("ttl_expiry", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - CASE WHEN event_type = 'purchase' THEN INTERVAL 15 DAY ELSE INTERVAL 5 DAY END", with_mentions=False)
def _(spark, sf):
    """Kinds live for different times, as seen from the newest event."""
    e = read(spark, sf, "events")
    newest = F.broadcast(e.agg(F.max("ts").alias("newest")))  # one row
    lives = F.when(F.col("event_type") == "purchase", F.expr("INTERVAL 15 DAYS")).otherwise(F.expr("INTERVAL 5 DAYS"))
    return e.join(newest, F.col("ts") > F.col("newest") - lives).select("event_id")
