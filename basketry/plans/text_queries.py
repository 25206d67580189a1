"""Queries that parse texts: lines, blocks, sections, commands, fenced JSON, similarity."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import texts as T
from ..sources.tables import read
from .registry import query

LINES_SQL = "l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM conversations WHERE text IS NOT NULL) "


def lines(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n").cast("long"))


@query("line_attributes", f"WITH {LINES_SQL} SELECT conv_id, turn, n, nullif(regexp_extract(line, '[0-9]+'), '') AS number, CASE WHEN regexp_matches(line, 'tion[.,]') THEN 'end' WHEN contains(line, 'and') THEN 'and' END AS form, nullif(regexp_extract(line, '([A-Z][a-z]+) ([a-z]+)', 2), '') AS second FROM l", with_mentions=False)
def _(spark, sf):
    c = F.col("line")
    return lines(spark, sf).select("conv_id", "turn", "n", T.found(c, "[0-9]+").alias("number"), F.when(c.rlike("tion[.,]"), "end").when(F.contains(c, F.lit("and")), "and").alias("form"), T.found(c, "([A-Z][a-z]+) ([a-z]+)", 2).alias("second"))


@query("first_integer", "SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '([0-9]{1,9})', 1) AS INTEGER) AS days FROM part", with_mentions=False)
def _(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.first_integer(F.col("p_brand")).alias("days"))


@query("section_forward_fill", f"WITH {LINES_SQL}, s AS (SELECT *, CASE WHEN regexp_matches(line, '^T') THEN regexp_extract(line, '^[A-Za-z]+') END AS head FROM l) SELECT conv_id, turn, n, last_value(head IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM s", with_mentions=False)
def _(spark, sf):
    """A line that starts a section names it for all lines until the next."""
    head = F.when(F.col("line").rlike("^T"), F.regexp_extract("line", "^[A-Za-z]+", 0))
    w = Window.partitionBy("conv_id", "turn").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return lines(spark, sf).withColumn("head", head).select("conv_id", "turn", "n", F.last("head", ignorenulls=True).over(w).alias("section"))


@query("line_protocol_groups", f"WITH {LINES_SQL}, s AS (SELECT *, CAST(sum(CASE WHEN contains(line, ',') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY n) AS BIGINT) AS g FROM l) SELECT conv_id, turn, g, count(*) AS n_lines, string_agg(line, '|' ORDER BY n) AS body FROM s WHERE g > 0 GROUP BY conv_id, turn, g", with_mentions=False)
def _(spark, sf):
    """A line with a comma opens a group; lines before the first belong to none."""
    g = F.sum(F.when(F.contains(F.col("line"), F.lit(",")), 1).otherwise(0)).over(Window.partitionBy("conv_id", "turn").orderBy("n"))
    rows = lines(spark, sf).withColumn("g", g.cast("long")).where("g > 0").groupBy("conv_id", "turn", "g").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))
    return rows.select("conv_id", "turn", "g", "n_lines", F.array_join(F.col("x.line"), "|").alias("body"))


@query("severity_keywords", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'never|contra') THEN 'major' WHEN regexp_matches(lower(text), 'tion|ever') THEN 'moderate' ELSE 'minor' END AS level FROM conversations", with_mentions=False)
def _(spark, sf):
    level = T.keyword_level(F.col("text"), [("major", ("never", "contra")), ("moderate", ("tion", "ever"))], "minor")
    return read(spark, sf, "conversations").select("conv_id", "turn", level.alias("level"))


@query("fenced_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL", with_mentions=False)
def _(spark, sf):
    """Half of the texts have a fence around the JSON; rows without a key go."""
    fence = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("so:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    return read(spark, sf, "events").select("event_id", T.fenced_json(fence, "k int").k.alias("k")).where("k IS NOT NULL")


@query("command_parse", "SELECT event_id, event_type AS name, CAST(user_id AS VARCHAR) AS key, concat_ws(',', user_id, event_type) AS vals FROM events", with_mentions=False)
def _(spark, sf):
    text = F.concat("event_type", F.lit("： "), F.col("user_id").cast("string"), F.lit(" -> "), F.col("user_id").cast("string"), F.lit("、 "), "event_type")
    return read(spark, sf, "events").select("event_id", T.command(text).alias("c")).select("event_id", "c.name", "c.key", F.array_join("c.values", ",").alias("vals"))


@query("block_split", "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS INTEGER) AS number, event_type AS content FROM (SELECT DISTINCT user_id, event_type FROM events)", with_mentions=False)
def _(spark, sf):
    """Numbered texts are made of each user's kinds and split again."""
    kinds = read(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    text = F.array_join(F.transform("k", lambda x, i: F.concat((i + 1).cast("string"), F.lit("【般】 "), x)), "\n")
    return kinds.select("user_id", F.explode(T.numbered_blocks(text, "般|外|麻|向")).alias("b")).select("user_id", "b.*")


PAIRS_SQL = "WITH n AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON split_part(a.name, ' ', 2) = split_part(b.name, ' ', 2))"


@query("pattern_similarity", PAIRS_SQL + " SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.9 ELSE least(round(len(list_filter(string_split(a, ''), lambda x: x <> '' AND contains(b, x))) / greatest(length(a), length(b)) + CASE WHEN left(a, 3) = left(b, 3) THEN 0.3 ELSE 0 END + CASE WHEN right(a, 3) = right(b, 3) THEN 0.3 ELSE 0 END, 6), 1.0) END AS sim, round(len(list_intersect(string_split(a, ''), string_split(b, ''))) / len(list_distinct(list_concat(string_split(a, ''), string_split(b, '')))), 6) AS jaccard FROM q", with_mentions=False)
def _(spark, sf):
    n = read(spark, sf, "part").select(F.col("p_name").alias("a")).distinct().withColumn("k", F.substring_index("a", " ", -1))
    a, b = F.col("a"), F.col("b")
    return n.join(n.withColumnRenamed("a", "b"), "k").select("a", "b", T.pattern_similarity(a, b).alias("sim"), F.round(T.char_jaccard(a, b), 6).alias("jaccard"))
