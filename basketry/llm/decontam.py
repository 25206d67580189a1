"""Benchmark decontamination by word n-grams. DataFrame functions only.

Every word of a document is hashed once. A window of the benchmark is known by the hashes of its first and last word
and its size; where such a pair occurs in a document, a candidate window is cut out. Candidates are verified by a join
on the window's words, which also names the items. The set of pairs travels to the executors in the plan while it takes
at most SET_BYTES; beyond that every place's pair is joined with the set as a table, which Spark broadcasts or shuffles
by its size. The results are the same.

Defined results: a null or empty text has no words, no hits and is not contaminated; an item without words, or with a
null text, has no window; an item of fewer than 13 words is one window; repeated rows are judged each for itself;
an item id that repeats counts once; a column that has the name of a result is renamed to in_<name>; an empty table
gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import ascii_lower, set_apart, written

WINDOW, SET_BYTES = 13, 1 << 20
#: Separators in a text whose A-Z are not yet lower-cased; all other characters are parts of words.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
RESULTS = ("n_words", "n_hit", "items", "spans")
START = "array<struct<i:int,size:int>>"


def words_of(text):
    return F.filter(F.split(ascii_lower(text), f"[{SEPARATORS}]+"), lambda x: x != "")


def item_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(wtext, size, pair, items): each distinct window of the items, with the ids that have it."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.coalesce(text_col, F.lit(""))).alias("words")).where("size(words) > 0")
    size = f"least(size(words), {WINDOW})"
    w = w.selectExpr("item", f"explode(transform(sequence(1, size(words) - {size} + 1), i -> struct(array_join(slice(words, i, {size}), ' ') AS wtext, {size} AS size, xxhash64(words[i - 1]) ^ shiftleft(xxhash64(words[i + {size} - 2]), 1) AS pair))) AS x")
    return w.selectExpr("item", "x.*").groupBy("wtext", "size", "pair").agg(F.collect_set("item").alias("items"))


def pair_at(i: str, size: int) -> str:
    return f"hashes[{i} - 1] ^ shiftleft(hashes[{i} + {size} - 2], 1)"


def places(size: int, test: str = "true") -> str:
    """SQL: the places (from 1) of a document's windows of that size for which the test holds."""
    return f"CASE WHEN size(hashes) >= {size} THEN filter(sequence(1, size(hashes) - {size} + 1), i -> {test}) ELSE array() END"


def starts_in_plan(rows: DataFrame, pairs: dict[int, list[int]]) -> DataFrame:
    """rows (row, words, hashes, others) with starts, the candidates; pairs: those of each size, as literals."""
    found = [f"transform({places(n, f'{pair_at('i', n)} IN ({", ".join(map("{}L".format, pairs[n]))})')}, i -> struct(i AS i, {n} AS size))" for n in sorted(pairs)]
    return rows.withColumn("starts", F.expr(f"CAST(concat({', '.join(found)}) AS {START})") if found else F.expr(f"CAST(array() AS {START})"))


def starts_by_join(rows: DataFrame, known: DataFrame, sizes) -> DataFrame:
    """The same with the pairs as a table. Only numbers travel; the words are written once and joined by their row."""
    rows = written(rows, "words")
    each = ", ".join(f"transform({places(n)}, i -> struct(i AS i, {n} AS size, {pair_at('i', n)} AS pair))" for n in sizes)
    at = rows.select("row", F.explode(F.expr(f"concat({each})")).alias("x")).select("row", "x.*")
    hit = at.join(known, ["size", "pair"], "left_semi")
    hit = hit.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "size"))).alias("starts"))
    return rows.join(hit, "row", "left").withColumn("starts", F.coalesce("starts", F.expr(f"CAST(array() AS {START})")))


def scan(docs: DataFrame, benchmark: DataFrame, id_col="item_id", text_col="text", set_bytes: int = SET_BYTES) -> DataFrame:
    """docs (with text) -> its columns, n_words, n_hit, items (sorted ids), spans (word ranges, from 1, end exclusive)."""
    docs = set_apart(docs, RESULTS)
    windows = item_windows(benchmark, id_col, text_col)
    known = windows.select("size", "pair").distinct()
    pairs: dict[int, list[int]] = {}
    for r in known.limit(set_bytes // 8 + 1).collect():
        pairs.setdefault(r["size"], []).append(r["pair"])
    own = {f"c{i}": c for i, c in enumerate(docs.columns)}  # names that clash with none used here; what isn't asked for is never read
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *(F.col(f"`{c}`").alias(k) for k, c in own.items()), words_of(F.coalesce("text", F.lit(""))).alias("words"))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    if 8 * sum(map(len, pairs.values())) <= set_bytes:
        rows = starts_in_plan(rows, pairs)
    else:
        rows = starts_by_join(rows, known, range(1, WINDOW + 1))
    cut = F.expr("transform(starts, s -> struct(s.i AS start, s.i + s.size AS stop, array_join(slice(words, s.i, s.size), ' ') AS wtext))")
    rows = rows.select("row", *own, F.size("words").cast("long").alias("n_words"), F.explode_outer(cut).alias("x"))
    # No row without a candidate meets another one.
    rows = rows.withColumn("key", F.coalesce("x.wtext", F.concat(F.lit("\0"), F.col("row").cast("string"))))
    joined = rows.join(windows.select(F.col("wtext").alias("key"), "items"), "key", "left")
    spans = F.collect_list(F.when(F.col("items").isNotNull(), F.struct("x.start", "x.stop")))
    out = joined.groupBy("row").agg(*(F.first(k).alias(k) for k in [*own, "n_words"]), F.array_sort(spans).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = "aggregate(spans, struct(0 AS stop, 0L AS n), (a, s) -> struct(greatest(a.stop, s.stop) AS stop, a.n + greatest(0, s.stop - greatest(s.start, a.stop)) AS n), a -> a.n)"
    return out.select(*(F.col(k).alias(c) for k, c in own.items()), "n_words", "spans", "items", F.expr(covered).alias("n_hit"))


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", set_bytes: int = SET_BYTES) -> DataFrame:
    """docs without contaminated documents ("documents"), or with every hit word cut from the texts ("spans"). The columns stay as they are.

    Texts don't travel with the hits: rows meet their verdict by two hashes of the text, so equal texts share it.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("text").alias("k1"), F.md5(F.coalesce("text", F.lit(""))).alias("k2"))
    hit = scan(keyed.select("k1", "k2", F.col("doc.text").alias("text")), benchmark, set_bytes=set_bytes).where("n_hit > 0")
    if remove == "documents":
        return keyed.join(hit.where(contaminated()).select("k1", "k2").distinct(), ["k1", "k2"], "left_anti").select("doc.*")
    rows = keyed.join(hit.select("k1", "k2", "spans").dropDuplicates(["k1", "k2"]), ["k1", "k2"], "left")
    rows = rows.withColumn("units", F.expr(f"regexp_extract_all(doc.text, r'([^{SEPARATORS}]+[{SEPARATORS}]*)', 1)"))
    kept = F.expr("array_join(filter(units, (u, i) -> NOT exists(spans, s -> i + 1 >= s.start AND i + 1 < s.stop)), '')")
    text = F.when(F.size("spans") > 0, F.concat(F.regexp_extract("doc.text", f"^[{SEPARATORS}]*", 0), kept)).otherwise(F.col("doc.text"))
    return rows.select(*(text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns))


def op2(spark, sf_dir: str) -> DataFrame:
    """Every whole document against every item of benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # Only the id travels: the text is read by the expression that finds the hits.
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS t FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
