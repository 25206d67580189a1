"""Spelling variants: words that differ by one edit, each with the most frequent spelling near it, and the chains of such forms.

1. Words are counted over all texts, partly before the shuffle, so a word that fills a third of a corpus is a few rows.
2. Each word's bigrams are ordered by how many words have them over the whole vocabulary, rare first (ties by the bigram,
   then by its place). One edit spoils two bigrams of a word at most, so the first three hold one that both words keep,
   at places that differ by one at most, and it is the first of the kept ones in either order.
3. The edit lies wholly to one side of that bigram. So the text on its other side, the bigram included, is the same in
   both words: that is the position limit, from the front or from the back. What is left on the side of the edit has one
   half that the edit leaves alone; a word posts both halves, for its own length and for one less, as the other may be
   shorter. Words that agree in a posting are compared by edit distance within the join, so only true pairs come out of
   it, and a list is as long as words agree in more than half of their letters.
4. Forms are followed by doubling: counts at least double along a chain, so it has at most 62 links.

Defined results: a null text has no words; a null doc_id counts as the empty text before the colon; A-Z count as a-z, all
other letters stand for themselves; ties of n go to the smallest word; repeated rows count each; empty tables give no
rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .shared import ascii_lower, discard, written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LETTERS, LEAST, TIMES = 5, 3, 2  # letters of a word and occurrences at least; a form is so many times as frequent
GRAMS = 3


def planted_slips(word, doc_id, every: int = 97):
    """word, without one letter where the crc32 of <doc_id>:<word> is divisible by every."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def word_counts(words: DataFrame, letters: int = LETTERS, least: int = LEAST) -> DataFrame:
    """words (word) -> (word, n) of words with enough letters and occurrences."""
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rare_grams(vocabulary: DataFrame) -> DataFrame:
    """(word, n, len, at): the places (from 1) of each word's GRAMS rarest bigrams."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    gram = lambda i: F.substring("word", i, F.lit(2))
    # A word counts once for each of its bigrams. One row for each bigram of two of 90 letters: 8,100 at most, whatever the corpus.
    counts = F.broadcast(vocabulary.select(F.explode(F.array_distinct(F.transform(places, gram))).alias("gram")).groupBy("gram").agg(F.count("*").alias("had")))
    grams = vocabulary.select("word", "n", F.length("word").alias("len"), F.explode(places).alias("at")).withColumn("gram", gram(F.col("at")))
    rarest = Window.partitionBy("word").orderBy("had", "gram", "at")
    return grams.join(counts, "gram").withColumn("k", F.row_number().over(rarest)).where(F.col("k") <= GRAMS).select("word", "n", "len", "at")


def postings(vocabulary: DataFrame) -> DataFrame:
    """(key, word, n, len): what two words that are one edit apart have in common, for each side, half and length."""
    word, n, at = F.col("word"), F.col("len"), F.col("at")
    # Before the edit stands the word's front up to the bigram's end, or behind it the back from the bigram on.
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.substring(word, F.lit(1), at + 1).alias("kept"), F.substring(word, at + 2, n).alias("rest")),
        F.struct(F.lit(1).alias("side"), F.substring(word, at, n).alias("kept"), F.substring(word, F.lit(1), at - 1).alias("rest")),
    )
    own = rare_grams(vocabulary).select("word", "n", "len", F.explode(sides).alias("s")).select("word", "n", "len", "s.*")
    size = F.length("rest")
    own = own.withColumn("half", F.explode(F.array_distinct(F.array(F.floor(size / 2), F.floor(F.greatest(size - 1, F.lit(0)) / 2)).cast("array<int>"))))
    halves = F.array(
        F.xxhash64("side", "kept", F.lit(0), "half", F.substring("rest", F.lit(1), F.col("half"))),
        F.xxhash64("side", "kept", F.lit(1), "half", F.substring("rest", size - F.col("half") + 1, F.col("half"))),
    )
    return own.select(F.explode(F.array_distinct(halves)).alias("key"), "word", "n", "len").distinct()


def near_words(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (word, n) -> (a, na, b, nb), a < b, one row for each two words that are one edit apart."""
    posted = postings(vocabulary)
    left = posted.select("key", F.col("word").alias("a"), F.col("n").alias("na"), F.col("len").alias("la"))
    right = posted.select("key", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("len").alias("lb"))
    one_edit = (F.abs(F.col("la") - F.col("lb")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & one_edit).select("a", "na", "b", "nb").distinct()


def followed(forms: DataFrame) -> DataFrame:
    """forms (word, form), without cycles -> written (word, root): the last of each word's chain of forms."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(at)
        at = now.select("word", "root")
        at.written_to = now.written_to
        if now.where("moved").isEmpty():
            return at


def variants(words: DataFrame, letters: int = LETTERS, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """words (word) -> (word, form, root, n, n_near, form_n), a row for each word of enough letters and occurrences."""
    vocabulary = written(word_counts(words, letters, least), "words")
    pairs = written(near_words(vocabulary), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).union(pairs.select(F.col("b"), F.col("a"), F.col("na")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("form"))).alias("best"))
    found = vocabulary.join(best, "word", "left")
    enough = -F.col("best.less") >= times * F.col("n")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    discard(vocabulary, pairs)
    roots = followed(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def runs(docs: DataFrame, letters: int = LETTERS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, word): the lower-cased runs of letters that are long enough."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= letters).select("doc_id", ascii_lower(F.col("run")).alias("word"))


def op11(spark, sf_dir: str) -> DataFrame:
    """The words of every whole text of documents, with the slips that the contract plants."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(runs(docs).select(planted_slips(F.col("word"), F.col("doc_id")).alias("word")))


#: crc32 from its definition: a table of 256 entries by eight steps each, then a fold over the bytes (all letters have one
#: or two). Near words are found by comparing all words of near lengths, with each accented letter as one of 64 other
#: ASCII characters, as DuckDB's edits are of bytes.
ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
BYTES = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.islower() and c != "'")[:64]
OP11_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents),
hashed AS (
  SELECT w, k, xor(list_reduce(flatten(list_transform(string_split(d || ':' || w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM (SELECT d, w, count(*) AS k FROM runs WHERE length(w) >= 5 GROUP BY ALL), crc),
words AS (
  SELECT w AS word, CAST(sum(k) AS BIGINT) AS n, translate(w, '{ACCENTED}', '{BYTES}') AS s
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS w, k FROM hashed)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(k) >= 3),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM words a JOIN words b
  ON a.word <> b.word AND length(b.s) BETWEEN length(a.s) - 1 AND length(a.s) + 1 AND levenshtein(a.s, b.s) = 1),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min({{'less': -m, 'form': other}}) AS best FROM near GROUP BY word),
found AS (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * w.n THEN best.form END AS form, CASE WHEN -best.less >= 2 * w.n THEN -best.less END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, form AS last, 1 AS k FROM found WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN found f ON f.word = c.last WHERE f.form IS NOT NULL),
roots AS (SELECT word, max_by(last, k) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM found LEFT JOIN roots USING (word)
"""
