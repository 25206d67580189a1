"""Lookups of names in dictionaries: exact, contained, by prefix, in layers, in cascades.

Containment is an equi-join: the shorter side's keys meet all substrings of the longer side's names. Names are short
(tens of characters), so a name has some hundred substrings, and no row of one side is compared with every row of the
other. Null names match nothing; a dictionary's order is its column ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def each_once(rows: DataFrame, by: list[str], worked_out) -> DataFrame:
    """The different values of by in rows with the columns that worked_out gives for them, a row each.

    The columns are gathered behind the distinct: else Spark would carry a filter on them below it, and over a join with
    rows, and work them out for every row.
    """
    known = worked_out(rows.select(*by).distinct())
    columns = [c for c in known.columns if c not in by]
    return known.groupBy(*by).agg(F.collect_list(F.struct(*columns)).alias("w")).select(*by, *(F.col("w")[0][c].alias(c) for c in columns))


def substrings(name: str, least: int, lengths: list[int] | None = None) -> Column:
    """The distinct substrings of at least so many characters, or of the given lengths."""
    at = f"transform(sequence(1, length({name}) - n + 1), i -> substring({name}, i, n))"
    sizes = f"array({', '.join(map(str, lengths))})" if lengths else f"sequence({least}, length({name}))"
    return F.expr(f"CASE WHEN length({name}) >= {least} THEN array_distinct(flatten(transform(filter({sizes}, n -> n <= length({name})), n -> {at}))) END")


def exact_then_contains(names: DataFrame, book: DataFrame, least: int = 3) -> DataFrame:
    """names (q); book (drug_name, generic_name, ord) -> q, found, how.

    An exact hit on either name: the first entry. Else entries whose drug_name contains q, of at least least characters: the last entry.
    """
    keys = book.select(F.explode(F.array_distinct(F.array("drug_name", "generic_name"))).alias("q"), "drug_name", "ord")
    exact = keys.where("q IS NOT NULL").groupBy("q").agg(F.min_by("drug_name", "ord").alias("a"))
    parts = book.select(F.explode(substrings("drug_name", least)).alias("q"), "drug_name", "ord").groupBy("q").agg(F.max_by("drug_name", "ord").alias("b"))
    out = names.join(exact, "q", "left").join(parts, "q", "left")
    return out.select("q", F.coalesce("a", "b").alias("found"), F.when(F.col("a").isNotNull(), "exact").when(F.col("b").isNotNull(), "contains").otherwise("none").alias("how"))


def tags_exact_else_contained(names: DataFrame, tags: dict[str, tuple]) -> DataFrame:
    """names (q) -> q, tags (sorted): those of the key equal to q, else of all keys that q contains."""
    table = F.create_map(*(x for k, v in tags.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    held = F.flatten(F.transform(F.filter(F.map_entries(table), lambda e: F.contains(F.col("q"), e.key)), lambda e: e.value))
    return names.select("q", F.array_sort(F.array_distinct(F.coalesce(table[F.col("q")], held))).alias("tags"))


def first_prefix(code: Column, table: dict[str, str], default: Column) -> Column:
    """The label of code itself, else of the first key in the table's order that starts it, else default."""
    exact = [F.when(code == k, v) for k, v in table.items()]
    return F.coalesce(*exact, *(F.when(F.startswith(code, F.lit(k)), v) for k, v in table.items()), default)


def longest_prefix(code: Column, table: dict[str, str], lengths: tuple[int, ...]) -> Column:
    """The label of the longest leading part, of the given lengths only, that the table has."""
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(*(m[F.substring(code, 1, n)] for n in sorted(lengths, reverse=True)))


def layered(hits: DataFrame, by: str, bonus: float = 0.05, most: float = 0.2) -> DataFrame:
    """hits (by, name, layer, score) -> for each by the best name: its score, its layers at that score, the confidence.

    Only layers that reach a name's highest score count. Ties go to the name that sorts first.
    """
    best = hits.groupBy(by, "name").agg(F.collect_set(F.struct("score", "layer")).alias("x"))
    best = best.withColumn("score", F.array_max("x").score).withColumn("layers", F.size(F.filter("x", lambda e: e.score == F.col("score"))))
    top = best.groupBy(by).agg(F.max_by(F.struct("name", "score", "layers"), F.struct("score", F.transform(F.split("name", ""), lambda c: -F.ascii(c)).alias("k"))).alias("t"))
    conf = F.round(F.least(F.col("t.score") + F.least(bonus * F.col("t.layers"), F.lit(most)), F.lit(1.0)), 6)
    return top.select(by, "t.name", "t.score", "t.layers", conf.alias("confidence"))


def staged(name: Column, steps: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(result, step) of the first step with a result: a cascade with its lineage; else the name itself, step none."""
    return F.coalesce(*(v for _, v in steps), name), F.coalesce(*(F.when(v.isNotNull(), k) for k, v in steps), F.lit("none"))


def nearest(names: DataFrame, book: DataFrame) -> DataFrame:
    """names (q, distinct) and book (name, distinct) -> q, name, distance: the name with the fewest edits, of equal ones the first.

    A name that has no two neighbouring characters in common with q is at least (length(q) - 1) / 2 edits away, so names
    that share a pair settle most questions by an equi-join on pairs. For what is left names of all lengths that could
    still be nearer are compared, again by an equi-join, on the length.
    """
    pairs = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.substring(c, i, F.lit(2)))))
    both = names.select("q", pairs(F.col("q")).alias("p")).join(book.select("name", pairs(F.col("name")).alias("p")), "p").select("q", "name").distinct()
    first = lambda rows: rows.withColumn("distance", F.levenshtein("q", "name")).groupBy("q").agg(F.min(F.struct("distance", "name")).alias("x"))
    found = names.join(first(both), "q", "left")
    sure = F.col("x.distance") < (F.length("q") - 1) / 2
    longest = book.agg(F.max(F.length("name")).alias("longest"))
    open_ = found.where(~F.coalesce(sure, F.lit(False))).crossJoin(F.broadcast(longest))  # one row
    reach = F.coalesce("x.distance", F.greatest(F.length("q"), "longest"))
    rest = open_.select("q", F.explode(F.sequence(F.greatest(F.lit(0), F.length("q") - reach), F.least("longest", F.length("q") + reach))).alias("n"))
    rest = first(rest.join(book.withColumn("n", F.length("name")), "n").select("q", "name"))
    return found.where(sure).select("q", "x").union(rest).select("q", "x.name", "x.distance")


def inserted_if_absent(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys and order of each key's first row."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))
