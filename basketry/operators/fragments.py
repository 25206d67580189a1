"""Names that were cut in two are put together again, within each basket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.texts import let


def merged(names: Column, pairs: list[tuple[str, str]]) -> Column:
    """An ordered list of names -> the list with cut names joined, each once, in the order of first appearance.

    Each name in turn, unless used, takes the first unused later one that makes a known pair with it. Null names go.
    """
    book: dict[str, dict] = {}
    for first, second in pairs:
        book.setdefault(first, {})[second] = None
    if not book:
        return F.when(names.isNotNull(), F.array_distinct(F.filter(names, lambda x: x.isNotNull()))).otherwise(F.array().cast("array<string>"))
    ends = F.create_map(*(x for first, seconds in book.items() for x in (F.lit(first), F.array(*map(F.lit, seconds)))))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("out"))

    def whole(own: Column) -> Column:
        # Names, places and what is found are bound by let: an expression that is named twice is worked out twice.
        def step(s, i):
            fits = lambda fit: lambda j: (j > i) & F.array_contains(fit, F.get(own, j)) & ~F.array_contains(s.used, j)
            first = lambda fit: F.get(F.filter(F.sequence(F.lit(0), F.size(own) - 1), fits(fit)), 0)
            later = let(ends[F.get(own, i)], lambda fit: F.when(fit.isNotNull(), first(fit)))
            used = lambda j: F.when(j.isNotNull(), F.array_append(s.used, j)).otherwise(s.used)
            joined = lambda j: F.struct(used(j).alias("used"), F.array_append(s.out, F.concat(F.get(own, i), F.coalesce(F.get(own, j), F.lit("")))).alias("out"))
            return F.when(F.array_contains(s.used, i), s).otherwise(let(later, joined))

        at = F.sequence(F.lit(0), F.size(own) - 1)
        return F.when(F.size(own) > 0, F.array_distinct(F.aggregate(at, start, step, lambda s: s.out))).otherwise(F.array().cast("array<string>"))

    return let(F.filter(names, lambda x: x.isNotNull()), whole)


def merge_fragments(items: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """items (rx_id, pos, name) -> rx_id, pos (from 0), name. Baskets hold tens of names."""
    g = items.groupBy("rx_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("x"))
    return g.select("rx_id", F.posexplode(merged(F.col("x.name"), pairs)).alias("pos", "name"))
