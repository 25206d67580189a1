"""Pairs of items of one basket, and rules on pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def item_pairs(items: DataFrame, cols: list[str], most_items: int | None = None, most_pairs: int | None = None) -> DataFrame:
    """(rx_id, a_*, b_*) with a before b. Baskets hold tens of items at most; the limits are those of the rule, not samples."""
    if most_items is not None:
        items = items.where(F.col("pos") < most_items)
    if most_pairs is not None:
        n = items.groupBy("rx_id").agg(F.count("*").alias("n")).where(F.col("n") * (F.col("n") - 1) / 2 <= most_pairs)
        items = items.join(n.select("rx_id"), "rx_id", "left_semi")
    a = items.select("rx_id", *(F.col(c).alias(f"a_{c}") for c in ["pos", *cols]))
    b = items.select("rx_id", *(F.col(c).alias(f"b_{c}") for c in ["pos", *cols]))
    return a.join(b, "rx_id").where("a_pos < b_pos")


def apply_pair_rules(pairs: DataFrame, on: str, rules: list[tuple]) -> DataFrame:
    """rules (x, y, risk) hold in both directions; of several the earliest wins. The list is the driver's, so it is a literal map."""
    best: dict[tuple, str] = {}
    for x, y, risk in rules:
        best.setdefault((x, y), risk)
        best.setdefault((y, x), risk)
    table = F.create_map(*(v for (x, y), risk in best.items() for v in (F.lit(f"{x}\0{y}"), F.lit(risk))))
    return pairs.withColumn("risk", table[F.concat_ws("\0", f"a_{on}", f"b_{on}")]).where("risk IS NOT NULL")
