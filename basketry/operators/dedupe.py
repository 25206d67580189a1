"""Deduplication: the best row of each key, in the order of first appearance."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType


def best_per_key(df: DataFrame, keys: list[str], best: list, out_pos: str | None = None) -> DataFrame:
    """The first row of each key by the order best; out_pos gets the position of the key's first row."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("_n", F.row_number().over(w.orderBy(*best)))
    if out_pos:
        out = out.withColumn("_p", F.min(out_pos).over(w))
    out = out.where("_n = 1").drop("_n")
    return out.drop(out_pos).withColumnRenamed("_p", out_pos) if out_pos else out


def first_by(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    return best_per_key(df, keys, [F.col(pos)])


def two_stage(df: DataFrame, fine: list[str], coarse: list[str], best: list) -> DataFrame:
    """Best of each fine key, then of each coarse key."""
    return best_per_key(best_per_key(df, fine, best), coarse, best)


def collapse_combos(df: DataFrame, group: str, name: str, separator: str = " ") -> DataFrame:
    """Rows whose whole name is a part of any name of the group that has the separator go; anti-join on exploded parts."""
    parts = df.where(F.contains(F.col(name), F.lit(separator))).select(group, F.explode(F.split(name, separator)).alias(name)).distinct()
    return df.join(parts, [group, name], "left_anti")


@lru_cache(100_000)
def similarity(a: str, b: str) -> float:
    """Of names in lower case without blanks: 1 if equal, .9 if one holds the other, else the share in matching blocks; 0 for empty names."""
    if not a or not b:
        return 0.0
    x, y = ("".join(t.lower().split()) for t in (a, b))
    if x == y:
        return 1.0
    return 0.9 if x in y or y in x else difflib.SequenceMatcher(None, x, y).ratio()


def greedy_similarity(df: DataFrame, group: str, name: str, pos: str, confidence: str, limit: float = 0.9) -> DataFrame:
    """A row joins the first earlier one of its group that is more similar than the limit, and takes its place if it is surer.

    Returned with place: by falling confidence, then by the order of the first rows. A joined row is compared under the
    name of the first. Null names count as empty, null confidences as 0. The order within a group (one basket) matters, so
    a group is read in one piece; groups are streamed, sorted, and only one is held.
    """
    names = [*df.columns, "place"]

    def settle(rows):
        kept: list[list] = []  # [the first name, the row]
        for row in rows:
            own = (row[name] or "").strip()
            for k in kept:
                if similarity(own, k[0]) > limit:
                    if (row[confidence] or 0) > (k[1][confidence] or 0):
                        k[1] = row
                    break
            else:
                kept.append([own, row])
        order = sorted(range(len(kept)), key=lambda i: -(kept[i][1][confidence] or 0))
        return [kept[i][1] | {"place": n} for n, i in enumerate(order)]

    def run(batches):
        now, held = None, []
        for b in batches:
            out = []
            for row in b.to_pylist():
                if held and row[group] != now:
                    out += settle(held)
                    held = []
                now = row[group]
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if held:
            yield pa.RecordBatch.from_pylist(settle(held), arrow)

    schema = StructType([*df.schema, StructField("place", LongType())])
    arrow = to_arrow_schema(schema)
    return df.repartition(group).sortWithinPartitions(group, pos).select(*names[:-1]).mapInArrow(run, schema)
