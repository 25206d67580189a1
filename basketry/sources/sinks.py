"""Sinks: delimited files, appended audit lines by date, upserts of a learned store, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_audit(df: DataFrame, path: str, ts: str = "ts") -> None:
    df.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").json(path)


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the latest of both; of equally late ones new goes before old, then the largest in all columns."""
    old, new = old.withColumn("_new", F.lit(0)), new.withColumn("_new", F.lit(1))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"), *(F.desc(F.col(c).cast("string")) for c in old.columns if c not in (*keys, order, "_new")))
    return old.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def keep_recent(df: DataFrame, ts: str, days: int, now) -> DataFrame:
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))
