"""Minimax contiguous sharding of atomic groups. DataFrame functions only.

Groups (equal texts) are ordered by the hash of their text. The smallest capacity C is sought for which cutting that
order greedily into pieces of at most C bytes needs no more than the wanted number of shards; then it is cut there.
A table of groups with running sums is written once. A greedy step asks for the last group whose running sum is at
most some value; each job answers it for many capacities at once, so one round of steps is several levels of the
binary search, and reads only the blocks of groups that the values fall in.

Defined results: null and empty texts are one group of size 1 a row; repeated rows keep their own slots; with fewer
groups than shards the last shards stay empty; an empty table gives an empty result. A group larger than
bytes / shards makes the capacity that large: groups are never split.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window, functions as F

from .shared import set_apart, small, written

BLOCKS, SLOT_BLOCKS, PROBES = 4096, 256, 31


def running_sums(groups: DataFrame) -> tuple[DataFrame, list[int]]:
    """groups (gkey hex, bytes) -> the table with block and cum (running sum up to and with the group), block offsets."""
    groups = groups.withColumn("block", F.conv(F.substring("gkey", 1, 3), 16, 10).cast("int"))
    sums = {r["block"]: r["b"] for r in groups.groupBy("block").agg(F.sum("bytes").alias("b")).collect()}  # 4096 rows at most
    offsets = [0]
    for b in range(BLOCKS):
        offsets.append(offsets[-1] + sums.get(b, 0))
    starts = F.broadcast(small(groups.sparkSession, "block int, start long", list(enumerate(offsets[:-1]))))
    w = Window.partitionBy("block").orderBy("gkey")
    return written(groups.join(starts, "block").select("gkey", "bytes", "block", (F.col("start") + F.sum("bytes").over(w)).alias("cum")), "cums"), offsets


def last_at_most(cums: DataFrame, offsets: list[int], values: list[int]) -> list[int]:
    """For each value the largest running sum that is at most the value (0 if there is none)."""
    total, out, ask = offsets[-1], [0] * len(values), []
    for i, v in enumerate(values):
        if v >= total:
            out[i] = total
        elif v > 0:
            b = bisect.bisect_right(offsets, v) - 1
            out[i] = offsets[b]
            ask.append((i, b, v))
    if ask:
        q = F.broadcast(small(cums.sparkSession, "i int, block int, v long", ask))
        found = cums.where(F.col("block").isin(sorted({b for _, b, _ in ask}))).join(q, "block").where("cum <= v").groupBy("i").agg(F.max("cum").alias("c"))
        for r in found.collect():  # a row for each value at most
            out[r["i"]] = max(out[r["i"]], r["c"])
    return out


def greedy(cums: DataFrame, offsets: list[int], capacities: list[int], shards: int) -> list[list[int]]:
    """The running sums where a greedy fill ends its shards, for each capacity."""
    ends: list[list[int]] = [[] for _ in capacities]
    at = [0] * len(capacities)
    for _ in range(shards):
        at = last_at_most(cums, offsets, [a + c for a, c in zip(at, capacities)])
        for e, a in zip(ends, at):
            e.append(a)
    return ends


def smallest_capacity(cums: DataFrame, offsets: list[int], largest: int, shards: int) -> tuple[int, list[int]]:
    """Smallest capacity that a greedy fill of the shards gets by with, and where that fill ends its shards."""
    total = offsets[-1]
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest  # high always does
    best = None
    while low < high or best is None:
        probes = sorted({low + (high - low) * i // (PROBES + 1) for i in range(PROBES + 1)} | {high})
        fills = greedy(cums, offsets, probes, shards)
        first = next(i for i, e in enumerate(fills) if e[-1] == total)
        best, high = fills[first], probes[first]
        if first:
            low = probes[first - 1] + 1
        else:
            low = high
    return high, best


def shard(rows: DataFrame, shards: int = 8, seed_cols=("doc_id",)) -> DataFrame:
    """rows (gkey hex, size, other columns) -> the same with shard and slot (gapless in its shard).

    A column of the caller's that is called shard or slot comes as in_shard or in_slot; all others stay as they are.
    """
    rows = set_apart(rows, ("shard", "slot"))
    # The caller's columns travel as one, so none of them can clash with those of this function.
    rows = written(rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")), "sized")
    groups = written(rows.groupBy("row.gkey").agg(F.sum("row.size").alias("bytes")), "groups")
    largest = groups.agg(F.max("bytes")).first()[0] or 0
    keys: list[str] = []
    if largest:
        cums, offsets = running_sums(groups)
        _, ends = smallest_capacity(cums, offsets, largest, shards)
        inner = sorted({e for e in ends if 0 < e < offsets[-1]})
        keys = sorted(r[0] for r in cums.where(F.col("cum").isin(inner)).select("gkey").collect()) if inner else []
    where = sum((F.when(F.col("row.gkey") > k, 1).otherwise(0) for k in keys), F.lit(0)).cast("int")
    seeds = [f"row.{c}" for c in seed_cols]
    rows = rows.select("row", where.alias("shard"), F.pmod(F.xxhash64(*seeds), F.lit(SLOT_BLOCKS)).cast("int").alias("part"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = F.broadcast(counts.select("shard", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first")))  # shards * SLOT_BLOCKS rows
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*seeds, "row.gkey"))
    return rows.withColumn("number", number).join(firsts, ["shard", "part"]).select("row.*", "shard", (F.col("first") + F.col("number") - 1).alias("slot"))


def op10(spark, sf_dir: str) -> DataFrame:
    """All documents into 8 shards by the law of bytes."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("gkey")
    )
    out = shard(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
