"""What the operators share: the shared folder, written tables, packed byte blobs."""

from __future__ import annotations

import gc
import json
import os
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset, local mode gets a temporary folder, set for the session; a cluster gets an error, as its
    machines share no temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"basketry-{uuid.uuid4().hex}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later reads depend on no executor.

    What discard() doesn't delete before is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _filesystem(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def set_apart(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """df with every column whose name one of names takes (case ignored) renamed to in_<name>, with more in_ while that is taken too."""
    wanted, taken, out = {n.lower() for n in names}, {c.lower() for c in df.columns} | {n.lower() for n in names}, df
    for c in df.columns:
        if c.lower() in wanted:
            new = f"in_{c}"
            while new.lower() in taken:
                new = f"in_{new}"
            taken.add(new.lower())
            out = out.withColumnRenamed(c, new)
    return out


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Rows of whole documents go to Python a few hundred at a time, so that a worker holds a few MB of texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in tables:
        fs, at = _filesystem(df.sparkSession, df.written_to)
        fs.delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished jobs whose tables nothing refers to any more, before the next job needs the disk."""
    spark.range(1).write.format("noop").mode("overwrite").save()  # Spark holds on to the last job's plan
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.5)  # files are deleted in the background


def ascii_lower(col):
    """A-Z in lower case, everything else as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small table from the driver as a literal in the plan: no Python on the executors. columns: "a int, b long"."""
    names = [c.split()[0] for c in columns.split(", ")]
    data = json.dumps([dict(zip(names, r)) for r in rows])
    kind = ", ".join(c.replace(" ", ": ", 1) for c in columns.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{kind}>>")))


def hash_sample(rows: DataFrame, most: int, by: str | None = None, most_by: int = 256) -> DataFrame:
    """Of rows (text, and by) the distinct texts with the smallest hashes, at most `most` for each value of by; of more than most_by values those with most rows.

    Whether a text may be taken depends on its own hash and the number of rows, so no task passes on more than its
    share, and a text that many rows have comes once. Only counts and hashes come to the driver, most * most_by at most.
    """
    key = [by] if by else []
    counts = rows.groupBy(*key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *key).limit(most_by).collect()
    few = rows.withColumn("_h", F.xxhash64("text"))

    def at_most(limits: dict):
        if not by:
            return F.col("_h") <= F.lit(limits.get(None, -(1 << 63)))
        out = F.lit(False)
        for k, v in limits.items():
            out = F.when(F.col(by) == F.lit(k), F.col("_h") <= F.lit(v)).otherwise(out)
        return out

    loose = {r[by] if by else None: min((1 << 63) - 1, int(min(1.0, 1.5 * most / max(1, r["n"])) * (1 << 64)) - (1 << 63)) for r in counts}
    hashes: dict = {}
    for r in few.where(at_most(loose)).select(*key, "_h").distinct().collect():
        hashes.setdefault(r[by] if by else None, []).append(r["_h"])
    tight = {k: sorted(v)[:most][-1] for k, v in hashes.items()}
    return few.where(at_most(tight)).groupBy(*key, "_h").agg(F.min("text").alias("text")).drop("_h")
