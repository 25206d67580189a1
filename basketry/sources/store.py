"""A learned store that is replaced as a whole: each version is a folder of its own, and a small file names the one that counts.

A writer writes the new version beside the old one and then creates the next number's file, which fails if another writer
was faster; so readers see the old version or the new one, and a write that fails leaves the old one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .sinks import upsert_latest

ENTRY = "kind string, key string, value array<string>, ts timestamp"
#: Kinds whose values are joined into a sorted set; of other kinds the latest value counts.
JOINED = ("tag",)


class Conflict(Exception):
    """Another writer has made the version that this one was about to make."""


def _paths(spark: SparkSession, root: str, *more: str):
    jvm = spark._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    return files, [path(f"{root.rstrip('/')}/{m}") for m in more]


def current(spark: SparkSession, root: str) -> dict | None:
    """What the newest version's file says (version, folder, batch), None if there is none."""
    files, (at,) = _paths(spark, root, "_versions")
    if not files.exists(at):
        return None
    names = sorted(s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName().isdigit())
    if not names:
        return None
    text = spark.read.text(f"{root.rstrip('/')}/_versions/{names[-1]}", wholetext=True).first()
    return json.loads(text[0]) if text else None


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The newest version's entries (kind, key, value, ts); no rows if there is none."""
    now = current(spark, root)
    return spark.read.schema(ENTRY).parquet(f"{root.rstrip('/')}/{now['folder']}") if now else spark.createDataFrame([], ENTRY)


def commit(entries: DataFrame, root: str, after: int, batch: int | None = None) -> int:
    """Write entries as the version behind number after, and make it the one that counts. Conflict if there is one already."""
    spark, version, folder = entries.sparkSession, after + 1, f"v-{uuid.uuid4().hex}"
    entries.write.parquet(f"{root.rstrip('/')}/{folder}")
    files, (draft, final) = _paths(spark, root, f"_versions/.{folder}", f"_versions/{version:012d}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps({"version": version, "folder": folder, "batch": batch}).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else files.getUri(), spark._jsc.hadoopConfiguration())
    try:  # a rename that doesn't overwrite: either the whole file stands there or none
        context.rename(draft, final, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {version}") from e
        raise
    return version


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of both: the latest of each kind and key; values of kinds in JOINED are joined and sorted."""
    lists = F.col("kind").isin(*JOINED)
    latest = upsert_latest(old.where(~lists), new.where(~lists), ["kind", "key"], "ts")
    both = old.where(lists).unionByName(new.where(lists))
    joined = both.select("kind", "key", "ts", F.explode_outer("value").alias("v")).groupBy("kind", "key").agg(F.array_sort(F.collect_set("v")).alias("value"), F.max("ts").alias("ts"))
    return latest.unionByName(joined)


def upsert(new: DataFrame, root: str, batch: int | None = None, tries: int = 5) -> int:
    """Merge new entries into the store at root as one version. A batch number that is in already changes nothing."""
    spark = new.sparkSession
    for left in reversed(range(tries)):
        now = current(spark, root)
        if now and batch is not None and now["batch"] is not None and now["batch"] >= batch:
            return now["version"]
        try:
            return commit(merged(read_store(spark, root), new), root, now["version"] if now else 0, batch if batch is not None else now and now["batch"])
        except Conflict:
            if not left:
                raise
    raise AssertionError("not reached")


def upserts(root: str):
    """For writeStream.foreachBatch: each micro-batch of entries is one version, once, however often it is run again."""

    def run(batch: DataFrame, number: int) -> None:
        upsert(batch, root, number)

    return run


def with_defaults(entries: DataFrame, defaults: DataFrame) -> DataFrame:
    """Entries, and those defaults (kind, key, value) that they have no entry for."""
    return entries.select("kind", "key", "value").unionByName(defaults.select("kind", "key", "value").join(entries.select("kind", "key"), ["kind", "key"], "left_anti"))


def looked_up(names: DataFrame, entries: DataFrame, kind: str, column: str = "name") -> DataFrame:
    """names with value: the store's value of that kind; null where it has none. The store's side has one row a key."""
    known = entries.where(F.col("kind") == kind).select(F.col("key").alias(column), "value")
    return names.join(known, column, "left")


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the folders of all but the last versions. Readers of older ones that still run lose their files: keep enough."""
    files, (at,) = _paths(spark, root, "_versions")
    names = sorted(s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName().isdigit())
    gone = []
    for name in names[:-keep]:
        said = json.loads(spark.read.text(f"{root.rstrip('/')}/_versions/{name}", wholetext=True).first()[0])
        _, (folder, mark) = _paths(spark, root, said["folder"], f"_versions/{name}")
        files.delete(folder, True)
        files.delete(mark, False)
        gone.append(said["folder"])
    return gone
