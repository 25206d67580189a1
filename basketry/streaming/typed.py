"""A stream of typed events (a user follows, sends a picture or a text) through one stateful operator with several states.

Each user has a list of names (with a time to live of its own), a history of the last diagnoses (with a longer one) and a
flag for having followed (kept for good). Times to live count from the last change of a state, in processing time, as
Spark's state variables have them; an expired state reads as empty.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import texts as T

DAY = 86_400_000
LIST_DAYS, HISTORY_DAYS, HISTORY = 30, 90, 10
REPLIES = "user_id long, event_id long, reply string, names array<string>, past int"
TYPED = "user_id long, event_id long, ts timestamp, kind string, command string, names array<string>"
#: Several state variables need this store. With times to live every batch asks for another one, without data and without end.
STREAM = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
# Commands and what they teach.
DIAGNOSE, ADD = "診断", "薬剤追加："
LIST, HELP = ("リスト確認", "りすとかくにん", "list"), ("ヘルプ", "へるぷ", "help", "使い方", "つかいかた")
TAUGHT = {"誤読修正": "misread", "同義語": "synonym", "タグ追加": "tag", "分類修正": "atc"}


def command(kind: Column, text: Column) -> Column:
    """What an event asks for: follow, image, teach, diagnose, list, help, add, direct (names with blanks between them) or none."""
    teach = F.lit(False)
    for word in TAUGHT:
        teach = teach | F.startswith(text, F.lit(f"{word}：")) | F.startswith(text, F.lit(f"{word}:"))
    low = F.lower(text)
    said = F.when(teach, "teach").when(low == DIAGNOSE, "diagnose").when(low.isin(*LIST), "list").when(low.isin(*HELP), "help").when(F.startswith(text, F.lit(ADD)), "add").when(F.size(tokens(text)) >= 2, "direct")
    return F.when(kind.isin("follow", "image"), kind).otherwise(F.coalesce(said, F.lit("none")))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s　]+"), lambda x: x != "")


def typed(events: DataFrame) -> DataFrame:
    """events (user_id, event_id, ts, kind, text, found) -> TYPED: the command and its names; found are the names in a picture."""
    c, text = command(F.col("kind"), F.col("text")), F.col("text")
    added = F.filter(F.array(F.trim(F.replace(text, F.lit(ADD), F.lit("")))), lambda x: x != "")
    none = F.array().cast("array<string>")
    names = F.when(c == "image", F.coalesce("found", none)).when(c == "add", added).when(c == "direct", tokens(text)).otherwise(none)
    return events.select("user_id", "event_id", "ts", "kind", c.alias("command"), names.alias("names"))


def taught(events: DataFrame) -> DataFrame:
    """events (ts, kind, text) -> entries (kind, key, value, ts) of a learned store; commands that can't be read teach nothing."""
    rows = events.where(command(F.col("kind"), F.col("text")) == "teach").select("ts", T.command(F.col("text")).alias("c")).where("c IS NOT NULL")
    kind = F.coalesce(*(F.when(F.col("c.name") == word, F.lit(k)) for word, k in TAUGHT.items()))
    # A misreading or a synonym is one text, whatever marks it holds.
    whole = F.array(F.array_join("c.values", ","))
    return rows.select(kind.alias("kind"), F.col("c.key").alias("key"), F.when(kind.isin("tag", "atc"), F.col("c.values")).otherwise(whole).alias("value"), "ts").where("kind IS NOT NULL")


class Lists(StatefulProcessor):
    """The user's list: a picture starts it anew, names come in once each; a diagnosis or the list itself is read from it."""

    def __init__(self, list_ms: int | None, history_ms: int | None):
        self.list_ms, self.history_ms = list_ms, history_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getListState("names", "name string", self.list_ms)
        self.past = handle.getListState("past", "event_id long", self.history_ms)
        self.follows = handle.getValueState("follows", "times int")

    def handleInputRows(self, key, rows, timerValues):
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before, past = [n for (n,) in self.names.get()], [e for (e,) in self.past.get()]
        names, known = list(before), len(past)
        times = self.follows.get()[0] if self.follows.exists() else 0
        out, follows, diagnoses = [], times, list(past)
        for event, asked, given in zip(events["event_id"], events["command"], events["names"]):
            if asked == "image":
                names, reply = [], "received"
            else:
                reply = {"teach": "taught", "help": "help", "none": None}.get(asked)
            new = [n for n in dict.fromkeys(given) if n not in names]
            if asked in ("image", "add", "direct"):
                names += new
            if asked == "follow":
                follows, reply = follows + 1, "again" if follows else "welcome"
            elif asked == "add":
                reply = "added" if new else "there" if len(given) else "unnamed"
            elif asked in ("diagnose", "direct"):
                reply = "diagnosis" if names else "nothing"
            elif asked == "list":
                reply = "list" if names else "nothing"
            if reply == "diagnosis":
                diagnoses = [*diagnoses, int(event)][-HISTORY:]
            if reply:
                out.append((key[0], event, reply, list(names), len(diagnoses)))
        if names != before:  # a state that doesn't change keeps its time to live
            self.names.put([(n,) for n in names]) if names else self.names.clear()
        if len(diagnoses) != known or diagnoses != past:
            self.past.put([(e,) for e in diagnoses])
        if follows != times:
            self.follows.update((follows,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "reply", "names", "past"])

    def close(self) -> None:
        pass


def replies(stream: DataFrame, list_days: float = LIST_DAYS, history_days: float = HISTORY_DAYS) -> DataFrame:
    """stream as typed() gives it -> REPLIES: what each event is answered with, the list after it, and how many of the last diagnoses are remembered.

    Events of a micro-batch are taken in the order of ts; later micro-batches come later whatever their ts. Events
    without a command get no reply. Null names aren't expected.
    """
    own = Lists(int(list_days * DAY), int(history_days * DAY))
    return stream.groupBy("user_id").transformWithStateInPandas(own, REPLIES, "append", "ProcessingTime")


def answered(spark: SparkSession, source, folder: str, batches_at: str, schema, list_days: float = LIST_DAYS) -> DataFrame:
    """All files under batches_at, one micro-batch each, through source (stream -> typed events) and replies() into a written table.

    The table and the stream's checkpoint lie in folder, which all machines share, and go when the driver ends.
    """
    at = f"{folder}/typed-{uuid.uuid4().hex}"
    had = {k: spark.conf.get(k, None) for k in STREAM}
    for k, v in STREAM.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(batches_at)
        run = replies(source(stream), list_days).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(REPLIES).parquet(f"{at}/out")
