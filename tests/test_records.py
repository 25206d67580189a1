import os
import time
from collections import Counter, defaultdict
from itertools import combinations

import __spark_entry__ as entry
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.operators import records, reported_pairs
from basketry.plans.pool import POOL, baskets
from basketry.sources import audit, store
from basketry.streaming import typed

RECORD = """before
ENTRY       D0001  Drug
NAME        First; second
NAME        Third
CLASS       Cox-2 Inhibitor
PATHWAY     map1 x
            ATC A01AA01
BRITE       ATC B01AA01
            ATC C01AA01 and C01AA02, c01aa03
TARGET      t1
DBLINKS     ATC D01AA01
///
CATEGORY    Kampo
BRITE
            E01AA01
///"""


def test_records_by_hand(spark):
    lines = records.record_lines(spark.createDataFrame([(1, RECORD), (2, None), (3, "")], "id int, text string"), "id")
    got = {(r.id, r.record, r.n): (r.section, r.head, r.body) for r in lines.collect()}
    assert got[1, 0, 0] == (None, False, "before") and got[1, 0, 6] == ("PATHWAY", False, "ATC A01AA01") and got[1, 1, 12] == ("CATEGORY", True, "Kampo")
    assert got[3, 0, 0] == (None, False, "") and not [k for k in got if k[0] == 2] and (1, 0, 11) not in got
    codes = sorted((r.record, r.ord, r.entry, r.code) for r in records.record_codes(lines, "id").collect())
    assert codes == [(0, 0, "D0001", "C01AA01"), (0, 1, "D0001", "C01AA02"), (0, 2, "D0001", "D01AA01")]
    fields = {(r.id, r.record): (r.category, r.pathways, r.targets, r.generic, r.enhanced) for r in records.record_fields(lines, "id").collect()}
    assert fields[1, 0] == ("NSAIDs", ["map1"], ["t1"], "First", "不明") and fields[1, 1] == ("漢方", [], [], None, "不明")


def test_reported_pairs_by_hand(spark):
    lines = spark.createDataFrame([(x,) for x in ["# no", "dr:D1\tD2\tMajor bleeding", "D3\tdrug:D1\t", "D1\tD2", "D2\tD3\tmonitor"]], "value string")
    got = sorted(map(tuple, reported_pairs.reported_pairs(lines).collect()))
    assert got == [("D1", "D2", "Major bleeding", "重大"), ("D2", "D3", "monitor", "併用注意"), ("D3", "D1", "", "併用注意")]
    items = [(1, 0, "b"), (1, 1, "a"), (1, 2, "葛根湯"), (1, 3, "x"), *((2, i, n) for i, n in enumerate("aabbccd")), *((3, i, "x") for i in range(9)), (3, 9, "a"), (3, 10, "b"), (4, 0, None), (4, 1, "c"), (4, 2, "a")]
    ids = spark.createDataFrame([("a", "dr:D1"), ("b", "D2"), ("c", "D3"), ("d", "D4"), ("葛根湯", "D2")], "name string, id string")
    found = reported_pairs.basket_findings(spark.createDataFrame(items, "rx_id int, pos int, name string"), ids, reported_pairs.reported_pairs(lines))
    # Basket 2 has 21 pairs; of basket 3 the eleventh item doesn't count; a report without a text gets one.
    assert sorted((r.rx_id, r.name, r.advice, r.severity, r.source) for r in found.collect()) == [(1, "b × a", "Major bleeding", "重大", "KEGG"), (4, "c × a", "相互作用が報告されています。", "併用注意", "KEGG")]


def test_each_of_equal_reports_is_a_row(spark):
    lines = spark.createDataFrame([(x,) for x in ["D1\tD2\tmajor", "dr:D2\tD1\tmajor", "D1\tD2\tmajor\tx", "D1\tD2\t", "D2\tD2\tsame"]], "value string")
    items = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "b"), (None, 0, "a"), (None, 1, "b"), (2, 0, "a")], "rx_id int, pos int, name string")
    ids = spark.createDataFrame([("a", "D1"), ("b", "dr:D2")], "name string, id string")
    found = reported_pairs.basket_findings(items, ids, reported_pairs.reported_pairs(lines))
    got = sorted((r.rx_id, r.target_drugs, r.advice, r.severity) for r in found.collect())
    assert got == sorted(2 * [*3 * [(1, "a、b", "major", "重大")], (1, "a、b", "相互作用が報告されています。", "併用注意")] + [(1, "b、b", "same", "併用注意")])
    assert reported_pairs.basket_findings(items, ids, reported_pairs.reported_pairs(lines.limit(0))).count() == 0


def test_all_items_and_pairs_of_a_basket_count(spark):
    items = [(1, i, f"n{i}") for i in range(23)] + [(2, i, "x") for i in range(30)] + [(2, 30, "n1"), (2, 31, "n0")]
    ids = spark.createDataFrame([(f"n{i}", f"D{i}") for i in range(23)], "name string, id string")
    pairs = reported_pairs.basket_pairs(spark.createDataFrame(items, "rx_id int, pos int, name string"), ids).collect()
    assert sorted((r.rx_id, r.x.name, r.y.name) for r in pairs) == sorted([(1, f"n{i}", f"n{j}") for i in range(23) for j in range(i + 1, 23)] + [(2, "n1", "n0")])


def test_reported_pairs_of_all_baskets_are_found(spark, sf):
    def number(name):
        return POOL.index(name)

    reports = Counter()
    for (k,) in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect():
        if k % 13 and k % 17:
            reports[frozenset((k % len(POOL), (k * 7 + 3) % len(POOL)))] += 1
    own = defaultdict(list)
    for r in baskets(spark, sf).select("rx_id", "pos", "name").collect():
        if number(r.name) % 5 != 4 and not any(w in r.name for w in reported_pairs.SKIPPED):
            own[r.rx_id].append((r.pos, number(r.name)))
    expected = Counter({k: sum(reports[frozenset((x, y))] for (_, x), (_, y) in combinations(sorted(v), 2)) for k, v in own.items()})
    assert max(map(len, own.values())) > 7
    got = entry.queries()["reported_pair_findings"](spark, sf).groupBy("rx_id").count().collect()
    assert {r.rx_id: r["count"] for r in got} == dict(+expected)


def test_many_equal_reports_are_handed_out_in_blocks(spark):
    copies = {("D1", "D2"): 2900, ("D2", "D1"): 17, ("D1", "D3"): 128, ("D2", "D3"): 3}
    lines = spark.createDataFrame([(f"{a}\t{b}\tmajor",) for (a, b), n in copies.items() for _ in range(n)], "value string")
    items = spark.createDataFrame([(k, i, n) for k in (1, 2) for i, n in enumerate("abc")], "rx_id int, pos int, name string")
    ids = spark.createDataFrame([("a", "D1"), ("b", "D2"), ("c", "D3")], "name string, id string")
    found = reported_pairs.findings(items, ids, reported_pairs.reported_pairs(lines))
    got = found.groupBy(*found.columns).count().collect()
    assert sorted((r.rx_id, r.target_drugs, r["count"]) for r in got) == [(k, *x) for k in (1, 2) for x in (("a、b", 2917), ("a、c", 128), ("b、c", 3))]
    assert found.columns == ["rx_id", "name", "target_drugs", "advice", "severity", "source"]
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()


def test_audit_files_may_gain_columns_and_fields(spark, tmp_path):
    rows = spark.sql("SELECT 's1' session_id, TIMESTAMP '2024-01-01 10:00:00' ts, array(named_struct('generic', 'g', 'atc', array('A'), 'secret', 'x')) items, array(named_struct('id', 'r1', 'severity', 'major')) major, CAST(NULL AS array<struct<id string>>) moderate")
    one = audit.audit_records(rows)
    r = one.first()
    assert r.drugs[0].asDict() == {"generic": "g", "brand": "", "raw": "", "kegg_id": "", "atc_codes": ["A"], "class_jp": "", "confidence": 0.0, "interaction_tags": [], "route": "", "strength": "", "dose": "", "frequency": ""}
    assert r.interactions.asDict(True) == {"has_interactions": True, "major_count": 1, "moderate_count": 0, "rule_hits": [{"id": "r1", "name": "", "severity": "major", "matched_drugs": []}]}
    audit.write_audit(one, f"{tmp_path}/a")
    audit.write_audit(one.withColumn("ts", F.expr("ts + INTERVAL 1 DAY")).withColumn("stage", F.lit("late")).withColumn("interactions", F.col("interactions").withField("reviewed", F.lit(True))), f"{tmp_path}/a")
    back = audit.read_audit(spark, f"{tmp_path}/a")
    assert [(str(x.date), x.stage, x.interactions.reviewed, x.interactions.major_count) for x in back.orderBy("date").collect()] == [("2024-01-01", None, None, 1), ("2024-01-02", "late", True, 1)]
    assert sorted(x for x in os.listdir(f"{tmp_path}/a") if "=" in x) == ["date=2024-01-01", "date=2024-01-02"]


def entries(spark, *rows):
    return spark.createDataFrame([(k, key, v, pd.Timestamp(t, unit="s").to_pydatetime()) for k, key, v, t in rows], store.ENTRY)


def said(df):
    return {(r.kind, r.key): r.value for r in df.collect()}


def test_a_failing_write_leaves_the_old_version(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert said(store.read_store(spark, root)) == {} and store.upsert(entries(spark, ("synonym", "a", ["b"], 5), ("tag", "x", ["T"], 5)), root) == 1
    bad = entries(spark, ("synonym", "a", ["c"], 9)).withColumn("key", F.when(F.raise_error(F.lit("broken")).isNull(), "a"))
    with pytest.raises(Exception, match="broken"):
        store.upsert(bad, root)
    assert said(store.read_store(spark, root)) == {("synonym", "a"): ["b"], ("tag", "x"): ["T"]} and store.current(spark, root)["version"] == 1
    before = store.read_store(spark, root)
    assert store.upsert(entries(spark, ("synonym", "a", ["c"], 9), ("synonym", "a", ["old"], 1), ("tag", "x", ["S", "T"], 1)), root) == 2
    assert said(store.read_store(spark, root)) == {("synonym", "a"): ["c"], ("tag", "x"): ["S", "T"]}
    assert said(before) == {("synonym", "a"): ["b"], ("tag", "x"): ["T"]}  # a reader of the old version still has it
    known = store.looked_up(spark.createDataFrame([("a",), ("z",)], "name string"), store.read_store(spark, root), "synonym")
    assert sorted(map(tuple, known.collect())) == [("a", ["c"]), ("z", None)]
    filled = store.with_defaults(store.read_store(spark, root), entries(spark, ("misread", "ロ腔", ["口腔"], 0), ("synonym", "a", ["default"], 0)))
    assert said(filled) == {("synonym", "a"): ["c"], ("tag", "x"): ["S", "T"], ("misread", "ロ腔"): ["口腔"]}
    assert len(store.vacuum(spark, root, keep=1)) == 1 and said(store.read_store(spark, root))[("synonym", "a")] == ["c"]


def test_one_of_two_writers_wins_and_a_batch_counts_once(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert store.commit(entries(spark, ("synonym", "a", ["b"], 1)), root, 0) == 1
    with pytest.raises(store.Conflict):
        store.commit(entries(spark, ("synonym", "a", ["lost"], 1)), root, 0)
    assert said(store.read_store(spark, root)) == {("synonym", "a"): ["b"]}
    write = store.upserts(root)
    write(entries(spark, ("tag", "x", ["T"], 1)), 0)
    write(entries(spark, ("tag", "x", ["never"], 1)), 0)
    assert said(store.read_store(spark, root))[("tag", "x")] == ["T"] and store.current(spark, root) | {"folder": ""} == {"version": 2, "folder": "", "batch": 0}


def plain_replies(events):
    """What events (user, id, kind, text, found) in their order are answered with."""
    lists, past, follows, out = {}, {}, {}, []
    for user, i, kind, text, found in events:
        names, said_ = lists.setdefault(user, []), None
        if kind == "follow":
            follows[user] = follows.get(user, 0) + 1
            said_ = "welcome" if follows[user] == 1 else "again"
        elif kind == "image":
            names.clear()
            names += dict.fromkeys(found or [])
            said_ = "received"
        elif text and text[:4] in ("同義語：", "タグ追加"):
            said_ = "taught"
        elif text in ("診断", "LIST"):
            said_ = ("diagnosis" if text == "診断" else "list") if names else "nothing"
        elif text and text.startswith("薬剤追加："):
            n = text[5:].strip()
            said_ = "unnamed" if not n else "there" if n in names else "added"
            names += [n] if said_ == "added" else []
        elif text and len(text.split()) > 1:
            names += [n for n in dict.fromkeys(text.split()) if n not in names]
            said_ = "diagnosis"
        if said_ == "diagnosis":
            past[user] = min(10, past.get(user, 0) + 1)
        if said_:
            out.append((user, i, said_, list(names), past.get(user, 0)))
    return sorted(out)


EVENTS = [
    (1, 0, "follow", None, None), (1, 1, "text", "診断", None), (1, 2, "image", None, ["a", "b", "a"]), (2, 3, "text", "薬剤追加：c", None), (1, 4, "text", "診断", None), (1, 5, "text", "薬剤追加： a ", None),
    (1, 6, "text", "薬剤追加：", None), (2, 7, "text", "d c\ne", None), (1, 8, "text", "同義語：x→y", None), (1, 9, "text", "LIST", None), (2, 10, "image", None, None), (2, 11, "text", "LIST", None), (1, 12, "follow", None, None), (1, 13, "text", "one", None), (1, 14, "text", None, None),
    (2, 15, "text", "タグ追加：g→T1、 T2", None), *((2, 16 + i, "text", "u v", None) for i in range(12)),
]
SCHEMA = "user_id long, event_id long, kind string, text string, found array<string>, ts timestamp"


def answered(spark, tmp_path, goes, days):
    for rows in goes:
        df = spark.createDataFrame([(*e, pd.Timestamp(e[1], unit="s").to_pydatetime()) for e in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken in the order of their times, which may be whole seconds
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    out = typed.answered(spark, typed.typed, f"file://{tmp_path}", f"{tmp_path}/in", schema, days)
    return sorted((r.user_id, r.event_id, r.reply, r.names, r.past) for r in out.collect())


def test_typed_events_against_a_plain_version_over_several_batches(spark, tmp_path):
    assert answered(spark, tmp_path, [EVENTS[:5], EVENTS[5:9], EVENTS[9:]], 30) == plain_replies(EVENTS)


def test_lists_have_a_time_to_live_of_their_own(spark, tmp_path):
    got = answered(spark, tmp_path, [EVENTS[:5], EVENTS[9:10]], 1e-7)  # under a hundredth of a second
    # The list is gone in the second batch; that a diagnosis was made isn't forgotten.
    assert got[-2:] == [(1, 9, "nothing", [], 1), (2, 3, "added", ["c"], 0)]


def test_what_commands_teach(spark):
    rows = [(t, "text") for t in ("同義語：別名 -> 一般", "タグ追加:g→B、 A,", "誤読修正：ab", "分類修正：g→A01", "診断", "誤読修正：a→b,c")]
    df = spark.createDataFrame(rows, "text string, kind string").withColumn("ts", F.current_timestamp())
    got = sorted((r.kind, r.key, r.value) for r in typed.taught(df).collect())
    assert got == [("atc", "g", ["A01"]), ("misread", "a", ["b,c"]), ("synonym", "別名", ["一般"]), ("tag", "g", ["B", "A"])]
