from pyspark.sql import functions as F

from basketry.functions import classes as C, labels as L
from basketry.operators import knowledge, validation as V
from basketry.sources import audit

RECORD = "raw string, generic string, brand string, strength string, dose string, freq string, days string, confidence string, class_hint string, own int"


def test_records_by_hand(spark):
    rows = [(" r ", " リンゼス錠 ", " ", None, " 1錠", None, "14日分", "0.5", "", 1), ("r", None, "b", "", "", "", "", None, "h", 2), ("r", "  ", "b", "", "", "", "", None, "h", 3), (None, "薬", "b ", "5mg", "", "", None, None, " h ", 4)]
    got = {r.own: tuple(r)[:-1] for r in V.validated_records(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {1: ("r", "リナクロチド", None, "", "1錠", "", 14, 0.5, None), 4: ("", "薬", "b", "5mg", "", "", None, 0.0, "h")}
    kind = "generic string, brand string, raw string, dose_form string, quantity string, size string, strength string"
    rows = [("a", None, "テープ", None, None, None, None), ("a/b", "", "x", "外用貼付", "1", None, ""), (None, "b", "x", "外用貼付", "", "", "s"), (None, "", "テープ", None, None, None, None), ("c/d", None, None, None, None, None, "1mg")]
    got = sorted(((r.generic, r.brand, r.quantity, r.size, r.strength) for r in V.completed_records(spark.createDataFrame(rows, kind)).collect()), key=str)
    assert got == sorted([("a", None, "不明", "不明", None), ("a/b", "", "1", None, "配合錠"), (None, "b", "不明", "不明", "s"), ("c/d", None, None, None, "1mg")], key=str)


def test_candidates_by_hand(spark):
    rows = [("タケキャブ", 0.9, None), ("アムロジピン", 0.9, None), ("アムロジピン", 0.79, None), ("a", 0.9, None), ("ナントカリウム", 0.9, None), ("ナントカ", 0.9, None)]
    df = spark.createDataFrame(rows, "text string, confidence double, maker string")
    got = sorted(map(tuple, V.validated_candidates(df, F.col("text").isin(*C.ENGLISH)).collect()))
    assert got == [("アムロジピン", 0.9, None, None, None), ("ボノプラザン", 0.9, None, "タケキャブ", "known_bad")]


def test_items_are_told_apart_and_normalized(spark):
    rows = [(1, "何か", "アスパラCA錠200", "", 0.5), (2, "デビゴ", None, None, None), (3, None, "クラリス錠", "", 0.95), (4, "見知らぬ", "", "", 0.4), (5, "", None, "x", 0.1)]
    got = {r.i: r for r in V.normalized_items(spark.createDataFrame(rows, "i int, generic string, brand string, raw string, confidence double")).collect()}
    assert (got[1].generic, got[1].normalization_applied, got[1].original_name, got[1].confidence) == ("L-アスパラギン酸カルシウム", True, "何か", 1.0)
    assert (got[2].generic, got[2].original_name) == ("レンボレキサント", "デビゴ") and got[2].confidence >= 0.8 and got[3].generic == "クラリスロマイシン" and got[3].confidence >= 0.95
    assert (got[4].generic, got[4].normalization_applied, got[4].original_name, got[4].confidence) == ("見知らぬ", False, None, 0.4)
    assert (got[5].generic, got[5].normalization_applied, got[5].confidence) == ("", None, 0.1)


def test_suggestions_tags_and_rules(spark):
    df = spark.createDataFrame([("ラベプラゾール",), ("何か",)], "n string").select("n", V.suggestions(F.col("n")).alias("s"))
    got = {r.n: [(x.corrected, x.reason, x.confidence) for x in r.s] for r in df.collect()}
    assert got == {"何か": [], "ラベプラゾール": [("ボノプラザン", "known_bad", 0.95), ("ボノプラザン", "candidate", 0.9), ("ランソプラゾール", "candidate", 0.8), ("オメプラゾール", "candidate", 0.7)]}
    tags = spark.range(1).select(knowledge.tags_of_item(F.lit("アスピリン"), F.lit(None).cast("string"), F.lit("タケキャブ錠")).alias("t")).first().t
    assert tags == ["ANTI_PLATELET", "P-CAB"]
    rules = spark.createDataFrame([("a", "major"), ("b", "minor"), ("c", None)], "id string, severity string")
    ids = lambda **how: sorted(r.id for r in knowledge.rules_with(rules, **how).collect())
    assert ids() == ["a", "b", "c"] and ids(id="b") == ["b"] and ids(severity="major") == ["a"] and ids(id="b", severity="major") == []


def test_labels_by_hand(spark):
    rows = [("重大", "KEGG", "critical", ["a", "b"]), (" 軽微 ", "AI", "low", []), ("x", "手動ルール", "urgent", None), (None, None, None, ["c"])]
    df = spark.createDataFrame(rows, "s string, o string, r string, t array<string>")
    got = [tuple(r) for r in df.select(L.severity_code(F.col("s")), L.severity_label(F.col("s")), L.source_label(F.col("o")), L.risk_mark(F.col("r")), L.priority_mark(F.col("r")), L.shown_targets(F.col("t"))).collect()]
    assert got == [("major", "🚨 重大", " 📚", "🚨", "🚨", "a、b"), ("minor", "⚠️ 併用注意", " 🤖", "⚠️", "ℹ️", "（対象薬の特定に失敗）"), ("x", "⚠️ 併用注意", "", "⚠️", "🚨", "（対象薬の特定に失敗）"), ("", "⚠️ 併用注意", "", "⚠️", "ℹ️", "c")]


def test_enrichment_and_trace_by_hand(spark):
    book = spark.createDataFrame([("a", "不明", "下剤", 1), ("b", "g", "不明", 2), ("c", "不明", "降圧薬", 3), ("d", "不明", "不明", 4), ("a", "不明", None, 5)], "drug_name string, generic_name string, category string, hit int")
    found = spark.createDataFrame([("a", "A", "x"), ("b", "B", "y"), ("c", "C", "z")], "drug_name string, generic_name string, category string")
    got = sorted(map(tuple, V.enriched_dictionary(book.withColumnRenamed("hit", "ord"), found).collect()), key=lambda r: r[3])
    assert got == [("a", "A", "x", 1), ("b", "g", "y", 2), ("c", "不明", "降圧薬", 3), ("d", "不明", "不明", 4), ("a", "不明", None, 5)]
    findings = spark.createDataFrame([(1, "t", "重大", "a", "x"), (1, "u", "軽微", "b", "y"), (1, "v", "other", "b", "y")], "rx_id int, title string, severity string, targets string, action string")
    items = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "c")], "rx_id int, name string")
    rows = {r.rx_id: r for r in audit.audit_trace(findings, items).collect()}
    assert [rows[1][i] for i in (1, 3, 4, 5)] == [["a", "b"], 3, 1, 1] and [x.severity for x in rows[1].matched_rules] == ["major", "minor", "other"] and tuple(rows[2])[1:] == (["c"], None, 0, 0, 0)
