"""Values worked out by hand."""

from pyspark.sql import functions as F

from basketry.functions import names as N
from basketry.operators import dedupe, interactions, knowledge

COLUMNS = "rx_id int, pos int, generic string, name string, brand string, raw string, strength string, confidence double"


def basket(spark, *names, rx=1):
    return spark.createDataFrame([(rx, i, n, None, None, None, None, 0.5) for i, n in enumerate(names)], COLUMNS)


def titles(df):
    return [(r.title, r.priority, r.targets) for r in df.orderBy("rx_id", "rank").collect()]


def test_report(spark):
    got = titles(interactions.report(basket(spark, "エナラプリル", "エンレスト", "アムロジピン", "ニフェジピン")))
    assert [x[:2] for x in got] == [("RAAS禁忌（ARNI＋ACEIの同時併用）", 0), ("降圧薬の多剤併用", 2), ("Ca拮抗薬の重複", 2), ("Ca拮抗薬の重複", 2)]
    assert got[0][2] == "エナラプリル、サクビトリル/バルサルタン" and got[1][2] == "アムロジピン、エナラプリル、サクビトリル/バルサルタン、ニフェジピン徐放"


def test_binder_depends_on_the_basket(spark):
    assert titles(interactions.report(basket(spark, "キックリン")))[0][:2] == ("リン吸着薬／Ca製剤による他剤の吸収低下（該当薬なし：一般注意）", 3)
    assert titles(interactions.report(basket(spark, "キックリン", "レボフロキサシン錠")))[0][:2] == ("リン吸着薬／Ca製剤による他剤の吸収低下（該当薬あり：2時間以上間隔をあける）", 2)
    got = titles(interactions.report(basket(spark, "エボカルセト", "リナクロチド", "エロビキシバット")))
    assert [x[:2] for x in got] == [("下剤の多剤併用", 2), ("エボカルセト＋下剤多剤（低Ca/QT延長リスク）", 3)]


def test_report_of_nothing(spark):
    b = basket(spark, "エナラプリル", None, "", "  ", "エナラプリル")
    assert interactions.report(b).count() == 0 and interactions.report(b.limit(0)).count() == 0


def test_same_key_keeps_the_best(spark):
    rows = [(1, 0, "センノシド", None, None, "", None, 0.7), (1, 1, "センノシド錠", None, None, "", "12mg", 0.8), (1, 2, "ジクロフェナク", None, None, "ジクロフェナクゲル", None, 0.5), (1, 3, "ジクロフェナク", None, None, "ジクロフェナク錠", None, 0.5)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("key", N.same_key(F.col("generic"), F.col("raw"), F.lit(None).cast("string")))
    best = F.when(F.col("strength").isNotNull(), 1).otherwise(0) + F.col("confidence")
    assert sorted(r.pos for r in dedupe.best_per_key(df, ["rx_id", "key"], [F.desc(best), F.col("pos")]).collect()) == [1, 2, 3]


def test_names(spark):
    df = spark.createDataFrame([("テラムロＡＰ",), ("テルミサルタン・アムロジピン",), ("ン・配合",), (None,)], "t string")
    got = df.select(N.canonical(F.col("t")).alias("c"), N.is_noise(F.col("t")).alias("n")).collect()
    assert [r.c for r in got] == ["テルミサルタン/アムロジピン", "テルミサルタン/アムロジピン", "ン/配合", None] and [r.n for r in got] == [False, False, True, None]


def test_actions_and_the_order_of_three_names(spark):
    got = {r.title: (r.targets, r.action) for r in interactions.report(basket(spark, "テラムロAP", "エナラプリル", "アジルバ", "ランソプラゾールOD", "タケキャブ")).collect()}
    assert got["胃酸抑制薬の重複"] == ("ボノプラザン、ランソプラゾール", "同効薬の重複投与に注意。適応・目的が同じなら簡素化を検討。")
    assert got["RAAS重複（原則併用回避：ACEI/ARB/ARNI）"] == ("エナラプリル、テルミサルタン/アムロジピン", "低血圧・高K・腎機能悪化リスク。原則併用回避を検討。開始/変更後1–2週でCr/eGFR/K、血圧を再評価。")
    both = {r.title: r.action for r in interactions.report(basket(spark, "テラムロAP", "エンレスト")).collect()}
    assert both["RAAS重複（原則併用回避：ACEI/ARB/ARNI）"] == "低血圧・高K・腎機能悪化リスク。原則併用回避を検討。（注：ARNIはARB成分〈バルサルタン〉を含むため）開始/変更後1–2週でCr/eGFR/K、血圧を再評価。"
    assert set(interactions.ACTIONS) == {r.id for r in interactions.RULES}
    shown = lambda *x: spark.range(1).select(N.displayed(F.array(*map(F.lit, x)))).first()[0]
    assert shown("テラムロAP", "エンレスト", "エナラプリル5mg") == "エナラプリル、サクビトリル/バルサルタン、テルミサルタン/アムロジピン"
    assert shown("テラムロAP", "エンレスト") == "テルミサルタン/アムロジピン、サクビトリル/バルサルタン"


def test_class_risks_by_hand(spark):
    rows = [(1, "a", "cyp3a4_inhibitor"), (1, "b", "orexin_receptor_antagonist"), (2, "c", "sleep_medication"), (2, "d", "orexin_receptor_antagonist"), (3, "e", "ppi"), (3, "f", "p_cab"), (3, "e", "ppi"), (4, "g", "orexin_receptor_antagonist"), (4, "h", "orexin_receptor_antagonist"), (5, "i", "cyp3a4_inhibitor"), (5, "j", "ca_antagonist"), (6, None, "ppi"), (6, "k", None), (7, "l", "cyp3a4_inhibitor"), (7, "m", "cyp3a4_inhibitor")]
    got = sorted((r.rx_id, r.risk, r.description, r.targets) for r in knowledge.class_risks(spark.createDataFrame(rows, "rx_id int, name string, category string")).collect())
    by = {(i, risk): (text, targets) for i, risk, text, targets in got}
    assert by[1, "cyp3a4_inhibition"] == ("CYP3A4阻害薬による他剤の血中濃度上昇", "a、b") and by[2, "sleep_medication_duplication"] == ("睡眠薬の重複投与", "c、d") and by[4, "sleep_medication_duplication"][1] == "g、h"
    assert by[3, "gastric_medications"][1] == "e、f" and [k for k in by if k[0] == 4] == [(4, "sleep_medication_duplication")]
    # The plain risk of that name goes before; it fires for two inhibitors too.
    assert by[5, "cyp3a4_inhibition"][0] == by[7, "cyp3a4_inhibition"][0] == "CYP3A4阻害薬（クラリスロマイシン）による他剤の血中濃度上昇" and (5, "ca_antagonist_cyp3a4_inhibitor") in by and not [k for k in by if k[0] == 6]
