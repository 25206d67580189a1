"""A text of several blocks, and values worked out by hand."""

from pyspark.sql import functions as F

from basketry.functions import attributes as A
from basketry.plans import prescription as P

TEXT = "患者\n1【般】\nエナラプリル錠 5mg 1錠 朝食後 14日分\n2【般】エンレスト錠 100mg 2錠 朝夕\nエナラプリル 錠\n3【外】ジクロフェナクゲル 1% 毎日\n【般】\n"


def test_items_and_report(spark):
    texts = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "アムロジピン錠 5mg 眠前\nニフェジピン錠 10mg")], "rx_id int, text string")
    rows = {(r.rx_id, r.generic): r for r in P.distinct_items(P.items(texts)).collect()}
    assert set(rows) == {(1, "エナラプリル"), (1, "エンレスト"), (1, "ジクロフェナク"), (4, "アムロジピン"), (4, "ニフェジピン")}
    e = rows[1, "エナラプリル"]
    assert (e.strength, e.dose, e.days, e.route, e.confidence) == ("5mg", "1錠", 14, "内用", 1.0)
    assert rows[1, "ジクロフェナク"].route == "外用" and rows[4, "アムロジピン"].freq == "就寝前"
    got = {r.rx_id: r for r in P.diagnose(texts).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1].report.split("\n")[0] == "[重大] RAAS禁忌（ARNI＋ACEIの同時併用）：エナラプリル、サクビトリル/バルサルタン"
    assert got[1].passed and got[1].n_items == 3 and got[4].report == "\n".join(["[併用注意] Ca拮抗薬の重複：アムロジピン、ニフェジピン徐放"] * 2)
    assert all(not got[i].passed and got[i].issues == "low_coverage:high,low_classification:medium,too_few:high" and got[i].strategy == "extraction,classification,lookup,alternative" and got[i].report == "" for i in (2, 3))
    assert P.diagnose(texts.limit(0)).count() == 0


def test_texts_of_noise_repeated_texts_and_lines_without_form(spark):
    texts = spark.createDataFrame([(1, "1【般】アムロジピン錠 5mg 朝\n薬局"), (1, "ニフェジピン錠 10mg 朝\nアムロジピン錠 朝"), (2, "錠"), (None, "1【般】センナ錠 5mg")], "rx_id int, text string")
    got = {r.rx_id: r for r in P.diagnose(texts).collect()}
    assert {k: (r.n_items, r.passed, r.report.count("\n")) for k, r in got.items()} == {1: (2, True, 1), 2: (0, False, 0), None: (1, True, 0)}
    whole = "|".join(A.FORM_WORDS)
    lines = [*whole.split("|"), "a錠b", "カプ", "点 眼", "", None]
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select(A.has_form_word(F.col("x")).alias("a"), F.col("x").rlike(whole).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_code_labels(spark):
    rows = [(["A06AB06"],), (["A02BC06"],), (["A06", "A06AB08"],), (["X99"],), ([],), (None,)]
    got = [r.x for r in spark.createDataFrame(rows, "c array<string>").select(A.code_label(F.col("c")).alias("x")).collect()]
    assert got == ["下剤（刺激性）", "消化器系・代謝", "下剤（刺激性：ピコスルファート）", None, None, None]
