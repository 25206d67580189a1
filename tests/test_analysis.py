import pytest
from pyspark.sql import functions as F

from basketry.functions import analysis as A, classes as C, medicines as M
from basketry.operators import knowledge, rerank
from basketry.plans import risk_queries
from tests.test_medicines import of


def test_english_names_by_hand(spark):
    got = of(spark, ["アスピリン（100mg）", "クロラール", "アスピリン錠", None], A.english_names)
    assert got == [["aspirin", "acetylsalicylic acid", "ASA"], ["chloral", "chloral hydrate", "trichloroacetaldehyde"], [], []]
    variants = of(spark, ["メトホルミン", "ジアゼパム錠", "リンパム", "ヌゾラム", "薬"], A.english_variants)
    assert variants[0] == ["metformin", "glucophage"] and variants[1] == ["diazepam", "valium"]
    assert variants[2] == ["リンpam"] and variants[3] == ["ヌゾlam"] and variants[4] == []
    assert of(spark, ["ジアゼパム"], A.english_variants) == [["diazepam", "valium", "ジアゼpam"]]


def test_analysis_by_hand(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(["アスピリン錠", "xy", "何かの薬", "リン酸コデイン錠", "エソメプラゾル錠"])], "i int, s string")
    got = [r.a for r in rows.select("i", A.analysed(F.col("s")).alias("a")).orderBy("i").collect()]
    # 4 characters, a category, 3 plain ones, English names, the ending: 0.9; the common English name comes second.
    assert (got[0].category, got[0].plain, round(got[0].confidence, 9), got[0].priority) == ("nsaid", "アスピリン", 0.9, ["アスピリン錠", "aspirin", "アスピリン"])
    assert (got[1].category, got[1].confidence, got[1].priority) == ("unknown", 0.0, [])
    assert (round(got[2].confidence, 9), got[2].priority) == (0.4, ["何かの薬"])
    # 0.2 + 0.3 + 0.2, then ending and beginning; the name, its plain form, then the category's first part.
    assert (got[3].category, round(got[3].confidence, 9), got[3].priority) == ("opioid", 0.9, ["リン酸コデイン錠", "リン酸コデイン", "morphine"])
    assert got[4].category == "ppi"


def test_priority_puts_the_last_common_name_first(spark):
    row = spark.range(1).select(A.search_priority(F.lit("n"), F.lit("arni"), F.lit("m"), F.array(F.lit("x"), F.lit("aspirin"), F.lit("insulin")), F.lit(0.6)).alias("p"))
    assert row.first().p == ["n", "insulin", "aspirin"]
    low = spark.range(1).select(A.search_priority(F.lit("n"), F.lit("arni"), F.lit("m"), F.array(F.lit("x")), F.lit(0.3)).alias("p"))
    assert low.first().p == ["m"]


def plain_score(name, english, label):
    def overlap(a, b):
        return int(200 * sum(c in b for c in a) / (len(a) + len(b))) if a and b else 0

    a, b = name.lower(), label.lower()
    order = lambda s: " ".join(sorted(s.split(" ")))
    x, y = set(a.split(" ")), set(b.split(" "))
    kana = "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c for c in a).replace(" ", "").replace("-", "")
    best = max(overlap(a, b), 100 if a in b or b in a else overlap(a, b), overlap(order(a), order(b)), int(100 * len(x & y) / len(x | y)), overlap(kana, b))
    ending = any(name.endswith(e) and w in b for e, w in rerank.BONUS_ENDINGS)
    piece = len(name) > 3 and any(a[i : i + 3] in b for i in range(len(a) - 2))
    return best + 25 * any(e.lower() in b for e in english) + 15 * piece + 20 * ending


def test_best_labels_against_a_plain_version(spark):
    names = ["トリアゾラム", "アルプラゾラム", "aspirin plus", "warfarin", "zzz", None]
    labels = [("d1", "Triazolam tablets"), ("d2", "Alprazolam"), ("d3", "Aspirin"), ("d4", "aspirin oil"), ("d5", "Warfarin sodium"), ("d7", "Warfarin"), ("d6", "Warfarin"), ("d8", None)]
    got = {r.name: (r.id, r.label, r.score) for r in rerank.best_labels(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(labels, "id string, label string")).collect()}
    want = {}
    for n in names[:-1]:
        english = next((v for k, v in A.ENGLISH_NAMES.items() if k == n), ())
        near = [(x, i) for i, x in labels if x and not any(w in x.lower() for w in A.NO_MEDICINES) and any(s[j : j + 3].lower() in x.lower() for s in (n, *english) for j in range(max(1, len(s) - 2)))]
        if near:
            s, x, i = min((-plain_score(n, english, x), x, i) for x, i in near)
            want[n] = (i, x, -s)
    assert got == want and got["warfarin"][:2] == ("d6", "Warfarin") and "zzz" not in got


@pytest.mark.parametrize("name, category", [("フルニトラゼパム", "sleep_medication"), ("エチゾラム錠", "benzodiazepine"), ("サクビトリル/バルサルタン", "arni"), ("テルミサルタン・アムロジピン", "ca_antagonist"), ("カルシウム", "antacid"), ("リスペリドン", "antipsychotic"), ("フルラゼパム", "ssri_antidepressant"), ("沈降炭酸カルシウム錠", "phosphate_binder"), ("エスゾピクロン", "sleep_medication"), ("", "unknown")])
def test_categories_by_hand(spark, name, category):
    assert of(spark, [name], lambda c: C.category(c, M.plain(c))) == [category]


def test_two_psychotropic_medicines_fire_their_risk(spark, sf):
    assert {"benzodiazepine", "barbiturate", "antidepressant", "antipsychotic"} <= set(C.CATEGORIES.values())
    assert {c for r in knowledge.RISKS for c in r[1]} - set(C.CATEGORIES.values()) == {"cyp3a4_inhibitor"}
    risks = {r.risk: r for r in risk_queries.clinical_risks(spark, sf).where("risk = 'psychotropic_medications'").limit(1).collect()}
    assert set(risks["psychotropic_medications"].targets.split("、")) <= {"エチゾラム", "フェノバルビタール", "リスペリドン", "デュロキセチン"}
