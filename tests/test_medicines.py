import difflib
import json

import pytest
from pyspark.sql import functions as F

from basketry.functions import attributes as A, medicines as M, names as N, texts as T
from basketry.operators import dedupe, interactions, knowledge, lookup, normalize, postprocess
from basketry.plans.pool import POOL, baskets
from basketry.sources import tables
from basketry.streaming import buffer


def of(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[1] for r in sorted(rows.select("i", fn(F.col("s")).alias("x")).collect())]


def test_names_lose_makers_amounts_and_marks(spark):
    got = of(spark, ["タダラフィル「サンド」", "アムロジピン 2.5 mg", "アムロジピン5MG", "テラムロ OD", "ランソプラゾールOD", "センナ，センナ実", "エンレスト(心不全)", "ｱﾑﾛｼﾞﾋﾟﾝ＋ﾃﾙﾐｻﾙﾀﾝ", None], N.sanitized)
    assert got == ["タダラフィル", "アムロジピン", "アムロジピン", "テラムロ", "ランソプラゾールOD", "センナ/センナ実", "エンレスト", "アムロジピン/テルミサルタン", None]


def test_a_maker_in_brackets_loses_no_finding(spark):
    rows = [(1, "タダラフィル「サンド」"), (1, "ニコランジル錠5mg"), (1, "ニコランジル"), (2, "アムロジピン"), (2, "ニフェジピン10mg")]
    df = spark.createDataFrame(rows, "rx_id int, generic string").selectExpr("rx_id", "generic", "CAST(NULL AS string) name", "CAST(NULL AS string) brand", "generic raw")
    got = [(r.rx_id, r.title, r.targets) for r in sorted(interactions.report(df).collect(), key=lambda r: (r.rx_id, r.rank))]
    assert got == [(1, "PDE5阻害薬＋硝酸薬相当（禁忌）", "タダラフィル、ニコランジル"), (2, "Ca拮抗薬の重複", "アムロジピン、ニフェジピン徐放"), (2, "Ca拮抗薬の重複", "アムロジピン、ニフェジピン徐放")]


def test_drops_keep_no_form_in_their_names(spark):
    assert of(spark, ["クラビット点眼液0.5%", "フルナーゼ点鼻液", "タダラフィルOD錠5mg", "エナラプリル"], A.item_name) == ["クラビット0.", "フルナーゼ", "タダラフィル", "エナラプリル"]


def test_corrections_and_keys(spark):
    assert of(spark, ["フルラゼパム錠", "ロゼルム", "7オルケディア錠1mg", "テラムロリウム", "xyz"], M.corrected) == ["フルボキサミン", "ロゼレム", "エボカルセト", "テラムロリウム", "xyz"]
    assert of(spark, ["アスパラＣＡ", "ロ腔内", "デエビコ錠", "何か"], M.alias_fixed) == ["L-アスパラギン酸カルシウム", "口腔内", "レンボレキサント錠", "何か"]
    assert of(spark, ["あすぴりん 100", "Ａ・Ｂー"], M.katakana) == ["アスピリン100", "AB"]
    assert of(spark, ["錠5mg", "アムロジピン錠5mg"], M.without_dosage) == ["mg", "アムロジピンmg"] and of(spark, ["錠5"], M.without_dosage) == ["錠5"]
    assert of(spark, ["トラマドール 37.5mg 第一三共", "1.5 g", "なし"], M.amount) == ["37.5mg", "1.5g", None]


def test_keys_without_forms(spark):
    got = of(spark, ["ファモチジンロ腔内崩壊錠", "ベルソムラ錠", "デエビゴ", "アスピリン腸溶錠", "何か 錠"], N.form_agnostic_key)
    assert got == ["ファモチジン", "スボレキサント", "レンボレキサント", "アスピリン", "何か"]


def test_similarity(spark):
    rows = [("アムロジピン", "アムロジピン"), ("アムロ", "アムロジピン"), ("ロゼレム", "ロゼルム"), ("", "a"), ("ABcd", "abce")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(M.similarity(F.col("a"), F.col("b"))).collect()]
    mixed = lambda a, b: 0.7 * difflib.SequenceMatcher(None, a, b).ratio() + 0.3 * len(set(a) & set(b)) / len(set(a) | set(b))
    assert got == pytest.approx([1.0, 0.9, mixed("ロゼレム", "ロゼルム"), 0.0, mixed("abcd", "abce")])


def test_normalizer_against_a_plain_version(spark):
    def plain(name):
        p = spark_prepared[name]
        if p in normalize.BOOK:
            return normalize.BOOK[p][0], 1.0, "exact"
        c = normalize.CANDIDATES.get(p)
        if c and c[0][1] >= 0.9 and c[0][0] in normalize.BOOK:
            return normalize.BOOK[c[0][0]][0], c[0][1], "candidate"
        best = (0.85, None)
        for k, (_, more) in normalize.BOOK.items():
            for x in (k, *more):
                a, b = p.lower(), x.lower()
                s = 0.0 if not a else 1.0 if a == b else 0.9 if a in b or b in a else 0.7 * difflib.SequenceMatcher(None, a, b).ratio() + 0.3 * len(set(a) & set(b)) / len(set(a) | set(b))
                if s > best[0]:
                    best = (s, k)
        return (normalize.BOOK[best[1]][0], round(best[0], 6), "fuzzy") if best[1] else (name, 0.0, "unknown")

    names = sorted({*POOL, "クラリスロマイシソ", "テラムロジン", "", "ノルバスク"})
    spark_prepared = dict(zip(names, of(spark, names, M.prepared)))
    got = {r.name: (r.normal, r.confidence, r.how) for r in normalize.normalize(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {n: plain(n) for n in names} and {x[2] for x in got.values()} >= {"exact", "fuzzy", "unknown"}


def test_names_in_blocks_lines_and_patterns(spark):
    block = "7オルケディア錠1mg（医療用） ツムラ芍薬甘草湯エキス顆粒 センノシド 12mg"
    got = of(spark, [block], T.names_before_forms)[0]
    assert got[0] == "オルケディア" and "芍薬甘草湯" in got and "センノシド" in got and len(got) == len(set(got))
    assert of(spark, ["アムロジピン錠 5mg テープの残り", "何もない", "ゲルと軟膏x"], T.cut_behind_forms) == [["アムロジピン錠"], ["何もない"], ["ゲル", "と軟膏"]]
    assert of(spark, ["前 アムロジピン錠 と ツムラ大建中湯エキス顆粒"], T.pattern_names)[0] == ["アムロジピン", "ツムラ大建中湯", "ツムラ大建中湯エキス"]
    assert of(spark, ["アスピリン腸溶 と リンゼス"], lambda c: T.dictionary_names(c, M.VOTED))[0] == ["アスピリン", "リナクロチド"]
    assert of(spark, ["リオナ錠 250mg\n他 3g", "他 3g\nなし\n 1錠"], T.expected_lines) == [["リオナ錠 250mg"], ["他 3g", "1錠"]]


def test_greedy_similarity_against_a_plain_version(spark, sf):
    items = baskets(spark, sf).select("rx_id", "pos", "name", "confidence")
    want = []
    by = {}
    for r in sorted(items.collect()):
        by.setdefault(r.rx_id, []).append(r)
    for rx, rows in by.items():
        kept = {}
        for r in rows:
            for k in kept:
                if dedupe.similarity(r.name.strip(), k) > 0.9:
                    if r.confidence > kept[k].confidence:
                        kept[k] = r
                    break
            else:
                kept[r.name.strip()] = r
        want += [(rx, r.pos, r.name, r.confidence, n) for n, r in enumerate(sorted(kept.values(), key=lambda r: -r.confidence))]
    assert sorted(map(tuple, dedupe.greedy_similarity(items, "rx_id", "name", "pos", "confidence").collect())) == sorted(want)


def test_post_processors_without_changed_doses(spark):
    df = spark.createDataFrame([("", "", "サクビトリル/バルサルタン", None, "2錠", "眠前", None, None), (None, None, None, None, None, None, None, None)], "raw string, brand string, generic string, strength string, dose string, freq string, dose_form string, final_classification string")
    a, b = postprocess.post_process(df, change_doses=False).collect()
    assert (a.dose, a.freq) == ("2錠", "就寝前") and b.generic is None and b.timing_norm is None
    assert postprocess.post_process(df).first().dose == "1錠"


def test_nearest_name(spark):
    asked, book = ["abcd", "xyz", "", "abcdefgh", "zzzzzzz"], ["abce", "abxd", "xy", "q", "abcdefghij"]
    got = {r.q: (r.distance, r.name) for r in lookup.nearest(spark.createDataFrame([(x,) for x in asked], "q string"), spark.createDataFrame([(x,) for x in book], "name string")).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    assert got == {q: min((edits(q, n), n) for n in book) for q in asked}


def test_rules_as_files_and_the_sample_dictionary(spark, tmp_path):
    rule = {"id": "a", "name": "n", "severity": "minor", "advice": "x", "requires": ["P"], "threshold": 2}
    (tmp_path / "r.json").write_text(json.dumps(rule) + "\n" + json.dumps({"id": "b"}))
    got = knowledge.read_rules(spark, str(tmp_path / "r.json"))
    assert [r.id for r in got.where(knowledge.valid_rule()).collect()] == ["a"]
    knowledge.write_rules(got, str(tmp_path / "out"))
    assert knowledge.read_rules(spark, str(tmp_path / "out")).count() == 2
    assert tables.dictionary_csv(spark, [str(tmp_path / "none")], sample=True).count() == 15
    (tmp_path / "store.json").write_text('{"misread": {"a": "b"}}')
    row = tables.store_json(spark, str(tmp_path / "store.json")).first()
    assert row.misread == {"a": "b"} and row.tag == {}
    (tmp_path / "t.txt").write_text("x\ny")
    assert tables.whole_text(spark, str(tmp_path / "t.txt")).first()[0] == "x\ny"


def test_buffers_over_several_batches(spark, tmp_path):
    kinds = ["purchase", "purchase", "click", "signup", "click", "purchase", "click"]
    rows = [(1, i, k, f"2024-01-{1 + 3 * i:02d} 00:00:00", 1.5) for i, k in enumerate(kinds)] + [(2, 50, "click", "2024-01-02 00:00:00", 0.0)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, t string, value double").selectExpr("user_id", "event_id", "event_type", "CAST(t AS timestamp) ts", "value")
    for i, part in enumerate(("ts < '2024-01-09'", "ts >= '2024-01-09'")):
        df.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = buffer.buffer_reads(stream, ttl_days=5).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(map(tuple, spark.read.schema(buffer.READS).parquet(f"{tmp_path}/out").collect()))
    assert got == [(1, 2, 1, 1.5), (1, 4, 0, 0.0), (1, 6, 1, 1.5), (2, 50, 0, 0.0)]
