"""Names by a dictionary: as they are, by curated candidates, by similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import medicines as M, steps as S

# Entries (normal name, other names), curated candidates, limits.
BOOK = {
    "クラリスロマイシン": ("クラリスロマイシン", ("クラリス", "クラリシッド", "クラリシッド錠", "クラリスロマイシン錠")),
    "ベルソムラ": ("スボレキサント", ("スボレキサント", "ベルソムラ錠", "ベルソムラOD錠")),
    "デビゴ": ("レンボレキサント", ("レンボレキサント", "デビゴ錠", "デビゴOD錠")),
    "ロゼレム": ("ラメルテオン", ("ラメルテオン", "ロゼレム錠")),
    "フルボキサミン": ("フルボキサミン", ("フルボキサミン", "ルボックス", "ルボックス錠")),
    "アムロジピン": ("アムロジピン", ("アムロジピン", "ノルバスク", "ノルバスク錠")),
    "エソメプラゾール": ("エソメプラゾール", ("エソメプラゾール", "ネキシウム", "ネキシウム錠", "ネキシウムOD錠")),
    "L-アスパラギン酸カルシウム": ("L-アスパラギン酸カルシウム", ("アスパラ-CA", "アスパラーCA", "アスパラCA", "アスパラ-CA錠200", "アスパラーCA錠200", "アスパラCA錠200", "L-アスパラギン酸カルシウム錠200")),
    "タダラフィル": ("タダラフィル", ("タダラフィル", "シアリス", "シアリス錠")),
    "ニコランジル": ("ニコランジル", ("ニコランジル", "シグマート", "シグマート錠")),
    "エンレスト": ("サクビトリル/バルサルタン", ("サクビトリル/バルサルタン", "エンレスト錠")),
    "テラムロAP": ("テルミサルタン/アムロジピン", ("テルミサルタン/アムロジピン", "テラムロAP錠", "テラムロ", "テラムロジン", "テラムロプリド", "テラムロリウム")),
    "タケキャブ": ("ボノプラザン", ("ボノプラザン", "タケキャブ錠")),
    "ランソプラゾール": ("ランソプラゾール", ("ランソプラゾール", "タケプロン", "タケプロン錠", "タケプロンOD錠")),
    "エナラプリル": ("エナラプリル", ("エナラプリル", "レニベース", "レニベース錠")),
    "アトルバスタチン": ("アトルバスタチン", ("アトルバスタチン", "リピトール", "リピトール錠")),
    "クロピドグレル": ("クロピドグレル", ("クロピドグレル", "プラビックス", "プラビックス錠")),
    "ビソプロロール": ("ビソプロロール", ("ビソプロロール", "メインテート", "メインテート錠")),
    "フェロベンゾン": ("フェロベンゾン", ("フェロベンゾン", "フェロベンゾン散")),
    "ロキソニン": ("ロキソプロフェン", ("ロキソプロフェン", "ロキソニン", "ロキソニン錠", "ロキソニンテープ")),
    "アスパラCA": ("アスパラギン酸カリウム・マグネシウム", ("アスパラギン酸カリウム・マグネシウム", "アスパラCA", "アスパラCA錠")),
}
CANDIDATES = {
    "テラムロジン": (("テラムロAP", 0.95), ("テルミサルタン", 0.7), ("アムロジピン", 0.6)),
    "テラムロプリド": (("テラムロAP", 0.95), ("テルミサルタン", 0.7), ("アムロジピン", 0.6)),
    "テラムロリウム": (("テラムロAP", 0.95), ("テルミサルタン", 0.7), ("アムロジピン", 0.6)),
    "ラベプラゾール": (("ボノプラザン", 0.9), ("ランソプラゾール", 0.8), ("オメプラゾール", 0.7)),
    "ラベプラゾールナトリウム": (("ボノプラザン", 0.95), ("ランソプラゾール", 0.8)),
}
SURE, CURATED = 0.85, 0.9


def normalize(names: DataFrame) -> DataFrame:
    """names (name, distinct) -> name, normal, confidence, how, candidates (the best three, joined).

    The prepared name is looked up as it is; then by its best curated candidate, if that is sure and in the dictionary;
    then by similarity to entries and their other names, above .85, the surest first and of equal ones the dictionary's
    first; else the name itself with confidence 0. Only names that nothing else settles meet the dictionary's entries,
    each once, and the dictionary is a literal of some tens of rows.
    """
    prepared = names.withColumn("p", M.prepared(F.col("name")))
    normal = {k: v[0] for k, v in BOOK.items()}
    sure = {k: c[0] for k, c in CANDIDATES.items() if c[0][1] >= CURATED and c[0][0] in BOOK}
    best = F.coalesce(S.mapped(F.col("p"), {k: c[0] for k, c in sure.items()}), F.lit(None).cast("string")) if sure else F.lit(None).cast("string")
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("key"), F.lit(x).alias("said")) for i, (k, (_, more)) in enumerate(BOOK.items()) for x in (k, *more)))
    rest = prepared.where(S.mapped(F.col("p"), normal).isNull() & best.isNull() & (F.col("p") != "")).select("name", "p", F.inline(keys))
    near = rest.withColumn("s", M.similarity(F.col("p"), F.col("said"))).groupBy("name", "i", "key").agg(F.max("s").alias("s")).where(F.col("s") > SURE)
    near = near.groupBy("name").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "i", "key"))).alias("n"))
    out = prepared.join(near, "name", "left")
    first = F.get("n", 0)
    how = F.when(S.mapped(F.col("p"), normal).isNotNull(), "exact").when(best.isNotNull(), "candidate").when(F.col("n").isNotNull(), "fuzzy").otherwise("unknown")
    score = S.mapped(F.col("p"), {k: str(c[1]) for k, c in sure.items()}).cast("double") if sure else F.lit(None).cast("double")
    conf = F.when(how == "exact", 1.0).when(how == "candidate", score).when(how == "fuzzy", F.round(-first.s, 6)).otherwise(0.0)
    found = F.coalesce(S.mapped(F.col("p"), normal), S.mapped(best, normal), S.mapped(first.key, normal), "name")
    return out.select("name", found.alias("normal"), conf.alias("confidence"), how.alias("how"), F.coalesce(F.array_join(F.transform(F.slice("n", 1, 3), lambda x: x.key), "|"), F.lit("")).alias("candidates"))
