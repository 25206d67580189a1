"""Medicine names in the places of parts, so that queries on names run over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.steps import quoted, values_sql
from ..operators.lookup import each_once
from ..sources.tables import mentions, read

POOL = [
    "アムロジピン錠5mg", "タダラフィル", "ニコランジル", "サクビトリル/バルサルタン", "エナラプリル錠2.5mg（トーワ）", "ボノプラザン", "タケキャブ錠20mg", "ランソプラゾールOD錠15mg",
    "クラリスロマイシン", "ベルソムラ錠15mg", "デエビゴ", "ロゼレム", "フルボキサミン", "ニフェジピン徐放錠20mg", "エソメプラゾル錠", "センノシド", "センナ・センナ実配合", "ラキソベロン液",
    "リンゼス", "グーフィス", "ツムラ芍薬甘草湯エキス顆粒", "沈降炭酸カルシウム", "オルケディア錠1mg", "キックリン", "テラムロリウム", "テラムロAP", "ラベプラゾールナトリウム", "アスピリン腸溶錠100mg",
    "ファモチジン口腔内崩壊錠", "ジクロフェナクナトリウムゲル", "ロキソニンテープ", "アスパラＣＡ錠２００", "ワルファリン", "シンバスタチン", "アミオダロン", "あすぴりん", "クラビット点眼液0.5%",
    "12 × 3", "患者", "保存 午後", "AM", "トラマドール・アセトアミノフェン", "テルミサルタン", "リオナ錠mg", "炭酸ランタンロ腔内崩壊錠mg", "フルラゼパム錠", "メトホルミン", "ジゴキシン",
]
MAKER_POOL = ["トーワ", "サワイ製薬", "TAKEDA", "ノバルティス", "", "SANDOZ 2.5 mg", "東和 10ml", "なし"]


def picked(pool: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), (number % len(pool)).cast("int") + 1)


def names(spark, sf) -> DataFrame:
    """k, name, maker: a row for each part."""
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(k.alias("k"), picked(POOL, k).alias("name"), picked(MAKER_POOL, F.floor(k / 7)).alias("maker"))


def baskets(spark, sf) -> DataFrame:
    """mentions, with medicines as their names."""
    return mentions(spark, sf).withColumn("name", picked(POOL, F.col("part")))


def per_name(rows: DataFrame, worked_out, by: tuple[str, ...] = ("name",)) -> DataFrame:
    """rows with the columns that worked_out gives for their different names: what depends on a name alone is done once for each.

    Names come from short lists, so their table goes to all tasks, and rows aren't shuffled by a few names.
    """
    return rows.join(F.broadcast(each_once(rows, list(by), worked_out)), list(by))


POOLS_SQL = values_sql("pool", "i, name", list(enumerate(POOL))) + ", " + values_sql("makers", "i, maker", list(enumerate(MAKER_POOL)))
NAMES_SQL = f"{POOLS_SQL}, nm AS (SELECT p_partkey AS k, name, maker FROM part JOIN pool ON pool.i = p_partkey % {len(POOL)} JOIN makers ON makers.i = (p_partkey // 7) % {len(MAKER_POOL)})"
BASKETS_SQL = f", {POOLS_SQL}, b AS (SELECT m.* REPLACE (pool.name AS name) FROM m JOIN pool ON pool.i = part % {len(POOL)})"


def listed_sql(words) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"
