"""Sources: basket tables from Parquet, delimited dictionaries, JSON stores, whole-text files, event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

DICTIONARY = "drug_name string, generic_name string, category string, interactions string"
# The built-in sample, used where no dictionary file is found.
SAMPLE = [
    ("アスピリン", "アセチルサリチル酸", "解熱鎮痛薬", "ワルファリン,抗凝固薬"),
    ("ワルファリン", "ワルファリンカリウム", "抗凝固薬", "アスピリン,NSAIDs"),
    ("ジゴキシン", "ジゴキシン", "強心薬", "アミオダロン,ジゴキシン"),
    ("アミオダロン", "アミオダロン塩酸塩", "抗不整脈薬", "ジゴキシン,アミオダロン"),
    ("シンバスタチン", "シンバスタチン", "脂質異常症治療薬", "アミオダロン,シンバスタチン"),
    ("アトルバスタチン", "アトルバスタチンカルシウム", "脂質異常症治療薬", "シンバスタチン,アミオダロン"),
    ("メトトレキサート", "メトトレキサート", "抗リウマチ薬", "メトトレキサート,葉酸"),
    ("プレドニゾロン", "プレドニゾロン", "副腎皮質ホルモン", "プレドニゾロン,インスリン"),
    ("インスリン", "インスリン", "糖尿病治療薬", "インスリン,メトホルミン"),
    ("メトホルミン", "メトホルミン塩酸塩", "糖尿病治療薬", "メトホルミン,インスリン"),
    ("イブプロフェン", "イブプロフェン", "解熱鎮痛薬", "アスピリン,イブプロフェン"),
    ("ロキソプロフェン", "ロキソプロフェンナトリウム", "解熱鎮痛薬", "アスピリン,ロキソプロフェン"),
    ("ダビガトラン", "ダビガトランエテキシラート", "抗凝固薬", "ワルファリン,ダビガトラン"),
    ("リバーロキサバン", "リバーロキサバン", "抗凝固薬", "ワルファリン,リバーロキサバン"),
    ("プラバスタチン", "プラバスタチンナトリウム", "脂質異常症治療薬", "シンバスタチン,プラバスタチン"),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of baskets: rx_id, pos (from 0), name, brand, cls, confidence, qty, tax, part. Order is data: ties are broken by all columns that tell rows apart."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = read(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(w).cast("long") - 1)
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("rx_id"), "pos", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("cls"),
        F.round(1 - 5 * F.col("l_discount"), 2).alias("confidence"), F.col("l_quantity").alias("qty"), F.col("l_tax").alias("tax"), F.col("p_partkey").alias("part"),
    )


MENTIONS_SQL = """m AS (SELECT l_orderkey AS rx_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS pos,
 p_name AS name, p_brand AS brand, p_type AS cls, round(1 - 5 * l_discount, 2) AS confidence, l_quantity AS qty, l_tax AS tax, p_partkey AS part FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def listed(c) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def sample_dictionary(spark: SparkSession) -> DataFrame:
    """The built-in sample: ord, drug_name, generic_name, category, interactions (a list)."""
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), *(F.lit(v).alias(n) for n, v in zip(("drug_name", "generic_name", "category", "interactions"), r))) for i, r in enumerate(SAMPLE)))
    return spark.range(1).select(F.inline(rows)).withColumn("interactions", listed("interactions"))


def processed_dictionary(raw: DataFrame) -> DataFrame:
    """Columns named by their places, texts trimmed; rows with a null go."""
    return raw.toDF(*(c.split()[0] for c in DICTIONARY.split(", "))).dropna().select(*(F.trim(c.split()[0]).alias(c.split()[0]) for c in DICTIONARY.split(", ")))


def dictionary_csv(spark: SparkSession, paths: list[str], sample: bool = False) -> DataFrame:
    """The first path that can be read, with a fixed schema; interactions become a list. If there is none: the built-in sample, or an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            raw = spark.read.csv(path, header=True, schema=DICTIONARY)
            return raw.withColumn("interactions", listed("interactions"))
    if sample:
        return sample_dictionary(spark).drop("ord")
    raise FileNotFoundError(", ".join(paths))


def store_json(spark: SparkSession, path: str) -> DataFrame:
    """A learned store of four maps. What a document lacks, and all of a broken one, are empty maps."""
    maps = {"misread": "map<string,string>", "synonym": "map<string,string>", "atc": "map<string,array<string>>", "tag": "map<string,array<string>>"}
    found = spark.read.json(path, schema=", ".join(f"{k} {v}" for k, v in maps.items()), multiLine=True, mode="PERMISSIVE")
    return found.select(*(F.coalesce(k, F.create_map().cast(v)).alias(k) for k, v in maps.items()))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def audit_lines(spark: SparkSession, path: str, drugs: str = "array<struct<generic string>>") -> DataFrame:
    """Lines of an audit log: kind (record or error), session_id, drugs, has_interactions; other lines go. A record that is no JSON has nulls."""
    schema = f"session_id string, timestamp string, drugs {drugs}, interactions struct<has_interactions boolean>"
    line = F.col("value")
    kind = F.when(F.contains(line, F.lit("DRUG_PROCESSING:")), "record").when(F.contains(line, F.lit("ERROR:")), "error")
    body = F.from_json(F.regexp_extract(line, r"DRUG_PROCESSING:\s*(\{.*\})", 1), schema)
    rows = spark.read.text(path).select(kind.alias("kind"), body.alias("b")).where("kind IS NOT NULL")
    return rows.select("kind", "b.session_id", "b.timestamp", "b.drugs", F.coalesce("b.interactions.has_interactions", F.lit(False)).alias("has_interactions"))
