"""Audit records: what of items and findings is kept, written by date and read back whatever columns a day's files have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.labels import severity_code

# The fields of an item, what each is called in its source, its kind and default.
ITEM_FIELDS = [
    ("generic", "generic", "string", ""), ("brand", "brand", "string", ""), ("raw", "raw", "string", ""), ("kegg_id", "kegg_id", "string", ""), ("atc_codes", "atc", "array<string>", None), ("class_jp", "class_jp", "string", ""),
    ("confidence", "confidence", "double", 0.0), ("interaction_tags", "interaction_tags", "array<string>", None), ("route", "route", "string", ""), ("strength", "strength", "string", ""), ("dose", "dose", "string", ""), ("frequency", "frequency", "string", ""),
]
HIT_FIELDS = [("id", "id", "string", ""), ("name", "name", "string", ""), ("severity", "severity", "string", ""), ("matched_drugs", "matched_drugs", "array<string>", None)]


def _kept(x: Column, has: set[str], fields) -> Column:
    def one(name, source, kind, default):
        empty = F.array().cast(kind) if default is None else F.lit(default).cast(kind)
        return (F.coalesce(x[source].cast(kind), empty) if source in has else empty).alias(name)

    return F.struct(*(one(*f) for f in fields))


def _fields(df: DataFrame, column: str) -> set[str]:
    kind = df.schema[column].dataType
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType)):
        raise TypeError(f"{column} must be an array of structs")
    return set(kind.elementType.fieldNames())


def audit_records(rows: DataFrame) -> DataFrame:
    """rows (session_id, ts, items, major, moderate) -> session_id, ts, drugs, interactions: what the audit keeps.

    items, major and moderate are arrays of structs. A field that their structs lack, or that is null, gets its default;
    fields that the audit doesn't know are left out. A null array is an empty one. major hits come before moderate ones.
    """
    item = lambda x: _kept(x, _fields(rows, "items"), ITEM_FIELDS)
    hits = lambda c: F.transform(F.coalesce(c, F.array().cast(rows.schema[c].dataType)), lambda x: _kept(x, _fields(rows, c), HIT_FIELDS))
    drugs = F.transform(F.coalesce("items", F.array().cast(rows.schema["items"].dataType)), item)
    count = lambda c: F.size(F.coalesce(c, F.array().cast(rows.schema[c].dataType)))
    found = F.struct((count("major") + count("moderate") > 0).alias("has_interactions"), count("major").alias("major_count"), count("moderate").alias("moderate_count"), F.concat(hits("major"), hits("moderate")).alias("rule_hits"))
    return rows.select("session_id", "ts", drugs.alias("drugs"), found.alias("interactions"))


def audit_trace(findings: DataFrame, items: DataFrame) -> DataFrame:
    """findings (rx_id, title, severity, targets, action), items (rx_id, name) -> rx_id, matched_drugs, matched_rules, total_interactions, major_interactions, moderate_interactions, a row for each basket with items.

    Severities are the audit's codes; minor findings count as moderate. Names are sorted and distinct.
    """
    rule = F.struct("title", severity_code(F.col("severity")).alias("severity"), "targets", "action")
    rules = findings.select("rx_id", rule.alias("r")).groupBy("rx_id").agg(F.array_sort(F.collect_list("r")).alias("matched_rules"), F.count_if(F.col("r.severity") == "major").cast("int").alias("major"), F.count_if(F.col("r.severity").isin("moderate", "minor")).cast("int").alias("moderate"))
    drugs = items.groupBy("rx_id").agg(F.array_sort(F.collect_set("name")).alias("matched_drugs"))
    out = drugs.join(rules, "rx_id", "left")
    return out.select("rx_id", "matched_drugs", "matched_rules", F.greatest(F.size(F.coalesce("matched_rules", F.array().cast(out.schema["matched_rules"].dataType))), F.lit(0)).alias("total_interactions"), F.coalesce("major", F.lit(0)).alias("major_interactions"), F.coalesce("moderate", F.lit(0)).alias("moderate_interactions"))


def write_audit(records: DataFrame, path: str) -> None:
    """Append records as Parquet in a folder for each date. Later records may have more columns, and more fields in their structs."""
    records.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """All records, with the columns and nested fields that any of them has; null where a record has none."""
    return spark.read.option("mergeSchema", "true").parquet(path)
