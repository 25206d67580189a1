"""What comes out of extraction, checked and put right: records, candidates, names that are mixed up, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classes as C, medicines as M, steps as S, texts as T
from . import normalize

SURE, ACCEPTED, ASSUMED = 0.8, 0.8, 0.8
UNKNOWN, COMBINED = "不明", "配合錠"
# Fixed values, in the order in which they hold: brands in a name and their generic names; marks of names that are mixed up.
GENERIC_OF = {"オルケディア": "エボカルセト", "リンゼス": "リナクロチド", "ラキソベロン": "ピコスルファートナトリウム", "グーフィス": "エロビキシバット", "芍薬甘草湯": "芍薬甘草湯"}
MIXED_UP = [("アスパラ.?C[AＡ]", "アスパラ-CA"), ("アスパラ.?Ｋ|アスパラ.?K", "アスパラK"), ("ロキソニンテープ", "ロキソニンテープ"), ("デエビゴ|デビゴ", "デエビゴ")]


def generic_name(c: Column) -> Column:
    return F.coalesce(S.first_contained(c, GENERIC_OF), c)


def _said(c: Column) -> Column:
    """Trimmed; null and empty are null."""
    return F.nullif(F.trim(c), F.lit(""))


def validated_records(rows: DataFrame) -> DataFrame:
    """rows (with raw, generic, brand, strength, dose, freq, days, confidence, class_hint; all texts but confidence) -> those with a generic name, trimmed and cast.

    Generic names are those of their brands; days are the first number; a missing confidence is 0; brand and class_hint
    may be null, other texts are empty then. Other columns stay as they are.
    """
    texts = {c: F.coalesce(F.trim(c), F.lit("")) for c in ("raw", "strength", "dose", "freq")}
    maybe = {c: _said(F.col(c)) for c in ("brand", "class_hint")}
    own = {"generic": generic_name(F.trim("generic")), "days": T.first_integer(F.col("days").cast("string")), "confidence": F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))}
    return rows.where(_said(F.col("generic")).isNotNull()).withColumns({**texts, **maybe, **own})


def completed_records(rows: DataFrame) -> DataFrame:
    """rows (with generic, brand, raw, dose_form, quantity, size, strength) -> those with a name; tapes get quantity and size, combined names a strength, where they have none."""
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    tape = (F.coalesce(F.col("dose_form"), F.lit("")) == "外用貼付") | F.contains(F.coalesce("raw", F.lit("")), F.lit("テープ"))
    bare = tape & none("quantity") & none("size")
    both = F.contains(F.coalesce("generic", F.lit("")), F.lit("/")) & none("strength")
    kept = rows.where(~(none("generic") & none("brand")))
    return kept.withColumns({"quantity": F.when(bare, UNKNOWN).otherwise(F.col("quantity")), "size": F.when(bare, UNKNOWN).otherwise(F.col("size")), "strength": F.when(both, COMBINED).otherwise(F.col("strength"))})


def validated_candidates(rows: DataFrame, found: Column) -> DataFrame:
    """rows (with text, confidence, maker) -> the valid and sure ones whose name exists, or its correction with original and reason.

    found: whether a source knows the name. A name that doesn't exist and has no correction goes; one that exists has null
    original and reason.
    """
    judged = F.explode(F.array(C.existence(F.col("text"), F.col("maker"), found)))  # worked out once, however often it is asked below
    kept = rows.where(M.some_name(F.col("text")) & (F.col("confidence") >= SURE)).select("*", judged.alias("existence"))
    kept = kept.where("existence.exists OR existence.corrected IS NOT NULL")
    fixed = ~F.col("existence.exists")
    out = kept.withColumns({"original": F.when(fixed, F.col("text")), "reason": F.when(fixed, F.col("existence.reason")), "text": F.when(fixed, F.col("existence.corrected")).otherwise(F.col("text"))})
    return out.drop("existence")


def told_apart(name: Column, brand: Column, raw: Column) -> Column:
    """The name that brand and raw text stand for where names are mixed up, else the name."""
    both = F.concat(F.coalesce(brand, F.lit("")), F.lit(" "), F.coalesce(raw, F.lit("")))
    out = name
    for pattern, right in reversed(MIXED_UP):
        out = F.when(both.rlike(pattern), right).otherwise(out)
    return out


def normalized_items(rows: DataFrame) -> DataFrame:
    """rows (with generic, brand, raw, confidence) -> the same with generic and confidence put right, normalization_applied, original_name.

    The name is told apart by brand and raw text, its misreadings are mended, and it is looked up; what is found surely is
    taken, with the larger confidence (a missing one is ASSUMED). Each different name is looked up once. Rows without any
    name stay as they are, with null normalization_applied.
    """
    name = F.coalesce(F.nullif("generic", F.lit("")), F.nullif("brand", F.lit("")))
    asked = rows.withColumn("original_name", name).withColumn("asked", F.when(name.isNotNull(), M.alias_fixed(told_apart(name, F.col("brand"), F.col("raw")))))
    known = normalize.normalize(asked.select(F.col("asked").alias("name")).where("name IS NOT NULL").distinct()).select(F.col("name").alias("asked"), "normal", F.col("confidence").alias("sure"))
    out = asked.join(known, "asked", "left")
    took = F.col("sure") > ACCEPTED
    better = F.greatest(F.coalesce(F.col("confidence"), F.lit(ASSUMED)), F.col("sure"))
    return out.withColumns({
        "generic": F.when(took, F.col("normal")).otherwise(F.col("generic")), "confidence": F.when(took, better).otherwise(F.col("confidence")),
        "normalization_applied": took, "original_name": F.when(took, F.col("original_name")),
    }).drop("asked", "normal", "sure")


def suggestions(name: Column) -> Column:
    """What a name may be meant for, surest first: an array of corrected, reason, confidence; a known misreading before candidates of equal confidence."""
    row = lambda right, reason, sure, at: F.struct((-F.lit(sure)).alias("less"), F.lit(at).alias("at"), F.lit(right).alias("corrected"), F.lit(reason).alias("reason"))
    rows = [F.when(name == k, row(v, "known_bad", 0.95, 0)) for k, v in C.KNOWN_BAD.items()]
    rows += [F.when(name == k, row(right, "candidate", sure, i)) for k, found in normalize.CANDIDATES.items() for i, (right, sure) in enumerate(found, 1)]
    return F.transform(F.array_sort(F.array_compact(F.array(*rows))), lambda x: F.struct(x.corrected.alias("corrected"), x.reason.alias("reason"), (-x.less).alias("confidence")))


#: Categories that say too little.
COARSE = (UNKNOWN, "解熱鎮痛薬", "下剤")


def enriched_dictionary(book: DataFrame, found: DataFrame) -> DataFrame:
    """book (drug_name, generic_name, category and others) with what found (drug_name, distinct, generic_name, category) knows.

    Only rows of a coarse category are changed: the category is that found, and a generic name that is unknown too. Rows
    that nothing was found for, and those of a null category, stay as they are.
    """
    more = found.select("drug_name", F.col("generic_name").alias("found_name"), F.col("category").alias("found_category"), F.lit(True).alias("hit"))
    fill = F.coalesce(F.col("category").isin(*COARSE), F.lit(False)) & F.col("hit").isNotNull()
    out = book.join(more, "drug_name", "left").withColumn("fill", fill)
    out = out.withColumns({"generic_name": F.when(F.col("fill") & (F.col("generic_name") == UNKNOWN), F.col("found_name")).otherwise(F.col("generic_name")), "category": F.when(F.col("fill"), F.col("found_category")).otherwise(F.col("category"))})
    return out.select(*book.columns)
