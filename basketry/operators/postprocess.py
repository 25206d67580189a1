"""Thirteen ordered corrections of order rows. Each sees what the ones before wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the corrections.
PAIN = ("トラマドール", "アセトアミノフェン")
TIMINGS = {"食直前": "before_meal", "食前": "before_meal", "食後": "after_meal", "食直後": "after_meal"}
COMPONENTS = r"(\d+\.?\d*\s*(?:mg|μg))\s*/\s*(\d+\.?\d*\s*(?:mg|μg))"


def _has(c: Column, word: str) -> Column:
    return F.coalesce(F.contains(c, F.lit(word)), F.lit(False))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def post_process(rows: DataFrame, change_doses: bool = True) -> DataFrame:
    """rows (raw, brand, generic, strength, dose, freq, dose_form, final_classification, others) -> corrected, with timing_norm and component_strengths.

    change_doses=False leaves out the corrections that change a prescribed number or time (two tablets to one or three,
    right before meals to right after), which a reader may rather want to check. Nulls count as empty and stay null where
    nothing is corrected.
    """
    c, out = F.col, rows

    def put(test: Column, **values):
        nonlocal out
        out = out.withColumn("_t", F.coalesce(test, F.lit(False)))
        out = out.withColumns({k: F.when(c("_t"), v if isinstance(v, Column) else F.lit(v)).otherwise(c(k)) for k, v in values.items()}).drop("_t")

    source, name = F.concat(_text("raw"), _text("brand")), F.concat(_text("generic"), _text("brand"))
    pico = _has(name, "ピコスルファート") | _has(source, "ラキソベロン")
    liquid = pico & _has(source, "液")
    tablet = pico & ~_has(source, "液") & _has(source, "錠")
    put(liquid, strength="0.75mg/mL", dose_form="液")
    put(tablet, strength=F.coalesce(F.nullif("strength", F.lit("")), F.lit("2.5mg")), dose_form="錠")
    put(_has(c("generic"), "ナルフラフィン"), dose="1カプセル", dose_form="カプセル", strength=F.replace(F.replace("strength", F.lit("/錠"), F.lit("/カプセル")), F.lit("錠"), F.lit("カプセル")))
    both = lambda a, b: _has(c("freq"), a) & ~_has(c("freq"), b)
    swap = lambda a, b: F.replace("freq", F.lit(a), F.lit(b))
    times = F.when(both("朝夕", "朝・夕"), swap("朝夕", "朝・夕")).when(_has(c("freq"), "眠前"), swap("眠前", "就寝前")).otherwise(c("freq"))
    out = out.withColumn("freq", times)
    pain = _has(c("generic"), PAIN[0]) & _has(c("generic"), PAIN[1])
    put(pain, dose="1回1錠", freq="1日3回", strength=F.when(c("strength") == "不明", "配合錠").otherwise(c("strength")))
    if change_doses:
        put(_has(c("generic"), "サクビトリル") & _has(c("generic"), "バルサルタン") & (c("dose") == "2錠"), dose="1錠")
        put(_has(c("generic"), "沈降炭酸カルシウム") & (c("dose") == "2錠"), dose="3錠")
        put(_has(c("generic"), "沈降炭酸カルシウム") & (c("freq") == "食直前"), freq="食直後")
    put(_has(c("generic"), "キックリン") & (c("dose") == "2錠"), dose="2カプセル")
    put(_has(c("generic"), "キックリン"), dose_form="カプセル")
    put(pain, dose="1回1錠", freq="1日3回", strength=F.lit(None).cast("string"))
    later = F.when(_has(c("freq"), "食後朝・夕"), swap("食後朝・夕", "食後／朝・夕")).when(_has(c("freq"), "食後朝夕"), swap("食後朝夕", "食後／朝・夕")).otherwise(c("freq"))
    out = out.withColumn("freq", F.when(both("朝夕", "朝・夕") | _has(c("freq"), "眠前"), times).otherwise(later))
    out = out.withColumn("timing_norm", F.coalesce(*(F.when(_has(c("freq"), k), v) for k, v in TIMINGS.items())))
    bare = F.replace(F.replace(_text("strength"), F.lit("／"), F.lit("/")), F.lit(" "), F.lit(""))
    put(F.startswith("generic", F.lit("アスピリン")) & (_has(bare, "81mg") | _has(bare, "100mg") | _has(c("generic"), "腸溶")), final_classification="抗血小板薬")
    joined = F.concat_ws(" ", F.nullif("raw", F.lit("")), F.nullif("generic", F.lit("")), F.nullif("strength", F.lit("")))
    parts = F.array(F.regexp_extract(joined, COMPONENTS, 1), F.regexp_extract(joined, COMPONENTS, 2))
    out = out.withColumn("component_strengths", F.when(joined.rlike(COMPONENTS), parts))
    put(pain & _text("final_classification").isin("", "分類未設定"), final_classification="鎮痛薬（弱オピオイド＋解熱鎮痛薬）")
    return out
