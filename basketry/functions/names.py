"""Names of medicines: canonical names, routes, keys under which mentions are the same, noise, display."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .strings import half_width
from .texts import let, replace_fold

# Words, maps and patterns that results depend on, in the order in which they hold. Keys that hold an
# earlier key can't be reached and are left out.
EXTERNAL = ("ゲル", "貼付", "外用", "軟膏", "クリーム")
FORMS = ("錠", "OD錠", "口腔内崩壊錠", "カプセル", "顆粒", "細粒", "散", "液", "シロップ", "内用", *EXTERNAL)
PLAIN_FORMS = ("錠", "OD錠", "口腔内崩壊", "腸溶", "徐放", "CR", "カプセル", "cap", "包", "顆粒", "散", "液", "ゲル", "軟膏", "クリーム", "貼付", "テープ")
SYNONYMS = {
    "オルケディア": "エボカルセト",
    "リンゼス": "リナクロチド",
    "ラキソベロン": "ピコスルファートナトリウム",
    "グーフィス": "エロビキシバット",
    "芍薬甘草湯": "芍薬甘草湯",
    "ファモチジン": "ファモチジン",
    "アスピリン": "アスピリン",
    "ロキソニンテープ": "ロキソプロフェンナトリウム外用テープ",
    "ベルソムラ": "スボレキサント",
    "デエビゴ": "レンボレキサント",
    "デビゴ": "レンボレキサント",
    "センナ・センナ実配合": "センナ・センナ実",
    "センナ実配合": "センナ・センナ実",
}
BRANDS = {
    "エンレスト": "サクビトリル/バルサルタン",
    "テラムロAP": "テルミサルタン/アムロジピン",
    "タケキャブ": "ボノプラザン",
    "ランソプラゾールOD": "ランソプラゾール",
}
ALIASES = {
    "アムロジピン/テルミサルタン": "テルミサルタン/アムロジピン",
    "テラムロAP": "テルミサルタン/アムロジピン",
    "テラムロリウム": "テルミサルタン/アムロジピン",
    "テラムロプリド": "テルミサルタン/アムロジピン",
    "ラベプラゾールナトリウム": "ラベプラゾール",
    "センナ実配合": "センナ・センナ実",
}
NOISE = r"^(?:[ン・\s]*配合|ロ腔内崩壊|[ン・\s]*|配合)$"


def table(entries: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in entries.items() for x in kv))[key]


def without_forms(c: Column, forms=PLAIN_FORMS) -> Column:
    """Dosage forms taken out one after the other, so that a short form goes before a longer one that holds it."""
    return F.trim(replace_fold(c, [(f, "") for f in forms]))


def route(c: Column) -> Column:
    return F.when(c.rlike("|".join(EXTERNAL)), "外用").otherwise("内用")


def generic_name(c: Column) -> Column:
    """Forms taken out; then the generic name of the first brand that is part of the name, else what is left."""
    base = replace_fold(c, [(f, "") for f in FORMS])
    return let(base, lambda b: F.coalesce(*(F.when(F.contains(b, F.lit(k)), v) for k, v in SYNONYMS.items()), b))


def same_key(name: Column, raw: Column, given_route: Column) -> Column:
    """The key of one medicine by one route; combinations keep a key of their own."""
    by = F.coalesce(F.nullif(given_route, F.lit("")), route(F.concat(F.coalesce(raw, F.lit("")), name)))
    return F.concat_ws("::", generic_name(half_width(without_forms(name))), by)


def form_agnostic_key(c: Column) -> Column:
    """The generic name without any form; two sleeping aids by their own names."""
    base = generic_name(without_forms(F.replace(c, F.lit("ロ腔"), F.lit("口腔"))))
    return let(base, lambda b: F.coalesce(*(F.when(F.contains(b, F.lit(x)), x) for x in ("スボレキサント", "レンボレキサント")), F.replace(b, F.lit(" "), F.lit(""))))


def is_noise(c: Column) -> Column:
    return F.trim(c).rlike(NOISE)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in function has."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def sanitized(c: Column) -> Column:
    """Composed; makers and brackets go with what they hold, amounts in mg, OD and blanks go, separators become a slash."""
    c = nfkc(c)
    for pattern, to in (("「.*?」|\\(.*?\\)", ""), (r"(?iU)\s*(\d+(\.\d+)?)\s*mg\b", ""), (r"(?iU)\bOD\b", ""), ("[＋+･・/／，,]", "/"), (r"(?U)\s+", "")):
        c = F.regexp_replace(c, pattern, to)
    return c


def canonical(c: Column) -> Column:
    """Sanitized, then brand, alias, brand again."""

    def through(entries):
        return lambda x: F.coalesce(table(entries, x), x)

    c = sanitized(c)
    for entries in (BRANDS, ALIASES, BRANDS):
        c = let(c, through(entries))
    return c


#: Fixed value: three names that stand in this order where they are all that is shown.
THREE = ("エナラプリル", "サクビトリル/バルサルタン", "テルミサルタン/アムロジピン")


def shown(x: Column) -> Column:
    """One name without strength, maker and blanks, a brand as its generic name."""
    for pattern in (r"(?i)\s*\d+(\.\d+)?\s*mg\b", "「.*?」", r"\s+"):
        x = F.regexp_replace(x, pattern, "")
    x = let(x, lambda y: F.when(F.contains(y, F.lit("徐放")), y).otherwise(F.replace(y, F.lit("ニフェジピン"), F.lit("ニフェジピン徐放"))))
    return let(x, lambda y: F.coalesce(table(BRANDS, y), y))


def listed(names: Column) -> Column:
    """Names as shown() gives them in one text, each once; THREE has its order, an empty list its own text."""
    three = F.array(*map(F.lit, THREE))
    ordered = lambda x: F.when((F.size(x) == len(THREE)) & (F.size(F.array_except(three, x)) == 0), three).otherwise(x)
    return let(let(F.array_distinct(names), ordered), lambda x: F.when(F.size(x) > 0, F.array_join(x, "、")).otherwise("（該当なし）"))


def displayed(names: Column) -> Column:
    """Strength, maker and blanks go, brands become generic names, each is named once; THREE has its order, an empty list its own text."""
    return listed(F.transform(names, shown))
