"""Cleaning, correction, validity, makers and display of medicine names, as column expressions. Null names give nulls."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from . import steps as S
from .strings import FULL, HALF, char_overlap_ratio
from .texts import char_jaccard, let, replace_fold

# Cleaning steps, maps, words and patterns that results depend on, in the order in which they hold.
AMOUNT = r"\p{Nd}+\.?\p{Nd}*[\s　]*(mg|g|ml|μg|mcg)"
PLAIN_STEPS = [
    S.TRIM,
    *S.replaced(("錠", "カプセル", "散剤", "液剤", "注射剤", "軟膏", "クリーム", "貼付剤", "吸入剤", "点眼剤", "点鼻剤")),
    ("regex", AMOUNT, ""),
    ("regex", r"\p{Nd}+", ""),
    ("regex", "[（(].*?[）)]", ""),
    ("regex", r"[^\p{L}\p{N}_\s　]", ""),
    S.TRIM,
]
MISREAD_STEPS = [
    S.TRIM,
    *S.replaced(("錠", "カプセル", "散剤", "液剤", "注射剤", "OD錠", "口腔内崩壊錠", "徐放錠", "塩酸塩錠")),
    ("regex", r"[\s　]*" + AMOUNT, ""),
    ("regex", r"[\s　]+", ""),
    ("replace", "口", "ロ"),
    ("replace", "ソ", "ン"),
    ("replace", "シ", "ン"),
    ("replace", "ツ", "ッ"),
    ("replace", "タ", "ク"),
    ("replace", "ナ", "メ"),
]
DOSAGE_STEPS = [
    *(("regex", word + r"\p{Nd}*", "") for word in ("錠", "カプセル", "散", "液", "注射用", "軟膏", "点眼", "坐剤", "内用液", "外用液", "顆粒", "シロップ")),
    *(("regex", r"\p{Nd}+" + unit, "") for unit in ("mg", "g", "ml", "L", "%", "単位")),
    S.TRIM,
]
ENDING_STEPS = [
    S.TRIM,
    *(("regex", word + "$", "") for word in ("錠", "カプセル", "散", "液", "テープ")),
    *(("regex", r"\p{Nd}+" + unit, "") for unit in ("mg", "g", "ml", "μg")),
    ("regex", "[()（）]", ""),
    S.TRIM,
]
VOTED_STEPS = [
    *S.replaced(("錠", "カプセル", "口腔内崩壊錠", "顆粒", "ゲル", "散", "液", "テープ", "軟膏", "クリーム")),
    ("regex", AMOUNT, ""),
    ("regex", r"\p{Nd}+%", ""),
    ("regex", "[()（）【】]", ""),
]
SYMBOL_STEPS = [S.TRIM, ("regex", r"""[.．・,，、。()（）【】［］\[\]{}｛｝<>《》"'\-―ー=+*/\\]""", ""), S.TRIM]
HIRAGANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをんがぎぐげござじずぜぞだぢづでどばびぶべぼぱぴぷぺぽゃゅょっ"
KATAKANA = "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲンガギグゲゴザジズゼゾダヂヅデドバビブベボパピプペポャュョッ"
KATAKANA_STEPS = [("translate", FULL, HALF), ("translate", HIRAGANA, KATAKANA), ("regex", r"""[\s　\-・,，、.。()（）【】［］\[\]{}｛｝<>《》"'―ー=+*/\\]""", "")]
ALIASES = {
    "ロ腔": "口腔",
    "口腔内崩壊錠": "口腔内崩壊",
    "OD錠": "口腔内崩壊",
    "cap": "カプセル",
    "錠剤": "錠",
    "カプセル剤": "カプセル",
    "顆粒剤": "顆粒",
    "散剤": "散",
    "液剤": "液",
    "ゲル剤": "ゲル",
    "軟膏剤": "軟膏",
    "クリーム剤": "クリーム",
    "貼付剤": "貼付",
    "テープ剤": "テープ",
    "テラムロジン": "テラムロAP",
    "テラムロプリド": "テラムロAP",
    "テラムロリウム": "テラムロAP",
    "エンレカナフ": "エンレスト",
    "ラベプラゾール": "ボノプラザン",
    "ラベプラゾールナトリウム": "ボノプラザン",
    "タケキャブ": "ボノプラザン",
    "デエビゴ": "レンボレキサント",
    "デビゴ": "レンボレキサント",
    "デエビコ": "レンボレキサント",
    "デェビゴ": "レンボレキサント",
    "アスパラ-CA": "L-アスパラギン酸カルシウム",
    "アスパラーCA": "L-アスパラギン酸カルシウム",
    "アスパラーCA錠200": "L-アスパラギン酸カルシウム",
    "アスパラCA": "L-アスパラギン酸カルシウム",
    "アスパラＣＡ": "L-アスパラギン酸カルシウム",
    "アスパラK": "L-アスパラギン酸カリウム・L-アスパラギン酸マグネシウム",
}
CORRECTIONS = {
    "フルラゼパム": "フルボキサミン",
    "フルラゼパム錠": "フルボキサミン",
    "フルラゼパムmg": "フルボキサミン",
    "フルボキサミン": "フルボキサミン",
    "エソメプラゾル": "エソメプラゾール",
    "エソメプラゾル錠": "エソメプラゾール",
    "エソメプラゾール": "エソメプラゾール",
    "エソメプラゾルmg": "エソメプラゾール",
    "ロゼレム": "ロゼレム",
    "ロゼルム": "ロゼレム",
    "ロゼレックス": "ロゼレム",
    "ロゼレックス錠": "ロゼレム",
    "ロゼレックスmg": "ロゼレム",
    "ロゼレム錠": "ロゼレム",
    "ロゼレムmg": "ロゼレム",
    "デエビゴ": "デエビゴ",
    "ランソプラゾル": "ランソプラゾール",
    "ランソプラゾル錠": "ランソプラゾール",
    "アルファカルシドル": "アルファカルシドール",
    "アルファカルシドル錠": "アルファカルシドール",
    "フェブキソスタット錠mg": "フェブキソスタット",
    "オルケディア": "エボカルセト",
    "オルケディア錠": "エボカルセト",
    "オルケディア錠1mg": "エボカルセト",
    "7オルケディア": "エボカルセト",
    "芍薬甘草湯": "芍薬甘草湯",
    "ツムラ芍薬甘草湯": "芍薬甘草湯",
    "ツムラ芍薬甘草湯エキス顆粒": "芍薬甘草湯",
    "リンゼス": "リナクロチド",
    "ラキソベロン": "ピコスルファートナトリウム",
    "グーフィス": "エロビキシバット",
    "エボカルセト": "エボカルセト",
    "ルパフィン錠mg": "ルパフィン",
    "リオナ錠mg": "リオナ",
    "炭酸ランタンロ腔内崩壊錠mg": "炭酸ランタン",
    "ニフェジピン徐放錠mg": "ニフェジピン",
    "ベニジピン塩酸塩錠mg": "ベニジピン",
    "アムロジピンロ腔内崩壊錠mg": "アムロジピン",
    "タケキャブ錠mg": "タケキャブ",
    "タケミン": "タケキャブ",
    "タケキャブ": "タケキャブ",
    "テラゾシン": "テラムロAP",
    "テラムロAP": "テラムロAP",
    "テラグルチド": "テラムロAP",
}
VOTED = {
    "オルケディア": "エボカルセト",
    "リンゼス": "リナクロチド",
    "ラキソベロン": "ピコスルファートナトリウム",
    "グーフィス": "エロビキシバット",
    "芍薬甘草湯": "芍薬甘草湯",
    "ツムラ芍薬甘草湯": "芍薬甘草湯",
    "ツムラ芍薬甘草湯エキス顆粒": "芍薬甘草湯",
    "ファモチジン": "ファモチジン",
    "ファモチジンロ腔内崩壊": "ファモチジン",
    "ファモチジン口腔内崩壊": "ファモチジン",
    "アスピリン腸溶": "アスピリン",
    "アスピリン": "アスピリン",
    "エンレスト": "サクビトリル/バルサルタン",
    "テルミサルタン・アムロジピン": "テルミサルタン・アムロジピン",
    "ニフェジピン": "ニフェジピン",
    "センノシド": "センノシド",
    "センナ": "センナ",
    "センナ実配合": "センナ",
    "沈降炭酸カルシウム": "沈降炭酸カルシウム",
    "フェブキソスタット": "フェブキソスタット",
    "ナルフラフィン塩酸塩": "ナルフラフィン塩酸塩",
    "ジクロフェナクナトリウム": "ジクロフェナクナトリウム",
    "モンテルカスト": "モンテルカスト",
}
NORMAL_NAMES = {
    "テラムロプリド": "テラムロAP",
    "テラムロリウム": "テラムロAP",
    "テラムロジン": "テラムロAP",
    "テルミサルタン/アムロジピン": "テラムロAP",
    "ラベプラゾール": "ボノプラザン",
    "ラベプラゾールナトリウム": "ボノプラザン",
    "タケキャブ": "ボノプラザン",
    "エンレスト": "サクビトリル/バルサルタン",
    "シアリス": "タダラフィル",
    "シグマート": "ニコランジル",
    "レニベース": "エナラプリル",
    "タケプロン": "ランソプラゾール",
    "デエビゴ": "レンボレキサント",
    "デビゴ": "レンボレキサント",
    "デエビコ": "レンボレキサント",
    "デェビゴ": "レンボレキサント",
    "アスパラ-CA錠200": "L-アスパラギン酸カルシウム",
    "アスパラーCA錠200": "L-アスパラギン酸カルシウム",
    "アスパラCA錠200": "L-アスパラギン酸カルシウム",
    "アスパラK錠": "L-アスパラギン酸カリウム・L-アスパラギン酸マグネシウム",
    "ロキソニンテープ": "ロキソプロフェンナトリウム外用テープ",
}
PARTS = {
    "テラムロ": "テラムロAP",
    "タケキャブ": "ボノプラザン",
    "ボノ": "ボノプラザン",
    "キャブ": "ボノプラザン",
    "エンレスト": "サクビトリル/バルサルタン",
    "シアリス": "タダラフィル",
    "シグマート": "ニコランジル",
    "レニベース": "エナラプリル",
    "タケプロン": "ランソプラゾール",
    "デエビゴ": "レンボレキサント",
    "デビゴ": "レンボレキサント",
    "デエビコ": "レンボレキサント",
    "デェビゴ": "レンボレキサント",
    "アスパラ-CA": "L-アスパラギン酸カルシウム",
    "ロキソニンテープ": "ロキソプロフェンナトリウム外用テープ",
}
CONFUSED = {
    "(?i)アスパラ.?C[AＡ]": "L-アスパラギン酸カルシウム",
    "(?i)アスパラ.?Ｋ|アスパラ.?K": "L-アスパラギン酸カリウム・L-アスパラギン酸マグネシウム",
}
MAKERS = {
    "サンド": ("サンド", "SANDOZ", "ノバルティス"),
    "トーワ": ("トーワ", "TOWA", "東和"),
    "サワイ": ("サワイ", "SAWAI", "沢井"),
    "武田": ("武田", "TAKEDA", "タケダ"),
    "ノバルティス": ("ノバルティス", "NOVARTIS"),
    "ファイザー": ("ファイザー", "PFIZER"),
    "MSD": ("MSD", "メルク"),
    "アステラス": ("アステラス", "ASTELLAS"),
    "第一三共": ("第一三共", "DAIICHI SANKYO"),
    "エーザイ": ("エーザイ", "EISAI"),
}
MADE_BY = {
    "サンド": ("タダラフィル", "シアリス"),
    "トーワ": ("ニコランジル", "エナラプリル", "ランソプラゾール"),
    "サワイ": ("テラムロAP", "テルミサルタン", "アムロジピン"),
    "武田": ("タケキャブ", "ボノプラザン"),
    "ノバルティス": ("エンレスト", "サクビトリル", "バルサルタン"),
}
SIXTEEN = ("アムロジピン", "ニフェジピン", "ベニジピン", "クラリスロマイシン", "ベルソムラ", "デビゴ", "ロゼレム", "フルボキサミン", "エソメプラゾール", "タケキャブ", "ランソプラゾール", "アルファカルシドール", "フェブキソスタット", "炭酸ランタン", "ルパフィン", "リオナ")
FORM_PATTERN = "錠|カプセル|口腔内崩壊錠|OD錠|腸溶錠|徐放錠|CR錠|顆粒|細粒|散|粉末|ゲル|軟膏|クリーム|ローション|貼付剤|テープ|パッチ|液|シロップ|エキス|注射|点滴|静注|吸入|スプレー|ネブライザー|坐剤|浣腸|点眼|点鼻"
NOISE_CLASSES = (r"^[0-9\s×-]+$", "^[年月日時分秒]+$", r"^[患者|医師薬剤保険]+$", r"^[変更不可|患者希望次頁に続く]+$")
MORE_NOISE_CLASSES = (*NOISE_CLASSES, r"^[般|外麻向]+$", r"^[食前|後間就寝眠朝昼夕]+$")
NAME_CHARACTERS = "[ぁ-んァ-ヶ一-龥A-Za-z]"
NOT_NAMES = ("時間", "分", "秒", "日", "月", "年", "保存", "転送", "Keep", "名前を付けて保存", "午前", "午後", "AM", "PM", "電池", "信号", "WiFi", "バッテリー")
SURE_NAMES = ("シン", "マイシン", "ジピン", "プラゾール", "ソムラ", "ビゴ", "ゼレム", "ボキサミン", "ロジピン", "メプラゾール", "キャブ", "レム", "アスパラ", "ロキソニン", "テープ", "錠", "カプセル", "散", "シロップ")
SOME_PATTERN = r"^[ア-ン]+|[0-9]+mg|[錠|カプセル散液]|[A-Z]{2,}"
PROMPT_WORDS = ("注意:", "抽出ルール:", "薬剤名:", "分類:", "錠", "カプセル")
SUFFIXES = ("パム", "ラム", "ロン", "ジアゼパム", "ピオン", "ペート", "ジン", "ゾラム", "バミル", "バミド", "バミン")
SEVERITY_LABELS = {"重大": "🚨 重大", "major": "🚨 重大", "併用注意": "⚠️ 併用注意", "moderate": "⚠️ 併用注意", "注意": "⚠️ 併用注意", "参考": "ℹ️ 参考", "minor": "ℹ️ 参考"}
SEVERITY_CODES = {"重大": "major", "併用注意": "moderate", "注意": "moderate", "軽微": "minor", "major": "major", "moderate": "moderate", "minor": "minor"}
SOURCE_LABELS = {"手動ルール": "", "KEGG": " 📚", "AI": " 🤖"}


def alias_fixed(c: Column, learned: list[tuple[str, str]] = ()) -> Column:
    """Learned misreadings replaced; then the alias of the whole name, else all aliases replaced one after the other."""
    return let(replace_fold(c, list(learned)), lambda n: F.coalesce(S.mapped(n, ALIASES), replace_fold(n, list(ALIASES.items()))))


def corrected(c: Column) -> Column:
    """The correction of the whole name, else the first whose key contains it or is contained, else the first with a ratio of 80, else the name."""
    near = lambda e: char_overlap_ratio(F.lower(c), F.lower(e.key)) >= 80
    fuzzy = F.get(F.transform(F.filter(S.entries(CORRECTIONS), near), lambda e: e.value), 0)
    return F.coalesce(S.mapped(c, CORRECTIONS), S.first_contained(c, CORRECTIONS, either=True), fuzzy, c)


def plain(c: Column) -> Column:
    return S.run(c, PLAIN_STEPS)


def misread(c: Column) -> Column:
    return S.run(c, MISREAD_STEPS)


def without_dosage(c: Column) -> Column:
    """Forms and amounts taken out; the name itself if nothing is left."""
    return let(S.run(c, DOSAGE_STEPS), lambda x: F.when(x == "", c).otherwise(x))


def prepared(c: Column) -> Column:
    return S.run(alias_fixed(c), ENDING_STEPS)


def voted_name(c: Column) -> Column:
    return S.run(let(S.run(c, VOTED_STEPS), lambda x: F.coalesce(S.first_contained(x, VOTED), x)), [S.TRIM])


def without_symbols(c: Column) -> Column:
    return S.run(c, SYMBOL_STEPS)


def katakana(c: Column) -> Column:
    return S.run(c, KATAKANA_STEPS)


@F.pandas_udf(DoubleType())
def matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, longest first, which no built-in function has."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """1 if equal, .9 if one holds the other, else .7 of the matching blocks and .3 of the characters in common; 0 for empty names."""
    x, y = F.lower(a), F.lower(b)
    mixed = 0.7 * matching_blocks(x, y) + 0.3 * F.coalesce(char_jaccard(x, y), F.lit(0.0))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.9).otherwise(mixed)


def best_of(c: Column, names=SIXTEEN, least: int = 70) -> Column:
    """(name, score) of the first name with the highest overlap ratio of at least so much, null if there is none."""
    scored = F.transform(F.array(*map(F.lit, names)), lambda n, i: F.struct(char_overlap_ratio(c, n).alias("score"), (-i).alias("at"), n.alias("name")))
    best = let(F.array_max(scored), lambda x: F.when(x.score >= least, x))
    return F.when(best.isNotNull(), F.struct(best.getField("name").alias("name"), best.getField("score").alias("score")))


def maker(text: Column) -> Column:
    """The first maker of whom a spelling is part of the text."""
    return F.coalesce(*(F.when(S.any_of(text, words), name) for name, words in MAKERS.items()))


def amount(text: Column) -> Column:
    """The first amount in mg, else g, ml, μg, as number and unit."""
    found = lambda unit: F.regexp_extract(text, rf"([0-9]+\.?[0-9]*)[\s　]*{unit}", 1)
    return F.coalesce(*(F.when(found(u) != "", F.concat(found(u), F.lit(u))) for u in ("mg", "g", "ml", "μg")))


def made_name(c: Column, by: Column) -> Column:
    """The first main product of the first maker whose spelling is in `by` that holds the name or is held by it; else the name."""
    out = c
    for name in reversed(MADE_BY):
        fits = S.first_contained(c, {p: p for p in MADE_BY[name]}, either=True)
        out = F.when(S.any_of(by, MAKERS[name]) & fits.isNotNull(), fits).otherwise(out)
    return F.when(by.isNull() | (by == ""), c).otherwise(out)


def normalized(c: Column, by: Column) -> Column:
    """The ordered steps of a name as an array of (step, result): aliases, map, maker, parts, confusions."""
    alias = alias_fixed(c)
    whole = lambda x: F.coalesce(S.mapped(x, NORMAL_NAMES), x)
    part = lambda x: F.coalesce(S.first_contained(x, PARTS), x)
    forced = lambda x: F.coalesce(*(F.when(x.rlike(p), v) for p, v in CONFUSED.items()), x)
    said = lambda step, x: F.struct(F.lit(step).alias("step"), x.alias("result"))
    return let(alias, lambda a: let(whole(a), lambda w: let(made_name(w, by), lambda m: let(part(m), lambda p: F.array(said("alias", a), said("map", w), said("maker", m), said("part", p), said("confusion", forced(p)))))))


def valid_candidate(c: Column) -> Column:
    """Two characters at least, no noise, a form word and a letter."""
    noise = F.lit(False)
    for p in NOISE_CLASSES:
        noise = noise | c.rlike(p)
    return (F.length(c) >= 2) & ~noise & c.rlike(FORM_PATTERN) & c.rlike(NAME_CHARACTERS)


def noise(c: Column) -> Column:
    out = F.length(c) < 2
    for p in MORE_NOISE_CLASSES:
        out = out | c.rlike(p)
    return out


def valid_name(c: Column) -> Column:
    """Three characters at least, no word of other texts; a word of names, or katakana for half of it."""
    kana = F.length(F.regexp_replace(c, "[^゠-ヿ]", ""))
    return (F.length(c) >= 3) & ~S.any_of(c, NOT_NAMES) & (S.any_of(c, SURE_NAMES) | (kana >= F.length(c) * 0.5))


def some_name(c: Column) -> Column:
    return (F.length(c) >= 2) & c.rlike(SOME_PATTERN)


def no_prompt(c: Column) -> Column:
    return (F.length(c) >= 2) & ~S.any_of(c, PROMPT_WORDS)


def external_only(c: Column, text: Column, word: str = "ジクロフェナク") -> Column:
    """Whether a name stays: one with the word only where the text speaks of an external form."""
    return ~(F.contains(c, F.lit(word)) & ~S.any_of(text, ("ゲル", "外用", "貼付")))


def suffix_bonus(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for s in SUFFIXES:
        out = out | (F.endswith(a, F.lit(s)) & F.contains(b, F.lit(s)))
    return F.when(out, 15).otherwise(0)


def displayed_one(name: Column, raw: Column) -> Column:
    """The name as it is shown: three names take a form from the raw text."""
    aspirin = F.when(F.contains(raw, F.lit("腸溶")), "アスピリン腸溶").otherwise("アスピリン")
    famotidine = F.when(S.any_of(raw, ("口腔内崩壊", "OD錠")), "ファモチジン口腔内崩壊").otherwise("ファモチジン")
    senna = F.when(F.contains(raw, F.lit("センナ実")), "センナ実配合").otherwise("センナ")
    has = lambda w: F.contains(name, F.lit(w))
    return F.when(F.coalesce(name, F.lit("")) == "", "不明").when(has("アスピリン"), aspirin).when(has("ファモチジン"), famotidine).when(has("センナ"), senna).otherwise(name)


def summary(names: Column) -> Column:
    """How many different names there are, and which: all of up to five, else three."""
    own = F.array_distinct(names)
    n = F.size(own)
    few = F.concat(n.cast("string"), F.lit("剤検出: "), F.array_join(own, ", "))
    many = F.concat(n.cast("string"), F.lit("剤検出: "), F.array_join(F.slice(own, 1, 3), ", "), F.lit(" 他"), (n - 3).cast("string"), F.lit("剤"))
    return F.when(n == 0, "薬剤が検出されませんでした。").when(n <= 5, few).otherwise(many)


def merged_summary(kept: Column, removed: Column) -> Column:
    return F.when(removed > 0, F.format_string("✅ %d剤検出しました（重複 %d 件を自動統合）", kept, removed)).otherwise(F.format_string("✅ %d剤検出しました", kept))
