"""Form, name, strength, dose, frequency and code labels of order lines. Null lines give nulls; the form has a default."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .names import table
from .texts import found, let, replace_fold

# Form words in the order in which they are looked for, their normal forms, patterns, code labels.
FORM_WORDS = (
    "錠|カプセル|口腔内崩壊錠|OD錠|腸溶錠|徐放錠|CR錠",
    "顆粒|細粒|散|粉末",
    "ゲル|軟膏|クリーム|ローション",
    "貼付剤|テープ|パッチ",
    "液|シロップ|エキス",
    "注射|点滴|静注",
    "吸入|スプレー|ネブライザー",
    "坐剤|浣腸|点眼|点鼻",
)
NORMAL_FORMS = {
    "口腔内崩壊錠": "口腔内崩壊",
    "OD錠": "口腔内崩壊",
    "腸溶錠": "腸溶",
    "徐放錠": "徐放",
    "CR錠": "徐放",
    "細粒": "顆粒",
    "粉末": "散",
    "ローション": "液",
    "貼付剤": "貼付",
    "パッチ": "貼付",
    "エキス": "液",
    "静注": "注射",
    "点滴": "注射",
    "スプレー": "吸入",
    "ネブライザー": "吸入",
    "浣腸": "坐剤",
    "点眼": "点眼",
    "点鼻": "点鼻",
}
STRENGTHS = (r"\d+\.?\d*\s*(?:mg|g|ml|μg|mcg)", r"\d+\.?\d*%")
DOSES = (r"\d+\s*(?:錠|包|ml|g)", r"\d+\s*×\s*\d+")
FREQUENCIES = ("食前|食後|食間|就寝前|眠前|朝|昼|夕", r"\d+\s*回", r"毎日|隔日|週\d+回")
TIMINGS = {"朝夕": "朝・夕", "眠前": "就寝前"}
CODE_LABELS = {
    "A": "消化器系・代謝",
    "B": "血液・造血器",
    "C": "循環器系",
    "D": "皮膚科用",
    "G": "泌尿・生殖器・性ホルモン",
    "H": "全身用ホルモン（性ホルモン除く）",
    "J": "全身用抗感染薬",
    "L": "抗腫瘍・免疫調節",
    "M": "筋骨格系",
    "N": "神経系",
    "P": "寄生虫",
    "R": "呼吸器系",
    "S": "感覚器",
    "V": "その他",
    "A06": "下剤",
    "A06AB": "下剤（刺激性）",
    "A06AB08": "下剤（刺激性：ピコスルファート）",
    "A06AX04": "便秘症治療薬（GC-C作動薬）",
    "A06AX16": "便秘症治療薬（胆汁酸輸送阻害薬）",
    "A02AC": "制酸薬（カルシウム）",
    "A02AB": "制酸薬（アルミニウム）",
    "A02AD": "制酸薬（マグネシウム）",
    "M04AA": "高尿酸血症治療薬（キサンチン酸化酵素阻害薬）",
    "M02AA": "NSAIDs外用",
    "M01AB": "NSAIDs（ジクロフェナク系）",
    "M01AE": "NSAIDs（プロピオン酸系）",
    "R03DC": "抗アレルギー薬（LTRA）",
    "R06AX": "抗ヒスタミン薬",
    "H05BX": "副甲状腺機能亢進症治療薬（Ca受容体作動薬）",
    "H05AA": "副甲状腺ホルモン",
    "N05CF": "睡眠薬（非ベンゾジアゼピン系）",
    "N05CM": "睡眠薬（オレキシン受容体拮抗薬）",
    "N05CH": "睡眠薬（メラトニン受容体作動薬）",
    "N06AB": "抗うつ薬（SSRI）",
    "N06AX": "抗うつ薬（その他）",
    "D07": "副腎皮質ホルモン外用",
    "D11": "皮膚科用その他",
    "C09AA": "ACE阻害薬",
    "C09CA": "ARB",
    "C07AB": "β遮断薬",
    "C08CA": "カルシウム拮抗薬",
    "B01AC": "抗血小板薬",
    "B01AA": "抗凝固薬",
}


def first_of(c: Column, patterns) -> Column:
    return F.coalesce(*(found(c, p) for p in patterns))


def has_form_word(c: Column) -> Column:
    """Whether a line holds a form word. Words that hold another one needn't be looked for, and plain searches are far faster than a pattern of all words."""
    words = "|".join(FORM_WORDS).split("|")
    least = [w for w in words if not any(x in w for x in words if x != w)]
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in dict.fromkeys(least)))


def form(c: Column) -> Column:
    return let(first_of(c, FORM_WORDS), lambda word: F.coalesce(table(NORMAL_FORMS, word), word, F.lit("錠")))


def item_name(c: Column) -> Column:
    """The line without its form, all form words with a normal form, amounts and brackets."""
    bare = F.replace(c, form(c), F.lit(""))
    bare = replace_fold(bare, [(k, "") for k in NORMAL_FORMS])
    for pattern in (r"\d+\.?\d*\s*(?:mg|g|ml|μg|mcg)", r"\d+%", "[()（）【】]"):
        bare = F.regexp_replace(bare, pattern, "")
    return F.trim(bare)


def strength(c: Column) -> Column:
    return first_of(c, STRENGTHS)


def dose(c: Column) -> Column:
    return first_of(c, DOSES)


def frequency(c: Column) -> Column:
    """With the standard words for times of day."""
    return replace_fold(first_of(F.replace(c, F.lit("就寝前"), F.lit("眠前")), FREQUENCIES), list(TIMINGS.items()))


def code_label(codes: Column) -> Column:
    """The label of the longest code (the last of equally long ones): whole, or its first 5, 3 or 1 characters."""
    most = F.array_max(F.transform(codes, F.length))
    leaf = F.get(F.reverse(F.filter(codes, lambda x: F.length(x) == most)), 0)
    return F.coalesce(table(CODE_LABELS, leaf), *(table(CODE_LABELS, F.substring(leaf, 1, n)) for n in (5, 3, 1)))
