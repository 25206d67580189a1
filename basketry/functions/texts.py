"""Parsing of texts into rows and attributes, as column expressions. Null texts give nulls or empty lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, fn) -> Column:
    """fn of value, which is worked out once however often fn names it."""
    return F.get(F.transform(F.array(value), fn), 0)


def replace_fold(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replacements one after the other: a later one sees what an earlier one wrote."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null if there is none."""
    x = F.regexp_extract(c, pattern, group)
    return F.when(x != "", x)


def first_integer(c: Column) -> Column:
    return found(c, "([0-9]{1,9})", 1).cast("int")


def numbered_blocks(text: Column, kinds: str | None = None) -> Column:
    """Blocks (number, content) of a text whose lines start with one or two digits; with kinds, digits and one kind in lenticular brackets."""
    head = rf"[ \t]*(\d+)[ \t]*【(?:{kinds})】" if kinds else r"[ \t]*(\d{1,2})[ \t]*[【】]?"
    numbered = F.filter(F.split(text, rf"(?m)(?=^{head})"), lambda b: b.rlike(rf"\A{head}"))
    return F.transform(numbered, lambda b: F.struct(F.regexp_extract(b, rf"\A{head}", 1).cast("int").alias("number"), F.trim(F.regexp_replace(b, rf"\A{head}", ""), F.lit(" \t\r\n")).alias("content")))


def marked_lines(text: Column, mark: str = "RP") -> Column:
    """The lines that start with the mark and digits; the whole text if there is none."""
    lines = F.regexp_extract_all(text, F.lit(rf"(?m)^\s*{mark}\d+.*$"), F.lit(0))
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(text))


def line_attributes(line: Column) -> Column:
    """strength, size, qty, days, form of an order line."""
    both = lambda pattern, unit: F.concat(found(line, pattern, 1), F.lit(unit))
    form = F.when(line.rlike("テープ|パップ"), "テープ").when(F.contains(line, F.lit("錠")), "錠")
    size = F.concat(found(line, r"(\d+)\s*cm\s*×\s*(\d+)\s*cm", 1), F.lit("cm×"), found(line, r"(\d+)\s*cm\s*×\s*(\d+)\s*cm", 2), F.lit("cm"))
    qty = F.regexp_replace(found(line, r"\d+\s*(?:錠|枚)"), r"\s", "")
    return F.struct(both(r"(\d+)\s*mg", "mg").alias("strength"), size.alias("size"), qty.alias("qty"), both(r"(\d+)\s*日分", "日分").alias("days"), form.alias("form"))


def triage(line: Column, name: Column, normal: Column, conf: Column, units: dict[str, tuple], confusing: list[tuple[str, str]]) -> Column:
    """(score, status): half the confidence, .3 of the dictionary's agreement, .2 of three checks; .85 and .6 are the limits."""
    a = line_attributes(line)
    agree = F.when(name == normal, 1.0).when(F.coalesce(normal, F.lit("")) != "", 0.8).otherwise(0.0)
    fits = F.coalesce(*(F.when(a.form == f, F.coalesce(a.qty.rlike("|".join(us)), F.lit(True))) for f, us in units.items()), F.lit(True))
    mixed = F.lit(False)
    for x, y in confusing:
        mixed = mixed | (line.rlike(x) & line.rlike(y))
    passed = sum(F.when(t, 1).otherwise(0) for t in (agree >= 0.8, fits, ~mixed))
    score = F.round(0.5 * conf + 0.3 * agree + 0.2 * passed / 3, 3)
    return F.struct(score.alias("score"), F.when(score >= 0.85, "auto_confirm").when(score >= 0.6, "needs_review").otherwise("fail").alias("status"))


def command(text: Column) -> Column:
    """`name: key -> a, b` with half- or full-width colon, comma and arrow: (name, key, values); null if it is none."""
    pattern = r"\A\s*([^:：\s]+)\s*[:：]\s*(.+?)\s*(?:->|→)\s*(.+?)\s*\z"
    values = F.filter(F.transform(F.split(F.regexp_extract(text, pattern, 3), "[、,]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("name"), F.regexp_extract(text, pattern, 2).alias("key"), values.alias("values")))


def fenced_json(text: Column, schema: str) -> Column:
    """The JSON in the first code fence, else of the text itself."""
    return F.from_json(F.coalesce(found(text, r"(?s)```(?:json)?\s*(.*?)```", 1), text), schema)


def char_jaccard(a: Column, b: Column) -> Column:
    chars = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    x, y = chars(a), chars(b)
    return F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))


def pattern_similarity(a: Column, b: Column, ends: int = 3) -> Column:
    """1 if equal, .9 if one holds the other, else the share of a's characters that b has, .3 more for each equal end, 1 at most."""
    share = F.try_divide(F.size(F.filter(F.split(a, ""), lambda x: (x != "") & (F.instr(b, x) > 0))), F.greatest(F.length(a), F.length(b)))
    same = lambda x, y: F.when(x == y, 0.3).otherwise(0.0)
    more = same(F.left(a, F.lit(ends)), F.left(b, F.lit(ends))) + same(F.right(a, F.lit(ends)), F.right(b, F.lit(ends)))
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.9).otherwise(F.least(F.round(share + more, 6), F.lit(1.0)))


def keyword_level(c: Column, levels: list[tuple[str, tuple]], default: str) -> Column:
    """The level of the first list of keywords of which the text holds one, case ignored."""
    return F.coalesce(*(F.when(F.lower(c).rlike("|".join(words)), lv) for lv, words in levels), F.lit(default))


# Patterns of names in texts, in the order in which they are looked for.
CHARACTERS = "ぁ-んァ-ヶ一-龥A-Za-z0-9・ー"
BEFORE_FORMS = rf"(?:ツムラ)?([{CHARACTERS}\-]+?)(?:錠|カプセル|口腔内崩壊錠|顆粒|ゲル|散|液|エキス顆粒|テープ|点眼液|点鼻液|吸入液|注射剤|注射液|錠剤|カプセル剤|顆粒剤|ゲル剤|散剤|液剤)"
BEFORE_AMOUNTS = (rf"([{CHARACTERS}]+?)(?=\s*\d+mg|\s*\d+μg|\s*\d+g|\s*\d+%)", rf"([{CHARACTERS}]+?)(?=\s*×|\s*食後|\s*食前|\s*眠前)")
NAME_PATTERNS = (
    rf"([{CHARACTERS}]+?)(?:錠|カプセル|口腔内崩壊錠|顆粒|ゲル|散|液|テープ)",
    rf"(ツムラ[{CHARACTERS}]+?)(?:エキス顆粒|エキス散)",
    rf"([{CHARACTERS}]+?[・][{CHARACTERS}]+?)(?:錠|カプセル)",
    rf"([{CHARACTERS}]+?)(?:ゲル|軟膏|クリーム|貼付剤)",
)
FORM_FAMILIES = (
    "錠|カプセル|口腔内崩壊錠|OD錠|腸溶錠|徐放錠|CR錠",
    "顆粒|細粒|散|粉末",
    "ゲル|軟膏|クリーム|ローション",
    "貼付剤|テープ|パッチ",
    "液|シロップ|エキス",
    "注射|点滴|静注",
    "吸入|スプレー|ネブライザー",
    "坐剤|浣腸|点眼|点鼻",
)
EXPECTED = (
    r"ルパフィン錠\s*\d+mg",
    r"アムロジピン口腔内崩壊錠\s*\d+mg",
    r"ベニジピン塩酸塩錠\s*\d+mg",
    r"ニフェジピン徐放錠\s*\d+mg",
    r"アルファカルシドール\s*[\d.]+µg",
    r"フェブキソスタット錠\s*\d+mg",
    r"リオナ錠\s*\d+mg",
    r"炭酸ランタン口腔内崩壊錠\s*\d+mg",
    r"タケキャブ錠\s*\d+mg",
)


def names_before_forms(block: Column) -> Column:
    """Names before form words, and longer ones before amounts and times, in this order; a digit in front goes; each once."""
    text = replace_fold(block, [("（医療用）", ""), ("次頁に続く", ""), ("医療用", "")])
    tidy = lambda names, least: F.filter(F.transform(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: F.length(x) >= least), lambda x: F.regexp_replace(x, r"\A\d", "")), lambda x: F.length(x) >= least)
    each = [tidy(F.regexp_extract_all(text, F.lit(BEFORE_FORMS), F.lit(1)), 2), *(tidy(F.regexp_extract_all(text, F.lit(p), F.lit(1)), 3) for p in BEFORE_AMOUNTS)]
    return F.array_distinct(F.concat(*each))


def pattern_names(text: Column) -> Column:
    """The sorted distinct names of all patterns, noise left out."""
    from .medicines import noise

    found_ = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in NAME_PATTERNS))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found_, lambda x: ~noise(x)), lambda x: F.trim(x))))


def dictionary_names(text: Column, book: dict[str, str]) -> Column:
    """The sorted distinct values of the keys that the text holds."""
    from .steps import entries

    return F.array_sort(F.array_distinct(F.transform(F.filter(entries(book), lambda e: F.contains(text, e.key)), lambda e: e.value)))


def expected_lines(text: Column) -> Column:
    """Matches of the expected patterns; if there are none, the lines with a unit and a digit."""
    hits = F.concat(*(F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(0)) for p in EXPECTED))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("錠|mg|µg|g") & x.rlike(r"\d"))
    return F.when(F.size(hits) > 0, hits).otherwise(lines)


def cut_behind_forms(line: Column) -> Column:
    """The pieces of a line up to each form word, for one family of forms after the other; a piece without the family's words stays whole."""

    def family(words):
        def cut(x):
            pieces = F.transform(F.regexp_extract_all(x, F.lit(f"(?s).*?(?:{words})"), F.lit(0)), lambda y: F.trim(y))
            return F.when(x.rlike(words), F.filter(pieces, lambda y: y != "")).otherwise(F.array(x))

        return cut

    out = F.array(line)
    for words in FORM_FAMILIES:
        out = F.flatten(F.transform(out, family(words)))
    return out
