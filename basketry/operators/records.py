"""Flat-file records: a text with section heads at the start of lines, continued by indented lines, and `///` after each record.

Lines become rows that know their record and section, by one window over the lines of a text; codes and fields are taken
from the sections that hold them. A null text has no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import steps as S

END = "///"
CODE = "[A-Z][0-9]{2}[A-Z]{2}[0-9]{2}"
# Fixed values, in the order in which they hold: words of a class and its label; the first word that the class holds counts.
CLASS_LABELS = {
    "proton pump inhibitor": "消化管機能薬", "ppi": "消化管機能薬", "h2 blocker": "消化管機能薬", "antacid": "消化管機能薬", "prokinetic": "消化管機能薬", "laxative": "下剤", "antidiarrheal": "消化管機能薬",
    "calcium channel blocker": "カルシウム拮抗薬", "ace inhibitor": "ACE阻害薬", "angiotensin receptor blocker": "ARB", "beta blocker": "β遮断薬", "diuretic": "利尿薬", "antiarrhythmic": "抗不整脈薬", "cardiac glycoside": "強心配糖体",
    "benzodiazepine": "睡眠薬", "non-benzodiazepine": "睡眠薬", "orexin receptor antagonist": "睡眠薬", "melatonin receptor agonist": "睡眠薬", "ssri": "抗うつ薬", "snri": "抗うつ薬", "tricyclic antidepressant": "抗うつ薬", "antipsychotic": "抗精神病薬", "antianxiety": "抗不安薬", "anticonvulsant": "抗てんかん薬",
    "nsaid": "NSAIDs", "cox-2 inhibitor": "NSAIDs", "opioid": "オピオイド", "corticosteroid": "副腎皮質ホルモン",
    "antibiotic": "抗生物質", "antiviral": "抗ウイルス薬", "antifungal": "抗真菌薬", "macrolide": "抗生物質", "penicillin": "抗生物質", "cephalosporin": "抗生物質", "quinolone": "抗生物質",
    "statin": "脂質異常症治療薬", "fibrate": "脂質異常症治療薬", "xanthine oxidase inhibitor": "高尿酸血症治療薬", "uricosuric": "高尿酸血症治療薬", "antidiabetic": "糖尿病治療薬", "insulin": "糖尿病治療薬", "sulfonylurea": "糖尿病治療薬", "biguanide": "糖尿病治療薬", "dpp-4 inhibitor": "糖尿病治療薬", "sglt2 inhibitor": "糖尿病治療薬", "glp-1 receptor agonist": "糖尿病治療薬",
    "bronchodilator": "気管支拡張薬", "inhaled corticosteroid": "吸入ステロイド薬", "leukotriene receptor antagonist": "抗アレルギー薬", "antihistamine": "抗アレルギー薬", "mucolytic": "去痰薬", "expectorant": "去痰薬",
    "vitamin": "ビタミン剤", "mineral": "ミネラル剤", "herbal": "漢方", "traditional medicine": "漢方", "chinese medicine": "漢方", "kampo": "漢方", "topical": "外用薬", "dermatological": "皮膚科用薬", "ophthalmic": "眼科用薬", "otologic": "耳鼻科用薬",
}
ENHANCED_LABELS = {
    "benzodiazepine": "ベンゾジアゼピン系", "barbiturate": "バルビツール酸系", "opioid": "オピオイド系", "nsaid": "NSAIDs", "statin": "スタチン系", "ace inhibitor": "ACE阻害薬", "angiotensin": "ARB", "beta blocker": "β遮断薬", "calcium channel": "カルシウム拮抗薬", "diuretic": "利尿薬", "antihistamine": "抗ヒスタミン薬",
    "antacid": "制酸薬", "analgesic": "解熱鎮痛薬", "antibiotic": "抗生物質", "antiviral": "抗ウイルス薬", "antifungal": "抗真菌薬", "antidepressant": "抗うつ薬", "antipsychotic": "抗精神病薬", "antianxiety": "抗不安薬", "sedative": "鎮静薬", "hypnotic": "睡眠薬",
}
#: Labels of predicted classes.
PREDICTED_LABELS = {
    "benzodiazepines": "ベンゾジアゼピン系", "barbiturates": "バルビツール酸系", "opioids": "オピオイド系", "nsaids": "NSAIDs", "statins": "スタチン系", "ace_inhibitors": "ACE阻害薬", "arb": "ARB", "beta_blockers": "β遮断薬", "calcium_blockers": "カルシウム拮抗薬", "diuretics": "利尿薬", "antihistamines": "抗ヒスタミン薬", "antacids": "制酸薬", "unknown": "不明",
}
PATHWAYS, TARGETS = 5, 3


def record_lines(texts: DataFrame, by: str, text: str = "text") -> DataFrame:
    """texts (by, text) -> by, record (from 0), n (line of the text, from 0), section, head (whether the line starts it), body.

    A line that starts with capitals starts a section; all lines up to the next one are of it. Lines before the first
    section of a record have none. The lines that end records are left out.
    """
    lines = texts.select(by, F.posexplode(F.split(text, "\r?\n")).alias("n", "line"))
    w = Window.partitionBy(by).orderBy("n")
    ends = F.startswith("line", F.lit(END))
    lines = lines.withColumn("record", F.sum(F.when(ends, 1).otherwise(0)).over(w).cast("int")).where(~ends)
    own = F.regexp_extract("line", "^[A-Z][A-Z_]*", 0)
    lines = lines.withColumn("own", F.when(own != "", own))
    section = F.last("own", ignorenulls=True).over(Window.partitionBy(by, "record").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    body = F.trim(F.expr("substring(line, 1 + coalesce(length(own), 0))"))
    return lines.select(by, "record", "n", section.alias("section"), F.col("own").isNotNull().alias("head"), body.alias("body"))


def record_codes(lines: DataFrame, by: str) -> DataFrame:
    """Lines as record_lines() gives them -> by, record, entry, ord, code: the codes of a record, from the lines behind the head of BRITE that name ATC.

    ord counts them in the order of lines and places; entry is the id in the record's last ENTRY, null without one.
    """
    second = F.get(F.split("body", r"\s+"), 0)
    entry = lines.where("head AND section = 'ENTRY'").groupBy(by, "record").agg(F.max_by(second, "n").alias("entry"))
    first = lines.where("head AND section = 'BRITE'").groupBy(by, "record").agg(F.min("n").alias("start"))
    within = lines.where(F.contains("body", F.lit("ATC"))).join(first, [by, "record"]).where("n > start AND NOT (head AND section = 'BRITE')")
    codes = within.select(by, "record", "n", F.posexplode(F.regexp_extract_all("body", F.lit(CODE), F.lit(0))).alias("i", "code"))
    ord_ = F.row_number().over(Window.partitionBy(by, "record").orderBy("n", "i")) - 1
    return codes.withColumn("ord", ord_).join(entry, [by, "record"], "left").select(by, "record", "entry", "ord", "code")


def class_label(c: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(S.first_contained(F.lower(c), table), F.lit(default))


def record_fields(lines: DataFrame, by: str) -> DataFrame:
    """Lines as record_lines() gives them -> a row for each record: by, record, category, pathways, targets, generic, enhanced.

    category is the label of the first CLASS, else CATEGORY, else ATC with a text; pathways and targets are the first words
    of the first such heads; generic is the last NAME's part before a semicolon, enhanced the label of the last CLASS.
    """
    head = lambda s: F.col("head") & (F.col("section") == s)
    said = F.col("body") != ""
    first = lambda s: F.min_by(F.when(head(s) & said, F.col("body")), F.when(head(s) & said, F.col("n")))
    last = lambda s, test: F.max_by(F.when(head(s) & test, F.col("body")), F.when(head(s) & test, F.col("n")))
    word = F.get(F.split("body", r"\s+"), 0)
    some = lambda s, most: F.slice(F.transform(F.array_sort(F.collect_list(F.when(head(s) & said, F.struct("n", word.alias("w"))))), lambda x: x.w), 1, most)
    g = lines.groupBy(by, "record").agg(
        F.coalesce(first("CLASS"), first("CATEGORY"), first("ATC")).alias("c"), some("PATHWAY", PATHWAYS).alias("pathways"), some("TARGET", TARGETS).alias("targets"),
        F.trim(F.substring_index(last("NAME", F.contains("body", F.lit(";"))), ";", 1)).alias("generic"), last("CLASS", F.lit(True)).alias("e"),
    )
    return g.select(by, "record", class_label(F.col("c"), CLASS_LABELS, "その他").alias("category"), "pathways", "targets", "generic", class_label(F.col("e"), ENHANCED_LABELS, "不明").alias("enhanced"))
