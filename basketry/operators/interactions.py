"""The interaction report of whole baskets: classes of names, fixed rules, suppression, priorities. Not medical advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import canonical, listed, shown
from ..functions.strings import first_text
from .lookup import each_once
from .rules import Marks, Rule, evaluate_marked, findings

# The classes of each name, and the rules with severity, title and priority in their order. What follows #
# in a title tells two rules of one title apart and isn't shown.
CLASSES = {
    "タダラフィル": ("PDE5",),
    "ニコランジル": ("NITRATE_LIKE",),
    "サクビトリル/バルサルタン": ("ARNI", "ARB", "RAAS"),
    "テルミサルタン/アムロジピン": ("ARB", "CCB", "RAAS"),
    "エナラプリル": ("ACEI", "RAAS"),
    "ボノプラザン": ("PCAB",),
    "ランソプラゾール": ("PPI",),
    "クラリスロマイシン": ("ABX", "CYP3A_STRONG_INHIB"),
    "スボレキサント": ("OREXIN_ANTAGONIST", "SEDATIVE"),
    "レンボレキサント": ("OREXIN_ANTAGONIST", "SEDATIVE"),
    "ラメルテオン": ("MELATONIN_AGONIST", "SEDATIVE", "RAMELTEON"),
    "フルボキサミン": ("SSRI", "RAMELTEON_CONTRA_PAIR"),
    "アムロジピン": ("DHP_CCB", "CCB"),
    "ニフェジピン": ("DHP_CCB", "CCB"),
    "ニフェジピン徐放": ("DHP_CCB", "CCB"),
    "エソメプラゾール": ("PPI",),
    "センノシド": ("STIM_LAX", "LAXATIVE"),
    "センナ": ("STIM_LAX", "LAXATIVE"),
    "センナ・センナ実": ("STIM_LAX", "LAXATIVE"),
    "ピコスルファートナトリウム": ("STIM_LAX", "LAXATIVE"),
    "リナクロチド": ("GCC_AGONIST", "LAXATIVE"),
    "エロビキシバット": ("IBAT_INHIB", "LAXATIVE"),
    "芍薬甘草湯": ("GLYCYRRHIZA", "KAMPO"),
    "沈降炭酸カルシウム": ("CALCIUM_BINDER", "PHOSPHATE_BINDER"),
    "エボカルセト": ("CALCIMIMETIC",),
    "キックリン": ("PHOSPHATE_BINDER",),
}
RULES = [
    Rule("RAAS禁忌（ARNI＋ACEIの同時併用）", "all_of", ("ARNI", "ACEI"), severity="重大", priority=0),
    Rule("RAAS重複（原則併用回避：ACEI/ARB/ARNI）", "at_least", ("ACEI", "ARB", "ARNI"), severity="重大", priority=0, unless=("RAAS禁忌（ARNI＋ACEIの同時併用）",)),
    Rule("PDE5阻害薬＋硝酸薬相当（禁忌）", "all_of", ("PDE5", "NITRATE_LIKE"), severity="重大", priority=0),
    Rule("胃酸抑制薬の重複", "all_of", ("PPI", "PCAB"), severity="併用注意", priority=5),
    Rule("降圧薬の多剤併用", "at_least", ("ACEI", "ARB", "ARNI", "CCB", "NITRATE_LIKE"), least=3, severity="併用注意"),
    Rule("オレキシン受容体拮抗薬＋CYP3A強阻害薬（禁忌）", "all_of", ("OREXIN_ANTAGONIST", "CYP3A_STRONG_INHIB"), severity="重大", priority=0),
    Rule("フルボキサミン＋ラメルテオン（禁忌）", "all_of", ("RAMELTEON", "RAMELTEON_CONTRA_PAIR"), severity="重大", priority=0),
    Rule("CYP3A阻害薬＋DHP-CCB（注意）", "any_any", ("CYP3A_STRONG_INHIB", "CYP3A_MOD_INHIB"), ("DHP_CCB",), severity="併用注意"),
    Rule("Ca拮抗薬の重複", "at_least", ("DHP_CCB", "CCB"), severity="併用注意"),
    Rule("鎮静薬の多剤併用", "at_least", ("SEDATIVE",), severity="併用注意", priority=1),
    Rule("下剤の多剤併用", "at_least", ("LAXATIVE",), severity="併用注意"),
    Rule("甘草（芍薬甘草湯）＋刺激性下剤", "all_of", ("GLYCYRRHIZA", "STIM_LAX"), severity="併用注意", priority=1),
    Rule("Ca拮抗薬の重複#DHP", "at_least", ("DHP_CCB",), severity="併用注意"),
    Rule("刺激性下剤の重複", "at_least", ("STIM_LAX",), severity="併用注意", priority=1),
    Rule("リン吸着薬／Ca製剤による他剤の吸収低下（該当薬あり：2時間以上間隔をあける）", "at_least", ("CALCIUM_BINDER", "PHOSPHATE_BINDER"), least=1, severity="併用注意", given=("CHELATED",)),
    Rule("リン吸着薬／Ca製剤による他剤の吸収低下（該当薬なし：一般注意）", "at_least", ("CALCIUM_BINDER", "PHOSPHATE_BINDER"), least=1, severity="併用注意", priority=3, without=("CHELATED",)),
    Rule("エボカルセト＋下剤多剤（低Ca/QT延長リスク）", "with_least", ("LAXATIVE",), ("CALCIMIMETIC",), severity="併用注意", priority=3),
]
CHECKS = "開始/変更後1–2週でCr/eGFR/K、血圧を再評価。"
#: What is to be done, by rule; {why} stands for WHY where the targets hold its name.
ACTIONS = {
    "RAAS禁忌（ARNI＋ACEIの同時併用）": "禁忌（36時間ルール）。ACEI中止後36時間空けてARNIへ切替。" + CHECKS,
    "RAAS重複（原則併用回避：ACEI/ARB/ARNI）": "低血圧・高K・腎機能悪化リスク。原則併用回避を検討。{why}" + CHECKS,
    "PDE5阻害薬＋硝酸薬相当（禁忌）": "禁忌。重度低血圧・失神リスクのため併用回避。",
    "胃酸抑制薬の重複": "同効薬の重複投与に注意。適応・目的が同じなら簡素化を検討。",
    "降圧薬の多剤併用": "過度な降圧リスク。血圧・腎機能・K値のモニタリングを強化。",
    "オレキシン受容体拮抗薬＋CYP3A強阻害薬（禁忌）": "禁忌。CYP3A強阻害によりオレキシン薬の曝露が大幅上昇。併用回避。",
    "フルボキサミン＋ラメルテオン（禁忌）": "禁忌。フルボキサミンによりラメルテオンの曝露が大幅上昇。併用回避。",
    "CYP3A阻害薬＋DHP-CCB（注意）": "CYP3A阻害によりDHP-CCBの曝露上昇。過度の降圧・浮腫に注意。血圧・腎機能モニタリング強化。",
    "Ca拮抗薬の重複": "低血圧・浮腫・反射性頻脈などに注意。目的がなければ再検討。",
    "鎮静薬の多剤併用": "過鎮静・転倒リスク。必要性を再評価し、簡素化を検討。",
    "下剤の多剤併用": "下痢・脱水・電解質異常（特にK）に注意。便回数・体重・血圧のモニタリング。必要性を再評価し簡素化を検討。",
    "甘草（芍薬甘草湯）＋刺激性下剤": "低K血症（偽性アルドステロン症）や浮腫・高血圧のリスク。K値・血圧・浮腫を定期確認。",
    "Ca拮抗薬の重複#DHP": "低血圧・浮腫などに留意。目的がなければ再検討。",
    "刺激性下剤の重複": "腹痛/下痢/依存リスクに注意。便秘コントロールの再評価（用量調整や浸透圧性下剤の併用検討など）。",
    "リン吸着薬／Ca製剤による他剤の吸収低下（該当薬あり：2時間以上間隔をあける）": "併用薬に吸収低下リスク薬あり。服用間隔を2時間以上あける。",
    "リン吸着薬／Ca製剤による他剤の吸収低下（該当薬なし：一般注意）": "他剤と原則2時間以上あける（抗菌薬・甲状腺薬・鉄剤・ビスホスホネート等）。",
    "エボカルセト＋下剤多剤（低Ca/QT延長リスク）": "Ca低下によりQT延長素因が増す可能性。Ca・Mg・Kを定期確認（特に開始・増量時）。",
}
WHY = ("サクビトリル/バルサルタン", "（注：ARNIはARB成分〈バルサルタン〉を含むため）")
#: Words of names whose uptake a binder lowers: the class CHELATED.
CHELATED = ("レボフロキサシン", "シプロフロキサシン", "モキシフロキサシン", "トスフロキサシン", "ミノサイクリン", "ドキシサイクリン", "テトラサイクリン", "レボチロキシン", "リオチロニン", "アレンドロネート", "リセドロネート", "ミノドロネート", "ミコフェノール", "硫酸鉄", "フマル酸第一鉄", "クエン酸第一鉄")


def class_tags(name: Column) -> Column:
    """The classes of a name as it is, else as it is when cleaned, and that of names whose uptake a binder lowers; an empty array for none."""
    book = F.create_map(*(x for k, v in CLASSES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    none = F.array().cast("array<string>")
    chelated = F.when(name.rlike("|".join(CHELATED)), F.array(F.lit("CHELATED"))).otherwise(none)
    return F.concat(F.coalesce(book[name], book[canonical(name)], none), F.coalesce(chelated, none))


MARKS = Marks(RULES)


def classified(mentions: DataFrame) -> DataFrame:
    """mentions (rx_id, generic, name, brand, raw) -> rx_id, name, shown, marks: a row for each mention of a name that has classes.

    Each different name is classified once. The spellings of the names that have classes go to all tasks: a shuffle by
    name would put all mentions into as many tasks as there are names.
    """
    named = mentions.select("rx_id", first_text("generic", "name", "brand", "raw").alias("name"))
    book = each_once(named, ["name"], lambda d: d.select("name", class_tags(F.col("name")).alias("tags"))).where(F.size("tags") > 0)
    return named.join(F.broadcast(book.select("name", shown(F.col("name")).alias("shown"), MARKS.of(F.col("tags")).alias("marks"))), "name").select("rx_id", "name", "shown", "marks")


def report_lines() -> Column:
    """On a basket with columns as rules.gathered(MARKS) gives them: the findings by priority, a line each; empty if there are none."""
    order = F.sort_array(findings(RULES, MARKS, listed))
    return F.array_join(F.transform(order, lambda f: F.concat(F.lit("["), f.severity, F.lit("] "), F.substring_index(f.rule_id, "#", 1), F.lit("："), f.targets)), "\n")


def action(rule_id: Column, targets: Column) -> Column:
    """What is to be done about a finding."""
    why = F.when(F.contains(targets, F.lit(WHY[0])), WHY[1]).otherwise("")
    return F.replace(F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))[rule_id], F.lit("{why}"), why)


def report(mentions: DataFrame) -> DataFrame:
    """rx_id, title, severity, priority, targets, action, rank: the findings of each basket by priority, then in the rules' order.

    Null or blank names are in no class; an empty table has no findings.
    """
    found = evaluate_marked(classified(mentions), RULES, listed)
    order = F.create_map(*(F.lit(x) for i, r in enumerate(RULES) for x in (r.id, i)))[F.col("rule_id")]
    rank = F.row_number().over(Window.partitionBy("rx_id").orderBy("priority", order))
    return found.select("rx_id", F.substring_index("rule_id", "#", 1).alias("title"), "severity", "priority", "targets", action(F.col("rule_id"), F.col("targets")).alias("action"), rank.alias("rank"))
