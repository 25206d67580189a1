"""Analysis of a name: English names, category, confidence, and what to search for first. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import classes as C, medicines as M, steps as S
from .texts import let

# Fixed values, in the order in which they hold.
ENGLISH_NAMES = {
    "アルプラゾラム": ("alprazolam", "xanax", "U-31889"),
    "ブロマゼパム": ("bromazepam", "lexotanil", "ro-5-3350"),
    "クロルジアゼポキシド": ("chlordiazepoxide", "librium", "ro-5-0690"),
    "クロバザム": ("clobazam", "frisium", "HR-376"),
    "クロナゼパム": ("clonazepam", "klonopin", "ro-5-4023"),
    "ジアゼパム": ("diazepam", "valium", "ro-5-2807"),
    "エチゾラム": ("etizolam", "depas", "U-33400"),
    "フルニトラゼパム": ("flunitrazepam", "rohypnol", "ro-5-4200"),
    "フルラゼパム": ("flurazepam", "dalmane", "ro-5-6901"),
    "ハロキサゾラム": ("haloxazolam", "somelin", "CS-430"),
    "ロラゼパム": ("lorazepam", "ativan", "wy-4036"),
    "ミダゾラム": ("midazolam", "versed", "ro-21-3981"),
    "ニトラゼパム": ("nitrazepam", "mogadon", "ro-4-5360"),
    "オキサゼパム": ("oxazepam", "serax", "ro-5-6789"),
    "テマゼパム": ("temazepam", "restoril", "ro-5-5345"),
    "トリアゾラム": ("triazolam", "halcion", "U-33030"),
    "ゾルピデム": ("zolpidem", "ambien", "stilnox", "SL-800750"),
    "ゾピクロン": ("zopiclone", "imovane", "RP-27267"),
    "ゾレピデム": ("zaleplon", "sonata", "CL-284846"),
    "エスゾピクロン": ("eszopiclone", "lunesta", "S-20098"),
    "ラメルテオン": ("ramelteon", "rozerem", "TAK-375"),
    "スボレキサント": ("suvorexant", "belsomra", "MK-4305"),
    "レンボレキサント": ("lemborexant", "dayvigo", "E-2006"),
    "デビゴ": ("lemborexant", "dayvigo", "E-2006"),
    "ダロレキサント": ("daridorexant", "quviviq", "ACT-541468"),
    "ペントバルビタール": ("pentobarbital", "nembutal", "ethyl-5-phenylbarbituric acid"),
    "フェノバルビタール": ("phenobarbital", "luminal", "phenobarbitone"),
    "セコバルビタール": ("secobarbital", "seconal", "quinalbarbitone"),
    "アモバルビタール": ("amobarbital", "amytal", "amylobarbitone"),
    "バルビタール": ("barbital", "veronal", "diethylbarbituric acid"),
    "メタゼパム": ("metazepam", "meptin", "ro-5-5345"),
    "ロフラゼペート": ("lofrazepate", "meilax", "ro-5-3590"),
    "メキサゾラム": ("mexazolam", "melex", "CS-386"),
    "オキサゾラム": ("oxazolam", "serenal", "CS-370"),
    "リルマザフォン": ("rilmazafone", "rhythmy", "450-191"),
    "プラゼパム": ("prazepam", "centrax", "ro-5-4082"),
    "タンドスピロン": ("tandospirone", "sediel", "SM-3997"),
    "トフィンパム": ("tofisopam", "grandaxin", "GR-2"),
    "クロチアゼパム": ("clotiazepam", "veredorm", "YB-2"),
    "エスタゾラム": ("estazolam", "prosom", "D-40TA"),
    "クロキサゾラム": ("cloxazolam", "olcadil", "MT-141"),
    "ブトクトアミド": ("butoctamide", "listomin-s", "BA-1"),
    "クロラール": ("chloral", "chloral hydrate", "trichloroacetaldehyde"),
    "ブロモバレリル": ("bromovaleryl", "bromovalerylurea", "bromisoval"),
    "ブロチゾラム": ("brotizolam", "lendormin", "WE-941"),
    "トケイソウエキス": ("passiflora incarnata", "passion flower", "maypop"),
    "ロゼレム": ("ramelteon", "rozerem", "TAK-375"),
    "ベルソムラ": ("suvorexant", "belsomra", "MK-4305"),
    "フルボキサミン": ("fluvoxamine", "luvox", "fluvoxamine maleate"),
    "タケキャブ": ("vonoprazan", "takecab", "TAK-438"),
    "デュビゴ": ("linaclotide", "linzess", "MD-1100"),
    "ランソプラゾール": ("lansoprazole", "prevacid", "AG-1749"),
    "クラリスロマイシン": ("clarithromycin", "biaxin", "TE-031"),
    "カルベジロール": ("carvedilol", "coreg", "BM-14190"),
    "バルサルタン": ("valsartan", "diovan", "CGP-48933"),
    "アスピリン": ("aspirin", "acetylsalicylic acid", "ASA"),
    "ワルファリン": ("warfarin", "coumadin", "warfarin sodium"),
    "シンバスタチン": ("simvastatin", "zocor", "MK-733"),
    "メトホルミン": ("metformin", "glucophage", "dimethylbiguanide"),
    "アトルバスタチン": ("atorvastatin", "lipitor", "CI-981"),
    "プラバスタチン": ("pravastatin", "pravachol", "CS-514"),
    "ロスバスタチン": ("rosuvastatin", "crestor", "ZD-4522"),
    "ピタバスタチン": ("pitavastatin", "livalo", "NK-104"),
    "ダビガトラン": ("dabigatran", "pradaxa", "BIBR-1048"),
    "リバーロキサバン": ("rivaroxaban", "xarelto", "BAY-59-7939"),
    "アピキサバン": ("apixaban", "eliquis", "BMS-562247"),
    "エドキサバン": ("edoxaban", "savaysa", "DU-176b"),
    "イブプロフェン": ("ibuprofen", "advil", "motrin"),
    "ロキソプロフェン": ("loxoprofen", "loxonin", "CS-600"),
    "ジクロフェナク": ("diclofenac", "voltaren", "GP-45840"),
    "アセトアミノフェン": ("acetaminophen", "paracetamol", "tylenol"),
    "カプトプリル": ("captopril", "capoten", "SQ-14225"),
    "エナラプリル": ("enalapril", "vasotec", "MK-421"),
    "リシノプリル": ("lisinopril", "prinivil", "MK-521"),
    "ロサルタン": ("losartan", "cozaar", "MK-954"),
    "カンデサルタン": ("candesartan", "atacand", "TCV-116"),
    "オルメサルタン": ("olmesartan", "benicar", "CS-866"),
    "プロプラノロール": ("propranolol", "inderal", "AY-64043"),
    "アテノロール": ("atenolol", "tenormin", "ICI-66082"),
    "ビソプロロール": ("bisoprolol", "zebeta", "EMD-33512"),
    "ニフェジピン": ("nifedipine", "adalat", "BAY-a-1040"),
    "アムロジピン": ("amlodipine", "norvasc", "UK-48340"),
    "ベラパミル": ("verapamil", "calan", "CP-16533"),
    "ジルチアゼム": ("diltiazem", "cardizem", "CRD-401"),
    "グリメピリド": ("glimepiride", "amaryl", "HOE-490"),
    "グリクラジド": ("gliclazide", "diamicron", "S-1702"),
    "シタグリプチン": ("sitagliptin", "januvia", "MK-0431"),
    "ビルダグリプチン": ("vildagliptin", "galvus", "LAF-237"),
    "リナグリプチン": ("linagliptin", "tradjenta", "BI-1356"),
    "アログリプチン": ("alogliptin", "nesina", "SYR-322"),
    "ダパグリフロジン": ("dapagliflozin", "forxiga", "BMS-512148"),
    "カナグリフロジン": ("canagliflozin", "invokana", "JNJ-28431754"),
    "エンパグリフロジン": ("empagliflozin", "jardiance", "BI-10773"),
    "エゼチミブ": ("ezetimibe", "zetia", "SCH-58235"),
    "ベザフィブラート": ("bezafibrate", "bezalip", "BM-15075"),
    "フェノフィブラート": ("fenofibrate", "tricor", "procetofen"),
    "ヘパリン": ("heparin", "heparin sodium"),
    "ダルテパリン": ("dalteparin", "fragmin", "FR-860"),
    "エノキサパリン": ("enoxaparin", "lovenox", "PK-10169"),
}
#: A shorter list, which parts of names find too.
VARIANTS = {
    "トリアゾラム": ("triazolam", "halcion"),
    "ジアゼパム": ("diazepam", "valium"),
    "クロナゼパム": ("clonazepam", "klonopin"),
    "アルプラゾラム": ("alprazolam", "xanax"),
    "ロラゼパム": ("lorazepam", "ativan"),
    "テマゼパム": ("temazepam", "restoril"),
    "ミダゾラム": ("midazolam", "versed"),
    "エスタゾラム": ("estazolam", "prosom"),
    "フルラゼパム": ("flurazepam", "dalmane"),
    "ニトラゼパム": ("nitrazepam", "mogadon"),
    "ブロマゼパム": ("bromazepam", "lexotan"),
    "クロチアゼパム": ("clotiazepam", "rize"),
    "クロキサゾラム": ("cloxazolam", "sepazon"),
    "エチゾラム": ("etizolam", "sedekopan"),
    "ブロチゾラム": ("brotizolam", "lendormin"),
    "ハロキサゾラム": ("haloxazolam", "somelin"),
    "メキサゾラム": ("mexazolam", "melex"),
    "オキサゾラム": ("oxazolam", "serenal"),
    "フルタゾラム": ("flutazolam", "coreminal"),
    "アスピリン": ("aspirin", "acetylsalicylic acid"),
    "イブプロフェン": ("ibuprofen", "advil", "motrin"),
    "ロキソプロフェン": ("loxoprofen", "loxonin"),
    "ジクロフェナク": ("diclofenac", "voltaren"),
    "アセトアミノフェン": ("acetaminophen", "paracetamol", "tylenol"),
    "ワルファリン": ("warfarin", "coumadin"),
    "ダビガトラン": ("dabigatran", "pradaxa"),
    "リバーロキサバン": ("rivaroxaban", "xarelto"),
    "アピキサバン": ("apixaban", "eliquis"),
    "シンバスタチン": ("simvastatin", "zocor"),
    "アトルバスタチン": ("atorvastatin", "lipitor"),
    "プラバスタチン": ("pravastatin", "pravachol"),
    "メトホルミン": ("metformin", "glucophage"),
    "インスリン": ("insulin",),
    "プレドニゾロン": ("prednisolone", "prednisone"),
    "アミオダロン": ("amiodarone", "cordarone"),
    "ジゴキシン": ("digoxin", "lanoxin"),
    "メトトレキサート": ("methotrexate", "trexall"),
    "フェノバルビタール": ("phenobarbital", "luminal"),
    "セコバルビタール": ("secobarbital", "seconal"),
    "ブトクタミド": ("butoctamide", "listomin"),
    "エソピクロン": ("eszopiclone", "lunesta"),
    "ゾルピデム": ("zolpidem", "ambien"),
    "ゾピクロン": ("zopiclone", "imovane"),
}
#: A label that holds one of these words is of no medicine.
NO_MEDICINES = (
    "earth", "wax", "oil", "acid", "silica", "silicon", "aluminum", "magnesium", "calcium", "sodium", "potassium", "chloride", "sulfate", "carbonate", "phosphate", "citrate", "stearate", "palmitate", "oleate", "laurate", "glycerin",
    "propylene", "polyethylene", "cellulose", "starch", "lactose", "sucrose", "sorbitol", "mannitol", "xylitol", "maltitol", "erythritol", "vanillin", "menthol", "camphor", "eucalyptus", "peppermint", "anise", "caraway", "cardamom",
    "cinnamon", "clove", "ginger", "lemon", "lime", "orange", "rose", "lavender", "jasmine", "ylang", "patchouli", "sandalwood", "cedar", "pine", "fir", "spruce", "birch", "maple", "oak", "walnut", "almond", "peanut", "soybean", "corn",
    "wheat", "rice", "barley", "oat", "rye", "millet", "sorghum", "quinoa", "buckwheat", "amaranth", "teff", "chickpea", "lentil", "bean", "pea", "carrot", "potato", "tomato", "onion", "garlic", "turmeric", "nutmeg", "black pepper",
    "white pepper", "red pepper", "chili", "paprika", "saffron", "safflower", "sunflower", "sesame", "poppy", "flax", "chia", "hemp", "coconut", "palm", "olive", "avocado", "grapeseed", "cottonseed", "rapeseed", "canola", "mustard",
    "castor", "jojoba", "argan", "shea", "cocoa", "coffee", "tea", "chamomile", "spearmint", "rosemary", "thyme", "oregano", "basil", "sage", "marjoram", "tarragon", "dill", "fennel", "coriander", "cumin", "fenugreek", "asafoetida",
    "sumac", "zaatar", "harissa", "berbere", "ras el hanout", "garam masala", "curry", "galangal", "lemongrass", "kaffir lime", "makrut lime", "calamansi", "yuzu", "sudachi", "kabosu", "shikuwasa", "tachibana", "mikan", "satsuma",
    "mandarin", "clementine", "tangerine", "pomelo", "grapefruit", "citron", "buddha hand", "fingered citron", "bergamot", "bitter orange", "sweet orange", "blood orange", "valencia orange", "navel orange", "seville orange", "moro orange",
    "tarocco orange", "sanguinello orange",
)
#: Ends of names (in kana) and what stands for them in English; the first that fits counts.
ENGLISH_ENDINGS = [("パム", 2, "pam"), ("ラム", 2, "lam"), ("ゾラム", 3, "zolam")]
#: Names that come first among the English ones.
COMMON = ("aspirin", "ibuprofen", "warfarin", "insulin", "metformin")
FORCED = [(("エソメプラゾル", "エソメプラゾール"), "ppi"), (("フルラゼパム",), "ssri_antidepressant")]
#: Parts of English names by category.
PATTERNS = {
    "benzodiazepine": ("pam", "lam", "zolam"), "barbiturate": ("barbital",), "opioid": ("morphine", "codeine", "fentanyl"), "nsaid": ("profen", "fenac", "aspirin"), "statin": ("statin",), "ace_inhibitor": ("pril",), "arb": ("sartan",), "beta_blocker": ("olol",),
    "ca_antagonist": ("dipine",), "diuretic": ("ide",), "pde5_inhibitor": ("afil",), "nitrate": ("nitrate", "nitro"), "arni": ("arni", "sacubitril"), "ca_antagonist_arb_combination": ("combination",), "p_cab": ("p-cab", "p cab"), "ppi": ("prazole",),
}
ENDINGS = ("錠", "カプセル", "散剤", "液剤", "注射剤", "mg", "g", "ml", "μg", "mcg")
BEGINNINGS = ("塩酸", "硫酸", "リン酸", "酢酸", "クエン酸")
#: Confidence: from 4 characters on, a category, 3 characters of the plain name, an English name, an ending, a beginning.
POINTS = {"length": 0.2, "category": 0.3, "plain": 0.2, "english": 0.1, "ending": 0.1, "beginning": 0.1}
#: Names are compared without brackets, blanks, digits and marks.
BARE_STEPS = [("regex", "（.*?）|\\(.*?\\)", ""), ("replace", "販売中止", ""), ("regex", "[ 　0-9０-９.．・,，、。()（）【】［］\\[\\]{}｛｝<>《》\"'\\-―ー=+*/\\\\]", ""), S.TRIM]


def _by_bare_key() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for k, v in ENGLISH_NAMES.items():
        out.setdefault(S.text(k, BARE_STEPS), v)
    return out


def words(xs) -> Column:
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def lists(table: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), words(v))))


def english_names(c: Column) -> Column:
    """The English names of a name, an empty array if there are none."""
    return F.coalesce(lists(_by_bare_key())[S.run(c, BARE_STEPS)], words(()))


def english_variants(c: Column) -> Column:
    """The names of the entry itself, those of entries that hold the name or that it holds, and one made from its ending; each once, in this order."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), words(v).alias("names")) for k, v in VARIANTS.items()))
    near = F.flatten(F.transform(F.filter(entries, lambda e: F.contains(e.key, c) | F.contains(c, e.key)), lambda e: e["names"]))
    made = None
    for ending, cut, english in reversed(ENGLISH_ENDINGS):
        own = F.array(F.concat(F.lower(F.substring(c, F.lit(1), F.length(c) - cut)), F.lit(english)))
        made = F.when(F.endswith(c, F.lit(ending)), own).otherwise(words(()) if made is None else made)
    return F.array_distinct(F.concat(F.coalesce(lists(VARIANTS)[c], words(())), near, made))


def analysed_category(c: Column) -> Column:
    """The ladder's category; some names have one of their own, whatever the ladder says."""
    out = C.ladder(c)
    for names, category in FORCED:
        out = F.when(S.any_of(c, names), category).otherwise(out)
    return out


def confidence(c: Column, category: Column, plain: Column, english: Column) -> Column:
    """The sum of the points that a name gets, in the order of POINTS, 1 at most."""
    ends = lambda xs, test: _any(test(c, F.lit(x)) for x in xs)
    got = (F.length(c) >= 4, category != "unknown", F.length(plain) >= 3, F.size(english) > 0, ends(ENDINGS, F.endswith), ends(BEGINNINGS, F.startswith))
    out = F.lit(0.0)
    for test, points in zip(got, POINTS.values()):
        out = out + F.when(test, points).otherwise(0.0)
    return F.least(out, F.lit(1.0))


def search_priority(c: Column, category: Column, plain: Column, english: Column, conf: Column) -> Column:
    """What to search for, best first: the name, its common English names (last one first), the plain name, other English
    names, parts by category, endings; as many as five times the confidence, three at most, none below 0.2."""
    none = words(())
    common = lambda x: F.lower(x).isin(*COMMON)
    some = lambda least, xs: F.when(conf >= least, xs).otherwise(none)
    first = some(0.4, F.array(c))
    known = some(0.5, F.reverse(F.filter(english, common)))
    bare = F.when((plain != c) & (conf >= 0.3), F.array(plain)).otherwise(none)
    more = some(0.5, F.filter(english, lambda x: ~common(x)))
    parts = some(0.6, F.coalesce(lists(PATTERNS)[category], none))
    endings = some(0.7, F.filter(words(ENDINGS), lambda x: F.endswith(c, x)))
    so_far = F.concat(first, known, bare, more)
    added = let(so_far, lambda a: F.concat(a, F.filter(parts, lambda x: ~F.array_contains(a, x))))
    whole = let(added, lambda a: F.concat(a, F.filter(endings, lambda x: ~F.array_contains(a, x))))
    return F.when(conf < 0.2, none).otherwise(F.slice(whole, 1, F.least(F.lit(3), F.floor(conf * 5).cast("int"))))


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def analysed(c: Column) -> Column:
    """(corrected, plain, category, english, confidence, priority) of a name: corrected first, and all else from that."""

    def rest(name: Column) -> Column:
        def points(x: Column) -> Column:
            conf = confidence(name, x["category"], x["plain"], x["english"])
            said = F.struct(*(x[f].alias(f) for f in ("corrected", "plain", "category", "english")), conf.alias("confidence"))
            return let(said, lambda y: F.struct(*(y[f].alias(f) for f in ("corrected", "plain", "category", "english", "confidence")), search_priority(name, y["category"], y["plain"], y["english"], y["confidence"]).alias("priority")))

        return let(F.struct(name.alias("corrected"), M.plain(name).alias("plain"), analysed_category(name).alias("category"), english_variants(name).alias("english")), points)

    return let(M.corrected(c), rest)


__all__ = ["analysed", "english_names", "english_variants", "search_priority"]
