"""Values worked out by hand."""

from pyspark.sql import functions as F

from basketry.functions import texts as T
from basketry.operators import lookup


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col.alias("x")).first().x


def test_blocks(spark):
    text = "head\n1【般】 aa\nbb\n 2 【外】cc\n【x】 dd\n"
    got = one(spark, text, T.numbered_blocks(F.col("t"), "般|外|麻|向"))
    assert [(b.number, b.content) for b in got] == [(1, "aa\nbb"), (2, "cc\n【x】 dd")]
    assert one(spark, "", T.numbered_blocks(F.col("t"))) == [] and one(spark, None, T.numbered_blocks(F.col("t"))) is None
    assert [b.number for b in one(spark, "7 a\n8 b", T.numbered_blocks(F.col("t")))] == [7, 8]


def test_marked_lines_and_triage(spark):
    line = "RP001: アムロジピン錠 5mg 1錠 7日分"
    assert one(spark, f"x\n{line}\ny", T.marked_lines(F.col("t"))) == [line] and one(spark, "x", T.marked_lines(F.col("t"))) == ["x"]
    a = one(spark, line, T.line_attributes(F.col("t")))
    assert (a.strength, a.size, a.qty, a.days, a.form) == ("5mg", None, "1錠", "7日分", "錠")
    judge = lambda n: one(spark, line, T.triage(F.col("t"), F.lit("a"), F.lit(n), F.lit(0.8), {"錠": ("錠",), "テープ": ("枚",)}, []))
    assert tuple(judge("a")) == (0.9, "auto_confirm") and tuple(judge("b")) == (0.84, "needs_review")


def test_command_json_numbers(spark):
    c = one(spark, "登録： a b→x、 y", T.command(F.col("t")))
    assert (c.name, c.key, c["values"]) == ("登録", "a b", ["x", "y"]) and one(spark, "no command", T.command(F.col("t"))) is None
    assert one(spark, 'x ```json\n{"k": 3}\n``` y', T.fenced_json(F.col("t"), "k int")).k == 3
    assert one(spark, "for 14 days", T.first_integer(F.col("t"))) == 14 and one(spark, "none", T.first_integer(F.col("t"))) is None
    assert one(spark, "abc", T.replace_fold(F.col("t"), [("a", "b"), ("bb", "c")])) == "cc"


def test_prefixes(spark):
    table = {"A06": "x", "A06AB": "y", "A02BC": "z", "A": "top"}
    assert one(spark, "A06AB06", lookup.longest_prefix(F.col("t"), table, (5, 3, 1))) == "y"
    assert one(spark, "A06AB06", lookup.first_prefix(F.col("t"), table, F.lit("none"))) == "x"
    assert one(spark, "A02BX", lookup.longest_prefix(F.col("t"), table, (5, 3, 1))) == "top"


def test_lookup_of_empty_and_null_names(spark):
    book = spark.createDataFrame([("abcd", "g", 0), ("abce", None, 1), ("", "h", 2), (None, "i", 3)], "drug_name string, generic_name string, ord int")
    asked = spark.createDataFrame([("abc",), ("g",), ("ab",), ("",), ("zzz",), (None,)], "q string")
    got = {r.q: (r.found, r.how) for r in lookup.exact_then_contains(asked, book).collect()}
    assert got == {"abc": ("abce", "contains"), "g": ("abcd", "exact"), "ab": (None, "none"), "": ("", "exact"), "zzz": (None, "none"), None: (None, "none")}
    assert lookup.exact_then_contains(asked, book.limit(0)).where("how <> 'none'").count() == 0


def test_fragments_against_a_plain_loop(spark):
    import random

    from basketry.operators import fragments

    pairs, rng = [("a", "b"), ("a", "c"), ("b", "b")], random.Random(3)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randrange(7))]) for i in range(60)] + [(60, [None, "a", "b"]), (61, None)]

    def plain(names):
        names, used, out = [x for x in names or [] if x is not None], set(), []
        for i, x in enumerate(names):
            if i not in used:
                j = next((j for j in range(i + 1, len(names)) if j not in used and (x, names[j]) in pairs), None)
                out.append(x + (names[j] if j is not None else ""))
                used.add(j)
        return list(dict.fromkeys(out))

    got = {r.i: r.x for r in spark.createDataFrame(rows, "i int, n array<string>").select("i", fragments.merged(F.col("n"), pairs).alias("x")).collect()}
    assert got == {i: plain(n) for i, n in rows}


def test_audit_lines(spark, tmp_path):
    from basketry.sources.tables import audit_lines

    path = tmp_path / "audit.log"
    path.write_text('t DRUG_PROCESSING: {"session_id": "s", "drugs": [{"generic": "a"}, {"generic": "b"}], "interactions": {"has_interactions": true}}\nx ERROR: bad\nother\nDRUG_PROCESSING: {broken\n')
    got = sorted((r.kind, r.session_id or "", len(r.drugs or []), r.has_interactions) for r in audit_lines(spark, str(path)).collect())
    assert got == [("error", "", 0, False), ("record", "", 0, False), ("record", "s", 2, True)]
