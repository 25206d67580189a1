import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from basketry.functions import strings as S
from basketry.operators import dedupe, pairs, rules
from basketry.plans import catalog
from basketry.sources import sinks, tables


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        cols = sorted(got.columns)
        a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
        assert a.equals(b)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ratios(spark):
    df = spark.createDataFrame([("abca", "ab"), ("ab", "abca"), ("aaaa", "a")], "a string, b string")
    assert [r[0] for r in df.select(S.char_overlap_ratio(F.col("a"), F.col("b"))).collect()] == [100, 66, 160]


def test_first_text_and_widths(spark):
    df = spark.createDataFrame([("", " ", "x"), (None, "b", "c")], "a string, b string, c string")
    assert [r[0] for r in df.select(S.first_text("a", "b", "c")).collect()] == ["x", "b"]
    wide = spark.createDataFrame([("ＡＢ１　ー―ｰ- あ",)], "s string")
    assert wide.select(S.half_width(F.col("s"))).first()[0] == "AB1ーーー-あ"
    assert wide.select(S.to_katakana(F.col("s"))).first()[0].endswith("ア")


def test_best_per_key_keeps_the_earliest_of_ties_and_the_first_place(spark):
    df = spark.createDataFrame([(1, 0, "k", 0.7), (1, 1, "k", 0.9), (1, 2, "k", 0.9), (1, 3, "j", 0.1)], "rx_id int, pos int, key string, score double")
    out = dedupe.best_per_key(df, ["rx_id", "key"], [F.desc("score"), F.col("pos")], "pos")
    assert sorted((r.key, r.pos, r.score) for r in out.collect()) == [("j", 3, 0.1), ("k", 0, 0.9)]


def test_combos(spark):
    df = spark.createDataFrame([(1, "t・a"), (1, "a"), (1, "m"), (2, "a")], "rx_id int, name string")
    assert sorted(map(tuple, dedupe.collapse_combos(df, "rx_id", "name", "・").collect())) == [(1, "m"), (1, "t・a"), (2, "a")]


def test_earlier_pair_rule_wins_in_both_directions(spark):
    df = spark.createDataFrame([(1, 0, "f"), (1, 1, "r")], "rx_id int, pos int, name string")
    out = pairs.apply_pair_rules(pairs.item_pairs(df, ["name"]), "name", [("r", "f", "no"), ("f", "r", "careful")])
    assert [r.risk for r in out.collect()] == ["no"]


def test_suppressed_rule(spark):
    items = spark.createDataFrame([(1, "e", "ACEI"), (1, "s", "ARNI"), (2, "e", "ACEI"), (2, "l", "ACEI")], "rx_id int, name string, tag string")
    both = [rules.Rule("contra", "all_of", ("ACEI", "ARNI"), priority=0), rules.Rule("overlap", "at_least", ("ACEI", "ARNI"), unless=("contra",))]
    assert sorted((r.rx_id, r.rule_id, r.targets) for r in rules.evaluate(items, both).collect()) == [(1, "contra", "e, s"), (2, "overlap", "e, l")]


def test_csv_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([("a", "g", "c", "x, y"), ("b", "h", "d", None)], tables.DICTIONARY)
    sinks.write_csv(df, str(tmp_path / "d"))
    got = tables.dictionary_csv(spark, [str(tmp_path / "none"), str(tmp_path / "d")])
    assert {r.drug_name: r.interactions for r in got.collect()}["a"] == ["x", "y"]
    old, new = (spark.createDataFrame(x, "k int, v string, ts int") for x in ([(1, "a", 1), (2, "b", 1)], [(1, "c", 2)]))
    assert sorted((r.k, r.v) for r in sinks.upsert_latest(old, new, ["k"], "ts").collect()) == [(1, "c"), (2, "b")]
