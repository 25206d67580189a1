"""What must not be worked out for every row of a large table, and what must not grow with it."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from basketry.operators import fragments, rules
from basketry.plans import pool
from basketry.sources import pictures


def test_a_filter_on_what_a_name_gives_is_not_worked_out_for_every_row(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(x):
        calls.add(1)
        return None if x == "n0" else x.upper()

    rows = spark.range(4000).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id") % 4).alias("name"))
    out = pool.per_name(rows, lambda d: d.select("name", slow("name").alias("b"))).where("b IS NOT NULL")
    assert out.count() == 3000 and calls.value < 100


def joined_by_name(spark, sf, query):
    """The query's plan: the table of names, worked out once each, on one side of a join."""
    plan = entry.queries()[query](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "collect_list" in plan
    return plan.split("Join Inner")[1]


def test_names_in_blocks_are_looked_for_once_for_each_name(spark, sf):
    rows, known = joined_by_name(spark, sf, "block_names").split("Aggregate", 1)
    assert "regexp_extract_all" in known and "regexp_extract_all" not in rows


def test_pattern_candidates_are_looked_for_once_for_each_name(spark, sf):
    rows, known = joined_by_name(spark, sf, "pattern_candidates").split("Aggregate", 1)
    assert "regexp_extract_all" in known and "regexp_extract_all" not in rows


def test_items_of_a_report_are_not_shuffled_by_a_few_names(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # small tables stand for large ones
    try:
        plan = entry.queries()["interaction_report"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [name#" not in plan and "BroadcastHashJoin [name#" in plan


def test_rules_of_more_tags_than_a_number_has_bits(spark):
    own = [f"t{i}" for i in range(130)]
    all_rules = [rules.Rule("all", "all_of", tuple(own[60:130])), rules.Rule("sum", "tag_sum", (own[0], own[129]), least=3), rules.Rule("least", "at_least", (own[62], own[63]), unless=("all",)), rules.Rule("none", "any_any", (own[1],), (own[128],), without=(own[5],))]
    items = [(1, "a", t) for t in own] + [(1, "b", own[0]), (1, "b", own[0]), (2, "a", own[62]), (2, "b", own[63]), (2, "b", "other"), (3, "c", own[1]), (3, "d", own[128]), (3, None, own[5]), (3, "e", None)]
    got = rules.evaluate(spark.createDataFrame(items, "rx_id int, name string, tag string"), all_rules).collect()
    assert sorted((r.rx_id, r.rule_id, r.targets) for r in got) == [(1, "all", "a"), (1, "sum", "a, b"), (2, "least", "a, b"), (3, "none", "c, d")]


def test_lines_of_prescriptions_are_read_once_for_each_different_line(spark, sf):
    plan = entry.queries()["prescription_diagnosis"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(raw" not in plan and "nfkc" not in plan


def test_texts_of_prescriptions_are_made_and_cut_once(spark, sf):
    plan = entry.queries()["prescription_diagnosis"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "split(" not in plan and "Window" not in plan


def test_a_reported_pair_is_made_once_for_all_equal_reports(spark, sf):
    plan = entry.queries()["reported_pair_findings"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1
    copies, made = plan.split("Generate explode(sequence", 1)
    assert "concat_ws" not in copies and "concat_ws" in made


def test_items_are_not_shuffled_by_name_for_their_tags(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["medicine_tag_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [name#" not in plan and "BroadcastHashJoin [name#" in plan


def test_a_list_of_cut_names_is_cleaned_once_and_not_for_each_pair(spark):
    pairs = [(f"a{i}", f"b{i}") for i in range(300)]
    odd = spark.createDataFrame([(["a0", "a0", "b0", "b0", "b0"],), ([],), (None,), ([None],)], "n array<string>")
    assert [r.m for r in odd.select(fragments.merged(F.col("n"), pairs).alias("m")).collect()] == [["a0b0", "b0"], [], [], []]
    plan = odd.select(fragments.merged(F.col("n"), pairs).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(n#") == 1


def test_measures_of_pictures_that_are_not_asked_for_are_not_worked_out(spark, monkeypatch):
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(pictures, "skew", never)
    monkeypatch.setattr(pictures, "edge_pixels", never)
    picture = b"P5 2 1 255\n" + bytes([10, 30])
    assert pictures.measures(picture, ("width", "height", "spread", "brightness")) == (2, 1, 10.0, 20.0)
    rows = spark.createDataFrame([(1, bytearray(picture)), (2, None), (3, bytearray(b"no"))], "id int, content binary")
    got = {r.id: tuple(r.m) for r in pictures.measured(rows, column="m", asked=("brightness", "width")).collect()}
    assert got == {1: (20.0, 2), 2: (None, None), 3: (None, None)}
