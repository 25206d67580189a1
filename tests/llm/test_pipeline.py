import corpus_pipeline

from basketry.llm import decontam, langid, pii

from .brute import jaccard_components


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == first.columns
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        kept, had = {r.doc_id: r for r in out.collect()} if i < 4 else {}, {r.doc_id: r.text for r in docs.collect()}
        if i == 0:
            judge = langid.Classifier(langid.contract_dicts(docs))
            want = {d for d, t in had.items() if (x := judge(t))[0] != "und" and x[2] >= langid.MARGIN}
            assert set(kept) == want and len(want) > 0.9 * len(had)
        if i == 1:
            assert set(kept) == {d for d, _, c in jaccard_components(list(had.items())) if d == c}
        if i == 2:
            bad = {r.doc_id for r in decontam.scan(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")).where(decontam.contaminated()).collect()}
            assert set(kept) == set(had) - bad
        if i == 3:
            assert set(kept) == set(had) and not any(pii.base_spans(r.text) for r in kept.values())
            assert all(r.text == had[d] for d, r in kept.items() if not pii.base_spans(had[d]))
        if i == 4:
            pieces = {}
            for r in out.collect():
                pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
            assert set(pieces) == set(had)
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_an_empty_table_and_columns_that_clash(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "one two three four five six seven " * 9, "en", "s", 9, 1.5, "x"), (None, None, None, None, None, None, None), (2, "", "en", "s", 0, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string")
    for df in (docs, docs.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            df = stage(spark, df, str(tmp_path))
            assert i == 4 or df.columns == docs.columns
            df = spark.createDataFrame(df.collect(), df.schema)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_keep_columns_of_any_name(spark):
    names = ["_own", "_id", "_digest", "kept", "own", "own_id", "cut_id", "digest", "row", "rid", "rep", "n", "first", "stays"]
    rows = [(i % 4, "one two three four five six seven " * 3 if i < 3 else f"text {i % 5}", *range(i, i + len(names))) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    kept = sorted(map(tuple, out.collect()))
    assert out.columns == docs.columns and set(kept) <= set(rows) and len(set(r[1] for r in kept)) == len(kept) and {r[1] for r in kept} == {r[1] for r in rows}
    assert rows[0] in kept and rows[1] not in kept and rows[2] not in kept
