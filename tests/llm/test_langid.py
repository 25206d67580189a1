from pyspark.sql import functions as F

from basketry.llm import langid


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs.select("doc_id", "text", "lang"), langid.contract_dicts(docs)).where(langid.held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    rows = got.select("lang", "lang_pred", "score").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_learns_nothing_from_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = docs.withColumn("text", F.when(langid.held_out(), "zz yy xx").otherwise(F.col("text"))).withColumn("lang", F.when(langid.held_out(), "zz").otherwise(F.col("lang")))
    assert langid.contract_dicts(docs) == langid.contract_dicts(changed)


def test_nulls_empty_long_and_repeated_texts(spark):
    rows = [(1, None, "de"), (2, "", "de"), (3, "12 34 !", "fr"), (4, "und der die das nicht " * 40_000, "de"), (5, "le la les des une est", "fr"), (5, "le la les des une est", "fr"), (None, "und der die das nicht", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    taught = spark.createDataFrame([("und der die das nicht ein", "de"), ("le la les des une est dans", "fr"), (None, "fr"), ("x", None)], "text string, lang string")
    dicts = langid.learn(taught)
    assert langid.learn(taught.limit(0)) == {} and sorted(langid.learn(taught, max_langs=1)) in (['de'], ['fr'])
    assert sorted(dicts) == ["de", "fr"]
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(docs, dicts).collect()]
    assert sorted(got[:3]) == [(1, "und", True), (2, "und", True), (3, "und", True)]
    assert got[3][1] == "de" and got[4] == got[5] and got[4][1] == "fr" and got[6][1] == "de"
    assert langid.identify(docs.limit(0), dicts).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_against_a_plain_version(spark, sf):
    """Every text, cut and compressed one block after the other without any of the module's classes."""
    import re
    import unicodedata

    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    dicts = langid.contract_dicts(docs)
    assert sorted(dicts) == sorted({r.lang for r in docs.collect() if r.lang}) and all(0 < len(d) <= langid.DICT_BYTES for d in dicts.values())

    def size(lang, data):
        how = zstandard.ZstdCompressionParameters.from_level(3, source_size=4096 + 512, dict_size=len(dicts[lang]), write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS, min_match=3, strategy=zstandard.STRATEGY_BTOPT)
        words = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=how)
        return sum(len(zstandard.ZstdCompressor(dict_data=words, compression_params=how).compress(b" " * 512 + data[i : i + 4096])) for i in range(0, len(data), 4096))

    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.op4(spark, sf).collect()}
    for r in docs.collect()[::3]:
        low = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (r.text or "").lower())
        data = re.sub(" +", " ", low).encode()
        if not data.strip():
            assert got[r.doc_id] == ("und", 0.0)
            continue
        sizes = sorted((size(lang, data), lang) for lang in dicts)
        score = min(1.0, 0.5 + 5 * (sizes[1][0] - sizes[0][0]) / sizes[1][0])
        assert got[r.doc_id] == (sizes[0][1], score)


def test_clashing_names_nulls_in_other_columns_and_a_bounded_whole_sample(spark):
    rows = [(1 << 60, "und der die das nicht ein", "a", 1.5, True), (None, "le la les des une est", None, None, None), (7, None, "c", 2.5, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double, rejected boolean")
    dicts = {"de": b"und der die das nicht ein", "fr": b"le la les des une est dans"}
    out = {r.doc_id: r for r in langid.identify(docs, dicts).collect()}
    assert out[1 << 60].lang_pred == "de" and out[1 << 60].in_lang_pred == "a" and out[1 << 60].in_score == 1.5 and out[1 << 60].in_rejected is True
    assert out[None].lang_pred == "fr" and out[None].in_score is None and out[7].rejected is True and out[7].in_rejected is False
    kept = langid.accepted(docs, dicts)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([r for r in rows if r[0] != 7], key=str)
    taught = spark.createDataFrame([("a" * 300 + " zz " + f"end{i}", "x") for i in range(50)], "text string, lang string")
    assert len(langid.learn(taught, max_texts=5)["x"].split(b"end")) <= 6 and b"end" in langid.learn(taught, dict_bytes=10**6)["x"]
