import random

from basketry.llm import jaccard

from .brute import jaccard_components


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_whole_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(jaccard.op6(spark, sf)) == sorted(jaccard_components(rows))


def near_copies(seed, n, words):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, words // 12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_copies_of_all_degrees(spark):
    texts = near_copies(1, 120, 90) + near_copies(2, 40, 300) + ["Some common line of five words here"] * 5
    texts += [None, "", " \t\n", "one", "One", "two words", "a b c d e", "A B C D E", "a b c d", "a  b c\td", "é É", "É é"]
    texts += [f"some common line of five words here {i} {i + 1} {i * 7}" for i in range(30)]
    rows = [(i * 3 % len(texts) if len(texts) % 3 else i, t) for i, t in enumerate(texts)] + [(5, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(jaccard_components(rows))
    assert got(jaccard.similarity_groups(docs)) == want
    assert got(jaccard.similarity_groups(docs, chunk_bytes=2000)) == want
    assert got(jaccard.similarity_groups(docs, chunk_bytes=20000, block=7)) == want


def test_long_texts_null_ids_and_the_reviewed_case(spark):
    a, u, b = near_copies(7, 1, 4000)[0], near_copies(8, 1, 90)[0], near_copies(9, 1, 90)[0]
    docs = spark.createDataFrame([(3, a), (5, a), (5, u), (7, b), (7, b), (None, a + " end")], "doc_id long, text string")
    for how in ({}, {"chunk_bytes": 500}):
        assert sorted(map(tuple, jaccard.one_of_each(docs, **how).collect())) == [(3, a), (5, u), (7, b)]
        rows = sorted((r.component_id, r.n_shingles) for r in jaccard.similarity_groups(docs, **how).collect())
        assert rows == [(3, 3996), (3, 3996), (3, 3997), (5, 86), (7, 86), (7, 86)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, rid string")
    assert jaccard.similarity_groups(docs).count() == 0 and jaccard.one_of_each(docs).columns == docs.columns


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = near_copies(3, 1, 90) + near_copies(4, 1, 90) + near_copies(5, 1, 90) + near_copies(6, 1, 90)
    rows = [(1, a, "x"), (1, a, "x"), (2, a + " more", "x")]  # a repeated row and a near copy
    rows += [(None, b, "x"), (None, b, "y"), (None, b + " more", "x")]  # a group without an id
    rows += [(None, c, "x"), (9, c, "x"), (9, c.upper(), "x")]  # nulls come last; two texts of one id
    rows += [(2, d, "x")]  # id 2 goes as a near copy, this text of it is like no other
    rows += [(None, None, "x"), (None, None, "x"), (4, "", "x"), (4, "", "x"), (4, None, "x")]  # linked with nothing
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for how in ({}, {"chunk_bytes": 700}):
        out = jaccard.one_of_each(docs, **how)
        assert out.columns == docs.columns
        left = [(r.doc_id, r.text) for r in out.collect()]
        assert left.count((1, a)) == 1 and left.count((2, d)) == 1 and (2, a + " more") not in left
        assert sum(x in ((None, b), (None, b + " more")) for x in left) == 1
        assert (None, c) not in left and left.count((9, c)) + left.count((9, c.upper())) == 1
        assert [left.count(x) for x in ((None, None), (4, ""), (4, None))] == [2, 2, 1]
        assert len(left) == 9
