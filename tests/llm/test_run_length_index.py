import hashlib
import random

import numpy as np

from basketry.llm import run_length_index as rli

from .brute import repeated_bytes


def got(df):
    return sorted((r.doc_id, r.n_bytes, sum(b - a for a, b in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(80):
        texts = [[rng.randrange(1, 3) for _ in range(rng.randrange(0, 30))] * rng.randrange(1, 3) for _ in range(rng.randrange(1, 6))]
        texts += texts[: rng.randrange(2)]
        t = np.asarray([x for own in texts for x in [*own, 0]], np.uint16)
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1
        want = []
        for i in range(len(t)):
            best = 0
            for j in range(len(t)):
                n = 0
                while i != j and max(i, j) + n < len(t) and t[i + n] == t[j + n]:
                    n += 1
                best = max(best, n)
            want.append(best if t[i] else 0)
        index = rli.RunLengthIndex(t, ends)
        assert index.matching_statistics().tolist() == want and index.lengths.sum() == len(t)


def test_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = rli.op1(spark, sf).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == sorted(repeated_bytes(rows))


def test_passages_periods_and_many_contexts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(30), "very common line "
    texts = [None, "", "x", "ab" * 90, "ab" * 40 + text(30), passage, passage, passage[5:90], line * 12]
    texts += [text(rng.randrange(0, 25)) + passage[rng.randrange(60) : 60 + rng.randrange(60, 120)] + text(rng.randrange(0, 25)) for _ in range(40)]
    texts += [text(20) + line * rng.randrange(1, 9) for _ in range(10)] + [text(60)] * 2 + [text(25) + "\0" * 70 + text(10)]
    rows = [(i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, chunk_bytes in ((512, 1 << 20), (512, 700), (3, 1500)):
        assert got(rli.remove_repeats(docs, k=50, g=8, hot=hot, chunk_bytes=chunk_bytes, index_bytes=2000)) == sorted(repeated_bytes(rows, 50))


def test_texts_beyond_a_chunk_null_ids_and_clashing_names(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(500)
    long = text(5000) + passage + text(5000)
    rows = [(None, long, 1), (1, passage + "x" * 10, 2), (None, None, 3), (2, long[:300], 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    key = lambda x: (x[0] is None, x)
    want = sorted(repeated_bytes([r[:2] for r in rows]), key=key)
    out = rli.remove_repeats(docs, chunk_bytes=1000).collect()
    assert sorted(((r.doc_id, r.n_bytes, sum(b - a for a, b in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out), key=key) == want


def test_empty_table(spark):
    assert rli.remove_repeats(spark.createDataFrame([], "doc_id long, text string, spans int")).count() == 0
