import hashlib
import math
from collections import Counter

import numpy as np

from basketry.llm import digest


def test_entropy_steps():
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.integers(0, 4, 200), rng.integers(0, 255, 300), np.zeros(100, int)]).astype(np.uint8)
    got = digest.entropy_steps(data)
    for i in range(len(data) - 63):
        c = Counter(data[i : i + 64].tolist()).values()
        assert abs(got[i] - 1000 * sum(x * math.log2(x) for x in c) / 384) <= 1.01


def test_whole_documents_and_neighbours(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = dict(docs.collect())
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, [*ids[1:], ids[0]]))
    rows = {r.doc_id: r for r in digest.op7(spark, sf).collect()}
    assert sorted(rows) == sorted(texts)
    by_text = {}
    for d, r in rows.items():
        t, o = texts[d], texts[after[d]]
        e = t[: len(t) - len(t) // 2] + o[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        a, b, c = (digest.of_text(x) for x in (r.fingerprint, r.edited_fingerprint, rows[after[d]].fingerprint))
        assert r.near_edited == digest.likeness(a, b) and r.near_next == digest.likeness(a, c)
    long = [r for r in rows.values() if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > 0.3 and np.mean([r.near_next for r in long]) < 0.15


def test_odd_texts_and_small_chunks(spark):
    rows = [(1, None), (2, ""), (3, "é"), (4, "x" * 70), (4, "ab" * 500), (9, "short text"), (10, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(tuple, digest.fingerprints_with_edits(docs, n).collect())) for n in (1, 1 << 20)]
    assert got[0] == got[1] and len(got[0]) == 7
    assert got[0][0][3] == got[0][1][3] == "" and got[0][5][3] == got[0][6][3]
    assert digest.fingerprints_with_edits(docs.limit(0)).count() == 0


def plain_chain(text, ranks):
    """The filters of one text with plain loops: ranks of windows, points, hashes, bits."""
    b, mask = text.encode(), (1 << 64) - 1

    def mixed(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & mask
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    base = 0x9E3779B97F4A7C15
    code = [mixed((i + 1) * base & mask) for i in range(256)]
    own_hash = lambda x: sum(code[c] * pow(base, i, 1 << 64) for i, c in enumerate(x)) & mask
    part = lambda n: round(n * math.log2(n) * (1 << 20)) if n else 0
    windows = [b[i : i + 64] for i in range(len(b) - 63)]
    rank = [int(ranks[sum(map(part, Counter(w).values())) * 1000 // part(64)]) for w in windows]
    points, last, picks = 0, None, []
    for i in range(len(rank) - 63):
        at = min(range(i, i + 64), key=lambda j: (rank[j], j))
        if at != last:
            if last is not None and points >= 16:
                picks.append(last)
            points, last = 0, at
        points += 1
    if last is not None and points >= 16:
        picks.append(last)
    if picks:
        hashes = [mixed(own_hash(windows[i])) for i in picks]
    elif windows:
        hashes = [mixed(own_hash(windows[min(range(len(rank)), key=lambda j: (rank[j], j))]))]
    else:
        hashes = [mixed(own_hash(b) + len(b) & mask)] if b else []
    hashes = list(dict.fromkeys(hashes))
    out = []
    for i in range(0, len(hashes), 160):
        bits = [0] * 2048
        for h in hashes[i : i + 160]:
            for k in range(5):
                bits[h >> 11 * k & 2047] = 1
        out.append(np.packbits(np.asarray(bits, np.uint8)).tobytes())
    return b"".join(out)


def test_construction_against_a_plain_version():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeé ñ1.")) for _ in range(6)) for _ in range(60)]
    texts = ["", "x", "é" * 20, "ab" * 40, "z" * 300, *(" ".join(rng.choice(words, n)) for n in (9, 11, 18, 25, 60, 300))]
    ranks = np.empty(digest.STEPS + 1, np.int64)
    ranks[rng.permutation(digest.STEPS + 1)] = np.arange(digest.STEPS + 1)
    got = digest.features([t.encode() for t in texts], ranks)
    assert [digest.filters(x).tobytes() for x in got] == [plain_chain(t, ranks) for t in texts]


def test_a_column_called_fingerprint_is_set_apart(spark):
    docs = spark.createDataFrame([("mine", "text " * 40, 1), (None, None, 2)], "fingerprint string, text string, in_fingerprint int")
    out = digest.fingerprint_texts(docs, np.arange(digest.STEPS + 1))
    assert out.columns == ["in_in_fingerprint", "text", "in_fingerprint", "fingerprint"]
    assert sorted(((r[0], r[2], bool(r[3])) for r in out.collect()), key=str) == [("mine", 1, True), (None, 2, False)]
