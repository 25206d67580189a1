import random
import zlib

from basketry.llm import spelling


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def plain(counts, times=2):
    """{word: (form, root, n, n_near, form_n)} of {word: n} by comparing all words."""
    forms, out = {}, {}
    for w, n in counts.items():
        others = [(-m, o) for o, m in counts.items() if near(w, o)]
        best = min(others, default=None)
        if best and -best[0] >= times * n:
            forms[w] = best[1]
        out[w] = [forms.get(w), None, n, len(others), -best[0] if w in forms else None]
    for w in out:
        root = w
        while root in forms:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def result(spark, counts):
    words = [(w,) for w, n in counts.items() for _ in range(n)]
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(words, "word string")).collect()}


def test_random_words_against_all_pairs(spark):
    rng = random.Random(3)
    for letters in ("ab", "abcdefé"):  # many repeated bigrams, and few
        counts = {}
        for _ in range(60):
            w = "".join(rng.choice(letters) for _ in range(rng.randint(5, 9)))
            for _ in range(4):
                counts.setdefault(w, rng.choice([3, 3, 4, 7, 15, 40]))
                i, c = rng.randrange(len(w)), rng.choice(letters)
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
        counts = {w: n for w, n in counts.items() if len(w) >= 5}
        assert result(spark, counts) == plain(counts)


def test_edits_at_every_place(spark):
    counts = {"separation": 40}
    for i in range(10):
        counts |= {"separation"[:i] + "separation"[i + 1 :]: 3 + i, "separation"[:i] + "x" + "separation"[i:]: 3, "separation"[:i] + "é" + "separation"[i + 1 :]: 3}
    counts |= {"separationx": 3, "aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "abcde": 3, "abcdf": 3}
    got = result(spark, counts)
    assert got == plain(counts) and got["separation"][3] == 31 and got["aaaaa"][:2] == ("aaaaaa", "aaaaaaaa") and got["abcde"][0] is None


def test_runs_slips_and_edges(spark, tmp_path):
    texts = [(1, "Straße ÉTÉS étés 123 word's aaaa"), (None, "Hello hello HELLO"), (3, None), (4, ""), (5, "x" * 200_000 + " " + "hello " * 3), (5, "𝒳hello𝒳 naïve naïve naïve")]
    spark.createDataFrame([(*t, "a", 1) for t in texts], "doc_id long, text string, word string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    runs = sorted(r.word for r in spelling.runs(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect())
    assert runs == sorted(["straße", *["hello"] * 7, "x" * 200_000, *["naïve"] * 3])  # É stays É, so ÉTÉS has four letters alike but not equal: too short
    counts = {}
    for d, ws in [("", ["hello"] * 3), ("5", ["hello"] * 4 + ["naïve"] * 3)]:
        for w in ws:
            h = zlib.crc32(f"{d}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w
            counts[w] = counts.get(w, 0) + 1
    got = {r.word: r.n for r in spelling.op11(spark, str(tmp_path)).collect()}
    assert got == {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert spelling.op11(spark, f"{tmp_path}/none").count() == 0


def test_planted_slips(spark):
    words = [(d, w) for d in range(60) for w in ("winter", "naïveté", "separate", "étrange")]
    df = spark.createDataFrame(words, "doc_id long, w string")
    got = [r.s for r in df.select(spelling.planted_slips(df["w"], df["doc_id"]).alias("s")).collect()]
    want, slips = [], 0
    for d, w in words:
        h = zlib.crc32(f"{d}:{w}".encode())
        slips += h % 97 == 0
        want.append(w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w)
    assert got == want and slips
