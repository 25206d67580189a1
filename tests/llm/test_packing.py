import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from basketry.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, texts, size=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids, at = whole(texts[d]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = used = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        used += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / used


def test_documents_come_back_and_padding_is_small(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(packing.op3(spark, sf).collect(), texts) < 0.02


def test_ids_of_all_characters_that_are_split_here():
    """Every such character, and those whose lower case is one, in many neighbourhoods, against the tokenizer."""
    rng = random.Random(2)
    letters = [c for c in map(chr, [*range(9, 0x250), 0x2000, 0x200B, 0x212A, 0x212B, 0x1E9E, 0x301, 0x307]) if not 0xD800 <= ord(c) < 0xE000]
    encode, plain = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = [f"{a}an {c}{a}{c} 1{c}2 '{c}s" for c in letters for a in ("x", c.upper(), c.lower())] + ["Ɗan", "Ⱥb ƏƐ"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) for _ in range(6000)]
    texts += ["".join(rng.choice("aé's tTRrevmlLd19½ .!\n\t<|-ǅß") for _ in range(30)) for _ in range(3000)] + ["ab" * 500 + " " + "é!" * 300]
    for t in texts:
        assert encode(t) == np.asarray([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes(), t


def test_null_ids_clashing_names_and_documents_beyond_a_block(spark):
    rows = [(None, "One. " * 400, 1), (5, "Two words. " * 900, 2), (5, None, 3), (7, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset long")
    out = packing.pack(docs, PATH, size=64, block=256, with_ids=True).collect()
    text_of = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        text_of.setdefault((r.doc_id, r.doc_tokens), []).append(bytes(r.ids))
    assert sorted(len(b"".join(x)) // 4 for x in text_of.values()) == sorted(len(whole(t)) for _, t, _ in rows)


def test_odd_texts(spark):
    texts = {1: None, 2: "", 3: "Σας İ ß \x1c x", 4: "it's <|endoftext|> WE'LL 12 é ü...", 5: "a" * 30000, 6: "你好. é", 7: "Ends. " * 3000}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, start string")
    check(packing.pack(docs, PATH).collect(), texts)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_cuts_cost_no_more_than_any_others():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(5, 60))
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 8, n))]).tolist()
        cost = [0, *rng.integers(0, 9, n).tolist()]
        best = [0] + [10**9] * n
        for j in range(1, n + 1):
            for i in range(j):
                if at[j] - at[i] <= 16:
                    best[j] = min(best[j], best[i] + 16 - at[j] + at[i] + cost[j])
        cuts = packing.best_cuts(at, cost, 16)
        where = dict(zip(at, cost))
        assert sum(16 - b + a + where[b] for a, b in zip(cuts, cuts[1:])) == best[-1]
