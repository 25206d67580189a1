"""Packing of tokenized documents into sequences, order preserved, by dynamic programming.

Documents are dealt by ranges of doc_id and go through a partition in that order, in blocks of about BLOCK tokens that
end at a document's end. A block's tokens form one stream. It may be cut at document ends (free), after sentences (a
small penalty) and, where a stretch between those is longer than STRETCH tokens, inside it (a larger one). With
position p and best cost f, f(j) = min over i, p(j) - p(i) <= size, of f(i) + p(i) + (size - p(j)) + penalty(j): padding
plus penalties. The minimum runs over a sliding window, kept as a queue of rising costs, so each cut costs constant
time. What remains at a block's end is cut into powers of two, which need no padding, where that saves enough.

Defined results: a null or empty text is the end id alone; documents with equal ids stay next to each other; a
document longer than a block makes the block longer; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import small_batches

SIZE, BLOCK, STRETCH = 2048, 1 << 20, 32
AFTER_SENTENCE, INSIDE, TAIL = 2, 24, 64
#: So many words are kept with their ids.
CACHE = 400_000
#: Characters up to U+024F that stay there in lower case. Texts of these alone are split here; others go to the tokenizer whole.
PLAIN = "".join(c for c in map(chr, [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)]) if max(c.lower()) <= "\u024f")
ELSE = re.compile(f"[^{re.escape(PLAIN)}]|<\\|")
#: The tokenizer's own split, written for those characters.
SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ɏ0-9²³¹¼-¾]+")


class Words(dict):
    """word -> its ids as little-endian bytes, from the tokenizer's own stages when first asked for: a word is one piece of its split."""

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.model, self.bytes = tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        piece = word if word.isascii() else self.bytes.pre_tokenize_str(word)[0][0]
        out = self[word] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece)])
        return out


class Encoder:
    """Texts to ids, as bytes; with the end id. The tokenizer lower-cases and never joins across its split."""

    def __init__(self, path: str, end_id: int = 1):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), np.asarray([end_id], "<u4").tobytes()
        self.words = Words(self.tokenizer)
        vocab = self.tokenizer.get_vocab()
        self.stops = np.zeros(max([end_id, *vocab.values()]) + 1, bool)
        for token, i in vocab.items():
            self.stops[i] = bool(re.fullmatch(r"[.!?]+[\"')]*(</w>)?", token))

    def __call__(self, text) -> bytes:
        if not isinstance(text, str) or not text:
            return self.end
        if ELSE.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end
        return b"".join(map(self.words.__getitem__, SPLIT.findall(text.lower()))) + self.end


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_points(stops: np.ndarray, doc_ends: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, and each place's penalty. stops: whether a token ends a sentence."""
    n = int(doc_ends[-1])
    cost = np.full(n + 1, INSIDE, np.int64)
    cost[1:][stops] = AFTER_SENTENCE
    cost[doc_ends] = 0
    cost[0] = 0
    fine = np.flatnonzero(cost < INSIDE)
    gaps = np.diff(fine)
    wide = np.flatnonzero(gaps > stretch)
    more = [np.arange(fine[i] + stretch, fine[i + 1], stretch) for i in wide]
    at = np.unique(np.concatenate([fine, *more])) if more else fine
    return at, cost[at]


def best_cuts(at: list[int], cost: list[int], size: int) -> list[int]:
    """The cuts of least padding plus penalties, first and last place included."""
    m = len(at)
    f, came, keys = [0] * m, [0] * m, [0] * m
    queue, head = [0] * m, 0
    keys[0], tail = at[0], 1
    for j in range(1, m):
        p = at[j]
        while at[queue[head]] < p - size:
            head += 1
        i = queue[head]
        came[j] = i
        f[j] = keys[i] + size - p + cost[j]
        key = keys[j] = f[j] + p
        while tail > head and keys[queue[tail - 1]] >= key:
            tail -= 1
        queue[tail] = j
        tail += 1
    out, j = [at[-1]], m - 1
    while j:
        j = came[j]
        out.append(at[j])
    return out[::-1]


def windows(stops: np.ndarray, doc_ends: np.ndarray, size: int = SIZE) -> np.ndarray:
    at, cost = cut_points(stops, doc_ends, min(STRETCH, size))
    cuts = best_cuts(at.tolist(), cost.tolist(), size)
    left = cuts[-1] - cuts[-2]
    if size - left > TAIL:
        start, rest = cuts[-2], left
        cuts.pop()
        while rest:
            p = 1 << (rest.bit_length() - 1)
            start, rest = start + p, rest - p
            cuts.append(start)
    return np.asarray(cuts)


def pack(docs: DataFrame, path: str, size: int = SIZE, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (bytes, little-endian unsigned 32-bit) if asked for."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def pieces(held, first: int):
        data = b"".join(b for _, b in held)
        ends = np.cumsum([len(b) // 4 for _, b in held])
        cuts = windows(encoder(path).stops[np.frombuffer(data, "<u4")], ends, size)
        starts = np.union1d(cuts[:-1], np.concatenate([[0], ends[:-1]]))
        stops = np.append(starts[1:], ends[-1])
        doc, seq = np.searchsorted(ends, starts, "right"), np.searchsorted(cuts, starts, "right") - 1
        doc_start = ends - np.asarray([len(b) // 4 for _, b in held])
        bits = [data[a * 4 : b * 4] for a, b in zip(starts.tolist(), stops.tolist())]
        out = {
            "doc_id": pd.Series([held[i][0] for i in doc.tolist()], dtype=object), "start": starts - doc_start[doc], "length": stops - starts, "ids_crc32": [zlib.crc32(b) for b in bits],
            "doc_tokens": (ends - doc_start)[doc], "sequence_id": first + seq, "offset": starts - cuts[seq],
        }
        return pd.DataFrame(out | ({"ids": bits} if with_ids else {})), len(cuts) - 1

    arrow = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches):  # Arrow, as pandas would make ids beside a null floating
        encode, held, n = encoder(path), [], 0
        first = TaskContext.get().partitionId() << 32
        batch = lambda pdf: pa.RecordBatch.from_pandas(pdf, arrow, preserve_index=False)
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                held.append((doc_id, encode(text.as_py())))
                n += len(held[-1][1]) // 4
                if n >= block:
                    out, k = pieces(held, first)
                    yield batch(out)
                    first, held, n = first + k, [], 0
        if held:
            yield batch(pieces(held, first)[0])

    small_batches(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, fields)


def op3(spark, sf_dir: str) -> DataFrame:
    """All documents into sequences of 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
