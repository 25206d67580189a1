"""Chunks of documents, sorted runs of 64-bit hashes, and the trips between them.

Corpora have far more windows than rows that Spark should sort one by one. Here a chunk (some MB of whole documents)
passes on one sorted, delta-coded array of its distinct hashes for each bucket of the hash space; a bucket merges the
arrays of all chunks and answers each chunk with the hashes it asked to know of. A hash that all documents share is
sent once a chunk. Chunks have a bounded size (one document at least), and the number of buckets follows the number of
chunks, so that a bucket's share stays about as large as a chunk's.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import free_shuffles, small_batches, written

CHUNK_BYTES, IDX_BITS = 2 << 20, 20
MASK = (1 << 64) - 1
#: Odd multiplier of the rolling hash and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def pack_blob(ids: list, texts: list[bytes]) -> bytes:
    return zstandard.compress(pickle.dumps((ids, [len(t) for t in texts], b"".join(texts)), 5), 3)


class Chunk:
    """ids, data (all texts joined), starts and ends of the texts in data."""

    def __init__(self, blob: bytes):
        self._put(*pickle.loads(zstandard.decompress(blob)))

    @classmethod
    def of(cls, texts: list[bytes]) -> Chunk:
        """A chunk of texts without ids, never packed."""
        out = cls.__new__(cls)
        out._put([None] * len(texts), [len(t) for t in texts], b"".join(texts))
        return out

    def _put(self, ids: list, lens: list, data: bytes):
        self.ids, self.data = ids, data
        self.ends = np.cumsum(np.asarray(lens, np.int64))
        self.starts = self.ends - np.asarray(lens, np.int64)

    def __len__(self):
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def write_chunks(docs: DataFrame, ordered: bool = False, chunk_bytes: int = CHUNK_BYTES, base: int = 0) -> DataFrame:
    """docs (doc_id, text; null is empty) -> a written table (chunk, blob). Chunk numbers start at base.

    ordered: chunks follow each other by doc_id, nulls first, and equal ids share a chunk; texts travel compressed.
    """
    small_batches(docs.sparkSession)
    if ordered:
        kind = docs.schema["doc_id"].dataType

        def squeeze(batches):
            pack = zstandard.ZstdCompressor(level=1)
            for b in batches:
                texts = [pack.compress((t or "").encode()) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

        docs = docs.select("doc_id", "text").mapInArrow(squeeze, f"doc_id {kind.simpleString()}, text binary").repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        first, k, ids, texts, n = base + (TaskContext.get().partitionId() << 20), 0, [], [], 0
        unpack = zstandard.ZstdDecompressor()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([first + k], pa.int64()), pa.array([pack_blob(ids, texts)], pa.binary())], ["chunk", "blob"])

        for b in batches:
            for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                if n >= chunk_bytes and not (ordered and doc_id == ids[-1]) or len(ids) == (1 << IDX_BITS) - 1:
                    yield flush()
                    k, ids, texts, n = k + 1, [], [], 0
                t = unpack.decompress(t.as_py()) if ordered else (t.as_py() or "").encode()
                ids.append(doc_id)
                texts.append(t)
                n += len(t)
        if ids:
            yield flush()

    out = written(docs.select("doc_id", "text").mapInArrow(run, "chunk long, blob binary"), "chunks")
    del docs
    if ordered:
        free_shuffles(out.sparkSession)
    return out


def bucket_bits(chunks: DataFrame) -> int:
    return max(4, int(chunks.count()).bit_length() - 1)


# Sorted hashes as bytes


def encode_sorted(a: np.ndarray) -> bytes:
    """Sorted uint64 values as differences, byte planes apart, compressed."""
    d = np.diff(a, prepend=np.uint64(0))
    planes = d.view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(len(a).to_bytes(8, "little") + planes.tobytes(), 1)


def decode_sorted(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=8).reshape(8, n).T).reshape(-1).view(np.uint64))


def by_bucket(a: np.ndarray, bits: int):
    """Of sorted hashes: (bucket, first, stop) for each bucket that has some."""
    edges = np.searchsorted(a, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = np.concatenate([[0], edges, [len(a)]])
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), int(edges[b]), int(edges[b + 1])


def contains(run: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Whether each value of a is in the sorted run."""
    if not len(run):
        return np.zeros(len(a), bool)
    return run[np.minimum(np.searchsorted(run, a), len(run) - 1)] == a


# Rolling hashes


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i for i < n (or more), modulo 2 ** 64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got, m = np.ones(1, np.uint64), 1
        while m < max(n, CHUNK_BYTES):
            got = np.concatenate([got, got * np.uint64(pow(base, m, 1 << 64))])
            m *= 2
        _powers[base] = got
    return got


class Rolling:
    """Hashes of any byte ranges of data in constant time each."""

    def __init__(self, data: np.ndarray, codes: np.ndarray = BYTE_CODES):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * powers(BASE, len(data))[: len(data)], out=self.sums[1:])
        self.back = powers(INVERSE, len(data) + 1)

    def __call__(self, start, stop) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.back[start]


BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class WordTable:
    """Words of a chunk between blanks (space, \\t to \\r): hash, document, place of each."""

    def __init__(self, chunk: Chunk, lower: bool):
        arr = np.frombuffer(chunk.data, np.uint8)
        if lower:
            arr = LOWER[arr]
        inside = ~BLANK[arr]
        begin, last = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = chunk.starts < chunk.ends
        begin[chunk.starts[full]] = inside[chunk.starts[full]]
        last[chunk.ends[full] - 1] = inside[chunk.ends[full] - 1]
        start, stop = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.hash = mix(Rolling(arr)(start, stop) + (stop - start).astype(np.uint64))
        self.doc = np.searchsorted(chunk.ends, start, "right")
        self.first = np.searchsorted(start, chunk.starts)  # of each document
        self.stop = np.searchsorted(start, chunk.ends)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where size consecutive words of one document start, and the hash of each such window."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[k : k + n]
        return at, mix(h[at])


def send_runs(chunks: DataFrame, hashes, bits: int) -> DataFrame:
    """(bucket, chunk, blob, extra): hashes(chunk) gives a chunk's sorted distinct hashes and an array beside them or None."""

    def run(batches):
        for pdf in batches:
            for number, blob in zip(pdf["chunk"], pdf["blob"]):
                a, more = hashes(Chunk(blob))
                rows = [(b, number, encode_sorted(a[s:e]), None if more is None else zstandard.compress(more[s:e].tobytes(), 1)) for b, s, e in by_bucket(a, bits)]
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "blob", "extra"])

    return chunks.mapInPandas(run, "bucket int, chunk long, blob binary, extra binary")


def at_chunks(chunks: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """fn(number, Chunk, pandas frame of the answers to it) -> frames or None; every chunk gets a call."""

    def run(key, left, right):
        out = [x for blob in left["blob"] for x in fn(int(key[0]), Chunk(blob), right) if len(x)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, schema)
