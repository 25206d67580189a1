"""Document fingerprints from improbable features.

Every 64-byte window of a text has an entropy, in integer steps that don't depend on where the window is. How rare a
step is among all windows of the corpus is its rank. Where windows are read 64 at a time, the rarest gets a point
(the first of equal ones); those with enough points are a text's features. A feature sets five bits of a Bloom filter
of 2048 bits; after 160 features the next filter of the chain begins. Two fingerprints are compared filter by filter:
bits in common beyond those expected by chance, as a share of what there could be, the best for each filter of the
shorter chain, averaged.

Defined results: null counts as empty; an empty text has an empty fingerprint, whose likeness is 1 to another empty
one and else 0; a text of less than 64 bytes is one feature; a text without a window that has enough points takes its
rarest; equal texts have equal fingerprints; equal ids are ordered by the bytes of their texts.
"""

from __future__ import annotations

import base64
import hashlib
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .chunks import CHUNK_BYTES, Rolling, mix
from .run_length_index import sliding_min
from .shared import set_apart, small, small_batches, written

SIZE, POINTS, FULL, BITS, STEPS = 64, 16, 160, 2048, 1000
#: c * log2(c) in integers, so that sums are exact.
PART = np.concatenate([[0], np.rint(np.arange(1, SIZE + 2) * np.log2(np.arange(1, SIZE + 2)) * (1 << 20))]).astype(np.int64)
GAIN = np.diff(PART)


def entropy_steps(data: np.ndarray) -> np.ndarray:
    """For each 64-byte window its entropy in STEPS steps, 0 for the most mixed. One pass: a byte enters, a byte leaves."""
    n = len(data)
    if n < SIZE:
        return np.empty(0, np.int64)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (n + SIZE) + order
    place = np.arange(n)
    ahead, back = np.empty(n, np.int64), np.empty(n, np.int64)
    back[order] = place - np.searchsorted(key, key - (SIZE - 1))  # equal bytes among the 63 before
    ahead[order] = np.searchsorted(key, key + (SIZE - 1), "right") - place - 1  # and behind
    total = np.cumsum(GAIN[back])
    total[SIZE:] -= np.cumsum(GAIN[ahead])[:-SIZE]
    return total[SIZE - 1 :] * STEPS // int(PART[SIZE])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends


def step_counts(texts: list[bytes]) -> np.ndarray:
    data, starts, ends = joined(texts)
    steps = entropy_steps(data)
    inside = np.zeros(len(data) + 1, np.int8)
    long = ends - starts >= SIZE
    inside[starts[long]] += 1
    inside[ends[long] - SIZE + 1] -= 1
    return np.bincount(steps[np.cumsum(inside)[: len(steps)] > 0], minlength=STEPS + 1)


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The feature hashes of each text, in the order of their places."""
    data, starts, ends = joined(texts)
    out = [np.empty(0, np.uint64)] * len(texts)
    if not len(data):
        return out
    rolling = Rolling(data)
    rank = ranks[entropy_steps(data)].astype(np.uint64)
    low = np.uint64(max(1, int(len(data)).bit_length()))
    both = (rank << low) | np.arange(len(rank), dtype=np.uint64)
    picks = np.empty(0, np.int64)
    if len(both) >= SIZE:
        inside = np.zeros(len(data) + 1, np.int8)
        long = ends - starts >= 2 * SIZE - 1
        inside[starts[long]] += 1
        inside[ends[long] - 2 * SIZE + 2] -= 1
        least = sliding_min(both, SIZE)
        at = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
        pick = (least[at] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]])) if len(pick) else np.empty(0, np.int64)
        picks = pick[new][np.diff(np.append(new, len(pick))) >= POINTS]
    first, stop = np.searchsorted(picks, starts), np.searchsorted(picks, ends)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        if first[i] < stop[i]:
            own = picks[first[i] : stop[i]]
            out[i] = rolling(own, own + SIZE)
        elif e - s >= SIZE:
            at = s + int(rank[s : e - SIZE + 1].argmin())
            out[i] = rolling(np.asarray([at]), np.asarray([at + SIZE]))
        elif e > s:
            out[i] = rolling(np.asarray([s]), np.asarray([e])) + np.uint64(e - s)
    return [mix(x) for x in out]


def filters(hashes: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters, a row of 32 words each."""
    if not len(hashes):
        return np.empty((0, BITS // 64), np.uint64)
    own = hashes[np.sort(np.unique(hashes, return_index=True)[1])]
    chain = np.arange(len(own)) // FULL * BITS
    bits = np.zeros((int(chain[-1]) // BITS + 1) * BITS, np.uint8)
    for k in range(5):
        bits[chain + ((own >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64).reshape(-1, BITS // 64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
    best = []
    for f, n in zip(a, na):
        common = np.bitwise_count(b & f).sum(1, dtype=np.int64)
        chance, most = n * nb / BITS, np.minimum(n, nb)
        best.append(np.where(most > chance, (common - chance) / np.maximum(most - chance, 1e-9), 1.0).max())
    return float(min(1.0, max(0.0, np.mean(best))))


def as_text(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def of_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.uint64).reshape(-1, BITS // 64)


def edited(own: str, other: str) -> str:
    half = len(own) // 2
    return own[: len(own) - half] + other[:half]


def neighbours(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs -> a written table of chunks in the order of doc_id, each with the text before its first document.

    kind 0: (blob of ids and texts, and that text, if the partition has it). kind 1, a row for each partition: its
    first document and its last text, for which the partitions next to it wait.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = [pack.compress((t or "").encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    def run(batches):
        pid, unpack = TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        ids, texts, n, before, first, last = [], [], 0, None, None, b""

        def row(what, ids, texts, before):
            blob = zstandard.compress(pickle.dumps((ids, texts), 5), 3)
            before = None if before is None else zstandard.compress(before, 3)
            return pa.RecordBatch.from_arrays([pa.array([what], pa.int32()), pa.array([pid], pa.int64()), pa.array([blob], pa.binary()), pa.array([before], pa.binary())], ["kind", "pid", "blob", "before"])

        for b in batches:
            for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                if n >= chunk_bytes:
                    yield row(0, ids, texts, before)
                    before, ids, texts, n = last, [], [], 0
                last = unpack.decompress(t.as_py())
                first = first or (doc_id, last)
                ids.append(doc_id)
                texts.append(last)
                n += len(last)
        if ids:
            yield row(0, ids, texts, before)
            yield row(1, [first[0]], [first[1]], last)

    ordered = docs.select("doc_id", "text").mapInArrow(squeeze, f"doc_id {kind}, text binary").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "kind int, pid long, blob binary, before binary"), "neighbours")


def rank_table(chunks: DataFrame) -> np.ndarray:
    """Rank of each entropy step: the less often it occurs in the whole corpus, the lower."""

    def run(batches):
        for pdf in batches:
            for blob in pdf["blob"]:
                n = step_counts(pickle.loads(zstandard.decompress(blob))[1])
                yield pd.DataFrame({"step": np.flatnonzero(n), "n": n[n > 0]})

    total = np.zeros(STEPS + 1, np.int64)
    for r in chunks.where("kind = 0").select("blob").mapInPandas(run, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():  # STEPS rows at most
        total[r["step"]] = r["n"]
    ranks = np.empty(STEPS + 1, np.int64)
    ranks[np.lexsort((np.arange(STEPS + 1), total))] = np.arange(STEPS + 1)
    return ranks


def judged(ids: list, texts: list[bytes], before: bytes | None, ranks: np.ndarray) -> pd.DataFrame:
    """A row for each document whose neighbour (the text before) is known."""
    skip = int(before is None)
    own = [t.decode() for t in texts]
    other = [None if before is None else before.decode(), *own[:-1]]
    edits = [edited(a, b).encode() for a, b in zip(own[skip:], other[skip:])]
    chains = [filters(x) for x in features([before or b"", *texts], ranks)]
    changed = [filters(x) for x in features(edits, ranks)]
    mine, theirs = chains[1 + skip :], chains[skip:-1]
    return pd.DataFrame({
        "doc_id": pd.Series(ids[skip:], dtype=object), "n_chars": [len(t) for t in own[skip:]], "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edits],
        "fingerprint": [as_text(c) for c in mine], "edited_fingerprint": [as_text(c) for c in changed],
        "near_edited": [likeness(a, b) for a, b in zip(mine, changed)], "near_next": [likeness(a, b) for a, b in zip(mine, theirs)],
    })


def fingerprints_with_edits(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs (doc_id, text) -> the contract's columns. A document's neighbour is the next in descending order of doc_id, after the last the first."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = neighbours(docs, chunk_bytes)
    ranks = rank_table(table)
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        for pdf in batches:
            for blob, before in zip(pdf["blob"], pdf["before"]):
                out = judged(*pickle.loads(zstandard.decompress(blob)), None if before is None else zstandard.decompress(before), ranks)
                if len(out):
                    yield out

    edges = table.where("kind = 1")
    pids = sorted(r["pid"] for r in edges.select("pid").collect())  # a number for each partition
    main = table.where("kind = 0").select("blob", "before").mapInPandas(run, schema)
    if not pids:
        return main
    ring = small(docs.sparkSession, "pid long, left long", [(p, pids[i - 1]) for i, p in enumerate(pids)])
    lasts = edges.select(F.col("pid").alias("left"), "before")
    return main.union(edges.select("pid", "blob").join(ring, "pid").join(lasts, "left").select("blob", "before").mapInPandas(run, schema))


def fingerprint_texts(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """docs (with text) -> its columns and fingerprint, by a given table of ranks; a column of that name comes as in_fingerprint."""
    docs = set_apart(docs, ("fingerprint",))

    def run(batches):
        for pdf in batches:
            texts = [t.encode() if isinstance(t, str) else b"" for t in pdf["text"]]
            out, at = [], 0
            while at < len(texts):
                stop, n = at, 0
                while stop < len(texts) and (stop == at or n < CHUNK_BYTES):
                    n, stop = n + len(texts[stop]), stop + 1
                out += [as_text(filters(x)) for x in features(texts[at:stop], ranks)]
                at = stop
            yield pdf.assign(fingerprint=out)

    from pyspark.sql.types import StringType, StructType

    return docs.mapInPandas(run, StructType(list(docs.schema)).add("fingerprint", StringType()))


def op7(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return fingerprints_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
