"""Substring dedup with a log-structured fingerprint index.

1. The index is a set of buckets of the hash space, each a few immutable sorted runs of window fingerprints (64 bits of a
   mixed rolling hash) with the batch that had each first. Batches come in the order of doc_id. In each bucket a
   batch's fingerprints, sorted too, are merge-joined with the runs; what is found goes back to the batch with the batch
   that had it, what is new becomes a run, and runs of like size are compacted into one.
2. A batch marks its windows that were found, and those that repeat within it by its documents' order.
3. Verification, by the words themselves: a batch sends the words of its found spans to the batch that had them first,
   equal spans once; there every window is compared word by word with the one of the same fingerprint. Within a batch
   windows of one fingerprint are compared likewise. Fingerprints of which two different windows were seen are settled
   anew, by the words of all their windows.

An index can be kept as a table: runs, and the batches, whose words later verifications read. With it the next call needs
only the new documents, whose ids must all be larger. Buckets are split anew as the history grows.

Defined results: null and empty texts have no words; documents with equal ids don't remove each other's windows, as
neither id is smaller (they share a batch, which is as large as they are together); a null id counts as the smallest;
texts of fewer words than a window stay whole; other columns don't pass; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from .chunks import CHUNK_BYTES, Chunk, WordTable, at_chunks, by_bucket, contains, decode_sorted, encode_sorted, send_runs, write_chunks
from .shared import discard, free_shuffles, written

WINDOW = 13
#: Bytes of spans that one task verifies against a batch; more are dealt to several.
VERIFY_BYTES = 1 << 20
RUNS = "bucket int, chunk long, blob binary, extra binary"


def encode_ints(a: np.ndarray) -> bytes:
    """Integers of which few are different."""
    u, codes = np.unique(a, return_inverse=True)
    kind = np.uint16 if len(u) < 1 << 16 else np.uint32
    return zstandard.compress(len(u).to_bytes(8, "little") + u.astype(np.int64).tobytes() + codes.astype(kind).tobytes(), 1)


def decode_ints(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, np.int64, n, 8)[np.frombuffer(raw, np.uint16 if n < 1 << 16 else np.uint32, offset=8 + 8 * n)]


class Log:
    """The sorted runs of a bucket, with the batch that had each fingerprint first; a run is at least twice as long as the next."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def known(self, a: np.ndarray) -> np.ndarray:
        """For each fingerprint the batch that had it first, or -1."""
        out = np.full(len(a), -1, np.int64)
        for run, source in self.runs:
            at = np.minimum(np.searchsorted(run, a), len(run) - 1)
            out = np.where(run[at] == a, source[at], out)
        return out

    def add(self, a: np.ndarray, source: np.ndarray) -> None:
        if len(a):
            self.runs.append((a, source))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            last, before = self.runs.pop(), self.runs.pop()
            both, source = np.concatenate([before[0], last[0]]), np.concatenate([before[1], last[1]])
            order = np.argsort(both, kind="stable")
            self.runs.append((both[order], source[order]))


def merge_join(runs: DataFrame, keep: bool = False) -> DataFrame:
    """runs (bucket, chunk, blob, extra) -> the fingerprints of each batch that earlier ones have, extra: which; with keep the compacted runs instead.

    Rows with extra are runs of a kept index, which come before all batches.
    """

    def run(pdf):
        log, out, bucket = Log(), [], int(pdf["bucket"].iloc[0])
        rows = sorted(zip(pdf["extra"].isna(), pdf["chunk"], pdf["blob"], pdf["extra"]), key=lambda r: r[:2])
        for new, number, blob, extra in rows:
            a = decode_sorted(blob)
            if not new:
                log.add(a, decode_ints(extra))
                continue
            had = log.known(a)
            old = had >= 0
            if old.any() and not keep:
                out.append((bucket, number, encode_sorted(a[old]), encode_ints(had[old])))
            log.add(a[~old], np.full(int((~old).sum()), number, np.int64))
        if keep:
            out = [(bucket, i, encode_sorted(a), encode_ints(source)) for i, (a, source) in enumerate(log.runs)]
        return pd.DataFrame(out, columns=["bucket", "chunk", "blob", "extra"])

    return runs.groupBy("bucket").applyInPandas(run, RUNS)


def split_anew(runs: DataFrame, bits: int) -> DataFrame:
    """Kept runs, in buckets of so many bits."""

    def run(batches):
        for pdf in batches:
            out = []
            for number, blob, extra in zip(pdf["chunk"], pdf["blob"], pdf["extra"]):
                a, source = decode_sorted(blob), decode_ints(extra)
                out += [(b, number, encode_sorted(a[s:e]), encode_ints(source[s:e])) for b, s, e in by_bucket(a, bits)]
            yield pd.DataFrame(out, columns=["bucket", "chunk", "blob", "extra"])

    return runs.mapInPandas(run, RUNS)


def own_hashes(size: int):
    def hashes(chunk: Chunk):
        return np.unique(WordTable(chunk, lower=False).windows(size)[1]), None

    return hashes


def numbered(words: list[bytes], at: np.ndarray, size: int, book: dict[bytes, int]) -> np.ndarray:
    """A number for each word that a window at one of these places has, equal for equal words; 0 for the others."""
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    here = np.flatnonzero(np.cumsum(cover)[:-1])
    out = np.zeros(len(words), np.int64)
    out[here] = [book.setdefault(words[i], len(book) + 1) for i in here.tolist()]
    return out


def unlike(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the windows of numbered words at a and b differ in any word."""
    out = np.zeros(len(a), bool)
    for k in range(size):
        out |= left[a + k] != right[b + k]
    return out


def words_of(chunk: Chunk) -> list[list[bytes]]:
    return [chunk.text(i).split() for i in range(len(chunk))]


class Batch:
    """A chunk's windows: places, hashes, and for each the first of the same hash."""

    def __init__(self, chunk: Chunk, size: int):
        self.words, self.size = WordTable(chunk, lower=False), size
        self.at, self.h = self.words.windows(size)
        self.order = np.argsort(self.h, kind="stable")
        hs = self.h[self.order]
        self.lead = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]])) if len(hs) else np.empty(0, np.int64)
        self.sorted = hs[self.lead]
        self.first = np.empty(len(hs), np.int64)  # of each window the first of its hash
        if len(hs):
            group = np.zeros(len(hs), np.int64)
            group[self.lead[1:]] = 1
            self.first[self.order] = self.order[self.lead][np.cumsum(group)]

    def covered(self, hit: np.ndarray) -> np.ndarray:
        """The words that windows in hit cover."""
        cover = np.zeros(len(self.words.hash) + 1, np.int64)
        np.add.at(cover, self.at[hit], 1)
        np.add.at(cover, self.at[hit] + self.size, -1)
        return np.cumsum(cover)[:-1] > 0


def settled(chunk: Chunk, answers: pd.DataFrame, size: int, exact: dict[int, dict[bytes, int]] | None = None, number: int = 0):
    """(rows of the result, spans to verify as (batch, words), hashes within the batch that differ in words).

    exact: hashes that stand for several windows -> {words: the batch that had them first}; they count by words.
    """
    batch = Batch(chunk, size)
    ids = chunk.ids
    rank = np.cumsum([0, *(a != b for a, b in zip(ids[1:], ids[:-1]))])  # equal ids are neighbours
    doc = batch.words.doc[batch.at]
    repeats = rank[doc] > rank[doc[batch.first]] if len(doc) else np.empty(0, bool)
    known, source = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(answers):
        known, source = np.concatenate([decode_sorted(b) for b in answers["blob"]]), np.concatenate([decode_ints(b) for b in answers["extra"]])
        order = np.argsort(known)
        known, source = known[order], source[order]
    found = contains(known, batch.h)
    hit = repeats | found
    by_doc = words_of(chunk)
    flat = [w for own in by_doc for w in own]
    if exact is None:
        again = np.flatnonzero(batch.first != np.arange(len(batch.h)))
        a, b = batch.at[again], batch.at[batch.first[again]]
        own = numbered(flat, np.concatenate([a, b]), size, {})
        differ = np.unique(batch.h[again[unlike(own, a, own, b, size)]])
    else:
        differ = np.empty(0, np.uint64)
        least: dict[bytes, int] = {}
        for i in np.flatnonzero(contains(np.sort(np.asarray(list(exact), np.uint64)), batch.h)).tolist():
            text = b" ".join(flat[batch.at[i] : batch.at[i] + size])
            before = least.setdefault(text, int(rank[doc[i]]))
            hit[i] = exact[int(batch.h[i])].get(text, number) < number or before < rank[doc[i]]
    spans = set()
    if found.any() and exact is None:
        i = np.flatnonzero(found)
        of = source[np.searchsorted(known, batch.h[i])]
        cut = np.flatnonzero((np.diff(batch.at[i]) != 1) | (np.diff(of) != 0) | (np.diff(doc[i]) != 0)) + 1
        for part, who in zip(np.split(batch.at[i], cut), of[np.concatenate([[0], cut])].tolist()):
            spans.add((who, b" ".join(flat[part[0] : part[-1] + size])))
    gone = batch.covered(hit)
    rows = []
    for i, own in enumerate(by_doc):
        flags = gone[batch.words.first[i] : batch.words.stop[i]]
        kept = [w for w, g in zip(own, flags.tolist()) if not g] if flags.any() else own
        rows.append((ids[i], len(own), len(own) - len(kept), b" ".join(kept)))
    return rows, spans, differ


def differing(chunk: Chunk, spans: list[bytes], size: int) -> np.ndarray:
    """Hashes of windows in spans whose words aren't those of the chunk's window of the same hash."""
    at, h = WordTable(Chunk.of(spans), lower=False).windows(size)
    wanted = np.unique(h)
    own_at, own_h = WordTable(chunk, lower=False).windows(size)
    some = np.flatnonzero(contains(wanted, own_h))
    have, first = np.unique(own_h[some], return_index=True)
    bad = ~contains(have, h)
    here = np.flatnonzero(~bad)
    mine = own_at[some[first[np.searchsorted(have, h[here])]]]
    book: dict[bytes, int] = {}
    other = numbered([w for s in spans for w in s.split()], at, size, book)
    own = numbered([w for x in words_of(chunk) for w in x], mine, size, book)
    bad[here] = unlike(other, at[here], own, mine, size)
    return np.unique(h[bad])


def collisions(asks: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """asks (source, span) and chunks (chunk, blob) -> h of windows that differ. A batch that is asked for much is read by several tasks."""
    parts = asks.groupBy("source").agg(F.ceil(F.sum(F.length("span")) / VERIFY_BYTES).alias("parts"))
    left = chunks.join(parts, F.col("chunk") == F.col("source")).select("chunk", "blob", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = asks.join(parts, "source").select(F.col("source").alias("chunk"), F.pmod(F.xxhash64("span"), "parts").alias("part"), "span")

    def run(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"h": []}, dtype="int64")
        return pd.DataFrame({"h": differing(Chunk(left["blob"].iloc[0]), right["span"].tolist(), size).view(np.int64)})

    return left.groupBy("chunk", "part").cogroup(right.groupBy("chunk", "part")).applyInPandas(run, "h long")


def having(chunks: DataFrame, hashes: DataFrame, size: int, bits: int) -> DataFrame:
    """(chunk, blob): to each chunk those of hashes (h) that its windows have. They meet in buckets of the hash space."""
    runs = send_runs(chunks, own_hashes(size), bits).select("bucket", "chunk", "blob")
    dealt = hashes.select(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("bucket"), "h")

    def run(left, right):
        wanted, out = np.sort(right["h"].to_numpy(np.int64).view(np.uint64)), []
        if len(wanted):
            for number, blob in zip(left["chunk"], left["blob"]):
                a = decode_sorted(blob)
                own = a[contains(wanted, a)]
                if len(own):
                    out.append((number, encode_sorted(own)))
        return pd.DataFrame(out, columns=["chunk", "blob"])

    return runs.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInPandas(run, "chunk long, blob binary")


def by_words(chunks: DataFrame, hashes: DataFrame, size: int, bits: int) -> DataFrame:
    """(chunk, h, words, source): each chunk's windows of hashes (h) that stand for several, and the first chunk that has those words."""

    def own(number, chunk, got):
        if not len(got):
            return
        wanted = np.sort(np.concatenate([decode_sorted(b) for b in got["blob"]]))
        batch = Batch(chunk, size)
        flat = [w for x in words_of(chunk) for w in x]
        out = {(int(batch.h[i].view(np.int64)), b" ".join(flat[batch.at[i] : batch.at[i] + size])) for i in np.flatnonzero(contains(wanted, batch.h)).tolist()}
        yield pd.DataFrame([(number, h, t) for h, t in sorted(out)], columns=["chunk", "h", "words"])

    rows = written(at_chunks(chunks, having(chunks, hashes, size, bits), own, "chunk long, h long, words binary"), "exact")
    return rows.join(rows.groupBy("h", "words").agg(F.min("chunk").alias("source")), ["h", "words"])


def batches_and_runs(docs: DataFrame, size: int, index: DataFrame | None, chunk_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(chunks of docs, all chunks, runs to merge, bits)."""
    base, old = 0, None
    if index is not None:
        had = index.agg(F.max("chunk").alias("chunk"), F.max("size").alias("size"), F.max("last").alias("last")).first()
        if had["size"] is not None:
            if had["size"] != size:
                raise ValueError(f"the index has windows of {had['size']} words, not {size}")
            if not docs.where(F.coalesce(F.col("doc_id") <= F.lit(had["last"]), F.lit(True))).isEmpty():
                raise ValueError("documents must have larger ids than those in the index")
            base, old = (int(had["chunk"]) + (1 << 20)) >> 20 << 20, index
    chunks = write_chunks(docs, ordered=True, chunk_bytes=chunk_bytes, base=base)
    everything = chunks if old is None else chunks.select("chunk", "blob").union(old.where("kind = 1").select("chunk", "blob"))
    bits = max(4, int(everything.count()).bit_length() - 1)
    runs = send_runs(chunks, own_hashes(size), bits)
    if old is not None:
        runs = runs.unionByName(split_anew(old.where("kind = 0").select("bucket", "chunk", "blob", "extra"), bits))
    return chunks, everything, runs, bits


def all_found(found: DataFrame) -> DataFrame:
    """h of every fingerprint that two batches have."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"h": np.concatenate([np.empty(0, np.uint64), *map(decode_sorted, pdf["blob"])]).view(np.int64)})

    return found.select("blob").mapInPandas(run, "h long").distinct()


def deduplicate(docs: DataFrame, size: int = WINDOW, index: DataFrame | None = None, chunk_bytes: int = CHUNK_BYTES, by_words_all: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept (the words left, joined by blanks, UTF-8).

    index: a table made by build_index from documents with smaller ids. by_words_all: settle every fingerprint that two
    batches have by the words of all its windows, not only those that were seen to stand for different ones; the result
    is the same.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    chunks, everything, runs, bits = batches_and_runs(docs, size, index, chunk_bytes)
    found = written(merge_join(runs).select("chunk", "blob", "extra"), "found")
    del runs
    free_shuffles(spark)
    fields = f"doc_id {kind}, n_words long, n_removed long, kept binary, source long, span binary, h long"
    columns = [f.split()[0] for f in fields.split(", ")]

    def settle(number, chunk, answers):
        rows, spans, differ = settled(chunk, answers, size)
        rows = [(*r, None, None, None) for r in rows] + [(None, None, None, None, who, text, None) for who, text in sorted(spans)]
        rows += [(None, None, None, None, None, None, int(h)) for h in differ.view(np.int64)]
        out = pd.DataFrame(rows, columns=columns)
        yield out.astype({"doc_id": object, "n_words": "Int64", "n_removed": "Int64", "source": "Int64", "h": "Int64"})

    out = written(at_chunks(chunks, found, settle, fields), "settled")
    free_shuffles(spark)
    asks = written(out.where("source IS NOT NULL").select("source", "span").distinct(), "asks")
    free_shuffles(spark)
    differ = collisions(asks, everything, size).union(out.where("h IS NOT NULL").select("h"))
    bad = written((differ.union(all_found(found)) if by_words_all else differ).distinct(), "differ")
    result = ["doc_id", "n_words", "n_removed", "kept"]
    discard(asks)
    if bad.isEmpty():
        discard(found, bad)
        return out.where("n_words IS NOT NULL").select(*result)
    # Fingerprints of two windows: rare, but more of them in more text, so they stay a table and meet their batches by joins.
    exact = by_words(everything, bad, size, bits)
    none = F.lit(None)
    answers = found.select("chunk", "blob", "extra", none.cast("string").alias("h"), none.cast("binary").alias("words"), none.cast("string").alias("source"))
    answers = answers.unionByName(exact.select("chunk", none.cast("binary").alias("blob"), none.cast("binary").alias("extra"), F.col("h").cast("string").alias("h"), "words", F.col("source").cast("string").alias("source")))

    def settle_by_words(number, chunk, answers):
        book: dict[int, dict[bytes, int]] = {}
        for h, text, who in answers.loc[answers["words"].notna(), ["h", "words", "source"]].itertuples(index=False):
            book.setdefault(int(h) % (1 << 64), {})[bytes(text)] = int(who)
        yield pd.DataFrame(settled(chunk, answers[answers["blob"].notna()], size, book, number)[0], columns=result).astype({"doc_id": object})

    return at_chunks(chunks, answers, settle_by_words, f"doc_id {kind}, n_words long, n_removed long, kept binary")


def build_index(docs: DataFrame, size: int = WINDOW, index: DataFrame | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The index after docs, on top of an older one: kind 0, compacted runs (bucket, chunk: their order, blob, extra); kind 1, batches (chunk, blob); size, and last, the largest id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    _, everything, runs, _ = batches_and_runs(docs, size, index, chunk_bytes)
    tables = [docs.select(F.col("doc_id").alias("last"))] + ([] if index is None else [index.select("last")])
    last = max((x for t in tables if (x := t.agg(F.max("last")).first()[0]) is not None), default=None)
    runs = merge_join(runs, keep=True).select(F.lit(0).alias("kind"), "bucket", "chunk", "blob", "extra")
    none = F.lit(None)
    batches = everything.select(F.lit(1).alias("kind"), none.cast("int").alias("bucket"), "chunk", "blob", none.cast("binary").alias("extra"))
    return runs.union(batches).withColumns({"size": F.lit(size), "last": F.lit(last).cast(kind)})


def op8(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    out = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT t, min(doc_id) AS m FROM win GROUP BY t HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (t) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
