"""Substring dedup with a run-length index.

To remove: every byte covered by a string of K bytes that also starts elsewhere.

1. Each K-byte window picks an anchor: the place in it with the least hash of G bytes (the first of equal ones). Equal
   windows pick equal anchors at equal places, so only windows with equal anchors can be equal. An anchor's windows are
   neighbours; they and what they cover are its context, about 1.5 K bytes. Anchors come every K / 2 bytes or so.
2. Hashes of anchors and contexts are counted over the corpus. A context that occurs twice is removed whole. Contexts
   whose anchor occurs in one context only are done.
3. Distinct contexts with equal anchors meet in one index, a run-compressed Burrows-Wheeler transform. At the ends of
   its runs the common prefixes with the neighbouring rows are sampled. The contexts are streamed against it from right
   to left, a mapping step through the runs for each byte: inside a run the neighbours' common prefix grows by one, at
   a run's end it is the sample. That gives the matching statistics, the longest match elsewhere of what starts at each
   place. Places with K or more are marked.
4. An anchor with more than HOT contexts would be too much for one index, as an index can't be split: its windows'
   hashes are counted instead, in all buckets. Nothing is left out.

Defined results: null and empty texts have no bytes; texts shorter than K stay whole; documents are rows, so a
repeated row of at least K bytes is removed in all its copies.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .chunks import CHUNK_BYTES, Chunk, Rolling, at_chunks, bucket_bits, by_bucket, contains, decode_sorted, encode_sorted, mix, send_runs, write_chunks
from .shared import written

K, G, HOT, INDEX_BYTES = 400, 128, 512, 2 << 20
NONE = np.empty(0, np.uint64)
WHOLE, SEND, MANY = 1, 2, 4
CONTEXT = np.dtype([("h", "<u8"), ("chunk", "<i8"), ("start", "<i8"), ("span", "<i4"), ("size", "<i4"), ("open", "?")])
ITEM = np.dtype([("c", "<u8"), ("n", "<u4")])
ANSWER = np.dtype([("c", "<u8"), ("flag", "u1")])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[s : s + w]) for every s that has w values."""
    out, have = v, 1
    while have * 2 <= w:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(v) - w + 1], out[w - have :]) if w > have else out


class Anchors:
    """Anchors of a chunk: hash, first window, number of windows less one, hash of the context."""

    def __init__(self, chunk: Chunk, k: int, g: int):
        data = np.frombuffer(chunk.data, np.uint8)
        self.h = self.c = NONE
        self.start = self.span = np.empty(0, np.int64)
        long = chunk.ends - chunk.starts >= k
        if not long.any():
            return
        self.rolling = Rolling(data)
        at = np.arange(len(data) - g + 1)
        v = mix(self.rolling(at, at + g))
        low = np.uint64(max(1, int(len(data)).bit_length()))
        least = sliding_min((v >> low << low) | at.astype(np.uint64), k - g + 1)
        valid = np.zeros(len(data) + 1, np.int8)
        valid[chunk.starts[long]] += 1
        valid[chunk.ends[long] - k + 1] -= 1
        starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
        pick = (least[starts] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        self.start, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
        self.span, self.h = last - self.start, mix(v[pick[new]] + np.uint64(1))  # the least hashes aren't spread evenly
        view, off = memoryview(chunk.data), pick[new] - self.start
        c = [xxhash.xxh3_64_intdigest(view[a:b], seed=o) for a, b, o in zip(self.start.tolist(), (last + k).tolist(), off.tolist())]
        self.c = np.asarray(c, np.uint64)


def anchor_items(k: int, g: int):
    def hashes(chunk: Chunk):
        a = Anchors(chunk, k, g)
        order = np.lexsort((a.c, a.h))
        h, c = a.h[order], a.c[order]
        lead = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(h) else np.empty(0, np.int64)
        items = np.zeros(len(lead), ITEM)
        items["c"], items["n"] = c[lead], np.diff(np.append(lead, len(h)))
        return h[lead], items

    return hashes


def anchor_answers(hot: int):
    """For one bucket: what each chunk is to do with its contexts whose anchor occurs more than once."""

    def run(pdf):
        parts = [(decode_sorted(b), np.frombuffer(zstandard.decompress(x), ITEM)) for b, x in zip(pdf["blob"], pdf["extra"])]
        h, items = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        chunk = np.repeat(pdf["chunk"].to_numpy(), [len(p[0]) for p in parts])
        order = np.lexsort((chunk, items["c"], h))
        h, c, n, chunk = h[order], items["c"][order], items["n"][order].astype(np.int64), chunk[order]
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
        of_h, of_c = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
        total = np.add.reduceat(n, np.flatnonzero(new_h))[of_h]
        kinds = np.add.reduceat(new_c.astype(np.int64), np.flatnonzero(new_h))[of_h]
        copies = np.add.reduceat(n, np.flatnonzero(new_c))[of_c]
        flag = (WHOLE * (copies > 1) + SEND * ((kinds > 1) & new_c) + MANY * (kinds > hot)).astype(np.uint8)
        keep = np.flatnonzero((total > 1) & (flag > 0))
        keep = keep[np.argsort(chunk[keep], kind="stable")]
        out, edges = [], np.flatnonzero(np.concatenate([[True], chunk[keep][1:] != chunk[keep][:-1]])) if len(keep) else []
        for at in np.split(keep, edges[1:]) if len(keep) else []:
            rows = np.zeros(len(at), ANSWER)
            rows["c"], rows["flag"] = c[at], flag[at]
            out.append((int(chunk[at[0]]), encode_sorted(h[at]), zstandard.compress(rows.tobytes(), 1)))
        return pd.DataFrame(out, columns=["chunk", "blob", "extra"])

    return run


def spread(chunks: DataFrame, answers: DataFrame, k: int, g: int, bits: int) -> DataFrame:
    """kind 0: contexts for an index; 1: window hashes of anchors with many contexts; 2: spans to remove; 3: window ranges that wait for 1."""

    def run(number, chunk, got):
        if not len(got):
            return
        a = Anchors(chunk, k, g)
        h = np.concatenate([decode_sorted(b) for b in got["blob"]])
        rows = np.concatenate([np.frombuffer(zstandard.decompress(x), ANSWER) for x in got["extra"]])
        both = mix(h ^ mix(rows["c"]))
        order = np.argsort(both)
        both, flags = both[order], rows["flag"][order]
        own = mix(a.h ^ mix(a.c))
        here = contains(both, own)
        flag = np.zeros(len(own), np.uint8)
        flag[here] = flags[np.searchsorted(both, own[here])]
        out = []
        whole = np.flatnonzero(flag & WHOLE)
        if len(whole):
            out.append((2, 0, number, np.stack([a.start[whole], a.start[whole] + a.span[whole] + k]).tobytes(), None))
        send = np.flatnonzero(flag & SEND)
        send = send[np.sort(np.unique(own[send], return_index=True)[1])]  # one of equal contexts
        few = send[(flag[send] & MANY) == 0]
        few = few[np.argsort(a.h[few], kind="stable")]
        rows = np.zeros(len(few), CONTEXT)
        rows["h"], rows["chunk"], rows["start"], rows["span"], rows["size"], rows["open"] = a.h[few], number, a.start[few], a.span[few], a.span[few] + k, (flag[few] & WHOLE) == 0
        for b, s, e in by_bucket(a.h[few], bits):
            texts = b"".join(chunk.data[x : x + n] for x, n in zip(rows["start"][s:e].tolist(), rows["size"][s:e].tolist()))
            out.append((0, b, number, rows[s:e].tobytes(), zstandard.compress(texts, 1)))
        many = send[(flag[send] & MANY) > 0]
        if len(many):
            starts = np.concatenate([np.arange(s, s + n + 1) for s, n in zip(a.start[many].tolist(), a.span[many].tolist())])
            weight = np.repeat(1 + ((flag[many] & WHOLE) > 0), a.span[many] + 1)  # a context with copies counts for two
            w = mix(a.rolling(starts, starts + k))
            u, inverse = np.unique(w, return_inverse=True)
            n = np.minimum(np.bincount(inverse, weights=weight), 2).astype(np.uint8)
            out += [(1, b, number, encode_sorted(u[s:e]), n[s:e].tobytes()) for b, s, e in by_bucket(u, bits)]
            wait = many[(flag[many] & WHOLE) == 0]
            out.append((3, 0, number, np.stack([a.start[wait], a.start[wait] + a.span[wait] + 1]).tobytes(), None))
        if out:
            yield pd.DataFrame(out, columns=["kind", "bucket", "chunk", "blob", "extra"])

    return at_chunks(chunks, answers, run, "kind int, bucket int, chunk long, blob binary, extra binary")


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers below 512, by doubling; the end counts as below all."""
    n = len(t)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([t.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    for i in range(7):
        key = (key << np.uint64(9)) | padded[i : i + n]
    depth = 7
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        behind = np.zeros(n, np.uint64)
        behind[: n - depth] = rank[depth:] + 1
        key = (rank.astype(np.uint64) << np.uint64(32)) | behind
        depth *= 2


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with samples at the ends of its runs.

    A run has its first row, its symbol, the row that its first row maps to one symbol further left, and two samples:
    what the row mapped to from its first row has in common with the row above it, and from its last row with the one
    below. Inside a run, neighbours stay neighbours and have one symbol more in common. The suffix array goes once
    the samples are made.
    """

    def __init__(self, t: np.ndarray, ends: np.ndarray):
        """t: integers below 512, in which texts are followed by 0 each; ends: the places of those zeros."""
        self.n, self.ends = len(t), ends
        sa = suffix_array(t)
        bwt = t[sa - 1]
        self.starts = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.symbols, self.lengths = bwt[self.starts], np.diff(np.append(self.starts, self.n))
        order = np.argsort(self.symbols, kind="stable")
        self.maps_to = np.empty(len(order), np.int64)
        self.maps_to[order] = np.cumsum(self.lengths[order]) - self.lengths[order]
        rolling = Rolling(t, mix(np.arange(1, 513, dtype=np.uint64)))

        def common(rows):
            """Of each row with the row above it; 0 at the edges."""
            inside = (rows > 0) & (rows < self.n)
            out = np.zeros(len(rows), np.int64)
            out[inside] = self._common(rolling, sa[rows[inside] - 1], sa[rows[inside]])
            return out

        self.above, self.below = common(self.maps_to), common(self.maps_to + self.lengths)
        row_of = np.empty(self.n, np.int64)
        row_of[sa] = np.arange(self.n)
        self.end_rows = row_of[ends]
        self.end_above, self.end_below = common(self.end_rows), common(self.end_rows + 1)

    def _common(self, rolling: Rolling, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of common prefixes, by binary search over rolling hashes."""
        low, high = np.zeros(len(a), np.int64), self.n - np.maximum(a, b)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = rolling(a, a + mid) == rolling(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def matching_statistics(self) -> np.ndarray:
        """For each place of a text the length of the longest match that starts elsewhere.

        All texts are streamed side by side, from their ends to their beginnings, one mapping step through the runs for
        each symbol. Nothing but runs and samples is read.
        """
        out = np.zeros(self.n, np.int64)
        sizes = np.diff(np.concatenate([[-1], self.ends])) - 1
        order = np.argsort(-sizes, kind="stable")
        place, row, up, down = self.ends[order], self.end_rows[order], self.end_above[order], self.end_below[order]
        left = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right")  # texts of so many symbols
        for m in left.tolist():
            place, row, up, down = place[:m] - 1, row[:m], up[:m], down[:m]
            run = np.searchsorted(self.starts, row, "right") - 1
            off = row - self.starts[run]
            up = np.where(off == 0, self.above[run], up + 1)
            down = np.where(off == self.lengths[run] - 1, self.below[run], down + 1)
            row = self.maps_to[run] + off
            out[place] = np.maximum(up, down)
        return out


def index_marks(k: int, index_bytes: int):
    """For one bucket of contexts: the spans to remove, by chunk."""

    def run(pdf):
        rows = np.concatenate([np.frombuffer(b, CONTEXT) for b in pdf["blob"]])
        data = b"".join(zstandard.decompress(x) for x in pdf["extra"])
        off = np.cumsum(rows["size"], dtype=np.int64) - rows["size"]
        order = np.lexsort((rows["start"], rows["chunk"], rows["h"]))
        rows, off = rows[order], off[order]
        h, found = rows["h"], []
        group = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        at = 0
        while at < len(group) - 1:
            stop, size = at, 0
            while stop < len(group) - 1 and (stop == at or size < index_bytes):
                size += int(rows["size"][group[stop] : group[stop + 1]].sum())
                stop += 1
            part = slice(group[at], group[stop])
            found.append(marks(rows[part], off[part], data, k))
            at = stop
        found = np.concatenate(found)
        found = found[np.argsort(found[:, 0], kind="stable")]
        out = []
        if len(found):
            for x in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1):
                out.append((int(x[0, 0]), 2, np.ascontiguousarray(x[:, 1:].T).tobytes()))
        return pd.DataFrame(out, columns=["chunk", "kind", "blob"])

    return run


def marks(rows: np.ndarray, off: np.ndarray, data: bytes, k: int) -> np.ndarray:
    """(chunk, start, stop) of what is to go from some contexts."""
    text = np.zeros(int(rows["size"].sum()) + len(rows), np.uint16)  # 0 ends a context
    begin = np.cumsum(rows["size"] + 1, dtype=np.int64) - rows["size"] - 1
    raw = np.frombuffer(data, np.uint8)
    for b, o, n in zip(begin.tolist(), off.tolist(), rows["size"].tolist()):
        text[b : b + n] = raw[o : o + n]
        text[b : b + n] += 1
    long = RunLengthIndex(text, begin + rows["size"]).matching_statistics() >= k
    out = []
    for i in np.flatnonzero(rows["open"]).tolist():
        hit = np.flatnonzero(long[begin[i] : begin[i] + rows["span"][i] + 1])
        if len(hit):  # all windows of a context share its anchor, so what they cover is one piece
            out.append((rows["chunk"][i], rows["start"][i] + hit[0], rows["start"][i] + hit[-1] + k))
    return np.asarray(out, np.int64).reshape(-1, 3)


def repeated_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one bucket of window hashes: to each chunk those that occur more than once."""
    arrays = [decode_sorted(b) for b in pdf["blob"]]
    both, n = np.concatenate(arrays), np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["extra"]]).astype(np.int64)
    u, inverse = np.unique(both, return_inverse=True)
    twice = u[np.bincount(inverse, weights=n) > 1]
    out = [(int(number), 1, encode_sorted(own)) for number, a in zip(pdf["chunk"], arrays) if len(own := a[contains(twice, a)])]
    return pd.DataFrame(out, columns=["chunk", "kind", "blob"])


def spans_to_remove(chunk: Chunk, got: pd.DataFrame, k: int) -> np.ndarray:
    """Whether each byte of a chunk is to go."""
    change = np.zeros(len(chunk.data) + 1, np.int64)

    def cover(start, stop):
        np.add.at(change, start, 1)
        np.add.at(change, stop, -1)

    for blob in got["blob"][got["kind"] == 2]:
        cover(*np.frombuffer(blob, np.int64).reshape(2, -1))
    twice = [decode_sorted(b) for b in got["blob"][got["kind"] == 1]]
    if twice:
        twice = np.sort(np.concatenate(twice))
        rolling = Rolling(np.frombuffer(chunk.data, np.uint8))
        for blob in got["blob"][got["kind"] == 3]:
            a, b = np.frombuffer(blob, np.int64).reshape(2, -1)
            starts = np.concatenate([np.empty(0, np.int64), *(np.arange(x, y) for x, y in zip(a.tolist(), b.tolist()))])
            starts = starts[contains(twice, mix(rolling(starts, starts + k)))]
            cover(starts, starts + k)
    return np.cumsum(change)[:-1] > 0


def remove_repeats(docs: DataFrame, k: int = K, g: int = G, hot: int = HOT, chunk_bytes: int = CHUNK_BYTES, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, spans (array of [start, stop)), kept (bytes left)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = write_chunks(docs, chunk_bytes=chunk_bytes)
    bits = bucket_bits(chunks)
    answers = send_runs(chunks, anchor_items(k, g), bits).groupBy("bucket").applyInPandas(anchor_answers(hot), "chunk long, blob binary, extra binary")
    out = written(spread(chunks, answers, k, g, bits), "contexts")
    found = "chunk long, kind int, blob binary"
    # A task for each bucket: an index takes far longer than its bytes would let expect.
    from_index = out.where("kind = 0").repartition(1 << bits, "bucket").groupBy("bucket").applyInPandas(index_marks(k, index_bytes), found)
    from_windows = out.where("kind = 1").groupBy("bucket").applyInPandas(repeated_windows, found)
    known = out.where("kind >= 2").select("chunk", "kind", "blob").union(from_index).union(from_windows)

    def settle(number, chunk, got):
        gone = spans_to_remove(chunk, got, k)
        data, rows = np.frombuffer(chunk.data, np.uint8), []
        for i, (s, e) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist())):
            own = gone[s:e]
            if own.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).reshape(-1, 2)
                rows.append((chunk.ids[i], e - s, edges.tolist(), data[s:e][~own].tobytes()))
            else:
                rows.append((chunk.ids[i], e - s, [], chunk.text(i)))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"]).astype({"doc_id": object})

    return at_chunks(chunks, known, settle, f"doc_id {kind}, n_bytes long, spans array<array<long>>, kept binary")


def op1(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0]), F.lit(0))
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


