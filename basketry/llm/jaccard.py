"""Jaccard join of documents by their 5-word shingles, and the groups that its links make.

1. Documents with equal shingle sets are one class; only its representative goes on.
2. The number of documents that have each shingle is counted over the whole corpus. It gives the order, rare first, in
   which a set of n shingles is read: two sets that are similar enough share one of their first n - ceil(t n) + 1. A
   shingle that no other document has can't be shared, so a document that is unlike all others posts nothing.
3. The documents that post one shingle are compared by the length and positional filters, and by a suffix filter: the
   sets are partitioned into 512 hash classes, and the classes whose counts differ in parity are as many as the sets
   differ by at least. That is the bound of the usual recursive suffix filter, with all partitions at once. Of the
   pairs that pass, those of a spanning forest are verified, each once, by the sets themselves.
4. Verified links join groups; then lists are read again for pairs between groups. The last time all pairs that pass
   are verified, so no link between two groups is missed.
5. A list is read in blocks of about BLOCK documents. The first times each block is read for itself, dealt anew each
   time; the last time, when lists within one group are done with, every pair of blocks is a piece of work of its own.
   Shingles that more than BLOCK documents have are known from the count and never meet in one task.

Defined results: A-Z count as a-z; fewer than five words are one shingle; a null or empty text has an empty set and is
linked with nothing; repeated rows and ids are each a row of the result; a group's id is its smallest doc_id, null if
none of its rows has one; an empty table gives an empty result; other columns are read by one_of_each alone, which
returns them as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .chunks import CHUNK_BYTES, IDX_BITS, Chunk, WordTable, at_chunks, bucket_bits, by_bucket, contains, decode_sorted, encode_sorted, mix, send_runs, write_chunks
from .components import contracted, labels
from .shared import discard, written

SHINGLE, NUM, DEN = 5, 3, 4  # words; similarity 3 / 4
FORESTS, CLASSES, BLOCK = 3, 512, 256
#: Counting looks at the upper 44 bits of a shingle's hash. Shingles that agree there are counted together, and too high
#: a count only means that a document posts more than it has to.
COUNTED = np.uint64(~0xFFFFF & (1 << 64) - 1)


def shingle_sets(chunk: Chunk, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    words = WordTable(chunk, lower=True)
    at, h = words.windows(size)
    first, stop = np.searchsorted(at, words.first), np.searchsorted(at, words.stop)
    out = []
    for i in range(len(chunk)):
        n = int(words.stop[i] - words.first[i])
        if n >= size:
            out.append(np.unique(h[first[i] : stop[i]]))
        elif n:
            whole = mix(np.asarray([n], np.uint64))
            for x in words.hash[words.first[i] : words.stop[i]]:
                whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + x)
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-num * n // den) + 1


def parities(s: np.ndarray) -> bytes:
    """For each of CLASSES classes of hashes whether the set has an odd number of them."""
    return np.packbits(np.bincount((mix(s) % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES).astype(np.uint8) & 1).tobytes()


def set_keys(chunks: DataFrame, kind: str, size: int, digests: bool) -> DataFrame:
    """(rid, doc_id, n, key, and digest if asked for): a row for each document; equal sets have equal keys.

    The digest is that of the text itself (null is empty), as Spark's md5 gives it.
    """

    def run(batches):
        for pdf in batches:
            for number, blob in zip(pdf["chunk"], pdf["blob"]):
                chunk = Chunk(blob)
                sets = shingle_sets(chunk, size)
                rids = (int(number) << IDX_BITS) + np.arange(len(chunk))
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                rows = {"rid": rids, "doc_id": pd.Series(chunk.ids, dtype=object), "n": [len(s) for s in sets], "key": keys}
                if digests:
                    rows["digest"] = [hashlib.md5(chunk.text(i)).hexdigest() for i in range(len(chunk))]
                yield pd.DataFrame(rows)

    return chunks.mapInPandas(run, f"rid long, doc_id {kind}, n long, key binary" + ", digest string" * digests)


def own_counts(size: int):
    def hashes(chunk: Chunk):
        a, n = np.unique(np.concatenate([*shingle_sets(chunk, size), np.empty(0, np.uint64)]) & COUNTED, return_counts=True)
        return a, n.astype(np.uint32)

    return hashes


def shared_counts(runs: DataFrame) -> DataFrame:
    """(chunk, blob, extra): to each chunk those of its shingles that more than one document has, and how many do."""

    def run(pdf):
        arrays = [decode_sorted(b) for b in pdf["blob"]]
        counts = [np.frombuffer(zstandard.decompress(x), np.uint32) for x in pdf["extra"]]
        both, n = np.concatenate(arrays), np.concatenate(counts).astype(np.int64)
        order = np.argsort(both, kind="stable")
        both, n = both[order], n[order]
        lead = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        total = np.add.reduceat(n, lead)
        both, total = both[lead][total > 1], total[total > 1]
        out = []
        for number, a in zip(pdf["chunk"], arrays):
            own = a[contains(both, a)]
            if len(own):
                out.append((number, encode_sorted(own), zstandard.compress(total[np.searchsorted(both, own)].astype(np.uint32).tobytes(), 1)))
        return pd.DataFrame(out, columns=["chunk", "blob", "extra"])

    return runs.groupBy("bucket").applyInPandas(run, "chunk long, blob binary, extra binary")


POST = np.dtype([("h", "<u8"), ("rid", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("m", "<u4"), ("bits", "S1", (CLASSES // 8,))])


def postings_and_sets(chunks: DataFrame, answers: DataFrame, size: int, bits: int, block: int) -> DataFrame:
    """kind 0: (bucket, blob) of postings; kind 2: (blob) of those in lists longer than a block; kind 1: (rid, n, blob), the shared shingles of a document that posts."""

    def run(number, chunk, got):
        skip = {i for x in got["idx"] if x is not None for i in x}
        got = got[got["blob"].notna()]
        known = np.concatenate([*map(decode_sorted, got["blob"]), np.empty(0, np.uint64)])
        df = np.concatenate([*(np.frombuffer(zstandard.decompress(x), np.uint32) for x in got["extra"]), np.empty(0, np.uint32)])
        order = np.argsort(known)
        known, df = known[order], df[order]
        posts, sets = [], []
        for i, s in enumerate(shingle_sets(chunk, size)):
            if not len(s) or i in skip:
                continue
            common = contains(known, s & COUNTED)
            if not common.any():
                continue
            n_alone = int(len(s) - common.sum())
            p = prefix_length(len(s)) - n_alone  # those that are alone come first
            if p <= 0:
                continue
            own = s[common]
            had = df[np.searchsorted(known, own & COUNTED)]
            rank = np.lexsort((own, had))[:p]
            rid = (number << IDX_BITS) + i
            rows = np.zeros(len(rank), POST)
            rows["h"], rows["rid"], rows["n"], rows["pos"] = own[rank], rid, len(s), n_alone + np.arange(len(rank))
            rows["m"], rows["bits"] = had[rank], np.frombuffer(parities(s), "S1")
            posts.append(rows)
            sets.append((1, 0, rid, len(s), encode_sorted(own)))
        if sets:
            rows = np.concatenate(posts)
            rows = rows[np.argsort(rows["h"], kind="stable")]
            hot = rows["m"] > block
            if hot.any():
                sets.append((2, 0, 0, 0, zstandard.compress(rows[hot].tobytes(), 1)))
            rows = rows[~hot]
            sets += [(0, b, 0, 0, zstandard.compress(rows[s:e].tobytes(), 1)) for b, s, e in by_bucket(np.ascontiguousarray(rows["h"]), bits)]
            yield pd.DataFrame(sets, columns=["kind", "bucket", "rid", "n", "blob"])

    return at_chunks(chunks, answers, run, "kind int, bucket int, rid long, n long, blob binary")


def long_lists(out: DataFrame) -> DataFrame:
    """Postings of shingles that at least two documents post, as rows: (h, rid, n, pos, bits, m); m: at most so many documents post it."""
    schema = "h long, rid long, n long, pos long, bits binary, m long"

    def frame(rows):
        raw, w = np.ascontiguousarray(rows["bits"]).tobytes(), CLASSES // 8
        return pd.DataFrame({
            "h": np.ascontiguousarray(rows["h"]).view(np.int64), "rid": rows["rid"].astype(np.int64), "n": rows["n"].astype(np.int64), "pos": rows["pos"].astype(np.int64),
            "bits": [raw[i * w : i * w + w] for i in range(len(rows))], "m": rows["m"].astype(np.int64),
        })

    def bucket(pdf):
        rows = np.concatenate([np.frombuffer(zstandard.decompress(b), POST) for b in pdf["blob"]])
        rows = rows[np.argsort(rows["h"], kind="stable")]
        h = rows["h"]
        same = h[1:] == h[:-1]
        return frame(rows[np.concatenate([[False], same]) | np.concatenate([same, [False]])])

    def as_they_are(batches):
        for pdf in batches:
            for b in pdf["blob"]:
                yield frame(np.frombuffer(zstandard.decompress(b), POST))

    short = out.where("kind = 0").select("bucket", "blob").groupBy("bucket").applyInPandas(bucket, schema)
    hot = out.where("kind = 2").select("blob").mapInPandas(as_they_are, schema).drop("m")
    return short.unionByName(hot.join(hot.groupBy("h").agg(F.count("*").alias("m")), "h"))


def passing(n, pos, bits, i: int, js: np.ndarray) -> np.ndarray:
    """Which of js (no shorter than i) may be similar to i: length, positional and suffix filters. All are exact bounds."""
    a, b = n[i], n[js]
    js, b = js[NUM * b <= DEN * a], b[NUM * b <= DEN * a]
    need = -(-NUM * (a + b) // (NUM + DEN))
    ok = 1 + np.minimum(a - pos[i] - 1, b - pos[js] - 1) >= need
    js, b = js[ok], b[ok]
    apart = np.bitwise_count(bits[js] ^ bits[i]).sum(1, dtype=np.int64)
    return js[(NUM + DEN) * apart <= (DEN - NUM) * (a + b)]


def list_pairs(rid, n, pos, bits, comp, forest: bool, side=None) -> list[tuple[int, int]]:
    """Pairs of one list to verify: those of a spanning forest over groups, or all between groups (and between two sides)."""
    order = np.lexsort((rid, n))
    rid, n, pos, bits = rid[order], n[order], pos[order], bits[order]
    label = np.unique(comp[order], return_inverse=True)[1]
    side = None if side is None else side[order]
    out = []
    for i in range(len(rid) - 1):
        js = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if side is not None:
            js = js[side[js] != side[i]]
        if not len(js):
            continue
        js = passing(n, pos, bits, i, js)
        if not len(js):
            continue
        if forest:
            groups, at = np.unique(label[js], return_index=True)
            js = js[at]
            label[np.isin(label, groups)] = label[i]
        out += [(int(rid[i]), int(rid[j])) for j in js]
    return out


def candidates(lists: DataFrame, comps: DataFrame | None, step: int, forest: bool, cross: bool, block: int, parts: int) -> DataFrame:
    """lists (and comps (rid, comp)) -> distinct pairs (a, b), a < b, of different groups."""
    if comps is None:
        rows = lists.withColumn("comp", F.col("rid"))
    else:
        rows = lists.join(comps, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
        mixed = rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("h")
        rows = rows.join(mixed, "h", "left_semi")
    # A power of two, so that long lists are dealt alike and name the same pairs.
    blocks = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(F.col("m") / block)))).cast("long")
    rows = rows.withColumn("lo", F.pmod(F.xxhash64("rid", F.lit(step)), blocks)).withColumn("hi", F.col("lo")).withColumn("side", F.col("lo"))
    if cross:  # every pair of blocks; a row goes with each block of its list
        rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumns({"lo": F.least("side", "j"), "hi": F.greatest("side", "j")}).drop("j")

    def run(pdf):
        pdf = pdf.sort_values(["h", "lo", "hi"], kind="stable")
        key = pdf[["h", "lo", "hi"]].to_numpy()
        rid, n, pos, comp, side = (pdf[c].to_numpy() for c in ("rid", "n", "pos", "comp", "side"))
        bits = np.frombuffer(b"".join(pdf["bits"]), np.uint64).reshape(len(pdf), -1)
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
        out = set()
        for s, e in zip(edges.tolist(), edges[1:].tolist()):
            if e - s > 1:
                cross = side[s:e] if key[s, 1] != key[s, 2] else None
                out.update((min(x), max(x)) for x in list_pairs(rid[s:e], n[s:e], pos[s:e], bits[s:e], comp[s:e], forest, cross))
        return pd.DataFrame(sorted(out), columns=["a", "b"])

    # Many more parts than there are tasks, so that a task can't get several of the largest blocks.
    dealt = rows.select(F.pmod(F.xxhash64("h", "lo", "hi"), F.lit(parts)).alias("part"), "h", "lo", "hi", "side", "rid", "n", "pos", "bits", "comp")
    return dealt.groupBy("part").applyInPandas(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that are similar enough, by their whole sets."""
    left = sets.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("blob").alias("sa"))
    right = sets.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("blob").alias("sb"))

    def run(batches):
        for pdf in batches:
            keep = []
            for na, sa, nb, sb in zip(pdf["na"], pdf["sa"], pdf["nb"], pdf["sb"]):
                both = int(contains(decode_sorted(sa), decode_sorted(sb)).sum())
                keep.append(DEN * both >= NUM * (na + nb - both))
            yield pdf.loc[keep, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb").mapInPandas(run, "a long, b long")


def groups(docs: DataFrame, size: int = SHINGLE, chunk_bytes: int = CHUNK_BYTES, digests: bool = False, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) -> (rid, doc_id, n, rep, and digest if asked for), a row for each document; a group has one rep."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = write_chunks(docs, chunk_bytes=chunk_bytes)
    bits = bucket_bits(chunks)
    keys = written(set_keys(chunks, kind, size, digests), "keys")
    full = keys.where("key IS NOT NULL")
    classes = full.groupBy("key").agg(F.min("rid").alias("rep"))  # one row a key, so Spark can split the rows of a hot key
    own = ["rid", "doc_id", "n", "rep", *["digest"] * digests]
    members = full.join(classes, "key").select(*own).union(keys.where("key IS NULL").withColumn("rep", F.col("rid")).select(*own))
    members = written(members, "members")
    copies = members.where("rid != rep").groupBy(F.shiftright("rid", IDX_BITS).alias("chunk")).agg(F.collect_list(F.expr(f"CAST(rid & {(1 << IDX_BITS) - 1} AS INT)")).alias("idx"))
    answers = shared_counts(send_runs(chunks, own_counts(size), bits)).withColumn("idx", F.lit(None).cast("array<int>"))
    answers = answers.unionByName(copies.select("chunk", F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("binary").alias("extra"), "idx"))
    out = written(postings_and_sets(chunks, answers, size, bits, block), "posted")
    lists = written(long_lists(out), "lists")
    discard(chunks, keys)
    sets = out.where("kind = 1").select("rid", "n", "blob")
    edges, comps = None, None
    for step in range(FORESTS + 1):
        forest = step < FORESTS
        new = written(verified(candidates(lists, comps, step, forest, step >= 2, block, parts=16 << bits), sets), "links")
        if edges is not None:
            new = new.union(edges.toDF("a", "b"))
        # After one round groups aren't whole yet, which only means that the second pass looks at more pairs.
        edges = contracted(new, rounds=None if step else 1)
        comps = written(labels(edges).toDF("rid" if forest else "rep", "comp"), "comps")
    discard(out, lists)
    return members.join(comps, "rep", "left").withColumn("rep", F.coalesce("comp", "rep")).drop("comp")


def similarity_groups(docs: DataFrame, **how) -> DataFrame:
    """docs (doc_id, text) -> (rid, doc_id, n_shingles, component_id), a row for each document."""
    rows = groups(docs, **how)
    least = rows.groupBy("rep").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "rep").select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without all but one document of each group: the one with the smallest id, nulls last (of equal ids one row stays).

    Rows are told apart by id and text. Rows that agree in both are in one group, so at most one of them stays, or their
    text has no words and all of them do.
    """
    rows = groups(docs.select("doc_id", "text"), digests=True, **how)
    stays = rows.groupBy("rep").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first")).select("first.rid", F.lit(1).alias("stays"))
    cut = rows.join(stays, "rid", "left").groupBy("doc_id", "digest").agg(F.count("*").alias("n"), F.count("stays").alias("kept"))
    cut = written(cut.where("kept < n").select(F.col("doc_id").alias("cut_id"), "digest", "kept"), "cut")
    # The caller's columns travel as one, so none of them can clash with those of this function.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("own_id"), F.md5(F.coalesce("text", F.lit(""))).alias("own"))
    same = F.col("own_id").eqNullSafe(F.col("cut_id")) & (F.col("own") == F.col("digest"))
    out = own.join(cut, same, "left_anti").select("row.*")
    repeated = cut.where("kept > 0")
    if repeated.isEmpty():
        return out
    return out.union(own.join(repeated, same, "left_semi").dropDuplicates(["own_id", "own"]).select("row.*"))


def op6(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similarity_groups(docs).select("doc_id", "n_shingles", "component_id")
