"""Near duplicates among vectors by cosine: sorted projection passes, then exact counts within the groups that they find.

1. Equal vectors are one class; its first row goes on, so copies can't fill a window.
2. In each pass every vector gets a key of HASHES random hashes, concatenated: which of 64 random directions it lies along
   most, and on which side. Vectors are range-partitioned and sorted by the key, and each is compared, in double
   precision, with the next WINDOW ones; the rows at the ends of a partition are compared with those of the next one.
   The number of passes follows the number of vectors, as windows cover a smaller share of more of them.
3. Verified pairs of all passes are joined into components by alternating stars.
4. A window is bounded, so a vector's links are counted in its component. Two members whose angles to the component's
   centroid sum up to no more than the link's angle are surely linked, and are counted by sums over angles, without
   looking at pairs; what that leaves open is compared exactly, in blocks that are tasks' pieces of work of their own.
   So all links within a component count; a link that no pass found between two components doesn't.

The work of step 4 is linear for tight groups; it is quadratic, in blocks, only in members so far from the centre of their
own component that a pair of them may not be linked.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do
vectors of different lengths; repeated rows link with each other; a component's id is its smallest vec_id, null if all its
ids are; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .components import contracted, labels
from .shared import discard, written

LEAST = 0.9
WINDOW, HASHES, DIRECTIONS, SEED = 64, 4, 64, 5
PART, BLOCK = 8192, 1024  # vectors of a partition, and of a piece of exact work
TOGETHER = 4  # passes that share a shuffle, which carries the vectors once for each
STEPS = 4096  # angles are counted in so many steps a radian, rounded up


def passes(n: int, window: int = WINDOW, exponent: float = 0.2, missed: float = 0.02) -> int:
    """How many passes find a pair at cosine 0.9 among n vectors but for a share missed.

    One finds (n / window) ** -exponent of such pairs; the exponent was measured with HASHES hashes and 64 components.
    """
    alone = min(0.9, (max(n, 2 * window) / window) ** -exponent)
    return math.ceil(math.log(missed) / math.log(1 - alone))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]  # neither overflows nor vanishes when squared
    return x / np.sqrt((x * x).sum(1))[:, None]


def matrix(blobs) -> np.ndarray:
    """Blobs of equal lengths -> a row for each."""
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def keys(x: np.ndarray, number: int, hashes: int = HASHES) -> np.ndarray:
    """For each unit vector the concatenated hashes of pass number, a byte each."""
    random = np.random.default_rng([SEED, number, x.shape[1]])
    out = np.empty((len(x), hashes), np.uint8)
    for h in range(hashes):
        along = x @ random.normal(size=(x.shape[1], DIRECTIONS))
        most = np.abs(along).argmax(1)
        out[:, h] = 2 * most + (along[np.arange(len(x)), most] > 0)
    return out


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of a group) after groups of a and b have become one."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != label[label]).any():
            label = label[label]


def in_windows(rid: np.ndarray, x: np.ndarray, least: float, window: int, new: int = 0, side=None) -> list[np.ndarray]:
    """Pairs (a, b), a < b, that connect the rows of sorted order which are at most window apart and similar enough.

    The later row is from index new on (and on another side). A pair of rows that nearer ones have connected already isn't
    named again: links are counted later, in whole groups, so a group is about as many pairs as it has members.
    """
    out, label = [np.empty((0, 2), np.int64)], np.arange(len(x))
    for k in range(1, min(window, len(x) - 1) + 1):
        s = max(new, k)
        hit = s + np.flatnonzero((x[s - k : len(x) - k] * x[s:]).sum(1) >= least)
        if side is not None:
            hit = hit[side[hit] != side[hit - k]]
        hit = hit[label[hit] != label[hit - k]]
        if len(hit):
            out.append(np.sort(np.stack([rid[hit - k], rid[hit]], 1), 1))
            label = joined(label, hit - k, hit)
    return out


def lengths(blobs: list[bytes], order=None):
    """(start, stop) of runs of blobs of one length (and of one pass, order)."""
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    new = sizes[1:] != sizes[:-1]
    if order is not None:
        new |= order[1:] != order[:-1]
    edges = np.flatnonzero(np.concatenate([[True], new, [True]])) if len(sizes) else np.zeros(1, np.int64)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def some_passes(reps: DataFrame, numbers: range, parts: int, least: float = LEAST, window: int = WINDOW) -> DataFrame:
    """reps (rid, unit) -> written pairs (a, b) of neighbours in the order of any of these passes that are similar enough."""

    def keyed(batches):
        for pdf in batches:
            blobs = list(pdf["unit"])
            for s, e in lengths(blobs):
                x = matrix(blobs[s:e])
                front = x.shape[1].to_bytes(4, "big")  # vectors of one length stand together
                for number in numbers:
                    start = number.to_bytes(4, "big") + front
                    yield pd.DataFrame({"key": [start + k.tobytes() for k in keys(x, number)], "rid": pdf["rid"].iloc[s:e], "unit": blobs[s:e], "pass": number})

    def windows(batches):
        part = TaskContext.get().partitionId()
        rid, order, blobs, first = np.empty(0, np.int64), np.empty(0, np.int64), [], True
        for pdf in batches:
            new = len(blobs)
            rid, order, blobs = np.concatenate([rid, pdf["rid"].to_numpy()]), np.concatenate([order, pdf["pass"].to_numpy()]), blobs + list(pdf["unit"])
            for s, e in lengths(blobs, order):
                pairs = np.concatenate(in_windows(rid[s:e], matrix(blobs[s:e]), least, window, max(0, new - s)))
                yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "cut": -1, "at": 0, "pass": 0, "unit": None})
            if first and len(blobs):  # for the pairs across the partition's ends
                yield pd.DataFrame({"a": rid[:window], "b": 0, "cut": part - 1, "at": window + np.arange(len(rid[:window])), "pass": order[:window], "unit": blobs[:window]})
                first = False
            rid, order, blobs = rid[-window:], order[-window:], blobs[-window:]
        yield pd.DataFrame({"a": rid, "b": 0, "cut": part, "at": window - len(rid) + np.arange(len(rid)), "pass": order, "unit": blobs})

    def across(pdf):
        pdf = pdf.sort_values("at")
        rid, side, blobs = pdf["a"].to_numpy(), (pdf["at"] >= window).to_numpy(), list(pdf["unit"])
        found = [np.empty((0, 2), np.int64)]
        for s, e in lengths(blobs, pdf["pass"].to_numpy()):
            found += in_windows(rid[s:e], matrix(blobs[s:e]), least, window, 0, side[s:e])
        return pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    dealt = reps.mapInPandas(keyed, "key binary, rid long, unit binary, pass int").repartitionByRange(parts, "key", "rid").sortWithinPartitions("key", "rid")
    out = written(dealt.mapInPandas(windows, "a long, b long, cut int, at int, pass int, unit binary"), "pass")
    ends = out.where("cut >= 0").select("cut", "a", "at", "pass", "unit")
    pairs = written(out.where("cut = -1 AND unit IS NULL").select("a", "b").union(ends.groupBy("cut").applyInPandas(across, "a long, b long")).distinct(), "pairs")
    discard(out)
    return pairs


def centroids(members: DataFrame) -> DataFrame:
    """members (root, n, unit) -> (root, centroid): the direction of the sum; sums of a batch are passed on, not its rows."""

    def merge(root, n, blobs):
        order = np.argsort(root, kind="stable")
        root, x = root[order], matrix(blobs)[order] * n[order][:, None]
        lead = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
        return root[lead], np.add.reduceat(x, lead)

    def partial(batches):
        for pdf in batches:
            blobs = list(pdf["unit"])
            for s, e in lengths(blobs):
                root, x = merge(pdf["root"].to_numpy()[s:e], pdf["n"].to_numpy()[s:e], blobs[s:e])
                yield pd.DataFrame({"root": root, "sums": [r.tobytes() for r in x]})

    def whole(pdf):
        x = matrix(list(pdf["sums"])).sum(0)
        size = np.sqrt((x * x).sum())
        return pd.DataFrame({"root": pdf["root"].iloc[:1], "centroid": [(x / size if size else x).tobytes()]})

    return members.mapInPandas(partial, "root long, sums binary").groupBy("root").applyInPandas(whole, "root long, centroid binary")


def counted_links(members: DataFrame, least: float = LEAST, block: int = BLOCK, parts: int = 64) -> DataFrame:
    """members (rid, root, n, unit) of components -> (rid, links): how many rows of its component a member is linked with, its own copies too."""
    most = int(math.acos(least) * STEPS)

    def angles(batches):
        for pdf in batches:
            units, centres = list(pdf["unit"]), list(pdf["centroid"])
            at = np.empty(len(pdf), np.int64)
            for s, e in lengths(units):
                cosine = (matrix(units[s:e]) * matrix(centres[s:e])).sum(1)
                at[s:e] = np.ceil(np.arccos(np.clip(cosine, -1, 1)) * STEPS + 0.01)
            yield pd.DataFrame({"rid": pdf["rid"], "root": pdf["root"], "n": pdf["n"], "unit": units, "angle": at})

    placed = written(members.join(centroids(members), "root").mapInPandas(angles, "rid long, root long, n long, unit binary, angle long"), "angles")
    # Counts for each step of angle of a component, 12,868 at most; summed up to the angle that a member leaves over.
    counts = placed.groupBy("root", "angle").agg(F.sum("n").alias("n"))
    asked = counts.select("root", (F.lit(most) - F.col("angle")).alias("at"), F.lit(0).cast("long").alias("n"), "angle")
    steps = counts.select("root", F.col("angle").alias("at"), "n", F.lit(None).cast("long").alias("angle")).union(asked)
    upto = steps.withColumn("sure", F.sum("n").over(Window.partitionBy("root").orderBy("at"))).where("angle IS NOT NULL").select("root", "angle", "sure")
    sure = placed.join(upto, ["root", "angle"]).select("rid", (F.col("sure") - F.when(2 * F.col("angle") <= most, F.col("n")).otherwise(0) + F.col("n") - 1).alias("links"))

    widest = placed.groupBy("root").agg(F.max("angle").alias("widest"))
    outer = placed.join(widest, "root").where(F.col("angle") + F.col("widest") > most).drop("widest")
    blocks = outer.groupBy("root").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = outer.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("root", "lo", "hi"), F.lit(parts) * F.greatest(F.lit(1), F.ceil(F.log2("blocks") + 1))))

    def compared(pdf):
        pdf = pdf.sort_values(["root", "lo", "hi", "own"], kind="stable")
        key, blobs = pdf[["root", "lo", "hi"]].to_numpy(), list(pdf["unit"])
        rid, own, n, angle = (pdf[c].to_numpy() for c in ("rid", "own", "n", "angle"))
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
        links = np.zeros(len(pdf), np.int64)
        for s, e in zip(edges.tolist(), edges[1:].tolist()):
            x, same = matrix(blobs[s:e]), key[s, 1] == key[s, 2]
            near = (x @ x.T >= least) & (angle[s:e, None] + angle[None, s:e] > most)
            if same:
                np.fill_diagonal(near, False)
            else:
                near &= own[s:e, None] != own[None, s:e]
            links[s:e] = near @ n[s:e]
        hit = links > 0
        return pd.DataFrame({"rid": rid[hit], "links": links[hit]})

    more = dealt.groupBy("part").applyInPandas(compared, "rid long, links long")
    out = written(sure.union(more).groupBy("rid").agg(F.sum("links").alias("links")), "links")
    discard(placed)
    return out


def near_vectors(vectors: DataFrame, least: float = LEAST, window: int = WINDOW, rounds: int | None = None, part: int = PART, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id, embedding) -> (vec_id, n_links, component_id, kept), a row for each vector."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(fine, F.transform(v, lambda x: x + F.lit(0.0))).alias("v")).withColumn("rid", F.monotonically_increasing_id())
    rows = written(rows, "vectors")
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("rid").alias("rep"), F.count("*").alias("n"))

    def units(batches):
        for pdf in batches:
            yield pd.DataFrame({"rid": pdf["rep"], "n": pdf["n"], "unit": [unit(x[None])[0].tobytes() for x in map(np.asarray, pdf["v"])]})

    reps = written(classes.mapInPandas(units, "rid long, n long, unit binary"), "units")
    n = reps.count()
    parts = math.ceil(max(1, n) / part)
    rounds = passes(n, window) if rounds is None else rounds
    found = [some_passes(reps, range(i, min(rounds, i + TOGETHER)), parts * min(TOGETHER, rounds - i), least, window) for i in range(0, rounds, TOGETHER)]
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    comps = written(labels(contracted(pairs)).toDF("rep", "root"), "comps")
    discard(*found)
    members = reps.join(comps.withColumnRenamed("rep", "rid"), "rid")
    links = counted_links(members, least, block, 4 * parts + 28)
    of = rows.join(classes, "v", "left").join(comps, "rep", "left").join(links.withColumnRenamed("rid", "rep"), "rep", "left")
    of = of.select("vec_id", F.coalesce("links", F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "rep", "rid").alias("root"))
    smallest = of.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return of.join(smallest, "root").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12(spark, sf_dir: str) -> DataFrame:
    """All vectors of embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: All pairs, which the operator avoids.
OP12_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(least(a, b)) AS component_id FROM reached GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id
"""
