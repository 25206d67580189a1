import hashlib
import math

import numpy as np
import pytest
from basketry.llm import lloyd, sorted_passes


def plain_links(rows, least=0.9):
    """[(vec_id, n_links, component_id)] of (vec_id, vector or None) by comparing all."""
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    u = [np.array(v, float) / np.abs(v).max() if ok else None for ok, (_, v) in zip(fine, rows)]
    up, n = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and len(u[i]) == len(u[j]) and u[i] @ u[j] / np.sqrt((u[i] @ u[i]) * (u[j] @ u[j])) >= least:
                n[i], n[j], up[root(i)] = n[i] + 1, n[j] + 1, root(j)
    small = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            small[root(i)] = min(small.get(root(i), d), d)
    return sorted(((d, n[i], small.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def got_links(spark, rows, **how):
    df = spark.createDataFrame([(d, v, "l") for d, v in rows], "vec_id long, embedding array<double>, n string")
    out = sorted_passes.near_vectors(df, **how).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str)


def cluster(rng, centre, size, spread):
    x = centre + spread * rng.normal(size=(size, len(centre))) / math.sqrt(len(centre))
    return (x * rng.uniform(0.1, 9, size=(size, 1))).tolist()


def test_copies_tight_and_loose_groups_and_edges(spark):
    rng = np.random.default_rng(4)
    a, b, c = (v / np.linalg.norm(v) for v in rng.normal(size=(3, 24)))
    vectors = [*cluster(rng, a, 60, 0.2), *cluster(rng, b, 50, 0.36), *cluster(rng, c, 2, 0.3), *rng.normal(size=(40, 24)).tolist()]
    vectors += [vectors[0]] * 5 + [(2 * np.array(vectors[0])).tolist(), (-np.array(vectors[0])).tolist()]
    vectors += [None, [], [0.0] * 24, [0.0, -0.0], [1.0, None], [1.0, math.nan], [math.inf, 1.0], [1.0, 0.0], [1.0, -0.0], [1e300, 1e299], [1e-300, 1e-301], [1.0]]
    rows = [(1000 - i, v) for i, v in enumerate(vectors)] + [(7, vectors[1]), (7, vectors[1]), (None, vectors[2]), (None, [5.0, 5.0, 1.0])]
    want = plain_links(rows)
    assert got_links(spark, rows, window=200, rounds=4) == want  # windows that see everything
    assert got_links(spark, rows, window=8, rounds=16, part=40, block=16) == want  # many partitions, small blocks


def test_recall_of_pairs_against_all_pairs(spark):
    """Pairs at a cosine of 0.9 to 0.93, the hardest, each by itself among as many vectors without a neighbour."""
    rng = np.random.default_rng(9)
    n = 1500
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=(n // 2, 64))
    y -= (y * x[: n // 2]).sum(1)[:, None] * x[: n // 2]
    y /= np.linalg.norm(y, axis=1)[:, None]
    cosine = rng.uniform(0.9001, 0.93, size=(n // 2, 1))
    rows = np.concatenate([x, cosine * x[: n // 2] + np.sqrt(1 - cosine**2) * y])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in sorted_passes.near_vectors(df).collect()}
    found = sum(out[n + i].component_id == i and out[i].n_links == 1 for i in range(n // 2))
    assert found >= 0.95 * (n // 2) and all(out[i].n_links == 0 for i in range(n // 2, n))


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert sorted_passes.near_vectors(none).count() == 0 and lloyd.lloyd(none).count() == 0
    only = spark.createDataFrame([(3, None), (4, [0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in sorted_passes.near_vectors(only).collect()) == [(3, 0, 3, True), (4, 0, 4, True)]


def plain_lloyd(rows, k, rounds, dims, scale=256, salt="2"):
    """{(vec_id, place): (cluster, distance, own, all, sha)} with Python's whole numbers."""
    kept = [(d, [math.floor(scale * x) for x in v]) for d, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))[:k]
    cs = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cs)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for i in range(len(cs)):
            own = [v for (_, v), (_, j) in zip(kept, at) if j == i]
            if own:
                cs[i] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    return sorted(((d, j, s, sum(x for x, y in at if y == j), sum(x for x, _ in at), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for (d, _), (s, j) in zip(kept, at)), key=str)


@pytest.mark.parametrize("far", [0.0, 4e7])
def test_lloyd_against_a_plain_version(spark, far):
    rng = np.random.default_rng(1)
    vectors = [(v + far * (i % 3 == 0)).tolist() for i, v in enumerate(rng.normal(size=(150, 6)))]  # far: squared differences pass 64 bits
    rows = list(enumerate(vectors)) + [(5, vectors[3]), (5, vectors[4]), (None, vectors[5]), (200, None), (201, [1.0] * 5), (202, [1.0, 2.0, None, 0.0, 0.0, 0.0]), (203, [math.nan] * 6), (204, [math.inf] * 6), (205, [0.5] * 6), (206, [0.5] * 6)]
    df = spark.createDataFrame([(d, v, 1) for d, v in rows], "vec_id long, embedding array<double>, cluster int")
    got = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in lloyd.lloyd(df, k=7, rounds=3, dims=6).collect()), key=str)
    assert got == plain_lloyd(rows, 7, 3, 6)


def test_more_clusters_than_vectors_and_empty_ones(spark):
    rows = [(i, [float(i // 2)] * 3) for i in range(6)]  # equal vectors: the higher of two equal centroids stays empty
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in lloyd.lloyd(df, k=9, rounds=2, dims=3).collect())
    assert got == plain_lloyd(rows, 9, 2, 3) and len({r[1] for r in got}) == 3
