"""Plain versions to test against."""

import hashlib


def jaccard_components(rows):
    """{row number: (n_shingles, smallest doc_id reachable)} for rows (doc_id, text)."""
    table = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, t in rows:
        w = (t or "").translate(table).encode().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {j for x in s for j in where[x] if j < i}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= 75 * len(s | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, d), d)
    return [(d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def repeated_bytes(rows, k=400):
    """[(doc_id, n_bytes, n_removed, n_spans, sha)] for rows (doc_id, text)."""
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for i, (_, b) in enumerate(data):
        for s in range(len(b) - k + 1):
            h = b[s : s + k]
            seen[h] = seen.get(h, 0) + 1
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - k + 1):
            if seen[b[s : s + k]] > 1:
                gone[s : s + k] = b"\1" * k
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out
