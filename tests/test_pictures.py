import math
import struct
import zlib

import numpy as np
import pytest

from basketry.sources import pictures as P


def pgm(g, comment=b""):
    return b"P5\n" + comment + f"{g.shape[1]} {g.shape[0]}\n255\n".encode() + g.astype(np.uint8).tobytes()


def ppm(x):
    return f"P6 {x.shape[1]} {x.shape[0]} 255\n".encode() + x.astype(np.uint8).tobytes()


def png(x, how):
    """x (rows, columns, channels) with one filter for all rows, or each in turn."""
    h, w, n = x.shape
    rows, above = [], np.zeros(w * n, int)
    for y in range(h):
        line = x[y].reshape(-1).astype(int)
        left, corner = np.concatenate([np.zeros(n, int), line[:-n]]), np.concatenate([np.zeros(n, int), above[:-n]])
        k = y % 5 if how is None else how
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        rows.append(bytes([k]) + bytes(((line - (0, left, above, (left + above) // 2, paeth)[k]) & 255).astype(np.uint8)))
        above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = zlib.compress(b"".join(rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", data[:20]) + chunk(b"IDAT", data[20:]) + chunk(b"IEND", b"")


def test_decoders_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4):
        x = rng.integers(0, 256, (11, 7, n), dtype=np.uint8)
        want = np.repeat(x[:, :, :1], 3, 2) if n < 3 else x[:, :, :3]
        for how in (0, 1, 2, 3, 4, None):
            assert (P.decoded(png(x, how)) == want).all()
    g = rng.integers(0, 256, (5, 9), dtype=np.uint8)
    assert (P.decoded(pgm(g, b"# made\n"))[:, :, 1] == g).all() and (P.decoded(ppm(np.stack([g] * 3, 2)))[:, :, 2] == g).all()
    assert all(P.decoded(b) is None for b in (b"", b"P5", b"P5 9 9 255\nxx", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", png(g[:, :, None], 0)[:50]))


def test_measures_against_plain_loops():
    rng = np.random.default_rng(3)
    g = rng.integers(0, 256, (9, 12)).astype(np.uint8)
    at = lambda y, x: float(g[abs(y) if y < 9 else 16 - y, abs(x) if x < 12 else 22 - x])
    lap = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(9) for x in range(12)]
    k = [1, 4, 6, 4, 1]
    blur = [round(sum(k[i] * k[j] * at(y + i - 2, x + j - 2) for i in range(5) for j in range(5)) / 256) for y in range(9) for x in range(12)]
    m = dict(zip(P.MEASURES, P.measures(pgm(g))))
    assert m["sharpness"] == pytest.approx(np.var(lap)) and m["noise"] == pytest.approx(np.mean(np.abs(g.ravel() - np.array(blur)))) and (m["width"], m["height"]) == (12, 9)
    assert m["spread"] == pytest.approx(np.std(g)) and m["brightness"] == pytest.approx(np.mean(g)) and m["saturation"] == 0

    def within(t):
        a, b = g[g <= t].astype(float), g[g > t].astype(float)
        return sum(len(x) * x.var() for x in (a, b) if len(x))

    cut = min(range(int(g.min()), int(g.max())), key=lambda t: (round(within(t), 6), t))
    assert m["text"] == pytest.approx((g <= cut).mean())


def page(width=640, height=400, angle=0.0):
    """A white page with dark lines, turned by an angle."""
    y, x = np.mgrid[:height, :width]
    d = y * math.cos(math.radians(angle)) - x * math.sin(math.radians(angle))
    return np.where((d % 40 < 4) & (d > 30), 20, 245).astype(np.uint8)


def test_known_pictures(spark, tmp_path):
    rng = np.random.default_rng(4)
    white = np.full((400, 640), 250, np.uint8)
    upright = np.where(np.mgrid[:400, :640][1] % 40 < 4, 20, 245).astype(np.uint8)
    files = {"page.pgm": pgm(upright), "turned.png": png(page(angle=-60)[:, :, None], 1), "white.pgm": pgm(white), "noisy.pgm": pgm(rng.integers(0, 256, (400, 640))), "dark.pgm": pgm(white // 20), "small.pgm": pgm(upright[:200, :200]), "broken.pgm": b"P5 9", "red.ppm": ppm(np.dstack([upright, upright // 3, upright // 3])), "none.txt": b"x"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    df = P.measured(P.picture_files(spark, str(tmp_path), "*.p*"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in df.select("path", "measures", P.quality(df["measures"]).alias("q"), P.acceptable(df["measures"]).alias("a")).collect()}
    assert set(rows) == set(files) - {"none.txt"}
    m, q, a = ({k: r[f] for k, r in rows.items()} for f in ("measures", "q", "a"))
    assert m["page.pgm"].text == pytest.approx(0.1) and m["page.pgm"]["skew"] == 0 and a["page.pgm"] == [] and q["page.pgm"].issues == [] and q["page.pgm"].process and q["page.pgm"].level == "high"
    assert abs(m["turned.png"]["skew"]) == pytest.approx(30, abs=1) and q["turned.png"].issues == ["skew"] and not q["turned.png"].process
    assert m["white.pgm"].sharpness == 0 and m["white.pgm"].noise == 0 and m["white.pgm"].edges == 0 and a["white.pgm"] == ["blurred", "bright", "empty"]
    # Sharpness and contrast have 0.3 at least, which the gate lets pass; the rest is a noiseless empty page.
    assert q["white.pgm"].score == pytest.approx((0.3 + 0.3 + 1 + 0.2) / 4) and q["white.pgm"].level == "low"
    assert m["noisy.pgm"].noise > 20 and "noise" in q["noisy.pgm"].issues and m["noisy.pgm"].edges > 0.1
    assert a["dark.pgm"][:2] == ["blurred", "dark"] and a["small.pgm"] == ["small"] and q["small.pgm"].issues == ["width"]
    assert m["broken.pgm"].width is None and a["broken.pgm"] == ["unreadable"] and (q["broken.pgm"].score, q["broken.pgm"].level, q["broken.pgm"].process) == (0.0, "low", False)
    assert m["red.ppm"].saturation > 100


def test_no_bytes(spark):
    df = P.measured(spark.createDataFrame([(1, None), (2, bytearray())], "id int, content binary"))
    assert [r.measures.width for r in df.collect()] == [None, None]
    assert P.measured(spark.createDataFrame([], "id int, content binary")).count() == 0
