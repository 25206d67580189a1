"""Pictures: files read as bytes, decoded and measured in tasks; scores, levels and gates are columns of the measures.

Portable maps (P5, P6) and PNG (8 bits a channel, not interlaced) are decoded here; of other and broken files all measures
are null, which every judgement below counts as a picture that can't be read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MEASURES = ("width", "height", "sharpness", "spread", "noise", "brightness", "edges", "skew", "text", "saturation")
# Limits of scores, levels and gates.
LEVELS = [("high", 0.75), ("medium", 0.5)]
GATE = {"sharpness": 0.3, "contrast": 0.3, "noise": 0.2, "width": 600, "skew": 20, "text": 0.005}
#: Share of edge pixels below which a picture has this complexity; more than the last is very complex.
COMPLEXITY = [(0.005, 0.2), (0.02, 0.7), (0.15, 0.8)]
VERY_COMPLEX = 0.4
RELAXED = {"sharpness": 20, "dark": 20, "bright": 240, "side": 300, "ratio": 10.0, "edges": 0.001}
#: Of a note on a white screen two of three hold: little colour, few edges, little text.
NOTE = {"saturation": 50, "edges": 0.05, "text": 0.02}


def picture_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content of all files under path whose names fit."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def decoded(data: bytes) -> np.ndarray | None:
    """Rows of pixels of three channels (red, green, blue), None if the bytes are no picture of a known kind."""
    try:
        if data[:2] in (b"P5", b"P6"):
            head = re.match(rb"P[56](?:\s+(?:#[^\n]*\n)?)+(\d+)(?:\s+(?:#[^\n]*\n)?)+(\d+)(?:\s+(?:#[^\n]*\n)?)+(\d+)\s", data)
            w, h, most = map(int, head.groups())
            n = 3 if data[:2] == b"P6" else 1
            if most != 255 or not w or not h:
                return None
            pixels = np.frombuffer(data, np.uint8, w * h * n, head.end()).reshape(h, w, n)
            return np.repeat(pixels, 3, 2) if n == 1 else pixels
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, AttributeError, zlib.error, IndexError):
        pass
    return None


def _png(data: bytes) -> np.ndarray | None:
    at, parts, head = 8, [], b""
    while at + 8 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    w, h, bits, colour, interlaced = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9], head[12]
    n = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if bits != 8 or interlaced or n is None:
        return None
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, (w + 1) * n), np.int64)  # a row above and a pixel before, both empty
    for y in range(h):
        how, line, above, own = raw[y, 0], raw[y, 1:].astype(np.int64), out[y], out[y + 1]
        if how == 0:
            own[n:] = line
        elif how == 1:  # sums of a channel's differences, from the left
            own[n:] = (np.cumsum(line.reshape(w, n), 0) & 255).ravel()
        elif how == 2:
            own[n:] = (line + above[n:]) & 255
        else:
            for i in range(n, len(own)):
                a, b, c = own[i - n], above[i], above[i - n]
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                own[i] = (line[i - n] + guess) & 255
    pixels = out[1:, n:].reshape(h, w, n).astype(np.uint8)
    return np.repeat(pixels[:, :, :1], 3, 2) if n < 3 else pixels[:, :, :3]


def gray(pixels: np.ndarray) -> np.ndarray:
    return np.rint(pixels @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _around(g: np.ndarray, by: int) -> np.ndarray:
    """g with by more rows and columns on each side, mirrored without the edge itself where it is large enough."""
    return np.pad(g.astype(np.float64), by, mode="reflect" if min(g.shape) > by else "edge")


def laplacian(g: np.ndarray) -> np.ndarray:
    p = _around(g, 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def blurred(g: np.ndarray) -> np.ndarray:
    """Gaussian of five by five pixels, in whole levels."""
    p, weights = _around(g, 2), np.array([1, 4, 6, 4, 1]) / 16
    p = sum(w * p[i : i + g.shape[0]] for i, w in enumerate(weights))
    return np.rint(sum(w * p[:, i : i + g.shape[1]] for i, w in enumerate(weights)))


def edge_pixels(g: np.ndarray, low: float, high: float) -> np.ndarray:
    """Pixels on edges: gradients that are largest across their direction, above high or connected to such by ones above low."""
    p = _around(g, 1)
    dx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    dy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    size = np.abs(dx) + np.abs(dy)
    q = np.pad(size, 1)
    side = lambda y, x: q[1 + y : q.shape[0] - 1 + y, 1 + x : q.shape[1] - 1 + x]
    flat, steep = np.abs(dy) < np.abs(dx) * 0.41421356, np.abs(dy) > np.abs(dx) * 2.41421356
    same = (dx < 0) == (dy < 0)
    before = np.select([flat, steep, same], [side(0, -1), side(-1, 0), side(-1, -1)], side(-1, 1))
    after = np.select([flat, steep, same], [side(0, 1), side(1, 0), side(1, 1)], side(1, -1))
    may = (size > low) & (size > before) & (size >= after)
    out = may & (size > high)
    while True:  # what touches an edge and may be one is one
        r = np.pad(out, 1)
        grown = may & (sum(r[y : y + out.shape[0], x : x + out.shape[1]] for y in range(3) for x in range(3)) > 0)
        if (grown == out).all():
            return out
        out = grown


def skew(g: np.ndarray, least: int = 50, lines: int = 20) -> float:
    """The median angle of the strongest straight lines, of those within 45 degrees; 0 without any."""
    ys, xs = np.nonzero(edge_pixels(g, 30, 100))
    if not len(ys):
        return 0.0
    far, strong = int(np.hypot(*g.shape)) + 2, []
    for t in range(180):
        votes = np.bincount(np.rint(xs * np.cos(np.pi * t / 180) + ys * np.sin(np.pi * t / 180)).astype(np.int64) + far)
        at = np.flatnonzero(votes > least)
        strong.append(np.stack([-votes[at], np.full(len(at), t), at], 1))
    strong = np.concatenate(strong)
    best = strong[np.lexsort(strong.T[::-1])][:lines, 1]
    turned = np.where(best > 90, best - 180, best)
    turned = turned[np.abs(turned) <= 45]
    return float(np.median(turned)) if len(turned) else 0.0


def text_share(g: np.ndarray) -> float:
    """The share of dark pixels, where dark and light are told apart best (Otsu)."""
    n = np.bincount(g.ravel(), minlength=256).astype(np.float64)
    below, total = np.cumsum(n), n.sum()
    sums = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = (sums[-1] * below - total * sums) ** 2 / (below * (total - below))
    cut = int(np.nan_to_num(apart, nan=-1.0, posinf=-1.0).argmax())
    return float(below[cut] / total)


def measures(data: bytes, asked: tuple = MEASURES) -> tuple | None:
    """The measures that are asked for, in that order; None if the bytes are no picture."""
    pixels = decoded(data)
    if pixels is None:
        return None
    g = gray(pixels)

    def saturation() -> float:
        most, least = pixels.max(2).astype(np.float64), pixels.min(2)
        return float(np.where(most > 0, np.rint(255 * (most - least) / np.maximum(most, 1)), 0).mean())

    of = {
        "width": lambda: g.shape[1], "height": lambda: g.shape[0], "sharpness": lambda: float(laplacian(g).var()), "spread": lambda: float(g.std()), "noise": lambda: float(np.abs(g - blurred(g)).mean()),
        "brightness": lambda: float(g.mean()), "edges": lambda: float(edge_pixels(g, 50, 150).mean()), "skew": lambda: skew(g), "text": lambda: text_share(g), "saturation": saturation,
    }
    return tuple(of[name]() for name in asked)


def measured(pictures: DataFrame, content: str = "content", column: str = "measures", asked: tuple = MEASURES) -> DataFrame:
    """pictures (with content) -> the same with the measures asked for (all, if nothing is said), null where the bytes can't be decoded."""
    kinds = ", ".join(f"{name}: {'int' if name in ('width', 'height') else 'double'}" for name in asked)

    @F.pandas_udf(f"struct<{kinds}>")
    def run(data: pd.Series) -> pd.DataFrame:
        rows = [None if d is None else measures(bytes(d), asked) for d in data]
        out = pd.DataFrame([r or (None,) * len(asked) for r in rows], columns=list(asked))
        return out.astype({name: "Int32" if name in ("width", "height") else "float64" for name in asked})

    return pictures.withColumn(column, run(content))


def scores(m: Column) -> dict[str, Column]:
    """sharpness, contrast, noise and complexity of measures, each up to 1."""
    lim = lambda c, by: F.greatest(F.least(c / by, F.lit(1.0)), F.lit(0.3))
    complexity = F.lit(VERY_COMPLEX)
    for below, score in reversed(COMPLEXITY):
        complexity = F.when(m.edges <= below if below == COMPLEXITY[-1][0] else m.edges < below, score).otherwise(complexity)
    return {"sharpness": lim(m.sharpness, 300), "contrast": lim(m.spread, 30), "noise": F.greatest(F.lit(0.0), 1 - m.noise / 20), "complexity": complexity}


def is_note(m: Column) -> Column:
    """Whether two of three marks of a note on a screen hold."""
    return sum(F.when(m[k] < v, 1).otherwise(0) for k, v in NOTE.items()) >= 2


def quality(m: Column) -> Column:
    """(score, level, issues, process): the mean of four scores, its level, what keeps the picture out, and whether it is read."""
    s, readable = scores(m), m.width.isNotNull()
    mean = F.when(readable, (s["sharpness"] + s["contrast"] + s["noise"] + s["complexity"]) / 4).otherwise(0.0)
    level = F.lit("low")
    for name, least in reversed(LEVELS):
        level = F.when(mean >= least, name).otherwise(level)
    issues = F.array_compact(F.array(
        F.when(~readable, "unreadable"), F.when(s["sharpness"] < GATE["sharpness"], "sharpness"), F.when(s["contrast"] < GATE["contrast"], "contrast"), F.when(s["noise"] < GATE["noise"], "noise"),
        F.when(m.width < GATE["width"], "width"), F.when(F.abs(m["skew"]) > GATE["skew"], "skew"), F.when((m.text < GATE["text"]) & ~is_note(m), "text"),
    ))
    return F.struct(F.round(mean, 6).alias("score"), level.alias("level"), issues.alias("issues"), (readable & (F.size(issues) == 0) & (level != "low")).alias("process"))


def acceptable(m: Column) -> Column:
    """The issues of the relaxed check, none for an acceptable picture."""
    ratio, side = m.width / m.height, F.least(m.width, m.height)
    return F.array_compact(F.array(
        F.when(m.width.isNull(), "unreadable"), F.when(m.sharpness < RELAXED["sharpness"], "blurred"), F.when(m.brightness < RELAXED["dark"], "dark").when(m.brightness > RELAXED["bright"], "bright"),
        F.when(side < RELAXED["side"], "small"), F.when((ratio > RELAXED["ratio"]) | (ratio < 1 / RELAXED["ratio"]), "narrow"), F.when(m.edges < RELAXED["edges"], "empty"),
    ))
