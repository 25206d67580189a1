"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. Wider patterns find candidates: addresses whose marks are spelt out or set apart, numbers
grouped in other ways, dotted numbers in brackets, cards glued to other digits. Candidates and base spans are the nodes
of a graph for each document: neighbours in the text are linked in a chain, and each node is linked to the previous one
with the same skeleton (its letters and digits, spelt-out marks left out), however distant, and by a weaker link to the
previous one with a similar skeleton: numbers that end in the same nine digits, addresses of which one goes on where
the other ends. Links follow from one occurrence to the next, so a token that occurs n times has n - 1 links, and as
many weaker ones at most.

Node potentials come from a softmax regression on a node's shape and the cue word before it. It learns from the base
spans of a bounded sample of documents, each also disguised in several ways behind a cue, behind none, and with its
characters replaced by others (which is no personal data), and from the candidates that no pattern knows, at half
weight. So a number that only looks like a phone's is undecided by itself, and a cue or a link settles it. Chain and
skip potentials come from counts. Loopy belief propagation with the base nodes held fixed labels the candidates; those
that are surely personal are added.

Defined results: null and empty texts have no spans; base spans always stay, and no added span touches one; equal
texts get equal spans; texts are read whole, in time that grows in proportion to their length; other columns pass as
they are, and one that has the name of a result is renamed to in_<name>; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .shared import hash_sample, set_apart, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Belief from which a candidate is added, rounds of message passing, texts that are learned from.
SURE, ROUNDS, MAX_TRAIN = 0.8, 20, 1000
#: Before any is counted: so many pairs of equal tokens with equal labels for each with unequal ones.
PRIOR = 1000.0
#: Similar skeletons: digits at the end of numbers, letters at the start of addresses, the weight of their links.
TAIL, HEAD, WEAKER = 9, 7, 0.9
RESULTS = ("base", "spans", "counts")
#: Cue words of each label, looked for in the CONTEXT characters before a token.
CUES = {
    "other": ("order", "invoice", "code", "id", "ref", "no", "nr", "number", "isbn", "version", "page", "serial", "ticket"),
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell"),
}
CONTEXT = 32
CUE = re.compile("|".join(rf"(?P<{k}>\b(?:{'|'.join(v)})\b)" for k, v in CUES.items()), re.I)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Candidates: at signs, also set apart or spelt out, and what may follow; runs of digits with the marks that numbers
#: are grouped by; four small numbers with dots in brackets or spelt out.
AT = re.compile(r"\s@\s|@|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s(?=[a-z0-9-]++\sdot\s[a-z])", re.I)
NOT_NAME = frozenset(" \t\r\n\f\v@<>()[],;:\"")
BEHIND_AT = re.compile(r"[^\s@<>()\[\],;:\"]++")
DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)"
SPELT = re.compile(rf"[a-z0-9-]++(?:{DOT}[a-z0-9-]++)+", re.I)
NEAR_NUMBER = re.compile(r"[+(]?[0-9](?:[ ().,/-]{0,2}[0-9])++")
NEAR_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\s\.\s)[0-9]{1,3}){3}(?![0-9])", re.I)
SPELT_MARK = re.compile(r"[\[({<]\s?(?:at|dot|@|\.)\s?[\])}>]|\s(?:at|dot)\s")
NOT_DIGIT, NOT_ALNUM = re.compile(r"[^0-9]"), re.compile(r"[^0-9a-z]")
#: Digits in each group of cards and phone numbers.
CARD_GROUPS, PHONE_GROUPS = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5)}, {(3, 3, 4), (1, 3, 3, 4), (3, 4), (3, 4, 4), (4, 6), (5, 6), (2, 2, 4, 4)}


def emails(text: str):
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, going from one at sign to the next."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def small_part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or 0) <= 255


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(d * 2 - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), in that order."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small_part, m.groups()))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def near_addresses(text: str):
    """(start, end) around every at sign that has a name before and something like a domain behind; linear in the text."""
    done = 0
    for m in AT.finditer(text):
        at, plain = m.start(), m[0] == "@"
        if at < done:
            continue
        start = at
        while start > done and (text[start - 1] not in NOT_NAME if plain else text[start - 1] in LOCAL):
            start -= 1
        behind = SPELT.match(text, m.end()) or (BEHIND_AT.match(text, m.end()) if plain else None)
        if start < at and behind:
            done = behind.end()
            yield start, done


def inner_cards(piece: str):
    """(start, end) of cards among the groups of digits of a longer run."""
    groups = [m.span() for m in re.finditer(r"[0-9]+", piece)]
    sizes = [e - s for s, e in groups]
    at = 0
    while at < len(groups):
        for n in (5, 4, 3, 1):
            own = tuple(sizes[at : at + n])
            if len(groups) > n and len(own) == n and (own in CARD_GROUPS or n == 1 and 13 <= own[0] <= 19):
                s, e = groups[at][0], groups[at + n - 1][1]
                if luhn(NOT_DIGIT.sub("", piece[s:e])):
                    yield s, e
                    at += n - 1
                    break
        at += 1


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of other candidates, none of which touches a base span."""
    found = list(near_addresses(text))
    if DIGIT.search(text):
        found += [m.span() for m in NEAR_IP.finditer(text)]
        for m in NEAR_NUMBER.finditer(text):
            if m.end() - m.start() >= 7:
                inner = [(m.start() + s, m.start() + e) for s, e in inner_cards(m[0])]
                found += inner or [m.span()]
    out, k, last = [], 0, 0
    taken = []
    for s, _, e in base:  # merged
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s >= last and not (k < len(taken) and taken[k][0] < e):
            out.append((s, e))
            last = e
    return out


def skeleton(piece: str) -> str:
    return NOT_ALNUM.sub("", SPELT_MARK.sub("", piece.lower()))


def shape(text: str, s: int, e: int) -> list[bool]:
    """What the node potentials see of a span: its make-up and the last cue before it."""
    piece = text[s:e]
    digits = NOT_DIGIT.sub("", piece)
    n, dots, letters = len(digits), piece.count("."), any(c.isalpha() for c in piece)
    groups = tuple(map(len, re.findall(r"[0-9]+", piece)))
    four = len(groups) == 4 and not re.search(r"[^0-9.\s\[\](){}<>dot]", piece) and max(groups) <= 3
    octets = four and all(int(x) <= 255 for x in re.findall(r"[0-9]+", piece))
    at = AT.search(f" {piece} ") is not None
    cue = None
    for m in CUE.finditer(text, max(0, s - CONTEXT), s):
        cue = m.lastgroup
    number = not at and not four
    whole = [digits[sum(groups[:i]) : sum(groups[: i + 1])] for i in range(len(groups))]
    return [
        True, at, at and "@" in piece, at and SPELT_MARK.search(f" {piece.lower()} ") is not None, at and SPELT.search(piece[max(0, piece.rfind("@")) :]) is not None, at and re.search(r"\sat\s", piece) is not None,
        four and octets, four and not octets, number and n < 7, number and 7 <= n < 9, number and 9 <= n < 12, number and 12 <= n < 16, number and 16 <= n < 20, number and n >= 20,
        number and 12 <= n <= 19 and luhn(digits), number and 12 <= n <= 19 and not luhn(digits), number and (groups in CARD_GROUPS or len(whole) == 1 and 13 <= n <= 19),
        number and groups in PHONE_GROUPS, number and piece[0] == "+", number and "(" in piece, number and "-" in piece, number and " " in piece, number and dots > 0, letters and not at and not four,
        *(cue == k for k in CUES),
    ]


def graph(text: str, nodes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Skip links: each node with the previous one of the same skeleton."""
    last: dict[str, int] = {}
    out = []
    for i, (s, e) in enumerate(nodes):
        key = skeleton(text[s:e])
        if len(key) >= 7:
            if key in last:
                out.append((last[key], i))
            last[key] = i
    return out


def similar(text: str, nodes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Weaker skip links: each node with the previous one of its block, if their skeletons are similar but not equal."""
    last: dict[str, tuple[int, str]] = {}
    out = []
    for i, (s, e) in enumerate(nodes):
        key = skeleton(text[s:e])
        number = key.isdigit()
        if len(key) < (TAIL if number else HEAD):
            continue
        block = key[-TAIL:] if number else "@" + key[:HEAD]
        j, other = last.get(block, (i, key))
        if key != other and (number or key.startswith(other) or other.startswith(key)):
            out.append((j, i))
        last[block] = i, key
    return out


def disguised(piece: str, kind: str, rng: random.Random) -> str:
    """A base span in a form that the base patterns don't know."""
    digits = NOT_DIGIT.sub("", piece)
    if kind == "email":
        name, _, domain = piece.rpartition("@")
        at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" @ ", "."), ("[at]", "."), (" <at> ", " <dot> ")])
        return name + at + domain.replace(".", dot)
    if kind == "ip":
        return rng.choice(["[.]", "(.)", " [dot] ", " dot ", " . "]).join(piece.split("."))
    if kind == "card":
        by_four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return rng.choice([".".join(by_four), "/".join(by_four), "  ".join(by_four), ", ".join(by_four)])
    last = digits[-10:].rjust(10, "2")
    a, b, c = last[:3], last[3:6], last[6:]
    return rng.choice([digits, f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1 {a}-{b}-{c}", f"00{digits}"])


def others(piece: str, kind: str, rng: random.Random) -> str | None:
    """The same form with other characters, which is no personal data of the kind; None where any such form would be."""
    if kind == "email":
        if " at " in piece:  # prose may have these words
            return re.sub("[A-Za-z0-9]+", lambda m: m[0] if m[0] in ("at", "dot") else "".join(rng.choice("abcdefghinorstu") for _ in m[0]), piece)
        return re.sub(r"\s", "", piece).split(".")[0] if " @ " in piece else None
    while True:
        out = "".join(rng.choice("0123456789") if c.isdigit() else c for c in piece)
        if kind == "ip":
            numbers = [str(rng.randrange(256, 1000)) for _ in range(4)]
            return re.sub("[0-9]+", lambda m: numbers.pop(), piece)
        if kind != "card" or not luhn(NOT_DIGIT.sub("", out)):
            return out


def evidence(text: str) -> Counter:
    """Weighted counts of (x, features, label), (chain, label, label) and (skip, label, label) of a text, its base spans' disguises included."""
    out: Counter = Counter()

    def seen(own, s, e, label, weight=1.0):
        out["x", sum(1 << i for i, v in enumerate(shape(own, s, e)) if v), label] += weight

    base = base_spans(text)
    marked = sorted([(s, e, k + 1) for s, k, e in base] + [(s, e, 0) for s, e in candidates(text, base)])
    rng = random.Random(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))
    for s, e, label in marked:
        seen(text, s, e, label, 1.0 if label else 0.5)
        if not label:
            continue
        kind, before = LABELS[label], CUE.sub("", text[max(0, s - CONTEXT) : s])
        for cue, true in ((rng.choice(CUES[kind]) + " ", True), ("", True), ("", False), (rng.choice(CUES["other"]) + " ", False)):
            piece = disguised(text[s:e], kind, rng)
            piece = piece if true else others(piece, kind, rng)
            if piece:
                own = f"{before} {cue}{piece}"
                seen(own, len(own) - len(piece), len(own), label if true else 0)
    labels = [k for _, _, k in marked]
    for a, b in zip(labels, labels[1:]):
        out["chain", a, b] += 1.0
    for i, j in graph(text, [m[:2] for m in marked]):
        a, b = labels[i], labels[j]
        if a and b:  # what no pattern knows isn't evidence against
            out["skip", a, b] += 1.0
            out["skip", b, a] += 1.0
    return out


class Model:
    """Potentials: node weights (features x labels), chain and skip tables (labels x labels, logarithms)."""

    def __init__(self, weights, chain, skip):
        self.weights, self.chain, self.skip = (np.asarray(x, float) for x in (weights, chain, skip))

    @classmethod
    def fit(cls, texts: list[str]) -> Model:
        return cls.of_counts(sum((evidence(t) for t in texts), Counter()))

    @classmethod
    def of_counts(cls, counts: dict, steps: int = 1500, rate: float = 2.0, decay: float = 1e-4) -> Model:
        n, m = len(LABELS), len(shape("+", 0, 1))
        chain, skip = np.ones((n, n)), np.ones((n, n)) + (PRIOR - 1) * np.eye(n)
        rows = [(1, 0, 1.0)]
        for (what, a, b), v in sorted(counts.items()):
            if what == "x":
                rows.append((a, b, v))
            else:
                (chain if what == "chain" else skip)[a, b] += v
        x = np.asarray([[a >> i & 1 for i in range(m)] for a, _, _ in rows], float)
        y, own = np.eye(n)[[b for _, b, _ in rows]], np.asarray([[v] for _, _, v in rows])
        w = np.zeros((m, n))
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w += rate * (x.T @ (own * (y - p)) / own.sum() - decay * w)
        share = lambda t: np.log(t / t.sum() / np.outer(t.sum(1), t.sum(0)) * t.sum() ** 2)
        return cls(w, 0.2 * np.clip(share(chain), -2, 2), np.log(skip / skip.sum(1, keepdims=True)))

    def marginals(self, x, fixed, skips, near=()) -> np.ndarray:
        """Beliefs of all nodes; fixed: the label of a base node or -1; near: weaker skip links."""
        n, k = len(x), len(LABELS)
        node = x @ self.weights
        node = np.where(fixed[:, None] >= 0, np.where(np.arange(k) == fixed[:, None], 0.0, -1e3), node)
        pairs = [(i, i + 1) for i in range(n - 1)] + skips + list(near)
        if not pairs:
            z = np.exp(node - node.max(1, keepdims=True))
            return z / z.sum(1, keepdims=True)
        a, b = np.asarray(pairs).T
        table = np.concatenate([np.repeat(self.chain[None], n - 1, 0), np.repeat(self.skip[None], len(skips), 0), np.repeat(WEAKER * self.skip[None], len(near), 0)])
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        msg = np.zeros((len(src), k))
        for _ in range(ROUNDS):
            belief = node.copy()
            np.add.at(belief, dst, msg)
            out = (belief[src] - msg[back])[:, :, None] + table
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            new = 0.5 * new + 0.5 * msg
            if np.abs(new - msg).max() < 1e-4:
                msg = new
                break
            msg = new
        belief = node.copy()
        np.add.at(belief, dst, msg)
        z = np.exp(belief - belief.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def added(self, text: str, base: list[tuple[int, int, int]], links: bool = True) -> list[tuple[int, int, int]]:
        """Spans that the field adds to the base spans. links=False leaves the skip links out, to show what they explain."""
        more = candidates(text, base)
        if not more:
            return []
        nodes = sorted([(s, e, k + 1) for s, k, e in base] + [(s, e, -1) for s, e in more])
        fixed = np.asarray([k for _, _, k in nodes])
        x = np.asarray([shape(text, s, e) for s, e, _ in nodes], float)
        spans = [m[:2] for m in nodes]
        p = self.marginals(x, fixed, graph(text, spans) if links else [], similar(text, spans) if links else [])
        return [(nodes[i][0], int(p[i].argmax()) - 1, nodes[i][1]) for i in np.flatnonzero(fixed < 0) if p[i].argmax() and p[i].max() >= SURE]

    def packed(self) -> str:
        return json.dumps([self.weights.tolist(), self.chain.tolist(), self.skip.tolist()])


def train(docs: DataFrame, max_texts: int = MAX_TRAIN) -> Model:
    """A model from the max_texts whole texts with digits or an at sign whose hash is smallest. Only counts come to the driver, a row for each set of features."""
    small_batches(docs.sparkSession)
    rows = docs.where("text IS NOT NULL").where(F.col("text").rlike("[0-9@]")).select("text")

    def run(batches):
        for pdf in batches:
            total = sum(map(evidence, pdf["text"]), Counter())
            yield pd.DataFrame([(*k, v) for k, v in total.items()], columns=["what", "a", "b", "n"])

    counts = hash_sample(rows, max_texts).mapInPandas(run, "what string, a long, b long, n double").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Model.of_counts({(r["what"], r["a"], r["b"]): r["n"] for r in counts})


def said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with text) -> its columns, base and spans (lists of "kind:start:end" joined by commas), counts of base spans by kind."""
    small_batches(docs.sparkSession)
    docs = set_apart(docs, RESULTS)
    parts = model.packed()
    schema = StructType([*docs.schema, StructField("base", StringType()), StructField("spans", StringType()), StructField("counts", ArrayType(LongType()))])
    names = to_arrow_schema(schema).names

    def run(batches):
        own = Model(*json.loads(parts))
        for batch in batches:
            base, spans, counts = [], [], []
            for t in batch.column("text").to_pylist():
                b = base_spans(t or "")
                base.append(said(b))
                spans.append(said(sorted(b + own.added(t or "", b))))
                counts.append([sum(k == i for _, k, _ in b) for i in range(len(KINDS))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(counts, pa.list_(pa.int64()))], names)

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; spans that overlap become one. Null texts stay null."""
    small_batches(docs.sparkSession)
    parts = model.packed()

    def run(batches):
        own = Model(*json.loads(parts))

        def clean(t):
            if t is None:
                return None
            b = base_spans(t)
            out, at, stop = [], 0, 0
            for s, k, e in sorted(b + own.added(t, b)):
                if s >= stop:
                    out += [t[at:s], f"<{KINDS[k]}>"]
                at = stop = max(stop, e)
            return "".join([*out, t[at:]])

        for batch in batches:
            i = batch.schema.get_field_index("text")
            columns = list(batch.columns)
            columns[i] = pa.array([clean(t) for t in columns[i].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find(docs, train(docs))
    return out.select("doc_id", *(F.col("counts")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2("base", 256).alias("base_sha256"), "spans")


__all__ = ["Model", "base_spans", "find", "op9", "redact", "train"]
