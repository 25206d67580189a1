import random
import re

from basketry.llm import decontam, sharding, url_filter
from pyspark.sql import functions as F


def test_smallest_capacity_against_brute_force(spark):
    rng = random.Random(7)
    for shards, n in ((3, 40), (8, 60), (4, 2)):
        groups = [(f"{rng.randrange(16**8):08x}", rng.choice([1, 5, 30, 400])) for _ in range(n)]
        rows = [(i, k, s) for i, (k, s) in enumerate(groups) for _ in range(2)]
        out = sharding.shard(spark.createDataFrame(rows, "doc_id long, gkey string, size long"), shards).collect()
        sizes = [2 * s for _, s in sorted(groups)]

        def needed(c):
            used, at = 1, 0
            for s in sizes:
                if at + s > c:
                    used, at = used + 1, 0
                at += s
            return used

        best = next(c for c in range(max(sizes), sum(sizes) + 1) if needed(c) <= shards)
        totals, slots, of = {}, {}, {}
        for r in out:
            totals[r.shard] = totals.get(r.shard, 0) + r.size
            slots.setdefault(r.shard, []).append(r.slot)
            assert of.setdefault(r.gkey, r.shard) == r.shard
        assert max(totals.values()) == best and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding_of_nulls_and_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "x" * 50)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op10(spark, str(tmp_path)).collect()
    assert len(out) == 4 and sorted(r["size"] for r in out) == [1, 1, 1, 51]
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert sharding.op10(spark, f"{tmp_path}/none").count() == 0


def test_urls_and_rules(spark):
    urls = ["http://A.Example.org/es/1", "https://example.org/en/12?x", "http://x.org", "http://b.com/fr/", "http://b.com/de/#t", "nothing", None, "a://b://c/d", "http://z.net/?q", "http://notexample.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, none, url_filter.RULES).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1][1:] == ("/en/12", "example.org/en/1", "block")
    assert got[2] == ("x.org", "", None, "allow") and got[3][2:] == ("com/fr/", "allow") and got[4][1:] == ("/de/", "com/de/", "block")
    assert got[5][:2] == got[6][:2] == ("", "") and got[7][:2] == ("b:", "//c/d") and got[8][:2] == ("z.net", "/") and got[9][2:] == ("org/", "allow")


def plain_reputation(pages, outcomes, suffixes=(), z=1.645):
    """{page_id: (host, verdict without rules, rate)} with plain loops."""
    host_of = {}
    for p, u in pages:
        u = u or ""
        host_of[p] = re.split("[/?#]", u.split("://", 1)[1], maxsplit=1)[0].translate({c: c + 32 for c in range(65, 91)}) if "://" in u else ""

    def split(h):
        parts = h.split(".")
        k = max([i for i in range(1, len(parts) + 1) if ".".join(parts[-i:]) in suffixes], default=1)
        return ".".join(parts[-k - 1 :]), ".".join(parts[-k:])

    hosts = {}
    for p, _ in pages:
        if outcomes.get(p) is not None:
            n, k = hosts.get(host_of[p], (0, 0))
            hosts[host_of[p]] = n + 1, k + outcomes[p]

    def summed(level, up):
        out = {}
        for key, (n, k) in level.items():
            a, b = out.get(up(key), (0, 0))
            out[up(key)] = a + n, b + k
        return out

    domains = summed(hosts, split)
    tops = summed(domains, lambda d: d[1])
    n, k = (sum(x[i] for x in tops.values()) for i in (0, 1))
    overall = (k + 0.5) / (n + 1)

    def fitted(level, mu):
        room = sum(mu(g) * (1 - mu(g)) * (n - 1) for g, (n, k) in level.items())
        seen = sum(n * (k / n - mu(g)) ** 2 for g, (n, k) in level.items())
        rho = min(0.99, max(1e-4, (seen - sum(mu(g) * (1 - mu(g)) for g in level)) / room)) if room else None
        s = 1 / rho - 1 if room else 1.0
        return s, {g: (k + s * mu(g)) / (n + s) for g, (n, k) in level.items()}

    _, top = fitted(tops, lambda g: overall)
    _, domain = fitted(domains, lambda d: top[d[1]])
    s, _ = fitted(hosts, lambda h: domain[split(h)])
    out = {}
    for p, _ in pages:
        h = host_of[p]
        n, k = hosts.get(h, (0, 0))
        mu = domain.get(split(h), top.get(split(h)[1], overall))
        a, b = k + s * mu, n - k + s * (1 - mu)
        bound = a / (a + b) - z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
        out[p] = h, "block" if max(0.0, bound) > overall else "allow", a / (a + b)
    return out


def test_reputation_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()] + [(-1, None), (-2, "no url")]
    rng = random.Random(6)
    worse = {h: rng.random() for h in sorted({u.split("/")[2] for _, u in pages[:-2]})}
    made = {p: int(rng.random() < worse[u.split("/")[2]]) if rng.random() < 0.7 else None for p, u in pages[:-2]}
    table = {r.page_id: r.bad for r in url_filter.outcomes(spark, sf).collect()}
    df = spark.createDataFrame(pages, "page_id long, url string")
    for labels in (table, made):
        frame = spark.createDataFrame(list(labels.items()), "page_id long, bad int")
        want = plain_reputation(pages, labels, url_filter.TWO_LABEL_SUFFIXES)
        got = url_filter.filter_urls(df, frame).collect()
        assert len(got) == len(pages)
        for r in got:
            h, verdict, rate = want[r.page_id]
            assert (r.host, r.verdict) == (h, verdict) and abs(r.bad_rate - rate) < 1e-9
    assert {r.verdict for r in got} == {"allow", "block"}


def test_registered_domains(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "co.uk", "x.y.z.ck", "www.ck", "a.www.ck", "b.com", "com", "", "q.unknown.tld")], "host string")
    table = spark.createDataFrame([("co.uk",), ("uk",), ("*.ck",), ("!www.ck",), (None,)], "suffix string")
    got = {r.host: (r.domain, r.suffix) for r in url_filter.registered(hosts, table).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.z.ck": ("y.z.ck", "z.ck"), "www.ck": ("www.ck", "ck"), "a.www.ck": ("www.ck", "ck"), "b.com": ("b.com", "com"), "com": ("com", "com"), "": ("", ""), "q.unknown.tld": ("unknown.tld", "tld")}


def test_bad_hosts_are_blocked_and_unknown_ones_are_not(spark):
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}{i % 6}.site{i % 3}.net/p{i}") for i in range(600)] + [(1000, "http://new.other.net/")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)] + [(5, None)], "page_id long, bad int")
    frame = spark.createDataFrame(pages, "page_id long, url string")
    got = url_filter.filter_urls(frame, labels).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 and r.page_id < 600 else "allow") for r in got)
    quality = url_filter.held_back_quality(frame, labels)
    assert quality["precision"] == quality["recall"] == 1.0 and quality["pages"] > 100
    assert url_filter.filter_urls(frame.limit(0), labels).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(frame, labels.limit(0)).collect()} == {"allow"}


def plain_hits(docs, items):
    """{doc_id: (n_words, n_hit, items)} with plain loops."""
    low = {c: c + 32 for c in range(65, 91)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    known = {}
    for item, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            known.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for d, t in docs:
        w, gone, of = words(t), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    gone.update(range(i, i + n))
                    of |= known[tuple(w[i : i + n])]
        out[d] = (len(w), len(gone), sorted(of))
    return out


def test_decontamination_of_spans_and_documents(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    near = "one x three four five six seven eight nine ten eleven twelve thirteen"  # first and last word of a window alone
    rows = [(1, f"Before, {item.upper()}! After."), (2, None), (3, ""), (3, ""), (4, "short Item here"), (5, "clean text"), (6, f"{item} " + "word " * 1000), (None, near), (8, "Word, " * 30_000 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(7, item), (8, "short item"), (9, None), (10, "!!"), (7, item), (11, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(rows, items)
    for most in (decontam.SET_BYTES, 0):
        got = decontam.scan(docs, bench, set_bytes=most).collect()
        assert len(got) == len(rows) and all((r.n_words, r.n_hit, r["items"]) == want[r.doc_id] for r in got)
        assert sorted((r.doc_id for r in decontam.decontaminate(docs, bench, set_bytes=most).collect())) == [2, 3, 3, 5, 6, 8]
    cut = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, "spans").collect()}
    assert cut[1] == "Before, After." and cut[2] is None and cut[5] == "clean text"
    assert decontam.scan(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontam.scan(docs.limit(0), bench).count() == decontam.decontaminate(docs.limit(0), bench).count() == 0


def test_decontamination_keeps_columns_that_clash(spark):
    rows = [(1, "alpha beta gamma", "a", ["x"], 1, "k", "r", "w", "h", "d"), (2, "clean", "b", None, 2, None, "r", "w", "h", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, items array<string>, n_hit int, k1 string, row string, words string, hashes string, doc string")
    bench = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    out = {r.doc_id: r for r in decontam.scan(docs, bench).collect()}
    assert (out[1].in_spans, out[1].in_items, out[1].in_n_hit, out[1].n_hit, out[2].n_hit) == ("a", ["x"], 1, 2, 0)
    assert [tuple(r) for r in decontam.decontaminate(docs, bench).collect()] == [rows[1]]
    cut = sorted(map(tuple, decontam.decontaminate(docs, bench, "spans").collect()))
    assert cut == [(1, "alpha ", *rows[0][2:]), rows[1]] and decontam.decontaminate(docs, bench, "spans").columns == docs.columns


def test_sharding_keeps_columns_of_any_name_ids_that_are_null_and_long_texts(spark, tmp_path):
    names = ["number", "first", "slot", "shard", "part", "_part", "row", "n", "bytes", "cum", "block", "in_slot"]
    rows = [(None if i % 5 == 0 else i % 3, f"{i % 7:02x}", 10 + i % 7, *range(i, i + len(names))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, gkey string, size long, " + ", ".join(f"{n} long" for n in names))
    out = sharding.shard(df, 3)
    assert out.columns == ["doc_id", "gkey", "size", "number", "first", "in_in_slot", "in_shard", *names[4:], "shard", "slot"]
    got = out.collect()
    assert sorted(map(str, (r[:-2] for r in got))) == sorted(map(str, rows))
    slots = {}
    for r in got:
        slots.setdefault(r[-2], []).append(r[-1])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len({(r.gkey, r[-2]) for r in got}) == 7
    docs = spark.createDataFrame([(None, "a", 1), (None, None, 2), (3, "é" * 1_500_000, 3), (3, "a", 4)], "doc_id long, text string, slot int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["size"] for r in sharding.op10(spark, str(tmp_path)).collect()) == [1, 2, 2, 3_000_001]
