"""URL filter: allow and block rules, then empirical-Bayes host reputation. DataFrame functions only.

A host's rate of bad pages is shrunk towards its registered domain's, that one's towards its suffix's, and that one's
towards the overall rate. Each level has a beta prior: its mean is the parent's posterior mean, its strength comes from
the method of moments over that level's groups. A host is blocked when the lower posterior bound of its rate,
mean - z * sd, is above the threshold: it is then surely worse than the threshold. Unless another one is given, the
threshold is the overall rate of bad pages, so what is blocked are hosts that are surely worse than the average.

Suffixes under which domains are registered are a table in the syntax of the public suffix list: "co.uk", "*.ck" (any
one label more), "!www.ck" (an exception). The longest wins, exceptions before all; without one a host's last label is
its suffix.

Defined results: a null url, or one without "://", has an empty host and path and is judged by the overall prior;
pages with no labelled outcome inherit their parents' rates; with no labels at all every url that no rule fits is
allowed; repeated pages are judged alike, each in its own row; repeated labels of an id count once, bad if any says so;
labels without an id or an outcome don't count; other columns don't pass; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import ascii_lower, small, written

#: Suffixes of two labels, for callers without a table of their own.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "ne.jp", "ac.jp", "com.br", "com.cn", "co.in", "co.nz", "co.za", "com.mx", "com.tr")
#: Standard deviations below the mean at which a host's rate counts as sure.
Z = 1.645

URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url):
    """Host (A-Z lower-cased) and path of a url; both empty for null or where "://" is missing."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def registered(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """hosts (host, distinct) and suffixes (suffix) -> host, domain, suffix. A host that is a suffix itself is its own domain."""
    s = F.col("suffix")
    more = F.when(s.startswith("*."), 1).when(s.startswith("!"), -1).otherwise(0)
    keys = suffixes.where(s.isNotNull()).select(ascii_lower(F.regexp_replace(s, r"^(\*\.|!)", "")).alias("tail"), more.alias("more")).distinct()
    labels = F.split("host", r"\.")
    tails = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(labels, -i, i), ".").alias("tail")))).alias("x")).select("host", "x.*")
    found = tails.join(keys, "tail").groupBy("host").agg(F.max(F.when(F.col("more") == -1, F.col("i") - 1)).alias("less"), F.max(F.col("i") + F.col("more")).alias("most"))
    k = F.greatest(F.lit(1), F.least(F.coalesce("less", "most", F.lit(1)), F.size(labels)))
    last = lambda n: F.array_join(F.slice(labels, -F.least(n, F.size(labels)), F.least(n, F.size(labels))), ".")
    return hosts.join(found, "host", "left").select("host", last(k + 1).alias("domain"), last(k).alias("suffix"))


def rule_columns(host, path, rules):
    """rule and verdict of the longest rule that fits; both null if none does. Of two equal ones block goes first."""
    def chain(value):
        out = F.lit(None).cast("string")
        for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
            h, _, p = rule.partition("/")
            fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
            out = F.when(fits, F.lit({"rule": rule, "verdict": verdict}[value])).otherwise(out)
        return out

    return chain("rule"), chain("verdict")


def _strength(groups: DataFrame) -> float:
    """Prior strength of one level from groups (n, k, mu), mu being the parent's posterior mean: method of moments."""
    n, k, mu = F.col("n"), F.col("k"), F.col("mu")
    row = groups.agg(
        F.sum(n * (k / n - mu) * (k / n - mu)).alias("seen"), F.sum(mu * (1 - mu)).alias("bound"), F.sum(mu * (1 - mu) * (n - 1)).alias("room")
    ).first()
    if not row["room"]:
        return 1.0
    rho = min(0.99, max(1e-4, (row["seen"] - row["bound"]) / row["room"]))
    return 1 / rho - 1


def host_reputation(hosts: DataFrame) -> dict:
    """hosts (host, domain, suffix, n, k), those with outcomes -> overall rate, strengths, and tables of posterior means (mean) of hosts, domains and suffixes.

    Only sums by host are read; the levels above sum the sums. Four numbers come to the driver.
    """
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    n, k = total["n"] or 0, total["k"] or 0
    overall = (k + 0.5) / (n + 1)
    level, out = suffixes.withColumn("mu", F.lit(overall)), {"overall": overall, "strengths": {}}
    for name, below, keys in (("suffix", domains, ["suffix"]), ("domain", hosts, ["domain", "suffix"]), ("host", None, ["host"])):
        s = out["strengths"][name] = _strength(level) if n else 1.0
        out[name] = level = level.withColumn("mean", (F.col("k") + s * F.col("mu")) / (F.col("n") + s))
        if below is not None:
            level = below.join(level.select(*keys, F.col("mean").alias("mu")), keys)
    return out


def filter_urls(pages: DataFrame, labels: DataFrame, rules=(), suffixes: DataFrame | None = None, z: float = Z, threshold: float | None = None) -> DataFrame:
    """pages (page_id, url), labels (page_id, bad 0/1) and suffixes (suffix) -> page_id, host, path, rule, verdict, bad_rate, bad_bound, threshold."""
    spark = pages.sparkSession
    suffixes = small(spark, "suffix string", [(x,) for x in TWO_LABEL_SUFFIXES]) if suffixes is None else suffixes
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = labels.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    counted = parsed.join(seen, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = written(registered(counted.select("host"), suffixes).join(counted, "host"), "hosts")
    up = host_reputation(hosts.where("n > 0"))
    threshold = up["overall"] if threshold is None else threshold
    s = up["strengths"]["host"]
    rated = hosts.join(up["domain"].select("domain", "suffix", F.col("mean").alias("dm")), ["domain", "suffix"], "left").join(up["suffix"].select("suffix", F.col("mean").alias("sm")), "suffix", "left")
    mu = F.coalesce("dm", "sm", F.lit(up["overall"]))
    a, b = F.col("k") + s * mu, F.col("n") - F.col("k") + s * (1 - mu)
    rated = rated.select("host", (a / (a + b)).alias("bad_rate"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"))
    rated = rated.select("host", "bad_rate", F.greatest(F.lit(0.0), F.col("bad_rate") - z * F.col("sd")).alias("bad_bound"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_bound") > threshold, "block").otherwise("allow")
    return parsed.join(rated, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bad_rate", "bad_bound", F.lit(threshold).alias("threshold"))


def held_back_quality(pages: DataFrame, labels: DataFrame, **how) -> dict:
    """Precision and recall of the reputation on a quarter of the labelled pages that it didn't see, and the share of bad pages there."""
    back = F.crc32(F.col("page_id").cast("string").cast("binary")) % 4 == 2
    found = filter_urls(pages, labels.where(~back), **how).join(labels.where(back & F.col("bad").isNotNull()).select("page_id", "bad"), "page_id")
    blocked = F.col("verdict") == "block"
    r = found.agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.count_if(blocked).alias("blocked"), F.count_if(blocked & (F.col("bad") == 1)).alias("hit")).first()
    return {"pages": r["n"], "bad_share": (r["bad"] or 0) / max(1, r["n"]), "precision": r["hit"] / max(1, r["blocked"]), "recall": r["hit"] / max(1, r["bad"] or 0), "blocked": r["blocked"]}


#: The contract's rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A page is bad if it is toxic or of low quality.
BAD = "CASE WHEN toxic IS NULL AND quality IS NULL THEN NULL WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END"


def outcomes(spark, sf_dir: str) -> DataFrame:
    """The outcome of page p is the label of the document with the same id."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), F.expr(BAD).alias("bad"))


def op5(spark, sf_dir: str) -> DataFrame:
    """Every url of pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, outcomes(spark, sf_dir), RULES).select("page_id", "host", "path", "rule", "verdict")
