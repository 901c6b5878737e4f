import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from splitboard.llm import url_filter as u


def brute(urls, folds):
    """URL -> (host, path, rule, verdict or None, score), straight from the definitions."""

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]

    def rule(host, path):
        found = []
        for verdict, r in u.RULES:
            name, _, rest = r.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
                found.append((len(r), r, verdict))
        return max(found)[1:] if found else (None, None)

    def codes(text):
        ids = []
        for c in text:
            c = c.lower() if "A" <= c <= "Z" else c
            c = "0" if c in "0123456789" else c
            ids.append(u.SYMBOLS.index(c) if c in u.SYMBOLS else 31)
        return [tuple(ids[i - k] if i >= k else 31 for k in range(u.ORDER + 1)) for i in range(len(ids))]

    counts = {side: [Counter() for _ in range(u.ORDER + 1)] for side in ("allow", "block")}
    totals = {side: [Counter() for _ in range(u.ORDER + 1)] for side in ("allow", "block")}
    for url, fold in zip(urls, folds, strict=True):
        host, path = parts(url)
        verdict = rule(host, path)[1]
        if verdict and fold:
            for g in codes(host + path):
                for k in range(u.ORDER + 1):
                    counts[verdict][k][g[: k + 1]] += 1
                    totals[verdict][k][g[1 : k + 1]] += 1

    def logp(side, g):
        p = 1 / 32
        for k in range(u.ORDER + 1):
            p = (counts[side][k][g[: k + 1]] + u.SMOOTHING * p) / (totals[side][k][g[1 : k + 1]] + u.SMOOTHING)
        return math.log(p)

    out = []
    for url in urls:
        host, path = parts(url)
        gs = codes(host + path)
        score = sum(logp("allow", g) - logp("block", g) for g in gs) / len(gs) if gs else 0.0
        out.append((host, path, *rule(host, path), score))
    return out


def folds_of(spark, urls):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(urls)], "i int, url string")
    host, path = u.parts(F.col("url"))
    return [r.f for r in df.select("i", F.pmod(F.xxhash64(host, path), F.lit(u.CALIBRATION_FOLDS)).alias("f")).orderBy("i").collect()]


EDGES = [None, "", "no scheme", "HTTPS://A.Example.ORG/es/x?q#f", "x://example.org/en/12", "http://example.org", "http://example.com/fr/é/ü", "a://b.com/de/1://c", "http://org/", "http://notexample.org/es/1", "ftp://?x"]


def test_matches_brute_force(spark, sf_small):
    urls = [r.url for r in spark.read.parquet(f"{sf_small}/pages.parquet").orderBy("page_id").collect()] + EDGES * 2
    pages = spark.createDataFrame([(i, x, "h", 1) for i, x in enumerate(urls)], "page_id long, url string, host string, verdict int")
    got = {r.page_id: r for r in u.filter_urls(pages).collect()}
    want = brute(urls, folds_of(spark, urls))
    scores = defaultdict(set)
    for i, (host, path, rule, verdict, score) in enumerate(want):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.score == pytest.approx(score, abs=2e-6)
        if verdict:
            assert r.verdict == verdict
        else:
            scores[r.verdict].add(r.score)
    if len(scores) == 2:  # one threshold parts them
        assert min(scores["allow"]) > max(scores["block"])


def test_empty_and_one_sided(spark):
    assert u.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/x"), (None, "http://a.net/x")], "page_id long, url string")
    assert {r.verdict for r in u.filter_urls(one).collect()} == {"allow"}
