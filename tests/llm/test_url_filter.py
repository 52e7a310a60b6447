import math
import re
import zlib

from pyspark.sql import functions as F

from strandlake.llm import url_filter as uf

ODD = [
    None, "", "no scheme", "http://", "http://Example.COM", "HTTP://EXAMPLE.com/en/x?y=/z#a", "http://www.EXAMPLE.com/en/1", "https://a.b.example.com/en", "http://notexample.com/en/1", "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/",
    "http://h.org?q=http://z.net/fr/1", "http://h.net#/es/", "http://ÉX.net/es/é", "a://b://c.com/d", "http://h.org:80/p", "://x.com/", "http://casino-bonus.org/slots", "http://casino-bonus.com/slots", "http://\U0001f600.org/\U0001f600x", "http://h.org/" + "ab/" * 100_000, "http://x.net/es/1",
]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def rule(host, path):
    fits = [(len(d + p), d + p, kind) for kind, d, p in uf.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def buckets(host, path):
    """Of the host and of the path."""
    both = f"^{host}^", " " + re.sub("[0-9]+", "0", path) + " "
    return [{zlib.crc32(text[i : i + n].encode()) % uf.BUCKETS for n in uf.SIZES for i in range(len(text) - n + 1)} for text in both]


def probability(model, host, path):
    z = model.bias
    for size, b in zip((1, uf.PATH), buckets(host, path)):
        z += size * sum(model.weights[x] for x in b) / math.sqrt(len(b)) if b else 0
    return 1 / (1 + math.exp(-z))


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, probability double")


def test_equals_a_plain_version_on_odd_urls(spark):
    model = uf.fit(uf.labelled(spark))
    got = uf.judge(frame(spark, ODD), model).collect()
    assert len(got) == len(ODD)
    for r in got:
        host, path = parts(ODD[r.page_id])
        text, kind = rule(host, path)
        p = probability(model, host, path)
        assert (r.host, r.path, r.rule) == (host, path, text) and abs(r.probability - p) < 1e-9
        assert r.verdict == (kind or ("block" if p >= 0.6 else "allow"))
    assert uf.judge(frame(spark, ODD).where("false"), model).count() == 0


def test_features_are_hashed_grams(spark):
    urls = [u for u in ODD if u and len(u) < 1000]
    host, path = uf.split(F.col("url"))
    for r in frame(spark, urls).select("page_id", uf.features(host, path).alias("b")).collect():
        assert [set(r.b.host), set(r.b.path)] == buckets(*parts(urls[r.page_id])) and len(r.b.host) == len(set(r.b.host))


def test_unseen_hosts_are_told_apart(spark):
    """Hosts that are not in the labelled table."""
    bad = ["http://www.grand-casino.org/en/1", "https://pokerbonus.org/fr/22", "http://cheap-pills-shop.org/de/5.html", "https://livebets.net/en/90", "http://adult-cams.org/", "https://ads-click.net/en/7", "http://spam-seo-links.org/en/3"]
    good = ["http://www.riverside-school.org/en/1", "https://harbour.org/fr/22", "http://old-maps.net/de/5.html", "https://mountains.net/en/90", "http://bakery.org/", "https://songbirds.net/en/7", "http://village-hall.org/en/3"]
    got = {r.page_id: r.verdict for r in uf.judge(frame(spark, bad + good), uf.fit(uf.labelled(spark))).collect()}
    assert [got[i] for i in range(14)] == ["block"] * 7 + ["allow"] * 7


def test_fitting_takes_bounded_known_rows(spark):
    table = spark.createDataFrame([("http://a.org/x", True), ("http://a.org/x", True), (None, True), ("http://b.org/y", None), ("http://c.org/z", False)], "url string, blocked boolean")
    assert uf.fit(table) == uf.fit(table.repartition(3).distinct()) and uf.fit(table.where("false")) == uf.Model(0.0, (0.0,) * uf.BUCKETS)
    one = uf.fit(table, rows=1)
    assert (one.bias > 0) != (one.bias < 0)
    assert uf.fit(table, rows=10).weights != one.weights


def test_long_rules_win(spark):
    rules = (("allow", "org", "/"), ("block", "x.org", "/"), ("allow", "x.org", "/a"), ("block", "b.x.org", "/"))
    got = [(r.rule, r.verdict) for r in uf.judge(frame(spark, ["http://x.org/b", "http://x.org/ab", "http://b.x.org/ab", "http://y.org/", "http://y.org"]), None, rules).orderBy("page_id").collect()]
    assert got == [("x.org/", "block"), ("x.org/a", "allow"), ("b.x.org/", "block"), ("org/", "allow"), (None, "allow")]
