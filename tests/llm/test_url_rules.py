import random

from pyspark.sql import functions as F

from riskweave.llm import url_rules


def judged(url, rules, default="allow"):
    """The definition, rule by rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (-len(h + p), h + p, v or default)
        for h, p, v in ((h and h.lower(), p or "", v) for h, p, v in rules)
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if not fits:
        return host, path, None, default
    length, rule, _ = min(fits, key=lambda f: f[:2])
    return host, path, rule, "block" if any(f[1] == rule and f[2] == "block" for f in fits) else min(f[2] for f in fits if f[1] == rule)


def check(spark, urls, rules, default="allow"):
    pages = spark.createDataFrame(
        [(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string"
    ).repartition(3)
    table = spark.createDataFrame(rules, url_rules.RULE_SCHEMA)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, table, default).collect()}
    assert got == {i: judged(u, rules, default) for i, u in enumerate(urls)}


RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"), ("a.example.org", "", "block"), ("org", "/es/long/path", "allow"), ("EXAMPLE.net", None, "block"),
    ("", "/", "block"), (None, "/", "block"), ("org", "/both", "allow"), ("org", "/both", "block"),
]


def test_cases(spark):
    urls = [
        None, "", "example.org/es/", "http://", "http:///es/", "https://EXAMPLE.org/es/x?y#z", "http://a.b.example.org/en/12",
        "http://example.org", "http://example.org?x=/es/", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de/a",
        "http://x.com:80/de/", "http://com/fr/", "ftp://a.example.org", "http://a.example.org/es/long/path/deeper",
        "http://b.org/both/ways", "http://x.example.NET/q", "http://a..org/", "http://.org/", "http://ÄÖ.org/ü", "a://b://c.org/",
        "http://x.org/" + "long/" * 5000, "http://" + "s." * 3000 + "org/es/", "http://example.org/es/", "http://example.org/es/",
    ]
    check(spark, urls, RULES)
    check(spark, urls, RULES, "block")


def test_random(spark, monkeypatch):
    # Ranges of a few keys, so that rules span several of them.
    monkeypatch.setattr(url_rules, "SAMPLE_PER_RANGE", 2)
    r = random.Random(4)
    hosts = [".".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(60)]
    paths = ["".join(r.choice("/xy") for _ in range(r.randint(0, 5))) for _ in range(60)]
    urls = [f"http://{r.choice(hosts)}/{r.choice(paths)}" for _ in range(800)] + ["http://a/hot"] * 300
    rules = [(r.choice(hosts), "/" * r.randint(0, 1) + r.choice(paths), r.choice(["allow", "block"])) for _ in range(80)]
    check(spark, urls, rules)


def test_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], url_rules.RULE_SCHEMA)
    assert [tuple(r) for r in url_rules.judge(pages, none).collect()] == [(1, "a.org", "/", None, "allow")]
    assert url_rules.judge(pages.limit(0), url_rules.rule_table(spark, RULES)).count() == 0
    null = pages.withColumn("page_id", F.lit(None).cast("long"))
    assert url_rules.judge(null.unionByName(null), url_rules.rule_table(spark, RULES)).count() == 2
