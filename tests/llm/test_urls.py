import numpy as np

from semblance.llm import urls as U

URLS = ["http://A.Example.org/es/x?q", "https://x.org", "http://example.org/en/12", "http://notexample.org/en/1", "ftp://b.com/fr/#f", "http://com/de/", "http://b.com/DE/", None, "no scheme", "x://", "http://EXAMPLE.ORG/en/2/", "://org/", "http://\u00c9.org/a"]


def slow(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    for c in "?#":
        rest = rest.split(c)[0]
    host, slash, tail = rest.partition("/")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = slash + tail
    best = (None, U.DEFAULT)
    for rule, verdict in U.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(rule) > len(best[0] or ""):
            best = rule, verdict
    return host, path, *best


def test_verdicts(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string")
    got = U.judge(df.selectExpr("*", "'x' AS host", "1 AS verdict")).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == slow(r["url"])
    assert U.judge(df.limit(0)).count() == 0


def test_cascade_is_exact_over_its_universe():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (20_000, 2)).astype(np.uint64)
    listed, others = keys[:700], keys[700:]
    c = U.build(listed, lambda level: others[level.has(others, 0)], len(others))
    assert c.listed(listed).all() and not c.listed(others).any()
    assert len(c.levels) > 1 and c.size() < 8 * len(listed)


def test_lists_past_the_cascade_are_joined(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string")
    one, two = U.judge(df), U.judge(df, max_bytes=0)
    assert one.columns == two.columns and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
