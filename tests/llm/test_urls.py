from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.llm import urls

URLS = [
    "https://www.a.example.net/en/1?x=/y", "http://EXAMPLE.com/de/2#top", "http://example.com/dex", "ftp://x.org/fr/a/b",
    "http://org/fr/", "http://notexample.net/en/", "http://a.net", "http://a.net?q=/", "http://a.net/", "no scheme.net/",
    "", None, "http://", "http://net:80/", "http://a..net/x", "x://y://z.net/", "http://example.net/en/deep/er/x.html",
    "http://example.net/EN/", "http://exämple.net/é/", "http://a.b.c.d.e.f.example.com/de/", "http://example.com//de/",
    "http://.net/", "http://a.net/x\ny", "http://" + "a." * 300 + "net/" + "d/" * 300,
]


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[:min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


def judged(spark, pages, rules=urls.RULES):
    df = spark.createDataFrame(pages, "page_id bigint, url string, host string")
    rows = urls.judge(df.select("page_id", "url"), urls.rule_table(spark, rules)).collect()
    return Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows)


def test_query_equals_brute_force(spark):
    pages = [(i, u, "clash") for i, u in enumerate(URLS)] + [(None, URLS[0], "clash"), (0, URLS[0], "clash")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, host string").selectExpr("*", "'<p>' html", "'x' rule")
    got = Counter(map(tuple, urls.query(df).collect()))
    assert got == Counter((i, *plain(u, urls.RULES)) for i, u, _ in pages)
    assert urls.query(df.limit(0)).collect() == []


@settings(max_examples=12, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from(["net", "a.net", "b.a.net", "org", "a.org", "x"]),
                       st.sampled_from(["/", "/a", "/a/", "/a/b", "/a/b/", "", "/ab", "//"]),
                       st.sampled_from(["allow", "block"])), min_size=1, max_size=8, unique_by=lambda r: r[:2]),
    st.lists(st.tuples(st.sampled_from(["net", "a.net", "c.b.a.net", "ba.net", "a.org", "x", "y.x"]),
                       st.sampled_from(["", "/", "/a", "/ab", "/a/b", "/a/b/c", "//a", "/b/a"])), min_size=1, max_size=8))
def test_any_rules(spark, rules, pages):
    pages = [(i, f"http://{h}{p}", "") for i, (h, p) in enumerate(pages)]
    assert judged(spark, pages, rules) == Counter((i, *plain(u, rules)) for i, u, _ in pages)


def test_plan_has_no_python_and_no_cross_join(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    plan = urls.query(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_common_urls_are_spread(spark):
    rows = [(i, None if i % 5 else URLS[i % 7], "own", "own", {"k": i}) for i in range(6000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, salt string, best string, more map<string,int>")
    judged = urls.judge(pages, urls.rule_table(spark), hot=1000)
    assert judged.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    got = judged.collect()
    assert Counter((r.page_id, r.salt, r.best, r.host, r.path, r.rule, r.verdict) for r in got) == Counter(
        (i, "own", "own", *plain(u, urls.RULES)) for i, u, *_ in rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        judged = urls.judge(pages, urls.rule_table(spark), hot=1000)
        sizes = judged.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(r["count"] for r in sizes) < 4800 / 2  # no task has half of the rows of the null urls


def under_broadcasts(plan):
    """Lines of the plan below a broadcast."""
    found, depth = [], None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and indent > depth:
            found.append(line)
        else:
            depth = indent if "BroadcastExchange" in line else None
    return found


def test_expanded_places_are_never_sent_to_the_driver(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string")
    want = Counter((i, *plain(u, urls.RULES)) for i, u in enumerate(URLS))
    for most in (urls.RULE_BYTES, 0):
        monkeypatch.setattr(urls, "RULE_BYTES", most)
        judged = urls.query(pages)
        text = judged._jdf.queryExecution().executedPlan().toString()
        assert "Generate" in text and not [line for line in under_broadcasts(text) if "Generate" in line]
        assert ("BroadcastExchange" in text) == (most > 0)  # a large rule table is not sent either
        assert Counter(map(tuple, judged.collect())) == want
