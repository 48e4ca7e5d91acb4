from dataclasses import replace

from fringework.llm import url_filters as U

ROWS = [
    (1, "http://a.net/x", "net/", "block"),
    (2, "http://www.example.net/en/1", "example.net/en/", "allow"),
    (3, "http://example.net/de/1", "net/", "block"),
    (4, "https://x.EXAMPLE.com/de/", "example.com/de/", "block"),
    (5, "https://x.example.com/fr/", None, "allow"),
    (6, "https://b.org/fr/z?x", "org/fr/", "allow"),
    (7, "https://casino-win.example.com/en/", None, "block"),
    (8, "https://mycasinos.example.com/en/", None, "allow"),
    (9, None, None, "allow"),
    (10, "no scheme casino", None, "allow"),
    (11, "http://a.net", None, "allow"),
    (12, "http://badexample.com/de/", None, "allow"),
    (13, "ftp://h?a://net/", None, "allow"),
    (14, "", None, "allow"),
    (15, "http://h/p?a=1&phpsessid=0f", None, "block"),
]


def judge(spark, **more):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u, *_ in ROWS] * 2, "page_id long, url string, host string, tokens int")
    return U.judged(df, **more).collect()


def test_rules(spark):
    got = judge(spark)
    assert sorted((r.page_id, r.rule, r.verdict) for r in got) == sorted([(i, rule, v) for i, _, rule, v in ROWS] * 2, key=lambda x: x[0])
    assert {r.page_id: r.host for r in got}[4] == "x.example.com"
    assert {r.page_id: r.host for r in got}[13] == "h"


def test_joined_index_agrees_with_the_literal_one(spark):
    key = lambda r: (r.page_id, str(r))
    assert sorted(judge(spark), key=key) == sorted(judge(spark, literal_rules=0), key=key)


def test_index_loses_no_match(spark):
    """Brute force: every expression on every URL."""
    rules = [replace(r) for r in U.PATTERN_RULES]
    import re

    for r in judge(spark):
        url = {i: u for i, u, *_ in ROWS}[r.page_id] or ""
        rest = url.partition("://")[2]
        host, path, query = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", rest).groups()
        target = host.lower() + path + (f"?{query}" if query else "")
        hits = [p.name for p in rules if re.search(p.pattern, target)]
        assert r.rule is not None or r.pattern == (hits[0] if hits else None)


def test_empty(spark):
    assert U.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_capitals_lose_no_rule(spark, tmp_path):
    """The twin runs every rule on every URL."""
    import duckdb

    paths = ["MYcasino/", "casinoX", "Casino/", "CASINO", "Xfree-betsY", "free-Bets", "a?Phpsessid=0", "a?X&phpsessid=0f", "PIXEL.gif", "pixel.gif?A"]
    urls = [(i, f"http://a.com/{p}") for i, p in enumerate(paths)] + [(100, "http://ADS.a.com/x"), (101, "http://b.NET/MYcasino")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT page_id, verdict, rule, pattern FROM ({U.ORACLE_SQL['op9_url_filters']})").fetchall())
    assert want[0][1] == "block"
    for literal in (1_000, 0):
        got = U.judged(df, literal_rules=literal).select("page_id", "verdict", "rule", "pattern").collect()
        assert sorted(map(tuple, got)) == want


def test_null_keys_and_very_long_urls(spark):
    rows = [(None, "http://a.net/x"), (None, None), (1, "http://b.com/" + "a/" * 200_000 + "casino"), (2, "http://" + "c." * 50_000 + "net/")]
    got = sorted(((r.page_id, r.verdict) for r in U.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()), key=repr)
    assert got == sorted([(None, "block"), (None, "allow"), (1, "block"), (2, "block")], key=repr)
