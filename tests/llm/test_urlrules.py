from asofspark.llm import urlrules
from asofspark.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "https://Example.COM", "https://example.com/en/", "https://EXAMPLE.com/en/x?y#z", "https://a.example.com/en/1",
    "https://www.example.com/en/", "https://x.www.example.com/en/2", "https://badexample.com/en/", "https://example.com/EN/", "https://example.com/en",
    "http://com/", "http://x.com?q=/en/", "http://a.net/es/1", "http://a.net/es", "http://net/fr/", "http://anet/fr/", "a://b://c.com/d", "x://a.com/p\nq?z",
    "http://a.net/fr/#es", "http://É.COM/x", "http://a..net//fr/", "http://a.net//fr/", "http://" + "a." * 3000 + "net/fr/" + "p/" * 3000,
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


def test_equals_plain_rules(spark):
    rows = list(enumerate(URLS * 2))
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(df, URL_RULES).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        assert got[i] == plain(u), u


def test_rules_lie_under_their_rarest_token(spark):
    df = spark.createDataFrame([(f"h{i}.net", "/fr/" if i % 5 == 0 else "/x/") for i in range(20)], "host string, path string")
    urls = df.select("*", urlrules.url_tokens(df.host, df.path).alias("tokens"))
    got = {r.rule: r.token for r in urlrules.rarest_index(urlrules.rule_table(spark, URL_RULES), urls).collect()}
    assert got["net/fr/"] == "p:fr" and got["net/es/"] == "p:es" and got["com/"] == "h:com"


def test_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert urlrules.judge(df, URL_RULES).count() == 0
    assert urlrules.judge(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"), []).first().verdict == "allow"
