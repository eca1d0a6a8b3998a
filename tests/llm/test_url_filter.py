import re

from wireloom.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/700?x=1#y", "https://example.com/en/8", "http://a.example.net/de/81", "http://b.net/de/1",
    "x://y.org/es/", "http://y.org/es", "http://notcom/en/", "http://com/en/z", "ftp://a.b/c://d.com/en/", "http://example.com?/en/", "http://h.example.com:80/en/1",
    "http://spam-farm.x/1", "http://spam-farmer.x/1", "http://www.casino.x/free", "http://www.casino.x/casino", "http://x.y/freewin", "http://É.com/en/\n", "http://q.x/PORN",
]


def slow(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    if best:
        return host, path, *best
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    found = lambda terms: sum(any(not low[: m.start()][-1:].isalnum() and not low[m.end() : m.end() + 1].isalnum() for m in re.finditer(f"(?={re.escape(t)})(?P<t>{re.escape(t)})", low)) for t in terms)
    return host, path, None, "block" if found(U.STRICT) or found(U.SOFT) >= U.SOFT_LEAST else "allow"


def check(df):
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judged(df).collect()), key=repr)
    assert got == sorted(((r.page_id, *slow(r.url)) for r in df.collect()), key=repr)


def test_edge_cases(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(None, URLS[4], "x"), (4, URLS[4], "x"), (99, "http://x.y/" + "a/" * 50000, "x")]
    check(spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3))
    assert U.judged(spark.createDataFrame([], "page_id long, url string, verdict string")).count() == 0


def test_table(spark, sf):
    check(spark.read.parquet(f"{sf}/pages.parquet"))


def test_without_rules(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    assert U.judged(df, rules=()).head()[3:5] == (None, "allow")


def test_vocabulary_file_s_lines():
    import pytest

    strict, soft = U.vocabulary(["# terms", "", "Big Win soft", "bad strict", "big win soft", "either soft", "either strict"])
    assert strict == ("bad", "either") and soft == ("big win",)
    for line in ("word", "word medium", " soft"):
        with pytest.raises(ValueError):
            U.vocabulary([line])


def test_a_vocabulary_of_thousands_of_terms(spark):
    strict, soft = U.vocabulary([f"term{i} {'strict' if i % 3 else 'soft'}" for i in range(6000)])
    a = U.automaton(strict, soft)
    assert U.hits("http://x/term3/term6?term3&term3000#term60001", a) == (0, 3) and U.hits("http://term1.x/term2", a) == (2, 0)
    df = spark.createDataFrame([(1, "http://x/term3-term6"), (2, "http://x/term3"), (3, "http://x/xterm1")], "page_id long, url string")
    assert [r.verdict for r in U.judged(df, (), strict, soft).orderBy("page_id").collect()] == ["block", "allow", "allow"]
