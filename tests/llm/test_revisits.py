import random
import re

from pyspark.sql import functions as F

from trafficloom.llm import revisits as R


def plain_url(url):
    """The rule by a standard parser."""
    from urllib.parse import urlsplit

    if url is None:
        return None
    p = urlsplit(url.strip(" "))
    host = p.netloc.lower().removesuffix({"http": ":80", "https": ":443"}.get(p.scheme, " "))
    kept = [x for x in p.query.split("&") if not re.match(r"(utm_[a-z]+|ref|fbclid|gclid)=", x)]
    query = "&".join(kept)
    return ("https" if p.scheme in ("http", "https") else p.scheme) + "://" + host + p.path.rstrip("/") + ("?" + query if query else "")


def test_canonical_urls(spark):
    urls = ["https://x.org/AT&T/page", "https://x.org/a&b", "https://x.org/a?b", "https://x.org/a&ref=1/b", "http://X.org:80/", "http://x.org:443/a", "https://x.org:443", "https://x.org:8080/A//", "https://x.org?ref=1", "https://x.org/?a=1&utm_source=q&b=2#f",
            "https://x.org/?utm_source=q&b=2", "https://x.org/p?a=1&ref=z", "https://x.org/p?", "https://x.org/p?a=/?b", "https://x.org/p?ref", "https://x.org/p?a=&&c", " https://x.org/p ", "ftp://X/y/", "https://x.org/é?ü=1", "https://x.org/p#a?b&c", "https://x.org/" + "a&" * 50_000, None]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").withColumn("c", R.canonical_url(F.col("u"))).collect()
    for r in rows:
        assert r.c == plain_url(urls[r.i]), urls[r.i]


def test_against_brute_force_with_a_hot_url(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        url = "https://hot.org/" if rng.random() < 0.6 else f"https://x.org/{rng.randint(0, 30)}"
        rows.append((i, url, rng.randint(0, 40), rng.choice(["response", "revisit"]), rng.choice([200, 200, 404]), {"ETag": f'"{rng.randint(0, 3)}"'}))
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, headers map<string,string>")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r.record_id: (r.response_id, r.outcome) for r in R.resolve_revisits(df.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for i, url, ts, kind, _, h in rows:
        if kind == "revisit":
            of = max(((t, j, g) for j, u, t, k, s, g in rows if k == "response" and s == 200 and u == url and t < ts), key=lambda x: x[:2], default=None)
            assert got.pop(i) == ((None, "no response") if of is None else (of[1], "resolved" if of[2] == h else "mismatch"))
    assert not got


def test_as_of_join(spark):
    def rec(i, url, ts, kind, headers, status=200):
        return (i, url, ts, kind, status, headers, "clash")

    rows = [
        rec(1, "http://A.com/x/", 10, "response", {"ETag": '"1"', "Content-Type": "html", "Date": "d1"}),
        rec(2, "https://a.com/x?utm_source=q#f", 20, "response", {"etag": 'W/"2"', "Last-Modified": "m", "Content-Length": "5"}),
        rec(3, "https://a.com/x", 20, "response", {"ETag": '"3"'}, 404),
        rec(4, "https://a.com:443/x", 15, "revisit", {"ETag": '"1"', "Date": "d2", "Content-Type": "no"}, 304),
        rec(5, "https://a.com/x", 20, "revisit", {"ETag": '"2"'}, 304),
        rec(6, "https://a.com/x", 90, "revisit", {"ETag": '"2"', "Age": "3"}, 304),
        rec(7, "https://a.com/x", 91, "revisit", {"Last-Modified": "m"}, 304),
        rec(8, "https://a.com/x", 92, "revisit", {}, 304),
        rec(9, "https://a.com/y", 92, "revisit", {"ETag": '"2"'}, 304),
        rec(10, None, 92, "revisit", None, 304), rec(11, "https://a.com/x", None, "revisit", {"ETag": '"2"'}, 304),
        rec(12, "https://a.com/x", 10, "revisit", {"ETag": '"1"'}, 304), rec(6, "https://a.com/x", 90, "revisit", {"ETag": '"2"', "Age": "3"}, 304),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, headers map<string,string>, slice string")
    got = {}
    for r in R.resolve_revisits(df).collect():
        got.setdefault(r.record_id, []).append((r.response_id, r.outcome, r.headers))
    assert got[4] == [(1, "resolved", {"etag": '"1"', "content-type": "html", "date": "d2"})]
    assert got[5][0][:2] == (1, "mismatch")
    assert got[6] == [(2, "resolved", {"etag": '"2"', "last-modified": "m", "content-length": "5", "age": "3"})] * 2
    assert got[7][0][:2] == (2, "resolved") and got[8][0][:2] == (2, "no validator")
    assert all(got[k][0][:2] == (None, "no response") for k in (9, 10, 11, 12)) and len(got) == 9
    assert R.resolve_revisits(df.limit(0)).count() == 0
