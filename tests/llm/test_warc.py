import random

import pytest
from cellspark.llm import warc
from pyspark.sql import functions as F

SCHEMA = "record_id long, uri string, date long, type string, etag string, last_modified string, digest string, headers map<string,string>, url string, block int"


def brute(rows):
    out = []
    bare = lambda tag: tag.removeprefix("W/")
    for i, uri, date, kind, etag, modified, digest, headers, *_ in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and uri is not None and r[1] is not None and canonical(r[1]) == canonical(uri) and date is not None and r[2] is not None and r[2] < date]
        to = max(earlier, key=lambda r: (r[2], r[0])) if earlier else None
        tests = [bare(etag) == bare(to[4]) if to and etag and to[4] else None, modified == to[5] if to and modified and to[5] else None, digest == to[6] if to and digest and to[6] else None]
        same = next((x for x in tests if x is not None), False)
        own = headers or {}
        if same:
            update = {k: v for k, v in own.items() if k.lower() in warc.PERMITTED}
            names = {k.lower() for k in update}
            own = {k: v for k, v in (to[7] or {}).items() if k.lower() not in names} | update
        out.append((i, date, to and to[0], same, tuple(sorted(own.items())), to[6] if same else None))
    return sorted(out, key=str)


def canonical(uri):
    return uri.split("://")[-1].split("#")[0].removeprefix("www.").rstrip("/").lower()


def records(seed=1):
    rng, rows = random.Random(seed), []
    some = lambda *xs: rng.choice(xs)
    for i in range(300):
        uri = some("http://a.org/x", "https://www.A.org/x/", "http://a.org/x#part", "http://b.org/", None) if i % 3 else "http://hot.org/page"
        date = some(None, *range(0, 60)) if i % 2 else rng.randrange(40)
        kind = some("response", "revisit", "request") if i % 5 else None
        heads = some({"Date": str(i), "ETag": "n", "X": "1", "content-length": "0"}, {"X": "2", "vary": "v", "DATE": "d"}, {}, None)
        rows.append((i, uri, date, kind, some("e1", "W/e1", "e2", None), some("m1", "m2", None), some("d1", "d2", None), heads, "clash", 0))
    return rows + [rows[1], rows[1], rows[4]]


@pytest.mark.parametrize("block", [1, 7, 1 << 12])
def test_same_as_brute_force(spark, block):
    rows = records()
    got = warc.resolve(spark.createDataFrame(rows, SCHEMA), block)
    assert sorted(((r.record_id, r.date, r.refers_to, r.verified, tuple(sorted(r.headers.items())), r.digest) for r in got.collect()), key=str) == brute(rows)


def test_every_validator_decides_somewhere():
    rows = brute(records())
    assert sum(r[3] for r in rows) > 10 and sum(r[2] is not None and not r[3] for r in rows) > 10


def test_canonical_urls(spark):
    same = ["http://Www.Example.org:80/a/?b=2&a=1&utm_source=x#top", "https://example.org/a?a=1&b=2", " m.example.org:443/a/?ref=9&a=1&b=2 "]
    other = ["http://example.org/A?a=1&b=2", "http://example.org/a", None, ""]
    df = spark.createDataFrame([(u,) for u in same + other], "u string").select(warc.canonical_url(F.col("u")).alias("c"))
    got = [r.c for r in df.collect()]
    assert got == ["example.org/a?a=1&b=2"] * 3 + ["example.org/A?a=1&b=2", "example.org/a", None, ""]


def test_empty_table_and_long_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.resolve(empty).count() == 0
    long_uri = "http://a.org/" + "p" * 200_000
    rows = [(1, long_uri, 1, "response", "e", None, "d", {"X": "y" * 100_000}, "", 0), (2, long_uri + "/", 2, "revisit", "W/e", None, None, None, "", 0)]
    (r,) = warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (r.refers_to, r.verified, r.digest, len(r.headers["X"])) == (1, True, "d", 100_000)
