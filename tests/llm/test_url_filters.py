from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from panelytics.llm import url_filters as uf

URLS = [
    None,
    "",
    "no scheme example.org/es/1",
    "http://EXAMPLE.org/es/1?x#y",
    "https://a.b.example.org/en/17",
    "https://example.org/en/2",
    "https://example.org",
    "https://example.org?q=/es/",
    "https://notexample.org/es/",
    "ftp://x.com/fr/#a://b/c",
    "http://x.com/de/a",
    "http://com/de/",
    "http://x.com/en/",
    "http://www.spam-farm.example.org/en/9",
    "http://cheap-pills.example.com/en/450",
    "http://cheap-pills.example.com/fr/450",
    "http://ПРИМЕР.org/\n/x?",
    "a://b://c/d",
    "://host/path",
    "http:///path",
]


def brute(url, rules, hosts):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
    under = lambda h: bool(host) and (host == h or host.endswith("." + h))
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if under(h) and path.startswith(p)]
    rule, verdict = max(fits)[2:] if fits else (None, "block" if any(map(under, hosts)) else "allow")
    return host, path, rule, verdict


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_equals_trying_every_rule(spark, monkeypatch, most):
    monkeypatch.setattr(uf, "MOST_FILTER_BYTES", most)
    rows = [*enumerate(URLS), (3, URLS[3]), (None, URLS[4])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(0) for c in ("host", "keys", "rule", "key")})
    got = [tuple(r) for r in uf.judge(df).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *brute(u, uf.RULES, uf.LISTED_HOSTS))) for i, u in rows)


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    got = {tuple(r) for r in uf.judge(pages).collect()}
    assert got == {(i, *brute(u, uf.RULES, uf.LISTED_HOSTS)) for i, u in pages.collect()}


@pytest.mark.parametrize("bits", [20, 3])
def test_a_cascade_is_exact_over_its_universe(spark, monkeypatch, bits):
    """Few bits make many false positives, and so many levels."""
    monkeypatch.setattr(uf, "BITS_PER_KEY", bits)
    rng = random.Random(1)
    universe = [f"k{i}" for i in range(3000)]
    listed = rng.sample(universe, 400) + ["elsewhere"]
    key = lambda own: spark.createDataFrame([(k,) for k in [*own, None]], "key string")
    cascade = uf.build(key(listed), key(universe))
    assert (len(cascade.filters) > 3) == (bits == 3)
    rows = spark.createDataFrame([(i, universe[i * 10 : i * 10 + 10]) for i in range(300)] + [(300, []), (301, None)], "i int, keys array<string>")
    got = {r["i"]: r["found"] for r in uf.listed_keys(rows, cascade, "found").collect()}
    assert {k for own in got.values() for k in own} == set(listed) - {"elsewhere"}
    assert got[300] == got[301] == []


def test_lists_as_tables_in_parts(spark, monkeypatch):
    """Lists beyond one filter are split, and a part divides again if too many keys pass wrongly."""
    monkeypatch.setattr(uf, "MOST_FILTER_BYTES", 100)
    monkeypatch.setattr(uf, "BITS_PER_KEY", 5)
    rng = random.Random(3)
    names = [".".join("ab"[rng.randrange(2)] + str(rng.randrange(9)) for _ in range(rng.randint(1, 4))) for _ in range(1500)]
    hosts = rng.sample(names, 900) + [None]
    rules = [(rng.choice(names), rng.choice(["", "/", "/x", "/x/y/"]), rng.choice(["allow", "block"])) for _ in range(40)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{rng.choice(names)}{rng.choice(['', '/', '/x', '/x/y/z'])}" for _ in range(600)] + URLS
    parts = []
    build = uf.build
    monkeypatch.setattr(uf, "build", lambda *a: parts.append(build(*a)) or parts[-1])
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("x.org", None, "allow")], "host string, path string, verdict string")
    listed = spark.createDataFrame([(h, 1) for h in hosts], "host string, key int")
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {tuple(r) for r in uf.judge(df, table, listed).collect()}
    own = set(hosts) - {None}
    assert got == {(i, *brute(u, rules, own)) for i, u in enumerate(urls)}
    assert sum(p is not None for p in parts) > 3


def test_long_hosts_give_few_keys(spark):
    """As many keys as listed hosts and paths have sizes, however many labels a host has."""
    df = spark.createDataFrame([("a." * 20_000 + "x.com", "/fr/" * 5000)], "host string, path string")
    keys = df.select(uf.keys_of(F.col("host"), F.col("path"), [1, 4], [1, 3])).first()[0]
    assert keys == ["a.x.com/fr/", "a.x.com/", "com/fr/", "com/", "a.x.com", "com"]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert uf.judge(df).collect() == []
    some = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    assert [tuple(r) for r in uf.judge(some, rules=(), hosts=()).collect()] == [(1, "x.org", "/", None, "allow")]
