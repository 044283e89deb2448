import re
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from foliant.llm import urlfilter as U
from foliant.llm.common import read_table


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    best = None
    for verdict, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x?y#z", "https://www.example.com/en/", "https://a.www.Example.com/en/q", "http://example.com/EN/", "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/",
    "ftp://h?a/b", "x://a.b#/en/", "http://example.com", "http://example.com/en", "a://b://c.com/d", "http://É.com/ü\n/x", "http://user@host.org:80/p", "http://free-bets.example.org/de/1", "http://example.com/en/x?y#z",
]


def test_cases(spark):
    d = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)] + [(None, "http://a.com/", "r")], "page_id bigint, url string, rule string")
    rows = U.judge(d).collect()
    assert len(rows) == len(URLS) + 1
    got = {r.page_id: r for r in rows}
    for i, u in enumerate(URLS):
        host, path = split(u)
        name, verdict = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name), u
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")
    assert U.judge(d.limit(0)).count() == 0
    # with no rule decided, all are allowed
    assert {r.verdict for r in U.judge(d.where("page_id = 18")).collect()} == {"allow"}


def test_segmentation_is_the_most_probable():
    words = U.unigrams()
    assert U.segment("freebetsonline", words) in (["free", "bets", "online"], ["free", "bet", "sonline"], ["freebets", "online"])
    small = {"a": -1.0, "ab": -1.5, "b": -2.0, "bc": -0.5, "c": -3.0}

    def best(t):
        if not t:
            return 0.0, []
        return max((small.get(t[:k], -14.0 if k == 1 else -1e9) + best(t[k:])[0], [t[:k], *best(t[k:])[1]]) for k in range(1, len(t) + 1))

    for t in ("abc", "aabcb", "cab"):
        assert U.segment(t, small) == best(t)[1]
    assert U.segment("xyz", small) == ["xyz"] and U.segment("", small) == []


def test_bayes_separates():
    words = U.unigrams()
    rows = [(f"free-casino{i}.example.org", "/win/1", "block") for i in range(30)] + [(f"library{i}.example.org", "/books/1", "allow") for i in range(30)]
    m = U.train(rows, words)
    score = lambda h, p: m["prior"] + sum(m["odds"].get(t, 0.0) for t in U.tokens(h, p, words, {}))
    assert score("mycasino.example.org", "/win") > 0 > score("thelibrary.example.org", "/books")


def test_tokens():
    words = {"red": -1.0, "shop": -1.0}
    assert U.tokens("redshop12.com", "/A/2024-7.html?", words, {}) == ["h:red", "h:shop", "h:#2", "h:com", "p:a", "p:#4", "p:#1", "p:html"]
    assert U.tokens("", "", words, {}) == []


FEW = pytest.mark.xfail(reason="24 urls are too few to learn from: 18 of 24 verdicts, 3 of 9 allowed")


@pytest.mark.parametrize("size", [pytest.param("sf0.001", marks=FEW), "sf0.01", "sf0.1"])
def test_held_out_verdicts(sf, size):
    path = Path(sf).parent / size / "pages.parquet"
    if not path.exists():
        pytest.skip(f"no {path}")
    words = U.unigrams()
    known = sorted({(*hp, rule(*hp)[1]) for url in pq.read_table(path)["url"].to_pylist() for hp in [split(url)]}, key=str)
    known = [x for x in known if x[2]]
    hit = []
    for fold in range(4):
        mine = lambda x: zlib.crc32((x[0] + x[1]).encode()) % 4 == fold  # noqa: B023, E731
        m = U.train([x for x in known if not mine(x)], words)
        hit += [(m["prior"] + sum(m["odds"].get(t, 0.0) for t in U.tokens(h, p, words, {})) > 0) == (v == "block") for h, p, v in known if mine((h, p))]
    assert len(hit) == len(known) > 10 and sum(hit) >= 0.8 * len(hit)


def test_bound(spark):
    d = spark.createDataFrame([(i, f"http://a{i}.com/{i}") for i in range(500)], "page_id bigint, url string")
    host, path = U.parts(U.F.col("url"))
    src = d.select("page_id", host.alias("host"), path.alias("path"))
    src = src.withColumn("decided", U.matched(U.F.col("host"), U.F.col("path"))[1])
    assert len(U.sample(src, 40)) <= 40


def test_pages(spark, sf):
    pages = {r.page_id: r.url for r in read_table(spark, sf, "pages").collect()}
    for r in U.judge(read_table(spark, sf, "pages")).collect():
        assert (r.host, r.path) == split(pages[r.page_id]) and r.rule == rule(r.host, r.path)[0]
