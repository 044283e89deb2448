import collections
import hashlib

import numpy as np
import pytest

from foliant.llm import suffix_dedup as S
from foliant.llm.common import read_table


def marks(texts, length):
    n = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                hit[i : i + length] = True
        yield hit


def brute(texts, length, least):
    out = []
    for t, hit, low in zip(texts, marks(texts, length), marks(texts, least), strict=True):
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8)]))
        out.append((len(t), int(hit.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~hit])).hexdigest(), int(low.sum())))
    return out


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_ranks_are_the_suffix_order(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 3, 4, 5, 7, 31, 100):
        t = rng.integers(1, letters + 1, n)
        order = sorted(range(n), key=lambda i: tuple(t[i:]))
        got = S.cover_ranks(t, 10**9)
        assert [int(got[i]) for i in order] == list(range(n))
        # bounded depth: never out of order over that depth
        low = S.cover_ranks(t, 4)
        for i in range(n):
            for j in range(n):
                if tuple(t[i : i + 4]) < tuple(t[j : j + 4]):
                    assert low[i] < low[j]


def test_anchors_cover_each_start_once():
    from foliant.llm import kernels as K

    data = np.frombuffer(b"abcab" * 200 + b"z" * 300, np.uint8)
    powers = K.Powers()
    h = K.prefix(data, K.byte_values(), powers)
    _, a, b, e, _, _ = S.anchors(data, h, 60, 40, 8, powers)
    assert (e == np.minimum(b + 60, len(data))).all()
    starts = np.concatenate([np.arange(x, y + 1) for x, y in zip(a, b, strict=True)])
    assert (starts == np.arange(len(data) - 39)).all()


def near(rng, n):
    base = rng.integers(97, 101, n).astype(np.uint8)
    out = []
    for _ in range(12):
        x = base.copy()
        x[rng.integers(0, n, 3)] = 122
        out.append(bytes(x))
    return out


@pytest.mark.parametrize("group,crowd", [(1000, 1000), (3, 1000), (3, 2)])
@pytest.mark.parametrize("length,least", [(40, 40), (40, 25), (70, 22)])
def test_random_texts(spark, group, crowd, length, least):
    rng = np.random.default_rng(5)
    texts = near(rng, 300) + near(rng, 90) + [b"", b"a" * 200, b"ab" * 90, bytes(rng.integers(97, 123, 500).astype(np.uint8)), "é".encode() * 100, b"short"]
    texts += texts[:3] + [texts[0][-60:], b"x" + texts[0][-45:], texts[1][:30], texts[1][:33]]
    d = spark.createDataFrame([(i, t.decode(), "x") for i, t in enumerate(texts)], "doc_id bigint, text string, tk string")
    got = S.dedup(d, length=length, least=least, kmer=8, group=group, run=5, crowd=crowd).collect()
    got = [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest(), r.n_shared) for r in sorted(got, key=lambda r: r.doc_id)]
    assert got == brute(texts, length, least)


def test_long_text(spark):
    """A text of 3 MB whose middle stands in a short one."""
    rng = np.random.default_rng(6)
    long = bytes(rng.integers(97, 123, 3_000_000).astype(np.uint8))
    d = spark.createDataFrame([(1, long.decode()), (2, long[1_500_000:1_500_500].decode()), (3, long[:300].decode())], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.n_shared) for r in S.digests(d).collect()}
    assert got == {1: (3_000_000, 500, 1, 800), 2: (500, 500, 1, 500), 3: (300, 0, 0, 300)}


def test_cases(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 30), (3, "y" * 800), (3, "y" * 800)], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.n_shared) for r in S.digests(d).collect()}
    assert got == {(1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (None, 30, 0, 0, 0), (3, 800, 800, 1, 800)}
    assert S.digests(d.limit(0)).count() == 0


def test_documents(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    got = S.digests(read_table(spark, sf, "documents")).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute([(r.text or "").encode() for r in docs], 400, 256)
