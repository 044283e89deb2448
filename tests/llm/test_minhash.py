import random

import numpy as np
import pyarrow as pa

from foliant.llm import kernels as K
from foliant.llm import minhash as M
from foliant.llm.common import components, read_table


def sets(texts, words):
    data, offs = K.buffers(pa.array(texts, pa.string()))
    return list(M.shingle_sets(data, offs, K.Powers(), words))


def test_shingles():
    a, b, c, d, e, f = sets(["A b  c d", "a B c\td\n", "a b", "A\x0bb", None, "a b c"], 3)
    assert len(a) == 2 and (a == b).all() and len(c) == 1 and (c == d).all() and len(e) == 0 and len(f) == 1
    assert not (c == f).any()


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    ask, edges = M.donors(M.BINS), np.array([*((i << 64) // M.BINS for i in range(M.BINS)), 2**64 - 1], np.uint64)
    for n in (6, 40, 3000):
        diff = []
        for _ in range(30):
            x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(x[: n + n // 2]), np.unique(x[n // 2 :])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            diff.append((M.signature(a, edges, ask) == M.signature(b, edges, ask)).mean() - true)
        assert abs(np.mean(diff)) < 0.06


def test_components(spark):
    rng = random.Random(2)
    e = [(i, i + 1) for i in range(0, 60) if i % 20] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in e:
        if u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    got = {r.node: r.comp for r in components(spark.createDataFrame(e, "u bigint, v bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


BASE = " ".join(f"w{i}" for i in range(60))


def test_cases(spark):
    near = BASE.replace("w30", "other")
    rows = [(5, BASE, "a"), (3, near, "b"), (9, BASE.upper(), "c"), (9, BASE, "c"), (None, BASE, "d"), (1, "unlike text altogether", "e"), (2, None, "f"), (4, "", "g"), (6, " \n", "h"), (7, "two words", "i"), (8, "two  words", "j"), (None, "alone here now", "k"), (11, "same id", "l"), (11, "other text of it", "m")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, node string")
    got = sorted((tuple(r) for r in M.near_duplicates(d, 3, 85, 100).collect()), key=str)
    want = [(5, 58, 3, False), (3, 58, 3, True), (9, 58, 3, False), (9, 58, 3, False), (None, 58, 3, False), (1, 1, 1, True), (2, 0, 2, True), (4, 0, 4, True), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False), (None, 1, None, False), (11, 1, 11, True), (11, 2, 11, True)]
    assert got == sorted(want, key=str)
    kept = M.distinct(d, 3, 85, 100)
    assert kept.columns == d.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(["3", "1", "2", "4", "6", "7", "None", "11", "11"])
    assert M.near_duplicates(d.limit(0)).count() == 0


def test_a_group_around_one_text(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(1000, " ".join(words))]
    for i in range(60):
        x = list(words)
        for k in rng.sample(range(400), 10):
            x[k] = f"z{i}"
        rows.append((i, " ".join(x)))
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85, 100).collect()
    assert {r.component_id for r in got} == {0}


def brute(rows, words, num, den):
    """The smallest id that each id reaches, by all pairs."""
    s = [set(x.tolist()) for x in sets([t for _, t in rows], words)]
    low = {i: i for i, _ in rows}
    while True:
        last = dict(low)
        for a in range(len(rows)):
            for b in range(a):
                both = len(s[a] & s[b])
                if both and den * both >= num * (len(s[a]) + len(s[b]) - both):
                    u, v = rows[a][0], rows[b][0]
                    low[u] = low[v] = min(low[u], low[v])
        if low == last:
            return low


def test_copies_of_copies(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(500)]
    rows, texts = [], []
    for i in range(150):
        x = list(base)
        for k in rng.sample(range(500), 4):
            x[k] = f"a{i}_{k}"
        texts.append(x)
    for i in range(30):  # near enough to one copy, not to the base
        x = list(texts[i])
        for k in rng.sample(range(500), 13):
            x[k] = f"b{i}_{k}"
        texts.append(x)
    rows = [(1000 - i, " ".join(x)) for i, x in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85, 100).collect()}
    assert got == brute(rows, 3, 85, 100)


def test_crowded_bucket(spark):
    """All texts in one bucket, few of them near each other."""
    one = [f"p{i} q r" for i in range(40_000)]
    head = one[int(np.argmin([x[0] for x in sets(one, 3)]))]
    rows = [(i, f"{head} " + " ".join(f"a{i}_{k}" for k in range(80))) for i in range(120)]
    rows += [(200 + i, rows[i][1].replace(f"a{i}_70", "other")) for i in range(0, 120, 12)]
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85, 100, bins=1, rows=1).collect()}
    assert got == brute(rows, 3, 85, 100)


def test_short_texts(spark):
    rows = []
    for i in range(150):
        n = (9, 14, 24)[i % 3]  # 5, 10 and 20 shingles, of which 4, 8 and 16 are common
        x = [f"t{i}_{k}" for k in range(n)]
        rows += [(2 * i, " ".join(x)), (2 * i + 1, " ".join(x[: n - (n - 4) // 5]))]
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


def test_one_row_of_each_group_stays(spark):
    near = BASE.replace("w30", "other")
    rows = [(1, BASE, "a"), (1, BASE, "b"), (1, near, "c"), (2, BASE, "d")]
    rows += [(None, BASE.replace("w", "v"), "e"), (None, BASE.replace("w", "v"), "f"), (None, near.replace("w", "v"), "g"), (5, "", "h"), (5, "", "i")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, _id string")
    kept = M.distinct(d, 3, 85, 100)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "5", "None"]


def test_sql(spark, sf, same):
    same(M.near_duplicates(read_table(spark, sf, "documents"), 3, 85, 100), M.SQL)


def test_tiles_join_what_all_pairs_join(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    base = rng.integers(0, 10**6, 60)
    sets = [np.unique(np.where(rng.random(60) < 0.07, rng.integers(0, 10**6, 60), base)) for _ in range(90)]
    linked = lambda x, y: 100 * (k := len(np.intersect1d(x, y))) >= 85 * (len(x) + len(y) - k)
    node = list(range(90))

    def roots(edges, comp):
        lab = dict(enumerate(comp))
        for _ in range(90):
            for i, j in edges:
                x, y = lab[i], lab[j]
                lab = {k: min(x, y) if v in (x, y) else v for k, v in lab.items()}
        return [lab[i] for i in node]

    comp = [i // 3 * 3 for i in node]
    want = roots([(i, j) for i in node for j in node if i < j and comp[i] != comp[j] and linked(sets[i], sets[j])], comp)
    assert len(set(want)) > 1 and want != comp
    d = spark.createDataFrame([(7, i, comp[i], 90) for i in node], "bk bigint, node bigint, comp bigint, n bigint")
    s = spark.createDataFrame([(i, [int(x) for x in sets[i]]) for i in node], "node bigint, shingles array<bigint>")
    for tile in (100, 40, 7):
        got = M.tiled(d, s, 85, 100, tile).collect()
        assert all(linked(sets[r.u], sets[r.v]) and comp[r.u] == r.cu and comp[r.v] == r.cv for r in got)
        assert roots([(r.u, r.v) for r in got], comp) == want
