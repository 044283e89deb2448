import numpy as np
import pytest

from foliant.llm import lattice as L
from foliant.llm.common import read_table


def brute(ids, x, threshold=0.95):
    norm = np.sqrt((x * x).sum(1))
    hit = (x @ x.T) / np.outer(norm, norm) >= threshold
    np.fill_diagonal(hit, False)
    comp = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.array([min([comp[i], *comp[hit[i]]]) for i in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    return hit.sum(1), np.array([min(ids[comp == c]) for c in comp])


def test_decoding():
    rng = np.random.default_rng(0)
    r = L.roots()
    assert len(r) == 240 and np.allclose((r**2).sum(1), 2)
    x = rng.normal(size=(200, 8)) * 2
    p = L.nearest_e8(x)
    whole = np.allclose
    assert all(whole(v, np.rint(v)) or whole(v - 0.5, np.rint(v - 0.5)) for v in p) and (np.rint(p.sum(1)) % 2 == 0).all()
    # no neighbouring lattice point is nearer
    d = ((x - p) ** 2).sum(1)
    assert (((x[:, None, :] - p[:, None, :] - r[None]) ** 2).sum(2) >= d[:, None] - 1e-9).all()


@pytest.mark.parametrize("scale", L.SCALES)
def test_recall_of_each_scale_at_the_threshold(scale):
    rng = np.random.default_rng(3)
    a, g = rng.normal(size=(2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g -= (g * a).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    ka, kb = L.cells(a, 0.95, scale), L.cells(b, 0.95, scale)
    met = np.stack([L.same_table(ka[:, t], kb[:, t]) for t in range(scale.tables)])
    assert met.any(axis=0).mean() >= 0.9
    # unrelated vectors seldom meet
    far = np.stack([L.same_table(ka[:, t], np.roll(kb[:, t], 1, axis=0)) for t in range(scale.tables)])
    assert far.mean() < 1e-3


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 64))
    x = np.repeat(base, 8, axis=0) + rng.normal(size=(320, 64)) * rng.choice([0.05, 0.15, 0.25], 320)[:, None]
    return np.concatenate([x, x[:5], 2 * x[5:8]]).astype(np.float32)


def test_recall_and_counts(spark, cloud, monkeypatch):
    x = cloud.astype(np.float64)
    d = spark.createDataFrame([(i, [float(v) for v in r], 1, 7) for i, r in enumerate(cloud)], "vec_id bigint, embedding array<float>, label int, id int")
    links, comp = brute(np.arange(len(x)), x)
    for tile, small, scale in ((512, 32, None), (4, 32, None), (512, 3, None), (512, 32, L.SCALES[1]), (4, 3, L.SCALES[1])):
        monkeypatch.setattr(L, "TILE", tile)
        monkeypatch.setattr(L, "SMALL", small)
        got = L.near_duplicates(d, scale=scale).orderBy("vec_id").collect()
        n = np.array([r.n_links for r in got])
        assert (n <= links).all() and n.sum() >= 0.9 * links.sum()
        assert np.mean([r.component_id == c for r, c in zip(got, comp, strict=True)]) > 0.95
        assert all(r.kept == (r.component_id == r.vec_id) for r in got)


def test_links_do_not_follow_the_number_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, g = rng.normal(size=(2, 300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g -= (g * a).sum(1, keepdims=True) * a
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    x = np.concatenate([a, b])
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    few = sorted(tuple(r) for r in L.near_duplicates(d).collect())
    assert 0.9 * 600 <= sum(r[1] for r in few) <= 600
    # the same rows in a table that says it has more
    for rows in (2_000_001, 500_000_001):
        monkeypatch.setattr(type(d), "count", lambda _, rows=rows: rows)
        assert sorted(tuple(r) for r in L.near_duplicates(d).collect()) == few
    monkeypatch.undo()
    # and among others that link with nothing here
    more = spark.createDataFrame([(1000 + i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(3000, 64)))], d.schema)
    assert sorted(tuple(r) for r in L.near_duplicates(d.unionByName(more)).where("vec_id < 1000").collect()) == few


@pytest.mark.parametrize("d", [1, 8, 15, 16, 64])
def test_sketches_bound_the_cosine(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(500, d))
    b = a + rng.normal(size=(500, d)) * rng.choice([0.0, 0.1, 0.3], 500)[:, None]
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    bound = (L.sketches(a).astype(float) * L.sketches(b)).sum(1)
    assert (bound >= (a * b).sum(1) - L.SLACK).all()


def test_cases(spark):
    v = [1.0] + [0.0] * 7
    rows = [(1, v), (2, v), (2, v), (None, v), (3, None), (4, []), (5, [0.0] * 8), (6, [float("nan")] * 8), (7, [None] * 8), (8, [float("inf")] + v[1:]), (9, [1.0, 0.0]), (10, [3.0] + [0.0] * 7), (11, [-1.0] + v[1:])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((tuple(r) for r in L.near_duplicates(d).collect()), key=str)
    want = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (None, 4, 1, False), (10, 4, 1, False), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11))]
    assert got == sorted(want, key=str)
    assert L.near_duplicates(d.limit(0)).count() == 0


def test_table(spark, sf):
    rows = read_table(spark, sf, "embeddings").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    links, _ = brute(np.array([r.vec_id for r in rows]), x)
    got = L.near_duplicates(read_table(spark, sf, "embeddings")).orderBy("vec_id").collect()
    assert sum(r.n_links for r in got) >= 0.9 * links.sum()
