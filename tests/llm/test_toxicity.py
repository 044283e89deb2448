import numpy as np

from foliant.llm import toxicity as X
from foliant.llm.common import read_table


def test_isotonic():
    f, y = np.array([1.0, 2, 3, 4, 5, 6]), np.array([0.0, 1, 0, 0, 1, 1])
    xs, ps = X.isotonic(f, y, np.ones(6))
    assert (np.diff(ps) >= 0).all() and (np.diff(xs) >= 0).all()
    assert ps[0] < 0.4 and ps[-1] > 0.7


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.5)).astype(int)
    t = X.Trees.fit(x[:1500], y[:1500], np.ones(1500))
    assert ((t.score(x[1500:]) > 0) == y[1500:]).mean() > 0.97


def corpus(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("aeiourstln"), rng.integers(3, 7)))
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [word() for _ in range(rng.integers(20, 60))]
        if bad:
            for k in rng.integers(0, len(w), 4):
                w[k] = ("grumf", "blarg", "Snotzel")[k % 3]
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(bad), "y"))
    rows += [(9001, None, "x"), (9002, "", "x"), (None, "grumf grumf blarg you blarg", "x"), (9003, "gr0wn gru mf bl4rg snotzeling you GRUMF! grumf blarg", "x")]
    labels += [(9001, 0, "y"), (None, 1, "y"), (5, None, "y"), (7, 0, "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic int, text string")


def test_held_out_rows(spark):
    d, labels = corpus(spark)
    got = X.score(d, labels).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 80
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.93
    by = {r.doc_id: r.predicted for r in got}
    assert by[9001] == 0 and by[9002] == 0 and by[None] == 1 and by[9003] == 1


def test_without_labels(spark):
    d, labels = corpus(spark)
    assert {r.score for r in X.score(d, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in X.score(d, labels.where("toxic = 1")).collect()} == {1.0}
    assert X.score(d.limit(0), labels).count() == 0


def test_samples_are_bounded(spark):
    d, labels = corpus(spark)
    texts, y, share = X.sample(d, labels, X.crc(X.F.col("doc_id")) % 5 != 0, 50)
    assert len(texts) == len(y) <= 100 and 0.2 < share < 0.3


def brute_features(text, lex):
    """The features of one text, word by word."""
    import re

    from foliant.llm import kernels as K

    raw = text.encode()
    powers = K.Powers()
    one = lambda b: X.digests([b])[0]
    fold = lambda b: bytes(x + 32 if 65 <= x <= 90 else x for x in b)
    undo = lambda b: fold(b.translate(bytes.maketrans(b"013457@$!|", b"oleastasil")))
    ws = re.findall(rb"[0-9A-Za-z\x80-\xff@$*]+", raw)
    n, size = len(ws), max(len(raw), 1)
    has = lambda w, keys: one(fold(w)) in set(keys.tolist())
    hit = [has(w, lex.words) for w in ws]
    stem = [any(len(w) > k and one(fold(w[:k])) in set(lex.stems[k].tolist()) for k in X.STEMS) for w in ws]
    masked = [not h and undo(w) != fold(w) and one(undo(w)) in set(lex.words.tolist()) for w, h in zip(ws, hit, strict=True)]
    you = [i for i, w in enumerate(ws) if has(w, lex.second)]
    bad = [i for i in range(n) if hit[i] or stem[i] or masked[i]]
    near = sum(any(abs(i - j) <= X.NEAR for j in you) for i in bad)
    rate = lambda p: len(re.findall(p, raw)) / size
    inside = [sum(c in b"0123456789@$*" for c in w) for w in ws]
    mixed = sum(0 < k < len(w) for k, w in zip(inside, ws, strict=True))
    per = max(n, 1)
    same = sum(raw[i] == raw[i - 1] == raw[i - 2] for i in range(2, len(raw)))
    marks = rate(rb"[!?]")
    punct = rate(rb"[!-/:-@\[-`{-~]")
    del powers
    return [np.log1p(n), sum(hit), sum(hit) / per, sum(stem), sum(stem) / per, sum(masked), sum(masked) / per, near, near / per, len(you) / per,
            rate(rb"[A-Z]"), punct, marks, rate(rb"[0-9]"), mixed / per, same / size, punct - marks]


def test_features_equal_brute_force_alone_and_in_any_batch():
    import pyarrow as pa

    from foliant.llm import kernels as K

    lex = X.Lexicon(np.sort(X.digests([b"grumf", b"blarg"])), {k: np.sort(X.digests([b"snotzel"[:k]])) for k in X.STEMS}, np.sort(X.digests([w.encode() for w in X.SECOND_PERSON])))
    texts = ["hello aa", "a b c", "", "grumf YOU blarg!! gr0umf", "aaa!!! $nake b", "x", "yy", "é" * 9 + " ü", "snotzeling you gruMF 1@3 ***", "you " * 9 + "bl4rg", "z" * 50_000]
    assert len(X.NAMES) == 17
    run = lambda xs: X.features(*K.buffers(pa.array(xs)), lex, K.Powers())
    want = np.array([brute_features(t, lex) for t in texts])
    assert np.allclose(run(texts), want) and np.allclose(run(texts[::-1]), want[::-1])
    assert np.array_equal(np.concatenate([run([t]) for t in texts]), run(texts))


def test_long_text_and_repeated_ids(spark):
    d, labels = corpus(spark)
    long = "plain words " * 100_000 + "grumf"
    more = spark.createDataFrame([(7, long, "x"), (1, "another text of an id", "x"), (1, None, "x")], d.schema)
    got = X.score(d.unionByName(more), labels).collect()
    again = X.score(d.unionByName(more).repartition(3), labels).collect()
    assert len(got) == 607 and sorted(got, key=str) == sorted(again, key=str)


def test_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # labels enough to learn from
    labels = read_table(spark, sf, "labels")
    got = X.score(read_table(spark, sf, "documents"), labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9
