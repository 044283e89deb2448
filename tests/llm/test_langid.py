import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliant.llm import kernels as K
from foliant.llm import langid as L
from foliant.llm.common import read_table


def test_forward_sums_all_segmentations():
    v = L.vocabulary()
    rng = np.random.default_rng(0)
    prob = rng.random((v.n, 2))
    prob /= prob.sum(axis=0)
    all_ = L.pieces()
    order = [p for s, p in all_ if s], [p for s, p in all_ if not s]
    first = {p: i for i, p in enumerate(order[0])}
    inner = {p: i + v.n_first for i, p in enumerate(order[1])}

    def total(w, k, at=0):
        if at == len(w):
            return 1.0
        out = 0.0
        for e in range(at + 1, min(len(w), at + v.longest) + 1):
            x = w[at:e]
            p = prob[inner[x], k] * (prob[-1, k] if at == 0 else 1) if x in inner else 0.0
            p += prob[first[x], k] if at == 0 and x in first else 0.0
            out += p * total(w, k, e) if p else 0.0
        return out

    texts = ["the", "hello été", "x1", "", "unknownword"]
    data, offs = K.buffers(pa.array(texts))
    got = L.log_probabilities(data, offs, v, prob, K.Powers())
    for t, row in zip(texts, got, strict=True):
        want = [sum(math.log(total(w.encode(), k)) for w in t.split()) for k in range(2)]
        assert np.allclose(row, want)


def test_long_runs_do_not_underflow():
    v = L.vocabulary()
    prob = np.full((v.n, 1), 1e-9)
    data, offs = K.buffers(pa.array(["中" * 5000]))
    assert np.isfinite(L.log_probabilities(data, offs, v, prob, K.Powers())).all()


def test_slices_of_a_long_word_change_nothing():
    v, rng = L.vocabulary(), np.random.default_rng(3)
    prob = rng.random((v.n, 3)) ** 4
    prob /= prob.sum(axis=0)
    texts = ["".join(rng.choice(list("aeiéößthe中日"), 700)) for _ in range(3)] + ["short words too"]
    data, offs = K.buffers(pa.array(texts))
    whole = L.log_probabilities(data, offs, v, prob, K.Powers())
    for piece in (50, 333):
        assert np.allclose(whole, L.log_probabilities(data, offs, v, prob, K.Powers(), piece=piece))


def test_expected_counts_are_those_of_all_segmentations():
    v, rng = L.vocabulary(), np.random.default_rng(4)
    prob = rng.random((v.n, 1)) ** 4
    prob /= prob.sum(axis=0)
    data, offs = K.buffers(pa.array(["hello", "the", "中文é" * 400]))
    powers = K.Powers()
    h = K.prefix(data, K.byte_values(), powers)
    s, e, _ = L.word_cuts(data, offs)
    lat = L.Lattice.of(data, h, s, e, v, powers)
    got = L.expected(lat, prob, np.ones((3, 1)))
    assert np.isfinite(got).all()
    # the derivative of the log probability, piece by piece: p * dlog/dp is the expected number
    for piece in np.argsort(-got[:, 0])[:12]:
        up = prob.copy()
        up[piece] *= 1 + 1e-6
        change = (lat.forward(up)[2] - lat.forward(prob)[2]).sum() / 1e-6
        assert abs(change - got[piece, 0]) < 1e-2 * max(got[piece, 0], 1)


def test_scripts_without_spaces(spark):
    rng = np.random.default_rng(2)
    zh, th = "的一是不了人我在有他这中大来上国", "กขคงจฉชซญดตถทธนบปผพ"
    rows = [(i, "".join(rng.choice(list(zh if i % 2 else th), 300)), "zh" if i % 2 else "th") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in L.predict(d).collect()}
    assert all(got[i] == x for i, _, x in rows)


def test_rows_without_ids_are_sampled_too(spark):
    d = spark.createDataFrame([(None, f"text number {i % 500}", "xx") for i in range(2000)], "doc_id bigint, text string, lang string")
    assert 0 < len(L.sample(d, F.lit(True), 20)) <= 20


def test_held_out_accuracy(spark, sf):
    docs = read_table(spark, sf, "documents")
    got = L.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_cases(spark):
    en, de = "the cat and the dog were in the house with a book", "der Hund und die Katze waren in dem Haus mit einem Buch"
    rows = [(i, (en if i % 2 else de) + f" {i}", "en" if i % 2 else "de", 1) for i in range(40)]
    rows += [(100, None, "en", 1), (101, "", "de", 1), (102, "123 ...", None, 1), (103, "the house", None, 1), (None, "das Haus", None, 1), (103, "the house", None, 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred) for r in L.predict(d).collect()}
    assert {(100, "und"), (101, "und"), (102, "und"), (103, "en"), (None, "de")} <= got
    assert L.predict(d).count() == len(rows)
    assert all(0 <= r.score <= 1 for r in L.predict(d).collect())
    kept = L.recognised(d)
    assert kept.columns == d.columns and kept.count() == len(rows) - 3
    assert L.predict(d.limit(0)).count() == 0
    assert {r.lang_pred for r in L.predict(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_rows_are_not_learned_from(spark):
    d = spark.createDataFrame([(i, "abc def", "xx" if i < 60 else "yy") for i in range(120)], "doc_id bigint, text string, lang string")
    got = L.predict(d).collect()
    assert {r.held_out for r in got} == {True, False}
    only = L.sample(d, L.crc(F.col("doc_id")) % 4 != 2, 5)
    assert {x for x, _ in only} == {"xx", "yy"} and len(only) <= 10
