import hashlib
import random
import re

import pytest

from foliant.llm import decontam as D
from foliant.llm.common import read_table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=13, share=20):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, s in items:
            q = words(s)
            n = min(len(q), window)
            for k in range(len(q) - n + 1 if q else 0):
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == q[k : k + n]:
                        hit.update(range(a, a + n))
                        found.add(item)
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=str)


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    return d, spark.createDataFrame(items, "item_id bigint, text string")


ITEM = "Ada went to the old mill by the river and saw Fourteen grey herons standing there"
DOCS = [
    (1, "noise " * 30 + ITEM.upper() + " more"), (2, None), (3, ""), (4, "...!"), (5, ITEM[:60]), (6, "kurz, KURZ! kurz"), (6, "kurz"),
    (None, ITEM), (7, "été à été"), (8, "the " * 400 + ITEM), (9, "ada went to the old mill by the river and saw fifteen grey herons"), (10, ITEM + " " + ITEM),
]
ITEMS = [(1, ITEM), (2, "kurz"), (3, None), (4, " . "), (5, "été à"), (10, ITEM), (None, "noise noise"), (2, "kurz")]


@pytest.mark.parametrize("block", [4_000_000, 40])
def test_cases(spark, block):
    d, b = tables(spark, DOCS, ITEMS)
    got = sorted((tuple(r) for r in D.contamination(d, b, block=block).collect()), key=str)
    assert got == brute(DOCS, ITEMS)


def test_random(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(60)]
    items = [(i, text(rng.randrange(8))) for i in range(12)]
    d, b = tables(spark, docs, items)
    assert sorted((tuple(r) for r in D.contamination(d, b, window=4).collect()), key=str) == brute(docs, items, 4)


def test_proximity(spark):
    d, b = tables(spark, [(1, "x one two gap three four y"), (2, "one two three four"), (3, "four three two one"), (4, "one gap gap gap gap two three four")], [(1, "one two three four")])
    index = D.build_index(d)
    exact = {r.doc_id for r in D.search(index, b).collect() if r["items"]}
    near = {r.doc_id for r in D.proximity(index, b, slop=2).collect() if r["items"]}
    assert exact == {2} and near == {1, 2}


def test_empty(spark):
    d, b = tables(spark, DOCS, ITEMS)
    assert D.contamination(d.limit(0), b).count() == 0
    assert D.contamination(d, b.limit(0)).where("n_hit > 0").count() == 0


def test_clean_keeps_columns(spark):
    d, b = tables(spark, DOCS, ITEMS)
    got = D.clean(d, b)
    assert got.columns == d.columns
    # 8 holds a whole item among many other words; 9 not a whole window
    assert sorted(r.doc_id for r in got.collect()) == [2, 3, 4, 9]


def test_clean_long_text_and_short_item(spark):
    d, b = tables(spark, [(1, "noise " * 30_000 + ITEM), (2, "noise " * 100 + "kurz"), (3, "noise " * 10 + "kurz")], [(1, ITEM), (2, "kurz")])
    assert [r.doc_id for r in D.clean(d, b).collect()] == [2]


def test_matches_stay_within_documents(spark):
    d, b = tables(spark, [(1, "alpha beta"), (2, "gamma delta"), (3, "alpha gap beta gamma delta")], [(1, "alpha beta gamma delta")])
    index = D.build_index(d.coalesce(1))
    for slop in (1, 2, 5):
        assert {r.doc_id for r in D.proximity(index, b, slop=slop).collect() if r["items"]} == {3}


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity_brute(spark, slop):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    docs = [(i, text(rng.randrange(25))) for i in range(40)]
    items = [(i, text(rng.randrange(2, 6))) for i in range(8)]

    def hits(w, q):
        n = min(len(q), 4)
        for k in range(len(q) - n + 1):
            for a in range(len(w)):
                if w[a] == q[k] and all(q[k + j] in w[max(a + j - slop, 0) : a + j + slop + 1] for j in range(1, n)):
                    return True
        return False

    d, b = tables(spark, docs, items)
    got = {(r.doc_id, i) for r in D.proximity(D.build_index(d), b, window=4, slop=slop).collect() for i in r["items"]}
    assert got == {(i, str(k)) for i, t in docs for k, s in items if hits(words(t), words(s))}


def test_frequent_pair(spark):
    """Windows of one common pair against a text of nothing else: work stays in bounded parts."""
    d, b = tables(spark, [(1, "a b " * 20_000)], [(i, "a b " * 40) for i in range(30)])
    r = D.contamination(d, b).first()
    assert (r.n_words, r.n_hit, r.n_items) == (40_000, 40_000, 30)


def test_sql(spark, sf, same):
    same(D.contamination(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark")), D.SQL)
