import math

from foliant.llm import mixing as X
from foliant.llm.common import read_table


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_chars bigint, rate string")


def test_rates_reach_the_target(spark):
    rows = [(i, "big" if i % 3 else ("mid" if i % 2 else "small"), 100, "x") for i in range(6000)]
    d = frame(spark, rows)
    out = X.mixed(d, weights={"big": 0.2, "mid": 0.4, "small": 0.4})
    assert out.columns == [*d.columns, "n_copies", "copy_no", "shuffle_key"]
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    total = sum(n.values())
    assert abs(total - 6000) < 4 * math.sqrt(6000)
    for k, share in {"big": 0.2, "mid": 0.4, "small": 0.4}.items():
        assert abs(n[k] - 6000 * share) < 5 * math.sqrt(6000 * share)
    # copies of a document are numbered from 1 to their count
    bad = out.groupBy("doc_id").agg({"copy_no": "max", "n_copies": "max", "*": "count"}).where("`max(copy_no)` <> `max(n_copies)` OR `count(1)` <> `max(n_copies)`")
    assert bad.count() == 0


def test_poisson_function(spark):
    got = spark.range(1).select(*(X.cumulative(X.F.lit(float(r))).alias(f"r{i}") for i, r in enumerate((0, 0.3, 5, 900)))).first()
    for r, cdf in zip((0.3, 5), got[1:3], strict=True):
        want, p = 0.0, math.exp(-r)
        for k, c in enumerate(cdf[:20]):
            want += p
            p *= r / (k + 1)
            assert abs(c - want) < 1e-12
    assert list(got[0]) == [1.0] and abs(got[3][-1] - 1) < 1e-9 and min(got[3]) >= 0


def test_cases(spark):
    rows = [(1, None, 5, "a"), (2, "s", None, "b"), (None, "s", 7, "c"), (3, "t", 0, "d"), (3, "t", 0, "d"), (4, "none", 9, "e")]
    d = frame(spark, rows)
    first = sorted(map(str, X.mixed(d).collect()))
    assert first == sorted(map(str, X.mixed(d.repartition(7)).collect()))
    assert {r.source for r in X.mixed(d, weights={"none": 1.0}).collect()} <= {"none"}
    assert X.mixed(d.limit(0)).count() == 0
    assert sorted(map(str, X.mixed(d, broadcast_sources=1).collect())) == first


def test_order_is_shuffled(spark):
    d = frame(spark, [(i, "s", 10, "x") for i in range(2000)])
    ids = [r.doc_id for r in X.mixed(d).collect()]
    assert sum(a < b for a, b in zip(ids, ids[1:])) < 0.6 * len(ids)


def test_native(spark, sf):
    plan = X.mixed(read_table(spark, sf, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql(spark, sf, same):
    same(X.mixed(read_table(spark, sf, "documents")), X.SQL)
