from pyspark.sql import functions as F

import corpus_pipeline as C
from foliant.llm import queries
from foliant.llm.common import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, n = docs.columns, []
    assert [k for k, _ in C.STAGES] == ["language_id", "near_dedup", "decontamination", "personal_data", "mixing"]
    for k, (name, f) in enumerate(C.STAGES):
        docs = written(f(spark, docs, sf), name)
        n.append(docs.count())
        assert docs.columns[: len(cols)] == cols and (k == 4 or docs.columns == cols)
    assert 0 < n[3] == n[2] <= n[1] <= n[0]


#: Names that operators use for columns of their own.
CLASHES = ("base", "cand", "spans", "_row", "_u", "_id", "_tk", "_bad", "_letter", "_all", "_source", "h", "y", "tk", "node", "rep", "n_copies")


def test_odd_documents(spark, sf):
    rows = [(1, "the cat and the dog in the house " * 3, "en", "s", 99), (2, "the cat and the dog in the house " * 3, "en", "s", 99), (None, "a different text of no id, mail a@b.cd", "en", None, None), (3, None, None, None, None), (4, "", "en", "s", 0)]
    rows += [(10 + i, f"this is the document number {i} about the thing with words {i}{i} in it", "en", "t", 60) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    cols = docs.columns
    for name, f in C.STAGES[:4]:
        docs = written(f(spark, docs, sf), name)
        assert docs.columns == cols
    got = docs.collect()
    assert all(r[c] == f"own {c}" for r in got for c in CLASHES)
    mixed = C.mix(spark, docs, sf)
    assert mixed.columns == [*(c for c in cols if c != "n_copies"), "n_copies", "copy_no", "shuffle_key"] and mixed.count() > 0
    assert {r.doc_id for r in got} & {1, 2, 3, 4} == {1}
    assert [r.text for r in got if r.doc_id is None] == ["a different text of no id, mail <EMAIL>"]


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
