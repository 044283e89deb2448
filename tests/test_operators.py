import pytest
from pyspark.sql import functions as F

from foliant import api
from foliant.functions import heuristics as H
from foliant.functions import odt, rules
from foliant.operators import blocks, packages, roles
from foliant.sources import files
from foliant.streaming import pipeline
from tests.test_odt import PROFILE


@pytest.fixture
def docs(spark):
    rows = [(1, "# T\nsome *text*\n- a\n- b\n"), (2, "[x]()"), (3, ""), (4, None), (None, "p\n| a |\n| - |\n")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_blocks_with_nulls(docs):
    got = blocks.blocks(docs).collect()
    assert [r.kind for r in got if r.doc_id == 1] == ["heading", "paragraph", "list", "list_item", "paragraph", "list_item", "paragraph"]
    assert not [r for r in got if r.doc_id in (3, 4)]
    assert [r.kind for r in got if r.doc_id is None] == ["paragraph", "table", "paragraph"]


def test_status_rows(docs):
    got = {r.doc_id: r for r in blocks.to_markdown(docs).collect()}
    assert got[1].status == "ok" and got[1].output == "# T\nsome *text*\n- a\n- b\n"
    assert got[2].status == "invalid" and got[2].err_code == "missing_field"
    assert got[3].status == "ok" and got[3].diagnostics[0].severity == "warning"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert blocks.blocks(none).count() == blocks.to_markdown(none).count() == 0


def test_verbs(spark, docs):
    made = api.create_odt(docs).select(F.col("doc_id").cast("string").alias("path"), "content")
    bad = spark.createDataFrame([("bad", b"zip?")], "path string, content binary")
    checked = {r.path: r.ok for r in api.validate(made.unionByName(bad)).collect()}
    assert checked.pop("bad") is False and all(checked.values())
    assert {r.name for r in api.inspect(made).collect()} == {"mimetype", "content.xml", "styles.xml", "meta.xml", "META-INF/manifest.xml"}
    assert {r.path: r.text for r in api.extract_text(made).collect()}["1"].startswith("# T\n")
    assert all(r.ok for r in api.repack(made).collect())
    assert packages.package_rule(packages.entries(made)).where("NOT ok").count() == 0


def test_convert(docs):
    out = {r.id: r for r in api.convert(docs, "md", "odt").collect()}
    assert out["1"].code == 0 and odt.package_error(out["1"].content) is None
    assert out["2"].status == "invalid" and out["4"].status == "input"
    styled = {r.id: r for r in api.convert(docs, "md", "odt", profile=PROFILE).collect()}
    assert b"" != styled["1"].content and styled["1"].diagnostics[-1].severity == "info"
    strict = {r.id: r for r in api.convert(docs, "md", "odt", profile=PROFILE, policy="strict").collect()}
    assert strict["1"].code == 11
    with pytest.raises(ValueError):
        api.convert(docs, "md", "docx")
    with pytest.raises(ValueError):
        api.convert(docs, "md", "md", profile=PROFILE)
    with pytest.raises(rules.ProfileError):
        api.convert(docs, "md", "odt", profile="x")


def test_fold_agrees_with_the_one_pass_classifier(spark):
    p = rules.parse(PROFILE)
    stream = [("heading", 1, "a"), ("heading", 2, "b"), ("paragraph", 0, "xy"), ("heading", 2, "c"), ("paragraph", 0, "no")]
    df = spark.createDataFrame([(7, i, *x) for i, x in enumerate(stream)], "doc_id bigint, stream_idx int, kind string, level int, text string")
    for match_text in (False, True):
        got = [r.role for r in roles.classified(df, p, match_text).orderBy("stream_idx").collect()]
        assert got == rules.classify(p, stream, match_text)


def test_style_twins(spark):
    texts = ["---", "(1) x", "Dear A", "12 March 2026", "9 Main Street", "a@b.c", "School of x", "in this abstract", "Ada, Ben and C", "plain", "Ünïversität", "École, 5"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.paragraph_style(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [odt.paragraph_style(r.t) for r in got]


def test_files(spark, docs, tmp_path):
    (tmp_path / "a.md").write_text("# é\nx\n")
    got = files.read(spark, "md", str(tmp_path)).collect()
    assert [r.text for r in got] == ["# é\nx\n"]
    with pytest.raises(ValueError):
        files.read(spark, "docx", str(tmp_path))
    files.write_markdown(docs.where("doc_id = 1"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_stream_equals_batch(spark, docs, tmp_path):
    src = docs.where("doc_id IS NOT NULL")
    src.write.parquet(str(tmp_path / "in"))
    got = []
    q = pipeline.sink(pipeline.metrics(pipeline.documents(spark, str(tmp_path / "in"))), lambda df, _: got.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    from foliant.operators import lines

    assert sorted(map(str, got)) == sorted(map(str, lines.metrics(src).collect()))


def test_utf8(spark):
    good, bad = ("41", "C3BC", "E282AC", "F09F9982", ""), ("C0AF", "E080AF", "EDA080", "E282", "80", "F4908080")
    df = spark.createDataFrame([(x,) for x in good + bad], "h string").select("h", F.is_valid_utf8(F.unhex("h")).alias("ok"))
    assert {r.h for r in df.collect() if r.ok} == set(good)
    points = (0x41, 0x7F, 0x80, 0xFC, 0x7FF, 0x800, 0x20AC, 0xFFFF, 0x10000, 0x1F642, 0x10FFFF, 0xD800, 0x110000, -1)
    got = spark.createDataFrame([(p,) for p in points], "p int").select("p", H.utf8_bytes(F.col("p")).alias("b")).collect()
    for r in got:
        fine = 0 <= r.p <= 0x10FFFF and not 0xD800 <= r.p <= 0xDFFF
        assert (bytes(r.b) if r.b is not None else None) == (chr(r.p).encode() if fine else None)
    text = "aé€🙂"
    assert spark.createDataFrame([(text,)], "t string").select(H.code_points(F.col("t"))).first()[0] == [ord(c) for c in text]
    assert spark.createDataFrame([("",)], "t string").select(H.code_points(F.col("t"))).first()[0] == []


def test_names(spark):
    names = {"a": True, "_x1": True, "a:b-c.d": True, "éa": True, "1a": False, "-a": False, "": False, "a b": False}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", H.xml_name(F.col("n")).alias("ok"), H.local_name(F.col("n")).alias("l")).collect()
    assert {r.n: r.ok for r in got} == names and {r.n: r.l for r in got}["a:b-c.d"] == "b-c.d"


def test_registry():
    from foliant.functions.registry import Handler, Registry, default

    r = default()
    assert r.find("md") and r.find("docx") is None
    with pytest.raises(ValueError):
        r.register(r.find("md"))
    many = Registry()
    for i in range(16):
        many.register(Handler(f"f{i}", None, None))
    with pytest.raises(ValueError):
        many.register(Handler("one more", None, None))
    fail = Handler("bad", lambda _: ([], [("error", "invalid", "no")]), None)
    r.register(fail)
    assert blocks.convert_one("bad", "md", "x", True, registry=r)[0] == "policy"
    assert blocks.convert_one("bad", "md", "x", False, registry=r)[0] == "ok"
    assert blocks.convert_one("nil", "md", "x", False, registry=r)[0] == "registry"


def test_deflate(spark):
    import random

    rng = random.Random(0x12345678)
    rows = [(i, rng.randbytes(rng.randrange(3000)) + b"ab" * rng.randrange(9000)) for i in range(40)] + [(99, b""), (100, None)]
    got = {r.id: bytes(r.back) for r in packages.deflated(spark.createDataFrame(rows, "id bigint, data binary")).collect()}
    assert got == {i: d or b"" for i, d in rows}
