"""How the work of the engine's queries is dealt out and what it holds at once, on inputs that a reader takes as one task."""

import pyarrow as pa
import pytest

from foliant.functions import odt
from foliant.operators import blocks, gates, kernel, lines, packages
from foliant.plans import cases, catalog

#: Queries that make much of each short row.
DEALT = [
    "md_roundtrip",
    "metric_drift",
    "md_blocks",
    "present_styles",
    "md_stage_dedup",
    "md_toc_cap",
    "block_stream",
    "md_export",
    "odt_export",
    "md_cells",
    "md_rewrites",
    "odt_import",
    "odt_blocks",
    "validate_model",
    "validate_package",
    "extract_status",
    "convert_status",
    "md_inlines",
    "md_wrap",
    "style_xml",
    "letter_preamble",
]
#: Queries that stay in the row behind that: what a plan of theirs must not have.
IN_ROW = {
    "metric_drift": ("Join", "Broadcast", "Window", "Aggregate"),
    "present_styles": ("Aggregate", "Window"),
    "md_stage_dedup": ("Window", "Sort"),
    "md_toc_cap": ("Window", "Sort"),
    "block_stream": ("Aggregate", "Generate"),
}


@pytest.mark.parametrize("name", DEALT)
def test_rows_of_one_file_are_dealt_to_many_tasks(spark, sf, name):
    assert spark.read.parquet(f"{sf}/part.parquet").rdd.getNumPartitions() == 1
    assert catalog.QUERIES[name](spark, sf).rdd.getNumPartitions() >= 4


def test_fixed_entries_are_packed_once(monkeypatch):
    odt.package(b"<a/>")
    packed, made = [], odt.made
    monkeypatch.setattr(odt, "made", lambda name, *rest, **more: packed.append(name) or made(name, *rest, **more))
    a, b = odt.package(b"<a/>"), odt.package(b"<b/>", b"<own/>")
    assert packed == [odt.CONTENT, odt.CONTENT, odt.STYLES]
    assert odt.package_error(a) is odt.package_error(b) is None
    assert odt.extract(odt.find(odt.entries(b), odt.STYLES)) == b"<own/>"
    odt.package(b"<a/>", template=odt.archive([odt.made("x.bin", b"x")]))
    assert b"x.bin" not in odt.extract(odt.find(odt.entries(odt.package(b"<a/>")), odt.MANIFEST))


@pytest.mark.parametrize("name", IN_ROW)
def test_plans_that_stay_in_the_row(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not [x for x in IN_ROW[name] if x in plan]


def test_versions_of_contents_lists(spark):
    link = "[x](#__RefHeading1)"
    rows = [(1, "\n".join([link] * 3 + ["", link, "t"] + [link] * 2) + "\n"), (2, None), (3, ""), (4, "\n\n"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.after for r in lines.toc_versions(docs, 2).collect()}
    assert got == {1: "\n".join([link] * 2 + ["t"] + [link] * 2), None: "a"}
    assert sorted((r.doc_id, r.line_no) for r in lines.toc_capped(docs.where("doc_id = 1"), 2).collect()) == [(1, n) for n in (0, 1, 5, 6, 7)]
    drift = {r.doc_id: r for r in gates.drift(lines.toc_versions(docs, 2)).collect()}
    assert drift[1].drift_links == 2 and drift[None].drift_bytes == 0


def test_top_level_blocks_alone(spark):
    docs = spark.createDataFrame([(1, "# a\n- b\n- c\n> d\n| e |\n| - |\n| f |\n"), (2, None)], "doc_id bigint, text string")
    assert blocks.blocks(docs, top=True).collect() == blocks.blocks(docs).where("depth = 0").collect()


def test_listing_has_the_entries_of_each_archive(spark, sf):
    files = cases.faulty_packages(spark, sf).limit(40)
    want: dict = {}
    for r in packages.entries(files, wanted=("mimetype",)).collect():
        want.setdefault(r.path, []).append((r.idx, r.name, r.payload))
    assert {r.path: [tuple(e) for e in r.entries] for r in packages.listed(files, ("mimetype",)).collect()} == want


class Taken:
    """Stands for a DataFrame and hands out what would run in the workers."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


@pytest.mark.parametrize("name", ["md_roundtrip", "present_styles", "odt_import", "odt_blocks"])
def test_packages_are_made_and_read_in_one_worker(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_kernels_in_one_worker_do_as_two(spark):
    df = spark.range(5).selectExpr("id", "CAST(id AS STRING) AS s")
    twice, tag = lambda i, s: [(i, s), (i, s + "!")][: i], lambda i, s: [(s, i)]
    two = kernel.flat_map(kernel.flat_map(df, twice, "id bigint, s string"), tag, "s string, id bigint")
    assert kernel.flat_map(kernel.Made(df, twice, ("id", "s")), tag, "s string, id bigint").collect() == two.collect()
    with pytest.raises(ValueError):
        kernel.Made(df, twice, ("id", "s")).select("s", "id")


@pytest.mark.parametrize("wide", [0, 20_000, 3_000_000])
def test_a_kernel_holds_few_rows_at_once(wide):
    rows = 9000 if not wide else 60_000_000 // wide
    b = pa.record_batch({"i": pa.array(range(rows), pa.int64()), "t": pa.array(["x" * wide] * rows)})
    live, most = 0, 0

    def fn(i, t):
        nonlocal live, most
        live += len(t)
        most = max(most, live)
        yield i, t

    got = []
    for out in kernel.flat_map(Taken(), fn, "i bigint, t string")(iter([b.slice(0, 0), b])):
        got += out["i"].to_pylist()
        assert out.nbytes <= 2 * kernel.BYTES + wide and out.num_rows <= kernel.BATCH
        live = 0
    assert got == list(range(rows)) and most <= 2 * kernel.BYTES + wide
    assert list(kernel.flat_map(Taken(), fn, "i bigint, t string")(iter([])))[0].num_rows == 0


def test_text_to_packages_and_back_in_one_kernel(spark, sf):
    docs = spark.createDataFrame([(1, "a\n b  <c>"), (2, None), (3, ""), (None, "\x01")], "doc_id bigint, text string")
    made = packages.created(docs).selectExpr("CAST(doc_id AS STRING) AS path", "content")
    key = lambda r: str(r.path)
    assert sorted(packages.texts_of_created(docs).collect(), key=key) == sorted(packages.texts(made).collect(), key=key)
    assert catalog.QUERIES["odt_extract_text"](spark, sf)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_stages_of_odd_documents(spark):
    a, b = ("[%s](http://docs.oasis-open.org/office/OpenDocument/%s)" % (x, x) for x in "ab")
    texts = {1: ["", "This stage:", a, "x", "This stage:", a, b, a, "Latest stage:", "", "Latest stage:", "x"], 2: [a], 3: ["", ""], None: ["This stage:", "This stage:"]}
    docs = spark.createDataFrame([*((i, "\n".join(x)) for i, x in texts.items()), (4, None), (2, a)], "doc_id bigint, text string")
    got = sorted(((str(r.doc_id), r.line_no, r.line) for r in lines.stages_once(docs).collect()))
    kept = {1: (1, 2, 3, 6, 7, 8, 11), 2: (0, 0), None: (0,)}  # two documents of one id are two documents
    assert got == sorted((str(i), n, texts[i][n]) for i, ns in kept.items() for n in ns)


def test_streams_of_documents_of_one_id(spark):
    docs = spark.createDataFrame([(1, "# a\n:::note\nx\n:::\n> b\n"), (1, "- c\n"), (2, None), (None, "d\n")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.stream_idx, r.kind, str(r.text)) for r in blocks.stream(docs).collect())
    assert got == [("1", 0, "heading", "a"), ("1", 0, "list", "None"), ("1", 1, "blockquote", "None"), ("None", 0, "paragraph", "d")]
