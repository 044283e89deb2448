"""The command line: verbs, codes, files written; and operators over nulls, empty tables and faulty input."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.__main__ import run
from foliant.functions import odt
from foliant.operators import blocks, diagnostics, gates, lines, packages


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("# T\n\ntext é\n")
    (tmp_path / "md" / "b.md").write_text("\n")
    return tmp_path


def made(path):
    return sorted(path.iterdir(), key=lambda p: p.name)


def test_convert_and_back(spark, folder, capsys):
    assert run(spark, ["convert", "--from", "md", "--to", "odt", "--diag-json", f"{folder}/md", f"{folder}/odt"]) == 0
    shown = capsys.readouterr()
    assert "2 written" in shown.out
    logs = [json.loads(x) for x in shown.err.splitlines() if x.startswith("{")]
    assert [x["warnings"] for x in logs] == [1]
    assert [odt.package_error(p.read_bytes()) for p in made(folder / "odt")] == [None, None]
    assert run(spark, ["validate", f"{folder}/odt"]) == 0
    assert run(spark, ["inspect", f"{folder}/odt"]) == 0
    assert "content.xml" in capsys.readouterr().out
    assert run(spark, ["extract-text", f"{folder}/odt"]) == 0
    assert "text é" in capsys.readouterr().out
    assert run(spark, ["repack", f"{folder}/odt", f"{folder}/again"]) == 0 and len(made(folder / "again")) == 2
    assert run(spark, ["convert", "--from", "odt", "--to", "md", f"{folder}/odt", f"{folder}/back"]) == 0
    assert [p.read_text() for p in made(folder / "back")][0] == "# T\ntext é\n"
    capsys.readouterr()


def test_template_and_text(spark, folder, capsys):
    assert run(spark, ["create", f"{folder}/md", f"{folder}/plain"]) == 0
    template = next(p for p in made(folder / "plain"))
    args = ["convert", "--from", "md", "--to", "odt", "--template", str(template), "--strict", f"{folder}/md", f"{folder}/styled"]
    assert run(spark, args) == 0 and len(made(folder / "styled")) == 2
    (folder / "bad.profile").write_text("x")
    assert run(spark, [str(folder / "bad.profile") if a == str(template) else a for a in args]) == 8
    assert run(spark, ["extract-text", f"{folder}/plain", f"{folder}/txt"]) == 0 and len(made(folder / "txt")) == 2
    capsys.readouterr()


def test_faults(spark, folder, capsys):
    (folder / "bad").mkdir()
    (folder / "bad" / "x.odt").write_bytes(b"PK")
    (folder / "bad" / "y.md").write_bytes(b"\xff\xfe")
    assert run(spark, ["validate", f"{folder}/bad"]) == 3
    assert run(spark, ["repack", f"{folder}/bad/x.odt", f"{folder}/no"]) == 3
    assert run(spark, ["create", f"{folder}/bad/y.md", f"{folder}/no"]) == 3
    assert run(spark, ["convert", "--from", "md", "--to", "odt", f"{folder}/bad/y.md", f"{folder}/no"]) == 2
    assert run(spark, ["convert", "--from", "md", "--to", "docx", f"{folder}/md", f"{folder}/no"]) == 5
    for wrong in ([], ["validate"], ["fly", "x"], ["convert", "--to", "md", "--from", "md", "a", "b"], ["convert", "--from", "md", "--to", "md", "--fast", "a", "b"]):
        assert run(spark, wrong) == 1
    capsys.readouterr()


def test_measured_agrees_with_its_parts(spark):
    rows = [(1, "# a\n| x |\n| --- |\n| --- |\nTable 1 - b\n| y |\n"), (2, None), (3, ""), (None, "[a](b) [^1]\n[^1]: n\n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in lines.measured(docs, ["doc_id"], a=F.col("text"), b=F.lit("# z")).collect()}
    assert [got[1].a.consecutive_separators, got[1].a.table_sep_lines, got[1].a.headings, got[1].b.headings] == [1, 2, 1, 1]
    assert got[2].a == got[3].a and got[2].a.bytes == 0
    assert [got[None].a.links, got[None].a.footnote_refs, got[None].a.footnote_defs] == [1, 1, 1]
    both = {r.doc_id: r for r in gates.source(docs).collect()}
    assert not both[1].ok and not both[1].ok_separator_runs and both[1].ok_headings and not both[2].ok_bytes and both[None].ok
    assert gates.source(docs.limit(0)).count() == 0


def test_round_trip_of_nothing(spark):
    files = spark.createDataFrame([("a", None), ("b", b"no")], "path string, content binary")
    assert {r.path: (r.status, r.before, r.after) for r in packages.round_trip(files).collect()} == {"a": ("input", None, None), "b": ("failed", None, None)}


def test_logs(spark):
    notes = spark.createDataFrame([(1, i, s, "c", "emit", m) for i, (s, m) in enumerate([("error", "a\x01\nb"), ("warning", None), ("info", "z")])], "doc_id bigint, seq int, severity string, code string, stage string, message string")
    assert diagnostics.as_text(notes).first().text == "diag: error: a\x01\nb\ndiag: warn: (no message)\ndiag: info: z\n"
    assert json.loads(diagnostics.as_json(notes).first().json)["diagnostics"][0]["message"] == "a?\nb"


def test_stream_keeps_its_first_blocks(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\n")], "doc_id bigint, text string")
    assert [r.text for r in blocks.stream(docs, 2).collect()] == ["a", "b"]
