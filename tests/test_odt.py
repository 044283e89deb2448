import random

import pytest

from foliant.functions import markdown as M
from foliant.functions import odt as O
from foliant.functions import rules as R

CONTENT = (
    '<?xml version="1.0"?><office:document-content xmlns:office="o" xmlns:text="t" xmlns:table="b" xmlns:draw="d" xmlns:xlink="x"><office:body><office:text>'
    '<text:section text:name="S"><text:p>in <text:span text:style-name="Emphasis">section</text:span></text:p></text:section>'
    '<text:h text:outline-level="3">Head</text:h><text:p>a<text:bookmark text:name="mark"/><text:a xlink:href="u">l</text:a>'
    '<text:note><text:note-body><text:p>foot</text:p></text:note-body></text:note><draw:frame><draw:image xlink:href="i.png"/></draw:frame></text:p>'
    '<table:table><table:table-row><table:table-cell><text:p>1</text:p></table:table-cell><table:table-cell><text:p>2</text:p></table:table-cell></table:table-row>'
    "<table:table-row><table:table-cell><text:p>3</text:p></table:table-cell><table:covered-table-cell/></table:table-row></table:table>"
    '<text:list text:style-name="LOrdered"><text:list-item><text:p>one</text:p></text:list-item></text:list><text:p text:style-name="Quotations">said</text:p>'
    "<text:p>Note: mind</text:p><office:forms/><text:weird><text:p>x</text:p></text:weird></office:text></office:body></office:document-content>"
)


def test_import():
    got, notes = O.import_content(CONTENT.encode())
    assert [b["kind"] for b in got] == ["heading", "paragraph", "heading", "paragraph", "table", "list", "quote", "quote", "paragraph"]
    assert M.raw_inline(got[0]["inlines"]) == "Section: S" and got[2]["level"] == 3
    assert [x["kind"] for x in got[3]["inlines"]] == ["text", "text", "link", "code_span", "image"]
    assert got[3]["inlines"][1]["text"] == "{#mark}" and got[3]["inlines"][3]["text"] == "[note: foot]"
    assert got[4]["rows"][1][1]["blocks"] == [] and got[5]["ordered"]
    assert notes == [("warning", "unsupported_construct", "unsupported text:weird")]
    text, _ = M.export(got)
    assert "[^1]: foot" in text and "[odt:unsupported text:weird]" in text


def test_package_round_trip():
    text = "# T\npara **b** *i* `c` [l](h)\n- a\n  - b\n- c\n| x | y |\n| --- | --- |\n| 1 | 2 |\n```\ncode <x>\n```\n> quoted\n"
    xml, _ = O.content_xml(M.parse(text)[0])
    data = O.package(xml)
    assert O.package_error(data) is None
    back, _ = O.import_content(O.content_of(data))
    assert [b["kind"] for b in back] == ["heading", "paragraph", "list", "table", "code", "quote"]
    assert data == O.package(xml)


def test_create_and_extract():
    data = O.create("This is a test.\nx < y & z")
    assert O.plain_text(O.content_of(data)) == "This is a test.\nx < y & z\n"
    assert O.package_error(O.repack(data)) is None
    assert [e.raw for e in O.entries(O.repack(data))] == [e.raw for e in O.entries(data)]


def test_bad_packages():
    good = O.create("x")
    items = O.entries(good)
    assert O.package_error(b"") and O.package_error(b"PK\x05\x06" + bytes(18))
    assert O.package_error(O.archive(items[1:])) == "mimetype"
    assert O.package_error(O.archive([items[0], *items[2:]])) == "no content.xml"
    assert O.package_error(O.archive(items[:-1])) == "no manifest"
    assert O.package_error(good[:-30])
    with pytest.raises(O.PackageError):
        O.repack(O.archive([*items, O.made("../x", b"")]))
    with pytest.raises(O.PackageError):
        O.tokens(b"<a><b></a>")
    with pytest.raises(O.PackageError):
        O.tokens(b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')


def test_template_keeps_entries():
    xml, _ = O.content_xml(M.parse("x")[0])
    template = O.archive([*O.entries(O.create("t")), O.made("Pictures/a.png", b"png")])
    got = O.package(xml, template=template)
    assert O.package_error(got) is None
    assert O.extract(O.find(O.entries(got), "Pictures/a.png")) == b"png"
    with pytest.raises(O.PackageError):
        O.package(xml, template=O.archive([O.made("a", b""), O.made("a", b"")]))


def test_random_entries_round_trip():
    rng = random.Random(0x12345678)
    for _ in range(50):
        data = rng.randbytes(rng.randrange(5000)) + b"a" * rng.randrange(5000)
        e = O.made("x", data)
        assert O.extract(O.entries(O.archive([e]))[0]) == data


def test_letter_styles():
    blocks = M.parse("# T\nAda Corp\n12 March 2026\nBen\nDear Ben\ntext\n## Introduction\nmore")[0]
    xml = O.content_xml(blocks)[0].decode()
    assert 'style-name="Affiliation">Ada Corp' in xml and 'style-name="RecipientLine">Ben' in xml and 'style-name="DateLine"' in xml
    assert "BodyTwoColumns" in xml


PROFILE = """profile: p  # a comment
version: 1
roles:
  Title:
  Intro:
  Body:
regions:
  G:
    start:
      - Intro
recognize:
  Title:
    match:
      - heading(level=1)
    where:
      - position == first
    priority: 10
  Intro:
    match:
      - heading(level=2)
    where:
      - after Title
      - before Body
    priority: 9
  Body:
    match:
      - paragraph
    where:
      - in G
      - startswith "x"
layout:
  Title:
    style: T
present:
  page:
    margins:
      top: 2cm
  styles:
    T:
      family: paragraph
      align: center
"""


def test_rules():
    p = R.parse(PROFILE)
    stream = [("heading", 1, "a"), ("heading", 2, "b"), ("paragraph", None, "xy"), ("heading", 2, "c"), ("paragraph", None, "no")]
    assert R.classify(p, stream) == ["Title", "Intro", None, "Intro", None]
    assert R.classify(p, stream, True) == ["Title", "Intro", "Body", None, None]
    assert R.unsupported(p) == 1 and p.present["styles"]["T"]["align"] == "center"


@pytest.mark.parametrize(
    ("old", "new"),
    [("version: 1", "version: 2"), ("  Title:\n  Intro", "\tTitle:\n  Intro"), ("      - heading(level=1)", "      - heading(level=7)"), ("      - after Title", "      - after Nobody"), ("    style: T", "    colour: T"), ("      align", "      colour")],
)
def test_bad_profiles(old, new):
    line = PROFILE.count("\n", 0, PROFILE.index(old)) + 1
    with pytest.raises(R.ProfileError, match=rf"^line {line}: "):
        R.parse(PROFILE.replace(old, new, 1))


def test_a_profile_needs_its_parts():
    text = PROFILE.replace("profile: p  # a comment\n", "")
    with pytest.raises(R.ProfileError, match=rf"^line {text.count(chr(10)) + 1}: "):
        R.parse(text)


def test_presentation():
    p = R.parse(PROFILE)
    xml = R.materialized(O.styles_xml().decode(), p.present)
    assert '<style:style style:name="T" style:family="paragraph"><style:paragraph-properties fo:text-align="center"/></style:style>' in xml
    assert 'fo:margin-top="2cm"' in xml
    O.tokens(xml.encode())
    assert R.patched('a="1" a="2"', "a", "x&y") == 'a="x&amp;y" a="2"'


def test_files_that_others_can_open(spark, tmp_path):
    import zipfile

    from foliant.operators import packages
    from foliant.sources import files

    made = packages.exported(spark.createDataFrame([(1, "# a\n"), (2, "b\n")], "doc_id bigint, text string")).selectExpr("'x/y/' || doc_id AS path", "content")
    made = made.unionByName(spark.createDataFrame([("plain", None), (None, bytearray(b"x"))], "path string, content binary"))
    folder = f"file://{tmp_path}/out"
    got = {r.path: r for r in files.write_files(made, folder).collect()}
    assert got["plain"].error and got[None].error and got["plain"].file is None
    for p in ("x/y/1", "x/y/2"):
        with zipfile.ZipFile(got[p].file.removeprefix("file://")) as z:
            assert z.testzip() is None and z.namelist()[0] == "mimetype"
    assert {r.ok for r in packages.validated(files.read_packages(spark, folder)).collect()} == {True}


def test_bad_packages_are_rows(spark):
    from foliant.functions import rules
    from foliant.operators import packages
    from foliant.plans.cases import PACKAGES, PRESENT, faulty

    bad = spark.createDataFrame([(n, None if faulty(n) is None else bytearray(faulty(n))) for n, *_ in PACKAGES], "path string, content binary")
    assert packages.entries(bad).count() > 0 and packages.texts(bad).count() == len(PACKAGES)
    assert packages.imported(bad).count() == len(PACKAGES) and packages.imported_blocks(bad).count() >= 0
    shown = {r.path: r for r in packages.presented(bad, rules.parse(PRESENT)).collect()}
    assert shown["null"].error and shown["cut short"].error and shown["sound"].content
