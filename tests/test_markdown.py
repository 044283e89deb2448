import re

from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.functions import markdown as M
from foliant.functions import model


def kinds(text):
    return [b["kind"] for b in M.parse(text)[0]]


def test_blocks():
    text = "# T\np one\n> q\n```sql\na\n  b\n```\n- x\n- y\n1. z\n| a | b |\n| --- | --- |\n| c | d |\n:::note\nin\n:::\n:::figure pic\ncap\n:::\n"
    assert kinds(text) == ["heading", "paragraph", "quote", "code", "list", "list", "table", "admonition", "figure"]
    got = M.parse(text)[0]
    assert got[3]["language"] == "sql" and got[3]["text"] == "a\n  b\n"
    assert [len(b["items"]) for b in got if b["kind"] == "list"] == [2, 1]
    assert got[6]["rows"][0][0]["header"] and not got[6]["rows"][1][0]["header"]
    assert M.raw_inline(got[8]["caption"]) == "cap"


def test_headings_need_a_blank_and_at_most_six_hashes():
    assert kinds("####### x\n#x\n###### y") == ["paragraph", "paragraph", "heading"]


def test_style_lines():
    got = M.parse("# T\n{.A_b}\npara\n{.c}\n- one\n{.d}\nend\n")[0]
    assert [(b["kind"], b["style"]) for b in got] == [("heading", "A_b"), ("paragraph", "c"), ("list", "d"), ("paragraph", None), ("paragraph", None)]
    assert [b["kind"] for b in M.parse("- a\n- b\n{.d}")[0]] == ["list", "paragraph"]


def test_list_runs_end_after_128_items():
    got = M.parse("- x\n" * 129)[0]
    assert [len(b["items"]) for b in got] == [128, 1]
    assert [i["style"] for i in M.parse("- a\n  - b\n- c")[0][0]["items"]] == ["li-n0", "li-n1", "li-n0"]


def test_unclosed_directive_is_read_again():
    assert kinds(":::note\none\ntwo") == ["admonition", "paragraph", "paragraph"]
    assert len(M.parse(":::note\none\ntwo")[0][0]["blocks"]) == 2


def test_table_ends_where_cells_differ():
    got = M.parse("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\n")[0]
    assert [b["kind"] for b in got] == ["table", "paragraph"] and len(got[0]["rows"]) == 2
    assert M.table_cells("| a \\| b |") == ["a \\", "b"]


def test_inlines():
    got = M.inlines("{.s|x}![a](b)[t](h)**B***i*`c` y {.s|z}")
    assert [x["kind"] for x in got] == ["text", "image", "link", "strong", "emphasis", "code_span", "text"]
    assert got[0]["style"] == "s" and got[-1]["text"] == " y {.s|z}"
    assert [x["kind"] for x in M.inlines("**a")] == ["emphasis", "text"]
    assert [x["kind"] for x in M.inlines("[a")] == ["text", "text"]


def test_empty():
    assert M.parse("") == ([], [("warning", "unsupported_construct", "empty document")])


def test_export_rewrites():
    out, _ = M.export(M.parse("a ::= b\nc ::= d\n\nsee [note: one] and [note: two]\n| Table | x |\n| --- | --- |\n")[0])
    assert out.startswith("```bnf\na ::= b\nc ::= d\n```\n")
    assert "[^1]" in out and "[^2]: two\n" in out and "[note:" not in out
    assert M.style_line("Text_20 body!") == "{.Text_20-body}\n" and M.style_line("plain") == ""
    assert M.export(M.parse("1. x\n5. y\n")[0])[0] == "1. x\n2. y\n"
    assert M.inline_text(M.inlines("[a](h)[b](h)")) == "[ab](h)"


def test_reductions():
    toc = ["[x](#__RefHeading1)"] * 30
    assert len(list(M.reduced(toc))) == 24
    link = "[a](http://docs.oasis-open.org/office/OpenDocument/a)"
    assert list(M.reduced(["This stage:", link, "This stage:", "x", link, "Latest stage:"])) == ["This stage:", link, "x", "Latest stage:"]
    assert list(M.captions(["| a |", "Table 1 - x", "| b |"])) == ["| a |", "", "Table 1 - x", "| b |"]


def test_first_error():
    assert model.document_error(M.parse("[x]()")[0]) == ("missing_field", "inline.link.href", 0)
    assert model.document_error(M.parse("ok\n:::figure\nc\n:::")[0]) == ("missing_field", "block.figure.asset_id", 1)
    assert model.document_error(M.parse("ok")[0], [{"id": "a", "target": "cell"}]) == ("invalid_enum", "style.target", 0)
    assert model.document_error([], [], [{"id": "a", "mime": "m", "kind": "external"}]) == ("missing_field", "asset.uri", 0)
    assert model.document_error(M.parse("fine")[0]) is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é*`[](){}.|#>- \n:1!_", max_size=400))
def test_any_text_parses_and_exports(text):
    out, _ = M.export(M.parse(text)[0])
    again, _ = M.export(M.parse(out)[0])
    assert isinstance(again, str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abé ", min_size=1, max_size=90), min_size=1, max_size=30))
def test_wrap(parts):
    line = " ".join(parts)
    got = M.wrap_line(line.encode())
    assert b" ".join(got) == line.encode()
    for piece in got[:-1]:
        assert len(piece) <= 240
    if len(got[-1]) > 240:
        assert not re.search(rb"[^ ] [^ ]", got[-1][M.WRAP_FROM : 240])


def test_directives_end_at_three_colons_alone():
    got = M.parse(":::tip\na\n:::x\nb \n ::: \nafter")[0]
    assert [b["kind"] for b in got] == ["admonition", "paragraph"]
    assert [M.raw_inline(p["inlines"]) for p in got[0]["blocks"]] == ["a", ":::x", "b"]
    assert M.parse(":::tip\n:::")[1] == [("warning", "unsupported_construct", "empty directive block")]
    assert M.parse(":::other\nx")[0][0]["kind"] == "paragraph"


def test_code_and_delimiter_rows():
    assert M.parse("``` a b\nx\n")[0][0]["language"] == " a b" and M.parse("```\nx\n")[0][0]["text"] == "x\n\n"
    cell = lambda t: {"header": False, "blocks": [{"kind": "paragraph", "style": None, "inlines": M.inlines(t)}]}
    assert M.delimiter_like([cell("---"), cell(": -")]) and not M.delimiter_like([cell("---"), cell("a")]) and not M.delimiter_like([cell(":")])
