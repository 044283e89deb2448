"""Markdown grammar: text to document model and back. Pure Python, one document at a time.

The model is made of dicts. A block has kind, style (or None) and its own
fields; an inline has kind and its own fields. One physical line is one block:
paragraphs are not joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Fixed values of the format.
ADMONITIONS = ("note", "tip", "warning", "important", "caution")
LIST_RUN = 128
WRAP, WRAP_FROM = 240, 48
TOC_RUN = 24
STAGE_LABELS = ("This stage:", "Previous stage:", "Latest stage:")
STAGE_LINK, STAGE_LINK_BYTES = "docs.oasis-open.org/office/OpenDocument/", 512

DIRECTIVE = re.compile(r":::[ \t]*([^ \t]+)[ \t]*(.*)", re.S)
HEADING = re.compile(r"(#{1,6}) (.*)", re.S)
MARKER = re.compile(r"(?:([-*])|([0-9]+)\.) (.*)", re.S)
STYLE_LINE = re.compile(r"[ \t]*\{\.([^}]+)\}[ \t]*")
DASHES = re.compile(r"[-: \t]*-[-: \t]*")
DELIMITER = re.compile(r"[-:| \t]*-[-:| \t]*")
STYLED = re.compile(r"\{\.([^|}]*)\|([^}]+)\}")
#: Where plain text ends.
MARKUP = re.compile(r"[\[*`]|!\[")
BREAKS = re.compile(r"[\n\r\t]")


def block(kind: str, line: int, **fields: object) -> dict:
    return {"kind": kind, "style": None, "line": line} | fields


def text_inline(text: str, style: str | None = None) -> dict:
    return {"kind": "text", "text": text, "style": style}


def inlines(s: str) -> list[dict]:
    """Left to right, the first construct that matches wins; children are plain text."""
    out, i, n = [], 0, len(s)
    while i < n:
        c = s[i]
        if c == "{" and s.startswith("{.", i) and i + 3 < n:
            m = STYLED.match(s, i)
            if m:
                out.append(text_inline(m[2], m[1]))
                i = m.end()
                continue
        if c == "!" and s.startswith("![", i) or c == "[":
            image = c == "!"
            a = i + 1 + image
            close = s.find("]", a)
            if close >= 0 and s.startswith("(", close + 1):
                end = s.find(")", close + 2)
                if end >= 0:
                    if image:
                        out.append({"kind": "image", "alt": s[a:close], "asset": s[close + 2 : end]})
                    else:
                        out.append({"kind": "link", "href": s[close + 2 : end], "title": None, "children": [text_inline(s[a:close])]})
                    i = end + 1
                    continue
        if c == "*":
            # two stars without a close fall back to one, whose close may be the second star
            for mark, kind in (("**", "strong"), ("*", "emphasis")):
                if s.startswith(mark, i) and (close := s.find(mark, i + len(mark))) >= 0:
                    out.append({"kind": kind, "children": [text_inline(s[i + len(mark) : close])]})
                    i = close + len(mark)
                    break
            else:
                out.append(text_inline(c))
                i += 1
            continue
        if c == "`" and (close := s.find("`", i + 1)) > i + 1:
            out.append({"kind": "code_span", "text": s[i + 1 : close]})
            i = close + 1
            continue
        m = MARKUP.search(s, i)
        j = max(m.start() if m else n, i + 1)
        out.append(text_inline(s[i:j]))
        i = j
    return out


def style_name(line: str) -> str | None:
    m = STYLE_LINE.fullmatch(line)
    return m[1] if m else None


def table_cells(line: str) -> list[str]:
    """Every pipe separates; a leading one and a trailing one make no cell."""
    line = line.strip(" \t")
    cells = [x.strip(" \t") for x in line.removeprefix("|").split("|")]
    if line.endswith("|") and len(cells) > 1 and not cells[-1]:
        cells.pop()
    return cells


def parse(text: str) -> tuple[list[dict], list[tuple[str, str, str]]]:
    """Top-level blocks, and diagnostics as (severity, code, message)."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    blocks: list[dict] = []
    notes: list[tuple[str, str, str]] = []

    def inline(s: str) -> list[dict]:
        got = inlines(s)
        if not got:
            notes.append(("warning", "unsupported_construct", "empty inline line"))
        return got

    def styled(b: dict, i: int) -> int:
        """Take the style line behind line i, if there is one; the last line used."""
        if i + 1 < len(lines) and (name := style_name(lines[i + 1])):
            b["style"] = name
            return i + 1
        return i

    def directive(i: int, name: str, arg: str) -> tuple[dict, int] | None:
        """A block that ::: closes, and its last line; an unclosed one ends on its own line, so that its lines are read again."""
        body, j, closed = [], i + 1, False
        while j < len(lines):
            x = lines[j].strip(" \t")
            if x == ":::":
                closed = True
                break
            if x:
                body.append((j, x))
            j += 1
        last = j if closed else i
        if not body and (name in ADMONITIONS or name == "figure"):
            notes.append(("warning", "unsupported_construct", "empty directive block"))
        if name in ADMONITIONS:
            b = block("admonition", i, admonition=name, blocks=[block("paragraph", k, inlines=inline(x)) for k, x in body])
            b["style"] = f"admonition-{name}"
            return b, last
        if name == "figure":
            b = block("figure", i, asset=arg, caption=[text_inline(body[-1][1])] if body else [])
            b["style"] = "figure"
            return b, last
        return None

    i = 0
    while i < len(lines):
        raw = lines[i]
        line = raw.lstrip(" \t")
        indent = len(raw) - len(line)
        if not line:
            i += 1
            continue
        if line.startswith(":::") and len(line) >= 4 and (m := DIRECTIVE.fullmatch(line)) and (got := directive(i, m[1], m[2])):
            blocks.append(got[0])
            i = got[1] + 1
            continue
        if line.startswith("```"):
            j = i + 1
            while j < len(lines) and not lines[j].lstrip(" \t").startswith("```"):
                j += 1
            body = "".join(x + "\n" for x in lines[i + 1 : j])
            if j == len(lines) and text.endswith("\n"):
                body += "\n"
            blocks.append(block("code", i, language=line[3:] or None, text=body))
            i = j + 1
            continue
        if line.startswith(">"):
            rest = line[1:].removeprefix(" ")
            blocks.append(block("quote", i, blocks=[block("paragraph", i, inlines=inline(rest))]))
            i += 1
            continue
        if m := HEADING.fullmatch(line):
            b = block("heading", i, level=len(m[1]), inlines=inline(m[2]))
            blocks.append(b)
            i = styled(b, i) + 1
            continue
        if line.startswith("|") and i + 1 < len(lines) and DELIMITER.fullmatch(lines[i + 1].strip(" \t")):
            head = table_cells(line)
            rows, j = [head], i + 2
            while j < len(lines) and lines[j].lstrip(" \t").startswith("|"):
                cells = table_cells(lines[j])
                if len(cells) != len(head):
                    break
                rows.append(cells)
                j += 1
            cell = lambda s, r, k: {"header": r == 0, "blocks": [block("paragraph", k, inlines=inline(s))]}
            b = block("table", i, rows=[[cell(s, r, i + r + (r > 0)) for s in row] for r, row in enumerate(rows)])
            blocks.append(b)
            i = styled(b, j - 1) + 1
            continue
        if m := MARKER.match(line):
            ordered = m[2] is not None
            run, j = [], i
            while j < len(lines) and len(run) < LIST_RUN:
                x = lines[j].lstrip(" \t")
                k = MARKER.match(x)
                if not k or (k[2] is not None) != ordered:
                    break
                run.append((j, len(lines[j]) - len(x), k[3]))
                j += 1
            items = []
            for at, depth, s in run:
                item = block("list_item", at, blocks=[block("paragraph", at, inlines=inline(s))])
                item["style"] = "li-n1" if depth > indent else "li-n0"
                items.append(item)
            b = block("list", i, ordered=ordered, items=items)
            # a style line right behind a list of one item names its style and is read again as a paragraph
            if len(run) == 1:
                styled(b, i)
            blocks.append(b)
            i = j
            continue
        b = block("paragraph", i, inlines=inline(line))
        blocks.append(b)
        i = i + 1 if line.startswith("|") else styled(b, i) + 1
    if not blocks:
        notes.append(("warning", "unsupported_construct", "empty document"))
    return blocks, notes


# export


def escape(s: str) -> str:
    return s.replace("<", "\\<").replace(">", "\\>")


def flatten(s: str) -> str:
    return BREAKS.sub(" ", s)


def escape_flat(s: str) -> str:
    return escape(flatten(s).replace("|", "\\|"))


def inline_text(xs: list[dict], flat: bool = False) -> str:
    esc = escape_flat if flat else escape
    out = []
    for x in merged_links(xs):
        kind = x["kind"]
        if kind == "text":
            out.append(f"{{.{x['style']}|{esc(x['text'])}}}" if x.get("style") and not flat else esc(x["text"]))
        elif kind == "line_break":
            out.append(" " if flat else "\n")
        elif kind == "emphasis":
            out.append(f"*{inline_text(x['children'], flat)}*")
        elif kind == "strong":
            out.append(f"**{inline_text(x['children'], flat)}**")
        elif kind == "code_span":
            out.append(f"`{x['text']}`")
        elif kind == "link":
            out.append(f"[{inline_text(x['children'], flat)}]({x['href']})")
        elif kind == "image":
            out.append(f"![{esc(x['alt'])}]({x['asset']})")
    return "".join(out)


def merged_links(xs: list[dict]) -> list[dict]:
    """Neighbouring links to one place with one title become one."""
    out: list[dict] = []
    for x in xs:
        if x["kind"] == "link" and out and out[-1]["kind"] == "link" and (out[-1]["href"], out[-1]["title"]) == (x["href"], x["title"]):
            out[-1] = out[-1] | {"children": out[-1]["children"] + x["children"]}
        else:
            out.append(x)
    return out


def raw_inline(xs: list[dict]) -> str:
    """Text without markup, on one line."""
    out = []
    for x in xs:
        if x["kind"] in ("text", "code_span"):
            out.append(flatten(x["text"]))
        elif x["kind"] == "line_break":
            out.append(" ")
        elif x["kind"] == "image":
            out.append(flatten(x["alt"]))
        else:
            out.append(raw_inline(x["children"]))
    return "".join(out)


def is_grammar(b: dict) -> bool:
    return b["kind"] == "paragraph" and any(x["kind"] in ("text", "code_span") and "::=" in x["text"] for x in b["inlines"])


def style_line(style: str | None, indent: int = 0) -> str:
    """Only styles with an underscore are written; other characters become dashes."""
    if not style or "_" not in style:
        return ""
    clean = re.sub(r"[^A-Za-z0-9_-]+", "-", style)[:127].rstrip("-")
    return " " * indent + f"{{.{clean}}}\n" if clean else ""


def export_list(b: dict, indent: int) -> str:
    out = []
    for n, item in enumerate(b["items"], 1):
        mark = f"{n}. " if b["ordered"] else "- "
        first, rest = (item["blocks"][0], item["blocks"][1:]) if item["blocks"] else (None, [])
        body = inline_text(first["inlines"]) if first and first["kind"] == "paragraph" else ""
        out.append(" " * indent + mark + body + "\n")
        for x in rest:
            if x["kind"] == "list":
                out.append(export_list(x, indent + 2))
            elif x["kind"] == "paragraph":
                out.append(" " * (indent + 2) + inline_text(x["inlines"]) + "\n")
    return "".join(out)


def delimiter_like(row: list[dict]) -> bool:
    """Cells of nothing but dashes, colons and blanks, with a dash in each."""
    xs = [[x for b in c["blocks"] for x in (b["inlines"] if b["kind"] == "paragraph" else [{"kind": "block"}])] for c in row]
    return bool(xs) and all(all(x["kind"] == "text" for x in c) and DASHES.fullmatch("".join(x["text"] for x in c)) for c in xs)


def export_block(b: dict, notes: list) -> str:
    kind = b["kind"]
    if kind == "heading":
        return "#" * b["level"] + " " + inline_text(b["inlines"]) + "\n" + style_line(b["style"])
    if kind == "paragraph":
        return inline_text(b["inlines"]) + "\n" + style_line(b["style"])
    if kind == "list":
        return export_list(b, 0) + style_line(b["style"])
    if kind == "code":
        body = b["text"] if b["text"].endswith("\n") or not b["text"] else b["text"] + "\n"
        return f"```{b['language'] or ''}\n{body}```\n"
    if kind == "table":
        out = []
        for row in (r for r in b["rows"] if not delimiter_like(r)):
            cells = [inline_text(c["blocks"][0]["inlines"], True) if c["blocks"] and c["blocks"][0]["kind"] == "paragraph" else "[complex]" for c in row]
            out.append("|" + "".join(f" {c} |" for c in cells) + "\n")
            if len(out) == 1:
                out.append("|" + " --- |" * len(row) + "\n")
        return "".join(out) + (style_line(b["style"]) if b["rows"] else "")
    if kind == "quote":
        return "".join(f"> {inline_text(x['inlines'])}\n" for x in b["blocks"] if x["kind"] == "paragraph") + style_line(b["style"])
    if kind == "admonition":
        return f":::{b['admonition']}\n" + "".join(inline_text(x["inlines"]) + "\n" for x in b["blocks"] if x["kind"] == "paragraph") + ":::\n"
    if kind == "figure":
        return f":::figure {b['asset']}\n" + (inline_text(b["caption"]) + "\n" if b["caption"] else "") + ":::\n"
    notes.append(("warning", "unsupported_construct", f"unsupported block {kind}"))
    return ""


def export(blocks: list[dict]) -> tuple[str, list]:
    """Markdown text of a document, with all rewrites applied, and diagnostics."""
    notes: list = []
    out, run = [], []
    for b in [*blocks, None]:
        if b is not None and is_grammar(b):
            run.append(raw_inline(b["inlines"]))
            continue
        if run:
            out.append("```bnf\n" + "".join(x + "\n" for x in run) + "```\n")
            run = []
        if b is not None:
            out.append(export_block(b, notes))
    text = footnotes("".join(out))
    text = "".join(x + "\n" for x in captions(reduced(text.split("\n"))))
    return wrap(text), notes


# rewrites


def footnotes(text: str) -> str:
    """[note: X] becomes a numbered reference; definitions follow the text."""
    found: list[str] = []

    def put(m: re.Match) -> str:
        found.append(m[1])
        return f"[^{len(found)}]"

    text = re.sub(r"\[note: ([^\]]+)\]", put, text)
    if found:
        text += ("" if text.endswith("\n") else "\n") + "".join(f"[^{k}]: {x}\n" for k, x in enumerate(found, 1))
    return text


def is_toc(line: str) -> bool:
    return line.startswith("[") and "](#__RefHeading" in line


def is_stage_link(line: str) -> bool:
    return line.startswith("[") and STAGE_LINK in line


def reduced(lines: list[str]) -> Iterator[str]:
    """Without blank lines, without more than a run's worth of contents links, stage labels and repeated links once."""
    run, labels, last = 0, set(), None
    for line in lines:
        if not line:
            continue
        run = run + 1 if is_toc(line) else 0
        if run > TOC_RUN:
            continue
        if line in STAGE_LABELS:
            if line in labels:
                continue
            labels.add(line)
        elif is_stage_link(line):
            if line == last:
                continue
            if len(line.encode()) <= STAGE_LINK_BYTES:
                last = line
        yield line


def is_caption(line: str) -> bool:
    return line.startswith("Table") and " - " in line


def captions(lines: Iterator[str]) -> Iterator[str]:
    """A blank line before a caption that stands right between two table rows."""
    got = list(lines)
    for k, line in enumerate(got):
        if is_caption(line) and 0 < k < len(got) - 1 and got[k - 1].startswith("| ") and got[k + 1].startswith("| "):
            yield ""
        yield line


STRUCTURED = re.compile(r" *(?:[#|>`:]|[-*] |[0-9]+\. )")


def may_wrap(line: str) -> bool:
    return not STRUCTURED.match(line) and "http://" not in line and "https://" not in line


def wrap_line(line: bytes) -> list[bytes]:
    """Broken at the last single blank behind byte 48 and up to byte 240 of what is left, while that is too long."""
    out, start = [], 0
    while len(line) - start > WRAP:
        at = start + WRAP
        while at > start + WRAP_FROM and not (line[at : at + 1] == b" " and at + 1 < len(line) and line[at + 1 : at + 2] != b" "):
            at -= 1
        if at <= start + WRAP_FROM:
            break
        out.append(line[start:at])
        start = at + 1
    out.append(line[start:])
    return out


def wrap(text: str) -> str:
    fenced, out = False, []
    for line in text.split("\n"):
        if len(line) <= WRAP // 4:  # at most four bytes a character
            out.append(line)
            fenced ^= line.startswith("```")
            continue
        out += [x.decode() for x in wrap_line(line.encode())] if not fenced and may_wrap(line) else [line]
        fenced ^= line.startswith("```")
    return "\n".join(out)
