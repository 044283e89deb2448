"""OpenDocument Text: ZIP container, XML tokens, package rules, import into the document model and export. Pure Python."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.parsers import expat

from .heuristics import INSTITUTES, MEDIA_TYPES, MONTHS, STREETS
from .rules import escaped

MIMETYPE = "application/vnd.oasis.opendocument.text"
CONTENT, MANIFEST, STYLES, META = "content.xml", "META-INF/manifest.xml", "styles.xml", "meta.xml"
#: Sizes beyond which input is refused: content.xml, manifest, whole file.
CONTENT_MOST, MANIFEST_MOST, FILE_MOST = 64 << 20, 16 << 20, 32 << 20
#: Fixed values of the formats.
SKIPPED = (
    "office:forms", "text:sequence-decls", "text:user-field-decls", "text:tracked-changes", "text:variable-decls",
    "text:alphabetical-index", "text:illustration-index", "text:table-index", "text:bibliography", "text:object-index",
)
CODE_STYLES, QUOTE_STYLES = ("Preformatted_20_Text", "PCode"), ("Quotations", "PQuote")
EMPHASIS, STRONG, CODE = ("Emphasis", "TEmph"), ("Strong_20_Emphasis", "TStrong"), ("Source_20_Text", "TCode")
ADMONITIONS = ("note:", "warning:", "caution:", "important:")
NAMESPACES = {
    "office": "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "text": "urn:oasis:names:tc:opendocument:xmlns:text:1.0",
    "table": "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "style": "urn:oasis:names:tc:opendocument:xmlns:style:1.0",
    "draw": "urn:oasis:names:tc:opendocument:xmlns:drawing:1.0", "fo": "urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0",
    "xlink": "http://www.w3.org/1999/xlink", "svg": "urn:oasis:names:tc:opendocument:xmlns:svg-compatible:1.0",
}


class PackageError(ValueError):
    """Input that is not a readable package."""


@dataclass
class Entry:
    name: str
    method: int
    flags: int
    crc: int
    raw: bytes
    size: int


def entries(data: bytes) -> list[Entry]:
    """All entries of a ZIP archive, by its central directory; bytes as they are stored."""
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 70_000))
    if end < 0 or end + 22 > len(data):
        raise PackageError("no end of central directory")
    total, _, at = struct.unpack_from("<HII", data, end + 10)
    out = []
    for _ in range(total):
        if data[at : at + 4] != b"PK\x01\x02" or at + 46 > len(data):
            raise PackageError("bad central directory")
        flags, method, _, _, crc, packed, size, n, extra, note = struct.unpack_from("<HHHHIIIHHH", data, at + 8)
        local = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n]
        if data[local : local + 4] != b"PK\x03\x04":
            raise PackageError("bad local header")
        if local + 30 > len(data):
            raise PackageError("truncated entry")
        skip = struct.unpack_from("<HH", data, local + 26)
        start = local + 30 + sum(skip)
        raw = data[start : start + packed]
        if len(raw) < packed:
            raise PackageError("truncated entry")
        out.append(Entry(name.decode("utf-8", "replace"), method, flags, crc, raw, size))
        at += 46 + n + extra + note
    return out


def extract(e: Entry, most: int = CONTENT_MOST) -> bytes:
    """Contents of an entry. The size is checked, the CRC is not."""
    if e.size > most:
        raise PackageError("entry too large")
    if e.method == 0:
        out = e.raw
    elif e.method == 8:
        d = zlib.decompressobj(-15)
        try:
            out = d.decompress(e.raw, e.size + 1)
        except zlib.error as x:
            raise PackageError("bad deflate data") from x
    else:
        raise PackageError("unsupported method")
    if len(out) != e.size:
        raise PackageError("wrong size")
    return out


def unsafe(name: str) -> bool:
    return name[:1] in ("/", "\\") or ".." in re.split(r"[/\\]", name)


def made(name: str, payload: bytes, store: bool = False) -> Entry:
    packed = payload
    if not store:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = c.compress(payload) + c.flush()
    store = store or len(packed) >= len(payload)
    return Entry(name, 0 if store else 8, 0, zlib.crc32(payload), payload if store else packed, len(payload))


def archive(items: list[Entry]) -> bytes:
    """A ZIP archive; no times, so that equal input makes equal bytes."""
    out, central, at = [], [], 0
    for e in items:
        name = e.name.encode()
        fields = struct.pack("<HHHHIIIHH", e.flags & 0x0800, e.method, 0, 33, e.crc, len(e.raw), e.size, len(name), 0)
        out += [b"PK\x03\x04", struct.pack("<H", 20), fields, name, e.raw]
        central.append(b"PK\x01\x02" + struct.pack("<HH", 20, 20) + fields + struct.pack("<HHHII", 0, 0, 0, 0, at) + name)
        at += 30 + len(name) + len(e.raw)
    tail = b"".join(central)
    return b"".join([*out, tail, b"PK\x05\x06", struct.pack("<HHHHIIH", 0, 0, len(items), len(items), len(tail), at, 0)])


def find(items: list[Entry], name: str) -> Entry | None:
    return next((e for e in items if e.name == name), None)


def tokens(xml: bytes) -> list[tuple[str, str, dict]]:
    """(start | end | text, qname or text, attributes); names keep their prefixes, declarations are refused."""
    out: list[tuple[str, str, dict]] = []
    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler = lambda n, a: out.append(("start", n, a))
    p.EndElementHandler = lambda n: out.append(("end", n, {}))
    p.CharacterDataHandler = lambda s: out.append(("text", s, {}))

    def refuse(*_: object) -> None:
        raise PackageError("entity declaration")

    p.EntityDeclHandler = refuse
    try:
        p.Parse(xml, True)
    except expat.ExpatError as x:
        raise PackageError("bad XML") from x
    return out


def resolved(xml: bytes) -> list[tuple[str, str, int]]:
    """(uri, local name, depth) of every start tag, by the innermost binding of its prefix; an unbound prefix has an empty uri."""
    out: list[tuple[str, str, int]] = []
    scopes: list[dict[str, str]] = [{}]
    for kind, what, attrs in tokens(xml):
        if kind == "end":
            scopes.pop()
        elif kind == "start":
            own = {k.partition(":")[2]: v for k, v in attrs.items() if k == "xmlns" or k.startswith("xmlns:")}
            scopes.append(scopes[-1] | own)
            prefix, _, local = what.rpartition(":")
            out.append((scopes[-1].get(prefix, ""), local, len(scopes) - 2))
    return out


def package_error(data: bytes) -> str | None:
    """Why a file is not a valid package, None if it is."""
    try:
        items = entries(data)
        first = items[0] if items else None
        if not first or first.name != "mimetype" or first.method != 0 or first.raw != MIMETYPE.encode():
            return "mimetype"
        if not find(items, CONTENT):
            return "no content.xml"
        manifest = find(items, MANIFEST)
        if not manifest:
            return "no manifest"
        listed = {a.get("manifest:full-path"): a.get("manifest:media-type") for k, n, a in tokens(extract(manifest, MANIFEST_MOST)) if k == "start" and n == "manifest:file-entry"}
    except PackageError as x:
        return str(x)
    if listed.get("/") != MIMETYPE or listed.get(CONTENT) != "text/xml":
        return "manifest"
    return None


def content_of(data: bytes) -> bytes:
    e = find(entries(data), CONTENT)
    if not e:
        raise PackageError("no content.xml")
    return extract(e)


def plain_text(xml: bytes) -> str:
    """Text of all text:p; a paragraph or line break ends a line, text:s stands for blanks."""
    out, depth = [], 0
    for kind, what, attrs in tokens(xml):
        if what == "text:p" and kind != "text":
            depth += 1 if kind == "start" else -1
            if kind == "end":
                out.append("\n")
        elif depth and kind == "text":
            out.append(what)
        elif depth and kind == "start" and what == "text:line-break":
            out.append("\n")
        elif depth and kind == "start" and what == "text:s":
            out.append(" " * blanks(attrs))
    return "".join(out)


def blanks(attrs: dict) -> int:
    n = attrs.get("text:c", "1")
    return int(n) if n.isdigit() else 1


# import


class Reader:
    """Blocks of the tokens of office:text."""

    def __init__(self, toks: list[tuple[str, str, dict]]) -> None:
        self.toks, self.at, self.notes = toks, 0, []

    def inside(self, end: str) -> Iterator[tuple[str, str, dict]]:
        """Tokens up to the end of the element that has just begun; whoever reads them may consume children."""
        while self.at < len(self.toks):
            t = self.toks[self.at]
            self.at += 1
            if t[0] == "end" and t[1] == end:
                return
            yield t

    def skip(self, name: str) -> None:
        depth = 1
        while depth and self.at < len(self.toks):
            kind, what, _ = self.toks[self.at]
            self.at += 1
            if what == name and kind != "text":
                depth += 1 if kind == "start" else -1

    def flat(self, name: str) -> str:
        """All text of the element that has just begun."""
        out, depth = [], 1
        while depth and self.at < len(self.toks):
            kind, what, attrs = self.toks[self.at]
            self.at += 1
            if kind == "text":
                out.append(what)
            elif kind == "start" and what == "text:line-break":
                out.append("\n")
            elif kind == "start" and what == "text:s":
                out.append(" " * blanks(attrs))
            if what == name and kind != "text":
                depth += 1 if kind == "start" else -1
        return "".join(out)

    def inlines(self, name: str) -> list[dict]:
        out: list[dict] = []
        for kind, what, attrs in self.inside(name):
            if kind == "text":
                out.append({"kind": "text", "text": what, "style": None})
            elif kind == "end":
                continue
            elif what == "text:line-break":
                out.append({"kind": "line_break"})
            elif what == "text:s":
                out.append({"kind": "text", "text": " " * blanks(attrs), "style": None})
            elif what == "text:span":
                style = attrs.get("text:style-name")
                if style in CODE:
                    out.append({"kind": "code_span", "text": self.flat(what)})
                elif style in EMPHASIS or style in STRONG:
                    out.append({"kind": "emphasis" if style in EMPHASIS else "strong", "children": self.inlines(what)})
                else:
                    out += self.inlines(what)
            elif what == "text:a":
                href = attrs.get("xlink:href")
                children = self.inlines(what)
                out += [{"kind": "link", "href": href, "title": None, "children": children}] if href else children
            elif what == "text:note":
                out.append({"kind": "code_span", "text": f"[note: {self.flat(what)}]"})
            elif what in ("text:bookmark", "text:bookmark-start"):
                mark = attrs.get("text:name", "")
                if mark and not mark.startswith(("__RefHeading", "line-")):
                    out.append({"kind": "text", "text": f"{{#{mark}}}", "style": None})
            elif what == "draw:frame":
                href = None
                for k, w, a in self.inside(what):
                    if k == "start" and w == "draw:image":
                        href = a.get("xlink:href")
                out.append({"kind": "image", "alt": "image", "asset": href} if href else {"kind": "text", "text": "[image]", "style": None})
            else:
                self.skip(what)
        return out

    def paragraph(self, attrs: dict, top: bool) -> dict:
        style = attrs.get("text:style-name")
        if style in CODE_STYLES:
            return {"kind": "code", "style": None, "language": None, "text": self.flat("text:p")}
        xs = self.inlines("text:p")
        p = {"kind": "paragraph", "style": None, "inlines": xs}
        if not top:
            return p
        if style in QUOTE_STYLES or (xs and xs[0]["kind"] == "text" and xs[0]["text"].lower().startswith(ADMONITIONS)):
            return {"kind": "quote", "style": None, "blocks": [p]}
        if style in ("PHeading", "Heading") or (style or "").startswith("Heading_20_"):
            m = re.search(r"[1-6]", style[11:])
            return {"kind": "heading", "style": None, "level": int(m[0]) if m else 2, "inlines": xs}
        return p

    def item(self) -> dict:
        blocks: list[dict] = []
        for kind, what, attrs in self.inside("text:list-item"):
            if kind != "start":
                continue
            if what == "text:p":
                blocks.append(self.paragraph(attrs, False))
            elif what == "text:h":
                blocks.append({"kind": "paragraph", "style": None, "inlines": self.inlines(what)})
            elif what == "text:list":
                blocks.append({"kind": "paragraph", "style": None, "inlines": [{"kind": "text", "text": self.flat(what), "style": None}]})
            else:
                self.skip(what)
        return {"kind": "list_item", "style": None, "blocks": blocks or [{"kind": "paragraph", "style": None, "inlines": []}]}

    def list(self, attrs: dict) -> dict:
        items = []
        for kind, what, _ in self.inside("text:list"):
            if kind == "start":
                if what == "text:list-item":
                    items.append(self.item())
                else:
                    self.skip(what)
        return {"kind": "list", "style": None, "ordered": attrs.get("text:style-name") == "LOrdered", "items": items}

    def table(self) -> dict:
        rows = []
        for kind, what, _ in self.inside("table:table"):
            if kind != "start":
                continue
            if what != "table:table-row":
                self.skip(what)
                continue
            row = []
            for k, w, _a in self.inside(what):
                if k != "start":
                    continue
                if w == "table:table-cell":
                    blocks = []
                    for k2, w2, a2 in self.inside(w):
                        if k2 == "start":
                            if w2 == "text:p":
                                blocks.append(self.paragraph(a2, False))
                            else:
                                self.skip(w2)
                    row.append({"header": not rows, "blocks": blocks})
                else:
                    if w == "table:covered-table-cell":
                        row.append({"header": not rows, "blocks": []})
                    self.skip(w)
            rows.append(row)
        return {"kind": "table", "style": None, "rows": rows} if rows else self.placeholder("table:table")

    def placeholder(self, name: str) -> dict:
        self.notes.append(("warning", "unsupported_construct", f"unsupported {name}"))
        return {"kind": "paragraph", "style": None, "inlines": [{"kind": "text", "text": f"[odt:unsupported {name}]", "style": None}]}

    def blocks(self, name: str) -> Iterator[dict]:
        for kind, what, attrs in self.inside(name):
            if kind != "start":
                continue
            if what == "text:p":
                yield self.paragraph(attrs, True)
            elif what == "text:h":
                level = attrs.get("text:outline-level", "")
                yield {"kind": "heading", "style": None, "level": int(level) if level in "123456" and level else 1, "inlines": self.inlines(what)}
            elif what == "text:list":
                yield self.list(attrs)
            elif what == "table:table":
                yield self.table()
            elif what == "text:section":
                yield self.title(f"Section: {attrs.get('text:name', '')}")
                yield from self.blocks(what)
            elif what == "text:table-of-content":
                yield self.title("Table of Contents")
                yield from self.blocks(what)
            elif what in ("text:index-body", "text:index-title"):
                yield from self.blocks(what)
            elif what in SKIPPED or what.endswith("-source"):
                self.skip(what)
            else:
                self.skip(what)
                yield self.placeholder(what)

    def title(self, text: str) -> dict:
        return {"kind": "heading", "style": None, "level": 2, "inlines": [{"kind": "text", "text": text, "style": None}]}


def import_content(xml: bytes) -> tuple[list[dict], list[tuple[str, str, str]]]:
    """Blocks of content.xml; where its structure can't be read, its text as one paragraph."""
    toks = tokens(xml)
    r = Reader(toks)
    try:
        r.at = next(i for i, t in enumerate(toks) if t[:2] == ("start", "office:text")) + 1
        return list(r.blocks("office:text")), r.notes
    except (StopIteration, RecursionError):
        text = plain_text(xml)
        return [{"kind": "paragraph", "style": None, "inlines": [{"kind": "text", "text": text, "style": None}]}], [("warning", "lossy", "semantic parse failed")]


# export


def single_text(b: dict) -> str | None:
    xs = b["inlines"] if b["kind"] == "paragraph" else []
    return xs[0]["text"] if len(xs) == 1 and xs[0]["kind"] == "text" else None


ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def folded(s: str) -> str:
    return s.lower() if s.isascii() else s.translate(ASCII_LOWER)


def date_line(t: str) -> bool:
    if not (8 <= len(t.encode()) <= 64 and re.search("[0-9]", t)):
        return False
    low = folded(t)
    return any(m in low for m in MONTHS)


def paragraph_style(t: str | None) -> str:
    """The twin of heuristics.paragraph_style() for one text."""
    if t is None:
        return "Text_20_body"
    exact = {"---": "OJSeparator", "Whereas:": "OJWhereasLabel", "For the Commission": "OJSignatureLine", "The President": "OJSignatureTitle", "Sincerely,": "LetterClosing", "Sincerely": "LetterClosing"}
    if t in exact:
        return exact[t]
    n, low = len(t.encode()), folded(t)
    if re.match(r"\([0-9]+\) ", t):
        return "OJRecital"
    if t.startswith("Dear "):
        return "LetterSalutation"
    if t.startswith(("By email:", "By Email:", "CC:", "Cc:")):
        return "EmailLine"
    if date_line(t):
        return "DateLine"
    if 0 < n <= 96 and (any(w in low for w in STREETS) or ("," in t and re.search("[0-9]", t)) or re.search("[0-9]{4}", t)):
        return "Affiliation"
    if 0 < n <= 160 and "@" in t and "." in t:
        return "EmailLine"
    if n <= 60 and any(w in low for w in INSTITUTES):
        return "Affiliation"
    if "this abstract" in low or "the abstract should" in low:
        return "AbstractParagraph"
    if 8 <= n <= 80 and "@" not in t and "," in t and " and " in low:
        return "AuthorLine"
    return "Text_20_body"


def tag(name: str, body: str = "", **attrs: str) -> str:
    head = name + "".join(f' {k.replace("__", ":").replace("_", "-")}="{escaped(v)}"' for k, v in attrs.items())
    return f"<{head}>{body}</{name}>" if body else f"<{head}/>"


def text_xml(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def inlines_xml(xs: list[dict], notes: list) -> str:
    out = []
    for x in xs:
        kind = x["kind"]
        if kind == "text":
            out.append(tag("text:span", text_xml(x["text"]), text__style_name=x["style"]) if x.get("style") else text_xml(x["text"]))
        elif kind == "code_span":
            out.append(tag("text:span", text_xml(x["text"]), text__style_name="Source_20_Text"))
        elif kind in ("emphasis", "strong"):
            out.append(tag("text:span", inlines_xml(x["children"], notes), text__style_name="Emphasis" if kind == "emphasis" else "Strong_20_Emphasis"))
        elif kind == "link" and len(x["href"].encode()) < 1024:
            out.append(tag("text:a", inlines_xml(x["children"], notes), text__style_name="Internet_20_link", xlink__type="simple", xlink__href=x["href"]))
        elif kind == "image" and len(x["asset"].encode()) < 1024:
            out.append(tag("draw:frame", tag("draw:image", xlink__type="simple", xlink__show="embed", xlink__actuate="onLoad", xlink__href=x["asset"]), text__anchor_type="as-char"))
        elif kind == "line_break":
            out.append(tag("text:line-break"))
        else:
            notes.append(("warning", "lossy", f"{kind} dropped"))
    return "".join(out)


def list_xml(b: dict, notes: list, depth: int) -> str:
    """Items of style li-n1 behind an item of another style go into a list inside that item."""
    style = b["style"] or ("LOrdered" if b["ordered"] else "L1")
    out, k = [], 0
    body = lambda item: "".join(block_xml(x, notes, depth + 1) for x in item["blocks"])
    while k < len(b["items"]):
        own, k = body(b["items"][k]), k + 1
        nested = []
        while k < len(b["items"]) and b["items"][k]["style"] == "li-n1" and b["items"][k - 1 - len(nested)]["style"] != "li-n1":
            nested.append(tag("text:list-item", body(b["items"][k])))
            k += 1
        out.append(tag("text:list-item", own + (tag("text:list", "".join(nested), text__style_name=style) if nested else "")))
    return tag("text:list", "".join(out), text__style_name=style)


def block_xml(b: dict, notes: list, depth: int = 0, preamble: str | None = None) -> str:
    if depth > 32:
        raise PackageError("nested too deep")
    kind = b["kind"]
    if kind == "paragraph":
        guess = paragraph_style(single_text(b))
        if preamble and guess in ("Text_20_body", "Affiliation", "AuthorLine"):
            guess = preamble
        return tag("text:p", inlines_xml(b["inlines"], notes), text__style_name=b["style"] or guess)
    if kind == "heading":
        return tag("text:h", inlines_xml(b["inlines"], notes), text__style_name=b["style"] or f"Heading_20_{b['level']}", text__outline_level=str(b["level"]))
    if kind == "list":
        return list_xml(b, notes, depth)
    if kind == "code":
        return tag("text:p", tag("text:line-break").join(text_xml(x) for x in b["text"].removesuffix("\n").split("\n")), text__style_name=b["style"] or "Preformatted_20_Text")
    if kind == "table":
        cell = lambda c: tag("table:table-cell", "".join(block_xml(x, notes, depth + 1) for x in c["blocks"]) or tag("text:p"))
        rows = "".join(tag("table:table-row", "".join(cell(c) for c in row)) for row in b["rows"])
        return tag("table:table", rows, table__name="Table1", **({"table__style_name": b["style"]} if b["style"] else {}))
    if kind == "quote":
        return "".join(tag("text:p", inlines_xml(x["inlines"], notes), text__style_name=b["style"] or "Quotations") for x in b["blocks"] if x["kind"] == "paragraph")
    notes.append(("warning", "lossy", f"{kind} dropped"))
    return ""


def letter(blocks: list[dict]) -> tuple[int, int]:
    """Places of the salutation and of the date line before any heading of level 2 or more; the number of blocks if none."""
    n = next((i for i, b in enumerate(blocks) if b["kind"] == "heading" and b["level"] >= 2), len(blocks))
    first = lambda ok: next((i for i, b in enumerate(blocks[:n]) if (t := single_text(b)) is not None and ok(t)), len(blocks))
    return first(lambda t: t.startswith("Dear ")), first(date_line)


def inline_plain(xs: list[dict]) -> str:
    return "".join(x.get("text") or inline_plain(x.get("children", [])) for x in xs)


def two_columns_from(blocks: list[dict]) -> int:
    return next((i for i, b in enumerate(blocks) if b["kind"] == "heading" and b["level"] == 2 and "introduction" in folded(inline_plain(b["inlines"]))), len(blocks))


def content_xml(blocks: list[dict]) -> tuple[bytes, list]:
    notes: list = []
    salutation, date = letter(blocks)
    split = two_columns_from(blocks)
    role = lambda i: ("Affiliation" if i < date else "RecipientLine") if 0 < i < salutation < len(blocks) else None
    xml = [block_xml(b, notes, 0, role(i)) for i, b in enumerate(blocks)]
    body = "".join(xml[:split])
    styles = ""
    if split < len(blocks):
        body += tag("text:section", "".join(xml[split:]), text__style_name="SectCols2", text__name="BodyTwoColumns")
        styles = '<office:automatic-styles><style:style style:name="SectCols2" style:family="section"><style:section-properties><style:columns fo:column-count="2"/></style:section-properties></style:style></office:automatic-styles>'
    spaces = "".join(f' xmlns:{k}="{v}"' for k, v in NAMESPACES.items())
    return f'<?xml version="1.0" encoding="UTF-8"?><office:document-content{spaces} office:version="1.3">{styles}<office:body><office:text>{body}</office:text></office:body></office:document-content>'.encode(), notes


def styles_xml() -> bytes:
    """A plain style sheet with the styles that the exporter names."""
    named = [("Text_20_body", "Standard"), ("Quotations", "Text_20_body"), ("Preformatted_20_Text", "Standard"), *((f"Heading_20_{k}", "Standard") for k in range(1, 7))]
    body = '<style:style style:name="Standard" style:family="paragraph"/>' + "".join(f'<style:style style:name="{n}" style:family="paragraph" style:parent-style-name="{p}"/>' for n, p in named)
    body += "".join(f'<style:style style:name="{n}" style:family="text"/>' for n in ("Emphasis", "Strong_20_Emphasis", "Source_20_Text", "Internet_20_link"))
    spaces = "".join(f' xmlns:{k}="{v}"' for k, v in NAMESPACES.items())
    return f'<?xml version="1.0" encoding="UTF-8"?><office:document-styles{spaces} office:version="1.3"><office:styles>{body}</office:styles><office:automatic-styles/></office:document-styles>'.encode()


def media_type(name: str) -> str:
    return next((t for end, t in MEDIA_TYPES if name.endswith(end)), "")


def manifest_xml(names: list[str]) -> bytes:
    row = lambda path, kind: f'<manifest:file-entry manifest:full-path="{escaped(path)}" manifest:media-type="{kind}"/>'
    body = row("/", MIMETYPE) + "".join(row(n, media_type(n)) for n in names if n not in ("mimetype", MANIFEST))
    return f'<?xml version="1.0" encoding="UTF-8"?><manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" manifest:version="1.3">{body}</manifest:manifest>'.encode()


#: Entries and manifests that are the same in many packages, made once a process.
_FIXED: dict = {}


def fixed(key: object, make: Callable[[], Entry]) -> Entry:
    if key not in _FIXED:
        _FIXED[key] = make()
    return _FIXED[key]


def package(content: bytes, styles: bytes | None = None, template: bytes | None = None) -> bytes:
    """A package around content.xml. From a template, all its entries but mimetype, content and manifest are kept as stored."""
    items = [fixed("mimetype", lambda: made("mimetype", MIMETYPE.encode(), store=True)), made(CONTENT, content)]
    if template is not None:
        kept = [e for e in entries(template) if e.name not in ("mimetype", CONTENT, MANIFEST)]
        if len({e.name for e in kept}) < len(kept) or any(unsafe(e.name) for e in kept):
            raise PackageError("template has repeated or unsafe names")
        items += kept
    else:
        items.append(made(STYLES, styles) if styles else fixed(STYLES, lambda: made(STYLES, styles_xml())))
        items.append(fixed(META, lambda: made(META, b'<?xml version="1.0" encoding="UTF-8"?><office:document-meta xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" office:version="1.3"><office:meta/></office:document-meta>')))
    listed = lambda: made(MANIFEST, manifest_xml([e.name for e in items]))
    # templates name any number of files; without one the list is always the same
    items.append(fixed(MANIFEST, listed) if template is None else listed())
    return archive(items)


def create(text: str) -> bytes:
    """A package of plain text, a paragraph for each line."""
    xs = [{"kind": "text", "text": x, "style": None} for x in text.split("\n")]
    spaces = "".join(f' xmlns:{k}="{v}"' for k, v in NAMESPACES.items())
    body = "".join(tag("text:p", text_xml(x["text"])) for x in xs)
    return package(f'<?xml version="1.0" encoding="UTF-8"?><office:document-content{spaces} office:version="1.3"><office:body><office:text>{body}</office:text></office:body></office:document-content>'.encode())


def repack(data: bytes) -> bytes:
    """The same entries in the same order, as they are stored; refuses invalid packages and unsafe names."""
    if why := package_error(data):
        raise PackageError(why)
    items = entries(data)
    if any(unsafe(e.name) for e in items):
        raise PackageError("unsafe name")
    return archive(items)


def restyled(data: bytes, change) -> bytes:  # noqa: ANN001
    """The package with its styles.xml changed by a function of text; all other entries as they are stored."""
    items = entries(data)
    return archive([made(STYLES, change(extract(e).decode()).encode()) if e.name == STYLES else e for e in items])
