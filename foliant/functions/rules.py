"""The rule language: profiles that name roles, recognise blocks as roles in one pass, bind roles to styles and present them.

A profile is indented text, two blanks a level. parse() checks it and returns
it, or raises ProfileError with the line of the first fault. Predicates on text
are valid but never match; that is what the language's engine does, and
match_text=True asks for their documented meaning instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

NAME = r"[A-Za-z0-9_-]+"
MATCHES = ("paragraph", "blockquote", "list", "table", "codeblock")
PAGE_KEYS, MARGINS = ("size", "orientation", "margins"), ("top", "right", "bottom", "left")
FONTS = ("body", "heading", "mono")
STYLE_KEYS = ("family", "based-on", "font-size", "font-weight", "font-style", "align", "margin-top", "margin-bottom", "margin-left", "margin-right", "text-indent", "line-height")
SECTIONS = ("roles", "regions", "recognize", "layout", "present")
TEXT_TERMS = ("startswith", "equals", "endswith", "regex", "uppercase")


class ProfileError(ValueError):
    def __init__(self, line: int, message: str) -> None:
        super().__init__(f"line {line}: {message}")


@dataclass
class Rule:
    role: str
    match: str = ""
    level: int | None = None
    priority: int = 0
    where: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Profile:
    name: str
    roles: list[str]
    regions: dict[str, list[str]]
    rules: list[Rule]
    layout: dict[str, str]
    present: dict


def bare(line: str) -> str:
    """Without a comment: # outside double quotes."""
    quoted = False
    for i, c in enumerate(line):
        if c == '"':
            quoted = not quoted
        elif c == "#" and not quoted:
            return line[:i].rstrip(" \t\r")
    return line.rstrip(" \t\r")


def predicate(s: str) -> tuple[str, str] | None:
    """(term, argument) of a condition, None if it is none."""
    if m := re.fullmatch(r'(startswith|equals|endswith|regex:?) "(.+)"', s):
        return m[1].rstrip(":"), m[2]
    if m := re.fullmatch(r"uppercase == (true|false)", s):
        return "uppercase", m[1]
    if m := re.fullmatch(r"position == (first|last)", s):
        return "position", m[1]
    if m := re.fullmatch(rf"(before|after|follows|precedes|in) ({NAME})", s):
        return m[1], m[2]
    return None


def parse(text: str) -> Profile:
    name, version = None, None
    roles: list[str] = []
    regions: dict[str, list[str]] = {}
    rules: list[Rule] = []
    layout: dict[str, str] = {}
    present: dict = {"page": {}, "margins": {}, "fonts": {}, "master": {}, "styles": {}}
    section, seen = "", set()
    at: dict = {}
    number = 0
    for number, raw in enumerate(text.removesuffix("\n").split("\n"), 1):
        indent = len(raw) - len(raw.lstrip(" "))
        if raw[indent : indent + 1] == "\t":
            raise ProfileError(number, "tab indentation is not allowed")
        line = bare(raw[indent:])
        if not line:
            continue
        fail = lambda why, n=number: ProfileError(n, why)
        key, colon, value = line.partition(":")
        value = value.strip(" \t")
        if indent == 0:
            if not colon:
                raise fail("expected top-level key")
            at = {}
            if key == "profile":
                if not value:
                    raise fail("profile value is required")
                name, section = value, ""
            elif key == "version":
                if value != "1":
                    raise fail("version must be integer 1")
                version, section = 1, ""
            elif key in SECTIONS:
                if value:
                    raise fail(f"{key} key must not have inline value")
                section = key
                seen.add(key)
            else:
                raise fail("unknown top-level key")
            continue
        if not section:
            raise fail("indented content outside known section")
        header = re.fullmatch(rf"({NAME}):", line) if indent == 2 else None
        if section == "roles":
            if indent != 2 or not header:
                raise fail("roles entries must be '  Role:'")
            if header[1] not in roles:
                roles.append(header[1])
        elif section == "regions":
            if indent == 2:
                if not header:
                    raise fail("invalid region header in regions section")
                at = {"region": header[1]}
                regions.setdefault(header[1], [])
            elif "region" not in at:
                raise fail("regions content without region header")
            elif indent == 4:
                if line != "start:":
                    raise fail("regions supports only 'start:' in v0.1")
                at["list"] = True
            elif indent == 6 and at.get("list"):
                m = re.fullmatch(rf"- ({NAME})", line)
                if not m:
                    raise fail("invalid regions start list item")
                if m[1] not in roles:
                    raise fail("unknown role in region start list")
                regions[at["region"]].append(m[1])
            else:
                raise fail("unsupported indentation in regions section")
        elif section == "recognize":
            if indent == 2:
                if not header:
                    raise fail("invalid role header in recognize section")
                if header[1] not in roles:
                    raise fail("recognize role not declared in roles")
                at = {"rule": Rule(header[1])}
                rules.append(at["rule"])
            elif "rule" not in at:
                raise fail("recognize rule content without role header")
            elif indent == 4:
                if not colon:
                    raise fail("expected match/where/priority key")
                if key == "priority":
                    if not value.isdigit():
                        raise fail("priority must be an integer")
                    at["rule"].priority = int(value)
                    at["list"] = ""
                elif key in ("match", "where") and not value:
                    at["list"] = key
                else:
                    raise fail("unknown recognize rule key")
            elif indent == 6:
                if not line.startswith("- "):
                    raise fail("expected list item '- ...' in recognize rule")
                item = line[2:].strip(" \t")
                if at.get("list") == "match":
                    m = re.fullmatch(r"heading\(level=([1-6])\)", item)
                    if not m and item not in MATCHES:
                        raise fail("invalid match expression")
                    # the last of several holds
                    at["rule"].match, at["rule"].level = ("heading", int(m[1])) if m else (item, None)
                elif at.get("list") == "where":
                    p = predicate(item)
                    if not p:
                        raise fail("invalid where predicate")
                    if p[0] in ("before", "after", "follows", "precedes") and p[1] not in roles:
                        raise fail(f"unknown role in {p[0]} predicate")
                    if p[0] == "in" and p[1] not in regions:
                        raise fail("unknown region in in predicate")
                    at["rule"].where.append(p)
                else:
                    raise fail("list item outside match/where section")
            else:
                raise fail("unsupported indentation in recognize section")
        elif section == "layout":
            if indent == 2:
                if not header:
                    raise fail("invalid role header in layout section")
                if header[1] not in roles:
                    raise fail("layout role not declared in roles")
                at = {"role": header[1]}
            elif "role" not in at:
                raise fail("layout content without role header")
            elif indent == 4:
                if key != "style" or not colon:
                    raise fail("layout supports only 'style:' in v0.1")
                if not value:
                    raise fail("style value is required")
                layout[at["role"]] = value
            else:
                raise fail("unsupported indentation in layout section")
        else:
            _present(present, at, indent, key, colon, value, fail)
    if not (name and version and {"roles", "recognize", "layout"} <= seen):
        raise ProfileError(number + 1, "profile must contain profile/version/roles/recognize/layout")
    return Profile(name, roles, regions, rules, layout, present)


def _present(p: dict, at: dict, indent: int, key: str, colon: str, value: str, fail) -> None:  # noqa: ANN001
    value = value.removeprefix('"').removesuffix('"') if len(value) > 1 else value
    if not colon:
        raise fail("invalid present section key")
    if indent == 2:
        if value:
            raise fail("present subsection must not have inline value")
        if key not in ("page", "fonts", "master", "styles"):
            raise fail("unknown present subsection")
        at.clear()
        at["sub"] = key
        return
    sub = at.get("sub")
    if not sub:
        raise fail("present content without subsection")
    if sub == "page":
        if indent == 4:
            if key not in PAGE_KEYS:
                raise fail("unknown present.page key")
            if (key == "margins") == bool(value):
                raise fail("present.page.margins must not have inline value" if value else "present.page value is required")
            at["margins"] = key == "margins"
            if value:
                p["page"][key] = value
        elif indent == 6 and at.get("margins"):
            if key not in MARGINS:
                raise fail("unknown present.page.margins key")
            if not value:
                raise fail("present.page.margins value is required")
            p["margins"][key] = value
        else:
            raise fail("unsupported indentation in present.page")
    elif sub == "fonts":
        if indent != 4:
            raise fail("unsupported indentation in present.fonts")
        if key not in FONTS:
            raise fail("unknown present.fonts key")
        if not value:
            raise fail("present.fonts value is required")
        p["fonts"][key] = value
    elif sub == "master":
        if indent == 4:
            if value:
                raise fail("invalid present.master page key")
            at["page"], at["part"] = key, None
            p["master"].setdefault(key, {})
        elif indent == 6:
            if not at.get("page"):
                raise fail("present.master content without page key")
            if key not in ("header", "footer"):
                raise fail("unknown present.master key")
            at["part"] = key
        elif indent == 8:
            if not at.get("part"):
                raise fail("present.master nested key without header/footer")
            if key not in ("left", "center", "right"):
                raise fail("unknown present.master header/footer key")
            if not value:
                raise fail("present.master header/footer value is required")
            p["master"][at["page"]].setdefault(at["part"], {})[key] = value
        else:
            raise fail("unsupported indentation in present.master")
    elif indent == 4:
        if value:
            raise fail("invalid present.styles style key")
        at["style"] = key
        p["styles"].setdefault(key, {})
    elif indent == 6:
        if not at.get("style"):
            raise fail("present.styles property without style key")
        if key not in STYLE_KEYS:
            raise fail("unknown present.styles property")
        if not value:
            raise fail("present.styles property value is required")
        p["styles"][at["style"]][key] = value
    else:
        raise fail("unsupported indentation in present.styles")


#: Kinds of the block stream by kinds of the model.
STREAM = {"heading": "heading", "paragraph": "paragraph", "quote": "blockquote", "list": "list", "table": "table", "code": "codeblock"}


def unsupported(p: Profile) -> int:
    return sum(t in TEXT_TERMS for r in p.rules for t, _ in r.where)


def holds(term: str, arg: str, i: int, n: int, text: str | None, last: str | None, seen: set, active: set, match_text: bool) -> bool:
    if term == "position":
        return i == (0 if arg == "first" else n - 1)
    if term == "after":
        return arg in seen
    if term in ("before", "precedes"):
        return arg not in seen
    if term == "follows":
        return last == arg
    if term == "in":
        return arg in active
    if not match_text or text is None:
        return False
    return {
        "startswith": lambda: text.startswith(arg),
        "equals": lambda: text == arg,
        "endswith": lambda: text.endswith(arg),
        "regex": lambda: re.search(arg, text) is not None,
        "uppercase": lambda: (text == text.upper()) == (arg == "true"),
    }[term]()


def classify(p: Profile, stream: list[tuple[str, int | None, str | None]], match_text: bool = False) -> list[str | None]:
    """Role of each block of a stream of (kind, level, text): the fitting rule of highest priority, the first of equals."""
    seen: set[str] = set()
    active: set[str] = set()
    last = None
    out: list[str | None] = []
    for i, (kind, level, text) in enumerate(stream):
        best = None
        for r in p.rules:
            if r.match != kind or (kind == "heading" and r.level != level) or (best and r.priority <= best.priority):
                continue
            if all(holds(t, a, i, len(stream), text, last, seen, active, match_text) for t, a in r.where):
                best = r
        last = best.role if best else None
        out.append(last)
        if last:
            seen.add(last)
            active |= {g for g, starts in p.regions.items() if last in starts}
    return out


# presentation


def escaped(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&apos;")


#: Attribute of each property: on paragraphs, or on text.
PARAGRAPH = {"align": "fo:text-align", "line-height": "fo:line-height", "margin-top": "fo:margin-top", "margin-bottom": "fo:margin-bottom", "margin-left": "fo:margin-left", "margin-right": "fo:margin-right", "text-indent": "fo:text-indent"}
TEXT = {"font-size": "fo:font-size", "font-weight": "fo:font-weight", "font-style": "fo:font-style"}


def style_xml(name: str, props: dict[str, str]) -> str:
    """A style definition."""
    attrs = f' style:name="{escaped(name)}" style:family="{escaped(props.get("family", "paragraph"))}"'
    if "based-on" in props:
        attrs += f' style:parent-style-name="{escaped(props["based-on"])}"'
    body = ""
    for element, known in (("style:paragraph-properties", PARAGRAPH), ("style:text-properties", TEXT)):
        own = "".join(f' {a}="{escaped(props[k])}"' for k, a in known.items() if k in props)
        body += f"<{element}{own}/>" if own else ""
    return f"<style:style{attrs}>{body}</style:style>" if body else f"<style:style{attrs}/>"


def patched(xml: str, attr: str, value: str) -> str:
    """The first value of an attribute replaced."""
    return re.sub(rf'{re.escape(attr)}="[^"]*"', lambda _: f'{attr}="{escaped(value)}"', xml, count=1)


def materialized(styles_xml: str, present: dict) -> str:
    """styles.xml with a profile's page and styles. A style of the same name is replaced, others are added."""
    out = styles_xml
    for name, props in present["styles"].items():
        out = re.sub(rf'<style:style [^>]*style:name="{re.escape(name)}"[^>]*?(?:/>|>.*?</style:style>)', "", out, flags=re.S)
        out = out.replace("</office:styles>", style_xml(name, props) + "</office:styles>", 1)
    page = {f"fo:margin-{k}": v for k, v in present["margins"].items()}
    if o := present["page"].get("orientation"):
        page["style:print-orientation"] = o
    if page:
        if "<style:page-layout-properties" not in out:
            layout = '<style:page-layout style:name="pm1"><style:page-layout-properties/></style:page-layout>'
            out = re.sub(r"</office:automatic-styles>|<office:automatic-styles/>", f"{layout}</office:automatic-styles>", out, count=1) if "</office:automatic-styles>" in out else out.replace("</office:styles>", f"</office:styles><office:automatic-styles>{layout}</office:automatic-styles>", 1)

        def put(m: re.Match) -> str:
            tag = m[0]
            for k, v in page.items():
                tag = patched(tag, k, v) if f'{k}="' in tag else re.sub(r"/?>$", lambda e, k=k, v=v: f' {k}="{escaped(v)}"{e[0]}', tag)
            return tag

        out = re.sub(r"<style:page-layout-properties[^>]*>", put, out, count=1)
    return out
