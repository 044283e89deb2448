"""Rules of the document model: the first error of a document, and its flattening into rows."""

from __future__ import annotations

from collections.abc import Iterator

DEPTH = 64
BLOCKS = ("heading", "paragraph", "list", "list_item", "table", "quote", "code", "admonition", "figure")
INLINES = ("text", "emphasis", "strong", "code_span", "link", "image", "line_break")
TARGETS = ("block", "inline", "table", "page")
ADMONITIONS = ("note", "tip", "warning", "important", "caution")

#: (code, field, index) of an error.
Error = tuple[str, str, int]


def inline_error(xs: list[dict], depth: int = 0) -> Error | None:
    if depth > DEPTH:
        return ("limit", "inline.depth", 0)
    for i, x in enumerate(xs):
        kind = x["kind"]
        if kind not in INLINES:
            return ("invalid_enum", "inline.kind", i)
        if kind == "code_span" and not x["text"]:
            return ("missing_field", "inline.code_span.text", i)
        if kind == "link" and not x["href"]:
            return ("missing_field", "inline.link.href", i)
        if kind == "image" and not x["asset"]:
            return ("missing_field", "inline.image.asset_id", i)
        if "children" in x and (e := inline_error(x["children"], depth + 1)):
            return e
    return None


def block_error(b: dict, i: int, depth: int = 0) -> Error | None:
    if depth > DEPTH:
        return ("limit", "block.depth", i)
    kind = b["kind"]
    if kind not in BLOCKS:
        return ("invalid_enum", "block.kind", i)
    if kind == "heading" and not 1 <= b["level"] <= 6:
        return ("invalid_value", "block.heading.level", i)
    if kind == "list_item" and not b["blocks"]:
        return ("invalid_value", "block.list_item.blocks", i)
    if kind == "admonition" and b["admonition"] not in ADMONITIONS:
        return ("missing_field", "block.admonition.kind", i)
    if kind == "figure":
        if not b["asset"]:
            return ("missing_field", "block.figure.asset_id", i)
        return inline_error(b["caption"])
    if kind == "table":
        if not b["rows"]:
            return ("invalid_value", "block.table.rows", i)
        for r, row in enumerate(b["rows"]):
            if not row:
                return ("invalid_value", "block.table.row.cells", r)
            for c in row:
                if e := blocks_error(c["blocks"], depth + 1):
                    return e
    if "inlines" in b:
        return inline_error(b["inlines"])
    return blocks_error(b.get("items") or b.get("blocks") or [], depth + 1)


def blocks_error(blocks: list[dict], depth: int = 0) -> Error | None:
    return next((e for i, b in enumerate(blocks) if (e := block_error(b, i, depth))), None)


def styles_error(styles: list[dict]) -> Error | None:
    for i, s in enumerate(styles):
        if not s.get("id"):
            return ("missing_field", "style.id", i)
        if s.get("target") not in TARGETS:
            return ("invalid_enum", "style.target", i)
    return None


def assets_error(assets: list[dict]) -> Error | None:
    for i, a in enumerate(assets):
        if not a.get("id"):
            return ("missing_field", "asset.id", i)
        if not a.get("mime"):
            return ("missing_field", "asset.mime", i)
        if a.get("kind") not in ("embedded", "external"):
            return ("invalid_enum", "asset.kind", i)
        if a["kind"] == "external" and not a.get("uri"):
            return ("missing_field", "asset.uri", i)
    return None


def document_error(blocks: list[dict], styles: list[dict] = (), assets: list[dict] = (), meta: dict | None = None) -> Error | None:
    """The first error in the order metadata, blocks, styles, assets."""
    for i, k in enumerate(("language", "title", "author")):
        if meta is not None and k in meta and meta[k] is None and meta.get(f"{k}_length"):
            return ("invalid_value", f"metadata.{k}", i)
    return blocks_error(blocks) or styles_error(list(styles)) or assets_error(list(assets))


def flat_blocks(blocks: list[dict], top: bool = False) -> Iterator[tuple]:
    """(path, parent path or None, ord, depth, kind, level, ordered, style, language, code, admonition, asset, line, block), parents first; top: no children."""

    def walk(xs: list[dict], parent: list[int]) -> Iterator[tuple]:
        for i, b in enumerate(xs):
            path = [*parent, i]
            yield (path, parent or None, i, len(parent), b["kind"], b.get("level"), b.get("ordered"), b["style"], b.get("language"), b.get("text"), b.get("admonition"), b.get("asset"), b.get("line"), b)
            if top:
                continue
            if b["kind"] == "table":
                at = 0
                for row in b["rows"]:
                    for cell in row:
                        for c in cell["blocks"]:
                            yield from ((p[:-1] + [at], *rest) for p, *rest in walk([c], path))
                            at += 1
            else:
                yield from walk(b.get("items") or b.get("blocks") or [], path)

    return walk(blocks, [])


def flat_inlines(xs: list[dict], parent: tuple = ()) -> Iterator[tuple]:
    """(path, kind, style, text, href, title, asset, alt), parents first."""
    for i, x in enumerate(xs):
        path = (*parent, i)
        yield (list(path), x["kind"], x.get("style"), x.get("text"), x.get("href"), x.get("title"), x.get("asset"), x.get("alt"))
        yield from flat_inlines(x.get("children", []), path)
