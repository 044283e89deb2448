"""Documents as rows of blocks, inlines and cells: parse, validate, export, convert."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown, model, odt
from ..functions.registry import Registry, default
from .kernel import flat_map

BLOCKS = (
    "doc_id bigint, path array<int>, parent array<int>, ord int, depth int, kind string, level int, ordered boolean, style_id string, "
    "code_language string, code_text string, admonition_kind string, asset_id string, src_line int, text string"
)
INLINES = "doc_id bigint, block array<int>, path array<int>, kind string, style_id string, text string, href string, title string, asset_id string, alt string"
CELLS = "doc_id bigint, table_path array<int>, row_idx int, col_idx int, is_header boolean, text string"
STATUS = "doc_id bigint, status string, err_code string, err_field string, err_index int, output string, diagnostics array<struct<severity:string,code:string,stage:string,message:string>>"


def blocks(docs: DataFrame, top: bool = False) -> DataFrame:
    """One row per block (or just top-level block) of every Markdown document, parents before children; text is that of a block's own inlines."""

    def rows(doc_id: int, text: str | None) -> Iterator[tuple]:
        for *row, b in model.flat_blocks(markdown.parse(text or "")[0], top):
            own = b.get("inlines", b.get("caption"))
            yield (doc_id, *row, None if own is None else markdown.raw_inline(own))

    return flat_map(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, BLOCKS)


def inlines(docs: DataFrame) -> DataFrame:
    """One row per inline."""

    def rows(doc_id: int, text: str | None) -> Iterator[tuple]:
        for path, *_, b in model.flat_blocks(markdown.parse(text or "")[0]):
            for x in model.flat_inlines(b.get("inlines", b.get("caption")) or []):
                yield (doc_id, path, *x)

    return flat_map(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, INLINES)


def cells(docs: DataFrame) -> DataFrame:
    """One row per table cell."""

    def rows(doc_id: int, text: str | None) -> Iterator[tuple]:
        for path, *_, b in model.flat_blocks(markdown.parse(text or "")[0]):
            for r, row in enumerate(b.get("rows", [])):
                for c, cell in enumerate(row):
                    yield (doc_id, path, r, c, cell["header"], " ".join(markdown.raw_inline(x["inlines"]) for x in cell["blocks"]))

    return flat_map(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, CELLS)


#: Blocks of a stream that rules see.
STREAM_MOST = 32_768
#: Kinds of blocks that rules know, by their names in the model.
STREAM_KINDS = {"heading": "heading", "paragraph": "paragraph", "list": "list", "table": "table", "quote": "blockquote", "code": "codeblock"}


def stream(docs: DataFrame, most: int = STREAM_MOST) -> DataFrame:
    """The block stream: top-level blocks of the six kinds that rules know, numbered; those behind the first `most` have no role."""

    def rows(doc_id: int, text: str | None) -> Iterator[tuple]:
        known = (b for b in markdown.parse(text or "")[0] if b["kind"] in STREAM_KINDS)
        for i, b in enumerate(islice(known, most)):
            yield (doc_id, i, STREAM_KINDS[b["kind"]], b.get("level"), markdown.raw_inline(b["inlines"]) if "inlines" in b else None)

    return flat_map(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, "doc_id bigint, stream_idx int, kind string, level int, text string")


def convert_one(source: str, target: str, payload: str | bytes, strict: bool, template: bytes | None = None, registry: Registry | None = None) -> tuple[str, model.Error | None, str | bytes | None, list]:
    """(status, error, output, diagnostics) of one document: import, validate, gate, export, gate."""
    registry = registry or default()
    reader, writer = registry.find(source), registry.find(target)
    notes: list[tuple[str, str, str, str]] = []
    if not reader or not writer:
        return "registry", None, None, [("error", "invalid", "parse", f"unknown format {source if not reader else target}")]
    at = lambda stage, xs: notes.extend((s, c, stage, m) for s, c, m in xs)
    gated = lambda: strict and any(n[0] == "error" for n in notes)
    try:
        got, xs = reader.read(payload)
        at("normalize_in", xs)
        if e := model.document_error(got):
            at("validate", [("error", e[0], e[1])])
            return "invalid", e, None, notes
        if gated():
            return "policy", None, None, notes
        out, xs = writer.write(got, template)
        at("emit", xs)
        return ("policy", None, None, notes) if gated() else ("ok", None, out, notes)
    except odt.PackageError as x:
        at("parse", [("error", "invalid", str(x))])
        return "failed", None, None, notes


def to_markdown(docs: DataFrame, strict: bool = False) -> DataFrame:
    """Markdown in, normalised Markdown out: status, first error, output and diagnostics of each document."""

    def rows(doc_id: int, text: str | None) -> Iterator[tuple]:
        status, e, out, notes = convert_one("md", "md", text or "", strict)
        yield (doc_id, status, *(e or (None, None, None)), out, [dict(zip(("severity", "code", "stage", "message"), n, strict=True)) for n in notes])

    return flat_map(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, STATUS)


def validated(docs: DataFrame) -> DataFrame:
    """(doc_id, err_code, err_field, err_index): the first error of each document's model, nulls if none."""

    def rows(doc_id: int, text: str | None) -> Iterator[tuple]:
        yield (doc_id, *(model.document_error(markdown.parse(text or "")[0]) or (None, None, None)))

    return flat_map(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, "doc_id bigint, err_code string, err_field string, err_index int")


def model_errors(models: DataFrame) -> DataFrame:
    """validated() for models as JSON: (doc_id, blocks, styles, assets, meta); what is no JSON is a parse error."""

    def rows(doc_id: int, *parts: str | None) -> Iterator[tuple]:
        try:
            blocks_, styles, assets, meta = (json.loads(p) if p else None for p in parts)
        except ValueError:
            yield (doc_id, "parse", None, None)
            return
        yield (doc_id, *(model.document_error(blocks_ or [], styles or [], assets or [], meta) or (None, None, None)))

    return flat_map(models.select(F.col("doc_id").cast("bigint"), "blocks", "styles", "assets", "meta"), rows, "doc_id bigint, err_code string, err_field string, err_index int")


def metadata(docs: DataFrame, language: str = "en") -> DataFrame:
    """(doc_id, title, author, language, created_unix_s, modified_unix_s): what a Markdown document is taken to say of itself."""
    return docs.select(
        F.col("doc_id").cast("bigint"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("author"),
        F.lit(language).alias("language"),
        F.lit(0).cast("bigint").alias("created_unix_s"),
        F.lit(0).cast("bigint").alias("modified_unix_s"),
    )


def line_inlines(lines: DataFrame) -> DataFrame:
    """(doc_id, seq, kind, body, target, style): top-level inlines of single lines (doc_id, line)."""

    def rows(doc_id: int, line: str | None) -> Iterator[tuple]:
        for i, x in enumerate(markdown.inlines(line or "")):
            body = x["alt"] if x["kind"] == "image" else x["text"] if "text" in x else markdown.raw_inline(x["children"])
            yield (doc_id, i, x["kind"], body, x.get("asset") or x.get("href"), x.get("style"))

    return flat_map(lines.select(F.col("doc_id").cast("bigint"), "line"), rows, "doc_id bigint, seq int, kind string, body string, target string, style string")


def wrapped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with long plain lines broken."""
    return flat_map(docs.select(F.col("doc_id").cast("bigint"), "text"), lambda i, t: [(i, markdown.wrap(t or ""))], "doc_id bigint, text string")


def first_errors(checked: DataFrame) -> DataFrame:
    """The first error of each document from rows (doc_id, stage, ord, err_code), in the order of stages; documents without any have none."""
    key = F.struct("stage", "ord")
    bad = F.col("err_code").isNotNull()
    return checked.groupBy("doc_id").agg(
        F.min_by(F.when(bad, F.col("err_code")), F.when(bad, key)).alias("err_code"),
        F.min_by(F.when(bad, F.col("ord")), F.when(bad, key)).alias("err_index"),
    )
