"""Packages: rows of ZIP entries, validation, text, import, export, repacking."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown, model, odt, rules
from . import blocks as B
from .kernel import Made, flat_map

#: What is wrong with a null.
NOTHING = "no content"
ENTRIES = "path string, idx int, name string, method int, gp_flags int, crc32 bigint, comp_size bigint, uncomp_size bigint, payload binary"


def entries(files: DataFrame, wanted: tuple[str, ...] | None = None, payload: bool = True) -> DataFrame:
    """One row per entry of each archive (path, content); only the wanted names are unpacked. Unreadable archives have no rows, nor has null."""

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            for i, e in enumerate(odt.entries(content or b"")):
                body = odt.extract(e) if payload and (wanted is None or e.name in wanted) else None
                yield (path, i, e.name, e.method, e.flags, e.crc, len(e.raw), e.size, body)
        except odt.PackageError:
            return

    return flat_map(files.select("path", "content"), rows, ENTRIES)


def listed(files: DataFrame | Made, wanted: tuple[str, ...] = ()) -> DataFrame:
    """(path, entries): entries() of each archive as an array in one row, which nothing has to gather again; only the wanted names are unpacked."""

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            got = [{"idx": i, "name": e.name, "payload": odt.extract(e) if e.name in wanted else None} for i, e in enumerate(odt.entries(content or b""))]
        except odt.PackageError:
            return
        if got:
            yield (path, got)

    return flat_map(files.select("path", "content"), rows, "path string, entries array<struct<idx:int,name:string,payload:binary>>")


def validated(files: DataFrame) -> DataFrame:
    """(path, ok, error): whether each file is a package of a text document; larger files than the limit are not."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        why = NOTHING if content is None else "too large" if len(content) >= odt.FILE_MOST else odt.package_error(content)
        yield (path, why is None, why)

    return flat_map(files.select("path", "content"), rows, "path string, ok boolean, error string")


def package_rule(zip_entries: DataFrame) -> DataFrame:
    """(path, ok): the package rule as an aggregate over rows of entries."""
    first = (F.col("idx") == 0) & (F.col("name") == "mimetype") & (F.col("method") == 0) & (F.col("payload") == F.lit(odt.MIMETYPE.encode()))
    has = lambda n: F.bool_or(F.col("name") == n)
    return zip_entries.groupBy("path").agg((F.bool_or(F.coalesce(first, F.lit(False))) & has(odt.CONTENT) & has(odt.MANIFEST)).alias("ok"))


def round_trip(files: DataFrame | Made) -> DataFrame:
    """(path, status, before, after): each package as Markdown, and as Markdown again behind a package made of that.

    status is the first step's that isn't ok; the texts of later steps are null. Null content is `input`.
    """

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        if content is None:
            yield (path, "input", None, None)
            return
        status, _, before, _ = B.convert_one("odt", "md", content, False)
        made = after = None
        if status == "ok":
            status, _, made, _ = B.convert_one("md", "odt", before, False)
        if made is not None:
            status, _, after, _ = B.convert_one("odt", "md", made, False)
        yield (path, status, before, after)

    return flat_map(files.select("path", "content"), rows, "path string, status string, before string, after string")


TEXTS = "path string, ok boolean, text string"


def _text(path: str | None, content: bytes | None) -> Iterator[tuple]:
    try:
        yield (path, True, odt.plain_text(odt.content_of(content or b"")))
    except odt.PackageError:
        yield (path, False, None)


def texts(files: DataFrame) -> DataFrame:
    """(path, ok, text): plain text of each package."""
    return flat_map(files.select("path", "content"), _text, TEXTS)


def texts_of_created(docs: DataFrame) -> DataFrame:
    """texts() of created(), with ids as paths, by one Python worker a task and not two; packages don't leave it."""
    made = lambda i, t: _text(None if i is None else str(i), odt.create(t or ""))
    return flat_map(docs.select(F.col("doc_id").cast("bigint"), "text"), made, TEXTS)


def created(docs: DataFrame) -> DataFrame:
    """(doc_id, content): a package of each plain text."""
    return flat_map(docs.select(F.col("doc_id").cast("bigint"), "text"), lambda i, t: [(i, odt.create(t or ""))], "doc_id bigint, content binary")


def exported(docs: DataFrame, template: bytes | None = None) -> DataFrame:
    """(doc_id, status, err_code, content): Markdown documents as packages."""

    def rows(doc_id: int, text: str | None) -> Iterator[tuple]:
        status, e, out, _ = B.convert_one("md", "odt", text or "", False, template)
        yield (doc_id, status, e[0] if e else None, out)

    return flat_map(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, "doc_id bigint, status string, err_code string, content binary")


def imported(files: DataFrame | Made) -> DataFrame:
    """(path, status, text): packages as Markdown."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        if content is None:
            yield (path, "input", None)
            return
        status, _, out, _ = B.convert_one("odt", "md", content, False)
        yield (path, status, out)

    return flat_map(files.select("path", "content"), rows, "path string, status string, text string")


def imported_blocks(files: DataFrame | Made) -> DataFrame:
    """(path, block_path, kind, level, text): blocks of packages."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            got, _ = odt.import_content(odt.content_of(content or b""))
        except odt.PackageError:
            return
        for p, _, _, _, kind, level, *_, b in model.flat_blocks(got):
            yield (path, p, kind, level, None if "inlines" not in b else markdown.raw_inline(b["inlines"]))

    return flat_map(files.select("path", "content"), rows, "path string, block_path array<int>, kind string, level int, text string")


def repacked(files: DataFrame) -> DataFrame:
    """(path, ok, error, content): the same entries written anew, nothing compressed again."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        if content is None:
            yield (path, False, NOTHING, None)
            return
        try:
            yield (path, True, None, odt.repack(content))
        except odt.PackageError as x:
            yield (path, False, str(x), None)

    return flat_map(files.select("path", "content"), rows, "path string, ok boolean, error string, content binary")


def template_merge(template: DataFrame, made: DataFrame) -> DataFrame:
    """Entries (path, name) of a template without those that are generated, and the generated ones."""
    return template.join(made, ["path", "name"], "left_anti").unionByName(made)


def presented(files: DataFrame | Made, profile: rules.Profile) -> DataFrame:
    """(path, content, error): packages with a profile's page and styles in styles.xml; unreadable ones have an error and no content."""
    return flat_map(files.select("path", "content"), present_rows(profile), "path string, content binary, error string")


def present_rows(profile: rules.Profile) -> Callable[..., Iterator[tuple]]:
    """What presented() does with a package."""
    present = profile.present

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        if content is None:
            yield (path, None, NOTHING)
            return
        try:
            yield (path, odt.restyled(content, lambda x: rules.materialized(x, present)), None)
        except (odt.PackageError, UnicodeDecodeError) as x:
            yield (path, None, str(x))

    return rows


def deflated(payload: DataFrame) -> DataFrame:
    """(id, packed, back): raw deflate and inflate of bytes; back must equal the input."""

    def rows(i: int, data: bytes | None) -> Iterator[tuple]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = c.compress(data or b"") + c.flush()
        d = zlib.decompressobj(-15)
        # piece by piece, in bounded windows
        out, rest = [], packed
        while rest:
            out.append(d.decompress(rest, 4096))
            rest = d.unconsumed_tail
        yield (i, packed, b"".join([*out, d.flush()]))

    return flat_map(payload.select("id", "data"), rows, "id bigint, packed binary, back binary")


def xml_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, kind, name): tokens of XML text; malformed text has none."""

    def rows(doc_id: int, text: str | None) -> Iterator[tuple]:
        try:
            for i, (kind, what, _) in enumerate(odt.tokens((text or "").encode())):
                yield (doc_id, i, kind, what)
        except odt.PackageError:
            return

    return flat_map(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, "doc_id bigint, seq int, kind string, name string")


def xml_names(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, uri, local, depth): start tags of XML text with their namespaces; malformed text has none."""

    def rows(doc_id: int, text: str | None) -> Iterator[tuple]:
        try:
            for i, x in enumerate(odt.resolved((text or "").encode())):
                yield (doc_id, i, *x)
        except odt.PackageError:
            return

    return flat_map(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, "doc_id bigint, seq int, uri string, local string, depth int")


def crc(payload: Column) -> Column:
    return F.crc32(payload.cast("binary"))
