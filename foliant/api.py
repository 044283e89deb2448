"""The verbs: validate, inspect, extract text, create, repack, convert. Each takes rows and returns rows; bad input is a row too."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import markdown, model, odt, rules
from .operators import blocks, packages
from .operators.kernel import flat_map

#: Outcomes of convert() and the exit codes they stand for.
CODES = {"ok": 0, "usage": 1, "input": 2, "registry": 3, "session": 4, "invalid": 5, "failed": 5, "policy": 5, "output": 6, "template": 7, "profile": 8, "not_markdown": 9, "runtime": 10, "unsupported": 11}
POLICIES = ("lossy", "strict", "roundtrip_safe")
FORMATS = ("md", "odt")
RESULT = "id string, status string, code int, text string, content binary, diagnostics array<struct<severity:string,code:string,stage:string,message:string>>"


def validate(files: DataFrame) -> DataFrame:
    return packages.validated(files)


def inspect(files: DataFrame) -> DataFrame:
    """One row per entry: path, idx, name, method, uncomp_size."""
    return packages.entries(files, payload=False).select("path", "idx", "name", "method", "uncomp_size")


def extract_text(files: DataFrame) -> DataFrame:
    return packages.texts(files)


def create_odt(docs: DataFrame) -> DataFrame:
    return packages.created(docs)


def repack(files: DataFrame) -> DataFrame:
    return packages.repacked(files)


def convert(df: DataFrame, source: str, target: str, template: bytes | None = None, profile: str | None = None, policy: str = "lossy") -> DataFrame:
    """(id, status, code, text, content, diagnostics) of each row of df: (doc_id, text) for Markdown, (path, content) for packages.

    template: a package whose entries are kept. profile: text in the rule
    language, for Markdown to packages: blocks are classified, styled and
    presented. strict fails documents with error diagnostics, and with a profile
    those whose profile has conditions that are not evaluated. Requests that
    are wrong for all documents raise ValueError, a bad profile ProfileError.
    """
    if policy not in POLICIES or source not in FORMATS or target not in FORMATS:
        raise ValueError("unknown format or policy")
    if (template is not None or profile is not None) and target != "odt":
        raise ValueError("a template needs the target odt")
    if template is not None and odt.package_error(template):
        raise ValueError("the template is no package")
    parsed = rules.parse(profile) if profile is not None else None
    if parsed is not None and source != "md":
        raise ValueError("a profile needs the source md")
    strict = policy == "strict"

    def styled(text: str) -> tuple:
        notes: list[tuple] = []
        open_ = rules.unsupported(parsed)
        if open_:
            if strict:
                return "unsupported", None, [("error", "unsupported_construct", "transform", f"{open_} conditions on text")]
            notes.append(("warning", "unsupported_construct", "transform", f"{open_} conditions on text ignored"))
        got, xs = markdown.parse(text)
        notes += [(s, c, "normalize_in", m) for s, c, m in xs]
        stream = [(b, (rules.STREAM[b["kind"]], b.get("level"), None)) for b in got if b["kind"] in rules.STREAM]
        for (b, _), role in zip(stream, rules.classify(parsed, [x for _, x in stream]), strict=True):
            if role in parsed.layout:
                b["style"] = parsed.layout[role]
        if e := model.document_error(got):
            return "invalid", None, [*notes, ("error", e[0], "validate", e[1])]
        try:
            xml, xs = odt.content_xml(got)
            out = odt.restyled(odt.package(xml), lambda s: rules.materialized(s, parsed.present))
        except odt.PackageError as x:
            return "runtime", None, [*notes, ("error", "invalid", "emit", str(x))]
        return "ok", out, [*notes, *((s, c, "emit", m) for s, c, m in xs), ("info", "profile", "transform", parsed.name)]

    def rows(key: str, payload: str | bytes | None) -> Iterator[tuple]:
        if payload is None:
            yield (key, "input", CODES["input"], None, None, [])
            return
        if parsed is not None:
            status, out, notes = styled(payload)
        else:
            status, _, out, notes = blocks.convert_one(source, target, payload, strict, template)
        text, content = (out, None) if target == "md" else (None, out)
        yield (key, status, CODES[status], text, content, [dict(zip(("severity", "code", "stage", "message"), n, strict=True)) for n in notes])

    cols = df.select(F.col("doc_id").cast("string"), "text") if source == "md" else df.select("path", "content")
    return flat_map(cols, rows, RESULT)
