"""Formats by name: how each is read into the document model and written from it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from . import markdown, odt

#: Formats that a registry holds at most.
MOST = 16
Notes = list[tuple[str, str, str]]


@dataclass(frozen=True)
class Handler:
    """read(payload) and write(blocks, template) return (blocks | payload, notes); both raise odt.PackageError."""

    name: str
    read: Callable[[str | bytes], tuple[list[dict], Notes]]
    write: Callable[[list[dict], bytes | None], tuple[str | bytes, Notes]]


@dataclass
class Registry:
    handlers: dict[str, Handler] = field(default_factory=dict)

    def register(self, h: Handler) -> None:
        if not h.name or h.name in self.handlers:
            raise ValueError(f"format {h.name!r} is registered or has no name")
        if len(self.handlers) >= MOST:
            raise ValueError("too many formats")
        self.handlers[h.name] = h

    def find(self, name: str) -> Handler | None:
        return self.handlers.get(name)


def _read_markdown(payload: str | bytes) -> tuple[list[dict], Notes]:
    return markdown.parse(payload if isinstance(payload, str) else payload.decode("utf-8", "replace"))


def _write_package(blocks: list[dict], template: bytes | None) -> tuple[bytes, Notes]:
    xml, notes = odt.content_xml(blocks)
    out = odt.package(xml, template=template)
    if why := odt.package_error(out):
        raise odt.PackageError(why)
    return out, notes


def default() -> Registry:
    """Markdown and OpenDocument Text."""
    r = Registry()
    r.register(Handler("md", _read_markdown, lambda blocks, _: markdown.export(blocks)))
    r.register(Handler("odt", lambda payload: odt.import_content(odt.content_of(payload)), _write_package))
    return r
