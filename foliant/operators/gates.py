"""Quality gates over structure counters: of a conversion's result, and of what a round trip leaves of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lines


@dataclass(frozen=True)
class Limits:
    """Fixed limits, and minima and caps that depend on the corpus."""

    placeholders: int = 8
    line: int = 240
    raw_tokens: int = 16
    separator_slack: int = 4
    stage_labels: int = 3
    headings: int = 0
    fence_lines: int = 0
    footnotes: int = 0
    toc_links: int = 24
    note_quotes: int = 0
    heading_drift: int = 8
    table_drift: int = 8
    link_drift: int = 32


#: What drifts between two versions of a document.
DRIFTING = ("headings", "tables", "links", "bytes")


def _shape(m: str, k: Limits) -> dict[str, Column]:
    """Gates that hold for any version of a document."""
    c = lambda n: F.col(f"{m}.{n}")
    return {
        "bytes": c("bytes") > 0,
        "line": c("max_non_url_line") <= k.line,
        "raw_tokens": c("raw_xml_like_tokens") <= k.raw_tokens,
        "separators": c("table_sep_lines") <= c("tables") + k.separator_slack,
        "fence_lines": c("code_fence_lines") >= k.fence_lines,
        "fences_balanced": c("code_fence_lines") % 2 == 0,
        "notes": c("notes") == 0,
        "footnote_defs": c("footnote_defs") >= k.footnotes,
        "footnote_refs": c("footnote_refs") >= c("footnote_defs"),
        "toc_links": c("toc_refheading_links") <= k.toc_links,
        "stage_labels": c("stage_labels") <= k.stage_labels,
        "note_quotes": c("note_quote_lines") >= k.note_quotes,
        "captions": c("caption_interleaves") == 0,
        "separator_runs": c("consecutive_separators") == 0,
    }


def _rows(df: DataFrame, keys: list[str], gates: dict[str, Column]) -> DataFrame:
    return df.select(*keys, *(g.alias(f"ok_{n}") for n, g in gates.items())).withColumn("ok", F.expr(" AND ".join(f"ok_{n}" for n in gates)))


def _first(m: str, k: Limits) -> dict[str, Column]:
    return _shape(m, k) | {"headings": F.col(f"{m}.headings") >= k.headings, "placeholders": F.col(f"{m}.placeholders") <= k.placeholders}


def source(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, ok_..., ok): the gates of a conversion's result (doc_id, text); a null text is empty."""
    return _rows(lines.measured(docs, ["doc_id"], m=F.col("text")), ["doc_id"], _first("m", limits))


def drift(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, drift_..., ok_bytes) of pairs (key, before, after): absolute differences, and whether after has at most 3/2 of the bytes."""
    m = lines.measured(pairs, [key], DRIFTING, before=F.col("before"), after=F.col("after"))
    apart = [F.abs(F.col(f"before.{n}") - F.col(f"after.{n}")).alias(f"drift_{n}") for n in DRIFTING]
    return m.select(key, *apart, (F.col("after.bytes") * 2 <= F.col("before.bytes") * 3).alias("ok_bytes"))


def round_trip(pairs: DataFrame, limits: Limits = Limits(), key: str = "path") -> DataFrame:
    """(key, ok_source, ok_..., ok) of pairs (key, before, after): all gates of the first text as one, those of the second, and the drift."""
    m = lines.measured(pairs, [key], before=F.col("before"), after=F.col("after"))
    apart = lambda n: F.abs(F.col(f"before.{n}") - F.col(f"after.{n}"))
    first = F.lit(True)
    for g in _first("before", limits).values():
        first = first & g
    gates = {"source": first} | _shape("after", limits)
    gates |= {"heading_drift": apart("headings") <= limits.heading_drift, "table_drift": apart("tables") <= limits.table_drift, "link_drift": apart("links") <= limits.link_drift}
    gates["byte_drift"] = F.col("after.bytes") * 2 <= F.col("before.bytes") * 3
    return _rows(m, [key], gates)
