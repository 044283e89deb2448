"""The text plane: lines of documents, and what can be said of them without a grammar.

What needs the lines of a document in order is folded inside its row, so a
corpus is never shuffled for it. Only operators that return lines explode them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import heuristics as H

LF = "\n"


def split_lines(text: Column) -> Column:
    """The lines of a text; a last line feed begins no line."""
    all_ = F.split(text, LF, -1)
    return F.when(F.endswith(text, F.lit(LF)), F.slice(all_, 1, F.size(all_) - 1)).otherwise(all_)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, raw, line, indent): raw lines and lines without their indent."""
    raw = docs.where("text IS NOT NULL AND text <> ''").select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("line_no", "raw"))
    line = F.regexp_replace("raw", r"^[ \t]+", "")
    return raw.select("doc_id", "line_no", "raw", line.alias("line"), (F.length("raw") - F.length(line)).alias("indent"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, class, bytes) of every line."""
    return lines(docs).select("doc_id", "line_no", H.line_class(F.col("line")).alias("class"), F.octet_length("raw").alias("bytes"))


#: Counters of lines, each with its test.
COUNTED = {
    "headings": lambda x: F.startswith(x, F.lit("#")),
    "lists": lambda x: F.startswith(x, F.lit("- ")) | F.startswith(x, F.lit("1. ")),
    "tables": lambda x: F.startswith(x, F.lit("```table")) | F.startswith(x, F.lit("| ")),
    "table_sep_lines": lambda x: F.startswith(x, F.lit("| --- |")),
    "code_fence_lines": H.fence,
    "footnote_defs": lambda x: x.rlike(r"^\[\^[0-9]+\]: "),
    "toc_refheading_links": H.toc_link,
    "stage_labels": H.stage_label,
    "note_quote_lines": lambda x: F.startswith(x, F.lit("> Note:")),
}


def _fold(xs: Column) -> Column:
    """COUNTED, the longest plain line and the fence lines of an array of lines, in one pass."""
    one = lambda c: F.when(c, 1).otherwise(0)

    def step(a: Column, x: Column) -> Column:
        own = [(a[n] + one(f(x))).alias(n) for n, f in COUNTED.items()]
        plain = (a["fenced"] % 2 == 0) & ~H.structured(x) & ~H.has_url(x)
        longest = F.when(plain, F.greatest(a["max_non_url_line"], F.octet_length(x))).otherwise(a["max_non_url_line"])
        return F.struct(*own, longest.alias("max_non_url_line"), (a["fenced"] + one(H.fence(x))).alias("fenced"))

    return F.aggregate(xs, F.struct(*(F.lit(0).alias(n) for n in [*COUNTED, "max_non_url_line", "fenced"])), step)


def _neighbours(xs: Column) -> dict[str, Column]:
    """Captions right between two table rows, separators right behind separators."""
    row = lambda x: F.startswith(F.coalesce(x, F.lit("")), F.lit("| "))
    sep = lambda x: F.startswith(F.coalesce(x, F.lit("")), F.lit("| --- |"))
    count = lambda f: F.size(F.filter(F.transform(xs, f), lambda v: v)).cast("bigint")
    return {
        "caption_interleaves": count(lambda x, i: H.caption(x) & row(F.get(xs, i - 1)) & row(F.get(xs, i + 1))),
        "consecutive_separators": count(lambda x, i: sep(x) & sep(F.get(xs, i - 1))),
    }


def measured(df: DataFrame, keys: list[str], only: tuple[str, ...] = (), **texts: Column) -> DataFrame:
    """The keys, and for each named text (null: empty) a struct of its structure counters (or of some, counted one by one), all in the row."""
    t = {n: F.coalesce(c, F.lit("")) for n, c in texts.items()}
    split = df.select(*keys, *(F.struct(c.alias("t"), F.split(c, LF, -1).alias("xs")).alias(n) for n, c in t.items()))
    few = lambda xs: F.struct(*(F.size(F.filter(xs, f)).alias(k) for k, f in COUNTED.items() if k in only), F.lit(0).alias("none"))
    folded = split.select(*keys, *(F.struct(f"{n}.t", f"{n}.xs", (few if only else _fold)(F.col(f"{n}.xs")).alias("m")).alias(n) for n in t))
    big = lambda c: c.cast("bigint")

    def counters(n: str) -> Column:
        s = F.col(f"{n}.t")
        found = lambda p: big(F.regexp_count(s, F.lit(p)))
        all_ = {
            "bytes": big(F.octet_length(s)),
            **{k: big(F.col(f"{n}.m.{k}")) for k in [*COUNTED, "max_non_url_line"]},
            "links": found(r"\]\("),
            "notes": found(r"\[note:"),
            "placeholders": found(r"\[odt:unsupported "),
            "footnote_refs": found(r"\[\^[0-9]+\]") - found(r"\[\^[0-9]+\]:"),
            "raw_xml_like_tokens": big(H.raw_tags(s)),
            **_neighbours(F.col(f"{n}.xs")),
        }
        return F.struct(*(c.alias(k) for k, c in all_.items() if not only or k in only))

    return folded.select(*keys, *(counters(n).alias(n) for n in t))


def metrics(docs: DataFrame) -> DataFrame:
    """One row per document: the 18 structure counters, from one fold over its lines and a few counts over its text."""
    return measured(docs, ["doc_id"], m=F.col("text")).select("doc_id", "m.*").drop("caption_interleaves", "consecutive_separators")


def table_neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, caption_interleaves, consecutive_separators): captions between two table rows, separators behind separators."""
    return docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), LF, -1).alias("xs")).select("doc_id", *(c.alias(n) for n, c in _neighbours(F.col("xs")).items()))


def fenced(docs: DataFrame) -> DataFrame:
    """lines() with in_fence and fence_no: how many fence lines stand before a line, this one included."""
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.sum(F.when(H.fence(F.col("line")), 1).otherwise(0)).over(w)
    return lines(docs).withColumn("fence_no", n).withColumn("in_fence", (F.col("fence_no") % 2 == 1) & ~H.fence(F.col("line")))


def fence_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, fence, language, body): code fences, an unclosed one up to the end."""
    x = fenced(docs)
    f = F.ceil(F.col("fence_no") / 2).cast("bigint")
    own = x.where("in_fence OR (fence_no % 2 = 1)").withColumn("fence", f)
    body = F.array_sort(F.collect_list(F.when(F.col("in_fence"), F.struct("line_no", "raw"))))
    return own.groupBy("doc_id", "fence").agg(
        F.max(F.when(~F.col("in_fence"), F.trim(F.substring("line", 4, 1 << 30)))).alias("language"),
        F.array_join(F.transform(body, lambda s: F.concat(s["raw"], F.lit(LF))), "").alias("body"),
    )


def list_runs(docs: DataFrame, most: int = 128) -> DataFrame:
    """(doc_id, run, ordered, items, nested): runs of neighbouring list lines of one kind, at most so many items each."""
    kind = F.when(F.col("line").rlike("^[-*] "), "bullet").when(F.col("line").rlike(r"^[0-9]+\. "), "ordered")
    # outside fences, where grammar applies
    x = fenced(docs).where("NOT in_fence").withColumn("kind", kind)
    order = W.partitionBy("doc_id").orderBy("line_no")
    new = ~F.col("kind").eqNullSafe(F.lag("kind").over(order)) | (F.col("line_no") - 1 != F.lag("line_no").over(order))
    x = x.withColumn("island", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).where("kind IS NOT NULL")
    own = W.partitionBy("doc_id", "island").orderBy("line_no")
    x = x.withColumn("part", F.floor((F.row_number().over(own) - 1) / most).cast("bigint"))
    first = F.min_by("indent", "line_no")
    got = x.groupBy("doc_id", "island", "part", "kind").agg(F.min("line_no").cast("bigint").alias("first_line"), F.count("*").alias("items"), first.alias("base"), F.collect_list("indent").alias("indents"))
    return got.select("doc_id", "first_line", (F.col("kind") == "ordered").alias("ordered"), "items", F.size(F.filter("indents", lambda i: i > F.col("base"))).cast("bigint").alias("nested"))


def _rows(x: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of arrays of kept lines. An outer explode, since for another one Spark filters on the array's size before, which works it out twice."""
    return x.select("doc_id", F.explode_outer("kept").alias("e")).where("e IS NOT NULL").select("doc_id", "e.line_no", "e.line")


def _toc_capped(docs: DataFrame, most: int, *more: str) -> DataFrame:
    """(doc_id, more, kept): the lines that toc_capped() keeps, as an array in the row; a link goes if the `most` lines before it are links too."""
    each = F.transform(split_lines(F.col("text")), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), H.toc_link(x).alias("toc")))
    x = docs.select("doc_id", *more, F.filter(each, lambda e: e["line"] != "").alias("xs"))
    run = lambda i: ~F.exists(F.slice("xs", F.greatest(i - most + 1, F.lit(1)), most), lambda e: ~e["toc"])
    return x.select("doc_id", *more, F.filter("xs", lambda e, i: ~(e["toc"] & (i >= most) & run(i))).alias("kept"))


def toc_capped(docs: DataFrame, most: int = 24) -> DataFrame:
    """(doc_id, line_no, line): non-blank lines without those of a run of contents links beyond so many."""
    return _rows(_toc_capped(docs, most))


def toc_versions(docs: DataFrame, most: int = 24) -> DataFrame:
    """(doc_id, before, after): each text with a non-blank line, and the lines that toc_capped() keeps of it."""
    own = docs.where(F.col("text").rlike("[^\n]"))
    return _toc_capped(own, most, "text").select("doc_id", F.col("text").alias("before"), F.array_join(F.transform("kept", lambda e: e["line"]), LF).alias("after"))


def stages_once(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): stage labels once a document, stage links not right behind an equal one among them."""
    each = F.transform("ls", lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    first = [F.array_position("ls", F.lit(x)).alias(f"p{k}") for k, x in enumerate(H.STAGES)]
    x = docs.select("doc_id", split_lines(F.col("text")).alias("ls")).select("doc_id", F.filter(each, lambda e: e["line"] != "").alias("xs"), *first)
    x = x.select("doc_id", "xs", *(f"p{k}" for k in range(len(H.STAGES))), F.filter("xs", lambda e: H.stage_link(e["line"])).alias("links"))
    again = lambda e: reduce(lambda a, b: a | b, ((e["line"] == s) & (e["line_no"] + 1 > F.col(f"p{k}")) for k, s in enumerate(H.STAGES)))
    others = F.filter("xs", lambda e: ~H.stage_link(e["line"]) & ~again(e))
    apart = F.filter("links", lambda e, i: (i == 0) | (e["line"] != F.get("links", i - 1)["line"]))
    return _rows(x.select("doc_id", F.concat(others, apart).alias("kept")))


def captions_apart(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a blank line before each caption that stands between two table rows; all in the row."""
    xs = F.split(F.coalesce("text", F.lit("")), LF, -1)
    row = lambda x: F.startswith(F.coalesce(x, F.lit("")), F.lit("| "))
    put = lambda x, i: F.when(H.caption(x) & row(F.get("xs", i - 1)) & row(F.get("xs", i + 1)), F.concat(F.lit(LF), x)).otherwise(x)
    return docs.select("doc_id", xs.alias("xs")).select("doc_id", F.array_join(F.transform("xs", put), LF).alias("text"))


def grammar_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, first_line, n, body): runs of neighbouring plain lines that hold ::=."""
    x = fenced(docs).where("NOT in_fence AND line <> ''").withColumn("g", F.contains("line", F.lit("::=")) & (H.line_class(F.col("line")) == "paragraph"))
    order = W.partitionBy("doc_id").orderBy("line_no")
    x = x.withColumn("rest", F.sum(F.when(F.col("g"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).where("g")
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return x.groupBy("doc_id", "rest").agg(F.min("line_no").cast("bigint").alias("first_line"), F.count("*").alias("n"), F.array_join(F.transform(rows, lambda s: s["line"]), LF).alias("body")).drop("rest")


def footnotes(docs: DataFrame) -> DataFrame:
    """(doc_id, k, note): the notes of each document, numbered in order."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\[note: ([^\]]+)\]"), F.lit(1))
    return docs.select("doc_id", F.posexplode(found).alias("k", "note")).select("doc_id", (F.col("k") + 1).cast("bigint").alias("k"), "note")


def inline_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, images, links, strong, code_spans, styled): constructs by pattern, where they don't overlap."""
    t = F.coalesce("text", F.lit(""))
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("bigint")
    images = n(r"!\[[^\]\n]*\]\([^)\n]*\)")
    return docs.select("doc_id", images.alias("images"), (n(r"\[[^\]\n]*\]\([^)\n]*\)") - images).alias("links"), n(r"\*\*[^*\n]+\*\*").alias("strong"), n(r"`[^`\n]+`").alias("code_spans"), n(r"\{\.[^|}\n]*\|[^}\n]+\}").alias("styled"))


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, title, rendered) outside fences."""
    m = r"^(#{1,6}) (.*)$"
    x = fenced(docs).where("NOT in_fence").where(F.col("line").rlike(m))
    level = F.length(F.regexp_extract("line", m, 1))
    title = F.regexp_extract("line", m, 2)
    return x.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), level.cast("bigint").alias("level"), title.alias("title"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), H.escape(title)).alias("rendered"))


def table_cells(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, is_header, cells) of the rows of pipe tables that a delimiter line announces."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    x = fenced(docs).where("NOT in_fence").withColumn("pipe", F.startswith("line", F.lit("|"))).withColumn("sep", H.delimiter(F.col("line")))
    x = x.withColumn("head", F.col("pipe") & ~F.col("sep") & F.coalesce(F.lead("sep").over(order), F.lit(False)))
    x = x.withColumn("table", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    x = x.withColumn("gap", F.sum(F.when(F.col("pipe"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    head_gap = F.max(F.when(F.col("head"), F.col("gap"))).over(W.partitionBy("doc_id", "table"))
    x = x.withColumn("head_gap", head_gap).where("pipe AND NOT sep AND table > 0 AND gap = head_gap")
    inner = F.regexp_replace(F.regexp_replace("line", r"[ \t]+$", ""), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"\|", -1), lambda c: F.regexp_replace(c, r"^[ \t]+|[ \t]+$", ""))
    return x.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("head").alias("is_header"), F.array_join(cells, "\x1f").alias("cells"), F.size(cells).cast("bigint").alias("n_cells"))


def directives(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, name, argument, closed): directive lines outside fences, and whether a ::: follows."""
    x = fenced(docs).where("NOT in_fence")
    m = r"^:::[ \t]*([^ \t]+)[ \t]*(.*)$"
    order = W.partitionBy("doc_id").orderBy("line_no")
    rest = order.rowsBetween(1, W.unboundedFollowing)
    x = x.withColumn("later", F.coalesce(F.max(F.startswith("line", F.lit(":::"))).over(rest), F.lit(False))).where(F.col("line").rlike(m))
    return x.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.regexp_extract("line", m, 1).alias("name"), F.regexp_extract("line", m, 2).alias("argument"), F.col("later").alias("closed"))


def style_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, style): lines that name the style of the line before, with that line's class."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    x = fenced(docs).where("NOT in_fence").withColumn("target", F.lag(H.line_class(F.col("line"))).over(order))
    m = r"^[ \t]*\{\.([^}]+)\}[ \t]*$"
    return x.where(F.col("line").rlike(m)).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.regexp_extract("line", m, 1).alias("style"), "target")
