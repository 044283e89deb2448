"""Queries over documents, models and packages made for one rule each, faulty ones among them, with SQL that states the outcome."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import markdown, odt, rules
from ..operators import blocks, gates, packages
from ..operators.kernel import Made, flat_map, spread
from . import catalog, fixtures
from .catalog import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(s: str) -> str:
    """A string as SQL that both engines read, line feeds and all."""
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def by_case(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


# models

_P = '{"kind":"paragraph","inlines":[{"kind":"text","text":"a"}]}'


def _line(x: str) -> str:
    return '{"kind":"paragraph","inlines":[' + x + "]}"


_DEEP = 66
#: (blocks, styles, assets, metadata, code, field, index): index None counts the sound blocks before.
MODELS: list[tuple] = [
    ('{"kind":"heading","level":0,"inlines":[]}', "[]", "[]", "{}", "invalid_value", "block.heading.level", None),
    ('{"kind":"heading","level":7,"inlines":[]}', "[]", "[]", "{}", "invalid_value", "block.heading.level", None),
    ('{"kind":"list_item","blocks":[]}', "[]", "[]", "{}", "invalid_value", "block.list_item.blocks", None),
    ('{"kind":"admonition","admonition":"other","blocks":[]}', "[]", "[]", "{}", "missing_field", "block.admonition.kind", None),
    ('{"kind":"figure","asset":"","caption":[]}', "[]", "[]", "{}", "missing_field", "block.figure.asset_id", None),
    ('{"kind":"table","rows":[]}', "[]", "[]", "{}", "invalid_value", "block.table.rows", None),
    ('{"kind":"table","rows":[[{"blocks":[]}],[]]}', "[]", "[]", "{}", "invalid_value", "block.table.row.cells", 1),
    ('{"kind":"video"}', "[]", "[]", "{}", "invalid_enum", "block.kind", None),
    (_line('{"kind":"text","text":"b"},{"kind":"link","href":"","children":[]}'), "[]", "[]", "{}", "missing_field", "inline.link.href", 1),
    (_line('{"kind":"image","asset":"","alt":"x"}'), "[]", "[]", "{}", "missing_field", "inline.image.asset_id", 0),
    (_line('{"kind":"code_span","text":""}'), "[]", "[]", "{}", "missing_field", "inline.code_span.text", 0),
    (_line('{"kind":"blink"}'), "[]", "[]", "{}", "invalid_enum", "inline.kind", 0),
    ('{"kind":"quote","blocks":[' + _P + ',{"kind":"heading","level":9,"inlines":[]}]}', "[]", "[]", "{}", "invalid_value", "block.heading.level", 1),
    (_P, '[{"id":""}]', "[]", "{}", "missing_field", "style.id", 0),
    (_P, '[{"id":"a","target":"block"},{"id":"b","target":"moon"}]', "[]", "{}", "invalid_enum", "style.target", 1),
    (_P, "[]", '[{"id":"a","mime":"m","kind":"external"}]', "{}", "missing_field", "asset.uri", 0),
    (_P, "[]", '[{"id":"a","mime":"m","kind":"embedded"},{"id":"b","mime":"m","kind":"x"}]', "{}", "invalid_enum", "asset.kind", 1),
    (_P, "[]", '[{"id":"a"}]', "{}", "missing_field", "asset.mime", 0),
    (_P, "[]", '[{"mime":"m"}]', "{}", "missing_field", "asset.id", 0),
    (_P, "[]", "[]", '{"title":null,"title_length":3}', "invalid_value", "metadata.title", 1),
    (_P, '[{"id":"a","target":"inline"}]', '[{"id":"a","mime":"m","kind":"external","uri":"u"}]', '{"language":"en"}', None, None, None),
    (_line('{"kind":"emphasis","children":[' * _DEEP + '{"kind":"text","text":"x"}' + "]}" * _DEEP), "[]", "[]", "{}", "limit", "inline.depth", 0),
    ('{"kind":"quote","blocks":[' * _DEEP + _P + "]}" * _DEEP, "[]", "[]", "{}", "limit", "block.depth", 0),
    ('{"kind":"video"}', '[{"id":""}]', "[]", '{"author":null,"author_length":1}', "invalid_value", "metadata.author", 2),
    ('{"kind":"video"}', '[{"id":""}]', '[{"mime":"m"}]', "{}", "invalid_enum", "block.kind", None),
]


def _expected(k: int) -> str:
    return by_case(f"o_orderkey % {len(MODELS)}", ["NULL" if m[k] is None else f"'{m[k]}'" for m in MODELS])


@query(f"""SELECT o_orderkey AS doc_id, {_expected(4)} AS err_code, {_expected(5)} AS err_field,
  CAST({by_case(f"o_orderkey % {len(MODELS)}", ["NULL" if m[4] is None else "o_orderkey % 3" if m[6] is None else str(m[6]) for m in MODELS])} AS INT) AS err_index FROM orders""")
def validate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error of a model with one fault of each sort, behind up to two sound blocks."""
    k = F.col("o_orderkey") % len(MODELS)
    pick = lambda i: F.coalesce(*(F.when(k == n, F.lit(m[i])) for n, m in enumerate(MODELS)))
    sound = F.repeat(F.lit(_P + ","), (F.col("o_orderkey") % 3).cast("int"))
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey"))
    return blocks.model_errors(o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("["), sound, pick(0), F.lit("]")).alias("blocks"), pick(1).alias("styles"), pick(2).alias("assets"), pick(3).alias("meta")))


# packages

_MANIFEST = '<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0">%s</manifest:manifest>'
_ROOT, _CONTENT = (f'<manifest:file-entry manifest:full-path="{n}" manifest:media-type="{t}"/>' for n, t in (("/", odt.MIMETYPE), ("content.xml", "text/xml")))
#: What is wrong with each package, as validation, the package rule over rows of entries and repacking say; the rule has no row of unreadable files.
PACKAGES = [
    ("sound", None, True, None), ("mimetype deflated", "mimetype", False, "mimetype"), ("mimetype of another kind", "mimetype", False, "mimetype"), ("mimetype not first", "mimetype", False, "mimetype"),
    ("no content.xml", "no content.xml", False, "no content.xml"), ("no manifest", "no manifest", False, "no manifest"), ("content.xml not listed", "manifest", True, "manifest"), ("root not listed", "manifest", True, "manifest"),
    ("manifest no XML", "bad XML", True, "bad XML"), ("cut short", "no end of central directory", None, "no end of central directory"), ("empty", "no end of central directory", None, "no end of central directory"),
    ("null", "no content", None, "no content"), ("local header at the end", "truncated entry", None, "truncated entry"), ("unsafe name", None, True, "unsafe name"),
]


def faulty(case: str) -> bytes | None:
    """A package with one fault."""
    body = "plain " * 40 if case == "mimetype deflated" else odt.MIMETYPE
    kind = odt.made("mimetype", ("application/zip" if case == "mimetype of another kind" else body).encode(), store=case != "mimetype deflated")
    content = odt.made("content.xml", b"<a/>")
    rows = {"content.xml not listed": _ROOT, "root not listed": _CONTENT, "manifest no XML": "<open>"}.get(case, _ROOT + _CONTENT)
    manifest = odt.made("META-INF/manifest.xml", (_MANIFEST % rows).encode())
    items = [kind, content, manifest]
    if case == "mimetype not first":
        items = [content, kind, manifest]
    if case == "no content.xml":
        items.remove(content)
    if case == "no manifest":
        items.remove(manifest)
    if case == "unsafe name":
        items.append(odt.made("../evil", b"x"))
    out = odt.archive(items)
    if case == "local header at the end":  # the directory points at a signature in the last bytes
        out += b"PK\x03\x04"
        at = out.index(b"PK\x01\x02") + 42
        out = out[:at] + (len(out) - 4).to_bytes(4, "little") + out[at + 4 :]
    return {"cut short": out[:-30], "empty": b"", "null": None}.get(case, out)


def faulty_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = len(PACKAGES)

    def rows(key: int) -> Iterator[tuple]:
        yield (str(key), faulty(PACKAGES[key % n][0]))

    return flat_map(spread(table(spark, sf_dir, "part").select("p_partkey")), rows, "path string, content binary")


def _said(k: int) -> str:
    return by_case(f"p_partkey % {len(PACKAGES)}", ["NULL" if p[k] is None else f"'{p[k]}'" if isinstance(p[k], str) else str(p[k]).lower() for p in PACKAGES])


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS path, error IS NULL AS ok, error FROM (SELECT p_partkey, {_said(1)} AS error FROM part)")
def validate_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.validate(faulty_packages(spark, sf_dir))


@query(f"SELECT * FROM (SELECT CAST(p_partkey AS VARCHAR) AS path, {_said(2)} AS ok FROM part) WHERE ok IS NOT NULL")
def package_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.package_rule(packages.entries(faulty_packages(spark, sf_dir), wanted=("mimetype",)))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS path, error IS NULL AS ok, error, error IS NULL AS same FROM (SELECT p_partkey, {_said(3)} AS error FROM part)")
def repack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repacking what may be; same: the entries of the result are those of the input, as they were stored."""
    src = faulty_packages(spark, sf_dir)
    made = api.repack(src)
    listing = lambda df: packages.entries(df).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("idx", "name", "method", "crc32", "payload"))).alias("all"))
    a, b = listing(src).withColumnRenamed("all", "before"), listing(made.where("ok").select("path", "content"))
    return made.join(a, "path", "left").join(b, "path", "left").select("path", "ok", "error", F.coalesce(F.col("before") == F.col("all"), F.lit(False)).alias("same"))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS path, {by_case(f'p_partkey % {len(PACKAGES)}', [str(p[1] not in ('no content.xml', 'no end of central directory', 'no content', 'truncated entry')).lower() for p in PACKAGES])} AS ok FROM part")
def extract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether text can be taken out: that asks for content.xml alone."""
    return api.extract_text(faulty_packages(spark, sf_dir)).select("path", "ok")


# conversion

CONVERT = ["NULL", text("sound **text**\n"), text("[x]()\n"), text(":::figure\nx\n:::\n"), text("![a]()"), text("")]
STATUSES = [("input", 2, None), ("ok", 0, None), ("invalid", 5, "missing_field"), ("invalid", 5, "missing_field"), ("invalid", 5, "missing_field"), ("ok", 0, "unsupported_construct")]


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, " + by_case("c_custkey % 6", [f"'{s}'" for s, _, _ in STATUSES]) + " AS status, CAST(" + by_case("c_custkey % 6", [str(c) for _, c, _ in STATUSES]) + " AS INT) AS code, " + by_case("c_custkey % 6", [f"'{n}'" if n else "NULL" for _, _, n in STATUSES]) + " AS last_note FROM customer")
def convert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of conversion: no input, sound, three faults of the model, and an empty document, which is a warning."""
    docs = spread(table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("doc_id"), F.expr(by_case("c_custkey % 6", CONVERT)).alias("text"))
    return api.convert(docs, "md", "odt").select("id", "status", "code", F.get(F.col("diagnostics.code"), F.size("diagnostics") - 1).alias("last_note"))


# inlines

INLINES = [
    "plain words", "a **b** c", "*d* and *e", "`f` and `` and `g", "[h](i)[j](k", "![l](m) !n ![o](", "{.p|q} {.r} {.|s}", "t{.u|v}", "** w *x**y", "***z**", "a]b)c}d|e", "**[f](g)** *`h`*", "![i](j)[k](l)`m`**n***o*", "é*ü*中`文`", "[a*b](c*d) *e`f*g`", "",
]


def _inline_lines() -> str:
    return f"SELECT o_orderkey AS doc_id, {by_case(f'o_orderkey % {len(INLINES)}', [text(x) for x in INLINES])} || CASE WHEN o_orderkey % 3 = 0 THEN ' ' || o_orderpriority ELSE '' END AS line FROM orders"


@query(f"""WITH RECURSIVE l AS ({_inline_lines()}),
t(doc_id, seq, rest, kind, body, target, style) AS (
  SELECT doc_id, CAST(-1 AS BIGINT), line, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM l
  UNION ALL
  SELECT doc_id, seq + 1, substr(rest, used + 1), kind, body, target, style FROM (
    SELECT doc_id, seq, rest,
      CASE WHEN m1 <> '' THEN 'text' WHEN m2 <> '' THEN 'image' WHEN m3 <> '' THEN 'link' WHEN m4 <> '' THEN 'strong' WHEN m5 <> '' THEN 'emphasis' WHEN m6 <> '' THEN 'code_span' ELSE 'text' END AS kind,
      CASE WHEN m1 <> '' THEN regexp_extract(rest, '^\\{{\\.([^|}}]*)\\|([^}}]+)\\}}', 2) WHEN m2 <> '' THEN regexp_extract(m2, '^!\\[([^\\]]*)', 1) WHEN m3 <> '' THEN regexp_extract(m3, '^\\[([^\\]]*)', 1)
        WHEN m4 <> '' THEN substr(m4, 3, length(m4) - 4) WHEN m5 <> '' THEN substr(m5, 2, length(m5) - 2) WHEN m6 <> '' THEN substr(m6, 2, length(m6) - 2) ELSE substr(rest, 1, run) END AS body,
      CASE WHEN m1 <> '' THEN NULL WHEN m2 <> '' THEN regexp_extract(m2, '\\]\\(([^)]*)\\)$', 1) WHEN m3 <> '' THEN regexp_extract(m3, '\\]\\(([^)]*)\\)$', 1) END AS target,
      CASE WHEN m1 <> '' THEN regexp_extract(m1, '^\\{{\\.([^|}}]*)', 1) END AS style,
      CASE WHEN m1 <> '' THEN length(m1) WHEN m2 <> '' THEN length(m2) WHEN m3 <> '' THEN length(m3) WHEN m4 <> '' THEN length(m4) WHEN m5 <> '' THEN length(m5) WHEN m6 <> '' THEN length(m6) ELSE run END AS used
    FROM (SELECT *, regexp_extract(rest, '^\\{{\\.[^|}}]*\\|[^}}]+\\}}') AS m1, regexp_extract(rest, '^!\\[[^\\]]*\\]\\([^)]*\\)') AS m2, regexp_extract(rest, '^\\[[^\\]]*\\]\\([^)]*\\)') AS m3,
      regexp_extract(rest, '^\\*\\*.*?\\*\\*') AS m4, regexp_extract(rest, '^\\*.*?\\*') AS m5, regexp_extract(rest, '^`[^`]+`') AS m6,
      greatest(1, least(coalesce(nullif(strpos(rest, '['), 0), 100000), coalesce(nullif(strpos(rest, '*'), 0), 100000), coalesce(nullif(strpos(rest, '`'), 0), 100000), coalesce(nullif(strpos(rest, '!['), 0), 100000), length(rest) + 1) - 1) AS run
      FROM t WHERE rest <> '')))
SELECT doc_id, seq, kind, body, target, style FROM t WHERE seq >= 0""")
def md_inlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level inlines of lines that hold every construct, closed and unclosed; the SQL scans them step by step."""
    src = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"))
    src.createOrReplaceTempView("foliant_orders")
    found = blocks.line_inlines(spark.sql(_inline_lines().replace("FROM orders", "FROM foliant_orders")))
    return found.select("doc_id", F.col("seq").cast("bigint").alias("seq"), "kind", "body", "target", "style")


@query("""WITH x AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS xs FROM pages),
l AS (SELECT page_id, i, xs[i] AS href FROM x, unnest(generate_series(1, len(xs))) AS g(i)),
n AS (SELECT *, CASE WHEN href IS NOT DISTINCT FROM lag(href) OVER (PARTITION BY page_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM l),
k AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY i) AS island FROM n)
SELECT page_id, CAST(island AS BIGINT) AS island, min(href) AS href, count(*) AS n FROM k GROUP BY page_id, island""")
def link_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring links to one place become one, over the links of each page."""

    def rows(page: int, hrefs: list[str] | None) -> Iterator[tuple]:
        xs = [{"kind": "link", "href": h, "title": None, "children": [markdown.text_inline(str(i))]} for i, h in enumerate(hrefs or [])]
        for i, x in enumerate(markdown.merged_links(xs), 1):
            yield (page, i, x["href"], len(x["children"]))

    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return flat_map(table(spark, sf_dir, "pages").select("page_id", found.alias("hrefs")), rows, "page_id bigint, island bigint, href string, n bigint")


# blocks and export

SAMPLE = """# @
{.My_Title}
plain **@** *b* `c` [d](e) ![f](g)
- one
* two
  - nested
1. first
3. second
> quoted @
```sql
SELECT 1;

# no heading
```
| a | b |
| --- | :-: |
| @ | <2> |
| 3 |
:::note hint
inside @

more
:::
:::figure pic.png
caption @
:::
:::other
####### seven
"""


@query("SELECT p_partkey AS doc_id, CAST(ord AS INT) AS ord, kind, CAST(level AS INT) AS level, ordered, style_id, code_language, replace(code_text, '@', p_name) AS code_text, admonition_kind, asset_id, CAST(src_line AS INT) AS src_line, replace(text, '@', p_name) AS text FROM part, (VALUES"
       " (0, 'heading', 1, NULL, 'My_Title', NULL, NULL, NULL, NULL, 0, '@'), (1, 'paragraph', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 2, 'plain @ b c d f'),"
       " (2, 'list', NULL, false, NULL, NULL, NULL, NULL, NULL, 3, NULL), (3, 'list', NULL, true, NULL, NULL, NULL, NULL, NULL, 6, NULL), (4, 'quote', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 8, NULL),"
       " (5, 'code', NULL, NULL, NULL, 'sql', 'SELECT 1;' || chr(10) || chr(10) || '# no heading' || chr(10), NULL, NULL, 9, NULL), (6, 'table', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 14, NULL),"
       " (7, 'paragraph', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 17, '| 3 |'), (8, 'admonition', NULL, NULL, 'admonition-note', NULL, NULL, 'note', NULL, 18, NULL),"
       " (9, 'figure', NULL, NULL, 'figure', NULL, NULL, NULL, 'pic.png', 23, 'caption @'), (10, 'paragraph', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 26, ':::other'), (11, 'paragraph', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 27, '####### seven'))"
       " v(ord, kind, level, ordered, style_id, code_language, code_text, admonition_kind, asset_id, src_line, text)")  # fmt: skip
def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level blocks of a document that holds every construct."""
    return blocks.blocks(sample(spark, sf_dir), top=True).select("doc_id", "ord", "kind", "level", "ordered", "style_id", "code_language", "code_text", "admonition_kind", "asset_id", "src_line", "text")


def sample(spark: SparkSession, sf_dir: str, body: str = SAMPLE) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select(F.col("p_partkey").alias("doc_id"), F.replace(F.lit(body), F.lit("@"), F.col("p_name")).alias("text"))


@query("SELECT p_partkey AS doc_id, CAST(r AS INT) AS row_idx, CAST(c AS INT) AS col_idx, r = 0 AS is_header, replace(text, '@', p_name) AS text FROM part, (VALUES (0, 0, 'a'), (0, 1, 'b'), (1, 0, '@'), (1, 1, '<2>')) v(r, c, text)")
def md_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.cells(sample(spark, sf_dir)).select("doc_id", "row_idx", "col_idx", "is_header", "text")


@query("SELECT p_partkey AS doc_id, CAST(i AS INT) AS stream_idx, kind, CAST(level AS INT) AS level, replace(text, '@', p_name) AS text FROM part, (VALUES (0, 'heading', 1, '@'), (1, 'paragraph', NULL, 'plain @ b c d f'), (2, 'list', NULL, NULL), (3, 'list', NULL, NULL), (4, 'blockquote', NULL, NULL), (5, 'codeblock', NULL, NULL), (6, 'table', NULL, NULL), (7, 'paragraph', NULL, '| 3 |'), (8, 'paragraph', NULL, ':::other'), (9, 'paragraph', NULL, '####### seven')) v(i, kind, level, text)")
def block_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.stream(sample(spark, sf_dir))


EXPORTED = """# @
{.My_Title}
plain **@** *b* `c` [d](e) ![f](g)
- one
- two
- nested
1. first
2. second
> quoted @
```sql
SELECT 1;
# no heading
```
| a | b |
| --- | --- |
| @ | \\<2\\> |
| 3 |
:::note
inside @
more
:::
:::figure pic.png
caption @
:::
:::other
####### seven
"""


@query(f"SELECT p_partkey AS doc_id, 'ok' AS status, replace({text(EXPORTED)}, '@', p_name) AS output FROM part")
def md_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same document, normalised: markers, numbers, delimiters, escapes; a cell's count that differs ends its table."""
    return blocks.to_markdown(sample(spark, sf_dir)).select("doc_id", "status", "output")


REWRITES = """rule ::= @
other ::= b
{.Text_20_body}
See [note: one @] and [note: two].
| a | b |
| --- | --- |
| 1 | 2 |
Table 1 - @
| c | d |
| --- | --- |
| 3 | 4 |
This stage:
This stage:
"""
REWRITTEN = """```bnf
rule ::= @
other ::= b
```
See [^1] and [^2].
| a | b |
| --- | --- |
| 1 | 2 |

Table 1 - @
| c | d |
| --- | --- |
| 3 | 4 |
This stage:
[^1]: one @
[^2]: two
"""


@query(f"SELECT p_partkey AS doc_id, replace({text(REWRITTEN)}, '@', p_name) AS output FROM part")
def md_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export with every rewrite: grammar runs, notes, captions, labels."""
    return blocks.to_markdown(sample(spark, sf_dir, REWRITES)).select("doc_id", "output")


@query("""SELECT n_nationkey, '| nation | region |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_name || ' | ' || r_name || ' |' || chr(10) AS md FROM nation JOIN region ON n_regionkey = r_regionkey""")
def md_table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of two rows, by the exporter."""

    def rows(key: int, *names: str) -> Iterator[tuple]:
        cell = lambda s, head: {"header": head, "blocks": [markdown.block("paragraph", 0, inlines=[markdown.text_inline(s)])]}
        delimiter = [cell("---", False)] * 2  # a row that looks like a delimiter isn't written
        yield (key, markdown.export_block(markdown.block("table", 0, rows=[[cell("nation", True), cell("region", True)], delimiter, [cell(x, False) for x in names]]), []))

    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return flat_map(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"), rows, "n_nationkey int, md string")


@query("""SELECT p_partkey AS doc_id, repeat('word ', 47) || 'word' || chr(10) || repeat('word ', 11) || p_brand || chr(10) || 'see http://x/ ' || repeat('word ', 60) || chr(10) || '```' || chr(10) || repeat('code ', 60) || chr(10) || '```' || chr(10) || repeat('x', 300) || chr(10) || '- ' || repeat('item ', 60) AS text FROM part""")
def md_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long plain lines break at a blank; those with a URL, in a fence, of a list or without blanks stay."""
    made = "repeat('word ', 59) || p_brand || chr(10) || 'see http://x/ ' || repeat('word ', 60) || chr(10) || '```' || chr(10) || repeat('code ', 60) || chr(10) || '```' || chr(10) || repeat('x', 300) || chr(10) || '- ' || repeat('item ', 60)"
    return blocks.wrapped(spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand")).select(F.col("p_partkey").alias("doc_id"), F.expr(made).alias("text")))


# packages: styles, letters, import and export

@query("""SELECT p_partkey, '<style:style style:name="' || replace(p_brand, '&', '&amp;') || '" style:family="paragraph" style:parent-style-name="Standard"><style:paragraph-properties fo:margin-top="' || CAST(p_size AS VARCHAR) || 'mm" fo:text-indent="1mm"/><style:text-properties fo:font-weight="bold"/></style:style>' AS xml FROM part""")
def style_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(key: int, brand: str, size: int) -> Iterator[tuple]:
        yield (key, rules.style_xml(brand, {"font-weight": "bold", "text-indent": "1mm", "margin-top": f"{size}mm", "based-on": "Standard"}))

    return flat_map(spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")), rows, "p_partkey bigint, xml string")


LETTERS = ["Dear @\n3 March 2026\nbody\n", "Ada\n3 March 2026\nDear @\n", "# @\nx\nDear @\n## end\n5 May 2025\n", "## @\nDear @\n", "a\n## An INTRODUCTION to @\nb\n", "**Dear** @\n### introduction\n## *Intro*duction\n"]


@query("SELECT p_partkey AS doc_id, " + ", ".join(f"CAST({by_case('p_partkey % 6', v)} AS INT) AS {n}" for n, v in (("salutation", ["0", "2", "2", "2", "3", "3"]), ("date_line", ["1", "1", "5", "2", "3", "3"]), ("columns_from", ["3", "3", "5", "2", "1", "2"]))) + " FROM part")
def letter_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the salutation, the date and the heading where two columns begin; the number of blocks where there is none."""

    def rows(key: int, body: str) -> Iterator[tuple]:
        got = markdown.parse(body)[0]
        yield (key, *odt.letter(got), odt.two_columns_from(got))

    made = F.replace(F.expr(by_case("p_partkey % 6", [text(x) for x in LETTERS])), F.lit("@"), F.col("p_name"))
    return flat_map(spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", made.alias("text")), rows, "doc_id bigint, salutation int, date_line int, columns_from int")


OFFICE = (
    '<text:section text:name="S @"><text:h text:outline-level="3">Head @</text:h><text:h text:outline-level="9">deep</text:h></text:section>'
    '<text:table-of-content><text:table-of-content-source><text:p>gone</text:p></text:table-of-content-source><text:index-body><text:index-title><text:p>Contents</text:p></text:index-title><text:p>entry</text:p></text:index-body></text:table-of-content>'
    '<text:sequence-decls><text:p>gone</text:p></text:sequence-decls><text:soft-thing>gone</text:soft-thing>'
    '<text:p text:style-name="PCode">a<text:line-break/>b<text:s text:c="2"/>c</text:p><text:p text:style-name="PQuote">said @</text:p><text:p>Note: look</text:p><text:p text:style-name="Heading_20_4">styled</text:p>'
    '<text:p>x<text:span text:style-name="Emphasis">e</text:span><text:span text:style-name="TStrong">s</text:span><text:span text:style-name="TCode">k</text:span><text:span text:style-name="other">o</text:span><text:a xlink:href="u">l</text:a><text:a>m</text:a><text:note>1n</text:note>'
    '<text:bookmark text:name="b"/><text:bookmark text:name="__RefHeading1"/><draw:frame><draw:image xlink:href="i.png"/></draw:frame><draw:frame/><text:ruby>gone</text:ruby> @</text:p>'
    '<text:list text:style-name="LOrdered"><text:list-item><text:p>one @</text:p><text:list><text:list-item><text:p>in</text:p></text:list-item></text:list></text:list-item><text:list-item/></text:list><text:list><text:list-item><text:h>two</text:h></text:list-item></text:list>'
    '<table:table><table:table-row><table:table-cell><text:p>c1</text:p></table:table-cell><table:covered-table-cell/></table:table-row><table:table-row><table:table-cell><text:p>@</text:p></table:table-cell></table:table-row></table:table><table:table/>'
)
#: Path, kind, level and text of each block of it.
READ = [
    ("0", "heading", 2, "Section: S @"), ("1", "heading", 3, "Head @"), ("2", "heading", 1, "deep"), ("3", "heading", 2, "Table of Contents"), ("4", "paragraph", None, "Contents"), ("5", "paragraph", None, "entry"),
    ("6", "paragraph", None, "[odt:unsupported text:soft-thing]"), ("7", "code", None, None), ("8", "quote", None, None), ("8.0", "paragraph", None, "said @"), ("9", "quote", None, None), ("9.0", "paragraph", None, "Note: look"),
    ("10", "heading", 4, "styled"), ("11", "paragraph", None, "xeskolm[note: 1n]{#b}image[image] @"), ("12", "list", None, None), ("12.0", "list_item", None, None), ("12.0.0", "paragraph", None, "one @"), ("12.0.1", "paragraph", None, "in"),
    ("12.1", "list_item", None, None), ("12.1.0", "paragraph", None, ""), ("13", "list", None, None), ("13.0", "list_item", None, None), ("13.0.0", "paragraph", None, "two"), ("14", "table", None, None), ("14.0", "paragraph", None, "c1"),
    ("14.1", "paragraph", None, "@"), ("15", "paragraph", None, "[odt:unsupported table:table]"),
]


def office_packages(spark: SparkSession, sf_dir: str) -> Made:
    """A package of hand-made content for each part, as (path, content)."""
    spaces = "".join(f' xmlns:{k}="{v}"' for k, v in odt.NAMESPACES.items())
    xml = f'<office:document-content{spaces}><office:body><office:text>{OFFICE}</office:text></office:body></office:document-content>'

    def rows(key: int, name: str) -> Iterator[tuple]:
        yield (str(key), odt.package(xml.replace("@", rules.escaped(name)).encode()))

    return Made(spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")), rows, ("path", "content"))


_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else text(x) for x in r) + ")" for r in READ)


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS path, block, kind, CAST(level AS INT) AS level, replace(text, '@', p_name) AS text FROM part, (VALUES {_ROWS}) v(block, kind, level, text)")
def odt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import of every element that is read, replaced or skipped."""
    got = packages.imported_blocks(office_packages(spark, sf_dir))
    return got.select("path", F.array_join(F.col("block_path").cast("array<string>"), ".").alias("block"), "kind", "level", "text")


IMPORTED = """## Section: S @
### Head @
# deep
## Table of Contents
Contents
entry
[odt:unsupported text:soft-thing]
```
a
b  c
```
> said @
> Note: look
#### styled
x*e***s**`k`o[l](u)m`[note: 1n]`{#b}![image](i.png)[image] @
1. one @
  in
2. 
- two
| c1 | [complex] |
| --- | --- |
| @ |
[odt:unsupported table:table]
"""


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS path, 'ok' AS status, replace({text(IMPORTED.replace('`[note: 1n]`', '`[^1]`'))}, '@', p_name) || '[^1]: 1n' || chr(10) AS text FROM part")
def odt_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packages as Markdown."""
    return packages.imported(office_packages(spark, sf_dir))


#: What a nested list loses when it is read back: its second line's indent, and the empty item, which begins a list of its own.
AGAIN = IMPORTED.replace("  in\n2. \n", "in\n1. \n")


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS path, 'ok' AS status, replace({text(IMPORTED.replace('`[note: 1n]`', '`[^1]`'))}, '@', p_name) || '[^1]: 1n' || chr(10) AS before, replace({text(AGAIN.replace('`[note: 1n]`', '`[^1]`'))}, '@', p_name) || '[^1]: 1n' || chr(10) AS after FROM part")
def md_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packages as Markdown, and as Markdown once more behind packages made of that."""
    return packages.round_trip(office_packages(spark, sf_dir))


#: A second version of each document: the same, twice as long, empty, with headings, links or table rows before it.
SECOND = """CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN text || text WHEN 2 THEN '' WHEN 3 THEN repeat('# h' || chr(10), 9) || text WHEN 4 THEN repeat('[l](u) ', 33) || chr(10) || text ELSE repeat('| r |' || chr(10), 8) || text END"""
_ROUND = catalog.SHAPE | {"heading_drift": "abs(headings - headings0) <= 8", "table_drift": "abs(tables - tables0) <= 8", "link_drift": "abs(links - links0) <= 32", "byte_drift": "bytes * 2 <= bytes0 * 3"}


@query(f"WITH src AS ({fixtures.MD_DOCS}), md AS (SELECT doc_id * 2 AS doc_id, text FROM src UNION ALL SELECT doc_id * 2 + 1, {SECOND} FROM src), {catalog.COUNTERS}, "
    f"a AS (SELECT doc_id // 2 AS doc_id, {' AND '.join(f'({g})' for g in catalog.SOURCE.values())} AS ok_source, headings AS headings0, tables AS tables0, links AS links0, bytes AS bytes0 FROM m WHERE doc_id % 2 = 0), "
    f"b AS (SELECT * REPLACE (doc_id // 2 AS doc_id) FROM m WHERE doc_id % 2 = 1) SELECT doc_id, ok_source, {', '.join(f'{g} AS ok_{n}' for n, g in _ROUND.items())}, ok_source AND {' AND '.join(f'({g})' for g in _ROUND.values())} AS ok FROM a JOIN b USING (doc_id)")  # fmt: skip
def roundtrip_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates of a round trip, over pairs of which some drift."""
    pairs = catalog.md(spark, sf_dir).select("doc_id", F.col("text").alias("before"), F.expr(SECOND).alias("after"))
    return gates.round_trip(pairs, key="doc_id")


WRITE = "# @ & co\nplain **b** *i* `c` [l](u) ![a](p.png) {.My_Mark|m}\nDear @\n- one\n  - in\n- two\n1. x\n> q\n```\nk < 1\nj\n```\n| h |\n| --- |\n| @ |\n"
WRITTEN = (
    '<text:h text:style-name="Heading_20_1" text:outline-level="1">@ &amp; co</text:h>'
    '<text:p text:style-name="Affiliation">plain <text:span text:style-name="Strong_20_Emphasis">b</text:span> <text:span text:style-name="Emphasis">i</text:span> <text:span text:style-name="Source_20_Text">c</text:span> '
    '<text:a text:style-name="Internet_20_link" xlink:type="simple" xlink:href="u">l</text:a> <draw:frame text:anchor-type="as-char"><draw:image xlink:type="simple" xlink:show="embed" xlink:actuate="onLoad" xlink:href="p.png"/></draw:frame> {.My_Mark|m}</text:p>'
    '<text:p text:style-name="LetterSalutation">Dear @</text:p>'
    '<text:list text:style-name="L1"><text:list-item><text:p text:style-name="Text_20_body">one</text:p><text:list text:style-name="L1"><text:list-item><text:p text:style-name="Text_20_body">in</text:p></text:list-item></text:list></text:list-item><text:list-item><text:p text:style-name="Text_20_body">two</text:p></text:list-item></text:list>'
    '<text:list text:style-name="LOrdered"><text:list-item><text:p text:style-name="Text_20_body">x</text:p></text:list-item></text:list><text:p text:style-name="Quotations">q</text:p>'
    '<text:p text:style-name="Preformatted_20_Text">k &lt; 1<text:line-break/>j</text:p>'
    '<table:table table:name="Table1"><table:table-row><table:table-cell><text:p text:style-name="Text_20_body">h</text:p></table:table-cell></table:table-row><table:table-row><table:table-cell><text:p text:style-name="Text_20_body">@</text:p></table:table-cell></table:table-row></table:table>'
)


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS path, replace({text(WRITTEN)}, '@', p_name) AS body FROM part")
def odt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of content.xml of a document that holds every construct."""
    made = packages.exported(sample(spark, sf_dir, WRITE)).select(F.col("doc_id").cast("string").alias("path"), "content")
    xml = packages.entries(made, wanted=(odt.CONTENT,)).where(F.col("name") == odt.CONTENT).select("path", F.decode("payload", "utf-8").alias("xml"))
    return xml.select("path", F.regexp_extract("xml", "(?s)<office:text>(.*)</office:text>", 1).alias("body"))


PRESENT = "profile: p\nversion: 1\nroles:\n  Answer:\nrecognize:\n  Answer:\n    match:\n      - paragraph\n    priority: 1\nlayout:\n  Answer:\n    style: Text_20_body\npresent:\n  page:\n    margins:\n      top: 20mm\n  styles:\n    Answer:\n      family: paragraph\n      margin-top: 4mm\n    Quotations:\n      font-style: italic\n"


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, '<style:style style:name="Answer" style:family="paragraph"><style:paragraph-properties fo:margin-top="4mm"/></style:style>' AS added,
  '<style:style style:name="Quotations" style:family="paragraph"><style:text-properties fo:font-style="italic"/></style:style>' AS replaced, CAST(1 AS INT) AS n_replaced, '<style:page-layout-properties fo:margin-top="20mm"/>' AS page, 'mimetype,content.xml,styles.xml,meta.xml,META-INF/manifest.xml' AS names FROM part""")
def present_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile's styles and page in styles.xml: one style added, one replaced, the page's margin; all entries in place."""
    restyle = packages.present_rows(rules.parse(PRESENT))
    made = office_packages(spark, sf_dir).then(lambda path, content: ((p, c) for p, c, _ in restyle(path, content)), ("path", "content"))
    e = packages.listed(made, wanted=(odt.STYLES,))
    own = F.decode(F.get(F.filter("entries", lambda x: x["name"] == odt.STYLES), F.lit(0))["payload"], "utf-8").alias("xml")
    each = e.select("path", own, F.array_join("entries.name", ",").alias("names"))
    style = lambda n: F.regexp_extract("xml", f'<style:style style:name="{n}".*?</style:style>', 0)
    found = F.size(F.regexp_extract_all("xml", F.lit('style:name="Quotations"'), F.lit(0)))
    return each.select("path", style("Answer").alias("added"), style("Quotations").alias("replaced"), found.alias("n_replaced"), F.regexp_extract("xml", "<style:page-layout-properties[^>]*>", 0).alias("page"), "names")


@query("""WITH t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(0, 256) AS g(i))
SELECT c_custkey, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(generate_series(1, length(c_name)), lambda i: CAST(unicode(c_name[i]) AS BIGINT))), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS crc FROM customer, t""")
def crc32_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", packages.crc(F.col("c_name")).alias("crc"))


#: Byte strings in hexadecimal, and whether they are UTF-8: overlong forms, a surrogate, beyond the last code point, cut short.
UTF8 = [("616263", True), ("C3BC", True), ("E282AC", True), ("F09F9982", True), ("C0AF", False), ("E080AF", False), ("EDA080", False), ("E282", False), ("80", False), ("F4908080", False), ("", True), ("F48FBFBF", True)]


@query(f"SELECT c_custkey, {by_case(f'c_custkey % {len(UTF8)}', [str(ok).lower() for _, ok in UTF8])} AS valid, CAST(strlen(c_name) + {by_case(f'c_custkey % {len(UTF8)}', [str(len(h) // 2) for h, _ in UTF8])} AS BIGINT) AS bytes FROM customer")
def utf8_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity of byte strings, sound and faulty ones behind a name."""
    k = F.col("c_custkey") % len(UTF8)
    tail = F.coalesce(*(F.when(k == i, F.lit(h)) for i, (h, _) in enumerate(UTF8)))
    s = F.unhex(F.concat(F.hex(F.col("c_name").cast("binary")), tail))
    return table(spark, sf_dir, "customer").select("c_custkey", F.is_valid_utf8(s.cast("string")).alias("valid"), F.octet_length(s).cast("bigint").alias("bytes"))
