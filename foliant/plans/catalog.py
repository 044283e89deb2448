"""Every query over the document engine, with the SQL that states the same result."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import heuristics as H
from ..functions import rules
from ..operators import blocks, diagnostics, gates, lines, packages, roles
from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.view(spark, sf_dir, fixtures.MD_DOCS)


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.view(spark, sf_dir, fixtures.MD_TOC, ("p_partkey", "p_name", "p_size", "p_type"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.view(spark, sf_dir, fixtures.LETTER_LINES)


def with_md(rest: str, source: str = fixtures.MD_DOCS) -> str:
    return f"WITH md AS ({source}), {rest}"


#: Lines of the fixture, with fences counted.
L = r"""
ls AS (SELECT doc_id, string_split(text, chr(10)) AS xs FROM md),
l AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, xs[i] AS raw, ltrim(xs[i], ' ' || chr(9)) AS line
      FROM ls, unnest(generate_series(1, len(xs) - CASE WHEN xs[len(xs)] = '' THEN 1 ELSE 0 END)) AS g(i)),
f AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS fence_no FROM l),
p AS (SELECT *, fence_no % 2 = 1 AND NOT starts_with(line, '```') AS in_fence FROM f)
"""
CLASS = r"""CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^:::.+') THEN 'directive' WHEN starts_with(line, '```') THEN 'fence'
  WHEN starts_with(line, '>') THEN 'quote' WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading' WHEN starts_with(line, '|') THEN 'pipe'
  WHEN regexp_matches(line, '^[-*] ') THEN 'bullet' WHEN regexp_matches(line, '^[0-9]+\. ') THEN 'ordered' ELSE 'paragraph' END"""


@query(with_md(L + f"SELECT doc_id, line_no, {CLASS} AS class, CAST(strlen(raw) AS INT) AS bytes FROM l"))
def md_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classes(md(spark, sf_dir))


METRICS = r"""
ls AS (SELECT doc_id, text, string_split(text, chr(10)) AS xs FROM md),
l AS (SELECT doc_id, i, xs[i] AS x FROM ls, unnest(generate_series(1, len(xs))) AS g(i)),
f AS (SELECT *, coalesce(sum(CASE WHEN starts_with(x, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM l),
c AS (SELECT doc_id, count_if(starts_with(x, '#')) AS headings, count_if(starts_with(x, '- ') OR starts_with(x, '1. ')) AS lists,
  count_if(starts_with(x, '```table') OR starts_with(x, '| ')) AS tables, count_if(starts_with(x, '| --- |')) AS table_sep_lines,
  count_if(starts_with(x, '```')) AS code_fence_lines, count_if(regexp_matches(x, '^\[\^[0-9]+\]: ')) AS footnote_defs,
  count_if(starts_with(x, '[') AND contains(x, '](#__RefHeading')) AS toc_refheading_links,
  count_if(x IN ('This stage:', 'Previous stage:', 'Latest stage:')) AS stage_labels, count_if(starts_with(x, '> Note:')) AS note_quote_lines,
  coalesce(max(strlen(x)) FILTER (WHERE n % 2 = 0 AND NOT regexp_matches(x, '^ *([#|>`:]|[-*] |[0-9]+\. )') AND NOT contains(x, 'http://') AND NOT contains(x, 'https://')), 0) AS max_non_url_line
  FROM f GROUP BY doc_id)
SELECT c.doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST(headings AS BIGINT) AS headings, CAST(lists AS BIGINT) AS lists, CAST(tables AS BIGINT) AS tables,
  CAST(table_sep_lines AS BIGINT) AS table_sep_lines, CAST(code_fence_lines AS BIGINT) AS code_fence_lines, CAST(footnote_defs AS BIGINT) AS footnote_defs,
  CAST(toc_refheading_links AS BIGINT) AS toc_refheading_links, CAST(stage_labels AS BIGINT) AS stage_labels, CAST(note_quote_lines AS BIGINT) AS note_quote_lines,
  CAST(max_non_url_line AS BIGINT) AS max_non_url_line, CAST(len(regexp_extract_all(text, '\]\(')) AS BIGINT) AS links,
  CAST(len(regexp_extract_all(text, '\[note:')) AS BIGINT) AS notes, CAST(len(regexp_extract_all(text, '\[odt:unsupported ')) AS BIGINT) AS placeholders,
  CAST(len(regexp_extract_all(text, '\[\^[0-9]+\]')) - len(regexp_extract_all(text, '\[\^[0-9]+\]:')) AS BIGINT) AS footnote_refs,
  CAST(len(regexp_extract_all(replace(text, '\<', ''), '<[A-Za-z0-9:_-]+>')) AS BIGINT) AS raw_xml_like_tokens
FROM c JOIN ls USING (doc_id)
"""


@query(with_md(METRICS))
def md_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.metrics(md(spark, sf_dir))


@query(with_md(r"""ls AS (SELECT doc_id, string_split(text, chr(10)) AS xs FROM md)
SELECT doc_id, CAST(len(list_filter(range(1, len(xs) + 1), lambda i: starts_with(xs[i], 'Table') AND contains(xs[i], ' - ') AND i > 1 AND i < len(xs) AND starts_with(xs[i - 1], '| ') AND starts_with(xs[i + 1], '| '))) AS BIGINT) AS caption_interleaves,
  CAST(len(list_filter(range(2, len(xs) + 1), lambda i: starts_with(xs[i], '| --- |') AND starts_with(xs[i - 1], '| --- |'))) AS BIGINT) AS consecutive_separators FROM ls"""))
def md_table_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.table_neighbours(md(spark, sf_dir))


@query(with_md(L + r"""SELECT doc_id, CAST((fence_no + 1) // 2 AS BIGINT) AS fence,
  max(CASE WHEN NOT in_fence THEN trim(substr(line, 4)) END) AS language,
  coalesce(string_agg(CASE WHEN in_fence THEN raw || chr(10) END, '' ORDER BY line_no), '') AS body
FROM p WHERE in_fence OR fence_no % 2 = 1 GROUP BY ALL"""))
def md_fence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.fence_blocks(md(spark, sf_dir))


@query(with_md(L + r"""SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(length(regexp_extract(line, '^(#{1,6}) (.*)$', 1)) AS BIGINT) AS level,
  regexp_extract(line, '^(#{1,6}) (.*)$', 2) AS title,
  regexp_extract(line, '^(#{1,6}) (.*)$', 1) || ' ' || replace(replace(regexp_extract(line, '^(#{1,6}) (.*)$', 2), '<', '\<'), '>', '\>') AS rendered
FROM p WHERE NOT in_fence AND regexp_matches(line, '^(#{1,6}) (.*)$')"""))
def md_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.headings(md(spark, sf_dir))


@query(with_md(L + r""", k AS (SELECT *, CASE WHEN regexp_matches(line, '^[-*] ') THEN 'bullet' WHEN regexp_matches(line, '^[0-9]+\. ') THEN 'ordered' END AS kind, length(raw) - length(line) AS indent FROM p WHERE NOT in_fence),
n AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND line_no - 1 IS NOT DISTINCT FROM lag(line_no) OVER w THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM n),
r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, island ORDER BY line_no) - 1) // 128 AS part FROM i WHERE kind IS NOT NULL),
b AS (SELECT *, first_value(indent) OVER (PARTITION BY doc_id, island, part ORDER BY line_no) AS base FROM r)
SELECT doc_id, CAST(min(line_no) AS BIGINT) AS first_line, kind = 'ordered' AS ordered, count(*) AS items, count(*) FILTER (WHERE indent > base) AS nested FROM b GROUP BY doc_id, island, part, kind"""))
def md_list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.list_runs(md(spark, sf_dir))


@query(with_md(L + r""", t AS (SELECT *, starts_with(line, '|') AS pipe, regexp_matches(line, '^[-:| \t]*-[-:| \t]*$') AS sep FROM p WHERE NOT in_fence),
h AS (SELECT *, pipe AND NOT sep AND coalesce(lead(sep) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS head FROM t),
g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER w AS tab, sum(CASE WHEN pipe THEN 0 ELSE 1 END) OVER w AS gap FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
x AS (SELECT *, max(CASE WHEN head THEN gap END) OVER (PARTITION BY doc_id, tab) AS head_gap FROM g),
c AS (SELECT doc_id, line_no, head, list_transform(string_split(regexp_replace(regexp_replace(rtrim(line, ' ' || chr(9)), '^\|', ''), '\|$', ''), '|'), lambda c: trim(c, ' ' || chr(9))) AS cells
  FROM x WHERE pipe AND NOT sep AND tab > 0 AND gap = head_gap)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, head AS is_header, array_to_string(cells, chr(31)) AS cells, CAST(len(cells) AS BIGINT) AS n_cells FROM c"""))
def md_tables_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.table_cells(md(spark, sf_dir))


@query(with_md(L + r""", d AS (SELECT *, coalesce(max(CASE WHEN starts_with(line, ':::') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS later FROM p WHERE NOT in_fence)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, regexp_extract(line, '^:::[ \t]*([^ \t]+)[ \t]*(.*)$', 1) AS name, regexp_extract(line, '^:::[ \t]*([^ \t]+)[ \t]*(.*)$', 2) AS argument, later AS closed
FROM d WHERE regexp_matches(line, '^:::[ \t]*([^ \t]+)[ \t]*(.*)$')"""))
def md_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.directives(md(spark, sf_dir))


@query(with_md(L + f""", d AS (SELECT *, lag({CLASS}) OVER (PARTITION BY doc_id ORDER BY line_no) AS target FROM p WHERE NOT in_fence)
""" + r"""SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, regexp_extract(line, '^[ \t]*\{\.([^}]+)\}[ \t]*$', 1) AS style, target FROM d WHERE regexp_matches(line, '^[ \t]*\{\.([^}]+)\}[ \t]*$')"""))
def md_style_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.style_lines(md(spark, sf_dir))


@query(with_md(r"""n AS (SELECT doc_id, len(regexp_extract_all(text, '!\[[^\]\n]*\]\([^)\n]*\)')) AS images, len(regexp_extract_all(text, '\[[^\]\n]*\]\([^)\n]*\)')) AS links,
  len(regexp_extract_all(text, '\*\*[^*\n]+\*\*')) AS strong, len(regexp_extract_all(text, '`[^`\n]+`')) AS code_spans, len(regexp_extract_all(text, '\{\.[^|}\n]*\|[^}\n]+\}')) AS styled FROM md)
SELECT doc_id, CAST(images AS BIGINT) AS images, CAST(links - images AS BIGINT) AS links, CAST(strong AS BIGINT) AS strong, CAST(code_spans AS BIGINT) AS code_spans, CAST(styled AS BIGINT) AS styled FROM n"""))
def md_inline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.inline_counts(md(spark, sf_dir))


@query(with_md(r"""n AS (SELECT doc_id, regexp_extract_all(text, '\[note: ([^\]]+)\]', 1) AS xs FROM md)
SELECT doc_id, CAST(k AS BIGINT) AS k, xs[k] AS note FROM n, unnest(generate_series(1, len(xs))) AS g(k)"""))
def md_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.footnotes(md(spark, sf_dir))


@query(with_md(L + f""", g AS (SELECT *, contains(line, '::=') AND {CLASS} = 'paragraph' AS g FROM p WHERE NOT in_fence AND line <> ''),
r AS (SELECT *, sum(CASE WHEN g THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS rest FROM g)
SELECT doc_id, CAST(min(line_no) AS BIGINT) AS first_line, count(*) AS n, string_agg(line, chr(10) ORDER BY line_no) AS body FROM r WHERE g GROUP BY doc_id, rest"""))
def md_grammar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.grammar_runs(md(spark, sf_dir))


@query(with_md(L + r""", t AS (SELECT *, starts_with(raw, '[') AND contains(raw, '](#__RefHeading') AS toc FROM l WHERE raw <> ''),
r AS (SELECT *, sum(CASE WHEN toc THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS rest FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rest, toc ORDER BY line_no) AS k FROM r)
SELECT doc_id, line_no, raw AS line FROM k WHERE NOT toc OR k <= 24""", fixtures.MD_TOC))
def md_toc_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.toc_capped(toc(spark, sf_dir))


@query(with_md(L + r""", t AS (SELECT *, CASE WHEN raw IN ('This stage:', 'Previous stage:', 'Latest stage:') THEN 'label' WHEN starts_with(raw, '[') AND contains(raw, 'docs.oasis-open.org/office/OpenDocument/') THEN 'link' ELSE 'text' END AS kind FROM l WHERE raw <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, raw ORDER BY line_no) AS k, lag(raw) OVER (PARTITION BY doc_id, kind ORDER BY line_no) AS prev FROM t)
SELECT doc_id, line_no, raw AS line FROM k WHERE kind = 'text' OR (kind = 'label' AND k = 1) OR (kind = 'link' AND raw IS DISTINCT FROM prev)""", fixtures.MD_TOC))
def md_stage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.stages_once(toc(spark, sf_dir))


@query(with_md(r"""ls AS (SELECT doc_id, string_split(text, chr(10)) AS xs FROM md)
SELECT doc_id, array_to_string(list_transform(range(1, len(xs) + 1), lambda i: CASE WHEN starts_with(xs[i], 'Table') AND contains(xs[i], ' - ') AND i > 1 AND i < len(xs) AND starts_with(xs[i - 1], '| ') AND starts_with(xs[i + 1], '| ') THEN chr(10) || xs[i] ELSE xs[i] END), chr(10)) AS text FROM ls"""))
def md_caption_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.captions_apart(md(spark, sf_dir))


@query(r"SELECT doc_id, replace(replace(text, '<', '\<'), '>', '\>') AS escaped FROM documents")
def md_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", H.escape(F.col("text")).alias("escaped"))


@query(r"SELECT doc_id, replace(replace(replace(translate(text, chr(10) || chr(13) || chr(9), '   '), '|', '\|'), '<', '\<'), '>', '\>') AS escaped FROM documents")
def md_escape_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", H.escape_flat(F.col("text")).alias("escaped"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", H.xml_escape(F.col("html"), True).alias("escaped"))



STYLE = r"""
t AS (SELECT line_id, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, strlen(text) AS n FROM md),
d AS (SELECT *, n BETWEEN 8 AND 64 AND regexp_matches(text, '[0-9]') AND regexp_matches(low, 'january|february|march|april|may|june|july|august|september|october|november|december') AS is_date FROM t)
SELECT line_id, CASE WHEN text = '---' THEN 'OJSeparator' WHEN text = 'Whereas:' THEN 'OJWhereasLabel' WHEN text = 'For the Commission' THEN 'OJSignatureLine'
  WHEN text = 'The President' THEN 'OJSignatureTitle' WHEN regexp_matches(text, '^\([0-9]+\) ') THEN 'OJRecital' WHEN starts_with(text, 'Dear ') THEN 'LetterSalutation'
  WHEN text IN ('Sincerely,', 'Sincerely') THEN 'LetterClosing' WHEN regexp_matches(text, '^(By email:|By Email:|CC:|Cc:)') THEN 'EmailLine' WHEN is_date THEN 'DateLine'
  WHEN n BETWEEN 1 AND 96 AND (regexp_matches(low, 'street|avenue|road|tel:|phone|boulevard|blvd|lane|drive|place|way |court|suite|wharf|plaza|square') OR (contains(text, ',') AND regexp_matches(text, '[0-9]')) OR regexp_matches(text, '[0-9]{4}')) THEN 'Affiliation'
  WHEN n BETWEEN 1 AND 160 AND contains(text, '@') AND contains(text, '.') THEN 'EmailLine'
  WHEN n <= 60 AND regexp_matches(low, 'institute|department|university|laboratory|school') THEN 'Affiliation'
  WHEN regexp_matches(low, 'this abstract|the abstract should') THEN 'AbstractParagraph'
  WHEN n BETWEEN 8 AND 80 AND NOT contains(text, '@') AND contains(text, ',') AND contains(low, ' and ') THEN 'AuthorLine' ELSE 'Text_20_body' END AS style FROM d
"""


@query(with_md(STYLE, fixtures.LETTER_LINES))
def style_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letters(spark, sf_dir).select("line_id", H.paragraph_style(F.col("text")).alias("style"))



def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 == 0, "error").when(F.col("event_id") % 3 == 0, "warning").otherwise("info").alias("severity"), F.col("event_type").alias("code"), F.lit("import").alias("stage"), F.col("event_type").alias("message"))


@query("""WITH n AS (SELECT user_id AS doc_id, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'warning' ELSE 'info' END AS severity FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY doc_id) AS total FROM n)
SELECT doc_id, CAST(count_if(severity = 'error') AS BIGINT) AS errors, CAST(count_if(severity = 'warning') AS BIGINT) AS warnings, CAST(count_if(severity = 'info') AS BIGINT) AS infos, count(*) AS count,
  CAST(max(total) - count(*) AS BIGINT) AS dropped, count_if(severity = 'error') > 0 AS has_error FROM k WHERE k <= 128 GROUP BY doc_id""")
def diagnostics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.summary(_notes(spark, sf_dir))


@query("""WITH n AS (SELECT user_id AS doc_id, event_id AS seq, event_type AS code, CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'warning' ELSE 'info' END AS severity FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY doc_id) AS total FROM n)
SELECT doc_id, '{"errors":' || count_if(severity = 'error') || ',"warnings":' || count_if(severity = 'warning') || ',"infos":' || count_if(severity = 'info') || ',"count":' || count(*) || ',"dropped":' || (max(total) - count(*)) || ',"diagnostics":['
  || string_agg('{"severity":"' || severity || '","code":"' || code || '","stage":"import","message":"' || code || '"}', ',' ORDER BY seq) || ']}' AS json FROM k WHERE k <= 128 GROUP BY doc_id""")
def diagnostics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.as_json(_notes(spark, sf_dir))


@query("""WITH n AS (SELECT user_id AS doc_id, event_id AS seq, event_type AS code, CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'warn' ELSE 'info' END AS severity FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM n)
SELECT doc_id, string_agg('diag: ' || severity || ': ' || code || chr(10), '' ORDER BY seq) AS text FROM k WHERE k <= 128 GROUP BY doc_id""")
def diagnostics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.as_text(_notes(spark, sf_dir))


PROFILE = """profile: threads
version: 1
roles:
  Title:
  Lead:
  Question:
  Answer:
regions:
  Talk:
    start:
      - Question
recognize:
  Title:
    match:
      - heading(level=1)
    where:
      - position == first
    priority: 100
  Lead:
    match:
      - paragraph
    where:
      - follows Title
    priority: 90
  Question:
    match:
      - heading(level=2)
    where:
      - after Title
    priority: 80
  Answer:
    match:
      - paragraph
    where:
      - in Talk
    priority: 70
layout:
  Title:
    style: Heading_20_1
  Question:
    style: Heading_20_2
  Answer:
    style: Text_20_body
"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.view(spark, sf_dir, fixtures.STREAMS)
    from pyspark.sql import Window as W

    return s.withColumn("stream_idx", (F.row_number().over(W.partitionBy("doc_id").orderBy("ord")) - 1).cast("int")).drop("ord")


#: The profile above, told with windows: its roles depend on earlier ones in ways that running maxima express.
ROLES = f"""
s AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INT) AS stream_idx, kind, level FROM md),
t AS (SELECT *, kind = 'heading' AND level = 1 AND stream_idx = 0 AS title FROM s),
u AS (SELECT *, coalesce(bool_or(title) OVER (PARTITION BY doc_id ORDER BY stream_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS titled, coalesce(lag(title) OVER (PARTITION BY doc_id ORDER BY stream_idx), false) AS prev FROM t),
q AS (SELECT *, kind = 'heading' AND level = 2 AND titled AS question, kind = 'paragraph' AND prev AS lead FROM u),
r AS (SELECT *, coalesce(bool_or(question) OVER (PARTITION BY doc_id ORDER BY stream_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS talk FROM q),
x AS (SELECT doc_id, stream_idx, kind, level, CASE WHEN title THEN 'Title' WHEN lead THEN 'Lead' WHEN question THEN 'Question' WHEN kind = 'paragraph' AND talk THEN 'Answer' END AS role FROM r)
"""


@query(with_md(ROLES + "SELECT * FROM x", fixtures.STREAMS))
def classify_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.classified(_stream(spark, sf_dir), rules.parse(PROFILE))


@query(with_md(ROLES + "SELECT *, CASE role WHEN 'Title' THEN 'Heading_20_1' WHEN 'Question' THEN 'Heading_20_2' WHEN 'Answer' THEN 'Text_20_body' END AS style_id FROM x", fixtures.STREAMS))
def layout_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rules.parse(PROFILE)
    return roles.bound(roles.classified(_stream(spark, sf_dir), p), p)


@query(with_md("""s AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INT) AS stream_idx, kind, level FROM md)
SELECT doc_id, stream_idx, CAST(0 AS INT) AS rule_ix, 'Title' AS role, CAST(100 AS BIGINT) AS priority FROM s WHERE kind = 'heading' AND level = 1 AND stream_idx = 0
UNION ALL SELECT doc_id, stream_idx, 1, 'Lead', 90 FROM s WHERE kind = 'paragraph'
UNION ALL SELECT doc_id, stream_idx, 2, 'Question', 80 FROM s WHERE kind = 'heading' AND level = 2
UNION ALL SELECT doc_id, stream_idx, 3, 'Answer', 70 FROM s WHERE kind = 'paragraph'""", fixtures.STREAMS))
def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.candidates(_stream(spark, sf_dir), rules.parse(PROFILE))


@query("SELECT 'threads' AS profile, CAST(0 AS BIGINT) AS unsupported")
def unsupported_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.unsupported_terms(spark, [rules.parse(PROFILE)])



@query(with_md("""n AS (SELECT * FROM md) SELECT id, name, regexp_matches(name, '^[/\\\\]') OR regexp_matches(name, '(^|[/\\\\])\\.\\.([/\\\\]|$)') AS unsafe,
  CASE WHEN ends_with(name, '.xml') THEN 'text/xml' WHEN ends_with(name, '.png') THEN 'image/png' WHEN ends_with(name, '.jpg') OR ends_with(name, '.jpeg') THEN 'image/jpeg' WHEN ends_with(name, '.gif') THEN 'image/gif'
  WHEN ends_with(name, '.svg') THEN 'image/svg+xml' WHEN ends_with(name, '.bin') THEN 'application/octet-stream' ELSE '' END AS media_type FROM n""", fixtures.ENTRY_NAMES))
def unsafe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fixtures.view(spark, sf_dir, fixtures.ENTRY_NAMES)
    return x.select("id", "name", H.unsafe_name(F.col("name")).alias("unsafe"), H.media_type(F.col("name")).alias("media_type"))


@query(with_md("""t AS (SELECT DISTINCT 'p' || CAST(id % 20 AS VARCHAR) AS path, name FROM md), g AS (SELECT DISTINCT path, n AS name FROM t, (VALUES ('mimetype'), ('content.xml'), ('META-INF/manifest.xml')) v(n))
SELECT path, name FROM t WHERE name NOT IN ('mimetype', 'content.xml', 'META-INF/manifest.xml') UNION ALL SELECT path, name FROM g""", fixtures.ENTRY_NAMES))
def template_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a template package with the generated ones in place of its own."""
    t = fixtures.view(spark, sf_dir, fixtures.ENTRY_NAMES).select(F.concat(F.lit("p"), (F.col("id") % 20).cast("string")).alias("path"), "name").distinct()
    made = t.select("path").distinct().select("path", F.explode(F.array(*(F.lit(x) for x in ("mimetype", "content.xml", "META-INF/manifest.xml")))).alias("name"))
    return packages.template_merge(t, made)




@query("SELECT c_custkey, regexp_matches(n, '^[A-Za-z_:\\x{80}-\\x{10FFFF}][A-Za-z_:0-9.\\x{80}-\\x{10FFFF}-]*$') AS is_name, length(n) AS n_points, CAST(unicode(n) AS INT) AS first_point FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'é' || c_mktsegment WHEN 2 THEN '9' || c_name ELSE replace(c_name, '#', '_') END AS n FROM customer)")
def xml_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the rules of XML, and their code points."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey") % 4
    n = F.when(k == 0, F.col("c_name")).when(k == 1, F.concat(F.lit("é"), "c_mktsegment")).when(k == 2, F.concat(F.lit("9"), "c_name")).otherwise(F.replace("c_name", F.lit("#"), F.lit("_")))
    x = c.select("c_custkey", n.alias("n")).withColumn("p", H.code_points(F.col("n")))
    return x.select("c_custkey", H.xml_name(F.col("n")).alias("is_name"), F.size("p").cast("bigint").alias("n_points"), F.get("p", F.lit(0)).alias("first_point"))


#: The counters with those of neighbouring lines, as one relation by doc_id.
COUNTERS = METRICS.replace("\nSELECT c.doc_id", "\n, m18 AS (SELECT c.doc_id").rstrip() + r"""),
m AS (SELECT m18.*, CAST(len(list_filter(range(1, len(xs) + 1), lambda i: starts_with(xs[i], 'Table') AND contains(xs[i], ' - ') AND i > 1 AND i < len(xs) AND starts_with(xs[i - 1], '| ') AND starts_with(xs[i + 1], '| '))) AS BIGINT) AS caption_interleaves,
  CAST(len(list_filter(range(2, len(xs) + 1), lambda i: starts_with(xs[i], '| --- |') AND starts_with(xs[i - 1], '| --- |'))) AS BIGINT) AS consecutive_separators FROM m18 JOIN ls USING (doc_id))"""
#: The gates of any version of a document, and those of a conversion's result.
SHAPE = {
    "bytes": "bytes > 0", "line": "max_non_url_line <= 240", "raw_tokens": "raw_xml_like_tokens <= 16", "separators": "table_sep_lines <= tables + 4", "fence_lines": "code_fence_lines >= 0",
    "fences_balanced": "code_fence_lines % 2 = 0", "notes": "notes = 0", "footnote_defs": "footnote_defs >= 0", "footnote_refs": "footnote_refs >= footnote_defs", "toc_links": "toc_refheading_links <= 24",
    "stage_labels": "stage_labels <= 3", "note_quotes": "note_quote_lines >= 0", "captions": "caption_interleaves = 0", "separator_runs": "consecutive_separators = 0",
}
SOURCE = SHAPE | {"headings": "headings >= 0", "placeholders": "placeholders <= 8"}


def both(gates: dict[str, str]) -> str:
    return ", ".join(f"{g} AS ok_{n}" for n, g in gates.items()) + ", " + " AND ".join(f"({g})" for g in gates.values()) + " AS ok"


@query(with_md(COUNTERS + f" SELECT doc_id, {both(SOURCE | {'headings': 'headings >= 2', 'fence_lines': 'code_fence_lines >= 2', 'note_quotes': 'note_quote_lines >= 1'})} FROM m"))
def metric_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's counters keep within their limits."""
    return gates.source(md(spark, sf_dir), gates.Limits(headings=2, fence_lines=2, note_quotes=1))


@query(with_md(L + r""", t AS (SELECT *, starts_with(raw, '[') AND contains(raw, '](#__RefHeading') AS toc FROM l WHERE raw <> ''),
r AS (SELECT *, sum(CASE WHEN toc THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS rest FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rest, toc ORDER BY line_no) AS k FROM r),
n AS (SELECT doc_id, count(*) AS lines, count_if(toc) AS links, sum(strlen(raw)) AS bytes FROM k WHERE NOT toc OR k <= 24 GROUP BY doc_id),
o AS (SELECT doc_id, strlen(text) AS bytes, len(regexp_extract_all(text, '\]\(')) AS links FROM md),
a AS (SELECT doc_id, count_if(NOT toc AND contains(raw, '](')) AS others FROM t GROUP BY doc_id)
SELECT o.doc_id, CAST(0 AS BIGINT) AS drift_headings, CAST(0 AS BIGINT) AS drift_tables, CAST(o.links - n.links - others AS BIGINT) AS drift_links, CAST(o.bytes - n.bytes - n.lines + 1 AS BIGINT) AS drift_bytes, true AS ok_bytes
FROM o JOIN n USING (doc_id) JOIN a USING (doc_id)""", fixtures.MD_TOC))
def metric_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters before and after contents lists are capped, their absolute differences, and whether the size stays within 3/2."""
    return gates.drift(lines.toc_versions(toc(spark, sf_dir)))


@query(with_md(L + f""", n AS (SELECT doc_id, {CLASS} AS class, line, in_fence, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line FROM p)
SELECT doc_id, CAST(count_if(NOT in_fence AND class = 'heading') AS BIGINT) AS headings, CAST(count_if(class = 'fence') // 2 + count_if(class = 'fence') % 2 AS BIGINT) AS codes, CAST(count_if(NOT in_fence AND class = 'quote') AS BIGINT) AS quotes FROM n GROUP BY doc_id"""))
def md_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the parser counted by kind, which the line plane must agree with."""
    b = blocks.blocks(md(spark, sf_dir), top=True)
    n = lambda k: F.count_if(F.col("kind") == k)
    return b.groupBy("doc_id").agg(n("heading").alias("headings"), n("code").alias("codes"), n("quote").alias("quotes"))



def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.exported(md(spark, sf_dir)).where("status = 'ok'").select(F.col("doc_id").cast("string").alias("path"), "content")



@query(with_md("s AS (SELECT 1) SELECT CAST(doc_id AS VARCHAR) AS path, CAST(i - 1 AS INT) AS idx, names[i] AS name FROM (SELECT doc_id, ['mimetype', 'content.xml', 'styles.xml', 'meta.xml', 'META-INF/manifest.xml'] AS names FROM md), unnest(generate_series(1, 5)) AS g(i)"))
def zip_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.entries(_packages(spark, sf_dir), payload=False).select("path", "idx", "name")



@query("SELECT CAST(doc_id AS VARCHAR) AS path, true AS ok, coalesce(text, '') || chr(10) AS text FROM documents")
def odt_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to packages and back."""
    return packages.texts_of_created(spark.read.parquet(f"{sf_dir}/documents.parquet"))



@query("SELECT doc_id AS id, text AS back FROM documents")
def deflate_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("data"))
    return packages.deflated(x).select("id", F.col("back").cast("string").alias("back"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(i AS INT) AS seq, CASE i WHEN 0 THEN 'start' WHEN 1 THEN 'start' WHEN 2 THEN 'text' ELSE 'end' END AS kind, CASE i WHEN 0 THEN 'a:r' WHEN 1 THEN 'b' WHEN 2 THEN n_name || ' & co' WHEN 3 THEN 'b' ELSE 'a:r' END AS name FROM nation, unnest(range(0, 5)) AS g(i)")
def xml_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    xml = F.concat(F.lit('<?xml version="1.0"?><a:r xmlns:a="x"><!-- c --><b k="1">'), F.col("n_name"), F.lit(" &amp; co</b></a:r>"))
    return packages.xml_tokens(n.select(F.col("n_nationkey").alias("doc_id"), xml.alias("text")))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(seq AS INT) AS seq, replace(uri, '@', n_name) AS uri, local, CAST(depth AS INT) AS depth
FROM nation, (VALUES (0, 'u1', 'r', 0), (1, 'u2 @', 'x', 1), (2, 'u3', 'y', 2), (3, 'u2 @', 'z', 2), (4, 'u1', 'x', 1), (5, '', 'w', 1), (6, 'd', 'v', 1), (7, '', 'p', 1)) v(seq, uri, local, depth)""")
def xml_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start tags by the innermost binding of their prefix: bound again inside, out of scope again, default, unbound."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    xml = F.concat(F.lit('<a:r xmlns:a="u1"><a:x xmlns:a="u2 '), F.col("n_name"), F.lit('"><a:y xmlns:a="u3"/><a:z/></a:x><a:x/><w/><v xmlns="d"/><b:p/></a:r>'))
    return packages.xml_names(n.select(F.col("n_nationkey").alias("doc_id"), xml.alias("text")))


@query("SELECT doc_id, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS author, 'en' AS language, CAST(0 AS BIGINT) AS created_unix_s, CAST(0 AS BIGINT) AS modified_unix_s FROM documents")
def md_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.metadata(md(spark, sf_dir))


#: CRC-32 of the check string of the algorithm.
CRC_CHECK = zlib.crc32(b"123456789")


from . import cases  # noqa: E402, F401  registers its queries
