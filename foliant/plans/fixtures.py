"""Markdown documents made of the plain tables, by SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.kernel import spread

#: Structured documents around the whole text of each document.
MD_DOCS = """
SELECT doc_id,
  '# ' || coalesce(source, '') || chr(10) || '## ' || coalesce(lang, '') || ' introduction' || chr(10) || chr(10)
  || CASE WHEN doc_id % 5 = 0 THEN '> ' ELSE '' END || 'Note: <b>' || coalesce(source, '') || chr(10)
  || CASE WHEN doc_id % 7 = 0 THEN '```sql' || chr(10) || 'SELECT 1' || chr(10) || chr(10) || '# not a heading' || chr(10) || '- not a list' || chr(10) || '```' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 3 = 0 THEN '- one **bold** item' || chr(10) || '- two *soft* item' || chr(10) || '  - nested' || chr(10) || '1. first' || chr(10) || '2. second' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 4 = 0 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || coalesce(lang, '') || ' | ' || coalesce(source, '') || ' |' || chr(10) || 'Table 1 - sizes' || chr(10) || '| x | y |' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 11 = 0 THEN ':::note ' || coalesce(lang, '') || chr(10) || 'inside' || chr(10) || ':::' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 13 = 0 THEN 'rule ::= a b' || chr(10) || 'other ::= c' || chr(10) || '{.Text_20_body}' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 6 = 0 THEN 'See [' || coalesce(source, '') || '](http://example.org/' || coalesce(lang, '') || ') and `code` ![pic](p.png) [note: ref ' || CAST(doc_id AS STRING) || '] then [note: more] {.mark|styled}' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 17 = 0 THEN '[^1]: defined' || chr(10) || 'uses [^1] and [^2]' || chr(10) ELSE '' END
  || replace(coalesce(text, ''), '. ', '.' || chr(10)) || chr(10) AS text
FROM documents
"""

#: A contents list, stage labels and links for each part.
MD_TOC = """
SELECT p_partkey AS doc_id,
  'Contents' || chr(10) || repeat('[' || p_name || '](#__RefHeading_' || CAST(p_partkey AS STRING) || ')' || chr(10), CAST(20 + p_size AS INT)) || chr(10)
  || 'This stage:' || chr(10) || '[a](http://docs.oasis-open.org/office/OpenDocument/a)' || chr(10) || 'This stage:' || chr(10)
  || '[a](http://docs.oasis-open.org/office/OpenDocument/a)' || chr(10) || 'Previous stage:' || chr(10) || '[b](http://docs.oasis-open.org/office/OpenDocument/b)' || chr(10)
  || 'Latest stage:' || chr(10) || 'Previous stage:' || chr(10) || p_type || chr(10) AS text
FROM part
"""

#: One line of a letter for each order, of many looks.
LETTER_LINES = """
SELECT o_orderkey AS line_id, CASE
  WHEN o_orderkey % 16 = 0 THEN '---'
  WHEN o_orderkey % 16 = 1 THEN 'Whereas:'
  WHEN o_orderkey % 16 = 2 THEN '(' || CAST(o_custkey AS STRING) || ') Having regard'
  WHEN o_orderkey % 16 = 3 THEN 'Dear ' || o_orderstatus
  WHEN o_orderkey % 16 = 4 THEN 'Sincerely,'
  WHEN o_orderkey % 16 = 5 THEN 'CC: ' || o_orderpriority
  WHEN o_orderkey % 16 = 6 THEN CAST(o_orderkey % 28 + 1 AS STRING) || ' March 2026'
  WHEN o_orderkey % 16 = 7 THEN CAST(o_custkey AS STRING) || ' Main Street'
  WHEN o_orderkey % 16 = 8 THEN 'name' || o_orderstatus || '@example.org'
  WHEN o_orderkey % 16 = 9 THEN 'Department of ' || o_orderpriority
  WHEN o_orderkey % 16 = 10 THEN 'In THIS abstract we say so at length, and at greater length, without any number or name of a place'
  WHEN o_orderkey % 16 = 11 THEN 'Ada Alpha, Ben Beta and Cleo ' || o_orderstatus
  WHEN o_orderkey % 16 = 12 THEN 'order ' || CAST(o_custkey + 1000 AS STRING)
  WHEN o_orderkey % 16 = 13 THEN 'The President'
  WHEN o_orderkey % 16 = 14 THEN 'Plain words ' || o_orderpriority
  ELSE 'For the Commission' END AS text
FROM orders
"""

#: Names of package entries, some of them unsafe.
ENTRY_NAMES = """
SELECT p_partkey AS id, CASE
  WHEN p_size % 8 = 0 THEN '/abs/' || p_brand || '.xml'
  WHEN p_size % 8 = 1 THEN 'a/../' || p_brand
  WHEN p_size % 8 = 2 THEN 'Pictures/' || p_brand || '.png'
  WHEN p_size % 8 = 3 THEN 'content.xml'
  WHEN p_size % 8 = 4 THEN 'Thumbnails/'
  WHEN p_size % 8 = 5 THEN '..'
  WHEN p_size % 8 = 6 THEN 'x..y/z.jpeg'
  ELSE 'data/' || p_brand || '.bin' END AS name
FROM part
"""

#: Block streams: each conversation turn as heading and paragraph.
STREAMS = """
SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS ord,
  CASE WHEN turn = 0 THEN 'heading' WHEN role = 'user' THEN 'heading' WHEN length(text) % 5 = 0 THEN 'list' ELSE 'paragraph' END AS kind,
  CASE WHEN turn = 0 THEN 1 WHEN role = 'user' THEN 2 ELSE 0 END AS level
FROM conversations
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, sql: str, short: tuple[str, ...] = ()) -> DataFrame:
    """Run one of the queries above; its table is read from sf_dir. The plan is analyzed at once, so the view's name may serve again.

    short: the columns that it reads, where long texts are made of short rows; these are dealt to all cores before.
    """
    head, rest = sql.rsplit("FROM ", 1)
    read = spark.read.parquet(f"{sf_dir}/{rest.split()[0]}.parquet")
    (spread(read.select(*short)) if short else read).createOrReplaceTempView("foliant_fixture")
    return spark.sql(head + "FROM foliant_fixture")
