"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's mean repetition rate is its target share of the output over its
share of the corpus. Each document draws a uniform number from a hash of the
seed and its id, inverts the Poisson distribution of its source's rate with it,
and occurs so many times; a global shuffle orders the copies by another hash.
Draws are independent of partitioning, so a lost task repeats them exactly.

Scale: one partial aggregation over two narrow columns gives the sources'
sizes. The table of rates is broadcast only while it has at most
`broadcast_sources` rows, otherwise an equi-join that AQE splits deals the
documents. The shuffle deals by a hash that differs from copy to copy, so a
hot source spreads evenly.

Edge cases: a null source is a source of its own; a null size counts 0, and a
source of size 0 gets rate 0 under given weights and 1 otherwise; a null doc_id
draws like an empty one; rows of one id draw alike; a source that the given
weights leave out gets rate 0; an empty table gives no rows. Other columns are
kept as they are; a column named like one of ours is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits of the MD5 of the parts."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / float(2**52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, budget: float | None = None, source: str = "source", size: str = "n_chars") -> DataFrame:
    """(source, rate): mean repetitions. Without weights a source's target share is its size to the power alpha, normalised.

    budget: total size of the output, by default that of the corpus.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(F.col(size).cast("bigint")), F.lit(0)).cast("double").alias("size"))
    if weights is None:
        share = F.pow(F.col("size"), F.lit(float(alpha)))
    else:
        share = F.lit(0.0)
        for k, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(share)
    sizes = sizes.withColumn("share", share)
    total = sizes.agg(F.sum("size"), F.sum(F.when(F.col("size") > 0, F.col("share")))).first()  # one row
    all_size, all_share = float(total[0] or 0), float(total[1] or 0)
    empty = F.lit(1.0) if weights is None else F.lit(0.0)
    if not all_share:
        return sizes.select("source", empty.alias("rate"))
    rate = F.col("share") / F.lit(all_share) * F.lit(float(all_size if budget is None else budget)) / F.col("size")
    return sizes.select("source", F.when(F.col("size") > 0, rate).otherwise(empty).alias("rate"))


def cumulative(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, 2, ... up to where it is 1 in double precision."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    step = lambda a, k: F.struct((a["log"] + F.log(rate / k)).alias("log"), (a["sum"] + F.exp(a["log"] + F.log(rate / k))).alias("sum"), F.array_append(a["cdf"], a["sum"] + F.exp(a["log"] + F.log(rate / k))).alias("cdf"))
    zero = F.exp(-rate)
    start = F.struct((-rate).alias("log"), zero.alias("sum"), F.array(zero).alias("cdf"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["cdf"])).otherwise(F.array(F.lit(1.0)))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, budget: float | None = None, seed: str = "mix-1", doc_id: str = "doc_id", source: str = "source", size: str = "n_chars", broadcast_sources: int = 100_000) -> DataFrame:
    """All columns of docs plus n_copies, copy_no (1 to n_copies) and shuffle_key, shuffled globally."""
    table = rates(docs, weights, alpha, budget, source, size).select(F.col("source").alias("_source"), cumulative(F.col("rate")).alias("_cdf"))
    if table.select("_source").limit(broadcast_sources + 1).count() <= broadcast_sources:
        table = F.broadcast(table)
    ours = ("n_copies", "copy_no", "shuffle_key")
    # the row as one value, so that no column's name meets ours
    row = F.struct(*(docs[c] for c in docs.columns if c not in ours))
    rows = docs.select(row.alias("_row"), docs[source].alias("_own"), F.coalesce(docs[doc_id].cast("string"), F.lit("")).alias("_id"), uniform(seed, docs[doc_id]).alias("_u"))
    joined = rows.join(table, F.col("_own").eqNullSafe(F.col("_source")))
    n = F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))
    out = joined.select("_row", "_id", n.cast("bigint").alias("n_copies")).where("n_copies > 0")
    out = out.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_copies"))))
    key = F.md5(F.concat_ws("|", F.lit(seed + "-order"), "_id", F.col("copy_no").cast("string")))
    return out.select("_row.*", "n_copies", "copy_no", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


#: The same rows in DuckDB over the view documents.
SQL = """
WITH RECURSIVE s AS (SELECT source, CAST(coalesce(sum(n_chars), 0) AS DOUBLE) AS size FROM documents GROUP BY source),
t AS (SELECT sum(size) AS all_size, sum(pow(size, 0.5)) FILTER (WHERE size > 0) AS all_share FROM s),
r AS (SELECT source, CASE WHEN size > 0 THEN pow(size, 0.5) / all_share * all_size / size ELSE 1.0 END AS rate FROM s, t),
c(source, rate, k, log, cdf) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM r
  UNION ALL
  SELECT source, rate, k + 1, log + ln(rate / (k + 1)), cdf + exp(log + ln(rate / (k + 1))) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
u AS (SELECT *, CAST(('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
n AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) FILTER (WHERE c.cdf <= u.u) AS n_copies
  FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy_no, md5('mix-1-order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(copy_no AS VARCHAR)) AS shuffle_key
FROM n, unnest(generate_series(1, n_copies)) AS g(copy_no)
"""
