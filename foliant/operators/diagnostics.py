"""Diagnostics as rows: capped logs, summaries, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Entries that a document's log keeps.
CAP = 128


def exploded(converted: DataFrame) -> DataFrame:
    """(doc_id, seq, severity, code, stage, message) of converted documents."""
    return converted.select("doc_id", F.posexplode("diagnostics").alias("seq", "d")).select("doc_id", "seq", "d.*")


def capped(notes: DataFrame, most: int = CAP) -> DataFrame:
    """The first entries of each document's log."""
    k = F.row_number().over(W.partitionBy("doc_id").orderBy("seq"))
    return notes.withColumn("_k", k).where(F.col("_k") <= most).drop("_k")


def summary(notes: DataFrame, most: int = CAP) -> DataFrame:
    """(doc_id, errors, warnings, infos, count, dropped, has_error): counts over the entries kept, and how many were not."""
    kept = capped(notes, most)
    per = kept.groupBy("doc_id").agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")), F.count("*").alias("count"))
    all_ = notes.groupBy("doc_id").agg(F.count("*").alias("n"))
    return per.join(all_, "doc_id").select("doc_id", "errors", "warnings", "infos", "count", (F.col("n") - F.col("count")).alias("dropped"), (F.col("errors") > 0).alias("has_error"))


def one_line(message: Column) -> Column:
    """Control characters that JSON has no short form for become question marks."""
    return F.regexp_replace(message, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "?")


def as_text(notes: DataFrame, most: int = CAP) -> DataFrame:
    """(doc_id, text): a log as lines `diag: severity: message`, in order."""
    severity = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warn").otherwise("info")
    line = F.concat(F.lit("diag: "), severity, F.lit(": "), F.coalesce("message", F.lit("(no message)")), F.lit("\n"))
    body = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return capped(notes, most).groupBy("doc_id").agg(F.array_join(F.transform(body, lambda x: x["line"]), "").alias("text"))


def as_json(notes: DataFrame, most: int = CAP) -> DataFrame:
    """(doc_id, json): a log as JSON with its summary."""
    body = F.array_sort(F.collect_list(F.struct("seq", "severity", "code", "stage", one_line(F.col("message")).alias("message"))))
    logs = capped(notes, most).groupBy("doc_id").agg(F.transform(body, lambda x: x.dropFields("seq")).alias("diagnostics"))
    return summary(notes, most).join(logs, "doc_id").select("doc_id", F.to_json(F.struct("errors", "warnings", "infos", "count", "dropped", "diagnostics")).alias("json"))
