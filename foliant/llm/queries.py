"""One query per operator: (spark, sf_dir) -> DataFrame over the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, lattice, minhash, mixing, pii, suffix_dedup, toxicity, urlfilter, warc
from .common import read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item; null texts have no words, repeated rows are judged one by one."""
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; null or letterless texts are `und`, an empty table has no rows."""
    return langid.predict(read_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page to ARC, to WARC and back; a null html is an empty payload, ties of the largest id are all responses."""
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document repeated to its source's target weight; rows with a null source are a source of their own."""
    return mixing.mixed(read_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; a null text counts as empty."""
    return pii.detect(read_table(spark, sf_dir, "documents"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated bytes of every document; null and short texts keep all, equal texts repeat each other."""
    return suffix_dedup.digests(read_table(spark, sf_dir, "documents"))


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every vector; null, zero and non-finite ones link with nothing."""
    return lattice.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document; texts without words link with nothing, repeated rows are judged by their own texts."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; empty texts have one too, rows without a label are only scored."""
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url; null urls have an empty host and path."""
    return urlfilter.judge(read_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_language, op3_warc, op4_mixing, op5_pii, op6_suffix_array, op7_lattice, op8_minhash, op9_toxicity, op10_urls)}

ORACLE = {"op1_decontamination": decontam.SQL, "op3_warc": warc.SQL, "op4_mixing": mixing.SQL, "op6_suffix_array": suffix_dedup.SQL, "op7_lattice": lattice.SQL, "op8_minhash": minhash.SQL}
