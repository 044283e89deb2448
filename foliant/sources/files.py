"""Readers and writers of Markdown and package files, on any file system that Spark reaches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.odt import FILE_MOST
from ..operators.kernel import flat_map


def read_binary(spark: SparkSession, path: str, most: int = FILE_MOST) -> DataFrame:
    """(path, length, content, readable): whole files; a file of the limit or more is not read but listed. Spark's reader passes over empty files."""
    files = spark.read.format("binaryFile").load(path)
    small = F.col("length") < most
    return files.select("path", "length", F.when(small, F.col("content")).alias("content"), small.alias("readable"))


def as_text(content: Column) -> Column:
    """Bytes as text, null if they are no UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text): one row per file; doc_id is a hash of its path. What is no UTF-8 has a null text."""
    files = read_binary(spark, path).where("readable")
    return files.select(F.xxhash64("path").alias("doc_id"), "path", as_text(F.col("content")).alias("text"))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files that are small enough."""
    return read_binary(spark, path).where("readable").select("path", "content")


def write_markdown(docs: DataFrame, path: str) -> None:
    """(doc_id, text) as text files, one for each document, in folders by doc_id."""
    # the writer ends each text with a line feed of its own
    docs.select("doc_id", F.regexp_replace("text", r"\n\z", "").alias("value")).write.partitionBy("doc_id").option("lineSep", "\n").mode("errorifexists").text(path)


def write_packages(files: DataFrame, path: str) -> None:
    """(path, content) as a table that read_stored() reads; one commit for all."""
    files.select("path", "content").write.mode("errorifexists").parquet(path)


def write_files(files: DataFrame, folder: str, suffix: str = ".odt") -> DataFrame:
    """(path, content) as one file for each row in a folder (a URI that pyarrow's file systems know); returns (path, file, error).

    Names come from the last part of `path`, with a hash of the whole of it
    where that isn't a plain name. A file is written under its final name by
    the task that holds its row, so a task that runs again writes the same
    bytes again; a null content writes nothing and has an error. Nothing is
    written until the result is read.
    """

    def rows(path: str | None, content: bytes | None) -> Iterator[tuple]:
        import hashlib
        import re

        from pyarrow import fs

        if path is None or content is None:
            yield (path, None, "no content")
            return
        name = path.rsplit("/", 1)[-1].removesuffix(suffix)
        plain = re.sub(r"[^A-Za-z0-9._-]", "_", name)[:100]
        if plain != path or plain.startswith("."):
            plain = f"{plain.lstrip('.')}-{hashlib.sha1(path.encode()).hexdigest()[:12]}"
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{plain}{suffix}") as out:
            out.write(content)
        yield (path, f"{folder}/{plain}{suffix}", None)

    return flat_map(files.select("path", "content"), rows, "path string, file string, error string")


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("path", "content")


#: Formats by name, each with its reader.
FORMATS = {"md": read_markdown, "odt": read_packages}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Read files of a registered format."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    return FORMATS[kind](spark, path)
