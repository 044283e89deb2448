"""Command line: python -m foliant VERB ...; a path is a file, a folder or a pattern of files.

    validate IN
    inspect IN
    extract-text IN [OUT]
    create IN OUT
    repack IN OUT
    convert --from FORMAT --to FORMAT [--template FILE] [--strict] [--diag-json] IN OUT

OUT is a folder with one file for each input, whose names follow those of the
inputs. A template is a package or, from Markdown, a profile. Returns 0 if all
inputs came through, 1 for a wrong call, 2 where nothing could be read, else
the highest code among the inputs. Diagnostics go to the error stream.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import odt, rules
from .operators import diagnostics
from .operators.kernel import flat_map
from .sources import files

VERBS = {"validate": (1, 1), "inspect": (1, 1), "extract-text": (1, 2), "create": (2, 2), "repack": (2, 2)}
INVALID = 3


def usage() -> int:
    print(__doc__, file=sys.stderr)
    return api.CODES["usage"]


def stored(made: DataFrame, out: str, suffix: str) -> int:
    """Write (path, content, code) and say how it went; the highest code."""
    made = made.persist()
    try:
        bad = made.agg(F.coalesce(F.max("code"), F.lit(api.CODES["input"])).alias("code"), F.count("content").alias("n")).first()
        done = files.write_files(made.where("content IS NOT NULL"), out if "://" in out else Path(out).resolve().as_uri(), suffix)
        failed = done.where("error IS NOT NULL").count()
        print(f"{bad['n'] - failed} written")
        return max(bad["code"], api.CODES["output"] if failed else 0)
    finally:
        made.unpersist()


def converted(spark: SparkSession, args: list[str]) -> int:
    template, flags, i = None, set(), 4
    if len(args) < 6 or args[0] != "--from" or args[2] != "--to":
        return usage()
    while i < len(args) - 2:
        if args[i] == "--template" and template is None and i + 1 < len(args) - 2:
            template, i = args[i + 1], i + 2
        elif args[i] in ("--strict", "--diag-json"):
            flags.add(args[i])
            i += 1
        else:
            return usage()
    if i + 2 != len(args):
        return usage()
    source, target, given, out = args[1], args[3], args[i], args[i + 1]
    if source not in api.FORMATS or target not in api.FORMATS:
        print("error: format handler not found", file=sys.stderr)
        return api.CODES["invalid"]
    kept: dict = {}
    if template is not None:
        rows = files.read_binary(spark, template).take(1)
        if target != "odt" or not rows or rows[0]["content"] is None:
            print("error: no template that can be read", file=sys.stderr)
            return api.CODES["template"]
        data = bytes(rows[0]["content"])
        if not data.startswith(b"PK"):
            kept = {"profile": data.decode("utf-8", "replace")}
            if source != "md":
                return api.CODES["not_markdown"]
        elif odt.package_error(data):
            return api.CODES["template"]
        else:
            kept = {"template": data}
    read = files.read_binary(spark, given)
    src = read.select(F.col("path").alias("doc_id"), files.as_text(F.col("content")).alias("text")) if source == "md" else read.select("path", "content")
    try:
        got = api.convert(src, source, target, policy="strict" if "--strict" in flags else "lossy", **kept)
    except rules.ProfileError as e:
        print(f"error: {e}", file=sys.stderr)
        return api.CODES["profile"]
    got = got.persist()
    try:
        notes = diagnostics.exploded(got.withColumnRenamed("id", "doc_id"))
        log = diagnostics.as_json(notes).select("doc_id", F.col("json").alias("log")) if "--diag-json" in flags else diagnostics.as_text(notes).select("doc_id", F.col("text").alias("log"))
        for r in log.toLocalIterator():
            print(r["doc_id"], r["log"], sep="\n", file=sys.stderr)
        body = F.coalesce("content", F.encode("text", "utf-8"))
        return stored(got.select(F.col("id").alias("path"), body.alias("content"), "code"), out, f".{target}")
    finally:
        got.unpersist()


def run(spark: SparkSession, args: list[str]) -> int:
    if args[:1] == ["convert"]:
        return converted(spark, args[1:])
    if not args or args[0] not in VERBS or not VERBS[args[0]][0] <= len(args) - 1 <= VERBS[args[0]][1]:
        return usage()
    verb, given = args[0], files.read_binary(spark, args[1])
    if given.isEmpty():
        print("error: failed to read input", file=sys.stderr)
        return api.CODES["input"]
    state = lambda ok: F.when(ok, F.lit(0)).otherwise(INVALID).alias("code")
    if verb == "validate":
        worst = 0
        for r in api.validate(given).toLocalIterator():
            worst = worst if r["ok"] else INVALID
            print(r["path"], "ok" if r["ok"] else f"invalid: {r['error']}")
        return worst
    if verb == "inspect":
        n = 0
        for r in api.inspect(given).orderBy("path", "idx").toLocalIterator():
            n += 1
            print(r["path"], r["idx"], r["name"], r["method"], r["uncomp_size"])
        return 0 if n else INVALID
    if verb == "extract-text":
        got = api.extract_text(given)
        if len(args) == 3:
            return stored(got.select("path", F.encode("text", "utf-8").alias("content"), state(F.col("ok"))), args[2], ".txt")
        worst = 0
        for r in got.toLocalIterator():
            worst = worst if r["ok"] else INVALID
            print(r["text"] if r["ok"] else f"error: {r['path']}", end="" if r["ok"] else "\n")
        return worst
    if verb == "create":
        made = flat_map(given.select("path", files.as_text(F.col("content")).alias("text")), lambda p, t: [(p, None if t is None else odt.create(t))], "path string, content binary")
        return stored(made.select("path", "content", state(F.col("content").isNotNull())), args[2], ".odt")
    return stored(api.repack(given).select("path", "content", state(F.col("ok"))), args[2], ".odt")


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("foliant").getOrCreate()
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
