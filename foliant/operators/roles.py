"""Roles of blocks: rule candidates, one-pass classification, layout binding.

A profile is small and known to the driver. Classification folds each
document's stream inside its row, so streams are gathered once and never joined
with the rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import TEXT_TERMS, Profile, unsupported


def rule_rows(spark: SparkSession, p: Profile) -> DataFrame:
    """(rule_ix, role, match_kind, level, priority, position): the rules' stateless terms."""
    rows = [(i, r.role, r.match, r.level or 0, r.priority, next((a for t, a in r.where if t == "position"), None)) for i, r in enumerate(p.rules)]
    return spark.createDataFrame(rows, "rule_ix int, role string, match_kind string, level int, priority bigint, position string")


def layout_rows(spark: SparkSession, p: Profile) -> DataFrame:
    return spark.createDataFrame(list(p.layout.items()), "role string, layout_style string")


def candidates(stream: DataFrame, p: Profile) -> DataFrame:
    """(doc_id, stream_idx, rule_ix, role): rules whose kind, level and place fit a block; rules are at most 256."""
    n = stream.groupBy("doc_id").agg((F.max("stream_idx")).alias("last"))
    s = stream.join(n, "doc_id")
    r = F.broadcast(rule_rows(stream.sparkSession, p).withColumnsRenamed({"level": "rule_level"}))
    place = F.col("position").isNull() | ((F.col("position") == "first") & (F.col("stream_idx") == 0)) | ((F.col("position") == "last") & (F.col("stream_idx") == F.col("last")))
    fits = (F.col("kind") == F.col("match_kind")) & ((F.col("kind") != "heading") | (F.col("level") == F.col("rule_level"))) & place
    return s.join(r, fits).select("doc_id", "stream_idx", "rule_ix", "role", "priority")


def _holds(term: str, arg: str, a: Column, x: Column, i: Column, n: Column, match_text: bool) -> Column:
    if term == "position":
        return i == 0 if arg == "first" else i == n - 1
    if term == "after":
        return F.array_contains(a["seen"], arg)
    if term in ("before", "precedes"):
        return ~F.array_contains(a["seen"], arg)
    if term == "follows":
        return F.coalesce(a["last"] == arg, F.lit(False))
    if term == "in":
        return F.array_contains(a["active"], arg)
    if not match_text:
        return F.lit(False)
    t = F.coalesce(x["text"], F.lit(""))
    known = x["text"].isNotNull()
    return known & {
        "startswith": lambda: F.startswith(t, F.lit(arg)),
        "equals": lambda: t == arg,
        "endswith": lambda: F.endswith(t, F.lit(arg)),
        "regex": lambda: t.rlike(arg),
        "uppercase": lambda: (t == F.upper(t)) == (arg == "true"),
    }[term]()


def classified(stream: DataFrame, p: Profile, match_text: bool = False) -> DataFrame:
    """(doc_id, stream_idx, kind, level, role): the fitting rule of highest priority, the first of equals, in one pass.

    stream: doc_id, stream_idx, kind, level and, for match_text, text.
    """
    text = F.col("text") if "text" in stream.columns else F.lit(None).cast("string")
    packed = F.array_sort(F.collect_list(F.struct("stream_idx", "kind", "level", text.alias("text"))))
    docs = stream.groupBy("doc_id").agg(packed.alias("b"))
    ordered = sorted(enumerate(p.rules), key=lambda r: (-r[1].priority, r[0]))
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("i"), none.alias("last"), empty.alias("seen"), empty.alias("active"), empty.alias("out"))

    def step(a: Column, x: Column) -> Column:
        n = F.size("b")
        role = none
        for _, r in reversed(ordered):
            fits = x["kind"] == r.match
            if r.match == "heading":
                fits = fits & (x["level"] == r.level)
            fits = reduce(lambda c, t: c & _holds(*t, a, x, a["i"], n, match_text), r.where, fits)
            role = F.when(fits, F.lit(r.role)).otherwise(role)
        # bind the role once, as it is used several times
        def after(role: Column) -> Column:
            seen = F.when(role.isNotNull(), F.array_union(a["seen"], F.array(role))).otherwise(a["seen"])
            opened = [F.when(role.isin(*starts), F.array(F.lit(g))).otherwise(empty) for g, starts in p.regions.items() if starts]
            active = reduce(F.array_union, opened, a["active"])
            return F.struct((a["i"] + 1).alias("i"), role.alias("last"), seen.alias("seen"), active.alias("active"), F.concat(a["out"], F.array(role)).alias("out"))

        return F.get(F.transform(F.array(role), after), F.lit(0))

    out = docs.select("doc_id", "b", F.aggregate("b", start, step, lambda a: a["out"]).alias("roles"))
    z = out.select("doc_id", F.explode(F.arrays_zip("b", "roles")).alias("z"))
    return z.select("doc_id", "z.b.stream_idx", "z.b.kind", "z.b.level", F.col("z.roles").alias("role"))


def bound(roles: DataFrame, p: Profile) -> DataFrame:
    """classified() with style_id: the layout's style of the role; blocks without a role keep none. Layouts are at most 128."""
    return roles.join(F.broadcast(layout_rows(roles.sparkSession, p)), "role", "left").select("doc_id", "stream_idx", "kind", "level", "role", F.col("layout_style").alias("style_id"))


def unsupported_terms(spark: SparkSession, profiles: list[Profile]) -> DataFrame:
    """(profile, unsupported): how many conditions of a profile are on text."""
    return spark.createDataFrame([(p.name, unsupported(p)) for p in profiles], "profile string, unsupported bigint")


__all__ = ["TEXT_TERMS", "bound", "candidates", "classified", "layout_rows", "rule_rows", "unsupported_terms"]
