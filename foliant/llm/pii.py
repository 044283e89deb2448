"""Personal data by weak supervision, in DataFrame operations only.

Base spans of four kinds come from fixed patterns and checks. Stricter formats
propose further candidates, such as a card number that stands right behind
another, where the base pattern runs on and its check fails. Labelers vote on
every candidate: strict format, checksum or range, a gazetteer (top-level
domains, issuers, calling codes, reserved networks), context words before it,
its boundaries, and the variety of its digits. Expectation-maximisation
estimates, over counts of vote patterns, how reliable each labeler is; its
posteriors train a logistic classifier of spans, which judges the candidates
that the base lacks. Base spans always stay, and a further span must pass its
kind's check.

Scale: spans are found inside each row, no text is shuffled. What is counted
are vote patterns, at most 4 x 3**6 whatever the corpus, and only these reach
the driver. The patterns are possessive where backtracking could be quadratic.

Edge cases: a null text counts as empty and stays null when redacted; positions
are code points, end exclusive; a corpus without candidates gets a classifier
that accepts nothing further; rows of one id are judged one by one. Other
columns are ignored, or kept by redacted().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive, with a start behind no character of the first run (or at the last match's end), these match
#: what plain greedy ones match: a run that fails from its start fails from every later start.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Formats that propose further candidates and that the first labeler takes as strict.
STRICT = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:@| ?\[at\] ?| ?\(at\) ?)[A-Za-z0-9-]{1,63}(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[A-Za-z0-9-]{1,63}){1,8}+",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,15})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
}
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|dev|app|eu|uk|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|dk|fi|us|ca|mx|br|ar|au|nz|jp|cn|in|ru"
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CONTEXT = {
    "email": "(?i)(e-?mail|contact|write|reach|correo|courriel)",
    "ip": "(?i)(\\bip\\b|address|host|server|from|adresse)",
    "card": "(?i)(card|visa|master|amex|pay|carte|karte|tarjeta)",
    "phone": "(?i)(phone|tel|call|mobile|fax|contact|telefon|teléfono|téléphone)",
}
SPAN = "array<struct<kind:string,s:int,e:int,v:string>>"
VOTERS = 6


def located(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches as spans: the text between matches gives their places."""
    none = F.array().cast(SPAN)

    def place(found: Column, between: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(a: Column, i: Column) -> Column:
            s = a["at"] + F.length(F.get(between, i))
            v = F.get(found, i)
            return F.struct((s + F.length(v)).alias("at"), F.concat(a["out"], F.array(F.struct(F.lit(kind).alias("kind"), s.alias("s"), (s + F.length(v)).alias("e"), v.alias("v")))).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda a: a["out"])

    bound = F.transform(
        F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
        lambda m: F.when(F.size(m) > 0, F.get(F.transform(F.array(F.split(text, pattern, -1)), lambda p: place(m, p)), F.lit(0))).otherwise(none),
    )
    return F.get(bound, F.lit(0))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(d: Column) -> Column:
    at = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(at(i))).otherwise(at(i))) % 10 == 0


def valid(kind: Column, v: Column) -> Column:
    """The check of the base spans."""
    octet = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    small = lambda p: F.coalesce(F.substring(F.concat(F.lit("000"), F.regexp_replace(p, "^0+", "")), -3, 3).cast("int"), F.lit(0)) <= 255
    ip = F.forall(F.split(v, r"\."), lambda p: octet(p) & small(p))
    n = F.length(digits(v))
    return (
        F.when(kind == "ip", ip)
        .when(kind == "card", F.when(n.between(16, 19), luhn(digits(v))).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(True)
    )


def votes(text: Column, x: Column) -> Column:
    """-1, 0 or 1 of each labeler on one candidate."""
    kind, v = x["kind"], x["v"]
    by_kind = lambda f: F.coalesce(*(F.when(kind == k, f(k)) for k in KINDS))
    sign = lambda c: F.when(c, 1).otherwise(-1)
    strict = by_kind(lambda k: sign(v.rlike(f"^(?:{STRICT[k]})$")))
    check = sign(valid(kind, v))
    d = digits(v)
    gaz = (
        F.when(kind == "email", F.when(v.rlike(rf"(?i)[.\])] ?(?:{DOMAINS})$"), 1).otherwise(0))
        .when(kind == "ip", F.when(v.rlike(r"^0*(?:0|127|22[4-9]|2[34][0-9]|25[0-5])\."), -1).otherwise(0))
        .when(kind == "card", F.when(d.rlike("^[3-6]"), 1).otherwise(0))
        .otherwise(F.when(d.rlike(f"^(?:{CALLING})"), 1).otherwise(-1))
    )
    before = F.substring(text, F.greatest(x["s"] - 29, F.lit(1)), F.least(x["s"], F.lit(30)))
    context = by_kind(lambda k: F.when(before.rlike(CONTEXT[k]), 1).otherwise(0))
    last, following = F.substring(before, -1, 1), F.substring(text, x["e"] + 1, F.lit(1))
    edges = sign(~(F.when(x["s"] > 0, last).otherwise("").rlike(r"[\p{L}0-9]") | following.rlike(r"[\p{L}0-9]")))
    variety = F.when((kind != "email") & (F.size(F.array_distinct(F.split(d, ""))) <= 2), -1).otherwise(0)
    return F.array(*(c.cast("int") for c in (strict, check, gaz, context, edges, variety)))


def overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def found(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns to keep, base (valid base spans) and cand (further and failed candidates with their votes)."""
    t = F.coalesce(F.col(text), F.lit(""))
    raw = docs.select(*keep, t.alias("_t"), F.concat(*(located(t, BASE[k], k) for k in KINDS)).alias("_raw"), F.concat(*(located(t, STRICT[k], k) for k in KINDS)).alias("_strict"))
    raw = raw.withColumn("base", F.filter("_raw", lambda x: valid(x["kind"], x["v"])))
    same = lambda a, b: (a["kind"] == b["kind"]) & overlaps(a, b)
    more = F.filter("_strict", lambda x: ~F.exists("base", lambda b: same(x, b)))
    seen = lambda xs, label: F.transform(xs, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), valid(x["kind"], x["v"]).alias("ok"), F.lit(label).alias("base"), votes(F.col("_t"), x).alias("votes")))
    # failed matches of the base patterns are the labelers' counter-examples
    failed = F.filter("_raw", lambda x: ~valid(x["kind"], x["v"]) & (F.length(digits(x["v"])).between(8, 40)))
    raw = raw.withColumn("_more", more).withColumn("_failed", failed)
    return raw.select(*keep, F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))).alias("base"), F.concat(seen(F.col("base"), True), seen(F.col("_more"), False), F.transform(seen(F.col("_failed"), False), lambda x: x.withField("ok", F.lit(False)))).alias("cand"))


def patterns(spans: DataFrame) -> list[tuple[str, tuple[int, ...], int]]:
    """(kind, votes, count): at most 4 x 3**6 rows."""
    x = spans.select(F.explode("cand").alias("c")).groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").cast("string").alias("votes")).agg(F.count("*").alias("n"))
    return sorted((r["kind"], tuple(int(v) for v in r["votes"].strip("[]").split(",")), r["n"]) for r in x.collect())


def reliabilities(rows: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> list[float]:
    """Posterior of each pattern by expectation-maximisation over the labelers' confusion tables, one set for each kind."""
    post = {i: 1 / (1 + math.exp(-sum(v))) for i, (_, v, _) in enumerate(rows)}
    for kind in KINDS:
        own = [i for i, r in enumerate(rows) if r[0] == kind]
        for _ in range(rounds):
            table = [[[1.0, 1.0, 2.0], [2.0, 1.0, 1.0]] for _ in range(VOTERS)]  # [true or not][vote]; a labeler is better than chance to begin with
            for t in table:
                t[0], t[1] = [2.0, 1.0, 1.0], [1.0, 1.0, 2.0]
            prior = [1.0, 1.0]
            for i in own:
                _, v, n = rows[i]
                for z, p in ((0, 1 - post[i]), (1, post[i])):
                    prior[z] += n * p
                    for j in range(VOTERS):
                        table[j][z][v[j] + 1] += n * p
            for i in own:
                logs = [math.log(prior[z]) + sum(math.log(table[j][z][rows[i][1][j] + 1] / sum(table[j][z])) for j in range(VOTERS)) for z in (0, 1)]
                post[i] = 1 / (1 + math.exp(max(min(logs[0] - logs[1], 500), -500)))
    return [post[i] for i in range(len(rows))]


def classifier(rows: list[tuple[str, tuple[int, ...], int]], post: list[float], steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> dict:
    """Logistic regression on kind and votes, trained on the posteriors: {feature: weight}."""
    w: dict = {}
    total = sum(math.log1p(n) for *_, n in rows) or 1.0
    for _ in range(steps):
        grad: dict = {}
        for (kind, v, n), y in zip(rows, post, strict=True):
            feats = [(kind,), *((kind, j, x) for j, x in enumerate(v))]
            p = 1 / (1 + math.exp(-max(min(sum(w.get(f, 0.0) for f in feats), 50), -50)))
            for f in feats:
                grad[f] = grad.get(f, 0.0) + math.log1p(n) / total * (y - p)
        for f, g in grad.items():
            w[f] = w.get(f, 0.0) + rate * 8 * (g - ridge * w.get(f, 0.0))
    return w


def log_odds(w: dict, kind: Column, v: Column) -> Column:
    """The classifier as an expression over kind and votes."""
    total = F.lit(0.0)
    for k in KINDS:
        own = F.lit(float(w.get((k,), -50.0)))
        for j in range(VOTERS):
            own = own + F.coalesce(*(F.when(F.get(v, F.lit(j)) == x, F.lit(float(w.get((k, j, x), 0.0)))) for x in (-1, 0, 1)))
        total = F.when(kind == k, own).otherwise(total)
    return total


def accepted(w: dict) -> Column:
    """All spans of a row of found(), by kind as listed, then start."""
    more = F.filter("cand", lambda c: c["ok"] & ~c["base"] & (log_odds(w, c["kind"], c["votes"]) >= 0))
    both = F.concat("base", F.transform(more, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))))
    return F.concat(*(F.array_sort(of_kind(both, k)) for k in KINDS))


def of_kind(xs: Column, kind: str) -> Column:
    return F.filter(xs, lambda x: x["kind"] == kind)


def listed(xs: Column) -> Column:
    return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def train(spans: DataFrame) -> dict:
    rows = patterns(spans)
    return classifier(rows, reliabilities(rows))


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of base spans by kind, base_sha256, spans."""
    spans = written(found(docs), "spans")
    out = spans.withColumn("_all", accepted(train(spans)))
    return out.select("doc_id", *(F.size(of_kind(F.col("base"), k)).cast("bigint").alias(f"n_{k}") for k in KINDS), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("_all")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The same columns; each span of text becomes <KIND>, overlapping ones the first of them, and n_chars the new length."""
    # the row as one value, so that no column's name meets ours
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs[text].alias("text"))
    # found once: each row goes into the written table with its spans
    spans = written(found(rows, "text", ("_row",)), "spans")
    w = train(spans)
    own = F.col("_row")[text]
    spans = spans.withColumn("_all", F.array_sort(F.transform(accepted(w), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.upper(x["kind"]).alias("kind")))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        piece = F.substring(own, a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0)))
        put = F.array(piece, F.concat(F.lit("<"), x["kind"], F.lit(">")))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], F.concat(a["out"], put)).otherwise(a["out"]).alias("out"))

    whole = F.aggregate("_all", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(own, a["at"] + 1, F.length(own))))
    hit = F.size("_all") > 0
    spans = spans.select("_row", hit.alias("_hit"), F.when(hit, whole).otherwise(own).alias("_new"))

    def column(c: str) -> Column:
        if c == text:
            return F.col("_new")
        if c == n_chars:
            return F.when(F.col("_hit"), F.length("_new").cast(docs.schema[c].dataType)).otherwise(F.col("_row")[c])
        return F.col("_row")[c]

    return spans.select(*(column(c).alias(c) for c in docs.columns))
