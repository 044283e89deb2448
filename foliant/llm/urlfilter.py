"""URL filters: rules by host and path, else unigram Viterbi segmentation of host words and multinomial naive Bayes.

Host labels and path parts are cut into the most probable words of a fixed
public vocabulary: a word's probability falls with its rank in that vocabulary
(Zipf's law), an unknown letter costs more than any word. The words of host and
path, told apart, are the tokens of a naive Bayes model that is trained on
URLs that the rules decide, at most `fit_rows` of each verdict chosen by a hash.

Scale: one pass over the urls; rules and model have a bounded size and are sent
to the tasks; each distinct host of a batch is segmented once.

Edge cases: a null url, or one without ://, has an empty host and path, fits no
rule and is judged by the model's prior; ports and user names stay part of the
host, as the host rule is literal; rules of equal length and place cannot both
fit; if the rules decide URLs of one verdict only, that one holds for all, and
with none decided all are allowed; repeated rows each get their verdict.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Verdict, host and path prefix.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: The column `rule` names a rule by host and path, with the slash that joins them.


def parts(url: Column) -> tuple[Column, Column]:
    """Host, ASCII letters lower-cased, and path; empty where there is no ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    blank = F.coalesce(F.instr(url, "://"), F.lit(0)) == 0
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(blank, "").otherwise(low), F.when(blank, "").otherwise(path)


def matched(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def unigrams(path: str = VOCABULARY) -> dict[str, float]:
    """Log probability of each word of the vocabulary by its rank; a word is a whole token or a token's text."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    rank: dict[str, int] = {}
    for token, n in vocab.items():
        word = token.removesuffix("</w>")
        # a whole word outranks the same letters as a part of others
        n = n if token.endswith("</w>") else 4 * n + 1000
        if word.isalpha() and (len(word) > 1 or word in "ai") and n < rank.get(word, 1 << 60):
            rank[word] = n
    total = sum(1 / (r + 50) for r in rank.values())
    return {w: -math.log((r + 50) * total) for w, r in rank.items()}


def segment(text: str, words: dict[str, float], longest: int = 24, unknown: float = -14.0) -> list[str]:
    """The most probable cut of letters into words; single unknown letters cost `unknown` each and join up."""
    n = len(text)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for e in range(1, n + 1):
        best[e], back[e] = best[e - 1] + unknown, e - 1
        for s in range(max(0, e - longest), e):
            p = words.get(text[s:e])
            if p is not None and best[s] + p > best[e]:
                best[e], back[e] = best[s] + p, s
    out, e = [], n
    while e:
        out.append(text[back[e] : e])
        e = back[e]
    out.reverse()
    joined: list[str] = []
    loose = False
    for w in out:
        one = w not in words
        if one and loose:
            joined[-1] += w
        else:
            joined.append(w)
        loose = one
    return joined


def tokens(host: str, path: str, words: dict[str, float], cache: dict[str, list[str]]) -> list[str]:
    """Words of the host and of the path, told apart; a run of digits counts as `#` and its length."""
    out = []
    for kind, text in (("h", host), ("p", path.lower())):
        run, digits = "", 0
        for c in text + "\0":
            if digits and not c.isdecimal():
                out.append(f"{kind}:#{digits}")
                digits = 0
            if c.isalpha():
                run += c
                continue
            digits += c.isdecimal()
            if run:
                cut = cache.get(run)
                if cut is None:
                    if len(cache) > 100_000:
                        cache.clear()
                    cut = cache[run] = segment(run, words)
                out += [f"{kind}:{w}" for w in cut]
                run = ""
    return out


def train(rows: list[tuple[str, str, str]], words: dict[str, float], smooth: float = 0.5) -> dict:
    """Multinomial naive Bayes from (host, path, verdict): log prior odds of block and log odds of each token."""
    cache: dict[str, list[str]] = {}
    count: dict[str, dict[str, int]] = {"allow": {}, "block": {}}
    docs = {"allow": 0, "block": 0}
    for host, path, verdict in rows:
        docs[verdict] += 1
        for t in tokens(host, path, words, cache):
            count[verdict][t] = count[verdict].get(t, 0) + 1
    if not docs["block"] or not docs["allow"]:
        return {"prior": math.inf if docs["block"] else -math.inf, "odds": {}}
    all_ = sorted(set(count["allow"]) | set(count["block"]))
    total = {v: sum(c.values()) + smooth * len(all_) for v, c in count.items()}
    odds = {t: math.log((count["block"].get(t, 0) + smooth) / total["block"]) - math.log((count["allow"].get(t, 0) + smooth) / total["allow"]) for t in all_}
    return {"prior": math.log(docs["block"] / docs["allow"]), "odds": odds}


def sample(decided: DataFrame, fit_rows: int) -> list[tuple[str, str, str]]:
    """(host, path, verdict) of at most fit_rows rows of each verdict, those of the smallest hashes.

    A hash bound set by the verdicts' counts keeps what reaches the driver to little more than that.
    """
    known = decided.where("decided IS NOT NULL")
    h = F.pmod(F.xxhash64("host", "path", F.col("page_id").cast("string")), F.lit(1 << 40))
    bound = F.lit(0)
    for r in known.groupBy("decided").agg(F.count("*").alias("n")).collect():  # a row for each verdict
        share = min(1.0, 1.3 * fit_rows / r["n"] + 1e-9)
        bound = F.when(F.col("decided") == r["decided"], F.lit(int(share * (1 << 40)))).otherwise(bound)
    got: dict[str, list] = {}
    for r in sorted(known.where(h < bound).select(h.alias("h"), "host", "path", "decided").collect()):
        got.setdefault(r["decided"], []).append((r["host"], r["path"], r["decided"]))
    return [x for v in sorted(got) for x in got[v][:fit_rows]]


def judge(pages: DataFrame, rules: tuple = RULES, fit_rows: int = 5000, vocabulary: str = VOCABULARY, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (log odds of block by the model)."""
    host, path = parts(F.col(url).cast("string"))
    src = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    src = src.withColumn("rule", rule).withColumn("decided", verdict)
    words = unigrams(vocabulary)
    rows = sample(src, fit_rows)
    shared = pages.sparkSession.sparkContext.broadcast((words, train(rows, words)))
    schema = T.StructType([src.schema["page_id"], *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = shared.value
        cache: dict[str, list[str]] = {}
        for b in batches:
            p = [model["prior"] + sum(model["odds"].get(t, 0.0) for t in tokens(h, q, words, cache)) for h, q in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            out = [v or ("block" if x > 0 else "allow") for v, x in zip(b.column(4).to_pylist(), p, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.string()), pa.array(p, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    return src.mapInArrow(score, schema)
