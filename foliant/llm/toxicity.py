"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a whole text: densities of learned lexicons (words, and word stems
of 3 to 8 bytes), how near such words stand to second-person pronouns, rates of
capitals, punctuation, digits and repeated characters, and rates of
obfuscation: words that mix letters with digits or symbols, and those that hit
the lexicon only after the usual substitutions are undone.

Fit (bounded, on the driver): at most `per_class` texts of each label, chosen
by a hash of the id. One half of them finds the lexicons, the other half trains
the trees, whose out-of-fold scores train the calibration; weights restore the
classes' shares among all labelled rows. Score: every whole text, numpy over
the bytes of Arrow batches. The model has a bounded size.

Edge cases: a null text scores like an empty one; labels that are null or
rows without one are not learned from; an id with several labels counts as
toxic if one says so, and of several texts of an id the one that sorts first is
learned from; without labels of both kinds all scores are the share of
toxic labels (0 without any); a null id is held out like id ''. A score depends
on its own text and the model only. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .langid import crc, digests

PER_CLASS, LEXICON, TREES, DEPTH, RATE = 1500, 400, 60, 3, 0.2
STEMS = range(3, 9)
NEAR = 5
#: Second-person words of the languages of the corpus.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre ti usted ustedes tus vos".split()


def unmasked() -> np.ndarray:
    """Bytes with the usual substitutions of letters undone."""
    t = K.fold_table()
    for a, b in zip(b"013457@$!|", b"oleastasil", strict=True):
        t[a] = b
    return t


@dataclass
class Words:
    """Words of some texts: runs of letters, digits, non-ASCII bytes and the symbols that mask letters."""

    data: np.ndarray
    offs: np.ndarray
    s: np.ndarray
    e: np.ndarray
    row: np.ndarray
    whole: np.ndarray
    plain: np.ndarray
    prefix: np.ndarray
    powers: K.Powers

    @classmethod
    def of(cls, data: np.ndarray, offs: np.ndarray, powers: K.Powers) -> Words:
        kind = K.alnum_class()
        kind[list(b"@$*")] = True
        s, e, row = K.cut(data, offs, kind)
        h = K.prefix(data, K.byte_values(), powers)
        plain = unmasked()[data]
        g = K.prefix(plain, K.byte_values(), powers)
        return cls(data, offs, s, e, row, K.span_hash(h, s, e, powers), K.span_hash(g, s, e, powers), h, powers)

    def stem(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words longer than n bytes and the hashes of their first n."""
        long = np.flatnonzero(self.e - self.s > n)
        return long, K.span_hash(self.prefix, self.s[long], self.s[long] + n, self.powers)


def member(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(h), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)] == h


def telling(keys: np.ndarray, rows: np.ndarray, y: np.ndarray, most: int, odds_over: float = 3.5) -> np.ndarray:
    """The keys that mark label 1: by smoothed log odds of the texts that hold them, hardly any of label 0 among them; sorted."""
    if not len(keys):
        return keys
    pair = np.unique(np.stack([keys, rows.astype(np.uint64)], 1), axis=0)
    k, first, n = np.unique(pair[:, 0], return_index=True, return_counts=True)
    pos = np.add.reduceat(y[pair[:, 1].astype(np.int64)], first)
    neg = n - pos
    p, q = max(y.sum(), 1), max((1 - y).sum(), 1)
    odds = np.log((pos + 0.5) / (p + 1)) - np.log((neg + 0.5) / (q + 1))
    ok = (pos >= max(3, y.sum() // 150)) & (odds > odds_over) & (neg <= 0.02 * pos)
    order = np.argsort(-(odds * np.sqrt(pos))[ok], kind="stable")[:most]
    return np.sort(k[ok][order])


@dataclass
class Lexicon:
    words: np.ndarray
    stems: dict[int, np.ndarray]
    second: np.ndarray

    @classmethod
    def learn(cls, w: Words, y: np.ndarray) -> Lexicon:
        return cls(telling(w.whole, w.row, y, LEXICON), {n: telling(w.stem(n)[1], w.row[w.stem(n)[0]], y, LEXICON) for n in STEMS}, np.sort(digests([x.encode() for x in SECOND_PERSON])))


NAMES = ("words", "lexicon", "lexicon_rate", "stem", "stem_rate", "masked", "masked_rate", "near_you", "near_rate", "you_rate", "capitals", "marks", "shouts", "digits", "mixed", "repeats", "symbols")


def features(data: np.ndarray, offs: np.ndarray, lex: Lexicon, powers: K.Powers) -> np.ndarray:
    """(texts, features), in the order of NAMES."""
    n = len(offs) - 1
    w = Words.of(data, offs, powers)
    count = lambda at: np.bincount(w.row[at], minlength=n).astype(float)
    hit = member(lex.words, w.whole)
    stem = np.zeros(len(w.s), bool)
    for size in STEMS:
        long, h = w.stem(size)
        stem[long] |= member(lex.stems[size], h)
    masked = ~hit & (w.plain != w.whole) & member(lex.words, w.plain)
    bad = np.flatnonzero(hit | masked | stem)
    you = np.flatnonzero(member(lex.second, w.whole))
    near = np.zeros(len(bad), bool)
    if len(you) and len(bad):
        at = np.searchsorted(you, bad)
        for y in (you[np.maximum(at - 1, 0)], you[np.minimum(at, len(you) - 1)]):
            near |= (np.abs(y - bad) <= NEAR) & (w.row[y] == w.row[bad])
    total = np.bincount(w.row, minlength=n).astype(float)
    size = np.maximum(np.diff(offs), 1).astype(float)
    sums = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[offs]).astype(float)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    mark = (data == 33) | (data == 63)
    punct = ((data >= 33) & (data <= 47)) | ((data >= 58) & (data <= 64)) | ((data >= 91) & (data <= 96)) | ((data >= 123) & (data <= 126))
    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    # the first two bytes of a text repeat nothing, whatever stands before it
    lead = np.concatenate([offs[:-1], offs[:-1] + 1])
    same[lead[lead < np.concatenate([offs[1:], offs[1:]])]] = False
    symbol = np.concatenate([[0], np.cumsum(digit | (data == 64) | (data == 36) | (data == 42))])
    inside = symbol[w.e] - symbol[w.s]
    mixed = (inside > 0) & (inside < w.e - w.s)
    per = np.maximum(total, 1)
    cols = [
        np.log1p(total), count(hit), count(hit) / per, count(stem), count(stem) / per, count(masked), count(masked) / per,
        np.bincount(w.row[bad[near]], minlength=n), np.bincount(w.row[bad[near]], minlength=n) / per, count(you) / per,
        sums(upper) / size, sums(punct) / size, sums(mark) / size, sums(digit) / size, count(mixed) / per, sums(same) / size, sums(punct & ~mark) / size,
    ]
    return np.stack(cols, 1)


@dataclass
class Trees:
    """Gradient-boosted trees for the logistic loss; splits on quantile bins."""

    base: float = 0.0
    trees: list = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
        edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, 33)[1:-1])) for c in range(x.shape[1])]
        bins = np.stack([np.searchsorted(edges[c], x[:, c], "left") for c in range(x.shape[1])], 1)
        p = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
        out = cls(float(np.log(p / (1 - p))))
        f = np.full(len(y), out.base)
        for _ in range(trees):
            prob = 1 / (1 + np.exp(-f))
            grad, hess = weight * (y - prob), weight * prob * (1 - prob)
            nodes: dict[int, tuple] = {}

            def grow(node: int, at: np.ndarray, level: int) -> None:
                g, h = grad[at].sum(), hess[at].sum()  # noqa: B023
                best = (1e-6, -1, 0)
                if level < depth and len(at) >= 20:
                    for c, cuts in enumerate(edges):
                        if not len(cuts):
                            continue
                        gs = np.cumsum(np.bincount(bins[at, c], weights=grad[at], minlength=len(cuts) + 1))[:-1]  # noqa: B023
                        hs = np.cumsum(np.bincount(bins[at, c], weights=hess[at], minlength=len(cuts) + 1))[:-1]  # noqa: B023
                        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], c, k)
                if best[1] < 0:
                    nodes[node] = (-1, 0.0, rate * g / (h + 1))  # noqa: B023
                    f[at] += rate * g / (h + 1)
                    return
                _, c, k = best
                left = bins[at, c] <= k
                nodes[node] = (c, float(edges[c][k]), 0.0)  # noqa: B023
                grow(2 * node + 1, at[left], level + 1)
                grow(2 * node + 2, at[~left], level + 1)

            grow(0, np.arange(len(y)), 0)
            out.trees.append(nodes)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for nodes in self.trees:
            at = np.zeros(len(x), np.int64)
            col, cut, value = (np.zeros(max(nodes) + 1, t) for t in (np.int64, float, float))
            for k, (c, v, leaf) in nodes.items():
                col[k], cut[k], value[k] = c, v, leaf
            for _ in range(DEPTH):
                c = col[at]
                right = x[np.arange(len(x)), np.maximum(c, 0)] > cut[at]
                at = np.where(c >= 0, 2 * at + 1 + right, at)
            f += value[at]
        return f


def isotonic(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function of f that fits y best, by pooling adjacent violators."""
    order = np.argsort(f, kind="stable")
    f, y, weight = f[order], y[order], weight[order]
    blocks: list[list[float]] = []
    for a, b, w in zip(f, y, weight, strict=True):
        blocks.append([a, a, b * w, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, s, w2 = blocks.pop()
            blocks[-1][1] = hi
            blocks[-1][2] += s
            blocks[-1][3] += w2
    # half a case of each kind keeps the ends off 0 and 1
    xs = np.array([[b[0], b[1]] for b in blocks]).ravel()
    ps = np.repeat([(b[2] + 0.25) / (b[3] + 0.5) for b in blocks], 2)
    return xs, np.maximum.accumulate(ps)


@dataclass
class Model:
    share: float
    lexicon: Lexicon | None = None
    trees: Trees | None = None
    knots: tuple | None = None

    def score(self, data: np.ndarray, offs: np.ndarray, powers: K.Powers) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offs) - 1, self.share)
        return np.interp(self.trees.score(features(data, offs, self.lexicon, powers)), *self.knots)


def fit(texts: list[str], labels: list[int], share: float) -> Model:
    """share: of label 1 among all that may be learned from."""
    y = np.array(labels, dtype=np.int64)
    half = np.arange(len(y)) % 2 == 0
    if len(set(y[half])) < 2 or len(set(y[~half])) < 2:
        return Model(share)
    powers = K.Powers()
    own = lambda m: K.buffers(pa.array([t for t, ok in zip(texts, m, strict=True) if ok], pa.string()))
    lex = Lexicon.learn(Words.of(*own(half), powers), y[half])
    x, z = features(*own(~half), lex, powers), y[~half]
    weight = np.where(z == 1, share / z.mean(), (1 - share) / (1 - z.mean()))
    fold, f = np.arange(len(z)) // 2 % 5, np.zeros(len(z))
    for k in range(5):
        out = fold == k
        if len(set(z[~out])) == 2:
            f[out] = Trees.fit(x[~out], z[~out], weight[~out]).score(x[out])
    return Model(share, lex, Trees.fit(x, z, weight), isotonic(f, z.astype(float), weight))


def sample(docs: DataFrame, labels: DataFrame, may_learn: Column, per_class: int) -> tuple[list[str], list[int], float]:
    """Texts and labels, and the share of label 1 among all labelled rows that may be learned from."""
    marks = labels.where(may_learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row for each label
    share = n.get(1, 0) / max(n.get(1, 0) + n.get(0, 0), 1)
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40))
    bound = F.lit(0)
    for y, size in n.items():
        bound = F.when(F.col("y") == y, F.lit(int(min(1.0, 1.3 * per_class / size + 1e-9) * (1 << 40)))).otherwise(bound)
    # ids only; a little over the bound, which is then cut
    some = sorted((r["h"], r["doc_id"], r["y"]) for r in marks.where(h < bound).select(h.alias("h"), "doc_id", "y").collect())
    ids = [x[1:] for y in (0, 1) for x in [x for x in some if x[2] == y][:per_class]]
    picked = docs.sparkSession.createDataFrame(ids, f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, y int")
    # of rows with one id, the text that sorts first
    one = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = one.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").collect()  # 2 x per_class rows at most
    return [r["text"] or "" for r in rows], [r["y"] for r in rows], share


def score(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of label 1), predicted."""
    may_learn = crc(F.col("doc_id")) % 5 != 0 if may_learn is None else may_learn
    model = fit(*sample(docs, labels, may_learn, per_class))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select("doc_id", (~may_learn).alias("held_out"), F.col("text").alias("_text"))
    schema = T.StructType([*src.schema.fields[:2], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = K.Powers()
        for b in batches:
            data, offs = K.buffers(b.column(2))
            p = np.zeros(b.num_rows)
            for i, j in K.segments(offs):
                p[i:j] = shared.value.score(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], powers)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return src.mapInArrow(rows, schema)
