"""Language ID by unigrams of a fixed public vocabulary, marginalised over all segmentations.

Each language has its own probability for every piece of the vocabulary. The
probability of a word is the sum, over all ways to cut it into pieces, of the
products of their probabilities; a forward pass over the word's bytes computes
it. Pieces that begin a word are marked in the vocabulary, no piece crosses
white space or ASCII punctuation, and any byte may stand alone, so every text has a
probability. Expectation-maximisation fits the probabilities. A text's
languages are weighed by the product over its words.

Fit: on at most `per_lang` texts of each language, chosen by a hash of id and
text among the rows that may be learned from (a bounded sample, on the driver).
Score: every whole text, in Python workers, one batch at a time; each distinct
word of a batch is passed once. The model that is sent out has a bounded size,
pieces x languages.

Edge cases: a null text, or one without a letter, is `und` with score 0; rows
with a null lang are not learned from; with nothing to learn from, all rows
are `und`; ties go to the language that sorts first. Words of any length, as of
scripts without spaces, are learned from and scored whole. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SLOTS = 20
#: Bytes of a word whose sums are held at once; a longer word is passed in slices of so many.
SLICE = 200_000


def crc(col: Column) -> Column:
    """CRC-32 of an id as text; of an empty text for a null."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def pieces(path: str = VOCABULARY) -> list[tuple[bool, bytes]]:
    """(begins a word, bytes) of each distinct piece, ASCII letters lower-cased; single bytes among them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {(False, bytes([b])): None for b in range(256)}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        p = sp.id_to_piece(i)
        start, p = p.startswith("▁"), p.lstrip("▁").encode()
        p = bytes(b + 32 if 65 <= b <= 90 else b for b in p)
        if p:
            out[start, p] = None
    return list(out)


def digests(strings: list[bytes]) -> np.ndarray:
    data, offs = K.buffers(pa.array(strings, pa.binary()))
    powers = K.Powers()
    return K.span_hash(K.prefix(data, K.byte_values(), powers), offs[:-1], offs[1:], powers)


@dataclass
class Lookup:
    """Piece numbers by hash: a table addressed by the top bits, with as many layers as its fullest slot needs."""

    hashes: np.ndarray
    layers: list[np.ndarray]

    @classmethod
    def of(cls, hashes: np.ndarray) -> Lookup:
        slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        s = slot[order]
        rank = np.arange(len(s)) - np.searchsorted(s, s, "left")
        layers = []
        for r in range(int(rank.max()) + 1 if len(s) else 0):
            t = np.full(1 << SLOTS, -1, np.int32)
            t[s[rank == r]] = order[rank == r]
            layers.append(t)
        return cls(hashes, layers)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        for t in self.layers:
            c = t[slot]
            hit = c >= 0
            at = np.flatnonzero(hit)
            ok = self.hashes[c[at]] == h[at]
            out[at[ok]] = c[at[ok]]
        return out


@dataclass
class Vocabulary:
    first: Lookup
    inner: Lookup
    n_first: int
    n: int  # pieces: those that begin a word, the others, and the bare word mark
    sizes: list[int]  # in bytes, of the pieces that can stand in a word

    @property
    def longest(self) -> int:
        return self.sizes[-1]


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    all_ = pieces(path)
    a, b = [p for s, p in all_ if s], [p for s, p in all_ if not s]
    kind = K.alnum_class()
    sizes = sorted({len(p) for _, p in all_ if kind[np.frombuffer(p, np.uint8)].all()})
    return Vocabulary(Lookup.of(digests(a)), Lookup.of(digests(b)), len(a), len(a) + len(b) + 1, sizes)


def word_cuts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as runs of letters, digits and non-ASCII bytes."""
    return K.cut(data, offs, K.alnum_class())


@dataclass
class Lattice:
    """All pieces in some words: word, start and end within it, and piece; sorted by end."""

    word: np.ndarray
    s: np.ndarray
    e: np.ndarray
    piece: np.ndarray
    marked: np.ndarray  # at a word's start without the word mark in the piece
    size: np.ndarray

    longest: int

    @classmethod
    def of(cls, data: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray, v: Vocabulary, powers: K.Powers, begins: bool = True) -> Lattice:
        """begins: whether the words begin at s, rather than being cut there."""
        size = e - s
        word = np.repeat(np.arange(len(s), dtype=np.int32), size)
        within = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int64)
        left = np.repeat(size, size) - within
        at = np.repeat(s, size) + within
        parts = []
        for n in v.sizes:
            ok = np.flatnonzero(left >= n)
            if not len(ok):
                break
            g = K.span_hash(h, at[ok], at[ok] + n, powers)
            p = v.inner.find(g)
            hit = p >= 0
            parts.append((word[ok[hit]], within[ok[hit]], within[ok[hit]] + n, p[hit] + v.n_first, (within[ok[hit]] == 0) & begins))
            if not begins:
                continue
            top = within[ok] == 0
            p = v.first.find(g[top])
            hit = p >= 0
            w = ok[top][hit]
            parts.append((word[w], within[w], within[w] + n, p[hit], np.zeros(len(w), bool)))
        w, a, b, p, m = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(b, kind="stable")
        return cls(w[order], a[order], b[order], p[order], m[order], size, v.longest)

    def weights(self, prob: np.ndarray) -> np.ndarray:
        """Probability of each edge; prob: (pieces, languages)."""
        x = prob[self.piece]
        x[self.marked] *= prob[-1]
        return x

    def forward(self, prob: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled sums (words, positions, languages), the log of the scale, and log probabilities (words, languages).

        before: the sums of the first positions, where they are known; else a word begins with 1.
        """
        n, k, top = len(self.size), prob.shape[1], int(self.size.max(initial=0))
        x = self.weights(prob)
        # keeps the sums near 1; renewed as often as the longest piece
        a, log = np.zeros((n, top + 1, k)), np.zeros((n, k))
        known = 1 if before is None else before.shape[1]
        a[:, :known] = 1 if before is None else before
        out = np.zeros((n, k))
        bound = np.searchsorted(self.e, np.arange(top + 2))
        for e in range(known, top + 1):
            i = slice(bound[e], bound[e + 1])
            w = self.word[i]
            for c in range(k):
                a[:, e, c] = np.bincount(w, weights=a[w, self.s[i], c] * x[i, c], minlength=n)
            done = self.size == e
            out[done] = np.log(a[done, e]) + log[done]
            if e % self.longest == 0 and e < top:
                live = np.flatnonzero(self.size > e)
                scale = a[live, e]
                a[live, max(0, e - self.longest) : e + 1] /= scale[:, None]
                log[live] += np.log(scale)
        return a, log, out


def long_word(data: np.ndarray, h: np.ndarray, s: int, e: int, v: Vocabulary, prob: np.ndarray, powers: K.Powers, piece: int = SLICE) -> np.ndarray:
    """Log probabilities (languages) of one word, slice by slice: the sums of the last positions go on."""
    total, before = np.zeros(prob.shape[1]), None
    at = s
    while at < e:
        back = 0 if before is None else before.shape[1] - 1
        stop = min(at + piece, e)
        lat = Lattice.of(data, h, np.array([at - back]), np.array([stop]), v, powers, before is None)
        a, log, _ = lat.forward(prob, before)
        last = a[:, max(0, a.shape[1] - 1 - v.longest) :]
        total += log[0] + np.log(last[0, -1])
        before = last / last[:, -1:]
        at = stop
    return total


def fit(texts: list[str], langs: list[str], v: Vocabulary, names: list[str], rounds: int = 4, smooth: float = 0.05, at_once: int = 1_000_000) -> np.ndarray:
    """(pieces, languages) probabilities by expectation-maximisation over all segmentations of the words."""
    powers, data_offs = K.Powers(), K.buffers(pa.array(texts, pa.string()))
    data, offs = data_offs
    h = K.prefix(data, K.byte_values(), powers)
    s, e, row = word_cuts(data, offs)
    which = np.array([names.index(x) for x in langs])[row]
    key = K.span_hash(h, s, e, powers)
    _, one, inv = np.unique(key, return_index=True, return_inverse=True)
    count = np.zeros((len(one), len(names)))
    np.add.at(count, (inv, which), 1)
    # words of like length in parts, so that their sums stay small
    order, parts = np.argsort((e - s)[one], kind="stable"), []
    while len(order):
        n = min(len(order), 10_000)
        while n > 1 and n * int((e - s)[one[order[n - 1]]]) > at_once:
            n //= 2
        parts.append(order[:n])
        order = order[n:]
    prob = np.full((v.n, len(names)), 1.0 / v.n)
    for _ in range(rounds):
        new = np.zeros_like(prob)
        for i in parts:
            new += expected(Lattice.of(data, h, s[one[i]], e[one[i]], v, powers), prob, count[i])
        prob = (new + smooth) / (new + smooth).sum(axis=0)
    return prob


def expected(lat: Lattice, prob: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(pieces, languages) expected numbers of pieces over all segmentations; count: (words, languages).

    Sums are kept as logarithms, each computed relative to its neighbour's, so words of any length have them.
    """
    n, k, top = len(lat.size), prob.shape[1], int(lat.size.max(initial=0))
    x, word = lat.weights(prob), lat.word
    a, b = np.zeros((n, top + 1, k)), np.zeros((n, top + 1, k))
    grown = lambda z: np.exp(np.minimum(z, 700))

    def step(i: np.ndarray | slice, sums: np.ndarray, other: np.ndarray, at: int, near: int) -> None:
        """The sums at one position, from the edges i to or from it."""
        w = word[i]
        y = grown(sums[w, other[i]] - sums[w, near]) * x[i]
        rows = np.unique(w)
        for c in range(k):
            sums[rows, at, c] = sums[rows, near, c] + np.log(np.bincount(w, weights=y[:, c], minlength=n)[rows])

    bound = np.searchsorted(lat.e, np.arange(top + 2))
    for end in range(1, top + 1):
        step(slice(bound[end], bound[end + 1]), a, lat.s, end, end - 1)
    by_start = np.argsort(lat.s, kind="stable")
    bound = np.searchsorted(lat.s[by_start], np.arange(top + 2))
    for start in range(top - 1, -1, -1):
        step(by_start[bound[start] : bound[start + 1]], b, lat.e, start, start + 1)
    total = a[np.arange(n), lat.size]
    out = np.zeros_like(prob)
    for c in range(k):
        soft = grown(a[word, lat.s, c] + b[word, lat.e, c] - total[word, c]) * x[:, c] * count[word, c]
        out[:, c] = np.bincount(lat.piece, weights=soft, minlength=len(prob))
        out[-1, c] = soft[lat.marked].sum()
    return out


def log_probabilities(data: np.ndarray, offs: np.ndarray, v: Vocabulary, prob: np.ndarray, powers: K.Powers, at_once: int = 20_000, piece: int = SLICE) -> np.ndarray:
    """(texts, languages) log probabilities of whole texts."""
    out = np.zeros((len(offs) - 1, prob.shape[1]))
    s, e, row = word_cuts(data, offs)
    if not len(s):
        return out
    h = K.prefix(data, K.byte_values(), powers)
    key = K.span_hash(h, s, e, powers)
    _, one, inv = np.unique(key, return_index=True, return_inverse=True)
    one = one[order := np.argsort((e - s)[one], kind="stable")]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    score = np.empty((len(one), prob.shape[1]))
    i = 0
    while i < len(one):  # words of like length together, so many that their sums fit
        j = min(len(one), i + at_once)
        while (j - i) * int((e - s)[one[j - 1]]) > 2 * piece and j - i > 1:
            j = i + (j - i) // 2
        if (e - s)[one[i]] > piece:
            score[i] = long_word(data, h, int(s[one[i]]), int(e[one[i]]), v, prob, powers, piece)
            i += 1
            continue
        score[i:j] = Lattice.of(data, h, s[one[i:j]], e[one[i:j]], v, powers).forward(prob)[2]
        i = j
    word = back[inv]
    for c in range(prob.shape[1]):
        out[:, c] = np.bincount(row, weights=score[word, c], minlength=len(out))
    return out


def sample(docs: DataFrame, may_learn: Column, per_lang: int) -> list[tuple[str, str]]:
    """(lang, text) of at most per_lang different rows of each language, by a hash of id and text."""
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # of id and text, so that rows without an id are as rare in the sample as others; repeated rows count once
    h = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), F.lit(1 << 30))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    share = F.lit(0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], F.lit(int(min(1.0, 1.3 * per_lang / r["n"] + 1e-9) * (1 << 30)))).otherwise(share)
    got: dict[str, int] = {}
    out = []
    some = rows.where(h < share).groupBy("lang", h.alias("h")).agg(F.min("text").alias("text")).collect()  # about 1.3 x per_lang rows of each language
    for r in sorted(some, key=lambda r: (r["h"], r["text"])):
        if got.get(r["lang"], 0) < per_lang:
            got[r["lang"]] = got.get(r["lang"], 0) + 1
            out.append((r["lang"], r["text"]))
    return out


def model(docs: DataFrame, may_learn: Column, per_lang: int, vocabulary_path: str) -> tuple:
    """(vocabulary, probabilities, languages) to send out."""
    rows = sample(docs, may_learn, per_lang)
    names = sorted({x for x, _ in rows})
    v = vocabulary(vocabulary_path)
    return v, fit([t for _, t in rows], [x for x, _ in rows], v, names) if names else np.zeros((v.n, 0)), names


def posteriors(text: pa.Array, letter: np.ndarray, shared: tuple, powers: K.Powers) -> tuple[list[str], np.ndarray]:
    """Language and its posterior of every text."""
    v, prob, names = shared
    data, offs = K.buffers(text)
    best, p = np.zeros(len(text), np.int64), np.zeros(len(text))
    if names:
        for i, j in K.segments(offs):
            x = log_probabilities(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], v, prob, powers)
            best[i:j] = x.argmax(axis=1)
            p[i:j] = 1 / np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)
    known = letter & bool(names)
    return [names[k] if ok else "und" for k, ok in zip(best, known, strict=True)], np.where(known, p, 0.0)


def letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, may_learn: Column | None = None, per_lang: int = 200, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, held_out (not learned from), lang_pred, score (the language's posterior)."""
    may_learn = (crc(F.col("doc_id")) % 4 != 2) if may_learn is None else may_learn
    shared = docs.sparkSession.sparkContext.broadcast(model(docs, may_learn, per_lang, vocabulary_path))
    src = docs.select("doc_id", (~may_learn).alias("held_out"), letters(F.col("text")).alias("_letter"), F.col("text").alias("_text"))
    schema = T.StructType([*src.schema.fields[:2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = K.Powers()
        for b in batches:
            label, p = posteriors(b.column(3), b.column(2).to_numpy(zero_copy_only=False).astype(bool), shared.value, powers)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(label, pa.string()), pa.array(p)], ["doc_id", "held_out", "lang_pred", "score"])

    return src.mapInArrow(score, schema)


def recognised(docs: DataFrame, least: float = 0.5, may_learn: Column | None = None, per_lang: int = 200, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """The documents, all their columns, whose text has a language with a posterior of at least `least`."""
    may_learn = (crc(F.col("doc_id")) % 4 != 2) if may_learn is None else may_learn
    shared = docs.sparkSession.sparkContext.broadcast(model(docs, may_learn, per_lang, vocabulary_path))
    names = docs.columns
    at = names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = K.Powers()
        for b in batches:
            cols = b.column(0).flatten()
            label, p = posteriors(cols[at], b.column(1).to_numpy(zero_copy_only=False).astype(bool), shared.value, powers)
            ok = pa.array([x != "und" and y >= least for x, y in zip(label, p, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, names).filter(ok)

    # the row as one value, so that no column's name meets ours
    row = F.struct(*(docs[c] for c in names))
    return docs.select(row.alias("_row"), letters(docs["text"]).alias("_letter")).mapInArrow(keep, docs.schema)
