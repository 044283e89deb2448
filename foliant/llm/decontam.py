"""Benchmark decontamination with a distributed positional inverted index.

build_index() cuts every training text into words and stores, segment by
segment, the sorted terms (64-bit hashes) and for each term its ascending list
of positions. search() holds a stated set of phrases against each stored
segment: the phrases whose terms all occur start from their rarest term, the
offset-adjusted lists of the next rarer terms are intersected with it one by
one, and what remains are exact phrase matches. proximity() lets each term
behind the first stand up to `slop` words off its place. A match lies within
one document.

Scale: documents stay where they are (an index sharded by document needs no
shuffle), one row of the index holds at most TEXT bytes of text or one
longer text, and the phrases are sent out in blocks of at most `block`
bytes of benchmark text, one pass over the index for each block.

Edge cases: a null or empty text has no words; a null doc_id stays null; rows
with the same doc_id are judged one by one; an empty table gives no rows; a
null item_id marks words as hit but is not listed; repeated items are listed
once. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import scratch, written

INDEX = "seg string, doc_id array<bigint>, n_words array<int>, terms binary, ends binary, positions binary"
#: Bytes of text in a row of the index (or one longer text), and rows that are in hand at once: writers of tables hold a hundred rows.
TEXT, SEGMENTS = 250_000, 16
MATCHES = "seg string, ord int, doc_id bigint, n_words bigint, spans array<int>, items array<string>"


def _words(data: np.ndarray, offs: np.ndarray, powers: K.Powers) -> tuple[np.ndarray, np.ndarray]:
    _, _, row, h = K.word_hashes(data, offs, K.alnum_class(), K.byte_values(), powers)
    return row, h


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of all texts, a table in the shared folder."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, part, n = K.Powers(), TaskContext.get().partitionId(), 0
        for b in batches:
            data, offs = K.buffers(b.column(1))
            for i, j in K.segments(offs, TEXT):
                row, h = _words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], powers)
                order = np.argsort(h, kind="stable")
                terms, first = np.unique(h[order], return_index=True)
                ends = np.append(first[1:], len(h)).astype(np.uint32) if len(terms) else np.zeros(0, np.uint32)
                counts = np.bincount(row, minlength=j - i).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{part}-{n}"]),
                        pa.array([b.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                        pa.array([counts], pa.list_(pa.int32())),
                        pa.array([terms.tobytes()], pa.binary()),
                        pa.array([ends.tobytes()], pa.binary()),
                        pa.array([order.astype(np.uint32).tobytes()], pa.binary()),
                    ],
                    ["seg", "doc_id", "n_words", "terms", "ends", "positions"],
                )
                n += 1

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(segments, INDEX), "postings")


def phrases(texts: list[tuple[str | None, str | None]], window: int) -> dict | None:
    """The distinct windows of some items: term numbers by offset (-1 behind a short one), sorted terms, the items of each window."""
    data, offs = K.buffers(pa.array([t for _, t in texts], pa.string()))
    row, h = _words(data, offs, K.Powers())
    n = np.bincount(row, minlength=len(texts))
    if not len(h):
        return None
    first = np.cumsum(n) - n
    here = np.minimum(n, window)
    wins = np.where(n > 0, n - here + 1, 0)
    item = np.repeat(np.arange(len(texts)), wins)
    start = first[item] + np.arange(wins.sum()) - np.repeat(np.cumsum(wins) - wins, wins)
    terms, num = np.unique(h, return_inverse=True)
    at = np.arange(window)
    grid = np.where(at < here[item][:, None], num[np.minimum(start[:, None] + at, len(h) - 1)], -1).astype(np.int32)
    grid, same = np.unique(grid, axis=0, return_inverse=True)
    owner = np.unique(np.stack([same.ravel(), item], 1), axis=0)
    ids = [i for i, _ in texts]
    return {"terms": terms, "grid": grid, "item": owner[:, 1], "ends": np.searchsorted(owner[:, 0], np.arange(len(grid) + 1)), "ids": ids}


def intersect(q: dict, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray, n_words: np.ndarray, slop: int = 0, at_once: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, first positions) of the matches in one segment of the index, a bounded part at a time.

    A match lies within one document: its first term stands at the position,
    each other term at most slop words off its place behind it.
    """
    if not len(terms):
        return
    stop = np.cumsum(n_words)
    slot = np.minimum(np.searchsorted(terms, q["terms"]), len(terms) - 1)
    slot = np.where(terms[slot] == q["terms"], slot, -1)
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size = ends.astype(np.int64) - begin
    df = np.where(slot >= 0, size[slot], 0)
    wide = np.iinfo(np.int64).max
    length = np.where(q["grid"] >= 0, df[q["grid"]], wide)
    alive = np.flatnonzero((length > 0).all(axis=1))
    if not len(alive):
        return
    grid, length = q["grid"][alive], length[alive]
    rare = np.argsort(length, axis=1, kind="stable")
    n_terms = (grid >= 0).sum(axis=1)
    # one sorted array of (term, position): every posting list, end to end
    lists = (np.repeat(np.arange(len(terms), dtype=np.uint64), size) << np.uint64(32)) | positions.astype(np.uint64)

    def near(t: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether term t stands somewhere from low to high."""
        want = (t.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
        at = np.minimum(np.searchsorted(lists, want), len(lists) - 1)
        return (high >= low) & (lists[at] >= want) & (lists[at] <= want + np.maximum(high - low, 0).astype(np.uint64))

    # the windows' rarest lists end to end, cut into parts wherever a part is full
    most = length[np.arange(len(alive)), rare[:, 0]]
    total = np.cumsum(most)
    for i in range(0, int(total[-1]), at_once):
        k = np.arange(i, min(i + at_once, int(total[-1])))
        w = np.searchsorted(total, k, "right")
        r = positions[begin[slot[grid[w, rare[w, 0]]]] + k - (total[w] - most[w])].astype(np.int64)
        d = np.searchsorted(stop, r, "right")
        lo, hi = stop[d] - n_words[d], stop[d] - 1
        p = r - rare[w, 0]
        if slop:  # the rarest term may stand off its place: every place of the first term about it
            shift = np.where(rare[w, 0] > 0, slop, 0)
            copies = 2 * shift + 1
            p = np.repeat(p - shift, copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            w, lo, hi = np.repeat(w, copies), np.repeat(lo, copies), np.repeat(hi, copies)
        ok = (p >= lo) & (p <= hi)
        w, p, lo, hi = w[ok], p[ok], lo[ok], hi[ok]
        if slop:
            ok = near(slot[grid[w, 0]], p, p)
            w, p, lo, hi = w[ok], p[ok], lo[ok], hi[ok]
            if len(w):
                _, one = np.unique((w << 32) | p, return_index=True)
                w, p, lo, hi = w[one], p[one], lo[one], hi[one]
        for j in range(0 if slop else 1, grid.shape[1]):
            if not len(w):
                break
            off = rare[w, j]
            more = j < n_terms[w]
            shift = np.where(off > 0, slop, 0)
            ok = ~more | near(np.where(more, slot[grid[w, off]], 0), np.maximum(p + off - shift, lo), np.minimum(p + off + shift, hi))
            w, p, lo, hi = w[ok], p[ok], lo[ok], hi[ok]
        if len(w):
            yield alive[w], p


def _matched(index: DataFrame, q: dict | None, slop: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(q)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            for r in range(b.num_rows):
                seg, ids, n = b.column(0)[r].as_py(), b.column(1)[r].values, np.asarray(b.column(2)[r].values, dtype=np.int64)
                first, stop = np.cumsum(n) - n, np.cumsum(n)
                spans: list = [[]] * len(n)
                items: list = [[]] * len(n)
                if q is not None and n.sum():
                    terms, ends, pos = (np.frombuffer(b.column(c)[r].as_buffer(), dtype=t) for c, t in ((3, np.uint64), (4, np.uint32), (5, np.uint32)))
                    # matches become marks of words and pairs (document, window) at once: neither grows with their number
                    step, pairs = np.zeros(n.sum() + 1, np.int64), np.zeros(0, np.int64)
                    for w, p in intersect(q, terms, ends, pos, n, slop):
                        d = np.searchsorted(stop, p, "right")
                        step += np.bincount(p, minlength=len(step)) - np.bincount(np.minimum(p + (q["grid"][w] >= 0).sum(axis=1), stop[d]), minlength=len(step))
                        pairs = np.union1d(pairs, d * len(q["grid"]) + w)
                    hit = np.cumsum(step[:-1]) > 0
                    for d in np.unique(pairs // len(q["grid"])):
                        edge = np.diff(np.concatenate([[0], hit[first[d] : stop[d]].astype(np.int8), [0]]))
                        spans[d] = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel()
                        wins = pairs[np.searchsorted(pairs, d * len(q["grid"])) : np.searchsorted(pairs, (d + 1) * len(q["grid"]))] - d * len(q["grid"])
                        own = {q["ids"][i] for a, z in zip(q["ends"][wins], q["ends"][wins + 1], strict=True) for i in q["item"][a:z]}
                        items[d] = sorted(own - {None})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([seg] * len(n), pa.string()),
                        pa.array(np.arange(len(n), dtype=np.int32)),
                        ids,
                        pa.array(n),
                        pa.array(spans, pa.list_(pa.int32())),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    ["seg", "ord", "doc_id", "n_words", "spans", "items"],
                )

    # a row of the index is a whole segment
    return written(index.mapInArrow(rows, MATCHES), "matches", SEGMENTS, keep=True)


def search(index: DataFrame, items: DataFrame, window: int = 13, slop: int = 0, block: int = 4_000_000) -> DataFrame:
    """Per document of the index: its words, the merged [start, end) word spans that some phrase covers, the items found.

    A phrase is each run of `window` words of an item, or the whole item where
    it has fewer. slop = 0 asks for exact phrases, more for proximity matches.
    """
    passes, texts, size = [], [], 0
    for r in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        texts.append((r[0], r[1]))
        size += len((r[1] or "").encode()) + 16
        if size >= block:
            passes.append(_matched(index, phrases(texts, window), slop))
            texts, size = [], 0
    if texts or not passes:
        passes.append(_matched(index, phrases(texts, window), slop))
    if len(passes) == 1:
        return passes[0]
    found = passes[0]
    for x in passes[1:]:
        found = found.unionByName(x.where("size(items) > 0 OR size(spans) > 0"))
    return found.groupBy("seg", "ord").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )


def proximity(index: DataFrame, items: DataFrame, window: int = 13, slop: int = 3, block: int = 4_000_000) -> DataFrame:
    """Like search(), for phrases each of whose terms behind the first may stand up to slop words off its place."""
    return search(index, items, window, slop, block)


def covered(spans: Column) -> Column:
    """Number of words in a union of [start, end) spans, given end to end in one array of ints."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(spans) / 2).cast("int") - 1), lambda i: F.struct(F.get(spans, i * 2).alias("s"), F.get(spans, i * 2 + 1).alias("e"))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("e"))
    folded = F.aggregate(
        pairs,
        start,
        lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["e"]), F.lit(0))).cast("bigint").alias("n"), F.greatest(a["e"], x["e"]).alias("e")),
        lambda a: a["n"],
    )
    return F.when(F.size(spans) > 0, folded).otherwise(F.lit(0).cast("bigint"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, block: int = 4_000_000) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated (share * n_hit >= n_words, some hit)."""
    with scratch(docs.sparkSession):  # the index isn't needed behind the matches
        found = search(build_index(docs), items, window, 0, block)
    return found.select(
        "doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), F.array_sort("items").alias("items")
    ).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The documents, all their columns, of which phrases cover neither `window` words in a row nor one of `share` words.

    So a whole window taken from an item condemns a text of any length, a
    shorter item only a text of which it is much. The verdict is the text's,
    whatever the id.
    """
    key = F.xxhash64(docs["text"])
    with scratch(docs.sparkSession):
        found = search(build_index(docs.select(key.alias("doc_id"), "text")), items, window)
    pairs = F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1)
    run = (F.size("spans") > 0) & F.exists(pairs, lambda i: F.get("spans", i * 2 + 1) - F.get("spans", i * 2) >= window)
    n = covered(F.col("spans"))
    # written, so that its size is known before the join: small, it is sent to the documents; else both are shuffled
    bad = written(found.where(run | ((n > 0) & (share * n >= F.col("n_words")))).select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    return docs.join(bad, key == bad["_bad"], "left_anti")


#: The same rows in DuckDB, over views documents and benchmark.
SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k
  FROM iw, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS g(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
keys AS (SELECT DISTINCT n, k FROM wins),
cand AS (
  SELECT r, s.n, i, array_to_string(w[i:i + s.n - 1], ' ') AS k
  FROM dw, sizes s, unnest(generate_series(1, len(w) - s.n + 1)) AS g(i) WHERE len(w) >= s.n),
occ AS (SELECT a.r, a.n, a.i, a.k FROM cand a JOIN keys USING (n, k)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM occ, unnest(generate_series(i, i + n - 1)) AS g(p) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT o.r, w.item FROM occ o JOIN wins w USING (n, k) WHERE w.item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""
