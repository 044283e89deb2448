"""Suffix-array dedup: remove every byte that a repeated string of `length` bytes covers, and count those that one of `least` bytes covers.

Two equal strings of the smaller size hold the same smallest k-mer at the same
place, so every start of such a string belongs to one anchor, the place of that
k-mer, and only starts whose anchors have equal k-mers can be equal. An anchor
with its run of starts and the bytes they span is a context. Contexts that are
equal as a whole repeat in whole; the others of an anchor k-mer are compared by
the difference-cover algorithm: in blocks of whole groups of contexts, triples
at the places that are 1 or 2 modulo 3 are sorted and named, the string of
names is sorted by recursion (down to the depth that `length` needs), the
remaining suffixes are sorted by their first symbol and the rank behind it and
merged, and adjacent suffixes are compared over `least` and then `length` bytes.

So the suffix array is distributed by content: no repeat is lost, and only the
surroundings of anchors that occur more than once are sorted at all.

Scale: texts are shuffled twice, once to fetch the bytes of contexts to be
compared, once to cut. Anchors (about one for each 170 bytes) are counted with
partial aggregation, and only those whose k-mer occurs twice go on. The
contexts of a k-mer that has more than GROUP different ones are cut into pieces
by the offset of a start from its anchor; equal pieces are aggregated before
they are dealt out, and the others are grouped by the bytes that all strings of
a piece share, so a large group of near copies spreads over many tasks. Where
more than CROWD different pieces share these bytes too, their starts go one by
one, so no group has to fit in a block.

Edge cases: a null or empty text has no bytes; texts shorter than `length` keep
all, and those shorter than `least` share nothing; equal texts count as often as they occur; a null doc_id stays null;
removal may cut inside a character, so what is left is bytes. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import scratch, written

LENGTH, KMER = 400, 64
#: Bytes of a repeat that is counted but not removed: about 40 words, so that a passage of 50 words is one.
LEAST = 256
#: Different contexts of one k-mer that one block sorts; bytes of a block, bounded so that three names fit in 64 bits.
GROUP, BLOCK = 1000, 1_200_000
#: Starts of a piece of a context whose group is larger.
RUN = 64
#: Pieces with one core that a block sorts; beyond, each start goes by itself.
CROWD = 2000


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every run of `width` values."""
    n = len(x) - width + 1
    out = x.copy()
    step = 1
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[:n], out[width - step : width - step + n])


def anchors(data: np.ndarray, h: np.ndarray, length: int, least: int, kmer: int, powers: K.Powers) -> tuple[np.ndarray, ...]:
    """(place, first start, last start, end of the context, k-mer hash, context hash) of every anchor of one text."""
    n = len(data)
    starts = np.arange(n - kmer + 1)
    g = K.span_hash(h, starts, starts + kmer, powers)
    # the leftmost of equal k-mers: the place in the low bits, by blocks of 2**24 places
    parts = []
    base = 0
    most = 1 << 24
    while base <= n - least:
        top = min(base + most - (least - kmer), n - least + 1)  # starts of this block
        local = g[base : top + least - kmer]
        key = (local & ~np.uint64(most - 1)) | np.arange(len(local), dtype=np.uint64)
        parts.append((sliding_min(key, least - kmer + 1) & np.uint64(most - 1)).astype(np.int64) + base)
        base = top
    place = np.concatenate(parts)
    edge = np.flatnonzero(np.diff(place)) + 1
    a = np.concatenate([[0], edge])
    b = np.concatenate([edge, [len(place)]]) - 1
    p, e = place[a], np.minimum(b + length, n)
    # a context that its text's end cuts short isn't equal to one that goes on
    c = K.mix(K.span_hash(h, a, e, powers) + (p - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (e - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return p, a, b, e, g[p], c


def cover_ranks(t: np.ndarray, depth: int, span: int = 1, need: np.ndarray | None = None) -> np.ndarray:
    """Ranks (how many of the needed suffixes are smaller) of the needed suffixes of t, 0 for others; suffixes that agree
    over `depth` bytes or more may share a rank. Symbols of t are 1 or more and stand for `span` bytes each."""
    n = len(t)
    need = np.ones(n, bool) if need is None else need
    if n < 3:
        return np.array([sum(tuple(t[j:]) < tuple(t[i:]) for j in range(n)) for i in range(n)], np.int64)
    s = np.concatenate([t.astype(np.int64), np.zeros(4, np.int64)])
    base = int(s.max()) + 1
    m = n + (n % 3 == 1)  # one more place where the last triple needs a terminator
    one, two, zero = np.arange(1, m, 3), np.arange(2, m, 3), np.arange(0, n, 3)
    at = np.concatenate([one, two])
    if base * base * (n + 6) >= 1 << 62:  # three names don't fit in 64 bits: name pairs first
        _, pair = np.unique(s[:-1] * base + s[1:], return_inverse=True)
    else:
        pair = s[:-1] * base + s[1:]
    key = pair[at] * base + s[at + 2]
    order = np.argsort(key)
    new = np.concatenate([[True], np.diff(key[order]) > 0])
    names = np.empty(len(at), np.int64)
    names[order] = np.cumsum(new)
    if new.all() or 3 * span >= depth:
        r = names
    else:
        # a suffix is compared by itself or by the ranks of the two behind it
        behind = np.concatenate([need, np.zeros(4, bool)])
        behind[1:] |= behind[:-1].copy()
        behind[1:] |= behind[:-1].copy()
        r = cover_ranks(names, depth, 3 * span, behind[at]) + 1
    rank = np.zeros(n + 4, np.int64)
    rank[at] = r
    rank[n:] = 0
    one, two = one[one < n], two[two < n]
    one, two, zero = one[need[one]], two[need[two]], zero[need[zero]]
    wide = n + 6
    near = lambda i: s[i] * wide + rank[i + 1]
    far = lambda i: pair[i] * wide + rank[i + 2]
    # queries in ascending order keep the binary searches near each other
    zn, zf, on, tf, r12 = near(zero), far(zero), near(one), far(two), rank[np.concatenate([one, two])]
    ozn, ozf, oon, otf = (np.argsort(x) for x in (zn, zf, on, tf))
    szn, szf, son, stf, rest = zn[ozn], zf[ozf], on[oon], tf[otf], np.sort(r12)
    less = lambda a, x: np.searchsorted(a, x, "left")
    n0, n1, n2 = (np.zeros(len(x), np.int64) for x in (zero, one, two))
    n0[ozn] = less(szn, szn) + less(son, szn)
    n0[ozf] += less(stf, szf)
    n1[oon] = less(szn, son) + less(rest, rank[one[oon]])
    n2[otf] = less(szf, stf) + less(rest, rank[two[otf]])
    out = np.zeros(n, np.int64)
    out[zero], out[one], out[two] = n0, n1, n2
    return out


def repeated(t: np.ndarray, starts: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each of the ascending lengths, which starts begin a string of so many symbols that another start begins too."""
    need = np.zeros(len(t), bool)
    need[starts] = True
    order = np.argsort(cover_ranks(t, lengths[-1], need=need)[starts], kind="stable")
    p = starts[order]
    # seven symbols of 9 bits in a word; what lies behind the end is 0
    padded = np.concatenate([t, np.zeros(lengths[-1] + 7, t.dtype)])
    packed = np.zeros(len(t) + lengths[-1], np.uint64)
    for k in range(7):
        packed = (packed << np.uint64(9)) | padded[k : k + len(packed)].astype(np.uint64)
    live, done, out = np.arange(max(len(p) - 1, 0)), 0, []
    for length in lengths:
        for off in [*range(done, length - 6, 7), length - 7]:
            if not len(live):
                break
            live = live[packed[p[live] + off] == packed[p[live + 1] + off]]
        done = length
        hit = np.zeros(len(p), bool)
        hit[live] = hit[live + 1] = True
        back = np.empty(len(p), bool)
        back[order] = hit
        out.append(back)
    return out


OCCURRENCES = "tk binary, p int, a int, b int, e int, h bigint, c bigint"


def occurrences(src: DataFrame, length: int, least: int, kmer: int) -> DataFrame:
    """One row per anchor of every text; src: (tk, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, values = K.Powers(), np.array([K.mix(np.arange(1, 257, dtype=np.uint64))])[0]
        for b in batches:
            data, offs = K.buffers(b.column(1))
            for i, j in K.segments(offs, 1_000_000):
                part = data[offs[i] : offs[j]]
                h = K.prefix(part, values, powers)
                got, who = [], []
                for r in range(i, j):
                    lo, hi = offs[r] - offs[i], offs[r + 1] - offs[i]
                    if hi - lo >= least:
                        own = K.prefix(part[lo:hi], values, powers) if r > i else h[: hi - lo + 1]
                        got.append(anchors(part[lo:hi], own, length, least, kmer, powers))
                        who += [r] * len(got[-1][0])
                if got:
                    p, a, z, e, g, c = (np.concatenate(x) for x in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(who)), *(pa.array(x.astype(np.int32)) for x in (p, a, z, e)), pa.array(g.view(np.int64)), pa.array(c.view(np.int64))],
                        ["tk", "p", "a", "b", "e", "h", "c"],
                    )

    return src.mapInArrow(rows, OCCURRENCES)


CONTEXTS = "h bigint, sub bigint, pk bigint, c bigint, single boolean, i0 int, starts int, content binary"


def pieces(text: bytes, p: int, a: int, b: int, length: int, least: int, run: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(sub, i0, starts, bytes) of a context cut into runs of starts by their offset from the anchor.

    All strings of a run hold the bytes between its last start and its first
    end; sub is a hash of these and of the run, so equal strings share it.
    """
    i = a
    while i <= b:
        k = (p - i) // run
        j = min(b, p - k * run)  # the last start of this run
        core = text[p - k * run : p - k * run - run + 1 + least]  # the same place for all contexts, whichever starts they have
        sub = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=k.to_bytes(8, "big")).digest(), "big", signed=True)
        yield sub, i - a, j - i + 1, text[i : j + length]
        i = j + 1


def contexts(wanted: DataFrame, length: int, least: int, group: int, run: int) -> DataFrame:
    """The bytes of contexts, cut into pieces where their group is large; wanted: (text, want array of h, c, p, a, b, e, n, many)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for r in range(batch.num_rows):
                text = batch.column(0)[r].as_buffer().to_pybytes()
                for w in batch.column(1)[r].as_py():
                    h, c, p, a, b, e, n, many = (w[k] for k in ("h", "c", "p", "a", "b", "e", "n", "many"))
                    if many <= group:
                        out.append((h, None, c, c, n == 1, 0, b - a + 1, text[a:e]))
                        size += e - a
                    else:
                        for sub, i0, starts, content in pieces(text, p, a, b, length, least, run):
                            pk = hashlib.blake2b(content, digest_size=8, salt=(p - a - i0).to_bytes(8, "big")).digest()
                            out.append((h, sub, int.from_bytes(pk, "big", signed=True), c, n == 1, i0, starts, content))
                            size += len(content)
                    if size > 4_000_000:
                        yield batch_of(out)
                        out, size = [], 0
            if out:
                yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["h", "sub", "pk", "c", "single", "i0", "starts", "content"])

    return wanted.mapInArrow(rows, CONTEXTS)


def compared(groups: DataFrame, length: int, least: int) -> DataFrame:
    """(h, pk, size, lo, hi): runs of starts whose strings of `size` bytes repeat, in pieces that occur once; groups: (h, sub, pk, single, starts, content), sorted by h and sub."""

    def block(rows: list[tuple[int, int, bool, int, bytes]]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(r[4]) for r in rows])
        t = np.frombuffer(b"".join(r[4] + b"\0" for r in rows), np.uint8).astype(np.int32) + 2
        at = np.cumsum(size + 1) - size - 1
        t[at + size] = 1
        n = np.array([r[3] for r in rows])
        who = np.repeat(np.arange(len(rows)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.array([r[2] for r in rows])[who]
        for long, hit in zip((least, length), repeated(t, at[who] + within, (least, length)), strict=True):
            hit = hit & own & (within + long <= size[who])  # not beyond the end of its text
            first = hit & ~(np.concatenate([[False], hit[:-1]]) & (np.concatenate([[-1], who[:-1]]) == who))
            last = hit & ~(np.concatenate([hit[1:], [False]]) & (np.concatenate([who[1:], [-1]]) == who))
            w = who[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[k][0] for k in w], pa.int64()), pa.array([rows[k][1] for k in w], pa.int64()), pa.array(np.full(len(w), long, np.int32)), pa.array(within[first].astype(np.int32)), pa.array(within[last].astype(np.int32))],
                ["h", "pk", "size", "lo", "hi"],
            )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole groups only, as many as a block holds
        done: list[tuple] = []
        group: list[tuple] = []
        size = own = 0
        last = None
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(6)]
            for h, sub, pk, single, starts, content in zip(*cols, strict=True):
                if (h, sub) != last:
                    if len(group) > 1:
                        if size + own > BLOCK and done:
                            yield from block(done)
                            done, size = [], 0
                        done += group
                        size += own
                    group, own, last = [], 0, (h, sub)
                group.append((h, pk, single, starts, content))
                own += len(content) + 1
        if len(group) > 1:
            if size + own > BLOCK and done:
                yield from block(done)
                done = []
            done += group
        if done:
            yield from block(done)

    return groups.select("h", "sub", "pk", "single", "starts", "content").mapInArrow(rows, "h bigint, pk bigint, size int, lo int, hi int")


def singly(groups: DataFrame, length: int, least: int) -> DataFrame:
    """compared() for groups of any number of pieces: every start by itself, strings of equal bytes counted by their hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for h, pk, starts, content in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                for i in range(starts):
                    for size in {least, length}:
                        if i + size <= len(content):
                            key = hashlib.blake2b(content[i : i + size], digest_size=8).digest()
                            out.append((h, pk, size, i, int.from_bytes(key, "big", signed=True)))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["h", "pk", "size", "lo", "key"])

    each = written(groups.select("h", "pk", "starts", "content").mapInArrow(rows, "h bigint, pk bigint, size int, lo int, key bigint"), "starts", 100)
    twice = written(each.groupBy("h", "size", "key").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    return each.join(twice, ["h", "size", "key"]).select("h", "pk", "size", "lo", F.col("lo").alias("hi"))


def ranges(rows: DataFrame, starts: Column, bytes_: Column, length: int, least: int, *names: str) -> DataFrame:
    """(names, size, lo, hi): all starts that have so many bytes, for both sizes; what is equal as a whole repeats in whole."""
    hi = lambda size: F.least(starts - 1, bytes_ - size)
    both = F.array(*(F.struct(F.lit(size).alias("size"), F.lit(0).alias("lo"), hi(size).alias("hi")) for size in (least, length)))
    return rows.select(*names, F.explode(both).alias("x")).select(*names, "x.*").where("hi >= 0")


def removals(src: DataFrame, length: int = LENGTH, least: int = LEAST, kmer: int = KMER, group: int = GROUP, run: int = RUN, crowd: int = CROWD) -> DataFrame:
    """(tk, spans): the byte ranges (size, s, e) that repeated strings of size `least` and `length` cover in each distinct text that has any; src: (tk, text binary)."""
    occ = written(occurrences(src, length, least, kmer), "anchors")
    # only k-mers that occur more than once go on; mixed: with different contexts
    twice = occ.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1")
    # written, so that both sides of the join are plain shuffles, which AQE can split at a hot k-mer; likewise below
    twice = written(twice.select("h", (F.col("lo") != F.col("hi")).alias("mixed")), "twice")
    cand = written(occ.join(twice, "h"), "candidates")
    each = cand.groupBy("h", "c").agg(F.count("*").alias("n"), F.max("mixed").alias("mixed"), F.min(F.struct("tk", "p", "a", "b", "e")).alias("r"))
    each = written(each.select("h", "c", "n", "mixed", "r.*"), "contexts")
    many = written(each.where("mixed").groupBy("h").agg(F.count("*").alias("many")), "many")
    want = each.join(many, "h").groupBy("tk").agg(F.collect_list(F.struct("h", "c", "p", "a", "b", "e", "n", "many")).alias("want"))
    texts = src.join(want.select("tk"), "tk", "left_semi").dropDuplicates(["tk"]).join(want, "tk").select("text", "want")
    parts = written(contexts(texts, length, least, group, run), "pieces", 100)
    few = compared(parts.where("sub IS NULL").repartition("h").sortWithinPartitions("h"), length, least).withColumnRenamed("pk", "c")
    # of a large group, equal pieces are one row each, and those that differ meet those with the same core
    large = parts.where("sub IS NOT NULL")
    one = written(large.groupBy("h", "sub", "pk", "starts", "content").agg(F.count("*").alias("n")), "distinct")
    full = written(one.groupBy("h", "sub").agg(F.count("*").alias("m")).where("m > 1"), "cores")
    met = one.withColumn("single", F.col("n") == 1).join(full, ["h", "sub"])
    lone = compared(met.where(F.col("m") <= crowd).repartition("h", "sub").sortWithinPartitions("h", "sub"), length, least)
    shared = ranges(one.where("n > 1"), F.col("starts"), F.octet_length("content"), length, least, "h", "pk")
    lone = lone.unionByName(shared)
    if not full.where(F.col("m") > crowd).isEmpty():
        lone = lone.unionByName(singly(met.where(F.col("m") > crowd), length, least))
    lots = large.select("h", "pk", "c", "i0").join(lone, ["h", "pk"]).select("h", "c", "size", (F.col("lo") + F.col("i0")).alias("lo"), (F.col("hi") + F.col("i0")).alias("hi"))
    whole = ranges(each.where("n > 1"), F.col("b") - F.col("a") + 1, F.col("e") - F.col("a"), length, least, "h", "c")
    runs = written(few.unionByName(lots).unionByName(whole), "runs", 100)
    hits = cand.select("tk", "a", "h", "c").join(runs, ["h", "c"]).select("tk", "size", (F.col("a") + F.col("lo")).alias("s"), (F.col("a") + F.col("hi") + F.col("size")).alias("e"))
    return hits.groupBy("tk").agg(F.collect_set(F.struct("size", "s", "e")).alias("spans"))


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of data without the spans, and how many runs they make."""
    out, at, runs = [], 0, 0
    end = -1
    for s, e in sorted(spans):
        if s > end:
            out.append(data[max(at, 0) : s])
            runs += 1
        end = at = max(end, e)
    out.append(data[at:])
    return b"".join(out), runs


def covered(spans: list[tuple[int, int]]) -> int:
    """How many bytes the spans cover."""
    n, end = 0, 0
    for s, e in sorted(spans):
        n += max(e - max(s, end), 0)
        end = max(end, e)
    return n


def dedup(docs: DataFrame, length: int = LENGTH, least: int = LEAST, kmer: int = KMER, group: int = GROUP, run: int = RUN, crowd: int = CROWD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, kept (the bytes left), n_removed, n_spans, n_shared.

    n_shared counts the bytes that repeated strings of the smaller size `least`
    cover; they aren't removed for that.
    """
    own = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    src = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(own)).alias("tk"), own.alias("text"))
    spans = removals(src.select("tk", "text").where(F.octet_length("text") >= least), length, least, kmer, group, run, crowd)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, runs, size, shared = [], [], [], []
            for data, xs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                k, n = cut(data, [(x["s"], x["e"]) for x in xs or () if x["size"] == length])
                kept.append(k)
                runs.append(n)
                size.append(len(data))
                shared.append(covered([(x["s"], x["e"]) for x in xs or () if x["size"] == least]))
            removed = np.array(size, np.int64) - np.array([len(k) for k in kept], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed), pa.array(runs, pa.int64()), pa.array(shared, pa.int64())], ["doc_id", "n_bytes", "kept", "n_removed", "n_spans", "n_shared"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.join(spans, "tk", "left").select("doc_id", "text", "spans").mapInArrow(rows, f"doc_id {kind}, n_bytes bigint, kept binary, n_removed bigint, n_spans bigint, n_shared bigint")


def digests(docs: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """dedup() with the SHA-256 of what is left in place of it."""
    with scratch(docs.sparkSession):
        out = dedup(docs, length, least).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared")
        return written(out, "digests", keep=True)


#: The same rows in DuckDB over the view documents: all strings of 400 bytes, by their MD5.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT r, i, md5(x[i + 1:i + 400]) AS k FROM d, unnest(range(0, octet_length(x) - 399)) AS g(i)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM c),
y AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
runs AS (SELECT r, min(i) AS s, max(i) + 400 AS e FROM y GROUP BY r, run),
left_over AS (
  SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a, s AS b FROM runs
  UNION ALL SELECT r, max(e), octet_length(any_value(x)) FROM runs JOIN d USING (r) GROUP BY r),
kept AS (SELECT r, string_agg(CASE WHEN b > a THEN hex(x[a + 1:b]) ELSE '' END, '' ORDER BY a) AS h FROM left_over JOIN d USING (r) GROUP BY r),
n AS (SELECT r, count(*) AS spans, sum(e - s) AS removed FROM runs GROUP BY r),
sw AS (SELECT r, i, md5(x[i + 1:i + 256]) AS k FROM d, unnest(range(0, octet_length(x) - 255)) AS g(i)),
sc AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM sw) WHERE n > 1),
sh AS (SELECT r, sum(least(256, coalesce(nxt - i, 256))) AS shared FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM sc) GROUP BY r)
SELECT doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN n.r IS NULL THEN x ELSE unhex(kept.h) END) AS kept_sha256, CAST(coalesce(shared, 0) AS BIGINT) AS n_shared
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r) LEFT JOIN sh USING (r)
"""
