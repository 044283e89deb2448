"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A document's set holds the 64-bit hashes of its distinct word shingles. One
permutation cuts the hash range into `bins`; a bin's value is its smallest
hash, and an empty bin borrows the value of a bin that a 2-universal hash of
(bin, attempt) names, attempt after attempt, until it meets a full one. Runs of
`rows` bins make the keys of the bands. A set of at most `bins` shingles fills
too few bins for independent bands: it, and all sets that may be near to it,
have the keys of an exact prefix filter instead. Documents with equal sets form a class
first, so copies cost one row. In a bucket of classes, edges form stars: one
around its most popular class (the one whose buckets are largest) and one
around a hub that differs from bucket to bucket. Classes of buckets that then
still hold different components get finer keys, a prefix filter on their
rarest shingles, and are compared until no key holds two components whose
members have not met; a crowded key in tiles, without a row for each pair. Every edge is confirmed on the full sets before it links.

Scale: the shuffles move one short row per band and document, partial
aggregation collapses copies before any key is dealt out, and the joins on
band keys are plain equi-joins that AQE splits. Texts move only for the classes
that occur in a candidate edge.

Edge cases: a null, empty or blank text has the empty set and is linked with
nothing; a text of fewer words than a shingle has its whole sequence as one
shingle; a row with a null doc_id takes part in links and gets its group's
smallest id, is never kept, and has a null component where no member has an
id; rows of one id are judged by their own texts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, scratch, written

BINS, ROWS, SKETCH, TILE = 125, 5, 18, 256


def shingle_sets(data: np.ndarray, offs: np.ndarray, powers: K.Powers, words: int) -> Iterator[np.ndarray]:
    """For each text, the ascending distinct hashes of its shingles."""
    _, _, row, h = K.word_hashes(data, offs, K.nonspace_class(), K.byte_values(), powers)
    n = len(offs) - 1
    first = np.searchsorted(row, np.arange(n + 1), "left")
    times = np.uint64(0xD6E8FEB86659FD93)
    full = max(len(h) - words + 1, 0)
    acc = np.zeros(full, np.uint64)
    for j in range(words):
        acc = acc * times + h[j : j + full]
    acc = K.mix(acc)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            yield np.unique(acc[a : b - words + 1])
        elif b > a:
            x = 0
            for v in h[a:b]:
                x = (x * int(times) + int(v)) & (2**64 - 1)
            yield K.mix(np.array([x ^ (0x5851F42D4C957F2D * int(b - a) & (2**64 - 1))], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def donors(bins: int, attempts: int = 64) -> np.ndarray:
    """The bin that an empty bin asks at each attempt; 2-universal hashing."""
    rng = np.random.default_rng(20170305)
    prime = (1 << 31) - 1
    a, b, c = (int(x) for x in rng.integers(1, prime, 3))
    j, t = np.arange(bins, dtype=np.int64)[:, None], np.arange(attempts, dtype=np.int64)[None, :]
    return (((a * j) % prime + (b * t) % prime + c) % prime) % bins


def signature(s: np.ndarray, edges: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Smallest hash of each bin of a sorted set; empty bins filled by optimal densification."""
    at = np.searchsorted(s, edges)
    full = at[1:] > at[:-1]
    sig = s[np.minimum(at[:-1], len(s) - 1)]
    empty = np.flatnonzero(~full)
    for t in range(ask.shape[1]):
        if not len(empty):
            break
        give = ask[empty, t]
        ok = full[give]
        sig[empty[ok]] = sig[give[ok]]
        empty = empty[~ok]
    if len(empty):  # after so many misses, the next full bin
        near = np.flatnonzero(full)
        sig[empty] = sig[near[np.searchsorted(near, empty) % len(near)]]
    return sig


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    if not len(s):
        return 0, 0
    a, b = K.mix(s + np.uint64(1)).sum(dtype=np.uint64), K.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


SIGNATURES = "doc_id bigint, tk bigint, n_shingles bigint, node bigint, node2 bigint, bands array<bigint>, shingles array<bigint>"


def signatures(docs: DataFrame, words: int, num: int, den: int, bins: int, rows: int) -> DataFrame:
    """Bands of sets of more than `bins` shingles, and the sets of those which may be near to one of no more."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, ask = K.Powers(), donors(bins)
        edges = np.array([(i << 64) // bins for i in range(bins)], np.uint64)
        edges = np.concatenate([edges, [np.uint64(2**64 - 1)]])
        n_bands = bins // rows
        tag = K.mix(np.arange(1, n_bands + 1, dtype=np.uint64))
        for b in batches:
            data, offs = K.buffers(b.column(2))
            n, keys, bands, ends, small, stops = [], [], [], [0], [], [0]
            for i, j in K.segments(offs):
                for s in shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], powers, words):
                    n.append(len(s))
                    keys.append(set_key(s))
                    if len(s) > bins:
                        g = signature(s, edges, ask)[: n_bands * rows].reshape(n_bands, rows)
                        x = tag.copy()
                        for c in range(rows):
                            x = K.mix(x + g[:, c])
                        bands.append(x.view(np.int64))
                    ends.append(ends[-1] + n_bands * (len(s) > bins))
                    if num * len(s) <= den * bins:
                        small.append(s.view(np.int64))
                    stops.append(stops[-1] + len(s) * (num * len(s) <= den * bins))
            flat = np.concatenate([np.zeros(0, np.int64), *bands])
            sets = np.concatenate([np.zeros(0, np.int64), *small])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(sets))],
                ["doc_id", "tk", "n_shingles", "node", "node2", "bands", "shingles"],
            )

    return docs.mapInArrow(sign, SIGNATURES)


def confirmed(edges: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The edges (u, v) whose sets reach den * intersection >= num * union; texts: (node, text)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, kept = K.Powers(), {}
        for b in batches:
            u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            su, sv = b.column(2), b.column(3)
            ok = np.zeros(len(u), bool)

            def own(k: int, col: pa.Array, i: int) -> np.ndarray:
                if k not in kept:
                    if len(kept) >= 64:
                        kept.pop(next(iter(kept)))
                    kept[k] = next(shingle_sets(*K.buffers(col.slice(i, 1)), powers, words))
                return kept[k]

            for i in range(len(u)):
                x, y = own(u[i], su, i), own(v[i], sv, i)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = den * both >= num * (len(x) + len(y) - both) and both > 0
            yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], ["u", "v"])

    full = (
        edges.select("u", "v")
        .join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
        .join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
        .select("u", "v", "tu", "tv")
    )
    return full.mapInArrow(check, "u bigint, v bigint")


def stars(buckets: DataFrame) -> DataFrame:
    """Candidate edges (bk, hub, node) of both stars of every bucket; buckets: (bk, node, pop)."""
    hubs = buckets.groupBy("bk").agg(
        F.max_by("node", F.struct("pop", "node")).alias("a"),
        F.min(F.col("node").bitwiseXOR(F.col("bk"))).alias("x"),
        F.count("*").alias("n"),
    ).where("n > 1").select("bk", F.array_distinct(F.array("a", F.col("x").bitwiseXOR(F.col("bk")))).alias("hubs"))
    return buckets.join(written(hubs, "hubs"), "bk").select("bk", "node", F.explode("hubs").alias("hub")).where("node <> hub")


def several(buckets: DataFrame) -> DataFrame:
    """Buckets of two components or more, with their number of members; buckets: (bk, node, comp)."""
    return buckets.groupBy("bk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bk", "n")


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the texts (node, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = K.Powers()
        for b in batches:
            data, offs = K.buffers(b.column(1))
            for i, j in K.segments(offs):
                s = [x.view(np.int64) for x in shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], powers, words)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in s])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(s)))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(cut, "node bigint, shingles array<bigint>")


def prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Keys (node, size, bk) of which any two sets as similar as num / den share one: prefix filter, rarest shingles first.

    Any order of shingles that all sets share is exact. This one is by counts
    in 2**SKETCH slots of the hashes, a table of bounded size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SKETCH, np.int64)
        for b in batches:
            x = b.column(0).flatten().to_numpy().view(np.uint64)
            seen += np.bincount((x >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["slot", "n"])

    counts = sets.select("shingles").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << SKETCH, np.int64)
    table[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, keys = [], [], []
            for k, s in zip(b.column(0).to_numpy(), b.column(1), strict=True):
                x = s.values.to_numpy().view(np.uint64)
                x = x[np.lexsort((x, shared.value[(x >> np.uint64(64 - SKETCH)).astype(np.int64)]))][: len(x) - -(-len(x) * num // den) + 1]
                node.append(np.full(len(x), k))
                size.append(np.full(len(x), len(s)))
                keys.append(K.mix(x ^ np.uint64(0x2545F4914F6CDD1D)).view(np.int64))
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (node, size, keys)], ["node", "size", "bk"])

    return sets.where(F.size("shingles") > 0).select("node", "shingles").mapInArrow(cut, "node bigint, size bigint, bk bigint")


def tile_links(node: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of links between different components in one tile, as many as join what the links join.

    side: 0 in a tile of one chunk, else 1 or 2: only pairs across sides count.
    """
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # a shingle of one member alone is in no intersection
    col, row = (np.cumsum(n > 1) - 1)[col[n[col] > 1]], row[n[col] > 1]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    a, b = (np.arange(len(sets)),) * 2 if not side.any() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    both = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, int(n.size and (n > 1).sum()), 2048):
        x = np.zeros((len(sets), 2048), np.float32)
        at = slice(*np.searchsorted(col, [k, k + 2048]))
        x[row[at], col[at] - k] = 1
        both += x[a] @ x[b].T
    hit = (den * both >= num * (size[a][:, None] + size[b][None, :] - both)) & (both > 0) & (comp[a][:, None] != comp[b][None, :])
    i, j = np.nonzero(hit)
    i, j = a[i], b[j]
    # one link for each member whose label it lowers, until the labels of both ends agree
    lab, out = np.unique(comp, return_inverse=True)[1], []
    while len(i):
        apart = lab[i] != lab[j]
        i, j = i[apart], j[apart]
        if not len(i):
            break
        hi, lo = np.maximum(lab[i], lab[j]), np.minimum(lab[i], lab[j])
        top, first = np.unique(hi, return_index=True)
        out.append((i[first], j[first]))
        to = np.arange(lab.max() + 1)
        to[top] = lo[first]
        while (to[to] != to).any():
            to = to[to]
        lab = to[lab]
    if not out:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def tiled(buckets: DataFrame, sets: DataFrame, num: int, den: int, tile: int = TILE) -> DataFrame:
    """Links (u, v, cu, cv) between the components of crowded buckets (bk, node, comp, n), all pairs, without a row for a pair.

    A bucket is cut into chunks, and each two of them are compared as sets in
    one task; a tile returns as many links as join its components.
    """
    cut = buckets.withColumn("chunks", F.ceil(F.col("n") / tile).cast("int")).withColumn("c", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    each = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")).select(
        "bk", "node", "comp", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"),
        F.when(F.col("c") == F.col("o"), F.when(F.col("chunks") > 1, 3).otherwise(0)).when(F.col("c") < F.col("o"), 1).otherwise(2).alias("side"),
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        node, comp = rows["node"].to_numpy(), rows["comp"].to_numpy()
        side = rows["side"].to_numpy()
        i, j = tile_links(node, comp, np.where(side == 3, 0, side), list(rows["shingles"]), num, den)
        u, v = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
        return pd.DataFrame({"u": node[u], "v": node[v], "cu": comp[u], "cv": comp[v]})

    return each.join(sets, "node").groupBy("bk", "a", "b").applyInPandas(compare, "u bigint, v bigint, cu bigint, cv bigint").distinct()


def rest(keys: DataFrame, comp: DataFrame, tested: DataFrame, texts: DataFrame, sets: DataFrame, words: int, num: int, den: int) -> list[DataFrame]:
    """Compare until no key (node, size, bk) is left with members of different components that have not met.

    Returns what joins components, in turn: (comp, to), to being the new name of comp.

    Buckets of more than TILE members are compared in tiles at once. Of the
    others, each round compares some members, four times as many as the round
    before, with all members of other components; these leave the bucket. At
    the latest when all its members have been chosen it is done. Pairs in
    tested have met already.
    """
    alone = written(keys, "keys")
    buckets = alone.join(written(alone.groupBy("bk").agg(F.count("*").alias("n")).where("n > 1"), "crowd").select("bk"), "bk")
    buckets = buckets.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    moves, hubs = [], 2
    while True:
        buckets = written(buckets, "buckets")
        chosen = F.pmod(F.xxhash64("node", "bk"), F.col("n")) < hubs
        buckets = written(buckets.join(written(several(buckets), "several"), "bk").withColumn("hub", chosen), "buckets")
        if buckets.isEmpty():
            return moves
        wide = buckets.where(F.col("n") > TILE)
        buckets = buckets.where(F.col("n") <= TILE).drop("n")
        hub = written(buckets.where("hub").select("bk", F.col("node").alias("h"), F.col("comp").alias("hc"), F.col("size").alias("hs")), "hubs")
        pairs = buckets.join(hub, "bk").where(f"comp <> hc AND {den} * least(size, hs) >= {num} * greatest(size, hs)")
        lower = F.col("node") < F.col("h")
        either = lambda x, y: F.when(lower, F.col(x)).otherwise(F.col(y))
        pairs = pairs.select(either("node", "h").alias("u"), either("h", "node").alias("v"), either("comp", "hc").alias("cu"), either("hc", "comp").alias("cv")).distinct()
        pairs = written(pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        found = written(confirmed(pairs, texts, words, num, den), "links")
        found = pairs.join(found, ["u", "v"], "left_semi")
        if not wide.isEmpty():
            found = found.unionByName(written(tiled(wide, sets, num, den), "tiles"))
        buckets = buckets.where("NOT hub").select("bk", "node", "size", "comp")
        if not found.isEmpty():
            joined = written(components(found, "cu", "cv").withColumnRenamed("comp", "to").withColumnRenamed("node", "comp"), "joined")
            moves.append(joined)
            buckets = buckets.join(joined, "comp", "left").select("bk", "node", "size", F.coalesce("to", "comp").alias("comp"))
        tested = tested.unionByName(pairs.select("u", "v"))
        hubs *= 4


def grouped(docs: DataFrame, words: int, num: int, den: int, bins: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """near_duplicates() with tk, a hash of the text, and comp, a number of the group, null for an empty set."""
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("tk"), F.col(text).alias("text"))
    sig = written(signatures(src, words, num, den, bins, rows), "signatures")
    with scratch(docs.sparkSession):
        some = sig.where("n_shingles > 0")
        # the row of the smallest id stands for its class; copies fall together before the shuffle
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tk", "bands", "shingles")).alias("r")
        one = some.groupBy("node", "node2").agg(first).select("node", "r.doc_id", "r.tk", "r.bands", "r.shingles")
        one = written(one, "classes")
        # small sets fill too few bins for bands; their prefixes are exact
        rows_ = written(one.select("node", F.explode("bands").alias("bk")).unionByName(prefixes(one, num, den).select("node", "bk")), "keys")
        # written, so that both sides of the join are plain shuffles, which AQE can split at a hot key; likewise below
        crowd = written(rows_.groupBy("bk").agg(F.count("*").alias("n")).where("n > 1"), "crowd")
        crowded = written(rows_.join(crowd, "bk"), "crowded")
        pop = crowded.groupBy("node").agg(F.sum("n").alias("pop"))
        buckets = written(crowded.join(pop, "node").select("bk", "node", "pop"), "buckets")
        who = one.join(pop.select("node"), "node", "left_semi").select("node", F.col("doc_id").alias("rid"), F.col("tk").alias("rtk"))
        texts = written(
            src.join(who, src["doc_id"].eqNullSafe(who["rid"]) & (src["tk"] == who["rtk"])).select("node", "text").dropDuplicates(["node"]),
            "texts",
        )
        cand = written(stars(buckets).select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct(), "stars")
        links = written(confirmed(cand, texts, words, num, den), "links")
        comp = written(components(links), "components")
        # what is of different components in a bucket is compared to the end, by keys that meet less by chance
        left = buckets.select("bk", "node").join(written(several(buckets.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))), "several").select("bk"), "bk")
        again = written(texts.join(left.select("node").distinct(), "node", "left_semi"), "again")
        ids = one.groupBy("node").agg(F.min("doc_id").alias("rep"))
        label = ids.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        if not again.isEmpty():
            sets = written(full_sets(again, words), "sets")
            for move in rest(prefixes(sets, num, den), comp, cand, texts, sets, words, num, den):
                label = label.join(move, "comp", "left").select("node", "rep", F.coalesce("to", "comp").alias("comp"))
        low = label.groupBy("comp").agg(F.min("rep").alias("component_id"))
        named = written(label.join(low, "comp").select("node", "component_id", F.col("comp").alias("group")), "components", keep=True)
    # the empty set is linked with nothing
    out = sig.join(named, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return out.select("doc_id", "tk", F.when(F.col("n_shingles") > 0, F.col("group")).alias("comp"), "n_shingles", "component_id", kept)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, bins: int = BINS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Links documents whose sets of shingles of so many words have a Jaccard
    similarity of num / den or more.
    """
    return grouped(docs, words, num, den, bins, rows, doc_id, text).drop("tk", "comp")


def distinct(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, bins: int = BINS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all their columns, of which each group of near-duplicates keeps exactly one row.

    It is the one with the smallest id, null ids last, then with the smallest
    hash of its text; of rows equal in both, any one. Rows of an empty set
    are in no group and stay.
    """
    with scratch(docs.sparkSession):
        found = grouped(docs, words, num, den, bins, rows, doc_id, text)
        alike = found.where("comp IS NOT NULL").groupBy("comp", "doc_id", "tk").agg(F.count("*").alias("n"))
        one = alike.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tk", "n")).alias("one"))
        one = one.select(F.col("one.doc_id").alias("_id"), F.col("one.tk").alias("_tk"), (F.col("one.n") > 1).alias("_many"))
        blank = found.where("comp IS NULL").select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), F.lit(False).alias("_many")).distinct()
        stay = written(one.unionByName(blank), "stay", keep=True)
    key, tk = docs[doc_id].cast("bigint"), F.xxhash64(docs[text])
    single, many = stay.where("NOT _many"), stay.where("_many")
    out = docs.join(single, key.eqNullSafe(single["_id"]) & tk.eqNullSafe(single["_tk"]), "left_semi")
    if many.isEmpty():
        return out
    # the row as one value, so that no column's name meets ours
    again = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), key.alias("id"), tk.alias("tk"))
    again = again.join(many, again["id"].eqNullSafe(many["_id"]) & again["tk"].eqNullSafe(many["_tk"]), "left_semi")
    return out.unionByName(again.groupBy("id", "tk").agg(F.first("row").alias("row")).select("row.*"))


#: The same rows in DuckDB over the view documents: all pairs that share a shingle, exact.
SQL = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k
  FROM dw, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS g(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b USING (k) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""
