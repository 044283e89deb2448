"""Embedding near-duplicates: random projections decoded to E8 lattice points, several tables, neighbouring cells probed.

Each table projects a unit vector to some blocks of 8 dimensions and decodes every
block to the nearest point of E8 (D8 or D8 + 1/2); the decoded points name the
vector's home cell. It also visits the cells that lie next nearest, one
of the 240 shortest lattice vectors away in one block. In a cell, homes are
compared with homes and visitors by their cosine in double precision, on the
full vectors, so nothing below the threshold links.

Equal vectors form one class first, so copies cost one row. A crowded cell is
cut into tiles of at most 2 x TILE rows, which separate tasks compare; no pair
leaves a task: a tile returns for each vector how many links it found and the
root of its component inside the tile. A pair that meets in several cells is
counted where it meets first: in the first table, and there in the smaller of
the two home cells that both share.

Blocks, tables and probes are the same at any size, so whether two vectors link
follows from these two alone and no row more or less changes it. The price is
that a vector meets unrelated ones in proportion to the rows. Full vectors are
only fetched for rows of a tile that a sketch of SKETCH numbers leaves with a
partner; products of sketches bound the cosine from above, so this loses no
link. A caller may name another line of SCALES: more blocks make cells finer,
more tables and probes keep the recall. Every row is indexed. At a cosine of
0.95 in 64 dimensions, tests measure a recall of at least 0.9 for each line;
above it recall is higher.

Edge cases: a vector that is null, empty, zero or holds null or non-finite
components links with nothing and is its own component; vectors of different
lengths never link; rows with a null vec_id count as links but have no
component of their own name (null if the whole component has no id) and are
not kept. Other columns, labels among them, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, written



class Scale(NamedTuple):
    blocks: int
    tables: int
    probes: int


#: Settings to choose from, the first by default; the number of vectors chooses none. Two random directions of 64 dimensions
#: met in a table of 2 and 3 blocks with probabilities near 1e-5 and 3e-8 (of 4 blocks, never in 2e8 pairs).
SCALES = (Scale(2, 6, 8), Scale(3, 12, 16), Scale(4, 32, 16))
#: Rows of a chunk of a crowded cell; groups of at most SMALL rows are compared together.
TILE, SMALL = 512, 32
#: Numbers of a sketch, and room for the rounding of its products.
SKETCH, SLACK = 16, 1e-5
#: Standard deviation, in a projected dimension, of the difference of two unit vectors at the threshold; the cells have volume 1.
CELL = 0.2


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(whole + half)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    f = np.rint(x)
    off = x - f
    odd = np.flatnonzero(f.sum(axis=1) % 2)
    k = np.abs(off[odd]).argmax(axis=1)
    f[odd, k] += np.where(off[odd, k] >= 0, 1, -1)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def cell_keys(points: np.ndarray, salt: int) -> np.ndarray:
    """64-bit names of lattice points, doubled coordinates in the last axis."""
    h = np.full(points.shape[:-1], salt, np.uint64)
    for c in range(points.shape[-1]):
        h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + points[..., c].astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def cells(x: np.ndarray, threshold: float, scale: Scale, seed: int = 8) -> np.ndarray:
    """(n, tables, 1 + probes) names of the home cell and the cells to visit; x: unit vectors as rows."""
    n, d = x.shape
    blocks, tables, probes = scale
    rng, r = np.random.default_rng([seed, d]), roots()
    size = CELL / np.sqrt(2 - 2 * threshold)
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        y = x @ rng.standard_normal((d, blocks * 8)) * size
        home = np.concatenate([nearest_e8(y[:, 8 * b : 8 * b + 8]) for b in range(blocks)], axis=1)
        gain = np.concatenate([(y - home)[:, 8 * b : 8 * b + 8] @ r.T for b in range(blocks)], axis=1)
        best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
        near = np.repeat(home[:, None, :], 1 + probes, axis=1)
        step = np.zeros((blocks * len(r), blocks * 8))
        for b in range(blocks):
            step[b * len(r) : (b + 1) * len(r), 8 * b : 8 * b + 8] = r
        near[:, 1:, :] += step[best]
        out[:, t] = cell_keys(np.rint(near * 2), t * 1_000_003 + d)
    return out


def sketches(x: np.ndarray, seed: int = 9) -> np.ndarray:
    """(n, SKETCH): unit vectors on a few orthonormal directions, and the length of the rest.

    x.y is the product on these directions and that of the rests, which is at most the product of their lengths.
    """
    d = x.shape[1]
    q = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, SKETCH - 1)))[0]
    out = np.zeros((len(x), SKETCH), np.float32)
    y = x @ q
    out[:, : y.shape[1]] = y
    out[:, -1] = np.sqrt(np.maximum(1 - (y * y).sum(axis=1), 0))
    return out


def hashed(classes: DataFrame, threshold: float, scale: Scale) -> DataFrame:
    """(id, keys, sketch): the cells of every class of vectors."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column(1)
            size = np.diff(np.asarray(vecs.offsets))
            flat, offs = np.asarray(vecs.values, dtype=np.float64), np.asarray(vecs.offsets)
            out, short = np.zeros((len(size), scale.tables * (1 + scale.probes)), np.int64), np.zeros((len(size), SKETCH), np.float32)
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                x = flat[offs[own][:, None] + np.arange(d)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                out[own], short[own] = cells(x, threshold, scale).reshape(len(own), -1), sketches(x)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel())) for v in (out, short)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["id", "keys", "sketch"])

    return classes.select("id", "vec").mapInArrow(keys, "id bigint, keys array<bigint>, sketch array<float>")


def same_table(kx: np.ndarray, ky: np.ndarray) -> np.ndarray:
    """Whether two vectors meet in a table; (pairs, 1 + probes) cells, home first."""
    return (kx[:, :1] == ky).any(axis=1) | (kx == ky[:, :1]).any(axis=1)


def pairs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: rows of unit vectors of one group whose cosine reaches the threshold; groups are runs of rows."""
    size, found = ends - starts, []
    for s in np.unique(size[(size > 1) & (size <= SMALL)]):
        i, j = np.triu_indices(s, 1)
        at = starts[size == s][:, None]
        i, j = (at + i).ravel(), (at + j).ravel()
        for k in range(0, len(i), 1 << 16):
            found.append((i[k : k + (1 << 16)], j[k : k + (1 << 16)]))
    for a, b in zip(starts[size > SMALL], ends[size > SMALL], strict=True):
        # the product only proposes, with room for its rounding
        i, j = np.nonzero(np.triu(x[a:b] @ x[a:b].T >= threshold - 1e-9, 1))
        for k in range(0, len(i), 1 << 16):
            found.append((a + i[k : k + (1 << 16)], a + j[k : k + (1 << 16)]))
    kept = [(i[ok], j[ok]) for i, j in found for ok in [np.einsum("ij,ij->i", x[i], x[j]) >= threshold]]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(i for i, _ in kept)]), np.concatenate([none, *(j for _, j in kept)])


def tile_links(ids: np.ndarray, weight: np.ndarray, home: np.ndarray, side: np.ndarray, x: np.ndarray, keys: np.ndarray, table: np.ndarray, cell: np.ndarray, starts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links counted here, root of its component here) of every vector with a counted link, for tiles that begin at starts.

    side: 0 in a tile of one chunk, else 1 or 2: only pairs across sides count.
    """
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    i, j = pairs(x, starts, np.append(starts[1:], len(ids)), threshold)
    due = (home[i] | home[j]) & ((side[i] == 0) | (side[i] != side[j]))
    i, j = i[due], j[due]
    for t in range(int(table.max(initial=0))):
        before = np.flatnonzero(table[i] > t)
        fresh = np.ones(len(i), bool)
        fresh[before] = ~same_table(keys[i[before], t], keys[j[before], t])
        i, j = i[fresh], j[fresh]
    # both homes may be shared: then the smaller of them counts
    ki, kj = keys[i, table[i]], keys[j, table[j]]
    both = (ki[:, :1] == kj).any(axis=1) & (ki == kj[:, :1]).any(axis=1)
    here = ~both | (np.minimum(ki[:, 0], kj[:, 0]) == cell[i])
    i, j = i[here], j[here]
    lab = np.arange(len(ids))
    while len(i):
        new = lab.copy()
        low = np.minimum(lab[i], lab[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    linked = np.unique(np.concatenate([i, j]))
    n = np.bincount(i, weights=weight[j], minlength=len(ids)) + np.bincount(j, weights=weight[i], minlength=len(ids))
    return ids[linked], n[linked].astype(np.int64), ids[lab[linked]]


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that no tile crosses; rows of a tile follow each other."""
    rest = None
    for b in batches:
        b = b if rest is None else pa.concat_batches([rest, b])
        own = np.stack([b.column(c).to_numpy() for c in ("cell", "a", "b")])
        change = np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0))
        cut = change[-1] + 1 if len(change) else 0
        if cut:
            yield b.slice(0, cut)
        rest = b.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, scale: Scale | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors at cosine >= threshold), component_id, kept.

    scale: blocks, tables and probes; by default the first line of SCALES.
    """
    scale = scale or SCALES[0]
    vec = F.col("vec")
    src = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    fine = F.coalesce(
        (F.size(vec) > 0) & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vec, lambda v: v != 0.0),
        F.lit(False),
    )
    src = src.withColumn("id", F.when(fine, F.xxhash64(vec)))
    good = src.where("id IS NOT NULL")
    count = good.groupBy("id").agg(F.count("*").alias("m"), F.min("vec_id").alias("low"))
    # one row of each class: the row of its smallest vec_id, or any where none has one
    one = good.join(count, "id").where("vec_id <=> low").dropDuplicates(["id"]).select("id", "m", "low", "vec")
    one = written(one, "classes")
    keyed = written(hashed(one, threshold, scale), "cells")
    wide = 1 + scale.probes
    visits = keyed.select("id", F.posexplode("keys").alias("at", "cell")).select("id", "cell", (F.col("at") / wide).cast("int").alias("t"), (F.col("at") % wide == 0).alias("home"))
    full = (
        visits.groupBy("cell")
        .agg(F.count("*").alias("n"), F.max("home").alias("any_home"))
        .where("n > 1 AND any_home")
        .select("cell", F.ceil(F.col("n") / TILE).cast("int").alias("chunks"))
    )
    # written, so that both sides of the join are plain shuffles, which AQE can split at a hot cell
    full = written(full, "crowded")
    met = visits.join(full, "cell").withColumn("c", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("id"), "chunks")).otherwise(F.lit(0)).cast("int"))
    tiles = met.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")).select(
        "id", "cell", "t", "home", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"),
        F.when(F.col("c") == F.col("o"), F.lit(0)).otherwise(F.when(F.col("c") < F.col("o"), F.lit(1)).otherwise(F.lit(2))).alias("side"),
    )
    tiles = tiles.join(keyed.select("id", "sketch"), "id")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_tiles(batches):
            x = np.asarray(b.column(b.schema.get_field_index("sketch")).flatten(), dtype=np.float64).reshape(b.num_rows, SKETCH)
            tile = np.stack([b.column(c).to_numpy() for c in ("cell", "a", "b")])
            home, side = b.column("home").to_numpy(zero_copy_only=False), b.column("side").to_numpy()
            starts = np.flatnonzero(np.append(True, (tile[:, 1:] != tile[:, :-1]).any(axis=0)))
            i, j = pairs(x, starts, np.append(starts[1:], b.num_rows), threshold - SLACK)
            due = (home[i] | home[j]) & ((side[i] == 0) | (side[i] != side[j]))
            rest = b.take(pa.array(np.unique(np.concatenate([i[due], j[due]]))))
            yield rest.select(["id", "cell", "t", "home", "a", "b", "side"])

    # the rows of a tile, 2 x TILE at most on average, come one behind the other
    tiles = tiles.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b").mapInArrow(near, "id bigint, cell bigint, t int, home boolean, a int, b int, side int")
    # written, as AQE can't tell the size of what a function returns
    tiles = written(tiles, "near").join(one.select("id", "m", "vec"), "id").join(keyed.select("id", "keys"), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_tiles(batches):
            col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "cell", "t", "home", "a", "b", "side", "m")}
            vecs, keys = b.column(b.schema.get_field_index("vec")), b.column(b.schema.get_field_index("keys"))
            offs, flat = np.asarray(vecs.offsets), np.asarray(vecs.values, dtype=np.float64)
            keys = np.asarray(keys.flatten()).reshape(b.num_rows, scale.tables, wide)
            for d in np.unique(np.diff(offs)):
                own = np.flatnonzero(np.diff(offs) == d)
                here = {c: v[own] for c, v in col.items()}
                tile = np.stack([here[c] for c in ("cell", "a", "b")])
                starts = np.flatnonzero(np.append(True, (tile[:, 1:] != tile[:, :-1]).any(axis=0)))
                x = flat[offs[own][:, None] + np.arange(d)]
                out = tile_links(here["id"], here["m"].astype(float), here["home"].astype(bool), here["side"], x, keys[own], here["t"], here["cell"], starts, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["id", "n", "root"])

    tiles = tiles.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")
    found = written(tiles.mapInArrow(compare, "id bigint, n bigint, root bigint"), "links")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = components(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    label = one.select("id", "m", "low").join(links, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    low = label.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = written(label.join(low, "comp").select("id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"), "components")
    out = src.select("vec_id", "id").join(named, "id", "left")
    comp_id = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))


#: The same rows in DuckDB over the view embeddings: all pairs.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(x, x) > 0),
e AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.95),
r(node, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, e.w FROM r JOIN e ON e.u = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON node = vec_id LEFT JOIN n ON u = vec_id
"""
