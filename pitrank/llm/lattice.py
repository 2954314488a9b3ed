"""Near-duplicate embeddings by E8 lattice hashing.

In each table a vector of length one is projected to eight dimensions at random, scaled, and decoded to the
nearest point of the E8 lattice, its home cell; the neighbouring cells nearest to it are probed as well.  Two
vectors meet where one's home is the other's home or is probed by it, and every meeting is verified by the
cosine in double precision.  At a cosine of 0.9 a pair meets in one of the default tables with a probability
above 0.99, more often the nearer it is.

Equal vectors are one class.  A cell is compared in blocks: cells of more than ``block`` rows are dealt by
pairs of blocks, so that no task holds an unbounded cell, and no pair is left out.  A task returns link
counts and one edge a vector to the least vector of its local component, never all pairs.  A pair that meets
in several places is counted in the first one only.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different length do not link; rows with equal ids are treated each by its vector, a component's
id is the least one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, cut_lineage, mix64
from .graph import components

TABLES, PROBES, SCALE, BLOCK = 7, 4, 0.6, 1024
#: Rows of small blocks that are compared by one matrix product.
TOGETHER = 160


def _minimal_vectors() -> np.ndarray:
    """The 240 vectors from a point of E8 to its nearest other points."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


NEIGHBOURS = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where the sum is odd, the worst coordinate rounds the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    error = x[odd] - r[odd]
    worst = np.abs(error).argmax(1)
    r[odd, worst] += np.where(error[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _cell_keys(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    h = np.full(points.shape[:-1], mix64(np.array([table * 65_537 + dim + 1], np.uint64))[0], np.uint64)
    twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
    for i in range(8):
        h = mix64(h * np.uint64(3) + twice[..., i])
    return h.view(np.int64)


@functools.lru_cache(maxsize=256)
def _projection(seed: int, dim: int, table: int, scale: float) -> np.ndarray:
    return np.random.default_rng((seed, dim, table)).normal(0, scale, (dim, 8))


def table_cells(unit: np.ndarray, table: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Keys by vector and rank in one table: the home cell first, then the probed ones, nearest first."""
    n, dim = unit.shape
    x = unit @ _projection(seed, dim, table, scale)
    home = decode_e8(x)
    points = np.repeat(home[:, None, :], probes + 1, axis=1)
    along = (x - home) @ NEIGHBOURS.T
    # The few nearest one after another, equal ones by position: sorting all 240 takes most of the time otherwise.
    for r in range(1, probes + 1):
        best = along.argmax(1)
        points[:, r] += NEIGHBOURS[best]
        along[np.arange(n), best] = -np.inf
    return _cell_keys(points, table, dim)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Keys by vector, table and rank."""
    return np.stack([table_cells(unit, t, probes, scale, seed) for t in range(tables)], axis=1)


def _units(column: list) -> list[np.ndarray | None]:
    """Vectors of length one in double precision; None where a vector can't have a cosine."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = np.array([np.nan if c is None else c for c in v], float) if v is not None and len(v) else None
        if x is not None and np.isfinite(x).all() and np.abs(x).max() > 0:
            x = x / np.abs(x).max()
            out.append(x / np.sqrt(x @ x))
        else:
            out.append(None)
    return out


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of one table's cells (pair, rank) meet: one's home is the other's home or is probed by it."""
    return (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)


def _met_before(a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
    """Whether pairs of cell tables (pair, table, rank) meet in a table before ``table``."""
    met = np.zeros(len(a), bool)
    for t in range(table):
        met |= _meet(a[:, t], b[:, t])
    return met


def _compare(group: np.ndarray, ids: np.ndarray, unit: np.ndarray, table: np.ndarray, home: np.ndarray, left: np.ndarray, right: np.ndarray,
             keys_of, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs inside the groups (positions) that are counted here, and all linked pairs (for the component)."""
    ok = np.triu((left[:, None] & right[None, :]) | (right[:, None] & left[None, :]), 1) & (home[:, None] | home[None, :])
    ok &= (ids[:, None] != ids[None, :]) & (group[:, None] == group[None, :])
    i, j = np.nonzero(ok & (unit @ unit.T >= cosine))
    own = np.ones(len(i), bool)

    def keys(pairs: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        involved, at = np.unique(np.concatenate((i[pairs], j[pairs])), return_inverse=True)
        found = keys_of(unit[involved], t)
        return found[at[:len(pairs)]], found[at[len(pairs):]]

    # A pair is looked up in the tables before its own only until it meets in one.
    for t in range(int(table.max())):
        pairs = np.flatnonzero(own & (table[i] > t))
        if len(pairs):
            own[pairs[_meet(*keys(pairs, t))]] = False
    # Both may probe the other's home: then the pair counts where the lesser id probes.
    later = own & (home[i] ^ home[j]) & ((~home[i] & home[j]) != (ids[i] < ids[j]))
    for t in np.unique(table[i[later]]):
        pairs = np.flatnonzero(later & (table[i] == t))
        a, b = keys(pairs, int(t))
        own[pairs[(a == b[:, :1]).any(1) & (b == a[:, :1]).any(1)]] = False
    return i[own], j[own], i, j


def _local_roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least id of each position's component over the edges ``i, j``."""
    root = ids.copy()
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            return root
        root = new


def _links(batches: Iterator[pa.RecordBatch], cosine: float, tables: int, probes: int, scale: float, seed: int):
    """Link counts and edges of the blocks, whose rows follow one another; small blocks are compared together."""
    #: Parts of the block that may go on in the next batch, and whole small blocks that wait, each (vectors, other columns).
    going: list[tuple] = []
    waiting: list[tuple] = []
    names = ("class", "copies", "table", "home", "left", "right")

    def keys_of(unit: np.ndarray, table: int) -> np.ndarray:
        return table_cells(unit, table, probes, scale, seed)

    def compared(blocks: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not blocks:
            return
        group = np.repeat(np.arange(len(blocks)), [len(vec) for vec, _ in blocks])
        ids, copies, table, home, left, right = (np.concatenate(c) for c in zip(*[rest for _, rest in blocks], strict=True))
        i, j, every_i, every_j = _compare(group, ids, np.concatenate([vec for vec, _ in blocks]), table, home, left, right, keys_of, cosine)
        if not len(every_i):
            return
        count = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        root = _local_roots(ids, every_i, every_j)
        some = np.flatnonzero((count > 0) | (root < ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some].astype(np.int64)), pa.array(root[some])], names=["class", "links", "root"])

    def closed() -> Iterator[pa.RecordBatch]:
        """The block that went on is whole: it waits with others of its length up to ``TOGETHER`` rows."""
        rows = sum(len(vec) for vec, _ in going)
        if rows > 1:
            if waiting and (sum(len(vec) for vec, _ in waiting) + rows > TOGETHER or waiting[0][0].shape[1] != going[0][0].shape[1]):
                yield from compared(waiting)
                waiting.clear()
            waiting.append((np.concatenate([vec for vec, _ in going]), [np.concatenate(c) for c in zip(*[rest for _, rest in going], strict=True)]))
        going.clear()

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        key = np.stack([cols[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "first", "second")], axis=1)
        rest = [cols[c].to_numpy(zero_copy_only=False) for c in names]
        ends = cols["vector"].offsets.to_numpy()
        flat = cols["vector"].flatten().to_numpy()
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
        for s, e in zip(starts, np.append(starts[1:], len(key)), strict=True):
            if tuple(key[s]) != last:
                yield from closed()
                last = tuple(key[s])
            going.append((flat[ends[s] - ends[0]:ends[e] - ends[0]].reshape(e - s, -1), [c[s:e] for c in rest]))
    yield from closed()
    yield from compared(waiting)


def near_embeddings(vectors: DataFrame, embedding: str = "embedding", key: str = "vec_id", *, cosine: float = 0.9, tables: int = TABLES,
                    probes: int = PROBES, scale: float = SCALE, block: int = BLOCK, seed: int = 8) -> DataFrame:
    """One row a vector: ``vec_id, n_links, component_id, kept``."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    # The same vector may occur in a third of all rows: it is hashed and compared once, with its number.
    classes = rows.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        unit = _units(batch.column(0).to_pylist())
        by_dim: dict[int, list[int]] = {}
        for r, u in enumerate(unit):
            if u is not None:
                by_dim.setdefault(len(u), []).append(r)
        keys: list = [None] * len(unit)
        digest: list = [None] * len(unit)
        for dim, members in by_dim.items():
            same = np.stack([unit[r] for r in members])
            found = cells(same, tables, probes, scale, seed)
            bits = np.pad(same.view(np.uint64), ((0, 0), (1, 0))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(dim + 1, dtype=np.uint64)
            marks = mix64(bits).sum(1).view(np.int64).tolist()
            for r, k, d in zip(members, found.reshape(len(members), -1), marks, strict=True):
                keys[r], digest[r] = k, d
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(digest, pa.int64()),
                                           pa.array(unit, pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int64()))],
                                          names=["vector", "least", "copies", "class", "unit", "keys"])

    known = cut_lineage(arrow_map(classes, hashed, "vector array<double>, least bigint, copies bigint, class bigint, unit array<double>, keys array<bigint>"))
    # Scaled copies have the same unit vector: one class.
    usable = known.where(F.col("class").isNotNull())
    merged = cut_lineage(usable.groupBy("class").agg(F.min("least").alias("least"), F.sum("copies").alias("copies"), F.first("unit").alias("vector"),
                                                     F.first("keys").alias("keys")))
    spread = merged.select("class", "copies", "vector", F.posexplode("keys").alias("rank", "key"))
    spread = spread.withColumns({"table": F.floor(F.col("rank") / (probes + 1)).cast("int"), "home": F.col("rank") % (probes + 1) == 0})
    slim = merged.select("class", F.posexplode("keys").alias("rank", "key"))
    sizes = (slim.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("rank") % (probes + 1) == 0).alias("homes"))
             .where((F.col("members") > 1) & (F.col("homes") > 0)))
    large = sizes.select("key", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    dealt = spread.join(large, "key").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "class", "copies", "table", "home", "vector",
                         (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))

    def run(batches):
        yield from _links(batches, cosine, tables, probes, scale, seed)

    blocks = dealt.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second")
    found = cut_lineage(blocks.mapInArrow(run, "class bigint, links bigint, root bigint"))
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.where(F.col("root") != F.col("class")).select(F.col("class").alias("a"), F.col("root").alias("b")))
    label = merged.select("class", "least", "copies").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = label.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = (label.join(least, "root").join(counts, "class", "left")
                 .select("class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    per_vector = known.select("vector", "class").join(per_class, "class", "left")
    out = rows.alias("r").join(per_vector.alias("p"), F.col("r.vector").eqNullSafe(F.col("p.vector")), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
