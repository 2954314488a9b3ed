"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges.

A document is the set of its distinct word shingles (two words here), each a 64-bit hash.  Equal sets are one
node.  One permutation splits the hash range into bins; a bin's value is its least hash, and an empty bin
takes the value of a bin drawn for it by a universal hash, again until it is not empty (optimal
densification).  ``rows`` bins make a band; nodes with an equal band share a bucket.

Sets of few shingles fill the bins with copies of few values, so that one common shingle could make a band.
They get wide bands of eight bins drawn from the signature, more of them; sizes around the border get
both kinds, so that every pair within the threshold's size ratio shares one kind.

In every bucket all nodes are linked to one hub, not to each other, and every candidate edge is confirmed on
the full sets.  With 32 bands of 4 a pair at the threshold of 0.8 shares a bucket but for 1 in 20 million.
Buckets that still hold several components are treated again: with another hub each, and at last exactly,
every node against all nodes of other components.  So the star only saves work, it loses no link.

Edge cases: with fewer words than a shingle the whole sequence is the only shingle; null and empty texts have
an empty set and are linked with nothing; rows with equal ids are treated each on its own text; extra columns
are not returned; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, Hashed, arrow_map, by_bytes, joined, mix64, pieces, stored, texts_of, word_bounds
from .graph import components, near_labels

#: Ids that are sent to every task at most; more are joined by a shuffle.
BROADCAST_IDS = 100_000
STAR_ROUNDS = 2
#: Nodes of a bucket whose pairs are listed; above it buckets are compared in blocks of BLOCK nodes.
FEW, BLOCK = 8, 512

#: Sets up to SMALL shingles have SMALL_BANDS bands, each of SMALL_ROWS of their SMALL_BINS bins.
SMALL, SMALL_BINS, SMALL_BANDS, SMALL_ROWS = 40, 256, 96, 8

_SEED = np.uint64(0x8CB92BA72F3D8DD7)


def _words(text: bytes) -> np.ndarray:
    """Hashes of the words of one text, in order."""
    out = []
    for piece in pieces(text):
        data = np.frombuffer(piece, np.uint8)
        if len(data):
            out.append(Hashed(data).ranges(*word_bounds(data)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _chain(words: np.ndarray, n: int) -> np.ndarray:
    h = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        h = mix64(h * np.uint64(3) + words[i: len(words) - n + 1 + i] * _SEED)
    return mix64(h + np.uint64(n))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    out: list[np.ndarray] = []
    for a, b in by_bytes(texts):
        if b - a == 1:
            words, cuts = _words(texts[a].lower()), None
            runs = [words]
        else:
            data, seps = joined([t.lower() for t in texts[a:b]])
            starts, ends = word_bounds(data)
            words = Hashed(data).ranges(starts, ends)
            cuts = np.searchsorted(starts, seps)
            runs = [words[cuts[i]:cuts[i + 1]] for i in range(b - a)]
        for w in runs:
            out.append(np.unique(_chain(w, min(n, len(w)))) if len(w) else w)
    return out


def _draws(bins: int, attempts: int) -> np.ndarray:
    """Bin drawn for an empty bin at each attempt, the same for every document."""
    i = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(attempts, dtype=np.uint64)[None, :]
    return (mix64(i + _SEED) >> np.uint64(40)).astype(np.int64) % bins


_DRAWN: dict[int, np.ndarray] = {}


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One value a bin, from sorted distinct hashes (at least one); ``bins`` is a power of two."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    bin_of = (shingles >> shift).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bin_of[1:] != bin_of[:-1])))
    value = np.zeros(bins, np.uint64)
    full = np.zeros(bins, bool)
    value[bin_of[first]], full[bin_of[first]] = shingles[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        drawn = _DRAWN.get(bins)
        if drawn is None:
            drawn = _DRAWN[bins] = _draws(bins, 32 * bins)
        at, left, step = np.zeros(bins, np.int64), empty, 16
        done = 0
        while len(left):
            look = drawn[left, done:done + step]
            if look.shape[1] == 0:  # never met in practice: the next full bin
                at[left] = np.flatnonzero(full)[np.searchsorted(np.flatnonzero(full), left) % full.sum()]
                break
            hit = full[look]
            found = hit.any(1)
            at[left[found]] = look[found, hit[found].argmax(1)]
            left, done, step = left[~found], done + step, step * 4
        value[empty] = value[at[empty]]
    return value


#: Bins of each wide band.
_PICKED = (mix64(np.arange(SMALL_BANDS * SMALL_ROWS, dtype=np.uint64) * _SEED) % np.uint64(SMALL_BINS)).astype(np.int64).reshape(SMALL_BANDS, SMALL_ROWS)


def _folded(values: np.ndarray, kind: int) -> np.ndarray:
    """One key a band (row of ``values``)."""
    h = (np.arange(len(values), dtype=np.uint64) + np.uint64(kind << 20)) * np.uint64(0x632BE59BD9B4E019)
    for i in range(values.shape[1]):
        h = mix64(h * np.uint64(3) + values[:, i])
    return h.view(np.int64)


def band_keys(shingles: np.ndarray, bands: int, rows: int, percent: int) -> np.ndarray:
    """Keys of the bands of one set."""
    keys = []
    if len(shingles) <= SMALL:
        keys.append(_folded(mix64(signature(shingles, SMALL_BINS))[_PICKED], 1))
    if len(shingles) * 100 >= SMALL * percent:
        keys.append(_folded(mix64(signature(shingles, bands * rows)).reshape(bands, rows), 0))
    return np.concatenate(keys)


def signatures(docs: DataFrame, text: str, key: str, n: int, bands: int, rows: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, node, bands, text_hash``: node is a 128-bit digest of the set, null where it is empty."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_of(batch.column(1)), n)
        node, band = [], []
        for s in sets:
            if not len(s):
                node.append(None)
                band.append([])
                continue
            node.append(np.array([mix64(s + _SEED).sum(), mix64(s * np.uint64(5) + np.uint64(len(s))).sum()], np.uint64).tobytes())
            band.append(band_keys(s, bands, rows, percent))
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(band, pa.list_(pa.int64())),
            batch.column(2)], names=["doc_id", "n_shingles", "node", "bands", "text_hash"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    return arrow_map(slim, run, "doc_id bigint, n_shingles bigint, node binary, bands array<bigint>, text_hash bigint")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", *, shingle: int = 2, percent: int = 80,
                    bands: int = 32, rows: int = 4) -> DataFrame:
    """One row a document: ``doc_id, text_hash, n_shingles, node, group, component_id, kept``.

    ``group`` is the digest of the component's first set; ``component_id`` the least doc_id of the component.
    """
    signed = stored(signatures(docs, text, key, shingle, bands, rows, percent))
    nodes = stored(signed.where(F.col("node").isNotNull()).groupBy("node")
                        .agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    # Different sets of fewer than percent / (100 - percent) shingles cannot reach the threshold.
    buckets = stored(_shared_buckets(nodes.where(F.col("n") * (100 - percent) >= percent)))
    repeats = not signed.groupBy("doc_id").count().where("count > 1").isEmpty()
    sets = stored(_sets(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), buckets, shingle, repeats))
    links = _confirmed_links(buckets, sets, percent)
    roots = components(links)
    label = (nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    group = label.groupBy("root").agg(F.min("first_id").alias("component_id"))
    final = label.select("node", "root").join(group, "root").select("node", F.col("root").alias("group"), "component_id")
    known = signed.select("doc_id", "text_hash", "n_shingles", "node").join(final, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return known.select("doc_id", "text_hash", "n_shingles", "node", "group", component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """One document of each group, the one with the least id; documents without words all stay."""
    found = stored(near_duplicates(docs, text, key, **how))
    chosen = found.where("node is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    keep = chosen.union(found.where("node is null").select("doc_id", "text_hash").distinct()).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same = F.col(key).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__hash"))
    kept = docs.join(keep, same, "left_semi")
    again = found.where("node is not null").groupBy("doc_id", "text_hash").count().where("count > 1")
    if again.isEmpty():
        return kept
    some = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")) > 0
    return kept.where(some).dropDuplicates([key, text]).unionByName(kept.where(~some))


def _shared_buckets(nodes: DataFrame) -> DataFrame:
    """``bucket, node, n, first_id`` of the buckets that more than one node shares; of buckets with the same members, one."""
    member = nodes.select("node", "n", "first_id", F.explode("bands").alias("bucket"))
    h = F.xxhash64("node")
    told = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"))
    shared = told.where(F.col("members") > 1).groupBy("members", "s", "x").agg(F.min("bucket").alias("bucket"))
    return member.join(shared.select("bucket"), "bucket")


def _fits(percent: int, n1: Column, n2: Column) -> Column:
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def _confirmed_links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that connect every pair of nodes that a bucket holds and that reach the threshold."""
    compared = None  # a < b, both: every pair confirmed or refused so far, with the size of the intersection
    active = buckets.withColumn("root", F.col("node"))
    for turn in range(STAR_ROUNDS):
        order = F.col("first_id") if turn == 0 else F.xxhash64("node", "bucket", F.lit(turn))
        hub = active.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "node", "n", "root")).alias("hub"))
        star = (active.join(hub, "bucket").where((F.col("root") != F.col("hub.root")) & _fits(percent, F.col("n"), F.col("hub.n")))
                .select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct())
        if compared is not None:
            star = star.join(compared.select("a", "b"), ["a", "b"], "left_anti")
        checked = stored(_intersections(star, sets))
        compared = checked if compared is None else compared.union(checked)
        mixed = _mixed(buckets, _linked(compared, percent))
        active = stored(mixed)
        if active.isEmpty():
            return _linked(compared, percent)
    return _linked(compared, percent).union(_rest(active, compared, sets, percent))


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    union = F.col("na") + F.col("nb") - F.col("common")
    return compared.where(F.col("common") * 100 >= union * percent).select("a", "b")


def _mixed(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the buckets whose nodes the links found so far do not evidently connect, with their label.

    Labels of two steps along the links are finer than components, which only means some comparisons more.
    """
    roots = near_labels(links)
    member = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = member.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where(F.col("x") != F.col("y"))
    return member.join(several.select("bucket"), "bucket")


def _sets(docs: DataFrame, buckets: DataFrame, shingle: int, repeats: bool) -> DataFrame:
    """``node, set`` of the nodes of the shared buckets, from the text of one document each."""
    wanted = stored(buckets.select("node", "first_id").distinct())
    few = wanted.count() <= BROADCAST_IDS
    ids = wanted.select("first_id").distinct()
    picked = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(ids["first_id"]), "left_semi")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_of(batch.column(0)), shingle)
        node = [np.array([mix64(s + _SEED).sum(), mix64(s * np.uint64(5) + np.uint64(len(s))).sum()], np.uint64).tobytes() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                                          names=["node", "set"])

    found = arrow_map(picked.select("text"), run, "node binary, set array<bigint>").where(F.col("node").isNotNull())
    # Rows with equal ids may repeat a text: one set a node.
    return found.groupBy("node").agg(F.first("set").alias("set")) if repeats else found


def _intersections(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, na, nb, common`` of every pair, on the full sets."""
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    both = one.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    return both.select("a", "b", F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"),
                       F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))


def _rest(active: DataFrame, compared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between different components that share a bucket, found exactly.

    Buckets of up to ``FEW`` nodes give their pairs, at most ``FEW`` / 2 a node, each confirmed once however many
    buckets share it.  Larger buckets are dealt in blocks, compared within themselves first, then with one another where
    components are left, with each node's set sent along once a pair of blocks; a task counts intersections by an
    inverted index and returns a spanning forest of its components.
    """
    size = active.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"))
    member = stored(active.select("bucket", "node", "n", "root").join(size, "bucket"))
    few = member.where(F.col("members") <= FEW)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
                   & _fits(percent, F.col("x.n"), F.col("y.n"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    small = stored(_linked(_intersections(pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti"), sets), percent))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    many = member.where(F.col("members") > FEW).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    inside = stored(_compared_blocks(many.withColumn("first", F.col("own")).withColumn("second", F.col("own")), sets, percent))
    # Blocks are compared with one another only after their own links have joined nodes: a group of near copies is then one
    # component a block, which meets every other block in one link.
    roots = components(_linked(compared, percent).union(inside).union(small))
    again = many.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = again.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where(F.col("x") != F.col("y"))
    dealt = (again.where(F.col("blocks") > 1).join(several.select("bucket"), "bucket")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("own") != F.col("other"))
             .withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")}))
    return stored(small.union(inside).union(_compared_blocks(dealt, sets, percent)))


def _compared_blocks(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that join the components within each ``bucket, first, second``, at most one fewer than its rows."""
    rows = (dealt.select("bucket", "first", "second", "node", "root").join(sets, "node").select("bucket", "first", "second", "node", "root", "set")
            .repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second"))
    return rows.mapInArrow(lambda batches: _block_links(batches, percent), "a binary, b binary")


def _block_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of the blocks whose rows follow one another."""
    held: list[tuple] = []
    held_key = None
    for batch in batches:
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True))
        nodes, roots = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        column = batch.column(5)
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
        for r, key in enumerate(keys):
            if key != held_key:
                yield from _close_block(held, percent)
                held, held_key = [], key
            held.append((nodes[r], roots[r], flat[ends[r]:ends[r + 1]]))
    yield from _close_block(held, percent)


def _close_block(rows: list[tuple], percent: int) -> Iterator[pa.RecordBatch]:
    roots = np.unique([r[1] for r in rows], return_inverse=True)[1] if rows else np.zeros(0, np.int64)
    if not len(roots) or roots.max() == 0:
        return
    size = np.array([len(r[2]) for r in rows])
    values = np.concatenate([r[2] for r in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    # The greatest component is met by all others, so its own members need not be looked up.
    usual = np.bincount(roots).argmax()
    joined, left = list(range(roots.max() + 1)), int(roots.max())
    found: list[tuple[bytes, bytes]] = []

    def top(r: int) -> int:
        while joined[r] != r:
            joined[r] = joined[joined[r]]
            r = joined[r]
        return r

    for i in np.flatnonzero(roots != usual):
        if not left:
            break
        low, high = np.searchsorted(values, rows[i][2], "left"), np.searchsorted(values, rows[i][2], "right")
        length = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        common = np.bincount(owner[at], minlength=len(rows))
        for j in np.flatnonzero((common * 100 >= (size + size[i] - common) * percent) & (roots != roots[i])):
            x, y = top(roots[i]), top(roots[j])
            if x != y:
                joined[x] = y
                left -= 1
                found.append(tuple(sorted((rows[i][0], rows[j][0]))))
    if found:
        a, b = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
