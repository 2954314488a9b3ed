"""Prefix trie of conversations: padded turn-id matrices, sorted and cut into nodes column by column.

A turn's id is a 128-bit digest of role and text, a conversation the string of its turn ids.  Conversations are
range-partitioned by that string and their own id, so that a shard holds a contiguous part of the trie in
depth-first order and copies of one conversation spread over shards.  In a shard the ids lie in a matrix padded
to a block of columns, for the rows that reach it; ``np.lexsort`` orders them, and the column change masks,
accumulated by OR along a row, mark the rows at which a node of each depth starts.  ``reduceat`` over the starts
gives the counts of every depth, and from the deepest upwards the sums over subtrees.

Only the nodes on the path of a shard's first and last row can lie in more than one shard.  These boundary nodes
are recombined by their digest: counts add up, and sums over boundary subtrees run along the chain of each
boundary row, of which every node belongs to the first chain that holds it.

Edge cases: null roles and texts are empty; rows without conversation id are left out; null turns come first and
equal turns are ordered by digest; a conversation may be left without turns and then ends at the root; an empty
table gives no node; extra columns are ignored.  A conversation's turn ids (20 bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, stored

#: Columns of a padded matrix, conversations and turns of a shard, rows that are sent to every task at most.
COLUMNS, SHARD_ROWS, SHARD_TURNS, BROADCAST_ROWS = 8, 200_000, 2_000_000, 100_000
NODE = ("kind int, node binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string, chain bigint, first_end bigint, ends string")
#: Kinds of rows a shard gives: nodes that are whole, nodes of a boundary row's path, places on such paths, ids of conversations that end there.
WHOLE, BOUNDARY, PLACE, ENDS = range(4)


def turn_sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as structs of 16-byte digest (hex) and word count."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    one = F.struct("turn", F.md5(told.cast("binary")).alias("id"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    return (rows.repartition((F.col("conv_id") - F.col("conv_id") % 20).alias("leader")).groupBy("conv_id")
            .agg(F.sort_array(F.collect_list("t")).alias("turns")))


def with_shared_starts(sequences: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of c - c % 20, h = crc32(c) % 4."""
    leader = F.col("conv_id") - F.col("conv_id") % 20
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    held = sequences.withColumn("leader", leader)
    head = F.max(F.when(F.col("conv_id") == F.col("leader"), F.slice("turns", 1, 3))).over(Window.partitionBy("leader"))
    led = held.select("conv_id", "turns", head.alias("head"), h.alias("h"))
    start = F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", F.lit(1), F.greatest("h", F.lit(1))))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return led.select("conv_id", F.concat(F.coalesce(start, F.slice("turns", 1, 0)), own).alias("turns"))


class Shard:
    """The trie of the conversations of one shard."""

    def __init__(self, conv_id: np.ndarray, size: np.ndarray, ids: np.ndarray, words: np.ndarray):
        self.first = np.concatenate(([0], np.cumsum(size)))
        self.ids, self.words = ids, words
        n, depth = len(conv_id), int(size.max(initial=0))
        order, group, rows = np.lexsort((conv_id, size > 0)), np.zeros(n, np.int64), np.arange(n)
        self.starts: list[np.ndarray] = [np.zeros(1, np.int64)]
        for block in range(0, depth, COLUMNS):
            rows = rows[size[order[rows]] > block]
            chosen = order[rows]
            shown = np.arange(block, min(block + COLUMNS, depth))
            inside = shown < size[chosen][:, None]
            matrix = np.zeros((len(rows), len(shown), 2), np.uint64)
            matrix[inside] = ids[(self.first[chosen][:, None] + shown)[inside]]
            # Rows that end within the block go before those of the same turns that go on.
            keys = [conv_id[chosen], size[chosen] > block + COLUMNS]
            for column in reversed(range(len(shown))):
                keys += [matrix[:, column, 1], matrix[:, column, 0]]
            by = np.lexsort([*keys, group[rows]])
            order[rows], matrix, before = chosen[by], matrix[by], group[rows]
            changed = np.ones((len(rows), len(shown)), bool)
            changed[1:] = (matrix[1:] != matrix[:-1]).any(2)
            changed[1:, 0] |= before[1:] != before[:-1]
            changed = np.logical_or.accumulate(changed, axis=1)
            length = size[order[rows]]
            for column, d in enumerate(shown + 1):
                self.starts.append(rows[changed[:, column] & (length >= d)])
            group[rows] = np.cumsum(changed[:, -1])
        self.conv_id, self.size = conv_id[order], size[order]
        self.order = order

    def path(self, row: int) -> np.ndarray:
        at = self.first[self.order[row]]
        return self.ids[at:at + self.size[row]]

    def nodes(self) -> Iterator[dict]:
        """Nodes of every depth, the deepest first, as arrays with ``start`` (first row) and ``boundary``."""
        n = len(self.conv_id)
        members = np.arange(n)
        deeper: dict | None = None
        made = []
        alive = [members]
        for d in range(1, len(self.starts)):
            alive.append(alive[-1][self.size[alive[-1]] >= d])
        for d in range(len(self.starts) - 1, -1, -1):
            start, rows = self.starts[d], alive[d]
            at = np.searchsorted(rows, start)
            count = np.diff(np.append(at, len(rows)))
            least = np.minimum.reduceat(self.conv_id[rows], at)
            ended = np.add.reduceat((self.size[rows] == d).astype(np.int64), at)
            words = self.words[self.first[self.order[start]] + d - 1].astype(np.int64) if d else np.zeros(len(start), np.int64)
            last = rows[np.append(at[1:], len(rows)) - 1]
            boundary = (start == 0) | (last == n - 1)
            children = leaves = saved = np.zeros(len(start), np.int64)
            if deeper is not None and len(deeper["start"]):
                parent = np.searchsorted(start, deeper["start"], "right") - 1
                # Boundary children of a node are recombined elsewhere; of others everything is known here.
                own = ~deeper["boundary"]
                children = np.bincount(parent[own], minlength=len(start))
                leaves, saved = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
                np.add.at(leaves, parent, deeper["leaves"])
                np.add.at(saved, parent, deeper["saved"])
                deeper["parent"] = parent
                deeper["parent_conv_id"] = least[parent]
                deeper["parent_boundary"] = boundary[parent]
            leaves = leaves + (~boundary & (children == 0))
            saved = saved + np.where(boundary, 0, (count - 1) * words)
            if deeper is not None:
                made.append(deeper)
            deeper = {"depth": d, "start": start, "last": last, "boundary": boundary, "conv_id": least, "n": count, "ended": ended, "words": words,
                      "children": children, "leaves": leaves, "saved": saved}
        made.append(deeper)
        yield from made


def _digests(path: np.ndarray) -> list[bytes]:
    """Digest of every prefix of a path, the empty one first."""
    h = hashlib.md5()
    out = [h.digest()]
    for turn in path:
        h.update(turn.tobytes())
        out.append(h.digest())
    return out


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    conv_id = table.column("conv_id").to_numpy().astype(np.int64)
    path, words = (table.column(c).combine_chunks() for c in ("path", "words"))
    ids = np.frombuffer(b"".join(path.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
    size = np.diff(words.offsets.to_numpy()).astype(np.int64)
    shard = Shard(conv_id, size, ids, words.flatten().to_numpy().astype(np.int64))
    n = len(conv_id)
    chains = 2 * TaskContext.get().partitionId() + np.arange(2)
    edge = [_digests(shard.path(0)), _digests(shard.path(n - 1))]
    out: list[tuple] = []
    for level in shard.nodes():
        d, root = level["depth"], level["depth"] == 0
        for k in range(len(level["start"])):
            start, ended = int(level["start"][k]), int(level["ended"][k])
            ids_here = ",".join(map(str, shard.conv_id[start:start + ended].tolist()))
            row = (int(level["conv_id"][k]), d)
            sums = tuple(int(level[c][k]) for c in ("n", "children", "leaves", "saved", "words"))
            if level["boundary"][k]:
                side = 0 if start == 0 else 1
                node, parent = edge[side][d], None if root else edge[side][d - 1]
                out.append((BOUNDARY, node, parent, *row, None, *sums, None, None, None, None))
                if ended:
                    out.append((ENDS, node, None, *row, *[None] * 8, int(shard.conv_id[start]), ids_here))
                for chain in {side, 1 if level["last"][k] == n - 1 else side}:
                    out.append((PLACE, edge[chain][d], None, *row, *[None] * 7, int(chains[chain]), None, None))
            else:
                # The parent's least conversation is known here unless the parent is a boundary node.
                open_parent = level["parent_boundary"][k]
                side = 0 if start <= shard_side(shard, d - 1, 0) else 1
                out.append((WHOLE, None, edge[side][d - 1] if open_parent else None, *row, None if open_parent else int(level["parent_conv_id"][k]), *sums,
                            hashlib.sha256(ids_here.encode()).hexdigest(), int(chains[side]) if open_parent else None, None, None))
            if len(out) >= 20_000:
                yield _arrow(out)
                out = []
    if out:
        yield _arrow(out)


def shard_side(shard: Shard, depth: int, row: int) -> int:
    """Last row whose first ``depth`` turns are those of ``row`` 0 (its depth-``depth`` node)."""
    starts = shard.starts[depth]
    return int(starts[1]) - 1 if len(starts) > 1 else len(shard.conv_id) - 1


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in NODE.split(", ")]
    kind = {"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kind[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of a node, whose parts follow one another in order."""
    node, sha, done = None, None, []
    for batch in batches:
        for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if at != node:
                if node is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = at, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(part.encode())
    if node is not None:
        done.append((node, sha.hexdigest()))
    if done:
        nodes, digests = zip(*done, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])


def _boundary(parts: DataFrame) -> DataFrame:
    """Whole boundary nodes from the parts that shards hold: ``node`` and the columns of the result."""
    part = parts.where(F.col("kind") == BOUNDARY)
    node = part.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    inner = node.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("inner"))
    node = node.join(inner, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0))).drop("inner")
    # Every node belongs to the first chain that holds it; a chain adds the sums of its own nodes to all nodes above.
    place = parts.where(F.col("kind") == PLACE).select("node", "chain", "depth").distinct()
    own = place.groupBy("node").agg(F.min("chain").alias("owner"))
    gain = node.select("node", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("gain"))
    below = Window.partitionBy("chain").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.col("chain") == F.col("owner")
    sums = (place.join(own, "node").join(gain, "node")
            .select("node", F.sum(F.when(mine, F.col("leaf")).otherwise(0)).over(below).alias("leaf"), F.sum(F.when(mine, F.col("gain")).otherwise(0)).over(below).alias("gain"))
            .groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("gain").alias("gain")))
    ends = (parts.where(F.col("kind") == ENDS).select("node", "first_end", "ends").repartition("node").sortWithinPartitions("node", "first_end")
            .select("node", "ends").mapInArrow(_stream_hashes, "node binary, ends_sha256 string"))
    above = node.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (node.join(sums, "node").join(above, "parent", "left").join(ends, "node", "left")
            .select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
                    (F.col("saved_tokens") + F.col("gain")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row a trie node of ``sequences`` (``conv_id, turns``): see ``turn_sequences``."""
    path: Column = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    flat = stored(sequences.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")))
    rows, turns = flat.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    shards = max(1 + rows // SHARD_ROWS, 1 + turns // SHARD_TURNS, min(rows, int(flat.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = stored(flat.repartitionByRange(int(shards), "path", "conv_id").mapInArrow(_shard_rows, NODE))
    joined = stored(_boundary(parts))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = parts.where(F.col("kind") == WHOLE)
    # Parents on a boundary path, by chain and depth: no key is met by more rows than a shard has.
    chained = parts.where(F.col("kind") == PLACE).select("node", F.col("chain").alias("__chain"), F.col("depth").alias("__depth")).distinct()
    known = chained.join(joined.select("node", F.col("conv_id").alias("__conv_id")), "node").drop("node")
    known = stored(known)
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    opened = (whole.where(F.col("chain").isNotNull())
              .join(known, (F.col("chain") == F.col("__chain")) & (F.col("depth") - 1 == F.col("__depth")))
              .withColumn("parent_conv_id", F.col("__conv_id")))
    return whole.where(F.col("chain").isNull()).select(*columns).union(opened.select(*columns)).union(joined.select(*columns))
