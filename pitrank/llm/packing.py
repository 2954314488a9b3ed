"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Every document is tokenized whole and ends with a separator id.  Full windows are cut off it; what is left
(its tail) joins a block of tails whose sum fills a fixed number of windows.  Tails are cut into smaller
parts, and multiway differencing spreads the parts of a block over its windows: partial partitions are
merged, the two with the greatest imbalance first, the largest loads of one with the smallest of the other,
which gives near-equal windows.  Whenever a window exceeds the capacity the block gets one window more.

A task packs the rows of its own partition in blocks of bounded size, so nothing is shuffled or collected
and a lost task is simply packed again.  Only the last block of a partition can be short.

Edge cases: null and empty texts are the separator alone; rows with equal ids are packed each on its own; an
empty table gives no piece; extra columns are not returned.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
# Fixed value: how byte-level BPE files with their own pattern ("use_regex") split a text before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Sizes of the small parts cut for every window of a block: they even out what the larger parts leave.
GRADES = (16, 8, 4, 2, 1)


class Tokens:
    """Ids of whole texts as little-endian uint32 bytes, equal to those of the tokenizer file at ``path``.

    A plain byte-level BPE file (ids in the order of merges) is run by tiktoken, which takes a third of the time;
    any other file by the tokenizers library itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = (model.get("type", "BPE") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex")
                 and not before.get("add_prefix_space") and not model.get("ignore_merges") and not model.get("dropout"))
        self.plain = self.model = None
        if plain:
            import tiktoken

            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            byte_of = _byte_alphabet()
            ranks = {bytes(byte_of[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
            self.plain = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)

    def __call__(self, text: str) -> bytes:
        if self.plain is not None:
            ids = self.plain.encode(text, allowed_special="all")
        else:
            ids = self.model.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


_TOKENS: dict[str, Tokens] = {}


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indexes of ``sizes`` by window: multiway largest differencing."""
    heap, groups = [], {}
    for i, s in enumerate(sizes):
        loads = np.zeros(windows, np.int64)
        loads[-1] = s
        groups[i] = {windows - 1: [i]}
        heap.append((-s, i, loads))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        total = x + y[::-1]
        order = np.argsort(total, kind="stable")
        rank = np.empty(windows, np.int64)
        rank[order] = np.arange(windows)
        merged: dict[int, list[int]] = {}
        for slot, items in groups.pop(a).items():
            merged[int(rank[slot])] = items
        for slot, items in groups.pop(b).items():
            at = int(rank[windows - 1 - slot])
            merged[at] = merged[at] + items if at in merged else items
        loads = total[order]
        loads -= loads[0]  # only differences matter
        groups[made] = merged
        heapq.heappush(heap, (-int(loads[-1]), made, loads))
        made += 1
    out: list[list[int]] = [[] for _ in range(windows)]
    for slot, items in (groups.popitem()[1] if groups else {}).items():
        out[slot] = items
    return out


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of near-equal load within ``capacity``; every size must fit."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return [w for w in found if w]
        windows += 1


def pack_rows(rows: Iterator[tuple[int | None, bytes]], capacity: int, block_windows: int, part: int, slack: int) -> Iterator[tuple]:
    """Pieces ``(doc_id, start, ids, doc_tokens, window, offset)`` of ``(doc_id, ids)`` rows."""
    window = 0
    tails: list[tuple] = []
    held = 0
    full = block_windows * capacity - slack * block_windows

    def close():
        nonlocal window, tails, held
        parts, fine = [], [w for w in GRADES for _ in range(max(1, held // capacity))]
        for d, s, ids, n in tails:
            at, size = 0, len(ids) // 4
            while at < size:
                take = min(size - at, fine.pop(0) if fine else part)
                parts.append((d, s + at, ids[4 * at:4 * (at + take)], n))
                at += take
        for members in pack_block([len(p[2]) // 4 for p in parts], capacity):
            offset = 0
            for i in members:
                d, s, ids, n = parts[i]
                yield d, s, ids, n, window, offset
                offset += len(ids) // 4
            window += 1
        tails, held = [], 0

    for doc, ids in rows:
        n = len(ids) // 4
        whole = n - n % capacity
        for at in range(0, whole, capacity):
            yield doc, at, ids[4 * at:4 * (at + capacity)], n, window, 0
            window += 1
        at = whole
        while at < n:
            take = min(n - at, full - held)
            tails.append((doc, at, ids[4 * at:4 * (at + take)], n))
            held += take
            at += take
            if held >= full:
                yield from close()
    if tails:
        yield from close()


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", *, capacity: int = 1024,
                   separator: int = 0, block_windows: int = 32, part: int = 192, slack: int = 1, batch_rows: int = 8192) -> DataFrame:
    """One row a piece: ids ``start .. start + length`` of a document at ``offset`` of ``sequence_id``."""
    end = np.array([separator], "<u4").tobytes()

    def run(batches):
        encode = _TOKENS.setdefault(tokenizer, None) or Tokens(tokenizer)
        _TOKENS[tokenizer] = encode
        first = TaskContext.get().partitionId() << 40

        def rows():
            for batch in batches:
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield doc, encode(body.as_py() or "") + end

        out: list[tuple] = []
        size = 0
        for piece in pack_rows(rows(), capacity, block_windows, part, slack):
            out.append(piece)
            size += len(piece[2])
            if len(out) >= batch_rows or size > 4_000_000:
                yield batch_of(out, first)
                out, size = [], 0
        if out:
            yield batch_of(out, first)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)


def batch_of(pieces: list[tuple], first: int) -> pa.RecordBatch:
    doc, start, ids, n, window, offset = zip(*pieces, strict=True)
    return pa.RecordBatch.from_arrays([
        pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
        pa.array(n, pa.int64()), pa.array([first + w for w in window], pa.int64()), pa.array(offset, pa.int64())],
        names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
