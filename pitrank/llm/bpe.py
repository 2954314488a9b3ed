"""BPE encoding and decoding of whole texts by a segment tree over adjacent pair ranks.

The pieces of a text follow the tokenizer file: strings of special tokens are cut out first, the rest is
normalized (NFC, lower case by character) and split by the file's pattern, white space is dropped, and the
bytes of a piece become symbols, the last one with the word-end suffix.  Merging keeps a segment tree with
one leaf an adjacent pair: a leaf holds its merge rank and its place in one number, so that the root yields
the leftmost pair of lowest rank.  A merge changes at most three leaves, each with a logarithmic update, and
merging ends when no mergeable pair remains.

Decoding joins the tokens of the ids by spaces, as the library does for a file without a decoder.

A text is cut at spaces and line ends, across which no token reaches, so that memory is bounded by the
longest run without them; short runs are encoded once and kept in a cache of bounded size.

Edge cases: null and empty texts have no ids and decode to the empty text; texts are read whole, whatever
their length; rows with equal ids or texts are each encoded; an empty table gives no row; extra columns pass
through, except those with the name of a made one.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from .common import append_map, by_bytes
from .packing import _byte_alphabet

#: Characters a run may have to be kept in the cache, runs kept, and characters that are split at a time.
CACHED_CHARS, CACHED_RUNS, SPAN = 48, 1 << 19, 1 << 21
#: Symbols of a word from which it is merged by itself, and words merged together.
LONG, ROWS = 64, 1 << 11
#: Runs treated by themselves: with special tokens, unusual white space, or letters whose class depends on the Unicode version.
UNUSUAL = regex.compile("[<\\s\\x1c-\\x1f\u0530-\U0010ffff]")
NONE = 1 << 40


class PairTree:
    """Live pair ranks of one piece; ``least`` is the leftmost pair of lowest rank."""

    def __init__(self, ranks: list[int | None]):
        self.leaves = 1 << max(len(ranks) - 1, 0).bit_length()
        self.none = NONE
        fresh = [self.none] * (2 * self.leaves)
        # Numbers of a long piece lie in a flat array of 8 bytes each.
        self.tree = array("q", fresh) if self.leaves > 4096 else fresh
        for i, rank in enumerate(ranks):
            if rank is not None:
                self.tree[self.leaves + i] = rank * self.leaves + i
        for at in range(self.leaves - 1, 0, -1):
            left, right = self.tree[2 * at], self.tree[2 * at + 1]
            self.tree[at] = left if left < right else right

    def least(self) -> int | None:
        root = self.tree[1]
        return None if root == self.none else root % self.leaves

    def put(self, i: int, rank: int | None) -> None:
        tree, at = self.tree, self.leaves + i
        tree[at] = self.none if rank is None else rank * self.leaves + i
        while at > 1:
            at >>= 1
            left, right = tree[2 * at], tree[2 * at + 1]
            least = left if left < right else right
            if tree[at] == least:
                break
            tree[at] = least


def merge_symbols(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Ids after all merges; ``merges`` maps a pair to its rank and its merged id."""
    n = len(symbols)
    if n < 2:
        return symbols
    ids = list(symbols) if n <= 4096 else array("i", symbols)
    after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))

    def rank(i: int) -> int | None:
        found = merges.get((ids[i], ids[after[i]])) if after[i] < n else None
        return found and found[0]

    tree = PairTree([rank(i) for i in range(n - 1)])
    while (i := tree.least()) is not None:
        j = after[i]
        ids[i] = merges[ids[i], ids[j]][1]
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if j < n - 1:
            tree.put(j, None)
        if i < n - 1:
            tree.put(i, rank(i))
        if before[i] >= 0:
            tree.put(before[i], rank(before[i]))
    out, at = [], 0
    while at < n:
        out.append(ids[at])
        at = after[at]
    return out


def merge_words(flat: np.ndarray, bounds: np.ndarray, table: "MergeTable") -> np.ndarray:
    """Merge many words at once: word w is ``flat[bounds[w]:bounds[w + 1]]``; one tree a word, as rows of one array.

    Ids are merged in place; the mask returned is false where a symbol went into the one before it.
    """
    alive = np.ones(len(flat), bool)
    size = np.diff(bounds)
    for w in np.flatnonzero(size > LONG):
        a, b = bounds[w], bounds[w + 1]
        merged = merge_symbols(flat[a:b].tolist(), table.pairs)
        flat[a:a + len(merged)] = merged
        alive[a + len(merged):b] = False
    leaves = 1
    while leaves < LONG:
        chosen = np.flatnonzero((size > (1 if leaves == 1 else leaves // 2 + 1)) & (size <= leaves + 1))
        for at in range(0, len(chosen), ROWS):
            part = chosen[at:at + ROWS]
            _merge_rows(flat, alive, bounds[part], size[part], leaves, table)
        leaves *= 2
    return alive


def _merge_rows(flat: np.ndarray, alive: np.ndarray, start: np.ndarray, size: np.ndarray, leaves: int, table: "MergeTable") -> None:
    n, width = len(size), leaves + 1
    place = np.arange(width)
    inside = place < size[:, None]
    where = (start[:, None] + place)[inside]
    ids = np.full((n, width), -1, np.int64)
    ids[inside] = flat[where]
    after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
    tree = np.full((n, 2 * leaves), NONE, np.int64)
    rank = table.ranks(ids[:, :-1], ids[:, 1:])
    tree[:, leaves:] = np.where(rank < table.none, rank * leaves + place[:-1], NONE)
    level = leaves
    while level > 1:
        tree[:, level >> 1:level] = tree[:, level:2 * level].reshape(n, level >> 1, 2).min(2)
        level >>= 1
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        root = tree[rows, 1]
        i = root % leaves
        j = after[rows, i]
        made = table.merged[root // leaves]
        ids[rows, i], ids[rows, j] = made, -1
        k = after[rows, j]
        after[rows, i] = k
        inner = k < size[rows]
        before[rows[inner], k[inner]] = i[inner]
        # Up to three leaves change: the pair that began at j is gone, those that begin and end at i are new.
        h = before[rows, i]
        one = table.ranks(made, np.where(inner, ids[rows, np.minimum(k, width - 1)], -1))
        two = table.ranks(np.where(h >= 0, ids[rows, np.maximum(h, 0)], -1), made)
        at = leaves + np.stack([np.minimum(j, leaves - 1), np.minimum(i, leaves - 1), np.maximum(h, 0)])
        tree[rows, at[0]] = NONE
        tree[rows, at[1]] = np.where(one < table.none, one * leaves + i, NONE)
        tree[rows, at[2]] = np.where(h < 0, tree[rows, at[2]], np.where(two < table.none, two * leaves + h, NONE))
        level = leaves
        while level > 1:
            at >>= 1
            level >>= 1
            for leaf in at:
                tree[rows, leaf] = np.minimum(tree[rows, 2 * leaf], tree[rows, 2 * leaf + 1])
        rows = rows[tree[rows, 1] < NONE]
    flat[where] = ids[inside]
    alive[where] = ids[inside] >= 0


class MergeTable:
    """Merge ranks of pairs of ids, looked up one by one (``pairs``) or in arrays (``ranks``)."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.pairs = pairs
        made = sorted((a << 32 | b, rank) for (a, b), (rank, _) in pairs.items())
        self.keys, self.rank = np.array([m[0] for m in made], np.int64), np.array([m[1] for m in made], np.int64)
        self.none = 1 + max((rank for rank, _ in pairs.values()), default=-1)
        self.merged = np.zeros(self.none, np.int64)
        for rank, made_id in pairs.values():
            self.merged[rank] = made_id

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``none`` where it does not merge or an id is -1."""
        if not len(self.keys):
            return np.full(a.shape, self.none)
        key = np.where((a < 0) | (b < 0), -1, a << 32 | b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)


class WordBPE:
    """Encoder and decoder of a BPE file with a word-end suffix, a split pattern and byte symbols."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        pre = spec["pre_tokenizer"]["pretokenizers"] if (spec.get("pre_tokenizer") or {}).get("type") == "Sequence" else []
        known = (model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("ignore_merges") and not model.get("dropout")
                 and not model.get("continuing_subword_prefix") and not model.get("byte_fallback") and spec.get("decoder") is None
                 and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
                 and [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["invert"] and pre[0]["behavior"] == "Removed"
                 and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
                 and all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"]))
        if not known:
            raise ValueError("not a BPE file with NFC and lower case, a split pattern, byte symbols and word ends")
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"])
        # Characters beyond the common alphabets are normalized and classed by the library, whose Unicode version counts.
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = Split(Regex(pre[0]["pattern"]["Regex"]), "removed", invert=True)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.cut = regex.compile(f"({names})") if names else None
        vocab = model["vocab"]
        self.token = {i: w for w, i in [*vocab.items(), *self.special.items()]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.table = MergeTable({(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)})
        suffix = model["end_of_word_suffix"]
        letters = sorted(_byte_alphabet().items(), key=lambda item: item[1])
        self.inner, self.last = [vocab[c] for c, _ in letters], [vocab[c + suffix] for c, _ in letters]
        self.inner, self.last = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.names = np.array([self.token.get(i, "") for i in range(max(self.token) + 1)], object)
        self.split = regex.compile(" |" + pre[0]["pattern"]["Regex"])
        # Encoded runs: their ids and their decoded text; ``void`` once a run had no token.
        self.ids, self.text, self.void = {"": b""}, {"": ""}, False

    def _alone(self, runs: list[str]) -> None:
        """Runs with special tokens, unusual white space or letters of rarer alphabets: cut up one by one."""
        words, slots = [], []
        for run in runs:
            slots.append([])
            for i, part in enumerate(self.cut.split(run) if self.cut else [run]):
                if i % 2:
                    slots[-1].append(self.special[part])
                elif part:
                    found = [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]
                    slots[-1] += [None] * len(found)
                    words += found
        flat, bounds = self._symbols(words, list(map(len, map(str.encode, words))))
        alive = merge_words(flat, bounds, self.table)
        merged = (flat[a:b][alive[a:b]].tolist() for a, b in zip(bounds, bounds[1:]))
        for run, slot in zip(runs, slots, strict=True):
            ids = [i for s in slot for i in (next(merged) if s is None else [s])]
            self.ids[run], self.text[run] = array("I", ids).tobytes(), self.decode(ids)
            self.void |= not ids

    def _symbols(self, words: list[str], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer("".join(words).encode(), np.uint8)
        flat, bounds = self.inner[data], np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        flat[bounds[1:] - 1] = self.last[data[bounds[1:] - 1]]
        return flat, bounds

    def learn(self, runs: Iterable[str]) -> None:
        """Encode runs, all their words merged together."""
        plain: list[str] = []
        alone: list[str] = []
        for run in runs:
            (alone if UNUSUAL.search(run) else plain).append(run)
        if alone:
            self._alone(alone)
        for usual, chosen in ((str.lower, [r for r in plain if r.isascii()]), (self.normalizer.normalize_str, [r for r in plain if not r.isascii()])):
            if chosen:
                self._learn(chosen, self.split.findall(usual(" ".join(chosen))))

    def _learn(self, runs: list[str], words: list[str]) -> None:
        """``words`` of ``runs`` in order, with a space between runs."""
        ends = [i for i, w in enumerate(words) if w == " "]
        counts = np.diff([-1, *ends, len(words)]) - 1
        words = [w for w in words if w != " "]
        flat, bounds = self._symbols(words, list(map(len, map(str.encode, words))))
        alive = merge_words(flat, bounds, self.table)
        kept = np.concatenate(([0], np.cumsum(alive)))
        at = kept[bounds[np.concatenate(([0], np.cumsum(counts)))]].tolist()
        ids = flat[alive]
        data, names = ids.astype("<u4").tobytes(), self.names[ids].tolist()
        for run, a, b in zip(runs, at, at[1:], strict=False):
            self.ids[run] = data[4 * a:4 * b]
            self.text[run] = " ".join(names[a:b])

    def texts(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For every text its ids (little-endian uint32) and its decoded text."""
        for a, b in by_bytes(texts, SPAN):
            rows = [list(filter(None, t.replace("\n", " ").split(" "))) for t in texts[a:b]]
            seen = set().union(*rows)
            fresh = [run for run in seen if run not in self.ids]
            if len(self.ids) + len(fresh) > CACHED_RUNS:
                self.ids, self.text, self.void, fresh = {"": b""}, {"": ""}, False, list(seen)
            self.learn(fresh)
            for row in rows:
                if self.void:
                    row = [run for run in row if self.ids[run]]
                yield b"".join(map(self.ids.__getitem__, row)), " ".join(map(self.text.__getitem__, row))
            for run in fresh:
                if len(run) > CACHED_CHARS:
                    del self.ids[run], self.text[run]

    def parts(self, text: str) -> Iterator[tuple[bytes, str]]:
        """Ids and decoded text of consecutive spans of one text; the decoded ones are joined by a space."""
        for span in _spans(text):
            yield from (made for made in self.texts([span]) if made[0])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(ids for ids, _ in self.parts(text)), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids])

    def batch(self, column: pa.Array) -> Iterator[Iterable[tuple[bytes, str]]]:
        """``parts`` of every text of a column; short texts share the merging of their new words."""
        held: list[str] = []
        for text in column.to_pylist():
            held.append(text or "")
            if len(held[-1]) > SPAN:
                yield from ([made] for made in self.texts(held[:-1]))
                yield self.parts(held[-1])
                held = []
        yield from ([made] for made in self.texts(held))


def _spans(text: str) -> Iterator[str]:
    """Consecutive parts of about ``SPAN`` characters, cut at a space or line end only."""
    at = 0
    while len(text) - at > SPAN:
        cut = max(text.rfind(" ", at, at + SPAN), text.rfind("\n", at, at + SPAN))
        if cut <= at:
            ends = [e for e in (text.find(" ", at + SPAN), text.find("\n", at + SPAN)) if e >= 0]
            if not ends:
                break
            cut = min(ends)
        yield text[at:cut]
        at = cut
    yield text[at:]


_OPEN: dict[str, WordBPE] = {}


def opened(path: str) -> WordBPE:
    """The tokenizer at ``path``, read once by each worker."""
    if path not in _OPEN:
        _OPEN[path] = WordBPE(path)
    return _OPEN[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (little-endian uint32 bytes) and ``decoded``."""
    def run(column: pa.Array) -> list[pa.Array]:
        ids, decoded = [], []
        for made in opened(path).batch(column):
            parts = list(made)
            ids.append(b"".join(p[0] for p in parts))
            decoded.append(" ".join(p[1] for p in parts))
        return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]

    return append_map(docs, [F.col(text).cast("string")], {"n_tokens": "long", "ids": "binary", "decoded": "string"}, run)


def digest_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens, ids_sha256, decoded_sha256``: as ``encode_texts``, of which only digests leave the task."""
    def run(column: pa.Array) -> list[pa.Array]:
        count, ids, decoded = [], [], []
        for parts in opened(path).batch(column):
            n, one, other = 0, hashlib.sha256(), hashlib.sha256()
            for made, words in parts:
                if n and made:
                    other.update(b" ")
                n += len(made) // 4
                one.update(made)
                other.update(words.encode())
            count.append(n)
            ids.append(one.hexdigest())
            decoded.append(other.hexdigest())
        return [pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    return append_map(docs, [F.col(text).cast("string")], {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, run)
