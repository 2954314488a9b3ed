"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitrank.session import cut_lineage, scratch_path  # noqa: F401  (re-exported)

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows and characters that a model is fitted on at most (expected size of the hash sample).
FIT_ROWS = 4000
FIT_CHARS = 12_000_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Lineage cut by a written table in the shared folder: smaller on disk than a checkpoint, and of known size."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 5


def bounded_sample(df: DataFrame, text: str, key: str, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> DataFrame:
    """Hash sample of ``df`` of ``rows`` rows and ``chars`` characters at most, in expectation."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.length(text))).first()
    share = min(1.0, rows / max(n, 1), chars / max(total or 0, 1))
    unit = F.pmod(F.xxhash64(F.col(key), F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df if share >= 1.0 else df.where(unit < share)


def join_labels(docs: DataFrame, labels: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """Labelled documents of a hash sample of ``rows`` labels at most (in expectation), one label a key.

    The sample's bound makes the labels small enough to send to every task, so the texts are not shuffled.
    """
    share = min(1.0, rows / max(labels.count(), 1))
    unit = F.pmod(F.xxhash64(F.col(key), F.lit("labels")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return docs.join(F.broadcast(labels.where(unit < share)), key)


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finalizer on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _POWERS[name] = np.multiply.accumulate(have)
    return have[:n]


class Hashed:
    """Rolling hashes over one byte buffer: the hash of any byte range in constant time."""

    def __init__(self, data: np.ndarray):
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers("up", _BASE, len(data)), out=self.prefix[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = _powers("down", _BASE_INV, len(self.prefix))
        return mix64((self.prefix[end] - self.prefix[start]) * down[start])

    def windows(self, n: int) -> np.ndarray:
        """Hash of every n-byte window."""
        size = len(self.prefix) - n
        if size <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self.prefix[n:] - self.prefix[:size]) * _powers("down", _BASE_INV, size))


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, breaks: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the runs of bytes that are not in ``breaks``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~breaks[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pieces(data: bytes, most: int = 1_000_000) -> Iterator[bytes]:
    """Consecutive pieces of about ``most`` bytes, cut at white space only, so that memory stays bounded."""
    at = 0
    while len(data) - at > most:
        cut = max(data.rfind(b" ", at, at + most), data.rfind(b"\n", at, at + most))
        if cut <= at:  # one word longer than a piece
            found = [x for x in (data.find(b" ", at + most), data.find(b"\n", at + most)) if x >= 0]
            if not found:
                break
            cut = min(found)
        yield data[at:cut]
        at = cut
    yield data[at:]


def by_bytes(texts: list, most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``most`` bytes together (one row at least)."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def joined(texts: list[bytes], sep: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each after a separator and with one at the end; offsets of the separators."""
    buffer = sep + sep.join(texts) + sep
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.frombuffer(buffer, np.uint8), np.concatenate(([0], np.cumsum(lengths)))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of ``values`` along axis 0; empty segments give 0."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(RecordBatch) -> RecordBatch`` over every batch."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def append_map(df: DataFrame, inputs: list[Column], made: dict[str, str], fn) -> DataFrame:
    """``df`` with the columns ``made`` (name: type) that ``fn(*arrays of inputs)`` gives, batch by batch.

    A column of ``df`` that has the name of a made one (in any case) gives way to it.
    """
    names = {m.lower() for m in made}
    kept = [c for c in df.columns if c.lower() not in names]
    passed = df.select(*[df[f"`{c}`"] for c in kept])
    schema = passed.schema
    for name, kind in made.items():
        schema = schema.add(name, kind)
    given = df.select(*[df[f"`{c}`"] for c in kept], *[c.alias(f"__in{i}") for i, c in enumerate(inputs)])
    out_names = [*kept, *made]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = batch.columns
        return pa.RecordBatch.from_arrays([*columns[:len(kept)], *fn(*columns[len(kept):])], names=out_names)

    return arrow_map(given, run, schema)
