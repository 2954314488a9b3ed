"""Small cells are compared together, and as if each were alone."""

import numpy as np
import pyarrow as pa

from pitrank.llm import lattice


def _rows(seed: int, blocks: int) -> list[tuple]:
    """Rows of blocks whose vectors lie around a few directions, with real cell keys of table 2."""
    rng = np.random.default_rng(seed)
    out = []
    for b in range(blocks):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 9))):
            v = centre + rng.normal(0, 0.15, 16)
            out.append((b // 3, b % 3, b % 3, int(rng.integers(0, 40)), int(rng.integers(1, 4)), v / np.linalg.norm(v),
                        int(b % 7), bool(rng.random() < 0.6), bool(rng.random() < 0.8), bool(rng.random() < 0.8)))
    return out


def _batches(rows: list[tuple], size: int):
    names = ["key", "first", "second", "class", "copies", "vector", "table", "home", "left", "right"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()]
    for at in range(0, len(rows), size):
        cols = zip(*rows[at:at + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)


def _found(rows: list[tuple], size: int) -> list[tuple]:
    out = [b.to_pydict() for b in lattice._links(_batches(rows, size), 0.9, lattice.TABLES, lattice.PROBES, lattice.SCALE, 8)]
    return [(c, n, r) for b in out for c, n, r in zip(b["class"], b["links"], b["root"], strict=True)]


def test_small_blocks_share_a_comparison(monkeypatch):
    rows, calls = _rows(1, 120), []
    compare = lattice._compare
    monkeypatch.setattr(lattice, "_compare", lambda *a: calls.append(1) or compare(*a))
    together = _found(rows, 10_000)
    assert 0 < len(calls) <= 2 * len(rows) // lattice.TOGETHER + 1
    monkeypatch.setattr(lattice, "TOGETHER", 1)
    assert _found(rows, 10_000) == together != []
    # A block that goes on over many batches is one block.
    assert _found(rows, 5) == together


def test_probed_cells_are_the_nearest_by_a_stable_sort():
    unit = np.random.default_rng(2).normal(size=(300, 24))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    x = unit @ lattice._projection(8, 24, 3, lattice.SCALE)
    home = lattice.decode_e8(x)
    near = np.argsort(-((x - home) @ lattice.NEIGHBOURS.T), axis=1, kind="stable")[:, :4]
    points = np.concatenate((home[:, None, :], home[:, None, :] + lattice.NEIGHBOURS[near]), axis=1)
    assert (lattice.table_cells(unit, 3, 4, lattice.SCALE, 8) == lattice._cell_keys(points, 3, 24)).all()
