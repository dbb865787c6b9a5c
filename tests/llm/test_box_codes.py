"""Vector codes by boxes: equal to plain rounds over all rows, whatever the blocks."""

import hashlib
import math
import random

import numpy as np
import pytest

from cometa.llm import box_codes
from tests.conftest import SF001

SCHEMA = "vec_id long, embedding array<float>, label int, place string, `part` string, code string, error string"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, code, error, label_error, digest) of each kept row in plain Python integers."""
    kept = [(r[0], [math.floor(x * scale) for x in r[1]], r[2]) for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else b for e, b in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    return [(i, "".join(f"{e:02x}" for _, e in f), x, by_label[label], digest) for (i, _, label), f, x in zip(kept, found, error)]


def rows_of(table):
    return [(r.vec_id, r.embedding, r.label) for r in table.collect()]


def got(table):
    return sorted(map(tuple, box_codes.query(table).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([r + ("x",) * 4 for r in rows], SCHEMA)


def test_equal_brute_force_on_the_table(spark):
    d = spark.read.parquet(f"{SF001}/embeddings.parquet")
    assert got(d) == sorted(brute(rows_of(d)), key=str)


@pytest.mark.parametrize("block", [3, 128])
def test_equal_brute_force_with_ties_nulls_and_copies(spark, monkeypatch, block):
    monkeypatch.setattr(box_codes, "BLOCK_ROWS", block)
    rng = random.Random(3)
    grid = [[rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(16)] for _ in range(40)]  # many equal distances
    rows = [(k, grid[k], k % 3 or None) for k in range(40)]
    rows += [(100 + k, grid[7], 9) for k in range(60)]  # a vector that many rows share
    rows += [(None, grid[3], None), (5, grid[9], 1), (5, grid[2], 1), (-1, [rng.gauss(0, 3) for _ in range(16)], None)]
    rows += [(1, None, 1), (2, [None] * 16, 1), (3, [float("nan")] + [0.0] * 15, 1), (4, [float("inf")] + [0.0] * 15, 2)]
    rows += [(200 + k, [rng.gauss(0, 0.1) for _ in range(16)], 4) for k in range(50)]
    d = vectors(spark, rows).repartition(4).cache()
    assert got(d) == sorted(brute(rows_of(d)), key=str)


def test_few_rows_one_component_and_empty_table(spark):
    few = vectors(spark, [(k, [0.1 * k, -0.3] * 4, None) for k in range(5)])
    assert got(few) == sorted(brute(rows_of(few)), key=str)
    assert got(few.limit(0)) == []
    assert got(vectors(spark, [(None, None, None)] * 2)) == []


@pytest.mark.parametrize("rows", [[(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [0.0] * 9, 1)], [(1, [1e30] * 8, 1), (2, [0.0] * 8, 1)]])
def test_what_cannot_be_coded_ends_with_an_error(spark, rows):
    with pytest.raises(ValueError):
        box_codes.query(vectors(spark, rows))


def test_shortlists_hold_every_winner_and_tie():
    rng = np.random.default_rng(2)
    for _ in range(200):
        rows, book = rng.integers(-6, 7, (20, 3)), rng.integers(-6, 7, (9, 3))
        allowed = box_codes.shortlists(rows.min(axis=0)[None], rows.max(axis=0)[None], book)[0]
        d = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
        assert allowed[np.unique(np.nonzero(d == d.min(axis=1)[:, None])[1])].all()
        at, _ = box_codes.nearest(rows, book[allowed])
        assert np.flatnonzero(allowed)[at].tolist() == d.argmin(axis=1).tolist()


def test_the_curve_passes_each_cell_once_in_unit_steps():
    for bits, axes in ((3, 2), (2, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), axis=-1).reshape(-1, axes)
        keys = box_codes.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        order = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_most_blocks_of_clustered_vectors_need_no_rows(spark, monkeypatch):
    """Boxes shorten the lists: with clusters far apart, each block is left with one entry."""
    monkeypatch.setattr(box_codes, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(4)
    centres = rng.integers(-400, 400, (16, 8))
    d = spark.createDataFrame([(k, (centres[k % 16] / 100 + rng.normal(0, 0.001, 8)).tolist(), 0) for k in range(4000)], "vec_id long, embedding array<float>, label int")
    rows = box_codes.integer_rows(d, "vec_id", "embedding", "label", 4096)
    v = np.array([r.v for r in rows.collect()])
    blocks = box_codes.blocks_of(rows, 1, 8, int(v.min()), int(v.max())).collect()
    assert sum(b.n for b in blocks) == 4000
    low, high = (np.array([np.frombuffer(b[c], "<i8") for b in blocks]) for c in ("low", "high"))
    assert (box_codes.shortlists(low, high, centres * 4096 // 100).sum(axis=1) == 1).mean() > 0.5
