"""Product codes of vectors, learned by exact integer rounds over Hilbert-sorted blocks.

Components become integers (``floor(scale * x)``) and vectors are cut into equal
parts. The parts of each position are sorted along a Hilbert curve and stored once
in flat blocks of ``BLOCK_ROWS`` rows, each with its box (least and greatest value
of each component), its sums and its count. A round compares boxes with codebook
entries first: an entry whose least distance to the box exceeds the smallest
greatest distance of any entry can neither win nor tie for a row of the block, so
what is left is the block's shortlist. With one entry left, the block's sums and
count are added as they are; else the rows are compared with the shortlist alone, in
64-bit integers. Entries are kept in index order, so ties go to the lower index.

Scale: vectors are sorted once (eight narrow rows a vector); a round reads the
blocks and sends parts x entries x components partial sums a task. The driver holds
the codebooks, whose size the parameters fix. Equal vectors are told apart by their
place in the written table, so a vector that very many rows share is spread over
tasks. The totals of labels are joined from a written table, which Spark splits at a
hot label or broadcasts when it is small.

Defined results: rows whose vector is null, or holds a null, NaN or infinite
component, are left out; rows of equal vec_id are ordered by vector, null vec_ids
come last; with fewer rows than entries the codebooks are that much shorter; an
empty table gives an empty result; extra columns are not read. Vectors of unlike
lengths, lengths that the parts don't divide, and components so large that a distance
could pass 64 bits end the job with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cometa.llm.common import save

BLOCK_ROWS = 128
CURVE_BITS = 16


def hilbert_keys(points: np.ndarray, bits: int) -> list[bytes]:
    """The place of points (rows of ``bits``-bit numbers) on the Hilbert curve, as bytes that sort alike.

    Skilling's transform: undo the rotations from the highest bit down, take the Gray
    code, then interleave the bits of the axes.
    """
    x = points.T.astype(np.int64)
    if not len(x):
        return [b""] * len(points)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    plane = (x[None] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1  # bit, axis, point
    packed = np.packbits(plane.reshape(-1, x.shape[1]).astype(np.uint8).T, axis=1)
    return [row.tobytes() for row in packed]


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries can be nearest to some point of each box: boxes x entries."""
    below, above = low[:, None] - book[None], book[None] - high[:, None]
    least = (np.maximum(0, np.maximum(below, above)) ** 2).sum(axis=2)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
    return least <= most.min(axis=1)[:, None]


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row and the squared distance."""
    d = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(rows)), at]


def integer_rows(df: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """Kept rows: place, vec_id, label, components as integers (doubles where they are too large)."""
    x = F.col(f"`{vector}`").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return save(
        df.where(x.isNotNull() & whole).select(
            F.monotonically_increasing_id().alias("place"),
            F.col(f"`{vec_id}`").alias("vec_id"),
            F.col(f"`{label}`").alias("label"),
            F.transform(x, lambda v: F.floor(v * scale)).alias("v"),
            F.array_max(F.transform(x, lambda v: F.abs(v))).alias("most"),
        ),
        "code_vectors",
    )


def blocks_of(rows: DataFrame, parts: int, width: int, low: int, high: int) -> DataFrame:
    """The written blocks: part, n, places, values, low, high, sums (little-endian integers)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                n = some.num_rows
                v = some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n * parts, width)
                grid = (v - low) * ((1 << CURVE_BITS) - 1) // max(1, high - low)
                place = np.repeat(some.column("place").to_numpy(), parts)
                part = np.tile(np.arange(parts, dtype=np.int32), n)
                values = [row.tobytes() for row in v.astype("<i4")]
                columns = [pa.array(part), pa.array(hilbert_keys(grid, CURVE_BITS), pa.binary()), pa.array(place), pa.array(values, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "key", "place", "value"])

    names = ["part", "n", "places", "value", "low", "high", "sums"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part: int, places: np.ndarray, v: np.ndarray) -> list:
            wide = v.astype(np.int64)
            return [part, len(v), places.tobytes(), v.tobytes(), wide.min(axis=0).tobytes(), wide.max(axis=0).tobytes(), wide.sum(axis=0).tobytes()]

        def batch_of(made: list[list]) -> pa.RecordBatch:
            types = [pa.int32(), pa.int32()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)

        part, places, values = None, np.zeros(0, "<i8"), np.zeros((0, width), "<i4")
        for batch in batches:
            made = []
            mine = batch.column("part").to_numpy()
            at = batch.column("place").to_numpy()
            v = np.frombuffer(b"".join(batch.column("value").to_pylist()), "<i4").reshape(len(mine), width)
            edges = [0, *(np.flatnonzero(np.diff(mine)) + 1).tolist(), len(mine)] if len(mine) else [0]
            for a, b in zip(edges, edges[1:]):
                if part != mine[a] and len(places):
                    made.append(block(part, places, values))
                    places, values = places[:0], values[:0]
                part = int(mine[a])
                places, values = np.concatenate([places, at[a:b]]), np.concatenate([values, v[a:b]])
                full = len(places) // BLOCK_ROWS * BLOCK_ROWS
                for k in range(0, full, BLOCK_ROWS):
                    made.append(block(part, places[k : k + BLOCK_ROWS], values[k : k + BLOCK_ROWS]))
                places, values = places[full:], values[full:]
            if made:
                yield batch_of(made)
        if len(places):
            yield batch_of([block(part, places, values)])

    lines = rows.select("place", "v").mapInArrow(cut, "part int, key binary, place long, value binary")
    ordered = lines.repartitionByRange("part", "key", "place").sortWithinPartitions("part", "key", "place")
    return save(ordered.mapInArrow(gather, "part int, n int, places binary, value binary, low binary, high binary, sums binary"), "code_blocks")


def _assigned(batch: pa.RecordBatch, books: np.ndarray, width: int) -> Iterator[tuple]:
    """For each block: its record, its shortlist, and the entry and distance of each row where the rows were compared."""
    part = batch.column("part").to_numpy()
    low, high = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i8").reshape(-1, width) for c in ("low", "high"))
    for p in np.unique(part):
        mine = np.flatnonzero(part == p)
        lists = shortlists(low[mine], high[mine], books[p])
        for k, allowed in zip(mine.tolist(), lists):
            yield k, int(p), np.flatnonzero(allowed)


def _values(batch: pa.RecordBatch, k: int, width: int) -> np.ndarray:
    return np.frombuffer(batch.column("value")[k].as_py(), "<i4").reshape(-1, width).astype(np.int64)


def round_sums(blocks: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """The count and component sums of each entry that has rows: {(part, entry): (n, sums)}."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
            for k, p, allowed in _assigned(batch, books, width):
                if len(allowed) == 1:
                    n[p, allowed[0]] += batch.column("n")[k].as_py()
                    sums[p, allowed[0]] += np.frombuffer(batch.column("sums")[k].as_py(), "<i8")
                    continue
                rows = _values(batch, k, width)
                at = allowed[nearest(rows, books[p][allowed])[0]]
                n[p] += np.bincount(at, minlength=entries)
                for e in np.unique(at):
                    sums[p, e] += rows[at == e].sum(axis=0)
            p, e = np.nonzero(n)
            columns = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    partial = blocks.mapInArrow(add, "part int, entry int, n long, sums array<long>")
    exact = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).collect()  # at most parts x entries rows
    return {(r.part, r.entry): (r.n, [int(r[f"s{j}"]) for j in range(width)]) for r in found}


def learn(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after ``rounds`` rounds; entries without rows stay."""
    for _ in range(rounds):
        books = books.copy()
        for (p, e), (n, sums) in round_sums(blocks, books).items():
            books[p, e] = [s // n for s in sums]
    return books


def assign(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """place, code (two hex digits a part), error (squared distances summed over parts)."""
    parts, _, width = books.shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, p, allowed in _assigned(batch, books, width):
                at, d = nearest(_values(batch, k, width), books[p][allowed])
                place = np.frombuffer(batch.column("places")[k].as_py(), "<i8")
                columns = [pa.array(place), pa.array(np.full(len(at), p, np.int32)), pa.array(allowed[at].astype(np.int32)), pa.array(d)]
                yield pa.RecordBatch.from_arrays(columns, ["place", "part", "entry", "distance"])

    each = blocks.mapInArrow(rows, "place long, part int, entry int, distance long")
    entry = [F.lower(F.lpad(F.hex(F.max(F.when(F.col("part") == p, F.col("entry")))), 2, "0")) for p in range(parts)]
    return each.groupBy("place").agg(F.concat(*entry).alias("code"), F.sum("distance").alias("error"))


def book_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def code_vectors(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of each kept row; the codebooks: parts x entries x components)."""
    rows = integer_rows(df, vec_id, vector, label, scale)
    size = F.size("v")
    seen = rows.agg(F.min(size).alias("a"), F.max(size).alias("b"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"), F.max("most").alias("most")).first()
    if seen.a is None:
        empty = rows.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty, np.zeros((parts, 0, 0), np.int64)
    if seen.a != seen.b or seen.a % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}; found {seen.a} to {seen.b}")
    if seen.a and seen.most * scale + 1 > min(isqrt(2**61 // seen.a), 2**30):
        raise ValueError("components are too large for distances of 64 bits")
    width = seen.a // parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v", "place").limit(entries).select("v").collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    blocks = blocks_of(rows, parts, width, seen.low or 0, seen.high or 0)
    books = learn(blocks, books, rounds)
    return rows.select("place", "vec_id", "label").join(assign(blocks, books), "place").drop("place"), books


def query(vectors: DataFrame) -> DataFrame:
    coded, books = code_vectors(vectors)
    coded = save(coded, "codes")
    totals = save(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label_errors")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds written out, one set of tables a round, without blocks or boxes."""
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding, len(embedding) // 8 AS w FROM embeddings
        WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding))""",
        "cells AS MATERIALIZED (SELECT r, (j - 1) // w AS part, (j - 1) % w AS j, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS j FROM kept))",
        f"book0 AS MATERIALIZED (SELECT part, r - 1 AS e, j, x AS c FROM cells WHERE r <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT r, part, e, d FROM (SELECT r, part, e, d, row_number() OVER (PARTITION BY r, part ORDER BY d, e) AS n FROM
        (SELECT cells.r, part, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM cells JOIN book{k} USING (part, j) GROUP BY ALL)) WHERE n = 1)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT part, e, j, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM book{k} LEFT JOIN
            (SELECT part, e, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM near{k} JOIN cells USING (r, part) GROUP BY part, e, j) USING (part, e, j))""")
    steps.append(f"coded AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, e, j)) FROM book{rounds}) AS codebooks_sha256
    FROM kept JOIN coded USING (r)"""


SQL = _sql()
