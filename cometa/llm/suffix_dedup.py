"""Suffix-array dedup by a difference cover, one bucket of suffixes at a time.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts
anywhere else, in the same document or another; strings don't cross documents.

The cover: positions whose residue modulo v is in a perfect difference set D
(about the square root of v residues). Any two positions i and j have an offset
below v at which both i + offset and j + offset are in the cover. So two suffixes
that agree for LENGTH bytes agree, at that offset, on a cover sample of LENGTH -
v + 1 bytes. The samples are sorted first, and their ranks say which samples are
tied. A suffix without a tied sample within v bytes is unique at this depth and
is never sorted. The others are sorted bucket by bucket, one block of buckets
after the other, which bounds memory and disk; suffixes are ordered by the key of
their first LENGTH bytes, since only ties at that depth matter, not the
alphabetical order among unlike suffixes.

Defined results: a null text is empty: 0 bytes, nothing removed; a text shorter
than LENGTH keeps all; equal texts of LENGTH bytes or more go whole; a very long
text is a chunk of its own; an empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cometa.llm import repeats
from cometa.llm.repeats import BYTE_CODE, Rule, Units, cover_mask

LENGTH = 400
BLOCKS = 2
ORDER = 13  # a prime; v = 183 with 14 residues


def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """(v, D): q + 1 residues modulo v = q*q + q + 1 whose differences are all residues (Singer's construction).

    D holds the exponents i of a generator x of the field with q^3 elements for which x^i has no x^2 term.
    """
    v = q * q + q + 1
    for a, b, c in product(range(q), repeat=3):  # x^3 = a x^2 + b x + c
        power, found = (1, 0, 0), set()
        for i in range(v):
            if power[2] == 0:
                found.add(i)
            p0, p1, p2 = power
            power = (p2 * c % q, (p0 + p2 * b) % q, (p1 + p2 * a) % q)
        if len(found) == q + 1 and len({(x - y) % v for x in found for y in found}) == v:
            return v, np.array(sorted(found))
    raise ValueError("q must be a prime")


def rule(length: int = LENGTH, order: int = ORDER) -> Rule:
    v, residues = difference_cover(order)
    inside = np.zeros(v, dtype=bool)
    inside[residues] = True

    def units(blob: np.ndarray, bounds: np.ndarray) -> Units:
        return Units((BYTE_CODE[0][blob], BYTE_CODE[1][blob]), bounds)

    def seeds(u: Units) -> np.ndarray:
        own = np.arange(u.bounds[-1]) - np.repeat(u.bounds[:-1], np.diff(u.bounds))
        return np.flatnonzero(inside[own % v])

    return Rule(length, length - v + 1, v, units, seeds, 1.0, len(residues) / v)


def judge(length: int):
    def chunk(row: dict, u: Units, starts: np.ndarray) -> pa.RecordBatch:
        gone, blob = cover_mask(len(row["blob"]), starts, length), np.frombuffer(row["blob"], np.uint8)
        rows = []
        for d, copies, i, j in zip(row["digests"], row["copies"], row["bounds"][:-1], row["bounds"][1:]):
            mine = gone[i:j] if copies == 1 or j - i < length else np.ones(j - i, dtype=bool)
            spans = int(np.count_nonzero(mine[1:] & ~mine[:-1])) + int(j > i and mine[0])
            rows.append((d, j - i, int(mine.sum()), spans, hashlib.sha256(blob[i:j][~mine].tobytes()).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["digest", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return chunk


def dedup(docs: DataFrame, length: int = LENGTH, order: int = ORDER, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    schema = "digest string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    judged = repeats.covered(repeats.chunks(docs), rule(length, order), judge(length), schema, blocks)
    return repeats.per_document(docs, judged)


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs)


# Bytes as pairs of hexadecimal digits, so that offsets are bytes.
SQL = f"""
WITH b AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents
), starts AS (
  SELECT r, x, unnest(range(0, length(x) // 2 - {LENGTH} + 1)) AS i FROM b
), keyed AS (
  SELECT r, i, md5(substring(x, 2 * i + 1, {2 * LENGTH})) AS k FROM starts
), tied AS (
  SELECT r, i FROM keyed QUALIFY count(*) OVER (PARTITION BY k) > 1
), runs AS (
  SELECT r, i, i - {LENGTH} > lag(i) OVER (PARTITION BY r ORDER BY i) OR lag(i) OVER (PARTITION BY r ORDER BY i) IS NULL AS head FROM tied
), spans AS (
  SELECT r, run, min(i) AS start, max(i) + {LENGTH} AS stop
  FROM (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS run FROM runs) GROUP BY r, run
), gaps AS (
  SELECT r, start, stop, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY start), 0) AS since FROM spans
), cut AS (
  SELECT gaps.r, string_agg(substring(x, 2 * since + 1, 2 * (start - since)), '' ORDER BY start) AS kept,
    max(stop) AS stop, sum(stop - start) AS n_removed, count(*) AS n_spans
  FROM gaps JOIN b USING (r) GROUP BY gaps.r
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substring(x, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN cut USING (r)
"""
