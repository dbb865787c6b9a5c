"""Phrase dedup by a tie search over window keys (no Lempel-Ziv parse).

A word goes if it is covered by ``LENGTH`` consecutive words of one document whose
sequence also starts anywhere else, in the same document or another.

The reference is the corpus itself, cut into blocks by the key of the phrase (a
stretch of LENGTH words), and every block indexes the phrases that it holds twice
or more. Seeds keep the index small: among the ``REACH`` stretches of ``SEED``
words in a phrase, the one with the smallest key is its seed, wherever the phrase
stands, so a phrase whose seeds occur once can't be in the index and is not sent.

The windows whose 96-bit keys are tied cover the words that go; overlapping
windows merge to one interval. There is no parse and no boundary look-up.

Defined results: a null text has no words; a text of fewer than LENGTH words keeps
all; equal texts with LENGTH words or more go whole; a very long text is a chunk
of its own; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cometa.llm import repeats
from cometa.llm.common import WORD
from cometa.llm.repeats import BYTE_CODE, Rolling, Rule, Units, scramble

LENGTH = 35
SEED = 8
BLOCKS = 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_edges(blob: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; words end at text bounds too."""
    inside = ~_SPACE[blob]
    first, last = inside.copy(), inside.copy()
    cut = np.zeros(len(blob) + 1, dtype=bool)
    cut[bounds] = True
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def units(blob: np.ndarray, bounds: np.ndarray) -> Units:
    start, end = word_edges(blob, bounds)
    codes = tuple(Rolling(BYTE_CODE[k][blob], k).keys(start, end) + (end - start).astype(np.uint64) for k in (0, 1))
    return Units(codes, np.searchsorted(start, bounds))


def seeds_within(seed: int, reach: int):
    """The positions that have the smallest seed key of some ``reach`` successive positions."""

    def seeds(u: Units) -> np.ndarray:
        n = len(u.codes[0]) - seed + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        at = np.arange(n)
        key = scramble(Rolling(u.codes[0], 0).keys(at, at + seed))
        if n <= reach:
            return np.flatnonzero(key == key.min())
        low = np.lib.stride_tricks.sliding_window_view(key, reach).min(axis=1)
        # position p is chosen if it is the least of a stretch that starts at p - reach + 1 to p
        least = np.concatenate([low, np.zeros(reach - 1, dtype=key.dtype)])
        chosen = np.zeros(n, dtype=bool)
        for k in range(reach):
            chosen[k:] |= key[k:] == least[: n - k]
        return np.flatnonzero(chosen)

    return seeds


def rule(length: int = LENGTH, seed: int = SEED) -> Rule:
    reach = length - seed + 1
    return Rule(length, seed, reach, units, seeds_within(seed, reach), 1 / 6, 2 / (reach + 1) / 6)


def factors(indexed: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The duplicate spans of a text, from the (sorted) words at which an indexed phrase starts."""
    if not len(indexed):
        return []
    cut = np.flatnonzero(np.diff(indexed) > length)
    starts, ends = indexed[np.r_[0, cut + 1]], indexed[np.r_[cut, len(indexed) - 1]] + length
    return list(zip(starts.tolist(), ends.tolist()))


def judge(length: int):
    def chunk(row: dict, u: Units, starts: np.ndarray) -> pa.RecordBatch:
        rows = []
        edge = np.searchsorted(starts, u.bounds)
        for k, (d, copies) in enumerate(zip(row["digests"], row["copies"])):
            words = row["blob"][row["bounds"][k] : row["bounds"][k + 1]].split()
            spans = factors(starts[edge[k] : edge[k + 1]] - u.bounds[k], length)
            if copies > 1 and len(words) >= length:
                spans = [(0, len(words))]
            kept = [w for i, j in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(words)]) for w in words[i:j]]
            rows.append((d, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["digest", "n_words", "n_removed", "kept_sha256"])

    return chunk


def dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    schema = "digest string, n_words long, n_removed long, kept_sha256 string"
    judged = repeats.covered(repeats.chunks(docs), rule(length, seed), judge(length), schema, blocks)
    return repeats.per_document(docs, judged)


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs)


SQL = f"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), starts AS (
  SELECT r, ws, unnest(range(1, len(ws) - {LENGTH} + 2)) AS i FROM w
), keyed AS (
  SELECT r, i, md5(array_to_string(list_slice(ws, i, i + {LENGTH} - 1), ' ')) AS phrase FROM starts
), tied AS (
  SELECT r, i FROM keyed QUALIFY count(*) OVER (PARTITION BY phrase) > 1
), words AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w
), judged AS (
  SELECT words.r, word, p,
    coalesce(max(i) OVER (PARTITION BY words.r ORDER BY p) > p - {LENGTH}, false) AS gone
  FROM words LEFT JOIN tied ON words.r = tied.r AND words.p = tied.i
), kept AS (
  SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM judged GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""
