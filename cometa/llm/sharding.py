"""Uniform shuffle into shards of exact sizes by a communication matrix.

The rows are written once, which fixes in which block (file) and at which
position each row stands. The number of rows that block ``b`` sends to shard
``s`` then follows a multivariate hypergeometric law: the matrix is drawn with
exact row and column sums, every block permutes its own rows to decide which of
them go where, the rows are exchanged, and each shard is permuted again. The
result is a uniform permutation cut into shards whose sizes differ by one at
most.

Scale: no task holds a block's or a shard's rows. A block is handled through
its permuted label array (four bytes a row); a shard's final permutation is a
sort by random keys over ranges of about ``window_rows`` rows, whose slots
start at prefix sums of the range counts. The driver holds one number per
block and ``n_shards`` numbers per group of blocks; the matrix rows of a group
are drawn in the tasks that need them, from the seed, so a retried task draws
the same numbers.

Defined results: null values travel like others; equal rows are placed one by
one, since a row is identified by its place in the written table; an empty
table gives an empty result; extra columns travel with their rows, and a column
that is called ``shard`` or ``slot`` travels as ``shard given`` or ``slot given``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cometa.llm.common import free_name, save

GROUP_BLOCKS = 256


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Draw from the hypergeometric law by inversion around its mode, for any size.

    Log probabilities are summed from the mode over twelve standard deviations;
    what lies beyond is smaller than a double can tell from zero.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    sd = math.sqrt(draws * (good / total) * (bad / total) * (total - draws) / max(1, total - 1))
    reach = int(12 * sd) + 40
    lo, hi = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(lo, hi, dtype=np.float64)  # the ratio p(k + 1) / p(k) for each k
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(logp - logp.max()))
    return lo + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def matrix_row(rng: np.random.Generator, room: list[int], rows: int) -> list[int]:
    """How many of ``rows`` rows go to each shard with ``room`` places left."""
    out, left, rest = [], rows, sum(room)
    for places in room:
        rest -= places
        n = hypergeometric(rng, places, rest, left)
        out.append(n)
        left -= n
    return out


def shard_sizes(rows: int, n_shards: int) -> list[int]:
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


class Matrix:
    """The communication matrix of blocks and shards, drawn in two levels."""

    def __init__(self, block_rows: list[int], n_shards: int, seed: int) -> None:
        self.rows, self.seed = block_rows, seed
        self.kept: dict[int, np.ndarray] = {}
        room = shard_sizes(sum(block_rows), n_shards)
        rng = np.random.default_rng([seed, 0])
        self.groups: list[list[int]] = []
        for at in range(0, len(block_rows), GROUP_BLOCKS):
            got = matrix_row(rng, room, sum(block_rows[at : at + GROUP_BLOCKS]))
            room = [a - b for a, b in zip(room, got)]
            self.groups.append(got)

    def row(self, block: int) -> list[int]:
        group = block // GROUP_BLOCKS
        rng, room = np.random.default_rng([self.seed, 1, group]), list(self.groups[group])
        for b in range(group * GROUP_BLOCKS, block + 1):
            got = matrix_row(rng, room, self.rows[b])
            room = [x - y for x, y in zip(room, got)]
        return got

    def labels(self, block: int) -> np.ndarray:
        """The shard of each row of a block: its counts, permuted. The last few blocks are kept."""
        if block in self.kept:
            return self.kept[block]
        out = np.repeat(np.arange(len(self.groups[0]), dtype=np.int32), self.row(block))
        np.random.default_rng([self.seed, 2, block]).shuffle(out)
        self.kept = dict([*self.kept.items()][-3:]) | {block: out}
        return out


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 17, window_rows: int = 16384) -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in each shard)."""
    for c in [c for c in df.columns if c.lower() in ("shard", "slot")]:
        df = df.withColumnRenamed(c, free_name(df.columns, f"{c} given"))
    kept = [F.col(f"`{c}`") for c in df.columns]
    place = F.monotonically_increasing_id()
    fixed = save(
        df.select(
            F.struct(*kept).alias("row"),
            F.shiftright(place, 33).cast("int").alias("block"),
            place.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"),
        ),
        "shard_blocks",
    )
    found = dict(fixed.groupBy("block").count().collect())  # one number per block
    matrix = Matrix([found.get(b, 0) for b in range(max(found, default=-1) + 1)], n_shards, seed)
    ranges = max(1, -(-sum(found.values()) // (n_shards * window_rows)))

    @F.pandas_udf("int")
    def shard_of(block: pd.Series, pos: pd.Series) -> pd.Series:
        out = np.empty(len(block), dtype=np.int32)
        blocks, at = block.to_numpy(), pos.to_numpy()
        for b in np.unique(blocks):
            mine = blocks == b
            out[mine] = matrix.labels(int(b))[at[mine]]
        return pd.Series(out)

    def drawn(purpose: int):
        return F.xxhash64(F.lit(seed), F.lit(purpose), "block", "pos")

    dealt = fixed.withColumn("shard", shard_of("block", "pos")).withColumn("range", F.pmod(drawn(3), F.lit(ranges)))
    starts = (
        dealt.groupBy("shard", "range")
        .count()
        .select(
            "shard",
            "range",
            (F.sum("count").over(W.partitionBy("shard").orderBy("range")) - F.col("count")).alias("start"),
        )
    )
    inside = W.partitionBy("shard", "range").orderBy(drawn(4), "block", "pos")
    return (
        dealt.withColumn("at", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "range"])
        .select("row.*", "shard", (F.col("start") + F.col("at")).alias("slot"))
    )


def query(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_into_shards(narrow, 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
