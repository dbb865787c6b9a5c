"""Which windows of W units start in two or more places of a corpus.

The parts that two operators share: distinct texts packed into chunks, keys of
windows, and a tie search that deals keys to buckets and answers with one bit a
key. A unit is whatever the operator says (a byte, a word).

Flow, over a written table of chunks (about ``CHUNK_BYTES`` of distinct texts):

1. seeds: every chunk names some positions, chosen so that any two equal windows
   hold equal seeds at one offset; the keys of the seeds are searched for ties.
2. windows: only a window with a tied seed can have a twin. The keys of these
   windows are searched for ties, one block of the key space after the other.
3. the tied windows of each text cover the units to remove.

Tie search: a chunk sorts its keys, drops repeats (marking them) and sends one
binary row to each bucket of the key space; a task sorts one bucket at a time
and answers every row with bits in the row's own order, so no positions travel.
As a chunk sends a key once, a passage that a third of all documents hold costs
one key a chunk, and a bucket's size is set by the number of buckets, which
follows the corpus. Exact copies of a text are collapsed before (by digest,
combined on the map side).

Seed keys have 64 bits: a chance tie only adds candidates. Window keys have 96
bits, so that chance ties are not to be expected below some 10^14 candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cometa.llm.common import save

CHUNK_BYTES = 2_000_000
BUCKET_KEYS = 2_000_000

_G = np.random.Generator(np.random.PCG64(20240607))
BASES = [int(b) | 1 for b in _G.integers(1 << 40, 1 << 63, 2, dtype=np.uint64)]
BYTE_CODE = _G.integers(1, 1 << 63, (2, 256), dtype=np.uint64)


class Powers:
    """Powers of a base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            self.up, self.down = (np.full(self.n, b, dtype=np.uint64) for b in (self.base, self.inverse))
            for x in (self.up, self.down):
                x[0] = 1
                np.multiply.accumulate(x, out=x)
        return self.up[:n], self.down[:n]


POWERS = [Powers(b) for b in BASES]


def scramble(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Rolling:
    """Keys of any stretches of a sequence of unit codes, from prefix sums modulo 2^64."""

    def __init__(self, codes: np.ndarray, which: int) -> None:
        self.up, self.down = POWERS[which].upto(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * self.up[:-1], out=self.sums[1:])

    def keys(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((self.sums[end] - self.sums[start]) * self.down[start])


@dataclass
class Units:
    """The units of a chunk: two codes each; bounds: where each text starts, and the end."""

    codes: tuple[np.ndarray, np.ndarray]
    bounds: np.ndarray

    def room(self) -> np.ndarray:
        """Units left in the own text, from each position."""
        size = np.diff(self.bounds)
        return np.repeat(self.bounds[1:], size) - np.arange(self.bounds[-1])


@dataclass
class Rule:
    """W units a window, seeds of ``seed`` units within ``reach`` units of a window's start (seed + reach - 1 = W).

    units: of a chunk's bytes and text bounds; seeds: positions in the units that may serve as seeds;
    units_a_byte and seeds_a_byte: about how many there are, for the number of buckets.
    """

    window: int
    seed: int
    reach: int
    units: Callable[[np.ndarray, np.ndarray], Units]
    seeds: Callable[[Units], np.ndarray]
    units_a_byte: float
    seeds_a_byte: float


@dataclass
class Keys:
    """Sorted distinct keys of a chunk, and how positions map to them."""

    first: np.ndarray
    second: np.ndarray | None
    multi: np.ndarray
    back: np.ndarray  # position in the caller's order -> distinct key

    @staticmethod
    def of(first: np.ndarray, second: np.ndarray | None) -> Keys:
        order = np.argsort(first)
        s = first[order]
        new = np.ones(len(s), dtype=bool)
        new[1:] = s[1:] != s[:-1]
        if second is not None:
            t = second[order]
            new[1:] |= t[1:] != t[:-1]
            t = t[new]
        group = np.cumsum(new) - 1
        back = np.empty(len(s), dtype=np.int64)
        back[order] = group
        return Keys(s[new], None if second is None else t, np.bincount(group, minlength=int(new.sum())) > 1, back)

    def rows(self, bits: int, low: int, high: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, data) of each bucket from low to high - 1 that holds keys."""
        bucket = (self.first >> np.uint64(64 - bits)).astype(np.int64)
        edge = np.searchsorted(bucket, np.arange(low, high + 1))
        for b, i, j in zip(range(low, high), edge[:-1].tolist(), edge[1:].tolist()):
            if i < j:
                more = b"" if self.second is None else self.second[i:j].tobytes()
                yield b, self.first[i:j].tobytes() + more + np.packbits(self.multi[i:j]).tobytes()

    def tied(self, bits: int, answer: dict[int, bytes]) -> np.ndarray:
        """For each position, whether its key is tied, from the answers by bucket."""
        bucket = (self.first >> np.uint64(64 - bits)).astype(np.int64)
        out = np.zeros(len(self.first), dtype=bool)
        for b, got in answer.items():
            i, j = np.searchsorted(bucket, [b, b + 1])
            out[i:j] = np.unpackbits(np.frombuffer(got, np.uint8), count=int(j - i)).astype(bool)
        return out[self.back]


def bucket_ties(table: pa.Table, two: bool) -> pa.Table:
    """Answer the rows of one bucket: which of their keys other rows hold too, or the row holds twice."""
    size = 12 if two else 8
    data = [x.as_buffer() for x in table.column("data")]
    counts = [8 * len(d) // (8 * size + 1) for d in data]
    first = np.concatenate([np.frombuffer(d, np.uint64, n) for d, n in zip(data, counts)])
    multi = [np.unpackbits(np.frombuffer(d, np.uint8, offset=size * n), count=n) for d, n in zip(data, counts)]
    order = np.argsort(first)
    s = first[order]
    same = s[1:] == s[:-1]
    if two and same.any():
        second = np.concatenate([np.frombuffer(d, np.uint32, n, 8 * n) for d, n in zip(data, counts)])
        t = second[order]
        if (t[1:] != t[:-1])[same].any():  # equal first parts, unequal second parts
            order = np.lexsort((second, first))
            s, t = first[order], second[order]
        same = (s[1:] == s[:-1]) & (t[1:] == t[:-1])
    tied = np.concatenate(multi).astype(bool)
    tied[order[1:][same]] = True
    tied[order[:-1][same]] = True
    upto = np.cumsum([0, *counts])
    answer = [np.packbits(tied[i:j]).tobytes() for i, j in zip(upto[:-1], upto[1:])]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "answer": pa.array(answer, pa.binary())})


def find_ties(sent: DataFrame, two: bool, name: str) -> DataFrame:
    """chunk, answers: array<struct<bucket, answer>>, of the rows (chunk, bucket, data)."""
    answered = sent.groupBy("bucket").applyInArrow(lambda table: bucket_ties(table, two), "chunk long, bucket int, answer binary")
    return save(answered.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias(name)), f"repeats_{name}")


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct texts, packed: chunk, digests, copies, blob, bounds; written once."""
    t = F.coalesce(F.col(text), F.lit("")).alias("text")
    distinct = docs.select(digest(F.col(text)).alias("digest"), t).groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        digests, copies, texts, size = [], [], [], 0
        for batch in batches:
            for d, n, x in zip(*(batch.column(c).to_pylist() for c in ("digest", "copies", "text"))):
                raw = x.encode()
                if texts and size + len(raw) > CHUNK_BYTES:
                    yield packed(chunk, digests, copies, texts)
                    chunk, digests, copies, texts, size = chunk + 1, [], [], [], 0
                digests.append(d)
                copies.append(n)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield packed(chunk, digests, copies, texts)

    def packed(chunk: int, digests: list, copies: list, texts: list) -> pa.RecordBatch:
        bounds = np.cumsum([0, *map(len, texts)])
        columns = [pa.array([chunk]), pa.array([digests]), pa.array([copies], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary()), pa.array([bounds.tolist()], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "digests", "copies", "blob", "bounds"])

    return save(distinct.mapInArrow(pack, "chunk long, digests array<string>, copies array<long>, blob binary, bounds array<long>"), "repeats_chunks")


def chunk_units(row: dict, rule: Rule) -> Units:
    return rule.units(np.frombuffer(row["blob"], np.uint8), np.array(row["bounds"], dtype=np.int64))


def seed_keys(u: Units, rule: Rule) -> tuple[np.ndarray, Keys]:
    at = rule.seeds(u)
    at = at[u.room()[at] >= rule.seed]
    return at, Keys.of(Rolling(u.codes[0], 0).keys(at, at + rule.seed), None)


def window_keys(u: Units, rule: Rule, at: np.ndarray) -> Keys:
    second = (Rolling(u.codes[1], 1).keys(at, at + rule.window) >> np.uint64(32)).astype(np.uint32)
    return Keys.of(Rolling(u.codes[0], 0).keys(at, at + rule.window), second)


def candidates(u: Units, rule: Rule, seeds: np.ndarray) -> np.ndarray:
    """The starts of windows with one of these seeds in reach."""
    n = len(u.codes[0])
    mark = np.zeros(n + 1, dtype=np.int32)
    np.add.at(mark, np.maximum(0, seeds - (rule.reach - 1)), 1)
    np.add.at(mark, seeds + 1, -1)
    return np.flatnonzero((np.cumsum(mark[:n]) > 0) & (u.room() >= rule.window))


def answers(row: dict, name: str) -> dict[int, bytes]:
    return {x["bucket"]: x["answer"] for x in row[name] or []}


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def sent_rows(chunk: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([chunk] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "data"])


def bits_for(keys: float) -> int:
    return max(5, int(np.ceil(np.log2(max(1.0, keys / BUCKET_KEYS)))))


def covered(packed: DataFrame, rule: Rule, judge: Callable[[dict, Units, np.ndarray], pa.RecordBatch], schema: str, blocks: int) -> DataFrame:
    """Run the three steps over a table of ``chunks``; judge makes the rows of a chunk from its units and tied window starts."""
    total = packed.agg(F.sum(F.element_at("bounds", -1))).first()[0] or 0
    seed_bits, window_bits = bits_for(total * rule.seeds_a_byte), bits_for(total * rule.units_a_byte)
    window_bits = min(max(window_bits, int(blocks).bit_length()), 30)
    sent = "chunk long, bucket int, data binary"

    def send_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys = seed_keys(chunk_units(row, rule), rule)[1]
            yield sent_rows(row["chunk"], list(keys.rows(seed_bits, 0, 1 << seed_bits)))

    def window_starts(row: dict, u: Units) -> np.ndarray:
        at, keys = seed_keys(u, rule)
        return candidates(u, rule, at[keys.tied(seed_bits, answers(row, "seeds"))])

    def send_windows(low: int, high: int):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                u = chunk_units(row, rule)
                keys = window_keys(u, rule, window_starts(row, u))
                yield sent_rows(row["chunk"], list(keys.rows(window_bits, low, high)))

        return send

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            u = chunk_units(row, rule)
            starts = window_starts(row, u)
            if len(starts):
                found = {b: x for k in range(blocks) for b, x in answers(row, f"windows{k}").items()}
                starts = starts[window_keys(u, rule, starts).tied(window_bits, found)]
            yield judge(row, u, starts)

    light = packed.select("chunk", "blob", "bounds")
    seeds = find_ties(light.mapInArrow(send_seeds, sent), False, "seeds")
    known = light.join(seeds.hint("shuffle_hash"), "chunk", "left")
    edges = [(1 << window_bits) * k // blocks for k in range(blocks + 1)]
    out = packed.join(seeds.hint("shuffle_hash"), "chunk", "left")
    for k in range(blocks):
        found = find_ties(known.mapInArrow(send_windows(edges[k], edges[k + 1]), sent), True, f"windows{k}")
        out = out.join(found.hint("shuffle_hash"), "chunk", "left")
    return out.mapInArrow(remove, schema)


def cover_mask(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    mark = np.zeros(n + 1, dtype=np.int32)
    mark[starts] += 1
    np.add.at(mark, starts + window, -1)
    return np.cumsum(mark[:n]) > 0


def per_document(docs: DataFrame, judged: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of distinct texts, given to every document by its digest."""
    own = docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest"))
    return own.join(judged, "digest").drop("digest")
