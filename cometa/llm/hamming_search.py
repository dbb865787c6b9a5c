"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit per dimension (1 where the component is positive).
The code is cut into m segments of about log2(rows) bits, and every segment is an
index: (segment number, value) -> codes. Step s probes every segment of each open
query with all values at Hamming distance s from the query's own. After it, a code
that was not found differs by s + 1 or more in every segment, so every code within
distance m * s + m - 1 has been found. A query closes when it has k verified
neighbours and the k-th distance is within that radius; the others go on. A pair of
codes is verified in the first segment of the first step that meets it, so it is
never handled twice.

Each index is written once, in blocks of at most some ``BLOCK`` codes, sorted by the
segment's value; the blocks of an index are told apart by the leading bits of the value
(and, where very many codes share these, by a hash). A step sends each open query, in
blocks too, to the leading bits within distance s of its own. Where a block of queries
meets a block of codes, the probes for the rest of the value are looked up in the sorted
values, or all values compared where that is less work, and only each query's k best
leave the task: neither probes nor candidates are rows.

Scale: equal codes are collapsed first, each with its k smallest ids (combined on
the map side), so one vector held by a third of all rows is one code: an answer
never needs more than k ids of one code. As segments widen with the logarithm of
the rows, a probe meets about one code. A task holds one block of codes and one of
queries; the driver only asks whether queries are left. Every step's state is a
written table, and nothing is broadcast.

Ties in distance go to the smaller id. Defined results: a row counts as its own
neighbour, as queries run against all rows; rows with a null vector or id are
neither queries nor answers; a null or NaN component, or one that a shorter vector
lacks, is bit 0; repeated rows of one id count as one; if there are fewer than k
ids, all are returned; an empty table gives an empty result. Only the named
columns are read; ids are long integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cometa.llm.common import save

BLOCK = 1 << 14
TOP = 10
EVERY = 50


def segment_bounds(dims: int, rows: int) -> list[tuple[int, int]]:
    """Near-equal stretches of dimensions, each of about log2(rows) bits and 24 at most."""
    width = min(24, max(8, round(log2(max(2, rows)))))
    m = max(1, ceil(dims / width))
    return [(dims * i // m, dims * (i + 1) // m) for i in range(m)]


def segment_values(vector: Column, bounds: list[tuple[int, int]]) -> Column:
    """The code as an array of one int a segment."""

    def bit(i: int, shift: int) -> Column:
        x = F.get(vector, F.lit(i))
        return F.when((x > 0) & ~F.isnan(x), F.lit(1 << shift)).otherwise(F.lit(0))

    def value(a: int, b: int) -> Column:
        out = F.lit(0)
        for i in range(a, b):
            out = out + bit(i, i - a)
        return out.cast("int")

    return F.array(*[value(a, b) for a, b in bounds])


def flips(width: int, weight: int) -> list[int]:
    """All numbers of ``width`` bits of which ``weight`` are set."""
    return [sum(1 << i for i in c) for c in combinations(range(width), weight)]


def nearest(found: DataFrame, k: int, radius: int) -> DataFrame:
    """The k nearest (distance, id) of each query code; closed: the k-th is within the radius."""
    own = W.partitionBy("query")
    best = found.withColumn("rank", F.row_number().over(own.orderBy("distance", "id"))).where(F.col("rank") <= k)
    kth = F.max(F.when(F.col("rank") == k, F.col("distance"))).over(own)
    return best.withColumn("closed", F.coalesce(kth <= radius, F.lit(False)))


def code_blocks(codes: DataFrame, bounds: list[tuple[int, int]], lead: int, k: int) -> DataFrame:
    """The written blocks of all indexes: segment, lead, and, sorted by the segment's value, values, codes, ids and how many ids each code has."""
    m = len(bounds)
    each = codes.select("code", "ids", F.posexplode("code").alias("segment", "value"))
    each = each.withColumn("lead", _lead(bounds, lead))
    sizes = each.groupBy("segment", "lead").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    dealt = each.join(sizes, ["segment", "lead"]).withColumn("chunk", F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int"))

    def pack(key, table):
        order = np.argsort(table.column("value").to_numpy(), kind="stable")
        ids = table.column("ids").combine_chunks()
        count = np.diff(ids.offsets.to_numpy())[order]
        ids = ids.take(pa.array(order)).flatten().to_numpy()
        code = table.column("code").combine_chunks().flatten().to_numpy().reshape(-1, m)[order]
        row = [key[0].as_py(), key[1].as_py(), table.column("value").to_numpy()[order].tobytes(), code.tobytes(), ids.astype("<i8").tobytes(), count.astype("<i4").tobytes()]
        types = [pa.int32(), pa.int32()] + [pa.binary()] * 4
        return pa.table({c: pa.array([v], t) for c, v, t in zip(("segment", "lead", "value", "code", "ids", "count"), row, types)})

    packed = dealt.select("segment", "lead", "chunk", "value", "code", F.col("ids").cast("array<long>").alias("ids"))
    schema = "segment int, lead int, value binary, code binary, ids binary, count binary"
    return save(packed.groupBy("segment", "lead", "chunk").applyInArrow(pack, schema), "hamming_blocks")


def _lead(bounds: list[tuple[int, int]], lead: int) -> Column:
    """The leading bits of a segment's value: ``lead`` of them, or all if it has fewer."""
    rest = F.array(*[F.lit(max(0, b - a - lead)) for a, b in bounds])
    return F.call_function("shiftright", F.col("value"), F.get(rest, F.col("segment")))


def step(queries: DataFrame, blocks: DataFrame, bounds: list[tuple[int, int]], lead: int, s: int, k: int, open_queries: int) -> DataFrame:
    """query, distance, id: the k best of the pairs that step ``s`` is the first to meet, for each query and block."""
    m, widths = len(bounds), [b - a for a, b in bounds]
    own = queries.select(F.col("query"), F.posexplode("query").alias("segment", "value")).withColumn("lead", _lead(bounds, lead))
    last = F.get(F.array(*[F.lit((1 << min(lead, w)) - 1) for w in widths]), F.col("segment"))
    near = F.filter(F.sequence(F.lit(0), last), lambda x: F.bit_count(x) <= s)
    sent = own.select("query", "segment", F.explode(F.transform(near, lambda x: x.bitwiseXOR(F.col("lead")))).alias("lead"))
    share = max(1, ceil(open_queries / BLOCK * 8))
    sent = sent.groupBy("segment", "lead", F.pmod(F.xxhash64("query"), F.lit(share)).alias("part")).agg(F.flatten(F.collect_list("query")).alias("queries"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("segment", "value", "code", "ids", "count")}
                j, value, ids = row["segment"], np.frombuffer(row["value"], "<i4"), np.frombuffer(row["ids"], "<i8")
                code, count = np.frombuffer(row["code"], "<i4").reshape(-1, m), np.frombuffer(row["count"], "<i4")
                first = np.cumsum(count) - count
                asked = batch.column("queries")[r].values.to_numpy().reshape(-1, m)
                low = max(0, widths[j] - lead)
                found = ([], [], [])
                for q in asked:
                    t = s - int(q[j] >> low ^ value[0] >> low).bit_count()  # what the rest of the value may differ by
                    if not 0 <= t <= low:
                        continue
                    if comb(low, t) * log2(len(value) + 1) < len(value):
                        if (low, t) not in made:
                            made[low, t] = np.array(flips(low, t), np.int32)
                        probes = (int(value[0]) >> low << low | int(q[j]) & (1 << low) - 1) ^ made[low, t]
                        a, b = np.searchsorted(value, probes, "left"), np.searchsorted(value, probes, "right")
                        n = b - a
                        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    else:
                        at = np.flatnonzero(np.bitwise_count(value ^ q[j]) == s)
                    apart = np.bitwise_count(code[at] ^ q)
                    new = (apart[:, :j] > s).all(axis=1) & (apart[:, j:] >= s).all(axis=1)
                    at, distance = at[new], apart[new].sum(axis=1, dtype=np.int32)
                    if len(at) > k:  # those beyond the k-th code can't be among the k best
                        inside = distance <= np.partition(distance, k - 1)[k - 1]
                        at, distance = at[inside], distance[inside]
                    n = count[at]
                    mine = ids[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    distance = np.repeat(distance, n)
                    best = np.lexsort((mine, distance))[:k]
                    for c, x in zip(found, (np.repeat(q[None], len(best), axis=0), distance[best], mine[best])):
                        c.append(x)
                if found[0]:
                    q, distance, mine = (np.concatenate(c) for c in found)
                    columns = [pa.array(list(q), pa.list_(pa.int32())), pa.array(distance, pa.int32()), pa.array(mine)]
                    yield pa.RecordBatch.from_arrays(columns, ["query", "distance", "id"])

    met = blocks.hint("merge").join(sent, ["segment", "lead"])
    return met.select("segment", "value", "code", "ids", "count", "queries").mapInArrow(compare, "query array<int>, distance int, id long")


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, neighbor_id, distance: the k nearest rows of ``vectors`` for each row of ``queries``."""
    facts = vectors.agg(F.count("*").alias("rows"), F.max(F.size(vector)).alias("dims")).first()
    bounds = segment_bounds(max(1, facts["dims"] or 1), facts["rows"])

    def coded(df: DataFrame) -> DataFrame:
        known = df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull())
        return known.select(F.col(id_col).alias("id"), segment_values(F.col(vector), bounds).alias("code"))

    # k distinct ids of each code: repeated rows tie in dense_rank
    place = F.dense_rank().over(W.partitionBy("code").orderBy("id"))
    own = coded(vectors).withColumn("place", place).where(F.col("place") <= k)
    codes = save(own.groupBy("code").agg(F.sort_array(F.collect_set("id")).alias("ids")), "hamming_codes")
    asked = save(coded(queries).distinct(), "hamming_queries")

    lead = max(0, ceil(log2(max(1, codes.count()) / BLOCK)))
    blocks = code_blocks(codes, bounds, lead, k)
    left = save(asked.select(F.col("code").alias("query")).distinct(), "hamming_open")
    best, answers = None, None
    for s in range(max(b - a for a, b in bounds) + 1):
        found = step(left, blocks, bounds, lead, s, k, left.count())
        if best is not None:
            found = found.unionByName(best.where(~F.col("closed")).select("query", "distance", "id"))
        best = save(nearest(found, k, len(bounds) * (s + 1) - 1), "hamming_best")
        closed = best.where("closed")
        answers = closed if answers is None else answers.unionByName(closed)
        left = save(left.join(closed.select("query").hint("merge"), "query", "left_anti"), "hamming_open")
        if left.isEmpty():
            break
    else:  # every value of every segment was probed: fewer than k ids
        answers = answers.unionByName(best.where(~F.col("closed")))
    own = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    return own.join(answers.hint("merge"), "query").select("query_id", "rank", F.col("id").alias("neighbor_id"), "distance")


def query(vectors: DataFrame) -> DataFrame:
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH bits AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN 1 ELSE 0 END) AS code
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS neighbor_id, CAST(list_sum(list_transform(list_zip(q.code, d.code), lambda p: abs(p[1] - p[2]))) AS INTEGER) AS distance
  FROM bits q CROSS JOIN bits d WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
WHERE rank <= {TOP}
"""
