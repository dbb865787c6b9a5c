"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles. Equal sets are one record, so copies are
never paired. A record is embedded as ``TOKENS`` minwise tokens. A run starts with
all records in one bucket; each record goes on to the children named by those of
its tokens that a hash of (bucket, token) chooses, each with probability
1 / (threshold * TOKENS), so two records meet again with the share of tokens that
they have in common. Buckets over ``LIMIT`` records are split again, ``DEPTH``
times at most; small ones are compared by brute force. ``RUNS`` runs go side by
side: a pair at the threshold shares a leaf of a run with probability 0.63 (one
level) to 0.37 (three), so all runs miss it with probability below 0.0001.

A leaf is compared against pivots: the records near a pivot by the tokens (LINK)
join its cluster, and those very near (CLOSE) need no pivot of their own: by the
triangle inequality of the Jaccard distance, a partner of theirs at the threshold
is near the same pivot. So a leaf of thousands of near copies takes one pass, not
all pairs. A leaf over ``BLOCK`` records is compared in blocks, whose pivots are
then compared with each other at the wider distance APART. The clusters
are connected components, so all pairs that share a leaf in any run end in one
cluster. An exact check of the shingle sets follows inside clusters, in blocks of
``BLOCK`` records and pairs of blocks; it counts links and gives components. Pairs
are never rows.

Words are runs of characters other than ASCII white space, unchanged; a text of
one to four words is one shingle of its words.

Defined results: texts without words (null texts too) have no links and are
classes of their own; equal sets are linked; links count documents, copies
included; a null doc_id travels, and a class is named by its least doc_id that is
not null; repeated rows count as copies; an empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cometa.llm.common import WORD, free_name, give_back_memory, save, steps
from cometa.llm.components import components
from cometa.llm.phrase_dedup import units
from cometa.llm.repeats import Rolling, scramble

WORDS = 5
THRESHOLD = 0.8
TOKENS = 128
RUNS = 20
LIMIT, DEPTH = 128, 3
BLOCK = 1024
STEP = 1 << 19
CLOSE, LINK, APART = 0.82, 0.42, 0.2

_G = np.random.Generator(np.random.PCG64(7))
_A = _G.integers(1, 1 << 32, TOKENS, dtype=np.uint32) | np.uint32(1)
_B = _G.integers(0, 1 << 32, TOKENS, dtype=np.uint32)
_PLACE = _G.integers(1, 1 << 63, TOKENS, dtype=np.uint64)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle keys of each text."""
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    u = units(np.frombuffer(b"".join(raw), np.uint8), bounds)
    at = np.arange(u.bounds[-1])
    size = np.diff(u.bounds)
    full = np.flatnonzero(u.room() >= words)
    short = u.bounds[:-1][(size > 0) & (size < words)]
    start = np.sort(np.concatenate([full, short]))
    end = np.minimum(start + words, np.repeat(u.bounds[1:], size)[start]) if len(at) else start
    keys = Rolling(u.codes[0], 0).keys(start, end) + (end - start).astype(np.uint64)
    edge = np.searchsorted(start, u.bounds)
    return [np.unique(keys[i:j]) for i, j in zip(edge[:-1], edge[1:])]


def minwise(keys: np.ndarray) -> np.ndarray:
    """The least value of each of ``TOKENS`` hash functions."""
    low = np.full(TOKENS, 0xFFFFFFFF, dtype=np.uint32)
    k = (keys >> np.uint64(32)).astype(np.uint32) ^ keys.astype(np.uint32)
    for at in range(0, len(k), 2048):
        h = k[at : at + 2048, None] * _A
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h += _B
        h ^= h >> np.uint32(13)
        np.minimum(low, h.min(axis=0), out=low)
    return low


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of some ``STEP`` bytes of text: the keys of their bytes take some sixty times as much."""
    for batch in batches:
        yield from steps(batch, STEP)


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def sketch(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """doc_id, digest (of the text), key (of the shingle set; null if empty), tokens."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            tokens = [minwise(s).tobytes() if len(s) else None for s in sets]
            columns = [batch.column("doc_id"), batch.column("digest"), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "key", "tokens"])
        give_back_memory()

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, digest string, key binary, tokens binary")


def children(records: DataFrame, threshold: float, runs: int) -> DataFrame:
    """(path, key) of the children that each record's tokens choose; records: key, tokens and, below the roots, path."""
    limit = np.uint64(int(2**64 / (threshold * TOKENS)))
    roots = scramble(np.arange(1, runs + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048):
            keys = batch.column("key")
            codes = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS).astype(np.uint64)
            codes = scramble(codes * np.uint64(0x9E3779B97F4A7C15) ^ _PLACE)
            own = [None] * len(roots) if "path" not in batch.schema.names else [batch.column("path").to_numpy().view(np.uint64)[:, None]]
            for k, path in enumerate(own):
                h = scramble(codes ^ (roots[k] if path is None else path))
                row, token = np.nonzero(h < limit)
                # the child's name is scrambled again: a chosen hash is small
                child = scramble(h[row, token] + np.uint64(1)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(child), keys.take(pa.array(row))], ["path", "key"])
        give_back_memory()

    return records.mapInArrow(run, "path long, key binary")


def leaves(records: DataFrame, threshold: float, runs: int) -> DataFrame:
    """(path, key, n): the buckets of two or more records in which the runs end; n is the bucket's size."""
    own = records.select("key", "tokens")
    rows, found = save(children(own, threshold, runs), "path_rows"), []
    for level in range(DEPTH):
        size = rows.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") >= 2)
        shared = save(rows.join(size, "path"), "path_shared")
        last = level == DEPTH - 1
        found.append(shared if last else shared.where(F.col("n") <= LIMIT))
        if not last:
            rows = save(children(shared.where(F.col("n") > LIMIT).select("path", "key").join(own, "key"), threshold, runs), "path_rows")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    # buckets with the same members are compared once
    alike = out.groupBy("path", "n").agg(F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("members"))
    once = alike.groupBy("n", "members").agg(F.min("path").alias("path")).select("path")
    return save(out.join(once, "path", "left_semi"), "path_leaves")


def pivot_rows(keys: list[bytes], tokens: np.ndarray, close: float, link: float) -> tuple[np.ndarray, list[int]]:
    """(the member that names each record's cluster, the pivots). Records near one pivot are one cluster."""
    rest, pivots = np.argsort(np.array(keys, dtype=object), kind="stable"), []
    root = np.empty(len(rest), dtype=np.int64)
    root[rest] = np.arange(len(rest))  # by place in the order of keys
    order = rest
    while len(rest):
        p = int(rest[0])
        pivots.append(p)
        near = np.unique(root[(tokens == tokens[p]).mean(axis=1) >= link])
        root[np.isin(root, near)] = near[0]
        rest = rest[1:]
        rest = rest[(tokens[rest] == tokens[p]).mean(axis=1) < close]
    return order[root], pivots


def clusters(records: DataFrame, leaf: DataFrame) -> DataFrame:
    """(vertex, component): clusters of records that share a leaf and may be similar."""
    tokens = records.select("key", "tokens")
    block = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BLOCK)).cast("int")
    dealt = leaf.withColumn("block", block).join(tokens, "key")

    def compare(close: float, link: float):
        def run(table: pa.Table) -> pa.Table:
            keys = table.column("key").to_pylist()
            rows = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            root, pivots = pivot_rows(keys, rows, close, link)
            path, n = table.column("path")[0].as_py(), table.column("n")[0].as_py()
            # a row joins each record to its cluster; where other blocks hold records of the leaf, each pivot has a row (itself twice)
            out = [(k, keys[r]) for k, r in zip(keys, root) if k != keys[r]] + [(keys[p], keys[p]) for p in pivots if n > BLOCK]
            a, b = zip(*out) if out else ((), ())
            return pa.table({"path": pa.array([path] * len(a), pa.int64()), "n": pa.array([n] * len(a), pa.int64()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

        return run

    schema = "path long, n long, a binary, b binary"
    near = save(dealt.groupBy("path", "block").applyInArrow(compare(CLOSE, LINK), schema), "path_near")
    heads = near.where((F.col("n") > BLOCK) & (F.col("a") == F.col("b"))).select("path", "n", F.col("a").alias("key")).join(tokens, "key")
    across = heads.groupBy("path").applyInArrow(compare(2.0, APART), schema)
    return save(components(near.unionByName(across).select("a", "b")), "path_clusters")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of every two sets: frequent keys by matrix products, rare ones by counting their pairs."""
    m = len(sets)
    key, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    often = np.bincount(number, minlength=len(key))[number]
    out = np.zeros(m * m, dtype=np.int32)
    rare = (often > 1) & (often <= 12)
    n, o = number[rare], owner[rare]
    for step in range(1, 12):
        same = n[step:] == n[:-step]
        if not same.any():
            break
        cell, n_same = np.unique(o[:-step][same] * m + o[step:][same], return_counts=True)
        out[cell] += n_same.astype(np.int32)
    out = out.reshape(m, m)
    out = out + out.T
    n, o = number[often > 12], owner[often > 12]
    if len(n):
        dense = np.unique(n, return_inverse=True)[1]
        edge = np.searchsorted(dense, np.arange(0, dense[-1] + 2049, 2048))
        for k, (i, j) in enumerate(zip(edge[:-1], edge[1:])):
            a = np.zeros((m, 2048), dtype=np.float32)
            a[o[i:j], dense[i:j] - 2048 * k] = 1
            out += np.rint(a @ a.T).astype(np.int32)
    return out


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    size = np.array([len(s) for s in sets])
    both = intersections(sets)
    out = np.empty(both.shape, dtype=bool)
    for k in range(0, len(sets), 256):  # a few rows at a time need no further matrices
        out[k : k + 256] = both[k : k + 256] * (1 + threshold) >= threshold * (size[k : k + 256, None] + size[None, :]) - 1e-9
    np.fill_diagonal(out, False)
    return out


def roots(links: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    root = np.arange(len(links))
    while True:
        low = np.where(links, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def exact_links(docs: DataFrame, text: str, records: DataFrame, members: DataFrame, words: int, threshold: float) -> DataFrame:
    """(key, links, root): from every block and pair of blocks of a cluster, the documents linked to a record, and a member of its component."""
    size = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(size, "component").withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    own = records.select("key", "digest", "copies").join(dealt.withColumnRenamed("vertex", "key"), "key").drop("key")
    texts = docs.select(digest(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    kept = ["component", "blocks", "block", "copies"]

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], [*kept, "key", "keys"])
        give_back_memory()

    sets = texts.join(own, "digest").mapInArrow(with_sets, "component binary, blocks int, block int, copies long, key binary, keys binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = sets.withColumn("other", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def compare(table: pa.Table) -> pa.Table:
        block, low, high = (table.column(c).to_numpy() for c in ("block", "low", "high"))
        copies, keys = table.column("copies").to_numpy(), table.column("key").to_pylist()
        links = linked([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()], threshold)
        if low[0] != high[0]:  # a pair of blocks: links inside a block are counted elsewhere
            links &= block[:, None] != block[None, :]
        root = roots(links)
        out = pa.table({"key": pa.array(keys, pa.binary()), "links": pa.array([int(copies[row].sum()) for row in links], pa.int64()), "root": pa.array([keys[r] for r in root], pa.binary())})
        if len(keys) > BLOCK // 2:  # the matrices of a large group
            del links, table
            give_back_memory()
        return out

    return sent.groupBy("component", "low", "high").applyInArrow(compare, "key binary, links long, root binary")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, runs: int = RUNS) -> DataFrame:
    """doc_id, digest (of the text), component (null without words), n_links: a row for each document."""
    own = save(sketch(docs, doc_id, text, words), "path_documents")
    records = save(
        own.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("tokens").alias("tokens"), F.min("digest").alias("digest"), F.count("*").alias("copies")),
        "path_records",
    )
    members = clusters(records, leaves(records, threshold, runs))
    found = save(exact_links(docs, text, records, members, words, threshold), "path_links")
    group = save(components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))), "path_groups")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    about = (
        records.select("key", "copies")
        .join(links, "key", "left")
        .join(group.withColumnRenamed("vertex", "key"), "key", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("component"))
    )
    placed = own.select("doc_id", "digest", "key").join(about, "key", "left")
    return save(placed.select("doc_id", "digest", "component", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "path_placed")


def join(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id (least doc_id of the documents it is linked to, directly or not), n_links (documents at the threshold or above)."""
    placed = classes(docs, **how)
    names = placed.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("class_id"))
    name = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return placed.join(names, "component", "left").select("doc_id", name.alias("class_id"), "n_links")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each class, unchanged: the least doc_id (null last), then the least digest; rows without words all stay."""
    placed = classes(docs, doc_id, text, **how)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least")
    first = placed.where(F.col("component").isNotNull()).groupBy("component").agg(least)
    own, of, at = (free_name(docs.columns, c) for c in ("digest of a text", "id of a class", "place of a row"))
    first = first.select(F.col("least.digest").alias(own), F.col("least.doc_id").alias(of))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    words = F.coalesce(F.col(text), F.lit("")).rlike(WORD)
    tagged = docs.where(words).withColumn(own, digest(F.col(text)))
    found = tagged.join(first, own).where(F.col(doc_id).eqNullSafe(F.col(of)))
    # a row may be repeated; one of it stays
    once = found.withColumn(at, F.row_number().over(W.partitionBy(own, doc_id).orderBy(F.lit(0)))).where(F.col(at) == 1)
    return once.select(*columns).unionByName(docs.where(~words))


def query(docs: DataFrame) -> DataFrame:
    return join(docs)


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), starts AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS} + 1, 1) + 1)) AS i FROM w WHERE len(ws) > 0
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + {WORDS} - 1), ' ') AS s FROM starts
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE m * (1 + {THRESHOLD}) >= {THRESHOLD} * (x.n + y.n) - 1e-9
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), class AS (
  SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM class LEFT JOIN degree USING (doc_id)
"""
