"""Phrase collocations by Toivonen's sampling method, with exact counts.

1. Sample: the phrases of one document in ``SAMPLE`` (by a hash of its text) are
   counted; those seen ``LEAST`` times or more in it are proposed.
2. Full pass: over all documents, every word is counted, and every longer phrase
   whose two parts (without its last, without its first word) are proposed. These are
   the proposed phrases and their negative border, the smallest ones not proposed.
3. A phrase of the border that reaches the support is a failure: phrases around it
   may have been missed. Such phrases are proposed too, and an expansion pass counts
   every longer phrase that was not counted yet and whose parts may reach the support:
   they are proposed, or not counted yet and have such parts themselves. No phrase that
   can reach the support is left uncounted then, so this closes the border.
4. These passes count 64-bit keys of phrases, so that no text travels. Two phrases
   that share a key only raise its count. A last pass therefore counts, as text, the
   phrases whose keys reached the support, and keeps those that really did.

A pass asks a Bloom filter of fixed size (``FILTER_BITS``) whether a part is
proposed. A wrong yes makes it count a phrase more, never one less; and since the
same filters tell which pass counts a phrase, none is counted twice.

Words are numbered per language over steps of ``STEP`` bytes of text; keys of phrases
are mixed from keys of words for all places at once, sorted, and leave the task as
distinct keys with counts, to be added up by Spark. Candidates then take the counts of
their parts by joins (salted where very many candidates share a part), and the top
list per language is a limited window over them.

Scale: no task or driver holds a table of phrases. The driver holds one filter (fixed
size) and broadcasts one a pass; memory in a task is bounded by the step and the
longest text. Passes: the sample, one full pass, an expansion pass if the border fails,
and the last.

Defined results: a null text is empty; a null language is ``und``; equal rows count
each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cometa.llm.common import give_back_memory, save

SUPPORT = 10
SAMPLE = 8
LEAST = 2
FILTER_BITS = 1 << 27  # 16 MB
STEP = 1 << 22
HOLD = 1 << 20  # keys that a task adds up before they leave it
SHARE = 20_000
NONE = "und"
# The bytes that end a piece (as "."), those that part words, and lower case of A-Z alone.
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_TABLE = bytes(46 if b in _ENDS else 32 if b in _BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
COUNTS = "lang string, words int, phrase string, n long"
_TAG = np.uint64(7)  # the low bits of a key are the number of its words


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """One 64-bit hash of two, in order."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15) + b) ^ ((a ^ (b << np.uint64(23))) >> np.uint64(29))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Filter:
    """A Bloom filter over 64-bit keys (three probes); adding and asking whole arrays."""

    def __init__(self, bits: int, cells: np.ndarray | None = None) -> None:
        self.bits = bits
        self.cells = np.zeros(bits // 8, np.uint8) if cells is None else cells

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(3):
            yield _mix(keys, np.uint64(k + 1)) & np.uint64(self.bits - 1)

    def add(self, keys: np.ndarray) -> None:
        for at in self.places(keys):
            np.bitwise_or.at(self.cells, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self.places(keys):
            found &= (self.cells[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


class Text:
    """The words of a text, numbered, and the keys of its phrases at each place."""

    def __init__(self, text: bytes, lang: str, longest: int) -> None:
        parts = pc.ascii_split_whitespace(pa.array([text.translate(_TABLE).replace(b".", b" . ")], pa.large_binary()).cast(pa.large_string()))
        coded = parts.values.dictionary_encode()
        names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.words, self.at = coded.dictionary.cast(pa.large_binary()), at
        ends = np.array([w == "." or not w for w in names], bool)  # an empty word stands only at the text's ends
        seed = xxhash.xxh64_intdigest(lang.encode())
        one = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in names), np.uint64, len(names))
        self.one, self.real, self.keys = one, [~ends[at]], [one[at]]
        for size in range(1, longest):
            self.real.append(self.real[-1][:-1] & self.real[0][size:])
            self.keys.append(_mix(self.keys[-1][:-1], self.keys[0][size:]))

    def key(self, size: int) -> np.ndarray:
        """The keys of the phrases of ``size`` words that start at each place."""
        return (self.keys[size - 1] & ~_TAG) | np.uint64(size)

    def known(self, size: int, among: Filter) -> np.ndarray:
        """At which places a phrase of ``size`` words stands that the filter has."""
        if size == 1:
            return among.has((self.one & ~_TAG) | np.uint64(1))[self.at] & self.real[0]
        out = self.real[size - 1].copy()
        out[out] = among.has(self.key(size)[out])
        return out

    def phrases(self, size: int, places: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The distinct phrases that start at the given places, and how often each does."""
        code = self.at[places].astype(np.int64)
        for k in range(1, size):
            if len(code) and int(code.max()) >= 2**62 // len(self.words):
                code = np.unique(code, return_inverse=True)[1]
            code = code * len(self.words) + self.at[places + k]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        words = [self.words.take(pa.array(self.at[places[first] + k])) for k in range(size)]
        return pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())).cast(pa.string()), n


def added(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts (1 each if there are none)."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    if n is None:
        return keys[edges], np.diff(np.r_[edges, len(keys)])
    return keys[edges], np.add.reduceat(n, edges) if len(edges) else n


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of a batch by language, joined by line ends into steps of some ``STEP`` bytes."""
    held: dict[str, tuple[list[bytes], int]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
        texts, size = held.get(lang, ([], 0))
        texts.append(text)
        held[lang] = (texts, size + len(text))
        if size + len(text) >= STEP:
            yield lang, b"\n".join(held.pop(lang)[0])
    for lang, (texts, _) in held.items():
        yield lang, b"\n".join(texts)


def _count_keys(texts: DataFrame, longest: int, first, now, bits: int) -> DataFrame:
    """key, n of the phrases that a pass counts: all without a filter; with ``now`` the full pass; with ``first`` too (the full pass's filter) the expansion."""

    def wanted(text: Text, filters: list[Filter]) -> Iterator[np.ndarray]:
        """Of each size, the places whose phrases are counted."""
        if len(filters) < 2:
            yield text.real[0]
            for size in range(2, longest + 1):
                has = text.known(size - 1, filters[0]) if filters else text.real[size - 1]
                yield (has[:-1] & has[1:] if filters else has) & text.real[size - 1]
            return
        before, proposed = filters
        yield np.zeros(0, bool)  # the full pass has counted every word
        alive = text.known(1, proposed)
        for size in range(2, longest + 1):
            has = text.known(size - 1, before)
            fresh = alive[:-1] & alive[1:] & text.real[size - 1] & ~(has[:-1] & has[1:])
            yield fresh
            if size < longest:
                alive = fresh | text.known(size, proposed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [Filter(bits, f.value) for f in (first, now) if f is not None]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def let_go() -> Iterator[pa.RecordBatch]:
            keys, n = added(*(np.concatenate(c) for c in zip(*held)))
            for k in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 18)].view(np.int64)), pa.array(n[k : k + (1 << 18)])], ["key", "n"])

        for batch in batches:
            for lang, raw in _steps(batch):
                text = Text(raw, lang, longest)
                for size, mine in enumerate(wanted(text, filters), 1):
                    at = np.flatnonzero(mine)
                    if len(at):
                        held.append(added(text.key(size)[at]))
                if sum(len(k) for k, _ in held) > HOLD:
                    yield from let_go()
                    held = []
        if held:
            yield from let_go()
        give_back_memory()

    return texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _count_phrases(texts: DataFrame, longest: int, chosen, bits: int) -> DataFrame:
    """lang, words, phrase, n of the phrases whose keys the filter has; with 0 words, all words of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = Filter(bits, chosen.value)
        for batch in batches:
            for lang, raw in _steps(batch):
                text = Text(raw, lang, longest)
                found = [(0, pa.array([""]), np.array([text.real[0].sum()], np.int64))]
                for size in range(1, longest + 1):
                    found.append((size, *text.phrases(size, np.flatnonzero(text.known(size, among)))))
                for size, phrases, n in found:
                    for k in range(0, len(n), 1 << 16):
                        some, m = phrases.slice(k, 1 << 16), n[k : k + (1 << 16)]
                        columns = [pa.repeat(pa.scalar(lang), len(m)), pa.array(np.full(len(m), size, np.int32)), some, pa.array(m)]
                        yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "n"])
        give_back_memory()

    return texts.mapInArrow(count, COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def _filter_of(keys: DataFrame, bits: int) -> Filter:
    """The filter of keys: built in tasks by ranges of its cells, so that the driver only lays them end to end."""
    ranges = 64
    if bits < 8 * ranges or bits & (bits - 1):
        raise ValueError(f"filter_bits must be a power of two from {8 * ranges} on")
    size = bits // ranges

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Filter(bits, np.zeros(0, np.uint8))
        for batch in batches:
            at = np.unique(np.concatenate([*probe.places(batch.column("key").to_numpy().view(np.uint64))])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array(at % size)], ["range", "at"])

    def cells(key, table):
        bit = np.zeros(size, np.uint8)
        bit[table.column("at").to_numpy()] = 1
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "cells": [np.packbits(bit, bitorder="little").tobytes()]})

    set_bits = keys.select("key").mapInArrow(places, "range int, at long").distinct()
    out = Filter(bits)
    for r in set_bits.groupBy("range").applyInArrow(cells, "range int, cells binary").collect():  # the filter, whatever the input
        out.cells[r["range"] * size // 8 : (r["range"] + 1) * size // 8] = np.frombuffer(r["cells"], np.uint8)
    return out


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = 3, sample: int = SAMPLE, least: int = LEAST, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n of every phrase of 1 to ``longest`` (at most 7) words that occurs ``support`` times; lang, n of all words)."""
    if not 1 <= longest <= int(_TAG):
        raise ValueError(f"phrases of 1 to {_TAG} words can be counted")
    context = df.sparkSession.sparkContext
    texts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(NONE)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)
    proposed = save(_count_keys(drawn, max(1, longest - 1), None, None, filter_bits).where(F.col("n") >= least).select("key"), "phrases_proposed")

    def full_pass(first, now) -> DataFrame:
        return save(_count_keys(texts, longest, first, now, filter_bits).where(F.col("n") >= support).select("key"), "phrases_counted")

    now = context.broadcast(_filter_of(proposed, filter_bits).cells)
    frequent = full_pass(None, now)
    extendable = F.col("key").bitwiseAND(F.lit(int(_TAG))) < longest
    failed = save(frequent.where(extendable).join(proposed, "key", "left_anti"), "phrases_failed")
    if not failed.isEmpty():
        wider = context.broadcast(_filter_of(proposed.unionByName(failed), filter_bits).cells)
        frequent = frequent.unionByName(full_pass(now, wider))
    chosen = context.broadcast(_filter_of(frequent, filter_bits).cells)
    counts = save(_count_phrases(texts, longest, chosen, filter_bits).where((F.col("n") >= support) | (F.col("words") == 0)), "phrases")
    return counts.where(F.col("words") > 0), counts.where((F.col("words") == 0) & (F.col("n") > 0)).select("lang", "n")


def _with_count(candidates: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """Add ``name``, the count of the phrase in column ``part``. A phrase that is part of more than
    ``SHARE`` candidates is dealt over as many keys on both sides as it has such shares."""
    many = candidates.groupBy("lang", part).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("keys")).where(F.col("keys") > 1)
    many = save(many, "phrases_shared")
    keys = F.coalesce("keys", F.lit(1))
    right = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)).join(many, ["lang", part], "left")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), keys - 1))).drop("keys")
    left = candidates.join(many, ["lang", part], "left").withColumn("salt", F.pmod(F.xxhash64("phrase"), keys).cast("int")).drop("keys")
    return left.join(right, ["lang", part, "salt"]).drop("salt")


def scored(frequent: DataFrame, longest: int = 3, share: int = 50) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer candidate holds in ``share`` hundredths of their places."""
    counts, frequent = frequent, frequent.withColumn("w", F.split("phrase", " "))
    cand = frequent.where(F.col("words") > 1).withColumnRenamed("n", "a")

    def words(start: int, n) -> F.Column:
        return F.array_join(F.slice("w", start, n), " ")

    inner = None
    for size in range(3, longest + 1):
        for part in range(2, size):
            held = cand.where(F.col("words") == size).select(
                "lang", F.col("a").alias("of"), F.explode(F.array_distinct(F.array(*[words(k, part) for k in range(1, size - part + 2)]))).alias("phrase")
            )
            inner = held if inner is None else inner.unionByName(held)
    if inner is not None:
        most = inner.groupBy("lang", "phrase").agg(F.max("of").alias("of"))
        cand = cand.join(most, ["lang", "phrase"], "left").where(F.col("of").isNull() | (100 * F.col("of") < share * F.col("a"))).drop("of")
    cuts = None
    for size in range(2, longest + 1):
        for k in range(1, size):
            one = cand.where(F.col("words") == size).select("lang", "phrase", "a", words(1, k).alias("first"), words(k + 1, size - k).alias("rest"), F.lit(k).alias("k"))
            cuts = one if cuts is None else cuts.unionByName(one)
    cuts = save(cuts, "phrases_cut")
    cuts = _with_count(_with_count(cuts, counts, "first", "l"), counts, "rest", "r")
    number = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r")}
    top = (number["a"] * number["a"]).cast("decimal(31,0)") * F.lit(1000000).cast("decimal(7,0)")
    cuts = cuts.withColumn("top", top).withColumn("low", number["l"] * number["r"]).withColumn("score", F.expr("top div low"))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return cuts.groupBy("lang", "phrase", "a").agg(best.alias("cut")).select("lang", "phrase", "a", "cut.*")


def top_phrases(df: DataFrame, top: int = 2000, longest: int = 3, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` of each language by score, a, phrase."""
    frequent, total = frequent_phrases(df, longest=longest, **options)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = scored(frequent, longest).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(docs: DataFrame) -> DataFrame:
    return top_phrases(docs)


SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents)) WHERE len(words) > 0),
places AS MATERIALIZED (SELECT lang, piece, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM pieces),
chains AS MATERIALIZED (
  SELECT lang, w AS w1, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM places WINDOW p AS (PARTITION BY piece ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, 1 AS size, w1 AS phrase, w1, NULL AS w2, NULL AS w3, count(*) AS n FROM chains GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, w1, w2, NULL, count(*) FROM chains WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3, count(*) FROM chains WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
held AS (SELECT lang, phrase, max(n) AS n FROM (
  SELECT lang, w1 || ' ' || w2 AS phrase, n FROM f WHERE size = 3 UNION ALL SELECT lang, w2 || ' ' || w3, n FROM f WHERE size = 3) GROUP BY ALL),
cuts AS (
  SELECT lang, phrase, n AS a, 1 AS k, w1 AS first, w2 AS rest FROM f WHERE size = 2
  UNION ALL SELECT lang, phrase, n, 1, w1, w2 || ' ' || w3 FROM f WHERE size = 3
  UNION ALL SELECT lang, phrase, n, 2, w1 || ' ' || w2, w3 FROM f WHERE size = 3),
valued AS (
  SELECT c.lang, c.phrase, a, k, x.n AS l, y.n AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
  LEFT JOIN held h ON h.lang = c.lang AND h.phrase = c.phrase WHERE h.n IS NULL OR 100 * h.n < 50 * a),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS c FROM valued) WHERE c = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, t.n, score FROM ranked JOIN (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang) t USING (lang) WHERE rank <= 2000
"""
