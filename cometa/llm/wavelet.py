"""Token ids in wavelet matrices: one compressed file per shard, read without unpacking it.

Documents are put in ascending doc_id order by one exchange, encoded where they
land, and written as shards of about ``SHARD_TOKENS`` ids. A shard's file holds a
wavelet matrix: one bit-plane per bit of an id, from the highest, each stably
parted by the plane before it. A plane is cut into blocks of ``BLOCK`` bits, each
compressed alone, and a directory holds for each block its place in the file and
the number of ones before it. With these ``WaveletFile`` answers, reading only the
blocks that it needs: the id at a position (``access``), how often an id occurs
before a position (``rank``) or between two (``count``), where its k-th occurrence
is (``select``), where all are (``occurrences``), and the ids of one document.
Whole shards are unpacked plane by plane (``tokens``).

Text is encoded by the tokenizers library. Where a vocabulary drops white space
(which is probed when it is loaded), the ids of a text are those of its stretches
between ASCII white space, one after the other: the library encodes each distinct
stretch of a batch, and ``KEEP`` or a batch's more are kept; else it encodes whole texts.

Scale: one shuffle of texts, no table of ids in between. A task holds one shard's
ids, one Arrow batch (worked through in steps of ``STEP`` bytes) and the kept stretches. Files are written under a name of the
attempt and then moved to a name that depends on place alone, so that an attempt
that is run again replaces equal content. Only the manifest (a row a file) is
ordered as a whole, to find the first position of each file.

Defined results: a null text is empty (the end id alone); null doc_ids come first;
rows of equal doc_id are ordered by a hash of their text, then by the text; an
empty table gives no file and an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import random
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cometa.llm.common import give_back_memory, save, steps
from cometa.session import shared_path

SHARD_TOKENS = 1 << 22
BLOCK = 1 << 16
KEEP = 1_500_000
CHECKED = 64
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"  # ASCII marks that open neither a contraction nor a special token
WORD_AND_MARKS = re.compile(f"([A-Za-z]+)([{re.escape(MARKS)}]*)").fullmatch
STEP = 1 << 22
GROUP = 64
SENTINEL = " \x00 "  # a word of its own; stretches that hold the character are encoded alone
MAGIC = b"CWM1"
MANIFEST = "path string, first_doc long, first_hash long, n_docs long, n_tokens long"


class Encoder:
    """The ids of texts, end to end, in arrays of the least width that holds them."""

    def __init__(self, definition: bytes, keep: int = KEEP) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks use the cores
        self.tok = Tokenizer.from_buffer(definition)
        self.levels = max(1, (self.tok.get_vocab_size() - 1).bit_length())
        self.dtype = np.dtype("<u2" if self.levels <= 16 else "<u4")
        self.parts = self._drops_space()
        self.keep, self.marks, self.model = keep, {}, self.tok.model
        self.direct = self._model_takes_words()
        self._forget()

    def _forget(self) -> None:
        """Start with no stretches: ``at`` gives the place of each in ``pool`` (its ids) and ``ends``."""
        self.at: dict[str, int] = {}
        self.pool, self.ends = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _drops_space(self) -> bool:
        """Whether white space leaves no id and joins nothing, on probes of several scripts."""
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        probes = ["a", "Ab1", "'s", "!?", "\u0301x", "\u00e9", "\u6f22", "\u03a3", "\U0001f600", "9", SENTINEL[1], *special[:4]]

        def ids(text: str) -> list[int]:
            return self.tok.encode(text, add_special_tokens=False).ids

        self.sentinel = np.array(ids(SENTINEL[1]), self.dtype)
        if len(self.sentinel) != 1 or any(ids(s) for s in (" ", "\t\n", " \x0b\x0c\r ")):
            return False
        return all(ids(a + s + b) == ids(a) + ids(b) for a in probes for b in probes for s in (" ", "\n", "\t "))

    def _library(self, texts: list[str]) -> None:
        """Add the ids of texts to the pool."""
        lists = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        self._add(np.fromiter(chain.from_iterable(lists), self.dtype), np.fromiter(map(len, lists), np.int64, len(lists)))

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.pool = np.concatenate([self.pool, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def _together(self, stretches: list[str]) -> None:
        """The same for stretches, some ``GROUP`` in a text with the sentinel between any two."""
        groups = [stretches[k : k + GROUP] for k in range(0, len(stretches), GROUP)]
        found = self.tok.encode_batch_fast([SENTINEL.join(g) for g in groups], add_special_tokens=False)
        ids = np.concatenate([x for e in found for x in (np.array(e.ids, self.dtype), self.sentinel)])
        cuts = np.flatnonzero(ids == self.sentinel[0])
        if len(cuts) != len(stretches):
            raise ValueError("the tokenizer does not keep the sentinel apart")
        self._add(ids[np.flatnonzero(ids != self.sentinel[0])], np.diff(np.r_[-1, cuts]) - 1)

    def _model_takes_words(self) -> bool:
        """Whether the library's model, given ASCII words in lower case and runs of marks, gives the ids of the whole tokenizer, on a few thousand probes."""
        rng = random.Random(1)
        words = ["".join(rng.choices(string.ascii_letters, k=rng.randrange(1, 14))) + "".join(rng.choices(MARKS, k=rng.randrange(0, 5))) for _ in range(3000)]
        return self.parts and all(self._of_model(*WORD_AND_MARKS(w).groups()) == e.ids for w, e in zip(words, self.tok.encode_batch_fast(words, add_special_tokens=False)))

    def _of_model(self, word: str, marks: str) -> list[int]:
        ids = [t.id for t in self.model.tokenize(word.lower())]
        if marks:
            if marks not in self.marks:
                self.marks[marks] = self.tok.encode(marks, add_special_tokens=False).ids
            ids += self.marks[marks]
        return ids

    def _words(self, found: list[re.Match]) -> None:
        """Add the ids of stretches that are a word and marks after it; the library's whole path checks one in ``CHECKED``."""
        lists = [self._of_model(*m.groups()) for m in found]
        checked = [m[0] for m in found[::CHECKED]]
        if lists[::CHECKED] != [e.ids for e in self.tok.encode_batch_fast(checked, add_special_tokens=False)]:
            raise ValueError("the tokenizer's model and its whole path differ")
        self._add(np.fromiter(chain.from_iterable(lists), self.dtype), np.fromiter(map(len, lists), np.int64, len(lists)))

    def _stretches(self, stretches: list[str]) -> np.ndarray:
        """The places of distinct stretches in the pool, which is emptied once it holds more than ``keep``."""
        if len(self.at) > self.keep:
            self._forget()
        places = list(map(self.at.get, stretches))
        missing = [k for k, place in enumerate(places) if place is None]
        matched = [WORD_AND_MARKS(stretches[k]) for k in missing] if self.direct else [None] * len(missing)
        new, found = [k for k, m in zip(missing, matched) if m], [m for m in matched if m]
        other = [k for k, m in zip(missing, matched) if not m]
        plain, odd = [k for k in other if SENTINEL[1] not in stretches[k]], [k for k in other if SENTINEL[1] in stretches[k]]
        if found:
            self._words(found)
        for at in range(0, len(plain), 1 << 14):
            self._together([stretches[k] for k in plain[at : at + (1 << 14)]])
        if odd:
            self._library([stretches[k] for k in odd])
        for place, k in enumerate([*new, *plain, *odd], len(self.at)):
            places[k] = self.at[stretches[k]] = place
        return np.array(places, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if self.parts:
            cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
            edges = cut.offsets.to_numpy()
            words = cut.values.slice(int(edges[0]), int(edges[-1] - edges[0])).dictionary_encode()
            which = self._stretches(words.dictionary.to_pylist())[words.indices.to_numpy()]
        else:
            self._forget()
            self._library(texts.to_pylist())
            edges = np.arange(len(texts) + 1)
            which = edges[:-1]
        length = self.ends[which + 1] - self.ends[which]
        upto = np.r_[0, np.cumsum(length)]
        # a step has far fewer ids than 2^31
        place = np.repeat((self.ends[which] - upto[:-1]).astype(np.int32), length)
        place += np.arange(len(place), dtype=np.int32)
        return self.pool[place], np.diff(upto[edges - edges[0]])


def pack(ids: np.ndarray, levels: int, doc_ids: np.ndarray, no_id: np.ndarray, starts: np.ndarray) -> bytes:
    """The file of one shard: planes, documents, directory, header, and the header's place at the end."""
    press = zstandard.ZstdCompressor(level=1)
    body, places, ones, zeros, at = [MAGIC], [], [], [], len(MAGIC)

    def add(raw: bytes) -> None:
        nonlocal at
        body.append(raw)
        places.append(at)
        at += len(raw)

    for level in range(levels - 1, -1, -1):
        before, parted = 0, ([], [])
        for k in range(0, len(ids), BLOCK):  # block by block, in the processor's cache
            some = ids[k : k + BLOCK]
            bit = (some & some.dtype.type(1 << level)) != 0
            ones.append(before)
            for side, mine in zip(parted, (~bit, bit)):
                side.append(some[np.flatnonzero(mine)])
            before += len(parted[1][-1])
            add(press.compress(np.packbits(bit, bitorder="little").tobytes()))
        zeros.append(len(ids) - before)
        ids = np.concatenate([*parted[0], *parted[1], ids[:0]])
    docs = at
    add(press.compress(doc_ids.astype("<i8").tobytes() + starts.astype("<i8").tobytes() + np.packbits(no_id).tobytes()))
    directory = at
    add(press.compress(np.array([places, ones + [0]], "<i8").tobytes()))
    header = {"n": len(ids), "levels": levels, "block": BLOCK, "zeros": zeros, "n_docs": len(doc_ids), "docs": docs, "directory": directory}
    raw = json.dumps(header).encode()
    return b"".join([*body, raw, struct.pack("<qi", at, len(raw))])


class WaveletFile:
    """One shard, read block by block. ``read(offset, length)`` gives bytes of the file, ``size`` long."""

    def __init__(self, read, size: int) -> None:
        self.read = read
        at, length = struct.unpack("<qi", read(size - 12, 12))
        head = json.loads(read(at, length))
        if read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.n, self.levels, self.block, self.zeros, self.n_docs = (head[k] for k in ("n", "levels", "block", "zeros", "n_docs"))
        self.unpress = zstandard.ZstdDecompressor()
        self.per_level = -(-self.n // self.block)
        table = np.frombuffer(self.unpress.decompress(read(head["directory"], at - head["directory"])), "<i8").reshape(2, -1)
        self.places = np.r_[table[0], head["directory"]]
        self.ones = table[1][:-1].reshape(self.levels, self.per_level)
        raw = self.unpress.decompress(read(head["docs"], head["directory"] - head["docs"]))
        self.doc_ids, self.starts = np.frombuffer(raw[: 16 * self.n_docs], "<i8").reshape(2, -1)
        self.no_id = np.unpackbits(np.frombuffer(raw[16 * self.n_docs :], np.uint8))[: self.n_docs].astype(bool)
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    def _unpacked(self, level: int, block: int, raw: bytes) -> np.ndarray:
        size = min(self.block, self.n - block * self.block)
        return np.unpackbits(np.frombuffer(self.unpress.decompress(raw), np.uint8), count=size, bitorder="little")

    def _bits(self, level: int, block: int) -> np.ndarray:
        """The bits of one block of a plane (0 is the highest); the last few are kept."""
        if (level, block) not in self.kept:
            k = level * self.per_level + block
            raw = self.read(int(self.places[k]), int(self.places[k + 1] - self.places[k]))
            self.kept = dict([*self.kept.items()][-(2 * self.levels) :])
            self.kept[level, block] = self._unpacked(level, block, raw)
        return self.kept[level, block]

    def _ones(self, level: int, i: int) -> int:
        """The number of ones of a plane before position ``i``."""
        if i >= self.n:
            return self.n - self.zeros[level]
        block, rest = divmod(i, self.block)
        return int(self.ones[level, block]) + (int(np.count_nonzero(self._bits(level, block)[:rest])) if rest else 0)

    def _find(self, level: int, value: int, k: np.ndarray) -> np.ndarray:
        """The positions of the ``k``-th (sorted, from 0) bits of a plane that equal ``value``."""
        before = self.ones[level] if value else np.arange(self.per_level) * self.block - self.ones[level]
        block = np.searchsorted(before, k, side="right") - 1
        out = np.empty(len(k), dtype=np.int64)
        for b in np.unique(block):
            mine = block == b
            out[mine] = np.flatnonzero(self._bits(level, int(b)) == value)[k[mine] - before[b]] + b * self.block
        return out

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.levels):
            block, rest = divmod(i, self.block)
            bit, ones = int(self._bits(level, block)[rest]), self._ones(level, i)
            out = 2 * out + bit
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of an id between two positions stand below the last plane."""
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._span(token, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The positions of an id between two positions, ascending."""
        a, b = self._span(token, lo, self.n if hi is None else hi)
        return self._up(token, np.arange(a, b, dtype=np.int64))

    def _up(self, token: int, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels - 1, -1, -1):
            if not len(at):
                break
            bit = token >> (self.levels - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def select(self, token: int, k: int) -> int:
        """The position of the ``k``-th occurrence (from 0) of an id."""
        a, b = self._span(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        return int(self._up(token, np.array([a + k]))[0])

    def tokens(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        dtype = np.dtype("<u2" if self.levels <= 16 else "<u4")
        ids = np.zeros(self.n, dtype)
        for level in range(self.levels - 1, -1, -1) if self.n else ():
            at = self.places[level * self.per_level : (level + 1) * self.per_level + 1]
            plane, up = memoryview(self.read(int(at[0]), int(at[-1] - at[0]))), np.empty_like(ids)
            for b, one in enumerate(self.ones[level].tolist()):
                bit = self._unpacked(level, b, plane[at[b] - at[0] : at[b + 1] - at[0]]).view(bool)
                some, low, high = up[b * self.block :][: len(bit)], b * self.block - one, self.zeros[level] + one
                zero_at, one_at = np.flatnonzero(~bit), np.flatnonzero(bit)
                some[zero_at] = ids[low : low + len(zero_at)]
                some[one_at] = ids[high : high + len(one_at)] | dtype.type(1 << (self.levels - 1 - level))
            ids = up
        return ids

    def document(self, k: int) -> np.ndarray:
        """The ids of the ``k``-th document of the shard."""
        end = int(self.starts[k + 1]) if k + 1 < self.n_docs else self.n
        return np.array([self.access(i) for i in range(int(self.starts[k]), end)], np.uint32)


def open_file(path: str) -> WaveletFile:
    fs, at = pafs.FileSystem.from_uri(path)
    f = fs.open_input_file(at)
    return WaveletFile(lambda offset, length: f.read_at(length, offset), f.size())


def _put(path: str, content: bytes) -> None:
    """Write a file under a name of this attempt, then move it to its own."""
    fs, at = pafs.FileSystem.from_uri(path)
    folder, name = at.rsplit("/", 1)
    tried = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(tried) as f:
        f.write(content)
    fs.move(tried, at)


def write_shards(df: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the ids of all documents to wavelet files in ``folder``; the manifest: a row a file, and ``start``, the ids before it."""
    spark = df.sparkSession
    with open(tokenizer_path, "rb") as f:
        # one and a half megabytes, whatever the input; a worker keeps the encoder that it has made beside them
        shared = spark.sparkContext.broadcast({"definition": f.read()})
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "encoder" not in shared.value:
            shared.value["encoder"] = Encoder(shared.value["definition"])
        encoder, part, files = shared.value["encoder"], TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder.dtype)
        held: list[np.ndarray] = []
        keys: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal files, held, keys, size
            lengths = np.array([len(x) for x in held], np.int64)
            path = f"{folder}/{part:06d}-{files:06d}.wm"
            no_id = np.array([k is None for k, _ in keys])
            first = np.cumsum(lengths) - lengths
            _put(path, pack(np.concatenate(held), encoder.levels, np.array([k or 0 for k, _ in keys], np.int64), no_id, first))
            row = [path, *keys[0], len(keys), size]
            files, held, keys, size = files + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.string()] + [pa.int64()] * 4)], ["path", "first_doc", "first_hash", "n_docs", "n_tokens"])

        for some in chain.from_iterable(steps(batch, STEP) for batch in batches):
            ids, counts = encoder.encode(some.column("text"))
            upto = np.cumsum(counts).tolist()
            for key, h, a, b in zip(some.column("doc_id").to_pylist(), some.column("hash").to_pylist(), [0, *upto], upto):
                if held and size + b - a + 1 > shard_tokens:
                    yield flush()
                held.append(np.concatenate([ids[a:b], end]))
                keys.append((key, h))
                size += b - a + 1
        if held:
            yield flush()
        give_back_memory()

    ordered = narrow.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    manifest = save(ordered.mapInArrow(write, MANIFEST), "token_manifest")
    before = W.orderBy("first_doc", "first_hash", "path").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _over_files(manifest: DataFrame, rows_of, schema: str) -> DataFrame:
    """Apply ``rows_of(file, start)`` (a dict of columns) to every file, files dealt evenly to tasks."""
    spark = manifest.sparkSession
    files = manifest.count()
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                got = rows_of(open_file(path), start)
                yield pa.RecordBatch.from_arrays([pa.array(got[c]) for c in names], names)

    tasks = max(1, min(files, 64 * spark.sparkContext.defaultParallelism))
    return manifest.select("path", "start").repartitionByRange(tasks, "start", "path").mapInArrow(read, schema)


def _ids(file: WaveletFile, at: np.ndarray | slice = slice(None)) -> pa.Array:
    return pa.array(file.doc_ids[at], pa.int64(), mask=file.no_id[at])


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def rows(file: WaveletFile, start: int) -> dict:
        raw = memoryview(file.tokens().astype("<u4").tobytes())
        edges = [*file.starts.tolist(), file.n]
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges, edges[1:])]
        return {"doc_id": _ids(file), "start": file.starts + start, "n_tokens": np.diff(edges), "ids_crc32": np.array(crc, np.int64)}

    return _over_files(manifest, rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def find_tokens(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """token, doc_id and position (in its document and over all) of each occurrence of the given ids."""

    def rows(file: WaveletFile, start: int) -> dict:
        found = [file.occurrences(t) for t in tokens]
        at = np.concatenate([*found, np.zeros(0, np.int64)])
        doc = np.searchsorted(file.starts, at, side="right") - 1
        token = np.repeat(np.array(tokens, np.int64), [len(x) for x in found])
        return {"token": token, "doc_id": _ids(file, doc), "position": at - file.starts[doc], "global_position": at + start}

    return _over_files(manifest, rows, "token long, doc_id long, position long, global_position long")


def count_tokens(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: how often each given id occurs in all files, from rank alone."""

    def rows(file: WaveletFile, start: int) -> dict:
        return {"token": np.array(tokens, np.int64), "n": np.array([file.count(t) for t in tokens], np.int64)}

    return _over_files(manifest, rows, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def new_folder(spark: SparkSession) -> str:
    return shared_path(spark, f"tokens_{uuid.uuid4().hex}")


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return read_documents(write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), new_folder(docs.sparkSession)))
