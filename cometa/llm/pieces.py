"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by score: in every
step each segment merges its best pair, leftmost on ties, until no pair's
concatenation is a piece. Text is first cut where no piece holds the two
characters on either side of the cut; merges can't cross such a place, so the
segments are independent and equal segments have equal ids. The agenda then runs
over all new segments of an Arrow batch at once, in NumPy, and recent segments
are kept. Symbols outside the vocabulary fall back to byte pieces.

In every batch the sentencepiece library checks the ids of each segment that the
agenda has just made, and decodes the ids of each document for comparison with
the text decoded here. A difference ends the job. Whole texts are compared with
the library in the tests (in a job, that alone takes the library 560 CPU seconds
a GB of Parquet).

Scale: a narrow operator without a shuffle. The model travels as bytes in a
broadcast (half a megabyte), so executors need no local file. A worker keeps one
vocabulary and at most ``KEEP`` segments, works in steps of ``STEP`` bytes, and cuts texts into stretches of at most ``STRETCH``
characters at a time, so a very long text needs memory in proportion to its own
size only.

Defined results: a null text is encoded as the empty text (the begin and end ids
alone); repeated rows give repeated results; an empty table an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece as spm
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cometa.llm.common import give_back_memory, steps

KEEP = 300_000
STEP = 1 << 20
STRETCH = 1 << 20
SPACE = "▁"
NONE = np.int32(2**31 - 1)
codecs.register_error("replace_each", lambda e: ("\ufffd", e.start + 1))


class MergeVocabulary:
    """The tables of a merge-type model: symbols, scored pairs, allowed cuts, ids to bytes."""

    def __init__(self, model: bytes) -> None:
        self.sp = sp = spm.SentencePieceProcessor(model_proto=model)
        if sp.normalize(" Ａ  b ") != f"{SPACE}{SPACE}Ａ{SPACE}{SPACE}b{SPACE}":
            raise ValueError("the model must leave text as it is and add a leading space")
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        piece = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        chars = sorted({c for s in piece for c in s})
        self.symbol = dict(piece)
        for c in chars:  # characters that only occur inside pieces
            self.symbol.setdefault(c, len(self.symbol) + n)
        self.names = {v: k for k, v in self.symbol.items()}
        self.base = max(self.symbol.values()) + 1
        score = {i: sp.get_score(i) for i in piece.values()}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for s, i in piece.items():
            for k in range(1, len(s)):
                if s[:k] in self.symbol and s[k:] in self.symbol:
                    pairs[self.symbol[s[:k]] * self.base + self.symbol[s[k:]]] = (order[score[i]], i)
        self.pair = np.array(sorted(pairs), dtype=np.int64)
        self.rank = np.array([pairs[k][0] for k in self.pair.tolist()], dtype=np.int32)
        self.made = np.array([pairs[k][1] for k in self.pair.tolist()], dtype=np.int32)
        # characters of pieces are numbered from 1; others are 0
        self.number = np.zeros(0x110000, dtype=np.uint16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for s in piece:
            at = self.number[[ord(c) for c in s]]
            self.joined[at[:-1], at[1:]] = True
        self.char_symbol = np.array([0, *(self.symbol[c] for c in chars)], dtype=np.int32)
        bytes_of = [b"" if sp.is_control(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        bytes_of[sp.unk_id()] = " ⁇ ".encode()
        for b, i in self.byte_id.items():
            bytes_of[i] = bytes([b])
        self.blob = np.frombuffer(b"".join(bytes_of), dtype=np.uint8)
        self.length = np.array([len(b) for b in bytes_of], dtype=np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.spaced = np.array([not special[i] and sp.id_to_piece(i)[0] == SPACE for i in range(n)])
        self.size = n
        self.kept: dict[str, bytes] = {}
        self.ends = (np.array([sp.bos_id()], "<u4").tobytes(), np.array([sp.eos_id()], "<u4").tobytes())

    def segments(self, text: str) -> list[str]:
        """The normalized text, cut where no merge can cross."""
        if not text:
            return []
        t, out = SPACE + text.replace(" ", SPACE), []
        start = 0
        for at in range(0, len(t), STRETCH):
            part = t[at : at + STRETCH + 1]
            number = self.number[np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32)]
            cuts = (np.flatnonzero(~self.joined[number[:-1], number[1:]]) + (at + 1)).tolist()
            if cuts:
                out += [t[i:j] for i, j in zip([start, *cuts], cuts)]
                start = cuts[-1]
        out.append(t[start:])
        return out

    def final(self, symbol: int) -> list[int]:
        """The ids of a symbol that no merge has taken."""
        if symbol < self.size:
            return [symbol]
        return [self.byte_id[b] for b in self.names[symbol].encode()]

    def agenda(self, segments: list[str]) -> None:
        """Merge all these segments, each by its best pair at a time, and keep their ids."""
        known, odd = [], []
        for s in segments:
            (known if self.number[ord(s[0])] else odd).append(s)
        for s in odd:  # a cut stands on either side of a character that no piece has
            self.kept[s] = np.array([self.byte_id[b] for b in s.encode()], dtype="<u4").tobytes()
        if not known:
            return
        whole = np.frombuffer("".join(known).encode("utf-32-le"), dtype=np.uint32)
        symbol = self.char_symbol[self.number[whole]]
        segment = np.repeat(np.arange(len(known)), [len(s) for s in known])
        done_symbol, done_segment = [], []
        while len(symbol):
            key = symbol[:-1].astype(np.int64) * self.base + symbol[1:]
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            rank = np.full(len(symbol), NONE, dtype=np.int32)
            rank[:-1] = np.where((self.pair[at] == key) & (segment[:-1] == segment[1:]), self.rank[at], NONE)
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            length = np.diff(np.r_[starts, len(symbol)])
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best != NONE, length)
            done_symbol.append(symbol[~live])
            done_segment.append(segment[~live])
            hits = np.flatnonzero((rank == np.repeat(best, length)) & live)
            first = hits[np.r_[True, segment[hits][1:] != segment[hits][:-1]]] if len(hits) else hits
            symbol = symbol.copy()
            symbol[first] = self.made[at[first]]
            live[first + 1] = False
            symbol, segment = symbol[live], segment[live]
        symbol, segment = np.concatenate(done_symbol), np.concatenate(done_segment)
        order = np.argsort(segment, kind="stable")
        symbol, segment = symbol[order], segment[order]
        edge = np.searchsorted(segment, np.arange(len(known) + 1))
        raw, plain = symbol.astype("<u4").tobytes(), symbol < self.size
        bad = set(segment[~plain].tolist())
        for k, s in enumerate(known):
            if k in bad:
                ids = [i for x in symbol[edge[k] : edge[k + 1]].tolist() for i in self.final(x)]
                self.kept[s] = np.array(ids, dtype="<u4").tobytes()
            else:
                self.kept[s] = raw[4 * edge[k] : 4 * edge[k + 1]]

    def check(self, segments: list[str]) -> None:
        """Compare the ids of segments with the library's. A character of no piece goes before those that don't start with a space."""
        lead = self.sp.encode("\n")
        texts = [s[1:] if s[0] == SPACE else "\n" + s for s in segments]
        for s, text, got in zip(segments, texts, self.sp.encode([t.replace(SPACE, " ") for t in texts], num_threads=1)):
            if s[0] != SPACE:
                got = got[len(lead) :]
            elif not text:  # the library adds no space to an empty text
                got = np.frombuffer(self.kept[s], "<u4").tolist() if s == SPACE else got
            if np.array(got, "<u4").tobytes() != self.kept[s]:
                raise ValueError(f"the agenda and the sentencepiece library differ on {s!r}")

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, begin and end included, as little-endian unsigned 32-bit integers."""
        cut = [self.segments(t) for t in texts]
        if len(self.kept) > KEEP:
            self.kept.clear()
        new = list(set().union(*cut) - self.kept.keys())
        self.agenda(new)
        self.check(new)
        begin, end = self.ends
        get = self.kept.__getitem__
        return [b"".join([begin, *map(get, one), end]) for one in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids: spaces restored, byte pieces joined, the space of a first piece dropped, bytes that are no UTF-8 replaced one by one."""
        ids = np.frombuffer(ids, "<u4")
        length = self.length[ids]
        upto = np.cumsum(length)
        total = int(upto[-1]) if len(ids) else 0
        raw = self.blob[np.repeat(self.offset[ids] - (upto - length), length) + np.arange(total)].tobytes()
        said = ids[length > 0][:1]
        return (raw[1:] if len(said) and self.spaced[said[0]] else raw).decode("utf-8", "replace_each")


def load(spark, path: str):
    """A broadcast of the model's bytes, read on the driver. A worker keeps the vocabulary that it makes from them beside them."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast({"model": f.read()})


def encode_documents(df: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", give_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``give_ids``, ids (array of int) of each document."""
    model = load(df.sparkSession, model_path)
    narrow = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "vocabulary" not in model.value:
            model.value["vocabulary"] = MergeVocabulary(model.value["model"])
        for batch in batches:
            for some in steps(batch, STEP):
                yield one(model.value["vocabulary"], some)
        give_back_memory()

    def one(v: MergeVocabulary, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        ids = v.encode(texts)
        lists = [np.frombuffer(x, "<u4").tolist() for x in ids]
        decoded = [v.decode(x) for x in ids]
        if v.sp.decode(lists) != decoded:
            raise ValueError("the decoded texts and the sentencepiece library's differ")
        count = np.array([len(x) for x in lists], np.int64)
        columns = [
            batch.column("doc_id"),
            pa.array(count),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if give_ids:
            edges = np.r_[0, np.cumsum(count)].astype(np.int32)  # a step's ids are far fewer than 2^31
            columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    return narrow.mapInArrow(encoded, out + (", ids array<int>" if give_ids else ""))


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), give_ids=False)
