"""Token ids in wavelet files: the library's ids, and every look-up against plain arrays."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cometa.llm import wavelet
from cometa.llm.wavelet import Encoder, WaveletFile, pack
from tests.conftest import SF001

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "ΑΣ ΑΣ\x1cb", "<|endoftext|> a<|startoftext|>b <|end oftext|>", "é ́x ̈ y", "it's 're ab'S\xa0x\x85y z", "İstanbul ẞ",
       "\x00 \x0b\x0c\x1f\x1e a", "a\x00b \x00", "\x00", "한국 각", "a 'll'd", "😀漢字 がぎ 1234 !!??", "Ｆｕｌｌ　width"]


def definition(name="word_bpe_49k.json"):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def brute(rows):
    """The query's rows by the library on whole texts, in the operator's order of equal doc_ids (any order of these gives the same multiset of crc32)."""
    tok = Tokenizer.from_file(WORDS)
    return [tok.encode(r.text or "", add_special_tokens=False).ids + [2] for r in rows]


@pytest.mark.parametrize("keep", [0, 5, 10**6])
def test_encoder_equals_library(given, keep):
    texts = [r.text or "" for r in given] + ODD
    e = Encoder(definition(), keep)
    assert e.parts
    want = [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        ids, counts = e.encode(pa.array(texts))
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
    sliced = e.encode(pa.array(texts).slice(7, 9))
    assert sliced[0].tolist() == [i for x in want[7:16] for i in x]
    assert len(e.encode(pa.array([], pa.string()))[0]) == 0


def test_encoder_of_whole_texts_where_space_counts(given):
    e = Encoder(definition("byte_bpe_50k.json"))
    assert not e.parts
    texts = [r.text or "" for r in given] + ODD
    ids, counts = e.encode(pa.array(texts))
    want = [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]


@pytest.mark.parametrize("n, levels", [(0, 16), (1, 3), (1000, 16), (5000, 17)])
def test_look_ups_equal_plain_arrays(monkeypatch, n, levels):
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    rng = np.random.default_rng(n)
    dtype = "<u2" if levels <= 16 else "<u4"
    ids = np.minimum(rng.geometric(0.02, n) * (1 << levels) // 300, (1 << levels) - 1).astype(dtype)
    starts = np.array([0, 0, n // 3])
    raw = pack(ids, levels, np.array([4, 0, 9]), np.array([False, True, False]), starts)
    f = WaveletFile(lambda at, length: raw[at : at + length], len(raw))
    assert f.tokens().tolist() == ids.tolist()
    assert [f.access(i) for i in range(0, n, 17)] == ids[::17].tolist()
    assert f.document(2).tolist() == ids[n // 3 :].tolist()
    assert f.no_id.tolist() == [False, True, False] and f.doc_ids.tolist() == [4, 0, 9]
    for t in [*np.unique(ids)[:6].tolist(), (1 << levels) - 2, 1 << levels]:
        at = np.flatnonzero(ids == t)
        assert f.occurrences(t).tolist() == at.tolist()
        assert f.occurrences(t, n // 4, n // 2).tolist() == at[(at >= n // 4) & (at < n // 2)].tolist()
        assert f.count(t) == len(at) and f.rank(t, n // 2) == (at < n // 2).sum()
        assert [f.select(t, k) for k in range(0, len(at), 5)] == at[::5].tolist()
        with pytest.raises(IndexError):
            f.select(t, len(at))
    with pytest.raises(IndexError):
        f.access(n)


def test_query_equals_library(docs, given, none, odd):
    got = wavelet.query(docs).collect()
    ids = brute(given)
    want = sorted(((r.doc_id is not None, r.doc_id or 0), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(given, ids))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.ids_crc32) for r in got) == want
    upto = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == upto
        upto += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert wavelet.query(none).collect() == []
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in wavelet.query(odd).collect()) == [(None, 0, 1), (None, 1, 1), (None, 2, 1)]


def test_files_of_many_shards_find_tokens(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = sorted(d.collect(), key=lambda r: r.doc_id)
    ids = brute(rows)
    flat = np.array([i for x in ids for i in x])
    manifest = wavelet.write_shards(d, WORDS, wavelet.new_folder(spark), shard_tokens=20_000)
    assert manifest.count() >= len(flat) // 20_000
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in wavelet.read_documents(manifest).collect()}
    starts = np.cumsum([0] + [len(x) for x in ids])
    assert got == {r.doc_id: (int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, s, x in zip(rows, starts, ids)}
    tokens = [2, int(flat[100]), int(flat[5000]), 49405]
    found = wavelet.find_tokens(manifest, tokens).collect()
    assert sorted((r.token, r.global_position) for r in found) == sorted((t, int(i)) for t in set(tokens) for i in np.flatnonzero(flat == t))
    place = {r.doc_id: int(s) for r, s in zip(rows, starts)}
    assert all(place[r.doc_id] + r.position == r.global_position for r in found)
    assert {r.token: r.n for r in wavelet.count_tokens(manifest, tokens).collect()} == {t: int((flat == t).sum()) for t in tokens}
