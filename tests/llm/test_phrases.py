"""Phrase mining: exact counts and lists whatever the sample and the filter."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cometa.llm import phrase_mining as pm
from tests.conftest import SF001


def pieces_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counts(rows, longest):
    f, n = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        mine = f.setdefault(lang, Counter())
        for w in pieces_of(text):
            n[lang] = n.get(lang, 0) + len(w)
            mine.update(" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, top=2000, longest=3, support=10, share=50):
    f, n = counts(rows, longest)
    out = []
    for lang, mine in f.items():
        cand = {p: a for p, a in mine.items() if a >= support and " " in p}
        gone = set()
        for p, a in cand.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    q = " ".join(w[i : i + k])
                    if 100 * a >= share * cand[q]:
                        gone.add(q)
        best = []
        for p, a in cand.items():
            if p not in gone:
                w = p.split(" ")
                cuts = [(mine[" ".join(w[:k])], mine[" ".join(w[k:])]) for k in range(1, len(w))]
                score, _, l, r = min((1000000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
                best.append((-score, -a, p.encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return out


def corpus():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["É", "é", "NEW", "York", "a\x00b", "漢字", "x'y"]
    rows = []
    for k in range(300):
        text = " ".join(rng.choice(words[: 8 + k % 60]) + rng.choice(["", "", "", ",", ".", "\n", "!", " \t "]) for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "en", "fr", None, "und", ""]), text + " New York City, new york state." * (k % 3 == 0)))
    rows += [("en", "a a a a a a a a a a a a a"), ("de", "b b"), ("de", None), (None, ""), (None, None), ("en", "x" * 50_000), ("en", "p q " * 30_000)]
    return rows


def listed(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def corpus_rows():
    return corpus()


def table(spark, rows):
    return spark.createDataFrame([(t, l, 1, "x", "y") for l, t in rows], "text string, lang string, n int, phrase string, words string").repartition(5)


@pytest.mark.parametrize(
    "options",
    [{}, {"sample": 10**9}, {"sample": 1, "least": 1}, {"filter_bits": 512}, {"sample": 50, "least": 1, "filter_bits": 1 << 20}],
    ids=["as in the query", "empty sample", "all as sample", "a full filter", "small sample"],
)
def test_equal_brute_force_whatever_the_sample(spark, corpus_rows, options, monkeypatch):
    monkeypatch.setattr(pm, "STEP", 3000)
    assert listed(pm.top_phrases(table(spark, corpus_rows), **{"filter_bits": 1 << 20} | options)) == sorted(brute(corpus_rows))


def test_longer_phrases_other_limits(spark, corpus_rows):
    got = listed(pm.top_phrases(table(spark, corpus_rows), top=7, longest=4, support=6, filter_bits=1 << 20))
    assert got == sorted(brute(corpus_rows, top=7, longest=4, support=6))


def test_border_failures_are_closed_by_one_expansion(spark, monkeypatch):
    """With an empty sample nothing is proposed: the words fail, and the expansion counts all that they can make."""
    rows = [("en", "new york city")] * 12 + [("en", "rare words here")] * 3
    filters, passes = [], []
    real, count = pm._filter_of, pm._count_keys
    monkeypatch.setattr(pm, "_filter_of", lambda keys, bits: filters.append(keys.count()) or real(keys, bits))
    monkeypatch.setattr(pm, "_count_keys", lambda *a: passes.append(1) or count(*a))
    frequent, total = pm.frequent_phrases(table(spark, rows), sample=10**9, filter_bits=1 << 20)
    assert {r.phrase: r.n for r in frequent.collect()} == {p: 12 for p in ("new", "york", "city", "new york", "york city", "new york city")}
    assert filters == [0, 3, 6] and len(passes) == 3 and total.first().n == 45
    filters.clear(), passes.clear()
    pm.frequent_phrases(table(spark, rows), sample=1, least=1, filter_bits=1 << 20)  # all proposed: no failure, no expansion
    assert len(filters) == 2 and len(passes) == 2


def test_parts_that_many_candidates_share_are_dealt_over_keys(spark, corpus_rows, monkeypatch):
    monkeypatch.setattr(pm, "SHARE", 3)
    assert listed(pm.top_phrases(table(spark, corpus_rows), filter_bits=1 << 20)) == sorted(brute(corpus_rows))


def test_query_on_documents(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    assert listed(pm.query(d)) == sorted(brute([(r.lang, r.text) for r in d.collect()]))


def test_query_edges(docs, given, none, odd):
    assert listed(pm.query(docs)) == sorted(brute([(r.lang, r.text) for r in given]))
    assert pm.query(none).collect() == [] and pm.query(odd).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_000, 3_000_000_007, 3_000_000_019
    rows = [("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a), ("en", 1, "u", a), ("en", 1, "v", a), ("en", 2, "u v", a)]
    got = {x.phrase: x.score for x in pm.scored(spark.createDataFrame(rows, pm.COUNTS)).collect()}
    assert got == {"x y": 1000000 * a * a // (l * r), "u v": 1000000}


def test_filter_has_what_was_added():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    f = pm.Filter(1 << 17)
    f.add(keys[:2500])
    assert f.has(keys[:2500]).all() and f.has(keys[2500:]).mean() < 0.05


def test_phrases_of_a_text_equal_plain_counts():
    raw = " ".join(t or "" for _, t in corpus())
    f, _ = counts([("en", raw)], 3)
    text, got = pm.Text(raw.encode(), "en", 3), {}
    for size in (1, 2, 3):
        places = np.flatnonzero(text.real[size - 1])
        phrases, n = text.phrases(size, places)
        assert phrases.type == pa.string()
        got.update(zip(phrases.to_pylist(), n.tolist()))
        keys, m = pm.added(text.key(size)[places])
        assert sorted(m.tolist()) == sorted(n.tolist()) and (keys & np.uint64(7) == size).all()
    assert got == dict(f["en"])


def test_added_sums_counts():
    keys = np.array([5, 3, 5, 9, 3, 5], np.uint64)
    assert [x.tolist() for x in pm.added(keys)] == [[3, 5, 9], [2, 3, 1]]
    assert [x.tolist() for x in pm.added(keys, np.array([1, 2, 3, 4, 5, 6]))] == [[3, 5, 9], [7, 10, 4]]
    assert [x.tolist() for x in pm.added(keys[:0])] == [[], []]


def test_keys_that_clash_only_cost_time(spark, corpus_rows, monkeypatch):
    """With keys cut to a few bits very many phrases share one; the counts as text stay exact."""
    real = pm._mix
    monkeypatch.setattr(pm, "_mix", lambda a, b: real(a, b) & np.uint64(0xFFF))
    assert listed(pm.top_phrases(table(spark, corpus_rows), filter_bits=1 << 20)) == sorted(brute(corpus_rows))
