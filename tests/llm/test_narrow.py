"""Operators that handle each document alone: pieces, secrets, quality counts, toxicity."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as e
from cometa.llm import pieces, quality, secrets, toxicity
from tests.conftest import SF001

MODEL = __import__("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    with open(MODEL, "rb") as f:
        return pieces.MergeVocabulary(f.read())


ODD_TEXTS = ["", " ", "  a  b ", "\tx\n\ny", "ﬁ é é A", "a▁b", "x\x00y", "<s></s><unk>", "<0x41>", "😀漢字仮名 がぎぐ🧑‍🚀", "   " * 5 + "a" + " " * 17, "\r\n　\xa0", "▁▁▁", "Straße Ünïcödé", "def f():\n        return 1"]


def test_pieces_equal_library(vocabulary, given, spark):
    known = [r.text or "" for r in given] + ODD_TEXTS
    known += [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    ids = [np.frombuffer(x, "<u4").tolist() for x in vocabulary.encode(known)]
    want = vocabulary.sp.encode(known, add_bos=True, add_eos=True)
    assert ids == want
    assert [vocabulary.decode(np.array(x, "<u4").tobytes()) for x in want] == vocabulary.sp.decode(want)


@pytest.mark.parametrize("ids", [[5, 200, 255, 300], [0], [1, 2], [28705, 300], [200, 201, 202, 264], [259, 264], [231, 160, 264], [300, 0, 300], []])
def test_pieces_decode_any_ids(vocabulary, ids):
    assert vocabulary.decode(np.array(ids, "<u4").tobytes()) == vocabulary.sp.decode(ids)


def test_pieces_long_text_in_stretches(vocabulary, monkeypatch, given):
    text = " ".join(r.text or "" for r in given)
    whole = vocabulary.encode([text])
    monkeypatch.setattr(pieces, "STRETCH", 7)
    assert vocabulary.encode([text]) == whole


def test_pieces_keep_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "KEEP", 3)
    vocabulary.encode(["one two three four five"])
    vocabulary.encode(["six"])
    assert len(vocabulary.kept) < 5


def test_pieces_query(docs, given, vocabulary, none, odd):
    got = sorted(map(tuple, pieces.query(docs).collect()), key=str)
    want = []
    for r in given:
        ids = vocabulary.sp.encode(r.text or "", add_bos=True, add_eos=True)
        raw, text = np.array(ids, "<u4").tobytes(), vocabulary.sp.decode(ids)
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert pieces.query(none).collect() == []
    assert [r.n_tokens for r in pieces.query(odd).collect()] == [2, 2, 2]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    more, w = [], secrets.WINDOW
    for kind, (run, _, must, least) in secrets.CLASSES.items():
        for m in re.finditer(run, text):
            c = m[0].lower() if kind == "entropy_hex" else m[0]
            if not all(re.search(p, m[0]) for p in must) or any(re.search(p, m[0]) for p in secrets.ALLOW):
                continue
            bits = [-sum(v / w * math.log2(v / w) for v in Counter(c[i : i + w]).values()) for i in range(len(c) - w + 1)]
            hot = [i for i, h in enumerate(bits) if h >= least - 1e-9]
            if hot:
                span = (m.start() + hot[0], secrets.KINDS.index(kind), m.start() + hot[-1] + w)
                if not any(a <= span[0] and b >= span[2] for a, _, b in base):
                    more.append(span)
    return sorted(base), sorted(base + more)


def joined(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_secrets_equal_brute_force(docs, given, none, odd):
    got = sorted(map(tuple, secrets.query(docs).collect()), key=str)
    want = []
    for r in given:
        base, spans = brute_spans(r.text or "")
        want.append((r.doc_id, *(sum(k == j for _, k, _ in base) for j in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
    assert got == sorted(want, key=str)
    assert sum("entropy" in x[-1] for x in want) >= 2
    assert secrets.query(none).collect() == []
    assert [r.spans for r in secrets.query(odd).collect()] == ["", "", ""]


def test_secrets_equal_brute_force_on_documents(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    got = {r.doc_id: r.spans for r in secrets.query(d).collect()}
    assert got == {r.doc_id: joined(brute_spans(r.text)[1]) for r in d.collect()}


def test_secrets_allow_list(spark):
    d = spark.createDataFrame([(1, "id 123e4567-e89b-12d3-a456-426614174000 some-Long-slug-Of-words-Here EXAMPLEq8Zt3Lw9Vx2Kp7Rj4Nm6")], "doc_id long, text string")
    assert secrets.query(d).first().spans == ""


def test_secrets_of_two_classes_and_beside_placeholders(spark):
    lower, upper, mixed = "q7x2m9kd4vz8w1tb6rj3hn5p", "MZXW6YTBOI2GK3TUNB4Q7JLD", "q8Zt3Lw9Vx2Kp7Rj4Nm6Tb5Yd1"
    texts = [f"a {lower} b", f"a {upper} b", f"SAMPLE_ID={mixed}", f"{mixed}xxxx{mixed}", f"sample={lower}", "internationalization2", "UPPERCASEHEADINGHEADING1"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.query(d).collect()}
    assert got[0] == "entropy_lower:2:26" and got[1] == "entropy_upper:2:26"
    assert got[2] == "entropy_base64:7:36"
    assert got[3] == "entropy_base64:0:25,entropy_base64:31:56"
    assert got[4] == "entropy_lower:7:31"
    assert got[5] == got[6] == ""
    masked = {r.doc_id: r.text for r in secrets.redact(d.selectExpr("*", "cast(null as long) n_chars")).collect()}
    assert masked[0] == masked[1] == "a [SECRET] b" and masked[2] == "SAMPLE_[SECRET]"


def test_secrets_no_python(spark):
    plan = secrets.scan(spark.read.parquet(f"{SF001}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_redact(docs, given):
    got = secrets.redact(docs)
    assert got.schema.names == docs.columns
    for text in {r.text for r in got.collect()} - {r.text for r in given}:
        assert "[SECRET]" in text and brute_spans(text)[1] == []
    clean = [r for r in given if not brute_spans(r.text or "")[1]]
    assert Counter(map(tuple, clean)) == Counter(tuple(r) for r in got.collect() if "[SECRET]" not in (r.text or ""))


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(docs, given, none, odd, spark):
    got = sorted((tuple(r)[:1] + tuple(r)[1:7] for r in quality.query(docs).collect()), key=str)
    want = []
    for r in given:
        c = brute_counts(r.text or "")
        want.append((r.doc_id, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert got == sorted(want, key=str)
    assert quality.query(none).collect() == []
    assert [r.kept for r in quality.query(odd).collect()] == [False] * 3
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    counted = {r.doc_id: tuple(r)[3:] for r in quality.count_statistics(d).collect()}
    assert counted == {r.doc_id: brute_counts(r.text) for r in d.collect()}


def test_quality_rejects_outliers_only(spark):
    import random

    rng = random.Random(1)
    rows = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))), "en", "s") for k in range(300)]
    rows += [(1000 + k, " ".join(f"#w%{rng.randrange(5000)}$" for _ in range(150)), "en", "s") for k in range(20)]
    rows += [(2000 + k, " ".join(f"#w%{rng.randrange(5000)}$" for _ in range(150)), "xx", "few") for k in range(20)]
    got = {r.doc_id: r for r in quality.query(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k].kept for k in range(300))
    assert not any(got[1000 + k].kept for k in range(20))
    # too few for an estimate of their own: judged by the one pooled over all rows, of which they are outliers
    assert all(not got[2000 + k].kept and got[2000 + k].distance > quality.CUTOFF for k in range(20))


def test_quality_judges_small_groups_by_pools(spark):
    import random

    rng = random.Random(2)

    def clean():
        return " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300)))

    def ridden():
        return " ".join(f"#w%{rng.randrange(5000)}$" for _ in range(150))

    rows = [(k, clean(), "en", "s") for k in range(200)]
    rows += [(1000 + k, clean(), "en", f"tail{k % 10}") for k in range(40)]  # judged by their language
    rows += [(2000 + k, clean(), "xx", "few") for k in range(10)]  # by all rows
    rows += [(3000 + k, ridden(), ["en", "xx", None][k % 3], ["tail1", "few", None][k % 3]) for k in range(9)]
    got = {r.doc_id: r for r in quality.query(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(r.distance is not None for r in got.values())
    assert [k for k in got if k < 3000 and not got[k].kept] == []
    assert [k for k in got if k >= 3000 and got[k].kept] == []


def test_quality_rejects_one_outlying_statistic(spark):
    import random

    rng = random.Random(3)

    def clean(n):
        return [f"w{rng.randrange(10**4, 10**5)}" for _ in range(n)]

    def lines(w):
        return "\n".join(" ".join(w[k : k + 6]) for k in range(0, len(w), 6))

    rows = [(k, lines(clean(rng.randrange(180, 420)))) for k in range(300)]
    rows += [(900, lines(clean(2500))), (901, lines([x * 2 for x in clean(300)]))]  # x1, x2
    rows.append((902, lines([x[:-1] + "#" if k < 25 else x for k, x in enumerate(clean(300))])))  # x3: 1.4% of characters
    own = lines(clean(300)).split("\n")
    rows.append((903, "\n".join(x + "\n" + own[0] if k % 5 == 1 else x for k, x in enumerate(own))))  # x4: a line of 6 words 11 times
    w = clean(300)
    rows.append((904, lines(w + w[100:130])))  # x5: a passage of 30 words twice, 18% of the words
    rows.append((905, lines([*clean(179), "w1234#"])))  # one symbol is within the noise
    d = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.query(d).collect()}
    assert not any(r.base_failed for r in got.values())
    assert got[903].n_repeat_words == 0 and got[904].n_dup_lines <= 4
    assert [k for k in [*range(300), 905] if not got[k].kept] == []
    assert [k for k in range(900, 905) if got[k].kept] == []


def test_quality_estimate_is_the_minimum_determinant_kind():
    """One group's solve equals the mean and covariance of its nearest rows."""
    import pandas as pd

    x = np.random.default_rng(3).normal(size=(400, 5))
    bins = np.repeat(np.arange(40), 10)
    frame = pd.DataFrame(x, columns=quality.STATS).assign(bin=bins, n=1, part="p")
    for i, j in quality.PAIRS:
        frame[f"x{i + 1}{j + 1}"] = x[:, i] * x[:, j]
    got = quality.solve(frame.groupby(["part", "bin"], as_index=False).sum(), 0.75, 1.0).iloc[0]
    near = x[:300]
    assert np.allclose(got.centre, near.mean(0))
    inverse = np.linalg.inv(np.cov(near.T, bias=True) + np.diag(np.square(quality.FLOOR)))
    assert np.allclose(got.inverse, [inverse[i, j] for i, j in quality.PAIRS])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet").repartition(8), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.query(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.predicted.mean() > 0.8 and clean.predicted.mean() < 0.02
    assert got.score.between(0, 1).all()


def test_toxicity_edges(spark, docs, none, odd):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(None, 1), (3, None), (3, 7)], "doc_id long, toxic int")
    assert toxicity.query(docs, labels).count() == docs.count()
    assert toxicity.query(none, labels).collect() == []
    flat = toxicity.query(odd, labels.limit(0)).collect()
    assert {r.score for r in flat} == {0.5} and {r.held_out for r in flat} == {True}
    kept = toxicity.keep_civil(docs, labels.limit(0))
    assert kept.columns == docs.columns


def test_toxicity_uses_no_held_out_label(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    rows, there = toxicity.training_rows(docs, labels, 100)
    import zlib

    own = {r.doc_id for r in rows.collect()}
    assert own and all(zlib.crc32(str(k).encode()) % 5 for k in own)
    assert sum(there.values()) == sum(1 for k in range(40) if zlib.crc32(str(k).encode()) % 5)
    few, _ = toxicity.training_rows(docs, labels, 2)
    assert few.count() <= 4


def test_registered_pieces_and_secrets(spark):
    n = spark.read.parquet(f"{SF001}/documents.parquet").count()
    for name in ("op1_encode_pieces", "op2_scan_secrets", "op5_judge_quality"):
        assert e.queries()[name](spark, SF001).count() == n
