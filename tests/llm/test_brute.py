"""Operators and pipeline stages against brute force: placements, scores, placeholders, each stage on its own input."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from cometa.llm import mixing, secrets, sharding, suffix_dedup, toxicity
from tests.conftest import SF001
from tests.llm.test_narrow import ASSIGN
from tests.llm.test_wide import brute_join, brute_suffixes, rows_of


# -- secrets --------------------------------------------------------------------


def brute_spans(text):
    """All spans (start, kind, end): base kinds, then the hot windows of each run's parts between placeholders."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    more, w = [], secrets.WINDOW
    for kind, (run, _, must, least) in secrets.CLASSES.items():
        for m in re.finditer(run, text):
            pieces, at = [], 0
            for cut in re.finditer(secrets.CUT, m[0]):
                pieces.append((at, cut.start()))
                at = cut.end()
            for a, b in [*pieces, (at, len(m[0]))]:
                part = m[0][a:b]
                if len(part) < w or not all(re.search(p, part) for p in must) or any(re.search(p, part) for p in secrets.ALLOW):
                    continue
                c = part.lower() if kind == "entropy_hex" else part
                hot = [i for i in range(len(c) - w + 1) if -sum(v / w * math.log2(v / w) for v in Counter(c[i : i + w]).values()) >= least - 1e-9]
                span = (m.start() + a + hot[0], secrets.KINDS.index(kind), m.start() + a + hot[-1] + w) if hot else None
                if span and not any(x <= span[0] and y >= span[2] for x, _, y in base):
                    more.append(span)
    return sorted(base + more)


def redacted(text):
    out, at = "", 0
    for a, _, b in brute_spans(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_secrets_beside_placeholders_equal_brute_force(spark):
    rng = random.Random(7)
    alphabets = ["abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", "0123456789abcdefABCDEF"]
    words = ["example", "SAMPLE", "xxxx", "0123456789", "changeme", "abcdefghij"]
    texts = []
    for _ in range(250):
        parts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randrange(0, 45))) for _ in range(rng.randrange(1, 4))]
        texts.append(" ".join(rng.choice(words).join(parts) for _ in range(2)) + rng.choice(["", " token=" + parts[0]]))
    got = {r.doc_id: r.spans for r in secrets.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    want = {k: ",".join(f"{secrets.KINDS[kind]}:{a}:{b}" for a, kind, b in brute_spans(t)) for k, t in enumerate(texts)}
    assert got == want
    assert sum("entropy" in x for x in want.values()) > 50


# -- toxicity ---------------------------------------------------------------------


def brute_buckets(text):
    """The bucket of every n-gram, character by character."""
    chars, out = [ord(c) for c in f" {text.lower()} "], []
    for n in toxicity.SIZES:
        for at in range(len(chars) - n + 1):
            h = n
            for c in chars[at : at + n]:
                h = (h * 0x01000193 + c) & 0xFFFFFFFF
            h ^= h >> 15
            out.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - toxicity.BITS))
    return set(out)


def test_toxicity_ratios_features_and_scores_equal_brute_force(spark):
    d, labels = spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/labels.parquet")
    rows, _ = toxicity.training_rows(d, labels, toxicity.PER_CLASS)
    given = [(brute_buckets(r.text), r.toxic) for r in rows.collect()]
    size = Counter(y for _, y in given)
    p, q = (Counter(b for s, y in given if y == c for b in s) for c in (1, 0))
    counts = {r.bucket: (r.p, r.q) for r in toxicity.class_counts(rows).collect()}
    assert counts == {b: (p[b], q[b]) for b in p.keys() | q.keys()}
    often = [b for b in counts if sum(counts[b]) >= toxicity.LEAST_DOCS]
    ratio = {b: math.log((p[b] + 1) / (size[1] + 2)) - math.log((q[b] + 1) / (size[0] + 2)) for b in often}
    use = {b: abs(ratio[b]) * math.log1p(p[b] + q[b]) for b in often}
    model = toxicity.fit(d, labels)
    chosen = set(np.flatnonzero(model.feature >= 0).tolist())
    assert len(chosen) == min(len(often), toxicity.FEATURES)
    assert min(use[b] for b in chosen) >= max((use[b] for b in often if b not in chosen), default=0) - 1e-9
    weight = {b: model.weight[model.feature[b]] for b in chosen}
    scored = {r.doc_id: r.score for r in toxicity.query(d, labels).collect()}
    for r in d.limit(40).collect():
        z = model.intercept + (sum(weight[b] for b in brute_buckets(r.text) if b in weight) if r.text else 0.0)
        assert abs(scored[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-9


# -- sharding -----------------------------------------------------------------------


def test_sharding_equals_a_replayed_matrix(spark, monkeypatch):
    """Every row's shard and slot, from the written blocks, the matrix drawn again and plain sorting."""
    kept = {}
    real = sharding.save
    monkeypatch.setattr(sharding, "save", lambda df, name: kept.setdefault(name, real(df, name)))
    d = spark.range(0, 900, 1, 5).withColumnRenamed("id", "doc_id")
    n_shards, seed, window = 7, 23, 40
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(d, n_shards, seed, window).collect()}

    def drawn(purpose):
        return F.xxhash64(F.lit(seed), F.lit(purpose), "block", "pos")

    rows = kept["shard_blocks"].select("row.doc_id", "block", "pos", drawn(3).alias("x3"), drawn(4).alias("x4")).collect()
    sizes = Counter(r.block for r in rows)
    blocks = [sizes[b] for b in range(max(sizes) + 1)]
    room, labels = sharding.shard_sizes(len(rows), n_shards), {}
    groups, rng = [], np.random.default_rng([seed, 0])
    for at in range(0, len(blocks), sharding.GROUP_BLOCKS):
        groups.append(sharding.matrix_row(rng, room, sum(blocks[at : at + sharding.GROUP_BLOCKS])))
        room = [a - b for a, b in zip(room, groups[-1])]
    for g, left in enumerate(groups):
        rng, left = np.random.default_rng([seed, 1, g]), list(left)
        for b in range(g * sharding.GROUP_BLOCKS, min(len(blocks), (g + 1) * sharding.GROUP_BLOCKS)):
            row = sharding.matrix_row(rng, left, blocks[b])
            left = [a - c for a, c in zip(left, row)]
            own = np.repeat(np.arange(n_shards), row)
            np.random.default_rng([seed, 2, b]).shuffle(own)
            labels[b] = own
    ranges = max(1, -(-len(rows) // (n_shards * window)))
    placed = {}
    for s in range(n_shards):
        mine = [r for r in rows if labels[r.block][r.pos] == s]
        for slot, r in enumerate(sorted(mine, key=lambda r: (r.x3 % ranges, r.x4, r.block, r.pos))):
            placed[r.doc_id] = (s, slot)
    assert got == placed and ranges > 1


def test_sharding_keeps_a_callers_columns(spark):
    d = spark.createDataFrame([(k, f"s{k}", k) for k in range(20)], "doc_id long, shard string, slot int")
    got = sharding.shuffle_into_shards(d, 3)
    assert got.columns == ["doc_id", "shard given", "slot given", "shard", "slot"]
    assert all(r["shard given"] == f"s{r.doc_id}" and r["slot given"] == r.doc_id for r in got.collect())


# -- suffix dedup -------------------------------------------------------------------


def test_suffix_dedup_at_the_edge_of_its_length(spark, monkeypatch):
    """Passages of 399, 400 and 401 bytes inside unlike documents of several chunks: the first stays, the others go whole."""
    from cometa.llm import repeats

    monkeypatch.setattr(repeats, "CHUNK_BYTES", 3000)
    rng = random.Random(9)

    def prose(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=n))

    rows = []
    for length in (399, 400, 401):
        passage = "#" + prose(length - 2) + "#"
        for k in range(3):
            rows.append((length * 10 + k, prose(2500 + 97 * k) + "<>="[k] + passage + "|%&"[k] + prose(1700)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rows_of(suffix_dedup.query(d))
    assert got == brute_suffixes(d.collect(), 400)
    removed = {r[0]: (r[2], r[3]) for r in got}
    assert all(removed[3990 + k] == (0, 0) for k in range(3))
    assert all(removed[4000 + k][0] >= 400 and removed[4010 + k][0] >= 401 for k in range(3))


# -- the pipeline, stage by stage -------------------------------------------------------


def as_rows(df):
    return Counter(map(tuple, df.collect()))


def test_every_pipeline_stage_equals_brute_force_on_its_own_input(spark):
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF001}/documents.parquet")
    planted = ["one deadbeefdeadbeefdeadbeef00 two", "a plain text with password = 'x.y-z_12' in it", None, ""]
    more = spark.createDataFrame([(90_000 + k, t, "en", "web", len(t or "")) for k, t in enumerate(planted)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])).cache()
    columns = docs.columns

    model = toxicity.fit(docs, labels)
    civil = stages["toxicity"](spark, docs, SF001).cache()
    assert as_rows(civil) == Counter(tuple(r) for r in docs.collect() if model.score(r.text) < 0.5)

    one = stages["near copies"](spark, civil, SF001).cache()
    given = civil.collect()
    _, root, sets = brute_join(given)
    least, want = {}, Counter()
    for k, r in enumerate(given):
        rank = (r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest())
        if not sets[k]:
            want[tuple(r)] += 1
        elif root[k] not in least or rank < least[root[k]][0]:
            least[root[k]] = (rank, tuple(r))
    want.update(row for _, row in least.values())
    assert as_rows(one) == want and len(given) > one.count()

    clean = stages["secrets"](spark, one, SF001).cache()
    want = Counter()
    for r in one.collect():
        text = redacted(r.text or "")
        changed = {"text": text, "n_chars": len(text)} if text != (r.text or "") else {}
        want[tuple(changed.get(c, r[c]) for c in columns)] += 1
    assert as_rows(clean) == want and any("[SECRET]" in (r.text or "") for r in clean.collect())

    mixed = stages["mixing"](spark, clean, SF001).cache()
    frame, con = clean.toPandas(), duckdb.connect()
    con.register("documents", frame)
    taken = {row[0]: row for row in con.execute(mixing.SQL).fetchall()}
    want = Counter()
    for r in clean.collect():
        _, size, _, _, words = taken[r.doc_id]
        copies = -(-words // size) if size else 0  # the document at the cut is kept whole
        if copies:
            want[tuple(r)] += copies
    assert as_rows(mixed) == want

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, tuple(r.ids)) for r in stages["pieces"](spark, mixed, SF001).collect())
    want = Counter()
    for r in mixed.collect():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), tuple(ids))] += 1
    assert got == want


@pytest.mark.parametrize("text", ["token=abcdefgh and token=abcdefghi", "deadbeefdeadbeefdeadbeef00"])
def test_redacted_spans(spark, text):
    d = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    assert secrets.redact(d).first().text == redacted(text) != text
