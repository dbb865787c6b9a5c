"""Operators that compare documents: suffix and phrase dedup, search, Jaccard join, mixing, sharding, the pipeline."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cometa.llm import chosen_path, components, hamming_search, mixing, phrase_dedup, repeats, sharding, suffix_dedup
from tests.conftest import SF001
from tools.oracle_check import open_duckdb


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def brute_suffixes(given, length):
    raw = [(r.doc_id, (r.text or "").encode()) for r in given]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = sum(bool(gone[k] and (k == 0 or not gone[k - 1])) for k in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_phrases(given, length):
    words = [(r.doc_id, (r.text or "").encode().split()) for r in given]
    seen = Counter(tuple(w[k : k + length]) for _, w in words for k in range(len(w) - length + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk_bytes", [2_000_000, 3000])
def test_suffix_dedup(docs, given, none, odd, monkeypatch, chunk_bytes):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk_bytes)
    want = brute_suffixes(given, 400)
    assert rows_of(suffix_dedup.query(docs)) == want
    assert sum(x[2] for x in want) > 1000
    if chunk_bytes == 3000:
        assert rows_of(suffix_dedup.dedup(docs, 100, 7, blocks=3)) == brute_suffixes(given, 100)
    else:
        assert suffix_dedup.query(none).collect() == []
        assert {tuple(r) for r in suffix_dedup.query(odd).collect()} == {(None, 0, 0, 0, hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("chunk_bytes", [2_000_000, 3000])
def test_phrase_dedup(docs, given, none, odd, monkeypatch, chunk_bytes):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk_bytes)
    want = brute_phrases(given, 35)
    assert rows_of(phrase_dedup.query(docs)) == want
    assert sum(x[2] for x in want) > 500
    if chunk_bytes == 3000:
        assert rows_of(phrase_dedup.dedup(docs, 12, 4, blocks=2)) == brute_phrases(given, 12)
    else:
        assert phrase_dedup.query(none).collect() == []
        assert {tuple(r) for r in phrase_dedup.query(odd).collect()} == {(None, 0, 0, hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13])
def test_difference_cover(q):
    v, d = suffix_dedup.difference_cover(q)
    assert len(d) == q + 1 and {(int(x) - int(y)) % v for x in d for y in d} == set(range(v))


def test_ties_with_equal_first_parts():
    """Keys that agree in their first 64 bits alone are no ties."""
    import pyarrow as pa

    def data(first, second):
        return np.array(first, np.uint64).tobytes() + np.array(second, np.uint32).tobytes() + np.packbits(np.zeros(len(first), bool)).tobytes()

    table = pa.table({"chunk": [1, 2, 3], "bucket": pa.array([0, 0, 0], pa.int32()), "data": pa.array([data([5, 9], [1, 1]), data([5], [2]), data([5], [1])], pa.binary())})
    got = repeats.bucket_ties(table, True).column("answer").to_pylist()
    assert [np.unpackbits(np.frombuffer(x, np.uint8), count=n).tolist() for x, n in zip(got, (2, 1, 1))] == [[1, 0], [0], [1]]


def brute_join(given, threshold=0.8):
    sets = []
    for r in given:
        w = (r.text or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(sets)
    links = [[a != b and bool(sets[a]) and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9 for b in range(n)] for a in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[a]] + [root[b] for b in range(n) if links[a][b]]) for a in range(n)]
        if new == root:
            break
        root = new
    ids = defaultdict(list)
    for a in range(n):
        ids[root[a]].append(given[a].doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(given[a].doc_id, least[root[a]], sum(links[a])) for a in range(n)], root, sets


@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_join(docs, given, none, odd, monkeypatch, block):
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    monkeypatch.setattr(chosen_path, "LIMIT", 128 if block > 4 else 3)
    want = brute_join(given)[0]
    assert rows_of(chosen_path.query(docs)) == sorted(want, key=str)
    assert max(x[2] for x in want) >= 12
    if block == 1024:
        assert chosen_path.query(none).collect() == []
        assert [tuple(r) for r in chosen_path.query(odd).collect()] == [(None, None, 0)] * 3


def test_jaccard_recall_on_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given = d.collect()
    inverted, both = defaultdict(list), [Counter() for _ in given]
    sets = []
    for k, r in enumerate(given):
        w = r.text.encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        for s in sets[-1]:
            inverted[s].append(k)
    for own in inverted.values():
        for a in own:
            both[a].update(own)
    want = {r.doc_id: sum(c >= 0.8 * (len(sets[a]) + len(sets[b]) - c) - 1e-9 for b, c in both[a].items() if a != b) for a, r in enumerate(given)}
    assert {r.doc_id: r.n_links for r in chosen_path.query(d).collect()} == want


def test_keep_one(docs, given):
    got = chosen_path.keep_one(docs)
    assert got.columns == docs.columns
    _, root, sets = brute_join(given)
    least, want = {}, Counter()
    for k, r in enumerate(given):
        if not sets[k]:
            want[tuple(r)] += 1
        else:
            rank = (r.doc_id is None, r.doc_id or 0, hashlib.md5(r.text.encode()).hexdigest())
            if root[k] not in least or rank < least[root[k]][0]:
                least[root[k]] = (rank, tuple(r))
    want.update(row for _, row in least.values())
    assert Counter(map(tuple, got.collect())) == want


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_search_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=40)]) for k in range(120)]
    rows += [(1000 + k, rows[7][1]) for k in range(40)]  # equal codes
    rows += [(50, rows[50][1]), (None, rows[3][1]), (200, None), (300, [1.0, None, float("nan"), 2.0]), (350, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    bits = {i: [1 if k < len(v) and v[k] is not None and v[k] > 0 else 0 for k in range(40)] for i, v in rows if i is not None and v is not None}
    want = []
    for q, c in bits.items():
        if q % 50 == 0:
            near = sorted((sum(a != b for a, b in zip(c, x)), i) for i, x in bits.items())[:10]
            want += [(q, k + 1, i, n) for k, (n, i) in enumerate(near)]
    assert rows_of(hamming_search.query(d)) == sorted(want, key=str)
    few = d.where("vec_id in (0, 1, 50)")
    assert hamming_search.query(few).count() == 6
    assert hamming_search.query(d.limit(0)).collect() == []


@pytest.mark.parametrize("block, width", [(4, 12), (16, 24), (1 << 14, 8)])
def test_search_in_blocks_of_any_size(spark, monkeypatch, block, width):
    """Blocks told apart by leading bits and by hash, probes looked up and values compared, near and far neighbours."""
    monkeypatch.setattr(hamming_search, "BLOCK", block)
    monkeypatch.setattr(hamming_search, "segment_bounds", lambda dims, rows: [(a, min(dims, a + width)) for a in range(0, dims, width)])
    rng = np.random.default_rng(block)
    bits = rng.integers(0, 2, (160, 48))
    bits[:60, :24] = bits[0, :24]  # half a code that many share
    bits[60:80] = bits[60]
    bits[80:100] = bits[80] ^ (rng.random((20, 48)) < 0.05)
    d = spark.createDataFrame([(k, [float(2 * b - 1) for b in row]) for k, row in enumerate(bits.tolist())], "vec_id long, embedding array<float>")
    got = hamming_search.search(d, d.where("vec_id % 7 = 0"), k=6).collect()
    far = (bits[:, None] != bits[None]).sum(axis=2)
    want = [(q, r + 1, n, int(far[q, n])) for q in range(0, 160, 7) for r, n in enumerate(sorted(range(160), key=lambda n: (far[q, n], n))[:6])]
    assert sorted((r.query_id, r["rank"], r.neighbor_id, r.distance) for r in got) == sorted(want)


def test_search_plans_hold_no_probes(spark):
    """At 24 bits a step's probes are made in tasks: the plan is as small at distance 7 as at 1."""
    codes = spark.createDataFrame([([k, k + 1], [k]) for k in range(50)], "code array<int>, ids array<long>")
    bounds = [(0, 24), (24, 48)]
    blocks = hamming_search.code_blocks(codes, bounds, 3, 10)
    plans = []
    for s in (1, 7):
        out = hamming_search.step(codes.select(F.col("code").alias("query")), blocks, bounds, 3, s, 10, 50)
        plans.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(plans[0] - plans[1]) < 10


def test_mixing(docs, given, none, odd):
    got = rows_of(mixing.query(docs))
    assert got == rows_of(mixing.query(docs.repartition(3)))  # reruns agree
    con = open_duckdb(SF001)
    frame = docs.select("doc_id", "text", "source").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("given", frame)
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM given")
    assert [x for x in got] == sorted(con.execute(mixing.SQL).fetchall(), key=str)
    assert all(x[4] <= 3 * x[1] for x in got)
    assert mixing.query(none).collect() == []
    assert {tuple(r) for r in mixing.query(odd).collect()} == {(None, 0, 0, 0.0, 0)}


def test_mixing_meets_targets_in_ranges(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), (F.col("id") % 50).alias("n"))
    got = mixing.mix(d, text="source", size=F.col("n"), range_rows=64)
    per = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).collect()
    for r in per:
        assert r.taken == int(r.target + 0.5) and r.size == r.source_size
    assert abs(sum(r.taken for r in per) - sum(r.size for r in per)) <= len(per)


def test_mixed_rows(docs):
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    copies = {(r.doc_id, r.size): 0 for r in mixing.mix(docs).collect()}
    for r in mixing.mix(docs).collect():
        copies[(r.doc_id, r.size)] += r.copies
    assert got.count() == sum(copies.values())


def test_sharding(docs, given, none, odd):
    got = sharding.query(docs).collect()
    text = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in given]
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(text, key=str)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes[s] for s in range(16)) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sharding.query(none).collect() == []
    assert sharding.query(odd).count() == 3


def test_sharding_is_uniform_and_exact(spark):
    d = spark.range(0, 3000, 1, 7)
    seen = np.zeros((10, 4))
    for seed in range(6):
        got = sharding.shuffle_into_shards(d, 4, seed, window_rows=100).collect()
        assert Counter(r.shard for r in got) == {s: 750 for s in range(4)}
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(750)) for s in range(4))
        for r in got:
            seen[r.id * 10 // 3000, r.shard] += 1
    expect = 6 * 3000 / 40
    assert (((seen - expect) ** 2 / expect).sum()) < 80  # chi-square, 27 degrees of freedom


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    ours = np.array([sharding.hypergeometric(rng, 300, 700, 50) for _ in range(4000)])
    theirs = rng.hypergeometric(300, 700, 50, 4000)
    assert abs(ours.mean() - theirs.mean()) < 0.3 and abs(ours.std() - theirs.std()) < 0.15
    large = sharding.hypergeometric(rng, 10**10, 15 * 10**10, 10**8)
    assert abs(large - 10**8 / 16) < 10 * (10**8 / 16) ** 0.5
    m = sharding.Matrix([5, 0, 1000, 37] * 200, 16, 3)
    rows = np.array([m.row(b) for b in range(0, 800, 1)])
    assert rows.sum(1).tolist() == m.rows and rows.sum(0).tolist() == sharding.shard_sizes(sum(m.rows), 16)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF001).cache()
        assert after.columns == docs.columns, name
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF001)
    want = rows_of(last.select("doc_id", "ids_sha256"))
    assert rows_of(corpus_pipeline.run(spark, SF001).select("doc_id", "ids_sha256")) == want
    assert len(want) == before.count()


def test_pipeline_edges(spark, docs, none, odd):
    for given in (docs, none, odd):
        before = given
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            before = stage(spark, before, SF001)
            assert before.columns == docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, before, SF001).count()
