"""The embedding cache in buckets: what is read, what is added, and compaction beside appends."""

import glob
import threading

from pyspark.sql import functions as F

from cometa.operators import embed_cache as ec


def counted(calls):
    def embed(texts):
        calls.append(texts.count())
        return texts.select(F.lit("m").alias("model"), "text_key", F.array(F.length("text").cast("float")).alias("embedding"))

    return embed


def run(spark, texts, path, calls):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = ec.embed_with_cache(df, "text", path, embedder=counted(calls), model="m")
    return sorted((r.text or "", r.embedding) for r in out.collect()), out


def want(texts):
    return sorted((t or "", None if t is None else [float(len(t))]) for t in texts)


def test_a_small_table_reads_only_its_buckets(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []
    many = [f"text number {k}" for k in range(600)]
    assert run(spark, many, path, calls)[0] == want(many)
    assert len(glob.glob(f"{path}/bucket=*")) == ec.BUCKETS
    few = [many[3], many[3], "new", None]
    got, _ = run(spark, few, path, calls)
    assert got == want(few) and calls == [600, 1]
    keys = spark.createDataFrame([(many[3],), ("new",)], "text string").select(ec.bucket_of(ec.text_key(F.col("text"))).alias("b"))
    used = sorted({r.b for r in keys.collect()})
    files = ec.read_cache(spark, path, "m", used).inputFiles()  # before pruning by the plan
    plan = ec.read_cache(spark, path, "m", used)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = ec.read_cache(spark, path, "m", used).select(F.input_file_name().alias("f")).distinct().count()
    assert read <= 2 * len(used) < len(files)


def test_models_do_not_mix_and_empty_tables(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []
    assert run(spark, [None, None], path, calls)[0] == want([None, None])
    run(spark, ["a", "bb"], path, calls)
    df = spark.createDataFrame([("a",)], "text string")
    other = ec.embed_with_cache(df, "text", path, embedder=lambda t: t.select(F.lit("n").alias("model"), "text_key", F.array(F.lit(9.0).cast("float")).alias("embedding")), model="n")
    assert other.first().embedding == [9.0]
    assert run(spark, ["a", "bb"], path, calls)[0] == want(["a", "bb"])
    assert ec.read_cache(spark, str(tmp_path / "none"), "m") is None
    assert ec.embed_with_cache(df.limit(0), "text", path, embedder=counted([]), model="m").collect() == []


def test_compaction_keeps_every_vector_and_leaves_appends_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ec, "BUCKETS", 4)
    monkeypatch.setattr(ec.bucket_of, "__defaults__", (4,))
    path, calls, texts = str(tmp_path / "cache"), [], []
    for k in range(5):
        more = [f"t{k} {j}" for j in range(20)]
        run(spark, more, path, calls)
        texts += more
    double = spark.read.schema(ec.CACHE_SCHEMA).parquet(path).drop("bucket").limit(30)
    ec.append_vectors(double, path)  # what a second run embedded at the same time
    before = len(glob.glob(f"{path}/bucket=*/*.parquet"))
    rewrite = ec.append_vectors

    def with_an_append_between(new, to):
        rewrite(new, to)
        late = spark.createDataFrame([("m", "k" * 64, [7.0])], "model string, text_key string, embedding array<float>")
        thread = threading.Thread(target=rewrite, args=(late, to))  # after the listing, before the removal
        thread.start()
        thread.join()

    monkeypatch.setattr(ec, "append_vectors", with_an_append_between)
    removed = ec.compact(spark, path, least_files=3)
    assert removed == before
    spark.catalog.refreshByPath(path)
    left = spark.read.schema(ec.CACHE_SCHEMA).parquet(path)
    assert left.count() == 101 and left.where("text_key = repeat('k', 64)").first().embedding == [7.0]
    assert len(glob.glob(f"{path}/bucket=*/*.parquet")) <= 5
    monkeypatch.setattr(ec, "append_vectors", rewrite)
    assert run(spark, texts, path, calls)[0] == want(texts) and calls[-1] == 0
    assert ec.compact(spark, path, least_files=3) == 0
