"""Mixing sources to target weights by prefix sums over hash-random order.

Every document gets a hash-random key. Inside each source the key space is cut
into ranges of about ``range_rows`` documents, so one source of any size spreads
over many tasks; ranges are sorted, word counts are prefix-summed inside each
range and shifted by the sums of the ranges before it. A source whose budget is
``e`` times its size plus a rest is taken ``e`` times whole, and once more up to
the exact word where the running sum reaches the rest.

Targets: source weights share the words of all documents; no source passes
``max_epochs`` times its own size, and what it leaves is reshared by weight. The
fixed point is found in closed form: with sources sorted by cap over weight, the
capped ones are a prefix, and the others share what is left by weight.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; documents without words are taken 0 times; equal rows tie in the
order and are interchangeable; an empty table gives an empty result. Only the
named columns of the input are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cometa.llm.common import WORD, free_name, save, word_count

WEIGHTS = (5, 2, 1)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """One row per source: source_rows, source_size, target (double).

    The table has a row per source, not per document; it is sorted whole.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    upto, since = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    room = total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    per = per.withColumn("total", total).withColumn("capped", F.col("cap") * F.sum("weight").over(since) <= room * F.col("weight"))
    spent = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    share = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    per = per.withColumn("spent", spent).withColumn("share", share)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * (F.col("total") - F.col("spent")) / F.col("share"))
    return per.select("source", "source_rows", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    size: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = 3,
    seed: str = "mix",
    range_rows: int = 5_000,
    row: str | None = None,
) -> DataFrame:
    """doc_id, [row, a column of the input,] size, source_size, target, taken (words the mix takes), copies (times the document appears, the cut one included)."""
    sized = save(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            (word_count(F.col(text)) if size is None else size.cast("long")).alias("size"),
            *([F.col(row).alias("row")] if row else []),
        ),
        "mix_sizes",
    )
    targets = save(source_targets(sized, weights, max_epochs), "mix_targets")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    ranges = F.ceil(F.col("source_rows") / float(range_rows))
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32) * ranges)
    placed = (
        sized.withColumn("key", key)
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("part", part)
    )
    inside = W.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy("source", "part")
        .agg(F.sum("size").alias("n"))
        .select(F.col("source").alias("of"), F.col("part").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    # the key order depends on the seed alone; equal keys are ordered by doc_id, then size
    at = F.col("start") + F.col("run")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at")))
    return (
        placed.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
        .withColumn("at", at)
        .withColumn("budget", budget)
        .withColumn("epochs", epochs)
        .withColumn("rest", rest)
        .withColumn("extra", extra)
        .select(
            "doc_id",
            *["row"] * bool(row),
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"),
            (F.when(F.col("size") > 0, F.col("epochs") + (F.col("extra") > 0).cast("long")).otherwise(0)).alias("copies"),
        )
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of the mix, each as often as the mix takes it; the one at a source's cut is kept whole."""
    row, time = free_name(docs.columns, "row of a table"), free_name(docs.columns, "time of a row")
    tagged = save(docs.withColumn(row, F.monotonically_increasing_id()), "mix_rows")
    taken = mix(tagged, row=row).where(F.col("copies") > 0)
    times = taken.select(F.col("row").alias(row), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(time))
    return tagged.join(times, row).drop(row, time)


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM per
), judged AS (
  SELECT *, cap * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      <= (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS capped
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source IS NULL, source)
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap
    ELSE weight * (CAST(sum(source_size) OVER () AS DOUBLE) - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target
  FROM judged
), run AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM run
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)) AS BIGINT) AS taken
FROM cut
"""
