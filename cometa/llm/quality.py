"""Quality rules: base rules, then robust multivariate outliers by language and source.

Each whole text gives exact counts. The documents that pass the base rules are
grouped by language and source, and every group of ``LEAST_ROWS`` or more gets a
minimum covariance determinant (MCD) estimate of five transformed statistics: log words, log
characters per word, and the square roots of symbols per character, repeated
lines per word and repeated words per word. Concentration steps run over all
rows of all groups together: with the current centre and covariance every row
gets its squared Mahalanobis distance, and the ``SUBSET`` share of a group with
the smallest distances gives the next centre and covariance. The start is the
group's medians and quartile ranges. After ``STEPS`` steps comes the usual
reweighting step, and a row whose distance passes ``CUTOFF`` is rejected.

A smaller group is judged by an estimate of the same kind pooled over all passing
rows of its language, or, where its language has fewer than ``LEAST_ROWS`` passing
rows, over all passing rows of the table, however few. So every row that passes
the base rules has a distance.

Scale: the texts are read once, in Arrow batches, and the statistics are
written; each step is one aggregation of that narrow table by (group, distance
bin), combined before the shuffle, so a source that holds a third of all rows
costs each task at most ``BINS`` rows. The steps' estimates are solved on the
executors, one group at a time from at most ``BINS`` rows of sums, and joined
back as a small written table.

Counts vary by chance, so no scale is taken smaller than counting noise: the
square root of a Poisson count has a standard deviation of one half, which for
symbols per character is half of one symbol's share, and likewise for a line and
a window of 8 words. The noise is a lower bound, not added: on the estimate's
variance in every direction (with the mean noise of its rows), and on each row's
own scales, so that one symbol in a short text is no outlier. Log words and log
characters per word have the fixed bounds 0.2 and 0.1. A row whose distance is
over the 99.9% point of chi-square is rejected, so one outlying statistic is enough.

Defined results: a null or empty text has no words, and fails the base rules; a
null language or source is a group of its own, and a null language a language;
repeated rows count as often as they stand; an empty table gives an empty result. Only the
named columns of the input are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cometa.llm.common import save

SYMBOLS = "#*$%&|<>"  # fixed value
WINDOW = 8
SUBSET, STEPS, LEAST_ROWS = 0.75, 6, 50
# Chi-square with 5 degrees of freedom. Consistency factors of the
# 75% subset and of the reweighting at 97.5%, that 97.5% point, and the cutoff
# (the 99.9% point).
SUBSET_FACTOR, REWEIGHT_FACTOR, REWEIGHT_AT, CUTOFF = 1.4120710601890483, 1.055533110040659, 12.83250199403002, 20.515005652432873
STATS = ["x1", "x2", "x3", "x4", "x5"]
NOISE = ["v1", "v2", "v3", "v4", "v5"]  # the square of a row's least scales
FLOOR = [1e-3] * 5  # keeps a covariance of equal rows regular
BINS, PER_OCTAVE, LOWEST = 960, 32, -10
EVERYTHING = "A"  # the pool of all rows
PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of 8 words that stand twice or more in the text, the first included."""
    if len(words) <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    n = len(ids) - WINDOW + 1
    if len(number) == len(words):
        return 0
    h = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += ids[k : k + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    tied = order[np.r_[same, False] | np.r_[False, same]]
    seen: dict[bytes, int] = {}
    rows = [ids[i : i + WINDOW].tobytes() for i in tied.tolist()]
    for r in rows:
        seen[r] = seen.get(r, 0) + 1
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    for i, r in zip(tied.tolist(), rows):
        if seen[r] > 1:
            cover[i] += 1
            cover[i + WINDOW] -= 1
    return int((np.cumsum(cover) > 0).sum())


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space alone
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - spaces,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def count_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the exact counts of each whole text."""
    narrow = docs.select(
        F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text")
    )
    kept = ["doc_id", "lang", "source"]
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_counts(t) for t in batch.column("text").to_pylist()], dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *map(pa.array, rows.T)], [*kept, *COUNTS])

    return narrow.mapInArrow(count, schema)


def with_statistics(counted: DataFrame) -> DataFrame:
    words, chars = F.col("n_words"), F.col("word_chars")
    x = {
        "x1": F.log1p(words),
        "x2": F.log((chars + 1) / (words + 1)),
        "x3": F.sqrt(F.col("n_symbols") / (chars + 1)),
        "x4": F.sqrt(F.col("n_dup_lines") / (words + 1)),
        "x5": F.sqrt(F.col("n_repeat_words") / (words + 1)),
    }
    v = {
        "v1": F.lit(0.04),
        "v2": F.lit(0.01),
        "v3": 0.25 / (chars + 1),
        "v4": 0.25 / (words + 1),
        "v5": 0.25 * WINDOW / (words + 1),
    }
    failed = (words < 20) | (100 * F.col("n_repeat_words") > 30 * words)
    part = [F.when(F.col(c).isNull(), "0").otherwise(F.concat(F.lit("1"), c)) for c in ("lang", "source")]
    return counted.withColumns(x | v | {"base_failed": failed, "part": F.concat_ws("\x01", *part), "language": F.concat(F.lit("L"), part[0])})


def judged_by(passed: DataFrame) -> DataFrame:
    """part and used: the group, language or whole table whose estimate judges the group."""
    groups = passed.groupBy("part", "language").agg(F.count("*").alias("rows"))
    languages = groups.groupBy("language").agg(F.sum("rows").alias("language_rows"))
    used = F.when(F.col("rows") >= LEAST_ROWS, F.col("part")).when(F.col("language_rows") >= LEAST_ROWS, F.col("language")).otherwise(EVERYTHING)
    return groups.join(languages, "language").select("part", used.alias("used"))


def members(passed: DataFrame, groups: DataFrame) -> DataFrame:
    """Every passing row once for each estimate that it belongs to, its group's and the pools', as far as they are used."""
    wanted = groups.select(F.col("used").alias("part")).distinct()
    return passed.select(F.explode(F.array("part", "language", F.lit(EVERYTHING))).alias("part"), *STATS, *NOISE).join(wanted, "part", "left_semi")


def distance() -> Column:
    """The squared Mahalanobis distance of x1..x5 from the joined estimate, each scale at least the row's noise."""
    off = [(F.col(x) - F.get("centre", F.lit(k))) * F.least(F.lit(1.0), F.get("scale", F.lit(k)) / F.sqrt(v)) for k, (x, v) in enumerate(zip(STATS, NOISE))]
    out = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        out = out + F.get("inverse", F.lit(k)) * off[i] * off[j] * (1.0 if i == j else 2.0)
    return out


def first_estimate(rows: DataFrame) -> DataFrame:
    """Medians, and quartile ranges as independent scales."""
    wanted = [F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(x) for x in STATS]
    own = rows.groupBy("part").agg(*wanted, *[F.avg(v).alias(v) for v in NOISE])
    scale = [F.greatest((F.get(x, F.lit(2)) - F.get(x, F.lit(0))) / 1.349, F.sqrt(v), F.lit(f)) for x, v, f in zip(STATS, NOISE, FLOOR)]
    inverse = [1.0 / (scale[i] * scale[j]) if i == j else F.lit(0.0) for i, j in PAIRS]
    return own.select("part", F.array(*[F.get(x, F.lit(1)) for x in STATS]).alias("centre"), F.array(*inverse).alias("inverse"), F.array(*scale).alias("scale"))


def solve(sums: pd.DataFrame, share: float, factor: float) -> pd.DataFrame:
    """The estimate of one group from sums by distance bin: of the nearest bins that hold ``share`` of its rows."""
    sums = sums.sort_values("bin")
    upto = sums["n"].cumsum().to_numpy()
    m = int(np.searchsorted(upto, share * upto[-1])) + 1
    n = float(upto[m - 1])
    s = sums.iloc[:m]
    centre = np.array([s[x].sum() for x in STATS]) / n
    cov = np.zeros((5, 5))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = s[f"x{i + 1}{j + 1}"].sum() / n - centre[i] * centre[j]
    least = np.sqrt([max(s[v].sum() / n if v in s else 0.0, f * f) for v, f in zip(NOISE, FLOOR)])
    cov = cov * factor + np.diag(np.square(FLOOR))
    # in units of the noise, no direction varies less than 1
    values, axes = np.linalg.eigh(cov / np.outer(least, least))
    axes = axes / least[:, None]
    inverse = (axes / np.maximum(values, 1.0)) @ axes.T
    scale = np.maximum(np.sqrt(np.diag(cov)), least)
    return pd.DataFrame({"part": [sums["part"].iloc[0]], "centre": [centre.tolist()], "inverse": [[inverse[i, j] for i, j in PAIRS]], "scale": [scale.tolist()]})


def next_estimate(rows: DataFrame, estimate: DataFrame, last: bool) -> DataFrame:
    """One concentration step over all rows; the last is the reweighting step."""
    near = rows.join(estimate, "part").withColumn("d", distance())
    if last:
        near, share, factor = near.where(F.col("d") <= REWEIGHT_AT).withColumn("bin", F.lit(0)), 1.0, REWEIGHT_FACTOR
    else:
        octave = F.floor((F.log2(F.col("d") + 1e-12) - LOWEST) * PER_OCTAVE)
        near, share, factor = near.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), octave)).cast("int")), SUBSET, SUBSET_FACTOR
    sums = [F.sum(x).alias(x) for x in STATS + NOISE] + [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"x{i + 1}{j + 1}") for i, j in PAIRS]
    binned = near.groupBy("part", "bin").agg(F.count("*").alias("n"), *sums)
    return binned.groupBy("part").applyInPandas(lambda pdf: solve(pdf, share, factor), "part string, centre array<double>, inverse array<double>, scale array<double>")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, distance (null if base_failed) and kept."""
    rows = save(with_statistics(count_statistics(docs)), "quality_statistics")
    passed = rows.where(~F.col("base_failed"))
    groups = save(judged_by(passed), "quality_groups")
    pooled = save(members(passed, groups), "quality_members")
    estimate = save(first_estimate(pooled), "quality_estimate")
    for step in range(STEPS + 1):
        estimate = save(next_estimate(pooled, estimate, step == STEPS), "quality_estimate")
    own = save(groups.join(estimate.withColumnRenamed("part", "used"), "used"), "quality_estimate")
    far = F.when(~F.col("base_failed"), distance())
    judged = rows.join(own, "part", "left").withColumn("distance", far)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUTOFF))


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept", "distance")
