"""Partitioning helpers for CPU-heavy row operators."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_for_cpu(scan: DataFrame) -> DataFrame:
    """Round-robin repartition a *fresh file scan* before per-row heavy work,
    but only when it has fewer partitions than the cluster has cores (one
    large unsplittable file, a single row group). A big scan with many splits
    is returned as it is, so no shuffle is added at scale.

    Round-robin spreads evenly whatever the data (no hot key) and keeps the
    plan deterministic, so filters placed after the spread are still pushed
    into the scan. (Hashing a ``monotonically_increasing_id()`` avoids the
    per-task sort but is non-deterministic and blocks that pushdown.)

    Call it on a scan (possibly followed by narrow projections and filters),
    not on a plan with a shuffle: counting the partitions of a shuffled
    (adaptive) plan executes its upstream stages.
    """
    if scan.isStreaming:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)
