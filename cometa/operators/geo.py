"""Route operators: haversine segments, travel time, totals.

Consecutive stops of a route are paired with a skew-proof "previous row"
operator: a route may hold a third of all points, so the ordered window is
never taken over a whole route. Each route's order keys are cut into buckets at
their quantiles; inside a (route, bucket) window ``lag`` finds the previous stop, and the first stop of
each bucket takes the last stop of the route's previous non-empty bucket from
a small per-bucket table.

The all-pairs distance matrix of a route is not produced (it grows with the
square of the route); only consecutive segments are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cometa.session import materialize


# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------
EARTH_RADIUS_KM = 6371.0
SPEED_KMH = 60.0
# ---------------------------------------------------------------------------


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km between two (lat, lon) points in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def with_previous(
    df: DataFrame,
    part_col: str,
    order_col: str,
    cols: list[str],
    buckets: int = 256,
    prefix: str = "prev_",
) -> DataFrame:
    """Add ``prev_<c>`` for ``c`` in ``[order_col] + cols``: the values of the
    previous row of the same partition by ``order_col`` (null for the first).

    A partition's order keys are cut at their approximate quantiles, so its
    buckets hold near-equal numbers of rows whatever the keys' spread (a far
    outlier changes nothing). The cuts are written once: both uses of a bucket
    must see the same cuts. ``order_col`` must be unique within a partition.
    """
    carried = [order_col] + cols
    shares = [k / buckets for k in range(1, buckets)]
    cuts = df.groupBy(part_col).agg(F.array_distinct(F.percentile_approx(order_col, shares, 10_000)).alias("__cuts"))
    cuts = materialize(cuts.withColumnRenamed(part_col, "__part"), "route_cuts")
    staged = df.join(cuts, F.col(part_col).eqNullSafe(F.col("__part")), "left").drop("__part")
    staged = staged.withColumn("__bkt", F.size(F.filter("__cuts", lambda x: x < F.col(order_col)))).drop("__cuts")
    w_in = Window.partitionBy(part_col, "__bkt").orderBy(order_col)
    inner = staged.select("*", *[F.lag(c).over(w_in).alias("__in_" + c) for c in carried])
    # last stop of each (route, bucket), then the previous non-empty bucket's:
    # one row per (route, bucket)
    last = staged.groupBy(part_col, "__bkt").agg(
        F.max_by(F.struct(*[F.col(c) for c in carried]), F.col(order_col)).alias("__last")
    )
    w_b = Window.partitionBy(part_col).orderBy("__bkt")
    heads = last.select(F.col(part_col).alias("__part"), F.col("__bkt").alias("__of"), F.lag("__last").over(w_b).alias("__head"))
    out = inner.join(heads, F.col(part_col).eqNullSafe(F.col("__part")) & (F.col("__bkt") == F.col("__of")), "left")
    return out.select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(F.col("__in_" + c), F.col("__head")[c]).alias(prefix + c) for c in carried],
    )


def route_segments(points: DataFrame, route_col="route_id", seq_col="seq", lat="lat", lon="lon") -> DataFrame:
    """One row per consecutive pair: distance (km) and time (minutes)
    at the fixed speed."""
    p = with_previous(points, route_col, seq_col, [lat, lon])
    p = p.where(F.col("prev_" + seq_col).isNotNull())
    d = haversine_km(F.col("prev_" + lat), F.col("prev_" + lon), F.col(lat), F.col(lon))
    return p.select(
        route_col,
        F.col("prev_" + seq_col).alias("from_seq"),
        F.col(seq_col).alias("to_seq"),
        d.alias("dist_km"),
        (d / F.lit(SPEED_KMH) * 60.0).alias("minutes"),
    )


def route_totals(segments: DataFrame, route_col="route_id") -> DataFrame:
    """Total distance and time per route."""
    return segments.groupBy(route_col).agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.sum("dist_km").alias("total_km"),
        F.sum("minutes").alias("total_minutes"),
    )
