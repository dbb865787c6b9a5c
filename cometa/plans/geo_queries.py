"""Registered route queries and their DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from cometa.operators import geo
from cometa.sources.derived import route_points
from cometa.sources.tables import table


def _segments(spark, sf_dir):
    return geo.route_segments(route_points(table(spark, sf_dir, "customer")))


def route_segments(spark, sf_dir):
    s = _segments(spark, sf_dir)
    return s.select("route_id", "from_seq", "to_seq", F.round("dist_km", 6).alias("dist_km"), F.round("minutes", 6).alias("minutes"))


def route_totals(spark, sf_dir):
    t = geo.route_totals(_segments(spark, sf_dir))
    return t.select("route_id", "n_segments", F.round("total_km", 6).alias("total_km"), F.round("total_minutes", 6).alias("total_minutes"))


QUERIES = {"route_segments": route_segments, "route_totals": route_totals}

_POINTS = """
WITH pts AS (
  SELECT CAST(c_nationkey AS BIGINT) AS route_id, c_custkey AS seq,
         -23.5 + CAST((c_custkey * 7919) % 10007 AS DOUBLE) / 100000.0 AS lat,
         -46.6 + CAST((c_custkey * 104729) % 10009 AS DOUBLE) / 100000.0 AS lon
  FROM customer),
pr AS (
  SELECT route_id, seq, lat, lon,
         lag(seq) OVER w AS pseq, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
  FROM pts WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
sg AS (
  SELECT route_id, pseq AS from_seq, seq AS to_seq,
         2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2)
           + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))) AS dist_km
  FROM pr WHERE pseq IS NOT NULL)
"""

ORACLE = {
    "route_segments": _POINTS
    + "SELECT route_id, from_seq, to_seq, round(dist_km, 6) AS dist_km, round(dist_km / 60.0 * 60.0, 6) AS minutes FROM sg",
    "route_totals": _POINTS
    + "SELECT route_id, count(*) AS n_segments, round(sum(dist_km), 6) AS total_km, "
    "round(sum(dist_km / 60.0 * 60.0), 6) AS total_minutes FROM sg GROUP BY route_id",
}
