"""Points of a stream against static zones, counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import native
from ..functions.register import call


def zone_cells(zones: DataFrame, size: float, zone_id: str = "zone", geom: str = "geom", box: str = "bbox") -> DataFrame:
    """Static side: one row per zone and cell it touches."""
    return zones.select(zone_id, geom, F.explode(native.square_cells(F.col(box), size)).alias("_c")).select(zone_id, geom, F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j"))


def geofence(pings: DataFrame, cells: DataFrame, size: float, x: str = "lon", y: str = "lat", geom: str = "geom") -> DataFrame:
    """Pings with the zone they lie in: an equi-join on cells (stream-static), then the exact predicate."""
    own = pings.withColumn("_i", F.floor(F.col(x) / size).cast("long")).withColumn("_j", F.floor(F.col(y) / size).cast("long"))
    hit = call("ST_Intersects", F.col(geom), call("ST_MakePoint", F.col(x), F.col(y)))
    return own.join(cells, ["_i", "_j"]).where(hit).drop("_i", "_j", geom)


def windowed_counts(hits: DataFrame, ts: str = "ts", zone: str = "zone", width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Hits per zone and tumbling (or sliding) window, with a watermark for late data."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return hits.withWatermark(ts, late).groupBy(w.alias("w"), zone).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), zone, "n")


def session_counts(pings: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Visits per key: sessions that end after a gap."""
    return pings.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")
