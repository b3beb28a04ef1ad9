"""Who listened where: how far each receiver hears, by direction and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updraft.functions.geo import bearing_deg, haversine_m
from updraft.sources.beacons import heard_by

SECTORS = 8


def heard_events(parsed: DataFrame, window_s: int = 3600) -> DataFrame:
    """Packets heard and receivers' own beacons: ``receiver, slot, ts_recv, own, lat, lon``.

    ``slot`` numbers the time windows. Position packets belong to the receiver that
    passed them on; beacons of receivers to themselves. Rows without receiver, time
    or place are left out.
    """
    own = F.col("kind") == "receiver"
    receiver = F.when(own, F.col("source_id")).when(F.col("kind") == "position", heard_by(F.col("raw")))
    slot = F.floor(F.unix_timestamp("ts_recv") / window_s)
    events = parsed.select(receiver.alias("receiver"), slot.alias("slot"), "ts_recv", own.alias("own"), "lat", "lon")
    return events.where("receiver <> '' AND slot IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def receiver_places(events: DataFrame) -> DataFrame:
    """Per receiver and slot with events the last place it had told before the slot, as ``before``.

    One row per receiver and slot goes through the window, whatever the traffic.
    """
    told = F.max(F.when(F.col("own"), F.struct("ts_recv", "lat", "lon")))
    slots = events.groupBy("receiver", "slot").agg(told.alias("_told"))
    earlier = W.partitionBy("receiver").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return slots.select("receiver", "slot", F.last("_told", ignorenulls=True).over(earlier).alias("before"))


def placed_receptions(events: DataFrame) -> DataFrame:
    """Packets heard with the receiver's latest own place at or before them: adds ``rx_lat, rx_lon``.

    An as-of join whose windows end with the slot, since the place told earlier is
    joined on: a busy receiver is spread over its slots. A beacon of the same time
    counts; of two at one time the northern, then the eastern. Both columns are null
    before the first beacon.
    """
    order = W.partitionBy("receiver", "slot").orderBy("ts_recv", F.desc("own"), "lat", "lon")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    told = F.last(F.when(F.col("own"), F.struct("ts_recv", "lat", "lon")), ignorenulls=True).over(so_far)
    here = events.withColumn("_told", told).where("NOT own").join(receiver_places(events), ["receiver", "slot"])
    place = F.coalesce("_told", "before")
    return here.select("receiver", "slot", "ts_recv", "lat", "lon", place["lat"].alias("rx_lat"), place["lon"].alias("rx_lon"))


def receiver_coverage(parsed: DataFrame, window_s: int = 3600, sectors: int = SECTORS) -> DataFrame:
    """Packets and farthest range per receiver, window and bearing sector.

    Every window in which a receiver was on the air, by a beacon or a packet, has all
    its sectors: 0 packets and range 0 say that it listened and heard nothing there,
    while a window without rows says that nobody listened. Packets from before a
    receiver's first beacon have no bearing; they are counted in a row whose sector and
    range are null.
    """
    events = heard_events(parsed, window_s)
    km = haversine_m(F.col("rx_lat"), F.col("rx_lon"), F.col("lat"), F.col("lon")) / 1000.0
    bearing = bearing_deg(F.col("rx_lat"), F.col("rx_lon"), F.col("lat"), F.col("lon"))
    sector = F.floor(bearing / F.lit(360.0 / sectors)).cast("int")
    # The distance to an unknown place is unknown; least() would make a number of it.
    heard = placed_receptions(events).withColumns({"sector": sector, "range_km": F.when(F.col("rx_lat").isNotNull(), km)})
    counted = heard.groupBy("receiver", "slot", "sector").agg(F.count("*").alias("packets"), F.max("range_km").alias("range_km"))
    on_air = events.select("receiver", "slot").distinct()
    full = on_air.select("receiver", "slot", F.explode(F.sequence(F.lit(0), F.lit(sectors - 1))).alias("sector"))
    known = full.join(counted.where("sector IS NOT NULL"), ["receiver", "slot", "sector"], "left")
    known = known.fillna(0, subset=["packets", "range_km"])
    rows = known.unionByName(counted.where("sector IS NULL"))
    return rows.select("receiver", (F.col("slot") * window_s).alias("window_start_s"), "sector", "packets", "range_km")
