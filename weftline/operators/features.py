"""Zones as map features: one rectangle per lane, and the mean stop line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftline.functions.crs import Projection, ProjectionError, parse_proj, to_lon_lat, to_lon_lat_by
from weftline.functions.expressions import let
from weftline.functions.geometry import centroid, distance_from_start, point_and_tangent, rectangle
from weftline.operators.resolve import unique_lanes
from weftline.schemas import NetworkFrames

#: A zone of a network, in the order of documents.
ZONE = ["net", "junction_pos", "from_edge", "dir_ords"]
UNKNOWN_LANE_TEXT = 'zone "%s" references lane "%s", which isn\'t in the network'
#: Different projections that the driver takes at most, and networks whose places are broadcast.
MOST_PROJECTIONS, MOST_BROADCAST = 10_000, 10_000


class UnknownLaneError(ValueError):
    """A zone refers to a lane that the network doesn't have."""


def gate_pairs(zones: DataFrame) -> DataFrame:
    """Entries and exits side by side, as far as both go; what is left over of the longer list is ignored."""
    n = F.least(F.size("entries"), F.size("exits"))
    both = F.arrays_zip(F.slice("entries", 1, n).alias("entry"), F.slice("exits", 1, n).alias("exit"))
    return zones.select(*ZONE, "zone_id", F.posexplode(both).alias("gate_pos", "g")).select("*", F.col("g")["entry"].alias("entry"), F.col("g")["exit"].alias("exit")).drop("g")


def check_observed(seen: Observation) -> None:
    """The error of the first lane that was missing when what `seen` watched was evaluated, if one was."""
    first = seen.get.get("first_missing")
    if first is not None:
        raise UnknownLaneError(UNKNOWN_LANE_TEXT % (first["zone_id"], first["lane_id"]))


def lane_rectangles(zones: DataFrame, net: NetworkFrames, seen: Observation | None = None) -> DataFrame:
    """Per gate: its lane's rectangle (ring of points) and stop point, in network coordinates.

    Every gate's lane must exist.  A missing one fails the query where its rectangle is
    made; with `seen` it is observed instead, to be asked for after the action
    (check_observed), and its gate has a null ring.  Either way zones and lanes are
    evaluated once."""
    lanes = unique_lanes(net).select("net", "lane_id", "length_m", "width_m", "shape", F.lit(True).alias("known"))
    pairs = gate_pairs(zones).withColumn("lane_id", F.col("entry.lane")).join(lanes, ["net", "lane_id"], "left")
    missing = F.col("known").isNull()
    if seen is not None:
        where = F.struct("net", "junction_pos", "gate_pos", "zone_id", "lane_id")
        pairs = pairs.observe(seen, F.count(F.when(missing, 1)).alias("n_missing"), F.min(F.when(missing, where)).alias("first_missing"))
    at = lambda side: point_and_tangent(F.col("shape"), distance_from_start(F.col(f"{side}.pos"), F.col(f"{side}.from_end"), F.col("length_m")))
    ends = let(F.struct(at("entry").alias("entry"), at("exit").alias("exit")), lambda e: F.struct(rectangle(e["entry"], e["exit"], F.col("width_m")).alias("ring"), F.struct(*(e["exit"][c].alias(c) for c in "xyz")).alias("stop")))
    pairs = pairs.withColumn("drawn", ends)
    instead = F.raise_error(F.format_string(UNKNOWN_LANE_TEXT, F.col("zone_id"), F.col("lane_id"))) if seen is None else F.lit(None)
    return pairs.select(*ZONE, "zone_id", "gate_pos", "lane_id", F.when(missing, instead.cast("array<struct<x:double,y:double,z:double>>")).otherwise(F.col("drawn.ring")).alias("ring"), F.col("drawn.stop").alias("stop"))


def zone_shapes(zones: DataFrame, net: NetworkFrames, seen: Observation | None = None) -> DataFrame:
    """Per zone: rings in gate order and the mean of the lanes' stop points, in network coordinates."""
    gates = lane_rectangles(zones, net, seen)
    ordered = F.array_sort(F.collect_list(F.struct("gate_pos", "ring", "stop"))).alias("gates")
    grouped = gates.groupBy(*ZONE, "zone_id").agg(ordered)
    return grouped.select(*ZONE, "zone_id", F.transform("gates", lambda g: g.ring).alias("rings"), centroid(F.transform("gates", lambda g: g.stop)).alias("stop_line"))


def _projections(location: DataFrame) -> tuple[int, dict[str, Projection]]:
    """How many networks there are, and their different projections. Fails on a network without one, or on one that isn't supported."""
    n = location.count()
    texts = [r["proj"] for r in location.select("proj").distinct().limit(MOST_PROJECTIONS + 1).collect()]
    if len(texts) > MOST_PROJECTIONS:
        raise ProjectionError(f"more than {MOST_PROJECTIONS} different projections")
    if not n or None in texts:
        parse_proj(None)
    return n, {text: parse_proj(text) for text in texts}


def in_lon_lat(frame: DataFrame, net: NetworkFrames) -> tuple[DataFrame, object]:
    """frame (with net), and a function from its point columns, in coordinates of their networks, to struct lon, lat.

    One network's projection becomes literals; of several, each row's is looked up by
    net, its numbers in an array."""
    n, projections = _projections(net.location)
    if n == 1:
        place, (projection,) = net.location.first(), projections.values()
        return frame, lambda p: to_lon_lat(projection, place["net_x"], place["net_y"], p.x, p.y)
    known = frame.sparkSession.createDataFrame([(text, p.kind, bool(p.shift), list(p.numbers)) for text, p in projections.items()], "proj string, kind string, shifted boolean, numbers array<double>")
    places = net.location.join(F.broadcast(known), "proj").select("net", F.struct("kind", "shifted", "numbers", "net_x", "net_y").alias("place"))
    placed = frame.join(F.broadcast(places) if n <= MOST_BROADCAST else places, "net")
    kinds = {(p.kind, bool(p.shift)) for p in projections.values()}
    return placed, lambda p: to_lon_lat_by(kinds, F.col("place"), p.x, p.y)


def zone_features(zones: DataFrame, net: NetworkFrames, digits: int | None = None, seen: Observation | None = None) -> DataFrame:
    """Per zone: polygons (arrays of [lon, lat]) and stop line, rounded to so many digits if given. Fails at once on a network without a supported projection; on an unknown lane see lane_rectangles."""
    shapes, there = in_lon_lat(zone_shapes(zones, net, seen), net)

    def position(p: Column) -> Column:
        kept = (lambda d: d) if digits is None else (lambda d: F.round(d, digits))
        return F.get(F.transform(F.array(there(p)), lambda q: F.array(kept(q.lon), kept(q.lat))), 0)

    polygons = F.transform("rings", lambda ring: F.array(F.transform(ring, position)))
    return shapes.select(*ZONE, "zone_id", polygons.alias("polygons"), position(F.col("stop_line")).alias("stop_line"))
