"""Queueing zones of signalised junctions, and why other lanes have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.resolve import is_pedestrian_only, lane_keys, unique_lanes
from weftline.schemas import NO_OUTGOING_TEXT, NO_PROGRAM_TEXT, OUT_OF_RANGE_TEXT, SIGNAL_KINDS, SKIPPED_TEXT, NetworkFrames

NO_OUTGOING, NO_PROGRAM, OUT_OF_RANGE = "no_outgoing_connection", "no_resolvable_program", "link_index_out_of_range"


def signal_junctions(net: NetworkFrames) -> DataFrame:
    return net.junctions.where(F.col("kind").isin(SIGNAL_KINDS))


def vehicle_lanes(net: NetworkFrames) -> DataFrame:
    """Incoming lanes of signal junctions that aren't for pedestrians only; a lane that no edge has stays, with null length."""
    junctions = signal_junctions(net).select("net", "junction_pos", "junction_id", F.struct("x", "y", "z").alias("icon"))
    lanes = unique_lanes(net).select("net", "lane_id", "length_m", is_pedestrian_only(F.col("allow")).alias("pedestrian"))
    incoming = net.inc_lanes.join(junctions, ["junction_pos", "net"]).join(lanes, ["lane_id", "net"], "left")
    return incoming.where(~F.coalesce("pedestrian", F.lit(False))).drop("pedestrian")


def reason_of(n_ok: Column, first_oor: Column) -> Column:
    """Null for a lane that is grouped."""
    return F.when(n_ok.isNull(), NO_OUTGOING).when(n_ok > 0, None).when(first_oor.isNotNull(), OUT_OF_RANGE).otherwise(NO_PROGRAM)


def lane_reasons(net: NetworkFrames) -> DataFrame:
    """Each vehicle lane with its movement or the reason why it has none."""
    joined = vehicle_lanes(net).join(lane_keys(net), ["lane_id", "net"], "left")
    return joined.withColumn("reason", reason_of(F.col("n_ok"), F.col("first_oor")))


def reason_text(reason: Column, program: Column, link: Column) -> Column:
    out_of_range = F.format_string(OUT_OF_RANGE_TEXT, link, program)
    return F.when(reason == NO_OUTGOING, NO_OUTGOING_TEXT).when(reason == NO_PROGRAM, NO_PROGRAM_TEXT).when(reason == OUT_OF_RANGE, out_of_range)


def diagnostics_of(lanes: DataFrame) -> DataFrame:
    """net, junction_pos, inc_pos, junction_id, lane_id, reason, program, link_index, message of the lanes left out."""
    left_out = F.col("reason") == OUT_OF_RANGE
    rows = lanes.where(F.col("reason").isNotNull()).select(
        "net", "junction_pos", "inc_pos", "junction_id", "lane_id", "reason", F.when(left_out, F.col("first_oor.tl")).alias("program"), F.when(left_out, F.col("first_oor.link_index")).alias("link_index")
    )
    text = reason_text(F.col("reason"), F.col("program"), F.col("link_index"))
    return rows.withColumn("message", F.format_string(SKIPPED_TEXT, F.col("lane_id"), F.col("junction_id"), text))


def entry_position(length: Column, cap: float | None) -> Column:
    """Where the zone begins: the cap before the stop line if the lane is longer than the cap, else the lane's start. Comparisons with NaN don't hold."""
    if cap is None or cap != cap:
        return F.lit(0.0)
    return F.when((F.lit(float(cap)) < length) & ~F.isnan(length), length - F.lit(float(cap))).otherwise(F.lit(0.0))


def gate(lane: Column, position: Column) -> Column:
    return F.struct(lane.alias("lane"), position.alias("pos"), F.lit(False).alias("from_end"), F.lit(True).alias("friendly"))


def movement_id(edge: Column, dirs: Column) -> Column:
    return F.concat_ws("_", edge, F.array_join(F.transform(dirs, lambda d: d.label), "+"))


def zones_of(lanes: DataFrame, cap: float | None = None) -> DataFrame:
    """One row per network, junction and movement; grouped on the structured key, never on the id."""
    known = lanes.where(F.col("reason").isNull() & F.col("length_m").isNotNull())
    placed = F.array_sort(F.collect_list(F.struct("inc_pos", "lane_id", "length_m"))).alias("placed")
    groups = known.groupBy("junction_pos", "net", "junction_id", "icon", "from_edge", "dirs").agg(placed)
    return groups.select(
        "net",
        "junction_pos",
        "junction_id",
        "from_edge",
        F.transform("dirs", lambda d: d.ord).alias("dir_ords"),
        movement_id(F.col("from_edge"), F.col("dirs")).alias("zone_id"),
        F.transform("placed", lambda p: gate(p.lane_id, entry_position(p.length_m, cap))).alias("entries"),
        F.transform("placed", lambda p: gate(p.lane_id, p.length_m)).alias("exits"),
        "icon",
        *(F.lit(None).cast(t).alias(c) for c, t in (("period", "double"), ("name", "string"), ("speed_threshold", "double"), ("time_threshold", "double"), ("open_entry", "boolean"))),
    )


def generate(net: NetworkFrames, max_zone_length: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Zones and diagnostics of the networks."""
    lanes = lane_reasons(net)
    return zones_of(lanes, max_zone_length), diagnostics_of(lanes)
