"""From connections to what each lane's signals allow: lookups, range test, one row per lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.schemas import DIRECTION_LABELS, NetworkFrames


def dealt(frame: DataFrame, *keys: str) -> DataFrame:
    """frame dealt by its keys to as many tasks as spark.sql.shuffle.partitions says. Of a join or a window Spark would put small ones together, to about as many as there are cores: it goes by what is shuffled, compressed, and rows that are sorted several times in one task take many times that."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def last_wins(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one latest in the given order."""
    rest = [c for c in frame.columns if c not in keys]
    latest = frame.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return latest.select(*keys, *(F.col("row")[c].alias(c) for c in rest))


def first_wins(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one earliest in the given order."""
    rest = [c for c in frame.columns if c not in keys]
    earliest = frame.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return earliest.select(*keys, *(F.col("row")[c].alias(c) for c in rest))


def unique_lanes(net: NetworkFrames) -> DataFrame:
    return last_wins(net.lanes, ["lane_id", "net"], ["edge_pos", "lane_pos"])


def unique_programs(net: NetworkFrames) -> DataFrame:
    """net, tl, phases, min_len: the shortest state's length in code points, null without phases."""
    return first_wins(net.programs, ["net", "tl"], ["program_pos"]).withColumn("min_len", _shortest(F.col("phases")))


def _shortest(phases: Column) -> Column:
    return F.array_min(F.transform(phases, lambda p: F.length(p.state)))


def is_pedestrian_only(allow: Column) -> Column:
    return F.coalesce((F.size(allow) > 0) & F.forall(allow, lambda v: v == "pedestrian"), F.lit(False))


def in_range(link: Column, phases: Column) -> Column:
    """Whether every phase has a state for the link; true without phases, false for a negative link."""
    return (link >= 0) & F.forall(phases, lambda p: F.coalesce(F.length(p.state) > link, F.lit(False)))


def resolved_connections(net: NetworkFrames) -> DataFrame:
    """Connections with the lane they start from; those of no known lane drop out."""
    by_index = last_wins(net.lanes.select("net", "edge_id", "lane_index", "lane_id", "edge_pos", "lane_pos"), ["edge_id", "lane_index", "net"], ["edge_pos", "lane_pos"])
    by_index = by_index.select("net", F.col("edge_id").alias("from_edge"), F.col("lane_index").alias("from_lane"), "lane_id")
    return dealt(net.connections, "from_edge", "from_lane", "net").join(by_index, ["from_edge", "from_lane", "net"])


def connection_status(net: NetworkFrames) -> DataFrame:
    """Connections with status none (no signal that the file defines), ok, or oor (link index out of range).

    A connection without a signal, as very many are, is dealt by its lane, so that they
    don't meet in one task of the join; it finds nothing there."""
    lengths = net.programs.select("net", "tl", "program_pos", _shortest(F.col("phases")).alias("min_len"))
    programs = first_wins(lengths, ["tl", "net"], ["program_pos"]).select(F.col("net").alias("of"), F.col("tl").alias("program"), "min_len", F.lit(True).alias("known"))
    named = (F.coalesce("tl", "lane_id") == F.col("program")) & (F.col("net") == F.col("of")) & F.col("tl").isNotNull()
    joined = resolved_connections(net).join(programs, named, "left").drop("of", "program")
    link = F.col("link_index")
    fits = (link >= 0) & (F.col("min_len").isNull() | (link < F.col("min_len")))
    status = F.when(F.col("known").isNull() | link.isNull(), "none").when(fits, "ok").otherwise("oor")
    return joined.withColumn("status", status).drop("known")


def lane_keys(net: NetworkFrames) -> DataFrame:
    """One row per lane that has a connection: net, lane_id, from_edge, dirs, n_ok, first_oor.

    dirs: array of struct ord, label of the in-range connections, sorted, distinct.
    first_oor: struct tl, link_index of the first out-of-range one in file order."""
    ok, oor = F.col("status") == "ok", F.col("status") == "oor"
    label = F.get(F.array(*map(F.lit, DIRECTION_LABELS)), F.col("dir_ord"))
    return dealt(connection_status(net), "lane_id").groupBy("lane_id", "net").agg(
        F.min_by(F.when(ok, F.col("from_edge")), F.when(ok, F.col("conn_pos"))).alias("from_edge"),
        F.array_sort(F.collect_set(F.when(ok, F.struct(F.col("dir_ord").alias("ord"), label.alias("label"))))).alias("dirs"),
        F.sum(F.when(ok, 1).otherwise(0)).alias("n_ok"),
        F.min_by(F.when(oor, F.struct("tl", "link_index")), F.when(oor, F.col("conn_pos"))).alias("first_oor"),
    )
