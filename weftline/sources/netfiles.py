"""Networks written back as files, one for each, as rows of text that executors sort and stream out."""

from __future__ import annotations

from dataclasses import fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import plain_number
from weftline.schemas import DIRECTIONS, NetworkFrames

_HEAD, _LOCATION, _EDGES, _PROGRAMS, _JUNCTIONS, _CONNECTIONS, _TAIL = range(7)
_LAST = (1 << 31) - 1


#: What stands for a sign in a value; "&" comes first.
_ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\t": "&#9;", "\n": "&#10;", "\r": "&#13;"}


def _escaped(value: Column) -> Column:
    return reduce(lambda c, sign: F.replace(c, F.lit(sign), F.lit(_ENTITIES[sign])), _ENTITIES, value)


def _element(tag: str, **attributes: Column) -> Column:
    """An element without content; null attributes are left out. By functions of strings: for each row, to_xml sets up a writer of its own."""
    texts = (F.coalesce(F.concat(F.lit(f' {name}="'), _escaped(c), F.lit('"')), F.lit("")) for name, c in attributes.items())
    return F.concat(F.lit(f"<{tag}"), *texts, F.lit("/>"))


def _opened(element: Column) -> Column:
    return F.concat(F.substring(element, F.lit(1), F.length(element) - 2), F.lit(">"))


def _shape_text(shape: Column) -> Column:
    return F.array_join(F.transform(shape, lambda p: F.concat_ws(",", plain_number(p.x), plain_number(p.y), plain_number(p.z))), " ")


def network_lines(net: NetworkFrames) -> DataFrame:
    """net, section, first, second, line: the text of each network's file, in the order of the three numbers."""

    def lines(frame: DataFrame, section: int, line: Column, first: Column | None = None, second: Column | None = None) -> DataFrame:
        zero = F.lit(0)
        place = lambda c: (zero if c is None else c).cast("long")
        return frame.select("net", F.lit(section).alias("section"), place(first).alias("first"), place(second).alias("second"), line.alias("line"))

    col, text = F.col, (lambda c: F.col(c).cast("string"))
    nets = net.location.select("net")
    edges = net.lanes.select("net", "edge_pos", "edge_id").distinct()
    offset = F.concat_ws(",", plain_number(col("net_x")), plain_number(col("net_y")))
    lane = _element("lane", id=col("lane_id"), index=text("lane_index"), length=text("length_m"), width=text("width_m"), allow=F.nullif(F.array_join("allow", " "), F.lit("")), shape=_shape_text(col("shape")))
    states = F.array_join(F.transform("phases", lambda p: _element("phase", duration=p.duration.cast("string"), state=p.state)), "")
    incoming = net.inc_lanes.groupBy("net", "junction_pos").agg(F.array_sort(F.collect_list(F.struct("inc_pos", "lane_id"))).alias("inc"))  # the lanes into one junction
    junctions = net.junctions.join(incoming, ["net", "junction_pos"], "left")
    junction = _element("junction", id=col("junction_id"), type=col("kind"), x=text("x"), y=text("y"), z=text("z"), incLanes=F.array_join(F.transform("inc", lambda i: i.lane_id), " "))
    way = F.get(F.array(*(F.lit(code) for code, _ in DIRECTIONS)), col("dir_ord"))
    connection = _element("connection", **{"from": col("from_edge"), "fromLane": text("from_lane"), "tl": col("tl"), "linkIndex": text("link_index"), "dir": way})
    parts = [
        lines(nets, _HEAD, F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<net>')),
        lines(net.location, _LOCATION, _element("location", netOffset=offset, projParameter=F.coalesce("proj", F.lit("!")))),
        lines(edges, _EDGES, _opened(_element("edge", id=col("edge_id"))), col("edge_pos"), F.lit(-1)),
        lines(net.lanes, _EDGES, lane, col("edge_pos"), col("lane_pos")),
        lines(edges, _EDGES, F.lit("</edge>"), col("edge_pos"), F.lit(_LAST)),
        lines(net.programs, _PROGRAMS, F.concat(_opened(_element("tlLogic", id=col("tl"))), states, F.lit("</tlLogic>")), col("program_pos")),
        lines(junctions, _JUNCTIONS, junction, col("junction_pos")),
        lines(net.connections, _CONNECTIONS, connection, col("conn_pos")),
        lines(nets, _TAIL, F.lit("</net>")),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_networks(net: NetworkFrames, folder: str) -> None:
    """A file for each network, in a folder net=<its name>; a file is in order, and so it is written by one task, line by line."""
    order = ["net", "section", "first", "second"]
    network_lines(net).repartition("net").sortWithinPartitions(*order).select("net", F.col("line").alias("value")).write.partitionBy("net").text(folder)


def stage_networks(net: NetworkFrames, folder: str) -> NetworkFrames:
    """The tables as Parquet in a folder, to be read several times."""

    def stage(name: str) -> DataFrame:
        frame = getattr(net, name)
        frame.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/{name}")

    return NetworkFrames(**{f.name: stage(f.name) for f in fields(NetworkFrames)})


#: Connections of networks that are small enough to be taken all at once.
FEW = 2_000_000


def in_groups(net: NetworkFrames, few: int = FEW) -> list[NetworkFrames]:
    """The networks in groups, so that files and shuffles of one group at a time lie on disk: as many networks as there are cores, since each file is written by one task, or more if they have few connections in all."""
    names = sorted(r["net"] for r in net.location.select("net").collect())
    cores = net.location.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(-(-len(names) // cores), -(-net.connections.count() // few)))
    return [NetworkFrames(**{f.name: getattr(net, f.name).where(F.col("net").isin(names[k::groups])) for f in fields(NetworkFrames)}) for k in range(groups)]
