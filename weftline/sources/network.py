"""Network files as tables, read in one of two ways that give the same rows.

read_network takes a file as one row of nested arrays: places in it are known at
once, but a task holds a whole file.

read_large_network takes a file as a stream of tags, cut at every "<" and read by
as many tasks as it has splits.  A sign "<" stands in no value, so that each piece
is one tag.  A tag's place is rebuilt from where its split begins, its place within
the split, and how many tags of its kind the splits before hold; a lane belongs
to the edge that was opened last, a phase to the program.  Comments are recognised
by counting where they begin and end.  CDATA sections aren't read this way, and are an
error; text between tags is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.schemas import CONNECTION, DEFAULT_LANE_WIDTH_M, DIRECTIONS, EDGE, JUNCTION, LANE, LOCATION, NET, PHASE, PROGRAM, NetworkFrames


def tokens(column: Column) -> Column:
    """Blank-separated tokens; none for a missing or empty attribute."""
    return F.filter(F.split(F.coalesce(column, F.lit("")), r"\s+"), lambda t: t != "")


def shape_of(column: Column) -> Column:
    """Points "x,y[,z] x,y ..." as structs."""

    def point(token):
        parts = F.split(token, ",")
        return F.struct(F.get(parts, 0).cast("double").alias("x"), F.get(parts, 1).cast("double").alias("y"), F.coalesce(F.get(parts, 2).cast("double"), F.lit(0.0)).alias("z"))

    return F.transform(tokens(column), point)


def direction_ordinal(code: Column) -> Column:
    """Place of a turn code in the listing order; an unknown code is an error, a missing one null."""
    known = F.array_position(F.array(*(F.lit(c) for c, _ in DIRECTIONS)), code) - 1
    return F.when(known < 0, F.raise_error(F.concat(F.lit("unknown turn code: "), code)).cast("int")).otherwise(known.cast("int"))


def scan_network(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, so that places in it are known; what is unnested is dealt out again by Spark's joins. A folder or pattern gives a row for each of its files, named by its path."""
    rows = spark.read.format("xml").option("rowTag", "net").option("mode", "FAILFAST").schema(NET).load(path)
    return rows.select("location", "edge", "tlLogic", "junction", "connection", F.col("_metadata.file_path").alias("net"))


def read_network(spark: SparkSession, path: str) -> NetworkFrames:
    """Tables of the network files at a path: one file, a folder, or a pattern. Callers that use several of them may persist the scan (scan_network, frames_of)."""
    return frames_of(scan_network(spark, path))


def frames_of(net: DataFrame) -> NetworkFrames:
    edges = net.select("net", F.posexplode("edge").alias("edge_pos", "e"))
    return _frames(
        location=net.select("net", F.col("location").alias("o")),
        lanes=edges.select("net", "edge_pos", F.col("e._id").alias("edge_id"), F.posexplode("e.lane").alias("lane_pos", "l")),
        junctions=net.select("net", F.posexplode("junction").alias("junction_pos", "j")),
        connections=net.select("net", F.posexplode("connection").alias("conn_pos", "c")),
        programs=net.select("net", F.posexplode("tlLogic").alias("program_pos", "t")).select("net", "program_pos", F.col("t._id").alias("tl"), F.col("t.phase").alias("phase")),
    )


def _frames(location: DataFrame, lanes: DataFrame, junctions: DataFrame, connections: DataFrame, programs: DataFrame) -> NetworkFrames:
    """The tables from elements with their places: location o, lanes l, junctions j and connections c as structs of attributes, programs with their phases."""
    offset = F.split(F.col("o._netOffset"), ",")
    return NetworkFrames(
        location=location.select("net", F.get(offset, 0).cast("double").alias("net_x"), F.get(offset, 1).cast("double").alias("net_y"), F.nullif(F.col("o._projParameter"), F.lit("!")).alias("proj")),
        lanes=lanes.select(
            "net",
            "edge_pos",
            "lane_pos",
            "edge_id",
            F.col("l._id").alias("lane_id"),
            F.col("l._index").alias("lane_index"),
            F.col("l._length").alias("length_m"),
            F.coalesce("l._width", F.lit(DEFAULT_LANE_WIDTH_M)).alias("width_m"),
            tokens(F.col("l._allow")).alias("allow"),
            shape_of(F.col("l._shape")).alias("shape"),
        ),
        junctions=junctions.select("net", "junction_pos", F.col("j._id").alias("junction_id"), F.col("j._type").alias("kind"), *(F.coalesce(f"j._{c}", F.lit(0.0)).alias(c) for c in "xyz")),
        inc_lanes=junctions.select("net", "junction_pos", F.posexplode(tokens(F.col("j._incLanes"))).alias("inc_pos", "lane_id")),
        connections=connections.select(
            "net",
            "conn_pos",
            F.col("c._from").alias("from_edge"),
            F.col("c._fromLane").alias("from_lane"),
            direction_ordinal(F.col("c._dir")).alias("dir_ord"),
            F.col("c._tl").alias("tl"),
            F.col("c._linkIndex").alias("link_index"),
        ),
        programs=programs.select(
            "net",
            "program_pos",
            "tl",
            F.transform(F.coalesce("phase", F.array().cast("array<struct<_duration:double,_state:string>>")), lambda p: F.struct(p["_duration"].alias("duration"), p["_state"].alias("state"))).alias("phases"),
        ),
    )


_KINDS = {"edge": EDGE, "lane": LANE, "junction": JUNCTION, "connection": CONNECTION, "tlLogic": PROGRAM, "phase": PHASE, "location": LOCATION}
_SPLIT = ["net", "block"]
_BLANKS = " \t\n\x0b\f\r"


def scan_splits(spark: SparkSession, path: str) -> DataFrame:
    """net, block, at, kind, in_<kind>, and <kind>: of every tag that is read, where its split begins, its place there, how many of each kind stand before it in the split, and its attributes in the column of its kind.

    What is staged of it is read and parsed once; placed_tags takes it from there."""
    pieces = spark.read.option("lineSep", "<").text(path).select(F.col("_metadata.file_path").alias("net"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    value, known = F.col("value"), F.col("kind").isNotNull()
    step = F.startswith(value, F.lit("!--")).cast("int") - F.contains(value, F.lit("-->")).cast("int")
    kind = F.when(F.startswith(value, F.lit("![CDATA[")), F.raise_error("CDATA sections are read by read_network only").cast("string"))
    for k in _KINDS:
        kind = kind.when(F.startswith(value, F.lit(k)) & F.substring(value, len(k) + 1, 1).isin([*_BLANKS, "/", ">"]), k)
    tags = pieces.select("*", kind.alias("kind"), step.alias("step"))
    steps = _before(pieces.groupBy(*_SPLIT).agg(F.sum(step).alias("step")), ["step"])
    so_far = Window.partitionBy(*_SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counted = tags.where(known | (F.col("step") != 0)).withColumn("in_step", F.coalesce(F.sum("step").over(so_far), F.lit(0)))
    own = counted.join(F.broadcast(steps), _SPLIT).where((F.col("in_step") + F.col("before_step") == 0) & known)
    running = own.select(*_SPLIT, "at", "kind", "value", *(F.coalesce(F.sum((F.col("kind") == k).cast("long")).over(so_far), F.lit(0)).alias(f"in_{k}") for k in _KINDS))
    return running.select(*_SPLIT, "at", "kind", *(f"in_{k}" for k in _KINDS), *(F.when(F.col("kind") == k, _attributes(value, schema)).alias(k) for k, schema in _KINDS.items()))


def placed_tags(splits: DataFrame) -> DataFrame:
    """net, block, at, kind, n_<kind>, and <kind>: the tags of scan_splits with how many of each kind stand before them in their file."""
    sums = splits.groupBy(*_SPLIT).agg(*(F.sum((F.col("kind") == k).cast("long")).alias(k) for k in _KINDS))
    return splits.join(F.broadcast(_before(sums, list(_KINDS), "splits_before_")), _SPLIT).select(*_SPLIT, "at", "kind", *((F.col(f"in_{k}") + F.col(f"splits_before_{k}")).alias(f"n_{k}") for k in _KINDS), *_KINDS)


def scan_tags(spark: SparkSession, path: str) -> DataFrame:
    """The tags of the files at a path with their places (placed_tags). Callers that use several tables of it may persist it (tables_of_tags)."""
    return placed_tags(scan_splits(spark, path))


def _before(sums: DataFrame, names: list[str], prefix: str = "before_") -> DataFrame:
    """For each split, a row with what the splits before it in its file add up to; there are as many as a file has splits."""
    earlier = Window.partitionBy("net").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*_SPLIT, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{prefix}{n}") for n in names))


def _attributes(tag: Column, schema: str) -> Column:
    """A tag's attributes, of an opening tag or an element without content."""
    whole = F.rtrim(tag, F.lit(_BLANKS))
    opened = F.when(F.endswith(whole, F.lit(">")), F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    element = F.when(F.endswith(whole, F.lit("/>")), F.concat(F.lit("<"), whole)).otherwise(F.concat(F.lit("<"), opened, F.lit("/>")))
    return F.from_xml(element, schema, {"mode": "FAILFAST"})


def tables_of_tags(tags: DataFrame) -> NetworkFrames:
    def every(kind: str, *columns: Column) -> DataFrame:
        return tags.where(F.col("kind") == kind).select("net", *columns)

    def number(kind: str, outer: int = 0) -> Column:
        """How many of a kind stand before; with outer 1, the number of the one that was opened last."""
        return F.col(f"n_{kind}") - outer

    place = lambda kind, outer=0: number(kind, outer).cast("int")
    edges = every("edge", place("edge").alias("edge_pos"), number("lane").alias("first"), F.col("edge._id").alias("edge_id"))
    lanes = every("lane", place("edge", 1).alias("edge_pos"), number("lane").alias("number"), F.col("lane").alias("l")).join(edges, ["edge_pos", "net"])
    phases = every("phase", place("tlLogic", 1).alias("program_pos"), number("phase").alias("number"), F.col("phase").alias("x"))
    phases = phases.groupBy("program_pos", "net").agg(F.array_sort(F.collect_list(F.struct("number", "x"))).alias("p"))
    programs = every("tlLogic", place("tlLogic").alias("program_pos"), F.col("tlLogic._id").alias("tl"))
    return _frames(
        location=tags.select("net").distinct().join(every("location", F.col("location").alias("o")), "net", "left").select("net", "o"),  # a network without one is told, not lost
        lanes=lanes.select("net", "edge_pos", "edge_id", (F.col("number") - F.col("first")).cast("int").alias("lane_pos"), "l"),
        junctions=every("junction", place("junction").alias("junction_pos"), F.col("junction").alias("j")),
        connections=every("connection", place("connection").alias("conn_pos"), F.col("connection").alias("c")),
        programs=programs.join(phases, ["program_pos", "net"], "left").select("net", "program_pos", "tl", F.transform("p", lambda q: q.x).alias("phase")),
    )


def read_large_network(spark: SparkSession, path: str) -> NetworkFrames:
    """Tables of the network files at a path, each file read by as many tasks as it has splits."""
    return tables_of_tags(scan_tags(spark, path))
