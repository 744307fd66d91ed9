"""A road network laid over the driver's star-schema tables, so that every operator runs on them.

customer: edges, leading into the junction of their nation.  orders: lanes, some of
which the junctions and connections name but no edge has.  lineitem: connections.
supplier: signal programs.  nation: junctions.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.resolve import dealt
from weftline.schemas import DEFAULT_LANE_WIDTH_M, NetworkFrames

#: Nations of the tables, at any scale.
NATIONS = 25
KINDS = ["traffic_light", "priority", "traffic_light_unregulated", "traffic_light_right_on_red", "rail_signal"]
#: UTM zone 33 north on GRS80, with the offset of a city on the Spree.
PROJECTION, NET_X, NET_Y = "+proj=utm +zone=33 +ellps=GRS80 +units=m +no_defs", -390000.0, -5810000.0
#: The western one of two networks: a conformal cone over the middle of Europe.
WEST_PROJECTION, WEST_X, WEST_Y, WEST_LONGER = "+proj=lcc +lat_1=35 +lat_2=65 +lat_0=52 +lon_0=10 +x_0=4000000 +y_0=2800000 +ellps=GRS80 +units=m", -3600000.0, -2500000.0, 25.0


def star_network(spark: SparkSession, sf_dir: str) -> NetworkFrames:
    """One network, named star."""
    named = _star_tables(spark, sf_dir)
    return NetworkFrames(**{f.name: getattr(named, f.name).withColumn("net", F.lit("star")) for f in fields(NetworkFrames)})


def star_networks(spark: SparkSession, sf_dir: str) -> NetworkFrames:
    """Two networks, east and west, with the same ids throughout. In the west lanes are WEST_LONGER metres longer, phases a state shorter and turns straight on missing, and the place is another one."""
    star = _star_tables(spark, sf_dir)
    longer = F.col("length_m") + WEST_LONGER
    fewer = F.transform("phases", lambda p: F.struct(p.duration.alias("duration"), F.substring(p.state, F.lit(1), F.length(p.state) - 1).alias("state")))
    west = star.with_frames(
        location=spark.range(1).select(F.lit(WEST_X).alias("net_x"), F.lit(WEST_Y).alias("net_y"), F.lit(WEST_PROJECTION).alias("proj")),
        lanes=star.lanes.withColumn("length_m", longer),
        connections=star.connections.where("dir_ord <> 0"),
        programs=star.programs.withColumn("phases", fewer),
    )
    both = lambda name: getattr(star, name).withColumn("net", F.lit("east")).unionByName(getattr(west, name).withColumn("net", F.lit("west")))
    return NetworkFrames(**{f.name: both(f.name) for f in fields(NetworkFrames)})


def _star_tables(spark: SparkSession, sf_dir: str, cities: DataFrame | None = None) -> NetworkFrames:
    """The tables without networks. cities (c_custkey, net): lanes, connections and incoming lanes have the network of their street, and a street leads into the junction of its own number. Lanes meet it where they are counted, so that nothing is dealt again for it."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = lambda c: F.col(c).cast("string")
    customers = table("customer").select("c_custkey", "c_nationkey")
    orders = table("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    lanes = dealt(orders, "o_custkey").withColumn("lane_index", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    net = [] if cities is None else ["net"]
    if cities is not None:
        lanes = lanes.join(cities, F.col("o_custkey") == F.col("c_custkey"))
    incoming = lanes.withColumn("c_nationkey", F.col("o_custkey")) if net else orders.select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    items = table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    ordered = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    of_lane = lanes.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "lane_index", *net)
    connections = dealt(items, "l_orderkey").withColumn("conn_pos", F.row_number().over(ordered)).join(of_lane, "l_orderkey")
    suppliers = table("supplier").where("s_suppkey % 5 <> 0").select("s_suppkey", F.col("s_nationkey").cast("long").alias("n"))
    programs = suppliers.withColumn("program_pos", F.explode(F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    state = lambda i: F.repeat(F.lit("G"), (4 + (F.col("s_suppkey") + i + 3 * F.col("program_pos")) % 8).cast("int"))
    phases = F.transform(F.sequence(F.lit(0).cast("long"), 1 + F.col("n") % 3), lambda i: F.struct(F.lit(30.0).alias("duration"), state(i).alias("state")))
    no_phases = F.array().cast("array<struct<duration:double,state:string>>")
    key = F.col("o_orderkey")
    return NetworkFrames(
        location=spark.range(1).select(F.lit(NET_X).alias("net_x"), F.lit(NET_Y).alias("net_y"), F.lit(PROJECTION).alias("proj")),
        lanes=lanes.where("o_orderkey % 13 <> 5").select(
            *net,
            F.col("o_custkey").alias("edge_pos"),
            F.col("lane_index").alias("lane_pos"),
            text("o_custkey").alias("edge_id"),
            text("o_orderkey").alias("lane_id"),
            "lane_index",
            length_of(F.col("o_totalprice")).alias("length_m"),
            F.when(key % 3 == 0, DEFAULT_LANE_WIDTH_M).when(key % 3 == 1, 2.75).otherwise(4.0).alias("width_m"),
            F.when(F.col("o_orderstatus") == "P", F.array(F.lit("pedestrian"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("passenger"), F.lit("pedestrian"))).otherwise(F.array().cast("array<string>")).alias("allow"),
            shape_of(key, length_of(F.col("o_totalprice"))).alias("shape"),
        ),
        junctions=table("nation").select(
            F.col("n_nationkey").alias("junction_pos"),
            text("n_nationkey").alias("junction_id"),
            F.get(F.array(*map(F.lit, KINDS)), F.col("n_regionkey")).alias("kind"),
            (F.col("n_nationkey") * 100.0).alias("x"),
            (F.col("n_nationkey") * -50.0).alias("y"),
            F.lit(0.0).alias("z"),
        ),
        inc_lanes=incoming.select(*net, F.col("c_nationkey").alias("junction_pos"), key.alias("inc_pos"), text("o_orderkey").alias("lane_id")),
        connections=connections.select(
            *net,
            "conn_pos",
            text("o_custkey").alias("from_edge"),
            F.col("lane_index").alias("from_lane"),
            (F.col("l_linenumber") - 1).alias("dir_ord"),
            F.when(F.col("l_returnflag") != "N", text("l_suppkey")).alias("tl"),
            (F.col("l_quantity").cast("int") % 12 - 1).alias("link_index"),
        ),
        programs=programs.select("program_pos", text("s_suppkey").alias("tl"), F.when(F.col("s_suppkey") % 17 == 1, no_phases).otherwise(phases).alias("phases")),
    )


def city_networks(spark: SparkSession, sf_dir: str) -> NetworkFrames:
    """A network for each nation: the streets of its customers, each with a junction of its own at the end, and all signals."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").cast("string").alias("net"))
    star = _star_tables(spark, sf_dir, customers)
    nets = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("net"))
    key = F.col("c_custkey")
    # places in a file: one order for all programs, and for all connections
    programs = star.programs.withColumn("program_pos", F.col("tl").cast("long") * 2 + F.col("program_pos"))
    conn_pos = F.col("from_edge").cast("long") * 4096 + F.col("from_lane").cast("long") * 16 + F.col("conn_pos")
    return NetworkFrames(
        location=nets.select("net", F.lit(NET_X).alias("net_x"), F.lit(NET_Y).alias("net_y"), F.lit(PROJECTION).alias("proj")),
        lanes=star.lanes,
        junctions=customers.select("net", key.alias("junction_pos"), F.concat(F.lit("J"), key.cast("string")).alias("junction_id"), F.get(F.array(*map(F.lit, KINDS)), (key % 5).cast("int")).alias("kind"), (key * 2.5).alias("x"), (key * -0.5).alias("y"), F.lit(0.0).alias("z")),
        inc_lanes=star.inc_lanes,
        connections=star.connections.withColumn("conn_pos", conn_pos),
        programs=programs.withColumn("net", F.explode(F.array(*(F.lit(str(k)) for k in range(NATIONS))))),
    )


def length_of(price):
    """Lane length in whole quarters of a metre, which both engines hold exactly."""
    return F.floor(price / 250) / 4.0


def shape_of(key, length):
    """A bend: along x, then along y. Every seventh lane repeats its first vertex, every fifth is drawn shorter than its length says."""
    along = F.when(key % 7 == 0, 0.0).otherwise(F.floor(length) / 2)
    up = F.when(key % 5 == 0, F.floor(length) / 4).otherwise(length - along)
    x0, y0 = (key % 1000).cast("double"), ((key * 7) % 1000).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))
    return F.array(point(x0, y0), point(x0 + along, y0), point(x0 + along, y0 + up))


def repeated_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes with repeated ids, which the orders don't have: order lines of one order and number."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return items.select("l_orderkey", "l_linenumber", F.row_number().over(order).alias("lane_pos"), "l_partkey", "l_quantity")
