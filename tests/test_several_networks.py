"""Several networks read at once: their ids are their own, wherever they are the same; and what a run of the command line evaluates."""

import json
import re
import xml.etree.ElementTree as ET

import pytest
from networks import crossing, plan, street, town, turn
from pyspark.sql import functions as F

from weftline import cli, sinks
from weftline.functions.crs import ProjectionError
from weftline.operators.features import UnknownLaneError, in_lon_lat, zone_features, zone_shapes
from weftline.operators.zones import generate
from weftline.sources.network import read_network

PLACES = {
    "a": {"offset": "-390000,-5810000", "projection": "+proj=utm +zone=33 +ellps=GRS80"},
    "b": {"offset": "-700000,-6600000", "projection": "+proj=lcc +lat_1=49 +lat_2=44 +lat_0=46.5 +lon_0=3 +x_0=700000 +y_0=6600000 +ellps=GRS80"},
    "c": {"offset": "-3500000,-5800000", "projection": "+proj=tmerc +lon_0=9 +k=1 +x_0=3500000 +datum=potsdam"},
}
#: The same ids in each: streets of other lengths, signals with other phases, turns in other ways, a lane that only some have.
PARTS = {
    "a": [street("main", 100, 100, shapes=["0,0 100,0", "0,4 100,4"]), plan("s", "GGr"), crossing("x", "main_0", "main_1"), turn("main_0", "s", "s", 0), turn("main_1", "l", "s", 1)],
    "b": [street("main", 40, shapes=["0,0 40,0"]), plan("s", "G"), crossing("x", "main_0", "main_1", at=(7, 8)), turn("main_0", "l", "s", 0), turn("main_1", "s", "s", 3)],
    "c": [street("main", 60, 60, shapes=["0,0 60,0", "0,4 60,4"], allow="bus"), plan("s", "Gr", "rGG"), crossing("x", "main_1", "main_0"), turn("main_0", "s", "s", 2), turn("main_1", "s", "s", 1)],
}


@pytest.fixture
def folder(tmp_path):
    for name, parts in PARTS.items():
        (tmp_path / "nets").mkdir(exist_ok=True)
        (tmp_path / "nets" / f"{name}.net.xml").write_text(town(*parts, **PLACES[name]))
    return tmp_path / "nets"


def rows(frame):
    return sorted(map(repr, frame.collect()))


def test_a_folder_is_the_union_of_its_files(spark, folder):
    """Every table, zones, reports, shapes and map features."""
    every = read_network(spark, str(folder))
    single = {name: read_network(spark, str(folder / f"{name}.net.xml")) for name in PARTS}
    for table in ("location", "lanes", "junctions", "inc_lanes", "connections", "programs"):
        assert rows(getattr(every, table)) == sorted(x for n in single.values() for x in rows(getattr(n, table)))
    zones, left_out = generate(every, 30.0)
    alone = [generate(n, 30.0) for n in single.values()]
    assert rows(zones) == sorted(x for z, _ in alone for x in rows(z)) and rows(left_out) == sorted(x for _, d in alone for x in rows(d))
    found = {(r["net"].rsplit("/", 1)[1], r["zone_id"], tuple(g["lane"] for g in r["entries"]), tuple(g["pos"] for g in r["exits"])) for r in zones.collect()}
    assert found == {("a.net.xml", "main_straight", ("main_0",), (100.0,)), ("a.net.xml", "main_left", ("main_1",), (100.0,)), ("b.net.xml", "main_left", ("main_0",), (40.0,)), ("c.net.xml", "main_straight", ("main_1",), (60.0,))}
    assert {(r["net"].rsplit("/", 1)[1], r["lane_id"], r["reason"]) for r in left_out.collect()} == {("b.net.xml", "main_1", "no_outgoing_connection"), ("c.net.xml", "main_0", "link_index_out_of_range")}
    together = {(r["net"], r["zone_id"]): r for r in zone_features(zones, every).collect()}
    for name, network in single.items():
        for r in zone_features(generate(network, 30.0)[0], network).collect():
            other = together.pop((r["net"], r["zone_id"]))
            near = lambda p, q: all(abs(x - y) < 1e-12 for x, y in zip(p, q, strict=True))
            assert near(r["stop_line"], other["stop_line"]), name
            assert all(near(p, q) for one, two in zip(r["polygons"], other["polygons"], strict=True) for p, q in zip(one[0], two[0], strict=True))
    assert not together


def test_ids_hold_in_each_network_when_phases_turn(spark, folder):
    every = read_network(spark, str(folder))
    turned = every.with_frames(programs=every.programs.withColumn("phases", F.reverse("phases")))
    assert rows(generate(every)[0]) == rows(generate(turned)[0])


def test_places_of_networks(spark, folder):
    every = read_network(spark, str(folder))
    framed, there = in_lon_lat(zone_shapes(generate(every)[0], every), every)
    at = {r["net"].rsplit("/", 1)[1][0]: r["q"] for r in framed.select("net", there(F.col("stop_line")).alias("q")).collect()}
    assert (round(at["a"]["lon"]), round(at["b"]["lon"]), round(at["c"]["lon"])) == (13, 3, 9)
    bare = every.with_frames(location=every.location.withColumn("proj", F.when(F.col("net_x") != -390000, F.col("proj"))))
    with pytest.raises(ProjectionError, match="not georeferenced"):
        in_lon_lat(framed, bare)


def test_a_document_is_of_one_network(spark, folder, tmp_path, capsys):
    assert cli.main([str(folder), "-o", str(tmp_path / "out.xml")]) == 1
    assert "several networks" in capsys.readouterr().err and not (tmp_path / "out.xml").exists()


def test_names_that_need_escapes(spark, tmp_path):
    """Signs that XML and JSON write otherwise come back as they were; documents are joined from several files."""
    names = ['a&amp;b', "q&quot;&lt;r&gt;", "é\U0001f6a6", "back\\slash"]
    parts = [street(n, 30 + k, shapes=["1,1 31,1"]) for k, n in enumerate(names)] + [plan("s", "G"), crossing("x", *(f"{n}_0" for n in names))] + [turn(f"{n}_0", "s", "s", 0) for n in names]
    source, out, geo = tmp_path / "t.net.xml", tmp_path / "t.add.xml", tmp_path / "t.json"
    source.write_text(town(*parts, **PLACES["a"]), encoding="utf-8")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cli.run(cli.Config(source, out, None, geo), spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = ["a&b_straight", "back\\slash_straight", 'q"<r>_straight', "é\U0001f6a6_straight"]
    assert [z.attrib["id"] for z in ET.parse(out).getroot()] == want
    assert [f["properties"]["waiting_zone_id"] for f in json.loads(geo.read_text(encoding="utf-8"))["features"]] == want


def test_documents_in_many_parts(spark, tmp_path):
    """Hundreds of zones, in order, whatever files they were staged in."""
    n = 300
    parts = [street(f"s{k}", 20 + k, shapes=[f"{k},0 {k},{20 + k}"]) for k in range(n)] + [plan("s", "G")] + [crossing(f"x{k}", f"s{k}_0") for k in range(n)] + [turn(f"s{k}_0", "s", "s", 0) for k in range(n)]
    source, out, geo = tmp_path / "t.net.xml", tmp_path / "t.add.xml", tmp_path / "t.json"
    source.write_text(town(*parts, **PLACES["a"]))
    network = read_network(spark, str(source))
    zones = generate(network)[0]
    sinks.write_detectors(zones, out)
    sinks.write_geojson(zones, network, geo)
    assert [z.attrib["id"] for z in ET.parse(out).getroot()] == [f["properties"]["waiting_zone_id"] for f in json.loads(geo.read_text())["features"]] == [f"s{k}_straight" for k in range(n)]
    lines = out.read_text().split("\n")
    assert lines[2] == '    <e3Detector id="s0_straight" file="detector_output/s0_straight.xml" pos="0,0">' and lines[3].startswith("        <detEntry ") and lines[-2:] == ["</additional>", ""]
    assert re.match(r'\{\n  "type": "FeatureCollection",\n  "features": \[\n    \{\n      "type": "Feature",\n      "geometry": \{\n        "type": "MultiPolygon",\n        "coordinates": \[\n          \[\n            \[\n              \[\n                1\d\.\d+,\n', geo.read_text())
    with pytest.raises(UnknownLaneError, match='zone "s7_straight" references lane "s7_0"'):
        sinks.write_geojson(zones, network.with_frames(lanes=network.lanes.where("lane_id NOT IN ('s7_0', 's9_0')")), tmp_path / "gone.json")
    assert not (tmp_path / "gone.json").exists()


def test_a_run_joins_lanes_and_connections_once(spark, folder, tmp_path):
    """Of all the plans that a run executes, one reads the connections; zones, messages and both documents come from what it stages."""
    listing = spark._jvm.org.apache.spark.sql.execution.ui
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    cli.run(cli.Config(folder / "a.net.xml", tmp_path / "a.add.xml", 30.0, tmp_path / "a.json"), spark)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [store.executionsList().apply(k).physicalPlanDescription() for k in range(before, store.executionsCount())]
    assert listing is not None and len(plans) >= 4
    assert sum("conn_pos" in p for p in plans) == 1 and sum("link_index" in p or "linkIndex" in p for p in plans) >= 1
