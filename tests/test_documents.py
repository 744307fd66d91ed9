"""Detector files, map files and the command line, on one small town."""

import json
import math
import random
import struct
import subprocess
import sys
import xml.etree.ElementTree as ET
from decimal import Decimal
from pathlib import Path

import pytest
from networks import crossing, plan, street, town, turn
from pyspark.sql import functions as F

from weftline import cli, sinks
from weftline.functions.crs import ProjectionError, parse_proj, to_lon_lat
from weftline.functions.text import plain_number
from weftline.operators.features import UnknownLaneError, gate_pairs, lane_rectangles
from weftline.operators.zones import generate
from weftline.sources.network import read_network

PARTS = [
    street("ring", 90, 90, width=2.5, shapes=["100,50 190,50", "100,47 190,47"]),
    street("side", 35.75, width=4, shapes=["200,10 200,45.75"]),
    street("blind", 9),
    plan("lights", "GGr", "rrG"),
    crossing("north", "ring_0", "ring_1", "side_0", "blind_0", at=(201.25, -0.5)),
    turn("ring_0", "s", "lights", 0),
    turn("ring_1", "s", "lights", 1),
    turn("side_0", "l", "lights", 2),
]
PLACE = {"offset": "-390000,-5810000", "projection": "+proj=utm +zone=33 +ellps=GRS80 +units=m +no_defs"}


@pytest.fixture
def files(tmp_path):
    source = tmp_path / "town.net.xml"
    source.write_text(town(*PARTS, **PLACE))
    return source, tmp_path / "new" / "town.add.xml", tmp_path / "maps" / "town.json"


def test_numbers_are_plain(spark):
    pairs = {0.25: "0.25", -17.0: "-17", 0.0: "0", 2500.0: "2500", 3e9: "3000000000", 1e-4: "0.0001", 61.70000076293945: "61.70000076293945"}
    rows = spark.createDataFrame([(v,) for v in pairs], "v double").select("v", plain_number(F.col("v")).alias("t")).collect()
    assert {r["v"]: r["t"] for r in rows} == pairs


def test_numbers_come_back(spark):
    """Every finite double is read back as itself, in as few digits as it takes; signs of zero too."""
    rng = random.Random(7)
    values = [0.0, -0.0, 1e21, 1e-20, 1.2345678901234568e-05, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 2e23, 9007199254740993.0, 8.41e21, 1e22, 1e23, 123456789012345680.0]
    values += [v for v in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)) if math.isfinite(v)]
    values += [round(rng.uniform(-1e5, 1e5), rng.randrange(9)) for _ in range(1000)] + [float(f"{rng.randrange(1, 10**rng.randrange(1, 18))}e{rng.randrange(-320, 290)}") for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", plain_number(F.col("v")).alias("t")).collect()
    digits = lambda t: t.replace(".", "").strip("-0")
    for v, t in rows:
        assert float(t) == v and t.startswith("-") == (math.copysign(1, v) < 0) and not {*t} - {*"-.0123456789"}, (v, t)
        assert len(digits(t)) == len(digits(format(Decimal(repr(v)), "f"))) and (v == 0 or not t.endswith(".")) and not (("." in t) and t.endswith("0")), (v, t)


def test_detector_file(spark, files):
    source, out, _ = files
    cli.run(cli.Config(source, out, 40.0), spark)
    document = out.read_text()
    zones = list(ET.fromstring(document))
    assert [(z.tag, z.attrib) for z in zones] == [
        ("e3Detector", {"id": "ring_straight", "file": "detector_output/ring_straight.xml", "pos": "201.25,-0.5"}),
        ("e3Detector", {"id": "side_left", "file": "detector_output/side_left.xml", "pos": "201.25,-0.5"}),
    ]
    gates = lambda kind, *lanes: [(kind, {"lane": lane, "pos": pos, "friendlyPos": "true"}) for lane, pos in lanes]
    assert [(g.tag, g.attrib) for g in zones[0]] == gates("detEntry", ("ring_0", "50"), ("ring_1", "50")) + gates("detExit", ("ring_0", "90"), ("ring_1", "90"))
    assert [(g.tag, g.attrib) for g in zones[1]] == gates("detEntry", ("side_0", "0")) + gates("detExit", ("side_0", "35.75"))
    assert document.startswith("<?xml") and document.index(" id=") < document.index(" file=") < document.index(" pos=")
    assert [p.name for p in out.parent.iterdir()] == [out.name]  # nothing is left beside it


def test_a_town_without_signals(spark, tmp_path, files):
    source, out, geo = files
    source.write_text(town(street("lane", 5), **PLACE))
    cli.run(cli.Config(source, out, None, geo), spark)
    assert ET.parse(out).getroot().tag == "additional" and not len(ET.parse(out).getroot())
    assert json.loads(geo.read_text()) == {"type": "FeatureCollection", "features": []}


def test_map_file(spark, files):
    source, out, geo = files
    cli.run(cli.Config(source, out, 40.0, geo), spark)
    text = geo.read_text()
    ring, side = json.loads(text)["features"]
    assert text.count("\n") > 50 and [f["properties"]["waiting_zone_id"] for f in (ring, side)] == ["ring_straight", "side_left"]
    shapes = ring["geometry"]["coordinates"]
    assert ring["geometry"]["type"] == "MultiPolygon" and len(shapes) == 2 and all(len(polygon) == 1 for polygon in shapes)
    # about 1 m is 1.47e-5 degrees of longitude and 0.9e-5 of latitude there; the ring's zone is 40 m along x and 2.5 m wide
    for (corners,) in shapes:
        assert len(corners) == 5 and corners[0] == corners[-1]
        east, north = zip(*corners, strict=True)
        assert max(east) - min(east) == pytest.approx(40 * 1.47e-5, rel=0.1) and max(north) - min(north) == pytest.approx(2.5 * 0.9e-5, rel=0.6)
    (corners,) = side["geometry"]["coordinates"][0]
    assert max(p[1] for p in corners) - min(p[1] for p in corners) == pytest.approx(35.75 * 0.9e-5, rel=0.1)
    east, north = ring["properties"]["stop_line"]
    assert min(p[0] for (c,) in shapes for p in c) < east < max(p[0] for (c,) in shapes for p in c) + 1e-6 and 52.4 < north < 52.5


def test_failures_name_their_path_and_leave_nothing(spark, files):
    source, out, geo = files
    source.write_text(town(*PARTS))
    with pytest.raises(ProjectionError, match="not georeferenced"):
        cli.run(cli.Config(source, out, None, geo), spark)
    assert not out.exists() and not geo.exists()
    source.write_text(town(*PARTS, **PLACE))
    taken = source.parent / "taken"
    taken.write_text("a file, not a folder")
    for config in (cli.Config(source, taken / "x.xml"), cli.Config(source, out, None, taken / "x.json")):
        with pytest.raises(sinks.WriteError, match="failed to write '.*taken/x"):
            cli.run(config, spark)


@pytest.mark.parametrize("text", ["", "+proj=geos", "+proj=utm +zone=61", "+proj=utm", "+proj=tmerc +lon_0=east", "+proj=utm +zone=33 +ellps=round", "+proj=utm +zone=33 +units=ell", "+proj=tmerc +lon_0=9 +ellps=bessel +towgs84=598,74", "+proj=tmerc +nadgrids=conus", "+proj=lcc +lat_1=30 +lat_2=-30", "+proj=merc +axis=wsu"])
def test_projections_that_are_not_understood(text):
    with pytest.raises(ProjectionError, match="invalid or unsupported"):
        parse_proj(text)


def test_ways_to_write_a_meridian():
    assert parse_proj("+proj=tmerc +lon_0=9w +towgs84=0,0,0") == parse_proj("+proj=tmerc +lon_0=-9")
    assert parse_proj("+proj=tmerc +lon_0=10d30'E") == parse_proj("+proj=tmerc +lon_0=10.5")
    assert parse_proj("+proj=tmerc +lat_0=1d0'36S") == parse_proj("+proj=tmerc +lat_0=-1.01")


def test_ways_to_name_an_ellipsoid():
    assert parse_proj("+proj=utm +zone=33 +a=6378137 +rf=298.257223563") == parse_proj("+proj=utm +zone=33 +datum=WGS84") == parse_proj("+proj=utm +zone=33")
    assert parse_proj("+proj=merc +a=6378137 +b=6378137") == parse_proj("+proj=merc +R=6378137") != parse_proj("+proj=merc")
    assert parse_proj("+proj=tmerc +ellps=bessel").rf == pytest.approx(6377397.155 / (6377397.155 - 6356078.963), rel=1e-6)


@pytest.mark.parametrize(("projection", "e2"), [("+proj=merc +lon_0=7", 0.0066943799901413165), ("+proj=merc +R=6378137 +lon_0=7 +k=0.9 +x_0=500 +y_0=-80", 0.0), ("+proj=merc +lat_ts=40 +lon_0=7", 0.0066943799901413165)])
def test_mercator_comes_back(spark, projection, e2):
    """Points put on the plane by the closed formula, and back by the expressions."""
    p, points = parse_proj(projection), [(7.0, 0.0), (13.4, 52.5), (-70.2, -33.4), (179.0, 80.0)]

    def plane(lon, lat):
        s = math.sin(math.radians(lat))
        isometric = math.atanh(s) - math.sqrt(e2) * math.atanh(math.sqrt(e2) * s)
        return p.x0 + p.a * p.constants[0] * math.radians(lon - 7), p.y0 + p.a * p.constants[0] * isometric

    rows = spark.createDataFrame([(*q, *plane(*q)) for q in points], "lon double, lat double, x double, y double")
    found = rows.select("lon", "lat", to_lon_lat(p, 100.0, -50.0, F.col("x") + 100, F.col("y") - 50).alias("q")).collect()
    assert all(r["q"]["lon"] == pytest.approx(r["lon"], abs=1e-9) and r["q"]["lat"] == pytest.approx(r["lat"], abs=1e-8) for r in found)


def test_zones_of_lanes_that_went_away(spark, files):
    """A lane that isn't there fails a query; a document is thrown away, and the error names zone and lane."""
    source, out, geo = files
    frames = read_network(spark, str(source))
    zones = generate(frames)[0]
    fewer = frames.with_frames(lanes=frames.lanes.where("lane_id <> 'side_0'"))
    with pytest.raises(Exception, match='zone "side_left" references lane "side_0", which isn\'t in the network'):
        lane_rectangles(zones, fewer).collect()
    with pytest.raises(UnknownLaneError, match='zone "side_left" references lane "side_0"'):
        sinks.write_geojson(zones, fewer, geo)
    assert not geo.exists() and not geo.parent.exists()
    assert gate_pairs(zones).count() == 3 and gate_pairs(zones.withColumn("exits", F.slice("exits", 1, 1))).count() == 2


@pytest.mark.parametrize(("source", "expected"), [("town.net.xml", "town"), ("town.xml", "town"), ("old.town.xml", "old.town"), ("town", "town"), (".net.xml", "")])
def test_arguments(source, expected):
    assert cli.default_output(Path("maps") / source) == Path("maps") / f"{expected}.waiting-zones.add.xml"
    assert cli.parse_args([f"maps/{source}"]) == cli.Config(Path("maps") / source, Path(f"maps/{expected}.waiting-zones.add.xml"))
    assert cli.parse_args([source, "-o", "x.xml", "--max-zone-length", "7.25", "--geojson", "g"]) == cli.Config(Path(source), Path("x.xml"), 7.25, Path("g"))


def test_what_is_said(spark, files, capsys):
    source, out, geo = files
    cli.run(cli.Config(source, out, None, geo), spark)
    said = capsys.readouterr()
    assert said.err.splitlines() == ['warning: lane "blind_0" at junction "north" skipped: no outgoing connection in the network at all']
    assert said.out.splitlines() == [f"GeoJSON written successfully: {str(geo)!r}", f"Processing completed successfully: {str(out)!r}"]


def test_exit_code(spark, files, capsys):
    source, out, _ = files
    assert cli.main([str(source), "-o", str(out)]) == 0 and out.exists()
    assert cli.main([str(source.parent / "missing.net.xml")]) == 1
    assert "error:" in capsys.readouterr().err
    assert subprocess.run([sys.executable, "-m", "weftline.cli"], capture_output=True, cwd=Path(__file__).parent.parent).returncode == 2
