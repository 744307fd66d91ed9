"""Points on drawn lanes, lane rectangles, and the way from the plane to longitude and latitude."""

import math

import pytest
from pyspark.sql import functions as F

from weftline.functions.crs import ELLIPSOIDS, parse_proj, to_lon_lat
from weftline.functions.geometry import centroid, distance_from_start, point_and_tangent, rectangle

POINT = "array<struct<x:double,y:double,z:double>>"
#: A slope of 3 to 4, a corner, and a line that stops at a piece without length.
SLOPE = [(7.0, 1.0), (10.0, 5.0)]
CORNER = [(-2.0, 6.0), (-2.0, -6.0), (3.0, -6.0)]
PAUSE = [(1.0, 1.0), (1.0, 9.0), (1.0, 9.0), (4.0, 9.0)]


@pytest.fixture
def at(spark):
    def at(points, distance):
        df = spark.createDataFrame([([(*p, 0.0) for p in points], float(distance))], f"shape {POINT}, d double")
        p = df.select(point_and_tangent(F.col("shape"), F.col("d")).alias("p")).first()["p"]
        return tuple(round(p[c], 9) for c in ("x", "y", "tx", "ty"))

    return at


@pytest.mark.parametrize(
    ("points", "distance", "expected"),
    [
        (SLOPE, 2.5, (8.5, 3, 0.6, 0.8)),
        (SLOPE, 5, (10, 5, 0.6, 0.8)),
        (SLOPE, 5.0625, (10, 5, 1, 0)),
        (SLOPE, -1, (7, 1, 0.6, 0.8)),
        (SLOPE, math.nan, (7, 1, 0.6, 0.8)),
        (CORNER, 12, (-2, -6, 0, -1)),
        (CORNER, 16.25, (2.25, -6, 1, 0)),
        (PAUSE, 3, (1, 4, 0, 1)),
        (PAUSE, 9.5, (1, 9, 1, 0)),
        (PAUSE[1:], 0, (1, 9, 1, 0)),
        ([(8.0, -8.0)], 1, (8, -8, 1, 0)),
        ([], 1, (0, 0, 1, 0)),
    ],
)
def test_point_and_tangent(at, points, distance, expected):
    assert at(points, distance) == expected


def test_rectangle_centroid_and_stations(spark):
    df = spark.createDataFrame([([(x, y, 2.0) for x, y in CORNER],)], f"shape {POINT}")
    begin, end = (point_and_tangent(F.col("shape"), F.lit(d)) for d in (13.0, 16.5))
    row = df.select(rectangle(begin, end, F.lit(5.0)).alias("r"), centroid(F.col("shape")).alias("c"), centroid(F.array().cast(POINT)).alias("e"), *(distance_from_start(F.lit(4.5), F.lit(back), F.lit(17.0)).alias(n) for n, back in (("back", True), ("on", False)))).first()
    assert [(p["x"], p["y"]) for p in row["r"]] == [(-1, -3.5), (2.5, -3.5), (2.5, -8.5), (-1, -8.5), (-1, -3.5)]
    assert (row["c"]["x"], row["c"]["y"], row["e"]["x"], row["e"]["y"]) == (pytest.approx(-1 / 3), -2, 0, 0)
    assert (row["back"], row["on"]) == (12.5, 4.5)


def on_plane(lon, lat, lon0, ellipsoid, scale):
    """Forward transverse Mercator by the meridian's length and a series in the distance from it."""
    a, rf = ELLIPSOIDS[ellipsoid]
    e2 = (2 - 1 / rf) / rf
    phi, second = math.radians(lat), e2 / (1 - e2)
    steps = 20_000  # the meridian by Simpson's rule
    radius = lambda p: a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    length = phi / steps / 3 * sum((1 if k in (0, steps) else 4 if k % 2 else 2) * radius(phi * k / steps) for k in range(steps + 1))
    n, t, c, d = a / math.sqrt(1 - e2 * math.sin(phi) ** 2), math.tan(phi) ** 2, second * math.cos(phi) ** 2, math.radians(lon - lon0) * math.cos(phi)
    x = n * (d + (1 - t + c) * d**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * second) * d**5 / 120)
    y = length + n * math.tan(phi) * (d * d / 2 + (5 - t + 9 * c + 4 * c * c) * d**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * second) * d**6 / 720)
    return scale * x, scale * y


@pytest.mark.parametrize(
    ("projection", "lon0", "ellipsoid", "scale", "x0", "y0"),
    [
        ("+proj=utm +zone=33 +ellps=GRS80", 15, "GRS80", 0.9996, 500000, 0),
        ("+proj=utm +zone=4 +south", -159, "WGS84", 0.9996, 500000, 10000000),
        ("+proj=tmerc +lon_0=9 +k=1 +x_0=3500000 +ellps=bessel", 9, "bessel", 1, 3500000, 0),
        ("+proj=tmerc +lon_0=71d30'W +k_0=0.99995 +y_0=-77", -71.5, "WGS84", 0.99995, 0, -77),
    ],
)
def test_transverse_mercator_comes_back(spark, projection, lon0, ellipsoid, scale, x0, y0):
    p, places = parse_proj(projection), [(lon0 + d, lat) for d in (-1.25, 0.0, 0.75) for lat in (-41.5, 0.5, 52.25, 69.0)]
    rows = [(lon, lat, *on_plane(lon, lat, lon0, ellipsoid, scale)) for lon, lat in places]
    df = spark.createDataFrame(rows, "lon double, lat double, x double, y double")
    found = df.select("lon", "lat", to_lon_lat(p, -250.5, 1000.0, F.col("x") + x0 - 250.5, F.col("y") + y0 + 1000).alias("q")).collect()
    for r in found:
        assert r["q"]["lon"] == pytest.approx(r["lon"], abs=2e-9) and r["q"]["lat"] == pytest.approx(r["lat"], abs=2e-9), r


def test_an_origin_off_the_equator(spark):
    p = parse_proj("+proj=tmerc +lon_0=12 +lat_0=-33.5 +ellps=intl")
    q = spark.range(1).select(to_lon_lat(p, 40.0, 60.0, F.lit(40.0), F.lit(60.0)).alias("q")).first()["q"]
    assert (q["lon"], q["lat"]) == (pytest.approx(12), pytest.approx(-33.5, abs=1e-9))
