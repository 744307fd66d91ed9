"""Transverse Mercator by its series (+approx), against the SQL of the queries and against the closed form."""

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.functions.crs import parse_proj, to_lon_lat
from weftline.plans import catalog
from weftline.sources.starviews import NET_X, NET_Y, PROJECTION

#: Two points of zones at sf0.1.
POINTS = [(1058.9, 846.75), (243.0, 491.25)]


def placed(spark, points, projection, net_x=NET_X, net_y=NET_Y):
    df = spark.createDataFrame(points, "x double, y double").coalesce(1)
    there = to_lon_lat(parse_proj(projection), net_x, net_y, F.col("x"), F.col("y"))
    return [(r["q"]["lon"], r["q"]["lat"]) for r in df.select(there.alias("q")).collect()]


def test_points_between_two_sixth_places_are_rounded_as_sql_does(spark):
    """Points whose latitude is within 5e-12 degrees of the middle between two sixth places, and some that aren't."""
    points = POINTS + [(x * 12.25, x * 7.75) for x in range(50)]
    sql = catalog._LONLAT.format(points="points").lstrip().removeprefix(",")
    values = ", ".join(f"({k}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for k, (x, y) in enumerate(points))
    expected = duckdb.sql(f"WITH points AS (SELECT * FROM (VALUES {values}) v(k, x, y)), {sql} SELECT lon, lat FROM placed ORDER BY k").fetchall()
    net = catalog._by_series(catalog.star_network(spark, "/root/testdata/sf0.001"))
    projection = net.location.first()["proj"]
    assert [(round(lon, 6), round(lat, 6)) for lon, lat in placed(spark, points, projection)] == expected


@pytest.mark.parametrize(("projection", "near"), [(PROJECTION, 2e-11), ("+proj=tmerc +lat_0=-33.5 +lon_0=12 +k=0.9999 +x_0=10 +ellps=intl", 5e-11)])
def test_the_series_is_near_the_closed_form(spark, projection, near):
    p = parse_proj(projection)
    points = [(p.x0 + x * 1000.0, 5810000.0 + y * 1000.0 if "utm" in projection else y * 1000.0) for x in range(-140, 141, 35) for y in range(-300, 301, 100)]
    series, closed = (placed(spark, points, text, 0.0, 0.0) for text in (f"{projection} +approx", projection))
    assert max(abs(a - b) for p, q in zip(series, closed, strict=True) for a, b in zip(p, q, strict=True)) < near


@pytest.mark.parametrize("name", ["zones_geojson", "zones_geojson_text", "zone_rings_lonlat", "networks_stop_lines"])
def test_queries_ask_for_the_series(spark, name, monkeypatch):
    asked = []
    monkeypatch.setattr("weftline.operators.features.parse_proj", lambda text: asked.append(text) or parse_proj(text))
    catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked and all(text.endswith(" +approx") for text in asked)
