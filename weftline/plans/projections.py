"""Queries that take a grid of points, laid over the orders, back from the plane of a projection, and their SQL.

The SQL works out the projections' constants itself and finds latitudes by fixed-point
iteration on the closed forms, where the expressions use series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.crs import ELLIPSOIDS, parse_proj, squared_eccentricity, to_lon_lat

#: Width of the grid in metres, and the offset of the network that it is given in.
WIDTH_M, NET_X, NET_Y = 400_000.0, 1250.0, -875.0
#: name: projection and where the grid's middle is, in metres of the plane.
GRIDS = {
    "lonlat_lambert": ("+proj=lcc +lat_1=49 +lat_2=44 +lat_0=46.5 +lon_0=3 +x_0=700000 +y_0=6600000 +ellps=GRS80 +units=m", 700000.0, 6600000.0),
    "lonlat_albers": ("+proj=aea +lat_1=-18 +lat_2=-36 +lat_0=0 +lon_0=132 +ellps=GRS80", 0.0, -2800000.0),
    "lonlat_azimuthal": ("+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80", 4321000.0, 3210000.0),
    "lonlat_stereographic": ("+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45 +datum=WGS84", 250000.0, -2000000.0),
    "lonlat_double_stereographic": ("+proj=sterea +lat_0=52d9'22.178 +lon_0=5d23'15.5 +k=0.9999079 +x_0=155000 +y_0=463000 +ellps=bessel", 155000.0, 463000.0),
    "lonlat_swiss": ("+proj=somerc +lat_0=46d57'8.66 +lon_0=7d26'22.5 +x_0=600000 +y_0=200000 +ellps=bessel +towgs84=674.374,15.056,405.346", 600000.0, 200000.0),
    "lonlat_oblique": ("+proj=omerc +lat_0=4 +lonc=115 +alpha=53d18'56.9537 +gamma=53d7'48.3685 +k=0.99984 +x_0=590476.87 +y_0=442857.65 +a=6377298.556 +rf=300.8017", 679000.0, 596000.0),
    "lonlat_datum_shift": ("+proj=merc +lon_0=9 +datum=potsdam", 0.0, 6600000.0),
}


def _grid(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, east, north = GRIDS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        place = lambda k, middle, net: k * (WIDTH_M / 1000) - WIDTH_M / 2 + middle + net
        x, y = place(F.col("o_orderkey") % 1000, east, NET_X), place(F.col("o_orderkey") * 7 % 1000, north, NET_Y)
        there = to_lon_lat(parse_proj(text), NET_X, NET_Y, x, y)
        return orders.select("o_orderkey", there.alias("q")).select("o_orderkey", F.round("q.lon", 6).alias("lon"), F.round("q.lat", 6).alias("lat"))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _grid(name) for name in GRIDS}


def _radians(degrees: float, minutes: float = 0, seconds: float = 0) -> str:
    return f"radians({degrees}::DOUBLE + {minutes}::DOUBLE / 60 + {seconds}::DOUBLE / 3600)"


class _Ellipsoid:
    """SQL of an ellipsoid's functions of latitude."""

    def __init__(self, a: float, rf: float):
        self.a, self.e2 = f"{a!r}::DOUBLE", f"{squared_eccentricity(rf)!r}::DOUBLE"
        self.e = f"sqrt({self.e2})"

    def m(self, b: str) -> str:
        return f"(cos({b}) / sqrt(1 - {self.e2} * sin({b}) ** 2))"

    def psi(self, b: str) -> str:
        return f"(atanh(sin({b})) - {self.e} * atanh({self.e} * sin({b})))"

    def q(self, b: str) -> str:
        return f"((1 - {self.e2}) * (sin({b}) / (1 - {self.e2} * sin({b}) ** 2) + atanh({self.e} * sin({b})) / {self.e}))"

    def by_psi(self, source: str) -> str:
        """CTEs from source(o_orderkey, lon, psi) to found(o_orderkey, lon, lat), in radians."""
        steps = [f"b0 AS (SELECT *, atan(sinh(psi)) AS b FROM ({source}))"]
        steps += [f"b{k + 1} AS (SELECT * REPLACE (atan(sinh(psi + {self.e} * atanh({self.e} * sin(b)))) AS b) FROM b{k})" for k in range(8)]
        return ", ".join(steps) + ", found AS (SELECT o_orderkey, lon, b AS lat FROM b8)"

    def by_q(self, source: str) -> str:
        """The same from source(o_orderkey, lon, q)."""
        steps = [f"b0 AS (SELECT *, asin(q / 2) AS b FROM ({source}))"]
        step = f"b + (1 - {self.e2} * sin(b) ** 2) ** 2 / (2 * cos(b)) * (q / (1 - {self.e2}) - {self.q('b')} / (1 - {self.e2}))"
        steps += [f"b{k + 1} AS (SELECT * REPLACE ({step} AS b) FROM b{k})" for k in range(8)]
        return ", ".join(steps) + ", found AS (SELECT o_orderkey, lon, b AS lat FROM b8)"


def _shifted(e: _Ellipsoid, dx: float, dy: float, dz: float, rx: float = 0, ry: float = 0, rz: float = 0, ppm: float = 0) -> str:
    """CTEs from found to moved: to WGS84 by geocentric coordinates, latitude by fixed-point iteration."""
    arc = lambda x: f"radians({x}::DOUBLE / 3600)"
    w = _Ellipsoid(*ELLIPSOIDS["WGS84"])
    return f""", geo AS (SELECT o_orderkey, n * cos(lat) * cos(lon) AS gx, n * cos(lat) * sin(lon) AS gy, n * (1 - {e.e2}) * sin(lat) AS gz FROM (SELECT *, {e.a} / sqrt(1 - {e.e2} * sin(lat) ** 2) AS n FROM found)
), turned AS (SELECT o_orderkey, m * (gx - {arc(rz)} * gy + {arc(ry)} * gz) + {dx} AS x, m * ({arc(rz)} * gx + gy - {arc(rx)} * gz) + {dy} AS y, m * ({arc(rx)} * gy - {arc(ry)} * gx + gz) + {dz} AS z FROM (SELECT *, 1 + {ppm}::DOUBLE / 1000000 AS m FROM geo)
), c0 AS (SELECT *, atan2(z, sqrt(x * x + y * y)) AS b FROM turned), """ + ", ".join(f"c{k + 1} AS (SELECT * REPLACE (atan2(z + {w.a} * {w.e2} * sin(b) / sqrt(1 - {w.e2} * sin(b) ** 2), sqrt(x * x + y * y)) AS b) FROM c{k})" for k in range(8)) + ", moved AS (SELECT o_orderkey, atan2(y, x) AS lon, b AS lat FROM c8)"


def _sql(name: str, body: str, last: str = "found") -> str:
    _, east, north = GRIDS[name]
    place = lambda k, middle, net: f"({k}) * {WIDTH_M / 1000}::DOUBLE - {WIDTH_M / 2}::DOUBLE + {middle}::DOUBLE + {net}::DOUBLE - {net}::DOUBLE"
    return f"""WITH grid AS (SELECT o_orderkey, {place("o_orderkey % 1000", east, NET_X)} AS x, {place("o_orderkey * 7 % 1000", north, NET_Y)} AS y FROM orders
), {body}
SELECT o_orderkey, round(degrees(lon), 6) AS lon, round(degrees(lat), 6) AS lat FROM {last}"""


def lambert(lat1: float, lat2: float, lat0: float, lon0: float, x0: float, y0: float) -> str:
    """CTEs from grid to found, for a conformal cone on GRS80 with two parallels."""
    e, (b1, b2, b0) = _Ellipsoid(*ELLIPSOIDS["GRS80"]), map(_radians, (lat1, lat2, lat0))
    n = f"(ln({e.m(b1)} / {e.m(b2)}) / ({e.psi(b2)} - {e.psi(b1)}))"
    return f"""k AS (SELECT {n} AS n, {e.m(b1)} / {n} * exp({n} * {e.psi(b1)}) AS f
), polar AS (SELECT o_orderkey, n, f, (x - {x0}::DOUBLE) / {e.a} AS u, f * exp(-n * {e.psi(b0)}) - (y - {y0}::DOUBLE) / {e.a} AS v FROM grid, k
), {e.by_psi(f"SELECT o_orderkey, {_radians(lon0)} + atan2(u, v) / n AS lon, ln(f / sqrt(u * u + v * v)) / n AS psi FROM polar")}"""


def _albers() -> str:
    e, (b1, b2) = _Ellipsoid(*ELLIPSOIDS["GRS80"]), map(_radians, (-18, -36))
    n = f"(({e.m(b1)} ** 2 - {e.m(b2)} ** 2) / ({e.q(b2)} - {e.q(b1)}))"
    return f"""k AS (SELECT {n} AS n, {e.m(b1)} ** 2 + {n} * {e.q(b1)} AS c
), polar AS (SELECT o_orderkey, n, c, x / {e.a} AS u, sqrt(c) / n - y / {e.a} AS v FROM grid, k
), {e.by_q(f"SELECT o_orderkey, {_radians(132)} + atan2(-u, -v) / n AS lon, (c - (u * u + v * v) * n * n) / n AS q FROM polar")}"""


def _azimuthal() -> str:
    e, b0 = _Ellipsoid(*ELLIPSOIDS["GRS80"]), _radians(52)
    pole = e.q("(pi() / 2)")
    return f"""k AS (SELECT {pole} AS qp, asin({e.q(b0)} / {pole}) AS beta, sqrt({pole} / 2) AS r, {e.m(b0)} / (sqrt({pole} / 2) * cos(asin({e.q(b0)} / {pole}))) AS d
), polar AS (SELECT o_orderkey, qp, beta, (x - 4321000) / {e.a} / d AS u, (y - 3210000) / {e.a} * d AS v, r FROM grid, k
), arcs AS (SELECT *, sqrt(u * u + v * v) AS rho, 2 * asin(sqrt(u * u + v * v) / (2 * r)) AS c FROM polar
), {e.by_q(f"SELECT o_orderkey, {_radians(10)} + CASE WHEN rho = 0 THEN 0 ELSE atan2(u * sin(c), rho * cos(beta) * cos(c) - v * sin(beta) * sin(c)) END AS lon, qp * (cos(c) * sin(beta) + CASE WHEN rho = 0 THEN 0 ELSE v * sin(c) * cos(beta) / rho END) AS q FROM arcs")}"""


def _stereographic() -> str:
    e, ts = _Ellipsoid(*ELLIPSOIDS["WGS84"]), _radians(70)
    return e.by_psi(f"SELECT o_orderkey, {_radians(-45)} + atan2(x, -y) AS lon, {e.psi(ts)} + ln({e.m(ts)} * {e.a} / sqrt(x * x + y * y)) AS psi FROM grid")


def _sphere(e: _Ellipsoid, b0: str) -> str:
    """CTE of the conformal sphere that touches at b0: radius, exponent n, constant c, latitude s0."""
    n = f"sqrt(1 + {e.e2} * cos({b0}) ** 4 / (1 - {e.e2}))"
    return f"k AS (SELECT {e.a} * sqrt(1 - {e.e2}) / (1 - {e.e2} * sin({b0}) ** 2) AS r, {n} AS n, asin(sin({b0}) / {n}) AS s0, atanh(sin({b0}) / {n}) - {n} * {e.psi(b0)} AS c)"


def _double_stereographic() -> str:
    e, b0 = _Ellipsoid(*ELLIPSOIDS["bessel"]), _radians(52, 9, 22.178)
    return f"""{_sphere(e, b0)}, polar AS (SELECT o_orderkey, n, c, s0, (x - 155000) AS u, (y - 463000) AS v, 2 * r * 0.9999079::DOUBLE AS d FROM grid, k
), arcs AS (SELECT *, sqrt(u * u + v * v) AS rho, 2 * atan(sqrt(u * u + v * v) / d) AS z FROM polar
), onsphere AS (SELECT o_orderkey, n, c, CASE WHEN rho = 0 THEN 0 ELSE atan2(u * sin(z), rho * cos(s0) * cos(z) - v * sin(s0) * sin(z)) END AS l, cos(z) * sin(s0) + CASE WHEN rho = 0 THEN 0 ELSE v * sin(z) * cos(s0) / rho END AS sine FROM arcs
), {e.by_psi(f"SELECT o_orderkey, {_radians(5, 23, 15.5)} + l / n AS lon, (atanh(sine) - c) / n AS psi FROM onsphere")}"""


def _swiss() -> str:
    e, b0 = _Ellipsoid(*ELLIPSOIDS["bessel"]), _radians(46, 57, 8.66)
    return f"""{_sphere(e, b0)}, polar AS (SELECT o_orderkey, n, c, s0, (x - 600000) / r AS l, 2 * atan(exp((y - 200000) / r)) - pi() / 2 AS b FROM grid, k
), onsphere AS (SELECT o_orderkey, n, c, atan2(cos(b) * sin(l), cos(s0) * cos(b) * cos(l) - sin(s0) * sin(b)) AS l, cos(s0) * sin(b) + sin(s0) * cos(b) * cos(l) AS sine FROM polar
), {e.by_psi(f"SELECT o_orderkey, {_radians(7, 26, 22.5)} + l / n AS lon, (atanh(sine) - c) / n AS psi FROM onsphere")}{_shifted(e, 674.374, 15.056, 405.346)}"""


def _oblique() -> str:
    e, b0, alpha, gamma = _Ellipsoid(6377298.556, 300.8017), _radians(4), _radians(53, 18, 56.9537), _radians(53, 7, 48.3685)
    return f"""k1 AS (SELECT sqrt(1 + {e.e2} * cos({b0}) ** 4 / (1 - {e.e2})) AS b
), k2 AS (SELECT b, {e.a} * b * 0.99984::DOUBLE * sqrt(1 - {e.e2}) / (1 - {e.e2} * sin({b0}) ** 2) AS a, b * sqrt(1 - {e.e2}) / {e.m(b0)} / (1 - {e.e2} * sin({b0}) ** 2) AS d FROM k1
), k3 AS (SELECT *, d + sqrt(d * d - 1) AS f, asin(sin({alpha}) / d) AS g0 FROM k2
), k AS (SELECT *, f * exp(-b * {e.psi(b0)}) AS h, {_radians(115)} - asin((f - 1 / f) / 2 * tan(g0)) / b AS lon0, a / b * atan2(sqrt(d * d - 1), cos({alpha})) AS uc FROM k3
), lines AS (SELECT o_orderkey, k.*, (x - 590476.87::DOUBLE) * cos({gamma}) - (y - 442857.65::DOUBLE) * sin({gamma}) AS v, (y - 442857.65::DOUBLE) * cos({gamma}) + (x - 590476.87::DOUBLE) * sin({gamma}) + uc AS u FROM grid, k
), turned AS (SELECT *, exp(-b * v / a) AS q, sin(b * u / a) AS vv FROM lines
), {e.by_psi("SELECT o_orderkey, lon0 - atan2((q - 1 / q) / 2 * cos(g0) - vv * sin(g0), cos(b * u / a)) / b AS lon, (atanh((vv * cos(g0) + (q - 1 / q) / 2 * sin(g0)) / ((q + 1 / q) / 2)) - ln(h)) / b AS psi FROM turned")}"""


def _datum_shift() -> str:
    e = _Ellipsoid(*ELLIPSOIDS["bessel"])
    return e.by_psi(f"SELECT o_orderkey, {_radians(9)} + x / {e.a} AS lon, y / {e.a} AS psi FROM grid") + _shifted(e, 598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)


def oracle_sql() -> dict[str, str]:
    bodies = {
        "lonlat_lambert": lambert(49, 44, 46.5, 3, 700000, 6600000),
        "lonlat_albers": _albers(),
        "lonlat_azimuthal": _azimuthal(),
        "lonlat_stereographic": _stereographic(),
        "lonlat_double_stereographic": _double_stereographic(),
        "lonlat_oblique": _oblique(),
    }
    moved = {"lonlat_swiss": _swiss(), "lonlat_datum_shift": _datum_shift()}
    return {name: _sql(name, body) for name, body in bodies.items()} | {name: _sql(name, body, "moved") for name, body in moved.items()}
