"""From the plane of a projection back to longitude and latitude on WGS84, as column expressions.

A PROJ.4 string is parsed once, on the driver, into a Projection: a kind and
that kind's constants.  The expressions take the constants as columns, either
literals (one network) or looked up for each row (many networks), so that a plan's
size depends on the kinds of projection and not on how many strings there are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.expressions import let


class ProjectionError(ValueError):
    """A network's projection is missing, malformed or not supported."""


# Semi-major axis and inverse flattening of ellipsoids.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563),
    "WGS72": (6378135.0, 298.26),
    "GRS80": (6378137.0, 298.257222101),
    "GRS67": (6378160.0, 298.2471674270),
    "aust_SA": (6378160.0, 298.25),
    "bessel": (6377397.155, 299.1528128),
    "intl": (6378388.0, 297.0),
    "krass": (6378245.0, 298.3),
    "helmert": (6378200.0, 298.3),
    "clrk66": (6378206.4, 294.9786982138982),
    "clrk80ign": (6378249.2, 293.4660212936269),
    "airy": (6377563.396, 299.3249646),
    "mod_airy": (6377340.189, 299.3249374),
    "evrst30": (6377276.345, 300.8017),
    "sphere": (6370997.0, math.inf),
}

# Datums with their ellipsoid and the shift to WGS84: metres, seconds of arc, parts per million.
DATUMS: dict[str, tuple[str, tuple[float, ...]]] = {
    "WGS84": ("WGS84", ()),
    "NAD83": ("GRS80", (0, 0, 0)),
    "GGRS87": ("GRS80", (-199.87, 74.79, 246.62)),
    "potsdam": ("bessel", (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)),
    "carthage": ("clrk80ign", (-263.0, 6.0, 431.0)),
    "hermannskogel": ("bessel", (577.326, 90.129, 463.919, 5.137, 1.474, 5.297, 2.4232)),
    "ire65": ("mod_airy", (482.530, -130.596, 564.557, -1.042, -0.214, -0.631, 8.15)),
    "nzgd49": ("intl", (59.47, -5.04, 187.44, 0.47, -0.1, 1.024, -4.5993)),
    "OSGB36": ("airy", (446.448, -125.157, 542.060, 0.1502, 0.2470, 0.8421, -20.4894)),
}

# Metres of a unit, and the longitude of prime meridians.
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "us-ft": 1200 / 3937}
MERIDIANS = {"greenwich": "0", "paris": "2d20'14.025E", "ferro": "17d40'W", "bern": "7d26'22.5E", "oslo": "10d43'22.5E"}

_WGS84 = ELLIPSOIDS["WGS84"]
#: Ellipsoids whose squared eccentricities are nearer to each other than this are one.
_SAME = 5e-11


@dataclass(frozen=True)
class Projection:
    """kind: which inverse; constants: that inverse's numbers; meters: of a unit of the plane; x0, y0: false origin in metres; lon0: central meridian; a, rf: the ellipsoid; shift: seven numbers of the way to WGS84, or none."""

    kind: str
    constants: tuple[float, ...]
    meters: float
    x0: float
    y0: float
    lon0: float
    a: float
    rf: float
    shift: tuple[float, ...]

    @property
    def numbers(self) -> tuple[float, ...]:
        """All numbers in one order: meters, x0, y0, lon0, a, squared eccentricity, then the shift (zeros if none), then the constants."""
        return (self.meters, self.x0, self.y0, self.lon0, self.a, squared_eccentricity(self.rf), *(self.shift or (0.0,) * 7), *self.constants)


_COMMON = 13


def flattening(rf: float) -> float:
    return 0.0 if math.isinf(rf) else 1 / rf


def squared_eccentricity(rf: float) -> float:
    return flattening(rf) * (2 - flattening(rf))


_ANGLE = re.compile(r"([-+]?[\d.]+)(?:d(?:([\d.]+)'?)?(?:([\d.]+)\"?)?)?([nsewNSEW]?)")


def _degrees(text: str) -> float:
    """An angle in degrees: a number, or degrees, minutes and seconds, with or without a letter of the side."""
    found = _ANGLE.fullmatch(text)
    if found is None:
        raise ValueError(text)
    whole, minutes, seconds, side = found.groups()
    size = abs(float(whole)) + float(minutes or 0) / 60 + float(seconds or 0) / 3600
    return -size if whole.startswith("-") != (side in ("s", "S", "w", "W")) else size


class _Words:
    """The words of a string, as numbers, angles (in radians) or text."""

    def __init__(self, text: str):
        self.pairs = dict(p.lstrip("+").partition("=")[::2] for p in text.split() if p.startswith("+"))

    def __contains__(self, key: str) -> bool:
        return key in self.pairs

    def number(self, key: str, default: float = 0.0) -> float:
        return float(self.pairs.get(key, default))

    def angle(self, key: str, default: float | None = None) -> float:
        if key not in self.pairs and default is not None:
            return default
        return math.radians(_degrees(self.pairs.get(key, "0") if default is None else self.pairs[key]))

    def scale(self) -> float:
        return self.number("k", self.number("k_0", 1.0))


def _ellipsoid(words: _Words) -> tuple[float, float]:
    """Semi-major axis and inverse flattening (infinite for a sphere), by name or by its own figures."""
    pairs = words.pairs
    if "R" in pairs:
        return float(pairs["R"]), math.inf
    if "a" in pairs:
        a = float(pairs["a"])
        b = float(pairs["b"]) if "b" in pairs else a
        return a, float(pairs["rf"]) if "rf" in pairs else math.inf if a == b else a / (a - b)
    return ELLIPSOIDS[pairs["ellps"] if "ellps" in pairs else DATUMS[pairs.get("datum", "WGS84")][0]]


def _shift(words: _Words, a: float, rf: float) -> tuple[float, ...]:
    """Metres, radians and factor from this ellipsoid's datum to WGS84; empty if there is nothing to do, or nothing known."""
    pairs = words.pairs
    if pairs.get("nadgrids", "@null") != "@null":
        raise ValueError("grids")
    given = [float(x) for x in pairs["towgs84"].split(",")] if "towgs84" in pairs else list(DATUMS[pairs["datum"]][1]) if "datum" in pairs else []
    if len(given) not in (0, 3, 7):
        raise ValueError("towgs84")
    alike = a == _WGS84[0] and abs(squared_eccentricity(rf) - squared_eccentricity(_WGS84[1])) < _SAME
    if not given or (alike and not any(given)):
        return ()
    given += [0.0] * (7 - len(given))
    return (*given[:3], *(math.radians(x / 3600) for x in given[3:6]), 1 + given[6] * 1e-6)


def parse_proj(text: str | None) -> Projection:
    """The projections of INVERSES on a named or given ellipsoid, in any of UNITS, with three or seven parameters of a datum; anything else is an error that names the string."""
    if text is None:
        raise ProjectionError("network is not georeferenced (no projection in its location): GeoJSON needs real-world coordinates")
    words = _Words(text)
    try:
        a, rf = _ellipsoid(words)
        shift = _shift(words, a, rf)
        if words.pairs.get("axis", "enu") != "enu":
            raise ValueError("axis")
        meters = words.number("to_meter") if "to_meter" in words else UNITS[words.pairs.get("units", "m")]
        prime = words.pairs.get("pm", "greenwich")
        pm = math.radians(_degrees(MERIDIANS.get(prime, prime)))
        kind, constants, x0, y0, lon0 = _SETUPS[words.pairs["proj"]](words, a, rf)
    except (KeyError, ValueError, ZeroDivisionError) as error:
        raise ProjectionError(f"invalid or unsupported projection: {text!r}") from error
    return Projection(kind, tuple(constants), meters, x0, y0, lon0 + pm, a, rf, shift)


# Latitudes: conformal and authalic from geodetic in closed form, back by series in the third flattening.


def _third(rf: float) -> float:
    return flattening(rf) / (2 - flattening(rf))


def _conformal(phi: float, e: float) -> float:
    if abs(phi) >= math.pi / 2:
        return phi
    tau = math.tan(phi)
    sigma = math.sinh(e * math.atanh(e * tau / math.hypot(1, tau)))
    return math.atan(tau * math.hypot(1, sigma) - sigma * math.hypot(1, tau))


def _isometric(phi: float, e: float) -> float:
    return math.asinh(math.tan(_conformal(phi, e)))


def _parallel(phi: float, e2: float) -> float:
    """Radius of a parallel, of an ellipsoid of semi-major axis 1."""
    return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)


def _authalic_q(phi: float, e: float) -> float:
    """Twice the area between the equator and a parallel, for a radian of longitude; of an ellipsoid of semi-major axis 1."""
    s = math.sin(phi)
    return 2 * s if e == 0 else (1 - e * e) * (s / (1 - e * e * s * s) + math.atanh(e * s) / e)


def _from_conformal(rf: float) -> list[float]:
    n = _third(rf)
    return [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45 + 26 * n**5 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45 + 2704 * n**5 / 315,
        56 * n**3 / 15 - 136 * n**4 / 35 - 1262 * n**5 / 105,
        4279 * n**4 / 630 - 332 * n**5 / 35,
        4174 * n**5 / 315,
    ]


def _from_authalic(rf: float) -> list[float]:
    n = _third(rf)
    return [4 * n / 3 + 4 * n**2 / 45 - 16 * n**3 / 35 - 2582 * n**4 / 14175, 46 * n**2 / 45 + 152 * n**3 / 945 - 11966 * n**4 / 14175, 3044 * n**3 / 2835 + 3802 * n**4 / 14175, 6059 * n**4 / 4725]


def _series(latitude: Column, terms: Sequence[Column]) -> Column:
    return let(latitude, lambda c: reduce(lambda total, jd: total + jd[1] * F.sin(2 * jd[0] * c), enumerate(terms, 1), c))


# One setup on the driver and one inverse for each kind.  A setup gives kind,
# constants, false origin and central meridian; an inverse takes metres from the false
# origin, the semi-major axis and the constants, and gives struct lon (from the central meridian), lat.


def _setup_tmerc(w: _Words, a: float, rf: float, utm: bool = False):
    n, e = _third(rf), math.sqrt(squared_eccentricity(rf))
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    if utm:
        zone = int(w.pairs["zone"])
        if not 1 <= zone <= 60:
            raise ValueError("zone")
        lat0, k0, x0, y0, lon0 = 0.0, 0.9996, 500000.0, 10000000.0 if "south" in w else 0.0, math.radians(6 * zone - 183)
    else:
        lat0, k0, x0, y0, lon0 = w.angle("lat_0"), w.scale(), w.number("x_0"), w.number("y_0"), w.angle("lon_0")
    if "approx" in w:
        return "tmerc_series", [k0, *_footpoint(lat0, a, rf), squared_eccentricity(rf)], x0, y0, lon0
    xi = _conformal(lat0, e)
    start = xi + sum(c * math.sin(2 * j * xi) for j, c in enumerate(alpha, 1))
    return "tmerc", [k0 * radius, start, *beta, *_from_conformal(rf)], x0, y0, lon0


def _tmerc(x: Column, y: Column, a: Column, c: Sequence[Column]) -> Column:
    plane = F.struct((y / c[0] + c[1]).alias("xi"), (x / c[0]).alias("eta"))

    def sphere(q):
        xi, eta = q.xi, q.eta
        for j, b in enumerate(c[2:6], 1):
            xi = xi - b * F.sin(2 * j * q.xi) * F.cosh(2 * j * q.eta)
            eta = eta - b * F.cos(2 * j * q.xi) * F.sinh(2 * j * q.eta)
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def geodetic(q):
        conformal = F.atan2(F.sin(q.xi), F.hypot(F.sinh(q.eta), F.cos(q.xi)))
        return _place(F.atan2(F.sinh(q.eta), F.cos(q.xi)), _series(conformal, c[6:11]))

    return let(let(plane, sphere), geodetic)


def _footpoint(lat0: float, a: float, rf: float) -> list[float]:
    """The meridian's arc up to a latitude, the radius of the rectifying sphere, and the terms from its latitude to the geodetic one."""
    e2 = squared_eccentricity(rf)
    arcs = [1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256 - 175 * e2**4 / 16384, -(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024 + 105 * e2**4 / 4096), 15 * e2**2 / 256 + 45 * e2**3 / 1024 + 525 * e2**4 / 16384, -(35 * e2**3 / 3072 + 175 * e2**4 / 12288), 315 * e2**4 / 131072]
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    terms = [3 * e1 / 2 - 27 * e1**3 / 32, 21 * e1**2 / 16 - 55 * e1**4 / 32, 151 * e1**3 / 96, 1097 * e1**4 / 512]
    return [a * (arcs[0] * lat0 + sum(c * math.sin(2 * j * lat0) for j, c in enumerate(arcs[1:], 1))), a * arcs[0], *terms]


def _tmerc_series(x: Column, y: Column, a: Column, c: Sequence[Column]) -> Column:
    """The same by powers of the distance from the central meridian (+approx): to 5e-11 degrees within two degrees of it, and no more than an approximation beyond four."""
    k0, arc, radius, terms, e2 = c[0], c[1], c[2], c[3:7], c[7]
    second = e2 / (1 - e2)

    def parts(f):
        bend = 1 - e2 * F.pow(F.sin(f), F.lit(2.0))
        n = a / F.sqrt(bend)
        return F.struct(f.alias("f"), F.cos(f).alias("cos"), F.tan(f).alias("tan"), F.pow(F.tan(f), F.lit(2.0)).alias("t"), (second * F.pow(F.cos(f), F.lit(2.0))).alias("c"), n.alias("n"), (a * (1 - e2) / F.pow(bend, F.lit(1.5))).alias("r"), (x / k0 / n).alias("d"))

    def geodetic(q):
        t, k, d = q.t, q.c, q.d
        p = lambda m: F.pow(d, F.lit(float(m)))
        lon = (d - (1 + 2 * t + k) * p(3) / 6 + (5 - 2 * k + 28 * t - 3 * k * k + 8 * second + 24 * t * t) * p(5) / 120 - (61 + 662 * t + 1320 * t * t + 720 * t * t * t) * p(7) / 5040) / q.cos
        fourth, sixth = 5 + 3 * t + 10 * k - 4 * k * k - 9 * second, 61 + 90 * t + 298 * k + 45 * t * t - 252 * second - 3 * k * k
        lat = q.f - q.n * q.tan / q.r * (d * d / 2 - fourth * p(4) / 24 + sixth * p(6) / 720 - (1385 + 3633 * t + 4095 * t * t + 1575 * t * t * t) * p(8) / 40320)
        return _place(lon, lat)

    return let(let(_series((arc + y / k0) / radius, terms), parts), geodetic)


def _place(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def _setup_merc(w: _Words, a: float, rf: float):
    k0 = _parallel(w.angle("lat_ts"), squared_eccentricity(rf)) if "lat_ts" in w else w.scale()
    return "merc", [k0, *_from_conformal(rf)], w.number("x_0"), w.number("y_0"), w.angle("lon_0")


def _merc(x: Column, y: Column, a: Column, c: Sequence[Column]) -> Column:
    return _place(x / (c[0] * a), _series(F.atan(F.sinh(y / (c[0] * a))), c[1:6]))


def _setup_lcc(w: _Words, a: float, rf: float):
    """Cone constant n, scale of the cone, and the distance of the origin from its tip (all for semi-major axis 1)."""
    e2 = squared_eccentricity(rf)
    e = math.sqrt(e2)
    lat1 = w.angle("lat_1", w.angle("lat_0"))
    lat2, lat0 = w.angle("lat_2", lat1), w.angle("lat_0", lat1)
    if abs(lat1 + lat2) < 1e-10:
        raise ValueError("parallels")
    psi1, m1 = _isometric(lat1, e), _parallel(lat1, e2)
    n = math.sin(lat1) if abs(lat1 - lat2) < 1e-10 else math.log(m1 / _parallel(lat2, e2)) / (_isometric(lat2, e) - psi1)
    size = m1 * math.exp(n * psi1) / n * w.scale()
    rho0 = 0.0 if abs(abs(lat0) - math.pi / 2) < 1e-10 else size * math.exp(-n * _isometric(lat0, e))
    return "lcc", [n, size, rho0, *_from_conformal(rf)], w.number("x_0"), w.number("y_0"), w.angle("lon_0")


def _cone(x: Column, y: Column, a: Column, n: Column, rho0: Column) -> Column:
    """struct rho (with n's sign, for semi-major axis 1) and theta of a point on an unrolled cone."""
    south = F.signum(n)
    east, north = x / a, rho0 - y / a
    return F.struct((south * F.hypot(east, north)).alias("rho"), F.atan2(south * east, south * north).alias("theta"))


def _lcc(x: Column, y: Column, a: Column, c: Sequence[Column]) -> Column:
    def geodetic(q):
        conformal = F.lit(math.pi / 2) - 2 * F.atan(F.pow(q.rho / c[1], 1 / c[0]))
        return _place(q.theta / c[0], _series(conformal, c[3:8]))

    return let(_cone(x, y, a, c[0], c[2]), geodetic)


def _setup_aea(w: _Words, a: float, rf: float):
    e2 = squared_eccentricity(rf)
    e = math.sqrt(e2)
    lat1, lat2 = w.angle("lat_1"), w.angle("lat_2", w.angle("lat_1"))
    if abs(lat1 + lat2) < 1e-10:
        raise ValueError("parallels")
    m1, m2, q1 = _parallel(lat1, e2), _parallel(lat2, e2), _authalic_q(lat1, e)
    n = math.sin(lat1) if abs(lat1 - lat2) < 1e-10 else (m1 * m1 - m2 * m2) / (_authalic_q(lat2, e) - q1)
    size = m1 * m1 + n * q1
    return "aea", [n, size, math.sqrt(size - n * _authalic_q(w.angle("lat_0"), e)) / n, _authalic_q(math.pi / 2, e), *_from_authalic(rf)], w.number("x_0"), w.number("y_0"), w.angle("lon_0")


def _arc_sine(x: Column) -> Column:
    return F.asin(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)))


def _aea(x: Column, y: Column, a: Column, c: Sequence[Column]) -> Column:
    def geodetic(q):
        authalic = _arc_sine((c[1] - F.pow(q.rho * c[0], F.lit(2.0))) / c[0] / c[3])
        return _place(q.theta / c[0], _series(authalic, c[4:8]))

    return let(_cone(x, y, a, c[0], c[2]), geodetic)


def _setup_laea(w: _Words, a: float, rf: float):
    """Sine and cosine of the origin's authalic latitude, radius of the authalic sphere, and what stretches x (1 at a pole)."""
    e2, lat0 = squared_eccentricity(rf), w.angle("lat_0")
    e = math.sqrt(e2)
    pole = _authalic_q(math.pi / 2, e)
    sine, radius = _authalic_q(lat0, e) / pole, math.sqrt(pole / 2)
    cosine = math.sqrt(max(0.0, 1 - sine * sine))
    polar = abs(abs(lat0) - math.pi / 2) < 1e-10
    sine, cosine = (math.copysign(1.0, lat0), 0.0) if polar else (sine, cosine)
    return "laea", [sine, cosine, radius, 1.0 if polar else _parallel(lat0, e2) / (radius * cosine), *_from_authalic(rf)], w.number("x_0"), w.number("y_0"), w.angle("lon_0")


def _around(x: Column, y: Column, angle: Callable[[Column], Column], sine: Column, cosine: Column, latitude: Callable[[Column], Column]) -> Column:
    """Place of a point in an azimuthal projection: `angle` of its distance is the arc from the origin, whose latitude is given by sine and cosine."""

    def at(q):
        def place(p):
            north = F.when(q.rho == 0, sine).otherwise(F.cos(p.arc) * sine + q.y * F.sin(p.arc) * cosine / q.rho)
            east = F.atan2(q.x * F.sin(p.arc), q.rho * cosine * F.cos(p.arc) - q.y * sine * F.sin(p.arc))
            return _place(F.when(q.rho == 0, F.lit(0.0)).otherwise(east), latitude(_arc_sine(north)))

        return let(F.struct(angle(q.rho).alias("arc")), place)

    return let(F.struct(x.alias("x"), y.alias("y"), F.hypot(x, y).alias("rho")), at)


def _laea(x: Column, y: Column, a: Column, c: Sequence[Column]) -> Column:
    return _around(x / a / c[3], y / a * c[3], lambda rho: 2 * _arc_sine(rho / (2 * c[2])), c[0], c[1], lambda sphere: _series(sphere, c[4:8]))


def _setup_stere(w: _Words, a: float, rf: float):
    """Sine and cosine of the origin's conformal latitude, and the diameter of the sphere that is looked at (for semi-major axis 1)."""
    e2, lat0 = squared_eccentricity(rf), w.angle("lat_0")
    e = math.sqrt(e2)
    if abs(abs(lat0) - math.pi / 2) < 1e-10:
        ts = w.angle("lat_ts", lat0)
        if abs(abs(ts) - math.pi / 2) < 1e-10:
            size = 2 * w.scale() / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        else:
            size = _parallel(abs(ts), e2) * math.exp(_isometric(abs(ts), e)) * w.scale()
        return "stere", [math.copysign(1.0, lat0), 0.0, size, *_from_conformal(rf)], w.number("x_0"), w.number("y_0"), w.angle("lon_0")
    chi = _conformal(lat0, e)
    return "stere", [math.sin(chi), math.cos(chi), 2 * w.scale() * _parallel(lat0, e2) / math.cos(chi), *_from_conformal(rf)], w.number("x_0"), w.number("y_0"), w.angle("lon_0")


def _stere(x: Column, y: Column, a: Column, c: Sequence[Column]) -> Column:
    return _around(x / a, y / a, lambda rho: 2 * F.atan(rho / c[2]), c[0], c[1], lambda sphere: _series(sphere, c[3:8]))


def _gauss_sphere(lat0: float, e2: float) -> tuple[float, float, float, float]:
    """Radius (for semi-major axis 1), exponent and constant of the conformal sphere that touches at a latitude, and the latitude there."""
    e, s = math.sqrt(e2), math.sin(lat0)
    radius = math.sqrt(1 - e2) / (1 - e2 * s * s)
    exponent = math.sqrt(1 + e2 * math.cos(lat0) ** 4 / (1 - e2))
    sphere = math.asin(s / exponent)
    return radius, exponent, math.asinh(math.tan(sphere)) - exponent * _isometric(lat0, e), sphere


def _setup_sterea(w: _Words, a: float, rf: float):
    radius, exponent, constant, sphere = _gauss_sphere(w.angle("lat_0"), squared_eccentricity(rf))
    return "sterea", [math.sin(sphere), math.cos(sphere), 2 * radius * w.scale(), exponent, constant, *_from_conformal(rf)], w.number("x_0"), w.number("y_0"), w.angle("lon_0")


def _from_gauss(sphere: Column, exponent: Column, constant: Column, terms: Sequence[Column]) -> Column:
    """Geodetic latitude of a latitude on the conformal sphere."""
    return _series(F.atan(F.sinh((F.asinh(F.tan(sphere)) - constant) / exponent)), terms)


def _sterea(x: Column, y: Column, a: Column, c: Sequence[Column]) -> Column:
    place = _around(x / a, y / a, lambda rho: 2 * F.atan(rho / c[2]), c[0], c[1], lambda sphere: _from_gauss(sphere, c[3], c[4], c[5:10]))
    return let(place, lambda q: _place(q.lon / c[3], q.lat))


def _setup_somerc(w: _Words, a: float, rf: float):
    radius, exponent, constant, sphere = _gauss_sphere(w.angle("lat_0"), squared_eccentricity(rf))
    return "somerc", [math.sin(sphere), math.cos(sphere), radius * w.scale(), exponent, constant, *_from_conformal(rf)], w.number("x_0"), w.number("y_0"), w.angle("lon_0")


def _somerc(x: Column, y: Column, a: Column, c: Sequence[Column]) -> Column:
    """A Mercator of the conformal sphere turned so that the origin lies on its equator."""
    turned = F.struct((x / a / c[2]).alias("l"), F.atan(F.sinh(y / a / c[2])).alias("b"))

    def back(t):
        sphere = _arc_sine(c[1] * F.sin(t.b) + c[0] * F.cos(t.b) * F.cos(t.l))
        lon = F.atan2(F.cos(t.b) * F.sin(t.l), c[1] * F.cos(t.b) * F.cos(t.l) - c[0] * F.sin(t.b))
        return _place(lon / c[3], _from_gauss(sphere, c[3], c[4], c[5:10]))

    return let(turned, back)


def _setup_omerc(w: _Words, a: float, rf: float):
    """Hotine's oblique Mercator, given by a centre and the azimuth of its line: the aposphere's constants."""
    e2, lat0, azimuth = squared_eccentricity(rf), w.angle("lat_0"), w.angle("alpha", w.angle("gamma", math.radians(90)))
    e, s = math.sqrt(e2), math.sin(w.angle("lat_0"))
    exponent = math.sqrt(1 + e2 * math.cos(lat0) ** 4 / (1 - e2))
    size = exponent * w.scale() * math.sqrt(1 - e2) / (1 - e2 * s * s)
    d = max(1.0, exponent * math.sqrt(1 - e2) / (math.cos(lat0) * math.sqrt(1 - e2 * s * s)))
    f = d + math.copysign(math.sqrt(d * d - 1), lat0)
    h = f * math.exp(-exponent * _isometric(lat0, e))
    turn = math.asin(max(-1.0, min(1.0, math.sin(azimuth) / d)))
    lon0 = w.angle("lonc") - math.asin(max(-1.0, min(1.0, (f - 1 / f) / 2 * math.tan(turn)))) / exponent
    rectified = w.angle("gamma", azimuth)
    at_centre = 0.0 if "no_uoff" in w or "no_off" in w else math.copysign(size / exponent * math.atan2(math.sqrt(d * d - 1), math.cos(azimuth)), lat0)
    return "omerc", [math.sin(rectified), math.cos(rectified), at_centre, math.sin(turn), math.cos(turn), exponent, size, h, *_from_conformal(rf)], w.number("x_0"), w.number("y_0"), lon0


def _omerc(x: Column, y: Column, a: Column, c: Sequence[Column]) -> Column:
    along = F.struct((x / a * c[1] - y / a * c[0]).alias("v"), (y / a * c[1] + x / a * c[0] + c[2]).alias("u"))

    def back(p):
        angles = F.struct((-c[5] * p.v / c[6]).alias("v"), (c[5] * p.u / c[6]).alias("u"))

        def place(q):
            north = (F.sin(q.u) * c[4] + F.sinh(q.v) * c[3]) / F.cosh(q.v)
            isometric = (F.atanh(north) - F.log(c[7])) / c[5]
            lon = -F.atan2(F.sinh(q.v) * c[4] - F.sin(q.u) * c[3], F.cos(q.u)) / c[5]
            return _place(lon, _series(F.atan(F.sinh(isometric)), c[8:13]))

        return let(angles, place)

    return let(along, back)


_SETUPS = {
    "utm": lambda w, a, rf: _setup_tmerc(w, a, rf, utm=True),
    "tmerc": _setup_tmerc,
    "etmerc": _setup_tmerc,
    "merc": _setup_merc,
    "lcc": _setup_lcc,
    "aea": _setup_aea,
    "laea": _setup_laea,
    "stere": _setup_stere,
    "sterea": _setup_sterea,
    "somerc": _setup_somerc,
    "omerc": _setup_omerc,
}
INVERSES: dict[str, Callable[[Column, Column, Column, Sequence[Column]], Column]] = {"tmerc": _tmerc, "tmerc_series": _tmerc_series, "merc": _merc, "lcc": _lcc, "aea": _aea, "laea": _laea, "stere": _stere, "sterea": _sterea, "somerc": _somerc, "omerc": _omerc}
#: The most numbers that a projection has.
N_NUMBERS = _COMMON + 13

#: Turns of the way back from geocentric coordinates; each leaves a hundredth of the last one's error.
_TURNS = 5


def _to_wgs84(place: Column, a: Column, e2: Column, shift: Sequence[Column]) -> Column:
    """struct lon, lat on WGS84 of a place on another datum's ellipsoid, at height 0: to geocentric coordinates, turned, scaled and moved, and back."""
    a1, e2_1 = _WGS84[0], squared_eccentricity(_WGS84[1])

    def geocentric(q):
        return let(a / F.sqrt(1 - e2 * F.pow(F.sin(q.lat), F.lit(2.0))), lambda n: F.struct((n * F.cos(q.lat) * F.cos(q.lon)).alias("x"), (n * F.cos(q.lat) * F.sin(q.lon)).alias("y"), (n * (1 - e2) * F.sin(q.lat)).alias("z")))

    dx, dy, dz, rx, ry, rz, m = shift

    def moved(p):
        x = m * (p.x - rz * p.y + ry * p.z) + dx
        y = m * (rz * p.x + p.y - rx * p.z) + dy
        z = m * (rx * p.y - ry * p.x + p.z) + dz
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))

    def back(p):
        r = F.hypot(p.x, p.y)
        lat = F.atan2(p.z, r * (1 - e2_1))
        for _ in range(_TURNS):
            lat = let(lat, lambda b: F.atan2(p.z + F.lit(a1 * e2_1) * F.sin(b) / F.sqrt(1 - F.lit(e2_1) * F.pow(F.sin(b), F.lit(2.0))), r))
        return _place(F.atan2(p.y, p.x), lat)

    return let(let(let(place, geocentric), moved), back)


def _inverse(kind: str, shifted: bool, numbers: Callable[[int], Column], net_x: Column, net_y: Column, x: Column, y: Column) -> Column:
    meters, x0, y0, lon0, a, e2 = (numbers(i) for i in range(6))
    constants = [numbers(_COMMON + i) for i in range(N_NUMBERS - _COMMON)]
    place = INVERSES[kind]((x - net_x) * meters - x0, (y - net_y) * meters - y0, a, constants)
    place = let(place, lambda q: _place(q.lon + lon0, q.lat))
    if shifted:
        place = _to_wgs84(place, a, e2, [numbers(6 + i) for i in range(7)])
    turned = lambda lon: lon - 360 * F.floor((lon + 180) / 360)
    return let(place, lambda q: F.struct(let(F.degrees(q.lon), lambda d: F.when(F.abs(d) > 180, turned(d)).otherwise(d)).alias("lon"), F.degrees(q.lat).alias("lat")))


def to_lon_lat(p: Projection, net_x: float, net_y: float, x: Column, y: Column) -> Column:
    """struct lon, lat in degrees of a point in coordinates of a network of this projection and offset."""
    numbers = lambda i: F.lit(p.numbers[i] if i < len(p.numbers) else 0.0)
    return _inverse(p.kind, bool(p.shift), numbers, F.lit(float(net_x)), F.lit(float(net_y)), x, y)


def to_lon_lat_by(kinds: set[tuple[str, bool]], place: Column, x: Column, y: Column) -> Column:
    """The same with a projection for each row: place is struct kind, shifted, numbers (array), net_x, net_y; kinds: those that occur, with and without shift of datum."""
    found = None
    for kind, shifted in sorted(kinds):
        way = _inverse(kind, shifted, lambda i: F.get(place["numbers"], i), place["net_x"], place["net_y"], x, y)
        is_it = (place["kind"] == kind) & (place["shifted"] == shifted)
        found = F.when(is_it, way) if found is None else found.when(is_it, way)
    return F.lit(None).cast("struct<lon:double,lat:double>") if found is None else found
