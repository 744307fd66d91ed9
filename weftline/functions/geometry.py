"""Points, tangents and rectangles along lanes, as row-local expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance_from_start(position: Column, from_end: Column, length: Column) -> Column:
    return F.when(from_end, length - position).otherwise(position)


def point_and_tangent(shape: Column, distance: Column) -> Column:
    """struct x, y, z, tx, ty at an arc length (2-D) along a polyline.

    A segment is passed only if it has length and ends before the station; so a
    station on a vertex belongs to the earlier segment, and a repeated vertex ends
    the walk with tangent (1, 0), as does a station beyond the end (the last point)
    or a shape of no segment.  An empty shape gives the origin."""
    target = F.when(F.isnan(distance) | (distance < 0), 0.0).otherwise(distance)
    segments = F.when(F.size(shape) > 1, F.arrays_zip(F.slice(shape, 1, F.size(shape) - 1).alias("a"), F.slice(shape, 2, F.greatest(F.size(shape) - 1, F.lit(0))).alias("b")))
    nothing = F.lit(None).cast("struct<x:double,y:double,z:double,tx:double,ty:double>")
    start = F.struct(F.lit(0.0).alias("travelled"), nothing.alias("found"))

    def step(state, segment):
        a, b = segment.a, segment.b
        dx, dy = b.x - a.x, b.y - a.y
        length = F.hypot(dx, dy)
        t = F.when(length > 0, (target - state.travelled) / length).otherwise(0.0)
        here = F.struct((a.x + dx * t).alias("x"), (a.y + dy * t).alias("y"), (a.z + (b.z - a.z) * t).alias("z"), F.when(length > 0, dx / length).otherwise(1.0).alias("tx"), F.when(length > 0, dy / length).otherwise(0.0).alias("ty"))
        passed = (length > 0) & (state.travelled + length < target)
        return F.when(state.found.isNotNull(), state).when(passed, F.struct((state.travelled + length).alias("travelled"), nothing.alias("found"))).otherwise(F.struct(state.travelled.alias("travelled"), here.alias("found")))

    walked = F.aggregate(segments, start, step, lambda s: s.found)
    last = F.get(shape, F.size(shape) - 1)
    end = F.struct(*(F.coalesce(last[c], F.lit(0.0)).alias(c) for c in "xyz"), F.lit(1.0).alias("tx"), F.lit(0.0).alias("ty"))
    return F.coalesce(F.when(F.size(shape) > 1, walked), end)


def offset_left(at: Column, distance: Column) -> Column:
    """The point moved perpendicular to its tangent: left if positive, right if negative."""
    return F.struct((at.x - at.ty * distance).alias("x"), (at.y + at.tx * distance).alias("y"), at.z.alias("z"))


def rectangle(entry: Column, exit_: Column, width: Column) -> Column:
    """Closed ring: left entry, left exit, right exit, right entry, left entry."""
    half = width / 2
    corners = [offset_left(entry, half), offset_left(exit_, half), offset_left(exit_, -half), offset_left(entry, -half)]
    return F.array(*corners, corners[0])


def centroid(points: Column) -> Column:
    """Mean point, summed in order; the origin for no points."""
    n = F.greatest(F.size(points), F.lit(1)).cast("double")

    def mean(c: str) -> Column:
        return (F.aggregate(points, F.lit(0.0), lambda total, p: total + p[c]) / n).alias(c)

    return F.struct(*map(mean, "xyz"))
