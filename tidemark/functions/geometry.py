"""Spherical, rotational and planar geometry as Column expressions (sections H1 to H6). Angles are degrees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once however often then uses it."""
    return F.transform(F.array(value), then)[0]


def _point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return _point(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def scale(a: Column, k: Column) -> Column:
    return _point(a["x"] * k, a["y"] * k, a["z"] * k)


def add(a: Column, b: Column) -> Column:
    return _point(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def normalize(a: Column) -> Column:
    """Unit vector; null for the zero vector."""
    length = F.nullif(F.sqrt(dot(a, a)), F.lit(0.0))
    return _point(a["x"] / length, a["y"] / length, a["z"] / length)


def sphere_to_cartesian(azimuth: Column, elevation: Column, radius: Column) -> Column:
    a, e = F.radians(azimuth), F.radians(elevation)
    return _point(radius * F.cos(e) * F.cos(a), radius * F.cos(e) * F.sin(a), radius * F.sin(e))


def cartesian_to_sphere(p: Column) -> Column:
    """(azimuth, elevation, radius) of a point."""
    r = F.sqrt(dot(p, p))
    return F.struct(F.degrees(F.atan2(p["y"], p["x"])).alias("azimuth"), F.degrees(F.asin(F.try_divide(p["z"], r))).alias("elevation"), r.alias("radius"))


def relative_elevation(elevation: Column) -> Column:
    """Elevation folded to the other pole's scale by its own sign: 90 - e above, -90 - e below, 0 stays 90."""
    return F.when(elevation >= 0, 90 - elevation).otherwise(-90 - elevation)


def from_relative_elevation(folded: Column) -> Column:
    """The elevation of a folded one. Both poles fold to 0, which is read as the upper one."""
    return relative_elevation(folded)


def dome_to_cartesian(x: Column, y: Column, radius: float = 60.0) -> Column:
    """A point of a dome from its angles right of and above straight ahead (x right, y up, z ahead)."""
    a, e = F.radians(x), F.radians(y)
    return _point(radius * F.cos(e) * F.sin(a), radius * F.sin(e), radius * F.cos(e) * F.cos(a))


def _bounded(c: Column) -> Column:
    """c between -1 and 1; null and NaN stay."""
    return F.when(c.between(-1, 1) | F.isnan(c), c).otherwise(F.signum(c))


def cartesian_to_dome(p: Column, radius: float = 60.0) -> Column:
    """(x, y): the angles of a dome's point; behind the left side x goes on beyond 180."""
    return F.struct((90 - F.degrees(F.atan2(p["z"], p["x"]))).alias("x"), F.degrees(F.asin(_bounded(p["y"] / radius))).alias("y"))


def project_to_plane(p: Column, distance: float) -> Column:
    """Where the line from zero through a point meets the plane z = distance; null if it never does."""
    k = F.try_divide(F.lit(distance), p["z"])
    return F.when(k.isNotNull(), scale(p, k))


def flat_angles(p: Column) -> Column:
    """(x, y): the angles of a point's projections to the horizontal and the vertical plane."""
    return F.struct(F.degrees(F.atan(F.try_divide(p["x"], p["z"]))).alias("x"), F.degrees(F.atan(F.try_divide(p["y"], p["z"]))).alias("y"))


def from_flat_angles(x: Column, y: Column, z: Column) -> Column:
    return _point(F.tan(F.radians(x)) * z, F.tan(F.radians(y)) * z, z)


def gaze_direction(x: Column, y: Column) -> Column:
    """Unit vector of a gaze x right of and y above straight ahead."""
    return dome_to_cartesian(x, y, 1.0)


def eye_to_dome(x: Column, y: Column, eye: Column, radius: float = 60.0) -> Column:
    """(x, y) on the dome that an eye away from its middle sees at flat angles."""
    ray = let(from_flat_angles(x, y, F.lit(radius) - eye["z"]), normalize)
    return let(let(ray, lambda r: sphere_intersect(eye, r, F.lit(radius))), lambda p: cartesian_to_dome(p, radius))


def sphere_intersect(origin: Column, direction: Column, radius: Column) -> Column:
    """The far point where a ray from origin meets a sphere about zero; null if it doesn't."""
    a, b, c = dot(direction, direction), 2 * dot(origin, direction), dot(origin, origin) - radius * radius
    d = b * b - 4 * a * c
    t = F.when(d >= 0, (-b + F.sqrt(F.when(d >= 0, d))) / (2 * a))
    return F.when(t.isNotNull(), add(origin, scale(direction, t)))


def rotate(p: Column, axis: Column, angle: Column) -> Column:
    """A point turned about a unit axis by an angle, right-handed."""
    t = F.radians(angle)
    return add(add(scale(p, F.cos(t)), scale(cross(axis, p), F.sin(t))), scale(axis, dot(axis, p) * (1 - F.cos(t))))


def euler_parameters(axis: Column, angle: Column) -> Column:
    """(a, w) of a turn about a unit axis."""
    half = F.radians(angle) / 2
    return F.struct(F.cos(half).alias("a"), let(axis, lambda k: scale(k, F.sin(half))).alias("w"))


def rotate_by(p: Column, turn: Column) -> Column:
    """A point turned by Euler parameters."""
    return let(cross(turn["w"], p), lambda once: add(add(p, scale(once, 2 * turn["a"])), scale(cross(turn["w"], once), F.lit(2.0))))


def to_gaze_frame(p: Column, x: Column, y: Column) -> Column:
    """A point after the turn that brings the gaze (x, y) straight ahead; a gaze straight ahead turns nothing."""
    ahead = _point(F.lit(0.0), F.lit(0.0), F.lit(1.0))

    def turned(gaze: Column) -> Column:
        angle = F.degrees(F.acos(_bounded(gaze["z"])))
        axis = let(cross(gaze, ahead), normalize)
        return F.when((gaze["x"] == 0) & (gaze["y"] == 0), p).otherwise(let(euler_parameters(axis, angle), lambda turn: rotate_by(p, turn)))

    return let(gaze_direction(x, y), turned)


def cartesian_to_retinal(p: Column) -> Column:
    """(eccentricity, polar) of a direction: the angle from straight ahead, and the angle around it from the right."""
    return F.struct((90 - F.degrees(F.asin(_bounded(p["z"])))).alias("eccentricity"), F.degrees(F.atan2(p["y"], p["x"])).alias("polar"))


def retinal_to_cartesian(eccentricity: Column, polar: Column) -> Column:
    e, a = F.radians(eccentricity), F.radians(polar)
    return _point(F.sin(e) * F.cos(a), F.sin(e) * F.sin(a), F.cos(e))


def dome_to_eye(x: Column, y: Column, gaze_x: Column, gaze_y: Column, eye: Column, radius: float = 60.0) -> Column:
    """(eccentricity, polar) of a dome's point for an eye away from its middle that looks along a gaze."""
    seen = let(add(dome_to_cartesian(x, y, radius), scale(eye, F.lit(-1.0))), normalize)
    return let(let(seen, lambda p: to_gaze_frame(p, gaze_x, gaze_y)), cartesian_to_retinal)


def angle_between(a: Column, b: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(normalize(a), normalize(b))))))


def great_circle(az1: Column, el1: Column, az2: Column, el2: Column) -> Column:
    """Distance along the sphere, by the haversine."""
    a1, e1, a2, e2 = map(F.radians, (az1, el1, az2, el2))
    h = F.pow(F.sin((e2 - e1) / 2), 2) + F.cos(e1) * F.cos(e2) * F.pow(F.sin((a2 - a1) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def bearing(az1: Column, el1: Column, az2: Column, el2: Column) -> Column:
    """Initial course from the first point to the second, -180 to 180 from the pole."""
    a1, e1, a2, e2 = map(F.radians, (az1, el1, az2, el2))
    return F.degrees(F.atan2(F.sin(a2 - a1) * F.cos(e2), F.cos(e1) * F.sin(e2) - F.sin(e1) * F.cos(e2) * F.cos(a2 - a1)))


def cross_track(az: Column, el: Column, az1: Column, el1: Column, az2: Column, el2: Column) -> Column:
    """Signed distance of a point from the great circle through two others."""
    d, t, c = F.radians(great_circle(az1, el1, az, el)), F.radians(bearing(az1, el1, az, el)), F.radians(bearing(az1, el1, az2, el2))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(d) * F.sin(t - c)))))


def corners(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Bottom right, top right, top left, bottom left of a box."""
    xy = lambda i, j: F.struct((x + i * width / 2).alias("x"), (y + j * height / 2).alias("y"))
    return F.array(xy(1, -1), xy(1, 1), xy(-1, 1), xy(-1, -1))


def reorder(points: Column, order: tuple[int, ...] = (3, 0, 1, 2)) -> Column:
    return F.array(*[F.get(points, F.lit(k)) for k in order])


def _following(points: Column) -> Column:
    return F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))


def polygon_area(points: Column) -> Column:
    """Area within a simple polygon; 0 with fewer than three corners."""
    parts = F.zip_with(points, _following(points), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(points) >= 3, F.abs(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)) / 2).otherwise(F.lit(0.0))


def is_collapsed(points: Column, least: float = 10.0) -> Column:
    """Whether a polygon is lower than so much."""
    ys = F.transform(points, lambda p: p["y"])
    return (F.array_max(ys) - F.array_min(ys)) < least


def circle_polygon_area(x: Column, y: Column, radius: Column, points: Column) -> Column:
    """Area common to a circle and a simple polygon: over the edges, triangles inside the circle and sectors outside."""
    near = F.transform(points, lambda p: F.struct((p["x"] - x).alias("x"), (p["y"] - y).alias("y")))

    def sector(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        return radius * radius * F.atan2(ax * by - ay * bx, ax * bx + ay * by) / 2

    # a step an array, so that what later steps use many times is computed once an edge
    def line(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        aa, bb, cc = dx * dx + dy * dy, a["x"] * dx + a["y"] * dy, a["x"] * a["x"] + a["y"] * a["y"] - radius * radius
        return F.struct(a.alias("a"), b.alias("b"), dx.alias("dx"), dy.alias("dy"), aa.alias("aa"), bb.alias("bb"), (bb * bb - aa * cc).alias("disc"))

    def crossed(e: Column) -> Column:
        root = F.sqrt(F.greatest(F.lit(0.0), e["disc"]))
        lo, hi = F.greatest(F.lit(0.0), F.try_divide(-e["bb"] - root, e["aa"])), F.least(F.lit(1.0), F.try_divide(-e["bb"] + root, e["aa"]))
        return F.struct(e.alias("e"), lo.alias("lo"), hi.alias("hi"))

    def chord(c: Column) -> Column:
        e, a = c["e"], c["e"]["a"]
        at = lambda t: F.struct((a["x"] + t * e["dx"]).alias("x"), (a["y"] + t * e["dy"]).alias("y"))
        return F.struct(a.alias("a"), e["b"].alias("b"), e["aa"].alias("aa"), ((e["disc"] <= 0) | (c["lo"] >= c["hi"])).alias("out"), at(c["lo"]).alias("p"), at(c["hi"]).alias("q"))

    def area(k: Column) -> Column:
        a, b, p, q = k["a"], k["b"], k["p"], k["q"]
        inside = sector(a["x"], a["y"], p["x"], p["y"]) + (p["x"] * q["y"] - p["y"] * q["x"]) / 2 + sector(q["x"], q["y"], b["x"], b["y"])
        return F.when(k["aa"] == 0, F.lit(0.0)).when(k["out"], sector(a["x"], a["y"], b["x"], b["y"])).otherwise(inside)

    parts = F.transform(F.transform(F.transform(F.zip_with(near, _following(near), line), crossed), chord), area)
    return F.when(F.size(points) >= 3, F.abs(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))).otherwise(F.lit(0.0))


def square_to_quad(u: Column, v: Column, quad: Column) -> Column:
    """Where the projective map of the unit square to a quadrilateral, corners (0,0) (1,0) (1,1) (0,1) in order, sends
    (u, v); null if a corner is missing or the quadrilateral is flat."""
    p = [F.get(quad, F.lit(k)) for k in range(4)]
    dx1, dx2, sx = p[1]["x"] - p[2]["x"], p[3]["x"] - p[2]["x"], p[0]["x"] - p[1]["x"] + p[2]["x"] - p[3]["x"]
    dy1, dy2, sy = p[1]["y"] - p[2]["y"], p[3]["y"] - p[2]["y"], p[0]["y"] - p[1]["y"] + p[2]["y"] - p[3]["y"]
    det = dx1 * dy2 - dx2 * dy1
    g, h = F.try_divide(sx * dy2 - dx2 * sy, det), F.try_divide(dx1 * sy - sx * dy1, det)
    w = g * u + h * v + 1
    one = lambda c: F.try_divide((p[1][c] - p[0][c] + g * p[1][c]) * u + (p[3][c] - p[0][c] + h * p[3][c]) * v + p[0][c], w)
    return F.struct(one("x").alias("x"), one("y").alias("y"))
