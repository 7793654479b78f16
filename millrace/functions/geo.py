"""Spatial columns: points (lon, lat), lines and rings (arrays of points), polygons (arrays of rings).

Distances are on the sphere of the mean earth radius (a spheroid differs by up to half a percent).
Shape predicates are planar in degrees. All are column expressions; hulls and clusters need groups
and use pandas where noted.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import runtime

RADIUS_M = 6_371_008.8
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def distance_m(a: Column, b: Column) -> Column:
    """Great-circle distance in metres."""
    p, q = F.radians(a["lat"]), F.radians(b["lat"])
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(b["lon"] - a["lon"]) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def within_km(a: Column, b: Column, km: float) -> Column:
    """Distance at most ``km``, with a box test first that costs no trigonometry on far points."""
    near = F.abs(a["lat"] - b["lat"]) <= km / 111.0
    return near & (distance_m(a, b) <= km * 1000)


def order_by_distance(df: DataFrame, at: Column, to: Column, key: str) -> DataFrame:
    return df.withColumn("distance_m", distance_m(at, to)).orderBy(F.col("distance_m").asc_nulls_last(), key)


def bounded_by(p: Column, west: float, south: float, east: float, north: float) -> Column:
    return p["lon"].between(west, east) & p["lat"].between(south, north)


def ring(coordinates: Sequence[tuple[float, float]]) -> Column:
    """A closed ring of constant points."""
    pts = list(coordinates)
    if pts[0] != pts[-1]:
        pts.append(pts[0])
    return F.array(*[point(F.lit(float(x)), F.lit(float(y))) for x, y in pts])


def _sides(r: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.struct(F.element_at(r, i).alias("a"), F.element_at(r, i + 1).alias("b")))


def ring_contains(r: Column, p: Column) -> Column:
    """Whether a point is inside a ring, by counting the sides that a ray from it crosses."""
    crossed = F.filter(_sides(r), lambda s: ((s["a"]["lat"] > p["lat"]) != (s["b"]["lat"] > p["lat"])) & (p["lon"] < (s["b"]["lon"] - s["a"]["lon"]) * (p["lat"] - s["a"]["lat"]) / (s["b"]["lat"] - s["a"]["lat"]) + s["a"]["lon"]))
    return F.size(crossed) % 2 == 1


def contains(polygon: Column, p: Column) -> Column:
    """In the first ring and in none of the others (holes)."""
    holes = F.slice(polygon, 2, 1000000)
    return ring_contains(polygon[0], p) & ~F.exists(holes, lambda r: ring_contains(r, p))


def _turn(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["lon"] - a["lon"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"]))


def rings_intersect(r: Column, s: Column) -> Column:
    """Sides cross, or one ring holds a corner of the other."""
    cross = F.exists(_sides(r), lambda x: F.exists(_sides(s), lambda y: (_turn(x["a"], x["b"], y["a"]) != _turn(x["a"], x["b"], y["b"])) & (_turn(y["a"], y["b"], x["a"]) != _turn(y["a"], y["b"], x["b"]))))
    return cross | ring_contains(r, s[0]) | ring_contains(s, r[0])


def rings_touch(r: Column, s: Column) -> Column:
    """They share boundary points and no inner ones: a corner of one on the other, and none inside."""
    on = lambda p, q: (_turn(q["a"], q["b"], p) == 0) & p["lon"].between(F.least(q["a"]["lon"], q["b"]["lon"]), F.greatest(q["a"]["lon"], q["b"]["lon"])) & p["lat"].between(F.least(q["a"]["lat"], q["b"]["lat"]), F.greatest(q["a"]["lat"], q["b"]["lat"]))
    meets = F.exists(r, lambda p: F.exists(_sides(s), lambda q: on(p, q))) | F.exists(s, lambda p: F.exists(_sides(r), lambda q: on(p, q)))
    proper = F.exists(_sides(r), lambda x: F.exists(_sides(s), lambda y: (_turn(x["a"], x["b"], y["a"]) * _turn(x["a"], x["b"], y["b"]) < 0) & (_turn(y["a"], y["b"], x["a"]) * _turn(y["a"], y["b"], x["b"]) < 0)))
    middle = lambda q: point(F.aggregate(F.slice(q, 1, F.size(q) - 1), F.lit(0.0), lambda t, p: t + p["lon"]) / (F.size(q) - 1), F.aggregate(F.slice(q, 1, F.size(q) - 1), F.lit(0.0), lambda t, p: t + p["lat"]) / (F.size(q) - 1))
    return meets & ~proper & ~ring_contains(r, middle(s)) & ~ring_contains(s, middle(r))


def ring_within(r: Column, outer: Column) -> Column:
    return F.forall(r, lambda p: ring_contains(outer, p))


def area_deg2(r: Column) -> Column:
    """Planar area of a ring in square degrees."""
    twice = F.aggregate(_sides(r), F.lit(0.0), lambda t, s: t + s["a"]["lon"] * s["b"]["lat"] - s["b"]["lon"] * s["a"]["lat"])
    return F.abs(twice) / 2


def area_m2(r: Column) -> Column:
    """Spherical area of a ring in square metres."""
    total = F.aggregate(_sides(r), F.lit(0.0), lambda t, s: t + F.radians(s["b"]["lon"] - s["a"]["lon"]) * (2 + F.sin(F.radians(s["a"]["lat"])) + F.sin(F.radians(s["b"]["lat"]))))
    return F.abs(total) * RADIUS_M * RADIUS_M / 2


def clip(subject: list, window: list) -> list:
    """Intersection of a ring with a convex ring (both lists of (x, y))."""
    def inside(p, a, b):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0

    def meet(p, q, a, b):
        d1, d2 = (q[0] - p[0], q[1] - p[1]), (b[0] - a[0], b[1] - a[1])
        den = d1[0] * d2[1] - d1[1] * d2[0]
        t = ((a[0] - p[0]) * d2[1] - (a[1] - p[1]) * d2[0]) / den
        return (p[0] + t * d1[0], p[1] + t * d1[1])

    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(window, window[1:], strict=False)) < 0:
        window = window[::-1]
    out = subject[:-1]
    for a, b in zip(window, window[1:], strict=False):
        points, out = out, []
        for i, q in enumerate(points):
            p = points[i - 1]
            if inside(q, a, b):
                if not inside(p, a, b):
                    out.append(meet(p, q, a, b))
                out.append(q)
            elif inside(p, a, b):
                out.append(meet(p, q, a, b))
        if not out:
            return []
    return [*out, out[0]]


def intersection(a: Column, b: Column) -> Column:
    """The ring that two rings share; the second must be convex."""
    kind = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))

    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        ring_ = lambda r: [(p["lon"], p["lat"]) for p in r]
        return pd.Series([[{"lon": x, "lat": y} for x, y in clip(ring_(p), ring_(q))] for p, q in zip(a, b, strict=True)])

    return F.pandas_udf(shared, kind)(a, b)


def intersection_area(a: Column, b: Column) -> Column:
    """Planar area that two rings share, in square degrees; the second must be convex."""

    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        rings = [clip([(p["lon"], p["lat"]) for p in x], [(p["lon"], p["lat"]) for p in y]) for x, y in zip(a, b, strict=True)]
        return pd.Series([abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:], strict=False))) / 2 for r in rings])

    return F.pandas_udf(shared, T.DoubleType())(a, b)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Area of the intersection over the area of the first."""
    return intersection_area(a, b) / area_deg2(a)


def geohash(p: Column, length: int) -> Column:
    """Cell name of 1 to 12 characters: bits of longitude and latitude interleaved."""
    if not 1 <= length <= 12:
        raise ValueError("a cell name has 1 to 12 characters")
    bits = 5 * length
    nx, ny = (bits + 1) // 2, bits // 2
    cell = lambda v, low, span, n: F.least(F.floor((v - low) / span * float(1 << n)).cast("long"), F.lit((1 << n) - 1))
    x, y = cell(p["lon"], -180.0, 360.0, nx), cell(p["lat"], -90.0, 180.0, ny)
    out = []
    for k in range(length):
        value = F.lit(0)
        for j in range(5):
            i = 5 * k + j
            source, n = (x, nx - 1 - i // 2) if i % 2 == 0 else (y, ny - 1 - i // 2)
            value = value * 2 + F.shiftright(source, n).bitwiseAND(F.lit(1)).cast("int")
        out.append(F.substring(F.lit(_BASE32), value + 1, F.lit(1)))
    return F.concat(*out)


def extent(lon: str, lat: str) -> list[Column]:
    return [F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north")]


def centroid(lon: str, lat: str) -> Column:
    return F.struct(F.avg(lon).alias("lon"), F.avg(lat).alias("lat"))


def make_line(p: Column, order: Column) -> Column:
    """Points of a group as a line, in an order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), p.alias("p")))), lambda x: x["p"])


def collect(p: Column) -> Column:
    return F.array_sort(F.collect_list(p))


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def convex_hull(df: DataFrame, key: str, lon: str, lat: str) -> DataFrame:
    """(key, hull, area_deg2) of each group.

    Hulls of hulls are hulls: each batch of rows is reduced to its groups' corners before the
    shuffle, so a group sends corners and not points, whatever its size.
    """
    runtime.ship(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def corners(batches):
        for pdf in batches:
            rows = [(k, x, y) for k, g in pdf.groupby(key, dropna=False) for x, y in _hull(list(zip(g["x"], g["y"], strict=True)))]
            yield pd.DataFrame(rows, columns=[key, "x", "y"])

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(list(zip(pdf["x"], pdf["y"], strict=True)))
        closed = [*h, h[0]] if len(h) > 2 else h
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(closed, closed[1:], strict=False))) / 2
        return pd.DataFrame([{key: pdf[key].iloc[0], "hull": [{"lon": x, "lat": y} for x, y in closed], "area_deg2": area}])

    slim = df.select(key, F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y")).dropna(subset=["x", "y"])
    near = slim.mapInPandas(corners, f"`{key}` {kind}, x double, y double")
    return near.groupBy(key).applyInPandas(hull, f"`{key}` {kind}, hull array<struct<lon: double, lat: double>>, area_deg2 double")


def by_region(points: DataFrame, lon: str, lat: str, regions: DataFrame, name: str, polygon: str, cell: float = 5.0) -> DataFrame:
    """Each point with the region that covers it (null if none).

    Regions are filed under the grid cells of their box and points under theirs, so the join is an
    equality and the exact test runs on neighbours only.
    """
    r = regions.select(F.col(name).alias("region"), F.col(polygon).alias("_poly"))
    outer = F.col("_poly")[0]
    box = r.withColumns({"_w": F.array_min(outer["lon"]), "_e": F.array_max(outer["lon"]), "_s": F.array_min(outer["lat"]), "_n": F.array_max(outer["lat"])})
    floor = lambda v: F.floor(F.col(v) / cell).cast("int")
    cells = box.withColumn("_cx", F.explode(F.sequence(floor("_w"), floor("_e")))).withColumn("_cy", F.explode(F.sequence(floor("_s"), floor("_n")))).select("region", "_poly", "_cx", "_cy")
    p = points.withColumns({"_cx": floor(lon), "_cy": floor(lat)})
    return p.join(cells, (p["_cx"] == cells["_cx"]) & (p["_cy"] == cells["_cy"]) & contains(F.col("_poly"), point(F.col(lon), F.col(lat))), "left").select(*points.columns, "region")


def cluster_by_proximity(df: DataFrame, key: str, lon: str, lat: str, metres: float, min_points: int = 1) -> DataFrame:
    """DBSCAN: each point with its cluster (its smallest core member's key; null for noise).

    Points meet only those of their own and the next grid cells (a side is the radius in degrees),
    so neighbours are an equality join; clusters of core points are connected components.
    """
    from millrace.operators.components import label

    eps = metres / 111_320.0
    slim = df.select(F.col(key).alias("v"), F.col(lon).alias("x"), F.col(lat).alias("y")).where("x is not null and y is not null")
    gx, gy = F.floor(F.col("x") / eps), F.floor(F.col("y") / eps)
    home = slim.withColumns({"gx": gx, "gy": gy})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = home.withColumn("s", F.explode(steps)).select(F.col("v").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("gx") + F.col("s.i")).alias("gx"), (F.col("gy") + F.col("s.j")).alias("gy"))
    within = F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2) <= eps * eps
    work = runtime.Workspace(df.sparkSession, "dbscan")
    pairs = work.save(home.join(near, ["gx", "gy"]).where(within).select("v", "o"))
    core = work.save(pairs.groupBy("v").count().where(F.col("count") >= min_points).select("v"))
    links = pairs.join(core, "v").join(core.withColumnRenamed("v", "o"), "o").select(F.col("v").alias("x"), F.col("o").alias("y"))
    found = label(links, core.select("v", F.col("v").alias("name")), work).select(F.col("v").alias("o"), F.col("name").alias("cluster"))
    border = pairs.join(found, "o").groupBy("v").agg(F.min("cluster").alias("cluster"))
    own = found.select(F.col("o").alias("v"), F.col("cluster").alias("own"))
    return slim.select("v").join(border, "v", "left").join(own, "v", "left").select(F.col("v").alias(key), F.coalesce("own", "cluster").alias("cluster"))
