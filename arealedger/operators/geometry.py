"""Polygons as nested arrays: area, centroid, bounds, and points inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _edges(ring: Column) -> Column:
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1")))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring, about its first point."""
    x, y = ring[0][0], ring[0][1]
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["x0"] - x) * (e["y1"] - y) - (e["x1"] - x) * (e["y0"] - y)) / 2


def ring_centroid(ring: Column) -> Column:
    x, y = ring[0][0], ring[0][1]
    cross = lambda e: (e["x0"] - x) * (e["y1"] - y) - (e["x1"] - x) * (e["y0"] - y)
    sx = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["x0"] + e["x1"] - 2 * x) * cross(e))
    sy = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["y0"] + e["y1"] - 2 * y) * cross(e))
    return F.struct((x + sx / (6 * ring_area(ring))).alias("x"), (y + sy / (6 * ring_area(ring))).alias("y"))


def multi_centroid(polygons: Column) -> Column:
    """Centroid of polygons (each an outer ring and its holes), weighted by area; a hole counts against it."""
    parts = F.flatten(F.transform(polygons, lambda rings: F.transform(rings, lambda r, i: F.struct(F.when(i == 0, F.abs(ring_area(r))).otherwise(-F.abs(ring_area(r))).alias("w"), ring_centroid(r).alias("c")))))
    whole = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["w"])
    return F.struct((F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["w"] * p["c"]["x"]) / whole).alias("x"), (F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["w"] * p["c"]["y"]) / whole).alias("y"))


def multi_bounds(polygons: Column) -> Column:
    return bounds(F.flatten(F.flatten(polygons)))


def orient_ring(ring: Column, clockwise: bool) -> Column:
    return F.when((ring_area(ring) < 0) == F.lit(clockwise), ring).otherwise(F.reverse(ring))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; an edge's lower end counts, its upper end doesn't."""
    hits = F.filter(_edges(ring), lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"]))
    return F.size(hits) % 2 == 1


def edges_of(polygons: Column) -> Column:
    """The edges of every ring of polygons (each an outer ring and its holes)."""
    return F.flatten(F.transform(F.flatten(polygons), _edges))


def inside_edges(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule over the edges of all rings: holes are out, parts are in; boundaries as in `inside`."""
    hits = F.filter(edges, lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"]))
    return F.size(hits) % 2 == 1


def collective_bounds(features: DataFrame, by: list[str]) -> DataFrame:
    """(by, x0, y0, x1, y1, n): the box that holds all features (polygons) of a group; features without a point don't count."""
    rows = features.where(F.size(F.flatten(F.flatten("polygons"))) > 0).select(*by, multi_bounds(F.col("polygons")).alias("b"))
    return rows.groupBy(*by).agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"), F.count(F.lit(1)).alias("n"))


def grid_cover(shapes: DataFrame, cell: float) -> DataFrame:
    """(key, cx, cy, border): grid cells of shapes (key, polygons) that an edge's box touches, and those wholly inside.

    No edge enters a cell outside of all edges' boxes, so its centre speaks for all of it.
    """
    at = lambda c: F.floor(c / cell)
    edges = shapes.select("key", F.explode(edges_of(F.col("polygons"))).alias("e"))
    span = lambda a, b: F.explode(F.sequence(at(F.least(a, b)), at(F.greatest(a, b))))
    border = edges.withColumn("cx", span(F.col("e.x0"), F.col("e.x1"))).withColumn("cy", span(F.col("e.y0"), F.col("e.y1"))).select("key", "cx", "cy").distinct()
    whole = shapes.select("key", multi_bounds(F.col("polygons")).alias("b")).withColumn("cx", span(F.col("b.x0"), F.col("b.x1"))).withColumn("cy", span(F.col("b.y0"), F.col("b.y1"))).drop("b")
    rest = whole.join(border, ["key", "cx", "cy"], "left_anti").join(shapes.select("key", edges_of(F.col("polygons")).alias("edges")), "key")
    inner = rest.where(inside_edges((F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell, F.col("edges"))).select("key", "cx", "cy")
    return border.withColumn("border", F.lit(True)).union(inner.withColumn("border", F.lit(False)))


def points_in_multipolygons(points: DataFrame, shapes: DataFrame, cell: float = 0.01) -> DataFrame:
    """points (x, y, ...) with the key of each shape (key, polygons) that holds them: parts, less their holes.

    Points meet shapes by grid cells; only points in cells that a boundary touches are tested edge by edge. Points without a
    coordinate lie nowhere; a shape without rings holds nothing.
    """
    tiles = grid_cover(shapes, cell)
    met = points.where("x is not null and y is not null").withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)).join(tiles, ["cx", "cy"])
    sure = met.where("not border").select(*points.columns, "key")
    near = met.where("border").join(shapes.select("key", edges_of(F.col("polygons")).alias("_edges")), "key")
    return sure.union(near.where(inside_edges(F.col("x"), F.col("y"), F.col("_edges"))).select(*points.columns, "key"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float = 0.01) -> DataFrame:
    """points (x, y, ...) with the key of each polygon (key, ring) that holds them, matched by grid cells of their bounds."""
    b = polygons.withColumn("b", bounds(F.col("ring")))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    tiles = b.withColumn("cx", span(F.col("b.x0"), F.col("b.x1"))).withColumn("cy", span(F.col("b.y0"), F.col("b.y1"))).select("key", "ring", "cx", "cy")
    at = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    return at.join(tiles, ["cx", "cy"]).where(inside(F.col("x"), F.col("y"), F.col("ring"))).drop("cx", "cy", "ring")
