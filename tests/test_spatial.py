"""Point in polygon and nearest point against plain Python."""

import math
import random

from pyspark.sql import functions as F

from tivlens.operators import spatial

EDGES = "poly_id string, x1 double, y1 double, x2 double, y2 double"


def ring(name, *corners):
    return [(name, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]


def star(name, cx, cy, n, seed):
    rnd = random.Random(seed)
    pts = [(cx + math.cos(2 * math.pi * i / n) * rnd.uniform(0.4, 1.6),
            cy + math.sin(2 * math.pi * i / n) * rnd.uniform(0.4, 1.6)) for i in range(n)]
    return ring(name, *pts)


SHAPES = (
    # a square with a hole, a two-part polygon, two irregular shapes
    ring("hole", (0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))
    + ring("hole", (0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5))
    + ring("parts", (3.0, 0.0), (4.0, 0.0), (4.0, 1.0), (3.0, 1.0))
    + ring("parts", (5.0, 0.0), (6.0, 0.0), (6.0, 1.0), (5.0, 1.0))
    + star("star", -3.0, 1.0, 40, 1) + star("other", -2.5, 1.3, 25, 2)
)


def plain(edges, x, y, closed=False):
    found = set()
    for name in {e[0] for e in edges}:
        mine = [e[1:] for e in edges if e[0] == name]
        on = any((x - x1) * (y2 - y1) == (y - y1) * (x2 - x1)
                 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)
                 for x1, y1, x2, y2 in mine)
        odd = sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
                  for x1, y1, x2, y2 in mine) % 2 == 1
        if (odd or on) if closed else (odd and not on):
            found.add(name)
    return found


def test_polygons_match_all_edges(spark):
    rnd = random.Random(7)
    points = [(rnd.uniform(-5, 7), rnd.uniform(-1, 3)) for _ in range(1500)]
    points += [(i / 4, j / 4) for i in range(-20, 28) for j in range(-4, 12)]
    points += [(x1, y1) for _, x1, y1, _, _ in SHAPES]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, x double, y double")
    edges = spark.createDataFrame(SHAPES, EDGES)
    for size in (0.25, 1.0):
        index = spatial.polygon_index(edges, size)
        for closed in (False, True):
            got = spatial.polygons_at(df, index, "x", "y", "p", closed=closed).collect()
            assert len(got) == len(points)
            for r in got:
                assert set(r["p"] or []) == plain(SHAPES, r["x"], r["y"], closed), (r, size, closed)


def test_polygons_without_broadcast(spark):
    edges = spark.createDataFrame(SHAPES, EDGES)
    index = spatial.polygon_index(edges)
    shuffled = spatial.PolygonIndex(index.cells, index.size, small=False)
    df = spark.range(500).select(
        "id", (F.col("id") / 50 - 4).alias("x"), (F.col("id") % 37 / 12).alias("y"))
    df = df.unionByName(spark.createDataFrame([(1000, None, 1.0)], "id long, x double, y double"))
    a = {r["id"]: set(r["p"] or []) for r in spatial.polygons_at(df, index, "x", "y", "p").collect()}
    b = {r["id"]: set(r["p"] or []) for r in spatial.polygons_at(df, shuffled, "x", "y", "p").collect()}
    assert a == b and len(a) == 501


def test_polygons_on_the_lines_of_cells(spark):
    # corners, edges and points that lie on the lines between cells, and thin slivers
    rnd = random.Random(11)
    steps = [i / 4 for i in range(-8, 9)]
    shapes = []
    for k in range(12):
        centre = rnd.choice(steps), rnd.choice(steps)
        angles = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(rnd.randint(3, 14)))
        pts = [(round((centre[0] + 2 * rnd.random() * math.cos(a)) * 4) / 4,
                round((centre[1] + 2 * rnd.random() * math.sin(a)) * 4) / 4) for a in angles]
        shapes += ring(f"p{k}", *pts)
    shapes += ring("sliver", (-3.0, 0.1), (3.0, 0.1 + 1e-9), (3.0, 0.1 + 2e-9))
    shapes += ring("upright", (0.3, -3.0), (0.3 + 1e-9, 3.0), (0.3 + 2e-9, -3.0))
    points = [(x / 8, y / 8) for x in range(-26, 27) for y in range(-26, 27)]
    points += [(rnd.uniform(-3, 3), rnd.choice(steps)) for _ in range(300)]
    points += [(rnd.choice(steps), rnd.uniform(-3, 3)) for _ in range(300)]
    points += [(0.0, 0.1 + 5e-10), (0.3 + 1e-9, -2.5), (float("nan"), 0.0), (float("inf"), 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, x double, y double")
    index = spatial.polygon_index(spark.createDataFrame(shapes, EDGES))
    for closed in (False, True):
        for r in spatial.polygons_at(df, index, "x", "y", "p", closed=closed).collect():
            finite = math.isfinite(r["x"])
            assert set(r["p"] or []) == (plain(shapes, r["x"], r["y"], closed) if finite else set()), (r, closed)


def test_index_grows_with_edges_and_cells_only(spark):
    def circle(radius, n):
        turn = 2 * math.pi / n
        at = lambda i, f: F.lit(radius) * f(i * F.lit(turn))
        return spark.range(n).select(
            F.lit("ring").alias("poly_id"), at(F.col("id"), F.cos).alias("x1"), at(F.col("id"), F.sin).alias("y1"),
            at((F.col("id") + 1) % n, F.cos).alias("x2"), at((F.col("id") + 1) % n, F.sin).alias("y2"))

    largest = []
    for radius in (5.0, 20.0):
        index = spatial.polygon_index(circle(radius, 100_000))
        cells = index.cells.count()
        assert math.pi * (radius - 0.5) ** 2 / spatial.CELL ** 2 < cells < math.pi * (radius + 0.5) ** 2 / spatial.CELL ** 2
        assert spatial.index_items(index.cells) <= 4 * (100_000 + cells)
        assert spatial.index_items(index.cells) <= 1.2 * 100_000 + cells  # what is seen
        largest.append(index.cells.agg(F.max(F.size(F.col("polygons")[0]["edges"]))).first()[0])
    assert largest[1] < largest[0]
    rnd = random.Random(5)
    points = [(i, rnd.uniform(-21, 21), rnd.uniform(-21, 21)) for i in range(3000)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = {r["id"]: bool(r["p"]) for r in spatial.polygons_at(df, index, "x", "y", "p").collect()}
    assert all(got[i] == (math.hypot(x, y) < 20) for i, x, y in points if abs(math.hypot(x, y) - 20) > 1e-6)


def nearest(grid, x, y):
    return min(grid, key=lambda g: ((x - g[0]) ** 2 + (y - g[1]) ** 2, g[0], g[1]))


def test_nearest_point_at_any_distance(spark, monkeypatch):
    rnd = random.Random(3)
    few = [(round(rnd.uniform(80, 90), 8), round(rnd.uniform(15, 25), 8)) for _ in range(60)]
    many = [(80 + i / 10, 15 + j / 10) for i in range(101) for j in range(100)]
    points = [(i, rnd.uniform(78, 92), rnd.uniform(13, 27)) for i in range(150)]
    points += [(900, -0.1, 51.5), (901, 86.0, 190.5), (902, 0.0, 0.0), (903, -179.0, -89.0),
               (904, 300000.0, 2200000.0), (905, -1e12, 3.0), (906, 0.0, 0.0)]
    df = spark.createDataFrame(points + [(999, None, 20.0)], "id long, x double, y double")

    def check(grid):
        grid = [(round(a, 8), round(b, 8)) for a, b in grid]
        index = spatial.grid_index(spark.createDataFrame(grid, "grid_lon double, grid_lat double"))
        got = {r["id"]: (r["grid_lon"], r["grid_lat"])
               for r in spatial.nearest_point(df, index, "x", "y").collect()}
        assert got == {i: nearest(grid, x, y) for i, x, y in points}
        near = {r["id"] for r in spatial.nearest_point(df, index, "x", "y", 0.177).collect()}
        assert near == {i for i, x, y in points if math.dist((x, y), nearest(grid, x, y)) <= 0.177}
        return index

    check(few)
    assert len(check(many).levels) > 2
    check([(0.0, 0.0), (1e6, 1e6), (-1e6, 5.0)] + few[:30])
    empty = spatial.grid_index(spark.createDataFrame([], "grid_lon double, grid_lat double"))
    assert spatial.nearest_point(df, empty, "x", "y").count() == 0


def test_dense_cells_are_split(spark, monkeypatch):
    """A million points in one cell: lists and lowest cells stay within their bound, results are the nearest."""
    n = 1000
    at = lambda c: F.round(F.lit(0.01) + c * 0.0002, 8)
    grid = spark.range(n * n).select((80 + at(F.col("id") % n)).alias("grid_lon"), (20 + at(F.floor(F.col("id") / n))).alias("grid_lat"))
    far = spark.createDataFrame([(85.0, 22.0), (79.9, 19.9)], "grid_lon double, grid_lat double")
    index = spatial.grid_index(grid.unionByName(far))
    longest = index.near.agg(F.max(F.size("__candidates"))).first()[0]
    lowest = index.levels[0].groupBy("px", "py").count().agg(F.max("count")).first()[0]
    assert longest <= spatial.LEAF and lowest <= spatial.LEAF
    rnd = random.Random(4)
    points = [(i, 80 + rnd.uniform(-0.01, 0.23), 20 + rnd.uniform(-0.01, 0.23)) for i in range(300)]
    points += [(900, 84.0, 21.0), (901, 79.8, 19.8), (902, 80.01, 20.01), (903, 81.5, 20.1), (904, -170.0, 60.0)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = {r["id"]: (r["grid_lon"], r["grid_lat"]) for r in spatial.nearest_point(df, index, "x", "y").collect()}
    for i, x, y in points:
        def axis(v, low):
            k = min(max(round((v - low - 0.01) / 0.0002), 0), n - 1)
            return [round(low + round(0.01 + j * 0.0002, 8), 8) for j in range(max(k - 1, 0), min(k + 2, n))]

        some = [(a, b) for a in axis(x, 80) for b in axis(y, 20)] + [(85.0, 22.0), (79.9, 19.9)]
        best = nearest(some, x, y)
        assert math.dist(got[i], (x, y)) <= math.dist(best, (x, y)) + 1e-9, (i, got[i], best)
