"""Point-in-polygon and nearest-grid-point joins.

Both work the same way: the small side is turned into an index with one row per
square cell, the large side joins it on its own cell number, and the rest is an
expression on the joined row. Facts are never exploded or regrouped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tivlens.functions.columns import cell, col, key8
from tivlens.functions.geometry import crossed_once, crosses, distance2, straddles, touches
from tivlens.operators.sizing import is_small, lookup_join, salted_join
from tivlens.sources.tables import materialise

CELL = 0.25
#: Largest index (edges, or candidate points) that is broadcast; about 40 bytes per item.
BROADCAST_ITEMS = 2_000_000


# ------------------------------------------------------------ point in polygon

@dataclass(frozen=True)
class PolygonIndex:
    """Cells touched by polygons: ``(cell_x, cell_y, polygons)``.

    ``polygons`` is an array of ``(poly_id, base, edges)``: ``base`` is 1 if the cell's lower left
    corner is inside, ``edges`` are those that meet the cell. A point is inside as the corner
    is, turned over for every edge crossed on the way there. Cells wholly inside have no edges.
    """

    cells: DataFrame
    size: float
    small: bool


def _edges_by_cell(edges: DataFrame, s: Column, pad: Column) -> DataFrame:
    """Every edge once for each cell it meets: row by row of cells, the stretch it takes in each."""
    c = F.col
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    rows = edges.withColumn("cell_y", F.explode(F.sequence(F.floor((low - pad) / s), F.floor((high + pad) / s))))

    def at(y: Column) -> Column:
        return c("x1") + F.try_divide(y - c("y1"), c("y2") - c("y1")) * (c("x2") - c("x1"))

    enter = at(F.greatest(low, c("cell_y") * s - pad))
    leave = at(F.least(high, (c("cell_y") + 1) * s + pad))
    first = F.greatest(left, F.coalesce(F.least(enter, leave), left)) - pad
    last = F.least(right, F.coalesce(F.greatest(enter, leave), right)) + pad
    return rows.select(
        "poly_id", "cell_y", F.struct("x1", "y1", "x2", "y2").alias("edge"),
        F.explode(F.sequence(F.floor(first / s), F.floor(last / s))).alias("cell_x"))


def _corners_inside(edges: DataFrame, s: Column) -> DataFrame:
    """Cells whose lower left corner is inside.

    An edge that straddles a line of corners turns over all corners to its left. Only the last
    of those is noted; the running sum of such places, from the right, gives the parity of
    the stretch of corners between each two.
    """
    c = F.col
    line = c("cell_y") * s
    rows = edges.withColumn("cell_y", F.explode(F.sequence(
        F.floor(F.least("y1", "y2") / s), F.floor(F.greatest("y1", "y2") / s) + 1))).filter(
        straddles(c("y1"), c("y2"), line))
    guess = F.floor((c("x1") + F.try_divide(line - c("y1"), c("y2") - c("y1")) * (c("x2") - c("x1"))) / s)
    edge = F.struct("x1", "y1", "x2", "y2")
    # the quotient may be off by one, the predicate decides
    last = F.when(crosses(edge, (guess + 1) * s, line), guess + 1).when(
        crosses(edge, guess * s, line), guess).otherwise(guess - 1)
    turns = rows.select("poly_id", "cell_y", last.alias("last")).groupBy("poly_id", "cell_y", "last").agg(
        F.count("*").alias("n")).filter("n % 2 = 1")
    # at most one place per cell of the line
    leftwards = Window.partitionBy("poly_id", "cell_y").orderBy(c("last").desc())
    odd = turns.withColumn("turned", F.row_number().over(leftwards)).withColumn(
        "next", F.lead("last").over(leftwards)).filter("turned % 2 = 1 AND next IS NOT NULL")
    return odd.select("poly_id", "cell_y", F.explode(F.sequence(c("next") + 1, c("last"))).alias("cell_x"))


def polygon_index(edges: DataFrame, size: float = CELL) -> PolygonIndex:
    """Index an edge table ``(poly_id, x1, y1, x2, y2)``.

    A cell keeps the edges that meet it and the parity of one corner, so the index has an item for
    each crossing of an edge and a cell and one for each cell inside, whatever the polygons' extent.
    """
    s, pad = F.lit(float(size)), F.lit(float(size) * 1e-6)
    edge = "struct<x1: double, y1: double, x2: double, y2: double>"
    met = _edges_by_cell(edges, s, pad).select(
        "poly_id", "cell_x", "cell_y", F.lit(0).alias("base"), F.col("edge").cast(edge).alias("edge"))
    inside = _corners_inside(edges, s).select(
        "poly_id", "cell_x", "cell_y", F.lit(1).alias("base"), F.lit(None).cast(edge).alias("edge"))
    per_cell = met.unionByName(inside).groupBy("poly_id", "cell_x", "cell_y").agg(
        F.max("base").alias("base"), F.collect_list("edge").alias("edges"))
    index = per_cell.groupBy("cell_x", "cell_y").agg(
        F.collect_list(F.struct("poly_id", "base", "edges")).alias("polygons"))
    index = materialise(index, "polygon-cells")
    return PolygonIndex(index, size, index_items(index) <= BROADCAST_ITEMS)


def index_items(cells: DataFrame) -> int:
    """Edges and (cell, polygon) pairs that an index holds."""
    return cells.select(F.explode("polygons").alias("p")).agg(
        F.sum(F.size("p.edges") + 1).alias("n")).first()["n"] or 0


def _join_cells(rows: DataFrame, index: DataFrame, small: bool, keys: list[str]) -> DataFrame:
    if small:
        return rows.join(F.broadcast(index), keys, "left")
    return salted_join(rows, index, keys, "left")


def polygons_at(
    rows: DataFrame, index: PolygonIndex, lon: str, lat: str, name: str, *, closed: bool = False
) -> DataFrame:
    """Add ``name``: ids of the polygons containing the point, NULL or empty if none.

    A point on a boundary counts only when ``closed`` (covers instead of contains).
    """
    keys = [f"__{name}_x", f"__{name}_y"]
    cells = index.cells.select(
        F.col("cell_x").alias(keys[0]), F.col("cell_y").alias(keys[1]),
        F.col("polygons").alias(f"__{name}"),
    )
    x, y = F.col(lon), F.col(lat)
    x0, y0 = (F.col(k) * F.lit(float(index.size)) for k in keys)

    def holds(p: Column) -> Column:
        turned = F.size(F.filter(p.getField("edges"), lambda e: crossed_once(e, x, y, x0, y0)))
        odd = (p.getField("base") + turned) % 2 == 1
        on_edge = F.exists(p.getField("edges"), lambda e: touches(e, x, y))
        return (odd | on_edge) if closed else (odd & ~on_edge)

    # no number is in no cell
    keyed = rows.withColumns({
        k: F.when(~F.isnan(c), cell(c, index.size)) for k, c in zip(keys, (x, y), strict=True)})
    return (
        _join_cells(keyed, cells, index.small, keys)
        .withColumn(name, F.transform(
            F.filter(f"__{name}", holds), lambda p: p.getField("poly_id")))
        .drop(f"__{name}", *keys)
    )


def is_inside(name: str) -> Column:
    """A ``polygons_at`` column names at least one polygon."""
    return F.coalesce(F.size(F.col(name)) > 0, F.lit(False))


# ---------------------------------------------------------------- nearest point

@dataclass(frozen=True)
class GridIndex:
    """Grid points, indexed for a search that is exact at any distance and any grid size.

    ``near`` lists, for every cell of ``size``, the points of its 3 x 3 neighbourhood if there are
    no more than ``LEAF``: a candidate there no farther away than ``size`` is the nearest of all
    points. Rows it can't settle, far from any point or where points are dense, descend
    ``levels``, a quadtree without its empty boxes: boxes around the points of ever larger cells,
    from cells that hold at most ``LEAF`` points up to ``top``, a handful of boxes that hold everything.
    """

    size: float
    near: DataFrame
    small: bool
    levels: list[DataFrame]
    top: list[tuple]


#: Boxes at the top of the index; above that one more level is built.
TOP_BOXES = 16
STEP = 4
#: Points in a list or in a cell of the lowest level, at most. Cells are split until they hold no more.
LEAF = 256
#: Coordinates are rounded to eight decimals, so cells of this size hold one point.
FINEST = 1e-8


def _exploded(points: DataFrame, size: float) -> DataFrame:
    """Every point once for each of the nine cells it is a candidate of."""
    near = F.sequence(F.lit(-1), F.lit(1))
    return points.withColumn("__dx", F.explode(near)).withColumn("__dy", F.explode(near)).select(
        "grid_lon", "grid_lat", (cell("grid_lon", size) + F.col("__dx")).alias("__cx"),
        (cell("grid_lat", size) + F.col("__dy")).alias("__cy"))


def _near_lists(points: DataFrame, size: float) -> DataFrame:
    """The candidates of every cell that has at most ``LEAF``: dense cells are counted, never collected."""
    listed = _exploded(points, size)
    dense = listed.groupBy("__cx", "__cy").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF).select("__cx", "__cy")
    per_cell = listed.join(dense, ["__cx", "__cy"], "left_anti").groupBy("__cx", "__cy")
    return per_cell.agg(F.collect_list(F.struct("grid_lon", "grid_lat")).alias("__candidates"))


def _lowest_width(points: DataFrame, size: float) -> float:
    """The largest width, by steps from ``size`` down, whose cells hold at most ``LEAF`` points."""
    width = size
    while width > FINEST:
        most = points.groupBy(cell("grid_lon", width), cell("grid_lat", width)).agg(
            F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= LEAF:
            return width
        # points spread evenly over a cell fall to a sixteenth in each step
        width /= STEP
    return width


_BOX = ["xl", "xh", "yl", "yh"]


def grid_index(grid: DataFrame, size: float = CELL) -> GridIndex:
    """Index a grid ``(grid_lon, grid_lat)``; every part of it is stored once."""
    points = materialise(grid.select(
        key8("grid_lon").alias("grid_lon"), key8("grid_lat").alias("grid_lat")
    ).filter("grid_lon IS NOT NULL AND grid_lat IS NOT NULL").distinct(), "grid-points")
    # every point is a candidate of nine cells
    small = is_small(points, BROADCAST_ITEMS // 9)
    near = materialise(_near_lists(points, size), "grid-near")
    boxes = points.select(
        F.col("grid_lon").alias("xl"), F.col("grid_lon").alias("xh"),
        F.col("grid_lat").alias("yl"), F.col("grid_lat").alias("yh"))
    levels, width = [], _lowest_width(points, size)
    while True:
        child = boxes.withColumns({"px": cell("xl", width), "py": cell("yl", width)})
        levels.append(materialise(child, f"grid-level{len(levels)}"))
        boxes = levels[-1].groupBy("px", "py").agg(
            F.min("xl").alias("xl"), F.max("xh").alias("xh"),
            F.min("yl").alias("yl"), F.max("yh").alias("yh")
        ).withColumnsRenamed({"px": "cx", "py": "cy"})
        top = boxes.select("cx", "cy", *_BOX).limit(TOP_BOXES + 1).collect()
        if len(top) <= TOP_BOXES:
            return GridIndex(size, near, small, levels, [tuple(r) for r in top])
        # coarser cells are unions of finer ones, so a box never leaves its parent
        width *= STEP


def _search(places: DataFrame, index: GridIndex) -> DataFrame:
    """``(x, y, best)`` for distinct places: descend from the top, keeping the boxes whose nearest
    corner is no farther than the farthest corner of any other."""
    box = "struct<cx: bigint, cy: bigint, xl: double, xh: double, yl: double, yh: double>"
    tops = [F.struct(*[F.lit(v) for v in t]).cast(box) for t in index.top]
    found = places.withColumn("__box", F.explode(F.array(*tops) if tops else F.lit(None).cast(f"array<{box}>")))
    found = found.select("x", "y", "__box.*")
    x, y, zero = F.col("x"), F.col("y"), F.lit(0.0)
    for level in reversed(index.levels):
        dx, dy = F.greatest(F.col("xl") - x, x - F.col("xh"), zero), F.greatest(F.col("yl") - y, y - F.col("yh"), zero)
        fx = F.greatest(F.abs(x - F.col("xl")), F.abs(x - F.col("xh")))
        fy = F.greatest(F.abs(y - F.col("yl")), F.abs(y - F.col("yh")))
        bound = F.min(fx * fx + fy * fy).over(Window.partitionBy("x", "y"))
        kept = found.withColumn("__bound", bound).filter(
            dx * dx + dy * dy <= F.col("__bound") * (1 + 1e-9)).select(
            "x", "y", F.col("cx").alias("px"), F.col("cy").alias("py"))
        # a box has few children, and a box that many places share is split by the adaptive join
        found = kept.join(level, ["px", "py"])
        if "cx" not in level.columns:
            break
        found = found.select("x", "y", "cx", "cy", *_BOX)
    d2 = distance2(x, y, F.col("xl"), F.col("yl"))
    return found.groupBy("x", "y").agg(F.min(F.struct(
        d2.alias("d2"), F.col("xl").alias("grid_lon"), F.col("yl").alias("grid_lat"))).alias("best"))


def _closest(candidates: Column, x: Column, y: Column, within: float | None = None) -> Column:
    """Struct (d2, grid_lon, grid_lat) of the closest candidate, NULL if there is none
    ``within`` the distance; ties go to the smaller lon, lat."""
    measured = F.transform(candidates, lambda p: F.struct(
        distance2(x, y, p.getField("grid_lon"), p.getField("grid_lat")).alias("d2"),
        p.getField("grid_lon").alias("grid_lon"),
        p.getField("grid_lat").alias("grid_lat"),
    ))
    if within is not None:
        measured = F.filter(measured, lambda c: c.getField("d2") <= F.lit(within * within))
    return F.array_min(measured)


def _evaluated(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that is computed exactly once per row.

    A plain projection would be merged into its consumers and repeated for each
    of them; a generator is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def nearest_point(
    rows: DataFrame,
    index: GridIndex,
    lon: str,
    lat: str,
    max_distance: float | None = None,
) -> DataFrame:
    """Add ``grid_lon, grid_lat`` of the nearest grid point and its ``grid_distance``.

    Rows without coordinates are dropped, and so are rows farther than
    ``max_distance`` when it is given.
    """
    x, y = col(lon), col(lat)
    out = rows.filter(x.isNotNull() & y.isNotNull())
    out = _join_cells(
        out.withColumns({"__cx": cell(lon, index.size), "__cy": cell(lat, index.size)}),
        index.near, index.small, ["__cx", "__cy"])
    kept = [c for c in out.columns if c not in ("__candidates", "__cx", "__cy")]
    best = _closest(F.col("__candidates"), x, y, index.size)
    out = _evaluated(out, best, "__new").select(*kept, F.col("__new").alias("__best"))
    if max_distance is None or max_distance > index.size:
        far = F.col("__best").isNull()
        places = out.filter(far).select(x.alias("x"), y.alias("y")).distinct()
        places = materialise(_search(places, index), "grid-far").select(
            F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("best").alias("__far"))
        # settled rows carry a NULL key and match nothing
        out = lookup_join(
            out.withColumns({"__x": F.when(far, x), "__y": F.when(far, y)}), places, ["__x", "__y"])
        out = out.withColumn("__best", F.coalesce("__best", "__far")).drop("__x", "__y", "__far")
    out = out.filter(F.col("__best").isNotNull()).withColumns({
        "grid_lon": F.col("__best.grid_lon"), "grid_lat": F.col("__best.grid_lat"),
        "grid_distance": F.sqrt(F.col("__best.d2")),
    }).drop("__best")
    if max_distance is not None:
        out = out.filter(F.col("grid_distance") <= F.lit(float(max_distance)))
    return out
