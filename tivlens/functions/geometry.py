"""Planar geometry as column expressions.

Polygons are edge lists ``(x1, y1, x2, y2)``; rings need no orientation and
holes or several parts need no marking, because membership is the parity of
edge crossings over all rings together.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def straddles(a: Column, b: Column, line: Column) -> Column:
    """One of the two values lies beyond the line and the other doesn't (a value on it doesn't)."""
    return (a > line) != (b > line)


def on_left(edge: Column, x: Column, y: Column) -> Column:
    """(x, y) lies to the left of the edge's direction; a point on the edge counts as moved towards +x, then +y.

    The one predicate behind all parity tests: whichever way two of them reach a point, they
    agree on the side it is on.
    """
    x1, y1 = edge.getField("x1"), edge.getField("y1")
    x2, y2 = edge.getField("x2"), edge.getField("y2")
    turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    return (turn > 0) | ((turn == 0) & ((y2 < y1) | ((y2 == y1) & (x2 > x1))))


def crosses(edge: Column, x: Column, y: Column) -> Column:
    """The ray from (x, y) towards +x crosses the edge (half-open in y)."""
    y1, y2 = edge.getField("y1"), edge.getField("y2")
    return straddles(y1, y2, y) & (on_left(edge, x, y) == (y2 > y1))


def crossed_once(edge: Column, x: Column, y: Column, x0: Column, y0: Column) -> Column:
    """The way from (x, y) along y to x0 and on along x0 to y0 crosses the edge an odd number of times."""
    level = straddles(edge.getField("y1"), edge.getField("y2"), y)
    upright = straddles(edge.getField("x1"), edge.getField("x2"), x0)
    turning = on_left(edge, x0, y)
    return (level & (on_left(edge, x, y) != turning)) != (upright & (turning != on_left(edge, x0, y0)))


def touches(edge: Column, x: Column, y: Column) -> Column:
    """(x, y) lies on the edge."""
    x1, y1 = edge.getField("x1"), edge.getField("y1")
    x2, y2 = edge.getField("x2"), edge.getField("y2")
    return (
        ((x - x1) * (y2 - y1) == (y - y1) * (x2 - x1))
        & x.between(F.least(x1, x2), F.greatest(x1, x2))
        & y.between(F.least(y1, y2), F.greatest(y1, y2))
    )


def distance2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared planar distance in degrees."""
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)
