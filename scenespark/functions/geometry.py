"""Box and polygon geometry as column expressions (all stay in codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenespark import constants as C


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else (v if isinstance(v, Column) else F.lit(v))


def clamp(v, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(v)))


def clamp01(v) -> Column:
    return clamp(v, 0.0, 1.0)


def box_area(x1, y1, x2, y2) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, _c(x2) - _c(x1)) * F.greatest(zero, _c(y2) - _c(y1))


def iou(a, b) -> Column:
    """Intersection over union of two corner boxes; 0.0 when the union is empty."""
    ax1, ay1, ax2, ay2 = map(_c, a)
    bx1, by1, bx2, by2 = map(_c, b)
    inter = box_area(
        F.greatest(ax1, bx1), F.greatest(ay1, by1), F.least(ax2, bx2), F.least(ay2, by2)
    )
    union = box_area(*a) + box_area(*b) - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(inter / union)


def _crosses(px, py, xi, yi, xj, yj) -> Column:
    """Does the ray going right from the point cross this polygon edge?"""
    at = (xj - xi) * (py - yi) / (yj - yi + F.lit(1e-12)) + xi
    return ((yi > py) != (yj > py)) & (px < at)


def in_polygon(px, py, vertices) -> Column:
    """Ray casting against a constant polygon: unrolled arithmetic, no join.

    Edges are half open, so of two zones sharing a horizontal edge exactly one
    owns it. Horizontal edges can never be crossed and are left out.
    """
    px, py = _c(px), _c(py)
    ring = list(vertices)
    hits = [
        F.when(_crosses(px, py, *(F.lit(float(v)) for v in (*a, *b))), 1).otherwise(0)
        for a, b in zip(ring, ring[-1:] + ring[:-1])
        if a[1] != b[1]
    ]
    if not hits:
        return F.lit(False)
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total % 2 == 1


def in_polygon_array(px, py, polygon) -> Column:
    """The same test when the polygon is a column ``array<struct<x,y>>``."""
    px, py, poly = _c(px), _c(py), _c(polygon)
    shifted = F.concat(F.slice(poly, -1, 1), F.slice(poly, 1, F.greatest(F.size(poly) - 1, F.lit(0))))
    edges = F.arrays_zip(poly.alias("a"), shifted.alias("b"))
    crossed = F.filter(
        edges,
        lambda e: _crosses(px, py, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]),
    )
    return F.when(F.size(poly) > 0, F.size(crossed) % 2 == 1).otherwise(F.lit(False))


def corners_to_center(xmin, ymin, xmax, ymax, width, height) -> dict[str, Column]:
    """Corner box in pixels -> centre box as shares of the image."""
    xmin, ymin, xmax, ymax, width, height = map(_c, (xmin, ymin, xmax, ymax, width, height))
    return {
        "cx": ((xmin + xmax) / 2) / width,
        "cy": ((ymin + ymax) / 2) / height,
        "w": (xmax - xmin) / width,
        "h": (ymax - ymin) / height,
    }


def oriented_to_corners(points) -> dict[str, Column]:
    """Four corner points ``[x1, y1, .. x4, y4]`` (array column) -> axis-aligned box."""
    p = _c(points)
    xs = [F.get(p, F.lit(i)) for i in (0, 2, 4, 6)]
    ys = [F.get(p, F.lit(i)) for i in (1, 3, 5, 7)]
    return {
        "xmin": F.least(*xs),
        "ymin": F.least(*ys),
        "xmax": F.greatest(*xs),
        "ymax": F.greatest(*ys),
    }


def box_is_valid(cx, cy, w, h) -> Column:
    """Strictly positive and at most one on all four values."""
    ok = F.lit(True)
    for v in map(_c, (cx, cy, w, h)):
        ok = ok & (v > 0) & (v <= 1)
    return ok


def label_is_valid(class_id, cx, cy, w, h) -> Column:
    """Centre in [0, 1], size in (0, 1], known class."""
    class_id, cx, cy, w, h = map(_c, (class_id, cx, cy, w, h))
    return (
        cx.between(0, 1) & cy.between(0, 1)
        & (w > 0) & (w <= 1) & (h > 0) & (h <= 1)
        & class_id.between(0, C.NUM_CLASSES - 1)
    )


def at_least_px(w, h, size: int = C.IMG_SIZE, px: int = C.MIN_BOX_PX) -> Column:
    return (_c(w) * size >= px) & (_c(h) * size >= px)


def fit_inside(cx, cy, w, h) -> dict[str, Column]:
    """Pull the centre off the rim and shrink the box to stay inside the image."""
    cx, cy = clamp(cx, 0.001, 0.999), clamp(cy, 0.001, 0.999)
    return {
        "cx": cx,
        "cy": cy,
        "w": F.least(_c(w), 2 * F.least(cx, 1 - cx)),
        "h": F.least(_c(h), 2 * F.least(cy, 1 - cy)),
    }


def letterbox(width, height, size: int = C.IMG_SIZE) -> dict[str, Column]:
    """Scale and padding that fit an image into a square keeping its shape."""
    width, height = _c(width), _c(height)
    scale = F.least(F.lit(size) / width, F.lit(size) / height)
    return {
        "scale": scale,
        "pad_x": F.floor((F.lit(size) - F.floor(width * scale)) / 2),
        "pad_y": F.floor((F.lit(size) - F.floor(height * scale)) / 2),
    }


def letterbox_box(cx, cy, w, h, width, height, size: int = C.IMG_SIZE) -> dict[str, Column]:
    """Centre box moved into the letterboxed square."""
    lb = letterbox(width, height, size)
    width, height = _c(width), _c(height)
    return fit_inside(
        (_c(cx) * width * lb["scale"] + lb["pad_x"]) / size,
        (_c(cy) * height * lb["scale"] + lb["pad_y"]) / size,
        _c(w) * width * lb["scale"] / size,
        _c(h) * height * lb["scale"] / size,
    )


def tile_offsets(side, size: int = C.IMG_SIZE, stride: int = C.TILE_STRIDE) -> Column:
    """Sorted start offsets covering ``side``; the last tile is flush to the edge."""
    side = _c(side).cast("int")
    regular = F.sequence(F.lit(0), F.greatest(F.lit(0), side - size), F.lit(stride))
    flush = F.greatest(F.lit(0), side - size)
    return F.array_sort(F.array_union(regular, F.array(flush)))


def tiles_holding(center, side, size: int = C.IMG_SIZE, stride: int = C.TILE_STRIDE) -> Column:
    """Offsets of the tiles whose half-open span holds ``center``.

    The candidates come from the centre by arithmetic (at most
    ``ceil(size / stride)`` regular tiles and the flush one), so no tile list is
    ever joined or scanned.
    """
    center, side = _c(center), _c(side).cast("int")
    flush = F.greatest(F.lit(0), side - size)
    last = F.floor(flush / stride)
    first_k = F.greatest(F.lit(0), F.floor((center - size) / stride) + 1)
    last_k = F.least(last, F.floor(center / stride))
    regular = F.when(
        (first_k <= last_k), F.transform(F.sequence(first_k, last_k), lambda k: (k * stride).cast("int"))
    ).otherwise(F.array().cast("array<int>"))
    edge = F.when(
        (flush <= center) & (center < flush + size), F.array(flush)
    ).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_union(regular, edge))


def flip_horizontal(cx) -> Column:
    return F.lit(1.0) - _c(cx)
