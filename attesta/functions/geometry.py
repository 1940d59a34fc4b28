"""Points, quadrilaterals and rectangles as Column functions. A quadrilateral is an array of struct(x, y), corner by corner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import let

#: Height to which a crop is enlarged, and the most it is enlarged by.
CROP_HEIGHT, MOST_SCALE = 110.0, 5.0
#: Inset of the frame that stands in for a card which was not found, and the share of a card's foot that may hold its zone.
FRAME_INSET, FOOT_SHARE = 0.01, 0.45


def rounded(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _turned(q: Column, by: int) -> Column:
    """The corners, from the one `by` places on."""
    return F.transform(q, lambda p, i: F.get(q, (i + by + F.size(q)) % F.size(q)))


def area(q: Column) -> Column:
    terms = F.transform(F.arrays_zip(q.alias("a"), _turned(q, 1).alias("b")), lambda z: z["a"]["x"] * z["b"]["y"] - z["b"]["x"] * z["a"]["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def same_quad(a: Column, b: Column, tolerance: Column) -> Column:
    """Whether no corner has moved by more than the tolerance."""
    return F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: distance(z["a"], z["b"]) <= tolerance)


def expand_quad(q: Column, offset: Column, width: Column, height: Column) -> Column:
    """The quadrilateral whose edges lie further out by an offset, clamped to the image; a corner of parallel edges stays."""
    mean = lambda c: F.aggregate(q, F.lit(0.0), lambda s, p: s + p[c]) / F.size(q)
    inside = lambda x, most: F.greatest(F.lit(0.0), F.least(most - 1.0, x))

    def edge(a: Column, b: Column, middle: Column) -> Column:
        """nx, ny and c of the line nx * x + ny * y = c through two corners, moved away from the middle."""
        length = F.greatest(F.lit(1e-6), distance(a, b))
        nx, ny = (b["y"] - a["y"]) / length, (a["x"] - b["x"]) / length
        sign = F.when(nx * (a["x"] - middle["x"]) + ny * (a["y"] - middle["y"]) < 0, -1.0).otherwise(1.0)
        return F.struct((sign * nx).alias("nx"), (sign * ny).alias("ny"), (sign * (nx * a["x"] + ny * a["y"]) + offset).alias("c"))

    def corners(edges: Column) -> Column:
        def meet(z: Column) -> Column:
            p, n = z["p"], z["n"]
            det = p["nx"] * n["ny"] - p["ny"] * n["nx"]
            x, y = F.try_divide(p["c"] * n["ny"] - p["ny"] * n["c"], det), F.try_divide(p["nx"] * n["c"] - p["c"] * n["nx"], det)
            return F.when(F.abs(det) < 1e-6, z["at"]).otherwise(point(inside(x, width), inside(y, height)))

        return F.transform(F.arrays_zip(_turned(edges, -1).alias("p"), edges.alias("n"), q.alias("at")), meet)

    pairs = F.arrays_zip(q.alias("a"), _turned(q, 1).alias("b"))
    return let(let(point(mean("x"), mean("y")), lambda m: F.transform(pairs, lambda z: edge(z["a"], z["b"], m))), corners)


def whole_frame(width: Column, height: Column) -> Column:
    """The image's own corners, slightly inside it: for a card that was not found."""
    near, far = F.lit(FRAME_INSET), F.lit(1 - FRAME_INSET)
    return F.array(*[point(width * a, height * b) for a, b in ((near, near), (far, near), (far, far), (near, far))])


def bottom_region(width: Column, height: Column) -> Column:
    """The foot of a card that fills the image."""
    top = rounded(height * F.lit(1 - FOOT_SHARE))
    return F.struct(F.lit(0).alias("left"), top.alias("top"), width.alias("width"), (height - top).alias("height"))


def crop(x0: Column, y0: Column, x1: Column, y1: Column, padding: Column, width: Column, height: Column) -> Column:
    """The rectangle around a zone with a margin of a share of its height, and the size to which it is enlarged."""
    pad = (y1 - y0) * padding
    start = lambda a: F.greatest(F.lit(0), rounded(a - pad))
    size = lambda a, b, most: F.least(most - start(a), rounded(b - a + pad * 2))
    w, h = size(x0, x1, width), size(y0, y1, height)
    scale = F.greatest(F.lit(1.0), F.least(F.lit(MOST_SCALE), F.try_divide(F.lit(CROP_HEIGHT), h)))
    return F.struct(start(x0).alias("left"), start(y0).alias("top"), w.alias("width"), h.alias("height"), rounded(w * scale).alias("out_width"), rounded(h * scale).alias("out_height"))


def bounding_crop(q: Column, width: Column, height: Column, least: int = 100) -> Column:
    """struct(left, top, right, bottom) around a quadrilateral within the image; NULL if a side is too short to be a card."""
    xs, ys = F.transform(q, lambda p: p["x"]), F.transform(q, lambda p: p["y"])
    box = F.struct(
        F.greatest(F.lit(0), F.floor(F.array_min(xs))).alias("left"), F.greatest(F.lit(0), F.floor(F.array_min(ys))).alias("top"),
        F.least(width, F.ceil(F.array_max(xs))).alias("right"), F.least(height, F.ceil(F.array_max(ys))).alias("bottom"),
    )
    return let(box, lambda b: F.when((b["right"] - b["left"] >= least) & (b["bottom"] - b["top"] >= least), b))


def point_to_percent(p: Column, width: Column, height: Column) -> Column:
    return point(p["x"] / width * 100, p["y"] / height * 100)


# --- maps between quadrilaterals -----------------------------------------------------------------------------------

#: Least share of its size squared that a quadrilateral's determinant has, below which it counts as degenerate.
LEAST_DETERMINANT = 1e-9


def _matrix(*cells: Column) -> Column:
    return F.array(*[c.cast("double") for c in cells])


def _square_to(q: Column) -> Column:
    """The 3 x 3 map, row by row, of the unit square's corners (0,0), (1,0), (1,1), (0,1) to a quadrilateral's; null if three corners are on a line."""
    p = [F.get(q, F.lit(i)) for i in range(4)]
    x, y = [c["x"] for c in p], [c["y"] for c in p]
    ax, ay, bx, by = x[1] - x[2], y[1] - y[2], x[3] - x[2], y[3] - y[2]
    sx, sy = x[0] - x[1] + x[2] - x[3], y[0] - y[1] + y[2] - y[3]
    size = F.greatest(*[F.abs(v) for v in (ax, ay, bx, by, sx, sy)])
    den = ax * by - bx * ay
    sound = F.when(F.abs(den) > LEAST_DETERMINANT * size * size, den)
    return let(F.struct(((sx * by - bx * sy) / sound).alias("g"), ((ax * sy - sx * ay) / sound).alias("h")), lambda v: F.when(
        v["g"].isNotNull() & v["h"].isNotNull(),
        _matrix(x[1] - x[0] + v["g"] * x[1], x[3] - x[0] + v["h"] * x[3], x[0], y[1] - y[0] + v["g"] * y[1], y[3] - y[0] + v["h"] * y[3], y[0], v["g"], v["h"], F.lit(1.0)),
    ))


def _product(a: Column, b: Column) -> Column:
    cell = lambda i, j: sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j])
    return _matrix(*[cell(i, j) for i in range(3) for j in range(3)])


def _adjugate(m: Column) -> Column:
    """The inverse up to a factor, which a map of points does not mind; null where there is none."""
    minor = lambda r, s, c, d: m[3 * r + c] * m[3 * s + d] - m[3 * r + d] * m[3 * s + c]
    cells = [
        minor(1, 2, 1, 2), -minor(0, 2, 1, 2), minor(0, 1, 1, 2), -minor(1, 2, 0, 2), minor(0, 2, 0, 2), -minor(0, 1, 0, 2),
        minor(1, 2, 0, 1), -minor(0, 2, 0, 1), minor(0, 1, 0, 1),
    ]
    return let(_matrix(*cells), lambda a: F.when(m[0] * a[0] + m[1] * a[3] + m[2] * a[6] != 0, a))


def homography(source: Column, target: Column) -> Column:
    """The projective map of one quadrilateral's corners to another's, nine cells row by row.

    In closed form: the source to the unit square by the adjugate, the square
    to the target. Null where either has three corners on a line or is null.
    """
    return let(_square_to(source), lambda s: let(_adjugate(s), lambda back: let(_square_to(target), lambda t: F.when(back.isNotNull() & t.isNotNull(), _product(t, back)))))


def mapped(h: Column, p: Column) -> Column:
    """A point carried by a map; null for a null map, and for points at the map's horizon."""
    w = h[6] * p["x"] + h[7] * p["y"] + h[8]
    return F.when(w != 0, point((h[0] * p["x"] + h[1] * p["y"] + h[2]) / w, (h[3] * p["x"] + h[4] * p["y"] + h[5]) / w))
