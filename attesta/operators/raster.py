"""Raster kernels in numpy, run over one image per row with mapInPandas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grayscale(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def paleness(rgb: np.ndarray) -> np.ndarray:
    x = rgb[..., :3].astype(np.float64)
    high, low = x.max(-1), x.min(-1)
    return high / 255 - 0.5 * np.divide(high - low, high, out=np.zeros_like(high), where=high > 0)


def box_sums(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts over clipped square windows, from an integral image."""
    whole = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    whole[1:, 1:] = x.cumsum(0).cumsum(1)
    ys, xs = np.arange(x.shape[0]), np.arange(x.shape[1])
    t, b = np.maximum(ys - radius, 0), np.minimum(ys + radius + 1, x.shape[0])
    l, r = np.maximum(xs - radius, 0), np.minimum(xs + radius + 1, x.shape[1])
    return whole[b][:, r] - whole[t][:, r] - whole[b][:, l] + whole[t][:, l], (b - t)[:, None] * (r - l)[None, :]


def box_mean(x: np.ndarray, radius: int) -> np.ndarray:
    s, n = box_sums(x, radius)
    return s / n


def blur3(x: np.ndarray) -> np.ndarray:
    """3x3 mean of the interior; the border stays 0."""
    out = np.zeros_like(x, dtype=np.float64)
    if min(x.shape) > 2:
        out[1:-1, 1:-1] = sum(x[1 + dy : x.shape[0] - 1 + dy, 1 + dx : x.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) / 9
    return out


def otsu(x: np.ndarray, bins: int, low: float, high: float) -> int:
    n = np.bincount(np.clip(((x - low) / max(high - low, 1e-12) * bins).astype(int), 0, bins - 1).ravel(), minlength=bins)
    c, m = n.cumsum(), (n * np.arange(bins)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.nan_to_num(c * (c[-1] - c) * (m / c - (m[-1] - m) / (c[-1] - c)) ** 2)
    return int(np.argmax(v)) if v.max() > 0 else bins // 2 - 1


def regions(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected labels of a mask (0: background), numbered in reading order of their first pixel."""
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape) + 1, 0)
    while True:
        new = label.copy()
        for a, b in ((np.s_[1:, :], np.s_[:-1, :]), (np.s_[:-1, :], np.s_[1:, :]), (np.s_[:, 1:], np.s_[:, :-1]), (np.s_[:, :-1], np.s_[:, 1:])):
            both = (new[a] > 0) & (new[b] > 0)
            new[a] = np.where(both, np.minimum(new[a], new[b]), new[a])
        on = new > 0
        new[on] = new.ravel()[new[on] - 1]
        if np.array_equal(new, label):
            break
        label = new
    kinds = np.unique(label[label > 0])
    return np.where(label > 0, np.searchsorted(kinds, label) + 1, 0), len(kinds)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the leftmost lowest point."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(order: np.ndarray) -> list:
        chain: list = []
        for p in order:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def area(polygon: np.ndarray) -> float:
    x, y = polygon[:, 0], polygon[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def hull_by_key(points: DataFrame, key: str) -> DataFrame:
    """(key, corners, area) of the convex hull of each key's points (key, x, y).

    A hull's corners are among those of the hulls of its parts: each batch of
    rows gives its keys' hulls, and only these are shuffled; they meet in two
    steps, so that no key's points are ever one task's.
    """
    kind = points.schema[key].dataType.simpleString()

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [pd.DataFrame(hull(g[["x", "y"]].to_numpy()), columns=["x", "y"]).assign(**{key: k}) for k, g in b.groupby(key)]
            if parts:
                yield pd.concat(parts)[[key, "x", "y"]]

    def partial(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(hull(g[["x", "y"]].to_numpy()), columns=["x", "y"]).assign(**{key: k[0]})[[key, "x", "y"]]

    def whole(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        h = hull(g[["x", "y"]].to_numpy())
        return pd.DataFrame({key: [k[0]], "corners": [len(h)], "area": [round(area(h), 6)]})

    schema = f"{key} {kind}, x double, y double"
    some = points.select(key, "x", "y").where(F.col(key).isNotNull()).mapInPandas(corners, schema)
    some = some.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(64))).groupBy(key, "part").applyInPandas(partial, schema)
    return some.groupBy(key).applyInPandas(whole, f"{key} {kind}, corners long, area double")


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3x3 map that carries four points of src to dst; a singular system is an error."""
    rows, rhs = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(rhs, float)), 1.0).reshape(3, 3)


def warp(image: np.ndarray, to_source: np.ndarray, width: int, height: int, fill: float = 255) -> np.ndarray:
    """Nearest-neighbour sampling through the map from output to source; outside is white."""
    y, x = np.mgrid[0:height, 0:width]
    p = to_source @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    sx, sy = np.floor(p[0] / p[2] + 0.5).astype(int), np.floor(p[1] / p[2] + 0.5).astype(int)
    ok = (sx >= 0) & (sy >= 0) & (sx < image.shape[1]) & (sy < image.shape[0])
    out = np.full((height * width, *image.shape[2:]), fill, dtype=image.dtype)
    out[ok] = image[sy[ok], sx[ok]]
    return out.reshape(height, width, *image.shape[2:])


def projection_score(gray: np.ndarray, angle: float, dark: float = 190.0, stride: int = 2) -> float:
    """How sharply the rows of dark pixels stand out when the image is turned by an angle in degrees."""
    y, x = np.mgrid[0 : gray.shape[0] : stride, 0 : gray.shape[1] : stride]
    on = gray[::stride, ::stride] <= dark
    t = np.tan(np.deg2rad(angle))
    row = np.floor(y[on] - x[on] * t + 0.5).astype(int)
    inside = (row >= 0) & (row < gray.shape[0])
    n = np.bincount(row[inside], weights=255 - gray[::stride, ::stride][on][inside], minlength=gray.shape[0])
    return float((np.diff(n) ** 2).sum())


def skew(gray: np.ndarray) -> float:
    """The angle from -5 to 5 degrees, by halves, with the best projection; 0 wins a tie."""
    best, found = projection_score(gray, 0.0), 0.0
    for a in np.arange(-5, 5.01, 0.5):
        s = projection_score(gray, float(a))
        if s > best:
            best, found = s, float(a)
    return found


def ink(gray: np.ndarray, radius: int = 14, margin: float = 18.0) -> np.ndarray:
    """Pixels darker than the mean around them."""
    return gray < box_mean(gray, radius) - margin


def text_rows(mask: np.ndarray, transitions: int = 24) -> np.ndarray:
    return (np.diff(mask.astype(int), axis=1) != 0).sum(1) >= transitions


def expand(quad: np.ndarray, share: float = 0.012) -> np.ndarray:
    """A quadrilateral grown from its centre by a share of its size."""
    centre = quad.mean(0)
    return centre + (quad - centre) * (1 + 2 * share)


def card_quad(rgb: np.ndarray, step: float = 0.05, levels: int = 10, tolerance: float = 0.02) -> tuple[np.ndarray | None, float]:
    """Corners of the card: the extreme points of the largest plausible region that stays put over several thresholds."""
    pale, size = paleness(rgb), np.array(rgb.shape[1::-1])
    best: tuple[np.ndarray | None, int] = (None, 0)
    for light in (1, -1):
        x = pale * light
        base = (otsu(x, 128, x.min(), x.max()) + 1) / 128 * (x.max() - x.min()) + x.min()
        run: list[np.ndarray] = []
        for k in range(levels):
            quad = _candidate(x > base - 0.05 + k * step * (x.max() - x.min()) / 4, size)
            if quad is None or (run and np.abs(quad - run[-1]).max() > tolerance * size.max()):
                run = []
            if quad is not None:
                run.append(quad)
            if len(run) >= 3 and len(run) > best[1]:
                best = (run[len(run) // 2], len(run))
    if best[0] is None:
        return None, 0.0
    return np.clip(expand(best[0]), 0, size), min(1.0, 0.5 + best[1] / (2 * levels))


def _candidate(mask: np.ndarray, size: np.ndarray) -> np.ndarray | None:
    label, n = regions(mask)
    found: tuple[float, np.ndarray | None] = (0.0, None)
    for k in range(1, n + 1):
        y, x = np.nonzero(label == k)
        if len(x) < 0.05 * size.prod():
            continue
        pts = np.stack([x, y], 1)
        big = area(hull(pts))
        s, d = x + y, x - y
        quad = pts[[s.argmin(), d.argmax(), s.argmax(), d.argmin()]].astype(float)
        sides = np.linalg.norm(quad - np.roll(quad, -1, 0), axis=1)
        if 0.08 <= big / size.prod() <= 0.9 and area(quad) >= 0.85 * big and sides.min() >= 0.15 * size.min() and big > found[0]:
            found = (big, quad)
    return found[1]


def over_images(images: DataFrame, schema: str, kernel: Callable[[np.ndarray], list[dict]], id_col: str = "doc_id") -> DataFrame:
    """Run a kernel over (id, width, height, channels, data) rows; each gives any number of result rows with the id."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                x = np.frombuffer(r.data, dtype=np.uint8).reshape(int(r.height), int(r.width), int(r.channels))
                out += [{id_col: getattr(r, id_col), **f} for f in kernel(x)]
            names = [c.split()[0] for c in schema.split(", ")]
            yield pd.DataFrame(out, columns=names)

    return images.mapInPandas(work, schema)
