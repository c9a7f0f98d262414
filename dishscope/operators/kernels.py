"""Raster kernels over numpy planes of one plate: (rows, columns), row 0 on top.

They run inside grouped-map functions, one plate a task; whatever can be said per
pixel, per window or per group is a DataFrame expression elsewhere.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

#: More than any distance in pixels.
FAR = 1 << 30


def _slide(x: np.ndarray, r: int, axis: int, mean: bool) -> np.ndarray:
    """Sum or mean over [k - r, k + r], cut at the ends."""
    n = x.shape[axis]
    total = np.concatenate([np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis=axis)], axis=axis)
    lo, hi = np.maximum(np.arange(n) - r, 0), np.minimum(np.arange(n) + r + 1, n)
    out = np.take(total, hi, axis) - np.take(total, lo, axis)
    if mean:
        shape = [1] * x.ndim
        shape[axis] = n
        out = out / (hi - lo).reshape(shape)
    return out


def box_sum(x: np.ndarray, r: int) -> np.ndarray:
    return _slide(_slide(x.astype(float), r, 0, False), r, 1, False)


def box_blur(x: np.ndarray, r: int, passes: int = 3) -> np.ndarray:
    x = x.astype(float)
    for _ in range(passes):
        x = _slide(_slide(x, r, 0, True), r, 1, True)
    return x


def box_mean(x: np.ndarray, r: int, w: np.ndarray | None = None) -> np.ndarray:
    if r <= 0:
        return x.astype(float)
    if w is None:
        return box_blur(x, r, 1)
    den = box_sum(w, r)
    return np.divide(box_sum(np.where(w > 0, x, 0) * w, r), den, out=np.full(x.shape, np.nan), where=den > 0)


def gauss_radius(sigma: float) -> int:
    """Half-width of the box whose three passes have this standard deviation."""
    return max(1, int(np.rint((np.sqrt(4 * sigma * sigma + 1) - 1) / 2)))


def gauss_blur(x: np.ndarray, sigma: float, w: np.ndarray | None = None) -> np.ndarray:
    if sigma <= 0.5:
        return x.astype(float)
    r = gauss_radius(sigma)
    if w is None:
        return box_blur(x, r)
    w = w.astype(float)
    den = box_blur(w, r)
    return np.divide(box_blur(np.where(w > 0, x, 0) * w, r), den, out=np.full(x.shape, np.nan), where=den >= 1e-6)


def local_sd(x: np.ndarray, r: int, w: np.ndarray | None = None) -> np.ndarray:
    return np.sqrt(np.maximum(box_mean(x * x, r, w) - box_mean(x, r, w) ** 2, 0))


def neighbours(mask: np.ndarray) -> list[np.ndarray]:
    """The four neighbours of every pixel; outside counts as false."""
    p = np.pad(mask, 1)
    return [p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]


def mask_boundary(mask: np.ndarray) -> np.ndarray:
    up, down, left, right = neighbours(mask)
    return mask & ~(up & down & left & right)


def perimeter(mask: np.ndarray) -> float:
    return float(sum((mask & ~n).sum() for n in neighbours(mask)) * np.pi / 4)


def along_columns(mask: np.ndarray) -> np.ndarray:
    """Distance of every pixel to the nearest false one in its column; height plus width without one."""
    h, w = mask.shape
    up = np.where(mask, np.int32(h + w), np.int32(0))
    for k in range(1, h):
        np.minimum(up[k], up[k - 1] + 1, out=up[k])
    for k in range(h - 2, -1, -1):
        np.minimum(up[k], up[k + 1] + 1, out=up[k])
    return up


def within(mask: np.ndarray, r: float) -> np.ndarray:
    """Pixels whose distance to a false pixel is at most ``r``, without working out the distance."""
    up, w = along_columns(mask), mask.shape[1]
    up[up >= sum(mask.shape)] = 1 << 30  # none in the column
    out = up <= r
    for dx in range(1, min(int(r), w - 1) + 1):
        near = up <= math.sqrt(r * r - dx * dx)
        out[:, dx:] |= near[:, :-dx]
        out[:, :-dx] |= near[:, dx:]
    return out


def across_rows(up: np.ndarray) -> np.ndarray:
    """Squared distance of every pixel of each row, from its columns' distances.

    Each row is the lower envelope of its columns' parabolas, built for all rows at
    once, so work is linear in the pixels.
    """
    n, w = up.shape
    out = np.zeros((n, w), np.int64)
    g2 = np.ascontiguousarray(up.T.astype(np.int64) ** 2)  # a line for each column
    row, top = np.arange(n), np.zeros(n, np.int64)
    owner, since = np.zeros((w, n), np.int64), np.zeros((w, n), np.int64)  # parabolas of the envelope, and where each begins
    for u in range(1, w):
        new, live = g2[u], row
        while len(live):  # parabolas that the new one covers from their start on
            t = top[live]
            i, x = owner[t, live], since[t, live]
            covered = (x - i) ** 2 + g2[i, live] > (x - u) ** 2 + new[live]
            live = live[covered]
            top[live] -= 1
            live = live[top[live] >= 0]
        empty = top < 0
        t = np.maximum(top, 0)
        i = owner[t, row]
        first = np.where(empty, 0, 1 + (u * u - i * i + new - g2[i, row]) // (2 * np.maximum(u - i, 1)))
        take = np.nonzero(first < w)[0]
        top[take] += 1
        owner[top[take], take] = u
        since[top[take], take] = first[take]
    for u in range(w - 1, -1, -1):
        i = owner[top, row]
        out[:, u] = (u - i) ** 2 + g2[i, row]
        top -= (since[top, row] == u) & (top > 0)
    return out


def edt(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of true pixels to the nearest false one; infinite without one.

    Distances down the columns first, then ``across_rows``.
    """
    h, w = mask.shape
    out = np.zeros((h, w))
    if not mask.any():
        return out
    if mask.all():
        return np.full((h, w), np.inf)
    # only rows with something to measure
    rows = np.nonzero(mask.any(axis=1))[0]
    out[rows] = np.sqrt(across_rows(along_columns(mask)[rows]))
    return out


def edt_band(mask: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """``edt`` of some rows of a picture, whose columns' nearest false pixels outside lie so far before the first and after the last row (``FAR``: none)."""
    up = np.where(mask, np.int64(FAR), np.int64(0))
    up[0] = np.where(mask[0], above, 0)
    for k in range(1, len(up)):
        np.minimum(up[k], up[k - 1] + 1, out=up[k])
    up[-1] = np.where(mask[-1], np.minimum(up[-1], below), 0)
    for k in range(len(up) - 2, -1, -1):
        np.minimum(up[k], up[k + 1] + 1, out=up[k])
    out, rows = np.zeros(mask.shape), np.nonzero(mask.any(axis=1))[0]
    if len(rows):
        squares = across_rows(np.minimum(up[rows], FAR))
        out[rows] = np.where(squares < FAR * FAR, np.sqrt(squares), np.inf)
    return out


def edt_local(mask: np.ndarray, pad: int = 2) -> np.ndarray:
    """``edt`` on the bounding box; a box that meets the image's edge counts the outside as false."""
    out = np.zeros(mask.shape)
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return out
    y0, y1 = max(0, ys.min() - pad), min(mask.shape[0], ys.max() + pad + 1)
    x0, x1 = max(0, xs.min() - pad), min(mask.shape[1], xs.max() + pad + 1)
    part = mask[y0:y1, x0:x1]
    edge = y0 == 0 or x0 == 0 or y1 == mask.shape[0] or x1 == mask.shape[1]
    d = edt(np.pad(part, 1))[1:-1, 1:-1] if edge else edt(part)
    out[y0:y1, x0:x1] = d
    return out


def erode(mask: np.ndarray, r: float) -> np.ndarray:
    """True pixels farther than ``r`` from any false one."""
    return mask if r <= 0 else ~within(mask, r)


def dilate(mask: np.ndarray, r: float) -> np.ndarray:
    """Pixels at most ``r`` from a true one."""
    return mask if r <= 0 or not mask.any() else within(~mask, r)


def opened(mask: np.ndarray, r: float) -> np.ndarray:
    return dilate(erode(mask, r), r)


def closed(mask: np.ndarray, r: float) -> np.ndarray:
    return erode(dilate(mask, r), r)


def components(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Labels 1..n by first appearance down the columns, from the left; 0 elsewhere.

    Runs along rows are joined with the runs they touch in the row above.
    """
    out = np.zeros(mask.shape, np.int64)
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    n = len(row)
    if not n:
        return out
    reach = 1 if connectivity == 8 else 0
    width = mask.shape[1] + 3
    # runs of the row above that reach [start - reach, end + reach)
    lo = np.searchsorted(row * width + end, (row - 1) * width + start - reach, side="right")
    hi = np.searchsorted(row * width + start, (row - 1) * width + end + reach, side="left")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), count)
    b = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, root, start * mask.shape[0] + row)
    roots = np.unique(root)
    label = np.zeros(n, np.int64)
    label[roots[np.argsort(first[roots])]] = np.arange(1, len(roots) + 1)
    out[mask] = np.repeat(label[root], end - start)
    return out


def remove_small(mask: np.ndarray, least: float) -> np.ndarray:
    lab = components(mask)
    return mask & (np.bincount(lab.ravel())[lab] >= least)


def largest(mask: np.ndarray) -> np.ndarray:
    if not mask.any():
        return mask
    lab = components(mask)
    return lab == 1 + np.argmax(np.bincount(lab.ravel())[1:])


def fill_holes(mask: np.ndarray, forbid: np.ndarray | None = None) -> np.ndarray:
    lab = components(~mask, 4)
    keep = np.zeros(lab.max() + 1, bool)
    keep[0] = True
    for side in (lab[0], lab[-1], lab[:, 0], lab[:, -1]):
        keep[side] = True
    if forbid is not None:
        keep[lab[forbid & ~mask]] = True
    return mask | ~keep[lab]


def hull_area(x: np.ndarray, y: np.ndarray) -> float:
    """Area of the convex hull of the pixels' corners."""
    if len(x) < 3:
        return float(len(x))
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    first = np.append(True, np.diff(y) != 0)
    last = np.append(np.diff(y) != 0, True)
    pts = sorted({(px + dx, py + dy) for px, py, s in [*zip(x[first], y[first], [-0.5] * first.sum()), *zip(x[last], y[last], [0.5] * last.sum())] for dx in (s,) for dy in (-0.5, 0.5)})

    def half(points) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    h = np.array(half(pts) + half(pts[::-1]))
    return float(abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))) / 2)


def bilinear(plane: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples at 1-based places; missing outside."""
    h, w = plane.shape
    ok = (x >= 1) & (x <= w) & (y >= 1) & (y <= h)
    x0 = np.clip(np.floor(x).astype(int), 1, max(w - 1, 1)) - 1
    y0 = np.clip(np.floor(y).astype(int), 1, max(h - 1, 1)) - 1
    fx, fy = x - 1 - x0, y - 1 - y0
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    v = plane[y0, x0] * (1 - fx) * (1 - fy) + plane[y0, x1] * fx * (1 - fy) + plane[y1, x0] * (1 - fx) * fy + plane[y1, x1] * fx * fy
    return np.where(ok, v, np.nan)


def resize_area(planes: np.ndarray, factor: float) -> np.ndarray:
    """Mean of the pixels whose centre is in each cell of the smaller grid."""
    h, w = planes.shape[:2]
    nh, nw = max(1, int(np.rint(h * factor))), max(1, int(np.rint(w * factor)))
    by = np.minimum(((np.arange(h) + 0.5) * nh / h).astype(int), nh - 1)
    bx = np.minimum(((np.arange(w) + 0.5) * nw / w).astype(int), nw - 1)
    cell = (by[:, None] * nw + bx[None, :]).ravel()
    n = np.bincount(cell, minlength=nh * nw)
    flat = planes.reshape(h * w, -1)
    return np.stack([np.bincount(cell, flat[:, c], nh * nw) / n for c in range(flat.shape[1])], axis=1).reshape(nh, nw, *planes.shape[2:])


def resize_nearest(plane: np.ndarray, nh: int, nw: int) -> np.ndarray:
    h, w = plane.shape[:2]
    at = lambda n, m: np.clip(np.ceil((np.arange(n) + 0.5) * m / n).astype(int), 1, m) - 1
    return plane[at(nh, h)][:, at(nw, w)]


def otsu_threshold(x: np.ndarray, bins: int = 256) -> float:
    x = x[np.isfinite(x)]
    lo, hi = x.min(), x.max()
    if lo == hi:
        return float(lo)
    n = np.bincount(np.minimum(((x - lo) / (hi - lo) * bins).astype(int), bins - 1), minlength=bins).astype(float)
    mid = lo + (np.arange(bins) + 0.5) * (hi - lo) / bins
    w, m = np.cumsum(n), np.cumsum(n * mid)
    rest = w[-1] - w
    between = np.divide((m[-1] * w / w[-1] - m) ** 2, w * rest, out=np.zeros(bins), where=(w > 0) & (rest > 0))
    return float(lo + (int(np.argmax(between)) + 1) * (hi - lo) / bins)


def watershed(cost: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Flood the mask from the markers in the order of cost.

    A pixel taken from the queue gets the label of the cheapest of its labelled
    neighbours; those beside markers queue at their own cost, later ones at the
    current level at least.  What no flood reaches stays 0.  Only the mask's
    box is flooded, as one row of numbers with a border that is never entered.
    """
    out = np.zeros(mask.shape, np.int64)
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return out
    box = (slice(ys.min(), ys.max() + 1), slice(xs.min(), xs.max() + 1))
    inside = np.pad(mask[box], 1)
    start = np.pad(np.where(mask[box], markers[box], 0), 1)
    w = inside.shape[1]
    # first straight, then diagonal neighbours: ties go to the first
    around = (-w, w, -1, 1, -w - 1, -w + 1, w - 1, w + 1)
    level, label = np.pad(cost[box], 1).ravel().tolist(), start.ravel().tolist()
    closed_ = (~inside | (start > 0)).ravel()
    beside = np.zeros(closed_.shape, bool)
    seeds = np.nonzero(start.ravel())[0]
    for step in around:
        beside[seeds + step] = True
    first = np.nonzero((beside & ~closed_).reshape(inside.shape).T.ravel())[0]  # down the columns
    heap = []
    for tick, k in enumerate(first.tolist()):
        at = (k % inside.shape[0]) * w + k // inside.shape[0]
        heap.append((level[at], tick, at))
        closed_[at] = True
    heapq.heapify(heap)
    tick, done = len(heap), closed_.tolist()
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        now, _, at = pop(heap)
        best, own = None, 0
        for step in around:
            k = at + step
            if label[k]:
                if best is None or level[k] < best:
                    best, own = level[k], label[k]
            elif not done[k]:
                done[k] = True
                push(heap, (level[k] if level[k] > now else now, tick, k))
                tick += 1
        label[at] = own
    out[box] = np.array(label).reshape(inside.shape)[1:-1, 1:-1]
    return out


def find_cores(depth: np.ndarray, mask: np.ndarray, least: float, most: int = 20) -> list[tuple[float, float, float]]:
    """(x, y, depth), deepest first (then down the columns), each clearing a disk of 1.5 times its depth around it; 1-based."""
    xs, ys = np.nonzero((mask & (depth >= least)).T)
    d = depth[ys, xs]
    order = np.argsort(-d, kind="stable")
    xs, ys, d = xs[order], ys[order], d[order]
    out: list[tuple[float, float, float]] = []
    while len(d) and len(out) < most:
        x, y, deep = xs[0], ys[0], float(d[0])
        out.append((float(x + 1), float(y + 1), deep))
        free = (xs - x) ** 2 + (ys - y) ** 2 > (1.5 * max(deep, least)) ** 2
        xs, ys, d = xs[free], ys[free], d[free]
    return out


def match_cores(cores: list[tuple[float, float, float]], expected: list[tuple[str, float, float]], reach: float) -> dict[str, tuple[float, float, float]]:
    """Expected colony -> core: the nearest pair first, each used once; cores much shallower than the deepest are none."""
    if not cores:
        return {}
    deep = max(c[2] for c in cores)
    pairs = sorted((np.hypot(c[0] - x, c[1] - y), k, j) for k, (_, x, y) in enumerate(expected) for j, c in enumerate(cores) if c[2] >= 0.3 * deep)
    out: dict[str, tuple[float, float, float]] = {}
    used: set[int] = set()
    for d, k, j in pairs:
        name = expected[k][0]
        if d <= reach and name not in out and j not in used:
            out[name] = cores[j]
            used.add(j)
    return out
