"""Camera motion between two frames, as array kernels over all patches at once.

Everything works on brightness thumbnails. Sums run in float64; scores agree
with single precision to about 1e-4.
"""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np

#: Grid, patch radius, search radius, texture and fit bounds.
GRID_X, GRID_Y, RADIUS, SEARCH, LEAST_TEXTURE = 11, 7, 5, 10, 12.0
LEAST_PIVOT, BASE_FPS = 1e-4, 6.0
LEAST_INLIERS, TOLERANCE, SEEDS, TRIPLES, LEAST_AREA, SPREAD = 10, 1.5, 16, 200, 10.0, 0.25
SCALES = (0.88, 0.90, 0.92, 0.94, 0.96, 0.98, 1.02, 1.04, 1.06, 1.08, 1.10, 1.12)
NEIGHBOURS = np.array([(0, -1), (-1, 0), (1, 0), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1)])
_DY, _DX = (a.ravel() for a in np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1])


def thumbnail_size(w: int, h: int) -> tuple[int, int]:
    th = min(max(h, 24), 144)
    return min(max(w * th // max(h, 1), 24), 288), th


def source_scale(w: int, h: int) -> float:
    """Source pixels of a thumbnail's pixel, the mean over both axes."""
    tw, th = thumbnail_size(w, h)
    return (w / tw + h / th) / 2


def thumbnail(frame: np.ndarray) -> np.ndarray:
    """Brightness of the nearest source pixels of ``frame(height, width[, 3])``, BGR or brightness."""
    h, w = frame.shape[:2]
    tw, th = thumbnail_size(w, h)
    p = frame[(np.arange(th) * h // th)[:, None], np.arange(tw) * w // tw].astype(np.int64)
    return (p if p.ndim == 2 else (29 * p[..., 0] + 150 * p[..., 1] + 77 * p[..., 2]) >> 8).astype(np.uint8)


def patch_centres(w: int, h: int) -> np.ndarray:
    """Distinct (x, y), sorted."""
    margin = SEARCH + RADIUS + 1
    line = lambda n, k: np.unique(min(margin, n - 1) + (max(n - margin - 1, min(margin, n - 1)) - min(margin, n - 1)) * np.arange(k) // (k - 1))
    return np.array([(x, y) for x in line(w, GRID_X) for y in line(h, GRID_Y)])


def texture(luma: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """mean gradient around each centre, without the border of the frame."""
    a, e = luma.astype(np.int64), np.zeros(luma.shape, np.int64)
    e[1:-1, 1:-1] = np.abs(a[1:-1, 2:] - a[1:-1, :-2]) + np.abs(a[2:, 1:-1] - a[:-2, 1:-1])
    inner = np.zeros(luma.shape, np.int64)
    inner[1:-1, 1:-1] = 1
    x, y = centres[:, :1] + _DX, centres[:, 1:] + _DY
    ok = (x >= 0) & (y >= 0) & (x < luma.shape[1]) & (y < luma.shape[0])
    x, y = np.clip(x, 0, luma.shape[1] - 1), np.clip(y, 0, luma.shape[0] - 1)
    return (e[y, x] * ok).sum(1) / np.maximum((inner[y, x] * ok).sum(1), 1)


def patch_shifts(one: np.ndarray, two: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """V2: shift of each patch by descent in steps of 4, 2 and 1; all patches step together, the first best neighbour wins."""
    h, w = one.shape
    x, y = centres[:, :1] + _DX, centres[:, 1:] + _DY
    base = one[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)].astype(np.int64)

    def cost(rows: np.ndarray, s: np.ndarray) -> np.ndarray:
        there = two[np.clip(y[rows] + s[:, 1:], 0, h - 1), np.clip(x[rows] + s[:, :1], 0, w - 1)]
        out = np.abs(base[rows] - there).sum(1) // base.shape[1]
        return np.where((np.abs(s) > SEARCH).any(1), 1 << 20, out)

    shift, rows = np.zeros((len(centres), 2), np.int64), np.arange(len(centres))
    best = cost(rows, shift)
    for step in (4, 2, 1):
        live = rows
        while len(live):
            trial = shift[live][:, None, :] + step * NEIGHBOURS
            c = np.stack([cost(live, trial[:, k]) for k in range(len(NEIGHBOURS))], 1)
            k = c.argmin(1)
            better = c[np.arange(len(live)), k] < best[live]
            live, k, trial, c = live[better], k[better], trial[better], c[better]
            shift[live], best[live] = trial[np.arange(len(live)), k], c[np.arange(len(live)), k]
    return shift


def _solve(gram: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Many 3 x 3 systems at once by elimination with partial pivots; also which have no pivot that is too small."""
    gram, out, each = gram.copy(), right.copy(), np.arange(len(gram))
    sound = np.ones(len(gram), bool)
    for k in range(gram.shape[1]):
        best = k + np.abs(gram[:, k:, k]).argmax(1)
        for x in (gram, out):
            x[each, k], x[each, best] = x[each, best].copy(), x[each, k].copy()
        pivot = gram[:, k, k]
        sound &= np.abs(pivot) >= LEAST_PIVOT
        pivot = np.where(sound, pivot, 1.0)[:, None]
        gram[:, k], out[:, k] = gram[:, k] / pivot, out[:, k] / pivot
        factor = gram[:, :, k].copy()
        factor[:, k] = 0
        gram, out = gram - factor[:, :, None] * gram[:, None, k], out - factor[:, :, None] * out[:, None, k]
    return out, sound


def _fits(a: np.ndarray, d: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Models of groups of rows, both fits of a group sharing one matrix."""
    own, to = a[groups], d[groups]
    turned = own.transpose(0, 2, 1)
    return _solve(turned @ own, turned @ to)


def fit_affine(pos: np.ndarray, d: np.ndarray, w: int, h: int) -> tuple[np.ndarray, int, float] | None:
    """V3: parameters (3 x 2: shift, by x, by y), inliers and their mean residual; ``pos`` is relative to the centre.

    The model of all rows and those of all triples of seeds are solved and
    judged together; the first of the best stays.
    """
    if not len(pos):
        return None
    a = np.column_stack([np.ones(len(pos)), pos])
    far = (pos**2).sum(1)
    quarter = (pos[:, 0] >= 0) + 2 * (pos[:, 1] >= 0)
    lead = [int(np.flatnonzero(quarter == q)[::-1][far[quarter == q][::-1].argmax()]) for q in range(4) if (quarter == q).any()]
    seeds = [*lead, *(i for i in np.argsort(-far, kind="stable").tolist() if i not in lead)][:SEEDS]
    triples = np.array(list(islice(combinations(seeds, 3), TRIPLES)), np.int64).reshape(-1, 3)
    one, two = pos[triples[:, 1]] - pos[triples[:, 0]], pos[triples[:, 2]] - pos[triples[:, 0]]
    triples = triples[np.abs(one[:, 0] * two[:, 1] - one[:, 1] * two[:, 0]) / 2 >= LEAST_AREA]
    models, sound = (np.concatenate(x) for x in zip(_fits(a, d, np.arange(len(pos))[None]), _fits(a, d, triples), strict=True))
    models = models[sound]
    if not len(models):
        return None
    left = d - a @ models
    left = np.hypot(left[..., 0], left[..., 1])
    inside = left <= TOLERANCE
    count = inside.sum(1)
    mean = (left * inside).sum(1) / np.maximum(count, 1)
    best = None
    for k, (n, r) in enumerate(zip(count.tolist(), mean.tolist(), strict=True)):
        if n and (best is None or n > best[1] or (n == best[1] and r + 1e-4 < best[2])):
            best = (k, n, r)
    if best is None or best[1] < LEAST_INLIERS:
        return None
    model, ok = models[best[0]], inside[best[0]]
    if (np.ptp(pos[ok], axis=0) < SPREAD * np.array([w, h])).any():
        return None
    again, sound = _fits(a, d, np.flatnonzero(ok)[None])
    m = again[0] if sound[0] else model
    left = np.hypot(*(d - a @ m).T)[ok]
    left = left[left <= TOLERANCE]  # those that the refined model still explains
    return (m, len(left), float(left.mean())) if len(left) >= LEAST_INLIERS else None


def decompose(m: np.ndarray) -> tuple[float, float, float, float]:
    """P20: scale less 1, rotation, shear and anisotropy of the linear part."""
    j = np.eye(2) + m[1:].T
    sx = max(float(np.hypot(*j[:, 0])), 1e-4)
    u = j[:, 0] / sx
    along = float(u @ j[:, 1])
    sy = max(float(np.hypot(*(j[:, 1] - along * u))), 1e-4)
    return (sx + sy) / 2 - 1, float(np.arctan2(u[1], u[0])), along / sy, abs(sx - sy)


def zoom_by_scale(one: np.ndarray, two: np.ndarray) -> float:
    """V5: the scale that explains the second frame best, if it explains at least 8 % more than none."""
    h, w = one.shape
    y, x = np.mgrid[4 : h - 4 : 3, 4 : w - 4 : 3]
    cx, cy = (w - 1) / 2, (h - 1) / 2

    def cost(s):
        u, v = ((x - cx) / s + cx), ((y - cy) / s + cy)
        u, v = (np.sign(u) * np.floor(np.abs(u) + 0.5)).astype(int), (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(int)
        ok = (u >= 0) & (v >= 0) & (u < w) & (v < h)
        return np.abs(one[v[ok], u[ok]].astype(int) - two[y[ok], x[ok]]).mean() if ok.any() else 0.0

    whole = cost(1.0)
    if whole <= 0:
        return 0.0
    costs = [cost(s) for s in SCALES]
    k = int(np.argmin(costs))
    gain = (whole - costs[k]) / whole
    return abs(SCALES[k] - 1) * min(w, h) * gain if gain >= 0.08 else 0.0


def movement(translation: float, zoom: float, rotation: float, shear: float) -> str:
    """P24."""
    top = max(translation, zoom, rotation, shear)
    if top > 0:
        for name, score, share in (("Zoom", zoom, 0.82), ("Roll", rotation, 0.82), ("Complex", shear, 0.70)):
            if score >= share * top:
                return name
    return "PanTilt"


def pair_motion(one: np.ndarray, two: np.ndarray, source_scale: float = 1.0) -> dict | None:
    """Scores of two thumbnails; None if their shapes differ or they are empty."""
    if one.shape != two.shape or not one.size:
        return None
    h, w = one.shape
    grid = patch_centres(w, h)
    used = grid[texture(one, grid) >= LEAST_TEXTURE]
    d = patch_shifts(one, two, used).astype(float) if len(used) else np.zeros((0, 2))
    support = len(used) / len(grid)
    fallback = zoom_by_scale(one, two) * support
    fit = fit_affine(used - np.array([(w - 1) / 2, (h - 1) / 2]), d, w, h)
    if fit is None:
        return {"motion": 1.15 * fallback, "zoom": fallback, "rotation": 0.0, "shear": 0.0, "confidence": min(support / 2, 1.0), "movement": "Zoom"}
    m, inliers, residual = fit
    scale, turn, shear, uneven = decompose(m)
    sure = inliers / len(grid) * min(max(1 - residual / (SEARCH + 1), 0.0), 1.0)
    edge = min(w, h) / 2 * source_scale * sure
    shift = float(np.hypot(*m[0])) * source_scale * sure
    zoom = max(abs(scale) * edge * min(max(1 - uneven / (abs(scale) + 0.08), 0.0), 1.0), fallback)
    turn, shear = abs(turn) * edge, abs(shear) * edge / 2
    return {"motion": max(shift, 1.15 * zoom, 0.85 * turn, shear), "zoom": zoom, "rotation": turn, "shear": shear, "confidence": min(sure, 1.0), "movement": movement(shift, zoom, turn, shear)}
