"""A plain version of the width of one edge: everything at once, on the masks of its tiles."""

import math

import numpy as np

from kerbline.functions import shapes
from kerbline.operators.widths import axis_lines, mask_rings
from kerbline.schema import CROSSWALK_CLASSES, SIDEWALK_CLASSES


def estimate(line, ring, p):
    px = shapes.narrow_estimate(shapes.measured(line, ring, p.step, p.half_span, p.direction_delta)[1].tolist())
    return (None, None) if px is None else (px, round(px * p.pixel_size_m, 2))


class _Axis:
    """Axis pieces as arrays: for each its sides, and its direction from end to end."""

    def __init__(self, lines):
        self.a = np.concatenate([x[:-1] for x in lines])
        self.b = np.concatenate([x[1:] for x in lines])
        self.of = np.repeat(np.arange(len(lines)), [len(x) - 1 for x in lines])
        d = np.array([x[-1] - x[0] for x in lines])
        n = np.hypot(*d.T)
        self.dir = np.where(n[:, None] > 0, d / np.where(n > 0, n, 1)[:, None], 0)
        self.starts = np.searchsorted(self.of, np.arange(len(lines)))

    def nearest(self, points):
        """Distance and nearest place of each piece, for each point."""
        dist, near = shapes.to_segments(points, self.a, self.b)
        best = np.minimum.reduceat(dist, self.starts, axis=1)
        ends = [*self.starts[1:], len(self.of)]
        first = np.stack([a + dist[:, a:b].argmin(1) for a, b in zip(self.starts, ends)], 1)
        return best, np.take_along_axis(near, first[..., None], 1)


def _pieces(line, step):
    d = shapes.dense(line, step)
    if d is None:
        return None
    v = np.diff(d, axis=0)
    n = np.hypot(*v.T)
    ok = n > 0
    return ((d[:-1] + d[1:]) / 2)[ok], (v[ok] / n[ok][:, None])


def axis_fit(line, axis, p):
    """The shift that lays the line best along the axis, and how well it then lies."""
    none = {"coverage": 0.0, "score": 0.0, "line": None}
    got = _pieces(line, p.edge_step)
    if got is None:
        return none
    mid, way = got
    dots = np.abs(way @ axis.dir.T)
    dist, near = axis.nearest(mid)
    i, j = np.nonzero((dots >= p.parallel_cos) & (dist <= p.candidate_distance))
    if not len(i):
        return none
    shift = near[i, j] - mid[i]
    cell = np.rint(shift / p.cluster_radius).astype(int)
    candidates = []
    for key in dict.fromkeys(map(tuple, cell.tolist())):
        m = (cell == key).all(1)
        d = np.median(shift[m], axis=0)
        std = float(np.median(np.hypot(*(shift[m] - d).T)))
        far = math.hypot(*d)
        seed = 2.0 * m.sum() + 5.0 * dots[i, j][m].mean() - dist[i, j][m].mean() / p.candidate_distance - p.length_weight * far - 0.05 * std / p.edge_step
        candidates.append((seed, d, std, far))
    candidates.sort(key=lambda c: -c[0])
    best, most = None, -math.inf
    for _, d, std, far in candidates[: p.max_candidates]:
        dd, _ = axis.nearest(mid + d)
        ok = (dots >= p.parallel_cos) & (dd <= p.match_distance)
        s = np.where(ok, 10 * dots - dd / p.match_distance, -np.inf)
        k, some = s.argmax(1), ok.any(1)
        rows = np.flatnonzero(some)
        cover = some.mean()
        dot = dots[rows, k[rows]].mean() if len(rows) else 0.0
        away = dd[rows, k[rows]].mean() if len(rows) else None
        total = 2 * cover + 0.8 * dot - 0.6 * (1.0 if away is None else away / p.match_distance) - p.length_weight * far - 0.1 * std / p.edge_step
        if total > most:
            most, best = total, (d, std, cover, dot, away)
    d, std, cover, dot, away = best
    near_score = 0.0 if away is None else math.exp(-away / p.match_distance)
    return {"coverage": float(cover), "score": (0.6 * cover + 0.25 * dot + 0.15 * math.exp(-std / p.edge_step)) * near_score, "line": line + d}


def assigned(line, rings, axes, p):
    """The polygon of an edge: number, score and fit; the first on ties, none if all are far."""
    found = (None, -math.inf, {})
    for k, ring in enumerate(rings):
        away = shapes.line_distance(line, ring)
        if away > p.assign_distance:
            continue
        inner = sum(b - a for a, b in shapes.inside_parts(line, ring))
        base = shapes.overlap_area(line, p.edge_buffer, ring) + 10 * inner - 0.5 * away
        if k not in axes:
            lines = axis_lines(ring, p)
            axes[k] = _Axis(lines) if lines else None
        fit = axis_fit(line, axes[k], p) if axes[k] else {"coverage": 0.0, "score": 0.0, "line": None}
        score = base - p.axis_weight / 2 if fit["coverage"] < p.min_coverage else base + p.axis_weight * fit["score"]
        if score > found[1]:
            found = (k, score, fit)
    return found


def crosswalk_target(line, rings, p):
    """The crossing that holds most of the line, if over the least share (strictly)."""
    best, most = None, 0.0
    for k, ring in enumerate(rings):
        r = shapes.inside_ratio(line, ring, p.crosswalk_tolerance)
        if r > most:
            best, most = k, r
    return (best if most > p.crosswalk_ratio else None), most


def local_cuts(line, ring, p):
    """The polygon with side pockets cut off along pairs of concave vertices, and how many
    cuts were taken; each must lessen the relative deviation enough."""
    widths = lambda r: shapes.measured(line, r, p.step, p.half_span, p.direction_delta)[1]
    _, rel, share = shapes.quality(widths(ring))
    for n in range(p.max_cuts):
        corners = shapes.concave(shapes.simplified_ring(ring, p.cut_simplify))
        best = None
        for i in range(len(corners)):
            for j in range(i + 1, len(corners)):
                a, b = corners[i], corners[j]
                d, mid = b - a, (a + b) / 2
                size = math.hypot(*d)
                dist, near = shapes.to_segments(mid[None], line[:-1], line[1:])
                if size == 0 or dist.min() > p.cut_distance:
                    continue
                k = int(dist[0].argmin())
                at = shapes.length(line[: k + 1]) + math.hypot(*(near[0, k] - line[k]))
                way = shapes.directions(line, np.array([at]), p.cut_delta)[0][0]
                cos = abs(float(way @ d) / size)
                if cos < p.parallel_cos:
                    continue
                u = d / size * p.cut_extension
                pieces = [x for x in shapes.split(ring, a - u, b + u) if abs(shapes.area(x)) >= p.min_piece_area]
                if len(pieces) < 2:
                    continue
                kept = max(pieces, key=lambda x: round(shapes.overlap_area(line, p.cut_keep_buffer, x), 6))
                whole = sum(abs(shapes.area(x)) for x in pieces)
                gone = whole - abs(shapes.area(kept))
                if gone < p.min_removed or gone / whole > p.max_removed_ratio:
                    continue
                score, r, v = shapes.quality(widths(kept))
                if v >= p.valid_ratio and (best is None or score + 0.05 * cos > best[0]):
                    best = (score + 0.05 * cos, kept, r, v)
        if best is None or not (best[2] < rel - p.min_improvement and best[3] >= p.keep_ratio * share):
            return ring, n
        _, ring, rel, share = best
    return ring, p.max_cuts


class Mosaic:
    """One mask with its polygons and axes, shared by the edges on it."""

    def __init__(self, mask, p):
        self.p = p
        self.walks, self.crossings = mask_rings(mask, SIDEWALK_CLASSES, p), mask_rings(mask, CROSSWALK_CLASSES, p)
        self.axes = {}

    def width(self, line):
        """status, width_m, width_px, width_mode and crosswalk_ratio of an edge in pixels."""
        p = self.p
        target, ratio = crosswalk_target(line, self.crossings, p)
        out = {"status": "ok", "width_m": None, "width_px": None, "width_mode": "combined", "crosswalk_ratio": ratio}
        if target is not None:
            inner = shapes.longest_inside(line, self.crossings[target])
            if inner is not None:
                out["width_mode"] = "crosswalk_direct"
                px, m = estimate(inner, self.crossings[target], p)
                if px is None:
                    return out | {"status": "no_measurements"}
                if m < p.crosswalk_min_m:
                    m, px = p.crosswalk_min_m, p.crosswalk_min_m / p.pixel_size_m
                return out | {"width_m": m, "width_px": px}
        k, _, fit = assigned(line, self.walks, self.axes, p)
        if k is None:
            return out | {"status": "no_polygon"}
        ring = self.walks[k]
        work = fit["line"]
        if work is not None:
            if shapes.inside_ratio(work, ring, p.inside_tolerance) < p.inside_ratio:
                return out | {"status": "translated_edge_mostly_outside_polygon"}
        else:
            work = shapes.longest_inside(line, ring)
            work = shapes.snapped(line, ring) if work is None else work
        ring, _ = local_cuts(work, ring, p)
        px, m = estimate(work, ring, p)
        return out | ({"status": "no_measurements"} if px is None else {"width_m": m, "width_px": px})
