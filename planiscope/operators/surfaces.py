"""Surfaces through boundary points: robust planes, quadrics and cubics. One small numpy fit per pair of classes."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLANE = "y0 int, y1 int, model int, n array<double>, b double, inliers int, rmse double, planarity double"


def tls(points: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Unit normal and offset of the plane of least weighted squared distance; the largest entry of the normal is positive."""
    w = np.full(len(points), 1 / len(points)) if weights is None else weights / weights.sum()
    mean = w @ points
    x = points - mean
    n = np.linalg.eigh((x * w[:, None]).T @ x)[1][:, 0]
    n = n * np.sign(n[np.argmax(np.abs(n))])
    return n, float(-n @ mean)


def irls(points: np.ndarray, n: np.ndarray, b: float, rounds: int = 15, kind: str = "huber") -> tuple[np.ndarray, float]:
    """Refine a plane by weights that fall with the distance, in units of its median absolute deviation."""
    for _ in range(rounds):
        r = np.abs(points @ n + b)
        scale = 1.4826 * np.median(r) + 1e-12
        u = r / scale
        w = np.where(u <= 1.345, 1.0, 1.345 / np.maximum(u, 1e-12)) if kind == "huber" else np.where(u < 4.685, (1 - (u / 4.685) ** 2) ** 2, 0.0)
        if w.sum() < 1e-9:
            break
        new_n, new_b = tls(points, w)
        if abs(new_n @ n) > 1 - 1e-12 and abs(new_b - b) < 1e-12:
            break
        n, b = new_n, new_b
    return n, b


def robust_planes(points: np.ndarray, most: int = 4, samples: int = 600, seed: int = 0, optimise: int = 2, trims: int = 3, trim: float = 0.2) -> list[tuple[np.ndarray, float, np.ndarray]]:
    """Planes found one after the other among points that no earlier plane holds.

    Each comes from `samples` draws of d points, scored by the better half of the distances; the best is fitted again to
    what lies within 2.5 deviations `optimise` times, then to all but the worst `trim` of these up to `trims` times, and
    refined by weights; what it holds is taken out.
    """
    rng = np.random.default_rng(seed)
    left, out, d = np.arange(len(points)), [], points.shape[1]

    def near(own: np.ndarray, n: np.ndarray, b: float) -> np.ndarray:
        r = np.abs(own @ n + b)
        return r <= 2.5 * 1.4826 * np.median(r) + 1e-9

    while len(left) >= d + 2 and len(out) < most:
        own, best = points[left], None
        for _ in range(samples):
            n, b = tls(own[rng.choice(len(own), d, replace=False)])
            r = np.abs(own @ n + b)
            score = np.sort(r)[: max(d + 1, len(r) // 2)].sum()
            if best is None or score < best[0]:
                best = (score, n, b)
        _, n, b = best
        for _ in range(optimise):
            inside = near(own, n, b)
            if inside.sum() < d + 1:
                break
            n, b = tls(own[inside])
        inside = np.flatnonzero(near(own, n, b))
        for _ in range(trims):
            keep = inside[np.argsort(np.abs(own[inside] @ n + b), kind="stable")[: max(d + 1, int(np.ceil((1 - trim) * len(inside))))]]
            if len(keep) == len(inside) or len(keep) < d + 1:
                break
            new_n, new_b = tls(own[keep])
            if abs(new_n @ n) > 1 - 1e-9 and abs(new_b - b) < 1e-9:
                break
            n, b = new_n, new_b
        n, b = irls(own, n, b, rounds=12)
        inside = near(own, n, b)
        if inside.sum() < d + 1:
            break
        n, b = tls(own[inside])
        out.append((n, b, left[inside]))
        left = left[~inside]
    return out


def merged_planes(planes: list[tuple[np.ndarray, float, np.ndarray]], points: np.ndarray, degrees: float = 6.0, tau: float = 0.02) -> list[tuple[np.ndarray, float, np.ndarray]]:
    """Near-parallel planes of near-equal offset, signs aligned, become one fitted on the union of their points."""
    out: list[tuple[np.ndarray, float, np.ndarray]] = []
    for n, b, own in planes:
        for k, (m, c, other) in enumerate(out):
            s = 1.0 if n @ m >= 0 else -1.0
            if abs(n @ m) >= np.cos(np.radians(degrees)) and abs(c - s * b) <= tau:
                both = np.union1d(own, other)
                out[k] = (*tls(points[both]), both)
                break
        else:
            out.append((n, b, own))
    return out


def plane_score(points: np.ndarray, n: np.ndarray, b: float) -> dict[str, float]:
    """Inliers, mean and RMSE of distances, planarity, and their sum: inlier share + .35 planarity - .35 mean distance."""
    r = np.abs(points @ n + b)
    inside = r <= 2.5 * 1.4826 * np.median(r) + 1e-9
    e = np.linalg.eigvalsh(np.cov(points[inside].T)) if inside.sum() > 2 else np.ones(2)
    planarity = float(1 - e[0] / max(e.sum(), 1e-12))
    mean = float(r[inside].mean()) if inside.any() else 0.0
    return {"inliers": int(inside.sum()), "mean": mean, "rmse": float(np.sqrt((r * r).mean())), "planarity": planarity, "score": float(inside.mean() + 0.35 * planarity - 0.35 * mean)}


def ray_hits(a: np.ndarray, u: np.ndarray, n: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    """Where rays a + t u meet a plane, and the cosines of incidence; parallel rays meet it nowhere (infinity)."""
    slope = u @ n
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(np.abs(slope) > 1e-12, -(a @ n + b) / slope, np.inf)
    return t, np.abs(slope) / np.maximum(np.linalg.norm(u, axis=1) * np.linalg.norm(n), 1e-12)


def two_signs(u: np.ndarray, least: float = 0.25, flat: float = 0.2) -> list[np.ndarray]:
    """Row numbers of one group, or of two: directions that point both ways along their axis are parted by sign."""
    axis = np.linalg.svd(u, full_matrices=False)[2][0]
    side = u @ axis
    up = side >= 0
    if min(up.mean(), 1 - up.mean()) >= least and abs(side.mean()) <= flat:
        return [np.flatnonzero(up), np.flatnonzero(~up)]
    return [np.arange(len(u))]


def spherical_means(u: np.ndarray, k: int, seed: int = 0, rounds: int = 30) -> np.ndarray:
    """Labels of unit directions around k mean directions; first centres by farthest points."""
    rng = np.random.default_rng(seed)
    centre = u[[int(rng.integers(len(u)))]]
    while len(centre) < k:
        centre = np.vstack([centre, u[np.argmin((u @ centre.T).max(axis=1))]])
    label = np.zeros(len(u), int)
    for _ in range(rounds):
        new = (u @ centre.T).argmax(axis=1)
        if (new == label).all() and _:
            break
        label = new
        for c in range(k):
            if (label == c).any():
                m = u[label == c].sum(axis=0)
                centre[c] = m / max(np.linalg.norm(m), 1e-12)
    return label


def silhouette(u: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette of unit directions by cosine distance, from cluster sums: no matrix of all pairs."""
    ks = np.unique(label)
    if len(ks) < 2:
        return 0.0
    sums = np.stack([u[label == k].sum(axis=0) for k in ks])
    size = np.array([(label == k).sum() for k in ks])
    far = 1 - (u @ sums.T) / size  # mean distance to each cluster, itself included in its own
    own = np.searchsorted(ks, label)
    rows = np.arange(len(u))
    inner = np.where(size[own] > 1, far[rows, own] * size[own] / np.maximum(size[own] - 1, 1), 0.0)
    far[rows, own] = np.inf
    outer = far.min(axis=1)
    s = np.where(size[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-12), 0.0)
    return float(s.mean())


def direction_groups(u: np.ndarray, most: int = 12, seed: int = 0, least_cos: float = 0.55, spread: float = 0.25) -> list[np.ndarray]:
    """Groups of directions: as many as the silhouette less .05 a group says, loose ones parted once more, and those that
    point both ways parted by sign."""
    best, label = -0.1, np.zeros(len(u), int)
    for k in range(2, min(most, len(u) - 1) + 1):
        own = spherical_means(u, k, seed)
        score = silhouette(u, own) - 0.05 * k
        if score > best:
            best, label = score, own
    out = []
    for c in np.unique(label):
        rows = np.flatnonzero(label == c)
        mean = u[rows].sum(axis=0)
        cos = u[rows] @ (mean / max(np.linalg.norm(mean), 1e-12))
        loose = len(rows) >= 4 and cos.min() <= least_cos and 1 - cos.mean() >= spread
        parts = [rows[spherical_means(u[rows], 2, seed) == p] for p in (0, 1)] if loose else [rows]
        for part in (p for p in parts if len(p)):
            out += [part[g] for g in two_signs(u[part])]
    return out


def offset_groups(mid: np.ndarray, u: np.ndarray, least: int = 8) -> list[np.ndarray]:
    """Groups of segments of like direction by where they lie along it: cuts at the wide gaps between their offsets.

    A density method on one axis comes to that: a gap is wide if it is over five times the 90 % quantile of gaps and a
    tenth of the range; groups under `least` segments stay with their neighbour.
    """
    axis = u.sum(axis=0)
    axis = axis / max(np.linalg.norm(axis), 1e-12)
    at = mid @ axis
    order = np.argsort(at, kind="stable")
    gap = np.diff(at[order])
    if not len(gap):
        return [order]
    wide = np.flatnonzero((gap > 5 * np.quantile(gap, 0.9) + 1e-12) & (gap > 0.1 * (at.max() - at.min())))
    out, lo = [], 0
    for cut in [*(wide + 1), len(order)]:
        if cut - lo >= least and len(order) - cut >= least or cut == len(order):
            out.append(order[lo:cut])
            lo = cut
    return out


def segment_groups(a: np.ndarray, b: np.ndarray, seed: int = 0, most: int = 12, least: int = 8) -> list[np.ndarray]:
    """Groups of boundary segments a to b by direction, then by offset; groups under `least` join what is left over, which is
    one group of its own if it is large enough."""
    d = b - a
    u = d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)
    out, rest = [], []
    for rows in direction_groups(u, most, seed):
        for part in offset_groups((a[rows] + b[rows]) / 2, u[rows], least):
            (out if len(part) >= least else rest).append(rows[part])
    if rest and sum(map(len, rest)) >= least:
        out.append(np.sort(np.concatenate(rest)))
    return out


def process_group(points: np.ndarray, rows: np.ndarray, seed: int = 0, most: int = 4, depth: int = 2, degrees: float = 6.0, tau: float = 0.02) -> list[tuple[np.ndarray, float, np.ndarray]]:
    """Planes of one group of points: robust planes, merged; what they leave is tried again up to `depth` times, and in the
    end every point of the group goes to the plane nearest to it."""
    own, planes = rows, []
    for round_ in range(depth + 1):
        if len(own) < points.shape[1] + 2:
            break
        found = robust_planes(points[own], most, seed=seed + round_)
        if not found:
            break
        planes += [(n, b, own[held]) for n, b, held in found]
        taken = np.concatenate([p[2] for p in planes])
        own = np.setdiff1d(rows, taken)
    planes = merged_planes(planes, points, degrees, tau)
    if not planes:
        return []
    far = np.abs(points[rows] @ np.stack([n for n, _, _ in planes]).T + np.array([b for _, b, _ in planes]))
    nearest = far.argmin(axis=1)
    return [(n, b, rows[nearest == k]) for k, (n, b, _) in enumerate(planes) if (nearest == k).any()]


FRONTIER = PLANE + ", dims array<int>, score double, error string"


def frontier_planes(points: DataFrame, most: int = 4, seed: int = 0, least: int = 8, subspaces: list[list[int]] | None = None, depth: int = 2, degrees: float = 6.0, tau: float = 0.02) -> DataFrame:
    """Robust planes of every unordered pair of classes: FRONTIER rows; pairs under `least` points give none.

    `points` has y0, y1 and x, and may have the segment's start x0: then segments are grouped by direction and offset and
    each group is fitted on its own. With `subspaces` (lists of columns' numbers) planes in these columns come too, dims
    telling which. A pair that cannot be fitted gives a row with the error and no plane. A pair's points are boundary
    segments, at most a few thousand by their quotas, so one task fits one pair.
    """
    names = [c.split()[0] for c in FRONTIER.split(", ")]
    starts = "x0" in points.columns

    def planes_of(x: np.ndarray, a: np.ndarray | None) -> list[tuple]:
        groups = segment_groups(a, x, seed, least=least) if a is not None else [np.arange(len(x))]
        found = [p for g in groups or [np.arange(len(x))] for p in process_group(x, g, seed, most, depth, degrees, tau)]
        return merged_planes(found, x, degrees, tau)

    def fit(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, float) for v in d["x"]])
        order = np.lexsort(x.T)
        x = x[order]
        a = np.stack([np.asarray(v, float) for v in d["x0"]])[order] if starts else None
        rows = []
        for dims in [list(range(x.shape[1])), *(subspaces or [])] if len(x) >= least else []:
            try:
                for k, (n, b, own) in enumerate(planes_of(x[:, dims], a[:, dims] if a is not None else None)):
                    s = plane_score(x[own][:, dims], n, b)
                    r = x[own][:, dims] @ n + b
                    rows.append((key[0], key[1], k, n.tolist(), b, len(own), float(np.sqrt((r * r).mean())), s["planarity"], dims, s["score"], None))
            except (np.linalg.LinAlgError, ValueError) as e:
                rows.append((key[0], key[1], -1, None, None, 0, None, None, dims, None, str(e)))
        return pd.DataFrame(rows, columns=names)

    rows = points.select(F.least("y0", "y1").alias("y0"), F.greatest("y0", "y1").alias("y1"), "x", *(["x0"] if starts else []))
    return rows.groupBy("y0", "y1").applyInPandas(fit, FRONTIER)


def explorer_dims(reports: list[dict], names: list[str], top: int = 5) -> list[list[int]]:
    """Columns' numbers of the best reports' feature sets, given as names, numbers or x<number>; each set once, two or more columns."""
    out: list[list[int]] = []
    for r in reports:
        own = r["features"].split(",") if isinstance(r["features"], str) else r["features"]
        dims = sorted({names.index(c) if c in names else int(str(c).removeprefix("x")) for c in own})
        if len(dims) >= 2 and dims not in out:
            out.append(dims)
        if len(out) == top:
            break
    return out


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mu, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd < 1e-12, 1.0, sd)
    return (x - mu) / sd, mu, sd


def monomials(d: int, degree: int) -> list[tuple[int, ...]]:
    """Index tuples of all monomials up to the degree, the constant first."""
    return [m for k in range(degree + 1) for m in combinations_with_replacement(range(d), k)]


def polynomial(x: np.ndarray, terms: list[tuple[int, ...]]) -> np.ndarray:
    return np.stack([np.prod(x[:, list(t)], axis=1) if t else np.ones(len(x)) for t in terms], axis=1)


def fit_implicit(x: np.ndarray, w: np.ndarray, degree: int) -> dict:
    """Weights of the polynomial that is least on the points: the smallest right-singular vector of the weighted features."""
    z, mu, sd = _standard(x)
    terms = monomials(x.shape[1], degree)
    coef = np.linalg.svd(np.sqrt(w)[:, None] * polynomial(z, terms), full_matrices=True)[2][-1]
    return {"coef": coef * np.sign(coef[np.argmax(np.abs(coef))]), "terms": terms, "mu": mu, "sd": sd}


def weighted_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Weights of an L2-regularised logistic regression on weighted rows; column 0, the constant, is not penalised."""
    coef = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], 1 / c)
    penalty[0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        grad = x.T @ (w * (p - y)) + penalty * coef
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-12), grad)
        coef -= step
        if np.abs(step).max() < 1e-9:
            break
    return coef


def fit_separating(x0: np.ndarray, x1: np.ndarray, w: np.ndarray, degree: int, c: float = 1.0) -> dict:
    """Weights of the polynomial whose sign tells starts (negative) from ends (positive) of boundary segments, by logistic
    regression: the surface that lies between them."""
    both = np.vstack([x0, x1])
    z, mu, sd = _standard(both)
    terms = monomials(both.shape[1], degree)
    y = np.repeat([0.0, 1.0], len(x0))
    w2 = np.concatenate([w, w])
    return {"coef": weighted_logistic(polynomial(z, terms), y, w2 / max(w2.mean(), 1e-12), c), "terms": terms, "mu": mu, "sd": sd}


def evaluate_implicit(model: dict, x: np.ndarray) -> np.ndarray:
    return polynomial((x - model["mu"]) / model["sd"], model["terms"]) @ model["coef"]


def quadric(model: dict) -> tuple[np.ndarray, np.ndarray, float]:
    """(Q, r, c) in the original coordinates with x'Qx + r'x + c equal to the fitted surface."""
    d = len(model["mu"])
    q, r, c = np.zeros((d, d)), np.zeros(d), 0.0
    for w, t in zip(model["coef"], model["terms"], strict=True):
        if len(t) == 0:
            c += w
        elif len(t) == 1:
            r[t[0]] += w
        else:
            q[t[0], t[1]] += w / 2
            q[t[1], t[0]] += w / 2
    s = 1 / model["sd"]
    q, r = q * np.outer(s, s), r * s
    m = model["mu"]
    return q, r - 2 * q @ m, float(c - r @ m + m @ q @ m)


def surfaces(points: DataFrame, degree: int, mode: str = "svd", c: float = 1.0) -> DataFrame:
    """(y0, y1, degree, coef, mu, sd): a quadric (2) or cubic (3) per pair from (y0, y1, x, w). svd: the surface through the
    points; logistic: the one that parts their starts x0 from them, so that its values are log odds."""
    if degree not in (2, 3) or mode not in ("svd", "logistic"):
        raise ValueError(f"degree: {degree}, mode: {mode}")

    def fit(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, float) for v in d["x"]])
        cols = ["y0", "y1", "degree", "coef", "mu", "sd"]
        if len(x) < 5:
            return pd.DataFrame([], columns=cols)
        order = np.lexsort(x.T)
        w = d["w"].to_numpy()[order]
        if mode == "svd":
            m = fit_implicit(x[order], w, degree)
        else:
            m = fit_separating(np.stack([np.asarray(v, float) for v in d["x0"]])[order], x[order], w, degree, c)
        return pd.DataFrame([(key[0], key[1], degree, m["coef"].tolist(), m["mu"].tolist(), m["sd"].tolist())], columns=cols)

    return points.groupBy("y0", "y1").applyInPandas(fit, "y0 int, y1 int, degree int, coef array<double>, mu array<double>, sd array<double>")


def surface_value(features: str, model: dict) -> Column:
    """The fitted surface's value at an array column, as an expression; its logistic is the probability of a logistic fit."""
    z = [(F.element_at(features, i + 1) - float(m)) / float(d) for i, (m, d) in enumerate(zip(model["mu"], model["sd"], strict=True))]
    terms = [reduce(lambda a, b: a * b, [z[i] for i in t], F.lit(float(w))) for w, t in zip(model["coef"], model["terms"], strict=True)]
    return reduce(lambda a, b: a + b, terms)


def crossings(model: dict, x0: np.ndarray, x1: np.ndarray, parts: int = 128, rounds: int = 50, tol: float = 1e-7) -> list[float]:
    """Shares of the segment at which it crosses the surface, by sign changes on a grid and bisection."""
    t = np.linspace(0, 1, parts + 1)
    at = lambda s: evaluate_implicit(model, x0 + (x1 - x0) * np.atleast_1d(s)[:, None])
    v = at(t)
    out = [float(s) for s, g in zip(t, v, strict=True) if abs(g) < tol]
    for i in np.flatnonzero(v[:-1] * v[1:] < 0):
        lo, hi = t[i], t[i + 1]
        for _ in range(rounds):
            mid = (lo + hi) / 2
            if at(lo)[0] * at(mid)[0] <= 0:
                hi = mid
            else:
                lo = mid
            if hi - lo < tol:
                break
        out.append(float((lo + hi) / 2))
    out.sort()
    return [s for i, s in enumerate(out) if i == 0 or s - out[i - 1] > 1e-6]
