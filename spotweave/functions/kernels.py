"""Small numeric kernels for one spot, one group or one table of types."""

from __future__ import annotations

import heapq

import numpy as np


def nnls(a: np.ndarray, b: np.ndarray, most: int = 300) -> np.ndarray:
    """The x >= 0 of least |a x - b|, by active sets."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    g, h = a.T @ b, a.T @ a
    for _ in range(most):
        w = g - h @ x
        w[free] = -np.inf
        k = int(np.argmax(w))
        if w[k] <= 1e-10 * max(1.0, np.abs(g).max()):
            break
        free[k] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(h[np.ix_(free, free)], g[free], rcond=None)[0]
            if (s[free] > 0).all():
                x = s
                break
            bad = free & (s <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0.0
    return x


def box_qp(d: np.ndarray, c: np.ndarray, low: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The x >= low of least x'dx / 2 - c'x, by coordinate descent."""
    x = np.maximum(0.0, low)
    for _ in range(rounds):
        was = x.copy()
        for i in range(len(x)):
            x[i] = max(low[i], x[i] + (c[i] - d[i] @ x) / d[i, i])
        if np.abs(x - was).max() < 1e-10:
            break
    return x


def sum_qp(d: np.ndarray, c: np.ndarray, low: np.ndarray, total: float, rounds: int = 60) -> np.ndarray:
    """The x >= low with the given sum (no less than that of ``low``) of least x'dx / 2 - c'x: the multiplier of the sum by bisection."""
    scale = np.abs(c).max() + np.abs(d).max() * (np.abs(low).max() + abs(total) + 1)
    below, above = -2 * scale, 2 * scale
    for _ in range(rounds):
        m = (below + above) / 2
        below, above = (m, above) if box_qp(d, c - m, low).sum() > total else (below, m)
    return box_qp(d, c - (below + above) / 2, low)


def _prediction_weights(signature: np.ndarray, x: np.ndarray, most: float = np.inf) -> np.ndarray:
    """1 / prediction squared by gene (at most ``most``), divided by the least; genes without a prediction weigh as much as the heaviest."""
    with np.errstate(divide="ignore"):
        w = 1 / (signature @ x) ** 2
    known = np.isfinite(w)
    if not known.any():
        return np.ones(len(w))
    w[~known] = w[known].max()
    w = np.minimum(w, most)
    return w / w.min()


def dampened_wls(signature: np.ndarray, bulk: np.ndarray, dampening: int, rounds: int = 1000, tol: float = 0.01) -> np.ndarray:
    """Proportions by weighted least squares, weights 1 / prediction squared, capped at 2 ^ (dampening - 1) times the least.

    Each round moves a fifth of the way to the new solution, until a move is no longer than ``tol``.
    """
    x = nnls(signature, bulk)
    for _ in range(rounds):
        root = np.sqrt(np.minimum(_prediction_weights(signature, x), 2.0 ** (dampening - 1)))
        move = (nnls(signature * root[:, None], bulk * root) - x) / 5
        x = x + move
        if np.linalg.norm(move) <= tol:
            break
    x = np.maximum(x, 0)
    return x / x.sum() if x.sum() > 0 else x


def dampening_constant(signature: np.ndarray, bulk: np.ndarray, seed: int = 0, draws: int = 50) -> int:
    """The exponent of the cap under which fits to random halves of the genes have the evenest coefficients.

    A fit's score is the deviation across its coefficients (negative ones count
    as 0); the weights multiply the bulk alone.  The first of the best exponents wins.
    """
    rng = np.random.default_rng(seed)
    w = _prediction_weights(signature, nnls(signature, bulk), 1e6)
    score = []
    for j in range(1, max(1, int(np.ceil(np.log2(w.max())))) + 1):
        capped = bulk * np.minimum(w, 2.0 ** (j - 1))
        halves = [rng.choice(len(bulk), len(bulk) // 2, replace=False) for _ in range(draws)]
        score.append(np.mean([np.maximum(np.linalg.lstsq(signature[h], capped[h], rcond=None)[0], 0).std() for h in halves]))
    return int(np.argmin(score)) + 1


_NODES, _WEIGHTS = np.polynomial.hermite.hermgauss(24)


def _lognormal_nodes(y: np.ndarray, mu: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Per gene the factors exp(sigma z) at nodes around the integrand's mode, and the logarithms of the weighted integrand there (without y!)."""
    # The mode is at most sigma y; steps of 1 / sigma change the rate by a factor of e.
    z, most = np.minimum(np.log((y + 1) / mu) * sigma * (y + 1) / (1 + sigma * sigma * (y + 1)), sigma * y), max(1.0, 1 / sigma)
    for _ in range(12):
        rate = mu * np.exp(sigma * z)
        z = z + np.clip((sigma * (y - rate) - z) / (1 + sigma * sigma * rate), -most, most)
    width = 1 / np.sqrt(1 + sigma * sigma * mu * np.exp(sigma * z))
    at = z[:, None] + np.sqrt(2) * width[:, None] * _NODES[None, :]
    factor = np.exp(sigma * at)
    log_p = y[:, None] * (np.log(mu)[:, None] + sigma * at) - mu[:, None] * factor - at * at / 2
    return factor, log_p + (np.log(_WEIGHTS) + _NODES**2)[None, :] + np.log(width / np.sqrt(np.pi))[:, None]


def poisson_lognormal_derivatives(y: np.ndarray, mu: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative by mu of log P(y), y Poisson with a mean of mu times a lognormal factor, by quadrature around the mode."""
    e, log_p = _lognormal_nodes(y, mu, sigma)
    p = np.exp(log_p - log_p.max(1, keepdims=True))
    lam = mu[:, None] * e
    q = y[:, None] / lam - 1
    zero, one, two = p.sum(1), (p * q * e).sum(1), (p * (q * q - y[:, None] / lam**2) * e * e).sum(1)
    return one / zero, two / zero - (one / zero) ** 2


class LikelihoodTable:
    """``poisson_lognormal_derivatives`` of whole counts up to ``MOST``, by cubics in log mu between the nodes of a grid.

    At each node the derivative by log mu and its own derivative are kept, so
    both results come from one smooth curve.  Other counts, and mu beyond the
    grid, take the quadrature.
    """

    MOST, NODES_A_UNIT, ENDS = 100, 64, (-9.25, 11.5)

    def __init__(self, sigma: float, rows: np.ndarray):
        self.sigma, self.rows = sigma, rows

    @classmethod
    def grid(cls) -> np.ndarray:
        low, high = cls.ENDS
        return low + np.arange(int((high - low) * cls.NODES_A_UNIT) + 1) / cls.NODES_A_UNIT

    @classmethod
    def row(cls, count: int, sigma: float) -> np.ndarray:
        """A count's values at the nodes, then its slopes."""
        mu = np.exp(cls.grid())
        d1, d2 = poisson_lognormal_derivatives(np.full(len(mu), float(count)), mu, sigma)
        return np.concatenate([mu * d1, mu * d1 + mu * mu * d2])

    def derivatives(self, y: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = (np.log(mu) - self.ENDS[0]) * self.NODES_A_UNIT
        width = self.rows.shape[1] // 2
        out = (y != np.floor(y)) | (y < 0) | (y > self.MOST) | ~((place >= 0) & (place < width - 1))
        at, row = np.where(out, 0, place).astype(int), np.where(out, 0, y).astype(int)
        u, flat, start = np.where(out, 0, place - at), self.rows.ravel(), row * (2 * width) + at
        a, b, h = flat[start], flat[start + 1], 1 / self.NODES_A_UNIT
        p, q = flat[start + width] * h, flat[start + width + 1] * h
        square, cube = 3 * (b - a) - 2 * p - q, 2 * (a - b) + p + q
        value = a + u * (p + u * (square + u * cube))
        slope = (p + u * (2 * square + 3 * u * cube)) / h
        d1, d2 = value / mu, (slope - value) / (mu * mu)
        if out.any():
            d1[out], d2[out] = poisson_lognormal_derivatives(y[out], mu[out], self.sigma)
        return d1, d2


def poisson_lognormal_loss(y: np.ndarray, mu: np.ndarray, sigma: float) -> float:
    """Minus the summed log P(y), y Poisson with a mean of mu times a lognormal factor, by quadrature around the mode."""
    _, log_p = _lognormal_nodes(y, mu, sigma)
    fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(y.max(initial=0)) + 1)))])[y.astype(int)]
    top = log_p.max(1)
    return float((fact - top - np.log(np.exp(log_p - top[:, None]).sum(1))).sum())


def rctd_weights(signature: np.ndarray, y: np.ndarray, n_umi: float, sigma: float | None, rounds: int = 50, tol: float = 1e-3, most: float = 100, whole: bool = False, table: LikelihoodTable | None = None) -> np.ndarray:
    """Weights of a spot: damped Newton steps with a positive-definite Hessian and x >= 0; ``whole`` keeps their sum at 1.

    Without ``sigma`` the squared difference of the logarithms is fitted instead of the likelihood, for a bulk sample.
    ``table``: of that sigma, in place of a quadrature per call.
    """
    s = signature * n_umi
    y = y if sigma is None else np.minimum(y, most)
    x = np.full(s.shape[1], 1 / s.shape[1])
    for _ in range(rounds):
        mu = np.maximum(np.abs(s @ np.maximum(x, 0)), max(1e-4, n_umi * 1e-7))
        if sigma is None:
            gap = np.log(mu) - np.log(np.maximum(y, 1e-300))
            d1, d2 = -2 * gap / mu, -2 * (1 - gap) / mu**2
        else:
            d1, d2 = poisson_lognormal_derivatives(y, mu, sigma) if table is None else table.derivatives(y, mu)
        value, vector = np.linalg.eigh(-(s * d2[:, None]).T @ s)
        hess = (vector * np.maximum(value, 1e-3)) @ vector.T
        norm = np.linalg.norm(hess, 2)
        d, c, low = hess / norm + 1e-7 * np.eye(len(x)), (d1 @ s) / norm, -np.maximum(x, 0)
        step = 0.3 * (sum_qp(d, c, low, 1 - np.maximum(x, 0).sum()) if whole else box_qp(d, c, low))
        x = np.maximum(x, 0) + step
        if np.abs(step).sum() <= tol:
            break
    return x


#: Losses beyond the best pair's that still count as near it, and by which a lone type must lose for a doublet; weights that make a candidate.
NEAR_PAIR, DOUBLET, CANDIDATE = 10.0, 25.0, 0.01


def doublet(signature: np.ndarray, y: np.ndarray, n_umi: float, sigma: float, classes: np.ndarray | None = None, table: LikelihoodTable | None = None) -> tuple[str, int, int, float, float, float]:
    """Whether a spot holds one type or two: its class, first and second type, the first one's weight, the pair's and the lone type's loss.

    Candidates come from the fit of all types; every pair of them is fitted.  A
    type is sure if all pairs near the best one hold it, or a type of its class
    (``classes``; by default each type is its own).  Two sure types are a certain
    doublet, one an uncertain one, none a reject; where the sure type alone does
    nearly as well as the pair, the spot is a singlet.
    """
    k = signature.shape[1]
    classes = np.arange(k) if classes is None else classes
    counts = np.minimum(np.floor(y), 100)

    def loss(types: list[int]) -> float:
        s = signature[:, types]
        x = rctd_weights(s, y, n_umi, sigma, rounds=25, table=table)
        return poisson_lognormal_loss(counts, np.maximum(s @ np.maximum(x, 0) * n_umi, 1e-4), sigma)

    found = np.flatnonzero(rctd_weights(signature, y, n_umi, sigma, table=table) > CANDIDATE).tolist()
    if not found:
        found = list(range(k))[1:3] if k > 2 else list(range(k))
    elif len(found) == 1 and k > 1:
        found.append(1 if found[0] == 0 else 0)
    if len(found) < 2:
        alone = loss(found)
        return "singlet", found[0], found[0], 1.0, alone, alone
    pairs = {(a, b): loss([a, b]) for i, a in enumerate(found) for b in found[i + 1 :]}
    pair = min(pairs, key=pairs.__getitem__)
    best = pairs[pair]
    near = [p for p, v in pairs.items() if v < best + NEAR_PAIR]

    def sure(t: int) -> tuple[bool, float]:
        kin = {u for p in near for u in p if classes[u] == classes[t]}
        every = all(classes[a] == classes[t] or classes[b] == classes[t] for a, b in near)
        others = kin if every and not all(t in p for p in near) else set()
        return every, min(loss([u]) for u in {t, *others})

    (sure_a, alone_a), (sure_b, alone_b) = sure(pair[0]), sure(pair[1])
    if sure_a and sure_b:
        kind, alone = "doublet_certain", min(alone_a, alone_b)
        swap = alone_b < alone_a
    elif sure_a or sure_b:
        kind, alone, swap = "doublet_uncertain", alone_a if sure_a else alone_b, sure_b
    else:
        kind, alone, swap = "reject", best + 2 * DOUBLET, False
    if alone - best < DOUBLET:
        kind = "singlet"
    first, second = pair[::-1] if swap else pair
    x = np.maximum(rctd_weights(signature[:, [first, second]], y, n_umi, sigma, table=table), 0)
    return kind, first, second, float(x[0] / x.sum()) if x.sum() > 0 else 0.0, best, alone


def assign_with_quota(score: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """The type of each row of greatest total score with ``quota[k]`` rows of type k; ties go to the earlier row and type.

    From every row's best type, units move along the cheapest path of types from
    one over its quota to one under it, which keeps the total optimal.
    """
    n, k = score.shape
    if quota.sum() != n:
        raise ValueError(f"quotas sum to {quota.sum()}, rows are {n}")
    out = score.argmax(1)
    over = np.bincount(out, minlength=k) - quota
    if not over.any():
        return out
    # Per pair of types a queue of (loss, row); rows that have left their type are dropped when they come first.
    queue = {}
    for a in range(k):
        rows = np.flatnonzero(out == a)
        for b in range(k):
            if b != a:
                loss = score[rows, a] - score[rows, b]
                order = np.argsort(loss, kind="stable")
                queue[a, b] = list(zip(loss[order].tolist(), rows[order].tolist()))
    while over.any():
        cost, via = np.full((k, k), np.inf), np.full((k, k), -1)
        for (a, b), q in queue.items():
            while q and out[q[0][1]] != a:
                heapq.heappop(q)
            if q:
                cost[a, b], via[a, b] = q[0]
        dist = np.where(over > 0, 0.0, np.inf)
        past = np.full(k, -1)
        for _ in range(k):
            new = dist[:, None] + cost
            best = new.argmin(0)
            better = new[best, np.arange(k)] < dist - 1e-12
            if not better.any():
                break
            past[better], dist[better] = best[better], new[best, np.arange(k)][better]
        to = int(np.argmin(np.where(over < 0, dist, np.inf)))
        path = [to]
        while past[path[-1]] >= 0 and len(path) <= k:
            path.append(int(past[path[-1]]))
        for b, a in zip(path[:-1], path[1:]):
            row = int(via[a, b])
            out[row] = b
            for c in range(k):
                if c != b:
                    heapq.heappush(queue[b, c], (float(score[row, b] - score[row, c]), row))
            over[a] -= 1
            over[b] += 1
    return out


def deal_quotas(total: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Quotas by block (rows) that sum to the block's size and, over all blocks, to ``total``: the kinds' places, spread evenly, are handed out in order."""
    given, out = np.zeros(len(total), np.int64), []
    for size in sizes:
        place = [np.arange(g, min(g + size, t)) for g, t in zip(given, total)]
        kind = np.repeat(np.arange(len(total)), [len(p) for p in place])
        key = (np.concatenate(place) + 0.5) / np.repeat(np.maximum(total, 1), [len(p) for p in place])
        got = np.bincount(kind[np.argsort(key, kind="stable")[:size]], minlength=len(total))
        given += got
        out.append(got)
    return np.array(out).reshape(len(sizes), len(total))


def transport(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The transport plan of least cost from a to b (of equal sums): shares move along the cheapest paths, which may take back what an earlier path moved."""
    plan, left, want = np.zeros(cost.shape), a.astype(float).copy(), b.astype(float).copy()
    n, m = cost.shape
    eps = 1e-12 * max(1.0, a.sum())
    while left.max(initial=0) > eps and want.max(initial=0) > eps:
        far, near = np.where(left > eps, 0.0, np.inf), np.full(m, np.inf)
        from_row, from_col = np.full(m, -1), np.full(n, -1)
        for _ in range(n + m):
            reach = far[:, None] + cost
            best = reach.argmin(0)
            better = reach[best, np.arange(m)] < near - 1e-13
            near[better], from_row[better] = reach[best, np.arange(m)][better], best[better]
            back = np.where(plan > eps, near[None, :] - cost, np.inf)
            best = back.argmin(1)
            closer = back[np.arange(n), best] < far - 1e-13
            far[closer], from_col[closer] = back[np.arange(n), best][closer], best[closer]
            if not closer.any():
                break
        j = int(np.argmin(np.where(want > eps, near, np.inf)))
        path, size = [], want[j]
        while True:
            i = int(from_row[j])
            path.append((i, j, 1))
            if from_col[i] < 0:
                size = min(size, left[i])
                break
            j = int(from_col[i])
            path.append((i, j, -1))
            size = min(size, plan[i, j])
        for i, j, sign in path:
            plan[i, j] += sign * size
        left[path[-1][0]] -= size
        want[path[0][1]] -= size
    return np.maximum(plan, 0)


def sinkhorn(a: np.ndarray, b: np.ndarray, cost: np.ndarray, reg: float = 0.01, rounds: int = 2000) -> np.ndarray:
    """The entropic transport plan from a to b, in logarithms."""
    f, g = np.zeros(len(a)), np.zeros(len(b))
    la, lb = np.log(np.maximum(a, 1e-300)), np.log(np.maximum(b, 1e-300))
    lse = lambda m, axis: np.log(np.exp(m - m.max(axis, keepdims=True)).sum(axis)) + m.max(axis)
    for _ in range(rounds):
        f = reg * (la - lse((g[None, :] - cost) / reg, 1))
        g = reg * (lb - lse((f[:, None] - cost) / reg, 0))
    return np.exp((f[:, None] + g[None, :] - cost) / reg)


def delaunay_circles(px: np.ndarray, py: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Centre and squared radius of the circle through each triangle's corners."""
    ax, ay = px[t[:, 0]], py[t[:, 0]]
    bx, by, cx, cy = px[t[:, 1]] - ax, py[t[:, 1]] - ay, px[t[:, 2]] - ax, py[t[:, 2]] - ay
    d = 2 * (bx * cy - by * cx)
    d = np.where(np.abs(d) < 1e-300, 1e-300, d)
    ux = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d
    uy = (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return np.stack([ux + ax, uy + ay, ux * ux + uy * uy], 1)


def delaunay_triangles(x: np.ndarray, y: np.ndarray, frame: tuple[float, float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Triangles and their circles, with the three corners ``n``, ``n + 1``, ``n + 2`` of a triangle far around ``frame`` (middle and span; the points' own by default)."""
    n = len(x)
    mx, my, span = frame or (x.mean(), y.mean(), max(np.ptp(x), np.ptp(y), 1e-9))
    px = np.concatenate([x, mx + span * np.array([-50.0, 50.0, 0.0])])
    py = np.concatenate([y, my + span * np.array([-40.0, -40.0, 60.0])])
    tri = np.array([[n, n + 1, n + 2]])
    circle = delaunay_circles(px, py, tri)
    for i in np.lexsort((y, x)):
        inside = (px[i] - circle[:, 0]) ** 2 + (py[i] - circle[:, 1]) ** 2 < circle[:, 2] * (1 + 1e-12)
        gone = tri[inside]
        p, q, r = gone.T
        ends = np.concatenate([p, q, p]), np.concatenate([q, r, r])
        # Edges as whole numbers; those of one triangle alone are the rim.
        edges = np.sort(np.minimum(*ends) * (n + 3) + np.maximum(*ends))
        alone = np.ones(len(edges), bool)
        same = edges[1:] == edges[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        rim = edges[alone]
        new = np.column_stack([rim // (n + 3), rim % (n + 3), np.full(len(rim), i)])
        tri = np.concatenate([tri[~inside], new])
        circle = np.concatenate([circle[~inside], delaunay_circles(px, py, new)])
    return tri, circle


def delaunay_edges(x: np.ndarray, y: np.ndarray, frame: tuple[float, float, float] | None = None) -> np.ndarray:
    """Edges (i < j) of the Delaunay triangulation by incremental insertion; fewer than three or collinear points give the complete graph."""
    n = len(x)
    every = np.array([(i, j) for i in range(n) for j in range(i + 1, n)], int).reshape(-1, 2) if n < 4 else None
    if n < 3:
        return every
    tri, _ = delaunay_triangles(x, y, frame)
    tri = tri[(tri < n).all(1)]
    if not len(tri):
        order = np.lexsort((y, x))
        return np.sort(np.column_stack([order[:-1], order[1:]]), 1) if every is None else every
    return np.unique(np.sort(np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [0, 2]]]), 1), axis=0)


def polygon_area(x: np.ndarray, y: np.ndarray) -> float:
    """The area of a simple polygon; its last corner joins its first."""
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def greedy_boxes(r0: np.ndarray, c0: np.ndarray, r1: np.ndarray, c1: np.ndarray, ids: np.ndarray, state: np.ndarray, whole: np.ndarray, least: float, wide: float) -> np.ndarray:
    """States (0 open, 1 kept, 2 gone) after the greatest area, then the smallest id, has displaced those it overlaps.

    ``whole``: whether all of a box's rivals are here; others are only displaced, never kept.  ``wide``: the longest side.
    """
    n, area, state = len(r0), (r1 - r0) * (c1 - c0), state.copy()
    rank = np.empty(n, np.int64)
    rank[np.lexsort((ids, -area))] = np.arange(n)
    order = np.argsort(r0, kind="stable")
    high = np.searchsorted(r0[order], r1[order])
    win, lose, done = [], [], 0
    while done < n:
        # Each pair once: the other box starts no higher than this one and above its end.
        some = max(1, 250_000 // max(1, int(high[done : done + 256].max()) - done))
        i = order[done : done + some]
        j = order[done : int(high[done : done + some].max())]
        dr = np.minimum(r1[i, None], r1[j]) - np.maximum(r0[i, None], r0[j])
        dc = np.minimum(c1[i, None], c1[j]) - np.maximum(c0[i, None], c0[j])
        hit = (dr > 0) & (dc > 0) & (dr * dc > least * np.minimum(area[i, None], area[j])) & (np.arange(len(j)) > np.arange(len(i))[:, None])
        a, b = np.nonzero(hit)
        a, b = i[a], j[b]
        first = rank[a] < rank[b]
        win.append(np.where(first, a, b).astype(np.int32))
        lose.append(np.where(first, b, a).astype(np.int32))
        done += some
    win, lose = np.concatenate(win or [np.zeros(0, np.int32)]), np.concatenate(lose or [np.zeros(0, np.int32)])
    while True:
        before = state.copy()
        state[lose[(state[win] == 1) & (state[lose] == 0)]] = 2
        going = (state[win] == 0) & (state[lose] == 0)
        win, lose = win[going], lose[going]
        free = (state == 0) & whole
        free[lose] = False
        state[free] = 1
        # The edges of the boxes just kept still have to displace.
        if free.any() and len(win):
            state[lose[free[win]]] = 2
        if (state == before).all():
            return state


def _slices(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where horizontal lines enter and leave a polygon: two arrays of lines by intervals, empty ones at 0."""
    x1, y1 = np.roll(x, -1), np.roll(y, -1)
    line = at[:, None]
    cut = (np.minimum(y, y1) <= line) & (line < np.maximum(y, y1))
    with np.errstate(divide="ignore", invalid="ignore"):
        place = np.where(cut, x + (line - y) * (x1 - x) / (y1 - y), np.inf)
    place.sort(1)
    place = place[:, : int(cut.sum(1).max(initial=0) + 1) // 2 * 2]
    place[~np.isfinite(place)] = 0.0
    return place[:, 0::2], place[:, 1::2]


def common_area(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> float:
    """The area that two simple polygons share.

    Between the heights of all corners and crossings the shared width is linear
    in the height, so its middle value times the height is exact.
    """
    ax1, ay1, bx1, by1 = np.roll(ax, -1), np.roll(ay, -1), np.roll(bx, -1), np.roll(by, -1)
    ux, uy, vx, vy = (ax1 - ax)[:, None], (ay1 - ay)[:, None], (bx1 - bx)[None, :], (by1 - by)[None, :]
    wx, wy = bx[None, :] - ax[:, None], by[None, :] - ay[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        det = ux * vy - uy * vx
        s, t = (wx * vy - wy * vx) / det, (wx * uy - wy * ux) / det
        crossing = (ay[:, None] + s * uy)[(det != 0) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)]
    heights = np.unique(np.concatenate([ay, by, crossing]))
    heights = heights[(heights >= max(ay.min(), by.min())) & (heights <= min(ay.max(), by.max()))]
    if len(heights) < 2:
        return 0.0
    at = (heights[1:] + heights[:-1]) / 2
    (a0, a1), (b0, b1) = _slices(ax, ay, at), _slices(bx, by, at)
    width = np.minimum(a1[:, :, None], b1[:, None, :]) - np.maximum(a0[:, :, None], b0[:, None, :])
    return float((np.maximum(width, 0).sum((1, 2)) * np.diff(heights)).sum())


def common_areas(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """``common_area`` of many pairs at once: pairs by corners, a polygon's number of corners the same in all."""
    after = lambda v: np.roll(v, -1, 1)
    ux, uy, vx, vy = (after(ax) - ax)[:, :, None], (after(ay) - ay)[:, :, None], (after(bx) - bx)[:, None, :], (after(by) - by)[:, None, :]
    wx, wy = bx[:, None, :] - ax[:, :, None], by[:, None, :] - ay[:, :, None]
    low, high = np.maximum(ay.min(1), by.min(1))[:, None], np.minimum(ay.max(1), by.max(1))[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        det = ux * vy - uy * vx
        s, t = (wx * vy - wy * vx) / det, (wx * uy - wy * ux) / det
        crossing = np.where((det != 0) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1), ay[:, :, None] + s * uy, -np.inf)
    # Heights beyond the common ones move to the lowest, where they bound nothing.
    heights = np.concatenate([ay, by, crossing.reshape(len(ax), -1)], 1)
    heights = np.sort(np.where((heights >= low) & (heights <= high), heights, low), 1)
    heights = heights[:, max(0, int((heights == low).sum(1).min(initial=heights.shape[1])) - 1) :]
    at = ((heights[:, 1:] + heights[:, :-1]) / 2)[:, :, None]

    def slices(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y, x1, y1 = x[:, None, :], y[:, None, :], after(x)[:, None, :], after(y)[:, None, :]
        cut = (np.minimum(y, y1) <= at) & (at < np.maximum(y, y1))
        with np.errstate(divide="ignore", invalid="ignore"):
            place = np.where(cut, x + (at - y) * (x1 - x) / (y1 - y), np.inf)
        place = np.sort(place, 2)[:, :, : int(cut.sum(2).max(initial=0) + 1) // 2 * 2]
        place[~np.isfinite(place)] = 0.0
        return place[:, :, 0::2], place[:, :, 1::2]

    (a0, a1), (b0, b1) = slices(ax, ay), slices(bx, by)
    width = np.minimum(a1[:, :, :, None], b1[:, :, None, :]) - np.maximum(a0[:, :, :, None], b0[:, :, None, :])
    return np.where(low[:, 0] < high[:, 0], (np.maximum(width, 0).sum((2, 3)) * np.diff(heights, axis=1)).sum(1), 0.0)
