"""Exact top-k by inner product with M-trees.

Equal vectors are one point that keeps its least ids.  Points are dealt by hash
into blocks, and the stated queries meet every block.  In a block, one more
component lifts all points to one norm, so that the greatest inner product is the
least distance; a paged M-tree holds a routing object, covering radius and
parent distance per node.  Best-first search takes nodes by their least possible
distance and leaves out those that the stored bounds, by the triangle
inequality, put beyond the k-th best; often before their own distance is known.
A block's queries search side by side: each takes its own best nodes, first one,
then two, four and so on, and those that meet at a node share one matrix product.

Vectors that are null, empty or hold a null or non-finite component take no part.
Only vectors of a query's dimension are its candidates.  Ties go to the smaller
id; rows of the query's own id are no candidates.  Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .groups import by_group, sorted_groups
from .store import parallelism, settle

#: Points of a block and queries of a block, at most about; entries of a leaf page, children of an inner one.
POINTS, QUERIES, PAGE, FANOUT = 16_384, 2_048, 256, 16
#: Bounds that queries side by side hold at most: those of each to each node.
BOUNDS = 1 << 20


class MTree:
    """A bulk-loaded M-tree over integer vectors of one dimension."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.vectors = vectors.astype(np.float64)
        norms = (self.vectors * self.vectors).sum(1)
        self.top = float(norms.max())
        self.lift = np.sqrt(self.top - norms)
        self.rng = np.random.default_rng(seed)
        #: Distances computed by searches, against those a scan computes.
        self.computed = self.scanned = 0
        root = int(np.argmin(norms))
        self.root = self._build(np.arange(len(vectors)), root, self._distances(np.arange(len(vectors)), root))
        #: All nodes; the children of one are neighbours, from its ``first`` on.
        self.nodes = [self.root]
        for node in self.nodes:
            node["first"] = len(self.nodes)
            self.nodes += node.get("children", [])

    def _distances(self, at: np.ndarray, to: int) -> np.ndarray:
        square = 2 * self.top - 2 * (self.vectors[at] @ self.vectors[to] + self.lift[at] * self.lift[to])
        return np.sqrt(np.maximum(square, 0))

    def _build(self, at: np.ndarray, routing: int, away: np.ndarray) -> dict:
        """A node over the points ``at`` with their distances from its routing object."""
        node = {"routing": routing, "radius": float(away.max())}
        if len(at) <= PAGE:
            return node | {"points": at, "away": away}
        pivots = self.rng.choice(at, FANOUT, replace=False)
        each = np.stack([self._distances(at, int(p)) for p in pivots])
        each[np.arange(FANOUT), np.searchsorted(at, pivots)] = -1.0  # a pivot stays its own
        near = each.argmin(0)
        each = np.maximum(each, 0)
        children = [self._build(at[near == c], int(p), each[c, near == c]) for c, p in enumerate(pivots)]
        return node | {
            "children": children,
            "away": np.array([away[np.searchsorted(at, int(p))] for p in pivots]),
            "routings": pivots,
            "radii": np.array([c["radius"] for c in children]),
        }

    def search(self, query: np.ndarray, k: int, members, best: list) -> None:
        """Add to ``best``, a heap of (score, -id), the ``k`` best of this tree; ``members(i)`` gives a point's ids in order."""
        q = query.astype(np.float64)
        square = float(q @ q) + self.top
        # Beyond the rounding of sums of exact integers below 2^53.
        slack = 1e-6 * (1 + square**0.5)
        distances = lambda at: np.sqrt(np.maximum(square - 2 * (self.vectors[at] @ q), 0))

        def reach() -> float:
            return np.inf if len(best) < k else max(square - 2 * best[0][0], 0) ** 0.5 + slack

        self.scanned += len(self.vectors)
        self.computed += 1
        first = float(distances(np.array([self.root["routing"]]))[0])
        queue = [(max(first - self.root["radius"], 0.0), 0, first, self.root)]
        ticket = 1
        while queue:
            least, _, own, node = heapq.heappop(queue)
            limit = reach()
            if least > limit:
                return
            if "points" in node:
                at = node["points"][np.abs(own - node["away"]) <= limit]
                self.computed += len(at)
                score = self.vectors[at] @ q
                if len(best) >= k:
                    keep = score >= best[0][0]
                    at, score = at[keep], score[keep]
                for i in np.argsort(-score, kind="stable")[: None if len(best) < k else len(score)].tolist():
                    s = int(score[i])
                    if len(best) >= k and s < best[0][0]:
                        break
                    for member in members(int(at[i])):
                        entry = (s, -member)
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
                        else:
                            break
                continue
            open_ = np.flatnonzero(np.abs(own - node["away"]) - node["radii"] <= limit)
            self.computed += len(open_)
            to = distances(node["routings"][open_])
            for c, d in zip(open_.tolist(), to.tolist()):
                bound = max(d - node["children"][c]["radius"], least, 0.0)
                if bound <= limit:
                    heapq.heappush(queue, (bound, ticket, d, node["children"][c]))
                    ticket += 1


    def search_all(self, queries: np.ndarray, own: np.ndarray, k: int, first: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, score, id) of the ``k`` best of each query but its ``own`` id; point i has ``ids[first[i]:first[i + 1]]``."""
        step = max(1, BOUNDS // len(self.nodes))
        parts = [self._side_by_side(queries[a : a + step], own[a : a + step], k, first, ids) for a in range(0, len(queries), step)]
        place = [r + a for (r, _, _), a in zip(parts, range(0, len(queries), step))]
        return np.concatenate(place), np.concatenate([s for _, s, _ in parts]), np.concatenate([i for _, _, i in parts])

    def _side_by_side(self, queries: np.ndarray, own: np.ndarray, k: int, first: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = queries.astype(np.float64)
        square = (q * q).sum(1) + self.top
        slack = 1e-6 * (1 + np.sqrt(square))
        held = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        away, bound = np.zeros((len(q), len(self.nodes))), np.full((len(q), len(self.nodes)), np.inf)

        def distances(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(square[rows, None] - 2 * (q[rows] @ self.vectors[at].T), 0))

        def reach(rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(square[rows] - 2 * held[0][rows, -1], 0)) + slack[rows]

        every = np.arange(len(q))
        self.scanned += len(q) * len(self.vectors)
        self.computed += len(q)
        away[:, 0] = distances(every, np.array([self.root["routing"]]))[:, 0]
        bound[:, 0] = np.maximum(away[:, 0] - self.root["radius"], 0)
        step = 1
        while True:
            # Nodes that are taken, or not yet known, have an infinite bound.
            take = (bound <= reach(every)[:, None]) & (bound < np.inf)
            if not take.any():
                break
            if step < len(self.nodes):
                take &= bound <= np.partition(np.where(take, bound, np.inf), step - 1, axis=1)[:, step - 1 : step]
            leaves = False
            for c in np.flatnonzero(take.any(0)).tolist():
                node, rows = self.nodes[c], np.flatnonzero(take[:, c])
                least = bound[rows, c]
                bound[rows, c] = np.inf
                near = least <= reach(rows)
                rows, least = rows[near], least[near]
                limit, gap = reach(rows)[:, None], np.abs(away[rows, c, None] - node["away"])
                if "points" in node:
                    leaves = True
                    self._offer(node["points"], gap <= limit, q, rows, own, first, ids, held)
                    continue
                near = gap - node["radii"] <= limit
                open_ = np.flatnonzero(near.any(0))
                self.computed += len(rows) * len(open_)
                to, at = distances(rows, node["routings"][open_]), (rows[:, None], node["first"] + open_)
                away[at] = to
                bound[at] = np.where(near[:, open_], np.maximum(to - node["radii"][open_], least[:, None]), np.inf)
            step *= 1 + leaves
        row, place = np.nonzero(held[0] > -np.inf)
        return row, held[0][row, place].astype(np.int64), held[1][row, place]

    def _offer(self, at: np.ndarray, near: np.ndarray, q: np.ndarray, rows: np.ndarray, own: np.ndarray, first: np.ndarray, ids: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> None:
        """Merge a leaf's points, ``near`` or not to each of ``rows``, into what these hold: scores falling, equal ones by rising id."""
        scores, holders = held
        k = scores.shape[1]
        some = near.any(0)
        at, near = at[some], near[:, some]
        self.computed += len(rows) * len(at)
        s = np.where(near, q[rows] @ self.vectors[at].T, -np.inf)
        floor = scores[rows, -1]
        if len(at) > k + 1:
            # One of the k + 1 greatest may be the query's own.
            many = np.flatnonzero((s >= floor[:, None]).sum(1) > k + 1)
            floor[many] = np.maximum(floor[many], np.partition(s[many], len(at) - k - 1, axis=1)[:, len(at) - k - 1])
        r, p = np.nonzero((s >= floor[:, None]) & near)
        size = first[at[p] + 1] - first[at[p]]
        of = np.repeat(rows[r], size)
        member = ids[np.repeat(first[at[p]] - np.cumsum(size) + size, size) + np.arange(len(of))]
        other = member != own[of]
        if not other.any():
            return
        row = np.unique(of[other])
        of = np.concatenate([np.repeat(row, k), of[other]])
        score = np.concatenate([scores[row].ravel(), np.repeat(s[r, p], size)[other]])
        member = np.concatenate([holders[row].ravel(), member[other]])
        order = np.lexsort((member, -score, of))
        start = np.searchsorted(of[order], row)
        best = order[start[:, None] + np.arange(k)]
        scores[row], holders[row] = score[best], member[best]


def scaled(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null for a vector that takes no part."""
    x = embedding.cast("array<double>")
    # NaN is the greatest double, and infinities are beyond any float.
    fine = (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(F.abs(v) <= F.lit(1e300), F.lit(False)))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale)))


def _search_blocks(batches, k: int):
    """Of sorted rows (part, kind, vector, ids), the ``k`` best points of each block's queries."""
    for group in sorted_groups(batches):
        kind = group.column("kind").to_numpy()
        column, lists = (group.column(x).combine_chunks() for x in ("vector", "ids"))
        dense = column.flatten().to_numpy(zero_copy_only=False).reshape(len(kind), -1)
        ids = lists.flatten().to_numpy()
        first = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        n = int(np.searchsorted(kind, 1))  # the points, then the queries
        if not 0 < n < len(kind):
            continue
        own = ids[first[n] :]
        place, score, member = MTree(dense[:n]).search_all(dense[n:], own, k, first, ids)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (own[place], member, score)], names=["query_id", "id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``vectors`` and ``queries``: id, vector (array of long, or null).  Per query its ``k`` best: query_id, rank, id, score."""
    points = vectors.where(F.col("vector").isNotNull())
    least = Window.partitionBy("vector").orderBy("id")
    points = points.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    points = settle(points.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    asked = settle(queries.where(F.col("vector").isNotNull()).select("id", "vector"), "queries")
    spark = vectors.sparkSession
    blocks = max(-(-points.count() // POINTS), parallelism(spark))
    query_blocks = max(-(-asked.count() // QUERIES), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = points.select(F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int").alias("b"), "vector", "ids", every(query_blocks).alias("q"))
    b = asked.select(every(blocks).alias("b"), "vector", F.array("id").alias("ids"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("q"))
    part = F.xxhash64("b", "q", F.size("vector")).alias("part")
    rows = a.select(part, F.lit(0).alias("kind"), "vector", "ids").union(b.select(part, F.lit(1).alias("kind"), "vector", "ids"))

    found = by_group(rows, lambda batches: _search_blocks(batches, k), "query_id bigint, id bigint, score bigint").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
