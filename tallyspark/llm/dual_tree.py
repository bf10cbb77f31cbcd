"""Exact top-k by inner product: cover trees over queries and candidates are walked together.

Queries and candidates are cut into blocks; each pair of a query block and a candidate block is one
task's work, so memory is that of two blocks whatever the input. A task builds a cover tree of either
block and walks the two trees together. For two nodes with centres q, p and covering radii r, s no
inner product exceeds qp + |q| s + |p| r + r s; a pair of nodes is left out if that bound lies below the
worst k-th score that the queries under the node have so far. The k best of each pair of blocks are
merged by a ranked window.

Exact search compares every query with every candidate in the worst case, so work grows with the
product of both; the blocks' rows are sent once for each block of the other side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.runtime import materialize

#: Queries and candidates of a block, and points from which a node is not divided further.
QUERY_BLOCK, BLOCK, LEAF = 2048, 8192, 256
#: How far a child's covering radius lies below its parent's, and the most children of a node.
BASE, CHILDREN = 1.3, 16
#: The score of no candidate; its negative is a number too.
NONE = -(1 << 62)


@dataclass
class Node:
    """Points within ``radius`` of the point ``centre``; rows lo..hi of the tree's order are below it."""

    centre: int
    radius: float
    lo: int
    hi: int
    children: list["Node"] = field(default_factory=list)


class CoverTree:
    """A cover tree over the rows of ``x``: children's centres are chosen farthest first, until each point is covered at the next smaller radius."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        first = 0
        d = self._distances(first, self.order)
        self.root = self._build(first, 0, len(x), d)
        self.norms = np.sqrt((x * x).sum(1))

    def _distances(self, centre: int, rows: np.ndarray) -> np.ndarray:
        diff = self.x[rows] - self.x[centre]
        return np.sqrt(np.einsum("ij,ij->i", diff, diff))

    def _build(self, centre: int, lo: int, hi: int, d: np.ndarray) -> Node:
        """d: distances of the rows lo..hi from the centre, which is one of them."""
        stack_root = Node(centre, float(d.max(initial=0.0)), lo, hi)
        stack = [(stack_root, d)]
        while stack:
            node, d = stack.pop()
            rows = self.order[node.lo : node.hi]
            if len(rows) <= LEAF or node.radius == 0.0:
                continue
            goal = node.radius / BASE
            nearest, owner, centres = d.copy(), np.zeros(len(rows), np.int64), [node.centre]
            # where points lie too evenly to be covered by CHILDREN, these keep the radius they reach
            while nearest.max() > goal and len(centres) < CHILDREN:
                far = int(nearest.argmax())
                centres.append(int(rows[far]))
                new = self._distances(centres[-1], rows)
                closer = new < nearest
                nearest[closer], owner[closer] = new[closer], len(centres) - 1
            arranged = np.argsort(owner, kind="stable")
            self.order[node.lo : node.hi] = rows[arranged]
            counts = np.bincount(owner, minlength=len(centres))
            at = node.lo
            for c, n in zip(centres, counts):
                part = nearest[arranged[at - node.lo : at - node.lo + n]]
                child = Node(c, float(part.max()), at, at + int(n))
                node.children.append(child)
                stack.append((child, part))
                at += int(n)
        return stack_root


class _Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> int:
        """The smallest k-th score of the queries ``rows``."""
        return int(self.score[rows, -1].min())

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: one row for each of ``rows``, one column for each of ``ids``; NONE: no candidate."""
        hot = (scores >= self.score[rows, -1][:, None]).any(1)
        rows, scores = rows[hot], scores[hot]
        if not len(rows):
            return
        s = np.concatenate([self.score[rows], scores], 1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, scores.shape)], 1)
        i = np.where(s == NONE, np.iinfo(np.int64).max, i)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[_Best, int]:
    """The k best points for each query, itself left out, and the number of inner products taken.

    Rows of whole numbers; inner products are exact up to 2 ** 53.
    """
    best, taken = _Best(len(queries), k), 0
    if not len(queries) or not len(points):
        return best, taken
    qt, pt = CoverTree(queries), CoverTree(points)
    stack = [(qt.root, pt.root, math.inf)]
    while stack:
        q, p, bound = stack.pop()
        mine = qt.order[q.lo : q.hi]
        # scores are whole numbers: half of one is room for the rounding of the bound, and keeps ties
        if bound < best.worst(mine) - 0.5:
            continue
        if not q.children and not p.children:
            # the same bound for single rows of either leaf against the other leaf's ball
            theirs = pt.order[p.lo : p.hi]
            mine = mine[queries[mine] @ points[p.centre] + qt.norms[mine] * p.radius >= best.score[mine, -1] - 0.5]
            if not len(mine):
                continue
            theirs = theirs[points[theirs] @ queries[q.centre] + pt.norms[theirs] * q.radius >= best.worst(mine) - 0.5]
            if not len(theirs):
                continue
            scores = np.rint(queries[mine] @ points[theirs].T).astype(np.int64)
            taken += scores.size
            scores[query_ids[mine][:, None] == ids[theirs][None, :]] = NONE
            best.add(mine, scores, ids[theirs])
            continue
        # the wider node is opened; of its parts the one with the highest bound is walked first
        open_q = q.children and (not p.children or q.radius >= p.radius)
        parts_q, parts_p = (q.children, [p]) if open_q else ([q], p.children)
        cq, cp = np.array([n.centre for n in parts_q]), np.array([n.centre for n in parts_p])
        rq, rp = np.array([n.radius for n in parts_q]), np.array([n.radius for n in parts_p])
        bounds = queries[cq] @ points[cp].T + qt.norms[cq][:, None] * rp[None, :] + rq[:, None] * pt.norms[cp][None, :] + rq[:, None] * rp[None, :]
        flat = bounds.ravel()
        for at in np.argsort(flat, kind="stable"):
            stack.append((parts_q[at // len(parts_p)], parts_p[at % len(parts_p)], float(flat[at])))
    return best, taken


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0))


def top_k(vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its k best rows by inner product of floor(scale * component).

    ``is_query``: SQL condition that marks the queries; every other row is a candidate for each of
    them, a query not for itself (rows with its own id are left out). Ties go to the smaller id; a query
    with fewer than k candidates gets all; of query rows with one id the one with the smallest vector asks. Rows whose vector or id is null, whose vector is empty or
    holds a null or non-finite component take no part; vectors of different lengths never meet. Repeated
    rows are candidates as often as they come. Scores are taken as exact products of doubles: where a squared
    length reaches 2^53, so that a score could be rounded, an ArithmeticError is raised. Other columns are only read by ``is_query``. An empty
    table gives an empty result.
    """
    v = F.col(f"`{vector_col}`")
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    sound = v.isNotNull() & F.col(f"`{id_col}`").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = materialize(vectors.where(sound).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("vec"), F.size(v).alias("dim"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks")), "vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    counts = rows.agg(F.count_if("asks").alias("q"), F.count(F.lit(1)).alias("n"), F.max(square).alias("most")).first()
    if (counts["most"] or 0.0) >= 2.0**53:
        raise ArithmeticError(f"a vector has the squared length {counts['most']:.3g}; scores of 2^53 and more are not exact")
    nq, np_ = max(1, math.ceil(counts["q"] / query_block)), max(1, math.ceil(counts["n"] / block))
    place = lambda n: F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")
    asking = rows.where("asks").groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    queries = asking.select("id", "vec", "dim", place(nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(np_ - 1))).alias("pb"))
    points = rows.select("id", "vec", "dim", place(np_).alias("pb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        best, _ = search(_matrix(q["vec"]), q["id"].to_numpy(), _matrix(p["vec"]), p["id"].to_numpy(), k)
        real = best.score > NONE
        at = np.nonzero(real)[0]
        return pd.DataFrame({"query_id": q["id"].to_numpy()[at] if len(q) else [], "vec_id": best.id[real], "score": best.score[real]})

    keys = ["qb", "pb", "dim"]
    found = queries.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
