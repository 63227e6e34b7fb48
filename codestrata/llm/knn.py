"""Exact top-k by inner product, with two cover trees searched together.

Vectors are integers: each component x is floor(64 * x). Candidates are dealt into blocks by a hash
of their id, queries into groups likewise; a task holds one block and one group and builds a cover
tree of each. In a cover tree a node's point stands for all points within its covering radius; its
children are points more than half that radius apart which cover the node, one being its own point.
The search takes pairs of nodes: an inner product of two descendants is at most
q.r + radius_q * |r| + radius_r * |q| + radius_q * radius_r of the nodes' points, so a pair goes
when that is below the worst kth score of the queries under its node. Pairs of leaves are compared
point by point. Every query first meets one block; its kth score there is a floor for the others.

Vectors that are null or hold a null or non-finite component take no part. Shorter vectors count as
if filled with zeros. Scores are exact: where a sum of products may pass 2**53, the largest that
doubles hold exactly, pairs are scored in Python's whole numbers. A score beyond the range of a long
is the end of that range. A query does not meet rows of its own id. Repeated rows are rows of their own, so an
id may come twice in a result. Queries without candidates have no rows. Ties go to the smaller id."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
#: Candidates, and queries, that one task holds.
BLOCK, GROUP = 4096, 2048
#: Points of a node that is not divided any more, and children of a node at most.
LEAF, CHILDREN = 48, 24
#: A node of up to so many points stays a leaf if its children would hold fewer than FEW on average:
#: where points lie about equally far apart, smaller balls tell no more.
WIDE, FEW = 512, 4
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)

_NONE = -(1 << 63)
_DOUBLE = 1.7976931348623157e308
_LEAST, _MOST = -(1 << 63) + 1, (1 << 63) - 1


def integers(vector: str, scale: int = SCALE) -> Column:
    """The components as numbers; null where the vector takes no part."""
    x = f"transform(`{vector}`, x -> CAST(x AS DOUBLE))"
    fine = f"forall({x}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    # a double of that size is whole, and floor() would give a long; what overflows is the greatest double
    whole = f"CASE WHEN abs({scale} * x) < {EXACT} THEN CAST(floor({scale} * x) AS DOUBLE) ELSE greatest(least({scale} * x, {_DOUBLE}D), -{_DOUBLE}D) END"
    return F.expr(f"CASE WHEN {fine} THEN transform({x}, x -> {whole}) END")


class CoverTree:
    """points (rows), ordered so that every node holds a range; per node: first, end, centre (a row of
    the points), radius, children."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points
        self.first, self.end, self.centre, self.radius, self.children = [], [], [], [], []
        start = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
        self._divide(np.arange(len(points)), start)
        self.order = np.concatenate(self._leaves)
        self.points = points[self.order]
        self.centre = points[self.centre]
        self.norm = np.sqrt((self.centre ** 2).sum(1))
        self.radius = np.array(self.radius)

    _leaves: list

    def _divide(self, rows: np.ndarray, centre: int) -> None:
        self._leaves, at = [], 0
        todo = [(rows, centre, -1)]
        while todo:  # depth first, so that the rows of a node come out side by side
            rows, centre, parent = todo.pop()
            node = len(self.first)
            away = self._distance(rows, centre)
            radius = float(away.max())
            self.first.append(at)
            self.centre.append(centre)
            self.radius.append(radius)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            self.end.append(at + len(rows))
            if len(rows) <= LEAF or radius == 0:
                self._leaves.append(rows)
                at += len(rows)
                continue
            parts = self._cover(rows, centre, away, radius / 2)
            if len(rows) <= WIDE and len(rows) < FEW * len(parts):
                self._leaves.append(rows)
                at += len(rows)
                continue
            todo += [(part, c, node) for part, c in parts]

    def _distance(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(1))

    def _cover(self, rows: np.ndarray, centre: int, away: np.ndarray, reach: float) -> list[tuple[np.ndarray, int]]:
        """Points more than `reach` apart, the farthest one next, until all are covered."""
        centres, nearest, owner = [centre], away.copy(), np.zeros(len(rows), np.int64)
        while True:
            far = int(nearest.argmax())
            if nearest[far] <= reach or len(centres) >= CHILDREN:  # the rest stays with its nearest centre
                break
            closer = self._distance(rows, rows[far])
            mine = closer < nearest
            owner[mine], nearest[mine] = len(centres), closer[mine]
            centres.append(int(rows[far]))
        return [(rows[owner == i], c) for i, c in enumerate(centres)]


class Best:
    """The k best (score, id) of each query so far; a floor may be known before."""

    def __init__(self, ids: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.k, self.floors = ids, k, floors
        self.score = np.full((len(ids), k), _NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.worst = floors.copy()

    def add(self, first: int, end: int, score: np.ndarray, ids: np.ndarray) -> None:
        score = np.where(ids[None, :] == self.ids[first:end, None], _NONE, score)
        better = np.flatnonzero((score >= self.worst[first:end, None]).any(0))
        if not len(better):
            return
        score = np.concatenate((self.score[first:end], score[:, better]), 1)
        found = np.concatenate((self.found[first:end], np.broadcast_to(ids[better], (end - first, len(better)))), 1)
        order = np.lexsort((found, ~score), axis=1)[:, :self.k]
        self.score[first:end] = np.take_along_axis(score, order, 1)
        self.found[first:end] = np.take_along_axis(found, order, 1)
        self.worst[first:end] = np.maximum(self.floors[first:end], self.score[first:end, -1])


def whole_scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of any whole numbers, within the range of a long."""
    exact = np.vectorize(int, otypes=[object])
    products = exact(queries).dot(exact(candidates).T)
    return np.vectorize(lambda s: min(max(s, _LEAST), _MOST), otypes=[np.int64])(products)


def search(queries: CoverTree, candidates: CoverTree, ids: np.ndarray, best: Best, unit_q: float = 1.0,
           unit_r: float = 1.0, exact: bool = True) -> int:
    """Fills `best` (in the order of the query tree); returns how many pairs of points were compared.

    The trees' points are the components divided by the units, powers of two; not `exact` if doubles do not hold
    all scores."""
    compared = 0
    root = (0.0, 0, 0)
    todo = [root]
    while todo:
        bound, q, r = todo.pop()
        if bound < best.worst[queries.first[q]:queries.end[q]].min() and (q, r) != (0, 0):
            continue
        if not queries.children[q] and not candidates.children[r]:
            a, b, c, d = queries.first[q], queries.end[q], candidates.first[r], candidates.end[r]
            own, other = queries.points[a:b], candidates.points[c:d]
            if exact:
                best.add(a, b, (own @ other.T).astype(np.int64), ids[c:d])
            else:
                best.add(a, b, whole_scores(own * unit_q, other * unit_r), ids[c:d])
            compared += (b - a) * (d - c)
            continue
        # the larger of both nodes is divided
        split_q = queries.children[q] and (not candidates.children[r] or queries.radius[q] > candidates.radius[r])
        qs = np.array(queries.children[q] if split_q else [q])
        rs = np.array([r] if split_q else candidates.children[r])
        at_most = (queries.centre[qs] @ candidates.centre[rs].T
                   + queries.radius[qs, None] * candidates.norm[rs] + queries.norm[qs, None] * candidates.radius[rs]
                   + queries.radius[qs, None] * candidates.radius[rs])
        slack = 1e-9 * ((queries.norm[qs, None] + queries.radius[qs, None]) * (candidates.norm[rs] + candidates.radius[rs]))
        with np.errstate(over="ignore"):  # an infinite bound prunes nothing
            at_most = (at_most + slack) * unit_q * unit_r
        # scores are whole, and rounding never cuts one off; those beyond a long count as its end
        at_most = np.minimum(np.floor(at_most + 1e-3), float(_MOST))
        pairs = sorted((float(at_most[i, j]), int(x), int(y)) for i, x in enumerate(qs) for j, y in enumerate(rs))
        todo += pairs  # the most promising is taken first
    return compared


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    at = np.arange(width) < sizes[:, None]
    out[at] = rows.flatten().to_numpy()
    return out


def _unit(points: np.ndarray) -> float:
    """A power of two near the largest component."""
    return 2.0 ** (math.frexp(float(np.abs(points).max()))[1] - 1) if points.any() else 1.0


def _block_results(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, query, vec_id, score) of every (block, group), at most k of a query."""
    def best_of(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "query_id", "vec_id", "score"]
        kinds = [pa.int64()] * 4
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        width = max(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max() for t in (left, right))
        q, c = (_matrix(t.column("v"), max(1, int(width))) for t in (left, right))
        # whatever the order of the additions, no sum of products passes this
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, int(width)) < EXACT
        units = (1.0, 1.0) if exact else (_unit(q), _unit(c))
        qt, ct = CoverTree(q / units[0]), CoverTree(c / units[1])
        ids = right.column("id").to_numpy()[ct.order]
        best = Best(left.column("id").to_numpy()[qt.order], left.column("floor").to_numpy()[qt.order], k)
        search(qt, ct, ids, best, *units, exact=exact)
        there = (best.score > _NONE) & (best.score >= best.floors[:, None])
        per = there.sum(1)
        number = left.column("query").to_numpy()[qt.order]
        return pa.table([pa.array(np.repeat(number, per)), pa.array(np.repeat(best.ids, per)),
                         pa.array(best.found[there]), pa.array(best.score[there])], names=names)

    return (queries.groupBy("block", "grp").cogroup(candidates.groupBy("block", "grp"))
            .applyInArrow(best_of, "query long, query_id long, vec_id long, score long"))


def top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K,
          block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query row."""
    points = vectors.select(F.col(key).cast("long").alias("id"), integers(vector).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(F.col(key).cast("long").alias("id"), integers(vector).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    n_blocks = max(1, -(-points.count() // block))
    n_groups = max(1, -(-asked.count() // group))
    dealt = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(n)).cast("int")
    # equal query rows are one question, asked once
    asked = asked.groupBy("id", "v").agg(F.count("*").alias("times")).withColumn(
        "grp", dealt(n_groups)).withColumn("query", F.xxhash64("id", "v"))
    points = points.withColumn("block", dealt(n_blocks)).withColumn(
        "grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    none = F.lit(_NONE).cast("long")
    first = _block_results(asked.withColumn("block", F.lit(0)).withColumn("floor", none), points.filter("block = 0"), k)
    floors = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(f"n = {k}")
    rest = asked.join(floors.select("query", "kth"), "query", "left").withColumn(
        "floor", F.coalesce("kth", none)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    every = _block_results(rest, points, k)
    by = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")
    return (every.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
