"""Exact top-k inner products by best-first search in M-trees.

Vectors become whole numbers, floor(scale * x). With one more coordinate,
sqrt(L - |x|^2) for L the largest squared length (0 for a query), the largest inner
product is the smallest Euclidean distance, a metric:
|q - x|^2 = |q|^2 + L - 2 q.x. Hence an M-tree finds exact inner products.

1. Pivots, a bounded sample (``pivots``), cut space into cells: each vector
   belongs to its nearest pivot. A cell with more than ``CELL_ROWS`` vectors, even
   of equal ones, is dealt to several trees under its pivot.
2. Each tree is loaded in bulk into pages: leaf entries hold a vector and its
   distance to the page's centre; inner entries a child's centre, covering radius
   and distance to the parent's centre.
3. Queries first search the trees of their nearest cell, which gives each a
   threshold, its k-th best score there. Then they search, by that threshold,
   the other trees whose lower bound does not rule them out.
4. A search keeps a heap of pages by lower bound. Bounds from the stored parent
   distances (triangle inequality) rule entries out before any distance to them
   is computed.

Bounds are widened by a small slack, so rounding never loses a result; scores are
exact whole numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

SCALE = 64
PIVOTS = 256  # at most; the documented bound of the sample
CELL_ROWS = 8192  # vectors of one tree
PAGE = 1024  # entries of a leaf page
QUERY_BLOCK = 4096  # queries that search a tree together
SLACK = 1e-6


def whole_vector(column: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as longs."""
    return F.transform(F.col(column), lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(column: str = "embedding") -> Column:
    """Not NULL, and without NULL, NaN or infinite components."""
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~bad, F.lit(False))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    """Rows of whole numbers; a shorter vector ends in zeros."""
    lengths = column.map(len).to_numpy()
    if len(column) and (lengths == dim).all():
        return np.stack(column.to_numpy()).astype(np.int64)
    out = np.zeros((len(column), dim), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    x = vectors.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0.0))])


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = points - centre
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class Tree:
    """An M-tree over the rows of a matrix, as arrays by page. ``order`` sorts the
    rows by leaf page, so that a page is a slice of them."""

    def __init__(self, points: np.ndarray, page: int = PAGE) -> None:
        self.points = points
        self.centres: list[np.ndarray] = []
        self.radius: list[float] = []
        self.rows: list[np.ndarray | slice | None] = []  # of leaf pages
        self.kids: list[list[int]] = []  # of inner pages
        self.to_parent: list[np.ndarray] = []  # distances of the entries to the page's centre
        self.root = self._load(np.arange(len(points)), page)
        leaves = [k for k, rows in enumerate(self.rows) if rows is not None]
        self.order = np.concatenate([self.rows[k] for k in leaves])
        at = 0
        for k in leaves:
            n = len(self.rows[k])
            self.rows[k] = slice(at, at + n)
            at += n

    def _page(self, centre: np.ndarray, radius: float, rows, kids, to_parent) -> int:
        for store, value in zip((self.centres, self.radius, self.rows, self.kids, self.to_parent), (centre, radius, rows, kids, to_parent)):
            store.append(value)
        return len(self.radius) - 1

    def _load(self, rows: np.ndarray, page: int) -> int:
        """Bulk loading: cut by nearest of a few far-apart rows until a page holds all."""
        pts = self.points[rows]
        centre = pts[int(_distances(pts, pts.mean(0)).argmin())]
        dist = _distances(pts, centre)
        if len(rows) <= page:
            return self._page(centre, float(dist.max()), rows, [], dist)
        fan = min(16, -(-len(rows) // page) + 1)
        seeds = [int(dist.argmax())]
        near = _distances(pts, pts[seeds[0]])
        owner = np.zeros(len(rows), np.int64)
        for s in range(1, fan):
            seeds.append(int(near.argmax()))
            d = _distances(pts, pts[seeds[-1]])
            owner[d < near] = s
            near = np.minimum(near, d)
        parts = [rows[owner == s] for s in range(fan)]
        parts = [x for x in parts if len(x)]
        if len(parts) == 1 or max(map(len, parts)) > 0.9 * len(rows):
            parts = np.array_split(rows[np.argsort(dist, kind="stable")], fan)  # equal rows cannot be told apart
        kids = [self._load(x, page) for x in parts]
        to_parent = _distances(np.stack([self.centres[k] for k in kids]), centre)
        return self._page(centre, float(dist.max()), None, kids, to_parent)

    def search(self, query: np.ndarray, reach: float, visit) -> None:
        """Call ``visit(rows)``, which gives the new reach, best page first;
        ``rows`` is a slice or an array of places in ``order``."""
        start = float(np.linalg.norm(query - self.centres[self.root]))
        heap = [(max(0.0, start - self.radius[self.root]), self.root, start)]
        while heap:
            bound, page, to_centre = heapq.heappop(heap)
            if bound > reach:
                return
            gaps = np.abs(self.to_parent[page] - to_centre)
            rows = self.rows[page]
            if rows is not None:
                close = np.flatnonzero(gaps <= reach)
                if len(close):  # a page of which most may count is cheaper to compute as a whole
                    reach = visit(rows.start + close if 4 * len(close) < len(gaps) else rows)
                continue
            for kid, gap in zip(self.kids[page], gaps.tolist()):
                if gap - self.radius[kid] > reach:
                    continue  # ruled out by the parent's distance alone
                d = float(np.linalg.norm(query - self.centres[kid]))
                lower = max(0.0, d - self.radius[kid])
                if lower <= reach:
                    heapq.heappush(heap, (lower, kid, d))


FOUND = "query_id long, vec_id long, score long"


def _search(dim: int, longest: float, k: int):
    """Queries that meet one tree: their k best rows of it, as far as their threshold goes."""

    def exact(points: np.ndarray, q: np.ndarray) -> bool:
        return float(np.abs(points).max(initial=0)) * float(np.abs(q).max(initial=0)) * dim < 2**53

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        points = _matrix(vectors["v"], dim)
        ids = vectors["vec_id"].to_numpy(np.int64)
        tree = Tree(_lift(points, longest))
        points, ids = points[tree.order], ids[tree.order]
        asked = _matrix(queries["v"], dim)
        fast = points.astype(np.float64) if exact(points, asked) else None
        # Beyond 2^53 a double may round a score up; a threshold must not.
        under = float if fast is not None else (lambda score: float(np.nextafter(float(score), -np.inf)))
        out_q, out_v, out_s = [], [], []
        for qid, q, limit in zip(queries["query_id"].to_numpy(np.int64), asked, queries["least"].to_numpy(np.float64)):
            limit = under(limit)
            square = float((q.astype(np.float64) ** 2).sum())
            best_s, best_v = np.empty(0, np.int64), np.empty(0, np.int64)
            qf = q.astype(np.float64)
            widen = 1e-9 * (square + longest) + SLACK

            def reach_of(score: float) -> float:
                return float(np.sqrt(max(0.0, square + longest - 2 * score) + widen)) + SLACK

            def visit(rows: np.ndarray) -> float:
                nonlocal best_s, best_v, limit
                scores = fast[rows] @ qf if fast is not None else points[rows] @ q
                good = np.flatnonzero(scores >= limit)
                if len(good):
                    found = np.rint(scores[good]).astype(np.int64) if fast is not None else scores[good]
                    s, v = np.concatenate((best_s, found)), np.concatenate((best_v, ids[rows][good]))
                    other = v != qid
                    s, v = s[other], v[other]
                    top = np.lexsort((v, -s))[:k]
                    best_s, best_v = s[top], v[top]
                    if len(best_s) == k:
                        limit = max(limit, under(best_s[-1]))
                return reach_of(limit) if limit > -np.inf else np.inf

            tree.search(np.append(qf, 0.0), reach_of(limit) if limit > -np.inf else np.inf, visit)
            out_q.append(np.full(len(best_s), qid))
            out_v.append(best_v)
            out_s.append(best_s)
        return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    return run


def _assign(pivots: np.ndarray, dim: int, longest: float):
    """(vec_id, v, cell, dist) of each vector: its nearest pivot."""
    squares = (pivots * pivots).sum(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if not len(frame):
                continue
            x = _lift(_matrix(frame["v"], dim), longest)
            d2 = (x * x).sum(1)[:, None] + squares - 2 * x @ pivots.T
            cell = d2.argmin(1)
            dist = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield frame.assign(cell=cell.astype(np.int32), dist=dist)

    return run


def _bounds(pivots: np.ndarray, radii: np.ndarray, dim: int):
    """(query_id, v, cell, lower, place) of each query and each cell with vectors."""
    live = np.flatnonzero(radii >= 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if not len(frame):
                continue
            q = np.column_stack([_matrix(frame["v"], dim).astype(np.float64), np.zeros(len(frame))])
            for qid, v, row in zip(frame["query_id"], frame["v"], q):
                d = _distances(pivots[live], row)
                lower = np.maximum(0.0, d - radii[live])
                place = np.empty(len(live), np.int32)
                place[np.argsort(d, kind="stable")] = np.arange(len(live))
                yield pd.DataFrame({"query_id": qid, "v": [v] * len(live), "cell": live.astype(np.int32), "lower": lower, "place": place})

    return run


def top_inner_products(
    vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = SCALE, id_column: str = "vec_id",
    column: str = "embedding", pivots: int = PIVOTS, cell_rows: int = CELL_ROWS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products of
    whole-number vectors, ties to the smaller vec_id, rank from 1.

    A query is never its own answer: rows with its id are left out, repeated ones
    too. Other rows that repeat an id count once each. Vectors that are NULL, hold
    NULL or non-finite components or have no id take no part; of vectors of
    different lengths the shorter counts as ending in zeros. Scores must fit a long. With fewer than k
    candidates all are returned; without any, no rows.
    """
    usable_rows = vectors.where(usable(column) & F.col(id_column).isNotNull())
    base = stored(usable_rows.select(F.col(id_column).cast("long").alias("vec_id"), whole_vector(column, scale).alias("v")), "vectors")
    asked = queries.where(usable(column) & F.col(id_column).isNotNull())
    asked = stored(asked.select(F.col(id_column).cast("long").alias("query_id"), whole_vector(column, scale).alias("v")).dropDuplicates(["query_id"]), "queries")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(square).alias("longest")).first()
    spark = vectors.sparkSession
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked_facts = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim, longest = max(facts["dim"], asked_facts["dim"] or 0, 1), float(facts["longest"])
    # Pivots: a bounded sample, those with the smallest hash of their id.
    count = max(1, min(pivots, -(-2 * facts["n"] // cell_rows)))
    rows = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()
    centre = _lift(_matrix(pd.Series([r["v"] for r in rows]), dim), longest)
    placed = stored(base.mapInPandas(_assign(centre, dim, longest), "vec_id long, v array<long>, cell int, dist double"), "cells")
    # One row per pivot comes back.
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect()}
    radii = np.array([cells[c]["r"] * (1 + 1e-9) + SLACK if c in cells else -1.0 for c in range(len(centre))])
    trees = F.create_map(*[F.lit(x) for c, r in cells.items() for x in (c, -(-r["n"] // cell_rows))])
    ways = F.element_at(trees, F.col("cell"))
    blocks = max(1, -(-asked_facts["n"] // query_block))
    dealt = placed.withColumn("tree", F.pmod(F.xxhash64("vec_id", F.lit("tree")), ways).cast("int"))
    bounds = asked.mapInPandas(_bounds(centre, radii, dim), "query_id long, v array<long>, cell int, lower double, place int")
    bounds = bounds.withColumn("qblock", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    def searched(pairs: DataFrame) -> DataFrame:
        at = ["cell", "tree", "qblock"]
        asks = pairs.withColumn("tree", F.explode(F.sequence(F.lit(0), ways - 1)))
        trees_ = dealt.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return trees_.groupBy(*at).cogroup(asks.groupBy(*at)).applyInPandas(_search(dim, longest, k), FOUND)

    def best(found: DataFrame) -> DataFrame:
        # Spark keeps k rows per query in each task before the shuffle.
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score")

    near = bounds.where("place = 0").withColumn("least", F.lit(float("-inf")))
    first = stored(searched(near), "nearest")
    # The k-th best so far; with fewer than k there is no threshold yet.
    ranked = best(first).groupBy("query_id").agg(F.max("rank").alias("got"), F.min("score").alias("worst"))
    least = F.when(F.col("got") == k, F.col("worst").cast("double")).otherwise(F.lit(float("-inf")))
    far = bounds.where("place > 0").join(ranked, "query_id", "left").withColumn("least", F.coalesce(least, F.lit(float("-inf"))))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) + longest
    reach = F.sqrt(F.greatest(F.lit(0.0), length - 2 * F.col("least")) + length * 1e-9 + SLACK) + SLACK
    far = far.where((F.col("least") == float("-inf")) | (F.col("lower") <= reach)).drop("got", "worst")
    return best(first.unionByName(searched(far.select(near.columns))))
