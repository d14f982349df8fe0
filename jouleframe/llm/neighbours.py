"""Approximate nearest neighbours by stable projections and kd-trees (operator 5).

Largest inner products become smallest distances by one extra coordinate that gives all
candidates the same norm. Vectors are projected on ``PROJECTED`` Gaussian directions, so that
a squared projected distance is the squared true distance times a chi-square variable of that
many degrees. A kd-tree over the projections, fitted on a bounded sample, deals all rows
into blocks, and each block's task builds the lower part of the tree over its own rows.

A query first searches its home block, which bounds the distance d of its k-th neighbour. It
then visits every block whose box, in projected space, is not farther than d times the root
of the chi-square quantile at ``SURE``. In a block, points are taken in order of projected distance and verified
with the true measure until that same test holds with the d reached by then. A true
neighbour is thus missed with probability 1 - ``SURE`` at most, whatever the data.

Equal vectors are one point of the tree, which keeps the k + 1 smallest identifiers - no
more of them can be among k nearest - and equal queries are searched once, so a vector that
a third of all rows share loads no task. Blocks with many queries are split into
parts of ``PART`` queries.

Defined results: vectors that are null, all zero, or hold null or non-finite components take
no part; shorter ones count as padded with zeros. A null identifier takes no part. With fewer
candidates than k, all are returned. Rows that repeat an identifier with equal vectors count
once. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from jouleframe.llm.common import keep

PROJECTED = 8        # even, for the closed form of the chi-square tail
SURE = 0.96
SAMPLE = 16_384      # vectors that the upper kd-tree is fitted on
BLOCK_ROWS = 4_096   # rows a block should hold
MOST_BLOCKS = 2_048  # bound of the driver's tables; beyond it blocks hold more rows
LEAF_ROWS = 256
PART = 2_048         # queries a task handles with one block
CHUNK = 256          # points verified between two stopping tests
SEED = 5


def chi_square(probability: float, degrees: int = PROJECTED) -> float:
    """The quantile for an even number of degrees, by bisection on the Poisson sum of its tail."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > 1 - probability else (lo, mid)
    return hi


def directions(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, PROJECTED))


def split_tree(points: np.ndarray, depth: int) -> tuple[list[int], list[float]]:
    """Axis and value of each node of a complete kd-tree, root first, children of i at 2i+1 and 2i+2."""
    axes, values = [0] * (2 ** depth - 1), [0.0] * (2 ** depth - 1)
    held = {0: points}
    for node in range(2 ** depth - 1):
        p = held.pop(node, points[:0])
        if len(p):
            axis = int(p.max(axis=0).__sub__(p.min(axis=0)).argmax())
            axes[node], values[node] = axis, float(np.median(p[:, axis]))
            left = p[:, axis] <= values[node]
            held[2 * node + 1], held[2 * node + 2] = p[left], p[~left]
    return axes, values


def block_of(points: np.ndarray, axes: list[int], values: list[float]) -> np.ndarray:
    a, v = np.array(axes, np.int64), np.array(values)
    node = np.zeros(len(points), np.int64)
    rows = np.arange(len(points))
    for _ in range((len(axes) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[rows, a[node]] > v[node])
    return node - len(axes)


class Block:
    """The rows of one block with the lower part of the kd-tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, extra: np.ndarray):
        order, self.bounds = self._leaves(points)
        self.ids, self.vectors, self.points, self.extra = ids[order], vectors[order], points[order], extra[order]
        self.low = np.array([self.points[a:b].min(axis=0) for a, b in self.bounds])
        self.high = np.array([self.points[a:b].max(axis=0) for a, b in self.bounds])

    @staticmethod
    def _leaves(points: np.ndarray):
        done, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            p = points[rows]
            axis = int((p.max(axis=0) - p.min(axis=0)).argmax())
            if len(rows) <= LEAF_ROWS:
                done.append(rows)
                continue
            half = np.argpartition(p[:, axis], len(rows) // 2)
            todo += [rows[half[:len(rows) // 2]], rows[half[len(rows) // 2:]]]
        ends = np.cumsum([len(r) for r in done]).tolist()
        return np.concatenate(done), list(zip([0, *ends[:-1]], ends))

    def search(self, query: np.ndarray, point: np.ndarray, base: float, known: float, k: int, quantile: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) found; ``base - 2 * score`` is a squared distance, ``known`` a bound of the k-th."""
        gap = np.maximum(0.0, np.maximum(self.low - point, point - self.high))
        nearest = (gap ** 2).sum(axis=1)
        leaves = np.flatnonzero(nearest <= known * quantile)
        if not len(leaves):
            return np.empty(0), np.empty(0, np.int64)
        rows = np.concatenate([np.arange(*self.bounds[i]) for i in leaves])
        far = ((self.points[rows] - point) ** 2).sum(axis=1)
        near = far <= known * quantile
        rows, far = rows[near], far[near]
        order = np.argsort(far, kind="stable")
        rows, far = rows[order], far[order]
        scores, ids, limit, at = np.empty(0), np.empty(0, np.int64), known, 0
        while at < len(rows) and far[at] <= limit * quantile:
            some = rows[at:at + CHUNK]
            at += CHUNK
            rough = self.vectors[some] @ query
            if len(scores) >= k:
                some = some[rough >= scores[k - 1] - 1e-9 * (1 + abs(scores[k - 1]))]
            # Row sums in a fixed order: equal vectors get equal scores.
            scores = np.concatenate([scores, (self.vectors[some] * query).sum(axis=1)])
            ids = np.concatenate([ids, self.ids[some]])
            best = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[best], ids[best]
            if len(scores) >= k:
                limit = min(limit, max(0.0, base - 2 * float(scores[k - 1])))
        return scores, ids


def valid(vector: Column) -> Column:
    """No null or non-finite component and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _wide(series: pd.Series, size: int) -> np.ndarray:
    if all(len(x) == size for x in series):
        return np.array(series.tolist(), float).reshape(len(series), size)
    return np.array([[*x, *[0.0] * (size - len(x))] for x in series], float).reshape(len(series), size)


def nearest(table: DataFrame, every: int = 20, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    spark = table.sparkSession
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(ArrayType(DoubleType())).alias("v")).where(
        F.col("id").isNotNull() & valid(F.col("v")))
    rows = keep(rows.distinct(), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, size, norm = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    quantile, spread = chi_square(sure), directions(size + 1)

    def project(v: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(0.0, norm - (v ** 2).sum(axis=1)))
        return v @ spread[:-1] + extra[:, None] * spread[-1], extra

    # The upper tree from a bounded sample; every row gets a block.
    depth = min(int(math.log2(MOST_BLOCKS)), max(0, math.ceil(math.log2(max(1, n / BLOCK_ROWS)))))
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).toPandas()
    axes, values = split_tree(project(_wide(sample["v"], size), False)[0], depth)

    @F.pandas_udf("block int, p array<double>")
    def placed(v: pd.Series) -> pd.DataFrame:
        p, _ = project(_wide(v, size), False)
        return pd.DataFrame({"block": block_of(p, axes, values).astype("int32"), "p": list(p)})

    w = Window.partitionBy("v").orderBy("id")
    points = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1).select("id", "v", placed("v").alias("x"))
    points = keep(points.select("id", "v", "x.block", "x.p"), "points")
    # One row a block.
    boxes = points.groupBy("block").agg(F.array(*[F.min(F.col("p")[i]) for i in range(PROJECTED)]).alias("low"),
                                        F.array(*[F.max(F.col("p")[i]) for i in range(PROJECTED)]).alias("high")).orderBy("block").collect()
    blocks, low, high = np.array([b["block"] for b in boxes], np.int32), np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes])

    queries = rows.where(F.col("id") % every == 0)
    asked = keep(queries.groupBy("v").agg(F.min("id").alias("q")), "asked")  # equal queries once

    @F.pandas_udf(ArrayType(IntegerType()))
    def home(v: pd.Series) -> pd.Series:
        p, _ = project(_wide(v, size), True)
        gap = [np.maximum(0.0, np.maximum(low - x, x - high)) for x in p]
        return pd.Series([[int(blocks[((g ** 2).sum(axis=1)).argmin()])] for g in gap])

    @F.pandas_udf(ArrayType(IntegerType()))
    def others(v: pd.Series, first: pd.Series, bound: pd.Series) -> pd.Series:
        p, _ = project(_wide(v, size), True)
        out = []
        for x, f, d in zip(p, first, bound):
            gap = (np.maximum(0.0, np.maximum(low - x, x - high)) ** 2).sum(axis=1)
            out.append([int(b) for b in blocks[gap <= d * quantile] if b != f])
        return pd.Series(out)

    def search(tasks: DataFrame) -> DataFrame:
        """``tasks``: q, v, block, bound. Up to k + 1 neighbours of each query in each block."""
        # Parts of bounded size; a block's rows go once to each of its parts.
        parts = tasks.groupBy("block").agg(F.count("*").alias("_t")).select("block", F.ceil(F.col("_t") / PART).cast("int").alias("_parts"))
        dealt = tasks.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("q"), F.col("_parts")).cast("int"))
        copies = points.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

        def run(key, held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            out = {"q": [], "id": [], "score": []}
            if len(held) and len(asks):
                v = _wide(held["v"], size)
                p, extra = project(v, False)
                block = Block(held["id"].to_numpy(), v, p, extra)
                qs = _wide(asks["v"], size)
                ps, _ = project(qs, True)
                for q, x, point, bound in zip(asks["q"], qs, ps, asks["bound"]):
                    scores, ids = block.search(x, point, float(norm + (x ** 2).sum()), float(bound), k + 1, quantile)
                    out["q"] += [q] * len(ids)
                    out["id"] += ids.tolist()
                    out["score"] += scores.tolist()
            return pd.DataFrame(out).astype({"q": "int64", "id": "int64", "score": "float64"})

        return copies.select("block", "part", "id", "v").groupBy("block", "part").cogroup(
            dealt.select("block", "part", "q", "v", "bound").groupBy("block", "part")).applyInPandas(run, "q long, id long, score double")

    first = asked.select("q", "v", home("v")[0].alias("block"), F.lit(float("inf")).alias("bound"))
    near = keep(search(first), "near")
    reached = near.groupBy("q").agg(F.count("*").alias("_n"), F.min("score").alias("_worst"))
    distance = norm + F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) - 2 * F.col("_worst")
    bound = F.when(F.col("_n") > k, F.greatest(F.lit(0.0), distance)).otherwise(F.lit(float("inf")))
    second = first.drop("bound").join(reached, "q", "left").withColumn("bound", bound)
    second = second.withColumn("block", F.explode(others("v", "block", "bound"))).select("q", "v", "block", "bound")
    found = near.unionByName(search(second))

    top = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    lists = found.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1).groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("_r", "id", "score"))).alias("near"))
    answered = queries.select(F.col("id").alias("query_id"), "v").join(asked.join(lists, "q").select("v", "near"), "v")
    own = answered.select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
