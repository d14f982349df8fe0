"""Hard negatives from integer inner products by Kronecker-packed multiplication (operator 13).

Vectors become integers, floor(256 * component). Anchors are a stated query set; they meet all
rows in blocks: rows are dealt evenly over blocks of about ``BLOCK`` rows, anchors over blocks
of about ``ANCHORS``, and each pair of blocks is one cogrouped task of bounded size, whatever
labels, identifiers or vectors repeat. Inside a pair of blocks scores come from packed products:

1. components of both sides are shifted to start at zero, so that no field ever borrows;
2. several rows lie in separated fields of one wide integer per component, fields wide enough
   for the largest possible sum of products;
3. each anchor component multiplies the wide integer once, sums stay inside their fields, and
   unpacking and taking back the shifts gives every exact score.

Wide integers of up to 53 bits ride in doubles, which multiply and add them exactly; longer
ones (from large components) are Python integers of any width.

There are two passes: the best rows of an anchor's own label are its positives; then, for each
positive, the best rows of other labels inside the band of its score. Each block keeps its own
best few, which a window ranks over all blocks (Spark keeps the first few on the map side).

Defined results: rows whose label or vector is null, or that hold a null or non-finite component,
take no part. Ties in score go to the smaller identifier; rows that repeat an identifier count
one by one, in a fixed order. A row without an identifier is no anchor; as a positive or
negative it comes after its ties, with a null identifier. Shorter vectors count as followed by
zeros. Components and scores beyond a long are the nearest long. Fewer candidates give fewer rows; an empty
table, or one without anchors, gives none. Other columns are not looked at.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from jouleframe.llm.common import keep

BLOCK = 4096
ANCHORS = 512
PACKED = 16  # rows in one wide integer of Python's
MOST = np.iinfo(np.int64).max


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 256).cast("long"))


def sound(vector: Column) -> Column:
    """Neither the vector nor a component is null, and all are finite."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, anchors by rows; int64, or Python integers where those do not suffice."""
    m, d = anchors.shape
    n = len(rows)
    if not m or not n or not d:
        return np.zeros((m, n), np.int64)
    low_a, low_r = int(anchors.min()), int(rows.min())
    most_a, most_r = int(anchors.max()) - low_a, int(rows.max()) - low_r
    bits = max(1, (d * most_a * most_r).bit_length())
    fields = 53 // bits
    kind = np.float64 if fields else object
    fields = fields or PACKED
    if kind is object:
        a, r = anchors.astype(object) - low_a, rows.astype(object) - low_r
    else:
        a, r = (anchors - low_a), (rows - low_r)
    padded = np.zeros((-(-n // fields), fields, d), r.dtype)
    padded.reshape(-1, d)[:n] = r
    wide = sum(padded[:, k] * (1 << k * bits) for k in range(fields))
    sums = a.astype(kind) @ wide.astype(kind).T
    sums = sums if kind is object else sums.astype(np.int64)
    mask = (1 << bits) - 1
    apart = np.stack([(sums >> k * bits) & mask for k in range(fields)], axis=2).reshape(m, -1)[:, :n]
    wider = object if kind is object else np.int64
    # sum (a + low_a)(r + low_r), from sum a * r and the sums of either side.
    return apart + low_r * a.astype(wider).sum(1)[:, None] + (low_a * r.astype(wider).sum(1) + d * low_a * low_r)[None, :]


def matrix(vectors: pd.Series, d: int) -> np.ndarray:
    """One vector a row, shorter ones followed by zeros."""
    if d and len(vectors) and vectors.map(len).eq(d).all():
        return np.concatenate(vectors.to_list()).reshape(-1, d)
    out = np.zeros((len(vectors), d), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _sides(anchors: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """Both sides, rows ordered as ties are, and their scores."""
    rows = rows.sort_values(["vec_id", "row"], ignore_index=True)
    codes, _ = pd.factorize(pd.concat([anchors["label"], rows["label"]], ignore_index=True))
    anchors, rows = anchors.assign(label=codes[:len(anchors)]), rows.assign(label=codes[len(anchors):])
    d = max([0, *map(len, anchors["x"]), *map(len, rows["x"])])
    return anchors, rows, products(matrix(anchors["x"], d), matrix(rows["x"], d))


def _clipped(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, -MOST - 1, MOST).astype(np.int64)


def _positives(count: int):
    names = ["anchor", "anchor_id", "positive", "positive_id", "positive_score"]

    def best(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        anchors, rows, scores = _sides(anchors, rows)
        label, row, ids = rows["label"].to_numpy(), rows["row"].to_numpy(), rows["vec_id"].to_numpy()
        out = []
        for i, (a, a_id, of) in enumerate(zip(anchors["row"], anchors["vec_id"], anchors["label"])):
            own = np.flatnonzero((label == of) & (row != a))
            first = own[np.argsort(-scores[i, own], kind="stable")[:count]]
            out += [(a, a_id, row[j], ids[j], s) for j, s in zip(first, _clipped(scores[i, first]))]
        return pd.DataFrame(out, columns=names).astype("int64")

    return best, "anchor long, anchor_id long, positive long, positive_id long, positive_score long"


def _negatives(count: int, low: int, high: int):
    names = ["anchor", "positive", "vec_id", "row", "score"]

    def best(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        anchors, rows, scores = _sides(anchors, rows)
        label, row, ids = rows["label"].to_numpy(), rows["row"].to_numpy(), rows["vec_id"].to_numpy()
        out = []
        for i, (a, of, positives, floors) in enumerate(zip(anchors["row"], anchors["label"], anchors["positives"], anchors["positive_scores"])):
            other = np.flatnonzero(label != of)
            order = other[np.argsort(-scores[i, other], kind="stable")]
            falling = [int(s) for s in scores[i, order]] if scores.dtype == object else scores[i, order]
            for p, s in zip(positives, floors):
                # 100 * score from low * s to high * s: whole scores from a ceiling to a floor.
                least, most = -(-low * int(s) // 100), high * int(s) // 100
                if least > most:
                    continue
                start, end = _between(falling, least, most)
                at = order[start:min(end, start + count)]
                out += [(a, p, ids[j], row[j], x) for j, x in zip(at, _clipped(scores[i, at]))]
        return pd.DataFrame(out, columns=names).astype("int64")

    return best, "anchor long, positive long, vec_id long, row long, score long"


def _between(falling, least: int, most: int) -> tuple[int, int]:
    """The stretch of falling scores that lie from ``least`` to ``most``."""
    negated = lambda x: -int(x)
    return bisect.bisect_left(falling, -most, key=negated), bisect.bisect_right(falling, -least, key=negated)


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, sides: int, rest: list[str]):
    """Anchors sent to every block of rows and rows to every block of anchors: one group per pair."""
    keys = ["_block", "_side"]
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, min(blocks * sides, 20_000))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    deal = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n))
    a = anchors.select("row", "vec_id", "label", "x", *rest, every(blocks).alias("_block"), deal(sides, 1).alias("_side"))
    r = rows.select("row", "vec_id", "label", "x", deal(blocks, 2).alias("_block"), every(sides).alias("_side"))
    return a.repartition(tasks, *keys).groupBy(*keys).cogroup(r.repartition(tasks, *keys).groupBy(*keys))


def _first(df: DataFrame, keys: list[str], order: list[Column], count: int, rank: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= count)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         label: str = "label", vector: str = "embedding") -> DataFrame:
    """For each row that ``anchor`` names and each of its positives, the hardest rows of other labels.

    ``low`` and ``high`` bound a negative's score, in hundredths of the positive's.
    """
    picked = rows.where(F.col(label).isNotNull() & sound(F.col(vector))).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(MOST)).alias("vec_id"),
        F.col(label).cast("string").alias("label"), integers(F.col(vector)).alias("x"),
        F.coalesce(anchor & F.col("vec_id").isNotNull(), F.lit(False)).alias("anchor"))
    all_rows = keep(picked, "vectors")
    chosen = keep(all_rows.where("anchor"), "anchors")
    n, m = (all_rows.select(F.count("*"), F.count_if("anchor")).first())
    blocks, sides = max(1, -(-n // BLOCK)), max(1, -(-m // ANCHORS))
    best, shape = _positives(positives)
    found = _met(chosen, all_rows, blocks, sides, []).applyInPandas(best, shape)
    order = [F.desc("positive_score"), F.col("positive_id"), F.col("positive")]
    kept = keep(_first(found, ["anchor"], order, positives, "positive_rank"), "positives")
    lists = kept.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("positive", "positive_score")).alias("_p"))
    lists = lists.select("row", F.col("_p.positive").alias("positives"), F.col("_p.positive_score").alias("positive_scores"))
    best, shape = _negatives(negatives, low, high)
    hard = _met(chosen.join(lists, "row"), all_rows, blocks, sides, ["positives", "positive_scores"]).applyInPandas(best, shape)
    hard = _first(hard, ["anchor", "positive"], [F.desc("score"), F.col("vec_id"), F.col("row")], negatives, "rank")
    named = lambda c: F.nullif(c, F.lit(MOST))
    return hard.join(kept, ["anchor", "positive"]).select(
        "anchor_id", named(F.col("positive_id")).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        named(F.col("vec_id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
