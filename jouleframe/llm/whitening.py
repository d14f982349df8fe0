"""Whitening of embeddings by a bidiagonal qd solver (operator 12).

Vectors become integers, floor(256 * component); the fit takes each distinct vector once.

1. Exact integer sums over the fit list give the mean.
2. Blockwise QR: each task reduces its centred rows to one triangular factor, holding one
   batch and one factor at a time; factors are stacked and reduced again, ``FAN`` at a time,
   until one is left. No covariance is formed, so its condition number is not squared.
3. On the driver that one factor (dimensions squared) is brought to upper bidiagonal form by
   Householder reflections from both sides.
4. Its squared singular values come from the qd algorithm with shifts (dqds), which keeps the
   relative accuracy of each.
5. Each wanted singular vector comes from a twisted factorisation: a stationary transform from
   the top and a progressive one from the bottom, joined where the residual is least. Blocks
   that the bidiagonal form splits into are solved apart; vectors of values that are close
   together are made orthogonal to those before by further twisted solves.
6. Each row is projected on the directions, and a second pass over the fit list measures the
   covariance of the result.

Defined results: rows whose vector is null, or that hold a null or non-finite component, are left
out; a null identifier stays. Shorter vectors count as followed by zeros. Components beyond a
long are the nearest long, and so is a deviation. A direction without variance (its singular value
is rounding beside the largest) is no component, so equal vectors, a single row, or an empty
table give no rows. Repeated rows each get their rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from jouleframe.llm.common import keep
from jouleframe.llm.negatives import integers, matrix, sound

COMPONENTS = 4
FAN = 32  # factors stacked into one
EPS = np.finfo(float).eps
MOST = np.iinfo(np.int64).max


# Bidiagonal form of one small matrix.

def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """v, beta, alpha with (I - beta v v') x = alpha e1."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0 or not np.any(x[1:]):
        return np.zeros_like(x), 0.0, float(x[0])
    alpha = -math.copysign(norm, x[0])
    v = x.copy()
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B, and V with R'R = V B'B V'."""
    a, n = r.astype(float).copy(), r.shape[1]
    right = np.eye(n)
    for k in range(n):
        v, beta, alpha = reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        a[k, k], a[k + 1:, k] = alpha, 0.0
        if k + 1 < n:
            v, beta, alpha = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= beta * np.outer(a[k:, k + 1:] @ v, v)
            right[:, k + 1:] -= beta * np.outer(right[:, k + 1:] @ v, v)
            a[k, k + 1], a[k, k + 2:] = alpha, 0.0
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


# Squared singular values of a bidiagonal matrix.

def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One dqds transform of q, e shifted down; the least of its d, negative if the shift was too large."""
    d, least = q[0] - shift, q[0] - shift
    new_q, new_e = [], []
    for qi, ei in zip(q[1:], e):
        top = d + ei
        if top == 0.0:  # splits here
            new_q.append(0.0)
            new_e.append(0.0)
            d = qi - shift
        else:
            t = qi / top
            new_q.append(top)
            new_e.append(ei * t)
            d = d * t - shift
        if not d >= least:
            least = d
    new_q.append(d)
    return new_q, new_e, least


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All of the bidiagonal matrix with diagonal ``a`` and superdiagonal ``b``, falling."""
    out: list[float] = []
    todo = [(np.square(a, dtype=float).tolist(), np.square(b, dtype=float).tolist(), 0.0)]
    while todo:
        q, e, total = todo.pop()
        best = math.inf
        while q:
            n = len(q)
            if n == 1 or e[-1] <= EPS * EPS * (total + q[-1]):
                out.append(max(total + q[-1], 0.0))
                q, e = q[:-1], e[:-1]
                best = math.inf
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * (total + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], total))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if q[-1] > 1.5 * q[0]:  # the small ones belong at the end
                q, e = q[::-1], e[::-1]
            shift = 0.0 if best is math.inf else 0.98 * best
            if e[-1] < 0.01 * q[-1]:
                shift = max(shift, q[-1] - math.sqrt(q[-1] * e[-1]) - e[-1])
            for _ in range(4):
                new_q, new_e, least = _sweep(q, e, shift)
                if least >= 0.0:
                    break
                shift *= 0.25
            else:
                shift = 0.0
                new_q, new_e, least = _sweep(q, e, 0.0)
            total += shift
            q, e, best = new_q, new_e, least
    return np.sort(np.array(out))[::-1]


# Right singular vectors.

def twisted(a: np.ndarray, b: np.ndarray, value: float, right: np.ndarray | None = None) -> np.ndarray:
    """The vector at ``value`` of B'B by a twisted factorisation; with ``right``, the solution for that right side."""
    n = len(a)
    q, e, ab = a * a, b * b, a[:-1] * b
    tiny = EPS * EPS * max(value, 1e-300)
    s, down = np.empty(n), np.empty(n - 1)  # from the top
    s[0] = -value
    for i in range(n - 1):
        pivot = q[i] + s[i]
        pivot = pivot if abs(pivot) > tiny else -tiny
        down[i] = ab[i] / pivot
        s[i + 1] = e[i] * s[i] / pivot - value
    p, up = np.empty(n), np.empty(n - 1)  # from the bottom
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = e[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else -tiny
        up[i] = ab[i] / pivot
        p[i] = q[i] * p[i + 1] / pivot - value
    gamma = s + p + value
    r = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    if right is None:
        z[r] = 1.0
    else:
        # Eliminate towards the twist, divide, and substitute back from it.
        y = right.astype(float).copy()
        for i in range(r):
            y[i + 1] -= down[i] * y[i]
        for i in range(n - 2, r - 1, -1):
            y[i] -= up[i] * y[i + 1]
        for i in range(r):
            z[i] = y[i] / ((q[i] + s[i]) or -tiny)
        for i in range(r, n - 1):
            z[i + 1] = y[i + 1] / ((e[i] + p[i + 1]) or -tiny)
        z[r] = y[r] / (gamma[r] if abs(gamma[r]) > tiny else tiny)
    for i in range(r - 1, -1, -1):
        z[i] -= down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] -= up[i] * z[i]
    return z / np.linalg.norm(z)


def leading(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of ``r`` that are not rounding, at most ``count``, and their right vectors as columns."""
    n = r.shape[1]
    if not n or not np.any(r):
        return np.zeros(0), np.zeros((n, 0))
    scale = float(np.abs(r).max())
    a, b, v = bidiagonal(r / scale)
    largest = max(np.abs(a).max(), np.abs(b).max() if len(b) else 0.0)
    # Blocks between negligible superdiagonal entries are solved apart, so that equal values in two of them do no harm.
    ends = [i + 1 for i in range(n - 1) if abs(b[i]) <= EPS * largest] + [n]
    found = []
    start = 0
    for end in ends:
        values = squared_singular_values(a[start:end], b[start:end - 1])
        found += [(x, start, end) for x in values[:count].tolist()]
        start = end
    found = sorted(found, key=lambda x: -x[0])[:count]
    found = [x for x in found if math.sqrt(x[0]) > n * EPS * largest]
    out, rng = [], np.random.default_rng(0)
    for k, (value, start, end) in enumerate(found):
        block = slice(start, end)
        z = np.zeros(n)
        z[block] = twisted(a[block], b[start:end - 1], value)
        near = [out[j] for j in range(k) if found[j][1] == start and found[j][0] - value <= 1e-3 * value]
        for again in range(4 if near else 0):
            kept = z.copy()
            for w in near:
                kept -= (w @ kept) * w
            size = float(np.linalg.norm(kept))
            if size < 0.5:  # it was mostly one of those before
                kept[block] = rng.standard_normal(end - start)
                for w in near * 2:
                    kept -= (w @ kept) * w
                size = float(np.linalg.norm(kept))
            z = kept / size
            if again < 3:
                z[block] = twisted(a[block], b[start:end - 1], value, z[block])
        out.append(z)
    vectors = np.stack(out, axis=1) if out else np.zeros((n, 0))
    return np.array([x for x, _, _ in found]) * scale ** 2, v @ vectors


# Passes over the rows.

def _sums(fit: DataFrame) -> tuple[int, list[int], int]:
    """Number of vectors, exact sum per dimension, and the longest length."""
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(0, object)
        for batch in batches:
            d = max([len(total), *map(len, batch["x"])])
            total = np.concatenate([total, np.zeros(d - len(total), object)])
            x = matrix(batch["x"], d)
            safe = len(x) == 0 or int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) < MOST // (len(x) + 1)
            total = total + (x if safe else x.astype(object)).sum(0).astype(object)
            n += len(x)
        if n:
            yield pd.DataFrame({"n": [n] * (len(total) + 1), "at": range(-1, len(total)), "total": ["0", *map(str, total)]})

    rows = fit.select("x").mapInPandas(part, "n long, at int, total string").withColumn("total", F.col("total").cast("decimal(38,0)"))
    got = rows.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("at").collect()  # one row a dimension
    return (got[0]["n"], [int(r["total"]) for r in got[1:]], len(got) - 1) if got else (0, [], 0)


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x minus the mean, whose whole part is taken off first, exactly where numbers are not huge."""
    if len(x) and max(abs(int(x.max())), abs(int(x.min()))) < 1 << 52:
        return (x - whole).astype(float) - rest
    return (x.astype(object) - whole.astype(object)).astype(float) - rest


def factor(fit: DataFrame, d: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    def reduce(batches: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, d))
        for batch in batches:
            for i in range(0, len(batch), 4 * d):
                r = np.linalg.qr(np.concatenate([r, batch[i:i + 4 * d]]), mode="r")
        if len(r):
            yield pd.DataFrame({"r": [r.ravel()]})

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from reduce(_centred(matrix(b["x"], d), whole, rest) for b in batches)

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from reduce(np.concatenate(b["r"].to_list()).reshape(-1, d) for b in batches if len(b))

    parts = keep(fit.select("x").mapInPandas(first, "r array<double>"), "factors")
    left = parts.count()
    while left > 1:
        left = -(-left // FAN)
        parts = keep(parts.repartition(left).mapInPandas(further, "r array<double>"), "factors")
        left = parts.count() if left > 1 else 1
    rows = parts.collect()  # one factor
    r = np.concatenate([np.array(x["r"]).reshape(-1, d) for x in rows]) if rows else np.zeros((0, d))
    return np.concatenate([r, np.zeros((max(0, d - len(r)), d))])


def _measured(fit: DataFrame, project, k: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((k, k)), 0
        for b in batches:
            w = project(b["x"])[1]
            total, n = total + w.T @ w, n + len(w)
        if n:
            yield pd.DataFrame({"i": np.repeat(range(k), k), "j": np.tile(range(k), k), "s": total.ravel(), "n": n})

    got = fit.select("x").mapInPandas(part, "i int, j int, s double, n long").groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("c"))
    return float(got.select(F.max(F.abs(F.col("c") - (F.col("i") == F.col("j")).cast("double")))).first()[0])


def whiten(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """Each row's coordinates on the first directions of the distinct integer vectors, scaled to variance one."""
    vec_id: Column = F.col("vec_id").cast("long")
    all_rows = keep(rows.where(sound(F.col(vector))).select(vec_id.alias("vec_id"), integers(F.col(vector)).alias("x")), "vectors")
    fit = keep(all_rows.select("x").distinct(), "fit")
    n, sums, d = _sums(fit)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    r = factor(fit, d, whole, rest) if d else np.zeros((0, 0))
    values, directions = leading(r, components)
    k = len(values)
    spread = np.sqrt(values / n) if n else np.zeros(0)

    def project(x: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        x = matrix(x, d)
        return x, _centred(x, whole, rest) @ directions / spread

    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return rows.sparkSession.createDataFrame([], shape)
    error = _measured(fit, project, k)
    explained = values / np.square(r).sum()
    s = np.array(sums, object)

    def out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, w = project(b["x"])
            far = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums))
            if d * far ** 2 <= MOST:
                deviation = np.square(n * x - s.astype(np.int64)).sum(1)
            else:
                deviation = np.array([min(int(v), MOST) for v in np.square(n * x.astype(object) - s).sum(1)], np.int64)
            m = len(x)
            yield pd.DataFrame({
                "vec_id": pd.array([None if v is None else int(v) for v in b["vec_id"]], dtype="Int64").repeat(k), "component": np.tile(np.arange(1, k + 1, dtype="int32"), m), "n": n,
                "deviation": deviation.repeat(k), "whitened": w.ravel(), "explained": np.tile(explained, m), "identity_error": error})

    return all_rows.select(F.col("vec_id").cast("string").alias("vec_id"), "x").mapInPandas(out, shape)
