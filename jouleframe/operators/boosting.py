"""Boosted regression trees of many fits at once, grown round by round and level by level.

The trees, their early stopping and their losses are those of Spark ML's ``GBTRegressor`` with absolute loss and validation
rows (tested against it); that one reads all rows of a fit for every level of every tree, and each fit reads them by itself.
Here rows of one group and category with the same bins stand together as a cell, and cells in blocks:

* a round reads the rows' labels once for all fits, which leaves a sum of residuals per cell and fit, and the losses;
* a level reads the cells alone and adds their sums up per fit, node, feature and bin; each node's best split is found
  where its sums meet. What the driver gets is a split per open node.

A cell of many rows is spread over blocks and tasks. Labels are whole numbers of ``1 / LABEL`` (``label``), so that their sums
are exact: equal splits tie however the rows are dealt, and the first feature wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from jouleframe.runtime import forget, written

BINS = 32
FIRST_BIN = 48           # the character of bin 0: a row's bins are a string, a character each
TASK_ROWS = 1_000_000    # rows of the table of blocks that one task sorts
BLOCK_ROWS = 16_384      # rows of a block
BLOCK_CELLS = 4_096      # cells of a block once only their sums are left
VALIDATION_TOL = 0.01    # Spark ML's: a round that gains less, relative to the loss, is the last
EPSILON = 2.0 ** -52     # of the impurity of a node whose labels are equal
LABEL = 2.0 ** 20        # steps of a label in one: its logarithm is kept to a millionth
LOW = 22                 # bits of a squared label that are summed apart from the upper ones

BLOCKS = "g string, category string, x binary, sizes binary, labels binary, val binary"
STATE = "g string, category string, x binary, n binary, v binary, loss binary"
SUMS = "fit int, node int, sums binary"
SPLITS = "fit int, node int, feature int, threshold double, gain double, stats array<double>, present binary"


def label(x: Column) -> Column:
    """The logarithm of ``x`` as the fits learn it."""
    return F.rint(F.ln(x) * LABEL) / LABEL


@dataclass(frozen=True)
class Fit:
    """One head's model for a held-out group: of one category, or of all (``"all"``), with the validation rows of a seed."""
    seed: int  # place among the seeds
    group: str
    model: str
    head: int  # place among the heads

    def trains_on(self, g: str, category: str | None) -> bool:
        return g != self.group and self.model in ("all", category)

    def tests_on(self, g: str, category: str | None, special: set[tuple[str, str]]) -> bool:
        """Test rows of a generalist are those that no specialist of its group takes."""
        return g == self.group and (self.model == category if self.model != "all" else (g, category) not in special)


class Tree:
    """Nodes as arrays; a leaf is its own child."""

    def __init__(self, value: float):
        self.feature, self.threshold, self.left, self.right, self.value = [0], [np.inf], [0], [0], [value]

    def split(self, node: int, feature: int, threshold: float, values: tuple[float, float]) -> tuple[int, int]:
        pair = len(self.value), len(self.value) + 1
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, *pair
        for at, value in zip(pair, values):
            for of, v in ((self.feature, 0), (self.threshold, np.inf), (self.left, at), (self.right, at), (self.value, value)):
                of.append(v)
        return pair

    def nodes(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row of bins reaches."""
        feature, threshold, left, right = (np.array(a) for a in (self.feature, self.threshold, self.left, self.right))
        at, row = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(depth):
            at = np.where(x[row, feature[at]] <= threshold[at], left[at], right[at])
        return at


def boosted(trees: list[Tree], x: np.ndarray, depth: int, step: float) -> np.ndarray:
    """What the trees say about rows of bins: the first as it is, the others by ``step``."""
    out = np.zeros(len(x))
    for i, t in enumerate(trees):
        out += np.array(t.value)[t.nodes(x, depth)] * (step if i else 1.0)
    return out


def bins_of(column: pa.Array) -> np.ndarray:
    """Rows of bins from strings of one width."""
    column = column.cast(pa.string())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(len(column), -1) - FIRST_BIN


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([np.any(c[1:] != c[:-1], axis=1) if c.ndim > 1 else c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.fill_null(-1).to_numpy()


def blocks(rows: DataFrame, labels: list[str], seeds: int) -> DataFrame:
    """``rows`` (g, category, x, val and the labels) as written blocks of cells; ``val`` has a bit per seed."""
    flags = np.min_scalar_type((1 << seeds) - 1)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def block() -> pa.RecordBatch:
            x, y, val = (np.concatenate(part) for part in zip(*held))
            starts = _runs(x)
            sizes = np.diff(np.append(starts, len(x))).astype(np.int32)
            steps = np.ascontiguousarray(np.rint(y.T * LABEL).astype(np.int32))
            cells = [x[starts].tobytes(), sizes.tobytes(), steps.tobytes(), val.astype(flags).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([k], pa.string()) for k in key] + [pa.array([c], pa.binary()) for c in cells],
                                              ["g", "category", "x", "sizes", "labels", "val"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x, val = bins_of(batch.column("x")), batch.column("val").to_numpy()
            y = np.stack([batch.column(h).to_numpy() for h in labels], axis=1)
            starts = _runs(_codes(batch.column("g")), _codes(batch.column("category")))
            for a, b in zip(starts, np.append(starts[1:], len(x))):
                own = batch.column("g")[a].as_py(), batch.column("category")[a].as_py()
                if held and (own != key or sum(len(h[0]) for h in held) >= BLOCK_ROWS):
                    yield block()
                    held = []
                key = own
                held.append((x[a:b], y[a:b], val[a:b]))
        if held:
            yield block()

    # Equal bins come to one task, unless they are many: then their labels' hash deals them over several.
    salted = rows.select("g", "category", "x", "val", *labels, F.xxhash64(*labels).alias("_salt"))
    placed = salted.repartitionByRange(tasks, "g", "category", "x", "_salt").sortWithinPartitions("g", "category", "x")
    return written(placed.mapInArrow(cut, BLOCKS))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _parts(steps: np.ndarray) -> np.ndarray:
    """Labels in steps, and their squares in an upper and a lower part: whole numbers, whose sums are exact."""
    square = steps.astype(np.int64) ** 2
    return np.stack([steps, square >> LOW, square & ((1 << LOW) - 1)]).astype(float)


def _moments(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum and sum of squares from summed counts and parts, or from counts and residuals, which are 1 or -1."""
    if len(sums) == 2:
        return sums[0], sums[1], sums[0]
    n, steps, upper, lower = sums
    return n, steps / LABEL, (upper * 2.0 ** LOW + lower) / LABEL ** 2


@dataclass
class Boosted:
    """Trees and losses (training, validation, test, one per tree) of every fit."""
    trees: dict[Fit, list[Tree]] = field(default_factory=dict)
    losses: dict[Fit, list[list[float]]] = field(default_factory=dict)


def _impurity(n, s, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (q - (s * s) / n) / n)


def best_split(sums: np.ndarray, present: np.ndarray) -> tuple[int, float, float, list[float]]:
    """(feature, threshold, gain, moments of the node and its sides); the first of the best, by Spark ML's formula.

    ``present``: the bins that the fit's training rows have; a threshold lies midway between neighbours of them.
    """
    upto = np.cumsum(sums, axis=2)
    all_of = upto[:, :1, -1:]
    left, right, whole = _moments(upto), _moments(all_of - upto), _moments(all_of)
    n = whole[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _impurity(*whole) - left[0] / n * _impurity(*left) - right[0] / n * _impurity(*right)
    later = np.flip(np.maximum.accumulate(np.flip(present, 1), 1), 1)
    last = np.ones_like(present)
    last[:, :-1] = ~later[:, 1:]
    gain = np.where(present & ~last & (left[0] >= 1) & (right[0] >= 1) & (gain >= 0), gain, -np.inf)
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    after = np.flatnonzero(present[f, b + 1:])
    stats = [float(m[0, 0]) for m in whole] + [float(m[f, b]) for side in (left, right) for m in side]
    return int(f), (2 * b + 1 + after[0]) / 2.0 if len(after) else 0.0, float(gain[f, b]), stats


class Grower:
    """Fits over one table of blocks."""

    def __init__(self, table: DataFrame, fits: list[Fit], special: set[tuple[str, str]], seeds: int, width: int,
                 max_iter: int, depth: int, step: float):
        self.table, self.fits, self.special, self.seeds, self.width = table, fits, special, seeds, max(width, 1)
        self.max_iter, self.depth, self.step = max_iter, depth, step
        self.heads = max(f.head for f in fits) + 1
        self.present: dict[int, np.ndarray] = {}

    def run(self) -> Boosted:
        out = Boosted({f: [] for f in self.fits}, {f: [[], [], []] for f in self.fits})
        active, best = list(self.fits), {}
        state = written(self._labels([]))
        for m in range(1, self.max_iter + 1):
            for f, tree in zip(active, self._trees(state, active, first=m == 1)):
                out.trees[f].append(tree)
            forget(state)
            state = written(self._labels(active, out.trees, sums=m < self.max_iter))
            losses = self._losses(state, active)
            going = []
            for f, (loss, n) in zip(active, losses):
                now = loss / np.maximum(n, 1)
                # Without validation rows there is nothing to stop by.
                if m > 1 and n[1] and best[f] - now[1] < VALIDATION_TOL * max(now[1], 0.01):
                    out.trees[f].pop()
                    continue
                best[f] = now[1]
                for side, value in zip(out.losses[f], now):
                    side.append(float(value))
                going.append(f)
            if not going:
                break
            # The state keeps a place for each fit of this round; those that have ended are not read again.
            self.stored, active = active, going
        forget(state)
        forget(self.table)
        return out

    # --- a round: labels ------------------------------------------------------------------

    def _labels(self, active: list[Fit], trees: dict[Fit, list[Tree]] | None = None, sums: bool = True) -> DataFrame:
        """Per cell the training rows of each seed, and the sums of the parts of the labels or, from the second round on, of the
        residuals (signs) of each fit; and per task the absolute errors and rows of each fit's sides."""
        self.stored = active
        seeds, heads, width, depth, step, special = self.seeds, self.heads, self.width, self.depth, self.step, self.special
        grown = [trees[f] for f in active] if trees else []
        flags = np.min_scalar_type((1 << seeds) - 1)

        def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, cells = None, [], 0
            loss = np.zeros((len(active), 2, 3))

            def row(g=None, category=None, x=None, n=None, v=None, loss=None) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([g], pa.string()), pa.array([category], pa.string())] +
                                                  [pa.array([c if c is None else c.tobytes()], pa.binary()) for c in (x, n, v, loss)],
                                                  ["g", "category", "x", "n", "v", "loss"])

            def gathered() -> pa.RecordBatch:
                x, n, v = zip(*held)
                return row(*key, np.concatenate(x), np.concatenate(n, axis=1), np.concatenate(v, axis=1))

            for b in _opened(batches):
                x, sizes = np.frombuffer(b["x"], np.uint8).reshape(-1, width), np.frombuffer(b["sizes"], np.int32)
                starts = np.append(0, np.cumsum(sizes)[:-1])
                labels, val = np.frombuffer(b["labels"], np.int32).reshape(heads, -1), np.frombuffer(b["val"], flags)
                train = [((val >> flags.type(s)) & flags.type(1) == 0).astype(float) for s in range(seeds)]
                n = np.stack([np.add.reduceat(t, starts) for t in train])
                if not active:
                    parts = [_parts(y) for y in labels]
                    v = [np.add.reduceat(p * t, starts) for t in train for q in parts for p in q]
                else:
                    v, labels = [], labels / LABEL
                    for i, f in enumerate(active):
                        trains = f.trains_on(b["g"], b["category"])
                        if not trains and not f.tests_on(b["g"], b["category"], special):
                            continue
                        off = labels[f.head] - np.repeat(boosted(grown[i], x, depth, step), sizes)
                        error, t = np.abs(off), train[f.seed]
                        if trains:
                            whole, mine = error.sum(), error @ t
                            rest = error @ (1.0 - t)
                            loss[i] += [[mine, rest, 0.0], [t.sum(), len(t) - t.sum(), 0.0]]
                            if sums:
                                v.append(n[f.seed] - 2.0 * np.add.reduceat((off < 0) * t, starts))
                        else:
                            loss[i] += [[0.0, 0.0, error.sum()], [0.0, 0.0, len(t)]]
                if not v:
                    continue
                own = b["g"], b["category"]
                if held and (own != key or cells >= BLOCK_CELLS):
                    yield gathered()
                    held, cells = [], 0
                key = own
                held.append((x, n, np.stack(v)))
                cells += len(x)
            if held:
                yield gathered()
            yield row(loss=loss)

        return self.table.mapInArrow(states, STATE)

    def _losses(self, state: DataFrame, active: list[Fit]) -> np.ndarray:
        rows = state.filter("loss IS NOT NULL").select("loss").collect()  # a row per task, six numbers per fit
        return sum(np.frombuffer(r["loss"]).reshape(len(active), 2, 3) for r in rows)

    # --- a tree, level by level -----------------------------------------------------------

    def _trees(self, state: DataFrame, active: list[Fit], first: bool) -> list[Tree]:
        trees: dict[Fit, Tree] = {f: Tree(0.0) for f in active}
        opened = {f: [0] for f in active}
        for level in range(max(self.depth, 1)):
            found = self._splits(state, active, trees, opened, first, level)
            opened = {f: [] for f in active}
            for r in found:
                f, tree = active[r["fit"]], trees[active[r["fit"]]]
                if level == 0:
                    tree.value[0] = r["stats"][1] / r["stats"][0]
                    if first:
                        self.present[self.fits.index(f)] = np.frombuffer(r["present"], bool).reshape(self.width, BINS)
                if not r["gain"] > 0 or level == self.depth:
                    continue
                sides = r["stats"][3:6], r["stats"][6:9]
                pair = tree.split(r["node"], r["feature"], r["threshold"], tuple(s / n for n, s, _ in sides))
                if level + 1 < self.depth:
                    opened[f] += [at for at, side in zip(pair, sides) if abs(float(_impurity(*side))) >= EPSILON]
            if not any(opened.values()):
                break
        return [trees[f] for f in active]

    def _splits(self, state: DataFrame, active: list[Fit], trees: dict[Fit, Tree], opened: dict[Fit, list[int]], first: bool, level: int) -> list:
        """The best split of every open node."""
        stored, seeds, heads, width = self.stored, self.seeds, self.heads, self.width
        per_bin = width * BINS
        jobs = [(i, f, trees[f], opened[f]) for i, f in enumerate(active) if opened[f]]
        present = {i: self.present.get(self.fits.index(f)) for i, f, _, _ in jobs}

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in _opened(batches):
                x = np.frombuffer(b["x"], np.uint8).reshape(-1, width)
                n = np.frombuffer(b["n"]).reshape(seeds, len(x))
                v = np.frombuffer(b["v"]).reshape(-1, len(x))
                place = x + BINS * np.arange(width)
                mine = {f: j for j, f in enumerate(f for f in stored if f.trains_on(b["g"], b["category"]))}
                for i, f, tree, nodes in jobs:
                    if not f.trains_on(b["g"], b["category"]):
                        continue
                    values = [n[f.seed], *(v.reshape(seeds, heads, 3, -1)[f.seed, f.head] if first else [v[mine[f]]])]
                    slot = np.full(len(tree.value), -1)
                    slot[nodes] = np.arange(len(nodes))
                    at = slot[tree.nodes(x, level)]
                    keep = np.flatnonzero((at >= 0) & (values[0] > 0))
                    if not len(keep):
                        continue
                    where = (place[keep] + (at[keep] * per_bin)[:, None]).ravel()
                    own = sums.setdefault(i, np.zeros((len(values), len(nodes) * per_bin)))
                    for k, value in enumerate(values):
                        own[k] += np.bincount(where, np.repeat(value[keep], width), len(nodes) * per_bin)
            for i, f, tree, nodes in jobs:
                if i in sums:
                    each = sums[i].reshape(-1, len(nodes), per_bin).transpose(1, 0, 2)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()),
                                                      pa.array([e.tobytes() for e in each], pa.binary())], ["fit", "node", "sums"])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: dict[tuple[int, int], np.ndarray] = {}
            for r in _opened(batches):
                part = np.frombuffer(r["sums"]).reshape(-1, width, BINS)
                met[r["fit"], r["node"]] = met[r["fit"], r["node"]] + part if (r["fit"], r["node"]) in met else part
            for (i, node), sums in met.items():
                bins = sums[0] > 0 if present[i] is None else present[i]
                feature, threshold, gain, stats = best_split(sums, bins)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([node], pa.int32()), pa.array([feature], pa.int32()), pa.array([threshold]), pa.array([gain]),
                     pa.array([stats], pa.list_(pa.float64())), pa.array([bins.tobytes() if present[i] is None else None], pa.binary())],
                    ["fit", "node", "feature", "threshold", "gain", "stats", "present"])

        cells = state.filter("x IS NOT NULL").select("g", "category", "x", "n", "v")
        return cells.mapInArrow(add_up, SUMS).repartition("fit", "node").mapInArrow(choose, SPLITS).collect()  # a row per open node
