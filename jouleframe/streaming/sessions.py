"""Sessions of a stream put together from slices, with state that does not grow while a device stays on."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from jouleframe.streaming.slices import MEDIANS, slice_columns, summary


Counts = tuple[np.ndarray, np.ndarray]  # distinct values, and how often each came


class Sessions(StatefulProcessor):
    """Per key: one row of combined numbers of the open session, and a count per distinct value for its medians.

    Slices arrive in order, as the watermark passes them; within a batch they are put in
    order here. A session is over when the next slice starts ``gap`` or more after its last
    sample, or when the watermark is past that by a slice, since an unfinished slice might
    still hold a sample before.
    """

    def __init__(self, columns: list[str], key_names: list[str], gap: int, slice_: int):
        self.combine = slice_columns(columns)
        self.counters = "counter_mj" in columns
        self.keys, self.gap, self.slice = key_names, gap, slice_
        self.medians = [c for c in MEDIANS if c in columns]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "session string")
        self.counts = {c: handle.getMapState(f"values_{c}", "value double", "n long") for c in self.medians}

    def _begun(self, r) -> dict:
        s = {c: r[c] for c in self.combine} | {k: r[k] for k in ("first_t", "last_t", "last_p")}
        if self.counters:
            s |= {k: r[k] for k in ("counter_first", "counter_first_t", "counter_last", "counter_last_t")}
        return s

    def _grown(self, s: dict, r) -> dict:
        if s["last_p"] is not None and r["first_p"] is not None:
            s["energy_integrated_j"] += 0.5 * (s["last_p"] + r["first_p"]) * ((r["first_t"] - s["last_t"]) / 1e6)
        for c, how in self.combine.items():
            if r[c] is not None:
                s[c] = r[c] if s[c] is None else s[c] + r[c] if how == "sum" else max(s[c], r[c])
        if self.counters and r["counter_last_t"] is not None:
            if s["counter_first_t"] is None:
                s |= {"counter_first": r["counter_first"], "counter_first_t": r["counter_first_t"]}
            s |= {"counter_last": r["counter_last"], "counter_last_t": r["counter_last_t"]}
        return s | {"last_t": r["last_t"], "last_p": r["last_p"]}

    def _stored(self, c: str) -> Counts:
        pairs = [(v[0], n[0]) for v, n in self.counts[c].iterator()] if self.counts[c].exists() else []
        return np.array([v for v, _ in pairs], float), np.array([n for _, n in pairs], np.int64)

    def _add(self, new: dict[str, list[np.ndarray]]) -> None:
        for c, held in new.items():
            state = self.counts[c]
            for v, n in zip(*_counted(held)):
                v, n = float(v), int(n)
                state.updateValue((v,), ((state.getValue((v,))[0] if state.containsKey((v,)) else 0) + n,))

    def _closed(self, key, s: dict, new: dict[str, list[np.ndarray]]) -> dict:
        """The finished session: what was stored of it, and the values of this batch, which never enter the state."""
        out = dict(zip(self.keys, key)) | {k: s.get(k) for k in (*self.combine, "first_t", "last_t")}
        if self.counters:
            out |= {"counter_first": s["counter_first"], "counter_last": s["counter_last"]}
        for c in self.medians:
            out[MEDIANS[c]] = _median(_summed([self._stored(c), _counted(new[c])] if new else [self._stored(c)]))
            self.counts[c].clear()
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Of a batch only the numbers of each slice and its values as plain arrays are held, eight bytes a value.
        parts, values = [], {c: [] for c in self.medians}
        for part in rows:
            for c, held in values.items():
                held += [np.asarray(v, float) for v in part[f"{c}_values"]]
            parts.append(part.drop(columns=[f"{c}_values" for c in self.medians]))
        batch = pd.concat(parts, ignore_index=True).sort_values("slice_start")
        s = json.loads(self.open.get()[0]) if self.open.exists() else None
        new: dict[str, list[np.ndarray]] = {c: [] for c in self.medians}
        done, names = [], list(batch.columns)
        for at, *r in batch.itertuples(name=None):
            r = {k: None if v is None or v != v else v for k, v in zip(names, r)}
            if s is not None and r["first_t"] - s["last_t"] >= self.gap:
                done.append(self._closed(key, s, new))
                new = {c: [] for c in self.medians}
                s = None
            s = self._begun(r) if s is None else self._grown(s, r)
            for c, held in new.items():
                held.append(values[c][at])
                values[c][at] = None
        self._add(new)
        self.open.update((json.dumps(s, default=lambda x: x.item()),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(-(-(s["last_t"] + self.gap + self.slice) // 1000))
        yield pd.DataFrame(done, columns=self.names())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = [self._closed(key, json.loads(self.open.get()[0]), {})] if self.open.exists() else []
        self.open.clear()
        yield pd.DataFrame(done, columns=self.names())

    def close(self) -> None:
        pass

    def names(self) -> list[str]:
        extra = ["counter_first", "counter_last"] if self.counters else []
        return [*self.keys, *self.combine, "first_t", "last_t", *extra, *[MEDIANS[c] for c in self.medians]]


def _counted(arrays: list[np.ndarray]) -> Counts:
    """Distinct values in rising order and their counts."""
    return np.unique(np.concatenate(arrays), return_counts=True) if arrays else (np.empty(0), np.empty(0, np.int64))


def _summed(counts: list[Counts]) -> Counts:
    values, at = np.unique(np.concatenate([v for v, _ in counts]), return_inverse=True)
    total = np.zeros(len(values), np.int64)
    np.add.at(total, at, np.concatenate([n for _, n in counts]))
    return values, total


def _median(counts: Counts) -> float | None:
    """Median of values given with their counts in rising order."""
    values, n = counts
    upto = np.cumsum(n)
    if not len(upto):
        return None
    middle = np.searchsorted(upto, [(upto[-1] - 1) // 2, upto[-1] // 2], side="right")
    return float(values[middle].sum() / 2)


def sessions(slices: DataFrame, columns: list[str], keys: list[str], gap: int, slice_: int) -> DataFrame:
    """Finished sessions of a stream of slices; ``columns`` are those of the samples, lengths are in microseconds."""
    processor = Sessions(columns, keys, gap, slice_)
    kinds = dict(slices.dtypes)
    number = lambda c: "long" if c.endswith("_n") or c in ("n_samples", "first_t", "last_t") else "double"
    shape = ", ".join(f"{c} {kinds[c] if c in keys else number(c)}" for c in processor.names())
    out = slices.groupBy(*keys).transformWithStateInPandas(processor, shape, "append", "EventTime")
    medians = [MEDIANS[c] for c in processor.medians]
    return out.select(*keys, F.timestamp_micros("first_t").alias("window_start"), F.timestamp_micros(F.col("last_t") + gap).alias("window_end"), *summary(out.columns), *medians)
