"""Near-duplicate documents by BagMinHash, banding and exact verification (operator 6).

A text is the multiset of its word 5-grams (fewer words: all of them as one gram), and two
texts are linked when their weighted Jaccard similarity - sum of the smaller counts over
sum of the larger ones - is at least ``THRESHOLD``. Classes are the connected components.

*Signatures.* A gram of weight w owns Poisson processes over [0, 1), [1, 2), [2, 4), ... up
to w, each of a rate equal to its width; every point of a process has a time, a level in its
interval and a register, all drawn from a hash of the gram. Points at levels beyond w do not
count, so the points of weight v < w are exactly those below v: this hierarchy makes the
smallest time per register an unbiased weighted-Jaccard sample. Points are made in order
of time and only while they can still lower the text's largest register.

*Links.* Texts that are equal word for word are one node. Registers are banded, and the
smallest node of a bucket is its head. Pairs are tested in three steps, each followed by
forming components and leaving out pairs that share a class by then: every node with the
smallest head it meets in any bucket, every node with the heads of its other buckets, and
then all pairs that share a bucket, the likely ones first. So a group of thousands of copies costs thousands of
tests, and every pair of a bucket is either in one class or has been tested. Before texts
are fetched, signatures of four bits a register are compared: pairs that agree on fewer than
``AGREE`` of 256 are left out, which at a similarity of ``THRESHOLD`` is more than four and a
half deviations away (3e-6). Nodes that still share a bucket with another class get signatures of
``FINE`` registers as well, which rule out pairs by the same margin far closer to the threshold:
only pairs from about 0.74 on are fetched, those expected to be links first, so that classes
have merged before the rest are made. A pair is made in the first bucket that it shares only.

A pair at 0.8 shares no bucket with probability (1 - 0.8^5)^26 = 3e-5. Nothing is collected;
hot buckets and classes only meet in aggregates with partial sums and in sort-merge joins
that Spark may split.

Defined results: texts without words (null, empty, only signs) are each a class of their own.
A class is named by its smallest ``doc_id`` and that row stays (of rows that share it, the
one with the first locator). Repeated rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from jouleframe.llm.common import LOCATOR, forget, keep, located, text_of

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 26, 5    # of the first registers
REGISTERS = 256
AGREE = 180            # of 256 four-bit registers; 208 are expected at 0.8, with a deviation of 6.2
FINE = 1024            # registers of nodes with open pairs
FINE_AGREE = 776       # 832 are expected at 0.8, with a deviation of 12.5
FINE_LIKELY = 832
BATCH_WORDS = 100_000  # words whose signatures are made at once
PART_ROWS = 100_000    # of nodes and links in a task
POINTS, AHEAD = 8_192, 64  # points of the grams that are left made at once, and of each of them
CACHED = 100_000

_PLAIN = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_G = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Lower-case runs of ASCII letters and digits and of characters beyond ASCII."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word grams and how often each occurs."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = mixed(total * _G + h[j:j + n])
    return np.unique(total, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Smallest times per register, one row per bag; infinite for an empty bag."""
    best = np.full(len(bags) * registers, np.inf)
    if not bags or not sum(len(h) for h, _ in bags):
        return best.reshape(-1, registers)
    h = np.concatenate([h for h, _ in bags])
    c = np.concatenate([c for _, c in bags]).astype(np.int64)
    d = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    # One process per gram and interval of its weight: [0, 1), [1, 2), [2, 4), ...
    parts, band, low, width = [], 0, 0, 1
    while True:
        here = np.flatnonzero(c > low)
        if not len(here):
            break
        parts.append((d[here], mixed(h[here] + np.uint64(band + 1) * _G), np.full(len(here), low), np.full(len(here), width), c[here]))
        band, low, width = band + 1, low + width, max(width, low + width)
        width = low
    d, seed, low, width, c = (np.concatenate(x) for x in zip(*parts))
    t, step, rows, worst = np.zeros(len(d)), 0, best.reshape(-1, registers), np.full(len(bags), np.inf)
    with np.errstate(over="ignore"):
        while len(d):
            # Of few grams many points at once: those that come too late lower no register.
            k = min(AHEAD, max(1, POINTS // len(d)))
            u = mixed(seed + np.arange(step + 1, step + k + 1, dtype=np.uint64)[:, None] * _G)
            v = mixed(u ^ _G)
            times = np.subtract.accumulate(np.vstack([t, np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / width]))[1:]
            at = d * registers + ((v >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            counts = np.broadcast_to(width == 1, at.shape)
            if not counts.all():
                level = low + ((mixed(v) >> np.uint64(11)).astype(float) * 2.0 ** -53 * width).astype(np.int64)
                counts = level < c
            np.minimum.at(best, at[counts], times[counts])
            # Only registers of bags that still have grams are looked at again.
            live = np.flatnonzero(np.bincount(d, minlength=len(bags)))
            worst[live] = rows[live].max(axis=1)
            t, step = times[-1], step + k
            on = t < worst[d]
            d, seed, low, width, c, t = d[on], seed[on], low[on], width[on], c[on], t[on]
    return rows


def band_keys(times: np.ndarray) -> np.ndarray:
    """One key per band: equal where all its registers are."""
    bits = np.ascontiguousarray(times[:, :BANDS * ROWS]).view(np.uint64).reshape(len(times), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(times), BANDS))
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            key = mixed(key * _G + bits[:, :, j])
    return key.view(np.int64)


def nibbles(times: np.ndarray) -> np.ndarray:
    """Four bits of each register, sixteen to a number."""
    four = mixed(np.ascontiguousarray(times).view(np.uint64)) & np.uint64(15)
    shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return np.bitwise_or.reduce(four.reshape(len(times), -1, 16) << shift, axis=2).view(np.int64)


def agreement(a: str, b: str, registers: int = REGISTERS) -> Column:
    """Registers whose four bits are equal."""
    def differing(i: int) -> Column:
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111)))

    return registers - sum((differing(i) for i in range(1, registers // 16)), differing(0))


SIGNED = f"{LOCATOR} string, doc_id long, node binary, n_words long, bands array<long>, signature array<long>"


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def made(rows):
        times = signatures([g for *_, g in rows])
        keys = band_keys(times)
        small = nibbles(times)
        return pd.DataFrame({
            LOCATOR: [r[0] for r in rows], "doc_id": pd.array([r[1] for r in rows], "Int64"), "node": [r[2] for r in rows], "n_words": [r[3] for r in rows],
            "bands": [keys[i] if r[3] else [] for i, r in enumerate(rows)], "signature": [small[i] if r[3] else [] for i, r in enumerate(rows)]})

    with np.errstate(over="ignore"):
        for batch in batches:
            rows, held = [], 0
            for place, doc_id, text in zip(batch[LOCATOR], batch["doc_id"], batch["text"]):
                words = words_of(text)
                rows.append((place, None if pd.isna(doc_id) else int(doc_id), hashlib.md5(b" ".join(words)).digest(), len(words), grams(words)))
                held += len(words)
                if held >= BATCH_WORDS or len(rows) >= 1000:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)


@lru_cache(maxsize=32)
def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return grams(words_of(text))


def similarity(a: str, b: str) -> float:
    (ha, ca), (hb, cb) = _bag(a), _bag(b)
    if not len(ha) or not len(hb):
        return 0.0
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    return both / (int(ca.sum()) + int(cb.sum()) - both)


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype=float)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows or fewer, in no more parts than these need: tables of a few thousand rows are not dealt over hundreds of tasks."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for all ends of ``edges`` (a, b), which are read more than once."""
    rows = 2 * edges.count()
    both = keep(_few(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), rows), "edges")
    roots = keep(_few(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), rows), "roots")
    while True:
        of = roots.select(F.col("node").alias("b"), F.col("root").alias("near"))
        met = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = roots.join(met, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # Jump: the root that the root has by now.
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = keep(_few(lower.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")), rows), "roots")
        done = new.where(F.col("old") != F.col("root")).isEmpty()
        forget(roots)
        roots = new.select("node", "root")
        if done:
            forget(both)
            return roots


def climbed(parents: DataFrame, rows: int) -> DataFrame:
    """node and root: where the steps from a node (to ``root``, a smaller node, or to itself) end; each round doubles the steps taken."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = keep(_few(parents.join(up, "root").select("node", F.col("root").alias("old"), F.col("far").alias("root")), rows), "labels")
        done = new.where(F.col("old") != F.col("root")).isEmpty()
        forget(parents)
        parents = new.select("node", "root")
        if done:
            return parents


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b and more) whose texts are similar enough."""
    a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    x = pairs.join(b, "b").join(a, "a").withColumn("similarity", _similarity("text_a", "text_b"))
    return x.where(F.col("similarity") >= THRESHOLD).select(*pairs.columns)


def _likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b and more) whose signatures do not rule them out."""
    a, b = (texts.select(F.col("node").alias(s), F.col("signature").alias(f"signature_{s}")) for s in "ab")
    return pairs.join(b, "b").join(a, "a").where(agreement("signature_a", "signature_b") >= AGREE).select(*pairs.columns)


def _with_first_head(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Each node (b) with the smallest head that it meets (a), a smaller node."""
    return _likely(members.groupBy(F.col("node").alias("b")).agg(F.min("head").alias("a")).where("a != b").select("a", "b"), texts)


def _with_heads(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Each node with the heads of its buckets that are of another class, and both classes."""
    met = members.where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    x = met.join(labels.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b")
    x = x.join(labels.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a").where("root_a != root_b").select("a", "b", "root_a", "root_b")
    return _likely(x, texts)


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their roots, of buckets that more than one class shares, and the class (main) that has most of a bucket."""
    placed = members.join(labels, "node")
    shares = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    open_ = shares.groupBy("key").agg(F.count("*").alias("classes"), F.max(F.struct("n", "root")).alias("most")).where("classes > 1")
    return placed.join(open_.select("key", F.col("most.root").alias("main")), "key").select("key", "node", "head", "root", "main")


def _finer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i:i + 500]
                small = nibbles(signatures([grams(words_of(t)) for t in part["text"]], FINE))
                yield part[["node", "signature", "bands"]].assign(fine=list(small))


def _open_pairs(open_: DataFrame, fine: DataFrame, least: int, below: int) -> DataFrame:
    """Pairs of different classes that share a bucket and agree in ``least`` registers or more, but fewer than ``below``, and both classes."""
    rest = open_.join(fine, "node")
    left, right = (rest.select(*[F.col(c).alias(f"{c}_{s}") for c in ("key", "node", "head", "root", "main", "signature", "bands", "fine")]) for s in "ab")
    # A large class would meet itself; so all others meet it and each other instead.
    left = left.where("root_a != main_a")
    first = F.array_compact(F.zip_with("bands_a", "bands_b", lambda x, y: F.when(x == y, x)))[0]
    # ``least`` <= agreement < ``below``, with the long expression once.
    close = F.abs(agreement("fine_a", "fine_b", FINE) * 2 - (least + below - 1)) <= below - 1 - least
    # The head of a bucket has met all its members already.
    fits = ((F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main_b")) | (F.col("root_a") < F.col("root_b")))
            & (F.col("node_a") != F.col("head_a")) & (F.col("node_b") != F.col("head_b"))
            & (agreement("signature_a", "signature_b") >= AGREE) & close & (first == F.col("key_a")))
    return left.join(right, (F.col("key_a") == F.col("key_b")) & fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "root_a", "root_b")


def _joined(labels: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """``labels`` (node, root), of so many rows, after merging the classes (root_a, root_b) that ``links`` join."""
    merged = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    out = keep(_few(labels.join(merged.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root")), rows), "labels")
    forget(labels), forget(merged)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, cluster_id, cluster_size, kept and the locator."""
    return _near(located(docs, "doc_id", "text"))


def _near(content: DataFrame) -> DataFrame:
    rows = keep(content.select(LOCATOR, F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(_sign, SIGNED), "signed")
    nodes = rows.where("n_words > 0").groupBy("node").agg(F.min(F.struct(LOCATOR, "bands", "signature")).alias("r"))
    bands = nodes.select("node", F.explode("r.bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    members = keep(bands.join(buckets, "key"), "buckets")

    # Texts of the nodes that share a bucket.
    shared = members.select("node").distinct()
    places = nodes.join(shared, "node", "left_semi").select("node", F.col(f"r.{LOCATOR}").alias(LOCATOR), "r.signature", "r.bands")
    texts = keep(content.select(LOCATOR, text_of().alias("text")).join(places, LOCATOR).select("node", "signature", "bands", "text"), "texts")

    size = texts.count()  # one row for each of these nodes
    first = keep(_verified(_with_first_head(members, texts), texts), "links").select(F.col("b").alias("node"), F.col("a").alias("root"))
    labels = climbed(keep(_few(texts.select("node").join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root")), size), "labels"), size)
    forget(first)

    def merged(pairs: DataFrame) -> DataFrame:
        links = keep(_verified(pairs, texts).select("root_a", "root_b"), "links")
        out = labels if links.isEmpty() else _joined(labels, links, size)
        forget(links)
        return out

    labels = merged(_with_heads(members, labels, texts))
    open_ = keep(_open(members, labels), "open")
    if not open_.isEmpty():
        fine = keep(texts.join(open_.select("node").distinct(), "node", "left_semi").mapInPandas(_finer, "node binary, signature array<long>, bands array<long>, fine array<long>"), "fine")
        labels = merged(_open_pairs(open_, fine, FINE_LIKELY, FINE + 1))
        labels = merged(_open_pairs(_open(open_.drop("root", "main"), labels), fine, FINE_AGREE, FINE_LIKELY))
        forget(fine)
    roots = labels
    forget(texts), forget(members), forget(open_)

    alone = F.when(F.col("n_words") == 0, F.encode(F.col(LOCATOR), "utf-8"))
    whole = rows.select(LOCATOR, "doc_id", "node", "n_words").join(roots, "node", "left").select(
        LOCATOR, "doc_id", F.coalesce(alone, "root", "node").alias("class"))
    best = whole.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", LOCATOR)).alias("best"), F.count("*").alias("cluster_size"))
    return whole.join(best, "class").select(
        "doc_id", F.col("best.doc_id").alias("cluster_id"), "cluster_size", (F.col(f"best.{LOCATOR}") == F.col(LOCATOR)).alias("kept"), LOCATOR)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    names = docs.columns
    whole = located(docs, *names)
    gone = _near(whole.select("doc_id", "text", LOCATOR)).where(~F.col("kept")).select(LOCATOR)
    return whole.join(gone, LOCATOR, "left_anti").select(*names)
