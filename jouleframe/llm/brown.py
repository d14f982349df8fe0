"""Language-model scores by Brown class n-grams (operator 8).

Word counts come from every training text. Every word of the vocabulary gets its class by
exchange, from all of its neighbours. The ``CORE`` most frequent words are first clustered
alone, word by word, which gives the exchange its start. Then rounds over the whole corpus
move words to the class that raises the likelihood of the class bigrams most, until a round
gains little: in a round every word of the ``HEAD`` moves, and so do, as one word each, the
other words that share their last two bytes. At last each of those other words moves on its
own: its contexts meet in one of many buckets of words, and it leaves the class of its ending
where that gains more than naming another class costs (the logarithm of their number).
Only words that no training text holds keep the class of their ending. Head and other words
have classes of their own.

A text's probability is the product of class transitions (trigrams that back off to bigrams
and those to class frequencies) and word emissions; in a class of other words an unseen word
gets the mass of a tenth of a count. ``END`` is a class of its own and follows every text.

The texts are taken apart once: a chunk of them holds numbers, which stand for a word of the
head or an ending, and each of its other words once. All later passes read the chunks. The
driver and the tasks hold tables of fixed bounds only: the head, classes by number and the
class n-grams. Classes and counts of other words go from their buckets to the chunks that hold
the words.

Defined results: a null or empty text is the end token alone. A null ``doc_id`` hashes as
the empty text. Repeated rows each count and each get a row. Without any training text all
counts are zero, V = 0 and the class model falls back to the base. An empty table gives no
rows. A long text costs one task memory in proportion to itself.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from jouleframe.llm.common import keep, text_of

FOLDS = 10
ADD = 0.1
CORE = 1_024      # words clustered word by word, as a start
HEAD = 65_536     # words with a number of their own
ENDINGS = 65_536  # two bytes
CLASSES = 32      # of head words, besides that of the end, and as many of other words
EXCHANGES = 12    # most rounds over the core
ROUNDS = 8        # most rounds over the corpus
LITTLE = 0.0005   # share of the likelihood's logarithm below which a round's gain ends them
LEAN = 0.001      # share of a head class's bigrams
TRIGRAM, BIGRAM = 8.0, 4.0  # counts given to the shorter history
FLUSH = 300_000   # different words a task counts before it hands them on
CHUNK = 250_000   # tokens of a chunk; a longer text is one chunk
BUCKET = 1_000_000  # tokens of a bucket of words outside the head
BLOCKS = 512      # shares of the numbers; the counts of a share travel as one row and have fewer than 2 ** 16 places
END = b""         # no word is empty


def words_of(text: str) -> list[bytes]:
    """A-Z lowered, then runs of anything but ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def is_training(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS != 0


def word_counts(training: DataFrame) -> DataFrame:
    """word, n over all training texts, the end included."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(words_of(text))
                held[END] += 1
                if len(held) > FLUSH:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = Counter()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    return training.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _ints(value, kind=np.int32) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _endings(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([(b" " + w)[-2:] for w in words]), "<u2").astype(np.int64)


CHUNKS = "trained boolean, doc_id array<long>, ends binary, units binary, tail binary, at binary"


def chunks_of(content: DataFrame, words: list[bytes]) -> DataFrame:
    """Texts as numbers: those of head words, and beyond them those of the endings of other words.

    ``tail`` holds the other words once each, ``at`` which of them stands at each number of an ending.
    """
    codes, size = dict(zip(words, range(len(words)))), len(words)

    def packed(trained: bool, ids: list, ends: list[int], tokens: list[bytes]) -> pa.RecordBatch:
        units = np.fromiter(map(codes.get, tokens, repeat(-1)), np.int32, len(tokens))
        outside = np.flatnonzero(units < 0)
        own: dict[bytes, int] = {}
        at = np.fromiter([own.setdefault(tokens[i], len(own)) for i in outside.tolist()], np.int32, len(outside))
        if own:
            units[outside] = size + _endings(list(own))[at]
        return pa.RecordBatch.from_arrays(
            [pa.array([trained]), pa.array([ids], pa.list_(pa.int64())),
             *(pa.array([x], pa.binary()) for x in (np.array(ends, np.int32).tobytes(), units.tobytes(), b" ".join(own), at.tobytes()))],
            names=["trained", "doc_id", "ends", "units", "tail", "at"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                for row in zip(*(batch.column(c).slice(start, 500).to_pylist() for c in ("trained", "doc_id", "text"))):
                    ids, ends, tokens = held.setdefault(row[0], ([], [], []))
                    tokens += words_of(row[2])
                    tokens.append(END)
                    ids.append(row[1])
                    ends.append(len(tokens))
                    if len(tokens) > CHUNK:
                        yield packed(row[0], *held.pop(row[0]))
        for trained, rest in held.items():
            yield packed(trained, *rest)

    made = content.select(is_training().alias("trained"), "doc_id", "text").mapInArrow(pack, CHUNKS)
    return keep(made.select(F.monotonically_increasing_id().alias("chunk"), "*"), "chunks")


def _tallied(frame: DataFrame, column: str, codes_of, bound: int) -> np.ndarray:
    """How often ``codes_of`` the rows' ``column`` gives each code below ``bound``, summed over the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(bound, np.int64)
        for batch in batches:
            for value in batch.column(0):
                sums += np.bincount(codes_of(value), minlength=bound)
        code = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(sums[code])], names=["code", "n"])

    got = frame.select(column).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(bound)
    out[got["code"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = EXCHANGES) -> np.ndarray:
    """Classes of words from their pair counts; word 0 (the end) alone has class 0."""
    k = len(pairs)
    given = np.concatenate([[0], 1 + np.arange(k - 1) % classes])
    hot = np.eye(classes + 1)[given]
    table = hot.T @ pairs @ hot
    for _ in range(rounds):
        moved = 0
        for w in range(1, k):
            old = given[w]
            from_, to, own = pairs[:, w] @ hot, pairs[w] @ hot, pairs[w, w]
            from_[old] -= own
            to[old] -= own
            # Take the word out ...
            table[:, old] -= from_
            table[old] -= to
            table[old, old] -= own
            # (its neighbours' own totals stay what they are in whatever class it ends)
            left, right = table.sum(axis=1) + from_, table.sum(axis=0) + to
            # ... and see what each class gains from it.
            into, out = _xlogx(table + from_[:, None]) - _xlogx(table), _xlogx(table + to[None, :]) - _xlogx(table)
            same = np.diag(table)
            gain = into.sum(axis=0) - np.diag(into) + out.sum(axis=1) - np.diag(out) + _xlogx(same + from_ + to + own) - _xlogx(same)
            gain -= _xlogx(left + to.sum() + own) - _xlogx(left) + _xlogx(right + from_.sum() + own) - _xlogx(right)
            gain[0] = -np.inf
            new = old if gain[old] >= gain.max() - 1e-9 else int(gain.argmax())
            table[:, new] += from_
            table[new] += to
            table[new, new] += own
            if new != old:
                given[w], moved = new, moved + 1
                hot[w] = np.eye(classes + 1)[new]
        if moved <= k // 200:
            break
    return given

def _gains(left: np.ndarray, right: np.ndarray, logs: np.ndarray, tails: bool) -> np.ndarray:
    """What each class adds to the likelihood of the class bigrams for words with these neighbours' classes.

    ``logs``: of the class bigrams, with their row and column sums' behind; words outside the head have the upper half.
    """
    pair, total = logs
    half = len(pair) // 2
    own = slice(half, None) if tails else slice(0, half)
    # The class's own sums stand below both bigrams.
    gain = left @ pair[:, own] + right @ pair[own].T - (left.sum(axis=1) + right.sum(axis=1))[:, None] * total[own]
    gain[:, 0] = -np.inf
    return gain


def _logs(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A class of other words leans on that of head words with its number, so that an empty one has something to draw words by."""
    smooth, half = table + 0.5, len(table) // 2
    smooth[:, half:] += LEAN * smooth[:, :half]
    smooth[half:] += LEAN * smooth[:half]
    return np.log(smooth), (np.log(smooth.sum(axis=0)) + np.log(smooth.sum(axis=1))) / 2


def _moved(training: DataFrame, classes: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """Classes after one round in which each number moves to its best class, given the classes of all neighbours.

    ``classes`` of -1 are not known yet; neighbours of that kind do not count.
    """
    t, logs = len(table), _logs(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(classes), 2, t), np.int32)
        flat, one = sums.reshape(-1), np.int32(1)
        for batch in batches:
            for value in batch.column(0):
                x = _ints(value)
                c = classes[np.append(0, x)]  # every text ends with the end, which opens the next
                now, near = x.astype(np.int64) * (2 * t), c[:-1]
                np.add.at(flat, (now + near)[near >= 0], one)
                now, near = now[:-1] + t, c[2:]
                np.add.at(flat, (now + near)[near >= 0], one)
        for block in range(BLOCKS):  # frequent words have neighbouring numbers: every block has its share of them
            part = sums[block::BLOCKS].reshape(-1)
            place = np.flatnonzero(part)
            if len(place):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([place.astype(np.uint16).tobytes()], pa.binary()), pa.array([part[place].tobytes()], pa.binary())],
                    names=["block", "place", "n"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, place, n in zip(*batch.columns):
                if block.as_py() not in blocks:
                    blocks[block.as_py()] = np.zeros(-(-len(classes) // BLOCKS) * 2 * t)
                blocks[block.as_py()][_ints(place, np.uint16)] += _ints(n)
        for block, sums in blocks.items():
            sums = sums.reshape(-1, 2, t)
            seen = np.flatnonzero(sums.any(axis=(1, 2)))
            left, right, unit = sums[seen, 0], sums[seen, 1], seen * BLOCKS + block
            tails = unit >= size
            to = np.where(tails, t // 2 + _gains(left, right, logs, True).argmax(axis=1), _gains(left, right, logs, False).argmax(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(to)], names=["unit", "class"])

    found = (training.select("units").mapInArrow(count, "block long, place binary, n binary").repartition(32, "block")
             .mapInArrow(best, "unit long, class long").toPandas())  # a row for each number at most
    out = classes.copy()
    out[found["unit"].to_numpy(np.int64)] = found["class"].to_numpy(np.int64)
    out[0] = 0
    return out


def _likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def unit_classes(training: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the head words and, behind them, of the endings; and the class bigrams that they give."""
    n_core, n_class = min(CORE, size), CLASSES + 1
    t = 2 * n_class

    def pairs(value) -> np.ndarray:
        x = np.append(0, _ints(value)).astype(np.int64)
        a, b = x[:-1], x[1:]
        both = (a < n_core) & (b < n_core)
        return a[both] * n_core + b[both]

    matrix = _tallied(training, "units", pairs, n_core ** 2).reshape(n_core, n_core)
    core = exchange(matrix, CLASSES)
    hot = np.eye(n_class)[core]
    table = np.tile(hot.T @ matrix @ hot, (2, 2))  # other words start as head words would
    known = np.full(size + ENDINGS, -1)
    known[:n_core] = core
    classes = _moved(training, known, table, size)
    classes[:n_core] = core
    # Numbers that never stand beside a word of the core start in the most frequent class; endings in no training text stay there.
    often = 1 + int(np.bincount(core[1:], minlength=n_class)[1:].argmax()) if n_core > 1 else 1
    classes = np.where(classes < 0, often + n_class * (np.arange(len(classes)) >= size), classes)
    best = None
    for _ in range(ROUNDS + 1):

        def bigrams(value) -> np.ndarray:
            c = classes[np.append(0, _ints(value))]
            return c[:-1] * t + c[1:]

        table = _tallied(training, "units", bigrams, t * t).reshape(t, t)
        if best is not None and _likelihood(table) <= _likelihood(best[1]):
            break  # words that moved together undid each other's gain
        little = best is not None and _likelihood(table) - _likelihood(best[1]) < -LITTLE * _likelihood(table)
        best = classes, table
        if little:
            break
        classes = _moved(training, classes, table, size)
    return best


CLASSED = "trained boolean, doc_id array<long>, ends binary, classes binary, known array<long>, base array<double>, emitted array<double>, kinds binary"


def _tail_words(chunks: DataFrame, classes: np.ndarray, table: np.ndarray, size: int, buckets: int) -> DataFrame:
    """A row per chunk and bucket of words outside the head: their training counts and classes, in the chunk's order.

    ``kinds``, in one row of a bucket: how many different words with a count each class got.
    """
    t, logs = len(table), _logs(table)
    half, price = t // 2, math.log(CLASSES)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, trained, units, tail, at in zip(*batch.columns):
                words = tail.as_py().split(b" ") if len(tail.as_buffer()) else []
                if not words:
                    continue
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                x, at = _ints(units), _ints(at)
                if not trained.as_py():
                    at = at[:0]  # only asks
                place = np.flatnonzero(x >= size)[:len(at)]
                c = classes[np.append(0, x)].astype(np.uint8)
                near = np.stack([c[place], c[place + 2]], axis=1)
                order, to = np.argsort(bucket, kind="stable"), np.argsort(bucket[at], kind="stable")
                within = np.empty(len(words), np.int32)
                sizes, takes = np.bincount(bucket, minlength=buckets), np.bincount(bucket[at], minlength=buckets)
                opens, starts = np.cumsum(sizes) - sizes, np.cumsum(takes) - takes
                rows = []
                for b in np.flatnonzero(sizes).tolist():
                    mine, tokens = order[opens[b]:opens[b] + sizes[b]], to[starts[b]:starts[b] + takes[b]]
                    within[mine] = np.arange(len(mine))
                    rows.append((b, b" ".join([words[i] for i in mine.tolist()]), within[at[tokens]].tobytes(), near[tokens].tobytes()))
                b, blob, at_, near_ = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk.as_py()] * len(b), pa.int64()), pa.array(b, pa.int32()), pa.array(blob, pa.binary()), pa.array(at_, pa.binary()),
                     pa.array(near_, pa.binary())], names=["chunk", "bucket", "words", "at", "near"])

    def move(group: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        asked, ids, near = [], [], []
        for words, at, sides in zip(*(group.column(c) for c in ("words", "at", "near"))):
            asked.append(np.array([known.setdefault(w, len(known)) for w in words.as_py().split(b" ")], np.int64))
            ids.append(asked[-1][_ints(at)])
            near.append(_ints(sides, np.uint8).reshape(-1, 2))
        ids, near = np.concatenate(ids), np.concatenate(near)
        n, to = np.bincount(ids, minlength=len(known)), classes[size + _endings(list(known))].astype(np.uint8)
        order = np.argsort(ids, kind="stable")
        ids, near = ids[order], near[order].astype(np.int64)
        for low in range(0, len(known), 10_000):
            high = min(low + 10_000, len(known))
            part = slice(*np.searchsorted(ids, [low, high]))
            left, right = (np.bincount((ids[part] - low) * t + near[part, side], minlength=(high - low) * t).reshape(-1, t) for side in (0, 1))
            gain = _gains(left, right, logs, True)
            row, start = np.arange(high - low), to[low:high].astype(np.int64) - half
            new = gain.argmax(axis=1)
            moves = (n[low:high] > 0) & (gain[row, new] - np.where(start > 0, gain[row, start], 0) > price)
            to[low:high] = np.where(moves, half + new, to[low:high])
        kinds = np.bincount(to[n > 0], minlength=t).tobytes()
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "n": pa.array([n[a].astype(np.int32).tobytes() for a in asked], pa.binary()),
                         "class": pa.array([to[a].tobytes() for a in asked], pa.binary()), "kinds": pa.array([kinds, *[None] * (len(asked) - 1)], pa.binary())})

    asks = chunks.select("chunk", "trained", "units", "tail", "at").mapInArrow(contexts, "chunk long, bucket int, words binary, at binary, near binary")
    return asks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(move, "chunk long, bucket int, n binary, class binary, kinds binary")


def classed(chunks: DataFrame, classes: np.ndarray, table: np.ndarray, counts: np.ndarray, buckets: int) -> DataFrame:
    """Chunks with the class of every token, and per text its known tokens, its base sum and its counts' part of the emissions."""
    size = len(counts)
    head = np.log10(counts + ADD)
    emission = np.log10(counts / np.bincount(classes[:size], weights=counts)[classes[:size]])

    def join(group: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(replies.column("bucket").to_numpy())
        kinds = [x for x in replies.column("kinds").to_pylist() if x]
        for row in group.to_pylist():
            x, at = np.frombuffer(row["units"], np.int32), np.frombuffer(row["at"], np.int32)
            c, inside = classes[x].astype(np.uint8), x < size
            base, emitted, known = np.zeros(len(x)), np.zeros(len(x)), np.ones(len(x), np.int64)
            base[inside], emitted[inside] = head[x[inside]], emission[x[inside]]
            if len(at):
                words = row["tail"].split(b" ")
                place = np.argsort(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets, kind="stable")
                n, of = np.empty(len(words), np.int32), np.empty(len(words), np.uint8)
                n[place] = np.concatenate([_ints(replies.column("n")[int(i)]) for i in order])
                of[place] = np.concatenate([_ints(replies.column("class")[int(i)], np.uint8) for i in order])
                c[~inside], known[~inside] = of[at], n[at] > 0
                base[~inside] = emitted[~inside] = np.log10(n[at] + ADD)
            first = np.append(0, np.frombuffer(row["ends"], np.int32)[:-1])
            out.append({k: row[k] for k in ("trained", "doc_id", "ends")} | {
                "classes": c.tobytes(), "known": np.add.reduceat(known, first), "base": np.add.reduceat(base, first), "emitted": np.add.reduceat(emitted, first),
                "kinds": np.sum([np.frombuffer(k, np.int64) for k in kinds], axis=0).tobytes() if kinds else None})
        return pa.Table.from_pylist(out, schema)

    schema = pa.schema([("trained", pa.bool_()), ("doc_id", pa.list_(pa.int64())), ("ends", pa.binary()), ("classes", pa.binary()), ("known", pa.list_(pa.int64())),
                        ("base", pa.list_(pa.float64())), ("emitted", pa.list_(pa.float64())), ("kinds", pa.binary())])
    words = _tail_words(chunks, classes, table, size, buckets)
    return keep(chunks.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(join, CLASSED), "classed")


def transitions(training: DataFrame, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms (base 10) of P(class | two classes before), flat, and the tokens of each class."""
    def trigrams(value) -> np.ndarray:
        return _trigrams(_ints(value, np.uint8), t)

    n3 = _tallied(training, "classes", trigrams, t ** 3).reshape(t, t, t)  # at most (2 * (CLASSES + 1)) ** 3 rows
    n2 = n3.sum(axis=0)
    n1 = n2.sum(axis=0)
    p1 = (n1 + ADD) / (n1.sum() + ADD * t)
    p2 = (n2 + BIGRAM * p1) / (n2.sum(axis=1, keepdims=True) + BIGRAM)
    return np.log10((n3 + TRIGRAM * p2) / (n3.sum(axis=2, keepdims=True) + TRIGRAM)).astype(np.float32).reshape(-1), n1


def _trigrams(classes: np.ndarray, t: int) -> np.ndarray:
    c = np.concatenate([[0, 0], classes]).astype(np.int64)
    a, b = c[:-2], c[1:-1]
    return (np.where(b == 0, 0, a) * t + b) * t + c[2:]  # two ends open a text


def scored(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    content = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    vocabulary = keep(word_counts(content.where(is_training())), "vocabulary")
    n_all, v_all = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = vocabulary.where(F.col("word") != END).orderBy(F.desc("n"), "word").limit(HEAD - 1).toPandas()
    ends = vocabulary.where(F.col("word") == END).first()
    words, counts = [END, *map(bytes, top["word"])], np.concatenate([[max(1, ends["n"] if ends else 0)], top["n"].to_numpy(float)])
    size, t = len(words), 2 * (CLASSES + 1)
    chunks = chunks_of(content, words)
    training = chunks.where("trained")
    classes, table = unit_classes(training, size)
    # Held-out texts only ask: they are as many again for each FOLDS - 1 of training.
    parts = classed(chunks, classes, table, counts, 16 + int(n_all - counts.sum()) // BUCKET)
    p3, n1 = transitions(parts.where("trained"), t)
    kinds = np.zeros(t)
    for r in parts.where("kinds is not null").select("kinds").collect():  # a row a bucket
        kinds += np.frombuffer(r["kinds"], np.int64)
    mass = np.log10(n1 + ADD * (kinds + 1)) * (np.arange(t) >= t // 2)
    floor = math.log10(n_all + ADD * (v_all + 1)) if n_all else 0.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trained, ids, ends, own, known, base, emitted in zip(*batch.columns):
                c, ends = _ints(own, np.uint8), _ints(ends)
                first = np.append(0, ends[:-1])
                n = (ends - first).astype(np.int64)
                base, emitted = base.values.to_numpy(), emitted.values.to_numpy()
                model = np.add.reduceat(p3[_trigrams(c, t)].astype(float) - mass[c], first) + emitted
                base = base - n * floor
                if not n_all:  # nothing was seen: every token has probability 1 of the one unknown
                    known, base = np.zeros(len(n), np.int64), np.zeros(len(n))
                    model = base
                else:
                    known = known.values.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(np.full(len(n), not trained.as_py())), pa.array(n), pa.array(known), pa.array(np.full(len(n), n_all)),
                     pa.array(base), pa.array(model)], names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return parts.select("trained", "doc_id", "ends", "classes", "known", "base", "emitted").mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
