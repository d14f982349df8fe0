"""Best-fit packing by a configuration linear program (operator 4).

Documents become token ids (a public byte-level vocabulary; id 0 ends each document), longer
ones are cut into pieces of the sequence length, the first being the shorter one. Only the
histogram of piece lengths - at most ``capacity`` counts, whatever the input - goes to the
driver, which packs lengths instead of pieces:

1. The configuration LP (fewest sequences so that every length is covered as often as it
   occurs) is solved by multiplicative weights. Each round prices a length by its weight
   over its count, finds the best configuration by a bounded knapsack dynamic program, uses
   it, and lowers the weights of what it covers. The value of that configuration also bounds
   from below how many sequences any packing needs.
2. Every ``CHECKED`` rounds shares of the solution are rounded down to whole uses of each
   configuration and the remaining pieces packed best-fit; the fewest sequences so far are kept.
   Rounds end when these are within ``GAP`` of the bound, at the latest after ``ROUNDS``.
3. Where the gap stays open, the remaining pieces are packed by priced configurations as well,
   the longest piece first, and the better of both stays.

Pieces then find their places on Spark: they are ranked within their length (in hash buckets,
so that no common length meets in one task) and a rank falls into one range of one
configuration. The table of ranges has as many rows as configurations have lengths: it
depends on the capacity, not on the number of documents.

Defined results: a null or empty text is one piece with the end id alone. An added token's string in
a text is that token. Other columns are not looked at. Repeated rows are
packed as often as they occur. An empty table gives no rows. A long text costs one task
memory in proportion to itself.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from jouleframe.llm.common import keep, text_of

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.tiktoken"
ADDED = "byte_bpe_50k.json"
END_ID = 0
BUCKETS = 256
ROUNDS = 500       # most rounds of the LP
CHECKED = 50       # rounds between two tests of the gap
GAP = 0.005        # between the sequences of a rounded solution and the bound of the prices
SHARES = (1.0, 0.9, 0.5, 0.0)  # of the LP solution that whole uses keep


# The word pattern of the vocabulary, with possessive repeats: the same words, found without backtracking.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def tokenizer(path: str, added: str):
    """Encoder of a rank file, with the added tokens of the json at ``added``.

    The rank file holds the vocabulary of the public ``byte_bpe_50k.json`` and gives the same ids. A text is cut
    at its added tokens first, and each stretch between them is encoded for itself, as ``tokenizers`` does.
    """
    import base64
    import json

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(added, encoding="utf-8") as file:
        special = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
    encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return partial(encoding.encode, allowed_special=set(special), disallowed_special=())


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        encode = tokenizer(path or public_tokenizers.path(VOCABULARY), public_tokenizers.path(ADDED))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*encode(text), END_ID], "<u4")
                first = len(ids) % capacity or capacity
                for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], [*range(first, len(ids) + 1, capacity)])):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(cut, PIECES)


def best_configuration(lengths: np.ndarray, most: np.ndarray, prices: np.ndarray, capacity: int) -> dict[int, int]:
    """Index -> copies of the most valuable set of lengths that fits, no length more often than ``most``."""
    items: list[tuple[int, int]] = []
    for i, (l, n) in enumerate(zip(lengths.tolist(), np.minimum(most, capacity // lengths).tolist())):
        k = 1
        while n > 0:
            c = min(k, n)
            items.append((i, c))
            n -= c
            k *= 2
    value = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), bool)
    for j, (i, c) in enumerate(items):
        size = int(lengths[i]) * c
        more = value[:capacity + 1 - size] + prices[i] * c
        better = taken[j, size:]
        np.greater(more, value[size:], out=better)
        value[size:] = np.maximum(value[size:], more)
    out: dict[int, int] = {}
    room = capacity
    for j in range(len(items) - 1, -1, -1):
        if taken[j, room]:
            i, c = items[j]
            out[i] = out.get(i, 0) + c
            room -= int(lengths[i]) * c
    return out


Plan = list[tuple[int, dict[int, int]]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram: sequences that are filled alike are one entry."""
    rooms: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}
    order: list[int] = []

    def put(room: int, held: tuple[tuple[int, int], ...], times: int) -> None:
        if room not in rooms:
            rooms[room] = {}
            bisect.insort(order, room)
        rooms[room][held] = rooms[room].get(held, 0) + times

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n > 0:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                put(capacity, (), -(-n // (capacity // length)))
                continue
            room = order[at]
            held = next(iter(rooms[room]))
            times, fit = rooms[room].pop(held), room // length
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            full = min(times, n // fit)
            if full:
                put(room - fit * length, (*held, (length, fit)), full)
                n -= full * fit
            if full < times and 0 < n < fit:
                put(room - n * length, (*held, (length, n)), 1)
                n, full = 0, full + 1
            if full < times:
                put(room, held, times - full)
    return [(times, dict(held)) for box in rooms.values() for held, times in box.items() if held]


def by_price(counts: dict[int, int], capacity: int) -> Plan:
    """The longest piece with the most valuable set beside it, again and again; the price of a length grows a little faster than it."""
    lengths = np.array(sorted(counts, reverse=True), np.int64)
    left = np.array([counts[l] for l in lengths.tolist()], np.int64)
    prices = lengths / capacity + 0.05 * (lengths / capacity) ** 2
    out: Plan = []
    while left.any():
        some = np.flatnonzero(left)
        first = some[0]
        room = capacity - int(lengths[first])
        held = left[some].copy()
        held[0] -= 1
        fits = (lengths[some] <= room) & (held > 0)
        best = {int(first): 1}
        if fits.any():
            for i, c in best_configuration(lengths[some][fits], held[fits], prices[some][fits], room).items():
                k = int(some[fits][i])
                best[k] = best.get(k, 0) + c
        times = int(min(left[i] // c for i, c in best.items()))
        for i, c in best.items():
            left[i] -= c * times
        out.append((times, {int(lengths[i]): c for i, c in sorted(best.items())}))
    return out


def configurations(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """How often each configuration (length -> copies) is used; together they hold every piece once."""
    lengths = np.array(sorted((l for l, n in counts.items() if n > 0), reverse=True), np.int64)
    if not len(lengths):
        return []
    n = np.array([counts[l] for l in lengths.tolist()], np.int64)
    total, size = n.astype(float), lengths / capacity

    # The LP by multiplicative weights: ``used`` is how much each configuration is used.
    weight = size * total / (size * total).sum()
    used: dict[tuple[tuple[int, int], ...], float] = {}
    bound = float((lengths * n).sum()) / capacity

    def rounded(share: float, rest) -> Plan:
        """``share`` of the solution in whole uses, full configurations first, never more than there are pieces; then the rest."""
        left = n.copy()
        volume = sum(x * sum(lengths[i] * c for i, c in key) for key, x in used.items())
        scale = share * float((lengths * n).sum()) / volume
        out: Plan = []
        fill = lambda key: sum(lengths[i] * c for i, c in key)
        for key, x in sorted(used.items(), key=lambda e: (-fill(e[0]), -e[1], e[0])):
            times = int(min(x * scale, min(left[i] // c for i, c in key)))
            if times > 0:
                for i, c in key:
                    left[i] -= c * times
                out.append((times, {int(lengths[i]): c for i, c in key}))
        return out + rest({int(l): int(k) for l, k in zip(lengths, left) if k}, capacity)

    needs = lambda plan: sum(times for times, _ in plan)
    best: Plan | None = None
    done = 0
    while done < rounds:
        for _ in range(CHECKED):
            found = best_configuration(lengths, n, weight / total, capacity)
            at, copies = np.array(list(found)), np.array(list(found.values()), float)
            # No sequence is worth more at these prices, so all pieces need this many.
            bound = max(bound, float(weight.sum() / (weight[at] / total[at] * copies).sum()))
            step = float((total[at] / copies).min())
            key = tuple(sorted(found.items()))
            used[key] = used.get(key, 0.0) + step
            weight[at] *= np.exp(-copies * step / total[at])
            weight /= weight.sum()
        done += CHECKED
        best = min([*([best] if best else []), *(rounded(share, best_fit) for share in SHARES)], key=needs)
        if needs(best) <= math.ceil(bound * (1 + GAP)):
            return best
    return min(best, rounded(1.0, by_price), key=needs)


def ranges(plan: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """One row per configuration and length: the ranks it takes and where they go; sorted by length and rank."""
    rows, sequence, taken = [], 0, {}
    for times, best in plan:
        offset = 0
        for length, copies in sorted(best.items(), reverse=True):
            lo = taken.get(length, 0)
            taken[length] = lo + times * copies
            rows.append((length, lo, sequence, times, offset))
            offset += length * copies
        sequence += times
    return pd.DataFrame(rows, columns=["length", "lo", "sequence", "times", "offset"], dtype="int64").sort_values(["length", "lo"], ignore_index=True)


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank`` from 0 within each length."""
    x = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)))
    sums = x.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    return x.join(sums, ["length", "_bucket"]).withColumn("rank", F.col("_first") + F.row_number().over(own) - 1).select(*pieces.columns, "rank")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    pieces = keep(tokenised(docs, path, capacity), "pieces")
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = ranges(configurations(counts, capacity))
    # Length and rank as one sorted key: ranks of a length lie below its count.
    lengths = np.array(sorted(counts), np.int64)
    base = dict(zip(lengths.tolist(), np.concatenate([[0], np.cumsum([counts[l] for l in lengths.tolist()])[:-1]]).tolist() if len(lengths) else []))
    starts = np.array([base[l] for l in table["length"]], np.int64) + table["lo"].to_numpy()
    lo, sequence, times, offset = (table[c].to_numpy() for c in ("lo", "sequence", "times", "offset"))
    firsts = np.array([base[l] for l in lengths.tolist()], np.int64)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        i = np.searchsorted(starts, firsts[np.searchsorted(lengths, n)] + r, side="right") - 1
        at = r - lo[i]
        return pd.DataFrame({"sequence_id": sequence[i] + at % times[i], "offset": offset[i] + at // times[i] * n})

    x = ranked(pieces).withColumn("_p", place("length", "rank"))
    return x.select(*pieces.columns, "_p.sequence_id", "_p.offset")
