"""BPE encoding by speculation and verification, and decoding (operator 11).

A text is cut at the vocabulary's added tokens; each stretch is normalised (NFC, lower case
character by character) and split into words. Every word that a worker has not met yet gets

1. a proposal: greedy longest matches among the tokens that encode their own string;
2. a test of every adjacent pair of proposed tokens, all pairs of an Arrow batch at once. Two
   tokens stand side by side in an exact encoding if undoing their merges, the latest first,
   never shows two parts at the seam that an earlier merge would have joined. A sequence
   whose pairs all pass is the exact encoding of its string;
3. exact merging (lowest rank first, then leftmost) where a pair fails. The test rests on
   merges being ranked after those of their parts; where a vocabulary breaks this, the
   tokens concerned are never proposed and their words are merged exactly.

Words met before come from a table of at most ``CACHED`` short words per worker. Rows are encoded where
they lie, nothing is shuffled, and a long text costs one task memory in proportion to itself.

Letters, digits and lower case are those of the Unicode versions that ``regex`` (17) and Python (15.1)
know; a character that only one of them and the public library (16) has may be split otherwise.

Decoding looks ids up and joins the tokens by one space, as the vocabulary names no decoder.

Defined results: a null or empty text has no ids and decodes to ''. A null id list decodes
to null; an id that the vocabulary does not have is passed over. Repeated rows each get
their row; other columns, whatever their names, stay with their row in ``encode`` and
``decode`` unless they bear the name of the column that is added.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from jouleframe.llm.common import text_of

VOCABULARY = "word_bpe_49k.json"
CACHED = 500_000  # words a worker remembers
TOGETHER = 1_000_000  # characters whose words are held at once, unless one text is longer
SHORT = 48  # characters of a word that is remembered
END = "Ā"  # stands after the last byte of a word; no byte has this number
# Splits a normalised text into words; the rest is white space.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}++|\p{N}|[^\s\p{L}\p{N}]++")


def byte_of() -> dict[str, int]:
    """Printable stand-in -> byte: printable Latin-1 stands for itself, other bytes for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges of a word BPE vocabulary as arrays over token ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        ids = model["vocab"]
        size = max([*ids.values(), *self.added.values()]) + 1
        self.token: list[str | None] = [None] * size
        for s, i in (ids | self.added).items():
            self.token[i] = s
        byte = byte_of()
        # What a token covers, in bytes as Latin-1 characters; two tokens may share a spelling but not this.
        self.form: dict[int, str] = {}
        self.symbol: dict[str, int] = {}
        for c, b in byte.items():
            for s, form in ((c, chr(b)), (c + suffix, chr(b) + END)):
                if s in ids:
                    self.form[ids[s]] = form
                    self.symbol[form] = ids[s]
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token; -1: none
        self.left = np.arange(size)
        self.right = np.arange(size)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        sound = np.zeros(size, bool)
        sound[list(self.symbol.values())] = True
        again = set(self.symbol.values())
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = ids[a], ids[b], ids[a + b]
            self.merge[a, b] = rank, made
            # Made twice, or before its parts: the test of pairs does not hold for it.
            sound[made] = made not in again and sound[a] and sound[b]
            again.add(made)
            if sound[made]:
                self.form[made] = self.form[a] + self.form[b]
                self.rank[made], self.left[made], self.right[made] = rank, a, b
        keys = sorted((a * size + b, rank) for (a, b), (rank, _) in self.merge.items())
        self.size = size
        self.pairs = np.array([k for k, _ in keys], np.int64)
        self.ranks = np.array([r for _, r in keys], np.int64)
        # Tokens whose own string encodes to them: parts that do, joined by nothing before their merge.
        made = np.array(sorted(i for i in self.form if self.rank[i] >= 0 and sound[i]), np.int64)
        whole = dict(zip(made.tolist(), self.compatible(self.left[made], self.right[made], parts=True).tolist()))
        for i in made[np.argsort(self.rank[made])].tolist():
            whole[i] = whole[i] and whole.get(int(self.left[i]), True) and whole.get(int(self.right[i]), True)
        self.whole = {f: i for i, f in self.form.items() if sound[i] and whole.get(i, True)}
        # The longest token that starts with these three, two or one characters.
        self.reach: dict[str, int] = {}
        for f in self.whole:
            for k in (1, 2, 3):
                self.reach[f[:k]] = max(len(f), self.reach.get(f[:k], 0))

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], len(self.ranks)) if len(self.pairs) else np.full(len(a), 1)

    def compatible(self, a: np.ndarray, b: np.ndarray, parts: bool = False) -> np.ndarray:
        """Whether each pair stays apart. ``parts``: leave out the merge of the two whole tokens themselves."""
        never = len(self.ranks)
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.copy(), b.copy()
        until_a, until_b = np.full(len(a), never), np.full(len(a), never)  # rank at which the part at the seam is used up
        while len(at):
            rank = self.pair_rank(a, b)
            # Of two equal merges the left one comes first: it uses ``a`` up, but not ``b``.
            joined = (rank < until_a) & (rank <= until_b) & (rank < never)
            if parts:
                joined[:], parts = False, False
            out[at[joined]] = False
            base = (self.rank[a] < 0) & (self.rank[b] < 0)
            go = ~(joined | base)
            at, a, b, until_a, until_b = at[go], a[go], b[go], until_a[go], until_b[go]
            of_a = self.rank[a] > self.rank[b]
            until_a, until_b = np.where(of_a, self.rank[a], until_a), np.where(of_a, until_b, self.rank[b])
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return out

    def propose(self, form: str) -> list[int] | None:
        """Greedy longest matches; none ends between the last byte and the end of the word."""
        out, i, n, whole, reach = [], 0, len(form), self.whole, self.reach
        while i < n:
            most = reach.get(form[i:i + 3]) or reach.get(form[i:i + 2]) or reach.get(form[i], 0)
            for j in range(min(n, i + most), i, -1):
                if (found := whole.get(form[i:j])) is not None and j != n - 1:
                    out.append(found)
                    i = j
                    break
            else:
                return None
        return out

    def exact(self, form: str) -> list[int]:
        """All merges in order, over a linked list of symbols with a heap of the pairs that can merge."""
        last = len(form) - 2
        ids = [self.symbol[c] for c in form[:last]] + [self.symbol[form[last:]]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has merged since
            ids[i], ids[j] = self.merge[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (m := self.merge.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: Iterable[str]) -> tuple[dict[str, tuple[int, ...]], int]:
        """Word -> ids, and how many words had to be merged exactly."""
        forms = {w: w.encode().decode("latin-1") + END for w in words}
        proposed = {w: self.propose(f) for w, f in forms.items()}
        several = [p for p in proposed.values() if p and len(p) > 1]
        flat = np.fromiter(chain.from_iterable(several), np.int64)
        ends = np.cumsum([len(p) for p in several], dtype=np.int64)
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False  # the last token of a word has no pair
        first = np.flatnonzero(inside)
        bad = np.zeros(len(flat), bool)
        key, back = np.unique(flat[first] * self.size + flat[first + 1] if len(first) else first, return_inverse=True)
        bad[first] = ~self.compatible(key // self.size, key % self.size)[back]
        failed = np.add.reduceat(bad, ends - np.array([len(p) for p in several]), dtype=np.int64) > 0 if several else []
        fails = iter(failed)
        out, merged = {}, 0
        for w, p in proposed.items():
            if p is None or (len(p) > 1 and next(fails)):
                p, merged = self.exact(forms[w]), merged + 1
            out[w] = tuple(p)
        return out, merged

    def stretches(self, text: str) -> list[str]:
        """Words of ``text`` in order; an added token is a word of its own."""
        if self.cut is None or not self.cut.search(text):
            return words_of(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += words_of(text[at:m.start()])
            out.append(m[0])
            at = m.end()
        return out + words_of(text[at:])


def words_of(text: str) -> list[str]:
    if not text.isascii():
        # Lower case knows no context: a capital sigma is always the medial one.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return WORDS.findall(text.lower())


class Words:
    """A worker's table of words in two halves: when the newer is full, it becomes the older, whose words go unless met again."""

    def __init__(self):
        self.newer: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def turn(self) -> None:
        if len(self.newer) > CACHED // 2:
            self.newer, self.older = {}, self.newer


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[Vocabulary, Words]:
    """The vocabulary and this worker's table of words."""
    return Vocabulary(path), Words()


def encode_texts(texts: Iterable[str], path: str) -> list[list[int]]:
    vocab, table = vocabulary(path)
    table.turn()
    known, older = table.newer, table.older
    split = [vocab.stretches(t) for t in texts]
    new = set(chain.from_iterable(split)).difference(known)
    met = {w: older[w] for w in new if w in older}
    # No word of a text looks like an added token: those hold letters and other signs.
    added = {w: (vocab.added[w],) for w in new & vocab.added.keys()}
    known.update(met, **added)
    known.update(vocab.encode_words(new.difference(met, added))[0])
    out = [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]
    for w in [w for w in new if len(w) > SHORT]:
        del known[w]
    return out


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return path


def parts(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in runs of about ``TOGETHER`` characters, so that the words of one run fit in memory."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= TOGETHER:
            yield texts[start:i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def decoded(ids: Iterable[int], token: list[str | None]) -> str:
    n = len(token)
    return " ".join([t for i in ids if 0 <= i < n and (t := token[i]) is not None])


def encode(docs: DataFrame, text: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with the token ids of column ``text``. ``path`` names the vocabulary file, the same on every executor."""

    @F.pandas_udf("array<int>")
    def ids(batch: pd.Series) -> pd.Series:
        return pd.Series([np.array(x, np.int32) for part in parts(batch.to_list()) for x in encode_texts(part, _path(path))], dtype=object)

    return docs.withColumn(into, ids(text_of(text)))


def decode(rows: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with the text of the id lists in column ``ids``."""

    @F.pandas_udf("string")
    def joined(batch: pd.Series) -> pd.Series:
        token = vocabulary(_path(path))[0].token
        return pd.Series([None if x is None else decoded([int(i) for i in x if i == i and i is not None], token) for x in batch], dtype=object)

    return rows.withColumn(into, joined(F.col(ids).cast("array<int>")))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: its number of tokens, and digests of its ids and of what they decode to."""
    sha256 = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = vocabulary(_path(path))[0].token
        number = [str(i) for i in range(len(token))]
        for batch in batches:
            at = 0
            for part in parts(batch["text"].to_list()):
                found = encode_texts(part, _path(path))
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[at:at + len(part)], "n_tokens": [len(x) for x in found],
                    "ids_sha256": [sha256(" ".join(map(number.__getitem__, x))) for x in found],
                    "decoded_sha256": [sha256(decoded(x, token)) for x in found]})
                at += len(part)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))
    out = rows.mapInPandas(made, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
