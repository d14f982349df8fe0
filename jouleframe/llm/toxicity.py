"""Toxicity scores from gradient-boosted trees over dense text features (operator 7).

Features of a text: lexicon hits (density, number, number of fixed insults, variety, most in a window), hits near a
second-person word, second-person rate, capitals, exclamation and other punctuation, digits,
hits that only appear once obfuscation (leet signs, stretched or starred letters) is undone,
and the rate of words that mix letters with digits or signs. The lexicon is a short fixed
list of insults plus words and word beginnings that the labelled texts show to be as telling
(languages that inflect or compound rarely repeat a whole word). Trees are boosted
on three of the five folds of ``doc_id``; a fourth, unseen by the trees and the lexicon,
calibrates their output with isotonic regression; the fifth stays held out.

Fitting uses at most ``FIT_ROWS`` labelled rows (those with the smallest hash of ``doc_id``);
scoring covers every row and its whole text. Labels, language, source and identifier never
enter a score.

Defined results: a null or empty text has zero features and gets the model's score for
them. Without labelled rows of both kinds to learn from, the score is half the number of
fixed insults, 1 at most. If the calibrating fold has labels of one kind only, the trees' own
probability is the score. Repeated labels of one ``doc_id`` count once, toxic if one is. A null
``doc_id`` is held out. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from jouleframe.llm.common import keep, text_of

FIT_ROWS = 20_000      # most labelled rows used for fitting
LEXICON_WORDS = 200    # most learned lexicon entries
MIN_TEXTS = 8          # different toxic texts that must hold a learned entry
CLEAN_WEIGHT = 9       # texts that are toxic for each one that is not
STEMS = range(3, 9)    # letters of a word beginning
CACHED = 100_000       # words or entries that a worker holds at once
FOLDS, CALIBRATION = 5, 1
WINDOW, NEAR = 25, 5   # words
PREFIX = "__tox_"

# Common insults, and second-person words of four languages.
INSULTS = ("idiot idiots moron morons stupid dumb dumbass loser losers trash scum clown pathetic disgusting worthless garbage ugly fool imbecile retard "
           "bastard jerk creep freak pig filth vermin hate kill die shut sucks crap damn idiota estúpido imbécil basura idiote stupide imbécile ordure "
           "dummkopf blödmann abschaum dreck").split()
SECOND_PERSON = "you your yours yourself u ur youre du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted vosotros".split()
LEET = {"@": "a", "$": "s", "0": "o", "1": "i", "!": "i", "3": "e", "4": "a", "5": "s", "7": "t"}

FEATURES = ["density", "hits", "insults", "variety", "most_near", "at_second_person", "second_person", "capitals", "exclaims", "punctuation", "digits",
            "hidden_hits", "mixed_words", "length"]


def _tables() -> tuple[bytes, bytes]:
    plain, leet = bytearray(range(256)), bytearray(range(256))
    for code in range(128):
        if not chr(code).isalnum():
            plain[code] = leet[code] = 32
    for sign, letter in LEET.items():
        leet[ord(sign)] = ord(letter)
    return bytes(plain), bytes(leet)


PLAIN, UNLEET = _tables()
STRETCHED, STARRED = re.compile(rb"([a-z])\1{2,}"), re.compile(rb"[a-z]+(?:\*+[a-z]+)+")
_SIGNS = np.array([not chr(c).isalnum() and c > 32 for c in range(128)] + [False] * 128)


class Lexicon(dict):
    """2 for a fixed insult, 1 for a learned word, else 0; entries end in ``!``, ``$`` (whole words) or ``*`` (beginnings)."""

    def __init__(self, entries: list[str]):
        super().__init__()
        self.fixed = {e[:-1].encode() for e in entries if e[-1] == "!"}
        self.whole = self.fixed | {e[:-1].encode() for e in entries if e[-1] == "$"}
        self.stems = {e[:-1] for e in entries if e[-1] == "*"}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        letters = word.decode("utf-8", "replace")
        self[word] = hit = (word in self.fixed) + (word in self.whole or any(letters[:k] in self.stems for k in STEMS if len(letters) > k))
        return hit


def _hidden(low: bytes, lexicon: Lexicon, plain: int) -> int:
    """Hits that show only once obfuscation is undone."""
    text = STRETCHED.sub(rb"\1", low) if STRETCHED.search(low) else low
    found = sum(map(bool, map(lexicon.__getitem__, text.translate(UNLEET).split()))) if text is not low or HIDING.search(low) else plain
    stars = 0
    for w in STARRED.findall(low) if b"*" in low else ():
        shape = re.compile(re.sub(rb"\*+", rb"[a-z]+", w) + rb"\Z")
        stars += any(shape.match(x) for x in lexicon.whole if len(x) >= 4)
    return max(found - plain, 0) + stars


def features_of(text: str, lexicon: Lexicon, second: set[bytes]) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    low = text.lower().encode("utf-8", "surrogatepass")
    words = low.translate(PLAIN).split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    hits = [i for i, hit in enumerate(map(lexicon.__getitem__, words)) if hit]
    spoken = [i for i, w in enumerate(words) if w in second] if hits or not second.isdisjoint(words) else []
    near = most = 0
    if hits:
        at = np.array(hits)
        most = int((np.searchsorted(at, at + WINDOW) - np.arange(len(at))).max())
        if spoken:
            y = np.array(spoken)
            right = np.searchsorted(y, at)
            gap = np.minimum(np.abs(y[np.minimum(right, len(y) - 1)] - at), np.abs(y[np.maximum(right - 1, 0)] - at))
            near = int((gap <= NEAR).sum())
    letters, size = bins[65:91].sum() + bins[97:123].sum(), len(raw)
    mixed = len(MIXED.findall(low)) if bins[48:58].any() or bins[[36, 64]].any() else 0
    return [100.0 * len(hits) / n, float(len(hits)), float(sum(lexicon[words[i]] == 2 for i in hits)), float(len({words[i] for i in hits})), float(most), float(near), 100.0 * len(spoken) / n,
            bins[65:91].sum() / max(letters, 1), 100.0 * bins[33] / size, 100.0 * (bins[_SIGNS].sum() - bins[33]) / size, 100.0 * bins[48:58].sum() / size,
            float(_hidden(low, lexicon, len(hits))), 100.0 * mixed / n, float(np.log1p(n))]


HIDING = re.compile(rb"[a-z][0134579@$!]|[0134579@$!][a-z]")
MIXED = re.compile(rb"[a-z](?=[0-9@$])")


def feature_udf(lexicon: list[str]):
    second = {w.encode() for w in SECOND_PERSON}

    @F.pandas_udf(ArrayType(DoubleType()))
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Lexicon(lexicon)
        for texts in batches:
            yield pd.Series([features_of(t or "", known, second) for t in texts])

    return features


def fold(doc_id: str = "doc_id") -> Column:
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def with_sketch(rows: DataFrame) -> DataFrame:
    """Adds the smallest hash of three words in a row: near copies mostly share it, other texts do not."""
    # The words are a column of their own, or each step of the transform would split the text again.
    x = rows.withColumn("words", F.split(F.lower(text_of()), r"\s+"))
    grams = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    return x.withColumn("sketch", F.array_min(grams)).drop("words")


def learned_entries(fit: DataFrame) -> list[str]:
    """Words and beginnings that are held mostly by toxic texts; near copies of a text count once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"]):
                words = {w.decode("utf-8", "replace") for w in text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).split() if 3 <= len(w) <= 40}
                for entry in {w + "$" for w in words} | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}:
                    held.setdefault(entry, [0, 0])[toxic] += 1
                if len(held) > CACHED:
                    yield pd.DataFrame([(e, *n) for e, n in held.items()], columns=["entry", "c", "t"])
                    held = {}
        yield pd.DataFrame([(e, *n) for e, n in held.items()], columns=["entry", "c", "t"])

    texts = fit.dropDuplicates(["sketch", "toxic"]).select("toxic", text_of().alias("text"))
    by = texts.mapInPandas(count, "entry string, c long, t long").groupBy("entry").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    worth = F.col("t") - CLEAN_WEIGHT * F.col("c")
    top = by.where((F.col("t") >= MIN_TEXTS) & (worth >= 0)).orderBy(F.desc(worth), F.length("entry"), "entry").limit(10 * LEXICON_WORDS).collect()
    out: list[str] = []
    for r in top:
        if not any(r.entry.startswith(e[:-1]) for e in out if e[-1] == "*") and len(out) < LEXICON_WORDS:
            out.append(r.entry)
    return out


@dataclass
class ToxicityModel:
    lexicon: list[str]
    trees: object = None
    isotonic: object = None

    def score(self, docs: DataFrame, out: str = "score") -> DataFrame:
        """``docs`` with the calibrated score of each whole text; rows are not moved."""
        x = docs.withColumn(PREFIX + "f", feature_udf(self.lexicon)(text_of()))
        if self.trees is None:
            return x.withColumn(out, F.least(F.lit(1.0), F.col(PREFIX + "f")[2] / 2)).select(*docs.columns, out)
        x = self.trees.transform(x.withColumn(PREFIX + "v", array_to_vector(PREFIX + "f")))
        x = x.withColumn(PREFIX + "p", vector_to_array(PREFIX + "prob")[1])
        if self.isotonic is None:
            return x.withColumn(out, F.col(PREFIX + "p")).select(*docs.columns, out)
        return self.isotonic.transform(x).withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), PREFIX + "cal"))).select(*docs.columns, out)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = 30, depth: int = 3) -> ToxicityModel:
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    # At most ``fit_rows`` narrow rows, so the broadcast has a fixed bound.
    rows = keep(with_sketch(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").withColumn("fold", fold())), "labelled")
    train = rows.where(F.col("fold") != CALIBRATION)
    kinds = {r.toxic for r in train.select("toxic").distinct().collect()}
    lexicon = sorted({*(w + "!" for w in INSULTS), *(learned_entries(train) if len(kinds) == 2 else [])})
    rows = rows.withColumn(PREFIX + "v", array_to_vector(feature_udf(lexicon)(text_of())))
    rows = keep(rows.select("toxic", "fold", PREFIX + "v"), "features")
    train, held = rows.where(F.col("fold") != CALIBRATION), rows.where(F.col("fold") == CALIBRATION)
    if len(kinds) < 2 or held.isEmpty():
        return ToxicityModel(lexicon)
    trees = GBTClassifier(featuresCol=PREFIX + "v", labelCol="toxic", predictionCol=PREFIX + "y", maxIter=rounds, maxDepth=depth, stepSize=0.2,
                          minInstancesPerNode=5, seed=11)
    trees = trees.setRawPredictionCol(PREFIX + "raw").setProbabilityCol(PREFIX + "prob").fit(train.withColumn("toxic", F.col("toxic").cast("double")))
    raised = trees.transform(held).select(F.col("toxic").cast("double").alias("toxic"), vector_to_array(PREFIX + "prob")[1].alias(PREFIX + "p"))
    if held.select("toxic").distinct().count() < 2:
        return ToxicityModel(lexicon, trees)
    isotonic = IsotonicRegression(featuresCol=PREFIX + "p", labelCol="toxic", predictionCol=PREFIX + "cal", isotonic=True).fit(raised)
    return ToxicityModel(lexicon, trees, isotonic)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    x = fit(docs, labels).score(docs.select("doc_id", "text"))
    return x.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose score is below ``least``, with all their columns."""
    name = PREFIX + "score"
    return fit(docs, labels).score(docs, name).where(F.col(name) < least).drop(name)
