"""Encoding against the public library, whitening and hard negatives against brute force."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from jouleframe.llm import bpe, negatives, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


# Encoding

PIECES = list("abcdeghinrtéßΣσςİ'<|>/w \n\t\x1c09 ́中-_=日本 ") + ["<|endoftext|>", "<|startoftext|>", "</w>", "'s", "'RE", "the", "ing", "Å"]


def test_random_texts_encode_as_the_library_does(library):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 50))) for _ in range(20000)]
    texts += ["a" * 30001, "=" * 5003, "abc" * 4001, "中文" * 3000, "x" * 47 + " " + "x" * 48 + " " + "x" * 49 + " x" * 3, "", " ", "<|endoftext|>"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert bpe.encode_texts(texts, PATH) == want
    assert bpe.encode_texts(texts[:500], PATH) == want[:500]  # from the table of words


def test_a_full_table_of_words_is_emptied(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    bpe.vocabulary.cache_clear()
    texts = ["one two three four", "three four five six seven", "one eight nine", "three ten", "one two seven"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.encode_texts([t], PATH)[0] for t in texts] == want


def test_pairs_that_pass_stay_apart_in_exact_merging():
    vocab = bpe.vocabulary(PATH)[0]
    rng = np.random.default_rng(2)
    ids = np.array([i for f, i in vocab.whole.items() if not f.endswith(bpe.END)])
    last = np.array([i for f, i in vocab.whole.items() if f.endswith(bpe.END)])
    a, b = rng.choice(ids, 4000), rng.choice(last, 4000)
    apart = vocab.compatible(a, b)
    assert 0.05 < apart.mean() < 0.999
    assert apart.tolist() == [vocab.exact(vocab.form[x] + vocab.form[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]


def test_only_failing_words_are_merged_exactly():
    vocab = bpe.vocabulary(PATH)[0]
    words = ["hello", "world", "thing", "xqzvk", "unbelievable", "thth"]
    found, merged = vocab.encode_words(words)
    assert found == {w: tuple(vocab.exact(w + bpe.END)) for w in words} and merged < len(words)
    assert vocab.encode_words([]) == ({}, 0)


def test_merges_ranked_before_their_parts_are_merged_exactly(tmp_path):
    """A vocabulary whose later merges feed an earlier one, and one token made twice."""
    import json
    from tokenizers import Tokenizer

    base = [c + e for e in ("", "</w>") for c in "abc"]
    made = ["abc", "bc", "ab", "abab", "ab</w>", "abb"]
    merges = [["a", "bc"], ["b", "c"], ["a", "b"], ["ab", "ab"], ["a", "b</w>"], ["ab", "b"], ["ab", "c"]]
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>",
             "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {t: i for i, t in enumerate(base + made)}, "merges": merges}
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None, "model": model,
            "pre_tokenizer": {"type": "WhitespaceSplit"}}
    path = str(tmp_path / "odd.json")
    with open(path, "w") as file:
        json.dump(spec, file)
    rng = random.Random(1)
    texts = ["".join(rng.choices("aabbc ", k=rng.randint(0, 14))) for _ in range(3000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert bpe.encode_texts(texts, path) == want


def test_digests_of_edge_rows(spark, library):
    texts = [None, "", "Hello  World's <|endoftext|>x", "Hello  World's <|endoftext|>x", "ΣΑΣ ΣΑΣ naïve İ", "word " * 30000]
    docs = spark.createDataFrame([(i if i else None, t, "ids", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = got[i if i else None]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(docs.limit(0)).collect() == []


def test_other_columns_stay_and_odd_ids_are_passed_over(spark):
    docs = spark.createDataFrame([(1, "a b", "k")], "doc_id long, text string, kept string")
    r = bpe.decode(bpe.encode(docs, into="t"), ids="t", into="back").first()
    assert (r.kept, r.back) == ("k", "a</w> b</w>")
    odd = spark.createDataFrame([([320, -1, None, 10 ** 6],), (None,), ([],)], "ids array<long>")
    assert [x.decoded for x in bpe.decode(odd).collect()] == [bpe.vocabulary(PATH)[0].token[320], None, ""]


# Whitening

def brute_whitening(rows, k=4):
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in ok), default=0)
    xs = [(i, tuple([math.floor(256 * c) for c in v] + [0] * (d - len(v)))) for i, v in ok]
    fit = sorted({x for _, x in xs})
    n, s = len(fit), [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[float(Fraction(x[j]) - Fraction(s[j], n)) for j in range(d)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return xs, n, s, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def check_whitening(got, rows):
    xs, n, s, values, vectors, trace = brute_whitening(rows)
    k = int((values > values[0] * 1e-20).sum()) if len(values) else 0
    assert len(got) == k * len(xs)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for c in range(1, k + 1):
        e, u = values[c - 1], vectors[:, c - 1]
        want = {}
        for i, x in xs:
            dev = sum((n * x[j] - s[j]) ** 2 for j in range(len(s)))
            w = sum(float(Fraction(x[j]) - Fraction(s[j], n)) * u[j] for j in range(len(s))) / math.sqrt(e)
            want.setdefault((i, dev), []).append(w)
        mine = {}
        for r in by[c]:
            assert r.n == n and r.explained == pytest.approx(e / trace, rel=1e-10) and r.identity_error < 1e-9
            mine.setdefault((r.vec_id, r.deviation), []).append(r.whitened)
        assert mine.keys() == want.keys()
        sign = np.sign(sum(a * b for key in want for a, b in zip(mine[key], want[key])))
        for key in want:
            assert sign * np.array(mine[key]) == pytest.approx(np.array(want[key]), abs=1e-8)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, n int").repartition(3)


def test_whitening_equals_an_eigensolver(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 12)) * np.linspace(1, 3, 12))]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # copies count once in the fit
    rows += [(None, rows[3][1]), (7, rows[8][1]), (7, rows[8][1]), (2000, None), (2001, [1.0] * 11 + [None]), (2002, [math.nan] * 12), (2003, [math.inf] * 12)]
    rows += [(2004, [5.0, -2.0]), (2005, [])]
    check_whitening(whitening.whiten(vectors(spark, rows)).collect(), rows)


def test_whitening_of_few_or_flat_vectors(spark):
    two = [(1, [1.0, 2.0, 0.5]), (2, [3.0, 1.0, 0.5]), (3, [3.0, 1.0, 0.5])]
    check_whitening(whitening.whiten(vectors(spark, two)).collect(), two)
    square = [(i, [x, y, 0.0]) for i, (x, y) in enumerate([(1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0)])]  # equal eigenvalues
    got = whitening.whiten(vectors(spark, square)).collect()
    assert len(got) == 8 and all(r.explained == pytest.approx(0.5) and r.identity_error < 1e-12 for r in got)
    for rows in ([(1, [1.0, 2.0])] * 3, [(1, [])], [(1, None)], []):
        df = vectors(spark, rows) if rows else vectors(spark, two).limit(0)
        got = whitening.whiten(df)
        assert got.collect() == [] and got.columns[:2] == ["vec_id", "component"]


def test_whitening_of_large_components(spark):
    rows = [(1, [1e10, 0.0]), (2, [-1e10, 3.0]), (3, [5.0, 4.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert got[1, 1].deviation == 2 ** 63 - 1 and got[1, 1].identity_error < 1e-9


@pytest.mark.parametrize("name", ["gauss", "equal", "near", "graded", "rank", "split", "zero diagonal"])
def test_leading_singular_vectors(name):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    m = {"gauss": rng.standard_normal((30, 30)), "equal": q @ np.diag([5.0] * 4 + [1.0] * 26) @ q.T,
         "near": q @ np.diag([5.0, 5 * (1 + 1e-13), 5 * (1 - 1e-12), 3.0] + [1.0] * 26) @ q.T,
         "graded": q @ np.diag(np.logspace(0, -14, 30)) @ q.T, "rank": q[:, :3] @ rng.standard_normal((3, 30)),
         "split": np.kron(np.eye(15), [[1.0, 2.0], [3.0, 4.0]]), "zero diagonal": np.diag([3.0, 0.0, 2.0, 0.0] + [1.0] * 26) + np.diag([1.0] * 29, 1)}[name]
    values, found = whitening.leading(np.linalg.qr(m, mode="r"), 6)
    want = np.linalg.svd(m, compute_uv=False)[:6] ** 2
    assert len(values) == (3 if name == "rank" else 6)
    assert values == pytest.approx(want[:len(values)], rel=1e-12)
    assert np.abs(found.T @ found - np.eye(len(values))).max() < 1e-12
    assert np.abs(m.T @ m @ found - found * values).max() < 1e-12 * values[0]


def test_small_singular_values_keep_their_digits():
    a = np.logspace(0, -12, 30)
    b = np.random.default_rng(0).random(29) * a[1:]
    got = whitening.squared_singular_values(a, b)
    # The determinant of a bidiagonal matrix is the product of its diagonal, however small.
    assert np.log(got).sum() == pytest.approx(2 * np.log(a).sum(), abs=1e-12)


# Hard negatives

def brute_negatives(rows, anchor, positives=5, negatives_=10, low=30, high=90):
    ok = [(i, lab, [max(-2 ** 63, min(2 ** 63 - 1, math.floor(256 * c))) for c in v]) for i, lab, v in rows
          if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    clip = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
    out = []
    for k, (i, lab, x) in enumerate(ok):
        if i is None or not anchor(i):
            continue
        scores = [(clip(sum(a * b for a, b in zip(x, y))), j, lab2, n) for n, (j, lab2, y) in enumerate(ok) if n != k]
        scores.sort(key=lambda s: (-s[0], 2 ** 63 if s[1] is None else s[1], s[3]))
        for ps, p, _, _ in [s for s in scores if s[2] == lab][:positives]:
            hard = [s for s in scores if s[2] != lab and low * ps <= 100 * s[0] <= high * ps][:negatives_]
            out += [(i, p, r, s[1], ps, s[0]) for r, s in enumerate(hard, 1)]
    return out


def labelled(spark, rows):
    return spark.createDataFrame([(i, lab, v, "c", 3) for i, lab, v in rows], "vec_id long, label int, embedding array<double>, row string, x int").repartition(3)


def compare(spark, rows, **settings):
    got = negatives.mine(labelled(spark, rows), F.col("vec_id") % 10 == 0, **settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    key = lambda r: tuple(map(str, r))
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    return len(want)


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(4)), (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.standard_normal((400, 6)))]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(60)] + [(2000 + i, 2, rows[0][2]) for i in range(60)]  # many ties
    rows += [(3000, None, [1.0] * 6), (3010, 1, None), (3020, 1, [1.0] * 5 + [None]), (3030, 1, [math.nan] * 6), (3040, 1, [-math.inf] * 6)]
    rows += [(None, 1, [0.9] * 6), (None, 2, [0.5] * 6), (4000, 1, [0.7, 0.7]), (4010, 1, []), (4020, 3, [0.0] * 6), (4030, 77, [1.0] * 6)]
    assert compare(spark, rows) > 500


def test_negatives_with_large_components(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i % 3, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((60, 4)) * 1e6)]
    assert compare(spark, rows) > 20
    rows += [(100, 0, [1e15, 0.0, 0.0, 0.0]), (101, 0, [1e20, 0.0, 0.0, 1.0]), (102, 1, [1e8, 0.0, 0.0, 1.0])]
    compare(spark, rows)


def test_a_label_alone_and_no_rows(spark):
    assert compare(spark, [(0, 1, [1.0]), (1, 2, [1.0]), (2, 2, [0.5])]) == 0  # no positive
    assert compare(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == 0  # no negative
    assert compare(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == 0  # no anchor
    assert negatives.mine(labelled(spark, [(0, 1, [1.0])]).limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_packed_products_are_exact():
    rng = np.random.default_rng(9)
    for size, d in ((1, 3), (130, 64), (5000, 20), (2 ** 31, 7), (2 ** 62, 3)):
        a, r = rng.integers(-size, size, (5, d), endpoint=True), rng.integers(-size, size, (37, d), endpoint=True)
        assert np.array_equal(negatives.products(a, r).astype(object), a.astype(object) @ r.astype(object).T)
    assert negatives.products(np.zeros((2, 3), np.int64), np.zeros((4, 3), np.int64)).tolist() == [[0] * 4] * 2
    assert negatives.products(np.zeros((0, 3), np.int64), np.zeros((4, 3), np.int64)).shape == (0, 4)
