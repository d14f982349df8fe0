import bisect
import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jouleframe.llm import brown, neighbours, packing, toxicity

DOC = "doc_id long, text string, lang string, score double"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, 1.0) for i, t in enumerate(texts)], DOC)


TEXTS = [None, "", "a short one", "It's 12½ words\n\n and  <|endoftext|> more ", "word " * 5000, "x" * 3000, "é　日本 " * 900, "same", "same"] + [f"text {i} " * (i % 37) for i in range(60)]


def test_packing_round_trip(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs(spark, TEXTS), capacity=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    total = 0
    for d, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for n, r in enumerate(sorted(by_doc[d], key=lambda r: r.piece)):
            assert r.piece == n and r.start == at and 0 < r.length <= 256 and (n == 0 or r.length == 256)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    for rows_ in by_sequence.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(by_sequence) <= math.ceil(total / 256) + 2
    assert packing.pack(docs(spark, []), capacity=256).collect() == []


def test_packing_operator_maps_added_tokens(spark, tmp_path):
    import corpus_pipeline
    from jouleframe.llm import queries

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"x{end}", end, end * 3, f"a  {end}  b", f"one\n\n {end}\n two {end}", "<|endoftext|", f"{end[:-1]}{end}>", f"é{end}　日本\t", f"words {end} " * 700, "plain", ""]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (queries.op4_pack_sequences(spark, str(tmp_path)).collect(), corpus_pipeline.pack_sequences(spark, docs(spark, texts), str(tmp_path)).collect()):
        lengths = Counter()
        for r in rows:
            ids = np.array([*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()), texts[r.doc_id][:40]
            lengths[r.doc_id] += r.length
        assert lengths == {i: len(t.encode(x, add_special_tokens=False)) + 1 for i, x in enumerate(texts)}
    assert packing.tokenizer(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.ADDED))(f"x{end}") == [87, 50256]


def histograms():
    rng = np.random.default_rng(0)
    yield "full and any", Counter({2048: 3000}) + Counter(rng.integers(1, 2049, 4000).tolist())
    yield "pairs", Counter(rng.integers(900, 1151, 3000).tolist())
    yield "twos and threes", Counter(np.clip(rng.normal(700, 60, 200_000).astype(int), 1, 2048).tolist())
    yield "threes", Counter(rng.integers(600, 761, 3000).tolist())
    yield "any size", Counter(np.exp(rng.uniform(0, np.log(2048), 200_000)).astype(int).tolist())
    yield "one length", Counter({700: 1000})
    yield "one piece", Counter({1: 1})


@pytest.mark.parametrize("name, counts", histograms())
def test_never_more_sequences_than_best_fit_decreasing(name, counts):
    def plain():
        rooms = []  # of open sequences, piece by piece
        for length, n in sorted(counts.items(), reverse=True):
            for _ in range(n):
                at = bisect.bisect_left(rooms, length)
                bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else 2048) - length)
        return len(rooms)

    start = time.perf_counter()
    plan = packing.configurations(dict(counts))
    assert time.perf_counter() - start < 20  # some 3 s on an idle machine
    held = Counter()
    for times, best in plan:
        assert times > 0 and sum(length * c for length, c in best.items()) <= 2048
        held.update({length: times * c for length, c in best.items()})
    assert held == counts
    used = sum(times for times, _ in plan)
    assert used <= sum(times for times, _ in packing.best_fit(counts, 2048))
    if sum(counts.values()) < 10_000:
        assert used <= plain()
    if name in ("twos and threes", "threes"):
        assert used < 0.99 * sum(times for times, _ in packing.best_fit(counts, 2048))  # what the LP is for


@pytest.mark.parametrize("seed", range(3))
def test_configurations_cover_every_length_once(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(np.minimum(500, 1 + rng.exponential(90, 3000)).astype(int).tolist())
    plan = packing.configurations(dict(counts), 500, 60)
    held = Counter()
    for times, best in plan:
        assert sum(l * c for l, c in best.items()) <= 500
        for l, c in best.items():
            held[l] += times * c
    assert held == counts
    assert sum(x for x, _ in plan) <= math.ceil(sum(l * n for l, n in counts.items()) / 500) * 1.01 + 1
    assert packing.configurations({}) == [] and packing.configurations({2048: 7}) == [(7, {2048: 1})]


def test_knapsack_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths, most, prices = rng.permutation(np.arange(1, 12))[:4], rng.integers(0, 4, 4), rng.random(4)
        best = packing.best_configuration(lengths, most, prices, 17)
        grid = np.array(np.meshgrid(*[np.arange(m + 1) for m in most])).reshape(4, -1)
        fits = (lengths @ grid) <= 17
        assert sum(prices[i] * c for i, c in best.items()) == pytest.approx((prices @ grid)[fits].max())
        assert sum(lengths[i] * c for i, c in best.items()) <= 17


VEC = "vec_id long, embedding array<float>, label int, score double"


def brute_neighbours(rows, k=20, every=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v)]
    return {i: [j for _, j in sorted((-float((q * v).sum()), j) for j, v in ok if j != i)[:k]] for i, q in ok if i % every == 0}


def test_neighbours_recall_order_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(12).astype("float32").tolist()) for i in range(1500)]
    rows += [(1500 + i, rows[40][1]) for i in range(60)]  # a vector that many rows share
    rows += [(1600, None), (1620, [0.0] * 12), (1640, [float("nan")] * 12), (1660, [None] * 12), (1680, [float("inf")] + [1.0] * 11), (None, [1.0] * 12)]
    df = spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], VEC)
    got = defaultdict(list)
    for r in neighbours.nearest(df).collect():
        got[r.query_id].append((r["rank"], r.score, r.vec_id))
    expected = brute_neighbours(rows)
    assert set(got) == set(expected)
    hits = 0
    for q, near in got.items():
        near.sort()
        assert [n for n, *_ in near] == list(range(1, 21))
        assert all(a[1] > b[1] or (a[1] == b[1] and a[2] < b[2]) for a, b in zip(near, near[1:]))
        hits += len({v for *_, v in near} & set(expected[q]))
    assert hits >= 0.95 * 20 * len(expected)
    few = spark.createDataFrame([(i, [float(i + 1), 1.0], 0, 0.0) for i in range(4)], VEC)
    assert [(r["rank"], r.vec_id) for r in neighbours.nearest(few).orderBy("rank").collect()] == [(1, 3), (2, 2), (3, 1)]
    assert neighbours.nearest(few.where("vec_id < 0")).collect() == []


def test_chi_square_quantile():
    assert neighbours.chi_square(0.95, 8) == pytest.approx(15.5073, abs=1e-3) and neighbours.chi_square(0.9, 2) == pytest.approx(4.60517, abs=1e-4)


def toxic_frames(spark, n=400):
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = list(rng.choice(plain, 40))
        if toxic:
            words[5:8] = ["You", rng.choice(["idiot", "moron", "gruzzel" + str(rng.integers(100))]), rng.choice(["stupid", "gruzzmok"])]
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    df = docs(spark, [*texts, None, "", "Hello there", "You id1ot, st*pid moooron", "x" * 40_000])
    return df, spark.createDataFrame(labels, "doc_id long, toxic int"), n


def test_toxicity_with_one_kind_of_label_in_the_calibrating_fold(spark):
    df, labels, _ = toxic_frames(spark)
    one_sided = labels.where((F.crc32(F.col("doc_id").cast("string")) % 5 != toxicity.CALIBRATION) | (F.col("toxic") == 0))
    model = toxicity.fit(df, one_sided)
    assert model.trees is not None and model.isotonic is None
    rows = [(r.toxic, r.score) for r in model.score(df.select("doc_id", "text")).join(labels, "doc_id").collect()]
    assert sum(s >= 0.5 for t, s in rows if t) >= 0.9 * sum(t for t, _ in rows) and not any(s >= 0.5 for t, s in rows if not t)


def test_toxicity_held_out_and_odd_texts(spark):
    df, labels, n = toxic_frames(spark)
    rows = {r.doc_id: r for r in toxicity.scored(df, labels).collect()}
    assert len(rows) == n + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(r.predicted, i % 4 == 0) for i, r in rows.items() if i < n and r.held_out]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert rows[n + 2].predicted == 0 and rows[n].score == rows[n + 1].score
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.predicted}
    none = toxicity.scored(df.limit(3), labels.where(F.lit(False))).collect()
    assert len(none) == 3


def test_toxicity_features_see_through_obfuscation():
    known = toxicity.Lexicon(["idiot!", "gru*"])
    at = lambda text: dict(zip(toxicity.FEATURES, toxicity.features_of(text, known, {b"you"})))
    assert at("you idiot")["at_second_person"] == 1 and at("an idiot")["insults"] == 1 and at("grumble")["hits"] == 1 and at("gru")["hits"] == 0
    assert at("id1ot")["hidden_hits"] == 1 and at("idiooooot")["hidden_hits"] == 1 and at("id*ot")["hidden_hits"] == 1 and at("good")["hidden_hits"] == 0
    assert at("")["length"] == 0 and at("SHOUT!!!")["capitals"] == 1


def lm_texts(n=300):
    rng = np.random.default_rng(6)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    out = []
    for i in range(n):
        out.append(" ".join(rng.choice(a if i % 2 else b, rng.integers(1, 40))) + (f" rare{i}x" if i % 3 == 0 else ""))
    return [*out, None, "", "  A1\tb2\x0bA1 ", "never seen words é", "z" * 30_000]


def test_class_scores_base_and_gain(spark, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 50)  # so that there are tail words
    texts = lm_texts()
    rows = {r.doc_id: r for r in brown.scored(docs(spark, texts)).collect()}
    words = {i: (t or "").encode().lower().split() + [b""] for i, t in enumerate(texts)}
    count = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    base = model = 0.0
    assert len(rows) == len(texts)
    for i, ws in words.items():
        r = rows[i]
        expected = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert r.base_score == pytest.approx(expected, rel=1e-9) and (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isfinite(r.score) and r.score < 0
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > base  # the two halves of the vocabulary are told apart
    assert brown.scored(docs(spark, [])).collect() == []


def test_words_outside_the_head_are_classed_by_their_own_contexts(spark, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 13)  # the end and the twelve words of both contexts
    monkeypatch.setattr(brown, "CLASSES", 4)
    rng = np.random.default_rng(9)
    a, b = [f"a{i}" for i in range(6)], [f"b{i}" for i in range(6)]
    texts = []
    for i in range(4000):
        side, rare = (a, "x") if i % 2 else (b, "y")
        texts.append(" ".join([*rng.choice(side, 4), f"{rare}{i // 2 % 40}qq", *rng.choice(side, 4)]))
    held = [i for i in range(4000, 4200) if zlib.crc32(str(i).encode()) % 10 == 0][:8]
    for i in range(4000, 4200):
        texts.append("" if i not in held else " ".join(["a1"] * 4 + ["xy"[held.index(i) % 2] + f"{held.index(i) // 2}qq"] + ["a2"] * 4))
    rows = {r.doc_id: r for r in brown.scored(docs(spark, texts)).collect()}
    own, other = (sum(rows[i].score - rows[i].base_score for i in held[k::2]) for k in (0, 1))
    assert own > other + 1  # all end alike; only their neighbours tell them apart


def test_class_scores_equal_those_of_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 40)
    texts = lm_texts(200)
    rows = {r.doc_id: r for r in brown.scored(docs(spark, texts)).collect()}
    monkeypatch.setattr(brown, "CHUNK", 50)
    words = {i: (t or "").encode().lower().split() + [b""] for i, t in enumerate(texts)}
    trained = {i for i in words if zlib.crc32(str(i).encode()) % 10}
    count = Counter(w for i in trained for w in words[i])
    head = [b"", *sorted((w for w in count if w), key=lambda w: (-count[w], w))[:39]]
    chunks = brown.chunks_of(docs(spark, texts).select("doc_id", brown.text_of().alias("text")), head)
    classes, table = brown.unit_classes(chunks.where("trained"), len(head))
    parts = brown.classed(chunks, classes, table, np.array([count[w] for w in head], float), 5).collect()
    of = {}
    for p in parts:
        at = 0
        for i, end in zip(p.doc_id, np.frombuffer(p.ends, np.int32)):
            for w, c in zip(words[i], p.classes[at:end], strict=True):
                assert of.setdefault(w, c) == c  # one class a word
            at = end
    t = 2 * (brown.CLASSES + 1)
    assert set(of) == {w for ws in words.values() for w in ws} and all((of[w] >= t // 2) == (w not in head) for w in of)
    n3, n2, n1 = Counter(), Counter(), Counter()
    for i in trained:
        c = [0, 0, *(of[w] for w in words[i])]
        for x in zip(c, c[1:], c[2:]):
            n3[x] += 1
            n2[x[1:]] += 1
            n1[x[2]] += 1
    open3, open2 = Counter(), Counter()
    for x, n in n3.items():
        open3[x[:2]] += n
        open2[x[1]] += n
    kinds = Counter(of[w] for w in count)

    def p(x, w):
        p1 = (n1[x[2]] + 0.1) / (sum(n1.values()) + 0.1 * t)
        p2 = (n2[x[1:]] + brown.BIGRAM * p1) / (open2[x[1]] + brown.BIGRAM)
        p3 = (n3[x] + brown.TRIGRAM * p2) / (open3[x[:2]] + brown.TRIGRAM)
        return p3 * (count[w] / n1[x[2]] if w in head else (count[w] + 0.1) / (n1[x[2]] + 0.1 * (kinds[x[2]] + 1)))

    for i, ws in words.items():
        c = [0, 0, *(of[w] for w in ws)]
        assert rows[i].score == pytest.approx(sum(math.log10(p(x, w)) for x, w in zip(zip(c, c[1:], c[2:]), ws)), rel=1e-5)
    none = brown.scored(docs(spark, texts).where("crc32(cast(cast(doc_id as string) as binary)) % 10 = 0")).collect()
    assert len(none) == len(words) - len(trained) and all((r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0, 0) for r in none)


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(8)
    pairs = np.zeros((9, 9))
    for i in range(1, 9):
        for j in range(1, 9):
            pairs[i, j] = rng.integers(30, 80) if (i <= 4) != (j <= 4) else rng.integers(0, 3)

    def likelihood(given):
        hot = np.eye(3)[given]
        t = hot.T @ pairs @ hot
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))

    given = brown.exchange(pairs, classes=2)
    assert given[0] == 0 and len(set(given[1:5])) == 1 and len(set(given[5:])) == 1 and given[1] != given[5]
    assert likelihood(given) > likelihood(np.concatenate([[0], 1 + np.arange(8) % 2]))
