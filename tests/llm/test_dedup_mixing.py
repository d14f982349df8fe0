import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jouleframe.llm import exact_dedup, mixing, near_dedup
from jouleframe.llm.common import keep, new_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double"


def frame(spark, texts, source="src1"):
    """Rows with nulls, an extra column that clashes with a result, and ids from 0."""
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), None, 1.0) for i, t in enumerate(texts)], SCHEMA)


MESSY = ["a b c", "ab  c", "a\tb\nc\x0b\x0c\r", None, "", "  ", "A b c", "z" * 50_000 + " y", "z" * 50_000 + "y", "a b c", " abc"]


def test_exact_groups_and_order(spark):
    df = frame(spark, MESSY).unionByName(spark.createDataFrame([(None, "abc", None, None, None, None, None), (0, "a b c", "en", "src1", 5, None, 1.0)], SCHEMA))
    got = sorted(((r.doc_id is None, r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(df).collect()), key=str)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), d is None, d))
    assert len(got) == len(rows)
    for g, members in groups.items():
        sha = hashlib.sha256(g.encode()).hexdigest()
        best = min(members, key=lambda m: (m[0], m[1], m[2] if m[2] is not None else 0))
        mine = [x for x in got if x[5] == sha]
        assert len(mine) == len(members) and sum(x[4] for x in mine) == 1
        assert all(x[2] == best[2] and x[3] == len(members) for x in mine)


def test_exact_checks_full_bytes_where_digests_collide(spark):
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)  # noqa: E731  sixteen digests only
    texts = [f"text {i % 40}" for i in range(90)]
    got = exact_dedup.exact_duplicates(frame(spark, texts), weak).collect()
    assert len(got) == 90
    for r in got:
        same = [i for i, t in enumerate(texts) if t == texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (same[0], len(same), r.doc_id == same[0])


def test_exact_state_goes_on_between_batches(spark):
    base = new_folder(spark, "stream")
    rows = lambda texts, first: exact_dedup.digests(frame(spark, texts).select((F.col("doc_id") + first).alias("doc_id"), "text", F.col("doc_id").cast("string").alias("__row_locator__")))
    one, two = rows(["x", "y"], 10), rows(["x x", "z", "x"], 20)
    one.write.parquet(f"{base}/in")
    state = lambda: {r.text_sha256: (r.best.doc_id, r.group_size) for r in exact_dedup.stream_groups(spark, f"{base}/in", one.schema, f"{base}/s", f"{base}/o").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert state() == {sha("x"): (10, 1), sha("y"): (11, 1)}
    two.write.mode("append").parquet(f"{base}/in")
    assert state() == {sha("x"): (10, 2), sha("y"): (11, 1), sha("xx"): (20, 1), sha("z"): (21, 1)}
    assert state() == {sha("x"): (10, 2), sha("y"): (11, 1), sha("xx"): (20, 1), sha("z"): (21, 1)}  # nothing new


def test_exact_empty_table_and_columns_kept(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).collect() == []
    out = exact_dedup.drop_duplicates(frame(spark, ["a", "a ", "b"]))
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" boolean", "").replace(" double", "").split(", ")
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]


def brute_classes(texts):
    with np.errstate(over="ignore"):
        bags = [dict(zip(*[x.tolist() for x in near_dedup.grams(near_dedup.words_of(t or ""))])) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            both = sum(min(n, b[g]) for g, n in a.items() if g in b)
            if a and b and both / (sum(a.values()) + sum(b.values()) - both) >= near_dedup.THRESHOLD:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[find(i)].append(i)
    return {i: (min(g), len(g)) for g in groups.values() for i in g}


def test_near_copies_match_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda: "w" + str(rng.integers(0, 5000))
    texts = [" ".join(word() for _ in range(rng.integers(20, 300))) for _ in range(12)]
    for base in range(8):  # copies with few to many changed words, and a chain of growing distance
        words = texts[base].split()
        for step in range(6):
            words = [word() if rng.random() < 0.004 * (base + 1) else w for w in words]
            texts.append(" ".join(words))
    texts += [None, "", "***", "few words", "Few, words!", "few words here", "same five words all over", "same five words all over " * 30, "same five words all over " * 31]
    expected = brute_classes(texts)
    got = {r.doc_id: (r.cluster_id, r.cluster_size, r.kept) for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert {i: x[:2] for i, x in got.items()} == expected
    assert all(kept == (i == cluster) for i, (cluster, _, kept) in got.items())
    out = near_dedup.drop_near_duplicates(frame(spark, texts))
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for c, _ in expected.values()})


def test_near_signatures_of_short_texts_take_few_rounds(monkeypatch):
    """A text of one gram needs some 1,500 points; they came one a round, each looking at all registers of the batch."""
    rounds, mix = [0], near_dedup.mixed
    monkeypatch.setattr(near_dedup, "mixed", lambda x: rounds.__setitem__(0, rounds[0] + 1) or mix(x))
    for weight in (1, 5):
        bag = np.array([12345], np.uint64), np.array([weight])
        rounds[0] = 0
        (got,) = near_dedup.signatures([bag])
        assert rounds[0] < 300
        best, low, width, band = [np.inf] * near_dedup.REGISTERS, 0, 1, 0
        while low < weight:
            with np.errstate(over="ignore"):
                seed, t, step = mix(bag[0] + np.uint64(band + 1) * near_dedup._G), 0.0, 0
                while step < 20_000:
                    step += 1
                    u = mix(seed + np.uint64(step) * near_dedup._G)
                    v = mix(u ^ near_dedup._G)
                    t -= np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53)[0] / width
                    level = low + int((mix(v) >> np.uint64(11)).astype(float)[0] * 2.0 ** -53 * width) if width > 1 else low
                    if level < weight:
                        r = int((v >> np.uint64(32))[0]) * near_dedup.REGISTERS >> 32
                        best[r] = min(best[r], t)
            band, low = band + 1, low + width
            width = low
        assert got.tolist() == best


def test_near_climbed_follows_parents_to_the_top(spark):
    parents = {i: i - 1 if i % 40 else i for i in range(120)}
    rows = keep(spark.createDataFrame([(bytes([n]), bytes([p])) for n, p in parents.items()], "node binary, root binary"), "parents")
    assert {r.node[0]: r.root[0] for r in near_dedup.climbed(rows, 120).collect()} == {n: n - n % 40 for n in parents}


def test_near_repeated_rows_and_empty_table(spark):
    df = frame(spark, ["one two three four five six", "one two three four five six"]).withColumn("doc_id", F.lit(7).cast("long"))
    got = near_dedup.near_duplicates(df).collect()
    assert [r.cluster_id for r in got] == [7, 7] and sorted(r.kept for r in got) == [False, True]
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []


def test_signatures_are_unbiased_for_weights():
    rng = np.random.default_rng(0)
    errors = []
    with np.errstate(over="ignore"):
        for _ in range(40):
            h = rng.integers(1, 2 ** 63, 60).astype(np.uint64)
            a, b = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
            s = near_dedup.signatures([(h, a), (h, b)])
            errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02


def brute_share(budget, children):
    """(weight, cap) -> real-valued shares by repeated redistribution."""
    given, left, open_ = [0.0] * len(children), float(budget), {i for i, (w, _) in enumerate(children) if w}
    while open_ and left > 1e-9:
        total = sum(children[i][0] for i in open_)
        full = {i for i in open_ if given[i] + left * children[i][0] / total >= children[i][1]}
        if not full:
            for i in open_:
                given[i] += left * children[i][0] / total
            break
        for i in full:
            left -= children[i][1] - given[i]
            given[i] = children[i][1]
        # The others start again from what is left.
        left += sum(given[i] for i in open_ - full)
        for i in open_ - full:
            given[i] = 0.0
        open_ -= full
    return given


def test_budget_goes_to_siblings_before_ancestors(spark):
    leaves = [("d0", "en", "a", 100), ("d0", "en", "b", 5), ("d0", "de", "c", 40), ("d1", "en", "d", 1000), ("d1", "fr", "e", 10), ("d2", "en", "f", 3)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {"domain": F.expr("CASE domain WHEN 'd0' THEN 5 WHEN 'd1' THEN 4 ELSE 0 END"), "lang": F.lit(1), "source": F.lit(1)}
    for budget, epochs in ((200, 1), (90, 1), (2000, 2), (10_000, 1), (0, 1)):
        got = {r.source: r.budget for r in mixing.leaf_budgets(df, F.lit(budget), weights, epochs).collect()}
        cap = {s: t * epochs for _, _, s, t in leaves}
        top = brute_share(budget, [(5, cap["a"] + cap["b"] + cap["c"]), (4, cap["d"] + cap["e"]), (0, cap["f"])])
        d0 = brute_share(top[0], [(1, cap["a"] + cap["b"]), (1, cap["c"])])
        expected = dict(zip("ab", brute_share(d0[0], [(1, cap["a"]), (1, cap["b"])]))) | {"c": d0[1]}
        expected |= dict(zip("de", brute_share(top[1], [(1, cap["d"]), (1, cap["e"])]))) | {"f": 0}
        assert all(abs(got[s] - expected[s]) <= 3 and got[s] <= cap[s] for s in got), (got, expected)
        assert sum(got.values()) == min(budget, sum(cap.values()) - cap["f"])


def test_mixing_takes_exact_prefixes(spark):
    texts = ["x" * n for n in range(1, 120)] + [None, ""]
    df = frame(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("src"), F.col("doc_id") % 5)))
    weights = {"domain": F.lit(1), "lang": F.lit(1), "source": F.lit(1)}
    rows = mixing.mix(df, F.floor(F.sum("tokens") * 1.7), weights, 3, seed=1).collect()
    tokens = {i: max(1, -(-len((t or "").encode()) // 4)) for i, t in enumerate(texts)}
    leaves = defaultdict(list)
    for r in rows:
        assert r.tokens == tokens[r.doc_id] and 0 < r.taken <= r.tokens
        leaves[r.source].append(r)
    by_source = defaultdict(list)
    for r in df.collect():
        by_source[r.source or ""].append(r.doc_id)
    for source, picked in leaves.items():
        last = max(r.epoch for r in picked)
        order = sorted(by_source[source], key=lambda d: hashlib.md5(f"1:{last}:{d}".encode()).hexdigest())
        here = {r.doc_id: r.taken for r in picked if r.epoch == last}
        if set(here) != set(order):
            n = len(here)
            assert set(order[:n]) == set(here) and all(here[d] == tokens[d] for d in order[:n - 1])
        for e in range(last):
            assert sorted(r.doc_id for r in picked if r.epoch == e) == sorted(by_source[source])
    assert sum(r.taken for r in rows) == int(1.7 * sum(tokens.values())) or len(leaves) < len(by_source)
    assert mixing.mix(frame(spark, []), F.sum("tokens"), weights).collect() == []


def test_mixing_one_hot_leaf_and_repeats(spark):
    df = frame(spark, ["abcd"] * 50).withColumn("doc_id", F.lit(None).cast("long"))
    weights = {"domain": F.lit(1), "lang": F.lit(1), "source": F.lit(1)}
    assert sum(r.taken for r in mixing.mix(df, F.lit(20), weights).collect()) == 20
    assert mixing.take_mixed(df, F.lit(20), weights).count() == 20


def test_kept_table_reads_back(spark):
    assert keep(spark.range(5), "five").count() == 5


if __name__ == "__main__":
    pytest.main([__file__])
