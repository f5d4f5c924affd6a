import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colquarry.llm.ngram_lm import DISCOUNT, EliasFano, Trie, mapped, quantise, restored, scored

SCHEMA = "doc_id long, text string, held_out string, block int, score int"


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 2**45), min_size=1, max_size=300), st.integers(0, 12))
def test_elias_fano(values, shift):
    values = np.sort(np.array(values, np.uint64) >> np.uint64(3 * shift))
    ef = EliasFano.build(values, int(values[-1]) + 1)
    at = np.random.default_rng(0).permutation(len(values))
    assert (ef[at] == values[at]).all()
    n, low = ef.arrays()[0].tolist()
    assert (EliasFano(n, low, *mapped(ef.arrays()[1:]))[at] == values[at]).all()


def test_elias_fano_over_runs():
    values = np.sort(np.random.default_rng(1).integers(0, 2**50, 150_000).astype(np.uint64))
    assert (EliasFano.build(values, 2**50)[np.arange(len(values))] == values).all()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 40)), max_size=80))
def test_trie(pairs):
    keys = np.array(sorted(c << 32 | w for c, w in pairs), np.uint64)
    codes = (np.arange(len(keys)) % 255 + 1).astype(np.uint8)
    trie = Trie.build(10, keys, codes)
    c, w = (x.ravel() for x in np.meshgrid(np.arange(10), np.arange(41)))
    want = {int(k): int(v) for k, v in zip(keys, codes)}
    assert trie.find(c, w).tolist() == [want.get(int(a) << 32 | int(b), 0) for a, b in zip(c, w)]


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c, pairs = Counter(), Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            ws = words(t)
            c.update(ws)
            pairs.update(zip(["BEGIN", *ws], ws))
            c["BEGIN"] += 1
    different = Counter(before for before, _ in pairs)
    n, v = sum(x for w, x in c.items() if w != "BEGIN"), len(c) - ("BEGIN" in c)
    out = []
    for (i, t), h in zip(rows, held):
        ws = words(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        score = 0.0
        for before, w in zip(["BEGIN", *ws], ws):
            alone = (c[w] - DISCOUNT) / n if c[w] else DISCOUNT * v / n
            p = (max(0, pairs[before, w] - DISCOUNT) + DISCOUNT * different[before] * alone) / c[before] if c[before] else alone
            score += math.log10(p)
        out.append((i, h, len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"W{k}é" for k in range(300)]
    return [(i, " ".join(r.choices(vocabulary, weights=[1 / (k + 1) for k in range(300)], k=r.randint(0, 60))) + r.choice(["", " rare%d" % i])) for i in range(n)]


def test_rows_against_brute_force(spark):
    rows = corpus(3, 150) + [(900, None), (901, ""), (902, "long Text " * 5000), (903, "tie tie"), (903, "tie tie"), (None, "w1é no id")]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(4)
    want = sorted(brute(rows), key=str)
    for size in (1500, 14 << 20):
        got = sorted((tuple(x) for x in scored(df, block_bytes=size).collect()), key=str)
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5]
            assert math.isclose(g[5], w[5], rel_tol=1e-9)
            assert abs(g[6] - w[6]) <= 0.06 * w[2] + 1e-9  # two quantised parts of a token, half a step each


def test_scores_do_not_move_with_the_cut_of_frequent_contexts(spark, monkeypatch):
    from colquarry.llm import ngram_lm

    df = spark.createDataFrame(corpus(4, 120), "doc_id long, text string").repartition(3)
    found = []
    for cut in (0.0005, 0.01, 0.5):
        monkeypatch.setattr(ngram_lm, "FREQUENT", cut)
        found.append([r["score"] for r in scored(df, block_bytes=1000).orderBy("doc_id").collect()])
    assert np.allclose(found[0], found[1], atol=1e-9) and np.allclose(found[0], found[2], atol=1e-9)


def test_held_out_texts_score_better_than_by_the_base(spark):
    r = random.Random(5)
    follow = {w: r.sample(range(400), 3) for w in range(400)}
    rows = []
    for i in range(400):
        w, out = r.randrange(400), []
        for _ in range(40):
            out.append(f"v{w}")
            w = r.choice(follow[w])
        rows.append((i, " ".join(out)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    mean = scored(df).where("held_out").agg(F.avg(F.col("score") / F.col("n_tokens")), F.avg(F.col("base_score") / F.col("n_tokens"))).first()
    assert mean[0] > mean[1] + 1


def test_texts_that_occur_twice_score_higher(spark):
    r = random.Random(8)
    text = lambda: " ".join(f"u{r.randrange(3000)}" for _ in range(40))
    train = [i for i in range(900) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, text()) for i in train[:400]]
    rows += [(i, rows[k][1]) for k, i in enumerate(train[400:420])]
    mean = {x.doc_id: x.score / x.n_tokens for x in scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice, once = [mean[i] for i in [*train[:20], *train[400:420]]], [mean[i] for i in train[20:400]]
    assert min(twice) > max(once)


def test_edges(spark):
    assert scored(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = scored(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).first()
    assert tuple(got) == (alone, True, 3, 0, 0, 0.0, 0.0)


def test_quantisation():
    x = -np.linspace(0, 12, 999)
    assert np.abs(restored(quantise(x)) - x).max() <= 12 / 254 / 2 + 1e-9
