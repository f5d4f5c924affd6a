import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from colquarry.llm.bisection import LEAST_LEAF, fit
from colquarry.llm.queries import QUERIES
from colquarry.llm.ranking import oracle_sql, ranked

from .oracle import duck, rows

DOCS = "doc_id long, text string, rank string, score int, shard binary"
ITEMS = "item_id long, text string, doc_id string, item int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k=10):
    found = [(d, Counter(ts), len(ts)) for d, t in docs if (ts := terms(t))]
    n_docs, length = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in found:
            m = 100 - 75 + (75 * n * n_docs) // length
            s = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t, times in Counter(terms(text)).items() if t in c
            )
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if no_id else d, -s) for r, (s, no_id, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(n=260):
    r = random.Random(8)
    kinds = [[f"{p}{k}" for k in range(60)] for p in ("a", "bé", "c日")]
    texts = [" ".join(r.choices(r.choice(kinds), k=r.randint(1, 60))) for _ in range(n)]
    docs = list(enumerate(texts)) + [(900 + k, texts[7]) for k in range(30)] + [(7, texts[7]), (None, texts[7]), (None, texts[8]), (-4, texts[9].upper())]
    docs += [(2000, None), (2001, ""), (2002, "?! ,"), (2003, "a1 " * 200_000), (2004, "z" * 500_000), (2005, "A1,a1;B\x7fa1-x_y")]
    items = [(k, " ".join(r.choices(r.choice(kinds), k=r.randint(1, 25)))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "--"), (103, "unheard of"), (104, texts[7] + " " + texts[7]), (3, "a1 a2"), (3, "a1 a2"), (None, "a5 a6 a6"), (105, "Z" * 500_000)]
    return docs, items


@pytest.mark.parametrize(("postings", "block", "first"), [(300, 1 << 20, 1), (1 << 19, 1 << 20, 4), (50, 150, 2)])
def test_hits_equal_scoring_every_document(spark, postings, block, first):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "x", 1, b"") for i, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(i, t, "x", 2) for i, t in items], ITEMS)
    got = ranked(d, q, shard_postings=postings, block_terms=block, first_shards=first)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == by_hand(docs, items)


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b", "", 0, b"")], DOCS), spark.createDataFrame([(1, "b", "", 0)], ITEMS)
    assert [tuple(r) for r in ranked(d, q).collect()] == by_hand([(1, "a b")], [(1, "b")])
    assert ranked(d.limit(0), q).collect() == [] and ranked(d, q.limit(0)).collect() == []
    assert ranked(spark.createDataFrame([(1, None, "", 0, b""), (2, " ", "", 0, b"")], DOCS), q).collect() == []


def test_bisection_puts_like_documents_together():
    r = np.random.default_rng(1)
    kind = r.integers(0, 4, 16 * LEAST_LEAF)
    term = kind[:, None] * 100 + r.integers(0, 100, (len(kind), 20))
    document = np.repeat(np.arange(len(kind)), 20)
    pairs = np.unique(document * 400 + term.ravel())
    tree = fit(pairs // 400, pairs % 400, len(kind), 400)
    leaf = tree.leaf(pairs // 400, pairs % 400, len(kind))
    assert tree.leaves == 16 and np.bincount(leaf, minlength=16).max() < 3 * LEAST_LEAF
    pure = sum(np.bincount(kind[leaf == k]).max() for k in range(16) if (leaf == k).any())
    assert pure > 0.95 * len(kind)
    unseen = r.integers(0, 4, 500)
    t = unseen[:, None] * 100 + r.integers(0, 100, (500, 20))
    pairs = np.unique(np.repeat(np.arange(500), 20) * 400 + t.ravel())
    where = tree.leaf(pairs // 400, pairs % 400, 500)
    home = {k: np.bincount(kind[leaf == k]).argmax() for k in range(16) if (leaf == k).any()}
    assert np.mean([home.get(x) == y for x, y in zip(where.tolist(), unseen)]) > 0.9


def test_query_equals_the_sql(spark):
    d = "/root/testdata/sf0.01"
    assert rows(QUERIES["op12_ranked_search"](spark, d)) == duck(oracle_sql(), d)
