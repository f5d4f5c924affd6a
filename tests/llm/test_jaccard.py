import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colquarry.llm.components import components
from colquarry.llm.jaccard import Frequent, Spaces, bitmap, marked_routes, near_duplicates, routes, tree_links, tree_sift, width_for

from colquarry.llm import queries

from .oracle import duck
from .oracle import rows as table_rows

SCHEMA = "doc_id long, text string, n int, set_id string, route int"
U64 = np.uint64


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def expected(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice(["alpha", "Beta", "gamma", "DELTA", "eps", "zeta", "eta", "theta"]) + str(r.randint(0, 30))
    passage = [word() for _ in range(40)]
    rows = []
    while len(rows) < n:
        base = [word() for _ in range(r.choice([1, 2, 3, 5, 9, 30, 120, 400]))]
        if r.random() < 0.4:
            base += passage
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5]) if len(text) > 20 else r.choice([0, 0, 1])):
                at = r.randrange(len(text))
                text[at : at + r.choice([0, 1])] = [word()] * r.choice([0, 1])
            rows.append((len(rows) * 3 % 1009, r.choice([" ", "\n", " \t"]).join(text)))
    return rows


@pytest.mark.parametrize("k,num,den,block,cluster", [(4, 85, 100, 24 << 20, 2048), (5, 80, 100, 6000, 2048), (4, 1, 2, 24 << 20, 3), (5, 80, 100, 24 << 20, 0)])
def test_components_against_brute_force(spark, k, num, den, block, cluster):
    rows = corpus(k * num, 170)
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "w " * 30_000), (5003, "w " * 30_000), (None, rows[0][1]), (None, "only null id here"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(5)
    got = sorted((tuple(x) for x in near_duplicates(df, k, num, den, block, cluster_sets=cluster).collect()), key=str)
    assert got == expected(rows, k, num, den)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(0, 12), st.integers(0, 12), st.sampled_from([(85, 100), (80, 100), (1, 2), (1, 1)]))
def test_linked_sets_share_a_route(seed, common, only_a, only_b, similarity):
    r = np.random.default_rng(seed)
    high = 2**64 - 1 if seed % 3 else 2**20  # also very uneven hashes
    values = np.unique(r.integers(0, high, common + only_a + only_b, dtype=U64, endpoint=True))
    r.shuffle(values)
    a, b = np.sort(values[: common + only_a]), np.sort(np.concatenate([values[:common], values[common + only_a :]]))
    spaces = Spaces(*similarity)
    if spaces.linked(len(a), len(b), len(np.intersect1d(a, b))):
        assert set(routes(a, spaces).tolist()) & set(routes(b, spaces).tolist())
        # in some space both, each with as many routes of it as it needs
        of_a, of_b = ({number: (need, set(keys.tolist())) for number, need, keys in marked_routes(x, spaces)} for x in (a, b))
        assert any(len(of_a[k][1] & of_b[k][1]) >= max(of_a[k][0], of_b[k][0]) for k in of_a.keys() & of_b.keys())


def test_frequent_routes_are_dealt_after_some():
    r = np.random.default_rng(3)
    frequent, met = Frequent(8), {}
    hot = r.integers(-(2**62), 2**62, 5)
    for _ in range(40):
        keys = np.concatenate([r.choice(hot, 3, replace=False), r.integers(-(2**62), 2**62, 50)])
        for key, flag in zip(keys.tolist(), frequent.dealt(keys).tolist()):
            met.setdefault(key, []).append(flag)
    for key, flags in met.items():
        assert not any(flags[:8]) and all(flags[16:]) and sorted(flags) == flags
        assert key in hot or len(flags) < 8


def test_dealt_routes_join_all_the_same(spark):
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):  # a chain of small changes, with the same routes again and again
        base[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(base)))
    rows += [(100 + i, " ".join(f"{i}y{j}" if j % 3 else base[j] for j in range(60))) for i in range(20)]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(x) for x in near_duplicates(df, 4, 70, 100, often=4).collect()), key=str)
    assert got == expected(rows, 4, 70, 100)


def rows_made(spark, join):
    """How many rows the joins of a type have made in all plans that ran so far."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = store.executionsList()
    for at in range(plans.size()):
        number = plans.apply(at).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if "Join" in node.name() and join in node.desc():
                metrics = node.metrics()
                made = [m for m in map(metrics.apply, range(metrics.size())) if m.name() == "number of output rows"]
                total += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in made if values.contains(m.accumulatorId()))
    return total


def test_labels_are_not_joined_on_each_route(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words))]
    for i in range(1, 80):  # copies with a change each: all link with the first, and meet on many routes
        rows.append((i, " ".join([*words[: 4 * i], f"x{i}", *words[4 * i + 1 :]])))
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(3)
    before = rows_made(spark, "LeftOuter")
    got = sorted((tuple(x) for x in near_duplicates(df, cluster_sets=0).collect()), key=str)
    assert 0 < rows_made(spark, "LeftOuter") - before <= 4 * len(rows)
    assert got == expected(rows, 5, 80, 100)


def test_ids_of_another_type(spark):
    df = spark.createDataFrame([("b", "one two three four five six"), ("a", "One two three four five six"), (None, "none"), ("c", None)], "doc_id string, text string")
    assert sorted((tuple(x) for x in near_duplicates(df).collect()), key=str) == sorted([("b", 2, "a"), ("a", 2, "a"), (None, 1, None), ("c", 0, "c")], key=str)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 90), st.booleans())
def test_tree_joins_what_links(seed, n, two_sides):
    r = np.random.default_rng(seed)
    bases = [r.integers(0, 2**64 - 1, r.integers(1, 80), dtype=U64) for _ in range(6)]
    sets = []
    for _ in range(n):
        base = bases[r.integers(6)]
        keep = base[r.random(len(base)) > r.choice([0, 0.05, 0.1, 0.3])]
        sets.append(np.unique(np.concatenate([keep if len(keep) else base, r.integers(0, 2**64 - 1, r.integers(0, 5), dtype=U64)])))
    sides = r.integers(0, 2, n).tolist() if two_sides else [0] * n
    labels = r.integers(0, n, n).tolist()
    spaces = Spaces(8, 10)

    def joined(pairs):
        group = list(labels)
        for i, j in pairs:
            x, y = group[i], group[j]
            group = [x if g == y else g for g in group]
        return sorted(tuple(k for k in range(n) if group[k] == g) for g in set(group))

    linked = [
        (i, j) for i in range(n) for j in range(i)
        if (len(set(sides)) == 1 or sides[i] != sides[j]) and spaces.linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])))
    ]
    found = tree_links(sets, labels, sides, spaces)
    assert all((max(p), min(p)) in set(linked) for p in found)
    assert joined(found) == joined(linked)
    alive = tree_sift([len(s) for s in sets], [bitmap(s, width_for(len(s), 4, 16)) for s in sets], labels, sides, spaces)
    assert all(alive[i] and alive[j] for i, j in linked if labels[i] != labels[j])


def test_sets_that_are_alike_are_compared_by_leaves(monkeypatch):
    r = np.random.default_rng(5)
    base, n, calls = r.integers(0, 2**64 - 1, 147, dtype=U64), 600, []
    fresh = lambda k: r.integers(0, 2**64 - 1, k, dtype=U64)
    sets = [np.unique(np.concatenate([r.permutation(base)[:132], fresh(r.integers(10, 16))])) for _ in range(n)]
    for i in range(0, n, 50):  # a few that do link
        sets[i] = np.unique(np.concatenate([sets[(i + 333) % n][4:], fresh(3)]))
    spaces = Spaces(85, 100)
    linked = {(i, j) for i in range(n) for j in range(i) if spaces.linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])))}
    counted = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: calls.append(1) or counted(x))
    found = tree_links(sets, list(range(n)), [0] * n, spaces)
    assert len(calls) < n  # a call for each set and leaf of 8 made 25,709
    calls.clear()
    alive = tree_sift([len(s) for s in sets], [bitmap(s, width_for(len(s), 4, 16)) for s in sets], list(range(n)), [0] * n, spaces)
    assert len(calls) < n
    assert len(linked) == 12 and {(max(p), min(p)) for p in found} == linked
    assert all(alive[i] and alive[j] for i, j in linked)


def test_star_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40, 75)] + [(r.randrange(30), r.randrange(30)) for _ in range(14)] + [(99, 99)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    loops = {a for a in root if all(a not in e or e[0] == e[1] for e in edges)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for most in (1 << 20, 2):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        got = {x.node: x.component for x in components(df, most=most).collect()}
        assert got == {k: v for k, v in root.items() if k not in loops}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_few_edges_take_two_steps(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (7, 9), (5, 5)], "a long, b long").repartition(3)
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = max((store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())), default=-1)
    found = components(df)
    bus.waitUntilEmpty(30_000)
    after = max(store.executionsList().apply(k).executionId() for k in range(store.executionsList().size()))
    assert after - before == 2  # they are counted and told; a round of stars made it six
    assert {x.node: x.component for x in found.collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7}


def test_the_query_and_its_sql(spark):
    d = "/root/testdata/sf0.01"
    assert table_rows(queries.op4_jaccard_join(spark, d)) == duck(queries.ORACLE_SQL["op4_jaccard_join"], d)
