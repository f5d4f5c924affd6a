import random
import zlib

import numpy as np

from colquarry.llm.bytenet import BLOCK, HIDDEN, VECTOR, WIDTH, Network, blocks, chunks, fit, gradients, layout, scores, texts_logits, trained
from colquarry.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, score string, quality int, held_out binary"
LABELS = "doc_id long, quality int, text string"


def one_by_one(network, text):
    """The log odds of a text, place by place."""
    data = text.encode()
    vectors = [network.vectors[b] for b in data] + [np.zeros(VECTOR, np.float32)] * WIDTH
    places = [np.maximum(np.concatenate(vectors[p : p + WIDTH]) @ network.filters + network.offsets, 0) for p in range(max(1, len(data)))]
    n = max(1, -(-len(data) // BLOCK))
    units = []
    for k in range(max(1, n - 1)):
        part = places[k * BLOCK : (k + 2) * BLOCK]
        units.append(np.maximum(np.append(np.max(part, axis=0), len(part) / (2 * BLOCK)) @ network.hidden + network.shift, 0))
    return float(np.max(units, axis=0) @ network.last + network.bias[0])


def together(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def some_texts():
    r = random.Random(3)
    lengths = [0, 1, 7, 8, 127, 128, 129, 135, 255, 256, 257, 300, 1000, 40_000]
    return ["".join(r.choices("ab é日\n", k=n)) for n in lengths] + ["x" * BLOCK, "y" * 3 * BLOCK, ""]


def test_forward_pass_equals_one_by_place():
    network, texts = Network.random(5), some_texts()
    network.offsets += 0.1
    got = texts_logits(network, *together(texts))
    assert np.allclose(got, [one_by_one(network, t) for t in texts], atol=1e-3)


def test_gradients_equal_differences():
    network, texts = Network.random(9), ["abcab" * 60, "é x" * 70, "short", "n" * 500, ""]
    network.offsets += np.linspace(-0.3, 0.3, len(network.offsets), dtype=np.float32) + np.float32(0.013)  # no kink where a text has ended
    network.shift += np.float32(0.017)
    raw, off = together(texts)
    text, start = layout(off)
    tokens, valid = blocks(raw, off, text, start)
    label, weight = np.array([1, 0, 1, 0, 1], np.float32), np.array([1, 2, 0.5, 1, 1], np.float32)
    args = tokens, valid, *chunks(text), label, weight
    _, found = gradients(network, *args)
    r = np.random.default_rng(2)
    for x, g in zip(network.arrays(), found.arrays()):
        flat, tried = x.reshape(-1), r.choice(x.size, min(12, x.size), replace=False)
        for k in np.unique([*tried, int(np.abs(g).argmax())]):
            kept = flat[k]
            flat[k] = kept + 2e-3
            up = gradients(network, *args)[0]
            flat[k] = kept - 2e-3
            down = gradients(network, *args)[0]
            flat[k] = kept
            assert abs((up - down) / 4e-3 - g.reshape(-1)[k]) < 2e-3 + 0.05 * abs(g.reshape(-1)[k]) or x.size == 257 * VECTOR and k >= 256 * VECTOR


def test_learns_a_mark_anywhere():
    r = random.Random(6)
    texts = ["".join(r.choices("abcdef ", k=r.randint(20, 900))) for _ in range(240)]
    label = np.array([k % 2 for k in range(240)])
    texts = [t if y else t[: len(t) // 3] + "###$$$" + t[len(t) // 3 :] for t, y in zip(texts, label)]
    raw, off = together(texts)
    text, start = layout(off)
    tokens, valid = blocks(raw, off, text, start)
    rows = np.column_stack([tokens, valid])
    network = trained([rows[text == k] for k in range(200)], label[:200], steps=200)
    assert ((texts_logits(network, raw, off)[200:] > 0) == label[200:]).mean() > 0.95


def test_rows(spark):
    network, texts = Network.random(5), some_texts()
    given = list(enumerate(texts)) + [(90, None), (3, "other"), (3, "other"), (None, "no id"), (91, "long " * 300_000)]
    df = spark.createDataFrame([(i, t, "x", 1, b"") for i, t in given], SCHEMA).repartition(3)
    got = sorted(((r["doc_id"], r["score"]) for r in scores(df, network).collect()), key=str)
    raw, off = together([t or "" for _, t in given])
    want = sorted(zip([i for i, _ in given], 1 / (1 + np.exp(-texts_logits(network, raw, off).astype(float)))), key=str)
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1] for x in got], [x[1] for x in want], atol=1e-5)
    assert scores(df.limit(0), network).collect() == []


def test_labels_missing_or_of_one_class(spark):
    df = spark.createDataFrame([(i, f"text {i}", "", 0, b"") for i in range(40)], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in scores(df, fit(df, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, "") for i in range(40)] + [(None, 0, ""), (3, None, "")], LABELS)
    assert {round(r["score"], 6) > 0.9 for r in scores(df, fit(df, ones)).collect()} == {True}
    both = spark.createDataFrame([(i, i % 2, "") for i in range(40)] + [(1, 1, "")], LABELS)
    first, again = fit(df, both), fit(df.repartition(5), both.repartition(2))
    assert all(np.array_equal(a, b) for a, b in zip(first.arrays(), again.arrays())) and first.last.shape == (HIDDEN,)
    assert fit(df.limit(0), both).bias[0] == fit(df.where("doc_id < 0"), both).bias[0]


def test_query_on_rows_that_it_has_not_seen(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op13_quality_net"](spark, d).toPandas()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(x).encode()) % 5 == 0 for x in got.doc_id]).all() and (got.predicted == (got.score >= 0.3)).all()
    seen = got[got.held_out].merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    right = seen.predicted == seen.quality
    assert right.mean() > 0.95 and right[seen.quality == 1].mean() > 0.99 and right[seen.quality == 0].mean() > 0.75
