import random
import re
from collections import defaultdict


import corpus_pipeline as cp

from .test_jaccard import expected
from .test_quality import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, _key string"


def corpus():
    r = random.Random(8)
    word = lambda: r.choice(["water", "house", "with", "from", "there", "other"]) + r.choice("abcdefghij") + r.choice("klmnop")
    docs = []
    for i in range(90):
        docs.append((i, " ".join(word() for _ in range(r.choice([5, 40, 120]))), "en", f"src{i % 3}"))
    for i in range(90, 110):
        ws = docs[i - 60][1].split(" ")
        ws[len(ws) // 2] = "changed"
        docs.append((i, " ".join(ws), "en", "src0"))
    docs += [(200, None, "en", "src0"), (201, "", None, None), (202, "123 " * 40, "en", "src1"), (203, "same words again and again " * 30, "en", "src1"), (204, docs[3][1] + " mail a.b@c1.example", "en", "src2")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "x", "y") for i, t, l, s in docs], SCHEMA).repartition(3)


def test_stages_against_brute_force(spark, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = {i: (i, t, l, s) for i, t, l, s in corpus()}
    now = frame(spark, list(docs.values()))
    want = {i for i in docs if re.search("[A-Za-z]", docs[i][1] or "")}
    stages = dict(cp.STAGES)
    now = stages["language"](spark, now, str(tmp_path))
    assert now.columns == list(cp.COLUMNS) and {x.doc_id for x in now.collect()} == want
    now = stages["quality"](spark, now, str(tmp_path))
    want = {i for i in want if not brute(docs[i][1])[-1]}
    assert {x.doc_id for x in now.collect()} == want
    now = stages["near_duplicate"](spark, now, str(tmp_path))
    want = {i for i, _, c in expected([docs[i][:2] for i in sorted(want)], 5, 80, 100) if i == c}
    assert {x.doc_id for x in now.collect()} == want and len(want) < 90
    now = stages["personal_data"](spark, now, str(tmp_path))
    for x in now.collect():
        assert x.n_chars == len(x.text) and "@c1" not in x.text and (x.text == docs[x.doc_id][1] or x.doc_id == 204)
    packed = stages["packing"](spark, now, str(tmp_path)).collect()
    by = defaultdict(int)
    for x in packed:
        by[x.sequence_id] += x.length
    assert {x.doc_id for x in packed} == want and max(by.values()) <= 1024


def test_run_and_ties(spark, tmp_path):
    docs = corpus()
    for name, rows in (("documents", frame(spark, docs)), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.select("doc_id").distinct().count() > 30
    twice = frame(spark, [docs[1], docs[1], docs[2], (None, docs[4][1], "en", "s")])
    kept = cp.near_duplicate(spark, twice, str(tmp_path)).select("doc_id").collect()
    assert sorted(str(x.doc_id) for x in kept) == ["1", "2", "None"]
    assert cp.run.__doc__ and cp.language(spark, twice.limit(0), str(tmp_path)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    a, b, c = (" ".join(f"{k}word{i}" for i in range(60)) for k in "abc")
    rows = [(1, a, "en", "s"), (5, a + " more", "en", "s"), (5, b, "en", "s"), (7, c, "en", "s"), (7, c + " more", "en", "s"), (None, b + " more", "en", "s")]
    rows += [(None, f"{a} {c}", "en", "s"), (None, f"{a} {c} more", "en", "s")] + [(None, f"{b} {c}", "en", "s")] * 2
    kept = cp.near_duplicate(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted((x.doc_id, x.text) for x in kept if x.doc_id in (1, 5)) == [(1, a), (5, b)]
    assert len([x for x in kept if x.doc_id == 7]) == 1
    nameless = [x.text for x in kept if x.doc_id is None]
    assert len(nameless) == 2 and f"{b} {c}" in nameless and set(nameless) & {f"{a} {c}", f"{a} {c} more"}
