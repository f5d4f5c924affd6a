import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colquarry.llm.language import STRENGTH, TEMPER, Model, fit, identify, in_sample, page_evidence, page_text, trigrams
from colquarry.llm.shared import text_chunks

WORDS = {"en": "the and of thing water house with from".split(), "de": "der und wasser haus mit schön für über".split(), "fr": "le et eau maison avec où élève".split()}
SCHEMA = "doc_id long, text string, lang string, host string, tld string, posterior int, n_trigrams string"


def texts(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        host = r.choice(["a.de", "b.fr", "hot.com", "hot.com", None])
        out.append((i, " ".join(r.choices(WORDS[lang], k=r.randint(3, 30))), lang, host, host and host[-2:]))
    return out


def brute(model, rows):
    """Rows: (key, text, host, suffix, declared)."""
    total, count = model.likelihoods(pa.array([r[1] for r in rows], pa.string()))
    log_text = TEMPER * (total - total.max(axis=1, keepdims=True))
    share = np.exp(log_text) / np.exp(log_text).sum(axis=1, keepdims=True) * (count > 0)[:, None]
    k, out = len(model.languages), []
    whole = (share.sum(axis=0) + 1) / ((count > 0).sum() + k)
    for i, r in enumerate(rows):
        prior = whole
        for at in (3, 2):
            if r[at]:
                same = [j for j, x in enumerate(rows) if x[at] == r[at] and j != i]
                prior = (share[same].sum(axis=0) + STRENGTH * prior) / (sum(count[j] > 0 for j in same) + STRENGTH)
        score = log_text[i] + np.log(prior)
        if r[4] in model.languages:
            others = [j for j, x in enumerate(rows) if x[4] in model.languages and j != i]
            mass = share[others].sum(axis=0)
            mine = share[[j for j in others if rows[j][4] == r[4]]].sum(axis=0)
            score = score + np.log((mine + 1) / (mass + k))
        p = np.exp(score - score.max())
        out.append((r[0], model.languages[int(np.argmax(p))] if count[i] else None, float(p.max() / p.sum()) if count[i] else None))
    return out


def test_fusion_against_brute_force(spark):
    model = fit(spark.createDataFrame([(r[2], r[1]) for r in texts(1, 200)], "lang string, text string"))
    assert model.languages == ["de", "en", "fr"]
    rows = [(i, t, h, s, d) for (i, t, lang, h, s), d in zip(texts(2, 120), random.Random(3).choices(["en", "de", "fr", "xx", None], k=120))]
    rows += [(500, None, "a.de", "de", "en"), (501, "", None, None, None), (502, "1234 !!", "a.de", "de", "de"), (503, "a b", "a.de", "de", None), (503, "a b", "a.de", "de", None), (None, "der und", None, None, None), (504, "haus " * 20_000, "b.fr", "fr", "fr")]
    df = spark.createDataFrame([(i, t, d, h, s, 1, "x") for i, t, h, s, d in rows], SCHEMA).repartition(3)
    got = identify(df, model, ["doc_id"], F.col("host"), F.col("tld"), F.col("lang")).collect()
    want = brute(model, rows)
    key = lambda x: (str(x[0]), str(x[1]), x[2] or 0)
    for g, w in zip(sorted((tuple(x) for x in got), key=key), sorted(want, key=key)):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None)
        assert g[2] is None or math.isclose(g[2], w[2], rel_tol=1e-9)
        assert g[3] == (g[1] is not None and g[2] >= 0.5)
    assert identify(df.limit(0), model, ["doc_id"], F.col("host"), F.col("tld"), F.col("lang")).collect() == []


def test_held_out_accuracy_and_evidence(spark):
    model = fit(spark.createDataFrame([(r[2], r[1]) for r in texts(1, 300)], "lang string, text string"))
    held = texts(9, 200)
    total, _ = model.likelihoods(pa.array([r[1] for r in held]))
    right = [model.languages[k] == r[2] for k, r in zip(total.argmax(axis=1), held)]
    assert np.mean(right) > 0.97
    # a text that says nothing goes with its host
    rows = [(i, "wasser haus mit und", None, "w.de", "de") for i in range(40)] + [(99, "zzz", None, "w.de", "de")]
    df = spark.createDataFrame([(i, t, d, h, s, 1, "x") for i, t, d, h, s in rows], SCHEMA)
    got = identify(df, model, ["doc_id"], F.col("host"), F.col("tld"), F.col("lang")).where("doc_id = 99").first()
    assert got.lang == "de"


def counted(text):
    """Trigram buckets of a text, byte by byte."""
    x = [b | 32 if 65 <= b <= 90 or 97 <= b <= 122 else b if b >= 128 else 32 for b in text.encode()]
    return [(((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (c * 0xC2B2AE3D)) & 0xFFFFFFFF) >> 17 for a, b, c in zip(x, x[1:], x[2:]) if b != 32]


def test_the_text_model_against_brute_force(spark):
    labelled = [(r[2], r[1]) for r in texts(4, 90)] + [("fr", "MAJUSCULES, été 12!"), ("de", None), (None, "words"), ("en", ""), ("en", "thing " * 30_000)]
    model = fit(spark.createDataFrame(labelled, "lang string, text string").repartition(4))
    table = {lang: np.full(1 << 15, 0.5) for lang in ("de", "en", "fr")}
    for lang, text in labelled:
        if lang and text:
            np.add.at(table[lang], counted(text), 1)
    assert model.languages == sorted(table)
    for j, lang in enumerate(model.languages):
        assert np.allclose(model.weights[:, j], np.log(table[lang] / table[lang].sum()), rtol=1e-12)
    asked = ["the house", "Über Wasser", "zz", "", None, "maison " * 20_000]
    total, count = model.likelihoods(pa.array(asked))
    for i, text in enumerate(asked):
        found = counted(text or "")
        assert count[i] == len(found) and np.allclose(total[i], model.weights[found].sum(axis=0), rtol=1e-9)


def test_only_the_frequent_languages_are_learnt(spark):
    rows = [(f"l{i % 7}", f"word{i} text") for i in range(60)] + [("rare", "a single one")]
    assert fit(spark.createDataFrame(rows, "lang string, text string"), most_languages=7).languages == [f"l{i}" for i in range(7)]


def test_documents_outside_the_sample(spark):
    """Documents get the language of their label, though neither it nor their text was learnt."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null and lang is not null")
    model = fit(docs, sample_rows=600)
    rows = docs.count()
    held = docs.where(~in_sample(rows, 600)).withColumn("label", F.col("lang"))
    nothing = F.lit(None).cast("string")
    found = identify(held, model, ["doc_id", "label"], F.col("source"), nothing, nothing)
    sums = found.agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("label")).alias("right"), F.count_if("kept").alias("kept")).first()
    assert sums["n"] > 5000 and sums["right"] / sums["n"] > 0.98 and sums["kept"] / sums["n"] > 0.98, sums


def test_no_labels(spark):
    model = fit(spark.createDataFrame([], "lang string, text string"))
    df = spark.createDataFrame([(1, "words", None, "h", "t", 1, "x")], SCHEMA)
    assert [(x.lang, x.kept) for x in identify(df, model, ["doc_id"], F.col("host"), F.col("tld"), F.col("lang")).collect()] == [(None, False)]


def test_trigrams_stay_inside_texts():
    (_, raw, off), = text_chunks(pa.array(["ab", "c", "xyz1", None, "é"]))
    bucket, text = trigrams(raw, off)
    assert text.tolist() == [2, 2]


@pytest.mark.parametrize("url,html,want", [
    ("http://u@Sub.Example.DE:80/x?y", '<!DOCTYPE html><HTML class=a LANG="de-AT"><script>if(a<b)</script><p>Wort&amp;</p>', ("sub.example.de", "de", "de-AT", "Wort")),
    ("nonsense", "<p>x", ("", "", "", "x")),
    (None, None, (None, None, None, None)),
])
def test_pages(spark, url, html, want):
    df = spark.createDataFrame([(url, html)], "url string, html string")
    e = page_evidence(F.col("url"), F.col("html"))
    x = df.select(e["host"], e["suffix"], e["declared"], F.trim(page_text(F.col("html")))).first()
    assert tuple(x) == want
