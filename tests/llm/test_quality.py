import math
import random
import re
from collections import Counter

import pytest

from colquarry.llm import queries
from colquarry.llm.quality import Rule, binomial_tail, judge, oracle_sql

from .oracle import duck, rows as spark_rows

DOCS = "doc_id long, text string, lang string, n_words string, stratum int, kept int"
LABELS = "doc_id long, quality int, toxic int, lang string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words))


def texts(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        ws = [r.choice(["a", "bb", "ccc", "Ünï", "d#", "|", "e e", "<x>"]) for _ in range(r.choice([0, 3, 9, 10, 40, 200]))]
        out.append("".join(w + r.choice([" ", " ", " ", "\n", "\t", "\r\n", "  "]) for w in ws))
    return out


def test_features_against_brute_force(spark):
    given = list(enumerate(texts(1, 120))) + [(900, None), (901, ""), (902, "\n \n"), (903, "one two\n" * 9000), (904, "tie"), (904, "tie"), (None, "x " * 30)]
    df = spark.createDataFrame([(i, t, None, "x", 1, 2) for i, t in given], DOCS)
    got = judge(df, spark.createDataFrame([], LABELS)).collect()
    want = [(i, *brute(t), not brute(t)[-1]) for i, t in given]
    assert sorted((tuple(x) for x in got), key=str) == sorted(want, key=str)
    assert judge(df.limit(0), spark.createDataFrame([(1, 1, 0, "x")], LABELS)).collect() == []


def test_binomial_tail(spark):
    cases = [(n, k) for n in (1, 5, 300, 20_000) for k in (0, 1, 3, 25) if k < n * 0.01] + [(2_000_000, 19_000), (2_000_000, 19_900), (400_000, 3900)]
    df = spark.createDataFrame([(5, 0), *cases], "n long, k long").withColumn("p", binomial_tail("n", "k", 0.01))
    for x in df.collect():
        want = sum(math.exp(math.lgamma(x.n + 1) - math.lgamma(i + 1) - math.lgamma(x.n - i + 1) + i * math.log(0.01) + (x.n - i) * math.log(0.99)) for i in range(x.k + 1))
        assert x.p == pytest.approx(want, rel=1e-6)


def corpus():
    r = random.Random(7)
    docs, labels = [], []
    for i in range(1500):
        bad = r.random() < 0.3
        ws = [r.choice(["plain", "prose", "word", "other", "thing", "more"]) + str(r.randint(0, 999)) for _ in range(30)]
        text = " ".join(w + "#$%" if bad and r.random() < 0.7 else w for w in ws)
        docs.append({"doc_id": i, "text": text, "lang": r.choice(["en", "en", "en", "de", None])})
        if r.random() < 0.8:
            labels.append({"doc_id": i, "quality": int(not bad), "toxic": 0})
    for i in range(1500, 1700):  # copies of one text count once
        docs.append({"doc_id": i, "text": docs[0]["text"] + " #", "lang": "de"})
        labels.append({"doc_id": i, "quality": 1, "toxic": 0})
    return docs, labels


def test_cutoffs_reject_what_is_bad_and_spare_the_good(spark):
    docs, labels = corpus()
    d, l = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = (Rule("symbols", "n_symbols", "word_chars", 100, 1, 40),)
    out = judge(d, l, rate=0.05, rules=rules)
    assert spark_rows(out) == duck(oracle_sql(rate=0.05, rules=rules), documents=docs, labels=labels)
    verdict = {x.doc_id: x.kept for x in out.collect()}
    good, bad = ([i for i in verdict if ("#" in docs[i]["text"]) == flag and docs[i]["lang"] == "en"] for flag in (False, True))
    assert all(verdict[i] for i in good) and not any(verdict[i] for i in bad)


def test_a_path_of_rules_and_strata_with_few_labels(spark):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(2400):
        lang = "en" if i % 3 else r.choice(["de", "fr", "es", "it"])  # none of four has enough for itself, all together have
        bad = r.random() < 0.25
        ws = [r.choice(["Plain", "prose", "word", "other", "thing"]) + str(r.randint(0, 9999)) for _ in range(25)]
        text = " ".join(ws) if not bad else " ".join(w.upper() for w in ws) if i % 2 else " ".join(w + "$$" for w in ws)
        docs.append({"doc_id": i, "text": text, "lang": lang})
        labels.append({"doc_id": i, "quality": int(not bad), "toxic": 0})
    docs.append({"doc_id": 9000, "text": "SHOUTED " * 3 + " ".join(f"A{k}" for k in range(20)), "lang": "unheard"})
    d, l = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = judge(d, l)
    assert spark_rows(out) == duck(oracle_sql(), documents=docs, labels=labels)
    kept, quality = {x.doc_id: x.kept for x in out.collect()}, {x["doc_id"]: x["quality"] for x in labels}
    for lang in ("en", "de", "fr"):
        ids = [x["doc_id"] for x in docs if x["lang"] == lang]
        assert not any(kept[i] for i in ids if not quality[i]) and all(kept[i] for i in ids if quality[i])
    assert kept[9000]  # nothing is certified where nothing is labelled


def test_cutoffs_of_a_path():
    from colquarry.llm.quality import RULES, STEPS

    for rule in RULES:
        path = [rule.cutoff(s) for s in range(STEPS + 1)]
        assert path[0] == rule.last and path[-1] == rule.first and path == sorted(path, reverse=True)


def test_steps_are_the_first_that_reject(spark):
    from colquarry.llm.quality import RULES, STEPS

    rule = RULES[0]
    df = spark.createDataFrame([(a, b) for a in range(0, 60, 3) for b in (0, 7, 50, 100)], "n_symbols long, word_chars long").withColumn("step", rule.step())
    for x in df.collect():
        want = next((s for s in range(STEPS + 1) if x.word_chars and rule.scale * x.n_symbols > rule.cutoff(s) * x.word_chars), STEPS + 1)
        assert x.step == want, x


def test_the_query_and_its_sql(spark):
    d = "/root/testdata/sf0.001"
    assert spark_rows(queries.op6_quality(spark, d)) == duck(queries.ORACLE_SQL["op6_quality"], d)


def test_no_python_in_the_plan(spark):
    plan = queries.op6_quality(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
