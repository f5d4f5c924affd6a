import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colquarry.llm.fingerprint import Fingerprint, PrefixHashes, code_points, edited, fingerprints, likeness

SCHEMA = "doc_id long, text string, bucket string, tail int"


def fp(text):
    return Fingerprint(PrefixHashes(code_points(text)))


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=60), st.text("ab", max_size=60), st.data())
def test_spans_and_extensions_agree_with_brute_force(a, b, data):
    x, y = PrefixHashes(code_points(a)), PrefixHashes(code_points(b))
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    want = 0
    while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
        want += 1
    assert x.common_extension(i, y, j) == want
    k = min(len(a) - i, len(b) - j)
    assert x.equal(i, y, j, k) == (a[i : i + k] == b[j : j + k])


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=400), st.text(max_size=400))
def test_likeness_is_symmetric_bounded_and_survives_the_string(a, b):
    x, y = fp(a), fp(b)
    assert 0 <= likeness(x, y) <= 1
    assert likeness(x, y) == likeness(y, x) == likeness(Fingerprint.parse(str(x)), Fingerprint.parse(str(y)))
    assert (str(x) == str(y)) == (a == b)
    assert likeness(x, fp(a)) == 1


def test_a_moved_passage_still_counts():
    r = random.Random(1)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    a, b, c = words(400), words(400), words(400)
    assert likeness(fp(a), fp(b)) < 0.05
    assert likeness(fp(a + b), fp(b + a)) > 0.8
    assert 0.4 < likeness(fp(a + b), fp(c + b)) < 0.6
    assert likeness(fp("x" * 5000), fp("x" * 4000)) <= 1


def test_repetitive_texts_keep_their_likeness():
    r = random.Random(5)
    prose = lambda n: "".join(r.choices("abcdefgh ", k=n))
    for period in (1, 7, 60, 130, 400):
        for n in (700, 5000, 24757, 130_000):
            text = (prose(period) * (n // period + 1))[:n]
            new = edited(text, prose(n))
            a, b = fp(text), fp(new)
            assert likeness(a, b) == likeness(Fingerprint.parse(str(a)), Fingerprint.parse(str(b))) >= 2 / 3, (period, n)
            assert len(a.at) < 200
            # a copy whose first character differs has no common prefix
            assert likeness(a, fp("#" + text[1:])) > 0.7, (period, n)


def test_the_edit_is_told_to_a_twentieth():
    r = random.Random(9)
    prose = lambda n: "".join(r.choices("abcdefgh ", k=n))
    for n in (400, 1500, 5000, 8000, 60_000):
        for text in (prose(n), "x" * n, ("ab" * n)[:n], ("One sentence again and again. " * n)[:n]):
            share = 1 - n // 4 / n
            assert abs(likeness(fp(text), fp(edited(text, prose(n)))) - share) < 0.05, (n, text[:10])


def test_rows_that_share_an_id_are_split(spark):
    r = random.Random(6)
    rows = [(None if i % 2 else 7, "".join(r.choices("abcé", k=r.randint(0, 60)))) for i in range(80)] + [(-(1 << 63), "least"), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], SCHEMA).repartition(3)
    out = fingerprints(df, 5)
    assert sorted((tuple(x) for x in out.collect()), key=str) == expected(rows)
    sizes = [sum(1 for _ in p) for p in out.rdd.glom().collect()]
    assert max(sizes) <= 20 and fingerprints(df, 1000, 300).rdd.getNumPartitions() > 5


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        e = edited(t, nxt)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), str(fp(t)), str(fp(e)), likeness(fp(t), fp(e)), likeness(fp(t), fp(nxt))))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_bucket", [3, 1000])
def test_rows_against_brute_force(spark, per_bucket):
    r = random.Random(3)
    rows = [(i * 7 % 101, "".join(r.choices("abcé 😀\n", k=r.randint(0, 300)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "y" * 70000), (202, "y" * 70000), (203, "tie"), (203, "tie b"), (None, "lost"), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], SCHEMA).repartition(5)
    got = sorted((tuple(x) for x in fingerprints(df, per_bucket).collect()), key=str)
    assert got == expected(rows)


def test_empty_table_and_single_row(spark):
    assert fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    one = fingerprints(spark.createDataFrame([(5, "abcdefgh", "", 1)], SCHEMA)).collect()
    assert [(x.doc_id, x.n_chars, x.near_next) for x in one] == [(5, 8, 1.0)]
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
