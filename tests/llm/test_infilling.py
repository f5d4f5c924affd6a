import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colquarry.llm.infilling import char_runs, digested, oracle_sql, transformed, word_runs
from colquarry.llm.queries import QUERIES

from .oracle import duck, rows

SCHEMA = "doc_id long, text string, n string, form int, output binary"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def by_hand(doc, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = sha(f"42:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc, len(tokens), "plain", None, None, sha(text), sha(text)
    spm = h4 % 100 < 80
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc, len(tokens), "spm" if spm else "psm", len(prefix), len(middle), sha(out), sha(text)


def packed(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(" \t\n\x0b\x1cab<éé日𝄞\xa0", max_size=12), min_size=1, max_size=6))
def test_every_cut_of_every_text(texts):
    raw, off = packed(texts)
    runs, chars = word_runs(raw, off), char_runs(raw, off)
    for k, text in enumerate(texts):
        tokens, whole = TOKEN.findall(text), text.encode()
        assert runs.units()[k] == len(tokens) and chars.units()[k] == len(text)
        cuts = np.arange(len(tokens) + 1)
        at = runs.offset(np.full(len(cuts), k), cuts)
        assert [whole[: x - off[k]].decode() for x in at] == ["".join(tokens[:c]) for c in cuts]
        assert chars.unit_at(np.full(len(cuts), k), at).tolist() == [len("".join(tokens[:c])) for c in cuts]
        places = np.arange(len(text) + 1)
        assert [whole[: x - off[k]].decode() for x in chars.offset(np.full(len(places), k), places)] == [text[:c] for c in places]


def test_rows_equal_the_plain_version(spark):
    texts = [f"  word {k} naïve 日本語\n\n\tlast{' ' * (k % 3)}" * (k % 7) for k in range(150)]
    given_rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, " "), (503, "a<P>b c d"), (504, "<S> x"), (505, "x <M>"), (506, "< P> <<<"), (507, "<" * 50)]
    given_rows += [(508, "wörd " * 900_000), (509, " " * 3_000_000), (510, "日" * 800_000), (3, texts[3]), (3, "another"), (None, "no id here"), (None, None), (-7, "less than none")]
    df = spark.createDataFrame([(i, t, "clash", 1, b"") for i, t in given_rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, digested(transformed(df)).collect()), key=str)
    assert got == sorted((by_hand(i, t) for i, t in given_rows), key=str)
    forms = [x[2] for x in got]
    assert {"plain", "spm", "psm"} == set(forms)
    assert transformed(df.limit(0)).collect() == []


def test_by_characters_and_other_shares(spark):
    df = spark.createDataFrame([(i, "tée x 日" * 9, "", 0, b"") for i in range(60)], SCHEMA)
    found = transformed(df, percent=100, spm_percent=0, units="chars").collect()
    assert {x.form for x in found} == {"psm"} and all(x.n == 63 for x in found)
    for x in found:
        prefix, rest = x.output[3:].split("<S>")
        suffix, middle = rest.split("<M>")
        assert (len(prefix), len(middle)) == (x.prefix_chars, x.middle_chars) and prefix + middle + suffix == "tée x 日" * 9
    assert {x.form for x in transformed(df, percent=0).collect()} == {"plain"}
    with pytest.raises(ValueError):
        transformed(df, units="lines")
    with pytest.raises(ValueError):
        transformed(df, marks=("<P>", "<P>", "<M>"))


def test_query_equals_the_sql(spark):
    d = "/root/testdata/sf0.01"
    assert rows(QUERIES["op11_infilling"](spark, d)) == duck(oracle_sql(), d)
