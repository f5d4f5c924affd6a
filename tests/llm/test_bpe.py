import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colquarry.llm.bpe import Builder, Encoder, Transducer, decode, encoded
from colquarry.llm.vocabulary import default_path, load, words_of, _ANY

SCHEMA = "doc_id long, text string, word string, n int, ids string"
LIBRARY = Tokenizer.from_file(default_path())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 9), min_size=1, max_size=3), max_size=60), st.lists(st.binary(max_size=6)))
def test_transducer_is_the_lexicon(lexicon, others):
    t = Transducer.mapped(Transducer.compile(lexicon))
    words = [*lexicon, *others]
    for w, n in zip(words, t.numbers(words).tolist()):
        assert (t.output(n) if n >= 0 else None) == lexicon.get(w)


def test_suffixes_are_shared():
    b = Builder()
    for w in sorted(f"{x}{y}ing".encode() for x in "abcdef" for y in "ghij"):
        b.add(w)
    b.finish()
    assert len(b.states) == 6


TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" '\n\tabstmdrevl²½_é0\x1c\x85\xa0")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encoder_equals_the_library(text):
    v = load(default_path())
    e = Encoder(v, Transducer(Transducer.compile({b" the": [262]})))
    assert words_of(text) == _ANY.findall(text)
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert e.encode(text) == ids
    assert decode(v, ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 999 + "é" * 500, " " * 4000, "<|endoftext|>a <|endoftext|>", "=" * 700, "\n" * 99 + "x"])
def test_long_and_special(text):
    v = load(default_path())
    assert Encoder(v, Transducer(Transducer.compile({}))).encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    r = random.Random(2)
    texts = ["".join(r.choices(["the ", "naïve", " 12", "x!", "\n", "<|endoftext|>", " Wörter", "日本"], k=r.randint(0, 60))) for _ in range(70)]
    rows = [*enumerate(texts), (500, None), (501, ""), (502, "z" * 50_000), (503, texts[1]), (503, texts[1]), (None, "no id")]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = encoded(df, n_words=9, with_ids=True).collect()
    assert sorted((tuple(x)[:4] for x in got), key=str) == sorted(want, key=str)
    assert all(LIBRARY.decode(x.ids, skip_special_tokens=False) == x.decoded for x in got)
    assert encoded(df.limit(0)).collect() == []
