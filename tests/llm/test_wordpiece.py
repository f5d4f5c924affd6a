import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import models

from colquarry.llm.vocabulary import default_path, load, words_of
from colquarry.llm.wordpiece import Automaton, token_counts

SCHEMA = "doc_id long, text string, n_words string, n_tokens int"


def greedy(word, initial, continuing, longest=10**9):
    n = at = 0
    while at < len(word):
        pieces = continuing if at else initial
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


PIECES = st.sets(st.text("abc", min_size=1, max_size=5), max_size=25)


@settings(max_examples=200, deadline=None)
@given(PIECES, PIECES, st.lists(st.text("abcd", max_size=14), max_size=20))
def test_counts_equal_greedy_matching_and_the_library(initial, continuing, words):
    enc = lambda xs: {x.encode() for x in xs}
    got = Automaton(enc(initial), enc(continuing)).counts([w.encode() for w in words])
    assert got.tolist() == [greedy(w.encode(), enc(initial), enc(continuing)) for w in words]
    model = models.WordPiece(vocab={"[UNK]": 0} | {p: k + 1 for k, p in enumerate([*initial, *("##" + c for c in continuing)])}, unk_token="[UNK]", max_input_chars_per_word=99)
    assert got.tolist() == [len(model.tokenize(w)) if w else 0 for w in words]
    same = Automaton(enc(initial)).counts([w.encode() for w in words])
    assert same.tolist() == [greedy(w.encode(), enc(initial), enc(initial)) for w in words]


def test_rows(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["thing", "naïve", "Überläufer", "12345", "x--", "日本語", "\n"], k=r.randint(0, 50)))) for i in range(50)]
    rows += [(90, None), (91, ""), (92, "q" * 20_000), (93, "same"), (93, "same"), (None, "no id")]
    v = load(default_path())
    pieces = {p for i, p in v.pieces.items() if i not in v.special.values()}
    longest = max(map(len, pieces))
    want = [(i, len(ws := words_of(t or "")), sum(greedy(w.encode(), pieces, pieces, longest) for w in ws)) for i, t in rows]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    got = [tuple(x) for x in token_counts(df, memory=5).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts(df.limit(0)).collect() == []
