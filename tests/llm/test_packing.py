import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colquarry.llm.packing import cut, encode, pack, plan
from colquarry.llm.vocabulary import default_path

SCHEMA = "doc_id long, text string, length string, sequence_id int, bucket int"


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is None:
            rooms.append(capacity - x)
        else:
            rooms[rooms.index(fit)] = fit - x
    return len(rooms)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=120))
def test_plan_equals_best_fit_over_single_pieces(lengths):
    rows = plan(Counter(lengths), 20)
    filled, seen = defaultdict(list), Counter()
    for length, first, n, sequence, each, offset in rows:
        for k in range(n):
            filled[sequence + k // each].append((offset + k % each * length, length))
        seen[length] += n
    assert seen == Counter(lengths)
    for slots in filled.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 20
    assert len(filled) == best_fit_decreasing(lengths, 20)


def test_cut():
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(4, 4) == [(0, 4)] and cut(1, 4) == [(0, 1)]


@pytest.mark.parametrize("per_bucket", [7, 50_000])
def test_pieces_and_places(spark, per_bucket):
    r = random.Random(5)
    texts = [" ".join(r.choices(["the", "naïve", "12", "x!", "\n", "<|endoftext|>", "word"], k=r.randint(0, 90))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "long text " * 4000), (903, texts[3]), (903, texts[3]), (None, "no id")]
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    got = pack(df, capacity=128, rows_per_bucket=per_bucket, with_ids=True).collect()
    t = Tokenizer.from_file(default_path())
    want = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cut(len(ids), 128))]
    assert sorted([(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got], key=str) == sorted(want, key=str)
    assert all(zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32 for x in got)
    by = defaultdict(list)
    for x in got:
        by[x.sequence_id].append((x.offset, x.length))
    for slots in by.values():
        assert [a for a, _ in sorted(slots)] == list(np.cumsum([0, *(n for _, n in sorted(slots))]))[:-1]
        assert sum(n for _, n in slots) <= 128
    assert len(by) == best_fit_decreasing([w[3] for w in want], 128)


@pytest.mark.parametrize(
    "text",
    [
        " " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "x\t" + "\t" * 2_000_000, "a" + " \t\n" * 700_000 + "<|endoftext|> the end" + "\u2003" * 70_000 + "é",
        "<|endoftext|>" + " " * 65_535 + "a" + " " * 65_536, "q" * 1_200_000, "!" * 1_200_000, "7" * 1_200_000, "日" * 300_000,
    ],
)
def test_very_long_runs_are_encoded_as_the_library_does(text):
    want = Tokenizer.from_file(default_path()).encode(text, add_special_tokens=False).ids
    assert encode(default_path(), text) == want


def test_a_long_run_of_white_space_is_packed(spark):
    got = pack(spark.createDataFrame([(1, "a" + " " * 1_100_000 + "b", "", 0, 0), (2, "c", "", 0, 0)], SCHEMA)).collect()
    want = Tokenizer.from_file(default_path()).encode("a" + " " * 1_100_000 + "b", add_special_tokens=False).ids
    assert sum(x.length for x in got if x.doc_id == 1) == len(want) + 1 and max(x.length for x in got) <= 1024


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []
