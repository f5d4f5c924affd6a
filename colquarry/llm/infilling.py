"""Fill-in-middle transformation over run-length encoded character classes.

A text is stored as its maximal runs of one character class, each with the units counted before it and the bytes
that a unit takes inside it. A cut after so many units is found by a binary search for the run that holds it, and its
place inside the run is a product. Two such tables serve a text: one of white space and words, whose units are the
tokens to cut by, and one of characters that take equally many bytes, whose units are code points. All texts of a
chunk share the tables and all their cuts are looked up at once; nothing is split into tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import _SPACE, arrow_batches, text_chunks

MARKS = ("<P>", "<S>", "<M>")
UNITS = ("words", "chars")


@dataclass(frozen=True)
class Runs:
    """Maximal runs of several texts that lie one behind the other.

    starts: first byte of each run, ascending, then the end of all; before: units before each run, then of all;
    size: bytes of a unit inside the run; first: the first run of each text, then the number of runs."""

    starts: np.ndarray
    before: np.ndarray
    size: np.ndarray
    first: np.ndarray

    def units(self) -> np.ndarray:
        """The units of each text."""
        return np.diff(self.before[self.first])

    def offset(self, text: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The byte behind the first ``unit`` units of each text; white space that follows them isn't passed."""
        goal = self.before[self.first[text]] + unit
        run = np.searchsorted(self.before, goal, side="left") - 1  # the run that ends or holds the unit
        run = np.maximum(run, 0)
        inside = self.starts[run] + (goal - self.before[run]) * self.size[np.minimum(run, len(self.size) - 1)] if len(self.size) else self.starts[run]
        return np.where(unit == 0, self.starts[self.first[text]], inside)

    def unit_at(self, text: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The units of each text that end at or before a byte of it."""
        if not len(self.size):
            return np.zeros(len(text), np.int64)
        run = np.clip(np.searchsorted(self.starts, byte, side="right") - 1, 0, len(self.size) - 1)
        return self.before[run] + (byte - self.starts[run]) // self.size[run] - self.before[self.first[text]]


def _table(starts: np.ndarray, units: np.ndarray, size: np.ndarray, off: np.ndarray) -> Runs:
    before = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(units, out=before[1:])
    return Runs(np.append(starts, off[-1]), before, size, np.searchsorted(starts, off).astype(np.int64))


def _changes(classes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where another class or another text begins."""
    change = np.ones(len(classes), bool)
    change[1:] = classes[1:] != classes[:-1]
    change[heads] = True
    return np.flatnonzero(change)


def word_runs(raw: np.ndarray, off: np.ndarray) -> Runs:
    """White space and words. A word is a unit together with white space before it; so is white space that ends a text."""
    heads = off[:-1][np.diff(off) > 0]
    space = _SPACE[raw]
    starts = _changes(space, heads)
    length = np.diff(np.append(starts, len(raw)))
    last = np.isin(starts + length, off)
    return _table(starts, (~space[starts] | last).astype(np.int64), length, off)


def char_runs(raw: np.ndarray, off: np.ndarray) -> Runs:
    """Characters of equal width in UTF-8; every character is a unit."""
    leads = np.flatnonzero((raw & 0xC0) != 0x80)
    width = np.diff(np.append(leads, len(raw)))
    at = _changes(width, np.searchsorted(leads, off[:-1][np.diff(off) > 0]))
    return _table(leads[at], np.diff(np.append(at, len(leads))), width[at], off)


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from the seed and the id; a row without an id has those of an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


_OUT = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}


def transformed(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, units: str = "words", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Each text with a part moved to its end, for training to fill in the middle.

    Returns doc_id, n (units of the text), form, prefix_chars, middle_chars (code points, null if plain) and output.
    ``percent`` of the texts are cut in two places, drawn with the seed and the id: ``psm`` is mark, prefix, mark, suffix,
    mark, middle; ``spm``, ``spm_percent`` of these, has the suffix first. The others, and every text that contains
    a mark or is empty, are ``plain``. ``units``: "words" (with the white space before them) or "chars".

    A null text is empty. A text of any length is cut whole, in two places. Rows with one doc_id are cut by the same draws, rows
    without one by those of no id. An empty table gives an empty result. Columns other than doc_id and text are ignored."""
    if units not in UNITS:
        raise ValueError(f"units are {' or '.join(UNITS)}")
    table = word_runs if units == "words" else char_runs
    p, s, m = (x.encode() for x in marks)
    if len({p, s, m}) < 3 or any(len(x) < 3 or x[:1] != b"<" or x[-1:] != b">" or b"<" in x[1:] or b">" in x[:-1] for x in (p, s, m)):
        raise ValueError("marks are three different names in angle brackets")  # then none can begin inside another

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, raw, off in text_chunks(batch.column("text")):
                n_texts, data = len(off) - 1, raw.tobytes()
                runs, chars = table(raw, off), char_runs(raw, off)
                n = runs.units()
                drawn = np.array([draws(seed, doc) for doc in ids[first : first + n_texts]], np.int64)
                cuts = np.sort(drawn[:, :2] % (n[:, None] + 1), axis=1)
                each = np.arange(n_texts)
                a, b = runs.offset(each, cuts[:, 0]), runs.offset(each, cuts[:, 1])
                prefix = chars.unit_at(each, a)
                middle = chars.unit_at(each, b) - prefix
                forms, outputs = [], []
                for k in range(n_texts):
                    begin, end = int(off[k]), int(off[k + 1])
                    text = data[begin:end]
                    if not text or drawn[k, 2] % 100 >= percent or p in text or s in text or m in text:
                        form, out = "plain", text
                    else:
                        x, y, z = data[begin : a[k]], data[a[k] : b[k]], data[b[k] : end]
                        form, out = ("spm", b"".join((s, z, p, x, m, y))) if drawn[k, 3] % 100 < spm_percent else ("psm", b"".join((p, x, s, z, m, y)))
                    forms.append(form)
                    outputs.append(out)
                plain = np.array([f == "plain" for f in forms])
                yield arrow_batches(_OUT, {
                    "doc_id": ids[first : first + n_texts], "n": n, "form": forms, "prefix_chars": pa.array(prefix, mask=plain),
                    "middle_chars": pa.array(middle, mask=plain), "output": pa.array(outputs, pa.binary()).cast(pa.string()),
                })

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, T._parse_datatype_string(schema))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. The marks stand in a known order and no part contains one."""
    p, s, m = marks

    def between(left: str, right: str) -> Column:
        begin = F.instr(output, left) + len(left)
        return F.substr(output, begin, F.instr(output, right) - begin)

    middle = F.substr(output, F.instr(output, m) + F.lit(len(m)))
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def digested(found: DataFrame) -> DataFrame:
    """The rows of ``transformed`` with digests of output and restored text for the output."""
    back = restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


def oracle_sql(seed: int = 42, percent: int = 50, spm_percent: int = 80) -> str:
    """DuckDB SQL for digested(transformed(documents)): tokens as a list, parts as slices of it."""
    p, s, m = MARKS
    draw = lambda k: f"CAST('0x' || substr(digest, {8 * k + 1}, 8) AS BIGINT)"
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('{seed}:' || doc_id) AS digest,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens FROM documents),
c AS (SELECT *, len(tokens) AS n, {draw(0)} % (len(tokens) + 1) AS a, {draw(1)} % (len(tokens) + 1) AS b, {draw(2)} % 100 AS plainly, {draw(3)} % 100 AS way FROM t),
f AS (
  SELECT doc_id, n, body, CASE WHEN body = '' OR contains(body, '{p}') OR contains(body, '{s}') OR contains(body, '{m}') OR plainly >= {percent} THEN 'plain'
      WHEN way < {spm_percent} THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(tokens[1:least(a, b)], '') AS prefix, array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(tokens[greatest(a, b) + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN body ELSE prefix || middle || suffix END) AS restored_sha256
FROM f"""
