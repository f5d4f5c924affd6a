"""Language identification by Bayesian fusion of evidence.

The text's likelihood under each language comes from counts of letter trigrams, fitted on a bounded sample of
labelled texts. A page also says where it comes from and what it claims: its host, its address suffix and the
language that its markup declares. What hosts and suffixes tell is taken from the texts themselves: posterior
masses summed by host and suffix give priors, a host's smoothed towards its suffix's and that towards the whole,
with the row's own share taken out; masses summed by declared language give how often each language declares it.
The posterior is the product of the three.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, text_chunks

#: Labelled texts that the trigram counts are fitted on, in expectation.
SAMPLE_ROWS = 20_000
#: Languages that a model knows at most, the most frequent ones of the sample: their weights, 16 MB, go to every task.
MOST_LANGUAGES = 64
#: Trigrams overlap, so their evidence counts for this share.
TEMPER = 0.3
#: Rows that a parent's prior counts for.
STRENGTH = 20.0
_BITS = 15

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams that hold a letter in the middle (a-z without case, or of other scripts),
    and the text of each; what isn't a letter counts as a space."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    x = _LETTER[raw].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = (text[:-2] == text[2:]) & (x[1:-1] != 32)
    bucket = ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(32 - _BITS)
    return bucket[inside].astype(np.int64), text[1:-1][inside]


class Model:
    """weights: the logarithm of each trigram bucket's share in each language, bucket by language."""

    def __init__(self, languages: list[str], weights: np.ndarray) -> None:
        self.languages, self.weights = languages, weights

    def likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text the log-likelihood of each language and the number of trigrams."""
        n = len(column)
        total, count = np.zeros((n, len(self.languages))), np.zeros(n, np.int64)
        for first, raw, off in text_chunks(column):
            bucket, text = trigrams(raw, off)
            k = len(off) - 1
            count[first : first + k] = np.bincount(text, minlength=k)
            for j in range(len(self.languages)):
                total[first : first + k, j] = np.bincount(text, self.weights[bucket, j], minlength=k)
        return total, count


def in_sample(rows: int, sample_rows: int = SAMPLE_ROWS) -> Column:
    """Whether a row of columns lang and text is one that ``fit`` learns from, out of so many rows."""
    share = min(1.0, sample_rows / max(1, rows))
    return F.pmod(F.xxhash64("lang", "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, most_languages: int = MOST_LANGUAGES) -> Model:
    """Fit on columns lang and text: about ``sample_rows`` rows, chosen by a hash of both, evenly, and of these the
    ``most_languages`` most frequent languages. Rows without either are left out; very long texts count whole."""
    labelled = labelled.where("lang is not null and text is not null").select("lang", "text")
    rows = labelled.select(F.count("*")).first()[0]
    chosen = labelled.where(in_sample(rows, sample_rows))
    frequent = chosen.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    chosen = chosen.where(F.col("lang").isin([r["lang"] for r in frequent]))

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs.tolist()):
                part = batch.column("text").filter(pa.array(langs == lang))
                found = np.zeros(1 << _BITS, np.int64)
                for _, raw, off in text_chunks(part):
                    found += np.bincount(trigrams(raw, off)[0], minlength=1 << _BITS)
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(found[at])], names=["lang", "bucket", "n"])

    counts = chosen.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in counts})
    table = np.full((1 << _BITS, max(1, len(languages))), 0.5)
    for r in counts:
        table[r["bucket"], languages.index(r["lang"])] += r["n"]
    return Model(languages or ["und"], np.log(table / table.sum(axis=0)))


def _scored(model: Model, carry: list[tuple[str, str]]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, count = model.likelihoods(batch.column("text"))
            total = TEMPER * (total - total.max(axis=1, keepdims=True))
            share = np.exp(total)
            share /= share.sum(axis=1, keepdims=True)
            lists = lambda x: pa.array(list(x), pa.list_(pa.float64()))
            names = [c for c, _ in carry]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(count), lists(total), lists(share)], names=[*names, "n_trigrams", "log_text", "by_text"])

    return run


def identify(docs: DataFrame, model: Model, keys: list[str], host: Column, suffix: Column, declared: Column, least: float = 0.5) -> DataFrame:
    """``keys`` (none of them named like a result) with lang, posterior and kept, from the column text and the
    given evidence.

    lang: the language of the highest posterior (of equals the one that sorts last), null for a text without
    letters (null and empty texts as well); a very long text counts whole; kept: lang is known with a posterior of ``least`` or more. Evidence
    that is null, and a declared language that no language of the model starts, is left out. Hosts and declared
    languages may hold any share of the rows: they are summed by partial aggregates and joined back by tables of a
    row for each. Repeated rows are kept, an empty table gives an empty result."""
    names = model.languages
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    claimed = F.regexp_extract(F.lower(F.trim(declared)), r"\A[a-z]+", 0)
    given = docs.select(*keys, clean(host).alias("host"), clean(suffix).alias("suffix"), F.when(claimed.isin(names), claimed).alias("declared"), "text")
    carry = [(f.name, f.dataType) for f in given.schema if f.name != "text"]
    schema = T.StructType([T.StructField(c, t) for c, t in carry])
    schema = schema.add("n_trigrams", "long").add("log_text", T.ArrayType(T.DoubleType())).add("by_text", T.ArrayType(T.DoubleType()))
    scored = materialize(given.mapInArrow(_scored(model, carry), schema), "languages")

    known = F.col("n_trigrams") > 0
    sums = lambda name: [F.count(F.when(known, 1)).alias(f"{name}_n"), F.array(*(F.coalesce(F.sum(F.when(known, F.col("by_text")[i])), F.lit(0.0)) for i in range(len(names)))).alias(name)]
    everywhere = scored.agg(*sums("a")).first()
    whole, n = list(everywhere["a"]), everywhere["a_n"]
    whole = [(x + 1) / (n + len(names)) for x in whole]
    by_suffix = scored.where("suffix is not null").groupBy("suffix").agg(*sums("s"))
    by_host = scored.where("host is not null").groupBy("host").agg(*sums("h"))
    by_claim = scored.where("declared is not null").groupBy("declared").agg(*sums("d"))
    claims = scored.where("declared is not null").agg(*sums("c")).first()["c"]
    both = scored.join(by_suffix, "suffix", "left").join(by_host, "host", "left").join(by_claim, "declared", "left")

    own = lambda i: F.when(known, F.col("by_text")[i]).otherwise(0.0)
    mine = F.when(known, 1).otherwise(0)
    scores = []
    for i, name in enumerate(names):
        prior = F.lit(whole[i])
        for level in ("s", "h"):
            smooth = (F.greatest(F.col(level)[i] - own(i), F.lit(0.0)) + STRENGTH * prior) / (F.col(f"{level}_n") - mine + STRENGTH)
            prior = F.coalesce(smooth, prior)
        claim = (F.greatest(F.col("d")[i] - own(i), F.lit(0.0)) + 1.0) / (F.greatest(F.lit(claims[i]) - own(i), F.lit(0.0)) + float(len(names)))
        scores.append(F.col("log_text")[i] + F.ln(prior) + F.when(F.col("d").isNotNull(), F.ln(claim)).otherwise(0.0))
    out = both.withColumn("_scores", F.array(*(F.struct(s.alias("s"), F.lit(name).alias("name")) for s, name in zip(scores, names))))
    best = F.array_max("_scores")
    mass = F.aggregate("_scores", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - F.array_max("_scores")["s"]))
    lang = F.when(known & F.lit(names != ["und"]), best["name"])
    return out.select(*keys, lang.alias("lang"), F.when(lang.isNotNull(), 1 / mass).alias("posterior")).withColumn(
        "kept", F.coalesce(F.col("lang").isNotNull() & (F.col("posterior") >= least), F.lit(False))
    )


def page_text(html: Column) -> Column:
    """A page's text: without scripts, styles, comments, tags and character references."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[A-Za-z0-9#]{1,10};", " ")


def page_evidence(url: Column, html: Column) -> dict[str, Column]:
    host = F.regexp_extract(F.lower(url), r"\A[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    return {
        "host": host,
        "suffix": F.regexp_extract(host, r"\.([a-z]+)\z", 1),
        "declared": F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1),
    }
