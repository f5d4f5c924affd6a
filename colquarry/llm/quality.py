"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each text gets counts of words, symbols, repeated lines and repeated five-word windows. A rule compares a ratio of two
counts with a cutoff, and a path of steps leads all rules together from their most lenient cutoffs to their strictest, so what
one step rejects the next one rejects too. How far down the path one may go is decided on labelled documents, apart for each
stratum: a step is certified if so few good documents are rejected by it that, by the exact binomial tail, a false rejection rate
above the permitted one can be excluded. Steps are tested in their order up to the first that fails, which needs no correction; the error
is shared out over the tests. Strata that have too few labels for a certificate are tested together as one. Where even these are too
few, nothing is certified and nothing rejected.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Steps of the path after its beginning.
STEPS = 40


@dataclass(frozen=True)
class Rule:
    """Rejects where scale * numerator > cutoff * denominator, for a whole cutoff from first to last."""

    name: str
    numerator: str
    denominator: str
    scale: int
    first: int
    last: int

    def cutoff(self, step: int) -> int:
        """The cutoff at a step of the path, ``last`` at the first."""
        return self.last - step * (self.last - self.first) // STEPS

    def step(self) -> Column:
        """The first step that rejects, STEPS + 1 if none does."""
        exceeded = f"least(({self.scale} * {self.numerator} - 1) div {self.denominator}, {self.last}L)"
        at = f"(({self.last} - {exceeded}) * {STEPS} + {self.last - self.first - 1}) div {self.last - self.first}"
        return F.expr(f"CASE WHEN {self.numerator} > 0 AND {self.denominator} > 0 THEN least({at}, {STEPS + 1}L) ELSE {STEPS + 1}L END")


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 100, 1, 40),
    Rule("capitals", "n_capitals", "word_chars", 100, 5, 90),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 100, 5, 90),
    Rule("repeated_words", "n_repeat_words", "n_words", 100, 1, 20),
    Rule("long_words", "word_chars", "n_words", 1, 6, 40),
)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_capitals.

    Windows are compared by the 64-bit hash of their words, sorted with their places where any repeat; every
    text stays one row. Columns of these names (and of _words, _windows, _pairs, _places) are replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.size("_words")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    out = docs.withColumn("_words", F.array_remove(F.split(body, SPACES), "")).withColumn("_lines", lines)
    hashes = F.transform(
        F.slice("_words", 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get("_words", i + k) for k in range(1, WINDOW)))
    )
    out = out.withColumn("_windows", hashes)
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_pairs", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda p, at: F.coalesce(F.get("_pairs", at)["h"] == p["h"], F.lit(False))
    repeated = F.filter("_pairs", lambda p, k: same(p, k - 1) | same(p, k + 1))
    out = out.withColumn("_places", F.when(repeats, F.sort_array(F.transform(repeated, lambda p: p["i"]))))
    covered = F.transform("_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", k + 1) - p, F.lit(WINDOW))))
    return out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, f"[{SYMBOLS}]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_capitals": (F.length(body) - F.length(F.regexp_replace(body, "[A-Z]+", ""))).cast("long"),
        }
    ).drop("_words", "_lines", "_windows", "_pairs", "_places")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(n: str, k: str, rate: float) -> Column:
    """P(X <= k) for X binomial with n trials of the given rate, for k < n * rate: the term at k, from factorials by
    Stirling's series, times one plus the ratios of the terms below it.

    Terms shrink downwards, by forty deviations to nothing that a double could hold, so no more of them are summed:
    the number of steps grows with the root of n."""
    odds = rate / (1 - rate)
    few = F.least(F.col(k), F.ceil(40 * F.sqrt(F.col(n) * rate)).cast("long") + 100)
    below = F.aggregate(
        F.when(F.col(k) > 0, F.sequence(F.col(k), F.col(k) - few + 1, F.lit(-1))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda a, i: F.struct(
            (a["term"] * i / ((F.col(n) - i + 1) * odds)).alias("term"), (a["total"] + a["term"] * i / ((F.col(n) - i + 1) * odds)).alias("total")
        ),
    )["total"]
    def log_factorial(x: Column) -> Column:
        """Of whole numbers: a sum up to 30, the series beyond, whose next term is under 1e-13 there."""
        near = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.least(x, F.lit(30)), F.lit(1)).cast("long")), F.lit(0.0), lambda a, i: a + F.ln(i))
        far = x * F.ln(x) - x + F.ln(x) / 2 + log(2 * pi) / 2 + 1 / (12.0 * x) - 1 / (360.0 * x * x * x) + 1 / (1260.0 * x * x * x * x * x)
        return F.when(x <= 30, near).otherwise(far)

    ways = log_factorial(F.col(n)) - log_factorial(F.col(k)) - log_factorial(F.col(n) - F.col(k))
    return F.exp(ways + F.col(k) * log(rate) + (F.col(n) - F.col(k)) * log(1 - rate)) * below


def thresholds(labelled: DataFrame, rate: float, error: float) -> DataFrame:
    """stratum and the last certified step, from rows (stratum, step) of good documents; no row where none is certified.

    Every count is an aggregate over (stratum, step), of which there are at most STEPS + 2 a stratum. A stratum without as many
    labels as a certificate without a false rejection needs at the number of strata joins the others of that kind. Each test may err by ``error``
    over the number of groups that are tested."""
    counted = labelled.groupBy("stratum", "step").agg(F.count("*").alias("c"))
    totals = counted.groupBy("stratum").agg(F.sum("c").alias("labels"))
    strata = totals.agg(F.count("*").alias("strata"))
    few = F.col("labels") * log(1 - rate) > F.ln(F.lit(error) / F.col("strata"))
    grouped = totals.join(strata).select("stratum", F.when(few, F.lit("")).otherwise(F.concat(F.lit("="), "stratum")).alias("group"))  # one row
    points = counted.join(grouped, "stratum").groupBy("group", "step").agg(F.sum("c").alias("c"))
    sized = points.withColumn("n", F.sum("c").over(Window.partitionBy("group")))
    tests = sized.select("group", "n").distinct()
    grid = tests.join(tests.agg(F.count("*").alias("tests"))).withColumn("tested", F.explode(F.sequence(F.lit(0), F.lit(STEPS))))
    rejected = grid.join(sized.select("group", "step", "c"), "group").groupBy("group", "tests", "n", "tested").agg(F.coalesce(F.sum(F.when(F.col("step") <= F.col("tested"), F.col("c"))), F.lit(0)).alias("k"))
    # a step further down rejects no fewer, so its tail is no lower: the certified ones are the first ones
    passed = rejected.where(F.col("k") < F.col("n") * rate).where(binomial_tail("n", "k", rate) <= F.lit(error) / F.col("tests"))
    return grouped.join(passed.groupBy("group").agg(F.max("tested").alias("certified")), "group").select("stratum", "certified")


def judge(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", rate: float = 0.01, error: float = 0.05, rules: tuple[Rule, ...] = RULES, carry: list[str] | None = None
) -> DataFrame:
    """The features of every document with base_failed and kept.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows. kept is false if base_failed; else false
    if some rule rejects at the last step certified for the document's stratum, so that with confidence 1 - ``error`` no stratum
    (or all those together that have few labels) loses more than ``rate`` of its good documents to the rules.

    ``labels``: doc_id and quality (1 good); a document with several labels is good if none says otherwise. Copies of
    a text count once, for trials must be independent. A very long text is judged whole. A
    null text has no words. A null stratum is a stratum of its own; a null doc_id has no label. Repeated rows
    are judged each. Empty tables give an empty result, and no labels leave the base rules only. ``carry``: the
    columns to return along with the results (doc_id alone if not given)."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    given = carry or ["doc_id"]
    base = docs.select(F.col("doc_id").alias("_doc"), *given, F.col("text").alias("_text"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
    step = F.least(*(r.step() for r in rules), F.lit(STEPS + 1).cast("long"), F.lit(STEPS + 1).cast("long"))
    found = features(base, "_text").withColumns({"base_failed": base_failed(), "step": step})
    judged = materialize(found.select("_doc", F.xxhash64("_text").alias("_hash"), *given, "stratum", *made, "base_failed", "step"), "quality")
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    good = good.select(F.col("doc_id").alias("_doc"))
    holdout = judged.where("not base_failed").select("_doc", "_hash", "stratum", "step").join(good, "_doc").drop("_doc").distinct()
    out = judged.join(thresholds(holdout, rate, error), "stratum", "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("step") <= F.col("certified"), F.lit(False))).select(*given, *made, "base_failed", "kept")


def oracle_sql(stratum: str = "lang", rate: float = 0.01, error: float = 0.05, rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for judge() over documents and labels; the tail is a sum of terms by lgamma instead."""
    exceeded = lambda r: f"least(({r.scale} * {r.numerator} - 1) // {r.denominator}, {r.last})"
    at = lambda r: f"CASE WHEN {r.numerator} > 0 AND {r.denominator} > 0 THEN least((({r.last} - {exceeded(r)}) * {STEPS} + {r.last - r.first - 1}) // {r.last - r.first}, {STEPS + 1}) ELSE {STEPS + 1} END"
    step = f"least({', '.join(map(at, rules))}, {STEPS + 1})"
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate!r}) + (n - i) * ln(1 - {rate!r}))"
    return f"""
WITH t AS (
  SELECT doc_id, coalesce({stratum}, '') AS stratum, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '{WORD}+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
win AS (SELECT doc_id, i, words[i:i + {WINDOW - 1}] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM t)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS c FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM win),
  (SELECT unnest(range({WINDOW})) AS j) WHERE times > 1 GROUP BY doc_id),
c AS (
  SELECT t.doc_id, stratum, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(body) - length(regexp_replace(body, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.c, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(body) - length(regexp_replace(body, '[A-Z]', '', 'g')) AS n_capitals
  FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {step} AS step FROM c),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
h AS (SELECT DISTINCT body, f.stratum, step FROM f JOIN good USING (doc_id) JOIN t USING (doc_id) WHERE NOT base_failed),
tot AS (SELECT stratum, count(*) AS labels, (SELECT count(DISTINCT stratum) FROM h) AS strata FROM h GROUP BY 1),
grp AS (SELECT stratum, CASE WHEN labels * ln(1 - {rate!r}) > ln({error!r} / strata) THEN '' ELSE '=' || stratum END AS grp FROM tot),
hg AS (SELECT grp, (SELECT count(DISTINCT grp) FROM grp) AS tests, step FROM h JOIN grp USING (stratum)),
test AS (SELECT grp, tests, tested, count(*) AS n, count(*) FILTER (step <= tested) AS k FROM hg, (SELECT unnest(range(0, {STEPS + 1})) AS tested) GROUP BY ALL),
p AS (SELECT grp, tests, tested, list_sum(list_transform(range(0, k + 1), lambda i: {term})) AS tail FROM test WHERE k < n * {rate!r}),
cut AS (SELECT stratum, max(tested) AS certified FROM p JOIN grp USING (grp) WHERE tail <= {error!r} / tests GROUP BY 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(step <= certified, false) AS kept
FROM f LEFT JOIN cut USING (stratum)"""
