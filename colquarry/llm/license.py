"""Licences in texts, by the Dice coefficient of word bigrams, in DataFrame functions only.

A text is normalised to lower-cased runs of letters and digits, so comment marks and line ends vanish. It is compared
with templates, whole licences and short notices, in windows: a window begins where a run of the template's bigrams
begins, has as many words as the template at most, and ends with the last of the template's bigrams in that reach.
The coefficient is that of the distinct bigrams of window and template.

Licences that are close tell each other apart by the bigrams that one has and the other lacks: a window must hold half of
those that its template has over each close one of another name. Of windows that overlap the one that shares the most bigrams with its
template stays, so a notice inside its licence, or a licence inside a longer one, isn't named again.

A coefficient of t or more needs t / (2 - t) of the template's distinct bigrams. So a template is left out where the
text has fewer bigrams than that, or fewer of the template's; and a text is left out whole if it has none of the
words without which no template can reach that many.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common notices and the first sentences of the licences. The whole texts lie in license_texts.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

#: Of 100, so that no comparison rounds.
THRESHOLD = 80
#: Of 100: templates of different names from this coefficient on are told apart by the bigrams of their own.
CLOSE = 60
#: Templates of fewer words are looked for in every text; longer ones have needed words of their own.
SHORT = 60


@cache
def templates() -> tuple[tuple[str, str], ...]:
    """(name, text): the notices, and the whole licences by the names of their files."""
    whole = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return (*NOTICES, *((path.stem, path.read_text(encoding="utf-8")) for path in whole))


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text: str) -> list[str]:
    found = words(text)
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:])})


def least_common(n: int, threshold: int) -> int:
    """How many of a template's n distinct bigrams a window must have."""
    return -(-threshold * n // (200 - threshold))


def own_bigrams(given: tuple[tuple[str, str], ...]) -> list[list[list[str]]]:
    """For each template, and each close one of another name, the bigrams that only the first has."""
    sets = [(name, set(bigrams(text))) for name, text in given]
    close = lambda a, b: 200 * len(a & b) >= CLOSE * (len(a) + len(b))
    return [[sorted(a - b) for other, b in sets if other != name and close(a, b) and a - b] for name, a in sets]


def needed_words(given: tuple[tuple[str, str], ...], threshold: int) -> list[str]:
    """Words of which every text that matches has one: for each template words whose bigrams are more than a match
    can do without. Long words, which fewer texts have, go first, of these the ones in most bigrams."""
    chosen: set[str] = set()
    for _, text in given:
        left = bigrams(text)
        spare = len(left) - least_common(len(left), threshold)
        own = sorted({w for b in left for w in b.split(" ")}, key=lambda w: (w not in chosen, len(w) < 6, -sum(w in b.split(" ") for b in left), w))
        covered: set[str] = set()
        for word in own:
            if len(covered) > spare:
                break
            more = {b for b in left if word in b.split(" ")}
            if more - covered:
                covered |= more
                chosen.add(word)
    return sorted(chosen)


def _list(values: list[str]) -> Column:
    """A constant array, of one literal: values hold letters, digits and spaces only."""
    return F.split(F.lit("|".join(values)), r"\|")


def _lists(values: list[list[str]]) -> Column:
    return F.array(*map(_list, values)) if values else F.array().cast("array<array<string>>")


def scan(docs: DataFrame, threshold: int = THRESHOLD, given: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """doc_id, license, dice, first_word, n_matches and licenses of every row.

    A match is a window that reaches ``threshold``, has what tells its template from close ones, and overlaps no match with more of
    its template's bigrams (of equals with a lower coefficient, a name or a place that comes later). license, dice and first_word: the
    name of the template, the coefficient and where the window begins (in words, from 0) of the best match (of equals the
    name that sorts first, then the first window), null without any; n_matches: matches; licenses: the names they have,
    sorted, joined by commas, empty if none. A null or empty text, or one of a single word, has none. A very long text is searched whole. Rows are
    never grouped, so repeated rows and null ids stay as they are. An empty table gives an empty result. Columns
    other than doc_id and text are ignored."""
    given = templates() if given is None else given
    sets = [(name, len(words(text)), bigrams(text)) for name, text in given]
    constant = F.array(*(
        F.struct(F.lit(name).alias("name"), F.lit(m).alias("m"), F.lit(len(b)).alias("n"), F.lit(least_common(len(b), threshold)).alias("need"), _list(b).alias("bigrams"), _lists(own).alias("own"))
        for (name, m, b), own in zip(sets, own_bigrams(given))
    ))
    t = F.lit(threshold)
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    out = docs.select("doc_id", F.split(plain, " ").alias("_words"))
    short = tuple(x for x in given if len(words(x[1])) < SHORT)
    long_ = tuple(x for x in given if len(words(x[1])) >= SHORT)
    fewest = min((least_common(len(bigrams(x)), threshold) for _, x in long_), default=0)
    has = lambda group: F.arrays_overlap("_words", _list(needed_words(group, threshold))) if group else F.lit(False)
    hinted = has(short) | ((F.size("_words") > fewest) & has(long_))
    pairs = F.zip_with(F.slice("_words", 1, F.size("_words") - 1), F.slice("_words", 2, F.size("_words")), lambda a, b: F.concat_ws(" ", a, b))
    found = F.when(hinted & (F.size("_words") > 1), pairs).otherwise(F.array().cast("array<string>"))
    out = out.select("doc_id", found.alias("_g"))
    # size bounds: the text's distinct bigrams, then those it shares
    possible = F.filter(constant, lambda x: x["need"] <= F.size("_g"))
    shared = F.transform(possible, lambda x: F.struct(*(x[c].alias(c) for c in ("name", "m", "n", "need", "own")), F.array_intersect("_g", x["bigrams"]).alias("common")))
    out = out.select("doc_id", "_g", F.filter(shared, lambda x: F.size(x["common"]) >= x["need"]).alias("_t"))
    flags = lambda x: F.transform("_g", lambda g: F.array_contains(x["common"], g))
    placed = F.transform("_t", lambda x: F.struct(x.alias("t"), flags(x).alias("hit")))

    def windows(x: Column) -> Column:
        t_, hit = x["t"], x["hit"]
        at = F.sequence(F.lit(0), F.size(hit) - 1)
        begins = F.filter(at, lambda i: F.get(hit, i) & ~F.coalesce(F.get(hit, i - 1), F.lit(False)))

        def window(i: Column) -> Column:
            reach = F.slice(hit, i + 1, t_["m"] - 1)
            length = F.size(reach) + 1 - F.array_position(F.reverse(reach), True).cast("int")
            unit = F.slice("_g", i + 1, length)
            both = F.size(F.array_intersect(unit, t_["common"]))
            total = F.size(F.array_distinct(unit)) + t_["n"]
            told = F.forall(t_["own"], lambda own: 2 * F.size(F.array_intersect(unit, own)) >= F.size(own))
            match = F.struct((-both).alias("minus_shared"), (F.lit(-2.0) * both / total).alias("minus"), t_["name"].alias("name"), i.alias("first_word"), (i + length).alias("last_word"))
            return F.when((200 * both >= t * total) & told, match)

        return F.filter(F.transform(begins, window), lambda w: w.isNotNull())

    ordered = F.array_sort(F.flatten(F.transform(placed, windows)))
    apart = lambda v, w: (v["first_word"] > w["last_word"]) | (v["last_word"] < w["first_word"])
    none = F.array().cast("array<struct<minus_shared:int,minus:double,name:string,first_word:int,last_word:int>>")
    kept = F.aggregate(ordered, none, lambda done, w: F.when(F.forall(done, lambda v: apart(v, w)), F.array_append(done, w)).otherwise(done))
    out = out.select("doc_id", kept.alias("_found"))
    best = F.array_min(F.transform("_found", lambda w: F.struct(w["minus"].alias("minus"), w["name"].alias("name"), w["first_word"].alias("first_word"))))
    names = F.array_sort(F.array_distinct(F.transform("_found", lambda w: w["name"])))
    return out.select(
        "doc_id", best["name"].alias("license"), (-best["minus"]).alias("dice"), best["first_word"].cast("long").alias("first_word"), F.size("_found").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"),
    )


def oracle_sql(threshold: int = THRESHOLD, given: tuple[tuple[str, str], ...] | None = None) -> str:
    """DuckDB SQL for scan() over documents, by joins of the bigrams with their places."""
    given = templates() if given is None else given
    rows = ", ".join(f"({k}, '{name}', {len(words(text))}, {len(b)}, '{'|'.join(b)}')" for k, (name, text) in enumerate(given) for b in [bigrams(text)])
    rivals = ", ".join(f"({k}, {r}, '{'|'.join(own)}')" for k, many in enumerate(own_bigrams(given)) for r, own in enumerate(many)) or "(-1, 0, '')"
    t = threshold
    return f"""
WITH tpl AS (SELECT * FROM (VALUES {rows}) v(k, name, m, n, bigrams)),
tb AS (SELECT k, unnest(string_split(bigrams, '|')) AS g FROM tpl),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, i - 1 AS i, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
h AS (SELECT p.doc_id, tb.k, p.i, p.g FROM p JOIN tb USING (g)),
c AS (SELECT h.doc_id, h.k FROM h JOIN tpl USING (k) GROUP BY h.doc_id, h.k, n HAVING {200 - t} * count(DISTINCT g) >= {t} * n),
hits AS (SELECT h.* FROM h JOIN c USING (doc_id, k)),
runs AS (SELECT doc_id, k, i FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id, k ORDER BY i) AS before FROM hits) WHERE before IS NULL OR before < i - 1),
ends AS (SELECT r.doc_id, r.k, r.i, max(x.i) AS e, count(DISTINCT x.g) AS common FROM runs r JOIN tpl USING (k) JOIN hits x ON x.doc_id = r.doc_id AND x.k = r.k AND x.i >= r.i AND x.i <= r.i + m - 2 GROUP BY ALL),
sized AS (SELECT s.doc_id, s.k, s.i, s.e, s.common, count(DISTINCT p.g) AS unit FROM ends s JOIN p ON p.doc_id = s.doc_id AND p.i >= s.i AND p.i <= s.e GROUP BY ALL),
d AS (SELECT doc_id, k, name, i, e, common, 2.0::DOUBLE * common / (unit + n) AS dice FROM sized JOIN tpl USING (k) WHERE 200 * common >= {t} * (unit + n)),
own AS (SELECT k, r, len(string_split(own, '|')) AS size, unnest(string_split(own, '|')) AS g FROM (VALUES {rivals}) v(k, r, own)),
asked AS (SELECT DISTINCT k, r, size FROM own),
held AS (SELECT d.doc_id, d.k, d.i, own.r, count(DISTINCT own.g) AS c FROM d JOIN own USING (k) JOIN hits x ON x.doc_id = d.doc_id AND x.k = d.k AND x.i >= d.i AND x.i <= d.e AND x.g = own.g GROUP BY ALL),
unlike AS (SELECT DISTINCT d.doc_id, d.k, d.i FROM d JOIN asked USING (k) LEFT JOIN held ON held.doc_id = d.doc_id AND held.k = d.k AND held.i = d.i AND held.r = asked.r WHERE 2 * coalesce(held.c, 0) < asked.size),
told AS (SELECT * FROM d ANTI JOIN unlike USING (doc_id, k, i)),
listed AS (SELECT doc_id, list({{'s': -common, 'd': -dice, 'name': name, 'i': i, 'e': e + 1}} ORDER BY -common, -dice, name, i, e) AS ws FROM told GROUP BY 1),
kept AS (SELECT doc_id, unnest(list_reduce(list_transform(ws, lambda w: [w]), lambda done, w: CASE WHEN len(list_filter(done, lambda v: v.i <= w[1].e AND v.e >= w[1].i)) > 0 THEN done ELSE list_concat(done, w) END)) AS w FROM listed),
f AS (SELECT doc_id, arg_min(w.name, (w.d, w.name, w.i)) AS license, -min(w.d) AS dice, arg_min(w.i, (w.d, w.name, w.i)) AS first_word, count(*) AS n_matches,
  array_to_string(list_sort(list_distinct(list(w.name))), ',') AS licenses FROM kept GROUP BY doc_id)
SELECT o.doc_id, f.license, f.dice, f.first_word, CAST(coalesce(f.n_matches, 0) AS BIGINT) AS n_matches, coalesce(f.licenses, '') AS licenses
FROM documents o LEFT JOIN f USING (doc_id)"""
