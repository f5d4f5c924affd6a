import re

from colquarry.llm import queries
from colquarry.llm.license import NOTICES, bigrams, needed_words, oracle_sql, scan, templates, words

from .oracle import duck, rows

SCHEMA = "doc_id long, text string, license string, dice int, _words string"
WHOLE = dict(templates()[len(NOTICES) :])


def close(a, b):
    a, b = set(bigrams(a)), set(bigrams(b))
    return 2 * len(a & b) / (len(a) + len(b)) >= 0.6


OWN = [[set(bigrams(t)) - set(bigrams(u)) for other, u in templates() if other != name and close(t, u)] for name, t in templates()]


def brute(text, threshold=0.8):
    """Every window of every template, without any bound."""
    found = words(text or "")
    g = [f"{a} {b}" for a, b in zip(found, found[1:])]
    matches = []
    for (name, t), rivals in zip(templates(), OWN):
        b, m = set(bigrams(t)), len(words(t))
        for i in range(len(g)):
            if g[i] not in b or i and g[i - 1] in b:
                continue
            e = max(j for j in range(i, min(len(g), i + m - 1)) if g[j] in b)
            unit = set(g[i : e + 1])
            dice = 2 * len(unit & b) / (len(unit) + len(b))
            if dice >= threshold and all(2 * len(unit & own) >= len(own) for own in rivals):
                matches.append((-len(unit & b), -dice, name, i, e + 1))
    kept = []
    for w in sorted(matches):
        if not any(v[3] <= w[4] and v[4] >= w[3] for v in kept):
            kept.append(w)
    best = min(((d, name, i) for _, d, name, i, _ in kept), default=None)
    return (best[1] if best else None, -best[0] if best else None, best[2] if best else None, len(kept), ",".join(sorted({w[2] for w in kept})))


def texts():
    out = [t for _, t in templates()[:20]] + [
        None, "", "word", "two words", "prose\nReleased under the MIT License.\nmore", "RELEASED -- under the mit   license", "released under the BSD licence",
        "Licensed under the Apache\nLicense, Version 2.0\n\nother", "x " * 20_000, "Licensed under CC BY-NC 4.0.\nLicensed under the MIT License\nÜber ö", "Released under the MIT License. " * 3,
        "A short sentence. Released under the MIT License. Another one.", "\n\n".join(WHOLE[n] for n in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "BSD-2-Clause")),
        " ".join(t for n, t in NOTICES if n.startswith(("CC", "GPL"))),
    ]
    for name in ("MIT", "ISC", "BSD-3-Clause", "BSD-2-Clause", "Unlicense"):
        wrapped = "\n".join(" * " + " ".join(WHOLE[name].split()[i : i + 9]) for i in range(0, len(WHOLE[name].split()), 9))
        out += [WHOLE[name], "Copyright (c) 2020 Somebody\n\n" + WHOLE[name] + "\nand code", f"/*\n * The {name} licence\n{wrapped}\n */\nint main();", WHOLE[name][: len(WHOLE[name]) // 2], " ".join(w for i, w in enumerate(WHOLE[name].split()) if i % 12)]
    return out


def test_rows_against_brute_force(spark):
    given = list(enumerate(texts()))
    given += [(3, given[3][1]), (None, given[0][1])]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in given], SCHEMA).repartition(3)
    assert sorted((tuple(x) for x in scan(df).collect()), key=str) == sorted(((i, *brute(t)) for i, t in given), key=str)
    assert scan(df.limit(0)).collect() == []
    docs = [{"doc_id": i, "text": t} for i, t in enumerate(texts())]
    assert rows(scan(spark.createDataFrame(docs, "doc_id long, text string"))) == duck(oracle_sql(), documents=docs)


def test_whole_licences_are_found(spark):
    given = []
    for name, t in WHOLE.items():
        lines = "\n".join("# " + line for line in t.splitlines())
        wrapped = "\n".join("// " + " ".join(t.split()[i : i + 17]) for i in range(0, len(t.split()), 17))
        given += [(name, f"{prose}{form}{prose}") for prose in ("", "Some prose before it and after it. " * 30) for form in (t, lines, wrapped)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(given)], "doc_id long, text string").repartition(4)
    for x in scan(df).collect():
        assert x.license == given[x.doc_id][0] and x.dice > 0.97, (x, given[x.doc_id][0])


def test_each_template_names_itself_only(spark):
    df = spark.createDataFrame([(i, f"Before it. {t}\nAfter it.") for i, (_, t) in enumerate(templates())], "doc_id long, text string").repartition(4)
    for x in scan(df).collect():
        name = templates()[x.doc_id][0]
        assert (x.license, x.licenses, x.n_matches) == (name, name, 1), (x, name)


def test_no_match_without_a_needed_word():
    needed = set(needed_words(templates(), 80))
    for name, t in templates():
        left = [b for b in bigrams(t) if not needed & set(b.split(" "))]
        assert 120 * len(left) < 80 * len(bigrams(t)), name


def test_the_query_and_its_sql(spark):
    d = "/root/testdata/sf0.001"
    df = queries.op10_license_scan(spark, d)
    assert rows(df) == duck(queries.ORACLE_SQL["op10_license_scan"], d)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
