"""Personal data replaced by surrogates, in DataFrame functions only.

Entities are found by one pattern over the whole text and checked where their kind has a check (card and account
numbers). An entity's kind and plain form (case, separators, country code and title aside) name it; its surrogate is
drawn from a hash under a secret key, so it is the same in every document and can't be turned back. Surrogates keep
the kind's form: digits stay digits, letters letters of their case, addresses keep their dots, card and account
numbers their checks, hexadecimal secrets stay hexadecimal, names their gender and script. Distinct entities get
distinct surrogates, none of which is an entity of the corpus: what collides is drawn again, longer after some
attempts.

A name is found by its title. Its last word is a family name, the others are given names; each has a surrogate of
its own, so that a person keeps one with and without the given name, and hyphens, particles and beginnings such as
O' and Mc stay. Where a document names somebody by title, the same name without a title is replaced in it as well, and
so is the family name alone, unless an article before it shows that it is a word ("der Berg") or it has two letters.

A telephone number is named without its country code or trunk zero, so its national and international form have one
surrogate. Numbers of four parts behind "version" and the like are no addresses.
"""

from __future__ import annotations

import secrets
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Tables

#: Titles by the gender they show, and names by gender and script.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Господин"), "f": ("Mrs", "Ms", "Frau", "Madame", "Mme", "Señora", "Госпожа"), "n": ("Dr", "Prof")}
GIVEN = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Oscar", "Paul", "Victor"),
    ("f", "latin"): ("Alma", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irma", "Julia", "Karla", "Laura", "Marta", "Nina", "Paula", "Vera"),
    ("n", "latin"): ("Alex", "Robin", "Sam", "Kim", "Toni", "Sascha", "Charlie", "Jules"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев"),
    ("f", "cyrillic"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Лидия"),
    ("n", "cyrillic"): ("Саша", "Женя", "Валя", "Шура"),
}
ENDINGS = {("m", "latin"): "on", ("f", "latin"): "a", ("n", "latin"): "i", ("m", "cyrillic"): "ан", ("f", "cyrillic"): "а", ("n", "cyrillic"): "и"}
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "du", "des", "la", "le", "zu", "zur", "ter", "ten", "af", "dos", "фон")
SYLLABLES = {
    "latin": ("ba", "den", "fa", "gor", "han", "ka", "lin", "mor", "ne", "ral", "sa", "ton", "ve", "wil", "zan", "ri"),
    "cyrillic": ("ба", "ден", "фа", "гор", "ка", "лин", "мор", "не", "рал", "са", "тон", "ве", "зан", "ри", "пол", "ду"),
}

#: Letters and digits outside ASCII by what they match: runs of code points to draw from. What no run meets becomes a Latin letter or a digit.
ALPHABETS = (
    (r"[\p{IsLatin}&&\p{Lu}]", 0xC0, 0xD6), (r"\p{IsLatin}", 0xE0, 0xF6), (r"[\p{IsCyrillic}&&\p{Lu}]", 0x410, 0x42F), (r"\p{IsCyrillic}", 0x430, 0x44F),
    (r"[\p{IsGreek}&&\p{Lu}]", 0x391, 0x3A1), (r"\p{IsGreek}", 0x3B1, 0x3C9), (r"[\p{IsArmenian}&&\p{Lu}]", 0x531, 0x556), (r"\p{IsArmenian}", 0x561, 0x586),
    (r"[\p{IsHebrew}&&\p{L}]", 0x5D0, 0x5EA), (r"[\p{IsArabic}&&\p{L}]", 0x627, 0x63A), (r"[\p{IsArabic}&&\p{N}]", 0x660, 0x669), (r"[\p{IsDevanagari}&&\p{L}]", 0x905, 0x939),
    (r"[\p{IsDevanagari}&&\p{N}]", 0x966, 0x96F), (r"[\p{IsThai}&&\p{L}]", 0xE01, 0xE2E), (r"[\p{IsGeorgian}&&\p{L}]", 0x10D0, 0x10F0), (r"\p{IsHangul}", 0xAC00, 0xD7A3),
    (r"\p{IsHiragana}", 0x3041, 0x3096), (r"\p{IsKatakana}", 0x30A1, 0x30FA), (r"\p{IsHan}", 0x4E00, 0x9FA5), (r"\p{L}", 0x61, 0x7A), (r"\p{N}", 0x30, 0x39),
)
#: A draw is as long as its entity at the first attempts; each later one is a character longer, so no form's space is used up.
SAME_LENGTH = 4

#: Beginnings of access tokens, articles, and calling codes of one and two digits (all others have three).
TOKENS = r"(?:sk-(?:[a-z]{2,8}\d{0,2}-)?|[spr]k_(?:live|test)_|gh[opsur]_|github_pat_|glpat-|xox[abeprs]-|AIza|hf_|npm_|[Bb]earer )"
ARTICLES = ("the", "a", "an", "der", "die", "das", "dem", "den", "des", "ein", "eine", "einem", "einen", "einer", "eines", "le", "la", "les", "un", "une", "el", "los", "las", "una")
CALLING_CODES = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d)"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ALL_TITLES = "|".join(t for ts in TITLES.values() for t in ts)
_WORD = r"(?=\p{Lu}[\p{Ll}'’])\p{Lu}\p{Ll}*+(?:['’-]?\p{Lu}\p{Ll}++)*+"
_NAME = rf"(?:(?:{'|'.join(PARTICLES)}) )*{_WORD}(?: (?:(?:{'|'.join(PARTICLES)}) )*{_WORD}){{0,2}}"
_GROUP = "[0-9A-Fa-f]{1,4}"
_LETTER = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{N}"  # scripts that set words apart, so an address ends where its word does
#: Numbers as North America, then as others write them; a number that goes on with more groups is none.
_NATIONAL = (
    r"\([2-9]\d{2}\) ?[2-9]\d{2}[ .]\d{4}", r"(?<!\d[ .])(?<!\.)[2-9]\d{2}(?:\.[2-9]\d{2}\.| [2-9]\d{2} )\d{4}(?![ .]?\d)",
    r"(?<!\d[ ./-])(?<![./-])0[1-9]\d{1,3}(?: ?/ ?|[ -])(?:\d{6,8}|\d{3,4}[ -]\d{3,4})(?![ ./-]?\d)", r"(?<!\d[ .])(?<!\.)0[1-9](?:[ .]\d{2}){4}(?![ .]?\d)",
)
_PHONE = "|".join((
    r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3}[ .-]\d{4}", r"(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}",
    r"\+[17](?:[ .-]?\d){10}", r"\+[2-9]\d{1,2}(?:[ .-]?\(\d{1,4}\))?(?:[ ./-]?\d){7,12}", *_NATIONAL,
))
_TITLED = rf"(?:(?:{_ALL_TITLES})\.? ){{1,3}}"
#: The kinds in order of precedence, each with its pattern.
PATTERNS = {
    "name": rf"(?=[{''.join(dict.fromkeys(t[0] for ts in TITLES.values() for t in ts))}])(?<![\p{{L}}\p{{N}}]){_TITLED}{_NAME}(?![\p{{L}}\p{{N}}])",
    "secret": r"(?i:password|passwd|secret|api_?key|token)(?: ?[=:] ?)\"?[^\s\"]{6,}\"?",
    "login": r"://[^\s/:@]{1,64}+:[^\s/@]{1,256}+@",
    "email": rf"(?<!{_LETTER}._%+-]){_LETTER}._%+-]{{1,64}}+@{_LETTER}-]++(?:\.{_LETTER}-]++)+",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "token": rf"(?=[a-zAB]){TOKENS}(?=[A-Za-z._~+/-]{{0,256}}\d)[A-Za-z0-9._~+/-]{{15,}}[A-Za-z0-9_-]",
    "hex": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "ip": rf"(?=\d)(?<![\d.])(?<!(?<![A-Za-z])(?i:version|release|build|ver|v)[ .:=]{{0,2}}){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ipv6": rf"(?=[0-9A-Fa-f])(?<![\w:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?i:[23][0-9a-f]{{3}}|f[cd][0-9a-f]{{2}}|fe[89ab][0-9a-f])(?::{_GROUP}){{0,6}}+::(?:{_GROUP}(?::{_GROUP}){{0,5}})?)(?![\w:])",
    "phone": rf"(?=[+(\d])(?<![\w+])(?:{_PHONE})(?!\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?=\d)(?<![\d-])(?:\d{13,19}|\d{4}[ -]\d{6}[ -]\d{5}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,4})(?!\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What may also begin inside a word (accessToken, SSN123-45-6789). The others can't, so there they aren't tried.
INSIDE = ("secret", "ip", "ssn", "card", "login")
ENTITY = rf"(?<![A-Za-z0-9])(?:{'|'.join(f'(?:{p})' for p in PATTERNS.values())})|(?=[AaPpSsTt\d:])(?<=[A-Za-z0-9])(?:{'|'.join(f'(?:{PATTERNS[k]})' for k in INSIDE)})"
#: A text without any of these holds no entity; looking for them costs much less.
HINT = "[0-9@=:]|AKIA"
TITLE_HINT = rf"(?=[{''.join(dict.fromkeys(t[0] for ts in TITLES.values() for t in ts))}])(?:{_ALL_TITLES})\.? "


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def luhn_sum(digits: Column) -> Column:
    """The weighted digit sum of a card number (a string of digits); 0 modulo 10 if it is one."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.reverse(chars(digits)), lambda d, i: F.when(i % 2 == 1, doubled(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def mod97(plain: Column) -> Column:
    """The remainder by 97 of an account number as written (letters as two digits, first four to the end)."""
    moved = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    value = lambda x: F.when(x.between("0", "9"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    return F.aggregate(F.transform(chars(moved), value), F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97))


def kind(raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(raw.rlike(rf"\A(?:{pattern})\z"), F.lit(name)).otherwise(out)
    return out


_PREFIX = r"\A(?i:password|passwd|secret|api_?key|token) ?[=:] ?\"?"


#: A telephone number's country code, with a zero in brackets, or its trunk zero.
_COUNTRY = rf"\A(?:\+{CALLING_CODES}(?:[ .-]?\(0\))?|0(?=[1-9]))"


def plain_form(k: Column, raw: Column) -> Column:
    """What names an entity of a kind, whatever way it is written."""
    digits = lambda c: F.regexp_replace(c, r"[^\d]", "")
    return (
        F.when(k.isin("email", "ipv6"), F.lower(raw))
        .when(k == "phone", digits(F.regexp_replace(raw, _COUNTRY, "")))
        .when(k.isin("ssn", "card"), digits(raw))
        .when(k == "iban", F.replace(raw, F.lit(" "), F.lit("")))
        .when(k == "secret", F.regexp_replace(F.regexp_replace(raw, _PREFIX, ""), r"\"\z", ""))
        .when(k == "token", F.regexp_replace(raw, rf"\A{TOKENS}", ""))
        .when(k == "login", F.regexp_replace(raw, r"\A://|@\z", ""))
        .when(k == "name", F.regexp_replace(raw, rf"\A{_TITLED}", ""))
        .otherwise(raw)
    )


def _pick(seed: Column, at, n: int) -> Column:
    """One of n by the seed and a place: 0 .. n - 1."""
    return F.pmod(F.xxhash64(seed, at if isinstance(at, Column) else F.lit(at)), F.lit(n)).cast("int")


def _letters(seed: Column, text: Column, hexadecimal: Column) -> Column:
    """The same string with other digits and letters in the same places and cases."""
    base = lambda c, first, n: F.chr(F.lit(ord(first)) + n)
    point = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")

    def foreign(c: Column, i: Column) -> Column:
        out = c
        for pattern, first, last in reversed(ALPHABETS):
            out = F.when(c.rlike(pattern), point(first + _pick(seed, i, last - first + 1))).otherwise(out)
        return out

    def other(c: Column, i: Column) -> Column:
        any_ = F.when(hexadecimal & (_pick(seed, i, 16) < 10), base(c, "0", _pick(seed, -1 - i, 10)))
        return (
            F.when(hexadecimal & c.rlike("[0-9a-f]"), F.coalesce(any_, base(c, "a", _pick(seed, i, 6))))
            .when(c.between("0", "9"), base(c, "0", _pick(seed, i, 10)))
            .when(c.between("a", "z"), base(c, "a", _pick(seed, i, 26)))
            .when(c.between("A", "Z"), base(c, "A", _pick(seed, i, 26)))
            .when(c < "\x80", c)
            .otherwise(foreign(c, i))
        )

    return F.array_join(F.transform(chars(text), other), "")


def _symbols(seed: Column, text: Column) -> Column:
    """Lower-case letters for a string without letters or digits: no draw of ``_letters`` would change it."""
    return F.array_join(F.transform(chars(text), lambda c, i: F.chr(F.lit(97) + _pick(seed, i, 26))), "")


def _by_script(plain: Column, one) -> Column:
    return F.when(plain.rlike(r"\p{IsCyrillic}"), one("cyrillic")).otherwise(one("latin"))


def _syllables(seed: Column, n: Column, script: str, at: int) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.get(F.lit(list(SYLLABLES[script])), _pick(seed, at + i, 16))), "")


def _family(seed: Column, plain: Column, attempt: Column) -> Column:
    return _by_script(plain, lambda script: F.initcap(_syllables(seed, 3 + attempt, script, 10)))


def _given(seed: Column, plain: Column, gender: Column, attempt: Column) -> Column:
    """A name of the list at the first attempt, after that syllables with an ending of the gender."""

    def one(script: str) -> Column:
        out = F.lit("")
        for g in TITLES:
            names = GIVEN[g, script]
            made = F.initcap(F.concat(_syllables(seed, 1 + attempt, script, 10), F.lit(ENDINGS[g, script])))
            listed = F.get(F.lit(list(names)), _pick(seed, 1, len(names)))
            out = F.when(gender == g, F.when(attempt == 0, listed).otherwise(made)).otherwise(out)
        return out

    return _by_script(plain, one)


def _address(seed: Column, plain: Column, attempt: Column) -> Column:
    """An IPv6 address of the same first group; at the first attempt it is shortened where the other one is."""
    drawn = lambda i: F.substr(seed, i * 4 + 1, F.lit(4))
    same = F.transform(F.split(plain, ":"), lambda g, i: F.when((i == 0) | (g == ""), g).otherwise(drawn(i)))
    whole = F.concat(F.slice(F.split(plain, ":"), 1, 1), F.transform(F.sequence(F.lit(1), F.lit(7)), drawn))
    return F.array_join(F.when(attempt == 0, same).otherwise(whole), ":")


def surrogate(k: Column, plain: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The plain form of the surrogate drawn at an attempt."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), k, plain, attempt.cast("string")), 256)
    never = F.lit(False)
    octet = lambda i: (1 + _pick(seed, i, 254)).cast("string")
    at = F.instr(plain, "@")
    dot = at + F.instr(F.substr(plain, at + 1), ".")
    body = _letters(seed, plain, never)
    longer = F.substr(F.sha2(F.concat(seed, F.lit("\x1flonger")), 256), F.lit(1), F.greatest(attempt - SAME_LENGTH + 1, F.lit(0)))  # hexadecimal
    digits = F.translate(longer, "abcdef", "012345")
    card = F.concat(F.substring(plain, 1, 1), F.substr(body, F.lit(2), F.length(plain) - 2), digits)
    card = F.concat(card, F.pmod(-luhn_sum(F.concat(card, F.lit("0"))), F.lit(10)).cast("string"))
    account = lambda check: F.concat(F.substring(plain, 1, 2), check, F.substring(body, 5, 100), digits)
    secret = F.when(plain.rlike(r"[\p{L}\p{N}]"), _letters(seed, plain, plain.rlike(r"\A[0-9a-f]+\z"))).otherwise(_symbols(seed, plain))
    return (
        F.when(k == "email", F.concat(F.substr(body, F.lit(1), dot - 1), longer, F.substr(plain, dot)))
        .when(k == "ip", F.concat(F.concat_ws(".", *(octet(i) for i in range(4))), digits))
        .when(k == "ipv6", _address(seed, plain, attempt))
        .when(k == "card", card)
        .when(k == "iban", account(F.lpad((98 - mod97(account(F.lit("00")))).cast("string"), 2, "0")))
        .when(k == "access_key", F.concat(F.lit("AKIA"), F.substring(body, 5, 100), F.upper(longer)))
        .when(k == "family", _family(seed, plain, attempt))
        .when(k == "given", _given(seed, plain, gender, attempt))
        .when(k == "phone", F.concat(F.when(plain.rlike(r"\A[2-9]"), F.chr(F.lit(50) + _pick(seed, 0, 8))).otherwise(F.left(plain, F.lit(1))), F.substring(body, 2, 100), digits))
        .when(k.isin("hex", "secret", "token"), F.concat(secret, longer))
        .when(k == "login", F.concat(body, longer))
        .otherwise(F.concat(body, digits))
    )


def written(k: Column, raw: Column, plain: Column, new: Column) -> Column:
    """The surrogate in the way the entity was written: its separators, case, country code and key word."""
    code = F.when(k == "phone", F.regexp_extract(raw, _COUNTRY, 0)).otherwise("")
    filled = F.aggregate(  # digits and letters in turn, all else as it was
        chars(F.substr(raw, F.length(code) + 1)),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("k")),
        lambda a, c: F.when(
            c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["out"], F.substr(new, a["k"] + 1, F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))),
    )
    fill = F.concat(code, filled["out"], F.substr(new, filled["k"] + 1))  # a longer draw goes on at the end
    cased = F.when(raw == F.upper(raw), F.upper(new)).otherwise(new)
    inside = F.concat(F.substr(raw, F.lit(1), F.instr(raw, plain) - 1), new, F.substr(raw, F.instr(raw, plain) + F.length(plain)))
    return F.when(k.isin("phone", "ssn", "card", "iban"), fill).when(k.isin("email", "ipv6"), cased).when(k.isin("secret", "token", "login"), inside).otherwise(new)


def gender_of(raw: Column) -> Column:
    """The gender that a name's titles show; n if none does, or titles of both."""
    shown = [raw.rlike(rf"\A{_TITLED}") & F.regexp_extract(raw, rf"\A{_TITLED}", 0).rlike(rf"(?:\A| )(?:{'|'.join(TITLES[g])})\.? ") for g in ("m", "f")]
    return F.when(shown[0] & ~shown[1], "m").when(shown[1] & ~shown[0], "f").otherwise("n")


def _beginning(piece: Column) -> Column:
    """O' and Mc, which a surrogate keeps."""
    return F.regexp_extract(piece, r"\A(?:\p{Lu}['’]|Ma?c(?=\p{Lu}))", 0)


def _parts(k: Column, raw: Column, plain: Column) -> Column:
    """What an entity consists of, each with a surrogate of its own: (kind, plain, before). Of a name its words and, of
    hyphened ones, their pieces, with what comes before each as it was written; particles are part of that. All else
    is a part alone."""
    piece = F.lit(r"[^ -]+")
    titles = F.substr(raw, F.lit(1), F.instr(raw, plain) - 1)
    found = F.regexp_extract_all(plain, piece, F.lit(0))
    gaps = F.regexp_extract_all(F.concat(plain, F.lit(" ")), F.lit(r"[ -]"), F.lit(0))
    last_word = F.size(F.regexp_extract_all(F.regexp_replace(plain, r"\A.* ", ""), piece, F.lit(0)))
    particle = lambda x: x.isin(*PARTICLES)
    start = F.struct(F.array().cast("array<struct<kind:string,plain:string,before:string>>").alias("out"), titles.alias("text"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        gap = F.get(gaps, a["i"])
        kept = F.concat(a["text"], _beginning(x))
        kind_ = F.when(a["i"] >= F.size(found) - last_word, "family").otherwise("given")
        entry = F.struct(kind_.alias("kind"), F.substr(x, F.length(_beginning(x)) + 1).alias("plain"), kept.alias("before"))
        as_is = F.struct(a["out"].alias("out"), F.concat(a["text"], x, gap).alias("text"), (a["i"] + 1).alias("i"))
        return F.when(particle(x), as_is).otherwise(F.struct(F.array_append(a["out"], entry).alias("out"), gap.alias("text"), (a["i"] + 1).alias("i")))

    alone = F.array(F.struct(k.alias("kind"), plain.alias("plain"), F.lit("").alias("before")))
    return F.when(k == "name", F.aggregate(found, start, step, lambda a: a["out"])).otherwise(alone)


def surrogates(entities: DataFrame, key: str, tables: Tables) -> DataFrame:
    """(kind, plain, new) for distinct (kind, plain, gender): no two alike, none an entity itself.

    Each round draws for those left; of equal draws the first plain form keeps it, and draws that are entities or
    given already are drawn again, from some round on a character longer each time. So rounds end, when none is left."""
    left = entities.withColumn("attempt", F.lit(0))
    taken = entities.select("kind", F.col("plain").alias("new"))
    out: DataFrame | None = None
    for attempt in count():
        drawn = left.withColumn("new", surrogate(F.col("kind"), F.col("plain"), F.col("gender"), F.lit(attempt), key))
        drawn = tables.store(drawn, "draws")
        # given names have few draws at first, so no draw's rows are brought together: its first is a partial minimum
        first = drawn.groupBy("kind", "new").agg(F.min("plain").alias("plain")).join(taken, ["kind", "new"], "left_anti").withColumn("first", F.lit(True))
        free = drawn.join(first, ["kind", "plain", "new"], "left").withColumn("ok", F.coalesce("first", F.lit(False)))
        tried = tables.store(free.select("kind", "plain", "gender", "attempt", "new", "ok"), "surrogates")
        given = tried.where("ok").select("kind", "plain", "new")
        out = given if out is None else out.union(given)
        left = tried.where("not ok").select("kind", "plain", "gender", "attempt")
        taken = taken.union(given.select("kind", "new"))
        if left.isEmpty():
            return out


def _valid(k: Column, plain: Column) -> Column:
    masked = (k == "secret") & plain.rlike(r"\A([^\p{L}\p{N}])\1*\z")
    return F.when(k == "card", luhn_sum(plain) % 10 == 0).when(k == "iban", mod97(plain) == 1).otherwise(k.isNotNull() & ~masked)


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in (c.lower() for c in taken):
        name = f"_{name}"
    return name


def replaced(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with its text's entities replaced under the secret ``key``, and n_entities, the number of places.

    Card and account numbers whose checks fail are left alone, as are masked secrets (one sign over and over, as in
    ``********``) and all that no pattern meets. A given name that occurs with titles of both genders gets a neutral
    one. A null text stays null, an empty one empty (n_entities 0); a very long text is searched whole, and its
    entities are a map in one row. Rows are matched by the text, not by id, so null ids and repeated rows do no harm;
    all columns are kept but for one named n_entities, which is replaced. An empty table gives an empty result."""
    if not key:
        raise ValueError("surrogates need a secret key")
    tables = Tables(docs.sparkSession)
    columns = [c for c in docs.columns if c != "n_entities"]
    id_, map_, found_, names_ = (_free(c, docs.columns) for c in ("_key", "_map", "_found", "_names"))
    docs = docs.select(*(F.col(f"`{c}`") for c in columns))
    body = F.col(f"`{text}`")
    hinted = body.rlike(HINT) | body.rlike(TITLE_HINT) | body.rlike("[A-Fa-f]{32}")
    has = F.coalesce(hinted & body.rlike(ENTITY), F.lit(False))
    some = docs.where(has).withColumn(id_, F.sha2(body, 256))
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(ENTITY), F.lit(0)))
    raws = some.select(F.col(id_).alias("id"), F.explode(found).alias("raw")).withColumn("kind", kind(F.col("raw")))
    raws = raws.withColumn("plain", plain_form(F.col("kind"), F.col("raw"))).where(_valid(F.col("kind"), F.col("plain"))).distinct()
    # a name is looked for without its title too, and its family name alone
    form = lambda raw, plain: F.struct(raw.alias("raw"), plain.alias("plain"))
    family = F.regexp_extract("plain", r"[^ ]+\z", 0)
    forms = F.array(form(F.col("raw"), F.col("plain")), form(F.col("plain"), F.col("plain")), form(family, family))
    forms = F.filter(forms, lambda x: (x["raw"] == F.col("raw")) | F.contains(x["raw"], F.lit(" ")) | (F.length(x["raw"]) > 2))
    alone = F.array(form(F.col("raw"), F.col("plain")))
    raws = raws.withColumn("gender", F.when(F.col("kind") == "name", gender_of(F.col("raw"))).otherwise("n"))
    raws = raws.select("id", "kind", "gender", F.inline(F.when(F.col("kind") == "name", forms).otherwise(alone)))
    raws = raws.withColumn("parts", _parts(F.col("kind"), F.col("raw"), F.col("plain")))
    raws = tables.store(raws.select("id", "raw", F.col("kind").alias("whole"), "gender", F.posexplode("parts").alias("place", "part")).select("id", "raw", "whole", "gender", "place", "part.*").distinct(), "entities")
    shown = F.when(F.col("gender") != "n", F.col("gender"))
    genders = raws.groupBy("kind", "plain").agg(F.min(shown).alias("g1"), F.max(shown).alias("g2"))
    named = genders.select("kind", "plain", F.when((F.col("kind") == "given") & (F.col("g1") == F.col("g2")), F.col("g1")).otherwise(F.lit("n")).alias("gender"))
    mapping = surrogates(named, key, tables)
    new = F.concat("before", written(F.col("kind"), F.col("raw"), F.col("plain"), F.col("new")))
    words = raws.select("id", "raw", "whole", "place", "kind", "plain", "before").distinct().join(mapping, ["kind", "plain"]).select("id", "raw", "whole", F.struct("place", new.alias("to")).alias("part"))
    # an entity has the parts of a name at most, a document the entities of its text
    pairs = words.groupBy("id", "raw", "whole").agg(F.array_join(F.transform(F.array_sort(F.collect_set("part")), lambda x: x["to"]), "").alias("to"))
    untitled = (F.col("whole") == "name") & ~F.col("raw").rlike(rf"\A{_TITLED}")
    maps = pairs.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("raw", "to"))).alias(map_), F.collect_set(F.when(untitled, F.col("raw"))).alias(names_))
    maps = tables.store(maps.withColumnRenamed("id", id_), "maps")
    tables.drop_others(maps)
    matched = some.join(maps, id_, "left")
    # of two names the longer one first; letters, spaces, hyphens and apostrophes only
    single = lambda n: F.concat(F.lit(rf"(?<!-)(?<!(?<!\p{{L}})(?i:{'|'.join(ARTICLES)}) )"), n, F.lit(r"(?!-)"))
    names = F.array_join(F.transform(F.reverse(F.array_sort(names_)), lambda n: F.when(F.contains(n, F.lit(" ")), n).otherwise(single(n))), "|")
    pattern = F.when(F.size(names_) > 0, F.concat(F.lit(rf"{ENTITY}|(?=\p{{Lu}}|\p{{Ll}}+ )(?<![\p{{L}}\p{{N}}])(?:"), names, F.lit(r")(?![\p{L}\p{N}])"))).otherwise(F.lit(ENTITY))

    def rebuilt(rows: DataFrame, what: Column) -> DataFrame:
        rows = rows.withColumn(found_, F.regexp_extract_all(body, what, F.lit(0)))
        between = F.split(body, what, -1)
        new = F.transform(found_, lambda e: F.coalesce(F.get(F.array(F.col(map_)), F.lit(0))[e], e))
        made = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(found_)), new, lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))
        n = F.size(F.filter(found_, lambda e: F.map_contains_key(F.col(map_), e)))
        n = F.coalesce(F.when(F.col(map_).isNotNull(), n), F.lit(0)).cast("long").alias("n_entities")
        return rows.select(*(made.alias(c) if c == text else F.col(f"`{c}`") for c in columns), n)

    with_names = F.coalesce(F.size(names_), F.lit(0)) > 0
    plain = docs.where(~has).withColumn("n_entities", F.lit(0).cast("long"))
    return plain.unionByName(rebuilt(matched, F.when(with_names, pattern).otherwise(F.lit(ENTITY))))


#: Where a session keeps the key of the queries; without one each run draws its own, and nobody can repeat it.
KEY_SETTING = "spark.colquarry.pii.key"


def session_key(spark) -> str:
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
