"""Keyed surrogates for personal data, from built-in expressions alone.

Detected entities are e-mail addresses, phone numbers, IP addresses of both versions, payment cards and IBANs
(with valid check digits), social security numbers, secrets (access keys, and strings with a digit given as a
token, key or password) and names after a title or after words that introduce one. Each gets a replacement of
its own kind that depends on the key and on its normal form only, so that it is the same wherever the entity
comes up again, however it is written:

- digits go through a Feistel network keyed by SHA-256, which is a bijection; separators, country code,
  first digit of a card and the check digits' validity stay;
- names are coined word by word in the script of the original, with its capitals and the endings of its
  gender, so a family name stays the same with and without a given name. A given name has the gender of most
  of the titles that the corpus gives it, so it stays the same after a title that tells none;
- addresses and secrets are spelt from digests, with the top-level domain, length, case and kinds of
  characters kept.

Distinct entities that would get the same surrogate, and surrogates that are real entities of the corpus, are
found by a check over all entities and get further attempts; only documents that hold such an entity are touched
by the join that this takes. What still collides after MAX_ATTEMPTS becomes a mark of its kind with a digest.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

KEY_SETTING = "spark.idsieve.surrogates.secretKey"  # Spark hides the values of settings that are called secret
#: Spark's SQL parser lets go of what it learnt of long expressions, which may be 100 MB on the driver; and each query's plan is sent about
#: as text, of which some thousand characters are enough. The expressions here are made by column functions, as in parsing them as text
#: (20,000 characters) the parser made 1.8 GB of objects on the driver.
PARSER = {"spark.sql.parser.manageParserCaches": "true", "spark.sql.parser.parserDfaCacheFlushThreshold": "2000", "spark.sql.maxPlanStringLength": "8000"}
ROUNDS = 6
MAX_ATTEMPTS = 12
# Titles by gender, and syllables and endings to coin names from, by script.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "господин", "г-н", "κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "госпожа", "г-жа", "κυρία"],
    "n": ["Dr", "Prof", "Mx"],
}
SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga go ha ka ke ko la le li lo ma me mi mo na ne ni no ra ro sa ta ve".split(),
    "cyrillic": "ба бе бо да де ди до фа фе га го ха ка ке ко ла ле ли ло ма ме ми мо на не ни но ра ро са та ве".split(),
    "greek": "βα βε βο δα δε δι δο φα φε γα γο χα κα κε κο λα λε λι λο μα με μι μο να νε νι νο ρα ρο σα τα πε".split(),
}
ENDINGS = {
    ("latin", "m"): ["ric", "ton", "mar", "bert"],
    ("latin", "f"): ["lia", "nna", "rine", "lena"],
    ("latin", "n"): ["ley", "rin", "sam", "kim"],
    ("latin", "family"): ["man", "sen", "ler", "court"],
    ("cyrillic", "m"): ["слав", "мир", "тин", "гор"],
    ("cyrillic", "f"): ["лия", "нна", "рина", "лена"],
    ("cyrillic", "n"): ["ша", "ня", "ля", "ся"],
    ("cyrillic", "family"): ["енко", "чук", "ских", "ович"],
    ("greek", "m"): ["νης", "ρος", "λος", "σης"],
    ("greek", "f"): ["νη", "ρια", "λια", "σα"],
    ("greek", "n"): ["ντι", "λις", "ρι", "νι"],
    ("greek", "family"): ["ίδης", "άκης", "όπουλος", "έας"],
}
# Words that introduce a name without a title.
INTRODUCTIONS = ["my name is", "name:", "named", "contact:", "signed by", "signed:", "regards,", "sincerely,", "dear", "author:", "patient:", "customer:"]
_titles = "|".join(sorted((t for own in TITLES.values() for t in own), key=len, reverse=True))
_TITLED = rf"(?i:{_titles})\.? "
# Runs that may be long are taken by possessive quantifiers and begin at a boundary, so that a text is passed once whatever it holds.
# Particles that stand before a family name.
PARTICLES = "van von der den de del della di da dos du la le ter ten zu zur bin al el".split()
_ALONE, _ENDS = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: A name's word: parts joined by apostrophes or hyphens, without the 's of a possessive.
_WORD = rf"\p{{Lu}}\p{{L}}*+(?:['’-](?!s{_ENDS})\p{{L}}++)*+"
_PARTS = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_WORD}"
_NEXT = rf" (?!{_TITLED}){_PARTS}"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-][\p{L}\p{N}.-]*\.\p{L}{2,}+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[\p{{L}}\p{{N}}])"
_GROUP = "[0-9A-Fa-f]{1,4}"
_IP6 = rf"(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})"
IP6 = rf"(?<![\p{{L}}\p{{N}}:.]){_IP6}(?![\p{{L}}\p{{N}}:])"
_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
SSN = r"\d{3}-\d{2}-\d{4}"
_PHONE = r"(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[-.]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})"
PHONE = rf"(?<![\p{{L}}\p{{N}}+]){_PHONE}{_ENDS}"
CARD = r"[2-6]\d{3}(?:[ -]?\d){9,15}"
_PREFIX = "(?:A[KS]IA|gh[opsu]_|sk-|eyJ)"  # of access keys and signed tokens
_LABEL = r"(?i:token|key|secret|password|passwd) {0,3}[=:] {0,3}[\"']?"
_OWN = rf"A[KS]IA[0-9A-Z]{{16}}{_ENDS}|gh[opsu]_[0-9A-Za-z]{{30,}}+|sk-[0-9A-Za-z_-]{{20,}}+|eyJ[0-9A-Za-z_-]{{10,}}+(?:\.[0-9A-Za-z_-]{{4,}}+){{0,2}}"
SECRET = rf"{_ALONE}(?:{_OWN})|{_LABEL}(?=[A-Za-z+/_-]*+\d)[0-9A-Za-z+/_-]{{8,}}+"
_INTRODUCED = rf"(?i:{'|'.join(INTRODUCTIONS)}) {{1,2}}(?!{_TITLED})"
NAME = rf"{_ALONE}(?:{_TITLED}{_PARTS}(?:{_NEXT}){{0,5}}|{_INTRODUCED}{_PARTS}(?:{_NEXT}){{1,5}})"
ENTITY = "|".join((EMAIL, SECRET, IP6, IP, _ALONE + _IBAN + _ENDS, _ALONE + SSN + _ENDS, PHONE, _ALONE + CARD + _ENDS, NAME))
LIKELY = rf"[0-9@]|A[KS]IA|{_TITLED}|(?i:{'|'.join(INTRODUCTIONS)}) "


def session_key(spark: SparkSession) -> str:
    """The key in KEY_SETTING. Where none is set, one is drawn for the session, so that surrogates of two sessions have nothing in common."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def _whole(x: Column, pattern: str) -> Column:
    return x.rlike(f"^(?:{pattern})$")


def _int(x: Column) -> Column:
    return x.cast("int")


def _string(x: Column | int) -> Column:
    return F.lit(x).cast("string")


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression in which a value is computed once and used by name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sub(x: Column, start: Column | int, size: Column | int | None = None) -> Column:
    return F.substr(x, F.lit(start)) if size is None else F.substr(x, F.lit(start), F.lit(size))


def _characters(x: Column) -> Column:
    return F.split(x, "")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The sum of a digit string with each second digit from the right doubled, modulo 10."""
    worth = lambda d, n: F.when(n % 2 == 0, _int(d)).when(d > "4", 2 * _int(d) - 9).otherwise(2 * _int(d))
    return F.aggregate(F.transform(_characters(F.reverse(digits)), worth), F.lit(0), lambda a, d: a + d) % 10


def mod97(text: Column) -> Column:
    """The number that capitals (10 to 35) and digits make, modulo 97."""
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + _int(c)) % 97).when(c == "", a).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_characters(text), F.lit(0), step)


def kind(x: Column) -> Column:
    """The kind of a match; null for a number that is no card or IBAN after all."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    card = F.length(_digits(x)).between(13, 19) & (luhn(_digits(x)) == 0)
    iban = mod97(F.concat(_sub(plain, 5), _sub(plain, 1, 4))) == 1
    out = F.when(x.rlike(f"^(?:{_LABEL}|{_PREFIX})"), "secret").when(x.contains("@"), "email")
    out = out.when(_whole(x, r"(?:\d+\.){3}\d+"), "ip").when(_whole(x, _IP6), "ip6").when(_whole(x, SSN), "ssn")
    out = out.when(_whole(x, _IBAN), F.when(iban, "iban")).when(_whole(x, CARD), F.when(card, "card"))
    return out.when(_whole(x, _PHONE), "phone").otherwise("name")


def _value(x: Column) -> Column:
    """A secret without its label."""
    return F.regexp_replace(x, f"^{_LABEL}", "")


def normal(x: Column, k: Column) -> Column:
    """The form that all spellings of an entity share. Names are looked at word by word."""
    out = F.when(k == "email", F.lower(x)).when(k == "secret", _secret_form(x)).when(k == "ip", x)
    return out.when(k == "ip6", F.lower(x)).when(k == "iban", F.replace(x, F.lit(" "), F.lit(""))).otherwise(_digits(x))


def _secret_form(x: Column) -> Column:
    return F.when(_value(x).rlike("^[0-9a-fA-F]+$"), F.lower(_value(x))).otherwise(_value(x))


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(key), *parts), 256)


def _hex(digest: Column, start: Column | int, size: int) -> Column:
    return F.conv(_sub(digest, start, size), 16, 10)


def _feistel(key: str, k: str, left: Column, right: Column, left_size: Column, right_size: Column, attempt: Column | int) -> Column:
    """A struct (l, r): a keyed bijection of pairs of numbers below the sizes."""
    pair = lambda a, b: F.struct(a.alias("l"), b.alias("r"))
    f = lambda i, other: _hex(_digest(key, F.lit(k), _string(attempt), _string(i), _string(other)), 1, 15).cast("bigint")
    moved = lambda own, i, other, size: (own + f(i, other) % size) % size
    step = lambda s, i: F.when(i % 2 == 0, pair(moved(s["l"], i, s["r"], left_size), s["r"])).otherwise(pair(s["l"], moved(s["r"], i, s["l"], right_size)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair(left.cast("bigint"), right.cast("bigint")), step)


def _permuted(key: str, k: str, digits: Column, attempt: Column | int) -> Column:
    """Another string of as many digits; digits has 2 to 18."""
    half = _int(F.length(digits) / 2)
    rest = F.length(digits) - half
    size = lambda n: F.pow(F.lit(10), n).cast("bigint")
    done = _feistel(key, k, _sub(digits, 1, half), _sub(digits, half + 1), size(half), size(rest), attempt)
    return _bind(done, lambda p: F.concat(F.lpad(_string(p["l"]), half, "0"), F.lpad(_string(p["r"]), rest, "0")))


def _in_place(x: Column, digits: Column, of: str = "[0-9]") -> Column:
    """x with its digits, or whatever ``of`` matches, replaced in order."""
    state = lambda o, k: F.struct(o.alias("o"), k.alias("k"))

    def replaced(made: Column) -> Column:
        step = lambda s, c: F.when(c.rlike(f"^{of}$"), state(F.concat(s["o"], _sub(made, s["k"], 1)), s["k"] + 1)).otherwise(state(F.concat(s["o"], c), s["k"]))
        return F.aggregate(_characters(x), state(F.lit(""), F.lit(1)), step, lambda s: s["o"])

    return _bind(digits, replaced)


def _spelt(x: Column, digest: Column, as_hex: Column) -> Column:
    """A string of x's length from the hexadecimal digits of a digest and of further ones for each 32 characters: digits for
    digits, letters of the same case for letters (``as_hex``: hexadecimal digits for both, capitals if all are), other characters as
    they are."""

    def one(c: Column, n: Column, z: Column, hexed: Column) -> Column:
        pick = lambda among: _sub(F.lit(among), _int(_hex(z, 2 * n + 1, 2)) % len(among) + 1, 1)
        letter = pick("abcdefghijklmnopqrstuvwxyz")
        out = F.when(hexed & c.rlike("[0-9a-zA-Z]"), pick("0123456789abcdef")).when(c.rlike("[0-9]"), pick("0123456789"))
        return out.when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

    def part(y: Column, m: Column, own: Column, hexed: Column) -> Column:
        return _bind(F.sha2(F.concat(y, _string(m)), 256), lambda z: F.array_join(F.transform(_characters(own), lambda c, n: one(c, n, z, hexed)), ""))

    def made(y: Column, hexed: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(x, F.lit("(?s).{1,32}"), 0), lambda own, m: part(y, m, own, hexed))
        return _bind(F.array_join(parts, ""), lambda out: F.when(hexed & (F.upper(x) == x), F.upper(out)).otherwise(out))

    return _bind(digest, lambda y: _bind(as_hex, lambda hexed: made(y, hexed)))


def _table(rows: dict[str, list[str]], name: Column) -> Column:
    """The words of a name; all as one literal, as hundreds of them would make the plan large."""
    return F.split(F.element_at(F.str_to_map(F.lit(";".join(f"{k}={' '.join(v)}" for k, v in rows.items())), F.lit(";"), F.lit("=")), name), " ")


def _pick(words: Column, digest: Column, at: int, size: int = 3) -> Column:
    return F.element_at(words, _int(_hex(digest, at, size)) % F.size(words) + 1)


def _coined(key: str, word: Column, role: Column, attempt: Column | int) -> Column:
    """A name word: role is m, f, n or family. Further attempts have more syllables."""
    script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    digest = _digest(key, F.lit("name"), role, F.lower(word), _string(attempt))

    def made(sy: Column, en: Column, h: Column) -> Column:
        start, more = (F.concat(*(_pick(sy, h, at) for at in places)) for places in ((1, 4, 7, 10), (23, 26, 29)))
        return F.concat(start, F.when(F.lit(attempt) == 0, "").otherwise(more), _pick(en, h, 13))

    spelt = lambda c: F.when((F.length(word) > 1) & (F.upper(word) == word), F.upper(c)).otherwise(F.initcap(c))
    endings = {f"{s} {r}": own for (s, r), own in ENDINGS.items()}
    of_script = lambda sc: _bind(_table(SYLLABLES, sc), lambda sy: _bind(_table(endings, F.concat(sc, F.lit(" "), role)), lambda en: _bind(digest, lambda h: _bind(made(sy, en, h), spelt))))
    return _bind(script, of_script)


def _gender(x: Column) -> Column:
    of = lambda g: x.rlike(rf"^(?i:{'|'.join(TITLES[g])})\.? ")
    return F.when(of("m"), "m").when(of("f"), "f").otherwise("n")


def name_words(x: Column) -> Column:
    """The words of a name as structs (role, word, sep: what stands before it): family, or for a given name m, f or n; null
    for a title and for particles. The parts of a word with hyphens are words."""
    titled, particle = x.rlike(f"^{_TITLED}"), f"^(?:{'|'.join(PARTICLES)})$"

    def parts(w: Column, n: Column, v: Column) -> Column:
        role = F.when((n == 0) & titled | w.rlike(particle), F.lit(None)).when(n == F.size(v) - 1, "family").otherwise(_gender(x))
        sep = lambda k: F.when(k > 0, "-").when(n > 0, " ").otherwise("")
        return F.transform(F.split(w, "-"), lambda p, k: F.struct(role.alias("role"), p.alias("word"), sep(k).alias("sep")))

    words = F.split(F.regexp_replace(x, f"^{_INTRODUCED}", ""), " ")
    return _bind(words, lambda v: F.flatten(F.transform(v, lambda w, n: parts(w, n, v))))


def _entry(moved: Column | None, k: Column, form: Column, part: str, default: Column | int) -> Column | int:
    """What the map ``moved`` has of an entity (a struct of attempt and gender)."""
    return default if moved is None else F.coalesce(F.try_element_at(moved, F.concat(k, F.lit("\n"), form))[part], F.lit(default))


def _phone(key: str, d: Column, attempt: Column | int) -> Column:
    national = F.greatest(F.lit(0), F.length(d) - 10)
    return F.concat(_sub(d, 1, national), _permuted(key, "phone", _sub(d, national + 1), attempt))


def _card(key: str, d: Column, attempt: Column | int) -> Column:
    middle = _permuted(key, "card", _sub(d, 2, F.length(d) - 2), attempt)
    return _bind(F.concat(_sub(d, 1, 1), middle), lambda b: F.concat(b, _string((10 - luhn(F.concat(b, F.lit("0")))) % 10)))


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _ssn(key: str, d: Column, attempt: Column | int) -> Column:
    # areas 1 to 899 but 666, groups from 1, serial numbers from 1; numbers beyond these go to some of them
    own = _int(_sub(d, 1, 3))
    area = F.when(own > 666, own - 2).otherwise(own - 1)
    number = _feistel(key, "ssn", F.pmod(area * 99 + _int(_sub(d, 4, 2)) - 1, F.lit(88902)), F.pmod(_int(_sub(d, 6)) - 1, F.lit(9999)), F.lit(88902), F.lit(9999), attempt)
    padded = lambda n, size: F.lpad(_string(n), size, "0")
    spelt = lambda p: F.concat(padded(_div(p["l"], 99) + F.when(_div(p["l"], 99) >= 665, 2).otherwise(1), 3), padded(p["l"] % 99 + 1, 2), padded(p["r"] + 1, 4))
    return _bind(number, spelt)


def _ip(key: str, x: Column, attempt: Column | int) -> Column:
    def net(t: Column, y: Column, z: Column) -> Column:
        done = _feistel(key, "ip", (t[0] - z) * y + t[1] - z, (t[2] - z) * y + t[3] - z, y * y, y * y, attempt)
        return _bind(done, lambda p: F.concat_ws(".", *(_string(n + z) for n in (_div(p["l"], y), p["l"] % y, _div(p["r"], y), p["r"] % y))))

    def based(t: Column) -> Column:
        plain = (F.array_min(t) > 0) & (F.array_max(t) < 255)
        return _bind(F.when(plain, 254).otherwise(256), lambda y: _bind(F.when(plain, 1).otherwise(0), lambda z: net(t, y, z)))

    return _bind(F.transform(F.split(x, "[.]"), _int), based)


def _single(key: str, x: Column, k: Column, attempt: Column | int) -> Column:
    """The surrogate of a match x that is no name."""
    of = lambda kind, form: _digest(key, F.lit(kind), form, _string(attempt))
    made = lambda make: _bind(_digits(x), lambda d: make(key, d, attempt))
    syllables = F.split(F.lit(" ".join(SYLLABLES["latin"])), " ")
    local = lambda h: F.concat(*(_pick(syllables, h, 2 * n + 1, 2) for n in range(3)), F.lit("."), _sub(h, 9, 10))
    domain = _sub(_digest(key, F.lit("domain"), F.lower(F.substring_index(x, "@", -1))), 1, 6)
    mail = F.concat(_bind(of("email", F.lower(x)), local), F.lit("@mail-"), domain, F.lit(".example."), F.substring_index(F.lower(x), ".", -1))
    mail = _bind(mail, lambda c: F.when(F.upper(x) == x, F.upper(c)).otherwise(c))
    check = lambda a, b: F.lpad(_string(98 - mod97(F.concat(b, _sub(a, 1, 2), F.lit("00")))), 2, "0")
    account = lambda a: _bind(_spelt(_sub(a, 5), of("iban", a), F.lit(False)), lambda b: F.concat(_sub(a, 1, 2), check(a, b), b))
    kept = F.regexp_extract(x, f"^(?:{_LABEL})?{_PREFIX}?", 0)
    secret = _bind(kept, lambda u: F.concat(u, _spelt(_sub(x, F.length(u) + 1), of("secret", _secret_form(x)), _value(x).rlike("^[0-9a-fA-F]+$"))))
    out = F.when(k == "email", mail).when(k == "ip", _ip(key, x, attempt)).when(k == "ip6", _spelt(x, of("ip6", F.lower(x)), F.lit(True)))
    out = out.when(k == "ssn", _in_place(x, made(_ssn))).when(k == "iban", _in_place(x, _bind(F.replace(x, F.lit(" "), F.lit("")), account), "[0-9A-Z]"))
    return out.when(k == "phone", _in_place(x, made(_phone))).when(k == "card", _in_place(x, made(_card))).when(k == "secret", secret).otherwise(x)


def _marked(key: str, k: Column, form: Column, attempt: Column | int, made: Column) -> Column:
    """The surrogate, or a mark where the attempts are used up (-1)."""
    mark = F.concat(F.lit("["), k, F.lit(" "), _sub(_digest(key, k, form), 1, 16), F.lit("]"))
    return made if isinstance(attempt, int) else F.when(attempt < 0, mark).otherwise(made)


def surrogate(key: str, x: Column, k: Column, moved: Column | None = None) -> Column:
    """The surrogate of a match x of kind k; x itself where it is no entity. moved: a map by kind and normal form of structs
    (attempt, gender), or None."""
    form = normal(x, k)
    single = _single(key, x, k, 0) if moved is None else _bind(_entry(moved, k, form, "attempt", 0), lambda q: _marked(key, k, form, q, _single(key, x, k, q)))

    def word(w: Column) -> Column:
        lower, family = F.lower(w["word"]), w["role"] == "family"
        sort = F.when(family, "family").otherwise("given")
        role = F.when(family, "family").otherwise(_entry(moved, F.lit("given"), lower, "gender", w["role"]))
        attempt = _entry(moved, sort, lower, "attempt", 0)
        made = _marked(key, sort, lower, attempt, _coined(key, w["word"], role, attempt))
        return F.concat(w["sep"], F.when(w["role"].isNull(), w["word"]).otherwise(made))

    name = F.concat(F.regexp_extract(x, f"^{_INTRODUCED}", 0), F.array_join(F.transform(name_words(x), word), ""))
    return F.when(k.isNull(), x).when(k == "name", name).otherwise(single)


def detected(docs: DataFrame, column: str) -> DataFrame:
    """The columns of ``docs`` and one more: structs (x, kind) of all matches in the text in order; the kind is null for numbers
    that are no cards after all."""
    # most texts have no digit, at sign or title, and are not searched further
    found = F.transform(F.regexp_extract_all("text", F.lit(ENTITY), 0), lambda x: F.struct(x.alias("x"), kind(x).alias("kind")))
    return docs.withColumn(column, F.when(F.col("text").rlike(LIKELY), found).otherwise(F.array().cast("array<struct<x:string,kind:string>>")))


def entity_forms(x: Column, k: Column) -> Column:
    """The structs (kind, form, role) of a match: one, or one for each word of a name."""
    entity = lambda kind, form, role: F.struct(kind.alias("kind"), form.alias("form"), role.alias("role"))
    named = lambda w: entity(F.when(w["role"] == "family", "family").otherwise("given"), F.lower(w["word"]), w["role"])
    names = F.transform(F.filter(name_words(x), lambda w: w["role"].isNotNull()), named)
    return F.when(k.isNull(), F.array()).when(k == "name", names).otherwise(F.array(entity(k, normal(x, k), F.lit(None).cast("string"))))


def entities(found: DataFrame, column: str) -> DataFrame:
    """kind, form, gender (of given names, from all titles) and mixed (whether some title tells another), of all distinct entities."""
    forms = found.select(F.explode(column).alias("f")).select(F.explode(entity_forms(F.col("f.x"), F.col("f.kind"))).alias("e")).select("e.kind", "e.form", "e.role")
    forms = forms.groupBy("kind", "form").agg(*(F.count_if(F.col("role") == r).alias(r) for r in ("m", "f", "n")))
    forms = forms.withColumn("gender", F.when(F.col("kind") == "given", F.expr("CASE WHEN m > f THEN 'm' WHEN f > m THEN 'f' ELSE 'n' END")))
    return forms.select("kind", "form", "gender", F.coalesce(F.expr("m + f + n > CASE gender WHEN 'm' THEN m WHEN 'f' THEN f ELSE n END"), F.lit(False)).alias("mixed"))


def collisions(found: DataFrame, column: str, key: str) -> DataFrame | None:
    """kind, form, attempt and gender of the entities whose own occurrence does not tell their surrogate; None if all do.

    All distinct entities are checked: a surrogate that is a real entity gives way, and of entities that share one
    all but that with the fewest attempts and then the least form.
    """
    forms = scratch.saved(entities(found, column).withColumn("attempt", F.lit(0)), "entities")
    k, form, attempt = F.col("kind"), F.col("form"), F.col("attempt")
    coined = _coined(key, form, F.when(k == "family", "family").otherwise(F.col("gender")), attempt)
    value = F.when(attempt < 0, F.lit(None)).when(k.isin("family", "given"), F.lower(coined)).otherwise(_bind(_single(key, form, k, attempt), lambda made: normal(made, k)))
    for n in range(MAX_ATTEMPTS + 1):
        made = scratch.saved(forms.withColumn("value", value), "surrogates")
        seen = made.where("value IS NOT NULL").select("kind", "value", F.struct("attempt", "form").alias("first"), F.lit(False).alias("real")).union(made.select("kind", F.col("form").alias("value"), F.lit(None), F.lit(True)))
        shared = seen.groupBy("kind", "value").agg(F.count("first").alias("n"), F.max("real").alias("real"), F.min("first").alias("first")).where("n > 1 OR n = 1 AND real")
        shared = scratch.saved(shared, "collisions")
        if shared.isEmpty():
            break
        lost = F.col("n").isNotNull() & (F.col("real") | (F.col("first.form") != F.col("form")))
        forms = made.join(shared, ["kind", "value"], "left").select("kind", "form", "gender", "mixed", F.when(lost, F.lit(-1) if n == MAX_ATTEMPTS else F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"))
        forms = scratch.saved(forms, "entities")
    moved = forms.where("attempt != 0 OR mixed").select("kind", "form", "attempt", "gender")
    return None if moved.isEmpty() else moved


def pseudonymised(docs: DataFrame, key: str, column: str = "n_entities") -> DataFrame:
    """The columns of ``docs`` with surrogates in ``text``, and the number of entities replaced.

    Null texts stay null and empty ones empty, with 0 entities. Repeated rows get the same surrogates. An empty table
    stays one. A column of the same name as ``column`` is replaced, others stay whatever their names.
    """
    if not key:
        raise ValueError("surrogates need a key")
    conf = docs.sparkSession.conf
    before = {setting: conf.get(setting, None) for setting in PARSER}
    for setting, value in PARSER.items():
        conf.set(setting, value)
    try:
        return _replaced(docs, key, column)
    finally:
        for setting, value in before.items():
            conf.unset(setting) if value is None else conf.set(setting, value)


def _replaced(docs: DataFrame, key: str, column: str) -> DataFrame:
    own = [c for c in docs.columns if c != column]
    hits, row, row2, entry = scratch.unused(docs, "hits", "row", "row2", "moved")
    # looked for once: the check and the replacement read what was found
    found = scratch.saved(detected(docs.select(*own).withColumn("text", F.col("text").cast("string")), hits).withColumn(row, F.monotonically_increasing_id()), "found")
    moved = collisions(found, hits, key)
    if moved is not None:
        # the entries of a document's own entities, gathered for the documents that hold one
        held = found.where(F.size(hits) > 0).select(F.col(row).alias("row"), F.explode(hits).alias("f")).select("row", F.explode(entity_forms(F.col("f.x"), F.col("f.kind"))).alias("e")).select("row", "e.kind", "e.form").distinct().join(moved, ["kind", "form"])
        held = held.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\n", "kind", "form"), F.struct("attempt", "gender")))).alias(entry)).withColumnRenamed("row", row2)
        found = found.join(held, F.col(row) == F.col(row2), "left")
    made = F.transform(hits, lambda f: surrogate(key, f["x"], f["kind"], None if moved is None else F.col(entry)))
    pieces = F.zip_with(F.split("text", ENTITY, -1), made, lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))
    text = F.when(F.size(hits) > 0, F.array_join(F.flatten(pieces), "")).otherwise(F.col("text"))
    count = F.coalesce(F.size(F.filter(hits, lambda f: f["kind"].isNotNull())), F.lit(0)).cast("long").alias(column)
    # written here, so that the driver plans the long expressions once and not again with each step that follows
    return scratch.saved(found.select(*(text.alias("text") if c == "text" else f"`{c}`" for c in own), count), "surrogate-texts")


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data, under the session's key.

    Null text: null, 0 entities. Repeated rows: a result each. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymised(docs, session_key(spark)).select("doc_id", "n_entities", "text")
