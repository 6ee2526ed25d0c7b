"""Recognised text of identity cards as column expressions: lines, labels, values beside and below them, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _phrase(words: str, gap: str = "\\s*") -> str:
    """A pattern of words that stand alone, with blanks between them."""
    return "\\b" + gap.join(words.split()) + "\\b"


def _initials(letters: str) -> str:
    """A pattern of an abbreviation, with or without full stops and blanks."""
    return "\\b" + "\\s*".join(f"{c}\\.?" for c in letters) + "\\b"


# The words of labels and what a guardian is called; all are looked for without regard to case.
NAME, ADDRESS, VID = [_phrase("NAME")], [_phrase("ADDRESS")], [_phrase("VID")]
BIRTH_DATE = [_phrase("DATE OF BIRTH"), _initials("DOB")]
BIRTH_YEAR = [_phrase("YEAR OF BIRTH"), _initials("YOB")]
GENDER = [_phrase("GENDER"), _phrase("SEX")]
GUARDIANS = ["SON", "DAUGHTER", "WIFE", "CARE"]
GUARDIAN = "|".join([f"\\b[{''.join(w[0] for w in GUARDIANS)}]\\s*/\\s*O\\b\\.?", *(_phrase(f"{w} OF", "\\s+") for w in GUARDIANS)])
PIN = "\\b[0-9]{6}\\b"
NO_WORD = "[^\\p{L}\\p{N}_]"  # \\W takes accented letters for blanks
ANY_LABEL = "(?iU)" + "|".join(NAME + BIRTH_DATE + BIRTH_YEAR + GENDER + ADDRESS + VID)


def collapse_spacing(line: Column) -> Column:
    """Runs of three or more single letters, or single digits, joined; two in a row stay apart."""
    for one in ("[A-Za-z]", "[0-9]"):
        before = f"(?<=(?:^|{NO_WORD}){one})[ \\t](?={one}[ \\t]{one}(?:{NO_WORD}|$))"
        after = f"(?<=(?:^|{NO_WORD}){one}[ \\t]{one})[ \\t](?={one}(?:{NO_WORD}|$))"
        line = F.regexp_replace(line, f"{before}|{after}", "")
    return line


def lines(text: Column) -> Column:
    """Lines without blanks around them, frame characters at their ends, and spaced-out letters; empty ones left out."""
    one = lambda x: F.trim(collapse_spacing(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(x), "(?U)\\s+", " "), "^[|_\\-~»«]+\\s*", ""), "\\s*[|_\\-~»«]+$", "")))
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\R"), one), lambda x: x != "")


def clean_value(text: Column) -> Column:
    """A value without the separators that a label leaves before it."""
    cut = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "(?U)^[:\\-.|#]+\\s*", "")
    return F.trim(F.regexp_replace(cut, "(?U)\\s+", " "))


def looks_like_label(text: Column) -> Column:
    return (F.length(text) <= 40) & text.rlike(ANY_LABEL)


def _value(text: Column) -> Column:
    """A cleaned value, or null if it is empty or a label."""
    v = clean_value(text)
    return F.when((v != "") & ~looks_like_label(v), v)


def labelled_value(rows: Column, labels: list[str], ahead: int = 2) -> Column:
    """The first value at a label: what follows it in its line, else one of the next lines that is no label."""
    found = []
    for pattern in labels:
        at = lambda x, p=pattern: x.rlike(f"(?i){p}")
        rest = lambda x, p=pattern: F.regexp_extract(x, f"(?i)(?:{p})(.*)$", 1)
        found.append((at, rest))

    def one(x: Column, i: Column) -> Column:
        following = [_value(F.get(rows, i + k)) for k in range(1, ahead + 1)]
        return F.coalesce(*(F.when(at(x), F.coalesce(_value(rest(x)), *following)) for at, rest in found))

    return F.get(F.filter(F.transform(rows, one), lambda v: v.isNotNull()), F.lit(0))


def gender_in(where: Column) -> Column:
    """Female, Transgender or Male, whichever of these words a text has first in this order."""
    return F.coalesce(*(F.when(where.rlike(f"(?i)\\b{w}\\b"), F.lit(w.capitalize())) for w in ("FEMALE", "TRANSGENDER", "MALE")))


def guardian(rows: Column) -> Column:
    """What follows the first mark of a guardian, up to a comma."""
    rest = F.transform(F.filter(rows, lambda x: x.rlike(f"(?i){GUARDIAN}")), lambda x: F.trim(F.get(F.split(clean_value(F.regexp_extract(x, f"(?i)(?:{GUARDIAN})(.*)$", 1)), ","), F.lit(0))))
    return F.get(F.filter(rest, lambda v: (v != "") & ~looks_like_label(v)), F.lit(0))


def plausible_name(line: Column) -> Column:
    """Two to four words of letters and full stops, and no label."""
    return ~looks_like_label(line) & line.rlike("^[A-Za-z.\\s]{4,40}$") & F.size(F.filter(F.split(F.trim(line), "\\s+"), lambda w: w != "")).between(2, 4)


def name_before_birth(rows: Column, window: int = 3) -> Column:
    """The nearest plausible name in the lines before the first label of a birth date."""
    at = F.array_position(F.transform(rows, lambda x: x.rlike("(?i)" + "|".join(BIRTH_DATE))), True)
    before = F.filter(F.sequence(F.lit(1), F.lit(window)), lambda k: (at > 0) & (at - k >= 1))
    near = F.transform(before, lambda k: F.get(rows, (at - k - 1).cast("int")))
    return F.get(F.filter(near, plausible_name), F.lit(0))


def garbled(line: Column) -> Column:
    """Less than six tenths letters, digits, blanks and common punctuation."""
    useful = F.length(F.regexp_replace(line, "[^\\p{L}\\p{N}\\s,.\\-/]", ""))
    return (F.length(line) == 0) | (useful / F.greatest(F.length(line), F.lit(1)) < 0.6)


def _collected(part: Column, skip, first: Column) -> Column:
    """Lines in order until a stop; a line with a PIN code is the last, one with a VID or a number of 12 digits ends before."""
    start = F.struct(F.lit(False).alias("done"), first.alias("out"))

    def step(s: Column, x: Column) -> Column:
        stops = x.rlike("(?i)" + VID[0]) | F.substring(F.regexp_replace(x, " ", ""), 1, 12).rlike("^[0-9]{4}[ \\t]?[0-9]{4}[ \\t]?[0-9]{4}$")
        taken = ~s["done"] & ~stops & ~skip(x)
        return F.struct((s["done"] | stops | (taken & x.rlike(PIN))).alias("done"), F.when(taken, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    return F.aggregate(part, start, step)["out"]


def address(rows: Column, most: int = 6) -> Column:
    """The labelled address: the label's own line and up to ``most`` further ones; else what follows a guardian or PIN code."""
    none = F.array().cast("array<string>")
    at = F.array_position(F.transform(rows, lambda x: x.rlike("(?i)" + ADDRESS[0])), True).cast("int")
    own = _value(F.regexp_extract(F.get(rows, at - 1), f"(?i){ADDRESS[0]}(.*)$", 1))
    labelled = _collected(F.slice(rows, F.greatest(at, F.lit(0)) + 1, F.lit(most)), garbled, F.when(own.isNotNull(), F.array(own)).otherwise(none))
    mark = F.array_position(F.transform(rows, lambda x: x.rlike(f"(?i){GUARDIAN}|{PIN}")), True).cast("int")
    guessed = _collected(F.slice(rows, F.greatest(mark, F.lit(1)), F.lit(5)), lambda x: garbled(x) | looks_like_label(x), none)
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", "))
    return F.when(at > 0, joined(labelled)).when(mark > 0, joined(guessed))


def clean_text(value: Column) -> Column:
    """Capitals with nothing but letters, digits and common punctuation; null if nothing is left."""
    cut = F.trim(F.regexp_replace(F.regexp_replace(value, "[^\\p{Alnum} .,'#:/()&-]", " "), "\\s+", " "))
    return F.nullif(F.upper(cut), F.lit(""))


def label_token(word: Column) -> Column:
    """A word as labels are compared: capitals, digits and full stops at most."""
    # a range from the full stop to 9 has / too
    return F.regexp_replace(F.translate(F.upper(word), "/", ""), "[^.-9A-Z]", "")
