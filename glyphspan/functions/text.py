"""Text functions as Columns: words and breaks, sentences, keys, numerals."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate words (a hyphen is part of a word).
BREAKS = " ()[];:.,?!'\n\t—\"†‘“”’<>"
_SET = "".join("\\" + c if c in "[]()" else c for c in BREAKS)
CHUNKS = f"([^{_SET}]+|[{_SET}]+)"
CHUNK = f"[^{_SET}]+[{_SET}]*"
IS_BREAK = f"^[{_SET}]"


def word_list(text: Column) -> Column:
    """The words of a text."""
    return F.regexp_extract_all(text, F.lit(f"([^{_SET}]+)"), F.lit(1))


def words(text: Column) -> Column:
    """Array of (text, norm, brk, hard) of a text's words; ``brk`` is what follows, ``hard`` a sentence's or the text's end."""

    def ended(pairs: Column) -> Column:
        return F.transform(
            pairs,
            lambda w, i: F.struct(
                w["text"].alias("text"), normal(w["text"]).alias("norm"), w["brk"].alias("brk"), (F.contains(w["brk"], F.lit(".")) | (i == F.size(pairs) - 1)).alias("hard")
            ),
        )

    return let(F.arrays_zip(word_list(text).alias("text"), breaks(text).alias("brk")), ended)


def breaks(text: Column) -> Column:
    """What follows each word of a text."""
    return F.regexp_extract_all(text, F.lit(f"[^{_SET}]+([{_SET}]*)"), F.lit(1))


def word_of(chunk: Column) -> Column:
    """The word of a word and what follows it."""
    return F.rtrim(chunk, F.lit(BREAKS))


def break_of(chunk: Column, word: Column) -> Column:
    """What follows ``word`` in its chunk."""
    return F.substr(chunk, F.char_length(word) + 1)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _marked(marks: set[str] | None) -> tuple[str, str]:
    """Letters composed with marks (any combining ones, or only ``marks``), and those letters without."""
    pairs = []
    for c in map(chr, range(0xC0, 0x3000)):
        parts = unicodedata.normalize("NFD", c)
        rest = unicodedata.normalize("NFC", "".join(p for p in parts if not (_combining(p) if marks is None else p in marks)))
        if rest != c and len(rest) == 1 and len(parts) > 1:
            pairs.append((c, rest))
    return "".join(c for c, _ in pairs), "".join(r for _, r in pairs)


def _combining(c: str) -> bool:
    return "\u0300" <= c <= "\u036f" or "\u1dc0" <= c <= "\u1dff" or "\u20d0" <= c <= "\u20ff"


# The combining signs of length, above a long and a short vowel.
MACRON, BREVE = "\u0304", "\u0306"
_LONG, _SHORT = _marked({MACRON}), _marked({BREVE})
_LENGTHS, _ALL = _marked({MACRON, BREVE}), _marked(None)
_COMBINING = "".join(c for r in ((0x300, 0x370), (0x1DC0, 0x1E00), (0x20D0, 0x2100)) for c in map(chr, range(*r)))


def strip_lengths(text: Column) -> Column:
    """Without signs of vowel length; other marks stay."""
    return F.translate(text, _LENGTHS[0] + MACRON + BREVE, _LENGTHS[1])


def strip_diacritics(text: Column) -> Column:
    """Without combining marks, composed with their letters or not."""
    return F.translate(text, _ALL[0] + _COMBINING, _ALL[1])


def marked_positions(text: Column) -> Column:
    """Array of (position, mark) of the signs of length: position counts the letters before, mark is long or short.

    Composed letters and combining signs behind letters count alike.
    """
    spread = F.regexp_replace(text, f"([{_LONG[0]}])", "$1" + MACRON)
    spread = F.regexp_replace(spread, f"([{_SHORT[0]}])", "$1" + BREVE)
    chars = F.filter(F.split(spread, ""), lambda c: c != "")
    begin = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<position:int,mark:string>>").alias("found"))

    def step(now: Column, c: Column) -> Column:
        sign = F.when(c == MACRON, "long").when(c == BREVE, "short")
        found = F.when(sign.isNotNull(), F.concat(now["found"], F.array(F.struct((now["n"] - 1).alias("position"), sign.alias("mark"))))).otherwise(now["found"])
        return F.struct((now["n"] + F.when(c.rlike(r"^\p{M}$"), 0).otherwise(1)).alias("n"), found.alias("found"))

    return F.aggregate(chars, begin, step, lambda now: now["found"])


def compatible_lengths(a: Column, b: Column) -> Column:
    """Equally many letters, and nowhere one of them long only and the other short only."""

    def only(word: Column, mark: str, other: str) -> Column:
        at = lambda m: F.transform(F.filter(word, lambda x: x["mark"] == m), lambda x: x["position"])
        return F.array_except(at(mark), at(other))

    letters = lambda w: F.char_length(strip_diacritics(w))
    x, y = marked_positions(a), marked_positions(b)
    clash = F.arrays_overlap(only(x, "long", "short"), only(y, "short", "long")) | F.arrays_overlap(only(x, "short", "long"), only(y, "long", "short"))
    return (letters(a) == letters(b)) & ~F.coalesce(clash, F.lit(False))


def normal(word: Column) -> Column:
    """The key of a word: lower case without signs of vowel length.  Words of ASCII alone have none and are not looked through."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(strip_lengths(F.lower(word)))


def clean_key(headword: Column) -> Column:
    """Key under which a headword is found: without marks, lower case, ss for sharp s, no apostrophes."""
    return F.replace(F.replace(F.lower(strip_diacritics(headword)), F.lit("ß"), F.lit("ss")), F.lit("'"), F.lit(""))


def whole_number(text: Column) -> Column:
    """The integer a text is, or null."""
    return F.when(text.rlike("^-?[0-9]+$"), text.try_cast("bigint"))


def roman(number: Column) -> Column:
    """Roman numeral of 1..3999: each decimal digit by its own signs."""
    n = number.cast("int")
    digit = lambda unit: F.pmod(F.floor(n / unit), F.lit(10)).cast("int")
    parts = [F.repeat(F.lit("M"), F.floor(n / 1000).cast("int"))]
    for unit, (one, five, ten) in ((100, "CDM"), (10, "XLC"), (1, "IVX")):
        d = digit(unit)
        low = F.repeat(F.lit(one), F.pmod(d, F.lit(5)))
        parts.append(F.when(d == 9, F.lit(one + ten)).when(d == 4, F.lit(one + five)).when(d >= 5, F.concat(F.lit(five), low)).otherwise(low))
    return F.concat(*parts)


def from_roman(numeral: Column) -> Column:
    """The number a Roman numeral stands for, or null: signs or pairs of signs (a lesser before a greater one) never ascend.

    Pairs are read from the left: equal or ascending signs together, a greater sign alone.
    """
    values = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    signs = F.transform(F.filter(F.split(F.upper(numeral), ""), lambda c: c != ""), lambda c: F.try_element_at(table, c))
    state = lambda total, held, most, ok: F.struct(total.alias("total"), held.alias("held"), most.alias("most"), ok.alias("ok"))
    none = F.lit(None).cast("int")

    def read(now: Column, m: Column) -> Column:
        n = now["held"]
        top = F.greatest(n, m)
        waits = state(now["total"], m, now["most"], now["ok"])
        alone = state(now["total"] + n, m, top, now["ok"] & (top <= now["most"]))
        pair = state(now["total"] + F.when(n == m, n + m).otherwise(m - n), none, top, now["ok"] & (top <= now["most"]))
        return F.when(n.isNull(), waits).when(n > m, alone).otherwise(pair)

    begin = state(F.lit(0), none, F.lit(1 << 30), F.lit(True))
    done = F.aggregate(signs, begin, read, lambda s: F.when(s["ok"] & (s["held"].isNull() | (s["held"] <= s["most"])), s["total"] + F.coalesce(s["held"], F.lit(0))))
    return F.when(~F.exists(signs, lambda v: v.isNull()), done)


def slug(name: Column, special: dict[str, str] | None = None) -> Column:
    """A name as part of an address: as ``special`` has it, else in lower case with underscores."""
    plain = F.replace(F.lower(name), F.lit(" "), F.lit("_"))
    if not special:
        return plain
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in special.items() for x in pair]), name), plain)


def short_before(headword: Column, *clusters: str) -> Column:
    """Whether one of the consonant clusters stands behind a letter that is not marked as long."""
    either = "|".join(clusters)
    return headword.rlike(f"(?<=.)(?<![{_LONG[0]}{MACRON}])(?:{either})")


def has_letters(text: Column) -> Column:
    """Whether a text is empty or has a Latin or Greek letter."""
    return (text == "") | text.rlike(r"[\p{IsLatin}\p{IsGreek}]")
