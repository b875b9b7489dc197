"""Grammatical features: categories, their values and synonyms, bit masks, and masks merged and compared by category.

A mask has one bit for each value of each category.  No bit of a category means that it is open; several mean that any of
these values is possible.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in the order of their bits, and the names of their values, the first of each being the full one.
CATEGORIES: dict[str, list[tuple[str, ...]]] = {
    "case": [("nominative", "nom", "n"), ("accusative", "acc", "ac"), ("dative", "dat", "d"), ("genitive", "gen", "g"), ("ablative", "abl", "ab"), ("vocative", "voc", "v"), ("locative", "loc", "l")],
    "number": [("singular", "sg", "s"), ("plural", "pl", "p")],
    "gender": [("masculine", "m", "mas", "masc"), ("feminine", "f", "fem"), ("neuter", "n", "neu", "neut"), ("adverbial", "adv", "a")],
    "person": [("first", "1st", "i"), ("second", "2nd", "ii"), ("third", "3rd", "iii")],
    "mood": [("indicative", "ind"), ("imperative", "imp"), ("subjunctive", "subj", "sub"), ("participle", "part"), ("gerundive", "ger"), ("infinitive", "inf"), ("supine", "sup")],
    "voice": [("active", "act", "a"), ("passive", "pass", "p")],
    "tense": [
        ("present", "pres", "pr"),
        ("imperfect", "impf", "i"),
        ("perfect", "perf", "pf"),
        ("futureperfect", "future_perfect", "future-perfect", "ftpf", "fp"),
        ("future", "fut", "f"),
        ("pluperfect", "plup", "pp"),
    ],
}
# The comparative degrees, which queries may name but masks do not hold; and short names of categories.
DEGREES = [("positive", "pos", "p"), ("comparative", "com", "cmp", "comp", "c"), ("superlative", "sup", "s")]
SHORT = {"c": "case", "d": "degree", "g": "gender", "m": "mood", "n": "number", "p": "person", "t": "tense", "v": "voice"}

_START: dict[str, int] = {}
for _name, _values in CATEGORIES.items():
    _START[_name] = sum(len(CATEGORIES[c]) for c in _START)


@dataclass(frozen=True)
class Feature:
    """A value (its number, from 1) of a category."""

    category: str
    value: int

    @property
    def bit(self) -> int:
        """The mask of this value; zero for degrees."""
        return 1 << (_START[self.category] + self.value - 1) if self.category in _START else 0


def category_mask(category: str) -> int:
    return ((1 << len(CATEGORIES[category])) - 1) << _START[category] if category in CATEGORIES else 0


def parse_feature(text: str) -> Feature:
    """``label:value`` or ``label=value``; labels may be short, values may be numbers."""
    at = min((i for i in (text.find(":"), text.find("=")) if i >= 0), default=-1)
    if at < 0:
        raise ValueError(f"no category in {text!r}")
    label, value = text[:at].strip().lower(), text[at + 1 :].strip().lower()
    label = SHORT.get(label, label)
    values = DEGREES if label == "degree" else CATEGORIES.get(label)
    for i, names in enumerate(values or [], 1):
        if value in names or value == str(i):
            return Feature(label, i)
    raise ValueError(f"unknown feature {text!r}")


def mask_of(*features: str) -> int:
    """The mask of features written ``label:value``."""
    return reduce(lambda m, f: m | parse_feature(f).bit, features, 0)


def merged(a: Column, b: Column) -> Column:
    """What both masks allow, category by category; an open category takes the other's values; null where they exclude each other."""
    out = F.lit(0)
    fits = F.lit(True)
    for name in CATEGORIES:
        part = F.lit(category_mask(name))
        x, y = a.bitwiseAND(part), b.bitwiseAND(part)
        out = out.bitwiseOR(F.when(x == 0, y).when(y == 0, x).otherwise(x.bitwiseAND(y)))
        fits = fits & ((x == 0) | (y == 0) | (x.bitwiseAND(y) != 0))
    return F.when(fits, out)


def narrowed(stem: Column, end: Column, tags: Column | None = None) -> Column:
    """Features of a regular form: those of its ending, which must allow all that its stem names; null where it does not.

    The stem's cases and genders are kept where it names any; an ending without gender allows each.  Endings for compounds
    only (tag ``comp_only``) are left out, as are futures of stems marked ``no_fut`` and future participles of ``no_fut_part``.
    """
    out, fits = end, F.lit(True)
    for name in CATEGORIES:
        part = F.lit(category_mask(name))
        s, e = stem.bitwiseAND(part), end.bitwiseAND(part)
        inside = s.bitwiseAND(e) == s
        fits = fits & (inside | (e == 0) if name == "gender" else inside)
        if name in ("case", "gender"):
            out = F.when(s != 0, out.bitwiseAND(F.lit(~category_mask(name))).bitwiseOR(s)).otherwise(out)
    if tags is not None:
        has = lambda feature: end.bitwiseAND(F.lit(mask_of(feature))) != 0
        future = has("tense:future")
        barred = F.array_contains(tags, "comp_only") | (F.array_contains(tags, "no_fut") & future) | (F.array_contains(tags, "no_fut_part") & future & has("mood:participle"))
        fits = fits & ~F.coalesce(barred, F.lit(False))
    return F.when(fits, out)


def values_of(mask: Column, category: str) -> Column:
    """Array of the full names of a category's values in a mask."""
    names = F.array(*[F.lit(v[0]) for v in CATEGORIES[category]])
    return F.filter(names, lambda _, i: F.shiftright(mask, _START[category]).bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)


def mask_from_tags(tags: Column) -> Column:
    """The mask of an array of feature words such as ``nom``, ``abl/dat`` or ``pl``; words that name no feature are left out.

    A word that names values of several categories counts in the first of them that is meant to be written so.
    """
    words = {name: 1 << (_START[c] + i) for c in reversed(CATEGORIES) for i, names in enumerate(CATEGORIES[c]) for name in names if len(name) > 2 or name in ("sg", "pl")}
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    each = F.flatten(F.transform(tags, lambda t: F.split(F.lower(t), "/")))
    return F.aggregate(each, F.lit(0), lambda m, t: m.bitwiseOR(F.coalesce(F.try_element_at(table, t), F.lit(0))))


# Features of tagged treebanks and the values they stand for; those without one are left out, as are further keys.
TREEBANK = {
    "Case": {"Nom": "case:nom", "Acc": "case:acc", "Gen": "case:gen", "Dat": "case:dat", "Abl": "case:abl", "Voc": "case:voc", "Loc": "case:loc"},
    "Number": {"Sing": "number:sg", "Plur": "number:pl", "Plural": "number:pl"},
    "Gender": {"Masc": "gender:masc", "Fem": "gender:fem", "Neut": "gender:neut"},
    "Person": {"1": "person:1", "2": "person:2", "3": "person:3"},
    "Voice": {"Act": "voice:act", "Pass": "voice:pass"},
    "VerbForm": {"Part": "mood:part", "Gdv": "mood:ger", "Inf": "mood:inf", "Sup": "mood:sup", "Fin": None},
    "Mood": {"Ind": "mood:ind", "Imp": "mood:imp", "Sub": "mood:subj", "Gdv": "mood:ger"},
    "Tense": {"Pres": "tense:pres", "Fut": "tense:fut", "Pqp": "tense:plup", "Imp": None, "Perf": None, "Ftp": None, "Past": None},
    "Degree": {"Pos": None, "Cmp": None, "Sup": None, "Abs": None},
}
IGNORED = ("InflClass", "PronType", "Aspect", "NumType", "NumValue", "Form", "Polarity", "AdvType", "Variant", "NameType", "Poss", "NumForm", "Reflex")
TENSE_BY_ASPECT = {"Future,Perf": "tense:futureperfect", "Past,Perf": "tense:plup", "Past,Imp": "tense:impf"}


def mask_from_treebank(tag: Column) -> Column:
    """The mask of a text such as ``Case=Nom|Number=Sing``; unknown keys or values are an error, keys in brackets say nothing."""
    told = F.filter(F.transform(F.split(tag, r"\|"), lambda p: F.btrim(p)), lambda p: p.rlike(r"^[^=\[]+=.+$"))
    bits = {f"{k}={v}": mask_of(f) if f else 0 for k, some in TREEBANK.items() for v, f in some.items()}
    table = F.create_map(*[F.lit(x) for pair in bits.items() for x in pair])
    ignored = lambda p: F.substring_index(p, "=", 1).isin(*IGNORED)

    def add(m: Column, p: Column) -> Column:
        bit = F.coalesce(F.try_element_at(table, p), F.raise_error(F.concat(F.lit("unknown feature "), p)).cast("int"))
        return F.when(ignored(p), m).otherwise(m.bitwiseOR(bit))

    plain = F.aggregate(told, F.lit(0), add)
    value = lambda key: F.coalesce(F.get(F.filter(told, lambda p: F.startswith(p, F.lit(key + "="))), F.lit(0)), F.lit(""))
    both = F.concat(F.substring_index(value("Tense"), "=", -1), F.lit(","), F.substring_index(value("Aspect"), "=", -1))
    tense = F.try_element_at(F.create_map(*[x for k, f in TENSE_BY_ASPECT.items() for x in (F.lit(k), F.lit(mask_of(f)))]), both)
    return F.when(tense.isNotNull(), plain.bitwiseAND(F.lit(~category_mask("tense"))).bitwiseOR(tense)).otherwise(plain)
