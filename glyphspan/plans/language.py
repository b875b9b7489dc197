"""The query language: texts such as ``[Author] @lemma:do oscula 5~> (@case:dat and @number:pl)`` as trees.

A query is a list of terms, each a constraint on one token, with how it relates to the term before: directly behind it, or
within so many tokens of it.  ``parse`` reads, ``check`` says what search supports, ``impossible`` finds contradictions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from glyphspan.functions.inflection import CATEGORIES, Feature, parse_feature

NEAR = 5
MOST_NEAR = 15
MOST_SPANS = 10
MOST_CHARS = 100


class QueryError(ValueError):
    """A query that cannot be read or is not supported."""


@dataclass(frozen=True)
class Word:
    value: str


@dataclass(frozen=True)
class Lemma:
    value: str


@dataclass(frozen=True)
class Inflection:
    feature: Feature


@dataclass(frozen=True)
class Not:
    inner: Constraint


@dataclass(frozen=True)
class All:
    parts: tuple[Constraint, ...]


@dataclass(frozen=True)
class Any:
    parts: tuple[Constraint, ...]


Atom = Word | Lemma | Inflection
Constraint = Word | Lemma | Inflection | Not | All | Any


@dataclass(frozen=True)
class Relation:
    """``distance`` zero: directly behind; else within so many tokens, ``directed``: behind."""

    distance: int = 0
    directed: bool = False


@dataclass(frozen=True)
class Term:
    constraint: Constraint
    relation: Relation = Relation()


@dataclass(frozen=True)
class Query:
    terms: tuple[Term, ...]
    authors: tuple[str, ...] = ()

    def spans(self) -> list[tuple[Relation, list[Constraint]]]:
        """Contiguous stretches of terms, each with how its first token relates to that of the stretch before."""
        out: list[tuple[Relation, list[Constraint]]] = []
        for term in self.terms:
            if out and not term.relation.distance:
                out[-1][1].append(term.constraint)
            else:
                out.append((term.relation, [term.constraint]))
        return out


# --- reading


def _atom(text: str) -> Atom:
    for kind, names in ((Lemma, ("@lemma:", "@l:")), (Word, ("@word:", "@w:"))):
        for name in names:
            if text.startswith(name):
                if not re.fullmatch(r"[A-Za-z]*(#[0-9]+)?", value := text[len(name) :]) or not value:
                    raise QueryError(f"not a word: {value!r}")
                return kind(value)
    if text.startswith("@"):
        try:
            return Inflection(parse_feature(text[1:]))
        except ValueError as e:
            raise QueryError(str(e)) from e
    if re.fullmatch("[A-Za-z]+", text):
        return Word(text)
    raise QueryError(f"not a token: {text!r}")


def _closing(text: str, at: int) -> int:
    """The place of the parenthesis that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if not depth:
            return i
    raise QueryError("a parenthesis is not closed")


def _constraint(text: str) -> Constraint:
    text = text.strip()
    if not text:
        raise QueryError("empty constraint")
    if text.startswith("!"):
        return Not(_constraint(text[1:]))
    if text.startswith("(") and _closing(text, 0) == len(text) - 1:
        return _constraint(text[1:-1])
    parts, words, depth, now = [], [], 0, ""
    for piece in re.split(r"( and | or )", text):
        if piece in (" and ", " or ") and not depth:
            words.append(piece.strip())
            parts.append(now)
            now = ""
        else:
            now += piece
            depth += piece.count("(") - piece.count(")")
        if depth < 0:
            raise QueryError("a parenthesis closes that is not open")
    if depth:
        raise QueryError("a parenthesis is not closed")
    if not words:
        return _atom(text)
    if len(set(words)) > 1:
        raise QueryError("`and` and `or` are mixed without parentheses")
    kind = All if words[0] == "and" else Any
    return kind(tuple(map(_constraint, [*parts, now])))


def _relation(text: str) -> Relation:
    text = text.strip()
    if not text:
        return Relation()
    if not (m := re.fullmatch(r"(.*)~(>?)", text, re.DOTALL)):
        raise QueryError(f"not a relation: {text!r}")
    number = m[1].removeprefix("+")
    if re.fullmatch("0+", number):
        raise QueryError("a distance of zero")
    return Relation(int(number) if re.fullmatch("[0-9]+", number) and int(number) < 256 else NEAR, bool(m[2]))


def _pieces(text: str) -> Iterator[str]:
    """Constraints and, between them, relations."""
    at = 0
    while True:
        begin = at
        if text[at : at + 1] == "!":
            at += 1
        if text[at : at + 1] == "(":
            at = _closing(text, at) + 1
        elif re.match("[@A-Za-z]", text[at:]):
            at = end if (end := text.find(" ", at)) >= 0 else len(text)
        else:
            raise QueryError(f"a constraint is expected at {text[at:]!r}")
        yield text[begin:at]
        if at >= len(text):
            return
        if not (m := re.compile("[!@(A-Za-z]").search(text, at)):
            raise QueryError("the query ends within a relation")
        yield text[at : m.start()]
        at = m.start()


def parse(text: str) -> Query:
    """Read a query; ``QueryError`` for what is none."""
    text, authors = text.strip(), ()
    if text.startswith("["):
        if (end := text.find("]")) < 0:
            raise QueryError("the list of authors is not closed")
        authors = tuple(a for a in map(str.strip, text[1:end].split(",")) if a)
        if not authors:
            raise QueryError("the list of authors is empty")
        text = text[end + 1 :].strip()
    pieces = list(_pieces(text))
    terms = [Term(_constraint(pieces[0]))] + [Term(_constraint(c), _relation(r)) for r, c in zip(pieces[1::2], pieces[2::2], strict=True)]
    return Query(tuple(terms), authors)


def with_author_mark(text: str) -> str:
    """``#Author words`` as ``[Author] words``; an underscore in the author's name stands for a blank."""
    marks = re.findall(r"(?<!\S)#(\S+)", text)
    if not marks:
        return text
    rest = " ".join(re.sub(r"(?<!\S)#\S+", " ", text).split())
    return f"[{', '.join(m.replace('_', ' ') for m in marks)}] {rest}"


# --- checking


def atoms(c: Constraint) -> list[Atom]:
    if isinstance(c, Not):
        return atoms(c.inner)
    return [a for p in c.parts for a in atoms(p)] if isinstance(c, (All, Any)) else [c]


def _depth(c: Constraint) -> int:
    if isinstance(c, Not):
        return _depth(c.inner)
    return 1 + max(map(_depth, c.parts)) if isinstance(c, (All, Any)) else 1


def _negated(c: Constraint) -> bool:
    return isinstance(c, Not) or (isinstance(c, (All, Any)) and any(map(_negated, c.parts)))


def check(query: Query, extended: bool = False) -> None:
    """``QueryError`` for more than one author, over ten spans, distances out of range, and, unless ``extended``, for
    negations and constraints that are more than an `and` or an `or` of atoms."""
    if len(query.authors) > 1:
        raise QueryError("more than one author")
    if len(query.spans()) > MOST_SPANS:
        raise QueryError(f"more than {MOST_SPANS} spans")
    for term in query.terms:
        if term.relation.distance > MOST_NEAR:
            raise QueryError(f"a distance of more than {MOST_NEAR}")
        if not extended and (_negated(term.constraint) or _depth(term.constraint) > 2):
            raise QueryError("only atoms and an `and` or an `or` of atoms are supported")


def _value(category: str, name: str) -> int:
    return next(i for i, names in enumerate(CATEGORIES[category], 1) if names[0] == name)


# Moods that only verbs have; what some moods exclude or demand of other categories.
VERBAL_MOODS = ("imperative", "infinitive", "indicative", "subjunctive")
EXCLUDED = {
    "subjunctive": {"tense": ("future", "futureperfect")},
    "infinitive": {"tense": ("future", "futureperfect", "imperfect", "pluperfect"), "person": "any", "number": "any"},
    "participle": {"person": "any"},
}
DEMANDED = {"supine": {"gender": ("neuter",), "case": ("nominative", "dative")}, "imperative": {"tense": ("present", "future")}}


def _demanded(c: Constraint) -> list[Atom]:
    """The atoms that all must hold for a constraint to hold: its own and those of an `and` inside an `and`, none below `or` and `!`."""
    return [a for p in c.parts for a in _demanded(p)] if isinstance(c, All) else [] if isinstance(c, (Any, Not)) else [c]


def _parts(c: Constraint) -> list[Constraint]:
    """The parts of an `and`, an `and` inside it taken apart."""
    return [x for p in c.parts for x in _parts(p)] if isinstance(c, All) else [c]


def impossible(c: Constraint) -> bool:
    """True for a constraint that no single token can meet: an `and` of two lemmata, of a noun's and a verb's category, of two
    values of one category, of a mood and what it excludes, of something and its negation, or with an impossible part; an
    `or` of which all parts are so."""
    if isinstance(c, Any):
        return all(map(impossible, c.parts))
    if not isinstance(c, All):
        return False
    parts, every = _parts(c), _demanded(c)
    if any(impossible(p) for p in parts) or any(isinstance(p, Not) and p.inner in parts for p in parts):
        return True
    if len({a.value for a in every if isinstance(a, Lemma)}) > 1:
        return True
    features = {a.feature for a in every if isinstance(a, Inflection) and a.feature.category != "degree"}
    found = {f.category: f.value for f in features}
    if len(found) < len(features):
        return True
    mood = CATEGORIES["mood"][found["mood"] - 1][0] if "mood" in found else None
    if {"case", "gender"} & set(found) and ({"tense", "voice", "person"} & set(found) or mood in VERBAL_MOODS):
        return True
    excluded = any(k in found and (v == "any" or found[k] in [_value(k, x) for x in v]) for k, v in EXCLUDED.get(mood, {}).items())
    return excluded or any(k in found and found[k] not in [_value(k, x) for x in v] for k, v in DEMANDED.get(mood, {}).items())


# --- places in results


@dataclass(frozen=True)
class Cursor:
    """Where a page ends: results so far, and the document and position of the last one."""

    results: int
    doc_id: int
    pos: int

    def __str__(self) -> str:
        return f"{self.results},{self.doc_id},{self.pos}"

    @staticmethod
    def read(text: str | None) -> Cursor | None:
        """The cursor written so; anything else is the beginning."""
        return Cursor(*map(int, text.split(","))) if text and re.fullmatch(r"\d+,-?\d+,\d+", text) else None
