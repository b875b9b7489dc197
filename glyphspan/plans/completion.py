"""What can come next in a half-typed query: legal kinds of tokens, features, and values from the corpus's stored lists.

The text's tokens move through five places: the begin, behind an author; a span's first term; a span; a bracket's or chain's
next part; behind such a part.  Authors, lemmata and words come from sorted lists by a range scan, never to the driver whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspan.functions.inflection import CATEGORIES, DEGREES, SHORT
from glyphspan.plans.language import MOST_NEAR, QueryError

#: Places and where each kind of token leads from them; behind a part it depends on what came before.
STEPS = {
    "begin": {"author": "begin", "(": "part", "word": "span"},
    "next": {"(": "part", "word": "span"},
    "span": {"word": "span", "and": "part", "or": "part", "near": "next", "(": "part"},
    "part": {"word": "said"},
}
MOST = 50
FEATURES = {c: [names[0] for names in values] for c, values in [*CATEGORIES.items(), ("degree", DEGREES)]}


@dataclass(frozen=True)
class Token:
    text: str
    start: int
    kind: str


def kind_of(token: str) -> str:
    if token in ("(", ")", "and", "or"):
        return token
    if token.isspace():
        return "space"
    if token.startswith("#"):
        return "author"
    return "near" if "~" in token and not token.startswith("@") else "word"


def tokens(text: str) -> list[Token]:
    """Brackets, runs of blanks and what is between them, with their places in the text."""
    return [Token(m[0], m.start(), kind_of(m[0])) for m in re.finditer(r"[()]| +|[^ ()]+", text)]


@dataclass
class _Walk:
    place: str = "begin"
    depth: int = 0
    operator: str | None = None
    author: bool = False
    closed: bool = False

    def options(self) -> dict[str, str]:
        if self.place != "said":
            found = dict(STEPS[self.place])
        else:
            found = {k: "part" for k in ("and", "or") if self.operator in (None, k)}
            found |= {")": "span"} if self.depth else {"near": "next", "word": "span", "(": "part"}
        return {k: v for k, v in found.items() if not (self.closed and k in ("and", "or"))}


def walk(found: list[Token]) -> tuple[list[str], list[list[Token]]]:
    """(kinds that may come next, the tokens of each term, authors and relations being terms of their own); ``QueryError`` where
    a token may not stand where it does."""
    at, terms, before = _Walk(), [], None
    for t in (t for t in found if t.kind != "space"):
        if t.kind in ("and", "or") and at.operator not in (None, t.kind):
            raise QueryError("`and` and `or` cannot be mixed on the same word")
        options = at.options()
        if t.kind not in options:
            raise QueryError("authors must come first" if t.kind == "author" else f"`{t.text}` is not allowed " + (f"after `{before.text}`" if before else "at the start"))
        if t.kind == "author":
            if at.author:
                raise QueryError("only one author is allowed")
            at.author = True
        begins = t.kind in ("author", "near", "(") or (t.kind == "word" and at.place != "part")
        if begins or t.kind == ")":
            at.operator = None
        if t.kind in ("and", "or"):
            at.operator = t.kind
        if begins:
            terms.append([])
        terms[-1].append(t)
        at.place, at.depth, at.closed, before = options[t.kind], at.depth + {"(": 1, ")": -1}.get(t.kind, 0), t.kind == ")", t
    return [k for k in at.options() if not (at.author and k == "author")], terms


def category_of(label: str) -> str | None:
    """The category of a whole or short label; else None."""
    label = SHORT.get(label, label)
    return label if label in FEATURES else None


def fault(token: Token) -> str | None:
    """What is wrong with a whole token, apart from where it stands."""
    if token.kind == "near":
        m = re.fullmatch(r"(\d*)~>?", token.text)
        return None if m and (not m[1] or 1 <= int(m[1]) <= MOST_NEAR) else f"`{token.text}`: expected ~, N~ or N~>, N from 1 to {MOST_NEAR}"
    if token.kind != "word" or not (token.text.startswith("@") or ":" in token.text):
        return None
    if not token.text.startswith("@"):
        return f"`{token.text}` lacks an @"
    label, _, value = token.text[1:].partition(":")
    if not value:
        return f"`{token.text}` lacks a value"
    if label in ("lemma", "l"):
        return None
    if (category := category_of(label)) is None:
        return f"`{label}` is not known"
    names = DEGREES if category == "degree" else CATEGORIES[category]
    return None if any(value in n for n in names) else f"`{value}` is no {category}"


@dataclass(frozen=True)
class Option:
    """A way to go on: the query's text then, and its kind; ``lookup`` (list, beginning) stands for all values found there."""

    kind: str
    becomes: str
    lookup: tuple[str, str] | None = None


def _wrapped(found: list[Token], terms: list[list[Token]]) -> str:
    """The text with its last term, a word alone, behind an opening bracket."""
    start = terms[-1][0].start
    text = "".join(t.text for t in found)
    return text[:start] + "(" + text[start:].rstrip(" ")


def options(text: str) -> list[Option]:
    """All ways to go on; ``QueryError`` for a text that no query begins with."""
    found = tokens(text)
    if not found or found[-1].kind in ("space", "(", ")"):
        kinds, terms = walk(found)
        for t in found:
            if (wrong := fault(t)) is not None:
                raise QueryError(wrong)
        lead = text if not text or text[-1] in " (" else text + " "
        shown = {"word": lambda: [Option("word", lead), Option("feature", lead + "@")], "near": lambda: [Option("near", lead + "~ ")], "author": lambda: [Option("author", lead + "#")], ")": lambda: [Option(")", text.rstrip(" ") + ") ")], "(": list}
        more = lambda k: [Option(k, (text.rstrip(" ") if any(t.kind == "(" for t in terms[-1]) else _wrapped(found, terms)) + f" {k} ")]
        return [o for k in kinds for o in (shown[k]() if k in shown else more(k))]
    last, head = found[-1], text[: found[-1].start]
    if last.kind == "author":
        walk(found)
        return [Option("author", head + "#", ("author", last.text[1:].replace("_", " ").lower()))]
    walk(found[:-1])
    if last.kind == "near":
        if (wrong := fault(last)) is not None:
            raise QueryError(wrong)
        return [Option("near", head + last.text + end) for end in ((" ", "> ") if last.text.endswith("~") else (" ",))]
    if last.text.startswith("@"):
        label, colon, value = last.text[1:].partition(":")
        if not colon:
            names = [c for c in ("lemma", *FEATURES) if c.startswith(label)]
            values = [(c, v) for c, names_ in FEATURES.items() for v in names_ if label and v.startswith(label)]
            out = [Option("feature", f"{head}@{c}:") for c in names] + [Option("value", f"{head}@{c}:{v} ") for c, v in values]
            if not out:
                raise QueryError(f"`{label}` is not known")
            return out
        if label in ("lemma", "l"):
            return [Option("lemma", f"{head}@{label}:", ("lemma", value[:1] + value[1:].lower()))]
        if (category := category_of(label)) is None:
            raise QueryError(f"`{label}` is not known")
        out = [Option("value", f"{head}@{label}:{v} ") for v in FEATURES[category] if v.startswith(value)]
        if not out and fault(last) is not None:
            raise QueryError(f"`{value}` is no {category}")
        return out or [Option("value", f"{head}{last.text} ")]
    return [Option("word", head, ("word", last.text.lower()))]


def completions(lists: DataFrame, text: str, most: int = MOST) -> DataFrame:
    """(text, kind, becomes): the ways to go on with ``text``, of a list's values the first ``most`` in order.

    ``lists``: rows (kind, place, value) as ``sinks.put_lists`` writes them.  A text that no query begins with has one row
    of kind ``fault``, with what is wrong.  An author's blanks are written as underscores.
    """
    spark = lists.sparkSession
    try:
        ways = options(text)
    except QueryError as e:
        ways = [Option("fault", str(e))]
    fixed = spark.createDataFrame([(text, o.kind, o.becomes) for o in ways if o.lookup is None], "text string, kind string, becomes string")
    for o in (o for o in ways if o.lookup is not None):
        which, begin = o.lookup
        near = lists.where((F.col("kind") == which) & F.startswith("place", F.lit(begin))).orderBy("place", "value").limit(most)
        value = F.translate("value", " ", "_") if which == "author" else F.col("value")
        fixed = fixed.unionByName(near.select(F.lit(text).alias("text"), F.lit(o.kind).alias("kind"), F.concat(F.lit(o.becomes), value, F.lit(" ")).alias("becomes")))
    return fixed
