"""URL filters: rules by host and path, and logistic regression on hashed character n-grams for urls without a rule.

A rule holds for its host and all subdomains where the path begins with the rule's; of several the longest holds.  The
classifier sees the host and the path apart: all runs of ``GRAMS`` characters of each, with its ends marked, are hashed into
``BUCKETS`` places; what a url holds of each place is scaled to length one, so long urls say no more than short ones.  The
weights minimise the regularised log loss over a small labelled table and are found by Newton steps in the span of the rows.

Scale: what is learned from is a table of at most ``MOST_LABELLED`` urls (a larger one is drawn from by a hash of the url),
so its fit is a small problem on the driver; the weights have ``BUCKETS`` numbers.  Urls are scored where they lie, in
batches, and nothing is shuffled.  Up to ``MOST_RULES`` rules travel with the tasks; more are joined: every host's suffixes
and the beginnings of its path, of the lengths that rules have, are equality keys, and the longest rule of a row is kept.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged as the classifier judges two
empty texts; letters A-Z of hosts become small, ports and user names stay part of the host, a rule with an empty host or a
null is an error; labelled urls that are null or have no label teach nothing, and without both labels, learning is an error;
repeated labelled urls count as often as they occur (in the table that is learned from, not when it is drawn); repeated rows
are judged each; an empty table gives none; existing names of new columns are an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphspan.llm.common import fresh, stored, unused

GRAMS = (2, 3, 4, 5)
BUCKETS = 1 << 16
MOST_LABELLED = 1000
MOST_RULES = 100_000
#: Weight of the squared weights against the log loss of one row.
PENALTY = 0.01
STEPS = 50
THRESHOLD = 0.5
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, below a beginning of the path (with its slash)."""

    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float
    grams: tuple[int, ...]


def host_of(url: str | Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z as small letters."""
    rest = F.regexp_extract(url if isinstance(url, Column) else F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url if isinstance(url, Column) else F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def places(host: str, path: str, buckets: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(places, values of length one) of a url's character n-grams."""
    found: list[int] = []
    for kind, text in ((b"h", f"^{host}$"), (b"p", f"^{path}$")):
        start = zlib.crc32(kind)
        for n in grams:
            found += [zlib.crc32(text[i : i + n].encode("utf-8", "surrogatepass"), start) for i in range(len(text) - n + 1)]
    at, count = np.unique(np.array(found, np.int64) % buckets, return_counts=True)
    return at, count / np.sqrt((count.astype(np.float64) ** 2).sum() or 1.0)


def fit(rows: list[tuple[str, str, int]], buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS, penalty: float = PENALTY) -> UrlModel:
    """The weights of least regularised log loss for rows of (host, path, 1 if to be blocked).

    They are a sum of the rows' features, so Newton's steps need only the rows' inner products, however many places there are."""
    y = np.array([r[2] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        raise ValueError("both labels must occur")
    features = [places(host, path, buckets, grams) for host, path, _ in rows]
    used = np.unique(np.concatenate([at for at, _ in features]))
    x = np.zeros((len(rows), len(used)))
    for row, (at, value) in zip(x, features, strict=True):
        row[np.searchsorted(used, at)] = value
    kernel = x @ x.T
    a, b = np.zeros(len(y)), 0.0  # weights are x.T @ a
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(kernel @ a + b)))
        s = np.maximum(p * (1 - p), 1e-9)
        # (kernel + penalty / s) a + b = z and sum(a) = 0, the bias being free of the penalty
        z = kernel @ a + b + (y - p) / s
        left = np.block([[kernel + np.diag(penalty / s), np.ones((len(y), 1))], [np.ones((1, len(y))), np.zeros((1, 1))]])
        told = np.linalg.solve(left, np.append(z, 0.0))
        moved = max(np.abs(told[:-1] - a).max(), abs(told[-1] - b))
        a, b = told[:-1], float(told[-1])
        if moved < 1e-10:
            break
    weights = np.zeros(buckets)
    weights[used] = x.T @ a
    return UrlModel(weights, b, tuple(grams))


def learn(labelled: DataFrame, url: str = "url", blocked: str = "blocked", most: int = MOST_LABELLED, **how) -> UrlModel:
    """Fit to a labelled table, or to ``most`` of its rows by a hash of the url."""
    rows = labelled.where(F.col(url).isNotNull() & F.col(blocked).isNotNull())
    told = rows.select(host_of(url).alias("host"), path_of(url).alias("path"), F.col(blocked).cast("int").alias("y"), F.xxhash64(url).alias("h"), F.col(url).alias("url"))
    return fit([(r["host"], r["path"], r["y"]) for r in told.orderBy("h", "url", "y").limit(most).collect()], **how)


def with_score(df: DataFrame, model: UrlModel, host: str = "host", path: str = "path", score: str = "score") -> DataFrame:
    """The rows with the classifier's probability that they are to be blocked."""
    unused(df, score)

    @F.pandas_udf("double")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        out = np.empty(len(hosts))
        for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            at, value = places(h, p, len(model.weights), model.grams)
            out[i] = model.weights[at] @ value + model.bias
        return pd.Series(1 / (1 + np.exp(-out)))

    return df.withColumn(score, judge(F.col(host), F.col(path)))


def _suffixes(host: str) -> Iterator[str]:
    while host:
        yield host
        host = host.partition(".")[2]


def rules_in_tasks(df: DataFrame, rules: list[Rule], host: str, path: str, rule: str, verdict: str) -> DataFrame:
    """The rows with the longest rule that fits and its verdict, looked up in a dictionary that each task holds."""
    by: dict[str, list[tuple[str, str]]] = {}
    for r in sorted(rules, key=lambda r: -len(r.path)):
        by.setdefault(r.host, []).append((r.path, r.verdict))
    kind = F.pandas_udf("rule string, verdict string")

    @kind
    def look_up(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        out = []
        for h, p in zip(hosts, paths, strict=True):
            fits = (max(((len(s) + len(start), s + start, v) for start, v in by[s] if p.startswith(start)), default=None) for s in _suffixes(h) if s in by)
            best = max((f for f in fits if f), default=(0, None, None))
            out.append(best[1:])
        return pd.DataFrame(out, columns=["rule", "verdict"])

    at = fresh(df, "__rule")
    told = df.withColumn(at, look_up(F.col(host), F.col(path)))
    return told.select(*df.columns, F.col(at)["rule"].alias(rule), F.col(at)["verdict"].alias(verdict))


def rules_by_join(df: DataFrame, rules: DataFrame, host: str, path: str, rule: str, verdict: str) -> DataFrame:
    """The same for any number of rules: suffixes of the host and beginnings of the path are joined to the rules.

    Keys are joined once each however many rows have them, and rows take the longest of what their keys found."""
    row = fresh(df, "__row")
    kept = stored(df.withColumn(row, F.monotonically_increasing_id()), "urls")
    lengths = sorted(r["n"] for r in rules.select(F.char_length("path").alias("n")).distinct().collect())  # bounded by the longest path of a rule
    parts = F.split(F.col(host), r"\.", -1)
    suffixes = F.when(F.col(host) != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array())
    starts = F.array_distinct(F.array(*[F.substring(F.col(path), 1, n) for n in lengths]))
    keys = kept.select(row, F.explode(suffixes).alias("__h"), starts.alias("__starts")).select(row, "__h", F.explode("__starts").alias("__p"))
    held = keys.join(rules.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("verdict").alias("__v")), ["__h", "__p"])
    size = F.char_length("__h") + F.char_length("__p")
    best = held.groupBy(row).agg(F.max(F.struct(size.alias("n"), F.concat("__h", "__p").alias("rule"), F.col("__v").alias("verdict"))).alias("__best"))
    return kept.join(best, row, "left").select(*df.columns, F.col("__best")["rule"].alias(rule), F.col("__best")["verdict"].alias(verdict))


def judge(
    df: DataFrame,
    model: UrlModel,
    rules: DataFrame,
    url: str = "url",
    threshold: float = THRESHOLD,
    most_rules: int = MOST_RULES,
    host: str = "host",
    path: str = "path",
    rule: str = "rule",
    score: str = "score",
    verdict: str = "verdict",
) -> DataFrame:
    """The rows with host, path, the rule that holds (or null), the classifier's score and the verdict.

    ``rules`` has host, path and verdict (allow or block); of equal rules the one that blocks holds."""
    unused(df, host, path, rule, score, verdict)
    rules = rules.select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path", "verdict")
    wrong = (F.coalesce(F.col("host"), F.lit("")) == "") | F.col("path").isNull() | ~F.coalesce(F.col("verdict").isin(ALLOW, BLOCK), F.lit(False))
    if bad := rules.where(wrong).first():
        raise ValueError(f"not a rule: {bad}")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    some = [Rule(*r) for r in rules.limit(most_rules + 1).collect()]
    told = df.withColumns({host: host_of(url), path: path_of(url)})
    by_rule = fresh(told, "__verdict")
    told = rules_in_tasks(told, some, host, path, rule, by_rule) if len(some) <= most_rules else rules_by_join(told, rules, host, path, rule, by_rule)
    told = with_score(told, model, host, path, score)
    learned = F.when(F.col(score) >= threshold, BLOCK).otherwise(ALLOW)
    return told.select(*df.columns, host, path, rule, score, F.coalesce(F.col(by_rule), learned).alias(verdict))
