"""URL filters: host rules first, gradient-boosted trees on lexical features for the rest. DataFrame operations only.

Features are binned and labelled URLs are counted for each combination of bins. The trees are fitted on those counts,
exactly as on the rows, and come back as nested CASE expressions over the bins. Statistics of suffixes (the last two
labels of the host, the last one, and the first segment of the path) are block rates over all labelled URLs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import let

#: (host, path, verdict); a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

_CUTS: dict[str, tuple[float, ...]] = {
    "length": (30, 40, 50, 60, 80),
    "depth": (1, 2, 3, 4),
    "digits": (0.02, 0.05, 0.08, 0.12, 0.2),
    "entropy": (2.5, 3.0, 3.25, 3.5, 3.75),
    "path_entropy": (1.5, 2.0, 2.5, 3.0, 3.5),
    "params": (1, 2),
    "labels": (3, 4),
    "hyphens": (1, 2),
    "segment": (1, 2, 3, 4, 8),
    "lead": tuple(range(1, 12)),
}
#: Kinds of suffix statistics, each a feature of its own.
_KINDS = ("domain", "top", "first")
_NEUTRAL = 3


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null or without ://."""
    raw = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(raw, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(raw, pattern, 2)


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null without one; of equally long ones the first listed."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits for each character; 0 for empty."""
    def spread(h: Column) -> Column:
        share = lambda c: (F.length(h) - F.length(F.replace(h, c, F.lit("")))) / F.length(h)
        chars = F.array_distinct(F.filter(F.split(h, ""), lambda c: c != ""))
        return F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))

    return F.when(F.length(text) > 0, let(text, spread)).otherwise(0.0)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """lead: 0 without a second segment, 1 to 10 for its first digit, 11 for another first character. segment: length of the first one."""
    raw = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(raw), F.lit(1))
    query = F.regexp_extract(raw, r"(?s)^[^?#]*\?([^#]*)", 1)
    lead = F.regexp_extract(path, r"(?s)^/+[^/]+/+([^/])", 1)
    return {
        "length": F.length(raw), "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")), "digits": F.length(F.regexp_replace(raw, "[^0-9]", "")) / n,
        "entropy": _entropy(host), "path_entropy": _entropy(path), "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "labels": F.size(F.split(host, r"\.")),
        "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))), "segment": F.length(_first(path)), "lead": F.when(lead == "", 0).when(lead.rlike("^[0-9]$"), F.ascii(lead) - 47).otherwise(11),
    }


def _first(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^/+([^/]+)", 1)


def _suffixes(host: Column, path: Column) -> dict[str, Column]:
    return {"domain": F.substring_index(host, ".", -2), "top": F.substring_index(host, ".", -1), "first": _first(path)}


def _bin(name: str, cuts: tuple[float, ...]) -> Column:
    cases = " ".join(f"WHEN f_{name} >= {cuts[i]} THEN {i + 1}" for i in reversed(range(len(cuts))))
    return F.expr(f"CASE {cases} ELSE 0 END")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Trees:
    """suffixes: (kind, value, bin of block rate); trees: nested (feature, cut, left, right) with leaf values."""

    suffixes: tuple[tuple[str, str, int], ...]
    trees: tuple
    base: float


NAMES = (*_CUTS, *_KINDS)


def binned(df: DataFrame, suffixes) -> DataFrame:
    """df (url, host, path, ...) with one int column b_<feature> for each feature."""
    made = {f"f_{k}": v for k, v in features(F.col("url"), F.col("host"), F.col("path")).items()}
    columns = {f"b_{k}": _bin(k, c) for k, c in _CUTS.items()}
    for kind, value in _suffixes(F.col("host"), F.col("path")).items():
        known = ", ".join(f"{_quoted(v)}, {b}" for k, v, b in suffixes if k == kind)
        columns[f"b_{kind}"] = F.coalesce(F.try_element_at(F.expr(f"map({known})"), value), F.lit(_NEUTRAL)) if known else F.lit(_NEUTRAL)
    return df.withColumns(made).select(*df.columns, *[c.alias(k) for k, c in columns.items()])


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """Regression tree on binned rows with gradients and hessians, by gain with L2 of 1; of equal gains the first feature, then the smallest cut."""
    leaf = -float(g.sum()) / (float(h.sum()) + 1.0)
    if not depth or h.sum() < 2:
        return leaf
    best, all_g, all_h = (1e-6, None, 0), g.sum(), h.sum()
    for f in range(bins.shape[1]):
        lg, lh = (np.cumsum(np.bincount(bins[:, f], w))[:-1] for w in (g, h))
        if len(lg):
            gain = lg**2 / (lh + 1) + (all_g - lg) ** 2 / (all_h - lh + 1) - all_g**2 / (all_h + 1)
            at = int((gain > gain.max() - 1e-9).argmax())
            if gain[at] > best[0] + 1e-9:
                best = (gain[at], f, at + 1)
    _, f, cut = best
    if f is None:
        return leaf
    left = bins[:, f] < cut
    return (NAMES[f], cut, grow(bins[left], g[left], h[left], depth - 1), grow(bins[~left], g[~left], h[~left], depth - 1))


def leaves(tree, bins: np.ndarray) -> np.ndarray:
    """The tree's value for each row."""
    if not isinstance(tree, tuple):
        return np.full(len(bins), tree)
    left = bins[:, NAMES.index(tree[0])] < tree[1]
    out = np.empty(len(bins))
    out[left], out[~left] = leaves(tree[2], bins[left]), leaves(tree[3], bins[~left])
    return out


def boost(bins: np.ndarray, n: np.ndarray, blocked: np.ndarray, rounds: int, depth: int, rate: float) -> tuple[float, tuple]:
    """(base, trees) of cells with n URLs each, `blocked` of them blocked."""
    if not n.sum():
        return -1.0, ()
    base = math.log((blocked.sum() + 0.5) / (n.sum() - blocked.sum() + 0.5))
    score, trees = np.full(len(n), base), []
    scaled = lambda t: (t[0], t[1], scaled(t[2]), scaled(t[3])) if isinstance(t, tuple) else rate * t
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(scaled(grow(bins, n * p - blocked, n * p * (1 - p), depth)))
        score = score + leaves(trees[-1], bins)
    return base, tuple(trees)


def _case(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{float(tree)!r}D"
    name, cut, left, right = tree
    return f"CASE WHEN b_{name} < {cut} THEN {_case(left)} ELSE {_case(right)} END"


def fit(labelled: DataFrame, rounds: int = 10, depth: int = 3, rate: float = 0.5, suffixes: int = 256, sample: int = 200_000) -> Trees:
    """Trees from rows of (url, host, path, block int); null labels are left out.

    Suffix statistics are over all of them and kept for the `suffixes` most frequent ones (a bound of the model); all
    others are neutral. The trees are fitted on about `sample` labelled rows at most, by hash of the url: all, if there
    are no more. Without labels the base is even and nothing is blocked.
    """
    labelled = labelled.filter("block is not null")
    kinds = [F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in _suffixes(F.col("host"), F.col("path")).items()]
    rates = labelled.select("block", F.explode(F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("value")), *kinds)).alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.sum("block").alias("k"))
    top = [(r.s.kind, r.s.value, r.n, r.k) for r in rates.orderBy(F.desc("n"), "s").limit(suffixes + 1).collect()]
    total = next((n for kind, _, n, _ in top if not kind), 0)
    # rates in seven bins: the outer ones are for suffixes of one verdict
    bins = tuple((kind, v, 0 if not k else 6 if k == n else 1 + min(4, int(5 * k / n))) for kind, v, n, k in sorted(top) if kind)
    if total > sample:
        labelled = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    cells = binned(labelled, bins).groupBy(*[f"b_{k}" for k in NAMES]).agg(F.count("*").alias("n"), F.sum("block").alias("k")).collect() if total else []
    cells = np.array(sorted(tuple(r) for r in cells), np.int64).reshape(-1, len(NAMES) + 2)
    base, trees = boost(cells[:, :-2], cells[:, -2].astype(float), cells[:, -1].astype(float), rounds, depth, rate)
    return Trees(bins, trees, base)


def score(df: DataFrame, model: Trees) -> DataFrame:
    """df (url, host, path, ...) with score, the probability of block by the trees."""
    z = F.expr(" + ".join([f"{model.base!r}D", *map(_case, model.trees)]))
    return binned(df, model.suffixes).select(*[c for c in df.columns if c != "score"], (1 / (1 + F.exp(-z))).alias("score"))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, ruled, block) of every row; ruled is the rule's verdict, block that as a number."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "ruled": verdict}).withColumn("block", (F.col("ruled") == "block").cast("int"))


def held_out(pages: DataFrame, rules=RULES, folds: int = 5) -> DataFrame:
    """(rule, n, right): how the trees, fitted on the other hosts, judge the labelled URLs of one fold of hosts, by rule."""
    rows = ruled(pages, rules).filter("rule is not null")
    out = F.crc32(F.col("host").cast("binary")) % folds == 0
    right = ((F.col("score") >= 0.5).cast("int") == F.col("block")).cast("int")
    return score(rows.filter(out), fit(rows.filter(~out))).groupBy("rule").agg(F.count("*").alias("n"), F.sum(right).alias("right"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    URLs that a rule fits are the labelled ones the trees learn from. Null urls and those without :// have an empty
    host and path, no rule, and the trees' verdict. Ties between equally long rules go to the first listed; repeated
    rows each get their result; an empty table gives none. Other columns are ignored.
    """
    rows = ruled(pages, rules)
    return score(rows, fit(rows.filter("rule is not null"))).select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
