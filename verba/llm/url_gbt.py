"""URL filters: host and path rules, and boosted trees on lexical features.

Everything on the main path is DataFrame or SQL expressions.  Training is
histogram boosting with logistic loss: features are cut into bins, each level of
a tree is one grouped sum of gradients per (node, feature, bin) on the executors,
and only these sums, whose number is fixed by the parameters, reach the driver.  A
finished tree is one CASE expression; scoring a URL adds the trees up inside
generated code, in one narrow pass.

Training labels are the URLs that a rule decides; from them a sample bounded by
``max_train`` (the smallest hashes of the whole url) is used.  Suffix statistics
are smoothed shares of blocked URLs by the host's last label in that sample.

Defined results: a null url, or one without ``://``, has an empty host and path,
no rule, and the model's verdict on empty strings.  With labels of one kind only
that kind is the model's verdict, and with none it is ``allow``.  Repeated rows
stay; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verba.llm.common import Scratch

#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BINS = 16


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    bare = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.substr(bare, F.length(host) + 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tried first
        own, _, start = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + start))
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features, all finite numbers."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    one = F.greatest(n, F.lit(1)).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    chars = F.split(u, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / one)
    ent = F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    drop = lambda col, what: F.length(F.regexp_replace(col, what, ""))
    labels = F.split(host, r"\.")
    return {
        "length": n.cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "labels": F.when(host == "", 0).otherwise(F.size(labels)).cast("double"), "depth": (F.length(path) - drop(path, "/")).cast("double"),
        "digit_ratio": (n - drop(u, "[0-9]")) / one, "host_digits": (F.length(host) - drop(host, "[0-9]")).cast("double"),
        "hyphens": (n - drop(u, "-")).cast("double"), "entropy": ent,
        "params": F.when(query == "", 0).otherwise(F.length(query) - drop(query, "&") + 1).cast("double"), "query_length": F.length(query).cast("double"),
        "secure": F.startswith(u, F.lit("https:")).cast("double"), "ends_slash": F.endswith(path, F.lit("/")).cast("double"), "dots_in_path": (F.length(path) - drop(path, r"\.")).cast("double"),
    }


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


@dataclass(frozen=True)
class Model:
    """Trees as SQL text over feature columns, and the share by suffix."""

    base: float
    trees: tuple[str, ...]
    shares: tuple[tuple[str, float], ...]
    prior: float

    def margin(self) -> Column:
        return F.expr(" + ".join([repr(self.base), *self.trees]))

    def share(self, host: Column) -> Column:
        out = F.lit(self.prior)
        for name, p in self.shares:
            out = F.when(suffix(host) == name, F.lit(p)).otherwise(out)
        return out


def _tree(df: DataFrame, margin: Column, cuts: dict[str, list[float]], depth: int, rate: float, penalty: float) -> str:
    """One regression tree on the logistic gradient, level by level."""
    p = 1 / (1 + F.exp(-margin))
    names = list(cuts)
    rows = df.withColumn("g", F.col("y") - p).withColumn("h", p * (1 - p))
    splits: dict[int, tuple[str, float] | None] = {}
    sums: dict[int, tuple[float, float]] = {}
    for level in range(depth):
        node = F.lit(1)
        for _ in range(level):
            below = F.lit(0)
            for k, s in splits.items():
                if s:
                    below = F.when(node == k, F.when(F.col(s[0]) < s[1], 2 * k).otherwise(2 * k + 1)).otherwise(below)
            node = below
        bins = F.array(*(F.struct(F.lit(i).alias("f"), sum(((F.col(c) >= x).cast("int") for x in cuts[c]), F.lit(0)).alias("b")) for i, c in enumerate(names)))
        got = rows.withColumn("node", node).where("node > 0").select("node", "g", "h", F.explode(bins).alias("x"))
        hist = got.groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).orderBy("node", "f", "b").collect()  # nodes x features x bins at most
        by: dict[int, dict[int, list]] = {}
        for r in hist:
            by.setdefault(r["node"], {}).setdefault(r["f"], []).append((r["b"], r["g"], r["h"]))
        for k, fs in by.items():
            best, gain = None, 1e-6
            tg, th = (sum(x[i] for x in fs[0]) for i in (1, 2))
            sums[k] = (tg, th)
            for f, cells in sorted(fs.items()):
                lg = lh = 0.0
                for b, g, h in cells[:-1]:
                    lg, lh = lg + g, lh + h
                    rg, rh = tg - lg, th - lh
                    v = lg * lg / (lh + penalty) + rg * rg / (rh + penalty) - tg * tg / (th + penalty)
                    if v > gain:
                        best, gain = (names[f], cuts[names[f]][b], lg, lh, rg, rh), v
            splits[k] = best[:2] if best else None
            if best:
                sums[2 * k], sums[2 * k + 1] = best[2:4], best[4:6]

    def text(k: int) -> str:
        s = splits.get(k)
        if s:
            return f"CASE WHEN {s[0]} < {s[1]!r}D THEN {text(2 * k)} ELSE {text(2 * k + 1)} END"
        g, h = sums.get(k, (0.0, 0.0))
        return f"{rate * g / (h + penalty)!r}D"

    return f"({text(1)})"


def train(urls: DataFrame, rules=RULES, max_train: int = 20_000, rounds: int = 8, depth: int = 3, rate: float = 0.4, penalty: float = 1.0) -> Model:
    """Boosted trees from the URLs that rules decide; ``urls`` has url, host and path."""
    scratch = Scratch(urls.sparkSession, "urls")
    labelled = urls.where(rule_of(F.col("host"), F.col("path"), rules)[1].isNotNull())
    some = labelled.orderBy(F.xxhash64("url"), "url").limit(max_train)
    y = (rule_of(F.col("host"), F.col("path"), rules)[1] == "block").cast("double")
    some = scratch.keep(some.select("url", "host", "path", y.alias("y")), "sample")
    n, blocked = some.agg(F.count("*"), F.sum("y")).first()
    if not n or blocked in (0, n):
        return Model(8.0 if n and blocked == n else -8.0, (), (), 0.5)
    prior = blocked / n
    by = some.groupBy(suffix(F.col("host")).alias("s")).agg(F.count("*").alias("n"), F.sum("y").alias("b")).orderBy(F.desc("n"), "s").limit(64).collect()
    shares = tuple((r["s"], (r["b"] + 20 * prior) / (r["n"] + 20)) for r in by)
    base = Model(math.log(prior / (1 - prior)), (), shares, prior)
    f = features(F.col("url"), F.col("host"), F.col("path")) | {"suffix_share": base.share(F.col("host"))}
    rows = scratch.keep(some.select("y", *(c.alias(name) for name, c in f.items())), "features")
    at = [i / BINS for i in range(1, BINS)]
    cuts = rows.agg(*(F.percentile(name, F.array(*map(F.lit, at))).alias(name) for name in f)).first()
    cuts = {name: sorted(set(cuts[name])) for name in f}
    cuts = {name: c for name, c in cuts.items() if c}
    model = base
    for _ in range(rounds):
        model = Model(model.base, (*model.trees, _tree(rows, model.margin(), cuts, depth, rate, penalty)), shares, prior)
    scratch.drop("sample", "features")
    return model


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", **training) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the model's probability to block."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("key"), url.alias("url"))
    rows = rows.withColumns(dict(zip(("host", "path"), split_url(F.col("url")), strict=True)))
    model = train(rows.select("url", "host", "path"), rules, **training)
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    f = features(F.col("url"), F.col("host"), F.col("path")) | {"suffix_share": model.share(F.col("host"))}
    scored = rows.withColumns(f).withColumn("score", 1 / (1 + F.exp(-model.margin())))
    verdict = F.coalesce(says, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("key").alias(id_col), "host", "path", name.alias("rule"), verdict.alias("verdict"), "score")
