"""Golden-set scoring (OP-A0 to OP-A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(type, tp, fp, fn) by multisets of (case, start, end, type)."""
    key = ["case_id", "start", "end", "type"]
    g = gold.groupBy(*key).agg(F.count("*").alias("g"))
    p = predicted.groupBy(*key).agg(F.count("*").alias("p"))
    both = g.join(p, key, "full").select("type", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    return both.groupBy("type").agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))


def partial_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(type, tp, fp, fn): each prediction, in order, takes the first unused gold span of its type that it overlaps.

    One fold per case and type over its own spans.
    """
    g = gold.groupBy("case_id", "type").agg(F.array_sort(F.collect_list(F.struct("ord", "start", "end"))).alias("g"))
    p = predicted.groupBy("case_id", "type").agg(F.array_sort(F.collect_list(F.struct("ord", "start", "end"))).alias("p"))
    none = "cast(array() as array<struct<ord:int,start:int,end:int>>)"
    both = g.join(p, ["case_id", "type"], "full").select("type", F.expr(f"coalesce(g, {none})").alias("g"), F.expr(f"coalesce(p, {none})").alias("p"))
    first = "filter(sequence(0, size(g) - 1), i -> not array_contains(used, i) and g[i].start < x.end and x.start < g[i].end)"
    hits = f"aggregate(p, cast(array() as array<int>), (used, x) -> if(size(g) = 0, used, if(size({first}) > 0, concat(used, array({first}[0])), used)))"
    n = both.withColumn("tp", F.size(F.expr(hits)))
    return n.groupBy("type").agg(F.sum("tp").alias("tp"), F.sum(F.size("p") - F.col("tp")).alias("fp"), F.sum(F.size("g") - F.col("tp")).alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(a + b == 0, 1.0).otherwise(a / (a + b))


def rates(counts: DataFrame) -> DataFrame:
    """Counts with precision, recall and F1."""
    p, r = _ratio(F.col("tp"), F.col("fp")), _ratio(F.col("tp"), F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def check(scores: DataFrame, least_precision: float, least_recall: float) -> DataFrame:
    """Messages for types below the wanted rates."""
    bad = scores.where((F.col("precision") < least_precision) | (F.col("recall") < least_recall))
    return bad.select("type", F.format_string("%s: precision %.3f, recall %.3f", "type", "precision", "recall").alias("message"))
