"""Rule stages that need no order within a document, as joins and folds (OP-47, OP-48, OP-62, OP-71 to OP-75, OP-84, OP-85).

The document kernel runs rules that absorb words; hints and triggers without
absorbing, reading filters, scores and choices without nesting are relational.
Candidates and their early and context filters (OP-81 to OP-83) are in the kernel
(``verba/plans/document.py``) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tag_tokens(tag: Column) -> Column:
    return F.filter(F.split(tag, "[,; ]"), lambda x: x != "")


def keeps(kind: Column, tag: Column, grammemes: dict[str, tuple[str, ...]]) -> Column:
    """Whether a profile keeps an exact reading: its kind lists no grammemes, or the tag has one of them."""
    out = F.lit(True)
    for k, want in grammemes.items():
        if want:
            out = F.when(kind == k, F.arrays_overlap(tag_tokens(tag), F.array(*map(F.lit, want)))).otherwise(out)
    return out


def all_service(tags: Column) -> Column:
    """Whether readings (an array of tags) make a stop word: all but the Abbr ones are service words, and there are some."""
    own = F.filter(tags, lambda t: ~F.array_contains(tag_tokens(t), "Abbr"))
    return (F.size(own) > 0) & F.forall(own, lambda t: F.get(F.split(t, "[,; ]"), F.lit(0)).isin("PREP", "CONJ", "PRCL", "INTJ"))


def active(docs: DataFrame, sets: dict[str, tuple[str, ...]], tags: str = "tags") -> DataFrame:
    """Documents with the ``name`` of each rule set all of whose tags they have (OP-71)."""
    one = [F.when(F.forall(F.array(*map(F.lit, when)).cast("array<string>"), lambda w: F.array_contains(F.col(tags), w)), F.lit(name)) for name, when in sets.items()]
    return docs.withColumn("name", F.explode(F.array_compact(F.array(*one))))


def hint_boosts(pos: DataFrame, keyword: Column, target: Column, window: int, direction: str = "right", by: str = "doc_id") -> DataFrame:
    """(doc, pos, hints): words for which ``target`` holds, by the keywords within ``window`` words and no break between.

    Each keyword is sent to the positions it reaches, so the band join is an
    equi-join; the running count of breaks tells whether one lies between.
    """
    w = Window.partitionBy(by).orderBy("pos")
    rows = pos.withColumn("sum", F.coalesce(F.sum(F.col("brk").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    steps = [*range(1, window + 1)] if direction == "right" else [*range(-window, 0)]
    sent = rows.where(keyword).select(by, F.col("sum").alias("ksum"), F.explode(F.array(*((F.col("pos") + s) for s in steps))).alias("pos"))
    hit = rows.where(target).select(by, "pos", "sum").join(sent, [by, "pos"]).where("sum = ksum")
    return hit.groupBy(by, "pos").agg(F.count("*").alias("hints"))


def trigger_ranges(pos: DataFrame, keyword: Column, accepts: Column, least: int, most: int, by: str = "doc_id") -> DataFrame:
    """(doc, start, end): up to ``most`` accepted words to the right of each keyword, without a break (OP-74)."""
    w = Window.partitionBy(by).orderBy("pos")
    # the first step that fails ends the reach: look-ahead of a fixed, small width
    ok = [F.coalesce(F.lead(accepts, i).over(w), F.lit(False)) & ~F.coalesce(F.lead("brk", i - 1).over(w) if i > 1 else F.col("brk"), F.lit(True)) for i in range(1, most + 1)]
    reach = F.lit(0)
    for i in range(most, 0, -1):
        reach = F.when(ok[i - 1], F.when(reach > i, reach).otherwise(i)).otherwise(i - 1)
    rows = pos.withColumn("hit", keyword).withColumn("reach", reach).where(F.col("hit") & (F.col("reach") >= least))
    return rows.select(by, (F.col("pos") + 1).alias("start"), (F.col("pos") + 1 + F.col("reach")).alias("end"))


def score(origin_weight: Column, words: Column, bonus: Column, readings: Column, length_bonus: float = 0.5, penalty: float = 0.25) -> Column:
    """A candidate's score, rounded to a millionth (OP-84)."""
    raw = origin_weight * words + length_bonus * (words - 1) + bonus - penalty * (F.greatest(readings, F.lit(1)) - 1)
    return F.round(raw * 1e6) / 1e6


def resolve_flat(candidates: DataFrame, by: str = "doc_id") -> DataFrame:
    """The best choice of candidates (doc, start, end, type, score) that do not overlap (OP-85 without nesting).

    One fold per document over its candidates by end: each step keeps the best
    value and the best value at each earlier end.
    """
    live = candidates.where("score > 0")
    one = F.struct("end", "start", (-F.col("score")).alias("neg"), "type")
    docs = live.groupBy(by).agg(F.array_sort(F.collect_list(one)).alias("c"))
    start = "array(named_struct('end', -1, 'value', 0D, 'pick', cast(array() as array<int>)))"
    before = "element_at(filter(acc, a -> a.end <= x.c.start), -1)"
    best = "element_at(acc, -1)"
    step = f"if(-x.c.neg + {before}.value > {best}.value, named_struct('end', x.c.end, 'value', -x.c.neg + {before}.value, 'pick', concat({before}.pick, array(x.i))), named_struct('end', x.c.end, 'value', {best}.value, 'pick', {best}.pick))"
    picked = docs.withColumn("pick", F.expr(f"element_at(aggregate(transform(c, (c, i) -> struct(c, i)), {start}, (acc, x) -> concat(acc, array({step}))), -1).pick"))
    out = picked.select(by, F.explode(F.expr("transform(pick, i -> c[i])")).alias("x"))
    return out.select(by, F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.type").alias("type"), (-F.col("x.neg")).alias("score"))
