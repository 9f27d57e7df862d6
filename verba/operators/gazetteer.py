"""Gazetteer: compiled keys, matches as joins, variant groups, versions (OP-60 to OP-6E)."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verba.functions.textnorm import PREREFORM, Rules
from verba.operators.analyzer import analyze
from verba.operators.lookup import Profile

MOST_KEYS = 8
_OPTIONS = "if(size(filter(lemmas, l -> (l.flags & 4) = 0)) > 0, array_distinct(transform(filter(lemmas, l -> (l.flags & 4) = 0), l -> l.text)), array(term))"
#: The product of option arrays, the last one fastest, cut inside the fold so that it stays small.
_COMBINE = f"aggregate(options, array(cast(array() as array<string>)), (acc, a) -> slice(flatten(transform(acc, p -> transform(a, x -> concat(p, array(x))))), 1, {MOST_KEYS}))"


def content(terms: DataFrame) -> DataFrame:
    """Content words with ``options``, the words that lemma keys may have there (OP-61)."""
    return terms.where("kind in ('word', 'number')").withColumn("options", F.expr(_OPTIONS))


def compile_entries(entries: DataFrame, dict_forms: DataFrame, type_profiles: Mapping[str, Profile], default: Profile, rules: Rules = PREREFORM) -> DataFrame:
    """Entries with ``alias_id``, word cases, surface and lemma keys; entries without words have ``n_words`` 0 (OP-60 to OP-63)."""
    rows = entries.withColumn("alias_id", F.expr("concat(source, '#', entry_ord)"))
    profiles = {p.name: p for p in [default, *type_profiles.values()]}
    of_type = F.coalesce(*(F.when(F.col("type") == t, F.lit(p.name)) for t, p in type_profiles.items()), F.lit(default.name))
    rows = rows.withColumn("profile", of_type)
    parts = None
    for name, p in profiles.items():
        got = analyze(rows.where(F.col("profile") == name).select("alias_id", F.col("alias").alias("text")), dict_forms, p, rules).select("alias_id", "idx", "kind", "case", "term", "lemmas")
        parts = got if parts is None else parts.unionByName(got)
    words = content(parts).groupBy("alias_id").agg(F.array_sort(F.collect_list(F.struct("idx", "term", "case", "options"))).alias("w"))
    keyed = words.select("alias_id", F.expr("transform(w, x -> x.term)").alias("surface_key"), F.expr("transform(w, x -> x.case)").alias("cases"), F.expr("transform(w, x -> x.options)").alias("options"))
    out = rows.join(keyed, "alias_id", "left").withColumn("n_words", F.coalesce(F.size("surface_key"), F.lit(0)))
    surface_only = F.expr("(flags & 2) <> 0")
    none = F.expr("cast(array() as array<array<string>>)")
    out = out.withColumn("lemma_keys", F.when(surface_only | (F.col("n_words") == 0), none).otherwise(F.array_distinct(F.expr(_COMBINE))))
    ways = F.expr("aggregate(options, 1L, (a, x) -> least(a * size(x), 1000000L))")
    out = out.withColumn("capped", (F.col("n_words") > 0) & ~surface_only & (ways > MOST_KEYS))
    return out.withColumn("canonical", F.when(F.coalesce("canonical", F.lit("")) == "", F.col("alias")).otherwise(F.col("canonical"))).drop("profile", "options")


def keys(compiled: DataFrame) -> DataFrame:
    """(alias_id, key_kind, key, n_words)."""
    lemma = compiled.select("alias_id", F.lit("lemma").alias("key_kind"), F.explode("lemma_keys").alias("key"))
    surface = compiled.where("n_words > 0").select("alias_id", F.lit("surface").alias("key_kind"), F.col("surface_key").alias("key"))
    return lemma.unionByName(surface).select("alias_id", "key_kind", F.array_join("key", " ").alias("key"), F.size("key").alias("n_words"))


def report(compiled: DataFrame) -> DataFrame:
    """What compiling each source gave (OP-65)."""
    return compiled.groupBy("source").agg(
        F.count("*").alias("entries"), F.count_if(F.col("n_words") > 0).alias("aliases"), F.sum(F.when(F.col("n_words") > 0, F.size("lemma_keys")).otherwise(0)).alias("lemma_keys"),
        F.count_if(F.col("n_words") > 0).alias("surface_keys"), F.count_if("capped").alias("capped"), F.count_if(F.expr("(flags & 8) <> 0 and n_words > 0")).alias("blocked"), F.count_if(F.col("n_words") == 0).alias("skipped"),
    )


def positions(terms: DataFrame, by: str = "doc_id") -> DataFrame:
    """Content words of each text in order: ``pos``, ``options``, ``brk`` (no match goes past it) and ``sent`` (OP-66)."""
    w = Window.partitionBy(by).orderBy("idx")
    like = F.expr("dotted and (char_length(raw) = 1 or exists(lemmas, l -> (l.flags & 8) <> 0))")
    rows = terms.withColumn("like", F.coalesce(like, F.lit(False)))
    plain = F.col("sentence_end") & ~F.col("like") & ~((F.col("raw") == ".") & F.coalesce(F.lag("like").over(w), F.lit(False)))
    rows = rows.withColumns({"ends": plain, "dots": F.sum((F.col("raw") == ".").cast("int")).over(w)})
    rows = rows.withColumn("sent", F.coalesce(F.sum(F.col("ends").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    words = content(rows)
    gap = F.lead("idx").over(w) - F.col("idx") - 1
    dots = F.lead("dots").over(w) - F.col("dots")
    joined = F.when(F.col("like"), gap == dots).otherwise((gap == 0) & ~F.col("sentence_end"))
    return words.withColumns({"pos": F.row_number().over(w) - 1, "brk": ~F.coalesce(joined, F.lit(False))})


def runs(pos: DataFrame, longest: int, by: str = "doc_id") -> DataFrame:
    """(doc, pos, n, key): each word's runs of up to ``longest`` words, by look-ahead in its own text."""
    w = Window.partitionBy(by).orderBy("pos")
    run, open_ = F.col("term"), F.lit(True)
    own = [F.struct(F.lit(1).alias("n"), run.alias("key"))]
    for n in range(1, longest):
        open_ = open_ & ~F.coalesce(F.lag("brk", -(n - 1)).over(w) if n > 1 else F.col("brk"), F.lit(True))
        run = F.concat_ws(" ", run, F.lead("term", n).over(w))
        own.append(F.when(open_, F.struct(F.lit(n + 1).alias("n"), run.alias("key"))))
    return pos.select(by, "pos", F.array_compact(F.array(*own)).alias("runs")).select(by, "pos", F.inline("runs"))


def surface_matches(pos: DataFrame, alias_keys: DataFrame, longest: int, by: str = "doc_id") -> DataFrame:
    """(doc, start, end, alias_id): runs of forms that are a surface key, by one equi-join (OP-68)."""
    own = alias_keys.where("key_kind = 'surface'").select("key", "alias_id")
    return runs(pos, longest, by).join(own, "key").select(by, F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("end"), "alias_id")


def lemma_matches(pos: DataFrame, alias_keys: DataFrame, by: str = "doc_id") -> DataFrame:
    """(doc, start, end, alias_id): paths through lemma options that are a lemma key (OP-67).

    The trie is a table of key starts, walked a level at a time by equi-joins, so
    that ambiguous words never multiply out.
    """
    lemma = alias_keys.where("key_kind = 'lemma'")
    longest = lemma.agg(F.max("n_words")).first()[0] or 0
    nodes = lemma.select(F.explode(F.expr("transform(sequence(1, n_words), i -> struct(i as depth, array_join(slice(split(key, ' '), 1, i), ' ') as path))")).alias("p")).select("p.*").distinct()
    options = pos.select(by, "pos", "brk", F.explode("options").alias("word"))
    front, out = None, None
    for depth in range(1, longest + 1):
        at = nodes.where(F.col("depth") == depth).select("path")
        if depth == 1:
            step = options.select(by, F.col("pos").alias("start"), "pos", "brk", F.col("word").alias("path"))
        else:
            ahead = options.select(by, F.col("pos").alias("next"), F.col("brk").alias("nbrk"), "word")
            step = front.where(~F.col("brk")).withColumn("next", F.col("pos") + 1).join(ahead, [by, "next"])
            step = step.select(by, "start", F.col("next").alias("pos"), F.col("nbrk").alias("brk"), F.concat_ws(" ", "path", "word").alias("path"))
        front = step.join(at, "path")
        got = front.join(lemma.where(F.col("n_words") == depth).select(F.col("key").alias("path"), "alias_id"), "path").select(by, "start", (F.col("pos") + 1).alias("end"), "alias_id")
        out = got if out is None else out.unionByName(got)
    return out.distinct()


def canonical_forms(compiled: DataFrame) -> DataFrame:
    """(key, forms): sorted canonical forms by lemma or surface key (OP-6A)."""
    k = keys(compiled).join(compiled.select("alias_id", "canonical"), "alias_id")
    return k.groupBy("key").agg(F.sort_array(F.collect_set("canonical")).alias("forms"))


def variants(compiled: DataFrame) -> DataFrame:
    """(lemma, expanded): lemma keys of all groups (same source and reference) that hold a key (OP-6B)."""
    rows = compiled.where("coalesce(ref, '') <> ''").select("source", "ref", F.explode("lemma_keys").alias("k")).select("source", "ref", F.array_join("k", " ").alias("key")).distinct()
    groups = rows.groupBy("source", "ref").agg(F.collect_set("key").alias("all"))
    return rows.join(groups, ["source", "ref"]).groupBy(F.col("key").alias("lemma")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("all")))).alias("expanded"))


def snapshot_version(config: str, sources: list[tuple[str, str]], analyzer: str) -> str:
    """Hash of what a compiled gazetteer depends on (OP-6D)."""
    return hashlib.sha256("".join([config, *(f"{n}\0{v}\0{analyzer}\n" for n, v in sources)]).encode()).hexdigest()


class Gazetteer:
    """Sources with versions; refreshing recompiles only what changed (OP-6C)."""

    def __init__(self, compile_source, config: str = ""):
        self.compile_source, self.config = compile_source, config
        self.built: dict[str, tuple[str, str, DataFrame]] = {}

    def refresh(self, sources: Mapping[str, tuple[str, DataFrame]], analyzer: str) -> list[tuple[str, str]]:
        """(source, error) of each source that was rebuilt; a failing one keeps its data."""
        done, fresh = [], dict(self.built)
        for name, (version, entries) in sources.items():
            if name in fresh and fresh[name][:2] == (version, analyzer):
                continue
            try:
                fresh[name] = (version, analyzer, self.compile_source(entries))
                done.append((name, ""))
            except Exception as e:
                done.append((name, str(e)))
        self.built = {n: v for n, v in fresh.items() if n in sources}
        return done

    def frame(self) -> DataFrame | None:
        out = None
        for _, _, df in self.built.values():
            out = df if out is None else out.unionByName(df)
        return out

    def version(self) -> str:
        return hashlib.sha256("".join([self.config, *(f"{n}\0{v}\0{a}\n" for n, (v, a, _) in self.built.items())]).encode()).hexdigest()
