"""Text analysis as joins: tokens, distinct keys, one dictionary join, terms (OP-50 to OP-5A).

Each distinct word form is looked up once per run, whatever number of documents
hold it; the dictionary joins with these forms, not with the text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verba.functions.textnorm import PREREFORM, RULES, TOKEN_FIELDS, Rules, explode_tokens, reform_variants_sql, with_tokens
from verba.operators.lookup import AMBIGUOUS, LEMMA_TYPE, Profile, lookup_abbrev, lookup_word
from verba.runtime import prepare
from verba.scratch import Scratch, small

FULL, INDEX = "full", "index"
#: Distinct forms, with their lemmas, up to which the table of forms is broadcast (some 200 bytes each).
BROADCAST_FORMS = 200_000
_LEMMAS = pa.list_(pa.struct([("text", pa.string()), ("flags", pa.int32()), ("tag", pa.string()), ("kind", pa.string()), ("dict", pa.string())]))


def readings_by_key(dict_forms: DataFrame) -> DataFrame:
    """(key, readings) with readings in dictionary and reading order."""
    one = F.struct("dict_ord", "form_ord", F.coalesce("lemma", F.lit("")).alias("normal"), F.coalesce("tag", F.lit("")).alias("tag"), "kind", "dict", F.coalesce("predicted", F.lit(False)).alias("predicted"))
    got = dict_forms.groupBy(F.col("form_key").alias("key")).agg(F.array_sort(F.collect_list(one)).alias("r"))
    return got.select("key", F.transform("r", lambda x: F.struct(*(x[n].alias(n) for n in ("normal", "tag", "kind", "dict", "predicted")))).alias("readings"))


def _lookup(profile: Profile, rules_name: str):
    def run(batches):
        rules = RULES[rules_name]
        for b in batches:
            keys, words, stops, short = [], [], [], []
            for key, cands in zip(b.column("key").to_pylist(), b.column("cands").to_pylist(), strict=True):
                cands = sorted(cands, key=lambda c: c["prio"])
                pairs = [(c["cand"], c["readings"] or []) for c in cands]
                w, stop = lookup_word(key, pairs, profile, rules)
                keys.append(key)
                words.append(w)
                stops.append(stop)
                short.append(lookup_abbrev(key, pairs[0][1], rules))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, _LEMMAS), pa.array(stops, pa.bool_()), pa.array(short, _LEMMAS)], ["key", "lemmas", "stop", "abbrev"])

    return run


def lookups(keys: DataFrame, dict_forms: DataFrame, profile: Profile, rules: Rules = PREREFORM) -> DataFrame:
    """(key, lemmas, stop, abbrev) of each distinct key."""
    prepare(keys.sparkSession)
    cands = keys.select("key").distinct().select("key", F.posexplode(F.expr(f"concat(array(key), {reform_variants_sql('key')})")).alias("prio", "cand"))
    held = cands.join(readings_by_key(dict_forms).withColumnRenamed("key", "cand"), "cand", "left")
    grouped = held.groupBy("key").agg(F.collect_list(F.struct("prio", "cand", "readings")).alias("cands"))  # at most three variants a key
    return grouped.mapInArrow(_lookup(profile, rules.name), f"key string, lemmas array<{LEMMA_TYPE}>, stop boolean, abbrev array<{LEMMA_TYPE}>")


def _unknown(form: Column) -> Column:
    none = F.lit("")
    return F.array(F.struct(form.alias("text"), F.lit(4).alias("flags"), none.alias("tag"), none.alias("kind"), none.alias("dict")))



def _keys(tokens: DataFrame) -> DataFrame:
    word = (F.col("kind") == "word") & (F.col("script") == "cyrillic") & (F.col("form") != "")
    own = F.concat(F.array("form"), F.when(F.col("dotted"), F.array(F.concat("form", F.lit(".")))).otherwise(F.expr("cast(array() as array<string>)")), F.split("form", "-"))
    return tokens.where(word).select(F.explode(F.array_distinct(own)).alias("key")).where("key <> ''")


def terms(tokens: DataFrame, dict_forms: DataFrame, profile: Profile, rules: Rules = PREREFORM, mode: str = FULL, keys: DataFrame | None = None) -> DataFrame:
    """Terms of exploded tokens: their columns, ``part`` (0 the whole, then hyphen parts), ``term`` and ``lemmas``.

    ``keys`` are the distinct keys of the tokens, if a cheaper plan than the tokens
    themselves has them.  What a form and the same form with a dot are read as is
    brought together by distinct form, so tokens meet the dictionary in one join.
    """
    scratch = Scratch(tokens.sparkSession, "lookups")
    table = scratch.keep(lookups(_keys(tokens) if keys is None else keys, dict_forms, profile, rules), "table")
    dotted = table.where("endswith(key, '.')").select(F.expr("left(key, char_length(key) - 1)").alias("form"), F.col("abbrev").alias("dot_abbrev")).where("size(dot_abbrev) > 0")
    own = table.select(F.col("key").alias("form"), "lemmas", "stop", F.col("abbrev").alias("own_abbrev")).join(dotted, "form", "left")
    if mode == INDEX:  # what the parts of a hyphenated form are read as, once for each distinct form
        parts = own.where("form like '%-%'").select("form", F.posexplode(F.split("form", "-")).alias("i", "term")).where("term <> ''")
        parts = parts.join(table.select(F.col("key").alias("term"), "lemmas", "stop"), "term")
        parts = parts.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("i", "term", "lemmas", "stop"))).alias("subs"))
        own = own.join(parts, "form", "left")
    # only words of the dictionary's script can have a row there
    rows = tokens.withColumn("_form", F.when((F.col("kind") == "word") & (F.col("script") == "cyrillic") & (F.col("form") != ""), F.col("form")))
    own, _ = small(scratch.keep(own.withColumnRenamed("form", "_form"), "forms"), BROADCAST_FORMS)
    rows = rows.join(own, "_form", "left").drop("_form")
    rows = rows.withColumn("dot_abbrev", F.when(F.col("dotted"), F.col("dot_abbrev")))
    short = F.coalesce(F.size("dot_abbrev"), F.lit(0)) > 0
    hyphened = (F.col("kind") == "word") & F.col("form").contains("-")
    whole = hyphened & (F.coalesce(F.size("own_abbrev"), F.lit(0)) > 0)
    none = F.expr(f"cast(array() as array<{LEMMA_TYPE}>)")
    lem = (
        F.when(F.col("kind") == "number", _unknown(F.col("form"))).when((F.col("kind") != "word") | (F.col("form") == ""), none)
        .when(F.col("script") != "cyrillic", _unknown(F.col("form"))).when(short, F.col("dot_abbrev")).when(whole, F.col("own_abbrev")).otherwise(F.col("lemmas"))
    )
    rows = rows.withColumn("term", F.when(short, F.concat("form", F.lit("."))).otherwise(F.col("form"))).withColumn("_lem", lem)
    if mode == FULL:
        return rows.withColumn("lemmas", F.col("_lem")).withColumn("part", F.lit(0)).drop("dot_abbrev", "own_abbrev", "_lem")
    rows = rows.where("kind = 'number' or (kind = 'word' and script = 'cyrillic' and form <> '')")
    said = F.when((F.col("kind") == "number") | short | whole, F.lit(False)).otherwise(F.coalesce("stop", F.lit(False)))
    one = F.array(F.struct(F.lit(-1).alias("_i"), "term", F.col("_lem").alias("lemmas"), said.alias("stop")))
    some = F.transform(F.coalesce("subs", F.expr("array()")), lambda x: F.struct(x["i"].alias("_i"), x["term"].alias("term"), x["lemmas"].alias("lemmas"), F.coalesce(x["stop"], F.lit(False)).alias("stop")))
    rest = [c for c in tokens.columns]
    rows = rows.withColumn("_made", F.filter(F.when(hyphened & ~short & ~whole, F.concat(one, some)).otherwise(one), lambda x: ~x["stop"]))
    rows = rows.select(*rest, F.inline("_made"))
    # a part's own text and place; the whole has the number -1
    raws, at = F.split("raw", "[-‐]"), F.expr("if(_i <= 0, 0, char_length(array_join(slice(split(raw, '[-‐]'), 1, _i), '-')) + 1)")
    rows = rows.withColumns({"_raws": raws, "_at": at})
    rows = rows.withColumns({"_raw": F.expr("_raws[_i]"), "_byte": F.expr("octet_length(substring(raw, 1, _at))"), "_last": (F.col("_i") < 0) | (F.col("_i") == F.size("_raws") - 1)})
    piece = F.col("_i") >= 0
    new = {
        "part": (F.col("_i") + 1).cast("int"), "dotted": F.col("dotted") & F.col("_last"), "sentence_end": F.col("sentence_end") & F.col("_last"),
        "rune_start": F.col("rune_start") + F.col("_at"), "rune_end": F.when(piece, F.col("rune_start") + F.col("_at") + F.char_length("_raw")).otherwise(F.col("rune_end")),
        "start": F.col("start") + F.col("_byte"), "end": F.when(piece, F.col("start") + F.col("_byte") + F.octet_length("_raw")).otherwise(F.col("end")),
        "raw": F.when(piece, F.col("_raw")).otherwise(F.col("raw")), "form": F.when(piece, F.col("term")).otherwise(F.col("form")),
    }
    return rows.withColumns({c: x for c, x in new.items() if c in ("part", *rest)}).drop("_i", "_raws", "_at", "_raw", "_byte", "_last")


def analyze(docs: DataFrame, dict_forms: DataFrame, profile: Profile, rules: Rules = PREREFORM, mode: str = FULL, keep: list[str] | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Terms of each text (OP-50); ``fields`` may name fewer token columns if the plan reads no others."""
    keys = _keys(explode_tokens(with_tokens(docs, rules, [], fields=("form", "kind", "script", "dotted"))))
    fields = TOKEN_FIELDS if fields is None else tuple(fields)
    return terms(explode_tokens(with_tokens(docs, rules, keep, fields=fields)), dict_forms, profile, rules, mode, keys)


def parse_queries(queries: DataFrame, dict_forms: DataFrame, profile: Profile, rules: Rules = PREREFORM) -> DataFrame:
    """(query columns, idx, part, term, lemmas, partial): index terms, and the unfinished last word as a partial term (OP-58)."""
    keep = [c for c in queries.columns if c != "text"]
    text = queries.select("*", F.octet_length("text").alias("_len"))
    tokens = explode_tokens(with_tokens(text, rules, [*keep, "_len"]))
    able = tokens.where("kind = 'number' or (kind = 'word' and script = 'cyrillic' and form <> '')")
    last = able.groupBy(*keep).agg(F.max("idx").alias("_last"))
    able = able.join(last, keep).withColumn("partial", (F.col("idx") == F.col("_last")) & (F.col("end") == F.col("_len")) & (F.col("kind") != "number")).drop("_last", "_len")
    done = terms(able.where("not partial"), dict_forms, profile, rules, INDEX)
    open_ = able.where("partial")
    table = lookups(_keys(open_), dict_forms, profile, rules)
    open_ = open_.join(table.select(F.col("key").alias("form"), "lemmas", "stop"), "form").withColumns({"term": F.col("form"), "part": F.lit(0)})
    open_ = open_.withColumn("lemmas", F.when(F.col("stop"), F.expr(f"cast(array() as array<{LEMMA_TYPE}>)")).otherwise(F.col("lemmas")))
    cols = [*keep, "idx", "part", "term", "lemmas", "partial"]
    return done.select(*cols).unionByName(open_.select(*cols))


def shown(lemmas: str = "lemmas") -> Column:
    """``lemma[flags],...`` of a term (OP-14)."""
    names = "array('ambiguous','predicted','unknown','abbrev','stop','reform')"
    return F.expr(f"array_join(transform({lemmas}, l -> concat(l.text, '[', array_join(filter(transform({names}, (n, i) -> if((l.flags & shiftleft(1, i)) <> 0, n, '')), x -> x <> ''), ','), ']')), ',')")


def version(rules: Rules, dictionaries: str) -> str:
    """The analyser's version, from all that changes its results (OP-59)."""
    return f"analyzer-2/{rules.label}/{dictionaries}"


__all__ = ["AMBIGUOUS", "FULL", "INDEX", "analyze", "lookups", "parse_queries", "readings_by_key", "shown", "terms", "version"]
