"""Entity extraction over documents (OP-80 to OP-8K).

Terms come from the analyser's joins.  Aliases reach a document by an equi-join
of its words with the first words of keys, so no dictionary is broadcast by hand;
the kernel then sees one document's terms and the few aliases that can match.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verba.functions.textnorm import PREREFORM, Rules, Words, token_rows, with_tokens
from verba.operators.analyzer import lookups
from verba.operators.lookup import UNKNOWN, Profile
from verba.plans.document import Alias, Index, Term, Weights, extract
from verba.plans.rules import Book
from verba.runtime import prepare
from verba.scratch import Scratch, small

EXTRACTOR = "spans-1"
SPAN_TYPE = "struct<start:int,end:int,rune_start:int,rune_end:int,surface:string,type:string,normal:array<string>,refs:array<string>,attrs:map<string,string>,flags:int,score:float,evidence:array<string>,alternatives:array<struct<type:string,normal:array<string>,refs:array<string>,score:double>>>"
FACT_TYPE = "struct<kind:string,args:map<string,int>,rule:string>"
_TEXTS = pa.list_(pa.string())
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rune_start", pa.int32()), ("rune_end", pa.int32()), ("surface", pa.string()), ("type", pa.string()), ("normal", _TEXTS), ("refs", _TEXTS), ("attrs", pa.map_(pa.string(), pa.string())), ("flags", pa.int32()), ("score", pa.float32()), ("evidence", _TEXTS), ("alternatives", pa.list_(pa.struct([("type", pa.string()), ("normal", _TEXTS), ("refs", _TEXTS), ("score", pa.float64())])))])
_FACT = pa.struct([("kind", pa.string()), ("args", pa.map_(pa.string(), pa.int32())), ("rule", pa.string())])


@dataclass(frozen=True)
class Pipeline:
    """What an extraction is configured with (OP-8K)."""

    profiles: Mapping[str, Profile]
    default_profile: str
    book: Book = Book()
    weights: Weights = Weights()
    nesting: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    min_lemma_runes: int = 3
    explain: bool = False
    rules: Rules = PREREFORM

    def __post_init__(self):
        if self.default_profile not in self.profiles:
            raise ValueError(f"unknown profile {self.default_profile!r}")
        w = self.weights
        if not (w.surface or w.lemma or w.trigger):
            object.__setattr__(self, "weights", Weights(types=w.types, length_bonus=w.length_bonus, ambiguity_penalty=w.ambiguity_penalty))

    def version(self, analyzer: str, gazetteer: str) -> str:
        """Hash of all that changes results (OP-8J)."""
        w = self.weights
        config = {"profiles": {n: [list(p.kinds), {k: list(v) for k, v in p.grammemes.items()}] for n, p in self.profiles.items()}, "weights": [w.surface, w.lemma, w.trigger, w.length_bonus, w.ambiguity_penalty, w.types], "nesting": {k: list(v) for k, v in self.nesting.items()}, "runes": self.min_lemma_runes}
        return hashlib.sha256("\n".join([EXTRACTOR, analyzer, gazetteer, self.book.version, json.dumps(config, sort_keys=True)]).encode()).hexdigest()


_NONE: list = []


def read_terms(tokens: list[tuple], known: dict[str, dict]) -> list[Term]:
    """Terms of a document in full mode from its tokens and what the dictionaries say about its keys (OP-56)."""
    memo: dict[str, list] = {}

    def lemmas(key: str, what: str) -> list:
        got = memo.get(what + key)
        if got is None:
            row = known.get(key)
            got = memo[what + key] = [(x["text"], x["flags"], x["tag"] or "") for x in (row[what] or _NONE if row else _NONE)]
        return got

    out = []
    for raw, form, start, end, rune, rune_end, kind, script, case, dotted, ends in tokens:
        if kind == "word" and form:
            if script != "cyrillic":
                own = [(form, UNKNOWN, "")]
            elif dotted and (own := lemmas(form + ".", "abbrev")):
                form += "."
            elif "-" in form and (own := lemmas(form, "abbrev")):
                pass
            else:
                own = lemmas(form, "lemmas")
        else:
            own = [(form, UNKNOWN, "")] if kind == "number" else _NONE
        out.append(Term(raw, form, start, end, rune, rune_end, kind, script, case, dotted, ends, own))
    return out


def _kernel(p: Pipeline):
    book, weights, nesting, least, explain = p.book, p.weights, {k: set(v) for k, v in p.nesting.items()}, p.min_lemma_runes, p.explain

    def run(batches):
        words = Words(p.rules)
        for b in batches:
            spans, facts = [], []
            for text, known, aliases, tags, types in zip(*(b.column(c).to_pylist() for c in ("text", "known", "aliases", "tags", "types")), strict=True):
                if not aliases and not book.sets:
                    spans.append([])
                    facts.append([])
                    continue
                ts = read_terms(token_rows(p.rules, text or "", words), {k["key"]: k for k in known or ()})
                sources: dict[str, list[Alias]] = {}
                for i, a in enumerate(sorted(aliases or [], key=lambda a: (a["source"], a["entry_ord"]))):
                    keys = tuple(tuple(k) for k in a["lemma_keys"] or [])
                    sources.setdefault(a["source"], []).append(Alias(i, a["alias"], a["type"], a["ref"] or "", a["canonical"], tuple(sorted(dict(a["attrs"] or {}).items())), a["flags"], tuple(a["cases"] or ()), keys, tuple(a["surface_key"] or ())))
                s, f = extract(text or "", ts, [Index(x) for x in sources.values()], book, weights, nesting, tags or (), types or (), least)
                for x in s:
                    x["attrs"] = list(x["attrs"].items())
                    if not explain:
                        x["evidence"] = []
                for x in f:
                    x["args"] = list(x["args"].items())
                spans.append(s)
                facts.append(f)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.list_(_SPAN)), pa.array(facts, pa.list_(_FACT))], ["doc_id", "spans", "facts"])

    return run


#: Rows of a dictionary's or a gazetteer's share of a corpus up to which they are broadcast (some hundred bytes each).
BROADCAST_ROWS = 100_000

#: What a document may look up in a dictionary: forms, dotted forms, hyphen parts of them.
_LOOKED_UP = """array_distinct(flatten(transform(filter(tokens, t -> t.kind = 'word' and t.script = 'cyrillic' and t.form <> ''),
    t -> if(t.dotted, array(t.form, concat(t.form, '.')), array(t.form)))))"""
_WORDS = "array_distinct(transform(filter(tokens, t -> t.kind in ('word', 'number')), t -> t.form))"


def extract_documents(docs: DataFrame, compiled: DataFrame, dict_forms: DataFrame, p: Pipeline) -> DataFrame:
    """(doc_id, spans, facts) of ``docs(doc_id, text[, profile, tags, types])``; doc_ids are unique.

    Tokens are made where they are used and never leave their document.  Only each
    document's distinct words do: to the dictionary, by distinct key over all
    documents, and to the first words of aliases.
    """
    prepare(docs.sparkSession)
    have = set(docs.columns)
    col = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.nullif(col("profile", "string"), F.lit("")), F.lit(p.default_profile)).alias("profile"), col("tags", "array<string>").alias("tags"), col("types", "array<string>").alias("types"))
    known = F.col("profile").isin(*p.profiles)
    rows = rows.withColumn("profile", F.when(known, F.col("profile")).otherwise(F.raise_error(F.concat(F.lit("unknown profile "), F.col("profile"))).cast("string")))
    names = [p.default_profile] if "profile" not in have else list(p.profiles)
    scratch = Scratch(docs.sparkSession, "extract")
    brief = with_tokens(rows, p.rules, ["doc_id", "profile"], fields=("form", "kind", "script", "dotted"))
    brief = scratch.keep(brief.select("doc_id", "profile", F.expr(_LOOKED_UP).alias("keys"), F.expr(_WORDS).alias("words")), "words")
    own = brief.select("doc_id", "profile", F.explode("keys").alias("key"))
    read, done = None, []
    for name in names:
        keys = own.where(F.col("profile") == name).select("doc_id", "key")
        said = lookups(keys.select("key").distinct(), dict_forms, p.profiles[name], p.rules).select("key", "lemmas", "abbrev")
        got = keys.join(small(scratch.keep(said, f"lookups-{len(done)}"), BROADCAST_ROWS)[0], "key")
        done.append(name)
        read = got if read is None else read.unionByName(got)
    per_doc = read.groupBy("doc_id").agg(F.collect_list(F.struct("key", "lemmas", "abbrev")).alias("known"))  # a document's distinct keys
    words = brief.select("doc_id", F.explode("words").alias("word"))
    said = read.select("doc_id", F.explode(F.concat(F.array("key"), F.expr("transform(lemmas, l -> l.text)"), F.expr("transform(abbrev, l -> l.text)"))).alias("word"))
    firsts = compiled.where("n_words > 0").select("alias_id", F.explode(F.array_distinct(F.concat(F.array(F.get("surface_key", F.lit(0))), F.expr("transform(lemma_keys, k -> k[0])")))).alias("word"))
    firsts, _ = small(firsts, BROADCAST_ROWS)
    alias = F.struct("source", "entry_ord", "alias", "type", "ref", "canonical", "attrs", "flags", "cases", "lemma_keys", "surface_key")
    entries, _ = small(compiled.where("n_words > 0").select("alias_id", alias.alias("a")), BROADCAST_ROWS)
    hit = words.join(firsts, "word").unionByName(said.join(firsts, "word")).select("doc_id", "alias_id").distinct()
    found = hit.join(entries, "alias_id").groupBy("doc_id").agg(F.collect_list("a").alias("aliases"))
    full = rows.select("doc_id", "text", "tags", "types").join(per_doc, "doc_id", "left").join(found, "doc_id", "left").select("doc_id", "text", "known", "aliases", "tags", "types")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return full.mapInArrow(_kernel(p), f"doc_id {kind}, spans array<{SPAN_TYPE}>, facts array<{FACT_TYPE}>")


def spans(results: DataFrame) -> DataFrame:
    """One row per span, with its place."""
    return results.select("doc_id", F.posexplode("spans").alias("place", "s")).select("doc_id", "place", "s.*")


def facts(results: DataFrame) -> DataFrame:
    return results.select("doc_id", F.posexplode("facts").alias("place", "f")).select("doc_id", "place", "f.*")


def span_json(results: DataFrame) -> DataFrame:
    """Spans as JSON lines (OP-15)."""
    names = "array('ambiguous','predicted','abbrev','candidate','nested')"
    s = spans(results).withColumn("flags", F.expr(f"filter(transform({names}, (n, i) -> if((flags & shiftleft(1, i)) <> 0, n, '')), x -> x <> '')")).withColumnRenamed("doc_id", "doc")
    return s.select(F.to_json(F.struct("doc", "start", "end", "rune_start", "rune_end", "type", "surface", "normal", "refs", "attrs", "flags", "score", "evidence", "alternatives")).alias("value"))
