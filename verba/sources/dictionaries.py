"""Dictionary catalogue: files, manifests, state, versions, parse and inflect (OP-01 to OP-08, OP-40 to OP-49).

A catalogue is a list of small entries on the driver and one DataFrame of word
forms.  A generation is immutable; enabling, disabling and reloading make a new
one, so a query that holds the old generation is not disturbed.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMS_SCHEMA = "dict_ord int, dict string, kind string, form_key string, form string, lemma string, tag string, lexeme_id long, form_ord long, predicted boolean"
BUILTIN_KINDS = ("base", "abbrev")
_KIND = re.compile(r"[a-z][a-z0-9_]*\Z")
MANIFEST_KEYS = ("source", "license", "version", "url", "generated_from")


def valid_kind(kind: str) -> bool:
    return bool(_KIND.match(kind))


def kind_sql(name: Column) -> Column:
    """The kind part of ``<kind>.<name>``; null unless it is a valid kind (OP-27)."""
    k = F.split_part(name, F.lit("."), F.lit(1))
    return F.when(F.regexp_like(k, F.lit(r"^[a-z][a-z0-9_]*\z")) & name.contains("."), k)


def fold_yo(col: Column) -> Column:
    return F.translate(col, "ёЁ", "еЕ")


# -- manifests ------------------------------------------------------------------


def manifest_fields(lines: DataFrame, group: list[str]) -> DataFrame:
    """One manifest per group from rows with ``line_no`` and ``line`` (OP-06): known fields and ``extra``."""
    line = F.trim(F.regexp_replace("line", "\r", ""))
    at = F.instr(line, ":")
    rows = lines.where((line != "") & ~F.startswith(line, F.lit("#")) & (at > 0)).select(*group, "line_no", F.lower(F.trim(F.substr(line, F.lit(1), at - 1))).alias("key"), F.trim(F.substr(line, at + 1)).alias("value"))
    last = rows.groupBy(*group, "key").agg(F.max_by("value", "line_no").alias("value"))
    known = [F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit("")).alias(k) for k in MANIFEST_KEYS]
    extra = F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("key").isin(*MANIFEST_KEYS), F.struct("key", "value")))))
    return last.groupBy(*group).agg(*known, extra.alias("extra"))


def merge_manifests(a: str, b: str) -> list[Column]:
    """Fields of struct columns ``a`` and ``b``, ``a`` first (OP-08)."""
    out = [F.coalesce(F.nullif(F.col(f"{a}.{k}"), F.lit("")), F.col(f"{b}.{k}"), F.lit("")).alias(k) for k in MANIFEST_KEYS]
    entries = F.array_sort(F.concat(F.map_entries(F.col(f"{a}.extra")), F.filter(F.map_entries(F.col(f"{b}.extra")), lambda e: ~F.map_contains_key(F.col(f"{a}.extra"), e["key"]))))
    return [*out, F.map_from_entries(entries).alias("extra")]


def manifest_text(m: str = "") -> Column:
    """The sidecar text of a manifest (OP-07): known fields, then extra ones by key, without empty ones."""
    col = lambda k: F.col(f"{m}.{k}" if m else k)
    known = F.array(*(F.when(col(k) != "", F.concat(F.lit(f"{k}: "), col(k))) for k in MANIFEST_KEYS))
    extra = F.transform(F.array_sort(F.filter(F.map_entries(col("extra")), lambda e: e["value"] != "")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.concat(F.array_compact(known), extra), "\n")


def manifest_line(m: str = "") -> Column:
    """One line of attribution."""
    col = lambda k: F.nullif(F.col(f"{m}.{k}" if m else k), F.lit(""))
    return F.concat_ws(", ", col("source"), col("version"), col("license"), col("url"))


# -- entries -------------------------------------------------------------------------


@dataclass(frozen=True)
class Entry:
    """One dictionary of the catalogue (DM-12); ``error`` tells why it cannot be used."""

    name: str
    kind: str
    format: str
    origin: str
    hash: str = ""
    enabled: bool = True
    error: str = ""


def tsv_rows(text: str) -> list[tuple[str, str, str]]:
    """(lemma, form, tag) lines of a TSV dictionary, with ё as е (OP-03)."""
    out = []
    for no, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        cells = line.replace("ё", "е").replace("Ё", "Е").split("\t")
        if len(cells) < 2 or not cells[0] or not cells[1]:
            raise ValueError(f"line {no}: want lemma, form and tag")
        out.append((cells[0], cells[1], cells[2] if len(cells) > 2 else ""))
    return out


def content_hash(rows: Iterable[tuple]) -> str:
    """Hash of a dictionary's content, whatever the time it was built."""
    h = hashlib.sha256()
    for r in rows:
        h.update(("\t".join(r) + "\n").encode())
    return h.hexdigest()


@dataclass(frozen=True)
class Catalog:
    """A generation of dictionaries: entries in order, and the forms of the usable ones."""

    spark: SparkSession
    entries: tuple[Entry, ...]
    contents: Mapping[str, tuple[tuple[str, str, str], ...]] = field(repr=False)
    predictions: tuple[tuple[str, str, str], ...] = ()

    # -- building ----------------------------------------------------------------
    @staticmethod
    def open(spark: SparkSession, folder: str | None = None, base: Iterable[tuple] = (), builtins: Mapping[str, Iterable[tuple]] | None = None,
             kinds: Iterable[str] = (), state: Mapping[str, bool] | None = None, predictions: Iterable[tuple] = ()) -> Catalog:
        """Base files (else ``base``), built-ins in order, then other files by name (OP-01, OP-02, OP-05, OP-40).

        Rows of ``base`` and ``builtins`` are (lemma, form, tag).  A file that cannot
        be used is listed with its error; an undeclared kind of a built-in raises.
        """
        known = {*BUILTIN_KINDS, *kinds}
        for k in known:
            if not valid_kind(k):
                raise ValueError(f"invalid kind {k!r}")
        files = scan_folder(folder, known) if folder else []
        by_name = {e.name: (e, rows) for e, rows in files}
        picked: list[tuple[Entry, tuple]] = [x for x in files if x[0].kind == "base"]
        if not any(not e.error for e, _ in picked) and base:
            rows = tuple(base)
            picked.append((Entry("base.builtin", "base", "table", "built-in", content_hash(rows)), rows))
        for name, given in (builtins or {}).items():
            kind = name.partition(".")[0]
            rows = tuple(given)
            if name in by_name:
                picked.append(by_name[name])
            elif not valid_kind(kind) or "." not in name:
                picked.append((Entry(name, kind, "table", "built-in", error="a built-in's name is <kind>.<name>"), ()))
            elif kind not in known:
                raise ValueError(f"undeclared kind {kind!r} of built-in {name!r}")
            else:
                picked.append((Entry(name, kind, "table", "built-in", content_hash(rows)), rows))
        names = {e.name for e, _ in picked}
        picked += [x for x in files if x[0].name not in names]
        state = state or {}
        entries = tuple(replace(e, enabled=state.get(e.name, True) and not e.error) for e, _ in picked)
        return Catalog(spark, entries, {e.name: tuple(rows) for e, rows in picked}, tuple(predictions))

    def set_enabled(self, name: str, on: bool) -> Catalog:
        """A generation with one dictionary on or off (OP-43)."""
        e = next((e for e in self.entries if e.name == name), None)
        if e is None:
            raise KeyError(f"unknown dictionary {name!r}")
        if e.error:
            raise ValueError(f"dictionary {name!r} cannot be used: {e.error}")
        return replace(self, entries=tuple(replace(x, enabled=on) if x.name == name else x for x in self.entries))

    # -- reading -----------------------------------------------------------------
    @property
    def live(self) -> list[Entry]:
        return [e for e in self.entries if e.enabled and not e.error]

    def version(self) -> str:
        """Hash over the enabled dictionaries in order (OP-45)."""
        return hashlib.sha256("".join(f"{e.name}\t{e.kind}\t{e.hash}\n" for e in self.live).encode()).hexdigest()

    def frame(self) -> DataFrame:
        """The entries as a table."""
        rows = [(i, e.name, e.kind, e.format, e.origin, e.hash, e.enabled, e.error) for i, e in enumerate(self.entries)]
        return self.spark.createDataFrame(rows, "dict_ord int, name string, kind string, format string, origin string, hash string, enabled boolean, error string")

    def summary(self) -> DataFrame:
        """Dictionaries and forms by kind."""
        forms = self.forms().where("not predicted").groupBy("dict").agg(F.count("*").alias("forms"))
        e = self.frame().where("enabled").join(F.broadcast(forms), F.col("name") == F.col("dict"), "left")
        return e.groupBy("kind").agg(F.count("*").alias("dictionaries"), F.sum(F.coalesce("forms", F.lit(0))).alias("forms"))

    def forms(self) -> DataFrame:
        """The word forms of the enabled dictionaries (DM-14)."""
        rows = []
        for i, e in enumerate(self.live):
            lexemes: dict[str, int] = {}
            for j, (lemma, form, tag) in enumerate(self.contents[e.name]):
                key = f"{lemma}\t{tag.partition(',')[0].partition(' ')[0]}" if _verbal(tag) is None else f"{lemma}\t{_verbal(tag)}"
                rows.append((i, e.name, e.kind, form.lower(), form, lemma, tag, (i << 40) + lexemes.setdefault(key, len(lexemes)), j, False))
        base = next((e for e in self.live if e.kind == "base"), None)
        if base:
            rows += [(self.live.index(base), base.name, "base", w.lower(), w, lemma, tag, -1, 1 << 40, True) for w, lemma, tag in self.predictions]
        return self.spark.createDataFrame(rows, FORMS_SCHEMA)


def _verbal(tag: str) -> str | None:
    """Forms of one verb share a paradigm across these parts of speech."""
    pos = re.split("[,; ]", tag)[0]
    return "V" if pos in ("INFN", "VERB", "GRND", "PRTF", "PRTS") else None


def scan_folder(folder: str, known: set[str]) -> list[tuple[Entry, tuple]]:
    """Entries of ``*.tsv`` and ``*.dat`` files by name; problems are entries with errors (OP-01)."""
    out: list[tuple[Entry, tuple]] = []
    if not os.path.isdir(folder):
        return out
    for file in sorted(os.listdir(folder)):
        name, ext = os.path.splitext(file)
        path = os.path.join(folder, file)
        if ext not in (".tsv", ".dat") or os.path.isdir(path):
            continue
        kind, dot, rest = name.partition(".")
        entry = Entry(name, kind, ext[1:], path)
        problem, rows = "", ()
        if not dot or not rest or not valid_kind(kind):
            problem = "a file's name is <kind>.<name>"
        elif kind not in known:
            problem = f"undeclared kind {kind!r}"
        elif any(e.name == name for e, _ in out):
            problem = "a dictionary of this name is already there"
        elif ext == ".dat":
            problem = "binary dictionaries are not read; store them as TSV or Parquet"
        else:
            try:
                with open(path, "rb") as f:
                    raw = f.read()
                rows = tuple(tsv_rows(raw.decode("utf-8")))
                entry = replace(entry, hash=hashlib.sha256(raw).hexdigest())
            except (OSError, ValueError) as e:
                problem = str(e)
        out.append((replace(entry, error=problem), rows))
    return out


# -- parse and inflect ---------------------------------------------------------------


def has_all(tag: Column, want: Column) -> Column:
    """Whether a tag has every grammeme of an array, as whole tokens (OP-47)."""
    own = F.split(tag, "[,; ]")
    return F.forall(want, lambda g: F.array_contains(own, g))


def parse_words(words: DataFrame, forms: DataFrame, kinds: Iterable[str] = ()) -> DataFrame:
    """(word, ord, normal, tag, kind, dict, predicted): exact readings, or else the base's predictions (OP-41)."""
    if kinds := tuple(kinds):
        forms = forms.where(F.col("kind").isin(*kinds))
    rows = words.select("word", F.lower("word").alias("form_key")).join(forms, "form_key")
    rows = rows.join(rows.groupBy("word").agg(F.bool_or(~F.col("predicted")).alias("sure")), "word").where("predicted != sure and (not predicted or kind = 'base')")
    from pyspark.sql import Window

    w = Window.partitionBy("word").orderBy("dict_ord", "form_ord")
    return rows.select("word", F.row_number().over(w).alias("ord"), F.col("lemma").alias("normal"), "tag", "kind", "dict", "predicted")


def inflect(requests: DataFrame, forms: DataFrame) -> DataFrame:
    """``forms`` of each request (id, word, kinds, from, want): a lexeme's forms with all wanted grammemes (OP-42).

    The source form comes first, then forms by the number of grammemes that
    differ and stored order.  A dictionary that does not know the word is asked
    with ё as е.
    """
    sure = forms.where("not predicted")
    req = requests.select("id", F.lower("word").alias("w"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), F.coalesce("from", F.array().cast("array<string>")).alias("src"), F.coalesce("want", F.array().cast("array<string>")).alias("want"))
    direct = req.join(sure.select(F.col("form_key").alias("w"), "dict_ord", "kind", "tag", "lexeme_id", "form_ord"), "w").withColumn("way", F.lit(0))
    folded = req.withColumn("w", fold_yo(F.col("w")))
    loose = sure.select(fold_yo(F.col("form_key")).alias("w"), "dict_ord", "kind", "tag", "lexeme_id", "form_ord")
    folded = folded.join(loose, "w").withColumn("way", F.lit(1))
    hit = direct.unionByName(folded.select(direct.columns)).where("size(kinds) = 0 or array_contains(kinds, kind)")
    first = hit.groupBy("id", "dict_ord").agg(F.min("way").alias("way"))
    hit = hit.join(first, ["id", "dict_ord", "way"]).where(has_all(F.col("tag"), F.col("src")))
    hit = hit.select("id", "dict_ord", "lexeme_id", F.col("tag").alias("own_tag"), F.col("form_ord").alias("reading"), "want")
    all_forms = hit.join(sure.select("dict_ord", "lexeme_id", "form", "tag", "form_ord"), ["dict_ord", "lexeme_id"]).where(has_all(F.col("tag"), F.col("want")))
    a, b = F.split("own_tag", "[,; ]"), F.split("tag", "[,; ]")
    far = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    got = all_forms.select("id", F.struct("dict_ord", "reading", far.alias("far"), "form_ord", "form").alias("x"))
    out = got.groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["form"])).alias("forms"))
    return requests.select("id").join(out, "id", "left")
