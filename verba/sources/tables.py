"""Gazetteer TSV, golden JSON lines, line documents and result sinks (OP-09, OP-10, OP-12, OP-14 to OP-16)."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Entry flags (DM-16).
ENTRY_FLAGS = {"requires_context": 1, "surface_only": 2, "case_sensitive": 4, "blocked": 8}
ENTRY_SCHEMA = "source string, entry_ord long, alias string, type string, ref string, canonical string, attrs map<string,string>, flags int"


def entry_flags(text: str) -> str:
    """Bits of a comma list of flags; null if one is unknown (OP-6E), as SQL."""
    cases = " ".join(f"when '{n}' then {b}" for n, b in ENTRY_FLAGS.items())
    return f"aggregate(filter(transform(split({text}, ','), x -> trim(x)), x -> x <> ''), 0, (a, x) -> a | (case x {cases} end))"


def gazetteer_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good entries and bad lines of (source, line_no, line).

    Lines are ``type, ref, canonical, alias[, flags[, key=value;...]]``; empty
    lines and ``#`` comments are skipped.
    """
    rows = lines.withColumn("line", F.regexp_replace("line", "\r$", "")).where("trim(line) <> '' and not startswith(trim(line), '#')")
    rows = rows.withColumn("f", F.split("line", "\t")).withColumn("n", F.size("f"))
    cell = lambda i: F.coalesce(F.trim(F.get("f", F.lit(i))), F.lit(""))
    rows = rows.withColumns({"type": cell(0), "ref": cell(1), "canonical": cell(2), "alias": cell(3), "_flags": cell(4), "_attrs": cell(5)})
    rows = rows.withColumn("flags", F.expr(entry_flags("_flags"))).withColumn("_pairs", F.expr("filter(transform(split(_attrs, ';'), x -> trim(x)), x -> x <> '')"))
    fault = (
        F.when((F.col("n") < 4) | (F.col("n") > 6), F.concat(F.lit("want 4 to 6 fields, got "), F.col("n").cast("string")))
        .when(F.col("type") == "", "no type").when(F.col("alias") == "", "no alias").when(F.col("flags").isNull(), "unknown flag")
        .when(F.expr("exists(_pairs, p -> instr(p, '=') < 2)"), "an attribute is key=value")
    )
    rows = rows.withColumn("fault", fault)
    attrs = F.expr("map_from_entries(array_sort(transform(_pairs, p -> struct(trim(substring(p, 1, instr(p, '=') - 1)), trim(substring(p, instr(p, '=') + 1))))))")
    good = rows.where("fault is null").select("source", F.col("line_no").cast("long").alias("entry_ord"), "alias", "type", "ref", F.when(F.col("canonical") == "", F.col("alias")).otherwise(F.col("canonical")).alias("canonical"), attrs.alias("attrs"), "flags")
    return good, rows.where("fault is not null").select("source", "line_no", "fault")


def text_lines(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, line_no, line) of one text file."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return whole.select(F.lit(source).alias("source"), (F.col("at") + 1).alias("line_no"), "line")


def file_version(spark: SparkSession, path: str) -> DataFrame:
    """(path, version): a source's version is its content's hash."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("version"))


def line_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents, one a line; blank lines are skipped and nothing is trimmed (OP-16)."""
    return text_lines(spark, path, path).where("trim(line) <> ''").select(F.col("line_no").alias("doc_id"), F.col("line").alias("text"))


@dataclass(frozen=True)
class Case:
    """A golden case with its gold spans as (start, end, type) in code points (DM-33)."""

    id: str
    text: str
    profile: str
    tags: tuple[str, ...]
    spans: tuple[tuple[int, int, str], ...]
    context: tuple[tuple[str, str], ...] = ()


def golden_cases(lines: Iterable[str]) -> list[Case]:
    """Cases of JSON lines; unknown fields and spans that the text lacks raise with the line (OP-12)."""
    out = []
    for no, line in enumerate(lines, 1):
        if not line.strip():
            continue
        x = json.loads(line)
        if extra := set(x) - {"id", "text", "profile", "tags", "spans", "context"}:
            raise ValueError(f"line {no}: unknown field {sorted(extra)[0]!r}")
        spans = []
        for s in x.get("spans") or []:
            if extra := set(s) - {"text", "type", "occurrence"}:
                raise ValueError(f"line {no}: unknown field {sorted(extra)[0]!r}")
            at = -len(s["text"])
            for _ in range(max(1, s.get("occurrence") or 1)):
                at = x["text"].find(s["text"], at + len(s["text"])) if s["text"] else -1
                if at < 0:
                    raise ValueError(f"line {no}: no span {s['text']!r}")
            spans.append((at, at + len(s["text"]), s["type"]))
        out.append(Case(x.get("id") or f"line{no}", x["text"], x.get("profile") or "", tuple(x.get("tags") or ()), tuple(spans), tuple(sorted((x.get("context") or {}).items()))))
    return out


def write_json_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines (OP-15)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
