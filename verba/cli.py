"""Command line over the DataFrame operators (OP-17): analyze, dicts, extract, golden.

Exit codes: 0 done, 1 a check or an input failed, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from verba.operators import analyzer, evaluate, gazetteer, ner
from verba.operators.lookup import Profile
from verba.plans.rules import compile_book, load
from verba.sources import dictionaries, tables


def profile(spec: str) -> Profile:
    """``NAME[:KIND[G1|G2],...]``."""
    name, _, rest = spec.partition(":")
    kinds, grams = [], {}
    for part in filter(None, rest.split(",")):
        m = re.fullmatch(r"([a-z][a-z0-9_]*)(?:\[([^\]]*)\])?", part)
        if not m:
            raise argparse.ArgumentTypeError(f"bad kind {part!r}")
        kinds.append(m[1])
        if m[2]:
            grams[m[1]] = tuple(m[2].split("|"))
    if not name:
        raise argparse.ArgumentTypeError("a profile needs a name")
    return Profile(name, tuple(kinds), grams)


def nesting(specs: list[str]) -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for s in specs:
        outer, arrow, inner = s.partition(">")
        if not arrow or not outer or not inner:
            raise argparse.ArgumentTypeError(f"want outer>inner, got {s!r}")
        out[outer] = (*out.get(outer, ()), inner)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verba")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "extract", "golden", "dicts"):
        s = sub.add_parser(name)
        s.add_argument("--dicts", required=True, help="folder of TSV dictionaries")
        s.add_argument("--kind", action="append", default=[], help="a host-defined kind")
        if name != "dicts":
            s.add_argument("--profile", type=profile, default=Profile("text"))
            s.add_argument("input", help="a text file, one document a line; JSON lines of cases for golden")
        if name == "analyze":
            s.add_argument("--mode", choices=("full", "index"), default="full")
        if name in ("extract", "golden"):
            s.add_argument("--entries", action="append", default=[], help="a gazetteer file")
            s.add_argument("--rules", action="append", default=[])
            s.add_argument("--nest", action="append", default=[])
        if name == "golden":
            s.add_argument("--min-precision", type=float, default=0.0)
            s.add_argument("--min-recall", type=float, default=0.0)
    return p


def _pipeline(spark, a, forms):
    entries = None
    for path in a.entries:
        good, bad = tables.gazetteer_lines(tables.text_lines(spark, path, path))
        for r in bad.orderBy("line_no").collect():  # faults of one hand-written file
            print(f"{path}:{r['line_no']}: {r['fault']}", file=sys.stderr)
        entries = good if entries is None else entries.unionByName(good)
    if entries is None:
        entries = spark.createDataFrame([], tables.ENTRY_SCHEMA)
    books = []
    for path in a.rules:
        with open(path, encoding="utf-8") as f:
            books.append(load(f.read(), path))
    p = ner.Pipeline({a.profile.name: a.profile}, a.profile.name, compile_book(*books), nesting=nesting(a.nest))
    return gazetteer.compile_entries(entries, forms, {}, a.profile), p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or SparkSession.builder.appName("verba").getOrCreate()
    try:
        cat = dictionaries.Catalog.open(spark, a.dicts, kinds=a.kind)
        if a.command == "dicts":
            for e in cat.entries:
                print("\t".join((e.name, e.kind, e.format, "on" if e.enabled else "off", e.error)))
            return 0
        forms = cat.forms()
        if a.command == "analyze":
            t = analyzer.analyze(tables.line_documents(spark, a.input), forms, a.profile, mode=a.mode)
            lines = t.orderBy("doc_id", "idx", "part").select(F.concat_ws("\t", "raw", "term", analyzer.shown()).alias("s"))
            for r in lines.toLocalIterator():
                print(r["s"])
            return 0
        compiled, p = _pipeline(spark, a, forms)
        if a.command == "extract":
            for r in ner.span_json(ner.extract_documents(tables.line_documents(spark, a.input), compiled, forms, p)).toLocalIterator():
                print(r["value"])
            return 0
        with open(a.input, encoding="utf-8") as f:
            cases = tables.golden_cases(f)
        docs = spark.createDataFrame([(c.id, c.text, list(c.tags)) for c in cases], "doc_id string, text string, tags array<string>")
        gold = spark.createDataFrame([(c.id, i, *s) for c in cases for i, s in enumerate(c.spans)], "case_id string, ord int, start int, end int, type string")
        got = ner.spans(ner.extract_documents(docs, compiled, forms, p)).select(F.col("doc_id").alias("case_id"), F.col("place").alias("ord"), F.col("rune_start").alias("start"), F.col("rune_end").alias("end"), "type")
        scores = evaluate.rates(evaluate.strict_counts(gold, got))
        for r in scores.orderBy("type").collect():  # a row a type
            print(f"{r['type']}\t{r['tp']}\t{r['fp']}\t{r['fn']}\t{r['precision']:.3f}\t{r['recall']:.3f}\t{r['f1']:.3f}")
        failed = [r["message"] for r in evaluate.check(scores, a.min_precision, a.min_recall).collect()]
        print(*failed, sep="\n", end="\n" if failed else "", file=sys.stderr)
        return int(bool(failed))
    except (ValueError, OSError, argparse.ArgumentTypeError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
