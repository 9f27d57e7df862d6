"""Matches over whole corpora against brute force."""

import collections
import json
import os
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq

from verba import catalog
from verba.runtime import prepare


def corpus(spark, path, rows) -> str:
    prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}"


def test_lemma_pairs_of_all_texts(spark, tmp_path):
    rows = [(1, "aba zavodnik ta ta", "en"), (50, "ta ta kanava", "fr"), (7, "zavodskoi aba gora", None), (None, "tetradka aba", "en"), (None, "aba gora", None), (9, "", "en"), (10, None, "en"), (11, "aba", "en"), (12, "gora", "en"), (12, "aba", "en")]
    cyr = str.maketrans(catalog.LATIN, catalog.CYRILLIC)
    want = collections.Counter()
    for i, text, _ in rows:
        options = [[w[:4], w[:5]] if len(w) >= 5 else [w] for w in (text or "").translate(cyr).split()]
        want.update((i, f"{a} {b}") for x, y in zip(options, options[1:], strict=False) for a in x for b in y)
    got = {(r["doc_id"], r["key"]): r["n"] for r in catalog.lemma_matches(spark, corpus(spark, tmp_path, rows)).collect()}
    assert got == want and {i for i, _ in got} == {1, 50, 7, None}


def test_surface_runs_of_all_texts(spark, tmp_path):
    rows = [(i, "Der Wald ist. tief", "de") for i in range(19)] + [(40, "der wald ist", None), (None, "der wald", "fr"), (None, "ist tief", "en"), (41, "the ist", "en"), (42, None, "en"), (43, "Ist", "es"), (43, "der", "es")]
    own = collections.Counter()
    for i, text, _ in rows:
        for part in (text or "").lower().split("."):
            w = part.split()
            own.update((i, " ".join(w[s : s + n])) for n in (1, 2, 3) for s in range(len(w) - n + 1))
    total = collections.Counter()
    for (_, k), n in own.items():
        total[k] += n
    want = {(i, k): n for (i, k), n in own.items() if total[k] >= 20}
    got = {(r["doc_id"], r["alias"]): r["n"] for r in catalog.surface_matches(spark, corpus(spark, tmp_path, rows)).collect()}
    assert got == want and {k for _, k in got} == {"der", "wald", "ist", "tief", "der wald", "wald ist", "der wald ist"}


def test_surface_runs_go_past_dots_of_one_character(spark, tmp_path):
    rows = [(i, "release 2.0 or a. b or 12.0", "en") for i in range(20)]
    got = {(r["doc_id"], r["alias"]): r["n"] for r in catalog.surface_matches(spark, corpus(spark, tmp_path, rows)).collect()}
    words = [["release", "2", "0", "or", "a", "b", "or", "12"], ["0"]]
    want = collections.Counter((i, " ".join(w[s : s + n])) for i, _, _ in rows for w in words for n in (1, 2, 3) for s in range(len(w) - n + 1))
    assert got == want


CLUSTER = """
import json, sys
from pyspark.sql import SparkSession
from verba import catalog
s = (SparkSession.builder.master("local-cluster[2,2,1024]").config("spark.default.parallelism", "8").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
     .config("spark.checkpoint.dir", f"file://{sys.argv[1]}/shared").getOrCreate())
print("ROWS", json.dumps([[r["doc_id"], r["key"], r["n"]] for r in catalog.lemma_matches(s, f"file://{sys.argv[1]}").collect()]))
s.stop()
"""


def test_lemma_pairs_of_few_files_on_a_cluster(tmp_path):
    """Fewer files than cores are dealt; blocks then come in any order, and a row must stay the same row."""
    os.mkdir(tmp_path / "documents.parquet")
    for i in range(3):
        ids = list(range(i, 240, 3))
        pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": ["aba gora ta"] * len(ids)}), tmp_path / f"documents.parquet/{i}.parquet")
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ran = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path)], capture_output=True, text=True, timeout=300, cwd=tmp_path, env=os.environ | {"PYTHONPATH": home, "PYSPARK_PYTHON": sys.executable})
    rows = [json.loads(x[5:]) for x in ran.stdout.splitlines() if x.startswith("ROWS ")]
    assert rows, ran.stderr[-2000:]
    assert sorted(rows[0]) == sorted([i, k, 1] for i in range(240) for k in ("аба гора", "гора та"))
