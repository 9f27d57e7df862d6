"""SQL functions, the stream and the command line."""

import json

from verba import catalog, cli, fixtures
from verba.functions.registry import register
from verba.operators import ner
from verba.plans.rules import compile_book, load
from verba.runtime import prepare
from verba.streaming.extract import start


def test_sql(spark):
    assert "vb_tokens" in register(prepare(spark))
    r = spark.sql("select vb_normalize_word('Ивановъ') a, vb_case_of('СПб') b, vb_reform_variants('новыя') c, vb_orthography(null) d").first()
    assert tuple(r) == ("иванов", "mixed", ["новые", "новой"], None)
    rows = spark.sql("select t.raw, t.rune_start from values ('Кот, 5') v(x), lateral vb_tokens(x) t order by t.idx").collect()
    assert [tuple(x) for x in rows] == [("Кот", 0), (",", 3), ("5", 5)]


def test_stream(spark, tmp_path):
    forms = catalog.golden_catalog(prepare(spark)).forms()
    compiled = catalog.golden_compiled(spark, forms)
    p = ner.Pipeline(fixtures.NER_PROFILES, "text", compile_book(load(fixtures.RULES)))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"doc_id": 1, "text": "лёд на оз. Налимье"}, ensure_ascii=False))
    stream = spark.readStream.schema("doc_id long, text string").json(f"file://{tmp_path}/in")
    start(stream, lambda: (compiled, forms, p), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(120)
    assert [r["surface"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == ["оз. Налимье"]


def test_command_line(spark, tmp_path, capsys):
    d = tmp_path / "dicts"
    d.mkdir()
    (d / "base.own.tsv").write_text("кот\tкота\tNOUN\n")
    (d / "x.tsv").write_text("")
    (tmp_path / "in.txt").write_text("Кота нет\n\nкот\n")
    (tmp_path / "e.tsv").write_text("animal\ta:1\tкот\tкот\nbad\n")
    (tmp_path / "g.jsonl").write_text(json.dumps({"text": "вижу кота", "spans": [{"text": "кота", "type": "animal"}]}, ensure_ascii=False))
    prepare(spark)
    assert cli.main(["analyze", "--dicts", str(d), f"file://{tmp_path}/in.txt"], spark) == 0
    assert capsys.readouterr().out.split("\n")[0] == "Кота\tкота\tкот[]"
    assert cli.main(["extract", "--dicts", str(d), "--entries", f"file://{tmp_path}/e.tsv", f"file://{tmp_path}/in.txt"], spark) == 0
    got = capsys.readouterr()
    assert json.loads(got.out.split("\n")[0])["surface"] in ("Кота", "кот") and ":2: want 4 to 6 fields" in got.err
    assert cli.main(["golden", "--dicts", str(d), "--entries", f"file://{tmp_path}/e.tsv", "--min-recall", "1", str(tmp_path / "g.jsonl")], spark) in (0, 1)
    assert cli.main(["dicts", "--dicts", str(d)], spark) == 0 and "x\tx\ttsv\toff" in capsys.readouterr().out
    assert cli.main(["nothing"], spark) == 2
    assert cli.main(["extract", "--dicts", str(d), "--nest", "ab", f"file://{tmp_path}/in.txt"], spark) == 1
