"""Empty tables, repeated rows, ties, very long texts and clashing columns, for operators whose own tests lack them."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verba.llm import decontaminate, html_diff, quality_fm, url_gbt
from verba.runtime import prepare

public = pytest.importorskip("public_tokenizers")
MODEL = "piece_bpe_32k.model"


def rule_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_against_brute_force(spark):
    rnd = random.Random(11)
    part = ["http", "://", "/", "?", "#", ".", "net", "example.net", "Example.COM", "org", "É", "/en/", "/de/", "/fr/", "a", "\n", ":80", "@"]
    urls = ["".join(rnd.choice(part) for _ in range(rnd.randrange(9))) for _ in range(300)]
    urls += [f"https://{rnd.choice(['', 'www.', 'not'])}{rnd.choice(part[6:10])}{rnd.choice(['', '/', '/en/', '/de/', '/fr/', '/en'])}{rnd.choice(['', 'x', '?q=/en/', '#/de/'])}" for _ in range(300)]
    urls += [None, "", "http://a.net/" + "x" * 300_000, "http://a.net/", "http://a.net/"]
    rows = prepare(spark).createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("z") for c in ("host", "path", "rule", "verdict", "score", "tld")})
    got = url_gbt.judge(rows.repartition(3), rounds=2).collect()
    assert len(got) == len(urls) and {r["verdict"] for r in got} <= {"allow", "block"}
    for r in got:
        host, path, rule, verdict = rule_by_hand(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls[r["page_id"]]
        assert verdict in (None, r["verdict"])
    same = rows.where("page_id >= 603").withColumn("page_id", F.lit(None).cast("long"))
    assert [(r["page_id"], r["host"]) for r in url_gbt.judge(same, rounds=1).collect()] == [(None, "a.net")] * 2
    assert url_gbt.judge(rows.where("page_id < 0"), rounds=1).count() == 0


def test_pieces_and_counts(frame):
    from sentencepiece import SentencePieceProcessor

    from verba.llm.sentencepiece_fst import encode_documents
    from verba.llm.token_counts import token_counts

    path = public.path(MODEL)
    lib, rnd = SentencePieceProcessor(model_file=path), random.Random(12)
    long = " ".join(rnd.choice(["river", "stone", "é", "x" * 50, "\n"]) for _ in range(60000))
    rows = [(1, "to be"), (1, "to be"), (1, "or not"), (None, None), (None, None), (2, long)]
    docs = frame(rows).withColumns({c: F.lit(1) for c in ("ids", "n_tokens", "n_bytes", "over_limit", "decoded")})
    want = sorted(((i, lib.encode(t or "")) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in encode_documents(docs, path, decoded=True).collect()), key=str) == want
    counts = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, path).collect()), key=str)
    assert counts == sorted(((i, len((t or "").encode()), len(lib.encode(t or "")), t == long) for i, t in rows), key=str)
    none = docs.where("doc_id > 99")
    assert encode_documents(none, path).count() == token_counts(none, path).count() == 0


def test_classifier(frame):
    rows = [(i, ("calm words here " if i % 2 else "BUY!!! $$$ ") * 20) for i in range(80)]
    docs = frame(rows)
    model = quality_fm.train(docs.select("text", (F.col("doc_id") % 2).cast("int").alias("y"), "doc_id"))
    odd = frame([(1, "calm words"), (1, "calm words"), (None, None), (None, ""), (3, "calm words here " * 100_000)]).withColumns({c: F.lit("s") for c in ("score", "y", "predicted")})
    got = quality_fm.score(odd.drop("score"), model, ["doc_id", "y"]).collect()
    by = {i: {r["score"] for r in got if r["doc_id"] == i} for i in (1, 3, None)}
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["y"] == "s" for r in got) and len(by[1]) == len(by[None]) == 1 and min(by[3]) > 0.5
    none = docs.where("doc_id < 0")
    assert quality_fm.train(none.select("text", F.lit(1).alias("y"), "doc_id")) is None
    assert quality_fm.score(none, model, ["doc_id"]).count() == 0


def test_leaks_of_odd_tables(frame, spark):
    text = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    item = text(1, 20)
    long = f"{text(2, 40000)} {item} {text(3, 40000)} {item}"
    rows = [(1, item), (1, item), (None, item), (5, long), (6, text(4, 30)), (7, None), (8, "")]
    docs = frame(rows).withColumns({c: F.lit("s") for c in ("item_id", "start", "size", "similarity", "h", "word", "near")})
    bench = spark.createDataFrame([(3, item), (3, item), (4, text(9, 700)), (5, None)], "item_id long, text string").withColumns({"size": F.lit(1), "doc_id": F.lit(2)})
    got = sorted(((r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.leaks(docs, bench).collect()), key=str)
    assert got == sorted([(1, 3, 0), (None, 3, 0), (5, 3, 40000)], key=str)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {6, 7, 8}
    assert decontaminate.clean(docs, bench.where("item_id < 0")).count() == len(rows)
    assert decontaminate.leaks(docs.where("doc_id > 99"), bench).count() == 0


def test_pages_with_clashing_columns(spark):
    rows = [(1, "http://h/a", "<article><p>One</article>"), (1, "http://h/a", "<article><p>One</article>"), (None, None, "<p>Two</p>"), (3, "http://h/b", "<article>" + "<p>line" * 20000 + "</article>")]
    pages = prepare(spark).createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("s") for c in ("text", "n_chars", "key", "pair", "zones", "hashes")})
    got = sorted(((r["page_id"], r["n_chars"]) for r in html_diff.extract(pages).collect()), key=str)
    assert got == sorted([(1, 3), (1, 3), (None, 3), (3, 20000 * 5 - 1)], key=str)


def test_pipeline_of_empty_tables(spark, tmp_path):
    empty = lambda ddl, name: prepare(spark).createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    empty("doc_id long, text string, lang string, source string, n_chars long", "documents")
    empty("item_id long, text string", "benchmark")
    empty("doc_id long, quality int, toxic int", "labels")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
