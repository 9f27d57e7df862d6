"""HTML, URLs, pieces, token counts, classifier, search and archive."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verba.llm import html_diff, quality_fm, topk, url_gbt, warc
from verba.runtime import prepare

MODEL = "piece_bpe_32k.model"
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def lib():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public.path(MODEL))


def odd_texts():
    rnd = random.Random(3)
    fixed = ["", " ", "  ", "\n", "\n\n", "a\n", "\na", " a ", "a  b", "a \n b", "▁", "x▁▁y", "<s>", "<unk> </s>", "<0x0A>", "\t", "\r\n", "é́", "日本語", "😀😀", "a" * 300, " " * 40, "();\r\n{\r", "\x00", "ﬁ　x"]
    return fixed + ["".join(rnd.choice("ab \n▁.é😀\r\t0th eing") for _ in range(rnd.randint(1, 50))) for _ in range(600)]


def test_pieces(lib, frame):
    from verba.llm.sentencepiece_fst import compiled, decode_documents, encode_documents

    t = compiled(public.path(MODEL))
    for x in odd_texts():
        ids = lib.encode(x)
        assert t.encode(x).tolist() == ids, x
        assert t.decode(ids) == lib.decode(ids), x
    assert [t.weights.name(x) for x in t.shortest("▁nothing")] == lib.encode("nothing", out_type=str)
    docs = frame([(1, "to be"), (2, None), (3, ""), (None, "x"), (1, "to be")])
    enc = encode_documents(docs, public.path(MODEL))
    got = sorted(((r["doc_id"], r["ids"], r["n_tokens"]) for r in enc.collect()), key=str)
    assert got == sorted([(1, lib.encode("to be"), 2), (2, [], 0), (3, [], 0), (None, lib.encode("x"), 1), (1, lib.encode("to be"), 2)], key=str)
    assert {r["text"] for r in decode_documents(enc, public.path(MODEL)).collect()} == {"to be", "", "x"}


def test_known_ends_of_words_are_not_searched_again(lib, monkeypatch):
    from verba.llm import sentencepiece_fst

    t = sentencepiece_fst.Transducer(sentencepiece_fst.piece_model.load(public.path(MODEL)))
    walks, arcs = [], t.pieces.arcs
    monkeypatch.setattr(t.pieces, "arcs", lambda text: walks.append(text) or arcs(text))
    starts = ["brandish", "unheard", "schein", "ñandú", "zuü", "x7", "日", "Q"]
    texts = [f"{a}{b}{c}" for a in starts for b in ("thoushreer", "ciónqueueb", "einstkeitw") for c in ("", ".", "&&&", ",***", "é", "9", " " * 3, "_" * 40)]
    for x in texts:
        assert t.encode(x).tolist() == lib.encode(x), x
    assert len(walks) < 4 * len(texts)
    mixed = [*texts, *odd_texts(), "", *texts[:20], "z" * 500 + "thoushreer&&&"]
    for group, ends, most in ((1, 2, 3), (7, 1 << 16, 5), (1 << 18, 5, 1 << 17)):
        monkeypatch.setattr(sentencepiece_fst, "GROUP", group)
        monkeypatch.setattr(sentencepiece_fst, "ENDS", ends)
        monkeypatch.setattr(sentencepiece_fst.Memo, "MOST", most)
        t.forget()
        for x in mixed:
            assert t.encode(x).tolist() == lib.encode(x), x


def test_rows_of_pieces_are_written_in_parts(lib, monkeypatch):
    from verba.llm import sentencepiece_fst

    monkeypatch.setattr(sentencepiece_fst, "HELD", 30)
    texts = [None, "", "to be or not", *odd_texts(), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    out = list(sentencepiece_fst._run(public.path(MODEL), True)(iter([batch.slice(0, 0), batch])))
    rows = pa.Table.from_batches(out).to_pylist()
    assert len(out) > 10 and [r["id"] for r in rows] == list(range(len(texts)))
    assert [r["ids"] for r in rows] == [lib.encode(x or "") for x in texts] and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert [r["decoded"] for r in rows] == [lib.decode(r["ids"]) for r in rows]


def test_counts(lib, frame):
    from verba.llm.token_counts import compiled, token_counts

    c = compiled(public.path(MODEL))
    assert len(c.proved) > 1000 and all(len(lib.encode(w)) == 1 for w in list(c.proved)[:300])
    for x in odd_texts():
        assert c.count(x) == len(lib.encode(x)), x
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(frame([(1, "é to"), (2, None), (None, "")]), public.path(MODEL), limit=1).collect()), key=str)
    assert got == sorted([(1, 5, len(lib.encode("é to")), True), (2, 0, 0, False), (None, 0, 0, False)], key=str)


def test_counts_of_many_texts_take_few_calls(lib, monkeypatch):
    from verba.llm import token_counts

    class Watched:
        calls = 0

        def encode(self, *a, **b):
            Watched.calls += 1
            return lib.encode(*a, **b)

    c = token_counts.Counter(public.path(MODEL))
    c.lib = Watched()
    texts = [f"brandish{i}ly to unheard{i}\nof{i} x{i}" for i in range(300)]
    assert c.counts(texts) == [len(lib.encode(t)) for t in texts] and Watched.calls < 10
    mixed = [None, "", *odd_texts(), *texts[:20], *odd_texts()]
    for group in (1, 7, 1 << 18):
        monkeypatch.setattr(token_counts, "GROUP", group)
        c.forget()
        assert c.counts(iter(mixed)) == [len(lib.encode(t or "")) for t in mixed]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<body><nav>x</nav><article><h1>T &amp; U</h1><p>a\n b<br>c<p>d<div class=ad>no</div></article><footer>f</footer>", "T & U\na b c\nd"),
        ("<main><p>hi<section class='comments'><p>c</p></section><form>f</form><p>end</main>", "hi\nend"),
        ("<article><header><h1>T</h1></header><p>A<script>if(a<b){'<p>'}</script><style>p{}</style></p><aside>s</aside></article>", "T\nA"),
        ("<p>1 < 2 &lt; 3</p>", "1 < 2 < 3"),
        (None, ""),
        ("", ""),
    ],
)
def test_markup(page, want):
    own = [x for x in html_diff.lines(page) if x[0] != html_diff.FURNITURE]
    assert html_diff.main_text([z for z, _ in own], [t for _, t in own], [hash(t) for _, t in own], None) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><p>A</p><script>for(i=0;i<n;i++){x(i)}</script><p>B</p></article>", "A\nB"),
        ("<article><p>A</p><STYLE>a{content:'<b'}</STYLE ><p>B</p><script>if(a<b)'</p>'", "A\nB"),
        ("<head><title>the <script> element</title></head><article>A<script src='x'/>B</article>", "AB"),
        ("<article><a href=x title=it's>A</a> and it's B</article>", "A and it's B"),
        ("<form id=aspnetForm><p>top</p><article><p>A<form>in</form></article></form>", "A"),
        ("<article><section id='related-work'><h2>Related work</h2></section><div class='side-by-side'>B</div><div class='share-buttons'>s</div><div class=cookieBanner>c</div></article>", "Related work\nB"),
        ("<article>A<ul class='related-posts'><li>r</ul><p data-id=\"ad\">B<p title='a > b'>C</article>", "A\nB\nC"),
        ("<div class='layout has-sidebar'><nav>n</nav><article><p>A<p>B</article><div class='sidebar'>s</div></div>", "A\nB"),
        ("<div id='search-results'>x<div role='main'>A</div></div>", "A"),
        ("<article>A<section class='comments'><article>c</article></section></article><div class='related'><article>r</article></div>", "A"),
        ("<div class='has-sidebar'><main>A</main><div class='related'><article>r</article></div></div><aside><article>s</article></aside>", "A"),
    ],
)
def test_raw_text_and_marked_wrappers(page, want):
    own = [x for x in html_diff.lines(page) if x[0] != html_diff.FURNITURE]
    assert html_diff.main_text([z for z, _ in own], [t for _, t in own], [hash(t) for _, t in own], None) == want


def test_common_lines():
    rnd = random.Random(1)

    def longest(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    for _ in range(300):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(9))] for _ in range(2))
        hit = html_diff.shared(a, b)
        assert hit.sum() == longest(a, b)
        it = iter(b)
        assert all(x in it for x, h in zip(a, hit, strict=True) if h)


def test_common_lines_of_long_pages(monkeypatch):
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(0, 30, 900).tolist(), rnd.integers(0, 30, 700).tolist()
    whole = html_diff.shared(a, b)
    monkeypatch.setattr(html_diff, "CELLS", 500)
    halves = html_diff.shared(a, b)
    it = iter(b)
    assert whole.sum() == halves.sum() and all(x in it for x, h in zip(a, halves, strict=True) if h)


def test_common_start(spark):
    rows = [("/a/b", "/a/c"), ("/a", "/a"), ("", "/x"), ("/abc", "/ab"), ("x", "y")]
    got = spark.createDataFrame(rows, "a string, b string").select(html_diff.common_start(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r["n"] for r in got] == [3, 2, 0, 3, 0]


def test_difference(spark):
    open_page = lambda body: f"<div>Top links</div><p>{body}</p><div>All rights reserved</div>"
    rows = [(i, f"http://h.org/a/{i}", open_page(f"Text {i}")) for i in range(6)] + [(10, "http://alone.org/x", open_page("One")), (11, None, None), (12, "http://c.org/1", open_page("Same")), (13, "http://c.org/2", open_page("Same")), (None, "http://h.org/a/9", open_page("N"))]
    pages = prepare(spark).createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_diff.extract(pages).collect()}
    assert all(got[i] == (f"Text {i}", 6) for i in range(6))
    assert got[10][0] == "Top links\nOne\nAll rights reserved" and got[11] == ("", 0)
    assert got[12][0] == got[13][0] == "Top links\nSame\nAll rights reserved"
    assert html_diff.extract(pages.where("page_id > 99")).count() == 0


def test_every_page_is_differenced(spark):
    """Differencing acts on pages with an article too; the check then keeps the article whole and nothing else."""
    page = lambda i, body: f"<nav><p>Home</p><p>Offer {i}</p></nav><article><p>Quoted line</p><p>{body}</p></article><footer>Imprint</footer>"
    plain = lambda i: f"<nav><p>Menu {i}</p></nav><p>Same</p><aside><p>Text 1</p></aside>"
    rows = [(i, f"http://h.org/a/{i}", page(i, f"Text {i}")) for i in range(4)] + [(7, "http://h.net/1", plain(1)), (8, "http://h.net/2", plain(2)), (9, "http://h.net/3", "<p>Text 1</p><p>Own</p>"), (10, "http://one.org/", page(1, "x"))]
    pages = prepare(spark).createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: (r["text"], r["n_shared"]) for r in html_diff.extract(pages).collect()}
    # shared: Home, Quoted line, Imprint
    assert all(got[i] == (f"Quoted line\nText {i}", 3) for i in range(4))
    # copies beside their furniture keep their lines, and furniture deletes no line but furniture
    assert got[7] == got[8] == ("Same", 1) and got[9] == ("Text 1\nOwn", 0) and got[10] == ("Quoted line\nx", 0)


def test_urls(spark):
    rows = [(1, "HTTP://A.Net/x?y"), (2, "https://sub.example.net/en/1"), (3, "http://example.net/de/"), (4, "http://x.example.com/de/a#b"), (5, "http://example.com/en/"), (6, "http://a.org/fr/1"), (7, "http://net"), (8, None), (9, "no scheme"), (10, "http://notnet/x"), (11, "http://h?u=http://net/")]
    rows += [(100 + i, f"http://{'spam' if i % 2 else 'good'}{i}.{'net' if i % 2 else 'org'}/{'x' if i % 2 else 'fr'}/{i}") for i in range(200)]
    got = {r["page_id"]: r for r in url_gbt.judge(prepare(spark).createDataFrame(rows, "page_id long, url string"), rounds=3).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)] == [
        ("a.net", "/x", "net/"), ("sub.example.net", "/en/1", "example.net/en/"), ("example.net", "/de/", "net/"), ("x.example.com", "/de/a", "example.com/de/"), ("example.com", "/en/", None),
        ("a.org", "/fr/1", "org/fr/"), ("net", "", None), ("", "", None), ("", "", None), ("notnet", "/x", None), ("h", "", None),
    ]
    assert [got[i]["verdict"] for i in (1, 2, 3, 4, 6)] == ["block", "allow", "block", "block", "allow"]
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"}
    labelled = [r for i, r in got.items() if i >= 100]
    assert np.mean([(r["score"] >= 0.5) == (r["rule"] == "net/") for r in labelled]) > 0.95
    assert url_gbt.judge(prepare(spark).createDataFrame([(1, None)], "page_id long, url string")).first()["verdict"] == "allow"


def test_machine(frame):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice(["river", "stone", "cloud", "house", "light"]) + rnd.choice(["", ".", ","]) for _ in range(rnd.randrange(20, 60)))
    junk = lambda: " ".join(rnd.choice(["BUY", "NOW", "FREE"]) + rnd.choice(["!!!", "$$$"]) for _ in range(rnd.randrange(20, 60)))
    rows = [(i, junk() if i % 3 == 0 else good()) for i in range(240)]
    docs = frame(rows)
    m = quality_fm.train(docs.where("doc_id < 160").select("text", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("y")))
    s = {r["doc_id"]: r["score"] for r in quality_fm.score(docs, m, ["doc_id"]).collect()}
    assert all(0 <= x <= 1 for x in s.values()) and np.mean([(s[i] >= 0.5) == (i % 3 != 0) for i in range(160, 240)]) > 0.97
    x = quality_fm.rows_of(pa.array(["a b a", "", None]), quality_fm.BUCKETS)
    dense = np.zeros((3, len(m.w)))
    for i in range(3):
        dense[i, x[1][x[0][i] : x[0][i + 1]]] = x[2][x[0][i] : x[0][i + 1]]
    dense[:, quality_fm.BUCKETS :] = m.scaled(x[3])
    pairs = [m.w0 + d @ m.w + sum((m.v[i] @ m.v[j]) * d[i] * d[j] for n, i in enumerate(np.flatnonzero(d)) for j in np.flatnonzero(d)[n + 1 :]) for d in dense]
    assert np.allclose(m.margin(*x), pairs)
    assert quality_fm.train(docs.select("text", F.lit(1).alias("y"))) is None
    assert {r["score"] for r in quality_fm.score(frame([(1, None), (2, "")]), None, ["doc_id"]).collect()} == {0.5}


def test_sample_with_copies(frame):
    rows = frame([(i, "one text") for i in range(300)] + [(1000 + i, f"text {i}") for i in range(300)]).select("text", F.lit(1.0).alias("y"), "doc_id")
    for by in (["text"], ["text", "doc_id"]):
        for most in (1, 100, 350, 600, 700):
            got = quality_fm.sample(rows, most, *by).collect()
            assert len(got) == min(most, 600)
    ids = {r["doc_id"] for r in quality_fm.sample(rows, 200, "text", "doc_id").collect()}
    assert len(ids) == 200 and 60 < sum(i < 300 for i in ids) < 140


def test_search(spark):
    rng = np.random.default_rng(4)
    vecs = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 12)]) for i in range(0, 700, 7)]
    vecs += [(800, [1.0] * 12), (801, [1.0] * 12), (900, None), (901, [float("nan")] * 12), (902, [None] * 12), (903, []), (1000, [0.5, 0.5]), (1001, [2.0, -1.0]), (None, [1.0] * 12)]
    df = prepare(spark).createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 100 = 0"), k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in vecs if i is not None and v and None not in v and np.isfinite(v).all()}
    for q in (i for i in good if i % 100 == 0):
        best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:10]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert 900 not in got


def test_search_with_large_components_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 200)
    monkeypatch.setattr(topk, "QUERIES", 1)
    rnd = np.random.default_rng(6)
    vecs = [(i, [float(x) for x in rnd.choice([-1, 1], 8) * 10.0 ** rnd.integers(0, 9, 8)]) for i in range(0, 600, 4)]
    vecs += [(1000, [2e6] * 8), (1001, [2e6] * 8), (1002, [3e6] + [0.0] * 7), (1100, [-1.0, *[0.0] * 7])]
    df = prepare(spark).createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(3).withColumns({c: F.lit(1) for c in ("dim", "qb", "id", "rank")})
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 100 = 0"), k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in vecs}
    for q in (i for i in whole if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:10]
        assert sorted(got[q]) == [(n, i, max(-topk.LONG - 1, min(topk.LONG, -s))) for n, (s, i) in enumerate(best, 1)]
    assert topk.top_k(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0


def test_bounds():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-900, 900, (20, 64)), rng.integers(-900, 900, (30, 64))
    exact = a @ b.T
    for s in topk.LEVELS:
        assert (topk.statistics(a, s) @ topk.statistics(b, s).T >= exact - 1e-6).all()


def test_archive(spark, tmp_path):
    big = "x" * 120
    rows = [(3, "http://a/3", big), (1, "http://a/1", big), (2, None, "small"), (4, "u\r\nv", "small"), (5, "u", None), (6, "u", ""), (7, "u", "tail\r\n\r\nWARC/1.1\r\n" + "é" * 60), (None, "n", big), (1, "http://a/1", big), (8, "u", "y" * 3_000_000)]
    pages = prepare(spark).createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("c") for c in ("key", "payload", "sum", "head", "first", "digest")})
    warc.write_files(pages, f"file://{tmp_path}/files")
    warc.ingest(spark, f"file://{tmp_path}/files", f"file://{tmp_path}/arc")
    records = warc.rebuilt(spark, f"file://{tmp_path}/arc")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.described(records).collect()), key=str)
    tail = len(rows[6][2].encode())
    assert got == sorted([(1, 120, "response", None), (1, 120, "response", None), (3, 120, "revisit", 1), (2, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (6, 0, "response", None), (7, tail, "response", None), (8, 3_000_000, "response", None), (None, 120, "response", None)], key=str)
    assert spark.read.parquet(f"file://{tmp_path}/arc/payloads").count() == 5
    # the rebuilt records are the files' bytes
    import gzip

    whole = b"".join(sorted(bytes(r["record"]) for r in records.collect()))
    files = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "files").glob("part-*")]
    assert whole == b"".join(sorted(h + p + b"\r\n\r\n" for data in files for h, p in warc.parse_records(data, piece=7)))
    assert sum(map(len, files)) == len(whole)
    text = {bytes(r["payload"]).decode() for r in records.collect()}
    assert text == {x or "" for _, _, x in rows}
    empty = pages.where("page_id > 99")
    warc.write_files(empty, f"file://{tmp_path}/none")
    warc.ingest(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/arc0")
    assert warc.described(warc.rebuilt(spark, f"file://{tmp_path}/arc0")).count() == 0


def test_damaged_files():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert list(warc.parse_records(good + good, piece=5)) == [(good[:-4], b"")] * 2
    for bad in (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab", good[:-1], b"x" + good, b"WARC/1.1\r\nA: b\r\n\r\n", good.replace(b"2", b"1")):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))


def test_archive_finds_changed_payloads(spark, tmp_path):
    pages = prepare(spark).createDataFrame([(1, "u", "payload")], "page_id long, url string, html string")
    warc.write_files(pages, f"file://{tmp_path}/files")
    import gzip

    (part,) = (tmp_path / "files").glob("part-*")
    part.write_bytes(gzip.compress(gzip.decompress(part.read_bytes()).replace(b"payload", b"paYload")))
    (tmp_path / "files" / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="digest"):
        warc.ingest(spark, f"file://{tmp_path}/files", f"file://{tmp_path}/arc")
