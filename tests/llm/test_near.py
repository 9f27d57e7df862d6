"""N-gram join, line dedup and decontamination against brute force, and their edge cases."""

import collections
import glob
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verba.llm import common, decontaminate, line_dedup, ngram_join


def grams(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else []))


def components(rows, k, num, den):
    sets = {i: grams(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            o = len(sets[a] & sets[b])
            if o and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n, group):
    """Random texts, a large group of edited copies, exact copies and short texts."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda m: [rnd.choice(vocab) for _ in range(m)]
    base = text(80)
    rows = []
    for _ in range(group):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append(" ".join(w))
    for _ in range(n):
        rows.append(" ".join(text(rnd.choice([1, 2, 3, 4, 5, 30, 90]))))
    rows += rnd.sample(rows, 20) + ["A B  c\tD e", "a b c d e", "a b", "A\nB", ""]
    return list(enumerate(rows))


def test_ngram_tasks_over_wide_rows_stay_apart(spark, frame, monkeypatch):
    """Rows that carry whole sets are multiplied in the tasks of their shuffle, not in one for each file of links."""
    tasks, own, kept = spark.sparkContext.accumulator(0), ngram_join._rows_by_blocks, {}
    keep = common.Scratch.keep

    def counted(num, den):
        run = own(num, den)

        def whole(batches):
            tasks.add(1)
            yield from run(batches)

        return whole

    def seen(self, df, name, *args, **more):
        out = keep(self, df, name, *args, **more)
        kept[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(ngram_join, "_rows_by_blocks", counted)
    monkeypatch.setattr(common.Scratch, "keep", seen)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words[i * 9 : i * 9 + 60], f"x{i // 2}" * (i % 2)])) for i in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(frame(rows), 4, 85, 100).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == components(rows, 4, 85, 100)
    assert tasks.value == 4 and kept["links"] <= 1 and kept["cells"] <= 1


def test_join_writes_its_tables_without_processes(frame, monkeypatch):
    """Spark's writer starts a process for each local file, which is counted with the executor's memory for a moment."""
    by_spark, write = [], DataFrame.write
    monkeypatch.setattr(DataFrame, "write", property(lambda df: by_spark.append(df.columns) or write.fget(df)))
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words[i * 9 : i * 9 + 60], f"x{i // 2}" * (i % 2)])) for i in range(20)] + [(20, ""), (21, None)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(frame(rows), 4, 85, 100).collect()}
    assert got == components(rows, 4, 85, 100) and not by_spark


def test_scratch_tables_of_workers(spark, monkeypatch):
    monkeypatch.setattr("verba.scratch.GROUP_BYTES", 64)
    scratch = common.Scratch(spark, "kept", workers=True)
    many = spark.range(0, 1000, 1, 5).selectExpr("id", "if(id % 3 = 0, null, array(id, -id)) a", "cast(cast(id as string) as binary) b", "cast(id as int) i", "if(id % 2 = 0, null, concat('\u00e9', id)) s", "named_struct('x', id / 7, 'y', id > 5) t")
    for df, n in ((many, 1000), (many.where("id < 0"), 0), (many.select("id", F.expr("date_add(date'2020-01-01', i)").alias("day")), 1000)):
        got = scratch.keep(df, "one", n, 400)  # again and again under one name
        assert got.dtypes == df.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, df.collect())) and len(got.inputFiles()) <= 3

    def broken(batches):
        yield from batches
        raise ValueError("broken task")

    with pytest.raises(Exception, match="broken task"):
        scratch.keep(many.select("id"), "two", made=(broken, "id long"))
    assert scratch.keep(many.select("id"), "two", made=(lambda batches: batches, "id long")).count() == 1000
    assert len(spark.read.parquet(f"{scratch.root}/two").inputFiles()) == 5


def test_join_against_brute_force(frame, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    rows = corpus(1, 120, 90)
    for k, num, den in ((4, 85, 100), (5, 80, 100)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(frame(rows), k, num, den).collect()}
        assert got == components(rows, k, num, den)


def test_join_edges(frame):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d e f"), (5, "a b c d e f"), (6, "A b c d e f"), (6, "A b c d e f")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(frame(rows), 4, 85, 100).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 3, None), (5, 3, 5), (6, 3, 5), (6, 3, 5)], key=str)
    assert ngram_join.ngram_components(frame(rows).where("doc_id > 99"), 4, 85, 100).count() == 0


def test_join_of_one_id_with_two_texts(frame):
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    a, b = words("a", 60), words("b", 90)
    rows = [(5, a), (5, b), (7, a + " q"), (9, b + " q"), (11, words("c", 20)), (12, "z" * 5000 + " " + words("d", 40000)), (13, words("d", 40000))]
    docs = frame(rows).withColumns({c: F.lit("x") for c in ("cid", "n", "fp1", "id", "component_id", "s")})
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_components(docs, 4, 85, 100).collect())
    assert got == [(5, 5), (5, 5), (7, 5), (9, 5), (11, 11), (12, 12), (13, 12)]


def test_columns_over_batches():
    rnd = random.Random(4)
    posts = sorted((rnd.choice([1, 2, 3, 4, 5, 6] + [7] * 8 + [8] * 3), i) for i in range(150))
    rows = pa.RecordBatch.from_pydict({"s": pa.array([s for s, _ in posts]), "cid": pa.array([i for _, i in posts]), "n": pa.array([10] * len(posts)), "pos": pa.array([0] * len(posts), pa.int32())})
    size = collections.Counter(s for s, _ in posts)
    want_long = {(i, s) for s, i in posts if size[s] > ngram_join.SHORT}
    want = {(a, b) for s, a in posts for t, b in posts if s == t and a < b and size[s] <= ngram_join.SHORT}
    assert want and want_long
    for step in (1, 7, 40, 200):
        out = [r for b in ngram_join._columns(85, 100)(rows.slice(i, step) for i in range(0, len(posts), step)) for r in b.to_pylist()]
        assert sorted((r["cid"], r["other"]) for r in out if r["other"] is not None) == sorted(want)
        assert sorted((r["cid"], r["s"]) for r in out if r["other"] is None) == sorted(want_long)


def test_bitmaps_bound_the_difference(spark):
    rnd = np.random.default_rng(5)
    rows = []
    for n in (1, 30, 64, 65, 200, 1000):
        a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        for cut, add in ((0, 0), (n // 10, n // 10), (n // 3, 0), (0, n // 2)):
            b = np.unique(np.concatenate([a[cut:], rnd.integers(0, 1 << 63, add + (cut == n)).astype(np.uint64)]))
            rows.append((ngram_join.bitmap(a).tolist(), ngram_join.bitmap(b).tolist(), len(np.setxor1d(a, b))))
    got = spark.createDataFrame(rows, "ma array<long>, mb array<long>, d long").selectExpr("d", f"{ngram_join.DIFFER} as x").collect()
    assert all(r["x"] <= r["d"] for r in got) and sum(r["x"] > r["d"] / 3 for r in got) > 12


def test_blocks():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 60, 30).astype(np.uint64)) for _ in range(12)]
    a, b = (ngram_join.unpack(ngram_join.pack(list(range(lo, lo + 6)), sets[lo : lo + 6])) for lo in (0, 6))
    got = ngram_join.overlaps(a, b, False, step=7)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[6 + j])) for i in range(6) for j in range(6))
    link = np.array([[1, 1, 0], [0, 1, 0], [0, 0, 1]], bool)
    edges = ngram_join.forest(link, np.array([0, 1, 2]), np.array([10, 11, 12]))
    assert {frozenset(e) for e in edges} == {frozenset(x) for x in ((0, 10), (0, 11), (1, 11), (2, 12))}


def without_copies(rows, least):
    seen, out = set(), []
    for i, t in sorted(rows):
        lines = [(n, x) for n, x in enumerate(t.split("\n")) if x.strip()]
        gone = set()
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b][1].split())
                if n >= least:
                    run = tuple(x for _, x in lines[a : b + 1])
                    if run in seen:
                        gone |= {n for n, _ in lines[a : b + 1]}
                    seen.add(run)
        for (x, _), (y, _) in zip(lines, lines[1:], strict=False):
            if x in gone and y in gone:
                gone |= set(range(x, y))
        out.append((i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)))
    return dict(out)


def test_lines_against_brute_force(frame):
    rnd = random.Random(5)
    pool = [" ".join(f"p{i}w{j}" for j in range(rnd.choice([1, 2, 3, 6]))) for i in range(12)]
    rows = [(i, "\n".join(rnd.choice([*pool, "", f"own {i} {j}"]) for j in range(rnd.randrange(1, 25)))) for i in range(60)]
    for least in (1, 4, 9):
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(rows), least).collect()}
        assert got == without_copies(rows, least)


def test_lines_edges(frame):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\n{long}"), (2, f"{long}\n\nb"), (3, None), (4, ""), (None, long), (5, f"{long}\n{long}"), (6, "own"), (6, "own")]
    out = line_dedup.dedup_lines(frame(rows).withColumn("gone", F.lit(7)).withColumn("th", F.lit("x")), 50)
    got = sorted(((r["doc_id"], r["text"], r["removed"]) for r in out.collect()), key=str)
    assert got == sorted([(1, f"a\n{long}", 0), (2, "\nb", 1), (3, None, 0), (4, "", 0), (None, "", 1), (5, "", 2), (6, "own", 0), (6, "own", 0)], key=str)
    assert "gone" in out.columns and out.where("gone = 7").count() == 8
    assert line_dedup.dedup_lines(frame(rows).where("doc_id > 99")).count() == 0


def test_line_dedup_starts_few_files(spark, frame, monkeypatch):
    rows = [(i, f"{' '.join(f'w{i % 5}_{j}' for j in range(60))}\nend {i}") for i in range(40)]
    made = lambda root: len(glob.glob(f"{root.removeprefix('file:').replace('//', '/')}/lines/part-*"))
    found = []
    for size in (common.TASK_BYTES, 4000):
        monkeypatch.setattr(common, "TASK_BYTES", size)
        scratch = common.Scratch(spark, "few")
        gone = sorted(tuple(r) for r in line_dedup.repeated_runs(frame(rows, 12), scratch).select("did", "lo", "hi").distinct().collect())
        found.append((made(scratch.root), gone))
    assert found[0][0] == 1 and 2 <= found[1][0] <= 12
    assert found[0][1] == found[1][1] == [(i, 0, 0) for i in range(5, 40)]


def test_lines_that_many_documents_share(frame, monkeypatch):
    monkeypatch.setattr(common, "HOT", 8)
    rnd = random.Random(9)
    shared = [" ".join(f"s{i}w{j}" for j in range(7)) for i in range(3)]
    rows = [(i, "\n".join([f"own {i}", *(shared if i % 3 else shared[:2]), *rnd.sample(shared, rnd.randrange(3))])) for i in range(90)]
    rows += [(200, "\n".join(["again " * 25] * 5)), (201, "\n".join(f"line {j} of one very long text" for j in range(30000)))]
    for least in (7, 14, 50):
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(rows), least).collect()}
        few = [r for r in rows if r[0] < 201]
        assert got == without_copies(few, least) | {201: rows[-1][1]}
    assert got[200] == "again " * 25


def test_dealt_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 8)
    keys = [1] * 60 + [2] * 25 + list(range(3, 20)) + [30]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    side = spark.createDataFrame([(k, f"v{k}", keys.count(k)) for k in set(keys) - {30}], "k long, v string, c long")
    got = sorted(tuple(r) for r in common.dealt_join(rows, side, ["k"], len(keys), ["i"]).select("k", "i", "v").collect())
    assert got == sorted((k, i, f"v{k}") for i, k in enumerate(keys) if k != 30)


def leaked(docs, items, least=0.8):
    words = lambda t: [x for x in regex.sub(r"[^\p{L}\p{N}]+", " ", (t or "").lower()).split(" ") if x]
    bag = lambda w: collections.Counter([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])
    out = {}
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            if not v or not w:
                continue
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = bag(w[s : s + len(v)]), bag(v)
                m = sum((a & b).values())
                sim = m / (sum(a.values()) + sum(b.values()) - m)
                if sim >= least and sim > out.get((d, i), (0, 0))[0] + 1e-12:
                    out[d, i] = (sim, s)
    return out


def test_leaks_against_brute_force(frame, spark):
    rnd = random.Random(8)
    vocab = ["the", "of", "and", *(f"word{i}" for i in range(150))]
    make = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(make(rnd.choice([2, 4, 6, 12, 30, 60])))) for i in range(12)] + [(90, ""), (91, None)]
    docs = []
    for i, t in items[:12]:
        w = t.split()
        y = list(w)
        y[len(y) // 2] = "zzz"
        docs += [(10 * i, " ".join([*make(9), *w, *make(7)])), (10 * i + 1, t.upper() + "!!"), (10 * i + 2, " ".join([*make(3), *y, *make(30)])), (10 * i + 3, " ".join(w[1:])), (10 * i + 4, " ".join(make(40)))]
    docs += [(500, None), (501, ""), (502, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in decontaminate.leaks(frame(docs), bench).collect()}
    want = leaked(docs, items)
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    kept = {r["doc_id"] for r in decontaminate.clean(frame(docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.leaks(frame(docs), bench.where("item_id < 0")).count() == 0


def test_leaks_of_items_without_id(frame, spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    docs = [(1, "before " + text(1)), (2, text(2)), (3, text(3)), (4, "other words")]
    bench = spark.createDataFrame([(None, text(1)), (None, text(2)), (7, text(3))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.leaks(frame(docs), bench).collect()}
    assert got == {(1, None, 1), (2, None, 0), (3, 7, 0)}
    assert {r["doc_id"] for r in decontaminate.clean(frame(docs), bench).collect()} == {4}
