"""Benchmark decontamination with SimHash over item-sized windows.

Only DataFrame and SQL expressions are used.  Texts are lower-cased and cut at
everything that is no letter or digit.  A window is as many words as an item has
(the whole text, if that is shorter); its shingles are its runs of five words
(the whole window, if that is shorter), weighted by how often they occur.  A
document leaks an item if one of its windows has a weighted shingle similarity
(sum of minima over sum of maxima) of at least ``least``.

1. *Anchors.*  A window that is similar enough lacks less than a fifth of an
   item's shingles.  So of each item a few far-apart positions are taken whose
   shingles together are more than a fifth; at least one of these shingles must be
   in the window.  The anchor words (the longest near each position) are joined
   to the words of all texts inside generated code, and only windows around a
   shared anchor shingle go on: the others cannot reach the similarity.
2. *SimHash.*  Distinct windows get a 64-bit weighted SimHash.
3. *Multi-index.*  Fingerprints are cut into ``64 / BITS`` blocks.  If two differ
   in at most ``RADIUS`` bits, some block differs in at most ``RADIUS // blocks``
   bits, so an equi-join of blocks with all such near values of the items' blocks
   finds every pair within the radius.
4. *Verification* of the exact weighted similarity for pairs within the radius.

At similarity 0.8 about 10 bits differ, with a deviation of 3; the radius is
beyond four deviations.  Item tables are broadcast only within a counted bound.

Defined results: null or empty texts and items have no words and leak nothing;
items that repeat (id and text) count once; of an item's equal windows the first
is reported.  Very long texts are searched whole, and a long item widens the windows
of its own anchor words only; empty tables leak nothing.  Documents with a null id are reported under null, as are items with a
null id; repeated rows once.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verba.llm.common import Scratch, light, small

#: Words of a shingle, least similarity.
SHINGLE, LEAST = 5, 0.8
#: Bits of a block and radius of the search.
BITS, RADIUS = 8, 23
BLOCKS = 64 // BITS
#: Documents whose share of a scratch table fills a file.
PER_FILE = 5000


def words(col: str) -> str:
    clean = rf"trim(regexp_replace(lower({col}), '[^\\p{{L}}\\p{{N}}]+', ' '))"
    return f"case when {col} is null or {clean} = '' then cast(array() as array<string>) else split({clean}, ' ') end"


def shingles(w: str, k: int = SHINGLE) -> str:
    """Hashes of a word array's shingles."""
    return f"case when size({w}) = 0 then cast(array() as array<bigint>) when size({w}) < {k} then array(xxhash64({w})) else transform(sequence(0, size({w}) - {k}), i -> xxhash64(slice({w}, i + 1, {k}))) end"


def simhash(h: str) -> str:
    bit = f"aggregate({h}, 0, (a, x) -> a + if(shiftright(x, b) & 1L = 1L, 1, -1)) > 0"
    return f"aggregate(transform(sequence(0, 63), b -> if({bit}, shiftleft(1L, b), 0L)), 0L, (a, x) -> a | x)"


def similarity(a: str, b: str) -> str:
    """Weighted similarity of two arrays of hashes."""
    both = f"aggregate(array_distinct({a}), 0, (s, x) -> s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    return f"{both} / cast(size({a}) + size({b}) - {both} as double)"


def prepared(benchmark: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(item_key, item_id, size, iw, n, item) with words and shingle hashes; the key is never null and tells items of one id apart."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = items.select("item_id", F.expr(words("text")).alias("iw")).where("size(iw) > 0").distinct()
    return items.select(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "iw").alias("item_key"), "item_id", "iw", F.size("iw").alias("size"), F.greatest(F.size("iw") - (k - 1), F.lit(1)).alias("n"), F.expr(shingles("iw", k)).alias("item"))


def anchors(items: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(word, size, near): anchor words, the window size and the shingles around the anchor."""
    segs = items.withColumn("parts", F.expr(f"cast(floor(n / {k * k}) as int) + 1")).withColumn("wide", F.expr("cast(floor(n / parts) as int)"))
    segs = segs.select("iw", "size", "n", "item", "wide", F.explode(F.expr("sequence(0, parts - 1)")).alias("seg"))
    segs = segs.withColumns(
        {"lo": F.expr(f"if(n < {k}, 0, {k - 1} + seg * wide)"), "hi": F.expr(f"if(n < {k}, size - 1, {k - 1} + seg * wide + wide - {k})")}
    )
    best = segs.withColumn("best", F.expr("array_max(transform(sequence(lo, greatest(lo, hi)), p -> struct(length(iw[p]) as l, -p as q, iw[p] as word)))"))
    near = best.select(F.col("best.word").alias("word"), "size", "n", "item", (-F.col("best.q")).alias("p"))
    return near.select("word", "size", F.expr(f"slice(item, greatest(0, p - {k - 1}) + 1, least(p, n - 1) - greatest(0, p - {k - 1}) + 1)").alias("near")).distinct()


def find_windows(docs: DataFrame, total: int, anchor: DataFrame, scratch: Scratch, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, size, h): windows around a shared anchor shingle and their shingle hashes.

    The words of all texts meet the anchor words without carrying their text
    along.  Texts with a hit are then read once more, and each hit gets the words
    around it, at most twice those of the largest item that its word anchors.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    text = text.withColumns({"own": F.coalesce("doc_id", F.lit(-(1 << 63))), "th": F.xxhash64("text")})
    names = light(scratch.keep(anchor.groupBy("word").agg((F.max("size") - 1).alias("reach")), "words", total, PER_FILE), "64 + octet_length(word)")
    hits = text.select("own", "th", F.posexplode(F.expr(words("text"))).alias("pos", "word")).join(names, "word")
    hits = scratch.keep(hits.groupBy("own", "th").agg(F.collect_set(F.struct("pos", "word", "reach")).alias("hits")), "hits", total, PER_FILE)
    rows = text.join(light(hits, "64 + 64 * size(hits)"), ["own", "th"]).select("doc_id", "hits", F.expr(words("text")).alias("w"))
    base = "greatest(0, x.pos - x.reach)"
    region = f"struct(x.pos as pos, x.word as word, {base} as base, slice(w, {base} + 1, 2 * x.reach + 1 + least(0, x.pos - x.reach)) as part)"
    rows = rows.select("doc_id", F.size("w").alias("n"), F.inline(F.expr(f"transform(hits, x -> {region})")))
    rows = rows.join(light(anchor, "64 + octet_length(word) + 8 * size(near)"), "word")
    around = f"slice(part, greatest(0, pos - base - {k - 1}) + 1, {2 * k - 1} + least(0, pos - base - {k - 1}))"
    rows = rows.where(f"size < {k} or arrays_overlap(near, {shingles(around, k)})")
    rows = rows.select("doc_id", "size", "base", "part", F.explode(F.expr("if(n <= size, array(0), sequence(greatest(0, pos - size + 1), least(pos, n - size)))")).alias("start"))
    rows = rows.select("doc_id", "start", "size", F.expr("slice(part, start - base + 1, size)").alias("part")).distinct()
    return rows.select("doc_id", "start", "size", F.expr(shingles("part", k)).alias("h"))


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start): the best window of each item that a document leaks."""
    scratch = Scratch(docs.sparkSession, "leaks")
    n_items = benchmark.count()
    items = scratch.keep(prepared(benchmark, k).withColumn("fp", F.expr(simhash("item"))), "items", n_items, PER_FILE)
    total = docs.count()
    wins = find_windows(docs, total, scratch.keep(anchors(items, k), "anchors", n_items, PER_FILE), scratch, k, id_col, text_col)
    wins = scratch.keep(wins.withColumn("key", F.expr("xxhash64(h, size)")), "windows", total, PER_FILE)
    texts = scratch.keep(wins.groupBy("size", "key").agg(F.any_value("h").alias("h")).withColumn("wfp", F.expr(simhash("h"))), "texts", total, PER_FILE)

    block = lambda fp: F.expr(f"transform(sequence(0, {BLOCKS - 1}), j -> struct(j, cast(shiftright({fp}, j * {BITS}) & {(1 << BITS) - 1} as int) as v))")
    own = items.select("item_key", "size", "fp", F.inline(block("fp")))
    own = own.select("item_key", "size", "fp", "j", F.explode(F.expr(f"filter(sequence(0, {(1 << BITS) - 1}), u -> bit_count(u ^ v) <= {RADIUS // BLOCKS})")).alias("v"))
    seen = texts.select("size", "key", "h", "wfp", F.inline(block("wfp")))
    near = seen.join(light(own.select("item_key", "size", "fp", "j", "v"), "64"), ["size", "j", "v"]).where(f"bit_count(wfp ^ fp) <= {RADIUS}")
    near = near.groupBy("size", "key", "item_key").agg(F.any_value("h").alias("h"))
    found = near.join(light(items.select("item_key", "item_id", "size", "item"), "64 + 8 * size(item)"), ["item_key", "size"]).withColumn("similarity", F.expr(similarity("h", "item")))
    found = scratch.keep(found.where(F.col("similarity") >= least).select("size", "key", "item_id", "similarity"), "found", total, PER_FILE)
    hit = wins.select("doc_id", "start", "size", "key").join(small(found)[0], ["size", "key"])
    best = hit.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("long").alias("start"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows whose text leaks no item; equal texts are judged once, whatever their ids."""
    th = F.xxhash64(F.col(text_col).cast("string"))
    found = leaks(docs.select(th.alias("doc_id"), F.col(text_col).alias("text")), benchmark, **how).select(F.col("doc_id").alias("leaking")).distinct()
    return docs.join(small(found)[0], th == F.col("leaking"), "left_anti")
