"""Helpers that several training-data operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verba.runtime import prepare
from verba.scratch import BROADCAST_ROWS, FILE_ROWS, Scratch, ceil_div, plainly, settled, shared_dir, small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def light(df: DataFrame, size: str, most: int = 64 << 20) -> DataFrame:
    """The frame, hinted for broadcast if its rows, each of ``size`` bytes by that expression, are within the bound."""
    total = df.agg(F.sum(F.expr(size).cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= most else df


#: A key with more than one ``HOT``th of all rows is dealt over several tasks.
HOT = 512


def dealt_join(rows: DataFrame, side: DataFrame, keys: list[str], total: int, by: list[str]) -> DataFrame:
    """``rows`` joined with ``side``, whose keys are unique and whose ``c`` counts a key's rows, of ``total`` at most.

    A hot key's rows are dealt by a hash of the columns ``by``, and its row of ``side`` is
    repeated for each deal.  Fewer than ``HOT`` keys can be hot, so that these are broadcast.
    """
    least = ceil_div(max(total, 1), HOT)
    deals = F.ceil(F.col("c") / least).cast("long")
    hot = side.where(F.col("c") > least).select(*keys, deals.alias("deals"))
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("deal", F.coalesce(F.expr(f"pmod(xxhash64({', '.join(by)}), deals)"), F.lit(0).cast("long"))).drop("deals")
    side = side.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1))).drop("c")
    return rows.join(side, [*keys, "deal"]).drop("deal")


def gathered(df: DataFrame, rows: int, per: int = 5000) -> DataFrame:
    """The frame in no more tasks, and so files, than ``per`` of its rows each fill."""
    return df.coalesce(max(1, ceil_div(rows, per)))


#: Bytes of texts that a task, and so a file, over whole texts takes at least, where there are as many.
TASK_BYTES = 64 << 20


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, and some for each row."""
    return docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + F.lit(64).cast("long"))).first()[0] or 0


# --------------------------------------------------------------------------
# words and shingles

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: Bytes of text whose words are hashed at once, and bytes up to which a word is hashed letter by letter.
PIECE, LETTERS = 1 << 18, 255
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                  0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _MULT[0])
_POWER = np.cumprod(np.array([1, *[0xD6E8FEB86659FD95] * LETTERS], np.uint64))


def word_hashes(data: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another in ``data``, and each text's end among them.

    Words end at space, U+0009..U+000D and a text's end; ``lower`` lowers A-Z.  No
    object is made for a word, and nothing is remembered between calls.
    """
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends], edge[0] = True, True
    begins = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | edge[:-1]))
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    stops = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1
    size = stops - begins
    own = np.flatnonzero(~space)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(own)) - np.repeat(first, size)
    h = np.add.reduceat(_LETTER[data[own]] * _POWER[np.minimum(place, LETTERS)], first)
    h = mix(h + size.astype(np.uint64) * _MULT[1])
    for i in np.flatnonzero(size > LETTERS):
        h[i] = xxhash.xxh3_64_intdigest(data[begins[i] : stops[i]].tobytes())
    return h, np.searchsorted(begins, ends)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k words; of the whole sequence if it is shorter."""
    if len(h) == 0:
        return h
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = (out * _MULT[j % 8]) ^ mix(h[j : j + len(out)] + np.uint64(j))
    return mix(out)


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) > 1 else h


def _long(data: np.ndarray, lower: bool) -> np.ndarray:
    """Word hashes of one long text, cut at white space into pieces that are hashed one after another."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            gap = np.flatnonzero(_SPACE[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:  # a word that is longer than a piece
                step, found = end, None
                while step < len(data) and found is None:
                    more = np.flatnonzero(_SPACE[data[step : step + PIECE]])
                    found = step + int(more[0]) if len(more) else None
                    step += PIECE
                end = len(data) if found is None else found
        out.append(word_hashes(data[at:end], np.array([end - at]), lower)[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def hashed(texts: pa.Array, lower: bool = True):
    """(bytes, ends of the texts in them, word hashes, ends of the texts in these) of groups of texts, in order.

    Null texts are empty.  A group is at most ``PIECE`` bytes, or one longer text.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1
        if end > at:
            part, ends = data[offsets[at] : offsets[end]], offsets[at + 1 : end + 1] - offsets[at]
            yield part, ends, *word_hashes(part, ends, lower)
        else:
            end = at + 1
            part = data[offsets[at] : offsets[end]]
            h = _long(part, lower)
            yield part, np.array([len(part)]), h, np.array([len(h)])
        at = end


def shingle_sets(texts: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text of a column, in order; null and empty texts have none."""
    for _, _, h, stops in hashed(texts):
        whole, begin = shingles(h, k), 0
        for stop in stops.tolist():
            yield distinct(whole[begin : stop - k + 1] if stop - begin >= k else shingles(h[begin:stop], k))
            begin = stop


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one whole text."""
    return next(shingle_sets(pa.array([text], pa.string()), k))


# --------------------------------------------------------------------------
# connected components


def components(edges: DataFrame, scratch: Scratch, rows: int | None = None, most: int = 60) -> DataFrame:
    """(id, component) for every id of ``edges(a, b)``: the smallest id reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014).  Each
    step is a grouped minimum with partial aggregation and one join, and is
    written out, so a large component is never gathered in one task.  ``rows`` is
    the number of edges if it is known; steps never have more than twice as many.
    """
    e = scratch.keep(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "cc0", rows)
    before, rows = None, e.count()
    for i in range(1, most + 1):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(low, "a")
        e2 = star.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e2 = scratch.keep(e2.where("a <> b").distinct(), f"cc{i}", rows)
        now = e2.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"cc{i - 1}", files=False)
        e, rows = e2, now[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    own = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(own)


__all__ = ["BROADCAST_ROWS", "FILE_ROWS", "Scratch", "ceil_div", "components", "dealt_join", "distinct", "gathered", "hashed", "light", "mix", "plainly", "prepare", "settled", "shared_dir", "shingle_set", "shingle_sets", "shingles", "small", "table", "text_bytes"]
