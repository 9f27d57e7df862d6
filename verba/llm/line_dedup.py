"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

A document is the sequence of its non-empty lines.  A run of lines counts as
repeated if it has at least ``min_words`` words and occurs earlier, by (doc_id,
line).  Later copies of every maximal repeated run are deleted.

1. *Ranks.*  At level k, the suffixes that share their first 2**k lines with
   another suffix have equal ranks, and ranks follow the order of those lines.
   Level k + 1 sorts the pairs of a suffix's rank and the rank 2**k lines on.  Suffixes
   whose pair nobody shares leave (prefix doubling with discarding); so do all
   lines that occur once, at the start.
2. *Intervals.*  The suffixes that share their first m lines are an interval of
   the suffix array whose longest common prefixes are at least m.  It is named by
   the ranks of two overlapping runs of 2**k lines.  For each line, the shortest
   run that starts or ends there and reaches ``min_words`` is looked up; as equal
   texts have equal shortest runs, the interval's earliest member tells whether
   the run occurs earlier.
3. The union of such runs is exactly that of all maximal repeated runs of
   ``min_words`` words: within a longer one each line is in the shortest run from
   the start, or in the shortest run that ends at the line.  So levels end at
   ``log2(min_words)``, and no interval is ever gathered: only minima by interval.
   The rows of a rank or interval that many documents share are dealt over tasks.

Defined results: null text stays null, empty text stays; an empty line goes if the
nearest other lines on both sides go; rows that repeat a doc_id and its text are one document and stay
alike; rows of one doc_id with other texts are documents of their own, in order
of a hash of the text; null ids come last in order.  A text whose lines are all
copies becomes empty.  A later copy may overlap the first one (a line that follows itself
again and again): all of its lines go, those of the first copy too.  Texts of any length
are read whole.  Other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verba.llm import common
from verba.llm.common import Scratch, dealt_join, light, settled, text_bytes

LAST = (1 << 63) - 1
LINES = "did long, th long, o int, id1 long, id2 long, lo1 int, hi1 int, m1 int, nx1 int, lo2 int, hi2 int, m2 int, nx2 int"
_NAMES = [x.split()[0] for x in LINES.split(", ")]


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Per line, the number of lines of the shortest run of ``least`` words that starts (ends) there; 0 if none does."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    at = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least, side="left")
    fwd = np.where(end <= n, end - at, 0)
    begin = np.searchsorted(total, total[1:] - least, side="right") - 1
    bwd = np.where(total[1:] >= least, at + 1 - begin, 0)
    return fwd, bwd


def _lines(least: int):
    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in _NAMES]
            for did, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py()
                if not text:
                    continue
                raw, own = [], []
                for i, line in enumerate(text.split("\n")):
                    if line and not line.isspace():
                        raw.append(i)
                        own.append(line)
                if not own:
                    continue
                n = len(own)
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in own), "<i8").reshape(-1, 2)
                fwd, bwd = windows(np.array([len(x.split()) for x in own]), least)
                raw = np.array(raw)
                at = np.arange(n)
                end = np.minimum(at + np.maximum(fwd, 1) - 1, n - 1)
                after = np.append(raw[1:], -1)  # the next line that is not empty
                lo2 = raw[np.maximum(at - np.maximum(bwd, 1) + 1, 0)]
                for c, v in zip(out, (np.full(n, did), np.full(n, th), at, h[:, 0], h[:, 1], raw, raw[end], fwd, after[end], lo2, raw, bwd, after), strict=True):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.int32()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)).cast(t) for c, t in zip(out, types, strict=True)], _NAMES)

    return settled(run)


def _mask(batches):
    for b in batches:
        masks = []
        for lo, hi, after in zip(*(b.column(c).to_pylist() for c in ("lo", "hi", "nx")), strict=True):
            m = np.zeros(max(hi) + 2, np.int32)
            np.add.at(m, lo, 1)
            np.add.at(m, np.array(hi) + 1, -1)
            gone = np.cumsum(m)[:-1] > 0
            for h, x in set(zip(hi, after, strict=True)):
                if h + 1 < x < len(gone) and gone[x]:
                    gone[h + 1 : x] = True
            masks.append(gone)
        yield pa.RecordBatch.from_arrays([b.column("did"), b.column("th"), pa.array(masks, pa.list_(pa.bool_()))], ["did", "th", "gone"])


def _key(id_col: str, text_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(F.col(text_col)).alias("th")


def repeated_runs(docs: DataFrame, scratch: Scratch, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, th, lo, hi, nx): line numbers of runs that occur earlier, both ends included, and of the next line that is not empty."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(*_key(id_col, text_col), F.col(text_col).cast("string").alias("text")).where("text is not null")
    lines = scratch.keep(rows.mapInArrow(_lines(min_words), LINES), "lines", text_bytes(rows), common.TASK_BYTES)
    most = most0 = lines.count()

    def ranked(keyed: DataFrame, k: int, most: int) -> DataFrame:
        """Positions whose (r1, r2) another shares, with ranks in the order of the pairs."""
        classes = keyed.groupBy("r1", "r2").agg(F.count("*").alias("c")).where("c > 1")
        classes = classes.repartitionByRange(parts, "r1", "r2").sortWithinPartitions("r1", "r2")
        classes = scratch.keep(classes.withColumn("r", F.monotonically_increasing_id()), f"ranks{k}", most)
        kept = dealt_join(keyed, classes, ["r1", "r2"], most, ["did", "th", "o"]).select("did", "th", "o", "r")
        return scratch.keep(kept.distinct() if k == 0 else kept, f"level{k}", most)  # repeated rows are one document

    level = ranked(lines.select("did", "th", "o", F.col("id1").alias("r1"), F.col("id2").alias("r2")), 0, most)
    levels, k = [level.withColumn("k", F.lit(0))], 0
    while 2 << k <= min_words:
        on = level.select("did", "th", (F.col("o") - (1 << k)).cast("int").alias("o"), F.col("r").alias("r2"))
        most = level.count()
        if not most:
            break
        level = ranked(level.withColumnRenamed("r", "r1").join(on, ["did", "th", "o"]), k + 1, most)
        k += 1
        levels.append(level.withColumn("k", F.lit(k)))
    names = levels[0]
    for other in levels[1:]:
        names = names.unionByName(other)
    first = lines.where("m1 > 0").select("did", "th", "o", F.col("m1").alias("m"), F.col("lo1").alias("lo"), F.col("hi1").alias("hi"), F.col("nx1").alias("nx"))
    last = lines.where("m2 > 0").select("did", "th", (F.col("o") - F.col("m2") + 1).cast("int").alias("o"), F.col("m2").alias("m"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("nx2").alias("nx"))
    runs = first.unionByName(last).withColumn("k", F.floor(F.log2("m")).cast("int"))
    runs = runs.join(names.withColumnRenamed("r", "r1"), ["did", "th", "o", "k"])
    runs = runs.withColumn("e", F.expr("cast(o + m - shiftleft(1, k) as int)"))
    runs = runs.join(names.select("did", "th", F.col("o").alias("e"), "k", F.col("r").alias("r2")), ["did", "th", "e", "k"])
    runs = scratch.keep(runs.select("did", "th", "o", "m", "r1", "r2", "lo", "hi", "nx").distinct(), "runs", 2 * most0)
    n = runs.count()
    earliest = runs.groupBy("m", "r1", "r2").agg(F.min(F.struct("did", "th", "o")).alias("first"), F.count("*").alias("c")).where("c > 1")
    earliest = scratch.keep(earliest, "earliest", n)
    later = dealt_join(runs, earliest, ["m", "r1", "r2"], n, ["did", "th", "o"]).where(F.struct("did", "th", "o") > F.col("first"))
    return later.select("did", "th", "lo", "hi", "nx")


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with repeated runs deleted from the text, and ``removed``, the number of lines deleted."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone = repeated_runs(docs, scratch, min_words, id_col, text_col)
    masks = gone.groupBy("did", "th").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"), F.collect_list("nx").alias("nx")).mapInArrow(_mask, "did long, th long, gone array<boolean>")
    masks = light(scratch.keep(masks, "masks"), "64 + size(gone)")
    did, th = _key(id_col, text_col)
    names = [c for c in docs.columns]
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), did, th).join(masks, ["did", "th"], "left")
    text = F.col(f"row.`{text_col}`")
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(F.get(F.col("gone"), i), F.lit(False)))
    new = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.size(F.filter("gone", lambda x: x)), F.lit(0)).cast("long")
    return held.select(*(new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names), F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(removed).alias("removed"))
