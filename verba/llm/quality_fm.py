"""Quality classifier: a factorisation machine.

A document's features are the hashed words of its whole text (square-root counts,
unit length), statistics of its structure, and its own length as metadata; labels,
language, source and id are no inputs.  The score is

    sigmoid(w0 + <w, x> + 1/2 * sum_f ((V x)_f^2 - sum_i V_if^2 x_i^2))

so all pairwise interactions are summed in time linear in the features.

Training takes a bounded sample (``max_train`` labelled rows, the smallest hashes
of their texts among those given) whose features are computed on the executors;
the fit itself is a fixed number of passes over that sample on the driver.
Scoring is one narrow pass over all documents with the broadcast model, whose size
is fixed by ``buckets`` and ``rank``.

Defined results: a null or empty text has no words and gets the score of its
structure statistics alone; without labelled rows, or with labels of one kind
only, every score is 0.5.  Repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verba.llm.common import distinct, hashed, prepare, settled

#: Word buckets, rank of the interactions, most labelled rows of the training sample.
BUCKETS, RANK, MAX_TRAIN = 1 << 13, 8, 6000
STATS = 16


def structure(raw: np.ndarray, words: np.ndarray, different: int) -> list[float]:
    """Statistics of a text's structure, from its bytes and word hashes, each about 0 to 1."""
    c = np.bincount(raw, minlength=256)
    inner = c[128:192].sum()  # bytes that go on a character
    n, lines, letters = max(1, len(raw) - inner), c[10] + 1, len(raw) - inner - c[9:14].sum() - c[32]
    c = c / max(1, len(raw))
    upper, lower, digit = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    mark = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
    end = c[33] + c[46] + c[63]
    distinct = different / max(1, len(words))
    mean = letters / max(1, len(words))
    size = np.log1p(len(words)) / 10
    return [upper, lower, digit, 5 * mark, 10 * end, 20 * c[44], 50 * c[33], 50 * c[124], distinct, distinct * size, mean / 20, size, np.log1p(n / lines) / 10, np.log1p(lines) / 10, 5 * c[32], 1.0 if not len(words) else 0.0]


def rows_of(texts: pa.Array, buckets: int):
    """Compressed sparse rows of word features, and the structure statistics."""
    ends, cols, vals, stats = [0], [], [], []
    for data, stops, h, words in hashed(texts, lower=False):
        byte = word = 0
        for b, w in zip(stops.tolist(), words.tolist(), strict=True):
            own = h[word:w]
            u, n = np.unique((own % np.uint64(buckets)).astype(np.int64), return_counts=True)
            v = np.sqrt(n.astype(np.float64))
            v /= max(1e-9, np.sqrt((v * v).sum()))
            cols.append(u)
            vals.append(v)
            ends.append(ends[-1] + len(u))
            stats.append(structure(data[byte:b], own, len(distinct(own))))
            byte, word = b, w
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return np.array(ends), cat(cols, np.int64), cat(vals, np.float64), np.array(stats).reshape(-1, STATS)


@dataclass
class Machine:
    """Weights: ``w0``, linear ``w`` and interactions ``v`` over word buckets and then statistics."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    dev: np.ndarray

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.dev, -6, 6) / 4

    def margin(self, ends, cols, vals, stats) -> np.ndarray:
        """Linear in the entries, by the identity of the square of a sum and the sum of squares."""
        n, b = len(ends) - 1, len(self.w) - STATS
        s = self.scaled(stats)
        row = np.repeat(np.arange(n), np.diff(ends))
        lin = np.bincount(row, self.w[cols] * vals, n) + s @ self.w[b:]
        vs = self.v[b:]
        out = lin + self.w0
        for f in range(self.v.shape[1]):
            xv = self.v[cols, f] * vals
            total = np.bincount(row, xv, n) + s @ vs[:, f]
            out += 0.5 * (total**2 - np.bincount(row, xv * xv, n) - (s**2) @ (vs[:, f] ** 2))
        return out

    def score(self, *x) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*x), -30, 30)))


def fit(ends, cols, vals, stats, y: np.ndarray, buckets: int = BUCKETS, rank: int = RANK, passes: int = 12, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine | None:
    """Adagrad over mini-batches of the sample; None if labels are of one kind."""
    if len(y) == 0 or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    mean, dev = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    m = Machine(float(np.log(y.mean() / (1 - y.mean()))), np.zeros(buckets + STATS), rng.normal(0, 0.02, (buckets + STATS, rank)), mean, dev)
    s = m.scaled(stats)
    gw, gv, g0 = np.full_like(m.w, 1e-2), np.full_like(m.v, 1e-2), 1e-2
    stat_cols = np.arange(buckets, buckets + STATS)
    for _ in range(passes):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in part])
            row = np.repeat(np.arange(len(part)), [ends[i + 1] - ends[i] for i in part])
            c = np.concatenate([cols[at], np.tile(stat_cols, len(part))])
            x = np.concatenate([vals[at], s[part].ravel()])
            r = np.concatenate([row, np.repeat(np.arange(len(part)), STATS)])
            vx = m.v[c] * x[:, None]
            total = np.stack([np.bincount(r, vx[:, f], len(part)) for f in range(rank)], axis=1)
            margin = m.w0 + np.bincount(r, m.w[c] * x, len(part)) + 0.5 * (total**2 - np.stack([np.bincount(r, vx[:, f] ** 2, len(part)) for f in range(rank)], axis=1)).sum(axis=1)
            e = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]) / len(part)
            u, inv = np.unique(c, return_inverse=True)
            dw = np.bincount(inv, e[r] * x, len(u)) + decay * m.w[u]
            ev = (e[r] * x)[:, None] * (total[r] - vx)
            dv = np.stack([np.bincount(inv, ev[:, f], len(u)) for f in range(rank)], axis=1) + decay * m.v[u]
            gw[u] += dw**2
            gv[u] += dv**2
            g0 += e.sum() ** 2
            m.w[u] -= rate * 4 * dw / np.sqrt(gw[u])
            m.v[u] -= rate * dv / np.sqrt(gv[u])
            m.w0 -= rate * e.sum() / np.sqrt(g0)
    return m


def _features(buckets: int):
    def run(batches):
        for b in batches:
            ends, cols, vals, stats = rows_of(b.column("text"), buckets)
            wide = lambda e, x, t: pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(x, t))
            yield pa.RecordBatch.from_arrays(
                [b.column("y"), wide(ends, cols.astype(np.int32), pa.int32()), wide(ends, vals.astype(np.float32), pa.float32()), wide(np.arange(0, stats.size + 1, STATS), stats.ravel(), pa.float64())],
                ["y", "cols", "vals", "stats"],
            )

    return settled(run)


def sample(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """The ``most`` rows of least hash of the columns ``by``, or all if there are no more.

    Slots of hashes are counted first, so that only the slot where the sample ends is ordered.
    """
    rows = rows.withColumn("h", F.xxhash64(*by)).withColumn("slot", F.floor((F.col("h") / F.lit(2.0**63) + 1) * 8192))
    picks = rows.groupBy("slot").count().orderBy("slot").collect()  # 16385 slots at most
    if sum(r["count"] for r in picks) <= most:
        return rows.drop("h", "slot")
    held = 0
    for r in picks:
        if held + r["count"] > most:
            break
        held += r["count"]
    ends = rows.where(F.col("slot") == r["slot"])
    hashes = [x["h"] for x in ends.select("h").orderBy("h").limit(most - held).collect()]
    if not hashes:
        return rows.where(F.col("slot") < r["slot"]).drop("h", "slot")
    # rows of the last hash are copies of each other
    last = max(hashes)
    ties = ends.where(F.col("h") == last).orderBy("y").limit(hashes.count(last))
    return rows.where((F.col("slot") < r["slot"]) | ((F.col("slot") == r["slot"]) & (F.col("h") < last))).unionByName(ties).drop("h", "slot")


def train(labelled: DataFrame, max_train: int = MAX_TRAIN, buckets: int = BUCKETS, rank: int = RANK) -> Machine | None:
    """A machine from ``labelled(text, y)``, y 0 or 1; other labels are ignored.

    Further columns tell copies of a text apart, so that the sample draws among them.
    """
    keys = [c for c in labelled.columns if c not in ("text", "y")]
    rows = labelled.where("y in (0, 1)").select(F.col("text").cast("string").alias("text"), F.col("y").cast("double").alias("y"), *keys)
    rows = sample(rows, max_train, "text", *keys).select("text", "y")
    got = rows.mapInArrow(_features(buckets), "y double, cols array<int>, vals array<float>, stats array<double>").toArrow()
    if not got.num_rows:
        return None
    cols, vals, stats = (got.column(c).combine_chunks() for c in ("cols", "vals", "stats"))
    sizes = np.diff(cols.offsets.to_numpy())
    x = (np.concatenate([[0], np.cumsum(sizes)]), cols.flatten().to_numpy().astype(np.int64), vals.flatten().to_numpy().astype(np.float64), stats.flatten().to_numpy().reshape(-1, STATS))
    y = got.column("y").to_numpy()
    # one order of the rows, whatever tasks returned them first
    at = np.lexsort((*x[3].T[:4], sizes, y))
    flat = np.concatenate([np.arange(x[0][i], x[0][i + 1]) for i in at])
    return fit(np.concatenate([[0], np.cumsum(sizes[at])]), x[1][flat], x[2][flat], x[3][at], y[at], buckets, rank)


def _score(model, buckets: int, keep: list[str]):
    def run(batches):
        m = model.value
        for b in batches:
            text = b.column("text")
            out = [m.score(*rows_of(text.slice(at, 256), buckets)) if m else np.full(len(text.slice(at, 256)), 0.5) for at in range(0, len(text), 256)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], [*keep, "score"])

    return settled(run)


def score(docs: DataFrame, model: Machine | None, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The columns ``keep`` (text among them or not) and ``score`` of every row."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep) + ", score double"
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(model), buckets, keep), schema)
