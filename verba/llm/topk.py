"""Exact top-k search by inner product with multi-resolution segment statistics.

Each vector is cut into segments; a segment is known by its mean and its
deviation (the norm of what the mean leaves).  For two vectors the squared
distance is at least the sum over segments of ``len * (difference of means)**2 +
(difference of deviations)**2``, so with the exact norms an inner product is at
most ``sum(len * mean * mean + deviation * deviation)``.  Coarse segments are
tried first, finer ones for what is left; what may still reach a query's k-th
best is computed exactly, in integers.

Rows are packed into blocks, queries into blocks of bounded size.  Query blocks are
broadcast, as many at once as ``BROADCAST_BYTES`` hold; beyond that the candidates
are read once more for each further round, so that they are never shuffled.  Each
task keeps the k best of each query it sees, and a ranked window with its group
limit joins what the tasks found.

Defined results: a vector that is null, empty or holds null or non-finite
components takes no part, nor a row with a null id.  Vectors of other lengths
than the query's are no candidates of it.  Rows that repeat a query's id are not
its candidates, and a query that stands twice counts once; other repeated rows
rank as rows of their own.  Scores are exact whatever the components: sums that may
leave 64 bits are made of unbounded integers, rows are ranked by up to 38 digits, and
a score beyond a long is shown as the long next to it.  Vectors of any length are
taken whole.  An empty table gives no rows.  Extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verba.llm.common import Scratch

#: Vectors of a candidate block and of a query block.
ROWS, QUERIES = 4096, 1024
#: Bytes of query blocks that are broadcast at once.
BROADCAST_BYTES = 64 << 20
#: Segments of the resolutions, coarse to fine.
LEVELS = (4, 16)
PACK = "dim int, wide boolean, ids binary, data binary"
#: Largest integers of a score: of its column, and of what ranks rows.
LONG, DIGITS = (1 << 63) - 1, 10**38 - 1


def _pack(scale: int, size: int):
    """Blocks of scaled vectors: 32-bit integers, or whole numbers as doubles where one is larger."""

    def flush(dim, wide, ids, vecs):
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([wide]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.stack(vecs).tobytes()], pa.binary())],
            ["dim", "wide", "ids", "data"],
        )

    def run(batches):
        held: dict[tuple[int, bool], tuple[list, list]] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = np.floor(np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) * scale)
                if not np.isfinite(x).all():
                    continue
                key = (len(x), bool(np.abs(x).max() >= 2**31))
                ids, vecs = held.setdefault(key, ([], []))
                ids.append(i)
                vecs.append(x if key[1] else x.astype(np.int32))
                if len(ids) >= size:
                    yield flush(*key, *held.pop(key))
        for key, (ids, vecs) in held.items():
            yield flush(*key, ids, vecs)

    return run


def block(data: bytes, dim: int, wide: bool) -> np.ndarray:
    return np.frombuffer(data, np.float64 if wide else np.int32).reshape(-1, dim)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows with a vector: 64-bit integers if none can be larger, else Python's."""
    if x.dtype == q.dtype == np.int32 and len(q) * float(np.abs(x.astype(np.int64)).max()) * float(np.abs(q.astype(np.int64)).max()) < 2**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    own = [int(v) for v in q]
    return np.array([sum(int(a) * b for a, b in zip(row, own, strict=True)) for row in x.tolist()], object)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if score.dtype == object:
        top = sorted(range(len(score)), key=lambda j: (-score[j], ids[j]))[:k]
    else:
        top = np.lexsort((ids, -score))[:k]
    return score[top], ids[top]


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row: scaled means, then deviations, whose product bounds the inner product from above."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    means, devs = [], []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = x[:, lo:hi].astype(np.float64)
        m = part.mean(axis=1)
        means.append(m * np.sqrt(hi - lo))
        devs.append(np.sqrt(((part - m[:, None]) ** 2).sum(axis=1)))
    return np.stack(means + devs, axis=1)


def search(q: np.ndarray, q_ids: np.ndarray, q_stats: list, x: np.ndarray, ids: np.ndarray, k: int, best: list, slab: int = 512) -> None:
    """Bring rows ``x`` into each query's ``best`` (scores, ids), its k best so far."""
    for at in range(0, len(x), slab):
        part, own = x[at : at + slab], ids[at : at + slab]
        floor = np.array([float(b[0][-1]) if len(b[0]) >= k else -np.inf for b in best])
        left = own[None, :] != q_ids[:, None]
        with np.errstate(over="ignore", invalid="ignore"):
            for segments, qs in q_stats:
                rows, cols = np.flatnonzero(left.any(axis=1)), np.flatnonzero(left.any(axis=0))
                if not len(rows) or not len(cols):
                    break
                mine, theirs = qs[rows], statistics(part[cols], segments)
                # rounding errors are far below this share of the norms' product; a bound that is no number excludes nothing
                slack = 1e-9 * np.sqrt((mine**2).sum(axis=1))[:, None] * np.sqrt((theirs**2).sum(axis=1)) + 1e-6
                left[np.ix_(rows, cols)] &= ~(mine @ theirs.T + slack < floor[rows, None])
        for r in np.flatnonzero(left.any(axis=1)):
            c = np.flatnonzero(left[r])
            best[r] = best_of(np.concatenate([best[r][0], products(part[c], q[r])]), np.concatenate([best[r][1], own[c]]), k)


def _search(k: int):
    def run(batches):
        state: dict[int, tuple] = {}
        for b in batches:
            for qb, qids, qdata, qwide, dim, wide, ids, data in zip(*(b.column(c).to_pylist() for c in ("qb", "q_ids", "q_data", "q_wide", "dim", "wide", "ids", "data")), strict=True):
                if qb not in state:
                    q = block(qdata, dim, qwide)
                    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    with np.errstate(over="ignore", invalid="ignore"):
                        state[qb] = (q, np.frombuffer(qids, np.int64), [(s, statistics(q, s)) for s in LEVELS], [none] * len(q))
                q, own, stats, best = state[qb]
                search(q, own, stats, block(data, dim, wide), np.frombuffer(ids, np.int64), k, best)
        for _, own, _, best in state.values():
            n = [len(s) for s, _ in best]
            if sum(n):
                score = [Decimal(max(-DIGITS, min(DIGITS, int(x)))) for s, _ in best for x in s]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(np.concatenate([i for _, i in best])), pa.array(score, pa.decimal128(38, 0))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products, ties to the smaller id."""
    scratch = Scratch(vectors.sparkSession, "topk")
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    packs = pick(queries).dropDuplicates().mapInArrow(_pack(scale, QUERIES), PACK).select("dim", F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    packs = scratch.keep(packs.withColumn("qb", F.monotonically_increasing_id()), "queries")
    rows = pick(vectors).mapInArrow(_pack(scale, ROWS), PACK)
    # a row for each block of queries: which round it is broadcast in
    sizes, rounds, held = packs.select("qb", (F.octet_length("q_data") + F.octet_length("q_ids")).alias("size")).orderBy("qb").collect(), [[]], 0
    for r in sizes:
        if rounds[-1] and held + r["size"] > BROADCAST_BYTES:
            rounds.append([])
            held = 0
        rounds[-1].append(r["qb"])
        held += r["size"]
    found = None
    for own in rounds:
        some = packs if len(rounds) == 1 else packs.where(F.col("qb").between(own[0], own[-1]))
        met = rows.join(F.broadcast(some), "dim").select("qb", "q_ids", "q_data", "q_wide", "dim", "wide", "ids", "data")
        got = met.mapInArrow(_search(k), "query_id long, vec_id long, score decimal(38,0)")
        found = got if found is None else found.unionByName(got)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    shown = F.greatest(F.lit(-LONG - 1).cast("decimal(38,0)"), F.least(F.lit(LONG).cast("decimal(38,0)"), F.col("score"))).cast("long")
    return top.select("query_id", "rank", "vec_id", shown.alias("score"))
