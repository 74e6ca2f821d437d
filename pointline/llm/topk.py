"""Exact top-k inner products by pivot-table elimination.

Distances of all vectors to a table of pivots are computed once. For a query and a candidate the
largest difference of their distances to a pivot bounds their distance from below and so their
inner product from above; for a block of candidates around a pivot, so do the least and largest
distances in it. Queries visit the blocks whose bound reaches the threshold they have, and there
evaluate candidates in the order of the bound until none can be among the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import stable

#: Rows of a block of candidates and of queries, at most about; queries and candidates compared in one step.
CANDIDATES, QUERIES, STEP, FIRST = 8_192, 2_048, 16, 64
#: Bounds of blocks are broadcast up to this size in bytes; beyond it every query visits every block.
BLOCK_TABLE = 64_000_000
#: Pivots, and the bounded sample that they and the first thresholds come from.
PIVOTS, SAMPLE = 32, 1_024


def finite_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec double[]) of the rows that take part, one per id."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & (F.size("vec") > 0) & whole).groupBy("id").agg(F.min("vec").alias("vec"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from one another: each is the farthest from those before it."""
    if not len(sample):
        return sample
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


def most_product(gap: np.ndarray, far: float | np.ndarray, q_square: np.ndarray, c_square: np.ndarray) -> np.ndarray:
    """What an inner product can be at most if the distance is at least ``gap``: |q-c|^2 = |q|^2 + |c|^2 - 2 q.c, with room for rounding."""
    gap = np.maximum(gap.astype(np.float64) - 1e-6 * far - 1e-3, 0)
    return (q_square + c_square - gap**2) / 2 + 1e-9 * (q_square + c_square) + 1e-3


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes, 2 for each where they fit and 8 otherwise."""
    small = np.abs(x).max(axis=1, initial=0) < 1 << 15
    return [(r.astype("<i2") if s else r.astype("<f8")).tobytes() for r, s in zip(x, small, strict=True)]


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    if all(len(r) == 2 * dim for r in rows):
        return np.frombuffer(b"".join(rows), dtype="<i2").reshape(len(rows), dim).astype(np.float64)
    return np.array([np.frombuffer(r, dtype="<i2" if len(r) == 2 * dim else "<f8") for r in rows], dtype=np.float64)


def k_best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id; scores of -inf are none."""
    some = np.flatnonzero(scores > -np.inf)
    if len(some) > k:
        some = some[scores[some] >= np.partition(scores[some], -k)[-k]]
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def best_in_block(q: np.ndarray, q_id: np.ndarray, q_far: np.ndarray, least: np.ndarray, c: np.ndarray, c_id: np.ndarray, c_far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's k best among the candidates that can be in its top k."""
    q_square, c_square = (q**2).sum(axis=1), (c**2).sum(axis=1)
    out: list[tuple] = []
    for at in range(0, len(q), STEP):
        own = slice(at, at + STEP)
        gap = np.zeros((len(q[own]), len(c)), np.float32)
        for p in range(c_far.shape[1]):
            np.maximum(gap, np.abs(c_far[None, :, p] - q_far[own, p, None]), out=gap)
        far = (c_far.max(axis=1, initial=0)[None, :] + q_far[own].max(axis=1, initial=0)[:, None]) if c_far.shape[1] else 0.0
        top = most_product(gap, far, q_square[own, None], c_square[None, :])
        top[q_id[own, None] == c_id[None, :]] = -np.inf
        level = least[own].copy()
        # the first candidates in the order of the bound raise the level, then all that still reach it are evaluated
        first = np.argpartition(-top, min(FIRST, len(c) - 1), axis=1)[:, :FIRST]
        for i, f in enumerate(first):
            scores = np.sort(np.where(top[i, f] > -np.inf, c[f] @ q[at + i], -np.inf))
            if len(scores) >= k:
                level[i] = max(level[i], scores[-k])
        reach = (top >= level[:, None]) & (top > -np.inf)
        some = np.flatnonzero(reach.any(axis=0))
        scores = np.where(reach[:, some], np.rint(q[own] @ c[some].T), -np.inf)
        for i, row in enumerate(scores):
            best = k_best(row, c_id[some], k)
            out.append((np.full(len(best), q_id[at + i]), c_id[some[best]], row[best].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """For each row whose id is divisible by ``every``, the k rows with the largest inner product.

    Components are turned into floor(scale * x); scores are exact integers as long as they stay
    below 2^53. Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, and
    fewer candidates give fewer rows. Vectors that are null, empty or hold null or non-finite
    components and rows with a null id take no part. Of rows that repeat an id, the one with the
    smallest array stands. Vectors meet only those of their own length; other columns aren't carried.

    Pivots and the first thresholds come from SAMPLE vectors with the smallest hashes; a poor sample
    costs time, not results. Candidates lie in blocks by their nearest pivot, those of a pivot dealt
    by hash to blocks of bounded size, so equal vectors may be any part of the rows. A query is sent
    to the blocks that it can't rule out; a block's candidates are sent once for each QUERIES queries.
    Where vectors have no structure (independent components), bounds rule out next to nothing and
    the work is that of all pairs.
    """
    rows = finite_vectors(vectors, id_col, vec_col).select("id", F.transform("vec", lambda x: F.floor(x * scale).cast("double")).alias("vec"), F.size("vec").alias("dim"))
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():  # at most SAMPLE rows
        sample.setdefault(r.dim, []).append((r.id, r.vec))
    fixed = {d: (np.array([i for i, _ in s], dtype=np.int64), np.array([v for _, v in s])) for d, s in sample.items()}
    pivots = {d: choose_pivots(x, PIVOTS) for d, (_, x) in fixed.items()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(1)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                x = lists.take(pa.array(own)).flatten().to_numpy().reshape(-1, d)
                far = pivot_distances(x, pivots[d]) if d in pivots else np.zeros((len(own), 1), np.float32)
                least = np.full(len(own), -np.inf)
                for j in np.flatnonzero(ids[own] % every == 0) if d in fixed else ():
                    scores = fixed[d][1][fixed[d][0] != ids[own[j]]] @ x[j]
                    if len(scores) >= k:
                        least[j] = np.partition(scores, -k)[-k]
                lists_of_far = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * far.shape[1]), pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own]), pa.array([d] * len(own), pa.int32()), pa.array(pack(x), pa.binary()), lists_of_far, pa.array(least), pa.array((x**2).sum(axis=1)), pa.array(far.argmin(axis=1).astype(np.int32))],
                    names=["id", "dim", "vec", "far", "least", "square", "near"],
                )

    measured = stable(rows.mapInArrow(measure, "id long, dim int, vec binary, far array<float>, least double, square double, near int"))
    asked = F.pmod(F.col("id"), F.lit(every)) == 0
    # blocks: so many for each pivot as its candidates need, numbered from ``first`` on
    sizes = measured.groupBy("dim", "near").count().collect()  # at most PIVOTS rows for each length of vectors
    many = {(r.dim, r.near): max(1, math.ceil(r["count"] / CANDIDATES)) for r in sizes}
    first = dict(zip(sorted(many), np.cumsum([0, *(many[x] for x in sorted(many))]).tolist(), strict=False))
    deal = vectors.sparkSession.createDataFrame([(*x, many[x], first[x]) for x in sorted(many)], "dim int, near int, n int, first int")
    block = (F.col("first") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("n"))).cast("int").alias("c")
    blocked = measured.join(F.broadcast(deal), ["dim", "near"]).select("id", "dim", "vec", "far", "least", "square", block)
    shape = blocked.groupBy("dim", "c").agg(
        F.max("square").alias("square"), F.array(*[F.min(F.get("far", F.lit(i))) for i in range(PIVOTS)]).alias("low"), F.array(*[F.max(F.get("far", F.lit(i))) for i in range(PIVOTS)]).alias("high")
    )
    bounds: dict[int, list] = {}
    known = sum(many.values()) * PIVOTS * 8 <= BLOCK_TABLE
    for r in shape.toLocalIterator() if known else ():
        bounds.setdefault(r.dim, []).append((r.c, r.square, [x for x in r.low if x is not None], [x for x in r.high if x is not None]))
    tables = {d: [np.array(x) for x in zip(*sorted(own), strict=True)] for d, own in bounds.items()}
    blocks_of = {d: np.array([first[x] + i for x in sorted(many) if x[0] == d for i in range(many[x])]) for d in {x[0] for x in many}}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (d, far, least, square) in enumerate(zip(*(batch.column(j).to_pylist() for j in (1, 3, 4, 5)), strict=True)):
                cells = blocks_of[d]
                if d in tables:
                    cells, c_square, low, high = tables[d]
                    far = np.array(far)
                    gap = np.maximum(np.maximum(low - far, far - high), 0).max(axis=1)
                    # the largest norm in the block stands for all
                    cells = cells[most_product(gap, high.max(axis=1) + far.max(), square, c_square) >= least]
                if len(cells):
                    one = batch.slice(i, 1).take(pa.array(np.zeros(len(cells), np.int64)))
                    yield pa.RecordBatch.from_arrays([*(one.column(j) for j in range(6)), pa.array(cells.astype(np.int32))], names=["id", "dim", "vec", "far", "least", "square", "c"])

    queries = measured.where(asked).select("id", "dim", "vec", "far", "least", "square")
    lines = max(1, math.ceil(queries.count() / QUERIES))
    queries = queries.mapInArrow(send, "id long, dim int, vec binary, far array<float>, least double, square double, c int").drop("square")
    queries = queries.withColumn("q", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(lines)).cast("int"))
    candidates = blocked.select("id", "dim", "vec", "far", "c", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("q"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 3
        if len(left) and len(right):
            d = left.column("dim")[0].as_py()
            vec = lambda t: unpack(t.column("vec").to_pylist(), d)
            far = lambda t: t.column("far").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
            found = best_in_block(vec(left), left.column("id").to_numpy(), far(left), left.column("least").to_numpy(), vec(right), right.column("id").to_numpy(), far(right), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    keys = ("dim", "q", "c")
    best = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
