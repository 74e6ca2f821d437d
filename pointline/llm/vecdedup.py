"""Embedding near-duplicates by an inverted multi-index.

Codebooks of the two halves of the unit vectors form a grid of cells. Each vector lives in the cell
of its nearest centroids and visits the nearest cells in the order of the multi-sequence traversal,
as many as bring the target recall on pairs that are exactly as far apart as a link may be. What
meets in a cell is verified by the exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import stable
from .graph import connected_components
from .topk import finite_vectors

#: Vectors that codebooks and the number of visits are fitted on, at most.
SAMPLE = 8_192
#: Vectors per cell aimed at; centroids of a half, at most.
CELL, CENTROIDS = 24, 2_048
#: Members or visitors of a cell that are compared in one group, at most, and rows of a group aimed at.
BLOCK, GROUP = 1_024, 16_384


def fit_centroids(x: np.ndarray, count: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Lloyd's k-means."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.permutation(len(x))[:count]].copy()
    for _ in range(rounds):
        nearest = square_distances(x, centroids).argmin(axis=1)
        size = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        full = size > 0
        centroids[full] = sums[full] / size[full, None]
    return centroids


def square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def traverse(first: np.ndarray, second: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``visits`` cells with the smallest sums of the halves' distances, in that order, for each row.

    The t-th cell of the multi-sequence has at most t cells before it in its row and column, so
    only the first ``visits`` centroids of each half, and of their pairs those with i * j <= visits,
    can come up. Returns cell numbers (i * centroids + j) and sums; -1 and inf where cells run out.
    """
    n, width = first.shape[0], second.shape[1]
    depth_a, depth_b = min(visits, first.shape[1]), min(visits, width)
    a, b = np.argsort(first, axis=1)[:, :depth_a], np.argsort(second, axis=1)[:, :depth_b]
    i, j = np.meshgrid(np.arange(depth_a), np.arange(depth_b), indexing="ij")
    open_ = (i + 1) * (j + 1) <= visits
    i, j = i[open_], j[open_]
    rows = np.arange(n)[:, None]
    sums = first[rows, a[:, i]] + second[rows, b[:, j]]
    cells = a[:, i].astype(np.int64) * width + b[:, j]
    order = np.argsort(sums, axis=1, kind="stable")[:, :visits]
    return cells[rows, order], sums[rows, order]


class MultiIndex:
    """Two codebooks and the number of cells each vector visits."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float, recall: float):
        self.half = max(1, sample.shape[1] // 2)
        count = int(min(CENTROIDS, max(2, math.isqrt(max(1, rows // CELL))), len(sample)))
        self.books = [fit_centroids(x, count, seed=11 + k) for k, x in enumerate(self.halves(sample))]
        self.visits = self.fit_visits(sample[:1_024], cosine, recall)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(x)
        return square_distances(a, self.books[0]), square_distances(b, self.books[1])

    def fit_visits(self, sample: np.ndarray, cosine: float, recall: float) -> int:
        """Visits that find the recall of partners at the largest angle, from either side."""
        rng = np.random.default_rng(5)
        noise = rng.standard_normal(sample.shape)
        noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        other = cosine * sample + math.sqrt(1 - cosine**2) * noise
        ranks = []
        for x, y in ((sample, other), (other, sample)):
            xa, xb = self.distances(x)
            ya, yb = self.distances(y)
            rows = np.arange(len(x))
            home = xa[rows, ya.argmin(axis=1)] + xb[rows, yb.argmin(axis=1)]
            # cells nearer than the partner's own
            rank = np.empty(len(x), dtype=np.int64)
            for k in range(len(x)):
                b = np.sort(xb[k])
                rank[k] = np.searchsorted(b, home[k] - xa[k], side="left").sum()
            ranks.append(rank)
        need = np.sort(np.minimum(*ranks))
        return int(need[min(len(need) - 1, math.ceil(recall * len(need)))] + 1)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cell, visited cells, reach): a cell is visited if its sum is below the reach."""
        first, second = self.distances(x)
        cells, sums = traverse(first, second, self.visits + 1)
        if cells.shape[1] > self.visits:
            reach = (sums[:, self.visits - 1] + sums[:, self.visits]) / 2
        else:
            reach = np.full(len(x), np.inf)
        return cells[:, 0], cells[:, : self.visits], reach

    def reaches(self, x: np.ndarray, reach: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Whether each vector visits the cell of the same row."""
        a, b = self.halves(x)
        i, j = cell // len(self.books[1]), cell % len(self.books[1])
        return ((a - self.books[0][i]) ** 2).sum(axis=1) + ((b - self.books[1][j]) ** 2).sum(axis=1) < reach


def settle_labels(linked: np.ndarray, row_id: np.ndarray, col_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a table of links, each id that isn't the smallest it reaches, and that smallest id."""
    ids, inverse = np.unique(np.r_[row_id, col_id], return_inverse=True)
    r, c = inverse[: len(row_id)], inverse[len(row_id) :]
    label, big = np.arange(len(ids)), len(ids)
    while True:
        new = label.copy()
        np.minimum.at(new, r, np.where(linked, label[c][None, :], big).min(axis=1, initial=big))
        np.minimum.at(new, c, np.where(linked, label[r][:, None], big).min(axis=0, initial=big))
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def bucket_count(counts: DataFrame) -> int:
    """Buckets of about GROUP rows for all copies that pairs of blocks need: a visitor one for each block of members, a member one for each of visitors."""
    copies = counts.agg(F.sum(F.col("vb") * F.col("m") + F.col("mb") * F.col("v"))).first()[0]
    return max(1, math.ceil((copies or 0) / GROUP))


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, recall: float = 0.98) -> DataFrame:
    """Near-duplicate classes of vectors.

    Returns one row per row of ``vectors``: ``id_col``, n_links (other vectors linked directly),
    component_id (the smallest id reachable, itself included) and kept (id = component_id). A link
    is a pair found with cosine >= ``cosine``, verified in double precision. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows with a null id, link with nothing.
    Rows that repeat an id share the results of that id's smallest array; vectors meet only those of
    their own length.

    Codebooks and visits are fitted on at most SAMPLE vectors, those with the smallest hashes; every
    vector is indexed. A cell's members and visitors are cut in blocks of BLOCK, and each pair of
    blocks gives only counts and a spanning set of links, so that a cell may hold any part of the
    rows without expanding its pairs.
    """
    rows = finite_vectors(vectors, id_col, vec_col).select("id", "vec", F.size("vec").alias("dim"))
    sizes = {r[0]: r[1] for r in rows.groupBy("dim").count().collect()}  # one row per vector length
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toLocalIterator():
        sample.setdefault(r.dim, []).append(r.vec)
    indexes: dict[int, MultiIndex] = {}
    for d in sizes:
        x = np.array(sample.get(d, []), dtype=np.float64).reshape(-1, d)
        norm = np.linalg.norm(x, axis=1)
        x = x[norm > 0] / norm[norm > 0, None]
        if not len(x):
            x = np.eye(1, d)
        indexes[d] = MultiIndex(x, sizes[d], cosine, recall)
    shared = vectors.sparkSession.sparkContext.broadcast(indexes)  # at most 2 * CENTROIDS centroids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, dims = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                index = shared.value[d]
                own = np.flatnonzero(dims == d)
                x = lists.take(pa.array(own)).flatten().to_numpy().reshape(-1, d)
                scale = np.abs(x).max(axis=1, initial=0)
                own, x = own[scale > 0], x[scale > 0] / scale[scale > 0, None]
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for at in range(0, len(own), 512):
                    part = x[at : at + 512]
                    home, cells, reach = index.place(part)
                    visits = cells.shape[1]
                    packed = pa.array([v.tobytes() for v in part.astype("<f8")], pa.binary())
                    which = np.repeat(np.arange(len(part)), visits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[own[at : at + 512]][which]), pa.array([d] * len(which), pa.int32()), pa.array(cells.ravel()), pa.array(home[which]), pa.array(reach[which]), packed.take(pa.array(which))],
                        names=["id", "dim", "cell", "home", "reach", "vec"],
                    )

    visits = rows.mapInArrow(place, "id long, dim int, cell long, home long, reach double, vec binary")
    visits = stable(visits.withColumn("lives", F.col("cell") == F.col("home")))
    counts = visits.groupBy("dim", "cell").agg(F.count_if("lives").alias("m"), F.count("*").alias("v")).where("m > 0")
    blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    counts = stable(counts.select("dim", "cell", "m", "v", blocks("m").alias("mb"), blocks("v").alias("vb")))
    dealt = visits.join(counts.select("dim", "cell", "mb", "vb"), ["dim", "cell"])
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # a visitor goes to its block with every block of members, a member to its block with every block of visitors
    roles = F.concat(
        F.transform(upto("mb"), lambda x: F.struct(F.lit(False).alias("member"), own("vb").alias("vi"), x.alias("mi"))),
        F.when(F.col("lives"), F.transform(upto("vb"), lambda x: F.struct(F.lit(True).alias("member"), x.alias("vi"), own("mb").alias("mi")))).otherwise(F.array()),
    )
    groups = bucket_count(counts)
    met = dealt.withColumn("r", F.explode(roles)).select("id", "dim", "cell", "home", "reach", "vec", "r.*")
    met = met.withColumn("unit", F.xxhash64("dim", "cell", "vi", "mi")).withColumn("bucket", F.pmod("unit", F.lit(groups)))

    def compare(table: pa.Table) -> pa.Table:
        unit = table.column("unit").to_numpy()
        order = np.argsort(unit, kind="stable")
        unit = unit[order]
        starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        col = {c: table.column(c).to_numpy()[order] for c in ("id", "dim", "home", "reach", "cell")}
        member = table.column("member").to_numpy(zero_copy_only=False)[order]
        packed = table.column("vec").combine_chunks().take(pa.array(order))
        out_id, out_n, out_low = [], [], []
        for a, b in zip(starts, np.r_[starts[1:], len(unit)], strict=True):
            is_m = member[a:b]
            if is_m.all() or not is_m.any():
                continue
            x = np.frombuffer(b"".join(packed.slice(a, b - a).to_pylist()), dtype="<f8").reshape(b - a, -1)
            ids, home, reach, cell, d = col["id"][a:b], col["home"][a:b], col["reach"][a:b], col["cell"][a], int(col["dim"][a])
            v, m = np.flatnonzero(~is_m), np.flatnonzero(is_m)
            linked = x[v] @ x[m].T >= cosine
            linked &= ids[v][:, None] != ids[m][None, :]
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            # a pair that both sides find counts where the smaller id visits
            again = (home[v[i]] == cell) | shared.value[d].reaches(x[m[j]], reach[m[j]], home[v[i]])
            count = ~again | (ids[v[i]] < ids[m[j]])
            n = np.bincount(v[i[count]], minlength=b - a) + np.bincount(m[j[count]], minlength=b - a)
            some = np.flatnonzero(n)
            node, low = settle_labels(linked, ids[v], ids[m])
            out_id += [ids[some], node]
            out_n += [n[some], np.zeros(len(node), np.int64)]
            out_low += [ids[some], low]
        if not out_id:
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "low": pa.array([], pa.int64())})
        return pa.table({"id": np.concatenate(out_id), "n": np.concatenate(out_n), "low": np.concatenate(out_low)})

    found = stable(met.groupBy("bucket").applyInArrow(compare, "id long, n long, low long"))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups_ = connected_components(found.select(F.col("id").alias("a"), F.col("low").alias("b")).where("a <> b"))
    result = links.join(groups_.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias("__id"), "n", "component")
    out = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id")).join(result, F.col("id") == F.col("__id"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
