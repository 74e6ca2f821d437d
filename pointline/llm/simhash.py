"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints at Hamming distance 4 or less are found whole: of three segments of a fingerprint the
two with the fewest errors have 2 together at most. Each segment, padded to the 23 bits of the
perfect Golay code, is decoded with its own bits and with each of them flipped; two segments that
differ in 2 bits or fewer meet in a word one flip from both, so they share a codeword. A key is a
pair of segments with a codeword of each. Rows that share a key are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_text, stable
from .graph import connected_components

#: Fixed generator polynomial of the Golay code [23, 12, 7].
GENERATOR = 0b101011100011
#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows with one key that are compared in the task that meets them; longer runs are dealt out in blocks.
RUN = 512


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text's word shingles, as a signed number; 0 without words."""
    own = text.encode().lower().split() if text else []
    if not own:
        return 0
    whole = b" ".join(own)
    if len(own) <= words:
        hashes = [xxhash.xxh64_intdigest(whole, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)]
    return print_of(np.array(hashes, dtype="<u8"))


def print_of(hashes: np.ndarray) -> int:
    """A fingerprint bit is 1 if set in over half of the (unsigned) hashes."""
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(count * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


@lru_cache(1)
def decoder() -> np.ndarray:
    """The index of the nearest codeword of each 23-bit word, made in pieces: whole, its steps would take 15 times its size."""

    def syndrome(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0).astype(np.int32)
        return x

    flips = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)] + [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    error = np.zeros(1 << 11, dtype=np.int32)
    error[syndrome(np.array(flips, dtype=np.int32))] = flips
    out = np.empty(1 << 23, dtype=np.int16)
    for at in range(0, len(out), 1 << 16):
        words = np.arange(at, at + (1 << 16), dtype=np.int32)
        out[at : at + (1 << 16)] = (words ^ error[syndrome(words)]) >> 11
    return out


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices near each 23-bit word, and which of them are there."""
    near = np.empty((len(segment), 24), dtype=np.int16)
    table = decoder()
    near[:, 0] = table[segment]
    for i in range(23):
        near[:, i + 1] = table[segment ^ (1 << i)]
    near.sort(axis=1)
    new = np.ones(near.shape, dtype=bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    rank = np.cumsum(new, axis=1) - 1
    out, there = np.zeros((len(segment), 6), dtype=np.int64), np.zeros((len(segment), 6), dtype=bool)
    row, col = np.nonzero(new)
    out[row, rank[row, col]] = near[row, col]
    there[row, rank[row, col]] = True
    return out, there


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every key of every fingerprint."""
    bits = prints.view(np.uint64)
    near = [codewords(((bits >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64)) for a, w in SEGMENTS]
    keys, rows = [], []
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (x, there_x), (y, there_y) = near[i], near[j]
        key = (tag << 24) | (x[:, :, None] << 12) | y[:, None, :]
        row, a, b = np.nonzero(there_x[:, :, None] & there_y[:, None, :])
        keys.append(key[row, a, b])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def lowest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links a-b: every node that isn't the smallest it reaches, and that smallest node."""
    nodes, inverse = np.unique(np.r_[a, b], return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing bits; of a negative number numpy would count the bits of its magnitude."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def close_pairs(key: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different fingerprints within ``distance`` that share a key; ``key`` is sorted."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    left = np.repeat(size - 1, size) - (np.arange(len(key)) - np.repeat(first, size))  # rows of the run that follow
    at, found = np.flatnonzero(left > 0), []
    step = 1
    while len(at):
        near = differing(prints[at], prints[at + step]) <= distance
        if near.any():
            found.append((prints[at[near]], prints[at[near] + step]))
        step += 1
        at = at[left[at] >= step]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


PAIR = T.StructType([T.StructField("key", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def compare_runs(distance: int, run: int = RUN):
    """A mapper over rows (key, print) sorted by key: rows (null, node, smaller node) for links found,
    and (key, print, null) for the members of runs too long to be compared here."""

    def flush(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = close_pairs(key, prints, distance)
        node, label = lowest_labels(a, b) if len(a) else (a, b)
        return pa.RecordBatch.from_arrays([pa.nulls(len(node), pa.int64()), pa.array(node), pa.array(label)], names=PAIR.names)

    def late(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints), pa.nulls(len(key), pa.int64())], names=PAIR.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, prints, long_key = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            k, p = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if long_key is not None:
                n = int(np.searchsorted(k, long_key, side="right"))
                if n:
                    yield late(k[:n], p[:n])
                k, p = k[n:], p[n:]
                if not len(k):
                    continue
                long_key = None
            key, prints = np.r_[key, k], np.r_[prints, p]
            if not len(key):
                continue
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            long = np.repeat(size > run, size)
            if long.any():
                yield late(key[long], prints[long])
            tail = np.zeros(len(key), dtype=bool)
            if size[-1] > run:
                long_key = key[-1]
            else:
                tail[first[-1] :] = True
            now = ~long & ~tail
            yield flush(key[now], prints[now])
            key, prints = key[tail], prints[tail]
        if len(key):
            yield flush(key, prints)

    return work


def near_links(prints: DataFrame, distance: int = 4, run: int = RUN) -> DataFrame:
    """(a, b): links that connect all fingerprints which pairs within ``distance`` connect.

    ``prints`` has distinct fingerprints in its one column. Keys shared by more than ``run`` of them
    are cut in blocks, and each pair of blocks is compared in a group of its own.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the keys are complete up to distance 4")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                key, row = keys_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "print"])

    keyed = prints.toDF("print").mapInArrow(expand, "key long, print long")
    found = stable(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare_runs(distance, run), PAIR))
    links, late = found.where("key IS NULL").select("a", "b"), found.where("key IS NOT NULL").select("key", F.col("a").alias("print"))
    blocks = late.groupBy("key").agg(F.ceil(F.count("*") / F.lit(run)).cast("int").alias("n"))
    if blocks.limit(1).count():
        own = F.pmod(F.xxhash64("print"), F.col("n")).cast("int")
        dealt = late.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        dealt = dealt.select("key", "print", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

        def compare(table: pa.Table) -> pa.Table:
            p, own = table.column("print").to_numpy(), table.column("own").to_numpy()
            x = table.column("x")[0].as_py()
            left, right = p[own == x], p if (own == x).all() else p[own != x]
            a, b = [], []
            for at in range(0, len(left), 1024):
                i, j = np.nonzero(differing(left[at : at + 1024, None], right[None, :]) <= distance)
                a.append(left[at + i])
                b.append(right[j])
            node, label = lowest_labels(np.concatenate(a), np.concatenate(b)) if a else (left, left)
            return pa.table({"a": node, "b": label})

        links = links.union(dealt.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long"))
    return links.distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """Fingerprint and near-duplicate class of every document.

    Returns one row per row of ``docs``: ``id_col`` (long), fingerprint (16 lower-case hex digits),
    component_id: the smallest id reachable by links of at most ``distance`` differing bits, itself
    included, and kept: whether the row carries that id. Null and empty texts have fingerprint zero
    and link like any other. Rows with a null id link others and get their class, but are never its
    name; kept is false for them unless no row of the class has an id. Copies share a fingerprint
    and are compared once; no cap applies.
    """

    def make():
        return lambda texts: [[fingerprint(t, words, seed) for t in texts]]

    rows = map_text(docs.withColumn(id_col, F.col(f"`{id_col}`").cast("long")), [id_col], text_col, make, [T.StructField("__print", T.LongType())])
    rows = stable(rows.select(F.col(f"`{id_col}`").alias("id"), F.col("__print").alias("print")))
    distinct = stable(rows.groupBy("print").agg(F.min("id").alias("least")))
    groups = connected_components(near_links(distinct.select("print"), distance))
    grouped = distinct.join(groups.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = grouped.join(least, "component").select("print", "component_id")
    out = rows.join(classes, "print", "left")
    return out.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
