"""Near-duplicate texts by SimHash, and by exact keys for what it leaves.

Every text's set of word shingles has a fingerprint; fingerprints that Golay codewords find within 4
bits are compared on whole sets, and sets that are alike to 0.8 (Jaccard) are linked. Fingerprints of
such sets may differ in more bits, so an exact search for the rest follows: two sets that similar
differ in at most a quarter of the smaller one's size, so of more parts of the range of hashes
than that one holds the same shingles in both. A key is the content of a part, some four shingles; a
passage that texts share seldom fills a part, so it makes few keys common. Keys of the same sets are
one. A histogram of a set's hashes bounds the similarity from above. Of the sets of a key, of different
classes so far, that it allows to be similar, each is first verified with one at a time, the first in an order
drawn anew, which brings groups of near copies down to classes in linear work; then all pairs that
are still in different classes are, as those of short keys are at once. Every link is verified on the whole sets.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import forget, map_text, stable, steps, written
from .graph import connected_components
from .simhash import near_links, print_of

#: In keys of so many sets or more a set is verified with one other at a time, in so many turns at most.
FREQUENT, TURNS = 5, 6
#: Turns end when one leaves more than this share of the pairs that it verifies without a link: then most of the rest aren't similar.
LEFT = 0.8
#: Smallest sizes of the classes that sets with the same number of parts are in; a class reaches a quarter further.
LOWS = [1]
while LOWS[-1] < 1 << 40:
    LOWS.append(LOWS[-1] * 5 // 4 + 1)
#: Places of the histogram of a set.
PLACES = 256
#: Sets of one key compared in one group, at most, and rows of a group aimed at.
BLOCK, GROUP = 512, 16_384
#: Sets that are to be made again are broadcast up to this number of 16-byte rows, and joined by a shuffle beyond it.
BROADCAST_SETS = 1_000_000


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, one without words none."""
    own = text.encode().lower().split() if text else []
    if not own:
        return np.zeros(0, dtype=np.int64)
    whole, digest = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= words:
        hashes = [digest(whole, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        hashes = [digest(whole[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)]
    return np.unique(np.array(hashes, dtype=np.uint64).view(np.int64))


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """Another number for every number; products wrap."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def keys_of(own: np.ndarray) -> np.ndarray:
    """Keys of a sorted set, of which sets that are alike to 0.8 have one in common.

    Two such sets differ in n // 4 shingles at most, n being the size of the smaller. For the sets of a class
    the range of hashes is cut in more parts than that; a set has a key for each part that it fills,
    of its own class and, if it may be the larger of a pair, of the class below. Each difference
    spoils one part, so a set that fills more parts than there are differences shares one with every similar set. Sets
    that fill fewer have their first shingles as keys besides, a fifth of all and one in the
    order of the hashes, by which they find one another.
    """
    n = len(own)
    if n < 4:
        return np.zeros(0, np.int64)  # alike to 0.8 are only equal ones
    unsigned = own.view(np.uint64) ^ np.uint64(1 << 63)
    high, content = unsigned >> np.uint64(32), mixed_bits(unsigned)
    level = bisect_right(LOWS, n) - 1
    out, thin = [], False
    for k in (level, level - 1):
        most = LOWS[k + 1] - 1
        if k < level and 4 * n > 5 * most:
            break
        parts = most // 4 + 2 + most // 60
        part = (high * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out.append(np.add.reduceat(content, first) + mixed_bits(part[first] + np.uint64(k << 40)))
        thin |= len(first) <= min(n, most) // 4
    if thin:
        out.append(mixed_bits(content[: n - (4 * n + 4) // 5 + 1]))
    return np.concatenate(out).view(np.int64)


def packed(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))


def histogram(own: np.ndarray) -> bytes:
    return np.minimum(np.bincount(own & (PLACES - 1), minlength=PLACES), 255).astype(np.uint8).tobytes()


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, sig) sorted by both, which may repeat: (key, sig) of every key with two sets or more."""
    last, told = None, False

    def rows(key, sig):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(sig, pa.int64())], names=["key", "sig"])

    for batch in batches:
        key, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.r_[True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])] if len(key) else np.zeros(0, bool)
        if last is not None and len(key):
            new[0] = (key[0], sig[0]) != last
        key, sig = key[new], sig[new]
        if last is not None and len(key) and key[0] == last[0]:
            n = int(np.searchsorted(key, last[0], side="right"))
            if not told:
                yield rows([last[0]], [last[1]])
                told = True
            yield rows(key[:n], sig[:n])
            last = key[n - 1], sig[n - 1]
            key, sig = key[n:], sig[n:]
        if not len(key):
            continue
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        many = np.repeat(size > 1, size)
        yield rows(key[many], sig[many])
        last, told = (key[-1], sig[-1]), bool(size[-1] > 1)


def near_pairs(left: tuple, right: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs in different classes whose sizes and histograms allow 0.8; of ``left`` alone without ``right``."""
    class_a, size_a, hist_a = left
    class_b, size_b, hist_b = right or left
    i_all, j_all = [], []
    for at in range(0, len(size_a), 64):
        a = slice(at, at + 64)
        n, m = size_a[a, None], size_b[None, :]
        ok = (class_a[a, None] != class_b[None, :]) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
        if right is None:
            ok &= np.arange(at, at + ok.shape[0])[:, None] < np.arange(len(size_b))[None, :]
        i, j = np.nonzero(ok)
        # the sets differ in at least as many shingles as their histograms, and in a ninth of both at most
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            near = 9 * np.abs(hist_a[a][x] - hist_b[y]).sum(axis=1, dtype=np.int64) <= size_a[a][x] + size_b[y]
            i_all.append(x[near] + at)
            j_all.append(y[near])
    return (np.concatenate(i_all), np.concatenate(j_all)) if i_all else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def first_partners(a: np.ndarray, b: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs a-b one for each set: that with the partner that comes first in the order of the turn, the same for all sets."""
    own, other = np.r_[a, b], np.r_[b, a]
    place = mixed_bits(mixed_bits(other.view(np.uint64) + np.uint64(turn)))
    order = np.lexsort((place, own))
    own, other = own[order], other[order]
    first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
    return own[first], other[first]


def compare_units(table: pa.Table, turn: int | None = None, frequent: int = FREQUENT) -> pa.Table:
    """Pairs (a < b) that the units of a bucket leave to be verified; with a turn, of units of ``frequent`` sets or more, one for each set."""
    unit = table.column("unit").to_numpy()
    order = np.argsort(unit, kind="stable")
    unit = unit[order]
    col = {c: table.column(c).to_numpy()[order] for c in ("sig", "class", "size", "own", "x")}
    hist = np.frombuffer(b"".join(table.column("hist").to_pylist()), dtype=np.uint8).reshape(-1, PLACES)[order].astype(np.int16)
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    found_a, found_b, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for s, e in zip(starts, np.r_[starts[1:], len(unit)], strict=True):
        at = np.arange(s, e)
        mine = col["own"][at] == col["x"][at]
        left, right = at[mine], at[~mine]
        take = lambda r: (col["class"][r], col["size"][r], hist[r])
        i, j = near_pairs(take(left), take(right) if len(right) else None)
        found_a.append(col["sig"][left[i]])
        found_b.append(col["sig"][(right if len(right) else left)[j]])
        many.append(np.full(len(i), e - s >= frequent))
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if turn is not None:
        many = np.concatenate(many)
        one_a, one_b = first_partners(a[many], b[many], turn)
        a, b = np.r_[a[~many], one_a], np.r_[b[~many], one_b]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, sizes, histograms) that the histograms allow to be similar."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, PLACES).astype(np.int16) for c in (4, 5))
        ok = 9 * np.abs(x - y).sum(axis=1, dtype=np.int64) <= batch.column(2).to_numpy() + batch.column(3).to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, text_hash, class) of every row: texts linked by a Jaccard similarity of 0.8 or more share a class.

    Shingles are of ``words`` words, split at ASCII white space, ASCII letters in lower case. Texts
    with equal sets of shingles are one; so are all null texts and those without words, which link
    with nothing else. Classes are the connected components of all similar pairs; no pair is left
    out by a cap or by chance. text_hash is xxhash64 of the text.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def signature(own: np.ndarray) -> int:
        return xxhash.xxh64_intdigest(own.tobytes(), 1)

    def make():
        forget()

        def work(batch: list) -> list:
            sets = [shingle_set(t, words) for t in batch]
            sigs = np.array([signature(s) for s in sets], dtype=np.uint64).view(np.int64)
            prints = [print_of(s.view(np.uint64)) if len(s) else 0 for s in sets]
            return [pa.array(sigs), pa.array(list(map(len, sets)), pa.int64()), pa.array(prints, pa.int64()), pa.array([histogram(s) for s in sets], pa.binary())]

        return work

    def make_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[int] = set()  # copies are told once in a task, and are left out by shared_keys beyond that
        for batch in batches:
            part = batch.column(0).to_pylist()
            for a, b in steps(part):
                sigs, keys = [], []
                for text in part[a:b]:
                    own = shingle_set(text, words)
                    sig = signature(own)
                    if sig not in seen:
                        seen.add(sig)
                        sigs.append(sig)
                        keys.append(keys_of(own))
                if keys:
                    sig = np.repeat(np.array(sigs, dtype=np.uint64).view(np.int64), list(map(len, keys)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(sig)], names=["key", "sig"])

    fields = [T.StructField("sig", T.LongType()), T.StructField("size", T.LongType()), T.StructField("print", T.LongType()), T.StructField("hist", T.BinaryType())]
    rows = written(map_text(texts, ["id", "text_hash"], "text", make, fields), "shingles")
    sets = written(rows.select("sig", "text_hash", "size", "print", "hist").dropDuplicates(["sig"]), "sets")
    keyed = texts.select("text").mapInArrow(make_keys, "key long, sig long").repartition("key").sortWithinPartitions("key", "sig")
    shared = stable(keyed.mapInArrow(shared_keys, "key long, sig long"))
    if not shared.limit(1).count():
        return rows.select("id", "text_hash", F.col("sig").alias("class"))

    side = lambda name: sets.select(F.col("sig").alias(name), F.col("size").alias(f"size_{name}"), F.col("hist").alias(f"hist_{name}"))
    named = lambda df: connected_components(df).select(F.col("node").alias("sig"), F.col("component").alias("class"))

    def near(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose sizes and histograms allow 0.8."""
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").where("5 * least(size_a, size_b) >= 4 * greatest(size_a, size_b)")
        return stable(pairs.select("a", "b", "size_a", "size_b", "hist_a", "hist_b").mapInArrow(allowed, "a long, b long"))

    def links(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` that are similar; whole sets are made again from one text of each, and moved for these pairs only."""
        live = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        live = written(live.join(sets.select("sig", "text_hash"), "sig"), "live")
        own = texts.select("text_hash", "text").join(F.broadcast(live) if live.count() <= BROADCAST_SETS else live, "text_hash").groupBy("sig").agg(F.first("text").alias("text"))
        whole = written(map_text(own, ["sig"], "text", lambda: lambda batch: [packed([shingle_set(t, words) for t in batch])], [T.StructField("whole", T.ArrayType(T.LongType()))]), "whole-sets")
        own = lambda name: whole.select(F.col("sig").alias(name), F.col("whole").alias(f"set_{name}"))
        # compared row by row in the JVM: two whole sets a row are too much for batches of a fixed number of rows
        similar = "9 * size(array_intersect(set_a, set_b)) >= 4 * (size(set_a) + size(set_b))"
        return written(pairs.join(own("a"), "a").join(own("b"), "b").where(similar).select("a", "b"), "links")

    def candidates(member: DataFrame, copies: int, turn: int | None) -> DataFrame:
        """Pairs of sets of a key, in different classes, that may be similar; with a turn all of short keys, one for each set of others."""
        dealt = member.join(sets.select("sig", "size", "hist"), "sig")
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumn("x", F.least("own", "other")).withColumn("unit", F.xxhash64("key", "x", F.greatest("own", "other")))
        dealt = dealt.withColumn("bucket", F.pmod("unit", F.lit(max(1, math.ceil(copies / GROUP)))))
        rows = dealt.select("bucket", "unit", "sig", "class", "size", "own", "x", "hist").groupBy("bucket")
        frequent = FREQUENT  # as it is here, for the workers
        return rows.applyInArrow(lambda table: compare_units(table, turn, frequent), "a long, b long")

    # the classes of the fingerprints: each set is compared with the first of its own
    prints = stable(sets.where("size >= 4").select("sig", "print"))
    groups = connected_components(near_links(prints.select("print").distinct()))
    alike = prints.join(groups.withColumnRenamed("node", "print"), "print", "left").withColumn("group", F.coalesce("component", "print"))
    lead = alike.groupBy("group").agg(F.min("sig").alias("a"))
    found = links(near(alike.join(lead, "group").where("sig <> a").select("a", F.col("sig").alias("b"))))
    classes = named(found)
    # the rest, by the keys: those with one class have nothing more to tell, those of the same sets tell the same
    left, last = shared, False
    for turn in range(TURNS + 1):
        last = last or turn == TURNS
        member = stable(left.join(classes, "sig", "left").select("key", "sig", F.coalesce("class", "sig").alias("class")))
        told = [F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), *[F.bit_xor(F.xxhash64("sig", F.lit(k))).alias(f"x{k}") for k in (1, 2)]]
        mixed = member.groupBy("key").agg(*told).where("low < high").groupBy("n", "low", "high", "x1", "x2").agg(F.min("key").alias("key"))
        mixed = stable(mixed.select("key", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"), "n"))
        copies = mixed.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0]
        if not copies:
            break
        member = member.join(mixed, "key")
        pairs = stable(candidates(member, copies, None if last else turn).distinct())
        tried = pairs.count()
        if not tried:
            break
        new = links(pairs)
        found = found.union(new)
        classes = named(found)
        if last:
            break
        last = tried - new.count() > LEFT * tried
        # short keys are done; a set that may be similar to none of its keys' has no pair here, and never will: classes only grow
        left = member.where(F.col("n") >= FREQUENT).select("key", "sig").join(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "sig", "left_semi")
    out = rows.select("id", "text_hash", "sig").join(classes, "sig", "left")
    return out.select("id", "text_hash", F.coalesce("class", "sig").alias("class"))
