"""Token ids in files of compressed blocks: an adaptive context-mixing range coder.

A shard's ids are named by their rank: its head lists them from the most to the least frequent.
Within a block, tables of its own predict the next id from the last two ids and from the last one.
Counts seen in the confidence contexts of both predictions are added up: their mix gives the odds of
"as order 2 says", "as order 1 says" or neither, and a range coder codes which. Otherwise the order-0
prediction holds: the octave of the id's rank is coded with the block's adaptive counts, which follow
how often common and rare ids come, then its place among the ids of that octave, which are about
equally frequent. Blocks are reset and checksummed one by one, so numpy codes many of them side by
side, one id of each in every step.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import kept, written
from .bpe import Encoder, byte_letters

#: Fixed start of a shard: name and version.
MAGIC = b"IDMX\x02"
#: Ids of a block, and ids after which a shard is closed at the end of a document.
BLOCK, SHARD = 2_048, 1 << 20
#: Entries of a prediction table, octaves of ranks below 2^24 - 1.
TABLE, CLASSES = 1_024, 24
#: Counts are halved beyond these sums.
EVENT_SUM, CLASS_SUM = 1 << 10, 1 << 11
#: Blocks coded side by side, at most.
LANES = 4_096
FULL, WORD = np.uint64(1 << 62), np.uint64(1 << 46)


class Model:
    """The adaptive state of many blocks."""

    def __init__(self, lanes: int):
        self.base = np.arange(lanes, dtype=np.int64)
        self.id2, self.id1 = np.zeros(lanes * TABLE, np.int32), np.zeros(lanes * TABLE, np.int32)
        self.sure2, self.sure1 = np.zeros(lanes * TABLE, np.int8), np.zeros(lanes * TABLE, np.int8)
        start = np.array([1, 1, 2], dtype=np.int32)
        self.by2, self.by1 = np.tile(start, (lanes * 4, 1)), np.tile(start, (lanes * 4, 1))
        self.sizes = np.ones((lanes, CLASSES), dtype=np.int32)
        self.last, self.before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)

    def predict(self, n: int) -> tuple[np.ndarray, ...]:
        """Predicted ids and the mixed counts of the three events for the first n blocks."""
        base, last = self.base[:n], self.last[:n].astype(np.int64)
        mixed = (last * 0x9E3779B1 + self.before[:n].astype(np.int64) * 0x85EBCA6B) >> 7
        self.at2 = base * TABLE + (mixed & (TABLE - 1))
        self.at1 = base * TABLE + ((last * 0x9E3779B1 >> 7) & (TABLE - 1))
        self.row2, self.row1 = base * 4 + self.sure2[self.at2], base * 4 + self.sure1[self.at1]
        return self.id2[self.at2], self.id1[self.at1], self.by2[self.row2] + self.by1[self.row1]

    def update(self, n: int, ids: np.ndarray, event: np.ndarray, two: np.ndarray, one: np.ndarray) -> None:
        for rows, counts in ((self.row2, self.by2), (self.row1, self.by1)):
            counts[rows, event] += 24
            full = np.flatnonzero(counts[rows, event] > EVENT_SUM)
            if len(full):
                counts[rows[full]] = (counts[rows[full]] + 1) >> 1
        for at, sure, table, said in ((self.at2, self.sure2, self.id2, two), (self.at1, self.sure1, self.id1, one)):
            right = said == ids
            sure[at] = np.where(right, np.minimum(sure[at] + 1, 3), np.maximum(sure[at] - 2, 0))
            table[at] = np.where(right | (sure[at] > 0), said, ids)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids

    def count_size(self, lanes: np.ndarray, size: np.ndarray) -> None:
        self.sizes[lanes, size] += 24
        full = lanes[self.sizes[lanes, size] > CLASS_SUM]
        if len(full):
            self.sizes[full] = (self.sizes[full] + 1) >> 1


def size_class(ranks: np.ndarray) -> np.ndarray:
    """Bits of rank + 1 after its first."""
    return np.frexp((ranks + 1).astype(np.float32))[1].astype(np.int64) - 1


def u64(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Code the blocks; each is an array of ranks from 0 to 2^24 - 2."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    for at in range(0, len(order), LANES):
        lanes = order[at : at + LANES]
        sizes = np.array([len(blocks[k]) for k in lanes])
        longest = int(sizes[0]) if len(sizes) else 0
        ids = np.zeros((longest, len(lanes)), dtype=np.int32)
        for j, k in enumerate(lanes):
            ids[: sizes[j], j] = blocks[k]
        # a step takes at most 61 bits, so 4 words; most take one
        words, used = np.zeros((len(lanes), longest + 8), dtype="<u2"), np.zeros(len(lanes), np.int64)
        low, span = np.zeros(len(lanes), np.uint64), np.full(len(lanes), FULL)
        model = Model(len(lanes))

        def settle(own: np.ndarray, low=low, span=span, used=used) -> None:
            nonlocal words
            while len(own):
                a, s = low[own], span[own]
                same = (a ^ (a + s - np.uint64(1))) >> np.uint64(46) == 0
                small = ~same & (s < WORD)
                if small.any():  # cut the span at the next word, so that its words agree
                    cut = own[small]
                    span[cut] = WORD - (low[cut] & (WORD - np.uint64(1)))
                    same |= small
                own = own[same]
                if not len(own):
                    return
                if int(used[own].max()) + 1 > words.shape[1]:
                    words = np.concatenate([words, np.zeros_like(words)], axis=1)
                words[own, used[own]] = (low[own] >> np.uint64(46)).astype(np.uint16)
                used[own] += 1
                low[own] = (low[own] & (WORD - np.uint64(1))) << np.uint64(16)
                span[own] <<= np.uint64(16)

        for step in range(longest):
            n = int(np.searchsorted(-sizes, -step, side="left"))
            now = ids[step, :n]
            two, one, counts = model.predict(n)
            event = np.where(now == two, 0, np.where(now == one, 1, 2))
            rows = np.arange(n)
            start = np.where(event > 0, counts[:, 0], 0) + np.where(event > 1, counts[:, 1], 0)
            unit = span[:n] // u64(counts.sum(axis=1))
            low[:n] += unit * u64(start)
            span[:n] = unit * u64(counts[rows, event])
            own = np.flatnonzero(event == 2)
            if len(own):
                literal = now[own]
                size = size_class(literal)
                table = model.sizes[own]
                ends = np.cumsum(table, axis=1)
                some = np.arange(len(own))
                unit = span[own] // u64(ends[:, -1])
                low[own] += unit * u64(ends[some, size] - table[some, size])
                span[own] = unit * u64(table[some, size])
                unit = span[own] >> u64(size)
                low[own] += unit * u64(literal + 1 - (1 << size))
                span[own] = unit
                model.count_size(own, size)
            model.update(n, now, event, two, one)
            settle(rows)
        for j, k in enumerate(lanes):
            # the value named by the last words lies inside the span whatever follows it
            end = int(low[j]) + int(span[j]) // 2
            tail = np.array([end >> 46, (end >> 30) & 0xFFFF, (end >> 14) & 0xFFFF], dtype="<u2")
            out[k] = words[j, : used[j]].tobytes() + tail.tobytes()
    return out


def decode_blocks(packed: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of blocks that encode_blocks made."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(packed)
    order = sorted(range(len(packed)), key=lambda k: -lengths[k])
    for at in range(0, len(order), LANES):
        lanes = order[at : at + LANES]
        sizes = np.array([lengths[k] for k in lanes])
        longest = int(sizes[0]) if len(sizes) else 0
        ids = np.zeros((longest, len(lanes)), dtype=np.int32)
        width = max(len(packed[k]) for k in lanes) // 2 + 8
        words = np.zeros((len(lanes), width), dtype=np.uint64)
        for j, k in enumerate(lanes):
            words[j, : len(packed[k]) // 2] = np.frombuffer(packed[k], dtype="<u2")
        read = np.full(len(lanes), 4)
        # value: the code less the span's low end; 62 bits are in view
        low, span = np.zeros(len(lanes), np.uint64), np.full(len(lanes), FULL)
        code = (words[:, 0] << np.uint64(46)) | (words[:, 1] << np.uint64(30)) | (words[:, 2] << np.uint64(14)) | (words[:, 3] >> np.uint64(2))
        model = Model(len(lanes))
        for step in range(longest):
            n = int(np.searchsorted(-sizes, -step, side="left"))
            two, one, counts = model.predict(n)
            rows = np.arange(n)
            unit = span[:n] // u64(counts.sum(axis=1))
            value = (code[:n] - low[:n]) // unit
            first, second = u64(counts[:, 0]), u64(counts[:, 0] + counts[:, 1])
            event = (value >= first).astype(np.int64) + (value >= second)
            low[:n] += unit * np.where(event > 1, second, np.where(event > 0, first, np.uint64(0)))
            span[:n] = unit * u64(counts[rows, event])
            now = np.where(event == 0, two, one)
            own = np.flatnonzero(event == 2)
            if len(own):
                table = model.sizes[own]
                ends = np.cumsum(table, axis=1)
                some = np.arange(len(own))
                unit = span[own] // u64(ends[:, -1])
                value = ((code[own] - low[own]) // unit).astype(np.int64)
                size = np.minimum((value[:, None] >= ends).sum(axis=1), CLASSES - 1)
                low[own] += unit * u64(ends[some, size] - table[some, size])
                span[own] = unit * u64(table[some, size])
                unit = span[own] >> u64(size)
                rest = np.minimum((code[own] - low[own]) // unit, (np.uint64(1) << u64(size)) - np.uint64(1))
                low[own] += unit * rest
                span[own] = unit
                now[own] = (rest.astype(np.int64) + (1 << size) - 1).astype(np.int32)
                model.count_size(own, size)
            ids[step, :n] = now
            model.update(n, now, event, two, one)
            own = rows
            while len(own):
                a, s = low[own], span[own]
                same = (a ^ (a + s - np.uint64(1))) >> np.uint64(46) == 0
                small = ~same & (s < WORD)
                if small.any():
                    cut = own[small]
                    span[cut] = WORD - (low[cut] & (WORD - np.uint64(1)))
                    same |= small
                own = own[same]
                if not len(own):
                    break
                low[own] = (low[own] & (WORD - np.uint64(1))) << np.uint64(16)
                span[own] <<= np.uint64(16)
                # 62 bits in view start two bits into the fourth word
                here = words[own, np.minimum(read[own] - 1, width - 1)] & np.uint64(3)
                there = words[own, np.minimum(read[own], width - 1)]
                code[own] = ((code[own] & (WORD - np.uint64(1))) << np.uint64(16)) | (here << np.uint64(14)) | (there >> np.uint64(2))
                read[own] += 1
        for j, k in enumerate(lanes):
            out[k] = ids[: sizes[j], j].copy()
    return out


def ranks_of(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids by falling frequency, then by number; the rank of each id of the stream)."""
    found, inverse, counts = np.unique(stream, return_inverse=True, return_counts=True)
    order = np.lexsort((found, -counts))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return found[order], rank[inverse]


def pack_shards(shards: list[tuple[list, list[np.ndarray]]]) -> list[bytes]:
    """One byte string for each shard: (document ids, their arrays of token ids).

    Layout, little-endian: MAGIC; counts of documents, ids, blocks and different ids (u64 each); for
    each document its id (i64), whether it has one (u8) and its number of ids (u64); the different ids
    by rank (u32 each); for each block its numbers of ids and bytes (u32 each) and the crc32 of its ids
    as u32 (u32); crc32 of all that (u32); blocks.
    """
    cut: list[np.ndarray] = []
    of: list[tuple[np.ndarray, np.ndarray]] = []
    for _, arrays in shards:
        stream = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
        table, ranks = ranks_of(stream)
        cut += [ranks[a : a + BLOCK] for a in range(0, len(stream), BLOCK)]
        of.append((table, stream))
    coded, out, at = encode_blocks(cut), [], 0
    for (docs, arrays), (table, stream) in zip(shards, of, strict=True):
        own = [stream[a : a + BLOCK] for a in range(0, len(stream), BLOCK)]
        bodies = coded[at : at + len(own)]
        at += len(own)
        head = MAGIC + struct.pack("<QQQQ", len(docs), len(stream), len(own), len(table))
        head += np.array([d or 0 for d in docs], dtype="<i8").tobytes() + bytes(d is not None for d in docs) + np.array([len(a) for a in arrays], dtype="<u8").tobytes()
        head += table.astype("<u4").tobytes()
        head += np.array([(len(b), len(c), zlib.crc32(b.astype("<u4").tobytes())) for b, c in zip(own, bodies, strict=True)], dtype="<u4").tobytes()
        out.append(head + struct.pack("<I", zlib.crc32(head)) + b"".join(bodies))
    return out


def unpack_shards(shards: list[bytes]) -> list[tuple[list, list[np.ndarray]]]:
    """What pack_shards was given; raises ValueError where a checksum doesn't hold."""
    heads, bodies, sizes, sums = [], [], [], []
    for data in shards:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        docs, _, n, different = struct.unpack_from("<QQQQ", data, len(MAGIC))
        at = len(MAGIC) + 32
        end = at + 17 * docs + 4 * different + 12 * n
        if len(data) < end + 4 or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
            raise ValueError("a shard's head is damaged")
        names = np.frombuffer(data, "<i8", docs, at)
        there = np.frombuffer(data, "u1", docs, at + 8 * docs)
        lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        ranked = np.frombuffer(data, "<u4", different, at + 17 * docs).astype(np.int32)
        table = np.frombuffer(data, "<u4", 3 * n, at + 17 * docs + 4 * different).reshape(n, 3).astype(np.int64)
        ends = end + 4 + np.cumsum(table[:, 1])
        bodies += [data[e - s : e] for e, s in zip(ends.tolist(), table[:, 1].tolist(), strict=True)]
        sizes += table[:, 0].tolist()
        sums += table[:, 2].tolist()
        heads.append(([int(x) if t else None for x, t in zip(names, there, strict=True)], lengths, n, ranked))
    blocks, out, at = decode_blocks(bodies, sizes), [], 0
    for names, lengths, n, ranked in heads:
        own = []
        for b, c in zip(blocks[at : at + n], sums[at : at + n], strict=True):
            ids = ranked[b] if not len(b) or int(b.max()) < len(ranked) else None
            if ids is None or zlib.crc32(ids.astype("<u4").tobytes()) != c:
                raise ValueError("a block is damaged")
            own.append(ids)
        at += n
        stream = np.concatenate(own) if own else np.zeros(0, np.int32)
        out.append((names, np.split(stream, np.cumsum(lengths)[:-1]) if len(names) else []))
    return out


class LibraryEncoder(Encoder):
    """Ids from the tokenizers library, asked once for each piece it has not met."""

    def __init__(self, file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        super().__init__()

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and the number of each piece's.

        Pieces that begin with a space before a word go to the library joined, many at a time: a
        cut before such a space never changes ids. Each id's bytes then tell where pieces end.
        """
        if not hasattr(self, "lengths"):
            letters, special = byte_letters(), {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.lengths = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
            for token, i in vocab.items():
                self.lengths[i] = len(token.encode()) if token in special or not all(c in letters for c in token) else len(token)
        starts, alone = [], True
        for k, piece in enumerate(pieces):
            own = len(piece) > 64 or piece[0] != " " or not piece[1:2].strip()
            if own or alone or k - starts[-1] >= 512:
                starts.append(k)
                alone = own
        ends = [*starts[1:], len(pieces)]
        joined = ["".join(pieces[a:b]) for a, b in zip(starts, ends, strict=True)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int32)
        reach = np.cumsum(self.lengths[ids])
        wanted = np.cumsum(np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in pieces), np.int64, len(pieces)))
        at = np.searchsorted(reach, wanted, side="left")
        if not (reach[at] == wanted).all():
            raise ValueError("ids don't line up with the pieces")
        return ids, np.diff(np.r_[0, at + 1])


def library_encoder(file: str) -> LibraryEncoder:
    return kept(("library", file), lambda: LibraryEncoder(file))


def write_token_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the ids in ascending order of ``id_col``.

    ``path`` becomes a table with one row per shard: place (ascending in the order of the documents;
    the writing task is its upper part), n_ids and data, the shard's bytes. Each document's ids are
    followed by ``end_id``. Null texts count as empty; null ids come first; rows with equal ids keep
    together, ordered by their text. A shard ends after the document that brings it to SHARD ids, and
    its blocks are cut regardless of documents, so a very long text only makes a longer shard.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, made = library_encoder(vocabulary), 0, 0
        waiting: list[tuple[list, list[np.ndarray]]] = []
        names, arrays, size, total = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal made, total
            data = pack_shards(waiting)
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 33) + made + k for k in range(len(data))], pa.int64()), pa.array([sum(map(len, a)) for _, a in waiting], pa.int64()), pa.array(data, pa.binary())], names=["place", "n_ids", "data"]
            )
            made, total = made + len(data), 0
            waiting.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                ids, texts = batch.column(0).slice(at, 1_024).to_pylist(), batch.column(1).slice(at, 1_024).to_pylist()
                part = batch.column(2)[0].as_py()
                encoder.room()
                numbers = [encoder.number(t or "") for t in texts]
                encoder.settle()
                for name, n in zip(ids, numbers, strict=True):
                    own = np.append(encoder.ids(n), np.int32(end_id))
                    names.append(name)
                    arrays.append(own)
                    size += len(own)
                    if size >= SHARD:
                        waiting.append((names, arrays))
                        total += size
                        names, arrays, size = [], [], 0
                        if total >= LANES * BLOCK:
                            yield flush()
        if names:
            waiting.append((names, arrays))
        if waiting:
            yield flush()

    rows.mapInArrow(run, "place long, n_ids long, data binary").write.mode("errorifexists").parquet(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(start, data) of the shards in a table that write_token_ids made: start counts the ids before."""
    shards = spark.read.parquet(path)
    part = F.shiftright("place", 33)
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    small = shards.select("place", "n_ids", part.alias("part")).withColumn("before", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    # one row per writing task
    totals = small.groupBy("part").agg(F.sum("n_ids").alias("n"))
    totals = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    starts = small.join(F.broadcast(totals), "part").select("place", (F.col("before") + F.col("offset")).alias("start"))
    # of known size once written, so Spark need not shuffle the shards to join it
    return shards.join(written(starts, "shard-starts"), "place").select("start", "data")


def digest_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document, in the files' terms: doc_id, start, n_tokens and ids_crc32 (of its ids as u32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                found = unpack_shards(batch.column(1).slice(at, 8).to_pylist())
                for start, (names, arrays) in zip(batch.column(0).slice(at, 8).to_pylist(), found, strict=True):
                    n = np.array([len(a) for a in arrays], dtype=np.int64)
                    crc = [zlib.crc32(a.astype("<u4").tobytes()) for a in arrays]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_token_ids(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
