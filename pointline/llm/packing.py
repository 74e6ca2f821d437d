"""Mixture-controlled packing: deficit round-robin over one queue of tokens per source.

In each round a queue's deficit grows by its quantum, its share of a window in fractions of a
token; the queue serves as many whole tokens as its deficit holds and keeps the rest. A queue that
runs dry leaves, and the others share its part from then on. The rounds' tokens make one stream,
and sequences are cut from it one after another, so that a round that a window's end cuts goes on
in the next window. All deficits of a round follow from the round's number, the quanta and what was
left over when a queue last ran dry: so each document finds its rounds, and with them its places in
the stream, by itself, in whatever task it lies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running_totals
from .batches import kept, stable, steps, written
from .idcoder import LibraryEncoder

#: Bits of a token's fraction in a deficit. Token counts stay exact up to 2 ** (62 - FRACTION) of one source.
FRACTION = 16
#: Tokens of a window below which sources share one queue; so there are at most window / LEAST queues beside it.
LEAST = 16
#: Ids that one step of a task places.
STEP_IDS = 500_000
#: Pieces of text that a worker remembers the ids of before it forgets those it met only once.
REMEMBERED = 800_000


class Rounds:
    """The rounds over queues of given sizes: where each queue's tokens come to lie in the stream."""

    def __init__(self, sizes: list[int], weights: list[float], window: int):
        if max(sizes, default=0) >> (62 - FRACTION):
            raise ValueError("a source has too many tokens")
        n, one = len(sizes), 1 << FRACTION
        left, carry, live = list(sizes), [0] * n, {s for s in range(n) if sizes[s]}
        served, quanta, carries, at = [[0] * n], [], [], [0]
        while live:
            shares = {s: max(weights[s], 0.0) for s in live}
            if not sum(shares.values()):
                shares = dict.fromkeys(live, 1.0)
            whole = sum(shares.values())
            quantum = [0] * n
            for s, w in shares.items():
                quantum[s] = max(1, round(window * one * w / whole)) if w else 0
            need = {s: -(-((left[s] << FRACTION) - carry[s]) // quantum[s]) for s in live if quantum[s]}
            last = min(need.values())
            quanta.append(quantum)
            carries.append(list(carry))
            gone = []
            for s in live:
                credit = carry[s] + last * quantum[s]
                gone.append(min(left[s], credit >> FRACTION))
                left[s] -= gone[-1]
                carry[s] = credit - (gone[-1] << FRACTION) if left[s] else 0
            served.append([a - b for a, b in zip(sizes, left, strict=True)])
            at.append(at[-1] + sum(gone))
            live = {s for s in live if left[s]}
        self.total = at[-1]
        self.served = np.array(served, np.int64).reshape(-1, n)  # before each stretch of rounds with the same queues
        self.quanta, self.carries = np.array(quanta, np.int64).reshape(-1, n), np.array(carries, np.int64).reshape(-1, n)
        self.left = self.served[-1] - self.served
        self.at = np.array(at, np.int64)

    def count(self, stretch: np.ndarray, queue: int, r: np.ndarray) -> np.ndarray:
        """Tokens that a queue has served in the stretch before its round r."""
        return np.minimum(self.left[stretch, queue], (self.carries[stretch, queue] + r * self.quanta[stretch, queue]) >> FRACTION)

    def places(self, queue: int, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start in it, tokens, place in the stream) of the parts that rounds cut from tokens first .. first + length of a queue."""
        own = self.served[:, queue]
        a, b = np.searchsorted(own, first, "right") - 1, np.searchsorted(own, first + length - 1, "right") - 1
        doc, stretch = ranges(a, b + 1)
        base = own[stretch]
        low, high = np.maximum(first[doc], base) - base, np.minimum(first[doc] + length[doc], own[stretch + 1]) - base
        quantum, carry = self.quanta[stretch, queue], self.carries[stretch, queue]
        some = (high > low) & (quantum > 0)
        doc, stretch, low, high, quantum, carry = (x[some] for x in (doc, stretch, low, high, quantum, carry))
        turn = lambda k, q, c: -((c - ((k + 1) << FRACTION)) // q) - 1  # noqa: E731  the round that serves token k
        # a queue with less than a token a round goes token by token, for most of its rounds serve none
        slow = quantum < 1 << FRACTION
        part, r = ranges(np.where(slow, low, turn(low, quantum, carry)), np.where(slow, high, turn(high - 1, quantum, carry) + 1))
        r = np.where(slow[part], turn(r, quantum[part], carry[part]), r)
        stretch = stretch[part]
        start, end = np.maximum(low[part], self.count(stretch, queue, r)), np.minimum(high[part], self.count(stretch, queue, r + 1))
        some = end > start
        part, stretch, r, start, end = (x[some] for x in (part, stretch, r, start, end))
        place = self.at[stretch] + start
        for other in range(self.served.shape[1]):
            if other != queue:
                place += self.count(stretch, other, r + 1 if other < queue else r)
        doc = doc[part]
        return doc, start + own[stretch] - first[doc], end - start, place


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the number of each number from start to end (exclusive) of each row."""
    n = np.maximum(end - start, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[row]


class Sequences:
    """Cuts the stream: ``length`` tokens each, the rest as powers of two, so that no sequence is padded."""

    def __init__(self, total: int, length: int):
        self.length, self.full = length, total // length
        rest, ends = total % length, [self.full * length]
        for bit in reversed(range(length.bit_length())):
            if rest >> bit & 1:
                ends.append(ends[-1] + (1 << bit))
        self.ends = np.array(ends, np.int64)

    def number(self, place: np.ndarray) -> np.ndarray:
        return np.where(place < self.ends[0], place // self.length, self.full + np.searchsorted(self.ends, place, "right") - 1)

    def start(self, number: np.ndarray) -> np.ndarray:
        return np.where(number < self.full, number * self.length, self.ends[np.clip(number - self.full, 0, len(self.ends) - 1)])

    def cut(self, doc: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start, length, sequence, offset) of each piece; parts that lie together in a sequence are one piece."""
        part, number = ranges(self.number(place), self.number(place + length - 1) + 1)
        low = np.maximum(place[part], self.start(number))
        high = np.minimum((place + length)[part], self.start(number + 1))
        doc, start = doc[part], start[part] + low - place[part]
        order = np.lexsort((start, doc))
        doc, start, number, low, high = (x[order] for x in (doc, start, number, low, high))
        head = np.r_[True, (doc[1:] != doc[:-1]) | (number[1:] != number[:-1]) | (low[1:] != high[:-1])][: len(doc)]
        at = np.flatnonzero(head)
        ends = high[np.r_[at[1:], len(doc)] - 1] if len(at) else at
        return doc[at], start[at], ends - low[at], number[at], low[at] - self.start(number[at])


class FrequentEncoder(LibraryEncoder):
    """Ids from the tokenizers library; where it has met too many pieces, it forgets the rare ones."""

    def __init__(self, file: str):
        self.kept = None
        super().__init__(file)
        self.limit = REMEMBERED

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return super().encode_pieces(pieces) if self.kept is None else self.kept

    def clear(self) -> None:
        super().clear()
        self.uses = np.zeros(0, np.int64)

    def room(self) -> None:
        if len(self.pieces) <= self.limit:
            return
        uses = self.uses[: self.count]
        least = max(2, int(np.partition(uses, -self.limit // 2)[-self.limit // 2]) + 1)
        stay = np.flatnonzero(uses >= least)
        names, self.kept = list(self.pieces), (self.ids(stay), self.size[stay])
        self.clear()
        for i in stay.tolist():
            self.pieces[names[i]]
        self.settle()
        self.kept = None

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of each text's."""
        self.room()
        parts = [self.parts(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        numbers = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(parts)), np.int32, int(counts.sum()))
        self.settle()
        met = np.bincount(numbers, minlength=self.count)
        met[: len(self.uses)] += self.uses
        self.uses = met
        ends = np.r_[0, np.cumsum(self.size[numbers], dtype=np.int64)][np.cumsum(counts)]
        return self.ids(numbers), np.diff(np.r_[0, ends])


def worker_encoder(file: str) -> FrequentEncoder:
    """One encoder per Python worker and vocabulary file, so tasks share what they have met."""
    return kept(("frequent", file), lambda: FrequentEncoder(file))


def store_tokens(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """A written table of all documents' ids: part (the writing task), source, n, before (tokens of the source earlier in the part), ids."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("text"), F.spark_partition_id().alias("part")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = worker_encoder(vocabulary), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                texts = batch.column(2).slice(at, 2_048).to_pylist()
                for a, b in steps(texts):
                    ids, n = encoder.encode_texts(texts[a:b])
                    flat = np.full(len(ids) + b - a, end_id, "<u4")
                    flat[np.arange(len(ids)) + np.repeat(np.arange(b - a), n)] = ids
                    n += 1
                    so_far = []
                    for source, k in zip(batch.column(1).slice(at + a, b - a).to_pylist(), n.tolist(), strict=True):
                        so_far.append(before.get(source, 0))
                        before[source] = so_far[-1] + k
                    data = flat if flat.max() >> 16 else flat.astype("<u2")
                    stored = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((np.r_[0, np.cumsum(n)] * data.itemsize).astype(np.int32)), pa.py_buffer(data.tobytes())])
                    keep = [batch.column(c).slice(at + a, b - a) for c in (0, 1, 3)]
                    yield pa.RecordBatch.from_arrays([*keep, pa.array(n), pa.array(so_far, pa.int64()), stored], names=["doc_id", "source", "part", "n", "before", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"doc_id {kind}, source string, part int, n long, before long, ids binary"), "tokens")


def pack_mixture(
    docs: DataFrame,
    vocabulary: str,
    length: int = 1024,
    window: int | None = None,
    weights: Mapping[str | None, float] | None = None,
    end_id: int = 0,
    least: int = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents' ids, each with ``end_id`` after it, into sequences of ``length``.

    A round of the deficit round-robin brings ``window`` tokens (one sequence, if not given) in the
    proportions of ``weights``; without weights these are the sources' own shares of all tokens, so
    that every window looks like the corpus and all queues run dry together. Sources that would have
    fewer than ``least`` tokens of a window, or no weight, share one queue behind the others, source
    after source; those without weight come when the others are empty. Queues stand in the code point
    order of their sources, null last; documents in the order of the stored rows.

    Returns one row per piece: ``id_col``, start, length, ids_crc32 (as little-endian u32),
    doc_tokens, sequence_id, offset, source and, with ``with_ids``, input_ids. All sequences are full
    but the last ones, which are powers of two: no padding. Null texts count as empty and give the
    end id alone; null ids, null sources and repeated rows are packed like others; further columns
    aren't carried. No rows give no rows.

    The ids are written once and read again. What the driver holds is one number per queue, at most
    length of window / least + 1; the starts of the sources in each writing task are joined by Spark.
    """
    window = window or length
    spark = docs.sparkSession
    rows = store_tokens(docs, vocabulary, end_id, id_col, text_col, source_col)
    sums = stable(rows.groupBy("part", "source").agg(F.sum("n").alias("n")))
    whole = sums.agg(F.sum("n")).first()[0] or 0
    totals = sums.groupBy("source").agg(F.sum("n").alias("n"))
    if weights is None:
        own = [(r.source, r.n, float(r.n)) for r in totals.where(F.col("n") >= F.lit(-(-whole * least // window)).cast("long")).collect()]
        rest_weight = float(whole - sum(n for _, n, _ in own))
    else:
        all_weights = sum(weights.values())
        large = {s: w for s, w in weights.items() if w * window >= least * all_weights}
        wanted = F.lit(False)
        for s in large:
            wanted |= F.col("source").eqNullSafe(F.lit(s).cast("string"))
        own = [(r.source, r.n, float(large[r.source])) for r in totals.where(wanted).collect()]
        rest_weight = float(sum(w for s, w in weights.items() if s not in large))
    own.sort(key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n, _ in own] + [whole - sum(n for _, n, _ in own)]
    rounds, sequences = Rounds(sizes, [w for _, _, w in own] + [rest_weight], window), Sequences(whole, length)

    names = spark.createDataFrame([(s, k) for k, (s, _, _) in enumerate(own)], "name string, queue int")  # at most window / least rows
    ahead = spark.createDataFrame([(k, sum(sizes[:k])) for k in range(len(sizes))], "queue int, ahead long")
    queued = sums.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name")), "left").select("part", "source", "n", F.coalesce("queue", F.lit(len(own))).alias("queue"))
    placed = running_totals(queued, [F.col("queue"), F.col("source").asc_nulls_last(), F.col("part")], {"all_before": F.col("n")})
    starts = placed.join(F.broadcast(ahead), "queue").select(F.col("part").alias("of_part"), F.col("source").alias("of_source"), "queue", (F.col("all_before") - F.col("ahead")).alias("queue_start"))
    # of known size once written, so Spark need not shuffle the ids to join it
    joined = rows.join(written(starts, "queue-starts"), (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of_source")))
    joined = joined.select("doc_id", "source", "queue", (F.col("queue_start") + F.col("before")).alias("first"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(4).to_numpy()
            ends, a = np.cumsum(sizes), 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP_IDS, "right")))
                yield placed_pieces(batch.slice(a, b - a))
                a = b

    def placed_pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        queue, first, n = (batch.column(c).to_numpy() for c in (2, 3, 4))
        found = []
        for q in np.unique(queue).tolist():
            mine = np.flatnonzero(queue == q)
            doc, *more = rounds.places(q, first[mine], n[mine])
            found.append((mine[doc], *more))
        doc, start, size, number, offset = sequences.cut(*map(np.concatenate, zip(*found, strict=True)))
        data = batch.column(5).to_pylist()
        flat = np.concatenate([np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype("<u4") for x, k in zip(data, n.tolist(), strict=True)])
        low = start + (np.cumsum(n) - n)[doc]
        view = memoryview(flat.tobytes())
        crc = [zlib.crc32(view[x:y]) for x, y in zip((4 * low).tolist(), (4 * (low + size)).tolist(), strict=True)]
        index = pa.array(doc)
        columns = [batch.column(0).take(index), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(number), pa.array(offset), batch.column(1).take(index)]
        if with_ids:  # pieces of a document follow one another, so the ids lie in their order
            columns.append(pa.ListArray.from_arrays(pa.array(np.r_[low, len(flat)].astype(np.int32)), pa.array(flat.astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=names_out)

    names_out = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"] + ["input_ids"] * with_ids
    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", input_ids array<int>" * with_ids)


def assemble_sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, input_ids) of pieces that carry input_ids; a sequence's pieces have a bounded number of ids."""
    own = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "input_ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["input_ids"]))
    return own.select("sequence_id", F.size(ids).cast("long").alias("n_tokens"), ids.alias("input_ids"))
