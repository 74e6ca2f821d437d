"""Quality classifier from supervised subword embeddings.

Each word and each of its character n-grams has a hashed vector, and so has the word pair "the same
word twice"; a document is their mean, and a softmax layer on it gives the class. Vectors and layer
are learned together by stochastic gradient descent in numpy from a bounded number of labelled rows,
of which tasks send the hashed features of the whole texts; scoring is a pass over all texts.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import kept, map_text, without

#: Labelled rows learned from, at most.
SAMPLE = 4_000
#: Words, and their characters, that a worker remembers before it starts anew.
MAX_WORDS, MAX_CHARS = 250_000, 16_000_000
#: Pieces of words, and their characters, that are hashed at once.
STEP_WORDS, STEP_CHARS = 20_000, 400_000
#: Features that a word which repeats its predecessor counts for; they share bucket 0. 0 leaves the pair out.
REPEAT = 8
#: Longer words are hashed in pieces of this many characters, all of them.
WORD_CHARS = 48


@dataclass(frozen=True)
class SubwordModel:
    """Hashed vectors, softmax layer and the settings that turn words into rows of the vectors."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    shortest: int = 2
    longest: int = 4
    repeat: int = REPEAT

    @property
    def buckets(self) -> int:
        return len(self.vectors)


def pieces_of(words: list[str]) -> tuple[list[str], np.ndarray]:
    """All pieces of all words, and the place of the word of each."""
    pieces, owner = [], []
    for k, w in enumerate(words):
        if len(w) <= WORD_CHARS:
            pieces.append(w)
            owner.append(k)
        else:
            cut = [w[at : at + WORD_CHARS] for at in range(0, len(w), WORD_CHARS)]
            pieces += cut
            owner += [k] * len(cut)
    return pieces, np.array(owner, dtype=np.int64)


def word_features(words: list[str], buckets: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature of all words (or pieces), and the number of features of each.

    A word's features are the whole word and the n-grams of its characters between two marks.
    """
    marked = ["\x02" + w + "\x03" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(words)), size)
    prime, mixed = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    rolled, hashes, owners = code * mixed, [], []
    for n in range(2, longest + 1):
        rolled = (rolled[:-1] * prime) ^ (code[n - 1 :] * mixed) if len(rolled) else rolled
        if n >= shortest and len(rolled):
            inside = word[: len(rolled)] == word[n - 1 :]
            hashes.append(rolled[inside] + np.uint64(n))
            owners.append(word[: len(rolled)][inside])
    # the whole word: a sum of its characters weighted by their places
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    whole = np.add.reduceat(code * mixed * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)) ** np.uint64(3), np.cumsum(size) - size) if len(words) else np.zeros(0, np.uint64)
    hashes.append(whole)
    owners.append(np.arange(len(words)))
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    order = np.argsort(owner, kind="stable")
    return (np.uint64(1) + h[order] % np.uint64(buckets - 1)).astype(np.int64), np.bincount(owner, minlength=len(words))


def document_features(text: str, buckets: int, shortest: int, longest: int, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text's features, ascending, and how often each comes."""
    words, counts = text.split(), np.zeros(buckets)
    pieces, _ = pieces_of(words)
    chars, at = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), 0
    while at < len(pieces):
        done = chars[at - 1] if at else 0
        end = min(at + STEP_WORDS, max(at + 1, int(np.searchsorted(chars, done + STEP_CHARS, side="right"))))
        counts += np.bincount(word_features(pieces[at:end], buckets, shortest, longest)[0], minlength=buckets)
        at = end
    counts[0] += repeat * sum(map(str.__eq__, words[1:], words))
    ids = np.flatnonzero(counts)
    return ids.astype(np.int32), counts[ids].astype(np.float32)


def pack_features(ids: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ids, prepend=np.int32(0)).tobytes() + counts.tobytes(), 1)


def unpack_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    return np.cumsum(np.frombuffer(raw, np.int32, len(raw) // 8)), np.frombuffer(raw, np.float32, len(raw) // 8, len(raw) // 2)


def train(features: list[bytes], labels: list[int], model: SubwordModel, epochs: int | None = None, rate: float = 0.5, seed: int = 7) -> SubwordModel:
    """Stochastic gradient descent, one document at a time, with a falling rate; ``model`` is where it starts.

    Without ``epochs`` there are about 8,000 steps, in 2 to 12 passes.
    """
    rng = np.random.default_rng(seed)
    epochs = epochs or max(2, min(12, 8_000 // max(len(features), 1)))
    total, done = epochs * max(len(features), 1), 0
    for _ in range(epochs):
        for k in rng.permutation(len(features)):
            which, times = unpack_features(features[k])
            if not len(which):
                continue
            weight = times / times.sum()
            mean = weight @ model.vectors[which]
            score = model.layer @ mean + model.bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[k]] -= 1
            step = rate * (1 - done / total)
            back = model.layer.T @ p
            model.layer[:] -= step * np.outer(p, mean)
            model.bias[:] -= step * p
            model.vectors[which] -= step * weight[:, None] * back * 50
            done += 1
    return model


class WordScores:
    """Log-odds and number of features of words, remembered between batches."""

    def __init__(self, model: tuple[np.ndarray, float, int, int, int]):
        self.scalar, self.bias, self.shortest, self.longest, self.repeat = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.sums, self.sizes = np.zeros(0), np.zeros(0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.number) > MAX_WORDS or self.chars > MAX_CHARS:
            self.clear()
        number, rows, new = self.number, [], []
        for text in texts:
            words = text.split() if text else []
            own = [number.get(w) for w in words]
            if None in own:
                for i, w in enumerate(words):
                    if own[i] is None:
                        if (n := number.get(w)) is None:
                            n = number[w] = len(number)
                            new.append(w)
                        own[i] = n
            rows.append(np.array(own, dtype=np.int64))
        if new:
            self.chars += sum(map(len, new))
            pieces, owner = pieces_of(new)
            sums, sizes, at = np.zeros(len(new)), np.zeros(len(new)), 0
            chars = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            while at < len(pieces):
                done = chars[at - 1] if at else 0
                end = min(at + STEP_WORDS, max(at + 1, int(np.searchsorted(chars, done + STEP_CHARS, side="right"))))
                ids, size = word_features(pieces[at:end], len(self.scalar), self.shortest, self.longest)
                starts = np.cumsum(size) - size
                np.add.at(sums, owner[at:end], np.add.reduceat(self.scalar[ids], starts))
                np.add.at(sizes, owner[at:end], size)
                at = end
            self.sums, self.sizes = np.r_[self.sums, sums], np.r_[self.sizes, sizes]
        odds = np.zeros(len(rows))
        for k, r in enumerate(rows):
            if len(r):
                again = self.repeat * np.count_nonzero(r[1:] == r[:-1])
                odds[k] = (self.sums[r].sum() + again * self.scalar[0]) / (self.sizes[r].sum() + again)
        return 1 / (1 + np.exp(-np.clip(odds + self.bias, -700, 700)))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, dim: int = 16, buckets: int = 1 << 17, repeat: int = REPEAT
) -> SubwordModel:
    """Learn from at most ``sample`` labelled rows outside the held-out fifth.

    Rows whose crc32 of the id as text is divisible by 5 are never learned from. Of the ids labelled
    0 or 1 (ids with both labels are left out) those with the smallest hash are taken, so equal
    inputs give equal samples; of rows that repeat an id the text with the smallest crc32 counts, and null texts teach nothing.
    What goes to the driver are ``sample`` rows of at most ``buckets`` counts each, made in tasks from
    whole texts of any length. Without rows of both classes the model scores everything by the share
    of label 1, or 0.5 without rows.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{label_col}`").alias("__y")).where("__id IS NOT NULL AND __y IN (0, 1)")
    known = known.groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z")
    known = known.where(F.pmod(F.crc32(F.col("__id").cast("string")), F.lit(5)) != 0).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text")).join(F.broadcast(known.select("__id", F.col("__y").cast("int").alias("__y"))), "__id")
    start = SubwordModel(np.random.default_rng(7).uniform(-1 / dim, 1 / dim, (buckets, dim)), np.zeros((2, dim)), np.zeros(2), repeat=repeat)
    settings = (buckets, start.shortest, start.longest, repeat)

    def make():
        return lambda texts: [[pack_features(*document_features(t, *settings)) for t in texts], [zlib.crc32(t.encode(errors="surrogatepass")) for t in texts]]

    made = map_text(rows.where(F.col("__text").isNotNull()), ["__id", "__y"], "__text", make, [T.StructField("features", T.BinaryType()), T.StructField("crc", T.LongType())])
    made = made.groupBy("__id").agg(F.min(F.struct("crc", "features", "__y")).alias("best")).select("__id", "best.__y", "best.features")
    got = {r[0]: (r[1], bytes(r[2])) for r in made.toLocalIterator()}  # at most ``sample`` rows
    y = [got[k][0] for k in sorted(got)]
    if len(set(y)) < 2:
        share = (sum(y) + 0.5) / (len(y) + 1)
        return SubwordModel(np.zeros((2, 1)), np.zeros((2, 1)), np.array([0.0, np.log(share / (1 - share))]), repeat=repeat)
    return train([got[k][1] for k in sorted(got)], y, start)


def score_quality(docs: DataFrame, model: SubwordModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the probability of label 1 of every whole text, null and empty ones too.

    Empty texts get the bias's score. An input column named like ``score_col`` gives way; all other
    columns and rows pass through.
    """
    # two classes: the log-odds are one number per bucket
    scalar = (model.vectors @ (model.layer[1] - model.layer[0])).astype(np.float32)
    bias = float(model.bias[1] - model.bias[0])
    share = docs.sparkSession.sparkContext.broadcast((scalar, bias, model.shortest, model.longest, model.repeat))  # buckets * 4 bytes

    def make():
        values = share.value
        key = hashlib.sha256(values[0].tobytes() + repr(values[1:]).encode()).digest()
        scores = kept(("scores", key), lambda: WordScores(values))
        return lambda texts: [scores.score(texts)]

    keep = without(docs, [score_col]).columns
    return map_text(docs, keep, text_col, make, [T.StructField(score_col, T.DoubleType())])


def held_out(id_col: str = "doc_id"):
    """Whether a row's label is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(5)) == 0, F.lit(False))
