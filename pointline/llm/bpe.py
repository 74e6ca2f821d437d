"""BPE encoding and decoding by batched numpy merge rounds.

A text is cut into the words that merges don't cross; a worker remembers the words it has met. All
new words of a batch are encoded together: their bytes lie as symbols in one flat array, the rank of
every neighbouring pair comes from a binary search over the sorted pair keys, and each round merges,
in each word, all occurrences of its lowest-ranked pair.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import kept, map_text

#: Pieces that a worker remembers before it starts anew.
MAX_PIECES = 250_000

#: Fixed pattern of the byte-level vocabulary: what is merged apart.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts without the characters of ODD, where the faster module's classes agree.
FAST_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
TWO_SPACES = re.compile(r"\s\s")


@lru_cache(1)
def odd_characters() -> frozenset[str]:
    """Characters that the two modules class differently: separators 1C-1F, numbers that aren't digits."""
    kinds = unicodedata.category
    return frozenset(map(chr, range(0x1C, 0x20))) | {c for c in map(chr, range(0x80, sys.maxunicode + 1)) if kinds(c) in ("No", "Nl") or c.isalnum() and kinds(c)[0] not in "LN"}


def split_words(text: str) -> list[str]:
    """The words of a text without special tokens, in the pattern's order."""
    return (FAST_WORDS if odd_characters().isdisjoint(set(text)) else WORDS).findall(text)


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, inverted."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary with its merges as sorted numpy arrays."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            whole = json.load(f)
        model, letters = whole["model"], byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if i not in set(self.special.values())}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.of_byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where there is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the word each belongs to."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words, none = [], [], len(self.keys)
        rank = np.full(len(symbols), none, dtype=np.int64)  # of the pair that begins at each symbol
        near = np.flatnonzero(word[1:] == word[:-1])
        rank[near] = self.ranks(symbols[near], symbols[near + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            best = np.repeat(lowest, np.diff(np.r_[first, len(symbols)]))
            over = best == none
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                live = ~over
                symbols, word, rank, best = symbols[live], word[live], rank[live], best[live]
                if not len(symbols):
                    break
            hit = rank == best
            after = hit[1:] & hit[:-1]
            if after.any():
                # in a run of overlapping hits every second one merges, from the left
                start = hit & ~np.r_[False, hit[:-1]]
                place = np.arange(len(hit))
                hit &= (place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0
            symbols[hit] = self.merged[best[hit]]
            left = ~np.r_[False, hit[:-1]]
            symbols, word, rank, hit = symbols[left], word[left], rank[left], hit[left]
            # only pairs that touch a new symbol change their rank
            hit[:-1] |= hit[1:]
            new = np.flatnonzero(hit)
            rank[new] = none
            new = new[new + 1 < len(word)]
            new = new[word[new + 1] == word[new]]
            rank[new] = self.ranks(symbols[new], symbols[new + 1])
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def decode_bytes(self, ids) -> bytes:
        return b"".join([self.bytes.get(i, b"") for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


SAFE_SPACE = re.compile(r"(?<=\S)(?= \S)")


def split_pieces(text: str) -> list[str]:
    """Parts of a text that are encoded apart with the same result as the whole."""
    if not text:
        return []
    if TWO_SPACES.search(text) is None:
        # every space stands alone: a cut before each of them is a cut of the pattern too
        parts = text.split(" ")
        out = [" " + p for p in parts]
        if parts[0]:
            out[0] = parts[0]
        else:
            del out[0]
        return out
    # elsewhere cut only before a space between two other characters
    return SAFE_SPACE.split(text)


class Pieces(dict):
    """Piece to number; new pieces get the next number and are listed in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Encodes texts with ``encode_words`` for what it hasn't met; keeps ids of pieces in flat arrays."""

    def __init__(self, limit: int = MAX_PIECES):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.pieces = Pieces()
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.at, self.size, self.count = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int32), 0

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def add(self, pieces: list[str]) -> None:
        ids, sizes = self.encode_pieces(pieces)
        n, m = self.count + len(pieces), self.used + len(ids)
        while n > len(self.at):
            self.at, self.size = np.r_[self.at, np.zeros_like(self.at)], np.r_[self.size, np.zeros_like(self.size)]
        if m > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros(max(m - len(self.flat), len(self.flat)), dtype=np.int32)]
        self.flat[self.used : m] = ids
        self.size[self.count : n] = sizes
        self.at[self.count : n] = self.used + np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else 0
        self.count, self.used = n, m

    def parts(self, text: str) -> list[str]:
        return split_pieces(text)

    def number(self, text: str) -> np.ndarray:
        """Numbers of the pieces of a text; their ids are there after settle()."""
        parts = self.parts(text)
        return np.fromiter(map(self.pieces.__getitem__, parts), dtype=np.int32, count=len(parts))

    def settle(self) -> None:
        if self.pieces.new:
            new, self.pieces.new = self.pieces.new, []
            self.add(new)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers].astype(np.int64)
        total = int(size.sum())
        if not total:
            return np.zeros(0, dtype=np.int32)
        start = np.cumsum(size) - size
        return self.flat[np.repeat(self.at[numbers] - start, size) + np.arange(total)]

    def room(self) -> None:
        if len(self.pieces) > self.limit:
            self.clear()


class BpeEncoder(Encoder):
    """Remembers single words: the same text always has the same words, whatever was met before."""

    def __init__(self, file: str, limit: int = MAX_PIECES):
        self.bpe = Bpe(file)
        n = max(self.bpe.bytes) + 1
        self.decimals = [str(i).encode() for i in range(n)]
        self.bytes_of = [self.bpe.bytes.get(i, b"") for i in range(n)]
        super().__init__(limit)

    def parts(self, text: str) -> list[str]:
        special = self.bpe.special_re
        if special is None or special.search(text) is None:
            return split_words(text)
        # a special token's string is a part of its own; no other part can equal it
        return [w for j, part in enumerate(special.split(text)) for w in ([part] if j % 2 else split_words(part))]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = {k: self.bpe.special[p] for k, p in enumerate(pieces) if p in self.bpe.special}
        ids, word = self.bpe.merge([b"" if k in special else p.encode() for k, p in enumerate(pieces)])
        if special:
            ids, word = np.r_[ids, np.fromiter(special.values(), np.int64)], np.r_[word, np.fromiter(special.keys(), np.int64)]
            order = np.argsort(word, kind="stable")
            ids, word = ids[order], word[order]
        return ids.astype(np.int32), np.bincount(word, minlength=len(pieces))

    def digests(self, numbers: np.ndarray) -> tuple[int, str, str]:
        own = self.ids(numbers).tolist()
        text = b"".join(map(self.bytes_of.__getitem__, own)).decode("utf-8", "replace")
        return len(own), hashlib.sha256(b",".join(map(self.decimals.__getitem__, own))).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def worker_encoder(file: str) -> BpeEncoder:
    """One encoder per Python worker and vocabulary file, so tasks share what they have met."""
    return kept(("bpe", file), lambda: BpeEncoder(file))


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns ``id_col`` as given, n_tokens long, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the text decoded from the ids, UTF-8) and, with ``with_ids``, input_ids.
    Null texts count as empty: no ids, and digests of nothing. Rows are independent, so repeated
    rows and null ids pass through; other columns of ``docs`` are not carried. A special token's
    string in a text becomes that token. ``vocabulary`` is a path that every executor can open.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("input_ids", T.ArrayType(T.IntegerType(), False)))

    def make():
        encoder = worker_encoder(vocabulary)

        def work(texts: list) -> list:
            encoder.room()
            numbers = [encoder.number(t or "") for t in texts]
            encoder.settle()
            out = [list(x) for x in zip(*map(encoder.digests, numbers), strict=True)]
            if with_ids:
                ids = encoder.ids(np.concatenate(numbers) if numbers else np.zeros(0, np.int32))
                offsets = np.r_[0, np.cumsum(out[0])].astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)).cast(pa.list_(pa.field("element", pa.int32(), nullable=False))))
            return out

        return work

    return map_text(docs, [id_col], text_col, make, fields)
