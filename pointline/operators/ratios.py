"""difflib's similarity ratio for many pairs of strings at once.

The characters of all pairs lie in two padded arrays. In each round every open stretch of a pair
looks for its longest matching block, all stretches side by side, one character of the first string
after another; the block then leaves a stretch before and one behind it, until none holds a match.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Length of the second string from which difflib leaves out frequent characters; such pairs are left to it.
FREQUENT_FROM = 200
#: Cells of one round's arrays, at most about.
CELLS = 1 << 21


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts by characters, lengths); what lies behind a text is 0."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), max(1, int(lengths.max(initial=0)))), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, lengths


def longest_blocks(a: np.ndarray, b: np.ndarray, low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of each row's longest common block within its bounds; of several, the first in a, then in b."""
    n, width = b.shape
    inside = (np.arange(width) >= low_b[:, None]) & (np.arange(width) < high_b[:, None])
    run = np.zeros((n, width + 1), np.int32)
    size, end_a, end_b = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(int(low_a.min(initial=0)), int(high_a.max(initial=0))):
        same = (b == a[:, i, None]) & inside & ((i >= low_a) & (i < high_a))[:, None]
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        at = run[:, 1:].argmax(axis=1)
        longer = run[np.arange(n), at + 1] > size
        size[longer], end_a[longer], end_b[longer] = run[longer, at[longer] + 1], i + 1, at[longer] + 1
    return end_a - size, end_b - size, size


def matched_characters(first: Sequence[str], second: Sequence[str]) -> np.ndarray:
    """Characters in the matching blocks of each pair."""
    a, length_a = code_points(first)
    b, length_b = code_points(second)
    total = np.zeros(len(first), np.int64)
    pair = np.arange(len(first))
    bounds = np.stack([np.zeros_like(length_a), length_a, np.zeros_like(length_b), length_b])
    while True:
        live = (bounds[0] < bounds[1]) & (bounds[2] < bounds[3])
        pair, bounds = pair[live], bounds[:, live]
        if not len(pair):
            return total
        low_a, high_a, low_b, high_b = bounds
        at_a, at_b, size = longest_blocks(a[pair], b[pair], low_a, high_a, low_b, high_b)
        np.add.at(total, pair, size)
        some = size > 0
        before = np.stack([low_a, at_a, low_b, at_b])[:, some]
        behind = np.stack([at_a + size, high_a, at_b + size, high_b])[:, some]
        pair, bounds = np.r_[pair[some], pair[some]], np.concatenate([before, behind], axis=1)


def ratios(first: Sequence[str], second: Sequence[str]) -> np.ndarray:
    """Twice the matched characters over both lengths; 1 for two empty strings."""
    out = np.ones(len(first))
    sizes = np.array([(len(x), len(y)) for x, y in zip(first, second, strict=True)], np.int64).reshape(-1, 2)
    frequent = np.flatnonzero(sizes[:, 1] >= FREQUENT_FROM)
    for i in frequent.tolist():
        out[i] = SequenceMatcher(None, first[i], second[i]).ratio()
    rest = np.flatnonzero((sizes[:, 1] < FREQUENT_FROM) & (sizes.sum(axis=1) > 0))
    rest = rest[np.argsort(sizes[rest].max(axis=1), kind="stable")]  # pairs of a like length together
    n = max(1, CELLS // (int(sizes[rest].max(initial=0)) + 1))
    for at in range(0, len(rest), n):
        part = rest[at : at + n]
        matched = matched_characters([first[i] for i in part], [second[i] for i in part])
        out[part] = 2.0 * matched / sizes[part].sum(axis=1)
    return out


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of each pair; null where one is null."""
    known = a.notna() & b.notna()
    out = pd.Series(np.nan, index=a.index, dtype=float)
    out[known] = ratios(a[known].tolist(), b[known].tolist())
    return out
