"""Periodic runs of words by a branching-tandem test over an enhanced suffix array.

The words of many documents lie in one flat array, a document's words being symbols of its own. The
suffix array comes from prefix doubling, in which only suffixes that still tie are sorted anew; the
ranks of each round give the LCP of neighbours. An LCP interval of depth d holds all places of a
repeated stretch of d words. Where a place i and the place i + d of an interval lie in different
children, a square (the same d words twice) begins at i that can't be moved to the right; one of the
two lies outside the largest child, so testing the inverse suffix array at i + d and i - d for the
places of the smaller children finds all of them in n log n tests. Intervals and children are index
ranges from smaller neighbours in the LCP array; there are no tree nodes. A square rotates to the
left as far as the words repeat, which is the run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_text
from .packing import ranges

#: Words that are sorted together, but for a longer document, which stands alone.
STEP_WORDS = 250_000
#: Times that a run repeats its period at least, and words that it has at least.
LEAST_TIMES, LEAST_WORDS = 4, 6


def sorted_suffixes(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse, and the ranks of each doubling round, equal where the first 1, 2, 4 ... words are.

    ``ends`` holds the end of each place's document; a suffix that ends there comes first.
    """
    n = len(symbols)
    suffixes = np.argsort(symbols, kind="stable")
    own = symbols[suffixes]
    head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    size = np.diff(np.r_[head, n])
    rank = np.empty(n, np.int64)
    rank[suffixes] = np.repeat(head, size)
    rounds, width = [rank.astype(np.int32)], 1
    live = np.flatnonzero(np.repeat(size, size) > 1)
    while len(live):
        s = suffixes[live]
        after = s + width
        key = np.where(after < ends[s], rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[s]
        order = np.lexsort((key, group))
        s, key, group = s[order], key[order], group[order]
        suffixes[live] = s
        fresh = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
        head = np.flatnonzero(fresh)
        size = np.diff(np.r_[head, len(live)])
        rank[s] = np.repeat(live[head], size)
        rounds.append(rank.astype(np.int32))
        width *= 2
        live = live[np.repeat(size, size) > 1]
    return suffixes, rank, rounds


def neighbour_lcp(suffixes: np.ndarray, ends: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the one before it in the array; 0 for the first."""
    lcp = np.zeros(len(suffixes), np.int64)
    live = np.flatnonzero(rounds[0][suffixes[1:]] == rounds[0][suffixes[:-1]]) + 1
    a, b = suffixes[live - 1], suffixes[live]
    for k in reversed(range(len(rounds))):
        # equal ranks of equal suffixes of one document mean equal words only while both have that many
        fits = np.maximum(a, b) + (1 << k) <= ends[suffixes[live]]
        last = len(rounds[k]) - 1
        same = fits & (rounds[k][np.minimum(a, last)] == rounds[k][np.minimum(b, last)])
        lcp[live] += np.where(same, 1 << k, 0)
        a, b = a + np.where(same, 1 << k, 0), b + np.where(same, 1 << k, 0)
    return lcp


def no_larger_before(values: np.ndarray) -> np.ndarray:
    """The nearest earlier place with no larger value; -1 if there is none.

    Most places are few jumps along others' answers away; the rest climb a tree of least values.
    """
    found = np.arange(len(values)) - 1
    live = np.arange(len(values))
    for _ in range(5):
        there = found[live]
        live = live[(there >= 0) & (values[np.maximum(there, 0)] > values[live])]
        found[live] = found[found[live]]
    if not len(live):
        return found
    levels = [values]
    while len(levels[-1]) > 1:
        level = np.r_[levels[-1], levels[-1][-1:]] if len(levels[-1]) % 2 else levels[-1]
        levels.append(np.minimum(level[::2], level[1::2]))
    # the search is among the first ``at`` blocks of a level; an odd one out is tested, then the level above has half as many
    own, at, height = values[live], live.copy(), np.full(len(live), -1)
    for k, level in enumerate(levels):
        climbing = height < 0
        last = np.where(climbing, np.maximum(at - 1, 0), 0)
        here = climbing & (at % 2 == 1) & (level[last] <= own)
        height[here] = k
        at = np.where(here, last, np.where(climbing, at // 2, at))
    for k in reversed(range(1, len(levels))):
        down = height == k
        right = np.where(down, np.minimum(2 * at + 1, len(levels[k - 1]) - 1), 0)
        at = np.where(down, np.where(levels[k - 1][right] <= own, right, 2 * at), at)
        height[down] = k - 1
    found[live] = np.where(height == 0, at, -1)
    return found


def leaders(values: np.ndarray, no_larger: np.ndarray) -> np.ndarray:
    """The first of the equal values that each place reaches by ``no_larger``, by doubling."""
    equal = (no_larger >= 0) & (values[np.maximum(no_larger, 0)] == values)
    found = np.where(equal, no_larger, np.arange(len(values)))
    while True:
        further = found[found]
        if (further == found).all():
            return found
        found = further


def branching_squares(suffixes: np.ndarray, inverse: np.ndarray, lcp: np.ndarray, ends: np.ndarray, least_times: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all squares that don't go on to the right, of intervals with ``least_times`` places."""
    n = len(lcp)
    nothing = np.zeros(0, np.int64)
    some = np.flatnonzero(lcp > 0)
    if not len(some):
        return nothing, nothing
    # only places with a common prefix and those on either side of each stretch of them matter
    near = np.zeros(n + 1, bool)
    near[some - 1] = near[some] = near[some + 1] = True
    kept = np.flatnonzero(near)
    values = np.r_[lcp, -1][kept]
    no_larger = no_larger_before(values)
    below = no_larger[leaders(values, no_larger)]
    turned = values[::-1].copy()
    turned_no_larger = no_larger_before(turned)
    after_no_larger = len(kept) - 1 - turned_no_larger[::-1]
    after = len(kept) - 1 - turned_no_larger[leaders(turned, turned_no_larger)][::-1]
    k = np.flatnonzero(values > 0)
    depth = values[k]
    low, high = kept[below[k]], kept[after[k]] - 1  # the interval
    wide = high - low + 1 >= least_times
    k, depth, low, high = k[wide], depth[wide], low[wide], high[wide]
    if not len(k):
        return nothing, nothing
    first = values[no_larger[k]] != depth  # the interval's first border also ends its first child
    start = np.r_[kept[k], low[first]]
    end = np.r_[kept[after_no_larger[k]] - 1, kept[k[first]] - 1]
    depth, low, high = np.r_[depth, depth[first]], np.r_[low, low[first]], np.r_[high, high[first]]
    # the largest child of each interval is left out
    order = np.lexsort((start - end, low, depth))
    start, end, depth, low, high = (x[order] for x in (start, end, depth, low, high))
    smaller = np.r_[False, (depth[1:] == depth[:-1]) & (low[1:] == low[:-1])]
    start, end, depth, low, high = (x[smaller] for x in (start, end, depth, low, high))
    child, at = ranges(start, end + 1)
    place, depth, low, high, start, end = suffixes[at], depth[child], low[child], high[child], start[child], end[child]

    def within(other: np.ndarray, known: np.ndarray) -> np.ndarray:
        there = inverse[np.clip(other, 0, n - 1)]
        return known & (there >= low) & (there <= high) & ((there < start) | (there > end))

    right = within(place + depth, place + depth < ends[place])
    left = within(place - depth, place >= depth)
    begin, period = np.r_[place[right], (place - depth)[left]], np.r_[depth[right], depth[left]]
    pairs = np.unique(np.stack([period, begin]), axis=1)
    return pairs[1], pairs[0]


def rotated_runs(symbols: np.ndarray, begins: np.ndarray, starts: np.ndarray, periods: np.ndarray, least_times: int, least_words: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs that squares in ascending order of their period rotate to.

    ``begins`` holds the begin of each place's document. Squares that can't reach far enough are left
    out first; if that of a run's own period is, so are those of its multiples.
    """
    # a run that is long enough reaches so far to the left of its last square
    reach = np.maximum(least_times * periods, least_words) - 2 * periods
    far = starts - reach >= begins[starts]
    starts, periods, reach = starts[far], periods[far], reach[far]
    some = (symbols[starts - (reach > 0)] == symbols[starts - (reach > 0) + periods]) & (symbols[starts - reach] == symbols[starts - reach + periods])
    starts, periods = starts[some], periods[some]
    out, known = [], {}
    for start, period in zip(starts.tolist(), periods.tolist(), strict=True):
        end = start + 2 * period
        # the square of a multiple of a run's own period
        if any(period % q == 0 and s <= start for q, s in known.get(end, ())):
            continue
        low, begin, step = start, int(begins[start]), 64
        while low > begin:
            back = max(begin, low - step)
            unlike = np.flatnonzero(symbols[back:low] != symbols[back + period : low + period])
            if len(unlike):
                low = back + int(unlike[-1]) + 1
                break
            low, step = back, 2 * step
        known.setdefault(end, []).append((period, low))
        if end - low >= max(least_words, least_times * period):
            out.append((low, end, period))
    return out


def document_runs(words: list[list[bytes]], least_times: int = LEAST_TIMES, least_words: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each document's runs by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    sizes = np.array([len(w) for w in words], np.int64)
    if not sizes.sum():
        return found
    number: dict[bytes, int] = {}
    flat = [number.setdefault(w, len(number)) for own in words for w in own]
    doc = np.repeat(np.arange(len(words)), sizes)
    symbols = doc * len(number) + np.array(flat, np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
    suffixes, inverse, rounds = sorted_suffixes(symbols, ends)
    lcp = neighbour_lcp(suffixes, ends, rounds)
    squares = branching_squares(suffixes, inverse, lcp, ends, least_times)
    for low, end, period in rotated_runs(symbols, begins, *squares, least_times, least_words):
        d = int(doc[low])
        found[d].append((low - int(begins[low]), end - low, period))
    for own in found:
        own.sort(key=lambda r: (r[0], r[2]))
    return found


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def detect_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_times: int = LEAST_TIMES, least_words: int = LEAST_WORDS, with_text: bool = True) -> DataFrame:
    """All runs of each document, and its text with each run cut to its first period.

    A run is a stretch of words that repeats its smallest period ``least_times`` or more, of
    ``least_words`` or more, which no neighbouring word extends. Words lie between ASCII white space.
    Returns ``id_col`` as given, n_runs, that run's start, length and period which has the greatest
    length over period (ties: smallest start, then period), exponent_milli, runs_sha256 of the lines
    ``start,length,period``, collapsed_sha256 of the words left, joined by spaces, and, with
    ``with_text``, runs and collapsed (null for a null text). Null and empty texts have no words and no runs; rows
    are independent, so repeated rows and null ids pass through; other columns aren't carried.
    """
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)
    fields = [T.StructField(c, T.LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")] + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")]
    if with_text:
        fields += [T.StructField("runs", run_type), T.StructField("collapsed", T.StringType())]

    def make():
        def described(words: list[bytes], runs: list[tuple[int, int, int]], null: bool) -> tuple:
            best = (None,) * 4
            if runs:
                start, length, period = runs[0]
                for s, n, q in runs[1:]:
                    if n * period > length * q:  # runs stand by start, then period
                        start, length, period = s, n, q
                best = (start, length, period, 1000 * length // period)
            left = b" ".join(without_repeats(words, runs))
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            row = (len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
            return (*row, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], None if null else left.decode()) if with_text else row

        def grouped(words: list[list[bytes]]) -> Iterator[tuple[int, int]]:
            start = size = 0
            for i, own in enumerate(words):
                if i > start and size + len(own) > STEP_WORDS:
                    yield start, i
                    start, size = i, 0
                size += len(own)
            yield start, len(words)

        def work(texts: list) -> list:
            words = [t.encode().split() if t else [] for t in texts]  # bytes split at ASCII white space alone
            rows = []
            for a, b in grouped(words):
                rows += map(described, words[a:b], document_runs(words[a:b], least_times, least_words), [t is None for t in texts[a:b]])
            return [list(x) for x in zip(*rows, strict=True)]

        return work

    return map_text(docs, [id_col], text_col, make, fields)
