"""Runs: stretches of words that repeat with a period, found by the tandem repeats of Gusfield and Stoye.

Words of a batch of texts stand in one sequence of numbers, in which equal numbers mean equal words of one text. For it:

1. Suffix tree, as the order of suffixes with the ranks of each doubling of length: a node is a range of the order and a length,
   a suffix link goes from (i, length) to (i + 1, length - 1), a child is found by bisection. Ranks give common extensions, too.
2. Lempel-Ziv blocks: each is the longest piece that also starts earlier, or a new word.
3. Squares that touch a block's end, or its start, by extensions for each half-length that a block allows: they cover the leftmost
   occurrence of every square. Squares whose half is itself a repetition are left out; their roots are found.
4. Suffix-link walks from these complete the vocabulary: along the text while it goes on repeating, then over a suffix link to the
   child that the rotated square needs, until a node is marked.
5. Every square of the vocabulary is located: its node's range of suffixes. Squares of one period that start side by side merge
   into a run.

A run is maximal: no neighbouring word continues its smallest period. Work and memory are in proportion to words (times the doublings
that repeats within a text need), whatever the runs; a text is worked on whole, some 200 bytes a word of the longest text.

Null and empty texts, and texts of white space, have no word and no run. Rows that repeat an id are texts of their own; a null id
is an id. Bytes that are no UTF-8 are words as they are. Further columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import bound_batches

#: Words that are worked on together, at least: texts are added until there are as many.
TOGETHER = 1 << 17
#: A run has this many words and periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def starts(keys: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place from 0) of as many rows as the counts say."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class SuffixTree:
    """Suffixes of a sequence whose first and last number, and those between texts, occur once."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        new = starts(symbols[order])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int32)
        rank[order] = first
        levels = [rank]
        waiting, width = order[~(new & np.r_[new[1:], True])], 1
        while len(waiting):  # rank those whose first `width` words another suffix shares by the words that follow
            old = rank[waiting].astype(np.int64)
            key = old * n + rank[waiting + width]
            by = np.argsort(key, kind="stable")
            waiting, key, old = waiting[by], key[by], old[by]
            new, place = starts(key), np.arange(len(key))
            rank = rank.copy()
            rank[waiting] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(starts(old), place, 0))
            levels.append(rank)
            waiting = waiting[~(new & np.r_[new[1:], True])]
            width *= 2
        #: ranks[k, i] is equal for the starts i of equal stretches of 2 ** k words. The last row has no equal ones.
        self.ranks = np.stack(levels)
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, i and j being different."""
        return self._extended(i, j, 1)

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same up to and including i and j, backwards."""
        return self._extended(i, j, -1)

    def _extended(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        out = np.zeros(len(i), np.int64)

        def equal(k: int, which: np.ndarray) -> np.ndarray:
            at = out[which] if way > 0 else -out[which] - (1 << k) + 1
            a, b = i[which] + at, j[which] + at
            return (a >= 0) & (b >= 0) & (self.ranks[k, a] == self.ranks[k, b])

        sets = [np.flatnonzero(equal(0, np.arange(len(i))))]
        while len(sets[-1]) and len(sets) < len(self.ranks):
            sets.append(sets[-1][equal(len(sets), sets[-1])])
        for k in reversed(range(len(sets))):
            out[sets[k]] += equal(k, sets[k]).astype(np.int64) << k
        return out

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether `length` (at least 1) words from i on equal those from j on."""
        k = np.frexp(length)[1] - 1
        known = k < len(self.ranks)
        k = np.minimum(k, len(self.ranks) - 1)
        last, end = length - (1 << k), self.n - 1
        at = lambda x: self.ranks[k, np.minimum(x, end)]
        return (i == j) | (known & (at(i) == at(j)) & (at(i + last) == at(j + last)))

    def node(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range (from, to) of suffixes that begin with the `length` words from i on."""
        rank = self.ranks[-1, i].astype(np.int64)
        ends = []
        for way in (-1, 1):
            reach, step, going = np.zeros(len(i), np.int64), 1, np.arange(len(i))

            def holds(which: np.ndarray, by: int, way: int = way, reach: np.ndarray = reach) -> np.ndarray:
                at = rank[which] + way * (reach[which] + by)
                inside = (at >= 0) & (at < self.n)
                return inside & self.same(self.order[np.clip(at, 0, self.n - 1)], i[which], length[which])

            sets = []
            while len(going):
                sets.append(going)
                going = going[holds(going, step)]
                reach[going] += step
                step *= 2
            for going in reversed(sets):
                step //= 2
                more = going[holds(going, step)]
                reach[more] += step
            ends.append(rank + way * reach)
        return ends[0], ends[1] + 1

    def child(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, word: np.ndarray) -> np.ndarray:
        """A suffix of the node (low, high) of this length whose next word has this rank; -1 if none has."""
        end = high
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = self.ranks[0, np.minimum(self.order[np.minimum(middle, self.n - 1)] + length, self.n - 1)] < word
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        at = self.order[np.minimum(low, self.n - 1)]
        return np.where((low < end) & (self.ranks[0, np.minimum(at + length, self.n - 1)] == word), at, -1)


def nearest_smaller(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The nearest place before each one that holds a smaller value of the same group (a stretch of places); -1 if none does."""
    near = np.where(starts(groups), -1, np.arange(len(values)) - 1)
    going = np.flatnonzero((near >= 0) & (values[near] > values))
    while len(going):
        near[going] = near[near[going]]
        going = going[(near[going] >= 0) & (values[near[going]] > values[going])]
    return near


def blocks(tree: SuffixTree) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks."""
    longest = np.zeros(tree.n, np.int64)
    for order in (tree.order, tree.order[::-1]):
        near = nearest_smaller(order, tree.ranks[0, order])  # suffixes with another first word share nothing
        has = near >= 0
        here = order[has]
        longest[here] = np.maximum(longest[here], tree.ahead(here, order[near[has]]))
    out, at, step = [], 0, np.maximum(longest, 1).tolist()
    while at < tree.n:
        out.append(at)
        at += step[at]
    return np.array(out, np.int64)


def leftmost_squares(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """(start, half-length) of squares whose stretch to the right covers the leftmost occurrence of every square."""
    begin = blocks(tree)
    size = np.diff(np.append(begin, tree.n))
    words = tree.ranks[0]
    found = []
    # Squares with their centre in a block that reach beyond its end.
    block, k = spread(size[:-1])
    k, end = k + 1, begin[1:][block]
    here = words[end] == words[end - k]
    k, end = k[here], end[here]
    left = end - k
    after, before = tree.ahead(end, left), tree.behind(end - 1, left - 1)
    good = after + before >= k
    found.append((np.maximum(left - before, left - k + 1)[good], k[good]))
    # Squares with their centre in a block that start before it.
    block, k = spread(size + np.append(size[1:], 0))
    k, at = k + 1, begin[block]
    right = np.minimum(at + k, tree.n - 1)
    here = (at + k < tree.n) & (at > 0) & (words[at] == words[right]) & (words[at - 1] == words[right - 1])
    k, at, end = k[here], at[here], (begin + size)[block[here]]
    after, before = tree.ahead(at, at + k), tree.behind(at - 1, at + k - 1)
    start = np.maximum(at - before, at - k + 1)
    good = (after + before >= k) & (start + k <= end)
    found.append((start[good], k[good]))
    start, k = (np.concatenate(x) for x in zip(*found))
    return primitive(tree, start, k)


def primitive(tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those squares whose half is no repetition of a shorter stretch."""
    keep, rest, factor = np.ones(len(k), bool), k.copy(), 2
    while (rest > 1).any():
        factor = factor if factor * factor <= rest.max() else 0
        prime = np.where(rest > 1, factor or rest, 1)
        divides = (rest > 1) & (rest % prime == 0)
        which = np.flatnonzero(divides)
        shift = k[which] // prime[which]
        keep[which] &= ~tree.same(start[which], start[which] + shift, 2 * k[which] - shift)
        while len(which):
            rest[which] //= prime[which]
            which = which[(rest[which] > 1) & (rest[which] % prime[which] == 0)]
        if factor:
            factor += 1
    return start[keep], k[keep]


def vocabulary(tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(half-length, from, to) of the nodes of all squares that suffix-link walks from the given ones meet."""
    marked, out = np.zeros(0, np.int64), []
    while len(start):
        along = np.minimum(tree.ahead(start, start + k) - k, k - 1)  # the text itself goes on as far
        owner, place = spread(along + 1)
        half = k[owner]
        low, high = tree.node(start[owner] + place, 2 * half)
        key, first = np.unique(half * tree.n + low, return_index=True)
        fresh = ~np.isin(key, marked)
        marked = np.concatenate([marked, key[fresh]])
        first = first[fresh]
        out.append((half[first], low[first], high[first]))
        # Where the text ends, the suffix link of the last square, and the child that its first word names.
        open_ = along < k - 1
        last, k = (start + along)[open_], k[open_]
        low, high = tree.node(last + 1, 2 * k - 1)
        start = tree.child(low, high, 2 * k - 1, tree.ranks[0, last])
        start, k = start[start >= 0], k[start >= 0]
        key, first = np.unique(k * tree.n + tree.node(start, 2 * k)[0], return_index=True)
        first = first[~np.isin(key, marked)]
        start, k = start[first], k[first]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every maximal repetition of at least two periods, by start, then period."""
    tree = SuffixTree(symbols)
    half, low, high = vocabulary(tree, *leftmost_squares(tree))
    owner, place = spread(high - low)
    key = np.sort(half[owner] * tree.n + tree.order[low[owner] + place])
    new = np.r_[True, np.diff(key) != 1] if len(key) else np.zeros(0, bool)
    first = key[new]
    number = np.diff(np.append(np.flatnonzero(new), len(key)))
    period, start = first // tree.n, first % tree.n
    by = np.lexsort((period, start))
    return start[by], (number + 2 * period - 1)[by], period[by]


def numbered(texts: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, where each text's words begin) of texts given as words."""
    codes = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode().indices.to_numpy()
    sizes = np.array([len(words) for words in texts], np.int64)
    n = int(codes.max(initial=-1)) + 1
    owner, _ = spread(sizes)
    out = np.empty(len(codes) + len(texts) + 1, np.int64)
    begin = np.cumsum(sizes) - sizes + np.arange(len(texts)) + 1
    marks = np.append(begin - 1, len(out) - 1)
    inside = np.ones(len(out), bool)
    inside[marks] = False
    out[inside] = owner * n + codes
    out[marks] = -1 - np.arange(len(marks))
    return out, begin


def found_runs(texts: Sequence[Sequence[bytes]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[np.ndarray]:
    """start, length, period (columns) of each text's runs."""
    symbols, begin = numbered(texts)
    start, length, period = runs(symbols)
    long = length >= np.maximum(least_words, least_periods * period)
    start, length, period = start[long], length[long], period[long]
    of = np.searchsorted(begin, start, "right") - 1
    table = np.stack([start - begin[of], length, period], 1) if len(of) else np.zeros((0, 3), np.int64)
    return np.split(table, np.searchsorted(of, np.arange(1, len(texts))))


def looped(words: list[bytes], g: int) -> list[bytes]:
    """The words from g modulo their number on, replaced by a loop of the first of them."""
    n = len(words)
    if not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + (loop * -(-(n - a) // p))[: n - a]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run repeats, joined by one space."""
    if not len(found):
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found.tolist():
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find_runs(df: DataFrame, columns: list[str], text_column: str = "text", loop: Column | None = None) -> DataFrame:
    """columns of df, n_words, runs (array of start, length, period by start, then period), collapsed (the words that no run repeats, joined by spaces).

    loop: where it is a number g, the text's end is replaced by a loop first (see looped), which puts a run there.
    """
    bound_batches(df.sparkSession)
    made = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
    out = StructType([df.schema[c] for c in columns] + _parse_datatype_string(made).fields)
    m = len(columns)

    def part(batch: pa.RecordBatch, at: int, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = found_runs(texts)
        fields = np.concatenate(found).T
        entries = pa.StructArray.from_arrays([pa.array(f) for f in fields], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), entries)
        given = [batch.column(k).slice(at, len(texts)) for k in range(m)]
        return pa.RecordBatch.from_arrays([*given, pa.array([len(w) for w in texts]), lists, pa.array([collapsed(*x) for x in zip(texts, found)], pa.binary())], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, texts = 0, 0, []
            for text, g in zip(batch.column(m), batch.column(m + 1).to_pylist()):
                words = (text.as_py() or b"").split()
                texts.append(words if g is None else looped(words, g))
                size += len(words)
                if size >= TOGETHER:
                    yield part(batch, at, texts)
                    at, size, texts = at + len(texts), 0, []
            if texts:
                yield part(batch, at, texts)

    g = F.lit(None) if loop is None else loop
    rows = df.select(*columns, F.col(text_column).cast("binary").alias("__text"), g.cast("bigint").alias("__loop")).mapInArrow(run, out)
    return rows.withColumn("collapsed", F.col("collapsed").cast("string"))
