"""Periodic runs of words by an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(``LEAST_LENGTH``, ``LEAST_POWER`` * q) that no neighbouring word extends keeping q.

1. The suffixes of a document are sorted by prefix doubling: only groups that still agree are
   sorted again.  The ranks of each step (suffixes by their first 1, 2, 4, ... words) are
   kept; they answer whether two stretches are equal, and how far to the left or right.
   Several documents are sorted side by side, each among its own suffixes.
2. LCP intervals follow from the nearest smaller LCP values to both sides; their children
   are the stretches between the places where the LCP equals the interval's depth.  There
   are no tree nodes, only arrays of bounds.
3. Branching tandems: for every suffix i of all children but a largest one, of an
   interval of depth q, ISA[i + q] (or ISA[i - q]) inside the interval means a square of period q at i
   (or i - q).  It branches where the word after it breaks the period: each run is found at its last
   square, in O(n log n) tests.
4. Squares rotate to the left as far as the period holds, by the kept ranks.  Squares that end where
   a run of a divisor of their period ends belong to that run.

Memory: four bytes a word for each power of two up to the longest repeat inside a document.

Defined cases: null, blank and short texts have no runs.  Each row is handled by itself, so
repeated rows, a null doc_id and other columns change nothing.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.textbatch import lists, slices, split

LEAST_LENGTH, LEAST_POWER = 6, 4
#: Suffixes of an interval's children that are tested together; rounds of pointer jumping before a scan.
TESTED, ROUNDS = 2_000_000, 40


class Suffixes:
    """Suffix array, its inverse and LCP values of integer sequences, each sorted among its own suffixes."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.text = np.concatenate([*sequences, np.empty(0, np.int64)]).astype(np.int64)
        n = len(self.text)
        ends = np.cumsum(sizes)
        #: Where each place's sequence begins and ends.
        self.begin, self.end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        place = np.arange(n)
        order = np.lexsort((self.text, self.begin))
        new = np.ones(n, bool)
        new[1:] = (self.text[order[1:]] != self.text[order[:-1]]) | (self.begin[order[1:]] != self.begin[order[:-1]])
        # A group's rank is the place of its first suffix in the sorted order, so it changes only if its group splits.
        head = np.maximum.accumulate(np.where(new, place, 0))
        rank = np.empty(n, np.int32)
        rank[order] = head
        #: ranks[k][i] == ranks[k][j] if and only if 2 ** k words are equal from i and j on.
        self.ranks = [rank]
        depth = 1
        live = order[_shared(new)]
        while len(live):
            rank = rank.copy()
            follow = live + depth
            inside = follow < self.end[live]
            after = np.where(inside, rank[np.where(inside, follow, 0)] + 1, 0)
            before = rank[live].astype(np.int64)
            order = np.argsort(before * (n + 1) + after, kind="stable")
            live, before, after = live[order], before[order], after[order]
            at = np.arange(len(live))
            group = np.ones(len(live), bool)
            group[1:] = before[1:] != before[:-1]
            new = group.copy()
            new[1:] |= after[1:] != after[:-1]
            rank[live] = before + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            live = live[_shared(new)]
            self.ranks.append(rank)
            depth *= 2
        self.inverse = rank.astype(np.int64)
        self.array = np.empty(n, np.int64)
        self.array[self.inverse] = place

    def lcp(self) -> np.ndarray:
        """LCP of each suffix and the one before it in the sorted order; 0 for a sequence's first."""
        out = np.zeros(len(self.array), np.int64)
        first = self.ranks[0][self.array]
        near = np.flatnonzero(first[1:] == first[:-1]) + 1
        a, b, n = self.array[near - 1], self.array[near], len(self.array)
        length = np.zeros(len(near), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a + length, b + length
            inside = np.maximum(x, y) < n
            equal = inside & (self.ranks[k][np.where(inside, x, 0)] == self.ranks[k][np.where(inside, y, 0)]) & (x != y)
            length[equal] += 1 << k
        out[near] = length
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b (a < b, of one sequence) are equal."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            while True:
                x, y = a - out - (1 << k), b - out - (1 << k)
                inside = x >= self.begin[a]
                equal = inside & (self.ranks[k][np.where(inside, x, 0)] == self.ranks[k][np.where(inside, y, 0)])
                if not equal.any():
                    break
                out[equal] += 1 << k
        return out


def _shared(new: np.ndarray) -> np.ndarray:
    """Whether each place is in a group of two or more; ``new`` marks the groups' first places."""
    follows = np.ones(len(new), bool)
    follows[:-1] = new[1:]
    return ~(new & follows)


def smaller(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each place in ``at``, the nearest place before it with a smaller value; values[0] is below all of them."""
    link = np.arange(len(values)) - 1
    live = at
    for _ in range(ROUNDS):
        live = live[values[link[live]] >= values[live]]
        if not len(live):
            return link[at]
        link[live] = link[link[live]]
    # Long chains that doubling does not shorten: look back in growing stretches.
    for i in live[values[link[live]] >= values[live]]:
        to, size = int(link[i]) + 1, 64
        while True:
            low = max(0, to - size)
            found = np.flatnonzero(values[low:to] < values[i])
            if len(found):
                link[i] = low + found[-1]
                break
            to, size = low, size * 2
    return link[at]


def squares(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the branching squares in intervals of as many suffixes as a run has."""
    none = np.empty(0, np.int64)
    lcp = s.lcp()
    n = len(lcp)
    at = np.flatnonzero(lcp)
    if not len(at):
        return none, none
    low = smaller(lcp, at)
    # To the right the same search runs on the mirrored values, between two zeros.
    mirrored = np.concatenate([[0], lcp[::-1]])
    high = n - smaller(mirrored, n - at) - 1
    # A square of period q that ends a run of LEAST_POWER * q words recurs in that many suffixes of the interval.
    wide = (high - low + 1 >= LEAST_POWER) & (lcp[at] * LEAST_POWER <= (s.end - s.begin)[s.array[at]])
    at, low, high = at[wide], low[wide], high[wide]
    if not len(at):
        return none, none
    order = np.lexsort((at, high, low))
    at, low, high = at[order], low[order], high[order]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    # Children: one from the interval's low end, one from each place where the LCP is its depth.
    interval = np.cumsum(new) - 1
    starts = np.concatenate([low[new], at])
    owner = np.concatenate([np.arange(new.sum()), interval])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    tops = high[new]
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(owner[1:] != owner[:-1], True)
    ends[last] = tops[owner[last]]
    sizes = ends - starts + 1
    firsts = np.flatnonzero(np.diff(owner, prepend=-1))
    largest = np.maximum.reduceat(sizes, firsts)[owner]
    # One largest child an interval is left out: the first of them.
    is_largest = np.flatnonzero(sizes == largest)
    left_out = is_largest[np.diff(owner[is_largest], prepend=-1) > 0]
    keep = np.ones(len(starts), bool)
    keep[left_out] = False
    starts, sizes, owner = starts[keep], sizes[keep], owner[keep]
    depth, lows = lcp[at[new]], low[new]
    found = []
    total = np.cumsum(sizes)
    cut = 0
    while cut < len(starts):
        to = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + TESTED, side="right")))
        part = slice(cut, to)
        rows = np.arange(sizes[part].sum()) + np.repeat(starts[part] - np.cumsum(sizes[part]) + sizes[part], sizes[part])
        v = np.repeat(owner[part], sizes[part])
        i, q = s.array[rows], depth[v]
        for here, other in ((i, i + q), (i - q, i - q)):
            inside = (other >= s.begin[i]) & (other < s.end[i])
            rank = s.inverse[np.where(inside, other, 0)]
            square = np.flatnonzero(inside & (rank >= lows[v]) & (rank <= tops[v]))
            start, p = here[square], q[square]
            after = start + 2 * p
            branches = (after >= s.end[start]) | (s.text[np.minimum(after, n - 1)] != s.text[start + p])
            found.append((start[branches], p[branches]))
        cut = to
    start, p = (np.concatenate(c) for c in zip(*found, strict=True))
    both = np.unique(np.stack([start, p]), axis=1)
    return both[0], both[1]


def runs(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, start, length and period of every run, by sequence, start and period."""
    s = Suffixes(sequences)
    start, q = squares(s)
    end = start + 2 * q
    order = np.lexsort((q, end))
    start, q, end = start[order], q[order], end[order]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(start):
        # Of the squares that end at a place, the one of the smallest period is rotated; its run holds those of multiples.
        changes = np.diff(end, prepend=-1) > 0
        new, owner = np.flatnonzero(changes), np.cumsum(changes) - 1
        first = start[new] - s.left(start[new], start[new] + q[new])
        out.append((first, end[new] - first, q[new]))
        rest = (q % q[new][owner] != 0) | (start < first[owner])
        start, q, end = start[rest], q[rest], end[rest]
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, none
    first, length, period = (np.concatenate(c) for c in zip(*out, strict=True))
    enough = length >= np.maximum(LEAST_LENGTH, LEAST_POWER * period)
    first, length, period = first[enough], length[enough], period[enough]
    order = np.lexsort((period, first))
    first, length, period = first[order], length[order], period[order]
    sizes = np.array([len(x) for x in sequences])
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, first, side="right")
    return owner, first - (ends - sizes)[owner], length, period


def _numbers(words: list[str], seen: dict[str, int]) -> np.ndarray:
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _find(words_of: Callable[[object, str | None], list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = [words_of(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                seen: dict[str, int] = {}
                owner, start, length, period = runs([_numbers(w, seen) for w in texts])
                kept = {}
                for i in np.unique(owner):
                    stay = np.ones(len(texts[i]), bool)
                    for k in np.flatnonzero(owner == i):
                        stay[start[k] + period[k]:start[k] + length[k]] = False
                    kept[i] = [texts[i][j] for j in np.flatnonzero(stay)]
                counts = np.bincount(owner, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([len(w) for w in texts], pa.int64()),
                    *(lists(x, counts, pa.int64()) for x in (start, length, period)),
                    pa.array([" ".join(kept.get(i, w)) for i, w in enumerate(texts)], pa.string())],
                    ["doc_id", "n_words", "starts", "lengths", "periods", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, words_of: Callable[[object, str | None], list[str]] = lambda _, text: split(text)) -> DataFrame:
    """doc_id, n_words, starts, lengths and periods of the runs, by start and period, and the text without their repeats.

    ``words_of`` gives a row's words from its doc_id and text.  Every run keeps its first period.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _find(words_of), f"doc_id {kind}, n_words long, starts array<long>, lengths array<long>, periods array<long>, "
        "collapsed string")


def planted(doc_id: int | None, text: str | None) -> list[str]:
    """The words of a text, of one document in ten with a repeating tail; a row without an id keeps its words."""
    words = split(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or not words or h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def op12_branching_tandems(docs: DataFrame) -> DataFrame:
    """Number, longest and digests of the runs of every row, after ``planted``."""
    found = periodic_runs(docs, planted)
    every = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    # The longest run, of the smallest start, then period.
    longest = F.array_max(F.transform(every, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    listed = F.array_join(F.transform(every, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("starts") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    found = found.withColumn("best", longest)
    length, start, period = F.col("best.length"), -F.col("best.col2"), -F.col("best.col3")
    return found.select(
        "doc_id", F.size("starts").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.expr("1000 * best.length div -best.col3").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
