"""Periodic runs in texts through a Re-Pair grammar of their words.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` words and ``REPEATS`` periods long, that no neighbouring word extends.

The words of many texts become numbers and one sequence.  Re-Pair replaces pairs of symbols that occur more than once, the
locally most frequent first, by new symbols until none is left; what remains of each text is then folded pair by pair into one
symbol.  The shortest symbol that holds a run holds it across the boundary between its two parts.  So the runs across each symbol's boundary are looked for once,
at the symbol's first place, and taken over to all places that the derivation gives it.  A run that reaches its symbol's end there may go on
at another place; such pieces of an interval are merged into the maximal one, which a larger symbol gives whole.

At a boundary b only some periods can do.  One side of the boundary holds half of the run, so ``2^j`` words at b are the same as those q words on (or back), where
q < 2^(j+2): equal stretches of each power of two, sorted by content and place, give these q.  How far each q reaches follows from comparing stretches of falling powers of two.

Texts in which no four words repeat, near enough to each other, can't hold a run and enter no grammar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import prepare, text_chunks, word_numbers

LEAST, REPEATS = 24, 3
#: Words in a row whose return starts a period, as a power of two: a quarter of LEAST at most.
FIRST = 2
#: Bytes of text taken together, and words in one grammar (one longer text is a grammar of its own).
CHUNK_BYTES, GRAMMAR_WORDS = 8_000_000, 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _next(name: np.ndarray, step: int) -> np.ndarray:
    """Names of stretches twice as long: of places ``i`` from those of ``i`` and ``i + step``."""
    x = name[:-step] * _MIX[0] + name[step:] + np.uint64(step)
    x ^= x >> np.uint64(29)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(32))


class Stretches:
    """64-bit names of all stretches of 1, 2, 4... words, longest first compared."""

    def __init__(self, words: np.ndarray):
        x = words.astype(np.uint64) * _MIX[1] + np.uint64(1)
        self.names = [x ^ (x >> np.uint64(31))]
        while (step := 1 << (len(self.names) - 1)) < len(self.names[-1]):
            self.names.append(_next(self.names[-1], step))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on, i < j, are the same."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            near = np.minimum(j, len(name) - 1)
            same = (j < len(name)) & (name[np.minimum(i, len(name) - 1)] == name[near])
            i, j = i + (same << k), j + (same << k)
        return i - start

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j, i < j, are the same."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.names) - 1, -1, -1):
            name, step = self.names[k], 1 << k
            same = (i >= step) & (j <= len(self.names[0])) & (name[np.maximum(i - step, 0)] == name[np.minimum(np.maximum(j - step, 0), len(name) - 1)])
            i, j = i - (same << k), j - (same << k)
        return start - i


def repair(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grammar's derivation: for each place of a symbol with two parts its number, start and the words in its first part, and its whole length.

    ``texts`` tells the text of each word; a pair never spans two.  Returns (symbol, start, first, length) stacked by rows, in order of making.
    """
    symbol, owner = words.astype(np.int64), texts.copy()
    start, length = np.arange(len(words)), np.ones(len(words), np.int64)
    free = int(symbol.max(initial=-1)) + 1
    made: list[np.ndarray] = []

    def replace(at: np.ndarray, key: np.ndarray) -> None:
        """Pairs at places ``at`` become one symbol each, the same for the same key."""
        nonlocal symbol, owner, start, length, free
        kinds, number = np.unique(key, return_inverse=True)
        made.append(np.stack([free + number, start[at], length[at], length[at] + length[at + 1]]))
        symbol[at] = free + number
        length[at] += length[at + 1]
        free += len(kinds)
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol, owner, start, length = symbol[keep], owner[keep], start[keep], length[keep]

    while len(symbol) > 1:
        _, small = np.unique(symbol, return_inverse=True)
        pair = np.where(owner[:-1] == owner[1:], small[:-1] * np.int64(len(symbol)) + small[1:], -1)
        _, number, counts = np.unique(pair, return_inverse=True, return_counts=True)
        often = np.where(pair >= 0, counts[number], 0)
        if often.max() < 2:
            break
        # More frequent than both neighbouring pairs; of pairs as frequent the one of the smaller number, and of equal pairs in a row every second from the left.
        rank = often * np.int64(len(pair) + 1) + (len(pair) - number)
        left, right = np.concatenate(([-1], rank[:-1])), np.concatenate((rank[1:], [-1]))
        best = (often >= 2) & (rank >= left) & (rank >= right)
        begins = best & ~np.concatenate(([False], best[:-1] & (rank[1:] == rank[:-1])))
        order = np.arange(len(pair))
        since = order - np.maximum.accumulate(np.where(begins, order, 0))
        at = np.flatnonzero(best & (since % 2 == 0))
        replace(at, pair[at])
    while len(symbol) > 1:
        inside = np.arange(len(symbol)) - np.searchsorted(owner, owner)
        at = np.flatnonzero((inside[:-1] % 2 == 0) & (owner[:-1] == owner[1:]))
        if not len(at):
            break
        replace(at, np.arange(len(at)))
    return np.concatenate(made, axis=1) if made else np.zeros((4, 0), np.int64)


def _periods(stretches: Stretches, start: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol's place, q) for all periods that runs across the boundary of the given symbols may have."""
    low, high, boundary = start, start + length, start + first
    most = length // REPEATS
    pairs: list[np.ndarray] = []
    for j in range(FIRST, len(stretches.names)):
        least, beyond, wide = (1 if j == FIRST else 1 << (j + 1)), 1 << (j + 2), 1 << j
        big = np.flatnonzero(most >= least)
        if not len(big):
            break
        name = stretches.names[j]
        # Places of stretches that occur more than once, by content and then place.
        order = np.argsort(name, kind="stable")
        same = name[order[1:]] == name[order[:-1]]
        order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        place = np.full(len(name), -1)
        place[order] = np.arange(len(order))
        for at, way in ((boundary, 1), (boundary - wide, -1)):
            some = big[(at[big] >= low[big]) & (at[big] + wide <= high[big])]
            some = some[place[at[some]] >= 0]
            here, step = place[at[some]], 0
            while len(some):
                step += way
                there = here + step
                ok = (there >= 0) & (there < len(order))
                some, here, there = some[ok], here[ok], there[ok]
                other = order[there]
                q = np.abs(other - at[some])
                ok = (name[other] == name[at[some]]) & (q < beyond) & (q <= most[some])
                some, here, q = some[ok], here[ok], q[ok]
                fits = q >= least
                pairs.append(np.stack([some[fits], q[fits]]))
    both = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def runs_of(words: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all maximal runs; ``texts`` numbers each word's text from 0, in order."""
    # A word of its own ends each text, so that nothing equal spans two.
    n_texts = int(texts[-1]) + 1
    at = np.arange(len(words)) + texts
    flat = np.empty(len(words) + n_texts, np.int64)
    ends = np.searchsorted(texts, np.arange(n_texts), side="right") + np.arange(n_texts)
    flat[at], flat[ends] = words, int(words.max()) + 1 + np.arange(n_texts)
    owner = np.empty(len(flat), np.int64)
    owner[at], owner[ends] = texts, np.arange(n_texts)
    stretches = Stretches(flat)
    symbol, start, first, length = repair(flat, owner)
    kinds, once = np.unique(symbol, return_index=True)
    once = once[length[once] >= LEAST]
    which, q = _periods(stretches, start[once], first[once], length[once])
    node, boundary = once[which], (start + first)[once[which]]
    # From the boundary, how far words q apart stay the same, within the symbol.
    ahead, back = stretches.ahead(boundary, boundary + q), stretches.back(boundary, boundary + q)
    lo, hi = np.maximum(boundary - back, start[node]), np.minimum(boundary + q + ahead, start[node] + length[node])
    # The same from q words before it, for runs that lie mostly left of the boundary.
    far = boundary - q
    inside = far >= 0
    ahead, back = stretches.ahead(np.maximum(far, 0), boundary), stretches.back(np.maximum(far, 0), boundary)
    lo2, hi2 = np.maximum(far - back, start[node]), np.minimum(boundary + ahead, start[node] + length[node])
    node, q = np.concatenate((node, node[inside])), np.concatenate((q, q[inside]))
    lo, hi = np.concatenate((lo, lo2[inside])), np.concatenate((hi, hi2[inside]))
    b = start[node] + first[node]
    good = (hi - lo >= np.maximum(LEAST, REPEATS * q)) & (lo < b) & (hi > b)
    node, q, lo, hi = node[good], q[good], lo[good], hi[good]
    found = np.unique(np.stack([symbol[node], lo - start[node], hi - start[node], q]), axis=1)
    # To every place of the symbol.
    order = np.argsort(symbol, kind="stable")
    a, z = np.searchsorted(symbol[order], found[0]), np.searchsorted(symbol[order], found[0], side="right")
    many = z - a
    row = np.repeat(np.arange(len(many)), many)
    place = start[order[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many)]]
    lo, hi, q = found[1][row] + place, found[2][row] + place, found[3][row]
    # Pieces of one interval of a period are merged: those that share q words or more.
    order = np.lexsort((lo, q))
    lo, hi, q = lo[order], hi[order], q[order]
    if len(lo):
        # Periods lie apart on one line, so the largest end so far never comes from another.
        shift = q * np.int64(len(flat) + 1)
        reach = np.maximum.accumulate(hi + shift)
        new = np.concatenate(([True], (q[1:] != q[:-1]) | (lo[1:] + shift[1:] + q[1:] > reach[:-1])))
        heads = np.flatnonzero(new)
        lo, q = lo[heads], q[heads]
        hi = reach[np.concatenate((heads[1:] - 1, [len(reach) - 1]))] - q * np.int64(len(flat) + 1)
        # The smallest period of an interval; a larger one of it is a multiple.
        order = np.lexsort((q, hi, lo))
        lo, hi, q = lo[order], hi[order], q[order]
        lead = np.concatenate(([True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
        lo, hi, q = lo[lead], hi[lead], q[lead]
    back_to = owner[lo]
    return np.stack([lo - back_to, hi - back_to, q]) if len(lo) else np.zeros((3, 0), np.int64)


def _may_hold(words: np.ndarray, texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which texts have the same four words twice, at most a third of the text apart."""
    wide = 1 << FIRST
    out = np.zeros(len(sizes), bool)
    if len(words) < LEAST:
        return out
    x = words.astype(np.uint64) * _MIX[1] + (texts.astype(np.uint64) << np.uint64(32))
    for step in (1 << k for k in range(FIRST)):
        x = _next(x, step)
    inside = np.flatnonzero(texts[: len(x)] == texts[wide - 1 :])
    order = inside[np.argsort(x[inside], kind="stable")]
    a, b = order[:-1], order[1:]
    near = (x[a] == x[b]) & (texts[a] == texts[b]) & ((b - a) * REPEATS <= sizes[texts[a]])
    out[texts[a[near]]] = True
    return out


def chunk_runs(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word, how many each text has, and rows (text, start, end, period) of all runs by text, start and period."""
    words, number, sizes = word_numbers(texts, lower=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    held = np.flatnonzero(_may_hold(number, owner, sizes))
    begins, found = np.cumsum(sizes) - sizes, []
    groups = np.searchsorted(np.cumsum(sizes[held]), np.arange(GRAMMAR_WORDS, int(sizes[held].sum()) + GRAMMAR_WORDS, GRAMMAR_WORDS), side="right")
    lo = 0
    for hi in np.unique(np.concatenate((groups, [len(held)]))).tolist():
        # A text longer than a grammar's words comes with the ones before it.
        if hi <= lo:
            continue
        some = held[lo:hi]
        many = sizes[some]
        offset = np.cumsum(many) - many
        at = np.repeat(begins[some] - offset, many) + np.arange(int(many.sum()))
        start, end, q = runs_of(number[at], np.repeat(np.arange(len(some)), many))
        which = np.searchsorted(offset, start, side="right") - 1
        found.append(np.stack([some[which], start - offset[which], end - offset[which], q]))
        lo = hi
    rows = np.concatenate(found, axis=1).T if found else np.zeros((0, 4), np.int64)
    return words.cast(pa.binary()).to_pylist(), number, sizes, rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(docs: DataFrame, collapse: bool = True) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row: all runs by start and then period, and the text without the words that repeat.

    ``runs`` holds (start, length, period) in words.  A word is left out of ``collapsed`` if any run holds it after that run's first period; the others are joined
    by one space, with ``collapse=False`` the column is null.  Words are as they stand, case included.
    A null, empty or blank text has no words, no runs and collapses to the empty string; texts of any length are searched whole.  Repeated rows and rows
    without a doc_id are rows like others; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    prepare(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in text_chunks(batches, 1, CHUNK_BYTES):
            words, number, sizes, rows = chunk_runs(some.column(1))
            cuts = np.searchsorted(rows[:, 0], np.arange(len(sizes) + 1)).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(rows[:, 1]), pa.array(rows[:, 2] - rows[:, 1]), pa.array(rows[:, 3])], fields=list(kind.value_type))
            stop, texts = np.cumsum(sizes), []
            if collapse:
                for i, (z, n) in enumerate(zip(stop.tolist(), sizes.tolist(), strict=True)):
                    mine = number[z - n : z]
                    if cuts[i] < cuts[i + 1]:
                        change = np.zeros(n + 1, np.int64)
                        own = rows[cuts[i] : cuts[i + 1]]
                        np.add.at(change, own[:, 1] + own[:, 3], 1)
                        np.add.at(change, own[:, 2], -1)
                        mine = mine[np.cumsum(change[:n]) == 0]
                    texts.append(b" ".join([words[w] for w in mine.tolist()]))
            collapsed = pa.array(texts, pa.binary()).cast(pa.string()) if collapse else pa.nulls(len(sizes), pa.string())
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), flat, type=kind), collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, f"doc_id bigint, n_words bigint, runs {RUN}, collapsed string")
