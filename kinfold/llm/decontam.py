"""Benchmark passages in documents: random-walk embedding, bit sampling, exact verification.

Both sides are sequences of words.  The CGK embedding of a window walks along its words: at every step it writes the word it is at, and a
random bit for (repetition, step, word) says whether it goes on to the next.  Two walks that part at an edit come together again, so windows
within few edits agree in many steps, and edit distance becomes Hamming distance.  Each of ``REPETITIONS`` walks is sampled at
``SAMPLED`` of its first ``STEPS`` steps; the words sampled there are hashed into one key.  Windows begin at every word, of items as of documents, so an edit
anywhere in an item leaves many windows that agree; equal keys in any repetition make a candidate, the item-sized stretch of the document around it.
With an edit at every fifth word a window between edits agrees in half of the repetitions; over all windows and repetitions the chance to
miss an item of ``SHORT`` or more words at ``MAX_EDITS`` is under a thousandth (measured in the tests).

Items of fewer words have too few windows.  An item of n words with k = ``MAX_EDITS`` * n edits, cut into k + 1 pieces, has one piece
intact, so short items are looked up by all their pieces and none is missed.  Keys are 64-bit hashes that wrap around; a collision costs a verification, never a result.
Each candidate is verified: the words' edit distance between the whole item and its best place near the hits
must be at most ``MAX_EDITS`` of the item's words.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import prepare, text_chunks, word_numbers

MAX_EDITS = 0.2
#: Walks of a window, their steps and how many of these are sampled.
REPETITIONS, STEPS, SAMPLED = 6, 6, 3
#: Items of fewer words are looked up by intact pieces.
SHORT = 16
#: Odd factor of the keys' hash.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Items are handled in slices of about so many characters, each a pass over the documents.  Measured with 500,000 words, all distinct: see the README.
SLICE_CHARS = 4_000_000
CHUNK_BYTES = 3_000_000


def best_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to any stretch of ``text``, with the stretch: (distance, start, end), the earliest end on ties."""

    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        steps = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else steps.copy()
        for i, x in enumerate(a, 1):
            new = np.empty_like(row)
            new[0] = i
            new[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
            row = np.minimum.accumulate(new - steps) + steps
        return row

    row = last_row(item, text, True)
    end = int(row.argmin())
    back = last_row(item[::-1], text[:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


class Keys:
    """Sorted keys with the item and the place in it that each stands for."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        keys, owners, places = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners, self.places = keys[order], owners[order], places[order]
        self.shift = np.uint64(64 - max(16, len(keys).bit_length() + 4))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self.keys >> self.shift] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which key, item, place) for all that are known."""
        at = np.flatnonzero(self.seen[keys >> self.shift])
        lo, hi = (np.searchsorted(self.keys, keys[at], side) for side in ("left", "right"))
        n = hi - lo
        stop = np.cumsum(n)
        row = np.repeat(lo - (stop - n), n) + np.arange(int(stop[-1]) if len(n) else 0)
        return np.repeat(at, n), self.owners[row], self.places[row]


class Index:
    """Words, window keys and pieces of a slice of items."""

    def __init__(self, items: list[tuple[int, str]], seed: int = 7):
        self.ids = [i for i, _ in items]
        words, number, sizes = word_numbers(pa.array([t for _, t in items], pa.string()))
        low = [w.lower() for w in words.to_pylist()]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(low), 1)}
        numbers = np.array([self.vocabulary[w] for w in low], np.int64)
        self.items = np.split(numbers[number], np.cumsum(sizes)[:-1]) if items else []
        self.bags = [list(Counter(item.tolist()).items()) for item in self.items]
        rng, n = np.random.default_rng(seed), len(self.vocabulary) + 1
        self.codes = rng.integers(0, 1 << 64, n, np.uint64)
        self.bits = rng.integers(0, 2, (REPETITIONS, STEPS, n), np.uint8)
        # Any step may be sampled; the first sample is one of the early ones, so that most keys lie within a few words.
        self.steps = [np.sort(rng.choice(STEPS, SAMPLED, replace=False)) for _ in range(REPETITIONS)]
        # All long items one after another, a 0 after each.
        long = [n for n, item in enumerate(self.items) if len(item) >= SHORT]
        lengths = np.array([len(self.items[n]) + 1 for n in long], np.int64)
        flat = np.concatenate([x for n in long for x in (self.items[n], [0])]).astype(np.int64) if long else np.zeros(0, np.int64)
        owner, place = np.repeat(np.array(long, np.int64), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.windows = [Keys([(key, owner[start], place[start])]) for start, key in self._walks(flat, np.flatnonzero(flat))] if long else []
        pieces: dict[int, list] = defaultdict(list)
        for n, item in enumerate(self.items):
            if len(item) >= SHORT:
                continue
            k = int(MAX_EDITS * len(item))
            short, longer = divmod(len(item), k + 1)
            starts = np.arange(k + 1) * short + np.minimum(np.arange(k + 1), longer)
            for width, at in ((short + 1, starts[:longer]), (short, starts[longer:])):
                if width and len(at):
                    pieces[width].append((self._runs(item, width)[at], np.full(len(at), n), at))
        self.pieces = {width: Keys(parts) for width, parts in sorted(pieces.items())}

    def _runs(self, symbols: np.ndarray, width: int) -> np.ndarray:
        """The hash of the ``width`` words from each place on."""
        codes = self.codes[symbols]
        size = max(0, len(codes) - width + 1)
        keys = codes[:size].copy()
        for k in range(1, width):
            keys *= FACTOR
            keys ^= keys >> np.uint64(29)
            keys += codes[k : k + size]
        return keys

    def _walks(self, symbols: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each repetition the starts whose sampled words are of the vocabulary and all at different places, and their keys.

        Symbol 0 is a word of no item, or a text's end; a walk stays there.
        """
        for bits, steps in zip(self.bits, self.steps, strict=True):
            start, at, last, key = starts, starts, np.full(len(starts), -1), np.zeros(len(starts), np.uint64)
            for step in range(int(steps[-1]) + 1):
                now = symbols[at]
                if step in steps:
                    fine = (now > 0) & (at > last)
                    start, at, key, now = start[fine], at[fine], key[fine], now[fine]
                    last = at
                    key = (key ^ (key >> np.uint64(29))) * FACTOR + self.codes[now]
                at = at + bits[step][now] * (now > 0)
            yield start, key

    def hits(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rows (document, item, where the item would start), each once and in order, for every key of an item in the symbols; the last symbol is 0."""
        found = []
        if self.windows:
            for known, (start, key) in zip(self.windows, self._walks(symbols, np.flatnonzero(symbols)), strict=True):
                which, item, place = known.find(key)
                found.append((owner[start[which]], item, start[which] - place))
        for width, known in self.pieces.items():
            which, item, place = known.find(self._runs(symbols, width))
            found.append((owner[which], item, which - place))
        rows = np.concatenate([np.stack(x, 1) for x in found]) if found else np.zeros((0, 3), np.int64)
        return np.unique(rows, axis=0)

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, start word, end word, edits): the best place of each item in each text."""
        words, number, sizes = word_numbers(texts)
        get = self.vocabulary.get
        mine = np.fromiter((get(w if w.isascii() else w.lower(), 0) for w in words.to_numpy(zero_copy_only=False)), np.int64, len(words))[number]
        # A 0 after each text keeps walks and pieces inside it.
        stops = np.cumsum(sizes)
        symbols = np.zeros(len(mine) + len(sizes), np.int64)
        symbols[np.arange(len(mine)) + np.repeat(np.arange(len(sizes)), sizes)] = mine
        begins = [(int(e - n) + k, int(e) + k) for k, (n, e) in enumerate(zip(sizes, stops, strict=True))]
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        spans: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
        for doc, n, start in self.hits(symbols, owner).tolist():
            size, (lo, hi) = len(self.items[n]), begins[doc]
            k = int(MAX_EDITS * size)
            a, b = max(lo, start - k), min(hi, start + size + k)
            near = spans[doc, n]
            if near and a <= near[-1][1]:
                near[-1][1] = max(b, near[-1][1])
            else:
                near.append([a, b])
        for doc, n, a, b in ((*key, *span) for key, near in spans.items() for span in near):
            item, lo = self.items[n], begins[doc][0]
            k = int(MAX_EDITS * len(item))
            # All but k of the item's words must be there, in any order, before order is looked at.
            there = Counter(symbols[a:b].tolist())
            if sum([min(c, there[w]) for w, c in self.bags[n]]) < len(item) - k:
                continue
            d, s, e = best_place(item, symbols[a:b])
            if d <= k and (d, a + s - lo) < best.get((doc, n), (1 << 60, 0, 0))[:2]:
                best[doc, n] = (d, a + s - lo, a + e - lo)
        return [(doc, self.ids[n], s, e, d) for (doc, n), (d, s, e) in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, end, edits``: per row of ``docs`` and item found in it, its best place in words.

    An item is found where a stretch of the text is within ``MAX_EDITS`` of its words.  Null, empty and blank texts
    hold nothing, and such items are found nowhere; empty tables give no rows.  Repeated rows and repeated items each give their own rows; a row without a doc_id gives null.
    Texts of any length are searched whole; other columns are not read.  Words are lower-cased and split at ASCII white space.  Items are read in slices of bounded size.
    """
    spark = prepare(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, math.ceil(chars / SLICE_CHARS))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id bigint, start bigint, end bigint, edits bigint"
    out = spark.createDataFrame([], schema)
    for n in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == n).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in part]))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for some in text_chunks(batches, 1, CHUNK_BYTES):
                cols = list(zip(*shared.value.leaks(some.column(1)), strict=True)) or [[]] * 5
                ids = some.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in cols[1:]]], ["doc_id", "item_id", "start", "end", "edits"])

        out = out.union(rows.mapInArrow(find, schema))
    return out
