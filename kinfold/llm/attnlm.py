"""Scoring of texts by a causal self-attention model over subword ids, beside a unigram base over words.

The model gives every subword id, the end of the text among them, a probability after those before it:
the class of the next id, then the id within its class.  Class logits are the log-probability of the class after the id before,
counted over all training text, plus one head of causal self-attention over the classes seen so far, trained by
Adam on every window of every training text.  Classes group ids that stand near the same frequent ids of all training text, so attention sees
what kind of text it is in.  An id within its class follows the id before by discounted counts over all training text, backed by its
share of the class.  Every id of the tokenizer has a class and a share, so probabilities sum to one over all ids
after any history, and a text's score is the probability of its ids and the end.

Scoring cuts a document's ids into windows of ``WIDTH`` that overlap by ``CONTEXT``: each id is scored
once, the ids of the overlap only serve as context.  Windows of many documents are attended to
together under one causal mask.  Projections of (position, class) are tables.

Training cuts the texts into windows that do not overlap and deals them by hash to groups of at least ``SHARE``.  Up to ``TURNS`` turns take
their part of the groups each: every group goes on from the same state by itself, and the mean of their states begins the next turn.
So each id of the training text is learned from once; texts of fewer than ``SHARE`` windows are one group that goes over all of them
as often as makes up ``SHARE``.

Pairs of ids with at least 1/``PAIRS`` of all pairs number at most ``PAIRS``; these are looked up in memory.  All others count as well: what a pair's
count adds to the log-probability of its second id follows from the pair alone, so a document's rarer pairs meet it in a shuffle join.
The base needs each word's training count.  The most frequent words, at most ``HEAD``, are broadcast; the rest of a
document's words meet their counts in a shuffle join.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import gathered, prepare, stored, text_chunks, word_numbers
from kinfold.llm.dac import WordCoder, coder
from kinfold.plans.lineage import discard

CLASSES, DIM = 32, 16
WIDTH, CONTEXT = 32, 8
#: Windows that a group learns from, at least; in one step; in one row; and turns with their states' mean between them.
SHARE, BATCH, PIECE, TURNS = 36_000, 128, 16, 8
#: Frequent ids that tell the classes apart, how near they stand, and rounds of the clustering.
MARKS, NEAR, ROUNDS = 256, 8, 12
HEAD, PAIRS = 400_000, 1 << 21
#: Bytes of text counted and encoded at once, ids counted and scored at once, and windows in one step of scoring.
COUNT_BYTES, SCORE_BYTES, SCORE_IDS, STEP = 8_000_000, 3_000_000, 1_000_000, 64
#: Discount of the pair counts, and weight of the class-level share in the counts of classes after an id.
DISCOUNT, BACK = 0.75, 5.0
LN10 = float(np.log(10.0))


def add_near(near: np.ndarray, ids: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> None:
    """Count in ``near`` (id * MARKS + mark) the marks at most ``NEAR`` places from each id within its text; ``place`` numbers the marks, -1 for other ids."""
    # Only rows of ids that are there.  Places of no id and no mark stand between the texts; what is counted there goes to a cell of its own.
    seen = np.flatnonzero(np.bincount(ids, minlength=len(place)))
    row, nowhere = np.zeros(len(place), np.int64), len(seen) * MARKS
    row[seen] = np.arange(len(seen)) * MARKS
    gap = np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes) * NEAR
    at, mark = np.full((2, len(ids) + NEAR * len(sizes)), nowhere)
    at[gap] = row.take(ids)
    found = place.take(ids)
    mark[gap] = np.where(found < 0, nowhere, found)
    part = np.zeros(nowhere + 1, np.int64)
    for d in range(1, NEAR + 1):
        for centre, other in ((at[d:], mark[:-d]), (at[:-d], mark[d:])):
            cell = centre + other
            part += np.bincount(np.minimum(cell, nowhere, out=cell), minlength=len(part))
    near.reshape(-1, MARKS)[seen] += part[:-1].reshape(-1, MARKS)


def marks_of(counts: np.ndarray) -> np.ndarray:
    """For each id its number among the ``MARKS`` most frequent ones, or -1."""
    place = np.full(len(counts), -1)
    marks = np.argsort(-counts, kind="stable")[:MARKS]
    place[marks] = np.arange(len(marks))
    return place


def cluster(counts: np.ndarray, cells: np.ndarray, n: np.ndarray, seed: int = 4) -> np.ndarray:
    """Class of each id: spherical k-means on the marks near it, given as cells (id * MARKS + mark) and numbers; ids without a count go last."""
    out = np.full(len(counts), CLASSES - 1)
    seen = np.flatnonzero(counts)
    if not len(seen):
        return out
    row = np.zeros(len(counts), np.int64)
    row[seen] = np.arange(len(seen))
    rows = np.zeros((len(seen), MARKS))
    rows[row[cells // MARKS], cells % MARKS] = np.sqrt(n)
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    weight, k = counts[seen].astype(float), CLASSES - 1
    rng = np.random.default_rng(seed)
    centre = rows[rng.choice(len(seen), min(k, len(seen)), replace=False, p=weight / weight.sum())]
    for _ in range(ROUNDS):
        at = (rows @ centre.T).argmax(1)
        centre = np.stack([np.bincount(at, weight * column, len(centre)) for column in rows.T], 1)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    out[seen] = (rows @ centre.T).argmax(1)
    return out


def id_classes(ids: np.ndarray, sizes: np.ndarray, n_ids: int, seed: int = 4) -> np.ndarray:
    """Classes by ``cluster`` of ids in texts of the given sizes."""
    counts, near = np.bincount(ids, minlength=n_ids), np.zeros(n_ids * MARKS, np.int64)
    add_near(near, ids, sizes, marks_of(counts))
    cells = np.flatnonzero(near)
    return cluster(counts, cells, near[cells], seed)


class Attention:
    """Tables of a trained model; scores chunks of id sequences."""

    def __init__(self, classes: np.ndarray, counts: np.ndarray, cells: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], end_id: int, attends: bool = True, kinds: np.ndarray | None = None):
        """Counts over the training text: of each id, of classes after an id (id * CLASSES + class) and of the frequent pairs (id * ids + next id).

        ``kinds`` says how many different pairs each of ``cells`` counts; without it there are no others than ``pairs``, and what else a cell counts is left to the shares.
        Unless it ``attends``, the head's output is 0 and stays so: the rest of the model is trained as usual, to tell what attention adds.
        """
        self.attends = attends
        n_ids = len(classes)
        self.classes, self.end_id, self.n_ids = classes.astype(np.int64), end_id, n_ids
        after = np.zeros(n_ids * CLASSES, np.float64)
        after[cells[0]] = cells[1]
        self.bits = max(1, (4 * len(pairs[0])).bit_length())
        bucket = self._places(pairs[0].astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        self.keys = pairs[0].astype(np.int64)[order]
        self.firsts = np.searchsorted(bucket[order], np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        before, to = np.divmod(self.keys, n_ids)
        cell = before * CLASSES + self.classes[to]
        cut = np.maximum(pairs[1][order] - DISCOUNT, 0.0)
        self.gain = (cut / np.maximum(after[cell], 1.0)).astype(np.float32)
        rest = after - np.bincount(cell, cut, n_ids * CLASSES)
        # Cells that count pairs beside the given ones.
        self.more = np.zeros(len(after), bool)
        if kinds is not None:
            rest[cells[0]] = DISCOUNT * kinds
            self.more[cells[0]] = kinds > np.bincount(cell, minlength=len(after))[cells[0]]
        self.rest = np.where(after > 0, rest / np.maximum(after, 1.0), 1.0).astype(np.float32)
        self.after = after.astype(np.float32)
        size, mass = np.bincount(self.classes, minlength=CLASSES), np.bincount(self.classes, counts, CLASSES)
        self.share = ((counts + 1.0) / (mass + size)[self.classes]).astype(np.float32)
        after = after.reshape(n_ids, CLASSES)
        coarse = np.zeros((CLASSES, CLASSES))
        np.add.at(coarse, self.classes, after)
        smooth = (coarse.sum(0) + 1.0) / (coarse.sum() + CLASSES)
        coarse = (coarse + BACK * smooth) / (coarse.sum(1, keepdims=True) + BACK)
        self.prior = np.log((after + BACK * coarse[self.classes]) / (after.sum(1, keepdims=True) + BACK)).astype(np.float32)
        rng = np.random.default_rng(5)
        draw = lambda *shape: rng.normal(0, 0.1, shape)
        self.params = {"embed": draw(CLASSES, DIM), "place": draw(WIDTH, DIM), "q": draw(DIM, DIM), "k": draw(DIM, DIM), "v": draw(DIM, DIM), "out": draw(DIM, CLASSES), "skip": np.zeros((DIM, CLASSES))}
        if not attends:
            self.params["out"] = np.zeros((DIM, CLASSES))
        self.mask = np.where(np.tril(np.ones((WIDTH, WIDTH))) > 0, 0.0, -1e9)
        self.rooms: dict = {}

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of hash buckets, about four for each pair."""
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def added(self, pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What their counts add to the log-probability of pairs (id * ids + next id) that aren't among the frequent ones."""
        before, to = np.divmod(pairs, self.n_ids)
        cell = before * CLASSES + self.classes[to]
        p = np.maximum(self.rest[cell] * self.share[to], np.float32(1e-30)).astype(np.float64)
        return np.log1p(np.maximum(n - DISCOUNT, 0.0) / np.maximum(self.after[cell], 1.0) / p)

    def inside(self, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each id within its class after the id before, and where the pair isn't among the frequent ones but may have been counted: there ``added`` is lacking."""
        cell = before * CLASSES + self.classes[ids]
        p, lacking = self.rest[cell] * self.share[ids], self.more[cell]
        wanted = before * self.n_ids + ids
        bucket = self._places(wanted)
        at, left = self.firsts[bucket], np.arange(len(wanted))
        stop = self.firsts[bucket + np.uint64(1)]
        while len(left):
            # Buckets hold hardly more than one pair; the first of each, then the second of those that have one.
            more = at < stop
            left, at, stop = left[more], at[more], stop[more]
            hit = self.keys[at] == wanted[left]
            p[left[hit]] += self.gain[at[hit]]
            lacking[left[hit]] = False
            left, at, stop = left[~hit], at[~hit] + 1, stop[~hit]
        return np.log(np.maximum(p, np.float32(1e-30))), np.flatnonzero(lacking)

    def _room(self, name: str, shape: tuple[int, ...], kind: type) -> np.ndarray:
        """An array to write into, the same one at each call: fresh ones of this size cost a page fault every 4 kB."""
        key = name, shape, kind
        if key not in self.rooms:
            self.rooms[key] = np.empty(shape, kind)
        return self.rooms[key]

    def _slopes(self, ids: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and gradients for windows of ids and next classes, each place with its weight."""
        p, x = self.params, self.classes.take(ids)
        kind, m = p["q"].dtype, x.size
        room = lambda name, *shape: self._room(name, shape, kind)
        take = lambda a, rows, name: a.take(rows, 0, out=self._room(name, (*rows.shape, a.shape[1]), a.dtype), mode="clip")
        turned = lambda a: a.transpose(0, 2, 1)
        # What goes in is the sum of a place's and a class's row, and so are its projections.
        project = np.concatenate([p["q"] / np.sqrt(DIM).astype(kind), p["k"], p["v"], p["skip"]], 1)
        cuts = [DIM, 2 * DIM, 3 * DIM]
        (pq, pk, pv, ps), (eq, ek, ev, es) = np.split(p["place"] @ project, cuts, 1), np.split(p["embed"] @ project, cuts, 1)
        both = lambda a, b: (a[:, None] + b).reshape(WIDTH * CLASSES, -1)
        at = x + np.arange(WIDTH) * CLASSES
        q, k, v = take(both(pq, eq), at, "q"), take(both(pk, ek), at, "k"), take(tall := both(pv, ev), at, "v")
        e = np.matmul(q, turned(k), out=room("e", len(x), WIDTH, WIDTH))
        longest = lambda a: np.einsum("nd,nd->n", a, a).max()
        if longest(both(pq, eq)) * longest(both(pk, ek)) > 40**2:
            e -= (e + self.mask.astype(kind)).max(2, keepdims=True)
            np.minimum(e, 0, out=e)
        np.exp(e, out=e)
        e *= (self.mask == 0).astype(kind)
        per = 1 / (e @ np.ones(WIDTH, kind))[:, :, None]
        c = np.matmul(e, v, out=room("c", len(x), WIDTH, DIM))
        c *= per
        flat, base = c.reshape(m, DIM), both(ps, es)
        z = np.matmul(flat, p["out"], out=room("z", m, CLASSES))
        z += take(base, at.ravel(), "more")
        z += take(self.prior, ids.ravel(), "more")
        if np.abs(p["out"]).max() * np.abs(tall).max() * DIM + np.abs(base).max() > 40:
            z -= z.max(1, keepdims=True)
        dz = np.exp(z, out=z)
        share = (np.full(m, 1 / m) if weight is None else weight.ravel() / weight.sum()).astype(kind)
        hit, sums = np.arange(m) * CLASSES + y.ravel(), dz @ np.ones(CLASSES, kind)
        loss = -float(np.log(np.maximum(dz.ravel().take(hit) / sums, 1e-30)) @ share)
        dz *= (share / sums)[:, None]
        dz.ravel()[hit] -= share
        g = {"out": flat.T @ dz}
        dc = np.matmul(dz, p["out"].T, out=room("dc", m, DIM)).reshape(c.shape)
        # The weights are e * per: per goes with the small arrays.
        less = np.einsum("btd,btd->bt", dc, c)[:, :, None] * per
        dc *= per
        ds = np.matmul(dc, turned(v), out=room("other", *e.shape))
        ds -= less
        ds *= e
        d = room("d", *x.shape, 3 * DIM)
        for n, (left, right) in enumerate(((ds, k), (turned(ds), q), (turned(e), dc))):
            np.matmul(left, right, out=d[:, :, n * DIM : (n + 1) * DIM])
        # Sums by class and by place, as all the rest is linear in the two.
        order = np.argsort(x.astype(np.uint8).ravel(), kind="stable")
        stop, one = np.cumsum(np.bincount(x.ravel(), minlength=CLASSES)).tolist(), np.ones(m, kind)
        by_class, by_place = np.empty((CLASSES, project.shape[1]), kind), np.empty((WIDTH, project.shape[1]), kind)
        for a, columns in ((d.reshape(m, -1), slice(3 * DIM)), (dz, slice(3 * DIM, None))):
            rows = take(a, order, "rows")
            for j, (lo, hi) in enumerate(zip([0, *stop], stop)):
                by_class[j, columns] = one[lo:hi] @ rows[lo:hi]
            by_place[:, columns] = (one[: len(x)] @ a.reshape(len(x), -1)).reshape(WIDTH, -1)
        g["embed"], g["place"] = by_class @ project.T, by_place @ project.T
        g["q"], g["k"], g["v"], g["skip"] = np.split(p["embed"].T @ by_class + p["place"].T @ by_place, cuts, 1)
        g["q"] = g["q"] / np.sqrt(DIM).astype(kind)
        return loss, g

    def learner(self) -> "Attention":
        """What ``steps`` needs, without the tables of pairs."""
        out = copy.copy(self)
        out.keys = out.firsts = out.gain = out.rest = out.share = out.after = out.more = None
        return out

    def state(self) -> np.ndarray:
        """Parameters and no moments, one after another."""
        flat = np.concatenate([p.ravel() for p in self.params.values()])
        return np.concatenate([flat, np.zeros(2 * len(flat))])

    def load(self, state: np.ndarray) -> None:
        self.params = dict(zip(self.params, self._shaped(state, 0), strict=True))

    def _shaped(self, state: np.ndarray, part: int) -> list[np.ndarray]:
        shapes = [p.shape for p in self.params.values()]
        sizes = [p.size for p in self.params.values()]
        return [a.reshape(s) for a, s in zip(np.split(np.split(state, 3)[part], np.cumsum(sizes)[:-1]), shapes, strict=True)]

    def steps(self, state: np.ndarray, now: int, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
        """Adam from a state, ``now`` steps old, once over all windows in random order; the new state and its age."""
        state = state.astype(np.float32)
        net, (all_params, m, v) = copy.copy(self), np.split(state, 3)  # views of the state: changed in place
        net.load(state)
        order = np.random.default_rng(seed).permutation(len(x))
        for lo in range(0, len(x), BATCH):
            some = order[lo : lo + BATCH]
            _, slopes = net._slopes(x.take(some, 0), y.take(some, 0), weight.take(some, 0))
            if not self.attends:
                slopes["out"] = np.zeros_like(slopes["out"])
            g = np.concatenate([slopes[name].ravel() for name in net.params])
            now += 1
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            all_params -= np.float32(0.01 / (1 - 0.9**now)) * m / (np.sqrt(v * np.float32(1 / (1 - 0.99**now))) + np.float32(1e-8))
        return state, now

    def freeze(self) -> "Attention":
        """Tables by (position, class) for scoring."""
        p = self.params
        h = p["embed"][None] + p["place"][:, None]
        f32 = lambda a: np.ascontiguousarray(a.reshape(WIDTH * CLASSES, -1), dtype=np.float32)
        q, k = h @ p["q"] / np.sqrt(DIM), h @ p["k"]
        # Attention to every position is at most the exponential of this, so that sums stay finite without a look at the largest.
        high = np.linalg.norm(q, axis=2).max() * np.linalg.norm(k, axis=2).max()
        q *= min(1.0, 40.0 / max(high, 1e-12))
        # The column of ones sums the weights within the product with the values; it adds nothing to the classes.
        v = np.concatenate([h @ p["v"], np.ones((WIDTH, CLASSES, 1))], 2)
        self.tables = f32(q), f32(k), f32(v), f32(h @ p["skip"])
        self.out = np.concatenate([p["out"], np.zeros((1, CLASSES))]).astype(np.float32)
        self.causal = np.tril(np.ones((WIDTH, WIDTH), np.float32))
        return self

    def _windows(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, skip: int) -> np.ndarray:
        """Log-probabilities of the classes y at positions skip.. of windows with inputs ids of classes x."""
        q, k, v, base = self.tables
        room = lambda name, *shape: self._room(name, shape, np.float32)
        take = lambda a, rows, name: a.take(rows, 0, out=room(name, *rows.shape, a.shape[1]), mode="clip")
        at = x + np.arange(WIDTH) * CLASSES
        late = at[:, skip:]
        s = np.matmul(take(q, late, "q"), take(k, at, "k").transpose(0, 2, 1), out=room("e", *late.shape, WIDTH))
        np.exp(s, out=s)
        s *= self.causal[skip:]
        c = np.matmul(s, take(v, at, "v"), out=room("c", *late.shape, DIM + 1))
        c *= 1 / c[:, :, -1:]
        z = np.matmul(c.reshape(-1, DIM + 1), self.out, out=room("z", late.size, CLASSES))
        z += take(base, late.ravel(), "more")
        z += take(self.prior, ids[:, skip:].ravel(), "more")
        hit = z.ravel().take(np.arange(len(z)) * CLASSES + y[:, skip:].ravel())
        return (hit - np.log(np.exp(z, out=z) @ np.ones(CLASSES, np.float32))).reshape(len(x), -1)

    def score(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log-probability of each id of the sequences, which lie one after another; each ends with the end id, so none is empty."""
        return self.scored(ids, sizes)[0]

    def scored(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``score``, and the places and pairs where ``added`` is lacking."""
        ids = ids.astype(np.int64)
        y = self.classes[ids]
        begin = np.cumsum(sizes) - sizes
        before = np.append(self.end_id, ids[:-1])
        before[begin] = self.end_id
        total, lacking = self.inside(before, ids)
        pairs = before[lacking] * self.n_ids + ids[lacking]
        pad = np.zeros(WIDTH, np.int64)
        before, x, y = np.append(before, pad), np.append(self.classes[before], pad), np.append(y, pad)
        stride = WIDTH - CONTEXT
        more = np.maximum(0, -(-(sizes - WIDTH) // stride))
        owner = np.repeat(np.arange(len(sizes)), more)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more) + 1
        for starts, own, skip in ((begin, np.arange(len(sizes)), 0), (begin[owner] + step * stride, owner, CONTEXT)):
            for lo in range(0, len(starts), STEP):
                s, o = starts[lo : lo + STEP], own[lo : lo + STEP]
                at = s[:, None] + np.arange(WIDTH)
                real = at[:, skip:] < (begin + sizes)[o][:, None]
                at = np.minimum(at, len(x) - 1)
                total[at[:, skip:][real]] += self._windows(before.take(at), x.take(at), y.take(at), skip)[real]
        return total, lacking, pairs


def sequences(make: WordCoder, words: pa.Array, number: np.ndarray, n_words: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts that are given as words, each text with the end, and how many each has."""
    ids, sizes = make.encode_words(words, number)
    so_far = np.concatenate(([0], np.cumsum(sizes)))
    sizes = np.diff(so_far[np.concatenate(([0], np.cumsum(n_words)))])
    out = np.full(len(ids) + len(sizes), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out, sizes + 1


def id_type(n_ids: int) -> type:
    return np.uint16 if n_ids <= 1 << 16 else np.uint32


def id_chunks(batches: Iterator[pa.RecordBatch], column: int, kind: type) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches cut into slices of at most ``SCORE_IDS`` ids, or of one longer text: each with its ids, one text after another, and their numbers."""
    width = np.dtype(kind).itemsize
    for some in text_chunks(batches, column, SCORE_IDS * width):
        sizes = pc.binary_length(some.column(column)).to_numpy().astype(np.int64) // width
        yield some, np.frombuffer(b"".join(some.column(column).to_pylist()), kind), sizes


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all of ``docs``, the end being the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in text_chunks(batches, 0, COUNT_BYTES):
            words, number, _ = word_numbers(some.column(0))
            n = np.bincount(number, minlength=len(words))
            used = np.flatnonzero(n)
            words = pa.concat_arrays([words.take(pa.array(used)).cast(pa.binary()), pa.array([b""], pa.binary())])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n[used], some.num_rows), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(words: DataFrame) -> tuple[int, int, int]:
    """The tokens and words of a ``word, n`` table, and the count from which on words are at most ``HEAD``, in steps of 2 ** (1 / 8)."""
    step = F.floor(F.log2("n") * 8 + 1e-9).alias("step")
    steps = words.groupBy(step).agg(F.sum("n"), F.count(F.lit(1)), F.min("n")).orderBy(F.desc("step")).collect()
    fit = [r[3] for r, so_far in zip(steps, accumulate(r[2] for r in steps)) if so_far <= HEAD]
    return sum(r[1] for r in steps), sum(r[2] for r in steps), fit[-1] if fit else 1 << 62


def pair_counts(rows: DataFrame, n_ids: int, end_id: int) -> DataFrame:
    """``id, n`` over all of ``rows``: pairs of ids as id * n_ids + next id; a text begins after the end."""
    kind = id_type(n_ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, ids, sizes in id_chunks(batches, 0, kind):
            before = np.append(end_id, ids[:-1]).astype(np.int64)
            before[np.cumsum(sizes) - sizes] = end_id
            found, times = np.unique(before * n_ids + ids, return_counts=True)
            keys, back = np.unique(np.concatenate([keys, found]), return_inverse=True)
            numbers = np.bincount(back, np.concatenate([numbers, times]), len(keys)).astype(np.int64)
        for at in range(0, len(keys), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 200_000]), pa.array(numbers[at : at + 200_000])], ["id", "n"])

    return rows.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def near_counts(rows: DataFrame, place: np.ndarray) -> DataFrame:
    """``cell, n`` over all of ``rows``: how often each mark stands near each id, by ``add_near``."""
    n_ids = len(place)
    kind = id_type(n_ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros(n_ids * MARKS, np.int64)
        for _, ids, sizes in id_chunks(batches, 0, kind):
            add_near(near, ids, sizes, place)
        cells = np.flatnonzero(near)
        for at in range(0, len(cells), 200_000):
            some = cells[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(near[some])], ["cell", "n"])

    return rows.select("ids").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def pieces_of(rows: DataFrame, n_ids: int, end_id: int) -> DataFrame:
    """``doc_id, at, ids``: every text of ``rows`` cut into ``PIECE`` windows each, with the id before them."""
    kind, long = id_type(n_ids), PIECE * WIDTH

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, ids, sizes in id_chunks(batches, 1, kind):
            n = -(-sizes // long)
            owner = np.repeat(np.arange(len(sizes)), n)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            begin = (np.cumsum(sizes) - sizes)[owner] + at * long
            size = np.minimum(long, sizes[owner] - at * long)
            # Each text with the end before it.
            seq = np.insert(ids, np.cumsum(sizes) - sizes, end_id)
            flat = gathered(seq, begin + owner, size + 1)
            bounds = np.concatenate(([0], np.cumsum(size + 1))) * flat.itemsize
            data = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(owner)), pa.array(at, pa.int64()), data], ["doc_id", "at", "ids"])

    return rows.select("doc_id", "ids").mapInArrow(cut, "doc_id bigint, at bigint, ids binary")


def windows_of(net: Attention, pieces: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, next classes and weights of all windows of the pieces; places after the end of a text have no weight."""
    flat = np.frombuffer(b"".join(pieces), kind).astype(np.int32)
    sizes = np.array([len(p) for p in pieces]) // np.dtype(kind).itemsize
    n = -(-(sizes - 1) // WIDTH)
    owner = np.repeat(np.arange(len(sizes)), n)
    inside = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))[:, None] * WIDTH + np.arange(WIDTH)
    real = inside < (sizes - 1)[owner][:, None]
    at = (np.cumsum(sizes) - sizes)[owner][:, None] + np.where(real, inside, 0)
    return flat[at], net.classes[flat[at + 1]], real.astype(np.float32)


def train(net: Attention, pieces: DataFrame, n_windows: int, kind: type, seed: int = 9) -> None:
    """Learn from every window of ``pieces``, group by group, turn by turn.

    A piece's group follows from its hash, and the order within it too, so that the model doesn't depend on the partitioning.
    """
    spark = pieces.sparkSession
    groups = max(1, n_windows // SHARE)
    turns, passes = min(TURNS, groups), -(-SHARE // n_windows) if n_windows < SHARE else 1
    keyed = pieces.withColumn("key", F.xxhash64("doc_id", "at", "ids")).withColumn("slot", F.pmod("key", F.lit(groups)))
    keyed = stored(keyed.withColumn("turn", (F.col("slot") % turns).cast("int")), "pieces", "turn")
    held, state, now = spark.sparkContext.broadcast(net.learner()), net.state(), 0
    for turn in range(turns):

        def fit(batches: Iterator[pa.RecordBatch], begin: np.ndarray = state, age: int = now) -> Iterator[pa.RecordBatch]:
            net, width = held.value, np.dtype(kind).itemsize

            def rows(now: np.ndarray, steps: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(now) + 1, dtype=np.int32)), pa.array(np.append(now, steps).astype(np.float64))], ["at", "value"])

            def go(pieces: list[bytes], now: np.ndarray, steps: int) -> tuple[np.ndarray, int]:
                x, y, weight = windows_of(net, pieces, kind)
                for k in range(passes):
                    now, steps = net.steps(now, steps, x, y, weight, seed + k)
                return now, steps

            slot, some, n, now, steps = None, [], 0, begin, age
            for batch in batches:
                for s, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if s != slot or n >= SHARE:
                        if some:
                            now, steps = go(some, now, steps)
                        if s != slot and slot is not None:
                            yield rows(now, steps)
                            now, steps = begin, age
                        slot, some, n = s, [], 0
                    some.append(ids)
                    n += -(-(len(ids) // width - 1) // WIDTH)
            if some:
                yield rows(*go(some, now, steps))

        mine = keyed.where(F.col("turn") == turn).select("slot", "ids", "key", "doc_id", "at")
        ordered = mine.repartition(-(-groups // turns), "slot").sortWithinPartitions("slot", "key", "doc_id", "at").select("slot", "ids")
        # Decimals, whose sum has no order.
        mean = ordered.mapInArrow(fit, "at int, value double").groupBy("at").agg((F.sum(F.col("value").cast("decimal(38,18)")).cast("double") / F.count(F.lit(1))).alias("value")).toArrow()
        if mean.num_rows:
            found = mean.sort_by("at").column("value").to_numpy()
            state, now = found[:-1], round(found[-1])
    net.load(state)
    held.destroy()
    discard(keyed)


def learn(rows: DataFrame, n_ids: int, end_id: int, attends: bool = True) -> tuple[Attention, DataFrame]:
    """A model from the ``doc_id, ids`` of all training rows, and ``id, n`` of the pairs that are too many for its tables."""
    pairs = stored(pair_counts(rows, n_ids, end_id), "pairs")
    # At most n_ids * n_ids rows by the vocabulary, here as sums by id, by (id, class) and as frequent pairs: n_ids, CLASSES * n_ids and PAIRS rows.
    single = pairs.groupBy((F.col("id") % n_ids).alias("id")).agg(F.sum("n").alias("n")).toArrow()
    both = lambda t: (t.column("id").to_numpy(), t.column("n").to_numpy().astype(float))
    number = np.zeros(n_ids)
    number[both(single)[0]] = both(single)[1]
    total = int(number.sum())
    # At most MARKS cells for an id.
    near = near_counts(rows, marks_of(number)).toArrow().sort_by("cell")
    classes = cluster(number, near.column("cell").to_numpy(), near.column("n").to_numpy())
    table = rows.sparkSession.createDataFrame(pa.table({"to": np.arange(n_ids), "class": classes.astype(np.int32)}))
    split = pairs.select((F.expr(f"id div {n_ids}")).alias("before"), (F.col("id") % n_ids).alias("to"), "n")
    cells = split.join(F.broadcast(table), "to").groupBy((F.col("before") * CLASSES + F.col("class")).alias("id")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).toArrow()
    often = pairs.where(F.col("n") * PAIRS >= total).toArrow()
    net = Attention(classes, number, both(cells), both(often), end_id, attends, cells.column("kinds").to_numpy())
    kind = id_type(n_ids)
    n_windows = rows.agg(F.sum(F.ceil(F.octet_length("ids") / (np.dtype(kind).itemsize * WIDTH)))).first()[0]
    if n_windows:
        train(net, pieces_of(rows, n_ids, end_id), int(n_windows), kind)
    return net.freeze(), pairs.where(F.col("n") * PAIRS < total)


def score_texts(docs: DataFrame, training: Column, tokenizer: str, attends: bool = True) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    ``training`` says which rows teach.  A null or empty text is the end alone.  Rows are scored one by one, so
    repeated rows score alike and each is given.  Without training rows counts are 0 and the base is 0 by its formula.
    An empty table gives no rows.  Texts of any length are scored whole.  Other columns are not read.  With ``attends=False`` the model is trained and scores without attention.
    """
    spark = prepare(docs.sparkSession)
    make = coder(tokenizer)
    n_ids, end_id = make.tokenizer.get_vocab_size(with_added_tokens=True), make.end_id
    kind = id_type(n_ids)
    words = stored(word_counts(docs.where(training)), "counts")
    total, distinct, least = head_of(words)
    often = words.where(F.col("n") >= least).toArrow()  # at most HEAD words
    frequent = spark.sparkContext.broadcast((often.column("word").combine_chunks(), np.append(often.column("n").to_numpy(), 0)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head, times), code, part, row = frequent.value, coder(tokenizer), TaskContext.get().partitionId(), 0
        count = lambda found: times[pc.fill_null(pc.index_in(found.cast(pa.binary()), head), len(head)).to_numpy()]
        end = int(count(pa.array([b""]))[0])
        for some in text_chunks(batches, 1, SCORE_BYTES):
            words, number, n_words = word_numbers(some.column(1))
            ids, sizes = sequences(code, words, number, n_words, end_id)
            known = count(words).astype(np.float64)[number]
            owner = np.repeat(np.arange(len(n_words)), n_words)
            # The end is a word too.
            base = np.bincount(owner, np.log10(known + 1.0), len(n_words)) + np.log10(end + 1.0)
            n_known = np.bincount(owner, known > 0, len(n_words)).astype(np.int64) + int(end > 0)
            rare = np.flatnonzero(known == 0)
            bounds = np.concatenate(([0], np.cumsum(np.bincount(owner[rare], minlength=len(n_words)))))
            tails = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.take(pa.array(number[rare])).cast(pa.binary()))
            rid = (part << 40) + row + np.arange(some.num_rows)
            row += some.num_rows
            stops = np.concatenate(([0], np.cumsum(sizes))) * np.dtype(kind).itemsize
            coded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(ids.astype(kind))])
            columns = [pa.array(rid, pa.int64()), some.column(0), some.column(2), pa.array(n_words + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), tails, coded]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "taught", "n_tokens", "known", "base", "tail", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("taught"))
    first = stored(rows.mapInArrow(encode, "rid bigint, doc_id bigint, taught boolean, n_tokens bigint, known bigint, base double, tail array<binary>, ids binary"), "ids")
    net, rest = learn(first.where("taught").select("doc_id", "ids"), n_ids, end_id, attends)
    model = spark.sparkContext.broadcast(net)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            more = model.value.added(some.column(0).to_numpy(), some.column(1).to_numpy()) / LN10
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(more)], ["pair", "added"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for some, ids, sizes in id_chunks(batches, 5, kind):
            each, places, pairs = net.scored(ids, sizes)
            begin = np.cumsum(sizes) - sizes
            scores = np.add.reduceat(each.astype(np.float64), begin) / LN10
            bounds = np.searchsorted(places, np.append(begin, len(ids)))
            rare = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pairs))
            yield pa.RecordBatch.from_arrays([*some.columns[:5], pa.array(scores), rare], ["rid", "doc_id", "n_tokens", "known", "base", "score", "rare"])

    scored = first.select("rid", "doc_id", "n_tokens", "known", "base", "ids").mapInArrow(work, "rid bigint, doc_id bigint, n_tokens bigint, known bigint, base double, score double, rare array<bigint>")
    scored = stored(scored, "scores")
    each = first.select("rid", F.explode("tail").alias("word"))
    # A rare word is met once for all rows that hold it; only those with a count come back.  So it is with rare pairs.
    met = each.join(words.where(F.col("n") < least).hint("shuffle_hash"), "word").select("rid", F.log10(F.col("n") + 1).alias("logs"), F.lit(None).cast("double").alias("added"))
    pairs = scored.select("rid", F.explode("rare").alias("pair")).join(rest.select("id", "n").mapInArrow(add, "pair bigint, added double"), "pair")
    met = met.unionAll(pairs.select("rid", F.lit(None).cast("double").alias("logs"), "added"))
    sums = met.groupBy("rid").agg(F.count("logs").alias("more"), F.sum("logs").alias("logs"), F.sum("added").alias("added"))
    out = scored.join(sums, "rid", "left")
    base = F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("added", F.lit(0.0))).alias("score"))
