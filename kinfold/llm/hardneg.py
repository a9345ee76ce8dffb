"""Hard negatives by Fagin's threshold algorithm over integer inner products.

Candidates lie in pieces of about ``PIECE`` rows; a piece keeps one list of its rows per dimension, sorted by that component.  An
anchor reads every list from the end that its own component's sign prefers, ``STEP`` rows at first and then twice as deep each time.  Every row met for
the first time is scored in full by random access.  The threshold, the anchor's product with the components last read, bounds
whatever was not met; reading stops once it falls strictly below the k-th score of every window the anchor still fills, or below a window's own
lower end.  Strictly, since a row not met with the same score could come first by its smaller id.

Each (piece, group of anchors) is one task; it returns at most k rows a window, and the best of all pieces are ranked by a window whose limit is
taken before the shuffle.  Labels are only compared, never grouped by, so a frequent label makes no task larger.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import prepare, stored

PIECE, ANCHORS, STEP = 8192, 2048, 64
#: Whole numbers up to this size are exact as doubles, and a hundred of them fit in 64 bits.
EXACT = 1 << 53


class Wanted(NamedTuple):
    """Up to ``k`` rows whose label is the anchor's own or, if not ``same``, another; with a window's score s those with ``low * s <= 100 * score <= high * s``."""

    k: int
    same: bool
    low: int = 0
    high: int = 0


class Lists:
    """The rows of one piece with a sorted list per dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        # In order of the ids, so that a smaller place wins ties.
        order = np.lexsort((rows, ids))
        self.rows, self.ids, self.labels, self.x = rows[order], ids[order], labels[order], x[order]
        self.lists = np.ascontiguousarray(np.argsort(self.x, axis=0, kind="stable").T)
        self.values = np.take_along_axis(self.x.T, self.lists, 1)
        self.largest = int(np.abs(self.x).max(initial=0))
        self.real = self.x.astype(np.float64) if self.largest < EXACT else None

    def _scores(self, at: np.ndarray, anchor: np.ndarray, small: bool) -> np.ndarray:
        if small:
            return (self.real[at] @ anchor.astype(np.float64)).astype(np.int64)
        return np.array([sum(int(p) * int(q) for p, q in zip(row, anchor, strict=True)) for row in self.x[at]], dtype=object)

    def best(self, row: int, anchor: np.ndarray, label: int, windows: list[int | None], want: Wanted) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window's score the places of the best rows and their scores; None is no limit."""
        n, up, down = len(self.rows), np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        small = self.largest * int(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < EXACT and all(at is None or abs(at) < EXACT for at in windows)
        fits = (self.labels == label) if want.same else (self.labels != label)
        fits = fits & (self.rows != row)
        met, scores = np.zeros(n, bool), np.zeros(n, np.int64 if small else object)
        open_, depth = list(range(len(windows))), 0
        while open_ and depth < n:
            to = min(n, max(STEP, 2 * depth))
            new = np.zeros(n, bool)
            new[self.lists[up, n - to : n - depth].ravel()] = True
            new[self.lists[down, depth:to].ravel()] = True
            if not len(up) and not len(down):
                new[:] = True
            new &= ~met
            met |= new
            at = np.flatnonzero(new & fits)
            scores[at] = self._scores(at, anchor, small)
            if met.all():
                break
            depth = to
            last = np.concatenate((self.values[up, n - to], self.values[down, to - 1]))
            threshold = sum(int(w) * int(v) for w, v in zip(np.concatenate((anchor[up], anchor[down])), last, strict=True))
            open_ = [w for w in open_ if not self._done(scores, met & fits, threshold, windows[w], want)]
        seen = np.flatnonzero(met & fits)
        seen = seen[np.argsort(-scores[seen], kind="stable")]
        return [(mine, scores[mine]) for w in windows for mine in (seen[self._inside(scores[seen], w, want)][: want.k],)]

    @staticmethod
    def _inside(s: np.ndarray, at: int | None, want: Wanted) -> np.ndarray:
        return np.ones(len(s), bool) if at is None else ((100 * s >= want.low * at) & (100 * s <= want.high * at)).astype(bool)

    def _done(self, scores: np.ndarray, seen: np.ndarray, threshold: int, at: int | None, want: Wanted) -> bool:
        """Can no row not met come among the window's best?"""
        if at is not None and 100 * threshold < want.low * at:
            return True
        # No score of the window is over its upper end.
        if at is not None and 100 * threshold >= want.high * at:
            return False
        s = scores[seen]
        s = s[self._inside(s, at, want)]
        return len(s) >= want.k and threshold < int(np.partition(s, len(s) - want.k)[len(s) - want.k])


def valid(vectors: DataFrame, column: str, label: Column, asked: Column, scale: int) -> DataFrame:
    """``row, vec_id, label, x, asked``: rows with a vec_id, a label and a vector of finite components, each component floor(scale * x); stored, so that ``row`` stays."""
    v = F.transform(column, lambda x: x.cast("double"))
    some = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), v.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = some.where("vec_id is not null and label is not null and v is not null").where(fine)
    usual = some.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    some = some.where(F.size("v") == (usual.dim if usual else 0))
    return stored(some.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("v", lambda x: F.floor(F.lit(scale) * x)).alias("x"), "asked"), "rows")


def _searched(rows: DataFrame, asks: DataFrame, want: Wanted, pieces: int, groups: int) -> DataFrame:
    """``anchor, window, other, other_id, score`` of the best in each piece for asks (row, x, label, windows: array of scores or null)."""
    left = rows.select("row", "vec_id", "label", "x", F.pmod(F.xxhash64("row"), F.lit(pieces)).cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("share"))
    right = asks.select("row", "label", "x", "windows", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int").alias("share"))
    columns = ["anchor", "window", "other", "other_id", "score"]

    def scan(some: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        got: list[pd.DataFrame] = []
        if len(some) and len(anchors):
            lists = Lists(some["row"].to_numpy(), some["vec_id"].to_numpy(), some["label"].to_numpy(), np.stack(some["x"].to_numpy()))
            for row, label, x, windows in zip(anchors["row"], anchors["label"], anchors["x"], anchors["windows"], strict=True):
                limits = [None] if windows is None else [int(w) for w in windows]
                for w, (at, scores) in enumerate(lists.best(row, np.asarray(x), label, limits, want)):
                    if len(at):
                        got.append(pd.DataFrame({"anchor": row, "window": w, "other": lists.rows[at], "other_id": lists.ids[at], "score": scores.astype(np.int64)}))
        return pd.concat(got) if got else pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})

    keys = ["piece", "share"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "anchor bigint, window bigint, other bigint, other_id bigint, score bigint")
    nth = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "other_id", "other"))
    return found.withColumn("rank", nth).where(F.col("rank") <= want.k)


def hard_negatives(
    vectors: DataFrame, asked: Column | str, label: Column | str = "label", column: str = "embedding", positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each row that ``asked`` holds for.

    Components become floor(scale * x); a score is their whole inner product.  An anchor's positives are its best other rows of the same label, the
    negatives of a positive its best rows of another label with ``low * positive_score <= 100 * negative_score <= high * positive_score``; ties go to the smaller vec_id.
    Fewer candidates give fewer rows, so does a window that no score can meet (a positive score below 0).
    Rows whose label, vec_id or vector is null take no part, nor do those with a null or non-finite component or of another length than most (of lengths
    as frequent the longer counts).  Rows that repeat a vec_id are rows of their own.  An empty table gives no rows; other columns are read by ``asked`` and ``label`` only.
    Scores must fit in 64 bits.
    """
    prepare(vectors.sparkSession)
    expr = lambda c: F.expr(c) if isinstance(c, str) else c
    rows = valid(vectors, column, expr(label), expr(asked), scale)
    count, anchors = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("asked").cast("int")), F.lit(0))).first()
    pieces, groups = max(1, math.ceil(count / PIECE)), max(1, math.ceil(anchors / ANCHORS))
    own = stored(rows.where("asked").select("row", "vec_id", "label", "x"), "anchors")
    none = F.lit(None).cast("array<bigint>").alias("windows")
    near = stored(_searched(rows, own.select("row", "label", "x", none), Wanted(positives, True), pieces, groups), "positives")
    # At most ``positives`` windows an anchor, in order of their rank.
    windows = near.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("rank", "score")))["score"].alias("windows"))
    far = _searched(rows, stored(own.join(windows, "row").select("row", "label", "x", "windows"), "windows"), Wanted(k, False, low, high), pieces, groups)
    ids = own.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    chosen = near.select("anchor", (F.col("rank") - 1).cast("bigint").alias("window"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.select("anchor", "window", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score")).join(chosen, ["anchor", "window"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
