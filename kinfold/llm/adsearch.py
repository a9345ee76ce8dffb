"""Nearest neighbours by inner product: inverted lists scanned with adaptive dimension sampling.

Largest inner product becomes least distance by one more coordinate: x -> (x, sqrt(M^2 - |x|^2)), q -> (q, 0),
with M the largest norm.  Vectors are rotated by one random orthogonal matrix and laid out in column blocks.  After d
of D rotated coordinates, the partial distance scaled by D/d estimates the whole; a candidate is
abandoned when the estimate exceeds the bound (the k-th best so far) by more than the factor
(1 + EPS/sqrt(d))^2, a hypothesis test whose error falls with EPS.  Survivors get exact products on the original vectors in double precision.

Lists come from k-means on at most ``SAMPLE`` vectors; every vector is in the index.  How many lists a query scans is fitted on
the sample: the least number that holds ``TARGET`` of the sample's own true neighbours, few where vectors cluster and many where they don't.
Neighbouring lists share a piece of about ``PIECE`` vectors and a list larger than that is cut, so a task holds a bounded number of vectors
whatever the lists' sizes; a query is sent once to each piece, in groups of at most some ``QUERIES``.  A block of queries meets a block of columns as one matrix
product until few candidates are left.  A query's nearest list is scanned first, with its piece, for a good bound for the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import prepare, stored

SAMPLE, MAX_LISTS, PER_LIST, ROUNDS = 20_000, 1024, 16, 6
#: Share of the sample's true neighbours that the lists scanned must hold, and how many queries measure it.
TARGET, MEASURED = 0.95, 256
BLOCK, EPS = 32, 1.6
PIECE, QUERIES = 8192, 16_384
#: Queries in one matrix product, and the share of candidates below which pairs are followed one by one.
TOGETHER, FEW = 256, 0.05


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty cluster moves to the point farthest from its centroid."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    centre = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        d = (centre**2).sum(1) - 2 * x @ centre.T
        at, far = d.argmin(1), d.min(1) + (x**2).sum(1)
        sums, n = np.zeros_like(centre), np.bincount(at, minlength=len(centre))
        np.add.at(sums, at, x)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        centre[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    # Neighbouring centroids get neighbouring numbers: by their own coarser clusters.
    if len(centre) > PER_LIST:
        coarse = kmeans(centre, math.isqrt(len(centre)), rounds, seed)
        centre = centre[np.argsort(_distances(centre, coarse).argmin(1), kind="stable")]
    return centre


def _distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances, less what is the same for all centroids."""
    return (centre**2).sum(1) - 2 * x.astype(np.float32) @ centre.T


def rotation(d: int, seed: int = 2) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(top**2 - (x**2).sum(1), 0.0))])


def fitted_probes(x: np.ndarray, centre: np.ndarray, top: float, k: int, target: float = TARGET) -> int:
    """The least number of lists that holds ``target`` of the k nearest of some of the sample's vectors among the sample."""
    asked = np.arange(min(MEASURED, len(x)))
    products = x[asked] @ x.T
    products[asked, asked] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(centre)
    near = np.argpartition(-products, k - 1, axis=1)[:, :k]
    at = _distances(lifted(x, top), centre).argmin(1)
    place = _distances(np.column_stack([x[asked], np.zeros(len(asked))]), centre).argsort(1, kind="stable").argsort(1)
    ranks = np.sort(np.take_along_axis(place, at[near], 1).ravel())
    return int(ranks[math.ceil(target * len(ranks)) - 1]) + 1


def valid(vectors: DataFrame, column: str, asked: Column) -> DataFrame:
    """``vec_id, v, asked``: vectors that are not null, empty or zero and hold only finite numbers, as doubles."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(column, lambda x: x.cast("double")).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where("vec_id is not null and v is not null").where(fine)


class Scan:
    """Adaptive scan of one piece: vectors with their row numbers and lists."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, lists: np.ndarray, x: np.ndarray, top: float, turn: np.ndarray):
        self.rows, self.ids, self.lists, self.x, self.turn = rows, ids, lists, x, turn
        self.d = x.shape[1] + 1
        self.cuts = [(lo, min(lo + BLOCK, self.d)) for lo in range(0, self.d, BLOCK)]
        turned = (lifted(x, top) @ turn).astype(np.float32)
        self.blocks = [np.ascontiguousarray(turned[:, a:b]) for a, b in self.cuts]
        self.norms = [(b**2).sum(1) for b in self.blocks]

    def nearest(self, rows: np.ndarray, q: np.ndarray, probed: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, exact product) of up to k best for each query but its own row, by product and then vec_id.

        ``probed[i, l]``: query i scans list l.  ``bound`` is a known k-th distance of each query, infinite where there is none.
        """
        turned = (np.column_stack([q, np.zeros(len(q))]) @ self.turn).astype(np.float32)
        alive = probed[:, self.lists] & (rows[:, None] != self.rows[None, :])
        slack = 1e-4 * (1 + (turned**2).sum(1) + float(sum(n.max() for n in self.norms)))
        bound, partial, pairs = bound.astype(np.float32), np.zeros(alive.shape, np.float32), None
        for n, (a, b) in enumerate(self.cuts):
            mine = turned[:, a:b]
            if pairs is None:
                # All pairs of the block by one product.
                partial += (mine**2).sum(1)[:, None] + self.norms[n][None, :] - 2 * mine @ self.blocks[n].T
            else:
                i, j, d = pairs
                d += ((self.blocks[n][j] - mine[i]) ** 2).sum(1)
            if n == 0 and not np.isfinite(bound).all():
                bound = self._first_bounds(turned, partial, alive, k, bound)
            limit = (bound + slack) if b == self.d else (bound * (1 + EPS / math.sqrt(b)) ** 2 + slack) * (b / self.d)
            if pairs is None:
                alive &= partial <= limit[:, None]
                if b == self.d or alive.sum() <= FEW * alive.size:
                    i, j = np.nonzero(alive)
                    pairs = (i, j, partial[i, j])
            else:
                keep = d <= limit[i]
                pairs = (i[keep], j[keep], d[keep])
        i, j, _ = pairs
        products = (self.x[j] * q[i]).sum(1)
        order = np.lexsort((self.rows[j], self.ids[j], -products, i))
        i, j, products = i[order], j[order], products[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        return i[nth < k], j[nth < k], products[nth < k]

    def _first_bounds(self, turned: np.ndarray, partial: np.ndarray, alive: np.ndarray, k: int, bound: np.ndarray) -> np.ndarray:
        """Where there is no bound yet, the k that look best so far give one by their exact distances."""
        if alive.shape[1] <= k:
            return bound
        looks = np.where(alive, partial, np.inf)
        some = np.argpartition(looks, k - 1, axis=1)[:, :k]
        exact = sum(((self.blocks[m][some] - turned[:, None, a:b]) ** 2).sum(2) for m, (a, b) in enumerate(self.cuts))
        exact[~np.take_along_axis(alive, some, 1)] = np.inf
        return np.minimum(bound, exact.max(1)).astype(np.float32)


def search(vectors: DataFrame, asked: Column | str, k: int = 20, column: str = "embedding", target: float = TARGET) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``asked`` holds for, the k nearest of all rows but itself.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows without a vec_id and those of another length
    than most (of lengths as frequent the longer counts); an empty table gives no rows.  Fewer candidates than k give fewer rows.  Ties go to the
    smaller vec_id.  Rows that repeat a vec_id are rows of their own: each is a candidate, and each asked one gets its neighbours.
    Other columns are read by ``asked`` only.
    """
    spark = prepare(vectors.sparkSession)
    out = "query_id bigint, rank int, vec_id bigint, score double"
    wanted = F.expr(asked) if isinstance(asked, str) else asked
    every = valid(vectors, column, wanted)
    usual = every.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if not usual:
        return spark.createDataFrame([], out)
    dim = usual.dim
    every = stored(every.where(F.size("v") == dim).withColumn("row", F.monotonically_increasing_id()), "vectors")
    count, top = every.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    share = min(1.0, SAMPLE / count)
    drawn = every.select("row", "v").where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("row")).limit(SAMPLE)
    sample = np.stack([np.array(r.v) for r in drawn.collect()])
    centre = kmeans(lifted(sample, top), max(1, min(MAX_LISTS, len(sample) // PER_LIST)))
    n_probes = fitted_probes(sample, centre, top, k, target)
    model = spark.sparkContext.broadcast((centre, rotation(dim + 1), float(top)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, _, high = model.value
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(2).flatten()).reshape(batch.num_rows, dim)
                at = _distances(lifted(x, high), centre).argmin(1)
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), raw, pa.array(at, pa.int32())], ["row", "vec_id", "asked", "v", "list"])

    placed = stored(every.select("row", "vec_id", "v", "asked").mapInArrow(place, "row bigint, vec_id bigint, asked boolean, v binary, list int"), "placed")
    # At most MAX_LISTS rows.
    sizes = np.zeros(len(centre), np.int64)
    for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r.list] = r.n
    first, pieces, at, held = [], [], -1, PIECE
    for n in sizes.tolist():
        parts = max(1, math.ceil(n / PIECE))
        if parts > 1 or held + n > PIECE:
            at, held = at + 1, 0
        first.append(at)
        pieces.append(parts)
        at, held = at + parts - 1, PIECE if parts > 1 else held + n
    where = spark.createDataFrame([(n, f, p) for n, (f, p) in enumerate(zip(first, pieces, strict=True))], "list int, first int, parts int")
    first_, parts_ = np.array(first), np.array(pieces)
    left = placed.join(F.broadcast(where), "list").withColumn("piece", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int")).select("piece", "row", "vec_id", "v", "list")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and piece that holds some of its lists; ``home`` where the nearest list is among them."""
        centre, _, _ = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(batch.num_rows, dim)
            near = np.argsort(_distances(np.column_stack([x, np.zeros(len(x))]), centre), axis=1, kind="stable")[:, :n_probes]
            source, piece, home, lists = [], [], [], []
            for i, mine in enumerate(near):
                for p in np.unique(first_[mine]).tolist():
                    some = mine[first_[mine] == p]
                    for extra in range(int(parts_[some[0]])):
                        source.append(i)
                        piece.append(p + extra)
                        home.append(bool(mine[0] in some))
                        lists.append(some.astype(np.int32))
            at = pa.array(source, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(piece, pa.int32()), pa.array(home, pa.bool_()), pa.array(lists, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "v", "piece", "home", "lists"])

    routed = stored(placed.where("asked").select("row", "vec_id", "v").mapInArrow(route, "row bigint, vec_id bigint, v binary, piece int, home boolean, lists array<int>"), "routed")

    def scanned(wanted: DataFrame) -> DataFrame:
        """``query, query_id, vec_id, other, score, norm`` for (row, vec_id, v, piece, lists, bound) rows."""
        shares = wanted.groupBy("piece").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("shares"))
        right = wanted.join(shares, "piece").withColumn("share", F.pmod(F.xxhash64("row"), F.col("shares")).cast("int")).drop("shares", "home")
        vectors_ = left.join(shares, "piece").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

        def scan(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            got: list[pd.DataFrame] = []
            if len(rows) and len(asks):
                _, turn, high = model.value
                matrix = lambda c: np.frombuffer(b"".join(c), np.float64).reshape(len(c), dim)
                inside, lists = np.unique(rows["list"].to_numpy(), return_inverse=True)
                piece = Scan(rows["row"].to_numpy(), rows["vec_id"].to_numpy(), lists, matrix(rows["v"]), high, turn)
                for lo in range(0, len(asks), TOGETHER):
                    some = asks.iloc[lo : lo + TOGETHER]
                    probed = np.zeros((len(some), len(inside)), bool)
                    for i, mine in enumerate(some["lists"]):
                        probed[i] = np.isin(inside, mine)
                    q = matrix(some["v"])
                    i, j, products = piece.nearest(some["row"].to_numpy(), q, probed, k, some["bound"].to_numpy())
                    norm = (q**2).sum(1)
                    got.append(pd.DataFrame({"query": some["row"].to_numpy()[i], "query_id": some["vec_id"].to_numpy()[i], "vec_id": piece.ids[j], "other": piece.rows[j], "score": products, "norm": norm[i]}))
            return pd.concat(got) if got else pd.DataFrame({c: [] for c in ("query", "query_id", "vec_id", "other", "score", "norm")})

        keys = ["piece", "share"]
        return vectors_.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "query bigint, query_id bigint, vec_id bigint, other bigint, score double, norm double")

    def best(found: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "other"))
        return found.withColumn("rank", nth).where(F.col("rank") <= k)

    home = stored(best(scanned(routed.where("home").withColumn("bound", F.lit(float("inf"))))), "home")
    # The k-th product so far as a distance: |q|^2 + M^2 - 2 product.
    kth = home.where(F.col("rank") == k).select(F.col("query").alias("row"), (F.col("norm") + float(top) ** 2 - 2 * F.col("score")).alias("bound"))
    others = routed.where("not home").join(kth, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    cols = ["query", "query_id", "vec_id", "other", "score"]
    return best(home.select(*cols).union(scanned(others).select(*cols))).select("query_id", "rank", "vec_id", "score")
