"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle hashes gives two signature values, its minimum and its
maximum, so ``2 * permutations`` values cost ``permutations`` hash evaluations.  Bands of ``rows``
values name buckets.  With 80 permutations, bands of 5 and similarity 0.8 a link is missed with
probability (1 - 0.8^5)^32, about 3 in a million.

Documents with equal shingle sets are one representative from the start.  In every bucket each
representative is held against the smallest one, its leader; confirmed links give components.
Two members of a bucket that are still in different components can only be linked if one of them is outside the
leader's component.  These few are held against all members of the leader, in blocks and on exact set differences, so no candidate that could
still join two components goes unchecked, and a bucket of copies never emits its pairs.  Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import prepare, stored, text_chunks, word_numbers
from kinfold.operators.graphs import components

PERMUTATIONS, ROWS, SEED = 80, 5, 20240607
#: Most members of a leader, and most of those outside its component, that meet in one task.
BLOCK_MEMBERS, BLOCK_OUTSIDE = 1024, 256
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Bytes of text hashed at once, and shingles whose permutations are taken together.
CHUNK_BYTES, CACHED = 4_000_000, 16_384


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[2]
    return x ^ (x >> np.uint64(29))


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit hashes of each text's word shingles, sorted text by text, and how many each has; fewer words than ``width`` are one shingle."""
    words, number, sizes = word_numbers(texts)
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(words))[number]
    counts = np.where(sizes > 0, np.maximum(sizes - width, 0) + 1, 0)
    starts, stop = np.cumsum(sizes) - sizes, np.cumsum(counts)
    step = lambda so_far, more, k: _mixed(so_far * _MIX[0] + more * _MIX[1] + np.uint64(k))
    # All windows of the words as they lie, those over the end of a text too; only a text's own are taken.
    every = hashed
    for k in range(1, width):
        every = step(every[:-1], hashed[k:], k)
    at = np.arange(int(counts.sum())) + np.repeat(starts - (stop - counts), counts)
    out = every.take(at, mode="clip") if len(every) else np.zeros(len(at), np.uint64)
    few = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(few):
        whole = hashed[starts[few]]
        for k in range(1, width - 1):
            more = np.flatnonzero(sizes[few] > k)
            whole[more] = step(whole[more], hashed[starts[few][more] + k], k)
        out[stop[few] - 1] = _mixed(whole + sizes[few].astype(np.uint64))
    for b, n in zip(stop.tolist(), counts.tolist(), strict=True):
        out[b - n : b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[(stop - counts)[counts > 0]] = True
    so_far = np.concatenate(([0], np.cumsum(fresh)))
    return out[fresh], so_far[stop] - so_far[stop - counts]


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = rng.integers(0, 1 << 63, size=(2, n), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def signatures(shingles: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row for each set of the given sizes, none empty: minima of all permutations, then maxima."""
    out = np.empty((len(sizes), 2 * len(a)), np.uint64)
    # A few sets at a time, so that all permutations of them stay in the processor's cache.
    stop, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        begin = int(stop[lo] - sizes[lo])
        hi = max(lo + 1, int(np.searchsorted(stop, begin + CACHED, side="right")))
        some, cuts = shingles[begin : stop[hi - 1]], stop[lo:hi] - sizes[lo:hi] - begin
        v, w = np.empty_like(some), np.empty_like(some)
        for k in range(len(a)):
            np.multiply(some, a[k], out=v)
            v += b[k]
            np.right_shift(v, np.uint64(32), out=w)
            v ^= w
            out[lo:hi, k], out[lo:hi, len(a) + k] = np.minimum.reduceat(v, cuts), np.maximum.reduceat(v, cuts)
        lo = hi
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A row of bucket names for each signature."""
    bands = sig[:, : sig.shape[1] // rows * rows].reshape(len(sig), sig.shape[1] // rows, rows)
    key = np.arange(bands.shape[1], dtype=np.uint64) * _MIX[1]
    for k in range(rows):
        key = _mixed(key * _MIX[0] + bands[:, :, k])
    return key.view(np.int64)


def fingerprints(docs: DataFrame, width: int, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n, s1, s2, bands``: size and 128-bit mark of the shingle set, and the band keys."""
    prepare(docs.sparkSession)
    a, b = _permutations(permutations)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in text_chunks(batches, 1, CHUNK_BYTES):
            shingles, n = shingle_hashes(some.column(1), width)
            stop = np.cumsum(n)
            marks = [xxhash.xxh3_128_intdigest(shingles[e - k : e].tobytes()) for e, k in zip(stop.tolist(), n.tolist(), strict=True)]
            s1, s2 = [(m >> 64) - (1 << 63) for m in marks], [(m & ((1 << 64) - 1)) - (1 << 63) for m in marks]
            keys = band_keys(signatures(shingles, n[n > 0], a, b), rows)
            bounds = np.concatenate(([0], np.cumsum((n > 0) * keys.shape[1])))
            bands = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), bands], ["doc_id", "n", "s1", "s2", "bands"])

    rows_ = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows_.mapInArrow(make, "doc_id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>")


def _similar(percent: int):
    """Of two shingle sets as bytes: is their Jaccard similarity at least ``percent`` hundredths?"""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if len(u) > len(v):
                u, v = v, u
            at = np.searchsorted(v, u)
            at[at == len(v)] = 0
            both = int((v[at] == u).sum())
            out.append(100 * both >= percent * (len(u) + len(v) - both))
        return pd.Series(out, dtype=bool)

    return similar


def _sets(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``doc_id, shingles`` for the ids, each set once as sorted 64-bit hashes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in text_chunks(batches, 1, CHUNK_BYTES):
            shingles, n = shingle_hashes(some.column(1), width)
            raw = [x.tobytes() for x in np.split(shingles, np.cumsum(n)[:-1])] if len(n) else []
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(raw, pa.binary())], ["doc_id", "shingles"])

    # Always by a shuffle, so that the plan is the same at every size.
    return texts.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(make, "doc_id bigint, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (id1, id2) whose full sets are similar; only sets that take part are shuffled."""
    ids = pairs.select(F.col("id1").alias("doc_id")).union(pairs.select(F.col("id2"))).distinct()
    known = sets.join(ids, "doc_id", "left_semi")
    first = known.select(F.col("doc_id").alias("id1"), F.col("shingles").alias("x"))
    second = known.select(F.col("doc_id").alias("id2"), F.col("shingles").alias("y"))
    return pairs.join(first, "id1").join(second, "id2").where(_similar(percent)("x", "y")).select("id1", "id2")


def _differences():
    """Of two shingle sets as bytes: the hashes in one of them only, sorted."""

    @F.pandas_udf("binary")
    def difference(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([np.setxor1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True).tobytes() for p, q in zip(x, y, strict=True)], dtype=object)

    return difference


def _among_members(stars: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (id1, id2) between members of one leader that the leader's own links leave in different components.

    One of two such members is in another component than the leader.  These are held against all members in blocks: a task takes a piece of
    the leader's members and a piece of those outside, as differences from the leader's set, which give the exact
    intersection and union of any two.  Only links leave the task.
    """
    lead = found.select(F.col("node").alias("lead"), F.col("component").alias("lead_comp"))
    rep = found.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    placed = stars.join(lead, "lead", "left").join(rep, "rep", "left").select("lead", "rep", "n", F.coalesce("comp", "rep").alias("comp"), F.coalesce("lead_comp", "lead").alias("lead_comp"))
    placed = stored(placed.withColumn("out", F.col("comp") != F.col("lead_comp")), "placed")
    # The leader of one member, or of members that all follow it, has nothing left to check.
    sizes = placed.groupBy("lead").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("out").cast("int")).alias("outs")).where("size > 1 and outs > 0")
    sizes = stored(sizes.select("lead", F.ceil(F.col("size") / BLOCK_MEMBERS).cast("int").alias("m"), F.ceil(F.col("outs") / BLOCK_OUTSIDE).cast("int").alias("o")), "sizes")
    rows = placed.join(sizes, "lead").select("lead", "rep", "n", "comp", "out", "m", "o")
    first = sets.select(F.col("doc_id").alias("lead"), F.col("shingles").alias("x"))
    second = sets.select(F.col("doc_id").alias("rep"), F.col("shingles").alias("y"))
    rows = stored(rows.join(first, "lead").join(second, "rep").withColumn("d", _differences()("x", "y")).drop("x", "y"), "differences")
    piece = lambda k: F.pmod(F.xxhash64("rep"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    keep = ["lead", "a", "b", "rep", "n", "comp", "d"]
    members = rows.withColumn("a", piece("m")).withColumn("b", every("o")).select(*keep)
    outside = rows.where("out").withColumn("b", piece("o")).withColumn("a", every("m")).select(*keep)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got: list[tuple[int, int]] = []
        if len(left) and len(right):
            parts = [np.frombuffer(d, np.uint64) for d in left["d"]]
            width, reps, comps, n = np.array([len(p) for p in parts]), left["rep"].to_numpy(), left["comp"].to_numpy(), left["n"].to_numpy()
            flat, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), width)
            for r, c, k, d in zip(right["rep"], right["comp"], right["n"], right["d"], strict=True):
                mine = np.frombuffer(d, np.uint64)
                at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                both = np.bincount(owner[mine[at] == flat], minlength=len(parts))
                apart = len(mine) + width - 2 * both
                union = (n + k + apart) // 2
                for x in reps[(100 * (union - apart) >= percent * union) & (comps != c)].tolist():
                    got.append((min(r, x), max(r, x)))
        return pd.DataFrame(got, columns=["id1", "id2"], dtype="int64")

    keys = ["lead", "a", "b"]
    return members.groupBy(*keys).cogroup(outside.groupBy(*keys)).applyInPandas(meet, "id1 bigint, id2 bigint").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Links join documents whose sets have 100 * intersection >= percent * union; a component is
    named by its smallest doc_id, which alone is kept.  A text without words (null, empty, blanks)
    links with nothing.  Rows sharing a doc_id are one document if their sets are equal; otherwise each
    row's set may link and all of them are joined.  A row without a doc_id gets component_id null and is kept.
    An empty table gives no rows; texts of any length count with all their shingles; other columns, whatever their names, are not read.
    """
    prepare(docs.sparkSession)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    prints = stored(fingerprints(docs, width, permutations, rows), "fingerprints")
    some = prints.where("n > 0 and doc_id is not null")
    # One representative for equal sets; a map-side minimum, so thousands of copies meet as a few rows.
    reps = stored(some.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("s1", "s2", "n", F.col("r.doc_id").alias("rep"), F.col("r.bands").alias("bands")), "representatives")
    cells = reps.select("rep", "n", F.explode("bands").alias("cell"))
    buckets = cells.groupBy("cell").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = stored(buckets.select("cell", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_n")), "buckets")
    stars = stored(cells.join(buckets, "cell").where("rep <> lead").select("lead", "rep", "lead_n", "n").distinct(), "stars")
    ids = stars.select(F.col("lead").alias("doc_id")).union(stars.select("rep")).distinct()
    sets = stored(_sets(texts, ids, width), "shingles")
    close = F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent
    links = stored(_confirmed(stars.where(close).select(F.col("lead").alias("id1"), F.col("rep").alias("id2")), sets, percent), "links")
    links = links.union(stored(_among_members(stars, components(links), sets, percent), "more"))
    # Documents with equal sets are linked without a check.
    same = some.join(reps.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).where("doc_id <> rep").select(F.col("rep").alias("id1"), F.col("doc_id").alias("id2"))
    joined = links.union(same)
    final = components(joined)
    out = prints.join(final, prints["doc_id"] == final["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))
