"""Statistics of shared segments per pair.

Segments: id1, id2, chromosome, id1_haplotype, id2_haplotype, start_cm, end_cm.  Slots 1 and 2 are the
haplotypes 0 and 1 of id1, slots 3 and 4 those of id2.  A pair's segments name it in one order (``canonical_pairs``).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from kinfold.operators.canonical import PAIR, match
from kinfold.operators.canonical import canonical_pairs as canonical_pairs

CHROM = (*PAIR, "chromosome")
MIN_PROPIBD = 2.0**-3.5
MIN_PIECE_CM = 2.5
LONGEST_CM = 300.0
SWITCHES = ArrayType(StructType([StructField("at", DoubleType()), StructField("side", IntegerType())]))


def pair_id(a: str = "id1", b: str = "id2") -> Column:
    """The pair's name: smaller id, underscore, larger id."""
    return F.concat_ws("_", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def segment_length(segments: DataFrame, min_cm: float | None = None) -> DataFrame:
    """Adds ``l``; with ``min_cm`` keeps segments of at least that length."""
    out = segments.withColumn("l", F.col("end_cm") - F.col("start_cm"))
    return out if min_cm is None else out.where(F.col("l") >= min_cm)


def close_pair_segments(segments: DataFrame, king: DataFrame, min_k: float = MIN_PROPIBD) -> DataFrame:
    """Segments of pairs with at least that kinship, in whatever order either table names a pair; a pair without a kinship row has 0.

    The filter stands before every window, where it prunes both sides of one equi-join.
    """
    return match(segments, king.where(F.col("propibd") >= min_k).select(*PAIR), "left_semi") if min_k > 0 else segments


def ibd_regions(segments: DataFrame) -> DataFrame:
    """G1: elementary regions between any two segment ends, with the cover count c1..c4 of each slot.

    One sweep: +1 and -1 events are combined per position, running sums give the cover and the
    next position ends the region.  Segments without length add nothing.
    """
    slots = [(F.col(f"{i}_haplotype") == h).cast("int") for i in PAIR for h in (0, 1)]
    event = lambda at, sign: F.struct(F.col(at).alias("pos"), *[(s * sign).alias(f"d{k}") for k, s in enumerate(slots, 1)])
    events = segments.where("end_cm > start_cm").select(*CHROM, F.inline(F.array(event("start_cm", 1), event("end_cm", -1))))
    ends = events.groupBy(*CHROM, "pos").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(1, 5)])
    at = Window.partitionBy(*CHROM).orderBy("pos")
    covered = [F.sum(f"d{k}").over(at.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias(f"c{k}") for k in range(1, 5)]
    regions = ends.select(*CHROM, F.col("pos").alias("start_cm"), F.lead("pos").over(at).alias("end_cm"), *covered)
    return regions.where("end_cm is not null and c1 + c2 > 0")


def _length() -> Column:
    return F.col("end_cm") - F.col("start_cm")


def _is_ibd2() -> Column:
    return (F.col("c1") > 0) & (F.col("c2") > 0) & (F.col("c3") > 0) & (F.col("c4") > 0)


def ibd1_ibd2(regions: DataFrame) -> DataFrame:
    """cM and number of regions by kind; a region is IBD2 when all four slots are covered."""
    two = _is_ibd2()
    one = lambda cond, what: F.coalesce(F.sum(F.when(cond, what)), F.lit(0))
    return regions.groupBy(*PAIR).agg(one(~two, _length()).alias("ibd1_cm"), one(two, _length()).alias("ibd2_cm"), one(~two, F.lit(1)).alias("n_ibd1"), one(two, F.lit(1)).alias("n_ibd2"))


def islands(segments: DataFrame, max_gap: float = 1.0) -> DataFrame:
    """Segments joined where less than ``max_gap`` apart, as one row each with its span."""
    order = Window.partitionBy(*CHROM).orderBy("start_cm", "end_cm")
    before = F.max("end_cm").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = segments.withColumn("new", (before.isNull() | (F.col("start_cm") - before >= max_gap)).cast("int"))
    numbered = fresh.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*CHROM, "island").agg(F.min("start_cm").alias("start_cm"), F.max("end_cm").alias("end_cm"))


def segment_count(segments: DataFrame, max_gap: float = 1.0) -> DataFrame:
    """Number of islands over all chromosomes."""
    return islands(segments, max_gap).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))


def _folded(h: Column) -> Column:
    return F.when(h > 0.5, h).otherwise(1 - h)


def _depth_one() -> Column:
    return F.expr("c1 + c2 + c3 + c4 = 2")


def _side(a: str, b: str) -> list[Column]:
    return [F.sum(F.when(_depth_one() & (F.col(c) > 0), _length()).otherwise(0.0)).alias(c) for c in (a, b)]


def _h(inter_phase: bool, a: str, b: str) -> Column:
    taken = F.col(a) if inter_phase else F.greatest(a, b)
    return F.sum(taken)


def h_score(regions: DataFrame, inter_phase: bool = False, folded: bool = True) -> DataFrame:
    """h1 and h2 per pair from regions of depth 1.

    Per chromosome the larger haplotype total (with ``inter_phase`` haplotype 0), summed and divided by all such cM; no such region gives 0 before folding.
    """
    per = regions.groupBy(*CHROM).agg(*_side("c1", "c2"), *_side("c3", "c4"))
    sums = per.groupBy(*PAIR).agg(_h(inter_phase, "c1", "c2").alias("t1"), _h(inter_phase, "c3", "c4").alias("t2"), F.sum(F.col("c1") + F.col("c2")).alias("total"))
    score = lambda t: F.coalesce(F.try_divide(t, "total"), F.lit(0.0))
    fold = _folded if folded else lambda h: h
    return sums.select(*PAIR, fold(score("t1")).alias("h1"), fold(score("t2")).alias("h2"))


def pair_stats(segments: DataFrame, genome_cm: float, inter_phase: bool = False, max_gap: float = 1.0) -> DataFrame:
    """ibd1 and ibd2 as shares of the genome, region and island counts and h-scores.

    One sweep feeds all region statistics: a partial sum per chromosome, which needs no further shuffle, then one per pair.  Sweep and islands share one shuffle of the segments.
    """
    two, segments = _is_ibd2(), segments.repartition(*CHROM)
    per = ibd_regions(segments).groupBy(*CHROM).agg(
        F.sum(F.when(~two, _length()).otherwise(0.0)).alias("l1"), F.sum(F.when(two, _length()).otherwise(0.0)).alias("l2"), F.sum(F.when(two, 0).otherwise(1)).alias("m1"), F.sum(F.when(two, 1).otherwise(0)).alias("m2"), *_side("c1", "c2"), *_side("c3", "c4")
    )
    count = islands(segments, max_gap).groupBy(*CHROM).agg(F.count(F.lit(1)).alias("k"))
    both = count.join(per, list(CHROM), "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = both.groupBy(*PAIR).agg(
        (zero("l1") / F.lit(genome_cm)).alias("ibd1"), (zero("l2") / F.lit(genome_cm)).alias("ibd2"), zero("m1").alias("n_ibd1"), zero("m2").alias("n_ibd2"), F.sum("k").alias("n"), _h(inter_phase, "c1", "c2").alias("t1"), _h(inter_phase, "c3", "c4").alias("t2"), F.sum(F.col("c1") + F.col("c2")).alias("total")
    )
    score = lambda t: _folded(F.coalesce(F.try_divide(t, "total"), F.lit(0.0)))
    return sums.select(*PAIR, "ibd1", "ibd2", "n_ibd1", "n_ibd2", "n", score("t1").alias("h1"), score("t2").alias("h2"))


def site_kinship(segments: DataFrame) -> DataFrame:
    """Whole-cM sites per pair covered by all four slots (IBD2) or fewer (IBD1).

    Sites are counted, not made: a segment covers those from its start rounded up to its end rounded down, both included, so on whole numbers it is the region
    from the one to one after the other, and a region between two events holds as many sites as it is long.
    """
    whole = segments.withColumns({"start_cm": F.ceil("start_cm").cast("bigint"), "end_cm": F.floor("end_cm").cast("bigint") + 1})
    two = _is_ibd2()
    sites = lambda kind: F.sum(F.when(kind, _length()).otherwise(0))
    return ibd_regions(whole).groupBy(*PAIR).agg(sites(~two).alias("ibd1_sites"), sites(two).alias("ibd2_sites"))


def pair_coverage(segments: DataFrame, max_gap: float = 1.0) -> DataFrame:
    """Islands, cM they span, cM of all segments, and per person the larger haplotype's cM summed over chromosomes."""
    joined = islands(segments, max_gap).groupBy(*CHROM).agg(F.count(F.lit(1)).alias("k"), F.sum(_length()).alias("span"))
    part = lambda c, h: F.sum(F.when(F.col(c) == h, _length()).otherwise(0.0))
    raw = segments.groupBy(*CHROM).agg(F.sum(_length()).alias("all"), F.greatest(part("id1_haplotype", 0), part("id1_haplotype", 1)).alias("b1"), F.greatest(part("id2_haplotype", 0), part("id2_haplotype", 1)).alias("b2"))
    return joined.join(raw, list(CHROM)).groupBy(*PAIR).agg(F.sum("k").alias("n_segs"), F.sum("span").alias("tot_cov"), F.sum("all").alias("tot_all"), F.sum("b1").alias("hap1"), F.sum("b2").alias("hap2"))


def switch_arrays(chromosomes: DataFrame, mean_d: float = 50.0, seed: int = 0) -> DataFrame:
    """``sw`` per (pair, chromosome), the switches of both sides in order as (at, side): running sums of exponential gaps up to the first beyond ``LONGEST_CM``.

    Gap i of a side comes from 52 bits of md5 of seed, pair, chromosome, side and i, the same on every run and partitioning; a batch draws the next gap of all its sides that aren't at the end yet.
    """
    if not mean_d > 0:
        raise ValueError("mean_d must be positive")
    longest = LONGEST_CM

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            n = some.num_rows
            begin = [f"{key}:{side}:" for side in (0, 1) for key in some.column(3).to_pylist()]
            left, last, found, i = np.arange(2 * n), np.zeros(2 * n), [], 0
            while len(left):
                i += 1
                marks = b"".join([md5(f"{begin[k]}{i}".encode(), usedforsecurity=False).digest() for k in left.tolist()])
                # The first 52 of 128 bits.
                u = (np.frombuffer(marks, ">u8")[::2] >> np.uint64(12)).astype(np.float64) / 16.0**13
                last[left] += -np.log(1 - u) * mean_d
                found.append((left, last[left]))
                left = left[last[left] < longest]
            side, row = np.divmod(np.concatenate([k for k, _ in found] or [left]), max(n, 1))
            at = np.concatenate([x for _, x in found] or [last])
            order = np.lexsort((side, at, row))
            bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))
            points = pa.StructArray.from_arrays([pa.array(at[order]), pa.array(side[order], pa.int32())], ["at", "side"])
            yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), points)], [*CHROM, "sw"])

    # Few bytes but much work: a fixed number of partitions, which adaptive execution doesn't put together.
    parts = int(chromosomes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = chromosomes.select(*CHROM)
    keyed = of.repartition(parts, *CHROM).distinct().withColumn("key", F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in CHROM)))
    return keyed.mapInArrow(draw, StructType([*of.schema.fields, StructField("sw", SWITCHES)]))


def draw_switches(chromosomes: DataFrame, mean_d: float = 50.0, seed: int = 0) -> DataFrame:
    """``side, switch_cm`` per (pair, chromosome), the switches of ``switch_arrays`` as rows."""
    return switch_arrays(chromosomes, mean_d, seed).select(*CHROM, F.inline_outer("sw")).select(*CHROM, "side", F.col("at").alias("switch_cm"))


def phase_error_split(segments: DataFrame, switches: DataFrame, min_cm: float = MIN_PIECE_CM) -> DataFrame:
    """Segments cut at the switches inside them, haplotypes flipped after an odd number of earlier switches.

    Cuts per segment are its start and every switch in [start, end]; the next cut, or the end, closes a piece, and a piece counts the switches before it
    on each side.  Pieces shorter than ``min_cm`` are dropped.  A (pair, chromosome)'s switches, some ``LONGEST_CM`` over their mean distance, are one sorted
    array (as ``switch_arrays`` gives it; rows of ``draw_switches`` are gathered) that joins its segments once, so a segment never meets them as rows.
    """
    point = F.struct(F.col("switch_cm").cast("double").alias("at"), F.col("side").cast("int").alias("side"))
    of = switches if "sw" in switches.columns else switches.groupBy(*CHROM).agg(F.sort_array(F.collect_list(point)).alias("sw"))
    out = segments.select(*CHROM, "id1_haplotype", "id2_haplotype", F.col("start_cm").cast("double"), F.col("end_cm").cast("double")).where("start_cm is not null and end_cm is not null")
    fields = [*out.schema.fields, *(StructField(n, LongType()) for n in ("n1", "n2"))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            n, lists = some.num_rows, some.column(7)
            start, end = (some.column(k).to_numpy() for k in (5, 6))
            # NaN is larger than any number.
            lo, hi = (np.where(np.isnan(x), np.inf, x) for x in (start, end))
            points, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            at, side = points.field(0).to_numpy(zero_copy_only=False), points.field(1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), sizes)
            early, inside = at < lo[row], np.flatnonzero((at >= lo[row]) & (at <= hi[row]))
            # Piece 0 of a segment begins at its start, piece k at the k-th switch inside.
            more = np.bincount(row[inside], minlength=n)
            first = np.arange(n) + np.cumsum(more) - more
            owner, begin = np.repeat(np.arange(n), more + 1), np.empty(n + len(inside))
            later = np.ones(len(begin), bool)
            later[first] = False
            begin[first], begin[later] = start, at[inside]
            until = np.append(begin[1:], 0.0)
            until[first + more] = end
            long = until - begin
            keep = np.flatnonzero((long >= min_cm) | np.isnan(long))
            counts = []
            for s in (0, 1):
                passed = np.zeros(len(begin), np.int64)
                passed[later] = side[inside] == s
                passed = np.cumsum(passed)
                counts.append((passed - passed[first][owner] + np.bincount(row[early & (side == s)], minlength=n)[owner])[keep])
            same = some.take(pa.array(owner[keep])).columns[:5]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(x) for x in (begin[keep], until[keep], *counts))], [f.name for f in fields])

    kept = out.join(of, list(CHROM), "left").mapInArrow(cut, StructType(fields))
    flip = lambda h, n: F.when(F.col(n) % 2 == 1, 1 - F.col(h)).otherwise(F.col(h)).alias(h)
    return kept.select(*CHROM, flip("id1_haplotype", "n1"), flip("id2_haplotype", "n2"), "start_cm", "end_cm", "n1", "n2")
