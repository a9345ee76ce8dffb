"""Genetic maps: lengths, extents and interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.plans.lineage import stored

DEFAULT_GENOME_CM = 3545.0


def genome_length(gmap: DataFrame | None, default: float = DEFAULT_GENOME_CM) -> float:
    """A2: sum over chromosomes of last minus first cM, knots being in order; ``default`` without a map."""
    if gmap is None:
        return default
    total = chrom_lengths(gmap).agg(F.sum("cm_span")).first()[0]
    return default if total is None else float(total)


def chrom_lengths(gmap: DataFrame) -> DataFrame:
    return gmap.groupBy("chrom").agg((F.max("cm") - F.min("cm")).alias("cm_span"))


def chrom_extents(gmap: DataFrame, unit: str = "cm") -> DataFrame:
    """A3: per chromosome the least and largest position and their distance, in the unit asked for."""
    return gmap.groupBy("chrom").agg(F.min(unit).alias("first"), F.max(unit).alias("last"), (F.max(unit) - F.min(unit)).alias("span"))


def interpolate(sites: DataFrame, gmap: DataFrame) -> DataFrame:
    """``chrom, bp, cm`` for every site, linear between the two nearest knots and constant beyond the ends.

    Knots and sites are range-partitioned together by (chrom, bp), so a chromosome is as many groups as its rows need, and look back and forth for a knot within
    their range; where it holds none, the nearest range that does has its last or first.  Of knots at one place the first in
    cM counts; a chromosome without knots gives null.
    """
    knots = gmap.groupBy("chrom", "bp").agg(F.min("cm").alias("cm")).select("chrom", "bp", "cm", F.lit(0).alias("kind"))
    both = knots.union(sites.select("chrom", "bp", F.lit(None).cast("double"), F.lit(1)))
    both = stored(both.repartitionByRange("chrom", "bp", "kind").withColumn("range", F.spark_partition_id()), "ranges")
    knot = F.when(F.col("kind") == 0, F.struct("bp", "cm"))
    # Both look back, one from each side: a frame that starts at the current row would be read again for every row.
    back, ahead = (F.last(knot, ignorenulls=True).over(Window.partitionBy("chrom", "range").orderBy(at, "kind").rowsBetween(Window.unboundedPreceding, 0)) for at in (F.asc("bp"), F.desc("bp")))
    ends = both.groupBy("chrom", "range").agg(F.min(knot).alias("low"), F.max(knot).alias("high"))
    order = Window.partitionBy("chrom").orderBy("range")
    before = F.last("high", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("low", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    carried = F.broadcast(ends.select("chrom", "range", before.alias("before"), after.alias("after")))  # a row for each range
    placed = both.withColumns({"a": back, "b": ahead}).where("kind = 1").join(carried, ["chrom", "range"])
    placed = placed.withColumns({"a": F.coalesce("a", "before"), "b": F.coalesce("b", "after")})
    slope = F.try_divide(F.col("b.cm") - F.col("a.cm"), (F.col("b.bp") - F.col("a.bp")).cast("double"))
    inside = F.col("a.cm") + (F.col("bp") - F.col("a.bp")) * F.coalesce(slope, F.lit(0.0))
    return placed.select("chrom", "bp", F.coalesce(inside, F.col("a.cm"), F.col("b.cm")).alias("cm"))


def select_sites(markers: DataFrame, sites: DataFrame) -> DataFrame:
    """The map's markers and all sites by (chrom, bp); sites that the map lacks come with snp null."""
    wanted = sites.select("chrom", "bp", F.lit(True).alias("keep")).distinct()
    return markers.select("chrom", "bp", "snp").join(wanted, ["chrom", "bp"], "full_outer").withColumn("keep", F.coalesce("keep", F.lit(False)))
