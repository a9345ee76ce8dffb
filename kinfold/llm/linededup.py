"""Repeated lines across documents, found by a range-partitioned sort of line hashes.

Only DataFrame functions run here.  A line's key is two 64-bit hashes; (hashes, document) is
range-partitioned, so one line that a third of all documents hold is spread over many tasks, and
sorted by document and position, so that one pass finds the first line of each document with that
key.  Counts are combined before they meet.  The result is a compressed keep bitmap for each
document: 64-bit words of keep bits, only those with a dropped line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import BLANKS, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def _row() -> Column:
    """Tells apart rows that share a doc_id but not a text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``doc_id, row, keep array<struct<word bigint, bits bigint>>`` for documents that lose lines.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` distinct doc_ids
    keeps its lines in the largest doc_id holding it and loses them elsewhere.  Bit i of word w
    says whether line 64 w + i stays; a word not given is all ones.  Rows sharing a doc_id count
    as one document.  Rows without a doc_id take no part; null and empty texts have no long line.
    An empty table gives no rows; texts of any length are split whole; other columns are not read.
    """
    split = docs.where("doc_id is not null").select("doc_id", _row().alias("row"), F.posexplode(_lines()).alias("pos", "line"))
    trimmed = split.withColumn("key", F.btrim("line", F.lit(BLANKS))).where(F.char_length("key") >= min_chars)
    key = F.translate("key", UPPER, UPPER.lower())
    keyed = trimmed.withColumn("key", key).select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    lines = stored(keyed, "lines")
    ordered = lines.select("h1", "h2", "doc_id", "pos").repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    first = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos"))
    firsts = ordered.withColumn("nth", first).where("nth = 1")
    repeated = firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder")).where(F.col("n") >= min_docs)
    # Stored, so that both sides of the join are plain shuffles and a hot line is split.
    repeated = stored(repeated.select("h1", "h2", "holder"), "repeated")
    dropped = lines.join(repeated, ["h1", "h2"]).where("doc_id <> holder")
    word = dropped.groupBy("doc_id", "row", F.expr("pos div 64").alias("word")).agg(F.expr("~bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return word.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` (the lines that stay, joined by newline).

    A null or empty text is one empty line; texts of any length keep or lose all their lines by the bitmaps; repeated rows are each given, with the same lines; an empty
    table gives no rows.  All other columns stay as they are; columns of these
    three names are replaced.
    """
    marks = bitmaps.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("keep").alias("__keep")).hint("shuffle_hash")
    rows = docs.withColumns({"__text": F.coalesce("text", F.lit("")), "__hash": _row()})
    both = rows.join(marks, (rows["doc_id"] == marks["__id"]) & (rows["__hash"] == marks["__row"]), "left")
    # Each step is a column of its own, so nothing is worked out once per line.
    both = both.withColumn("__lines", F.split("__text", "\n", -1)).withColumn("n_lines", F.size("__lines").cast("bigint"))
    both = both.withColumn("__map", F.map_from_entries("__keep"))
    dense = "transform(sequence(0L, (n_lines - 1) div 64), w -> coalesce(try_element_at(__map, w), -1L))"
    both = both.withColumn("__bits", F.when(F.col("__keep").isNotNull(), F.expr(dense)))
    left = F.expr("filter(__lines, (x, i) -> (shiftright(__bits[i div 64], i % 64) & 1L) = 1L)")
    both = both.withColumn("__left", F.when(F.col("__keep").isNotNull(), left))
    kept = F.when(F.col("__keep").isNull(), F.col("__text")).otherwise(F.concat_ws("\n", "__left"))
    n_dropped = F.when(F.col("__keep").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("__left")).cast("bigint")
    both = both.withColumns({"kept": kept, "n_dropped": n_dropped})
    made = ("n_lines", "n_dropped", "kept")
    return both.select(*[c for c in docs.columns if c not in made], *made)
