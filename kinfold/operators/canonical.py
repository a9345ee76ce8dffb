"""Pairs whatever way round they are given.

Kinship, segments and parent-offspring rows name a pair's two people in any order.  At the boundary they become canonical pairs, the smaller id
first, and what belongs to one side (haplotypes, h-scores) goes with its id; ``as_given`` turns results back into the caller's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ("id1", "id2")
#: Columns that belong to the first and to the second person of a pair.
SIDES = (PAIR, ("id1_haplotype", "id2_haplotype"), ("h1", "h2"), ("fid1", "fid2"))


def turned(df: DataFrame, when: Column, sides=SIDES) -> DataFrame:
    """``df`` with the two columns of each side exchanged in the rows that ``when`` holds for."""
    there = [(a, b) for a, b in sides if a in df.columns and b in df.columns]
    return df.withColumns({c: F.when(when, F.col(o)).otherwise(F.col(c)) for a, b in there for c, o in ((a, b), (b, a))})


def canonical_pairs(df: DataFrame, a: str = "id1", b: str = "id2", sides=SIDES) -> DataFrame:
    """P5: a <= b; haplotypes and scores go with their ids.  Rows with a null id stay as they are."""
    return turned(df, F.col(a) > F.col(b), ((a, b), *(s for s in sides if s != (a, b))))


def one_a_pair(pairs: DataFrame, best: str | None = None) -> DataFrame:
    """Canonical pairs with one row each: of several, the same pair given both ways included, the one with the largest ``best`` and then the largest values."""
    rest = [c for c in pairs.columns if c not in PAIR]
    first = [best] if best in rest else []
    order = F.struct(*first, *(c for c in rest if c not in first)) if rest else F.lit(1)
    rows = canonical_pairs(pairs).groupBy(*PAIR).agg(F.max(order).alias("__row"))
    return rows.select(*PAIR, *(F.col(f"__row.{c}").alias(c) for c in rest)) if rest else rows.select(*PAIR)


def match(df: DataFrame, pairs: DataFrame, how: str, a: str = "id1", b: str = "id2") -> DataFrame:
    """``df`` joined with ``pairs`` (id1, id2 and others) on the pair (a, b) in either order; ``how`` as in a join, ids of ``pairs`` left out."""
    side = canonical_pairs(pairs).withColumnsRenamed({"id1": "__k1", "id2": "__k2"})
    return df.join(side, (F.least(a, b) == F.col("__k1")) & (F.greatest(a, b) == F.col("__k2")), how).drop("__k1", "__k2")


def as_given(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of canonical pairs in the order that ``asked`` gives each pair; those given both ways or not at all stay canonical."""
    back = canonical_pairs(asked.select(*PAIR, (F.col("id1") > F.col("id2")).alias("__back"))).groupBy(*PAIR).agg(F.min("__back").alias("__back"))
    out = rows.join(back, list(PAIR), "left").select(*rows.columns, "__back")
    return turned(out, F.coalesce("__back", F.lit(False))).select(*rows.columns)
