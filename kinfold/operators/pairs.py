"""Selections, lookups and aggregates over people and pairs (P, J, A1, G13 to G15, N7, O)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.canonical import match, one_a_pair

#: Degrees from the most distant to the closest.
DEGREES = ("5th", "4th", "3rd", "2nd", "FS", "PO")


def with_attr(df: DataFrame, attrs: DataFrame, on: str | list[str], default: dict | None = None) -> DataFrame:
    """Left join of attributes, with defaults where there is none."""
    out = df.join(attrs, on, "left")
    return out.fillna(default) if default else out


def people(fam: DataFrame, populations: DataFrame | None = None, ages: DataFrame | None = None, default: str = "pop1") -> DataFrame:
    """Fam with "0" parents as null and the optional population and age of each person; people absent from the populations have the default one."""
    clean = lambda c: F.when(F.col(c).cast("string") == "0", None).otherwise(F.col(c)).alias(c) if c in ("father", "mother") else F.col(c)
    out = fam.select(*map(clean, fam.columns))
    out = with_attr(out, populations, "iid", {"popl": default}) if populations is not None else out.withColumn("popl", F.lit(default))
    return with_attr(out, ages, "iid") if ages is not None else out.withColumn("age", F.lit(None).cast("double"))


def children(fam: DataFrame) -> DataFrame:
    """A1: ``parent, children`` sorted."""
    edges = fam.select(F.inline(F.array(F.struct(F.col("father").alias("parent"), F.col("iid").alias("child")), F.struct(F.col("mother").alias("parent"), F.col("iid").alias("child")))))
    return edges.where("parent is not null").groupBy("parent").agg(F.sort_array(F.collect_set("child")).alias("children"))


def twins(king: DataFrame) -> DataFrame:
    """Second members of Dup/MZ pairs, second as the rows name them."""
    return king.where("inftype = 'Dup/MZ'").select(F.col("id2").alias("iid")).distinct()


def exclude_twins(persons: DataFrame, king: DataFrame) -> DataFrame:
    """People without the second member of each Dup/MZ pair."""
    return persons.join(twins(king), "iid", "left_anti")


def population_subset(pairs: DataFrame, persons: DataFrame, popl: str) -> DataFrame:
    """Pairs with both members in the population."""
    ids = persons.where(F.col("popl") == popl).select("iid").distinct()
    return keep_members(pairs, ids)


def keep_members(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs with both members among ``ids`` (iid)."""
    out = pairs.join(ids.select(F.col("iid").alias("id1")), "id1", "left_semi")
    return out.join(ids.select(F.col("iid").alias("id2")), "id2", "left_semi").select(*pairs.columns)


def select_where(df: DataFrame, cond: Column | str, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows that meet a condition, with chosen columns."""
    return df.where(cond).select(*(cols or df.columns))


def keep_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the given pairs, in whatever order either table names them; no pairs keep nothing."""
    return match(df, pairs.select("id1", "id2"), "left_semi")


def drop_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    return match(df, pairs.select("id1", "id2"), "left_anti")


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P10: rows with a number in each of the columns; NaN is not one."""
    return df.where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in cols))


def kinship(ibd1: str = "ibd1seg", ibd2: str = "ibd2seg") -> Column:
    """ibd2 + ibd1 / 2."""
    return F.col(ibd2) + F.col(ibd1) / 2


def coverage(ibd1: str = "ibd1seg", ibd2: str = "ibd2seg") -> Column:
    return F.col(ibd1) + F.col(ibd2)


def lookup_pairs(df: DataFrame, king: DataFrame, defaults: dict, a: str = "id1", b: str = "id2") -> DataFrame:
    """Values of pairs (a, b) from a table of pairs, both in any order, defaults where absent; a pair given twice counts once."""
    out = match(df, one_a_pair(king.select("id1", "id2", *defaults)), "left", a, b)
    return out.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in defaults.items()})


def related_edges(king: DataFrame, cond: Column | str = "propibd > 0.1 or ibd2seg > 0.03") -> DataFrame:
    """Pairs that count as related, each once."""
    return one_a_pair(king.where(cond).select("id1", "id2"))


def drop_exact_twins(ids: DataFrame, king: DataFrame) -> DataFrame:
    """Ids without the larger one, as text, of every pair with kinship exactly 1."""
    gone = king.where(kinship() == 1).select(F.when(F.col("id1").cast("string") > F.col("id2").cast("string"), F.col("id1")).otherwise(F.col("id2")).alias("iid")).distinct()
    return ids.join(gone, "iid", "left_anti")


def max_kinship(ids: DataFrame, king: DataFrame) -> DataFrame:
    """The largest kinship inside the set, 0 where no pair of it has any."""
    return keep_members(king, ids).agg(F.coalesce(F.max(kinship()), F.lit(0.0)).alias("max_kinship"))


def drop_related_families(founders: DataFrame, king: DataFrame, max_k: float) -> DataFrame:
    """Rows of ``founders`` (fid, iid) of families whose founders' kinship never exceeds ``max_k``."""
    a, b = founders.select("fid", F.col("iid").alias("id1")), founders.select("fid", F.col("iid").alias("id2"))
    close = king.where(F.col("propibd") > max_k).join(a, "id1").join(b, ["id2", "fid"]).select("fid").distinct()
    return founders.join(close, "fid", "left_anti")


def admit_training_pairs(members: DataFrame, max_couple_k: float, max_inlaw_k: float) -> DataFrame:
    """M9: ``pair`` of (pair, rel, k) rows whose couples and in-laws all stay within their limits."""
    over = members.where(((F.col("rel") == "couple") & (F.col("k") > max_couple_k)) | ((F.col("rel") == "inlaws") & (F.col("k") > max_inlaw_k))).select("pair").distinct()
    return members.select("pair").distinct().join(over, "pair", "left_anti")


def class_moments(pairs: DataFrame, label: str, value: str) -> DataFrame:
    """Mean and sample SD of a value by class."""
    return pairs.groupBy(label).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def within_class_sd(pairs: DataFrame, label: str = "degree", value: str = "ibd1", sd: float = 2.0) -> DataFrame:
    """Rows less than ``sd`` sample SD from their class mean; a class of one row has no SD and is dropped."""
    moments = F.broadcast(class_moments(pairs, label, value).select(F.col(label).alias("__class"), "mean", "sd"))  # one row a degree
    out = pairs.join(moments, pairs[label] == F.col("__class"))
    return out.where(F.abs(F.col(value) - F.col("mean")) < sd * F.col("sd")).select(*pairs.columns)


def fifth_degree_cut(pairs: DataFrame, sd: float = 2.0) -> DataFrame:
    """``cut``, the mean less ``sd`` sample SD of the fourth degree's pihat."""
    return pairs.where("degree = '4th'").agg((F.avg("pihat") - sd * F.stddev_samp("pihat")).alias("cut"))


def fullsib_cut(king: DataFrame, po: DataFrame, min_strength: float = 15.0, default: float = 0.18) -> DataFrame:
    """``cut``, mean less 1.5 population SD of ibd2 over full-sib pairs that both have two locked parents."""
    sure = po.where(F.col("strength") > min_strength).groupBy("child").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select(F.col("child").alias("iid"))
    pairs = keep_members(king.where("inftype = 'FS'"), sure)
    return pairs.agg(F.coalesce(F.avg("ibd2seg") - 1.5 * F.stddev_pop("ibd2seg"), F.lit(default)).alias("cut"))


def coparent_check(fam: DataFrame, king: DataFrame) -> DataFrame:
    """Children whose parents are 2nd degree, full siblings or parent and child."""
    both = fam.where("father is not null and mother is not null").select("iid", "father", "mother")
    return lookup_pairs(both, king, {"inftype": "UN"}, "father", "mother").where(F.col("inftype").isin("2nd", "FS", "PO"))


def unrelated_counts(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``iid, n_unrelated``: all others less the related partners; no pair of ids is ever formed."""
    inside = one_a_pair(keep_members(edges.select("id1", "id2"), ids).where("id1 <> id2"))
    degree = inside.select(F.explode(F.array("id1", "id2")).alias("iid")).groupBy("iid").agg(F.count(F.lit(1)).alias("k"))
    others = ids.agg((F.count(F.lit(1)) - 1).alias("others")).withColumn("one", F.lit(1))  # one row
    return ids.select("iid", F.lit(1).alias("one")).join(degree, "iid", "left").join(F.broadcast(others), "one").select("iid", (F.col("others") - F.coalesce("k", F.lit(0))).alias("n_unrelated"))


def founder_panel(king: DataFrame, persons: DataFrame) -> DataFrame:
    """Per population the people with a 4th degree or closer relative in it, and their share over all populations."""
    popl = persons.select("iid", "popl")
    close = king.where(F.col("inftype").isin("4th", "3rd", "2nd", "PO", "FS"))
    a = close.join(popl.select(F.col("iid").alias("id1"), F.col("popl").alias("p1")), "id1").join(popl.select(F.col("iid").alias("id2"), F.col("popl").alias("p2")), "id2").where("p1 = p2")
    counts = a.select("p1", F.explode(F.array("id1", "id2")).alias("iid")).distinct().groupBy("p1").agg(F.count(F.lit(1)).alias("n_close"))
    total = counts.agg(F.sum("n_close").alias("total")).withColumn("one", F.lit(1))  # one row
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select(F.col("p1").alias("popl"), "n_close", (F.col("n_close") / F.col("total")).alias("share"))


def founder_plan(panel: DataFrame, unrelated: DataFrame, n_pairs: int) -> DataFrame:
    """Families per round and rounds needed, from the share of a population and its number of unrelated people (popl, n_unrelated)."""
    out = panel.join(unrelated, "popl").withColumns({"n_samples": F.floor(F.lit(n_pairs) * F.col("share")), "per_gp": F.floor(F.col("n_unrelated") / 4), "per_other": F.floor(F.col("n_unrelated") / 5)})
    rounds = lambda c: F.ceil(F.try_divide(F.col("n_samples"), F.col(c)))
    return out.select("popl", "n_samples", "per_gp", "per_other", rounds("per_gp").alias("gp_rounds"), rounds("per_other").alias("other_rounds"))


def fill_missing_alleles(lines: DataFrame, column: str = "line") -> DataFrame:
    """Missing alleles of phased genotypes take the other allele, 0 where both are missing; lines with '#' stay."""
    text = F.col(column)
    for old, new in ((".|.", "0|0"), (".|0", "0|0"), ("0|.", "0|0"), (".|1", "1|1"), ("1|.", "1|1")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return lines.withColumn(column, F.when(F.col(column).contains("#"), F.col(column)).otherwise(text))


def label_by_template(segments: DataFrame, template: DataFrame, popl: str, sim: str) -> DataFrame:
    """Segments whose ids carry a template's suffixes (suffix1, suffix2, relative) within one simulated family.

    Ids read family_roundNN_..._suffix; the round's digits must agree.  Ids become relative, 1 or 2, population, round and simulation.
    """
    # No lists of parts: each of these is worked out for the filter, the join and the result.
    last = lambda c: F.substring_index(c, "_", -1)
    turn = lambda c: F.regexp_replace(F.substring_index(F.substring_index(c, "_", 2), "_", -1), "[^0-9]", "")
    rows = segments.withColumns({"suffix1": last("id1"), "suffix2": last("id2"), "round1": turn("id1"), "round2": turn("id2")}).where("round1 = round2")
    named = rows.join(F.broadcast(template), ["suffix1", "suffix2"])  # a fixed table of a few rows
    name = lambda n: F.concat("relative", F.lit(f"{n}_{popl}_i"), F.col("round1"), F.lit(f"_sim{sim}"))
    return named.withColumns({"id1": name(1), "id2": name(2), "pop": F.lit(popl)}).drop("suffix1", "suffix2", "round1", "round2")
