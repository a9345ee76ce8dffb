"""Paths through a pedigree and the names of relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.pairs import lookup_pairs
from kinfold.plans.lineage import stored

# Relationship codes in file order: name, paths by the parent they start with, sex-specific, degree, parent node.
CODES = (
    ("FS", {1: ["1,-1"], 2: ["1,-1"]}, False, "relatives", None),
    ("PO", {1: ["1"]}, False, "relatives", None),
    ("PHS", {1: ["1,-1"]}, True, "2nd", "HS"),
    ("MHS", {2: ["1,-1"]}, True, "2nd", "HS"),
    ("HS", {1: ["1,-1"]}, False, "2nd", None),
    ("AV", {1: ["1,1,-1", "1,1,-1"]}, False, "2nd", None),
    ("HAV", {1: ["1,1,-1"]}, False, "3rd", None),
    ("GP", {1: ["1,1"]}, False, "2nd", None),
    ("PGP", {1: ["1,1"]}, True, "2nd", "GP"),
    ("MGP", {2: ["1,1"]}, True, "2nd", "GP"),
    ("GGP", {1: ["1,1,1"]}, False, "3rd", None),
    ("DCO", {1: ["1,1,-1,-1", "1,1,-1,-1"], 2: ["1,1,-1,-1", "1,1,-1,-1"]}, False, "3rd+", None),
    ("HSCO", {1: ["1,-1"], 2: ["1,1,-1,-1", "1,1,-1,-1"]}, False, "2nd+", None),
    ("HSHCO", {1: ["1,-1"], 2: ["1,1,-1,-1"]}, False, "2nd+", None),
    ("CO", {1: ["1,1,-1,-1", "1,1,-1,-1"]}, False, "3rd", None),
    ("HCO", {1: ["1,1,-1,-1"]}, False, "4th", None),
    ("DHCO", {1: ["1,1,-1,-1"], 2: ["1,1,-1,-1"]}, False, "4th+", None),
    ("DHAV", {1: ["1,1,-1"], 2: ["1,1,-1"]}, False, "3rd+", None),
    ("COHCO", {1: ["1,1,-1,-1", "1,1,-1,-1"], 2: ["1,1,-1,-1"]}, False, "3rd+", None),
)


def codes_table(spark: SparkSession, codes=CODES) -> DataFrame:
    """``name, sexed, signature, degree, priority``: sex-specific codes first, then file order.

    A signature is the sorted multiset of paths, each with its parent in sex-specific codes.
    """
    rows = []
    for n, (name, paths, sexed, degree, _) in enumerate(codes):
        parts = sorted((f"{sex}:{p}" if sexed else p) for sex, ps in paths.items() for p in ps)
        rows.append((name, sexed, "|".join(parts), degree, n if sexed else len(codes) + n))
    return spark.createDataFrame(rows, "name string, sexed boolean, signature string, degree string, priority int")


def po_edges(fam: DataFrame) -> DataFrame:
    """K0: ``parent, child`` from fam."""
    both = F.inline(F.array(F.struct(F.col("father").alias("parent"), F.col("iid").alias("child")), F.struct(F.col("mother").alias("parent"), F.col("iid").alias("child"))))
    return fam.select(both).where("parent is not null and child is not null").distinct()


def ancestor_lines(po: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``low, top, ids`` of all lines from a person up to an ancestor, through different people, by doubling.

    Lines of 2^k + 1 to 2^(k+1) steps are one of just 2^k steps and one of at most 2^k on top, so each is made once and rounds follow the logarithm of the depth.
    """
    lines = stored(po.select(F.col("child").alias("low"), F.col("parent").alias("top"), F.array("child", "parent").alias("ids")).where("low <> top").distinct(), "lines")
    out, far = [lines], 1
    while (max_depth is None or far < max_depth) and not (full := lines.where(F.size("ids") == far + 1)).isEmpty():
        every = out[0]
        for more in out[1:]:
            every = every.unionAll(more)
        upper = every.select(F.col("low").alias("mid"), F.col("top").alias("end"), F.slice("ids", F.lit(2), F.size("ids") - 1).alias("more"))
        fresh = ~F.arrays_overlap("ids", "more")
        joined = full.join(upper, full["top"] == upper["mid"]).where(fresh).select("low", F.col("end").alias("top"), F.concat("ids", "more").alias("ids"))
        lines = stored(joined if max_depth is None else joined.where(F.size("ids") <= max_depth + 1), "lines")
        out.append(lines)
        far *= 2
    every = out[0]
    for more in out[1:]:
        every = every.unionAll(more)
    return every


def pedigree_paths(po: DataFrame, max_depth: int | None = None) -> DataFrame:
    """K1: ``focal, id2, first_parent, ids, dirs, open`` for all paths of at least one step up, then only down.

    A path never enters a person twice.  It is a line of ancestors, or two that meet at their ancestor, reached through different children of it and with no one
    else in common.  With ``max_depth`` paths end after so many steps; those that could go on are ``open``.
    """
    lines = stored(ancestor_lines(po, max_depth), "ancestors")
    ups = lambda ids: F.transform(F.slice(ids, F.lit(2), F.size(ids) - 1), lambda _: F.lit(1))
    rising = lines.select(F.col("low").alias("focal"), F.col("top").alias("id2"), F.col("ids")[1].alias("first_parent"), "ids", ups("ids").alias("dirs"))
    # The ancestor's child on the way tells most lines that can't meet apart before their people are compared.
    one = lines.select(F.col("low").alias("focal"), "top", F.col("ids").alias("up"), F.element_at("ids", -2).alias("by1"))
    other = lines.select(F.col("low").alias("id2"), "top", F.slice("ids", F.lit(1), F.size("ids") - 1).alias("rest"), F.element_at("ids", -2).alias("by2"))
    met = one.join(other, "top").where("focal <> id2 and by1 <> by2").where(~F.arrays_overlap("up", "rest"))
    if max_depth is not None:
        met = met.where(F.size("up") - 1 + F.size("rest") <= max_depth)
    falling = met.select("focal", "id2", F.col("up")[1].alias("first_parent"), F.concat("up", F.reverse("rest")).alias("ids"), F.concat(ups("up"), F.transform("rest", lambda _: F.lit(-1))).alias("dirs"))
    paths = rising.unionAll(falling)
    if max_depth is None:
        return paths.withColumn("open", F.lit(False))
    paths = stored(paths, "paths")
    last = paths.where(F.size("dirs") == max_depth)
    up, down = po.select(F.col("child").alias("id2"), F.col("parent").alias("to")), po.select(F.col("parent").alias("id2"), F.col("child").alias("to"))
    fresh = ~F.array_contains("ids", F.col("to"))
    on = last.where(F.element_at("dirs", -1) == 1).join(up, "id2").where(fresh).select("ids").unionAll(last.join(down, "id2").where(fresh).select("ids"))
    return paths.join(on.distinct().withColumn("on", F.lit(True)), "ids", "left").select("focal", "id2", "first_parent", "ids", "dirs", F.coalesce("on", F.lit(False)).alias("open"))


def _dirs(column: str = "dirs"):
    return F.array_join(F.transform(column, lambda d: d.cast("string")), ",")


def path_groups(paths: DataFrame, sexes: DataFrame) -> DataFrame:
    """K2, K3: per (focal, id2) the multiset of paths as signatures with and without the first parent's sex.

    Also the reversed signature, whether both are of one generation, and the expected sharing (G16).  Starting parents of
    unknown sex are left out (see ``sexless_parents``).
    """
    sex = sexes.where("sex in (1, 2)").select(F.col("iid").alias("first_parent"), "sex")
    one = paths.join(sex, "first_parent").select("focal", "id2", "sex", "ids", "dirs").distinct()
    back = F.array_join(F.transform(F.reverse("dirs"), lambda d: (-d).cast("string")), ",")
    rows = one.select("focal", "id2", "sex", _dirs().alias("way"), back.alias("back"), F.aggregate("dirs", F.lit(0), lambda a, d: a + d).alias("rise"), F.pow(F.lit(0.5), F.size("dirs") - 1).alias("k"))
    sig = lambda c: F.array_join(F.sort_array(F.collect_list(c)), "|")
    half = lambda s: F.coalesce(F.sum(F.when(F.col("sex") == s, F.col("k"))), F.lit(0.0))
    return rows.groupBy("focal", "id2").agg(sig("way").alias("signature"), sig(F.concat_ws(":", "sex", "way")).alias("sexed_signature"), sig("back").alias("reversed"), (F.max(F.abs("rise")) == 0).alias("same_generation"), half(1).alias("k1"), half(2).alias("k2"), F.count(F.lit(1)).alias("n_paths"))


def sexless_parents(paths: DataFrame, sexes: DataFrame) -> DataFrame:
    """Parents that start a path but have no sex 1 or 2."""
    known = sexes.where("sex in (1, 2)").select(F.col("iid").alias("first_parent"))
    return paths.select("first_parent").distinct().join(known, "first_parent", "left_anti")


def expected_kinship(groups: DataFrame) -> DataFrame:
    """``focal, id2, ibd1, ibd2`` expected from the paths."""
    k1, k2 = F.col("k1"), F.col("k2")
    return groups.select("focal", "id2", (k1 * (1 - k2) + k2 * (1 - k1)).alias("ibd1"), (k1 * k2).alias("ibd2"))


def name_relationships(groups: DataFrame, codes: DataFrame) -> DataFrame:
    """Groups with ``name`` and ``degree`` of the first code by priority whose signature they have, else null."""
    small = F.broadcast(codes.groupBy("sexed", "signature").agg(F.min_by("name", "priority").alias("name"), F.min_by("degree", "priority").alias("degree")))  # the code table
    a = small.where("sexed").select(F.col("signature").alias("sexed_signature"), F.col("name").alias("n1"), F.col("degree").alias("d1"))
    b = small.where("not sexed").select("signature", F.col("name").alias("n2"), F.col("degree").alias("d2"))
    # Sex-specific codes have the higher priority.
    out = groups.join(a, "sexed_signature", "left").join(b, "signature", "left")
    return out.withColumns({"name": F.coalesce("n1", "n2"), "degree": F.coalesce("d1", "d2")}).drop("n1", "n2", "d1", "d2")


def once_per_pair(named: DataFrame) -> DataFrame:
    """Of two people of one generation only the row whose focal is the smaller."""
    return named.where("not same_generation or focal < id2")


def unknown_relationships(groups: DataFrame, codes: DataFrame) -> DataFrame:
    """How often each unnamed signature occurs, those left out whose reverse has a name."""
    named = once_per_pair(name_relationships(groups, codes)).where("name is null")
    known = F.broadcast(codes.where("not sexed").select(F.col("signature").alias("reversed")).distinct())  # the code table
    return named.join(known, "reversed", "left_anti").groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


def known_pairs(groups: DataFrame, codes: DataFrame, king: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """K6: named pairs with kinship, expected sharing and, if given, their segment statistics."""
    named = once_per_pair(name_relationships(groups, codes)).where("name is not null")
    both = named.join(expected_kinship(groups).withColumnsRenamed({"ibd1": "exp_ibd1", "ibd2": "exp_ibd2"}), ["focal", "id2"])
    both = lookup_pairs(both.withColumnRenamed("id2", "relative"), king, {"ibd1seg": 0.0, "ibd2seg": 0.0}, "focal", "relative")
    out = both.select(F.least("focal", "relative").alias("id1"), F.greatest("focal", "relative").alias("id2"), "focal", F.col("name").alias("rel"), "degree", F.col("ibd1seg").alias("k_ibd1"), F.col("ibd2seg").alias("k_ibd2"), "exp_ibd1", "exp_ibd2")
    return out.join(stats, ["id1", "id2"], "left") if stats is not None else out


def sib_pairs(po: DataFrame) -> DataFrame:
    """Unordered pairs of children that share a parent.

    A parent's children are paired with each other: families are small, and their pairs are the result.
    """
    a, b = po.select("parent", F.col("child").alias("id1")), po.select("parent", F.col("child").alias("id2"))
    return a.join(b, "parent").where("id1 < id2").select("id1", "id2").distinct()


def putative_full_sibs(po: DataFrame, people: DataFrame, king: DataFrame, low: float = 0.10, high: float = 0.50) -> DataFrame:
    """Pairs of people without parents whose ibd2 lies between the limits."""
    rootless = people.select("iid").join(po.select(F.col("child").alias("iid")).distinct(), "iid", "left_anti")
    near = king.where((F.col("ibd2seg") > low) & (F.col("ibd2seg") < high))
    return near.join(rootless.select(F.col("iid").alias("id1")), "id1", "left_semi").join(rootless.select(F.col("iid").alias("id2")), "id2", "left_semi").select("id1", "id2")


def shared_parents(pairs: DataFrame, po: DataFrame) -> DataFrame:
    """Per pair the number of parents in common and of other parents, and the common ones."""
    of = po.groupBy("child").agg(F.collect_set("parent").alias("parents"))
    side = lambda k: of.select(F.col("child").alias(f"id{k}"), F.col("parents").alias(f"p{k}"))
    both = pairs.join(side(1), "id1", "left").join(side(2), "id2", "left")
    none = F.expr("array()").cast(of.schema["parents"].dataType)
    p1, p2 = F.coalesce("p1", none), F.coalesce("p2", none)
    common = F.array_sort(F.array_intersect(p1, p2))
    return both.select(*pairs.columns, common.alias("common"), F.size(common).alias("n_common"), (F.size(F.array_union(p1, p2)) - F.size(common)).alias("n_other"))
