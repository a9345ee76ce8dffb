"""Completing a pedigree from parent-offspring pairs.

Pairs: parent, child, parent_age, strength, method, h1, h2 (id sharing of the two), as read from a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.canonical import one_a_pair
from kinfold.operators.graphs import components, two_colour
from kinfold.operators.pairs import coparent_check
from kinfold.plans.lineage import stored

MIN_STRENGTH = 15.0
FAR = ("4th", "UN")


def orient_by_age(po: DataFrame, gap: float, min_strength: float = MIN_STRENGTH) -> DataFrame:
    """``parent, child, locked``; where the parent is younger than ``gap`` an unlocked pair is turned and locked."""
    turn = (F.col("strength") <= min_strength) & (F.col("parent_age") < gap)
    swap = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a)
    return po.select(swap("parent", "child"), swap("child", "parent"), ((F.col("strength") > min_strength) | turn).alias("locked"))


def _partners(po: DataFrame) -> DataFrame:
    both = F.inline(F.array(F.struct(F.col("parent").alias("iid"), F.col("child").alias("partner")), F.struct(F.col("child").alias("iid"), F.col("parent").alias("partner"))))
    return po.select(both).distinct()


def _turned(po: DataFrame, rulings: DataFrame) -> DataFrame:
    """Unlocked pairs turned and locked by (iid, partner, is_parent) rulings; of two the smaller iid's counts."""
    pair = [F.least("iid", "partner").alias("lo"), F.greatest("iid", "partner").alias("hi")]
    first = rulings.select(*pair, "iid", "is_parent").groupBy("lo", "hi").agg(F.min_by(F.struct("iid", "is_parent"), "iid").alias("r"))
    both = po.withColumns({"lo": F.least("parent", "child"), "hi": F.greatest("parent", "child")}).join(first, ["lo", "hi"], "left")
    ruled = ~F.col("locked") & F.col("r").isNotNull()
    # The one who rules is the child where the partner is a parent.
    child = F.when(F.col("r.is_parent"), F.col("r.iid")).otherwise(F.when(F.col("r.iid") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")))
    parent = F.when(child == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    return both.select(F.when(ruled, parent).otherwise(F.col("parent")).alias("parent"), F.when(ruled, child).otherwise(F.col("child")).alias("child"), (F.col("locked") | ruled).alias("locked"))


def orient_by_unrelated(po: DataFrame, king: DataFrame) -> DataFrame:
    """someone's first two partners, by id, that are 4th degree or unrelated to each other are the parents; the other partners are children.  Kinship may name a pair in any order.

    Only near pairs of kinship are rows: a person's partners in order, less those near to the first, then to the next, leave the first far pair.
    """
    partners = _partners(po)
    # Near pairs among someone's partners: each kinship row meets the people it is a partner of on one side and is kept if the other side is one too.
    near = one_a_pair(king.where(~F.col("inftype").isin(*FAR)).select("id1", "id2"))
    one = partners.select("iid", F.col("partner").alias("id1"))
    close = near.join(one, "id1").join(partners.select("iid", F.col("partner").alias("id2")), ["iid", "id2"], "left_semi")
    blocked = close.groupBy("iid", F.col("id1").alias("partner")).agg(F.collect_set("id2").alias("near"))
    # The first far partner after p among at most len(near) + 1 that follow it; rank tells how many follow.
    nth = F.row_number().over(Window.partitionBy("iid").orderBy("partner"))
    ranked = stored(partners.withColumn("nth", nth), "partners")
    rows = ranked.join(blocked, ["iid", "partner"], "left").withColumn("held", F.coalesce(F.size("near"), F.lit(0)))
    sizes = ranked.groupBy("iid").agg(F.max("nth").alias("of"))
    # p has a far partner after it iff more follow it than are near to it.
    first = rows.join(sizes, "iid").where(F.col("of") - F.col("nth") > F.col("held")).groupBy("iid").agg(F.min(F.struct("partner", "near")).alias("p"))
    after = ranked.join(first, "iid").where(F.col("partner") > F.col("p.partner"))
    after = after.where(F.col("p.near").isNull() | ~F.array_contains("p.near", F.col("partner")))
    chosen = after.groupBy("iid").agg(F.first("p.partner").alias("p1"), F.min("partner").alias("p2"))
    rulings = partners.join(chosen, "iid").select("iid", "partner", ((F.col("partner") == F.col("p1")) | (F.col("partner") == F.col("p2"))).alias("is_parent"))
    return _turned(po, rulings)


def fullsib_sets(king: DataFrame, cut: float) -> DataFrame:
    """Components of pairs with ibd2 above the cut."""
    return components(king.where(F.col("ibd2seg") > cut).select("id1", "id2"))


def orient_by_fullsibs(po: DataFrame, sets: DataFrame) -> DataFrame:
    """Partners that every member of a full-sib set has are its parents, a member's other partners its children."""
    partners = _partners(po).join(sets.select(F.col("node").alias("iid"), "component"), "iid")
    sizes = sets.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    common = partners.groupBy("component", "partner").agg(F.count(F.lit(1)).alias("k")).join(sizes, "component").where("k = size").select("component", "partner", F.lit(True).alias("common"))
    rulings = partners.join(common, ["component", "partner"], "left").select("iid", "partner", F.coalesce("common", F.lit(False)).alias("is_parent"))
    return _turned(po, rulings)


def assign_parents(po: DataFrame, people: DataFrame) -> DataFrame:
    """``iid, father, mother, n_fathers, n_mothers, n_sexless``: the first parent of each sex, by id."""
    rows = po.join(people.select(F.col("iid").alias("parent"), F.col("sex").alias("psex")), "parent", "left")
    first = lambda s: F.min(F.when(F.col("psex") == s, F.col("parent")))
    count = lambda s: F.count_distinct(F.when(F.coalesce("psex", F.lit(0)) == s, F.col("parent")))
    return rows.groupBy(F.col("child").alias("iid")).agg(first(1).alias("father"), first(2).alias("mother"), count(1).alias("n_fathers"), count(2).alias("n_mothers"), count(0).alias("n_sexless"))


def pedigree_qc(po: DataFrame, assigned: DataFrame, king: DataFrame, min_strength: float = MIN_STRENGTH) -> DataFrame:
    """``kind, subject, detail``: several parents of one sex, small age gaps, related parents, parents without a sex."""
    text = lambda *cols: F.concat_ws(" ", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])
    dup = assigned.where("n_fathers > 1 or n_mothers > 1").select(F.lit("duplicate").alias("kind"), F.col("iid").alias("subject"), text("n_fathers", "n_mothers").alias("detail"))
    sexless = assigned.where("n_sexless > 0").select(F.lit("sex"), "iid", text("n_sexless"))
    gap = po.where((F.col("method") == "AGE") & (F.col("strength") <= min_strength)).select(F.lit("ageGap"), "child", text("parent", F.col("strength").cast("int").cast("string")))
    related = coparent_check(assigned, king).select(F.lit("relatedParents"), "iid", text("father", "mother", "inftype"))
    return dup.union(sexless).union(gap).union(related)


def _parent_sets(po: DataFrame) -> DataFrame:
    """``child, ps``: each child's parents, in order."""
    return po.groupBy("child").agg(F.sort_array(F.collect_set("parent")).alias("ps"))


def parent_colours(po: DataFrame) -> DataFrame:
    """Two colours of the parents of children with two, the parents of one child apart, whatever is known of their sexes."""
    return two_colour(_parent_sets(po).where(F.size("ps") == 2).select(F.col("ps")[0].alias("id1"), F.col("ps")[1].alias("id2")).distinct())


def mixed_sex_groups(colours: DataFrame, people: DataFrame) -> DataFrame:
    """``kind, subject, detail`` of people whose colour holds both sexes by ``people``, a row each with the component and the sex."""
    known = colours.join(people.where("sex in (1, 2)").select(F.col("iid").alias("node"), "sex"), "node")
    both = known.groupBy("component", "colour").agg(F.count_distinct("sex").alias("n")).where("n > 1").select("component").distinct()
    return known.join(both, "component", "left_semi").select(F.lit("multipleSex").alias("kind"), F.col("node").alias("subject"), F.concat_ws(" ", F.col("component").cast("string"), F.col("colour").cast("string"), F.col("sex").cast("string")).alias("detail"))


def infer_parent_sex(po: DataFrame, people: DataFrame) -> DataFrame:
    """``iid, sex, how`` for parents without a sex.

    Two parents of one child get different colours.  If each colour's known sexes are one and they differ, they decide;
    else the colour with the higher mean of min(h1, h2) is male.  The parent of children with no other joins the sex whose mean is
    nearer to its own, male where there are no means.  A colour with both sexes shows as ``how`` = 'mixed'.
    """
    sexes = people.select("iid", F.coalesce("sex", F.lit(0)).alias("sex"))
    colours = stored(parent_colours(po), "colours")
    low = po.groupBy("parent").agg(F.sum(F.least("h1", "h2")).alias("h"), F.count(F.lit(1)).alias("k"))
    known = colours.join(sexes, colours["node"] == sexes["iid"]).join(low, colours["node"] == low["parent"], "left")
    stat = known.groupBy("component", "colour").agg(F.count_distinct(F.when(F.col("sex") > 0, F.col("sex"))).alias("n"), F.max(F.when(F.col("sex") > 0, F.col("sex"))).alias("s"), (F.sum("h") / F.sum("k")).alias("mean"))
    other = stat.select("component", (1 - F.col("colour")).alias("colour"), F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("mean").alias("mean2"))
    both = stat.join(other, ["component", "colour"], "left")
    sure = (F.col("n") == 1) & (F.col("n2") == 1) & (F.col("s") != F.col("s2"))
    higher = F.when((F.col("mean") > F.col("mean2")) | ((F.col("mean") == F.col("mean2")) & (F.col("colour") == 1)), 1).otherwise(2)
    ruled = both.select("component", "colour", F.when(sure, F.col("s")).otherwise(higher).alias("sex"), F.when(sure, "known").when((F.col("n") > 1) | (F.col("n2") > 1), "mixed").otherwise("mean").alias("how"))
    paired = stored(colours.join(ruled, ["component", "colour"]).select(F.col("node").alias("iid"), "sex", "how"), "paired")
    means = paired.join(low, paired["iid"] == low["parent"], "left").agg(*[(F.sum(F.when(F.col("sex") == s, F.col("h"))) / F.sum(F.when(F.col("sex") == s, F.col("k")))).alias(f"m{s}") for s in (1, 2)])  # one row
    single = _parent_sets(po).where(F.size("ps") == 1).select(F.col("ps")[0].alias("iid")).distinct().join(paired, "iid", "left_anti")
    near = single.join(low, single["iid"] == low["parent"], "left").withColumn("one", F.lit(1)).join(F.broadcast(means.withColumn("one", F.lit(1))), "one")
    own = F.col("h") / F.col("k")
    female = F.col("m1").isNotNull() & F.col("m2").isNotNull() & (F.abs(own - F.col("m2")) < F.abs(own - F.col("m1")))
    every = paired.union(near.select("iid", F.when(female, 2).otherwise(1), F.lit("nearest")))
    return every.join(sexes.where("sex = 0").select("iid"), "iid", "left_semi")


def complete_fam(fam: DataFrame, assigned: DataFrame) -> DataFrame:
    """Fam with parents filled in where it had none."""
    side = assigned.select("iid", F.col("father").alias("f"), F.col("mother").alias("m"))
    return fam.join(side, "iid", "left").withColumns({"father": F.coalesce("father", "f"), "mother": F.coalesce("mother", "m")}).drop("f", "m")
