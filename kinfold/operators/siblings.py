"""Full-sibling groups and the parents they lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.canonical import canonical_pairs, match, one_a_pair
from kinfold.operators.graphs import components
from kinfold.operators.models import gmm_fit, gmm_score, lda_fit, lda_predict
from kinfold.operators.pedigree import putative_full_sibs, shared_parents, sib_pairs

SIB_MEANS = ((0.5, 0.0), (0.5, 0.25))
FEATURES = ("ibd1seg", "ibd2seg")


def sibling_mixture(po: DataFrame, king: DataFrame, rounds: int = 20, tol: float = 1e-3) -> DataFrame:
    """Sib pairs with kinship, and ``component`` 1 for full, 0 for half siblings by a two-component mixture."""
    pairs = one_a_pair(match(king.select("id1", "id2", *FEATURES), sib_pairs(po), "left_semi"))
    return gmm_score(pairs, gmm_fit(pairs, FEATURES, SIB_MEANS, rounds=rounds, tol=tol), FEATURES)


def missing_parents(groups: DataFrame, po: DataFrame, people: DataFrame) -> DataFrame:
    """``group, child, parent, sex`` to add so that every member of a full-sib group (node, component) has two parents.

    Only groups whose members all lack the same number.  One missing parent gets the sex opposite to the smallest
    known parent's; two missing ones are a father and a mother.
    """
    have = po.groupBy("child").agg(F.count_distinct("parent").alias("k"), F.min("parent").alias("known"))
    sex = people.select(F.col("iid").alias("known"), F.col("sex").alias("known_sex"))
    members = groups.join(have, groups["node"] == have["child"], "left").select("node", "component", F.coalesce("k", F.lit(0)).alias("k"), "known").join(sex, "known", "left")
    lack = members.groupBy("component").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.min_by("known_sex", "known").alias("known_sex")).where("lo = hi and hi < 2")
    rows = members.select("node", "component").join(lack, "component")
    other = F.when(F.col("known_sex") == 1, 2).when(F.col("known_sex") == 2, 1).otherwise(0)
    sexes = F.when(F.col("lo") == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(other))
    out = rows.select("component", "node", F.explode(sexes).alias("sex"))
    return out.select(F.col("component").alias("group"), F.col("node").alias("child"), F.concat_ws("_", F.lit("missing"), F.col("component").cast("string"), F.col("sex").cast("string")).alias("parent"), "sex")


def resolve_sibships(po: DataFrame, people: DataFrame, king: DataFrame, rounds: int = 20) -> DataFrame:
    """Parents to add for the full-sib groups that the mixture finds."""
    full = sibling_mixture(po, king, rounds).where("component = 1")
    return missing_parents(components(full), po, people)


def classify_siblings(po: DataFrame, people: DataFrame, king: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Sibling pairs with ``half`` FS or 2nd and whether it was given or predicted, and the common parents.

    Two common parents make full siblings; one common and another parent, or no common but some other, half siblings; the rest is predicted by a
    discriminant trained on those, or by the model given.
    """
    king = canonical_pairs(king)
    pairs = sib_pairs(po).union(putative_full_sibs(po, people, king)).distinct()
    rows = shared_parents(one_a_pair(king.join(pairs, ["id1", "id2"], "left_semi").select("id1", "id2", *FEATURES)), po)
    rows = rows.withColumn("given", F.when(F.col("n_common") == 2, "FS").when(F.col("n_other") > 0, "2nd"))
    model = model if model is not None else lda_fit(rows, "given", FEATURES)
    out = lda_predict(rows, model, FEATURES)
    return out.select("id1", "id2", *FEATURES, "common", "n_common", F.coalesce("given", "predicted").alias("half"), F.col("given").isNull().alias("is_predicted"))


def insert_parents(classified: DataFrame, people: DataFrame) -> DataFrame:
    """``group, child, parent, sex`` to add for groups of predicted full siblings with no or one common parent."""
    full = classified.where("is_predicted and half = 'FS'")
    groups = components(full)
    parents = full.select(F.col("id1").alias("node"), F.explode_outer("common").alias("parent")).join(groups, "node")
    per = parents.groupBy("component").agg(F.count_distinct("parent").alias("k"), F.min("parent").alias("known")).where("k < 2")
    sex = people.select(F.col("iid").alias("known"), F.col("sex").alias("known_sex"))
    rows = groups.join(per, "component").join(sex, "known", "left")
    other = F.when(F.col("known_sex") == 1, 2).when(F.col("known_sex") == 2, 1).otherwise(0)
    out = rows.select("component", "node", F.explode(F.when(F.col("k") == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(other))).alias("sex"))
    return out.select(F.col("component").alias("group"), F.col("node").alias("child"), F.concat_ws("_", F.lit("missing"), F.col("component").cast("string"), F.col("sex").cast("string")).alias("parent"), "sex")
