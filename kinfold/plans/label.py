"""Labelling pairs of people with a relationship and a probability (M2 to M4, M8, M10), and unrelated sets by mode."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import pairs as P
from kinfold.operators.canonical import as_given, canonical_pairs, match, one_a_pair
from kinfold.operators.graphs import ranked_independent_set, unrelated_set
from kinfold.operators.hierarchy import TREE, cascaded, most_probable, set_probs, sum_children, tree_table, unpacked
from kinfold.operators.models import lda_fit, lda_predict, lda_score
from kinfold.operators.pedigree import CODES, codes_table, known_pairs, path_groups, pedigree_paths, po_edges, sib_pairs
from kinfold.operators.segments import MIN_PROPIBD, close_pair_segments, pair_stats, phase_error_split, switch_arrays
from kinfold.operators.siblings import resolve_sibships
from kinfold.plans.lineage import stored
from kinfold.sources.readers import check_codes
from kinfold.sources.writers import write_model

SECOND = ("MGP", "MHS", "PHS", "PGP", "AV")
HAPLOTYPE_CLASS = {"PHS": "HS", "MHS": "HS", "AV": "GPAV", "PGP": "GPAV", "MGP": "GPAV"}
PHASE_ERROR = "Phase error"
MODELS = ("degree", "segments", "haplotype")
PAIR = ["id1", "id2"]


def degree_of(rel: str = "rel", degree: str = "degree"):
    """The class that the degree model learns: the degree, or the relationship itself right under the root."""
    return F.when(F.col(degree) == "relatives", F.col(rel)).otherwise(F.col(degree))


def error_stats(segments: DataFrame, genome_cm: float, mean_d: float, seed: int) -> DataFrame:
    """M8: pair statistics after switch errors."""
    return pair_stats(phase_error_split(segments, switch_arrays(segments, mean_d, seed)), genome_cm)


def training_table(known: DataFrame, segments: DataFrame, genome_cm: float, mean_d: float = 50.0, seed: int = 0, stats: DataFrame | None = None) -> DataFrame:
    """M8: labelled pairs with statistics, and copies with switch errors of the 2nd-degree ones, labelled as such.

    ``stats`` are the pairs' statistics where they are known already.  Only segments of 2nd-degree pairs are split.
    """
    named = known.select(*PAIR, "rel", degree_of().alias("class"))
    real = named.join(stats if stats is not None else pair_stats(segments.join(named.select(*PAIR).distinct(), PAIR, "left_semi"), genome_cm), PAIR).withColumn("copy", F.lit("real"))
    second = named.where(F.col("rel").isin(*SECOND))
    theirs = segments.join(second.select(*PAIR).distinct(), PAIR, "left_semi")
    wrong = second.join(error_stats(theirs, genome_cm, mean_d, seed), PAIR).withColumn("copy", F.lit("error"))
    return real.unionByName(wrong)


def degree_model(known: DataFrame) -> DataFrame:
    """M2: learned from (k_ibd1, k_ibd2) of all known relatives."""
    return lda_fit(known.withColumn("class", degree_of()), "class", ("k_ibd1", "k_ibd2"))


def segment_count_model(known: DataFrame) -> DataFrame:
    """M3: learned from kinship coverage and n of 2nd-degree pairs."""
    return lda_fit(known.where(F.col("rel").isin(*SECOND)).select("rel", (F.col("k_ibd1") + F.col("k_ibd2")).alias("cov"), F.col("n").cast("double").alias("n")), "rel", ("cov", "n"))


def haplotype_model(training: DataFrame) -> DataFrame:
    """M4: learned from the h-scores in pair order, phase errors as a class of their own."""
    group = F.coalesce(*[F.when(F.col("rel") == r, F.lit(c)) for r, c in HAPLOTYPE_CLASS.items()])
    train = training.where(F.col("rel").isin(*HAPLOTYPE_CLASS)).select(F.when(F.col("copy") == "error", PHASE_ERROR).otherwise(group).alias("class"), "h1", "h2")
    return lda_fit(train, "class", ("h1", "h2"))


def degree_probs(pairs: DataFrame, model: DataFrame) -> DataFrame:
    """M2: ``id1, id2, node, p_con`` of degrees from (k_ibd1, k_ibd2)."""
    return lda_score(pairs, model, ("k_ibd1", "k_ibd2")).select(*PAIR, F.col("class").alias("node"), F.col("p").alias("p_con"))


def segment_count_probs(pairs: DataFrame, model: DataFrame) -> DataFrame:
    """M3: scored on segment coverage and n."""
    rows = pairs.select(*PAIR, (F.col("ibd1") + F.col("ibd2")).alias("cov"), F.col("n").cast("double").alias("n"))
    return lda_score(rows, model, ("cov", "n")).select(*PAIR, F.col("class").alias("node"), F.col("p").alias("p_con"))


def haplotype_probs(pairs: DataFrame, model: DataFrame, max_error: float = 0.2) -> DataFrame:
    """M4: HS and GPAV from the h-scores, the larger first; only where a phase error is unlikely."""
    rows = pairs.select(*PAIR, F.greatest("h1", "h2").alias("h1"), F.least("h1", "h2").alias("h2"))
    wide = lda_score(rows, model, ("h1", "h2")).groupBy(*PAIR).agg(*[F.coalesce(F.sum(F.when(F.col("class") == c, F.col("p"))), F.lit(0.0)).alias(c) for c in ("HS", "GPAV", PHASE_ERROR)])
    return wide.where(F.col(PHASE_ERROR) < max_error).unpivot(PAIR, ["HS", "GPAV"], "node", "p_con")


def write_models(models: dict[str, DataFrame], path: str) -> None:
    """The three models, a folder each."""
    for name in MODELS:
        write_model(models[name], f"{path}/{name}")


def read_models(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What ``write_models`` wrote, for labelling without training."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in MODELS}


def sibship_groups(po: DataFrame, people: DataFrame, king: DataFrame) -> DataFrame:
    """Path groups of listed people in the pedigree to which the parents that full siblings lack were added.

    Added parents have text as ids, so paths are walked over ids as text.
    """
    kind = people.schema["iid"].dataType
    edges = po.select(F.col("parent").cast("string").alias("parent"), F.col("child").cast("string").alias("child"))
    sexes = people.select(F.col("iid").cast("string").alias("iid"), F.col("sex").cast("int").alias("sex"))
    if match(king, sib_pairs(po), "left_semi").where("ibd1seg is not null and ibd2seg is not null and not isnan(ibd1seg) and not isnan(ibd2seg)").isEmpty():
        added = None
    else:
        added = stored(resolve_sibships(po, people, king).select("parent", F.col("child").cast("string").alias("child"), "sex"), "added")
        edges = edges.union(added.select("parent", "child")).distinct()
        sexes = sexes.union(added.select("parent", "sex").distinct())
    groups = path_groups(stored(pedigree_paths(stored(edges, "edges")), "walks"), sexes)
    if added is not None:
        groups = groups.join(added.select(F.col("parent").alias("id2")).distinct(), "id2", "left_anti")
    return groups.withColumns({c: F.col(c).cast(kind) for c in ("focal", "id2")})


class Labelling(NamedTuple):
    """What labelling gives: the pairs scored, the probability of every node (K9) for other cuts and questions, and the models used."""

    pairs: DataFrame
    packed: DataFrame
    tree: DataFrame
    models: dict[str, DataFrame]

    @property
    def probs(self) -> DataFrame:
        """A row for each pair and node."""
        return unpacked(self.packed, self.tree)

    def labels(self, min_p: float = 0.5, order: DataFrame | None = None) -> DataFrame:
        """``id1, id2, k_ibd1, k_ibd2, most_probable, probability, degree, h1, h2`` at a least probability.

        The smaller id comes first, or with ``order`` (id1, id2), say the caller's kinship, the one that it names first; h1 is always of id1.
        """
        found = self.pairs.select(*PAIR, "k_ibd1", "k_ibd2", "h1", "h2").join(most_probable(self.packed, self.tree, min_p), PAIR)
        return found if order is None else as_given(found, order)


class Ready(NamedTuple):
    """What training and labelling start from: all people and those who count, kinship and segments of close pairs by the smaller id, and the pairs' statistics."""

    fam: DataFrame
    persons: DataFrame
    king: DataFrame
    close: DataFrame
    stats: DataFrame
    genome_cm: float


def ready(fam: DataFrame, king: DataFrame, segments: DataFrame, genome_cm: float, *, min_k: float = MIN_PROPIBD, populations: DataFrame | None = None, popl: str | None = None, drop_twins: bool = True) -> Ready:
    """The tables of ``label`` before any model; one training and any number of labellings can start from them."""
    persons = fam
    twins = stored(P.twins(king), "twins") if drop_twins and "inftype" in king.columns else None
    drop_twins = twins is not None and not twins.isEmpty()
    # One row for each pair of people, whatever way round the tables name them.
    king, segments = stored(one_a_pair(king, "propibd"), "kinship"), canonical_pairs(segments)
    if drop_twins:
        persons = persons.join(twins, "iid", "left_anti")
    if popl is not None:
        persons = P.people(persons.drop("popl"), populations).where(F.col("popl") == popl)
    if drop_twins or popl is not None:
        persons = stored(persons, "persons")
        king = stored(P.keep_members(king, persons.select("iid").distinct()), "king")
    # With a least kinship only pairs that kinship has are kept anyway.
    close = stored(close_pair_segments(segments if persons is fam or min_k > 0 else P.keep_pairs(segments, king), king, min_k), "close")
    return Ready(fam, persons, king, close, stored(pair_stats(close, genome_cm), "stats"), genome_cm)


def known_relatives(of: Ready, codes=CODES) -> DataFrame:
    """The pairs with statistics whose relationship the pedigree names."""
    groups = stored(sibship_groups(po_edges(of.persons), of.fam, of.king), "groups")
    if of.persons is not of.fam:
        ids = of.persons.select("iid").distinct()
        groups = groups.join(ids.select(F.col("iid").alias("focal")), "focal", "left_semi").join(ids.select(F.col("iid").alias("id2")), "id2", "left_semi")
    return stored(known_pairs(groups, codes_table(of.fam.sparkSession, codes), of.king, of.stats).where("n is not null"), "known")


def train(of: Ready, known: DataFrame, mean_d: float = 50.0, seed: int = 0) -> dict[str, DataFrame]:
    """M2 to M4, M8: the three models, learned from known pairs."""
    training = stored(training_table(known, of.close, of.genome_cm, mean_d, seed, of.stats), "training")
    fitted = zip(MODELS, (degree_model(known), segment_count_model(known), haplotype_model(training)), strict=True)
    return {name: stored(model, "model") for name, model in fitted}


def scored(of: Ready, models: dict[str, DataFrame], tree=TREE, only: DataFrame | None = None) -> Labelling:
    """Probabilities of all pairs by the models, or of the known ones in ``only``."""
    nodes = tree_table(of.fam.sparkSession, tree)
    rows = of.stats.join(of.king.select(*PAIR, F.col("ibd1seg").alias("k_ibd1"), F.col("ibd2seg").alias("k_ibd2")), PAIR)
    if only is not None:
        rows = rows.join(only.select(*PAIR).distinct(), PAIR, "left_semi")
    rows = stored(rows, "rows")
    degrees = stored(degree_probs(rows, models["degree"]), "degrees")
    second = degrees.where("node = '2nd' and p_con > 0.2").select(*PAIR)
    if only is not None:
        second = only.where("degree = '2nd'").select(*PAIR).distinct()
    chosen = stored(rows.join(second, PAIR, "left_semi"), "second")
    counts = sum_children(segment_count_probs(chosen, models["segments"]))
    probs = degrees.withColumn("method", F.lit("degree")).unionByName(counts.withColumn("method", F.lit("segments")))
    probs = set_probs(probs, haplotype_probs(chosen, models["haplotype"]), "haplotype")
    return Labelling(rows, stored(cascaded(probs, nodes), "probs"), nodes, models)


def label(
    fam: DataFrame, king: DataFrame, segments: DataFrame, genome_cm: float, *, assess: bool = False, min_k: float = MIN_PROPIBD, mean_d: float = 50.0, seed: int = 0,
    populations: DataFrame | None = None, popl: str | None = None, drop_twins: bool = True, codes=CODES, tree=TREE, models: dict[str, DataFrame] | None = None,
) -> Labelling:
    """Probabilities of all close pairs with segments, or of known ones when assessing.

    Kinship and segments may name a pair in any order, and kinship more than once (the largest propibd counts); the result names the smaller id first, see ``Labelling.labels``.
    With ``popl`` only people of that population count (``populations``: iid, popl); unless ``drop_twins`` is false the second member of each Dup/MZ pair, second as kinship
    names it, goes (P2, P3); both leave pedigree and kinship before anything else.  ``codes`` and ``tree`` may be the user's own; with ``models`` from earlier training none is fitted.
    """
    check_codes(codes, tree)
    of = ready(fam, king, segments, genome_cm, min_k=min_k, populations=populations, popl=popl, drop_twins=drop_twins)
    known = known_relatives(of, codes) if assess or models is None else None
    return scored(of, train(of, known, mean_d, seed) if models is None else models, tree, known if assess else None)


def label_pairs(fam: DataFrame, king: DataFrame, segments: DataFrame, genome_cm: float, min_p: float = 0.5, **how) -> DataFrame:
    """The labels of ``label`` at one least probability."""
    return label(fam, king, segments, genome_cm, **how).labels(min_p)


def relatedness_edges(pairs: DataFrame, mode: str, degree: str = "4th", threshold: float | None = None, training: DataFrame | None = None) -> DataFrame:
    """Related pairs by mode.

    float: pihat above ``threshold``; king: a class strictly closer than ``degree``; fifth: pihat at or over the training pairs' fifth-degree cut;
    lda: a predicted class other than ``degree`` or a more distant one, trained on that degree and closer within two SD.
    """
    if mode == "float":
        return pairs.where(F.col("pihat") > threshold).select(*PAIR)
    closer = P.DEGREES[P.DEGREES.index(degree) + 1 :]
    if mode == "king":
        return pairs.where(F.col("degree").isin(*closer)).select(*PAIR)
    if mode == "fifth":
        cut = P.fifth_degree_cut(training).withColumn("one", F.lit(1))  # one row
        return pairs.withColumn("one", F.lit(1)).join(F.broadcast(cut), "one").where("pihat >= cut").select(*PAIR)
    if mode == "lda":
        train = P.within_class_sd(P.complete(training, ["ibd1", "ibd2", "pihat"]).where(F.col("degree").isin(degree, *closer)))
        model = lda_fit(train, "degree", ("ibd1", "ibd2"))
        return lda_predict(pairs, model, ("ibd1", "ibd2")).where(F.col("predicted").isin(*closer)).select(*PAIR)
    raise ValueError(f"unknown mode {mode!r}")


def find_unrelated(ids: DataFrame, pairs: DataFrame, mode: str, **how) -> DataFrame:
    """The ranked unrelated set under a mode."""
    edges = stored(P.keep_members(relatedness_edges(pairs, mode, **how), ids), "related")
    return ranked_independent_set(stored(P.unrelated_counts(ids, edges), "counts"), edges)


def unrelated_founders(king: DataFrame, persons: DataFrame, max_k: float, seed: int = 0) -> DataFrame:
    """``popl, iid`` of unrelated people within each population; one run serves all, as edges stay inside populations."""
    a = persons.select(F.col("iid").alias("id1"), F.col("popl").alias("p1"))
    b = persons.select(F.col("iid").alias("id2"), F.col("popl").alias("p2"))
    edges = king.where(F.col("propibd") > max_k).join(a, "id1").join(b, "id2").where("p1 = p2").select(*PAIR)
    return unrelated_set(persons, stored(edges, "edges"), seed).join(persons.select("iid", "popl"), "iid").select("popl", "iid")


def selected_summary(chosen: DataFrame, edges: DataFrame, king: DataFrame) -> DataFrame:
    """One row with the number of families, the set's size and its largest kinship."""
    from kinfold.operators.graphs import components

    families = components(edges).agg(F.count_distinct("component").alias("n_families"))
    size = chosen.agg(F.count(F.lit(1)).alias("size"))
    parts = [x.withColumn("one", F.lit(1)) for x in (families, size, P.max_kinship(chosen, king))]  # one row each
    return parts[0].join(parts[1], "one").join(parts[2], "one").drop("one")
