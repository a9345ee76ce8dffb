"""The labelling job on families that the fixture doesn't hold."""

import pytest

from kinfold.operators import pedigree as K
from kinfold.plans import label as J


class Stop(Exception):
    pass


@pytest.mark.parametrize("kind", ["long", "string"])
def test_full_siblings_with_one_listed_parent(spark, monkeypatch, kind):
    """Fathers with full siblings whose mother isn't listed, half siblings by two mothers, and a grandchild in each family."""
    as_id = int if kind == "long" else "p{}".format
    fam, king, want = [], [], {}
    for n in range(100, 1000, 100):
        f, a, b, m1, m2, c, d, spouse, kid = (as_id(n + k) for k in range(9))
        fam += [(f, None, None, 1), (a, f, None, 2), (b, f, None, 1), (m1, None, None, 2), (m2, None, None, 2), (c, f, m1, 1), (d, f, m2, 2), (spouse, None, None, 1), (kid, spouse, a, 1)]
        e = n / 50_000
        king += [(a, b, 0.5 - e, 0.24 + e, 0.5)] + [(x, y, 0.5 + e, e / 2, 0.25) for x, y in ((a, c), (a, d), (b, c), (b, d), (c, d))]
        want |= {(a, b): "FS", (a, c): "PHS", (b, d): "PHS", (c, d): "PHS", (kid, b): "AV"}
    fam = spark.createDataFrame(fam, f"iid {kind}, father {kind}, mother {kind}, sex int")
    king = spark.createDataFrame(king, f"id1 {kind}, id2 {kind}, ibd1seg double, ibd2seg double, propibd double")
    segments = spark.createDataFrame([], f"id1 {kind}, id2 {kind}, chromosome int, id1_haplotype int, id2_haplotype int, start_cm double, end_cm double")
    seen = {}

    def see(groups, codes, *rest):
        rows = K.name_relationships(groups, codes).collect()
        assert groups.schema["id2"].dataType == fam.schema["iid"].dataType
        seen.update({(r.focal, r.id2): r.name for r in rows})
        raise Stop

    monkeypatch.setattr(J, "known_pairs", see)
    monkeypatch.setattr(J, "pair_stats", lambda close, genome_cm: close)
    with pytest.raises(Stop):
        J.label_pairs(fam, king, segments, 3545.0)
    assert {k: seen.get(k) for k in want} == want
    assert {i for pair in seen for i in pair} <= {r.iid for r in fam.collect()}


def test_no_siblings(spark):
    fam = spark.createDataFrame([(1, None, None, 1), (2, None, None, 2), (3, 1, 2, 1)], "iid long, father long, mother long, sex int")
    king = spark.createDataFrame([], "id1 long, id2 long, ibd1seg double, ibd2seg double")
    assert J.sibship_groups(K.po_edges(fam), fam, king).count() == 2


def test_twins_populations_models_and_own_tree(spark):
    from kinfold.operators.hierarchy import TREE
    from kinfold.sources.fixtures import fixture

    sf = "/root/testdata/sf0.001"
    fam, king, segments, people = (fixture(spark, sf, v) for v in ("fam", "king_typed", "segments", "people"))
    full = J.label(fam, king, segments, 3545.0)
    twins = {r.iid for r in king.where("inftype = 'Dup/MZ'").selectExpr("id2 as iid").collect()}
    of = {r.iid: r.popl for r in people.collect()}
    got = J.label(fam, king, segments, 3545.0, drop_twins=True, models=full.models).labels().collect()
    # With the models of all, the labels of those who stay are the same.
    want = {(r.id1, r.id2): r.most_probable for r in full.labels().collect()}
    assert got and {(r.id1, r.id2): r.most_probable for r in got} == {k: v for k, v in want.items() if not twins & set(k)}
    inside = J.label(fam, king, segments, 3545.0, populations=people.select("iid", "popl"), popl="BUILDING", models=full.models).labels().collect()
    assert {(r.id1, r.id2): r.most_probable for r in inside} == {k: v for k, v in want.items() if of[k[0]] == of[k[1]] == "BUILDING"}
    # A tree whose second degree has a longer name, and probabilities for another question.
    tree = tuple((n, a) for n, a in TREE if n != "AV") + (("AV", "2nd"),)
    flat = J.label(fam, king, segments, 3545.0, tree=tree, models=full.models)
    assert {r.parent for r in flat.tree.where("node = 'AV'").collect()} == {"2nd"} and flat.probs.count() == full.probs.count()
    assert full.labels(0.99).count() == len(want)


def test_labels_by_stored_models_prepare_pairs_once(spark, sf_dir, monkeypatch):
    """Training and labelling start from the same tables, and training scores no pairs."""
    from kinfold.plans.queries import QUERIES

    names, store = [], J.stored
    monkeypatch.setattr(J, "stored", lambda df, name: (names.append(name), store(df, name))[1])
    assert QUERIES["file_labels"](spark, sf_dir).count() > 0
    assert [names.count(n) for n in ("kinship", "close", "stats", "training", "rows", "probs")] == [1] * 6
