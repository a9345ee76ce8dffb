"""Pedigree paths of any length."""

from kinfold.operators import pedigree as K


def paths(df):
    return {tuple(r.ids): (tuple(r.dirs), r.open) for r in df.collect()}


def test_paths_have_no_bound(spark):
    # 1 to 6 and 1, 12 to 16 are lines of descent from 1.
    edges = [(k, k + 1) for k in range(1, 6)] + [(1, 12)] + [(k, k + 1) for k in range(12, 16)]
    po = spark.createDataFrame(edges, "parent long, child long")
    got = paths(K.pedigree_paths(po))
    assert got[6, 5, 4, 3, 2, 1, 12, 13, 14, 15, 16] == ((1,) * 5 + (-1,) * 5, False)
    # Every line has 15 climbs; its n-th member below 1 also goes down the other line by 1 to 5 steps.
    assert len(got) == 2 * (15 + 5 * 5) and not any(open_ for _, open_ in got.values())
    sexes = spark.createDataFrame([(k, 1) for k in range(1, 17)], "iid long, sex int")
    kin = {(r.focal, r.id2): r.ibd1 for r in K.expected_kinship(K.path_groups(K.pedigree_paths(po), sexes)).collect()}
    assert kin[6, 16] == 0.5**9


def test_a_given_depth_tells_what_is_open(spark):
    po = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5)], "parent long, child long")
    got = paths(K.pedigree_paths(po, max_depth=2))
    full = paths(K.pedigree_paths(po))
    longer = {ids[:3] for ids in full if len(ids) == 4}
    assert {ids for ids, (_, open_) in got.items() if open_} == longer
    assert any(len(ids) == 3 and not open_ for ids, (_, open_) in got.items())
