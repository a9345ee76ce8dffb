"""Pairs in any order."""


import random

from kinfold.operators import assembly as A
from kinfold.operators import canonical as C
from kinfold.operators import pairs as P
from kinfold.operators import segments as S

KING = "id1 string, id2 string, propibd double, inftype string"


def swapped(rows, rng):
    return [(b, a, *rest) if rng.random() < 0.5 else (a, b, *rest) for a, b, *rest in rows]


def test_sides_go_with_their_ids(spark):
    df = spark.createDataFrame([(2, 1, 0, 1, 0.9, 0.6, "x"), (1, 2, 0, 1, 0.9, 0.6, "y"), (None, 2, 0, 1, 0.9, 0.6, "z"), (3, None, 0, 1, 0.9, 0.6, "w")], "id1 long, id2 long, id1_haplotype int, id2_haplotype int, h1 double, h2 double, k string")
    got = {r.k: tuple(r)[:6] for r in C.canonical_pairs(df).collect()}
    assert got == {"x": (1, 2, 1, 0, 0.6, 0.9), "y": (1, 2, 0, 1, 0.9, 0.6), "z": (None, 2, 0, 1, 0.9, 0.6), "w": (3, None, 0, 1, 0.9, 0.6)}
    back = C.as_given(C.canonical_pairs(df.where("k = 'x'")), df.where("k = 'x'")).first()
    assert tuple(back) == (2, 1, 0, 1, 0.9, 0.6, "x")


def test_one_row_a_pair(spark):
    king = spark.createDataFrame([("b", "a", 0.2, "3rd"), ("a", "b", 0.5, "2nd"), ("a", "c", 0.1, "UN")], KING)
    assert sorted(tuple(r) for r in C.one_a_pair(king, "propibd").collect()) == [("a", "b", 0.5, "2nd"), ("a", "c", 0.1, "UN")]
    asked = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("c", "b")], "p string, q string")
    assert sorted((r.p, r.q, r.inftype) for r in P.lookup_pairs(asked, king.where("inftype <> '3rd'"), {"inftype": "none"}, "p", "q").collect()) == [("a", "b", "2nd"), ("b", "a", "2nd"), ("c", "a", "UN"), ("c", "b", "none")]


def test_selections_take_either_order(spark):
    rng = random.Random(2)
    rows = [(f"p{a}", f"p{b}", (a * b % 10) / 10, ("UN", "FS", "2nd", "4th")[(a + b) % 4]) for a in range(12) for b in range(a + 1, 12)]
    straight, turned = (spark.createDataFrame(r, KING) for r in (rows, swapped(rows, rng)))
    segments = spark.createDataFrame([(*r[:2], 1, 0, 1, 2.0, 9.0) for r in swapped(rows, rng)], "id1 string, id2 string, chromosome int, id1_haplotype int, id2_haplotype int, start_cm double, end_cm double")
    keep = lambda king: sorted(tuple(r) for r in S.close_pair_segments(segments, king, 0.3).collect())
    assert keep(straight) == keep(turned) and 0 < len(keep(straight)) < len(rows)
    some = straight.where("propibd > 0.4").select("id1", "id2")
    assert P.keep_pairs(turned, some).count() == some.count() and P.drop_pairs(turned, some).count() == len(rows) - some.count()
    fam = spark.createDataFrame([("k1", "p3", "p8"), ("k2", "p9", "p4"), ("k3", "p7", "p0")], "iid string, father string, mother string")
    check = lambda king: sorted(tuple(r) for r in P.coparent_check(fam, king).collect())
    assert check(straight) == check(turned) != []


def test_orientation_takes_either_order(spark):
    rng = random.Random(5)
    rows = [(f"p{a}", f"p{b}", 0.1, rng.choice(["UN", "FS", "2nd", "4th", "3rd"])) for a in range(10, 30) for b in range(a + 1, 30)]
    po = [(f"p{a}", f"p{b}", rng.random() < 0.3) for a in range(10, 30) for b in range(a + 1, 30) if rng.random() < 0.2]
    po = spark.createDataFrame(po, "parent string, child string, locked boolean")
    got = [sorted(tuple(r) for r in A.orient_by_unrelated(po, spark.createDataFrame(r, KING)).collect()) for r in (rows, swapped(rows, rng), rows + swapped(rows, rng))]
    assert got[0] == got[1] == got[2] and any(r[2] for r in got[0])
