"""Hand-made cases of the segment, map and switch operators, and their invariants."""

import random

import pytest

from kinfold.operators import genmap as M
from kinfold.operators import segments as S
from kinfold.plans.queries import QUERIES

SCHEMA = "id1 long, id2 long, chromosome int, id1_haplotype int, id2_haplotype int, start_cm double, end_cm double"


def segs(spark, *rows):
    return spark.createDataFrame([(1, 2, 1, a, b, float(s), float(e)) for s, e, a, b in rows], SCHEMA)


def test_all_four_slots_make_ibd2(spark):
    row = S.ibd1_ibd2(S.ibd_regions(segs(spark, (0, 10, 0, 0), (0, 10, 1, 1)))).first()
    assert (row.ibd1_cm, row.ibd2_cm) == (0, 10)
    row = S.ibd1_ibd2(S.ibd_regions(segs(spark, (0, 10, 0, 0), (0, 10, 0, 1)))).first()
    assert (row.ibd1_cm, row.ibd2_cm) == (10, 0)


def test_segment_without_length_adds_nothing(spark):
    assert S.ibd_regions(segs(spark, (3, 3, 0, 0))).count() == 0
    assert S.ibd_regions(segs(spark, (0, 5, 0, 0), (3, 3, 1, 1))).count() == 1


def test_h_score(spark):
    row = S.h_score(S.ibd_regions(segs(spark, (0, 10, 0, 0), (20, 30, 1, 0)))).first()
    assert (row.h1, row.h2) == (0.5, 1.0)
    row = S.h_score(S.ibd_regions(segs(spark, (0, 10, 0, 0), (0, 10, 0, 0)))).first()
    assert (row.h1, row.h2) == (1.0, 1.0)


def test_stitching_is_strict(spark):
    assert S.segment_count(segs(spark, (0, 5, 0, 0), (5.5, 8, 0, 0), (9, 10, 0, 0))).first().n == 2


def test_no_whole_site_inside(spark):
    assert S.site_kinship(segs(spark, (0.2, 0.8, 0, 0))).count() == 0


def test_canonical_order_swaps_haplotypes(spark):
    df = spark.createDataFrame([(5, 2, 1, 0, 1, 0.0, 1.0)], SCHEMA)
    row = S.canonical_pairs(df).first()
    assert (row.id1, row.id2, row.id1_haplotype, row.id2_haplotype) == (2, 5, 1, 0)


def test_interpolation_is_clamped(spark):
    gmap = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0)], "chrom int, bp long, cm double")
    sites = spark.createDataFrame([(1, 5), (1, 15), (1, 25), (2, 7)], "chrom int, bp long")
    got = {(r.chrom, r.bp): r.cm for r in M.interpolate(sites, gmap).collect()}
    assert got == {(1, 5): 1.0, (1, 15): 1.5, (1, 25): 2.0, (2, 7): None}


def test_genome_length_default(spark):
    assert M.genome_length(None) == 3545.0
    assert M.genome_length(spark.createDataFrame([], "chrom int, cm double")) == 3545.0


def test_switches_cut_and_flip(spark):
    switches = spark.createDataFrame([(1, 2, 1, 0, 4.0), (1, 2, 1, 1, 10.0), (1, 2, 1, 0, 1.0)], "id1 long, id2 long, chromosome int, side int, switch_cm double")
    got = sorted((r.start_cm, r.end_cm, r.id1_haplotype, r.id2_haplotype) for r in S.phase_error_split(segs(spark, (2, 20, 0, 0), (30, 32, 0, 0)), switches).collect())
    # 2-4 is too short; one switch of side 0 lies before the segment, one inside.
    assert got == [(4.0, 10.0, 0, 0), (10.0, 20.0, 0, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_sweep_equals_incremental_split(spark, seed):
    rng = random.Random(seed)
    rows = [(s := rng.randint(0, 20), s + rng.randint(0, 8), rng.randint(0, 1), rng.randint(0, 1)) for _ in range(12)]
    want = {}
    cuts = sorted({x for s, e, _, _ in rows if e > s for x in (s, e)})
    for lo, hi in zip(cuts, cuts[1:]):
        held = [(a, b) for s, e, a, b in rows if s <= lo and e >= hi and e > s]
        if held:
            want[lo, hi] = tuple(sum(a == h for a, _ in held) for h in (0, 1)) + tuple(sum(b == h for _, b in held) for h in (0, 1))
    got = {(r.start_cm, r.end_cm): (r.c1, r.c2, r.c3, r.c4) for r in S.ibd_regions(segs(spark, *rows)).collect()}
    assert got == want
    row = S.ibd1_ibd2(S.ibd_regions(segs(spark, *rows))).first()
    assert row.ibd1_cm + row.ibd2_cm == sum(hi - lo for lo, hi in want)


def test_switches_reach_the_end_whatever_their_distance(spark):
    pairs = spark.createDataFrame([(1, 2, 1)], "id1 long, id2 long, chromosome int")
    got = S.draw_switches(pairs, mean_d=1.0).groupBy("side").agg({"switch_cm": "max", "*": "count"}).collect()
    assert len(got) == 2 and all(r["max(switch_cm)"] > S.LONGEST_CM and r["count(1)"] > 200 for r in got)


def test_cuts_by_brute_force_and_without_gathering(spark, sf_dir):
    """Pieces equal those counted one by one, with switches as arrays or as rows; the query's switches are arrays from the start, never gathered from rows."""
    rng = random.Random(5)
    rows = [(i, i + 1, 1, rng.randint(0, 1), rng.randint(0, 1), s := rng.randint(0, 200) / 2, s + rng.randint(0, 400) / 2) for i in range(3) for _ in range(40)]
    rows += [(9, 10, 1, 0, 1, 3.0, 8.0), (0, 1, 1, 0, 1, None, 8.0), (0, 1, 1, 0, 1, 3.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    arrays = S.switch_arrays(df.where("id1 < 9"), 20.0, 3)
    drawn = {r.id1: [(p.at, p.side) for p in r.sw] for r in arrays.collect()}
    want = []
    for i, j, c, a, b, start, end in rows:
        if start is None or end is None:
            continue
        points = drawn.get(i, [])
        assert points == sorted(points)
        cuts = [start, *(at for at, _ in points if start <= at <= end), end]
        for at, until in zip(cuts, cuts[1:]):
            n = [sum(s == side and (x < start or start <= x <= at) for x, s in points) for side in (0, 1)]
            if until - at >= S.MIN_PIECE_CM:
                want.append((i, j, c, a ^ (n[0] % 2), b ^ (n[1] % 2), at, until, *n))
    for switches in (arrays, S.draw_switches(df.where("id1 < 9"), 20.0, 3)):
        assert sorted(map(tuple, S.phase_error_split(df, switches).collect())) == sorted(want)
    plan = QUERIES["phase_error_split"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
