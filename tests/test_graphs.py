"""Graph operators against one-by-one versions on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold.operators import graphs as G
from kinfold.operators.pairs import unrelated_counts


def graph(seed, n=40, m=45):
    rng = random.Random(seed)
    return list(range(n)), sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def greedy(order, edges):
    taken = set()
    near = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    for v in order:
        if not any((v, t) in near for t in taken):
            taken.add(v)
    return taken


def frames(spark, nodes, edges):
    return spark.createDataFrame([(v,) for v in nodes], "iid long"), spark.createDataFrame(edges, "id1 long, id2 long")


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    nodes, edges = graph(seed)
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in G.components(frames(spark, nodes, edges)[1]).collect()}
    assert got == {v: find(v) for v in parent}


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(60)]
    assert {r.component for r in G.components(spark.createDataFrame(edges, "id1 long, id2 long")).collect()} == {0}


@pytest.mark.parametrize("seed", [3, 4])
def test_rounds_equal_the_visit(spark, seed):
    nodes, edges = graph(seed)
    ids, links = frames(spark, nodes, edges)
    degree = {v: sum(v in e for e in edges) for v in nodes}
    known = spark.createDataFrame([(v, degree[v]) for v in nodes], "iid long, degree int")
    got = {r.iid for r in G.independent_set(known, links, [F.col("degree")]).collect()}
    assert got == greedy(sorted(nodes, key=lambda v: (degree[v], v)), edges)
    ranked = {r.iid for r in G.ranked_independent_set(unrelated_counts(ids, links), links).collect()}
    assert ranked == greedy(sorted(nodes, key=lambda v: (degree[v], -v)), edges)


def test_path_of_four(spark):
    ids, links = frames(spark, [1, 2, 3, 4], [(1, 2), (2, 3), (3, 4)])
    assert {r.iid for r in G.unrelated_set(ids, links).collect()} == {1, 4}


def test_set_without_edges_is_everything(spark):
    ids = spark.createDataFrame([(1,), (2,)], "iid long")
    assert G.unrelated_set(ids, spark.createDataFrame([], "id1 long, id2 long")).count() == 2
    assert G.unrelated_set(ids.limit(0), spark.createDataFrame([], "id1 long, id2 long")).count() == 0


def test_two_colours(spark):
    edges = [(1, 2), (2, 3), (3, 4), (7, 8), (10, 11), (11, 12), (10, 12)]
    got = {r.node: (r.component, r.colour, r.conflict) for r in G.two_colour(spark.createDataFrame(edges, "id1 long, id2 long")).collect()}
    assert [got[v][:2] for v in (1, 2, 3, 4, 7, 8)] == [(1, 0), (1, 1), (1, 0), (1, 1), (7, 0), (7, 1)]
    assert not got[1][2] and got[10][2]


def test_ties_of_text_ids(spark):
    ids = spark.createDataFrame([("s1",), ("s12",), ("s2",), ("é",), ("s",)], "iid string")
    links = spark.createDataFrame([("s1", "s12"), ("s", "é")], "id1 string, id2 string")
    got = {r.iid for r in G.ranked_independent_set(unrelated_counts(ids, links), links).collect()}
    assert got == greedy(sorted(["s1", "s12", "s2", "é", "s"], key=lambda v: (v != "s2", [-ord(c) for c in v] + [0])), [("s1", "s12"), ("s", "é")]) == {"s12", "s2", "é"}


def folders(spark):
    from pathlib import Path

    from kinfold.plans.lineage import shared_dir

    return {p.name.split("-")[1] + p.name.split("-")[2][:6] for p in Path(shared_dir(spark).removeprefix("file:")).glob("kinfold-*")}


def test_a_chain_needs_few_rounds(spark):
    """Each of 10,000 waits for the one before; a round decides a chunk, and no round's tables stay but those of the result."""
    n = 10_000
    ids, links = frames(spark, range(n), [(k, k + 1) for k in range(n - 1)])
    known = ids.withColumn("place", F.col("iid"))
    families = ids.select(F.col("iid").alias("node"), F.lit(0).cast("long").alias("component"))
    for chunk, most in ((100_000, 1), (4_000, 3)):
        before = folders(spark)
        got = {r.iid for r in G.independent_set(known, links, [F.col("place")], families, chunk).collect()}
        assert got == set(range(0, n, 2))
        more = folders(spark) - before
        assert sum(f.startswith("taken") for f in more) <= most + 1 and all(f.startswith(("taken", "ranked")) for f in more)


@pytest.mark.parametrize("chunk", [3, 10])
def test_small_chunks_equal_the_visit(spark, chunk):
    nodes, edges = graph(9)
    _, links = frames(spark, nodes, edges)
    known = spark.createDataFrame([(v, v * 7 % 40) for v in nodes], "iid long, place int")
    got = {r.iid for r in G.independent_set(known, links, [F.col("place")], chunk=chunk).collect()}
    assert got == greedy(sorted(nodes, key=lambda v: (v * 7 % 40, v)), edges)


def test_components_leave_their_result_only(spark):
    before = folders(spark)
    G.components(spark.createDataFrame([(k, k + 1) for k in range(60)], "id1 long, id2 long")).count()
    assert sorted(f[:5] for f in folders(spark) - before) == ["edges", "nodes"]


def test_edges_given_twice_count_once(spark):
    ids, links = frames(spark, [1, 2, 3, 4], [(1, 2), (2, 1), (2, 3), (3, 3)])
    assert {r.iid: r.n_unrelated for r in unrelated_counts(ids, links).collect()} == {1: 2, 2: 1, 3: 2, 4: 3}
