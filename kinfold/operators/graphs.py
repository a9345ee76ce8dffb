"""Graph operators over edge tables, in rounds.

Components need rounds in the logarithm of the longest way.  A visit in a strict order is done chunk by chunk: consecutive places of whole families, or of parts of a large
one, are visited in one task, so a family needs one round and a chain as many as the chunks it runs through.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.canonical import one_a_pair
from kinfold.plans.lineage import Rounds, stored

#: People of one chunk of a visit.
CHUNK = 100_000


def _mark(edges: DataFrame) -> tuple:
    """Count and content mark of a set of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "id1", b: str = "id2", max_rounds: int = 60) -> DataFrame:
    """Connected components (G17): ``node, component`` for every node of an edge, component = smallest node.

    Alternates two star contractions: every node links its larger neighbours to its smallest one,
    then its smaller neighbours and itself.  Both are an aggregate and an equi-join, so a hub is
    combined before the shuffle and split by the skew join.  Edges with a null end are left out; a
    loop gives its node a component of its own.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = stored(ends.select("u").union(ends.select("v")).distinct(), "nodes")
    pairs = ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    rounds, seen = Rounds(), None
    now = rounds.store(pairs, "edges")
    for _ in range(max_rounds):
        if (mark := _mark(now)) == seen:
            break
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = rounds.store(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    rounds.end(now)
    # Every remaining edge is a node and its smallest one.
    return nodes.join(now, nodes["u"] == now["u"], "left").select(nodes["u"].alias("node"), F.coalesce(now["v"], nodes["u"]).alias("component"))


def _visit():
    """A chunk's own visit; made in a function, so that it travels with its code."""

    def visited(key: tuple, people: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        """``iid, taken`` of those of one chunk that its own visit decides; ``blocked`` ones wait for somebody in another chunk, unless a neighbour here was taken."""
        before: dict = {}
        for a, b in zip(links["a"], links["b"], strict=True):
            before.setdefault(a, []).append(b)
        state: dict = {}
        people = people.sort_values("nth")
        for iid, blocked in zip(people["iid"], people["blocked"], strict=True):
            near = [state.get(b) for b in before.get(iid, ())]
            if True in near:
                state[iid] = False
            elif not blocked and None not in near:
                state[iid] = True
        return pd.DataFrame({"iid": list(state), "taken": pd.Series(list(state.values()), dtype="bool")})

    return visited


def independent_set(nodes: DataFrame, edges: DataFrame, order: list[Column], families: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """The set that a visit of all nodes in ``order`` would take, each unless a neighbour is taken.

    Families (components, unless given) don't touch each other, so nodes are range-partitioned by family and place into chunks of some ``chunk`` nodes.  A round visits every
    chunk in a task of its own, as far as no earlier neighbour in another chunk is undecided, and strikes the neighbours of those taken everywhere; for a strict
    order the result is that of the one-by-one visit.
    """
    rounds = Rounds()
    found = families if families is not None else components(edges.where("id1 <> id2"))
    ranked = nodes.select("iid", F.struct(*order, F.col("iid").alias("iid")).alias("place"))
    ranked = stored(ranked.join(found.select(F.col("node").alias("iid"), "component"), "iid", "left").select("iid", "place", F.coalesce("component", "iid").alias("family")), "ranked")
    both = edges.where("id1 <> id2").select(F.col("id1").alias("a"), F.col("id2").alias("b")).union(edges.where("id1 <> id2").select(F.col("id2"), F.col("id1"))).distinct()
    side = lambda k: ranked.select(F.col("iid").alias(k), F.col("place").alias(f"p{k}"))
    # For each node the neighbours that come before it.
    after = rounds.store(both.join(side("a"), "a").join(side("b"), "b").where("pb < pa").select("a", "b"), "before")
    near = after.select(F.explode(F.array("a", "b")).alias("iid")).distinct()
    taken = [stored(ranked.join(near, "iid", "left_anti").select("iid"), "taken")]
    open_ = rounds.store(ranked.join(near, "iid", "left_semi"), "open")
    kind = dict(ranked.dtypes)["iid"]
    while left := open_.count():
        ranges = open_.repartitionByRange(max(1, -(-left // chunk)), "family", "place").withColumn("range", F.spark_partition_id())
        ranges = rounds.store(ranges, "ranges")
        where = lambda k: ranges.select(F.col("iid").alias(k), F.col("range").alias(f"r{k}"))
        links = rounds.store(after.join(where("a"), "a").join(where("b"), "b"), "links")
        waiting = links.where("ra <> rb").select(F.col("a").alias("iid"), F.lit(True).alias("blocked")).distinct()
        nth = F.row_number().over(Window.partitionBy("range").orderBy("family", "place"))
        people = ranges.withColumn("nth", nth).join(waiting, "iid", "left").select("range", "iid", "nth", F.coalesce("blocked", F.lit(False)).alias("blocked"))
        inside = links.where("ra = rb").select(F.col("ra").alias("range"), "a", "b")
        now = rounds.store(people.groupBy("range").cogroup(inside.groupBy("range")).applyInPandas(_visit(), f"iid {kind}, taken boolean"), "visited")
        mine = stored(now.where("taken").select("iid"), "taken")
        taken.append(mine)
        gone = after.join(mine.select(F.col("iid").alias("b")), "b", "left_semi").select(F.col("a").alias("iid"))
        decided = rounds.store(now.select("iid").union(gone).distinct(), "decided")
        open_ = rounds.store(open_.join(decided, "iid", "left_anti"), "open")
        after = rounds.store(after.join(decided.select(F.col("iid").alias("a")), "a", "left_anti").join(decided.select(F.col("iid").alias("b")), "b", "left_anti"), "before")
    rounds.end()
    out = taken[0]
    for more in taken[1:]:
        out = out.union(more)
    return out


def unrelated_set(nodes: DataFrame, edges: DataFrame, seed: int = 0, families: DataFrame | None = None) -> DataFrame:
    """Visit by initial degree, ties by a hash of (seed, id)."""
    degree = one_a_pair(edges.where("id1 <> id2").select("id1", "id2")).select(F.explode(F.array("id1", "id2")).alias("iid")).groupBy("iid").agg(F.count(F.lit(1)).alias("degree"))
    known = nodes.select("iid").join(degree, "iid", "left").fillna(0, ["degree"])
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("iid").cast("string")).cast("binary"))
    return independent_set(known, edges, [F.col("degree"), mark], families)


def best_of_seeds(nodes: DataFrame, edges: DataFrame, seeds: list[int], target: int | None = None) -> DataFrame:
    """The largest of the sets of several seeds, the first on ties; stops early at ``target``."""
    best, most = None, -1
    families = stored(components(edges.where("id1 <> id2")), "families")
    for seed in seeds:
        found = stored(unrelated_set(nodes, edges, seed, families), "set")
        if (size := found.count()) > most:
            best, most = found, size
        if target is not None and most >= target:
            break
    return best


def ranked_independent_set(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """Start from the one with the most unrelated others and grow in that order; ties go to the larger id, text ids compared character by character, a longer one over its beginning."""
    # Of two texts the larger has the smaller negated codes at the first difference; an end is larger than any of them.
    text = dict(counts.dtypes)["iid"] == "string"
    back = F.concat(F.transform(F.filter(F.split("iid", ""), lambda c: c != ""), lambda c: -F.ascii(c)), F.array(F.lit(0))) if text else -F.col("iid")
    return independent_set(counts.select("iid", "n_unrelated", back.alias("back")), edges, [-F.col("n_unrelated"), F.col("back")])


def two_colour(edges: DataFrame, a: str = "id1", b: str = "id2", max_rounds: int = 60) -> DataFrame:
    """``node, component, colour, conflict``: parity of the distance to the component's smallest node.

    Every node is doubled into an even and an odd copy and every edge joins copies of different parity.  The components of the
    doubled graph then tell the parity; an odd cycle puts both copies of a node into one.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    doubled = ends.select(F.inline(F.array(*[F.struct(F.struct("u", F.lit(s).alias("s")).alias("id1"), F.struct(F.col("v").alias("u"), F.lit(1 - s).alias("s")).alias("id2")) for s in (0, 1)])))
    found = stored(components(doubled, max_rounds=max_rounds), "colours")
    flat = found.select(F.col("node.u").alias("node"), F.col("node.s").alias("s"), F.col("component.u").alias("root"), F.col("component.s").alias("root_s"))
    # The even copy of the component's smallest node leads; the copy of a node that follows it has the node's colour.
    same = F.max(F.when(F.col("root_s") == 0, F.col("s")))
    return flat.groupBy("node").agg(F.min("root").alias("component"), F.min(F.when(F.col("root_s") == 0, F.col("s"))).alias("colour"), (F.count_distinct("root", "root_s") == 1).alias("conflict"), same.alias("top")).select("node", "component", F.coalesce("colour", F.lit(0)).alias("colour"), "conflict")
