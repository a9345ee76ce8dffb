"""Probabilities over the tree of relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

ROOT = "relatives"
# Nodes of the tree in file order with the node above each; degrees hang on the root.
TREE = (
    ("FS", ROOT), ("PO", ROOT), ("PHS", "HS"), ("MHS", "HS"), ("HS", "2nd"), ("GPAV", "2nd"), ("AV", "GPAV"), ("HAV", "3rd"), ("GP", "GPAV"),
    ("PGP", "GP"), ("MGP", "GP"), ("GGP", "3rd"), ("DCO", "3rd+"), ("HSCO", "2nd+"), ("HSHCO", "2nd+"), ("CO", "3rd"), ("HCO", "4th"), ("DHCO", "4th+"), ("DHAV", "3rd+"), ("COHCO", "3rd+"),
    ("2nd", ROOT), ("3rd", ROOT), ("2nd+", ROOT), ("3rd+", ROOT), ("4th", ROOT), ("4th+", ROOT),
)
#: Sums of children, innermost first.
SUMS = (("GP", ("PGP", "MGP")), ("HS", ("PHS", "MHS")), ("GPAV", ("GP", "AV")))
PAIR = ["id1", "id2"]


def tree_table(spark: SparkSession, tree=TREE) -> DataFrame:
    """K7: ``node, parent, depth, degree, level``; a degree is the node under the root, a level the height above the deepest leaf below."""
    above = dict(tree)

    def path(node: str) -> list[str]:
        return [node, *path(above[node])] if node in above else [node]

    height = {n: 0 for n in above}
    for n in above:
        for h, a in enumerate(path(n)[:-1]):
            height[a] = max(height[a], h)
    rows = [(n, above[n], len(path(n)) - 1, path(n)[-2], height[n]) for n in above]
    return spark.createDataFrame(rows, "node string, parent string, depth int, degree string, level int")


def closure(spark: SparkSession, tree=TREE) -> DataFrame:
    """``ancestor, node``: every node under every other and itself."""
    above, rows = dict(tree), []
    for node in above:
        at = node
        rows.append((node, node))
        while at in above:
            at = above[at]
            rows.append((at, node))
    return spark.createDataFrame(rows, "ancestor string, node string")


def set_probs(probs: DataFrame, new: DataFrame, method: str) -> DataFrame:
    """Conditional probabilities (id1, id2, node, p_con) put in under a method's name; the newer one wins."""
    both = probs.withColumn("turn", F.lit(0)).unionByName(new.withColumns({"method": F.lit(method), "turn": F.lit(1)}))
    return both.groupBy(*PAIR, "node").agg(F.max_by("p_con", "turn").alias("p_con"), F.max_by("method", "turn").alias("method"))


def sum_children(probs: DataFrame, sums=SUMS) -> DataFrame:
    """Adds rows of the nodes that are sums of others, innermost first, in one aggregate per pair."""
    value = {}
    for name, parts in sums:
        value[name] = sum((value.get(p, F.coalesce(F.sum(F.when(F.col("node") == p, F.col("p_con"))), F.lit(0.0))) for p in parts), F.lit(0.0))
    wide = probs.groupBy(*PAIR).agg(*[v.alias(n) for n, v in value.items()])
    extra = wide.unpivot(PAIR, list(value), "node", "p_con")
    return probs.select(*PAIR, "node", "p_con").where(~F.col("node").isin(*value)).unionByName(extra)


def cascade(probs: DataFrame, tree: DataFrame) -> DataFrame:
    """``p`` from root to leaf: the share among the siblings given, times the parent's p, for a tree of any depth.

    NaN and null count as 0 in the sum; a zero sum leaves its nodes at 0.  A node whose parent has no row gets null.
    """
    return unpacked(cascaded(probs, tree), tree)


def _ordered(tree: DataFrame) -> list[Row]:
    """The tree's nodes in order of their depth; they are the columns' numbers."""
    return sorted(tree.collect(), key=lambda r: (r.depth, r.node))  # a few dozen


def cascaded(probs: DataFrame, tree: DataFrame) -> DataFrame:
    """K9: a row a pair; ``con`` and ``p`` have a field ``n0, n1, ...`` for each node of the tree in order of its depth, null where a node isn't given.

    One aggregate puts a pair's nodes side by side.  The tree is folded level by level: each is one projection on the products made so far,
    so nothing is exploded, sorted or shuffled again, and every step is compiled.
    """
    nodes, below = _ordered(tree), {}
    number = {r.node: k for k, r in enumerate(nodes)}
    for r in nodes:
        below.setdefault(r.parent, []).append(number[r.node])
    value = F.when(F.col("p_con").isNull() | F.isnan("p_con"), 0.0).otherwise(F.col("p_con"))
    wide = probs.groupBy(*PAIR).agg(*(F.max(F.when(F.col("node") == r.node, value)).alias(f"c{k}") for k, r in enumerate(nodes)))
    total = lambda parent: sum((F.coalesce(f"c{k}", F.lit(0.0)) for k in below[parent]), F.lit(0.0))
    for depth in sorted({r.depth for r in nodes}):
        level = [r for r in nodes if r.depth == depth]
        wide = wide.withColumns({f"t{number[r.node]}": total(r.parent) for r in level if number[r.node] == below[r.parent][0]})
        share = lambda r: F.when(F.col(f"c{number[r.node]}").isNotNull(), F.coalesce(F.try_divide(f"c{number[r.node]}", f"t{below[r.parent][0]}"), F.lit(0.0)))
        above = lambda r: F.lit(1.0) if r.parent == ROOT else F.col(f"p{number[r.parent]}")
        wide = wide.withColumns({f"p{number[r.node]}": share(r) * above(r) for r in level})
    fields = lambda c: F.struct(*(F.col(f"{c}{k}").alias(f"n{k}") for k in range(len(nodes))))
    return wide.select(*PAIR, fields("c").alias("con"), fields("p").alias("p"))


def unpacked(packed: DataFrame, tree: DataFrame) -> DataFrame:
    """``id1, id2, node, p_con, p``: a row for each node of ``cascaded`` that is given."""
    rows = [F.when(F.col(f"con.n{k}").isNotNull(), F.struct(F.lit(r.node).alias("node"), F.col(f"con.n{k}").alias("p_con"), F.col(f"p.n{k}").alias("p"))) for k, r in enumerate(_ordered(tree))]
    return packed.select(*PAIR, F.inline(F.array_compact(F.array(*rows))))


def most_probable(probs: DataFrame, tree: DataFrame, min_p: float = 0.5, digits: int | None = None) -> DataFrame:
    """``most_probable, probability, degree`` per pair, from rows of ``cascade`` or from ``cascaded``, where the best is picked in the row.

    The best degree; if its p reaches ``min_p``, the best node of its lowest level where some p exceeds ``min_p``.  Ties go to the first name, with ``digits`` those
    of p rounded to so many.  Where no p exceeds ``min_p``, the degree itself; a pair without any p has no row.
    """
    nodes = _ordered(tree)
    if "con" not in probs.columns:
        wide = probs.groupBy(*PAIR).agg(*(F.max(F.when(F.col("node") == r.node, F.col("p"))).alias(f"p{k}") for k, r in enumerate(nodes)))
    else:
        wide = probs.select(*PAIR, *(F.col(f"p.n{k}").alias(f"p{k}") for k in range(len(nodes))))
    if digits is not None:
        wide = wide.select(*PAIR, *(F.round(f"p{k}", digits).alias(f"p{k}") for k in range(len(nodes))))
    # The least of such structs has the largest p and then the first name.
    best = lambda some: F.least(*some) if len(some) > 1 else some[0]
    p = lambda k: F.col(f"p{k}")
    tops = [F.when(p(k).isNotNull(), F.struct((-p(k)).alias("low"), F.lit(r.node).alias("node"))) for k, r in enumerate(nodes) if r.depth == 1]
    wide = wide.withColumn("top", best(tops)).where("top is not null")
    wide = wide.withColumns({"degree": F.col("top.node"), "top_p": -F.col("top.low")})
    fits = lambda k, r: F.when((p(k) > min_p) & (F.col("degree") == r.degree), F.struct(F.lit(r.level).alias("level"), (-p(k)).alias("low"), F.lit(r.node).alias("node")))
    wide = wide.withColumn("found", F.when(F.col("top_p") >= min_p, best([fits(k, r) for k, r in enumerate(nodes)])))
    return wide.select(*PAIR, F.coalesce("found.node", "degree").alias("most_probable"), F.coalesce(-F.col("found.low"), F.col("top_p")).alias("probability"), "degree")


def most_likely_among(probs: DataFrame, nodes: list[str]) -> DataFrame:
    """O2: the likeliest of the given nodes per pair, the first listed on ties."""
    place = F.array_position(F.array(*map(F.lit, nodes)), F.col("node"))
    return probs.where(F.col("node").isin(*nodes)).groupBy(*PAIR).agg(F.max_by("node", F.struct("p", -place)).alias("node"), F.max("p").alias("p"))


def pairs_under(known: DataFrame, closed: DataFrame, nodes: list[str]) -> DataFrame:
    """Known pairs below each of the nodes, with the node asked for."""
    below = F.broadcast(closed.where(F.col("ancestor").isin(*nodes)).select(F.col("ancestor").alias("requested"), F.col("node").alias("rel")))  # the tree
    return known.join(below, "rel")
