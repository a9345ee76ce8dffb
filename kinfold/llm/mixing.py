"""Mixing sources to target weights by iterative proportional fitting.

Token counts per (source, language, topic) cell are raked to target marginals of each of the three; a document
is then sampled with its cell's rate: raked weight over tokens, scaled so that the largest rate is 1.  The counts are combined before they are shuffled;
cells and factors are tables throughout and every fitting step is an equi-join and an aggregate.  Words are counted once for each text, in the cells' pass; the sampling
pass counts those of the sampled texts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stored

DIMS = ("source", "lang", "topic")
#: Topics by the first rule that a text meets: one of some strings, or a pattern that is only tried where a text holds the string before it.
TOPICS = (("licence", ("License", "LICENSE", "Copyright", "copyright"), None), ("contact", ("@",), "[a-z0-9]@[a-z0-9]"), ("markup", ("***", "###", "%%%", "$$$", "&&&"), None))
NONE, OTHER = "(none)", "prose"
#: Default target of a share s of the tokens: s to this power, normalised.
TEMPER = 0.9
CYCLES = 12
#: Tasks that end a step over the cells and over one dimension's values: both tables are combined already and small beside the documents.
CELL_TASKS, VALUE_TASKS = 32, 4
HEX_DIGITS = 13
#: White space between words.
BLANK = "[\\x20\\x09-\\x0D]"


def topic(rules=TOPICS) -> Column:
    """The name of the first rule that ``text`` meets."""
    text, out = F.coalesce("text", F.lit("")), F.lit(OTHER)
    for name, strings, pattern in reversed(rules):
        met = F.lit(False)
        for x in strings:
            met = met | F.contains(text, F.lit(x))
        out = F.when(met if pattern is None else met & text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def n_words() -> Column:
    """Runs of other characters than white space in ``text``."""
    return F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BLANK), "")).cast("bigint")


def celled(docs: DataFrame, topics: Column | None = None) -> DataFrame:
    """The rows with the cell columns ``__source``, ``__lang`` and ``__topic``, and ``__any``: does the text hold a word?"""
    some = F.coalesce("text", F.lit("")).rlike(f"[^{BLANK[1:]}")
    return docs.withColumns({"__source": F.coalesce("source", F.lit(NONE)), "__lang": F.coalesce("lang", F.lit(NONE)), "__topic": topics if topics is not None else topic(), "__any": some})


def tempered(cells: DataFrame, dim: str, power: float = TEMPER) -> DataFrame:
    """``dim, target``: the dimension's token shares to a power, normalised to 1."""
    sums = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("t"))
    total = sums.agg(F.sum("t")).first()[0]
    return sums.select(dim, (F.col("t") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], cycles: int = CYCLES) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``w``, fitted to the target shares of each dimension in turn, ``cycles`` times.

    A fitted weight is the cell's tokens times one factor for each dimension, so the cells stay as they are and a step gives a dimension's new factors: its
    targets over its sums under the other dimensions' factors, combined before they are shuffled.
    """
    goals = {d: stored(t.select(d, "target").coalesce(VALUE_TASKS), "target") for d, t in targets.items()}
    factors: dict[str, DataFrame] = {}

    def weighed(dims: list[str]) -> DataFrame:
        rows, w = cells, F.col("tokens").cast("double")
        for d in dims:
            rows = rows.join(factors[d].withColumnRenamed("f", f"f_{d}"), d, "left")
            w = w * F.coalesce(f"f_{d}", F.lit(0.0))
        return rows.select(*cells.columns, w.alias("w"))

    for _ in range(cycles):
        for dim, goal in goals.items():
            sums = weighed([d for d in factors if d != dim]).groupBy(dim).agg(F.sum("w").alias("s"))
            factor = sums.coalesce(VALUE_TASKS).join(goal, dim).select(dim, F.coalesce(F.try_divide("target", "s"), F.lit(0.0)).alias("f"))
            factors[dim] = stored(factor, "factors")
    return weighed(list(factors))


def unit(seed: int) -> Column:
    """A number in [0, 1) from the seed and doc_id: the first 52 bits of md5."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(mark, 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: int = 11, labels: bool = True, topics: Column | None = None) -> DataFrame:
    """The sampled rows of ``docs``; with ``labels`` also c_source, c_lang, c_topic, c_tokens and rate, replacing columns of these names.

    Targets are tables of shares (``__source``, ``__lang`` or ``__topic``, and ``target``) by dimension, by default the tempered shares; ``topics`` is a column
    of topics, by default that of ``topic``.  Null labels form a class of their own.
    Texts without words, null ones among them, have rate 1 and stay, as they carry no tokens; long texts count in full.  Rows with one doc_id share their draw.  A cell whose target
    is missing has rate 0.  An empty table gives an empty table.
    """
    rows = celled(docs, topics)
    dims = [f"__{d}" for d in DIMS]
    cells = stored(rows.where("__any").groupBy(*dims).agg(F.sum(n_words()).alias("tokens")).coalesce(CELL_TASKS), "cells")
    if targets is None:
        targets = {d: tempered(cells, d) for d in dims}
    fitted = rake(cells, targets).withColumn("ratio", F.col("w") / F.col("tokens"))
    top = fitted.agg(F.max("ratio")).first()[0]
    rates = stored(fitted.select(*dims, (F.col("ratio") / F.lit(top or 1.0)).alias("__rate")), "rates")
    # Spark broadcasts the rates while their table is small and shuffles beyond.
    joined = rows.join(rates, dims, "left").withColumn("__rate", F.when(~F.col("__any"), 1.0).otherwise(F.coalesce("__rate", F.lit(0.0))))
    kept = joined.where(unit(seed) < F.col("__rate"))
    if not labels:
        return kept.select(*docs.columns)
    kept = kept.withColumn("__tokens", n_words())
    made = {f"c_{d}": f"__{d}" for d in (*DIMS, "tokens")} | {"rate": "__rate"}
    return kept.select(*[c for c in docs.columns if c not in made], *[F.col(v).alias(k) for k, v in made.items()])
