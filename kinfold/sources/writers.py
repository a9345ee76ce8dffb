"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_readable(labels: DataFrame, path: str, with_h: bool = False) -> None:
    """Tab-separated labels with a header."""
    cols = ["id1", "id2", "k_ibd1", "k_ibd2", "most_probable", "probability", "degree", *(["h1", "h2"] if with_h else [])]
    labels.select(*cols).write.option("sep", "\t").option("header", True).csv(path)


def write_ids(ids: DataFrame, path: str, summary: DataFrame | None = None) -> None:
    """One id a line, and the summary as JSON beside it."""
    ids.select(F.col("iid").cast("string")).write.text(path)
    if summary is not None:
        summary.write.json(f"{path}-summary")


def write_fam(fam: DataFrame, path: str) -> None:
    """Fid iid father mother sex phenotype, blanks between, 0 for null."""
    text = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in fam.columns else F.lit(d)
    fam.select(F.concat_ws(" ", text("fid", "0"), text("iid", "0"), text("father", "0"), text("mother", "0"), text("sex", "0"), text("phenotype", "-9"))).write.text(path)


def write_map(sites: DataFrame, path: str) -> None:
    """Chrom snp cM bp of the sites kept, NA for null."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA"))
    kept = sites.where("keep") if "keep" in sites.columns else sites
    kept.select(F.concat_ws(" ", text("chrom"), text("snp"), text("cm"), text("bp"))).write.text(path)


def write_report(report: DataFrame, path: str) -> None:
    """Quality reports, one folder a kind."""
    report.write.partitionBy("kind").option("sep", "\t").csv(path)


def write_codes(spark: SparkSession, path: str, codes, tree=None) -> None:
    """Relationship codes as a YAML file that ``load_codes`` and ``load_tree`` read; with ``tree`` each code under its node there, and the tree's other nodes."""
    above, lines = dict(tree or ()), []
    for name, ways, sexed, degree, parent in codes:
        lines.append(f"{name}:")
        lines += [f"  {sex}: [{', '.join('[' + way.replace(',', ', ') + ']' for way in some)}]" for sex, some in ways.items()]
        lines += [f"  sex: {str(sexed).lower()}", f"  degree: {degree}"]
        parent = above.get(name, parent or degree)
        lines += [f"  parent: {parent}"] if parent != degree else []
    names, tops = {c[0] for c in codes}, {n for n, a in above.items() if a not in above}
    for node, parent in above.items():
        if node not in names | tops:
            degree = parent
            while degree not in tops:
                degree = above[degree]
            lines += [f"{node}:", f"  degree: {degree}", *([f"  parent: {parent}"] if parent != degree else [])]
    # One file of a few lines.
    spark.createDataFrame([("\n".join(lines) + "\n",)], "value string").coalesce(1).write.text(path)


def write_model(model: DataFrame, path: str) -> None:
    """Parameters of a model, or results."""
    model.write.parquet(path)


def write_segments(segments: DataFrame, path: str, by: str = "pop") -> None:
    """Segments as Parquet by population."""
    segments.write.partitionBy(by).parquet(path)
