"""Readers of the whitespace-delimited text formats and their kin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``parts``: each line's fields at runs of blanks; empty lines are left out."""
    lines = spark.read.text(paths).where("trim(value) <> ''")
    return lines.select(F.split(F.trim("value"), "\\s+").alias("parts"))


def read_positional(spark: SparkSession, paths: str | list[str], columns: dict[str, tuple[int, str]]) -> DataFrame:
    """Columns by index (from 0, or from the end when negative) and type."""
    at = lambda i: F.try_element_at("parts", F.lit(i + 1 if i >= 0 else i))
    return _rows(spark, paths).select(*[at(i).try_cast(t).alias(c) for c, (i, t) in columns.items()])


def read_headed(spark: SparkSession, paths: str | list[str], columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns by header name and type; each file has a header line of its own, in an order of its own.

    A line that holds all the names is a header.  The places of the names, a row a file, join the lines by the file's name; a file without a header stops the job.
    """
    lines = spark.read.text(paths).where("trim(value) <> ''").select(F.split(F.trim("value"), "\\s+").alias("parts"), F.col("_metadata.file_path").alias("file"))
    names = F.array(*(F.lit(n) for n, _ in columns.values()))
    is_header = F.size(F.array_except(names, "parts")) == 0
    places = F.transform(names, lambda n: F.array_position("parts", n).cast("int"))
    heads = lines.where(is_header).groupBy("file").agg(F.min(places).alias("places"), F.count_distinct(places).alias("kinds"))
    body = lines.where(~is_header).join(heads, "file", "left")
    fault = F.when(F.col("places").isNull(), F.raise_error(F.concat(F.lit("no header line in "), "file"))).when(F.col("kinds") > 1, F.raise_error(F.concat(F.lit("unlike header lines in "), "file")))
    body = body.withColumn("places", F.coalesce(fault.cast("array<int>"), "places"))
    return body.select(*[F.try_element_at("parts", F.col("places")[k]).try_cast(t).alias(c) for k, (c, (_, t)) in enumerate(columns.items())])


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """Fid, iid, father, mother, sex, phenotype; "0" parents are null."""
    rows = read_positional(spark, path, {c: (i, t) for i, (c, t) in enumerate([("fid", "string"), ("iid", "string"), ("father", "string"), ("mother", "string"), ("sex", "int"), ("phenotype", "string")])})
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("0")) for c in ("father", "mother")})


def read_king(spark: SparkSession, path: str) -> DataFrame:
    """id1, id2, ibd1seg, ibd2seg, propibd, inftype by header."""
    return read_headed(spark, path, {"id1": ("ID1", "string"), "id2": ("ID2", "string"), "ibd1seg": ("IBD1Seg", "double"), "ibd2seg": ("IBD2Seg", "double"), "propibd": ("PropIBD", "double"), "inftype": ("InfType", "string")})


def read_king_positional(spark: SparkSession, path: str) -> DataFrame:
    """S3: the same pairs by position (1, 3, 6, 7, last); lines whose IBD fields are no numbers, such as the header, are left out."""
    rows = read_positional(spark, path, {"id1": (1, "string"), "id2": (3, "string"), "ibd1seg": (6, "double"), "ibd2seg": (7, "double"), "inftype": (-1, "string")})
    return rows.where("ibd1seg is not null and ibd2seg is not null")


def read_segments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Segments by header, ids as text, many files in one read."""
    return read_headed(spark, paths, {c: (c, t) for c, t in (("id1", "string"), ("id2", "string"), ("id1_haplotype", "int"), ("id2_haplotype", "int"), ("chromosome", "int"), ("start_cm", "double"), ("end_cm", "double"))})


def chromosome_paths(name: str, n: int = 22) -> list[str]:
    """A name with chr1 anywhere in it stands for one file a chromosome, any other for itself."""
    return [name.replace("chr1", f"chr{k}") for k in range(1, n + 1)] if "chr1" in name else [name]


def read_gmap(spark: SparkSession, paths: str | list[str], columns: tuple[int, int, int] = (0, 2, 3), snp: int | None = 1) -> DataFrame:
    """Chrom, snp, cm, bp from chosen column indexes (chromosome, cM, bp)."""
    c, m, b = columns
    want = {"chrom": (c, "int"), "cm": (m, "double"), "bp": (b, "bigint")} | ({"snp": (snp, "string")} if snp is not None else {})
    out = read_positional(spark, paths, want)
    return out if snp is not None else out.withColumn("snp", F.lit(None).cast("string"))


def read_attribute(spark: SparkSession, path: str | None, name: str, kind: str = "string") -> DataFrame:
    """Iid and one attribute (ages, populations); without a path an empty table, so joins give defaults."""
    if path is None:
        return spark.createDataFrame([], f"iid string, {name} {kind}")
    return read_positional(spark, path, {"iid": (0, "string"), name: (1, kind)})


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Chrom, bp."""
    return read_positional(spark, path, {"chrom": (0, "int"), "bp": (1, "bigint")})


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Degree, ibd1, ibd2, pihat."""
    return read_headed(spark, path, {"degree": ("DEGREE", "string"), "ibd1": ("IBD1", "double"), "ibd2": ("IBD2", "double"), "pihat": ("PIHAT", "double")})


def read_po(spark: SparkSession, path: str) -> DataFrame:
    """Parent-offspring pairs with the parent's own age and the strength of the evidence."""
    rows = read_headed(spark, path, {c.lower(): (c, t) for c, t in (("IID1", "string"), ("IID2", "string"), ("AGE1", "double"), ("AGE2", "double"), ("H1", "double"), ("H2", "double"), ("PARENT", "string"), ("CHILD", "string"), ("STRENGTH", "double"), ("METHOD", "string"))})
    age = F.when(F.col("parent") == F.col("iid1"), F.col("age1")).otherwise(F.col("age2"))
    return rows.select("parent", "child", age.alias("parent_age"), "strength", "method", "h1", "h2")


def read_codes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``codes_table`` and ``tree_table`` of a YAML file, after ``check_codes``."""
    from kinfold.operators.hierarchy import tree_table
    from kinfold.operators.pedigree import codes_table

    codes, tree = load_codes(spark, path), load_tree(spark, path)
    check_codes(codes, tree)
    return codes_table(spark, codes), tree_table(spark, tree)


def check_codes(codes: tuple, tree: tuple, root: str = "relatives") -> None:
    """Raise an error where codes and tree don't fit: a name given twice, a node without a way to the root, a loop, a code that is no node, a path that isn't up and then down."""
    names, nodes = [c[0] for c in codes], [n for n, _ in tree]
    for what, some in (("code", names), ("node", nodes)):
        if twice := sorted({n for n in some if some.count(n) > 1}):
            raise ValueError(f"{what} given twice: {', '.join(twice)}")
    above = dict(tree)
    for node in nodes:
        way, at = [node], node
        while at != root:
            if at not in above:
                raise ValueError(f"node without parent: {at}")
            at = above[at]
            if at in way:
                raise ValueError(f"loop: {' > '.join([*way, at])}")
            way.append(at)
    if lost := sorted(set(names) - set(nodes)):
        raise ValueError(f"code that is no node of the tree: {', '.join(lost)}")
    for name, ways, *_ in codes:
        for way in (w for some in ways.values() for w in some):
            steps = way.split(",")
            if set(steps) - {"1", "-1"} or steps[0] != "1" or steps != sorted(steps, key=int, reverse=True):
                raise ValueError(f"path of {name} that isn't up and then down: {way}")


def _yaml(spark: SparkSession, path: str) -> dict:
    """A small YAML file, read by Spark so that it may lie in any store; needs the yaml package."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}


def load_codes(spark: SparkSession, path: str) -> tuple:
    """Relationship codes from a YAML file, in the form of ``CODES`` (nodes without paths are left out): name, paths by the parent they start with, sex-specific, degree, node above."""
    text = lambda way: ",".join(map(str, way))
    return tuple((name, {k: [text(w) for w in c[k]] for k in (1, 2) if k in c}, bool(c.get("sex")), c["degree"], c.get("parent")) for name, c in _yaml(spark, path).items() if 1 in c or 2 in c)


def load_tree(spark: SparkSession, path: str, root: str = "relatives") -> tuple:
    """The tree of relationships from a YAML file, in the form of ``TREE``: each name under its parent or else its degree, and degrees under the root."""
    said = {name: c.get("parent") or c["degree"] for name, c in _yaml(spark, path).items()}
    tops = dict.fromkeys(above for above in said.values() if above not in said and above != root)
    return (*said.items(), *((name, root) for name in tops))


def read_segment_table(spark: SparkSession, path: str) -> DataFrame:
    """Segments kept as Parquet."""
    return spark.read.parquet(path)


def vcf_samples(spark: SparkSession, path: str) -> DataFrame:
    """``idx, iid`` of the samples named in the header line."""
    head = spark.read.text(path).where("value like '#CHROM%'")
    parts = F.split("value", "\t")
    return head.select(F.posexplode(F.slice(parts, F.lit(10), F.greatest(F.size(parts) - 9, F.lit(0)))).alias("idx", "iid"))


def with_sample_ids(segments: DataFrame, samples: DataFrame) -> DataFrame:
    """Segments whose id1 and id2 are column indexes get the samples' ids."""
    name = lambda k: samples.select(F.col("idx").alias(f"id{k}"), F.col("iid").alias(f"name{k}"))
    return segments.join(name(1), "id1").join(name(2), "id2").withColumns({"id1": F.col("name1"), "id2": F.col("name2")}).select(*segments.columns)


def read_vcf_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``."""
    return spark.read.text(path).withColumnRenamed("value", "line")
