"""Relatedness tables derived from the star-schema tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW = ("customer", "lineitem", "part")

VIEWS: dict[str, str] = {
    "fam": """SELECT CAST(c_custkey AS BIGINT) AS iid, CAST(floor(c_custkey / 24.0) AS BIGINT) AS fid,
       CAST(CASE WHEN f >= 0 THEN c_custkey - j + f END AS BIGINT) AS father,
       CAST(CASE WHEN m >= 0 THEN c_custkey - j + m END AS BIGINT) AS mother, sex
FROM customer JOIN (VALUES (0,-1,-1,1),(1,-1,-1,2),(2,-1,-1,1),(3,-1,-1,2),(4,2,3,2),(5,-1,-1,1),
  (6,0,1,1),(7,0,1,2),(8,2,3,2),(9,2,3,1),(10,-1,-1,2),(11,-1,-1,1),(12,6,8,1),(13,6,8,2),(14,6,10,1),
  (15,11,7,2),(16,9,7,1),(17,-1,-1,2),(18,-1,-1,1),(19,12,17,2),(20,18,13,1),(21,18,13,2),(22,6,4,1),
  (23,14,17,2)) AS t(j,f,m,sex) ON c_custkey % 24 = j""",
    "people": """SELECT CAST(c_custkey AS BIGINT) AS iid, c_mktsegment AS popl,
       20 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 60 AS age FROM customer""",
    "king": """SELECT a.iid AS id1, b.iid AS id2, ((a.iid*31 + b.iid*17) % 100) / 100.0e0 AS ibd1seg,
       ((a.iid*13 + b.iid*7) % 25) / 100.0e0 AS ibd2seg
FROM fam a JOIN fam b ON a.fid = b.fid AND a.iid < b.iid""",
    "king_typed": """SELECT *, ibd1seg/2 + ibd2seg AS propibd, CASE WHEN ibd1seg/2 + ibd2seg > 0.70 THEN 'Dup/MZ'
  WHEN ibd2seg > 0.2 THEN 'FS' WHEN ibd1seg > 0.9 THEN 'PO' WHEN ibd1seg/2 + ibd2seg > 0.35 THEN '2nd'
  WHEN ibd1seg/2 + ibd2seg > 0.18 THEN '3rd' WHEN ibd1seg/2 + ibd2seg > 0.09 THEN '4th' ELSE 'UN' END AS inftype
FROM king""",
    "segments": """SELECT CASE WHEN a < b THEN a ELSE b END AS id1, CASE WHEN a < b THEN b ELSE a END AS id2, chromosome,
       h1 AS id1_haplotype, h2 AS id2_haplotype, start_cm, start_cm + len AS end_cm
FROM (SELECT blk*24 + l_partkey % 24 AS a, blk*24 + (l_partkey + 1 + l_suppkey % 3) % 24 AS b,
             1 + l_linenumber % 4 AS chromosome,
             CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS h1, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS h2,
             CAST((l_orderkey*7 + l_linenumber*13) % 60 AS DOUBLE) AS start_cm, l_quantity / 4 AS len
      FROM (SELECT *, l_orderkey % (SELECT CAST(floor(count(*) / 24.0) AS BIGINT) FROM customer) AS blk FROM lineitem) x) y""",
    "gmap": """SELECT 1 + p_partkey % 4 AS chrom, p_partkey*1000 AS bp, p_partkey*0.25e0 + (p_size % 2)*0.125e0 AS cm FROM part""",
    "sites": """SELECT DISTINCT 1 + l_partkey % 4 AS chrom, CAST(l_partkey*1000 + l_quantity*37 AS BIGINT) AS bp FROM lineitem""",
    "po": """SELECT parent, child FROM (SELECT father AS parent, iid AS child FROM fam UNION ALL SELECT mother, iid FROM fam) e WHERE parent IS NOT NULL""",
    "king_sibs": """SELECT a.iid AS id1, b.iid AS id2, CASE WHEN a.father = b.father AND a.mother = b.mother THEN 0.45e0 ELSE 0.40e0 END + ((a.iid*31 + b.iid*17) % 20) / 100.0e0 AS ibd1seg,
       CASE WHEN a.father = b.father AND a.mother = b.mother THEN 0.20e0 + ((a.iid*13 + b.iid*7) % 10) / 100.0e0 ELSE ((a.iid*13 + b.iid*7) % 5) / 100.0e0 END AS ibd2seg
FROM fam a JOIN fam b ON a.fid = b.fid AND a.iid < b.iid""",
    "po_lacking": """SELECT parent, child FROM po WHERE parent % 24 NOT IN (1, 3, 13)""",
    "king_turned": """SELECT CASE WHEN (id1 * 31 + id2 * 17) % 3 = 0 THEN id2 ELSE id1 END AS id1, CASE WHEN (id1 * 31 + id2 * 17) % 3 = 0 THEN id1 ELSE id2 END AS id2,
       ibd1seg, ibd2seg, propibd, inftype FROM king_typed""",
    "segments_turned": """SELECT CASE WHEN t THEN id2 ELSE id1 END AS id1, CASE WHEN t THEN id1 ELSE id2 END AS id2, chromosome,
       CASE WHEN t THEN id2_haplotype ELSE id1_haplotype END AS id1_haplotype, CASE WHEN t THEN id1_haplotype ELSE id2_haplotype END AS id2_haplotype, start_cm, end_cm
FROM (SELECT *, CAST(start_cm AS BIGINT) % 2 = 1 AS t FROM segments) s""",
    "founders": """SELECT fid, iid FROM fam WHERE father IS NULL AND mother IS NULL""",
    "po_file": """SELECT p.parent, p.child, a.age AS parent_age, b.age AS child_age, CAST(a.age - b.age AS DOUBLE) AS strength, 'AGE' AS method,
       coalesce(k.ibd1seg, 0.5e0) AS h1, 1 - coalesce(k.ibd1seg, 0.5e0) AS h2
FROM po p JOIN people a ON a.iid = p.parent JOIN people b ON b.iid = p.child
LEFT JOIN king k ON k.id1 = least(p.parent, p.child) AND k.id2 = greatest(p.parent, p.child)""",
    "pairs_file": """SELECT id1, id2, inftype AS degree, ibd1seg AS ibd1, ibd2seg AS ibd2, propibd AS pihat FROM king_typed""",
    "vcf_lines": """SELECT CAST(l_orderkey AS BIGINT) AS pos, l_linenumber AS nr,
       CASE WHEN l_partkey % 50 = 0 THEN concat('#', l_partkey) ELSE concat(CASE WHEN l_orderkey % 5 = 0 THEN '.' ELSE CAST(l_linenumber % 2 AS VARCHAR(1)) END, '|',
       CASE WHEN l_partkey % 5 = 0 THEN '.' ELSE CAST(l_suppkey % 2 AS VARCHAR(1)) END) END AS line FROM lineitem""",
}

#: Views that a view reads.
NEEDS = {"king_sibs": ("fam",), "po_lacking": ("fam", "po"), "founders": ("fam",), "king": ("fam",), "king_typed": ("fam", "king"), "king_turned": ("fam", "king", "king_typed"), "segments_turned": ("segments",), "po": ("fam",), "po_file": ("fam", "people", "king", "po"), "pairs_file": ("fam", "king", "king_typed")}


def with_views(*names: str) -> str:
    """A WITH list that defines the views and those they read, in order."""
    wanted = {n for name in names for n in (*NEEDS.get(name, ()), name)}
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in wanted)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables of a folder."""
    for raw in RAW:
        spark.read.parquet(f"{sf_dir}/{raw}.parquet").createOrReplaceTempView(raw)
    return spark.sql(f"WITH {with_views(name)} SELECT * FROM {name}")
