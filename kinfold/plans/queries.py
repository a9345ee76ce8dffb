"""The registered queries over the fixture views, and SQL written on its own for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import assembly as A
from kinfold.operators import canonical as C
from kinfold.operators import genmap as M
from kinfold.operators import graphs as G
from kinfold.operators import hierarchy as H
from kinfold.operators import models as L
from kinfold.operators import pairs as P
from kinfold.operators import pedigree as K
from kinfold.operators import segments as S
from kinfold.operators import siblings as B
from kinfold.plans import label as J
from kinfold.plans.lineage import scratch, stored
from kinfold.sources import readers as R
from kinfold.sources import writers as W
from kinfold.sources.fixtures import fixture, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

GENOME_CM = 3545.0
PAIR = ["id1", "id2"]
RELATED = "propibd > 0.1 or ibd2seg > 0.03"
CLOSE = "inftype in ('Dup/MZ', 'FS', 'PO')"


def query(views: str = "", sql: str | None = None):
    """Register a query that takes the named views; ``sql`` is the rest of a WITH list and the final SELECT."""

    def keep(f):
        names = views.split()
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[fixture(spark, sf_dir, v) for v in names])
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {with_views(*names)}\n{sql}"
        return f

    return keep


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Doubles to some digits, minus zero as zero."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


# --- segments ---------------------------------------------------------------------------------------------------------

REGIONS = """, real_ AS (SELECT * FROM segments WHERE end_cm > start_cm),
cuts AS (SELECT id1, id2, chromosome, start_cm AS p FROM real_ UNION SELECT id1, id2, chromosome, end_cm FROM real_),
gaps AS (SELECT *, lead(p) OVER (PARTITION BY id1, id2, chromosome ORDER BY p) AS q FROM cuts),
regions AS (SELECT g.id1, g.id2, g.chromosome, p AS start_cm, q AS end_cm,
    CAST(count(*) FILTER (id1_haplotype = 0) AS INT) AS c1, CAST(count(*) FILTER (id1_haplotype = 1) AS INT) AS c2,
    CAST(count(*) FILTER (id2_haplotype = 0) AS INT) AS c3, CAST(count(*) FILTER (id2_haplotype = 1) AS INT) AS c4
  FROM gaps g JOIN real_ s ON s.id1 = g.id1 AND s.id2 = g.id2 AND s.chromosome = g.chromosome AND s.start_cm <= p AND s.end_cm >= q
  GROUP BY ALL)"""
ISLANDS = """, flagged AS (SELECT *, CASE WHEN start_cm - max(end_cm) OVER (PARTITION BY id1, id2, chromosome ORDER BY start_cm, end_cm
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 1 THEN 0 ELSE 1 END AS fresh FROM segments),
counts AS (SELECT id1, id2, CAST(sum(fresh) AS BIGINT) AS n FROM flagged GROUP BY id1, id2)"""
SHARING = """, sharing AS (SELECT id1, id2, sum(CASE WHEN least(c1, c2, c3, c4) > 0 THEN 0 ELSE end_cm - start_cm END) AS ibd1_cm,
    sum(CASE WHEN least(c1, c2, c3, c4) > 0 THEN end_cm - start_cm ELSE 0 END) AS ibd2_cm,
    count(*) FILTER (least(c1, c2, c3, c4) = 0) AS n_ibd1, count(*) FILTER (least(c1, c2, c3, c4) > 0) AS n_ibd2 FROM regions GROUP BY id1, id2)"""
SCORES = """, lone AS (SELECT id1, id2, chromosome, sum((end_cm - start_cm) * c1) AS a, sum((end_cm - start_cm) * c2) AS b,
    sum((end_cm - start_cm) * c3) AS c, sum((end_cm - start_cm) * c4) AS d FROM regions WHERE c1 + c2 = 1 GROUP BY ALL),
shares AS (SELECT id1, id2, sum(greatest(a, b)) / sum(a + b) AS r1, sum(greatest(c, d)) / sum(a + b) AS r2 FROM lone GROUP BY id1, id2),
scores AS (SELECT id1, id2, CASE WHEN coalesce(r1, 0) > 0.5 THEN r1 ELSE 1 - coalesce(r1, 0) END AS h1,
    CASE WHEN coalesce(r2, 0) > 0.5 THEN r2 ELSE 1 - coalesce(r2, 0) END AS h2
  FROM (SELECT DISTINCT id1, id2 FROM regions) p LEFT JOIN shares USING (id1, id2))"""
STATS = f"""{REGIONS}{ISLANDS}{SHARING}{SCORES}, stats AS (SELECT c.id1, c.id2, coalesce(ibd1_cm, 0) / {GENOME_CM} AS ibd1, coalesce(ibd2_cm, 0) / {GENOME_CM} AS ibd2,
    coalesce(n_ibd1, 0) AS n_ibd1, coalesce(n_ibd2, 0) AS n_ibd2, n, coalesce(h1, 1) AS h1, coalesce(h2, 1) AS h2
  FROM counts c LEFT JOIN sharing USING (id1, id2) LEFT JOIN scores USING (id1, id2))"""
STATS_OUT = "SELECT id1, id2, round(ibd1, 9) AS ibd1, round(ibd2, 9) AS ibd2, n_ibd1, n_ibd2, n, round(h1, 6) AS h1, round(h2, 6) AS h2 FROM stats"


@query("segments", f"{REGIONS} SELECT * FROM regions")
def ibd_regions(segments):
    return S.ibd_regions(segments)


@query("segments", f"{REGIONS}{SHARING} SELECT * FROM sharing")
def ibd1_ibd2(segments):
    return S.ibd1_ibd2(S.ibd_regions(segments))


@query("segments", f"{ISLANDS} SELECT * FROM counts")
def segment_count(segments):
    return S.segment_count(segments)


@query("segments", f"{REGIONS}{SCORES} SELECT id1, id2, round(h1, 6) AS h1, round(h2, 6) AS h2 FROM scores")
def h_score(segments):
    return rounded(S.h_score(S.ibd_regions(segments)), "h1", "h2")


@query("segments", f"{REGIONS}, lone AS (SELECT id1, id2, (end_cm - start_cm) * c1 AS a, (end_cm - start_cm) * c3 AS c, CASE WHEN c1 + c2 = 1 THEN end_cm - start_cm END AS l FROM regions), "
    "r AS (SELECT id1, id2, coalesce(sum(a) FILTER (l IS NOT NULL) / sum(l), 0) AS r1, coalesce(sum(c) FILTER (l IS NOT NULL) / sum(l), 0) AS r2 FROM lone GROUP BY id1, id2) "
    "SELECT id1, id2, round(CASE WHEN r1 > 0.5 THEN r1 ELSE 1 - r1 END, 6) AS h1, round(CASE WHEN r2 > 0.5 THEN r2 ELSE 1 - r2 END, 6) AS h2 FROM r")  # fmt: skip
def h_score_between_phases(segments):
    return rounded(S.h_score(S.ibd_regions(segments), inter_phase=True), "h1", "h2")


@query("segments", f"{STATS} {STATS_OUT}")
def pair_stats(segments):
    return rounded(rounded(S.pair_stats(segments, GENOME_CM), "h1", "h2"), "ibd1", "ibd2", digits=9)


@query("segments", ", sites_ AS (SELECT id1, id2, chromosome, id1_haplotype AS a, id2_haplotype AS b, unnest(range(CAST(ceil(start_cm) AS BIGINT), CAST(floor(end_cm) AS BIGINT) + 1)) AS site FROM segments), "
    "slots AS (SELECT DISTINCT id1, id2, chromosome, site, a AS slot FROM sites_ UNION SELECT DISTINCT id1, id2, chromosome, site, b + 2 FROM sites_), "
    "k AS (SELECT id1, id2, chromosome, site, count(*) AS k FROM slots GROUP BY ALL) "
    "SELECT id1, id2, count(*) FILTER (k < 4) AS ibd1_sites, count(*) FILTER (k = 4) AS ibd2_sites FROM k GROUP BY id1, id2")  # fmt: skip
def quick_kinship(segments):
    return S.site_kinship(segments)


@query("segments", f"{ISLANDS}, isles AS (SELECT id1, id2, chromosome, start_cm, end_cm, sum(fresh) OVER (PARTITION BY id1, id2, chromosome ORDER BY start_cm, end_cm ROWS UNBOUNDED PRECEDING) AS i FROM flagged), "
    "spans AS (SELECT id1, id2, chromosome, i, max(end_cm) - min(start_cm) AS l FROM isles GROUP BY ALL), "
    "per AS (SELECT id1, id2, count(*) AS n_segs, sum(l) AS tot_cov FROM spans GROUP BY id1, id2), "
    "haps AS (SELECT id1, id2, chromosome, sum(end_cm - start_cm) AS t, sum((end_cm - start_cm) * id1_haplotype) AS a, sum((end_cm - start_cm) * id2_haplotype) AS b FROM segments GROUP BY ALL) "
    "SELECT id1, id2, n_segs, tot_cov, tot_all, hap1, hap2 FROM per JOIN (SELECT id1, id2, sum(t) AS tot_all, sum(greatest(a, t - a)) AS hap1, sum(greatest(b, t - b)) AS hap2 FROM haps GROUP BY id1, id2) h USING (id1, id2)")  # fmt: skip
def pair_coverage(segments):
    return S.pair_coverage(segments)


@query("segments", ", r AS (SELECT id2 AS id1, id1 AS id2, chromosome, id2_haplotype AS id1_haplotype, 1 - id1_haplotype AS id2_haplotype, start_cm, end_cm FROM segments) "
    "SELECT id2 AS id1, id1 AS id2, chromosome, id2_haplotype AS id1_haplotype, id1_haplotype AS id2_haplotype, start_cm, end_cm FROM r")  # fmt: skip
def canonical_pairs(segments):
    turned = segments.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), "chromosome", F.col("id2_haplotype").alias("id1_haplotype"), (1 - F.col("id1_haplotype")).alias("id2_haplotype"), "start_cm", "end_cm")
    return C.canonical_pairs(turned)


@query("segments king_typed", "SELECT s.*, end_cm - start_cm AS l FROM segments s WHERE end_cm - start_cm >= 2.5 AND EXISTS (SELECT 1 FROM king_typed k WHERE k.id1 = s.id1 AND k.id2 = s.id2 AND propibd >= pow(2, -3.5))")
def close_pair_segments(segments, king):
    return S.segment_length(S.close_pair_segments(segments, king), 2.5)


SWITCHES = """, drawn AS (SELECT id1, id2, chromosome, side, i,
    -ln(1 - ('0x' || substr(md5('7:' || id1 || ':' || id2 || ':' || chromosome || ':' || side || ':' || i), 1, 13))::BIGINT / pow(16, 13)) * 50 AS gap
  FROM (SELECT DISTINCT id1, id2, chromosome FROM segments) s, (SELECT unnest([0, 1]) AS side) a, (SELECT unnest(range(1, 41)) AS i) b),
places AS (SELECT *, sum(gap) OVER (PARTITION BY id1, id2, chromosome, side ORDER BY i) AS cm FROM drawn),
switches AS (SELECT id1, id2, chromosome, side, cm FROM places WHERE cm - gap < 300),
numbered AS (SELECT row_number() OVER () AS seg, * FROM segments),
points AS (SELECT seg, start_cm AS pos_ FROM numbered UNION SELECT n.seg, s.cm FROM numbered n JOIN switches s USING (id1, id2, chromosome) WHERE s.cm BETWEEN n.start_cm AND n.end_cm),
parts AS (SELECT n.*, pos_, coalesce(lead(pos_) OVER (PARTITION BY n.seg ORDER BY pos_), n.end_cm) AS until FROM points p JOIN numbered n USING (seg)),
flips AS (SELECT p.seg, p.id1, p.id2, p.chromosome, p.id1_haplotype, p.id2_haplotype, p.pos_, p.until,
    count(*) FILTER (s.side = 0) AS n1, count(*) FILTER (s.side = 1) AS n2
  FROM parts p LEFT JOIN switches s ON s.id1 = p.id1 AND s.id2 = p.id2 AND s.chromosome = p.chromosome AND s.cm <= p.pos_
  WHERE p.until - p.pos_ >= 2.5 GROUP BY ALL),
split AS (SELECT id1, id2, chromosome, CAST(CASE WHEN n1 % 2 = 1 THEN 1 - id1_haplotype ELSE id1_haplotype END AS INT) AS id1_haplotype,
    CAST(CASE WHEN n2 % 2 = 1 THEN 1 - id2_haplotype ELSE id2_haplotype END AS INT) AS id2_haplotype, pos_ AS start_cm, until AS end_cm, n1, n2 FROM flips)"""


@query("segments", f"{SWITCHES} SELECT id1, id2, chromosome, id1_haplotype, id2_haplotype, round(start_cm, 6) AS start_cm, round(end_cm, 6) AS end_cm, n1, n2 FROM split")
def phase_error_split(segments):
    return rounded(S.phase_error_split(segments, S.switch_arrays(segments, 50.0, 7)), "start_cm", "end_cm")


@query("segments", f"{SWITCHES}{STATS.replace('FROM segments', 'FROM split')} {STATS_OUT}")
def phase_error_stats(segments):
    split = S.phase_error_split(segments, S.switch_arrays(segments, 50.0, 7))
    return rounded(rounded(S.pair_stats(split, GENOME_CM), "h1", "h2"), "ibd1", "ibd2", digits=9)


# --- maps -------------------------------------------------------------------------------------------------------------


@query("gmap", "SELECT chrom, max(cm) - min(cm) AS cm_span, sum(max(cm) - min(cm)) OVER () AS genome_cm FROM gmap GROUP BY chrom")
def genome_length(gmap):
    return M.chrom_lengths(gmap).withColumn("genome_cm", F.lit(M.genome_length(gmap)))


@query("gmap", "SELECT chrom, min(bp) AS first, max(bp) AS last, max(bp) - min(bp) AS span FROM gmap GROUP BY chrom")
def chrom_extents(gmap):
    return M.chrom_extents(gmap, "bp")


INTERPOLATED = """, ends AS (SELECT s.chrom, s.bp, (SELECT max(bp) FROM gmap g WHERE g.chrom = s.chrom AND g.bp <= s.bp) AS lo,
    (SELECT min(bp) FROM gmap g WHERE g.chrom = s.chrom AND g.bp >= s.bp) AS hi FROM sites s),
knots AS (SELECT e.chrom, e.bp, lo, hi, a.cm AS a, b.cm AS b FROM ends e LEFT JOIN gmap a ON a.chrom = e.chrom AND a.bp = lo LEFT JOIN gmap b ON b.chrom = e.chrom AND b.bp = hi)
SELECT chrom, bp, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL OR lo = hi THEN a ELSE a + (bp - lo) * ((b - a) / (hi - lo)) END, 6) AS cm FROM knots"""


@query("sites gmap", INTERPOLATED)
def map_interpolation(sites, gmap):
    return rounded(M.interpolate(sites, gmap), "cm")


@query("sites gmap", "SELECT coalesce(g.chrom, s.chrom) AS chrom, coalesce(g.bp, s.bp) AS bp, g.cm, s.bp IS NOT NULL AS keep FROM gmap g FULL OUTER JOIN sites s ON g.chrom = s.chrom AND g.bp = s.bp")
def map_sites(sites, gmap):
    return M.select_sites(gmap.withColumn("snp", F.col("cm")), sites).withColumnRenamed("snp", "cm")


# --- people and pairs -------------------------------------------------------------------------------------------------


@query("people king_typed", "SELECT * FROM people WHERE iid NOT IN (SELECT id2 FROM king_typed WHERE inftype = 'Dup/MZ')")
def mz_filter(people, king):
    return P.exclude_twins(people, king)


@query("king people", "SELECT k.* FROM king k JOIN people a ON a.iid = k.id1 JOIN people b ON b.iid = k.id2 WHERE a.popl = 'BUILDING' AND b.popl = 'BUILDING'")
def population_pairs(king, people):
    return P.population_subset(king, people, "BUILDING")


@query("fam people", "SELECT f.iid, fid, nullif(father, 0) AS father, nullif(mother, 0) AS mother, sex, coalesce(popl, 'pop1') AS popl, CAST(age AS DOUBLE) AS age FROM fam f LEFT JOIN people p ON p.iid = f.iid")
def person_attributes(fam, people):
    return P.people(fam, people.select("iid", "popl"), people.select("iid", F.col("age").cast("double").alias("age")))


@query("fam", "SELECT parent, string_agg(child, ',' ORDER BY child) AS children FROM (SELECT father AS parent, iid AS child FROM fam UNION ALL SELECT mother, iid FROM fam) e WHERE parent IS NOT NULL GROUP BY parent")
def children(fam):
    return P.children(fam).withColumn("children", F.array_join(F.transform("children", lambda c: c.cast("string")), ","))


@query("king_typed king_turned", "SELECT id1, id2, (id1 % 10) / 10.0e0 AS h1, (id2 % 10) / 10.0e0 AS h2 FROM king_turned")
def pairs_as_given(king, turned):
    """Scores of canonical pairs go back into the order of a table that names a third of the pairs the other way round."""
    score = lambda c: ((F.col(c) % 10) / F.lit(10.0))
    return C.as_given(king.select(*PAIR, score("id1").alias("h1"), score("id2").alias("h2")), turned)


TURNED_LOOKUP = "SELECT p.parent, p.child, coalesce(k.inftype, 'UN') AS inftype, coalesce(k.propibd, 0) AS propibd FROM po p LEFT JOIN king_typed k ON (k.id1 = p.parent AND k.id2 = p.child) OR (k.id1 = p.child AND k.id2 = p.parent)"


@query("po king_typed king_turned", TURNED_LOOKUP)
def pair_lookup_turned(po, king, turned):
    # Every pair is given both ways round.
    return P.lookup_pairs(po, turned.unionByName(king), {"inftype": "UN", "propibd": 0.0}, "parent", "child")


@query("po king_typed", "SELECT p.parent, p.child, coalesce(k.inftype, 'UN') AS inftype, coalesce(k.propibd, 0) AS propibd FROM po p LEFT JOIN king_typed k ON (k.id1 = p.parent AND k.id2 = p.child) OR (k.id1 = p.child AND k.id2 = p.parent)")
def pair_lookup(po, king):
    return P.lookup_pairs(po, king, {"inftype": "UN", "propibd": 0.0}, "parent", "child")


@query("king_typed", f"SELECT id1, id2, round(ibd2seg + ibd1seg / 2, 6) AS kinship, round(ibd1seg + ibd2seg, 6) AS coverage FROM king_typed WHERE {RELATED}")
def related_pairs(king):
    out = P.select_where(king, RELATED)
    return rounded(out.select("id1", "id2", P.kinship().alias("kinship"), P.coverage().alias("coverage")), "kinship", "coverage")


@query("king_typed po", "SELECT k.*, EXISTS (SELECT 1 FROM po p WHERE least(p.parent, p.child) = k.id1 AND greatest(p.parent, p.child) = k.id2) AS given FROM king_typed k")
def pair_subsets(king, po):
    ends = po.select(F.least("parent", "child").alias("id1"), F.greatest("parent", "child").alias("id2"))
    return P.keep_pairs(king, ends).withColumn("given", F.lit(True)).unionByName(P.drop_pairs(king, ends).withColumn("given", F.lit(False)))


@query("people king_typed", f", e AS (SELECT * FROM king_typed WHERE {RELATED}), n AS (SELECT count(*) AS c FROM people) SELECT iid, (SELECT c FROM n) - 1 - (SELECT count(*) FROM e WHERE e.id1 = iid OR e.id2 = iid) AS n_unrelated FROM people")
def unrelated_counts(people, king):
    return P.unrelated_counts(people, P.related_edges(king))


@query("pairs_file", ", m AS (SELECT degree, avg(ibd1) AS mean, stddev_samp(ibd1) AS sd FROM pairs_file GROUP BY degree) SELECT p.* FROM pairs_file p JOIN m USING (degree) WHERE abs(ibd1 - mean) < 2 * sd")
def degree_sd_filter(pairs):
    return P.within_class_sd(P.complete(pairs, ["ibd1", "ibd2", "pihat"]))


@query("pairs_file", "SELECT round(avg(pihat) - 2 * stddev_samp(pihat), 9) AS cut FROM pairs_file WHERE degree = '4th'")
def fifth_degree_cut(pairs):
    return rounded(P.fifth_degree_cut(pairs), "cut", digits=9)


@query("pairs_file", "SELECT degree, round(avg(ibd1), 9) AS mean, round(stddev_samp(ibd1), 9) AS sd, count(*) AS n FROM pairs_file GROUP BY degree")
def class_moments(pairs):
    return rounded(P.class_moments(pairs, "degree", "ibd1"), "mean", "sd", digits=9)


SURE = ", sure AS (SELECT child FROM po_file WHERE strength > 15 GROUP BY child HAVING count(*) = 2)"


@query("king_typed po_file", f"{SURE} SELECT round(coalesce(avg(ibd2seg) - 1.5 * stddev_pop(ibd2seg), 0.18), 9) AS cut FROM king_typed WHERE inftype = 'FS' AND id1 IN (SELECT child FROM sure) AND id2 IN (SELECT child FROM sure)")
def fullsib_cut(king, po):
    return rounded(P.fullsib_cut(king, po), "cut", digits=9)


@query("fam king_typed", "SELECT f.iid, f.father, f.mother, k.inftype FROM fam f JOIN king_typed k ON k.id1 = least(f.father, f.mother) AND k.id2 = greatest(f.father, f.mother) WHERE k.inftype IN ('2nd', 'FS', 'PO')")
def coparent_check(fam, king):
    return P.coparent_check(fam, king)


@query("people king", "SELECT iid FROM people p WHERE NOT EXISTS (SELECT 1 FROM king k WHERE ibd2seg + ibd1seg / 2 = 1 AND p.iid = CASE WHEN CAST(id1 AS VARCHAR) > CAST(id2 AS VARCHAR) THEN id1 ELSE id2 END)")
def exact_twin_filter(people, king):
    return P.drop_exact_twins(people.select("iid"), king)


@query("people king", "SELECT round(coalesce(max(ibd2seg + ibd1seg / 2), 0), 6) AS max_kinship FROM king WHERE id1 IN (SELECT iid FROM people WHERE age < 30) AND id2 IN (SELECT iid FROM people WHERE age < 30)")
def max_kinship(people, king):
    return rounded(P.max_kinship(people.where("age < 30").select("iid"), king), "max_kinship")


@query("founders king_typed", "SELECT fid, iid FROM founders WHERE fid NOT IN (SELECT a.fid FROM founders a JOIN founders b ON a.fid = b.fid AND a.iid < b.iid JOIN king_typed k ON k.id1 = a.iid AND k.id2 = b.iid WHERE propibd > 0.73)")
def family_filter(founders, king):
    return P.drop_related_families(founders, king, 0.73)


ROLES = ", roles AS (SELECT id1 % 500 AS pair, CASE WHEN id2 % 3 = 0 THEN 'couple' ELSE 'inlaws' END AS rel, propibd AS k FROM king_typed)"


@query("king_typed", f"{ROLES} SELECT DISTINCT pair FROM roles WHERE pair NOT IN (SELECT pair FROM roles WHERE (rel = 'couple' AND k > 0.6) OR (rel = 'inlaws' AND k > 0.65))")
def training_admission(king):
    return P.admit_training_pairs(king.selectExpr("id1 % 500 as pair", "case when id2 % 3 = 0 then 'couple' else 'inlaws' end as rel", "propibd as k"), 0.6, 0.65)


PANEL = """, near_ AS (SELECT a.popl, id1, id2 FROM king_typed JOIN people a ON a.iid = id1 JOIN people b ON b.iid = id2 WHERE a.popl = b.popl AND inftype IN ('4th', '3rd', '2nd', 'PO', 'FS')),
panel AS (SELECT popl, count(*) AS n_close FROM (SELECT popl, id1 AS iid FROM near_ UNION SELECT popl, id2 FROM near_) x GROUP BY popl)"""


@query("king_typed people", f"{PANEL}, sized AS (SELECT popl, n_close, n_close / sum(n_close) OVER () AS share FROM panel), free AS (SELECT popl, count(*) AS u FROM people GROUP BY popl), "
    "plan AS (SELECT popl, floor(1000 * share) AS n_samples, floor(u / 4) AS per_gp, floor(u / 5) AS per_other FROM sized JOIN free USING (popl)) "
    "SELECT popl, CAST(n_samples AS BIGINT) AS n_samples, CAST(per_gp AS BIGINT) AS per_gp, CAST(per_other AS BIGINT) AS per_other, CAST(ceil(n_samples / nullif(per_gp, 0)) AS BIGINT) AS gp_rounds, CAST(ceil(n_samples / nullif(per_other, 0)) AS BIGINT) AS other_rounds FROM plan")  # fmt: skip
def founder_plan(king, people):
    free = people.groupBy("popl").agg(F.count(F.lit(1)).alias("n_unrelated"))
    return P.founder_plan(P.founder_panel(king, people), free, 1000)


@query("vcf_lines", "SELECT pos, nr, CASE WHEN contains(line, '#') THEN line ELSE replace(replace(replace(replace(replace(line, '.|.', '0|0'), '.|0', '0|0'), '0|.', '0|0'), '.|1', '1|1'), '1|.', '1|1') END AS line FROM vcf_lines")
def fill_missing_alleles(lines):
    return P.fill_missing_alleles(lines)


TEMPLATE = (("b1", "b2", "AV"), ("b2", "b0", "PHS"))


@query("segments", ", t AS (SELECT * FROM (VALUES ('b1', 'b2', 'AV'), ('b2', 'b0', 'PHS')) v(s1, s2, relative)), "
    "r AS (SELECT *, 'b' || id1 % 3 AS s1, 'b' || id2 % 3 AS s2, (id1 // 24) % 100 AS i, (id2 // 24) % 100 AS j FROM segments) "
    "SELECT relative || '1_pop1_i' || i || '_sim3' AS id1, relative || '2_pop1_i' || i || '_sim3' AS id2, chromosome, id1_haplotype, id2_haplotype, start_cm, end_cm, relative, 'pop1' AS pop FROM r JOIN t USING (s1, s2) WHERE i = j")  # fmt: skip
def template_segments(segments):
    text = lambda c: F.concat_ws("_", F.lit("f"), F.concat(F.lit("iter"), F.expr(f"cast(({c} div 24) % 100 as string)")), F.concat(F.lit("b"), (F.col(c) % 3).cast("string")))
    named = segments.withColumns({"id1": text("id1"), "id2": text("id2")})
    template = segments.sparkSession.createDataFrame(TEMPLATE, "suffix1 string, suffix2 string, relative string")
    return P.label_by_template(named, template, "pop1", "3")


def _codes_rows() -> str:
    """The tree's nodes with their codes as constant rows."""
    above, codes = dict(H.TREE), {c[0]: (n, c) for n, c in enumerate(K.CODES)}
    rows = []
    for node in above:
        way = [node]
        while above[way[-1]] in above:
            way.append(above[way[-1]])
        code = "NULL, NULL, NULL"
        if node in codes:
            n, (_, paths, sexed, _, _) = codes[node]
            code = f"{sexed}, '{'|'.join(sorted((f'{x}:{w}' if sexed else w) for x, ws in paths.items() for w in ws))}', {n if sexed else len(K.CODES) + n}"
        rows.append(f"('{node}', '{above[node]}', '{way[-1]}', {len(way)}, {code})")
    return f"SELECT node, parent, degree, depth, CAST(sexed AS BOOLEAN) AS sexed, signature, priority FROM (VALUES {', '.join(rows)}) v(node, parent, degree, depth, sexed, signature, priority)"


CODES_ROWS = _codes_rows()


# --- files ------------------------------------------------------------------------------------------------------------
# Each query writes a fixture to the shared folder in a file format and reads it back.


def _headed(df: DataFrame, sep: str = " ") -> str:
    """A new folder of text files that each begin with the header."""
    path = scratch(df.sparkSession, "files")
    df.write.option("sep", sep).option("header", True).csv(path)
    return path


def _plain(df: DataFrame) -> str:
    path = scratch(df.sparkSession, "files")
    df.write.option("sep", " ").csv(path)
    return path


FAM_TEXT = "CAST(iid AS VARCHAR) AS iid, CAST(fid AS VARCHAR) AS fid, nullif(CAST(father AS VARCHAR), '0') AS father, nullif(CAST(mother AS VARCHAR), '0') AS mother, CAST(sex AS INT) AS sex"


@query("fam", f"SELECT {FAM_TEXT}, '-9' AS phenotype FROM fam")
def file_fam(fam):
    path = scratch(fam.sparkSession, "files")
    W.write_fam(fam, path)
    return R.read_fam(fam.sparkSession, path)


SEG = "CAST(id1 AS VARCHAR) AS id1, CAST(id2 AS VARCHAR) AS id2, ibd1seg, ibd2seg"


def _king_file(king) -> str:
    of = lambda c, name: F.col(c).alias(name)
    none = F.lit(0)
    return _headed(king.select(of("id1", "FID1"), of("id1", "ID1"), of("id2", "FID2"), of("id2", "ID2"), none.alias("MaxIBD1"), none.alias("MaxIBD2"), of("ibd1seg", "IBD1Seg"), of("ibd2seg", "IBD2Seg"), of("propibd", "PropIBD"), of("inftype", "InfType")), "\t")


@query("king_typed", f"SELECT {SEG}, propibd, inftype FROM king_typed")
def file_king(king):
    return R.read_king(king.sparkSession, _king_file(king))


@query("king_typed", f"SELECT {SEG}, inftype FROM king_typed")
def file_king_positional(king):
    return R.read_king_positional(king.sparkSession, _king_file(king))


SEGMENT_TEXT = "CAST(id1 AS VARCHAR) AS id1, CAST(id2 AS VARCHAR) AS id2, CAST(chromosome AS INT) AS chromosome, id1_haplotype, id2_haplotype, start_cm, end_cm"


@query("segments", f"SELECT {SEGMENT_TEXT} FROM segments")
def file_segments(segments):
    """One folder a chromosome, with its number in the folder's name and the file's."""
    root = scratch(segments.sparkSession, "files")
    for k in range(1, 5):
        segments.where(F.col("chromosome") == k).write.option("sep", " ").option("header", True).csv(f"{root}/chr{k}/segments-chr{k}.txt")
    return R.read_segments(segments.sparkSession, R.chromosome_paths(f"{root}/chr1/segments-chr1.txt", 4))


@query("segments", f"SELECT {SEGMENT_TEXT}, CASE WHEN id1 % 2 = 0 THEN 'even' ELSE 'odd' END AS pop FROM segments")
def file_segment_table(segments):
    path = scratch(segments.sparkSession, "files")
    text = segments.withColumns({c: F.col(c).cast("string") for c in PAIR} | {"chromosome": F.col("chromosome").cast("int"), "pop": F.when(F.col("id1") % 2 == 0, "even").otherwise("odd")})
    W.write_segments(text, path)
    return R.read_segment_table(segments.sparkSession, path)


@query("sites gmap", f"{INTERPOLATED.partition('SELECT chrom, bp, round')[0]}, inter AS (SELECT chrom, bp, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR lo = hi THEN a ELSE a + (bp - lo) * ((b - a) / (hi - lo)) END AS cm FROM knots) SELECT CAST(chrom AS INT) AS chrom, 'NA' AS snp, round(cm, 6) AS cm, bp FROM inter")
def file_map(sites, gmap):
    path = scratch(sites.sparkSession, "files")
    W.write_map(M.interpolate(sites, gmap).withColumns({"snp": F.lit(None).cast("string"), "keep": F.lit(True)}), path)
    return rounded(R.read_gmap(sites.sparkSession, path), "cm")


@query("gmap", "SELECT CAST(chrom AS INT) AS chrom, cm, bp, CAST(NULL AS VARCHAR) AS snp FROM gmap")
def file_gmap_by_columns(gmap):
    return R.read_gmap(gmap.sparkSession, _plain(gmap.select("bp", "cm", "chrom")), (2, 1, 0), None)


@query("people", "SELECT CAST(iid AS VARCHAR) AS iid, CAST(age AS DOUBLE) AS age FROM people")
def file_ages(people):
    return R.read_attribute(people.sparkSession, _plain(people.select("iid", "age")), "age", "double")


@query("sites", "SELECT CAST(chrom AS INT) AS chrom, bp FROM sites")
def file_sites(sites):
    return R.read_sites(sites.sparkSession, _plain(sites.select("chrom", "bp")))


@query("pairs_file", "SELECT degree, ibd1, ibd2, pihat FROM pairs_file")
def file_pairs(pairs):
    return R.read_pairs(pairs.sparkSession, _headed(pairs.select(*[F.col(c).alias(c.upper()) for c in ("degree", "ibd1", "ibd2", "pihat")])))


@query("po_file", "SELECT CAST(parent AS VARCHAR) AS parent, CAST(child AS VARCHAR) AS child, CAST(parent_age AS DOUBLE) AS parent_age, strength, method, h1, h2 FROM po_file")
def file_po(po):
    turned = F.col("parent") > F.col("child")
    ends = {"IID1": F.least("parent", "child"), "IID2": F.greatest("parent", "child"), "AGE1": F.when(turned, F.col("child_age")).otherwise(F.col("parent_age")), "AGE2": F.when(turned, F.col("parent_age")).otherwise(F.col("child_age"))}
    cols = {"PAIR_ID": S.pair_id("parent", "child"), **ends, **{c.upper(): F.col(c) for c in ("h1", "h2", "parent", "child", "strength", "method")}}
    return R.read_po(po.sparkSession, _headed(po.select(*[c.alias(n) for n, c in cols.items()])))


@query("people segments", f"SELECT {SEGMENT_TEXT} FROM segments")
def file_vcf_samples(people, segments):
    """Segments that name their people by the columns of a header line, and get their ids back from it."""
    spark, path = people.sparkSession, scratch(people.sparkSession, "files")
    line = people.agg(F.concat_ws("\t", F.lit("#CHROM"), F.lit("POS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"), F.array_join(F.sort_array(F.collect_list("iid")), "\t")).alias("value"))
    line.union(spark.createDataFrame([("##file",), ("1\t7\t.\tA\tC\t.\t.\t.\tGT",)], "value string")).write.text(path)
    samples = stored(R.vcf_samples(spark, path), "samples")
    at = lambda k: samples.select(F.col("iid").cast("bigint").alias(f"id{k}"), F.col("idx").alias(f"at{k}"))
    placed = segments.join(at(1), "id1").join(at(2), "id2").withColumns({"id1": F.col("at1"), "id2": F.col("at2"), "chromosome": F.col("chromosome").cast("int")}).drop("at1", "at2")
    return R.with_sample_ids(placed, samples)


@query("vcf_lines", "SELECT CASE WHEN contains(line, '#') THEN line ELSE replace(replace(replace(replace(replace(line, '.|.', '0|0'), '.|0', '0|0'), '0|.', '0|0'), '.|1', '1|1'), '1|.', '1|1') END AS line FROM vcf_lines")
def file_vcf_lines(lines):
    path = scratch(lines.sparkSession, "files")
    lines.select("line").write.text(path)
    return P.fill_missing_alleles(R.read_vcf_lines(lines.sparkSession, path))


@query("people king_typed", f", e AS (SELECT * FROM king_typed WHERE {RELATED}) SELECT CAST(iid AS VARCHAR) AS iid, CAST((SELECT count(*) FROM people) AS BIGINT) AS listed FROM people WHERE iid NOT IN (SELECT id1 FROM e) OR iid NOT IN (SELECT id2 FROM e)")
def file_ids(people, king):
    """Ids that some pair doesn't relate on both sides, and the number of people as the summary."""
    spark, path, e = people.sparkSession, scratch(people.sparkSession, "files"), P.related_edges(king)
    both = e.select(F.col("id1").alias("iid")).distinct().join(e.select(F.col("id2").alias("iid")).distinct(), "iid", "left_semi")
    W.write_ids(people.select("iid").join(both, "iid", "left_anti"), path, people.agg(F.count(F.lit(1)).alias("listed")))
    summary = spark.read.schema("listed bigint").json(f"{path}-summary").withColumn("one", F.lit(1))  # one row
    return spark.read.text(path).withColumnRenamed("value", "iid").withColumn("one", F.lit(1)).join(F.broadcast(summary), "one").drop("one")


@query("fam", CODES_ROWS)
def file_codes(fam):
    """Codes and tree through a YAML file: each code with its place, degree and the node above it."""
    spark, path = fam.sparkSession, scratch(fam.sparkSession, "files")
    W.write_codes(spark, path, K.CODES, H.TREE)
    codes, tree = R.read_codes(spark, path)
    return tree.join(codes.select(F.col("name").alias("node"), "sexed", "signature", "priority"), "node", "left").select("node", "parent", tree["degree"], "depth", "sexed", "signature", "priority")


# --- models -----------------------------------------------------------------------------------------------------------


def lda_sql(train: str, rows: str, keys: str, x: str, y: str, label: str) -> str:
    """Closed-form discriminant from raw moments."""
    return f""", g AS (SELECT {label} AS class, {x} AS x, {y} AS y FROM {train}),
c AS (SELECT class, count(*) AS size, avg(x) AS m1, avg(y) AS m2 FROM g GROUP BY class),
w AS (SELECT sum((x - m1) * (x - m1)) AS a, sum((x - m1) * (y - m2)) AS b, sum((y - m2) * (y - m2)) AS d, count(*) AS n, count(DISTINCT g.class) AS k FROM g JOIN c USING (class)),
z AS (SELECT {keys}, c.class, ((total - k) / (a * d - b * b)) * ((d * m1 - b * m2) * x + (a * m2 - b * m1) * y - (d * m1 * m1 - 2 * b * m1 * m2 + a * m2 * m2) / 2) + ln(size / total) AS s
  FROM (SELECT {keys}, {x} AS x, {y} AS y FROM {rows}) r CROSS JOIN c CROSS JOIN (SELECT a, b, d, k, n AS total FROM w) w),
e AS (SELECT {keys}, class, exp(s - max(s) OVER (PARTITION BY {keys})) AS e FROM z)
SELECT {keys}, class, round(e / sum(e) OVER (PARTITION BY {keys}), 9) AS p FROM e"""


@query("king_typed", lda_sql("king_typed", "king_typed", "id1, id2", "ibd1seg", "ibd2seg", "inftype"))
def lda_degree_proba(king):
    model = L.lda_fit(king, "inftype", ("ibd1seg", "ibd2seg"))
    return rounded(L.lda_score(king, model, ("ibd1seg", "ibd2seg")).select(*PAIR, "class", "p"), "p", digits=9)


JOINED = f"{STATS}, both_ AS (SELECT s.*, inftype, ibd1seg + ibd2seg AS kcov, ibd1 + ibd2 AS scov, CAST(n AS DOUBLE) AS nn FROM stats s JOIN king_typed k ON k.id1 = s.id1 AND k.id2 = s.id2)"


@query("segments king_typed", JOINED + lda_sql("both_", "(SELECT id1, id2, scov AS kcov, nn FROM both_) q", "id1, id2", "kcov", "nn", "inftype"))
def lda_nsegs_proba(segments, king):
    rows = stored(S.pair_stats(segments, GENOME_CM).join(king, PAIR), "rows")
    train = rows.select("inftype", P.coverage().alias("cov"), F.col("n").cast("double").alias("n"))
    wanted = rows.select(*PAIR, (F.col("ibd1") + F.col("ibd2")).alias("cov"), F.col("n").cast("double").alias("n"))
    return rounded(L.lda_score(wanted, L.lda_fit(train, "inftype", ("cov", "n")), ("cov", "n")).select(*PAIR, "class", "p"), "p", digits=9)


@query("segments king_typed", JOINED + lda_sql("both_", "(SELECT id1, id2, greatest(h1, h2) AS h1, least(h1, h2) AS h2 FROM both_) q", "id1, id2", "h1", "h2", "inftype"))
def lda_hap_proba(segments, king):
    rows = stored(S.pair_stats(segments, GENOME_CM).join(king, PAIR), "rows")
    wanted = rows.select(*PAIR, F.greatest("h1", "h2").alias("h1"), F.least("h1", "h2").alias("h2"))
    return rounded(L.lda_score(wanted, L.lda_fit(rows, "inftype", ("h1", "h2")), ("h1", "h2")).select(*PAIR, "class", "p"), "p", digits=9)


LOO = """, g AS (SELECT id1, id2, inftype AS own, ibd1seg AS x, ibd2seg AS y FROM king_typed),
c AS (SELECT own AS class, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM g GROUP BY own),
t AS (SELECT g.*, c.class, c.n - o AS n, c.sx - o * x AS sx, c.sy - o * y AS sy, c.sxx - o * x * x AS sxx, c.sxy - o * x * y AS sxy, c.syy - o * y * y AS syy
  FROM g, c, LATERAL (SELECT CASE WHEN c.class = g.own THEN 1 ELSE 0 END AS o) q),
w AS (SELECT id1, id2, sum(sxx - sx * sx / n) AS a, sum(sxy - sx * sy / n) AS b, sum(syy - sy * sy / n) AS d, sum(n) AS total, count(*) AS k FROM t GROUP BY id1, id2),
z AS (SELECT id1, id2, t.class, ((total - k) / (a * d - b * b)) * ((d * m1 - b * m2) * x + (a * m2 - b * m1) * y - (d * m1 * m1 - 2 * b * m1 * m2 + a * m2 * m2) / 2) + ln(n / total) AS s
  FROM (SELECT *, sx / n AS m1, sy / n AS m2 FROM t) t JOIN w USING (id1, id2)),
e AS (SELECT id1, id2, class, exp(s - max(s) OVER (PARTITION BY id1, id2)) AS e FROM z)
SELECT id1, id2, class, round(e / sum(e) OVER (PARTITION BY id1, id2), 7) AS p FROM e"""


@query("king_typed", LOO)
def lda_loo(king):
    return rounded(L.lda_leave_one_out(king, "inftype", ("ibd1seg", "ibd2seg")).select(*PAIR, "class", "p"), "p", digits=7)


CLASSED = f"{STATS}, known_ AS (SELECT CASE (s.id1 + s.id2) % 5 WHEN 0 THEN 'MGP' WHEN 1 THEN 'MHS' WHEN 2 THEN 'PHS' WHEN 3 THEN 'PGP' ELSE 'AV' END AS rel, CAST(n AS DOUBLE) AS nn, ibd2 + ibd1 / 2 AS k FROM stats s)"


@query("segments", CLASSED + ", grid AS (SELECT CAST(unnest(range(20, 100)) AS BIGINT) AS n, CAST(0.02 AS DOUBLE) AS k), curve AS (SELECT * FROM (WITH one AS (SELECT 1)" + lda_sql("known_", "grid", "n", "CASE WHEN TRUE THEN nn END", "k", "rel").replace("n, CASE WHEN TRUE THEN nn END AS x", "n, CAST(n AS DOUBLE) AS x") + ") q) SELECT * FROM curve UNION ALL SELECT n, CASE WHEN class IN ('PGP', 'MGP') THEN 'GP' ELSE 'HS' END, round(sum(p), 8) FROM curve WHERE class <> 'AV' GROUP BY ALL")
def nsegs_curve(segments):
    rel = F.element_at(F.array(*map(F.lit, ("MGP", "MHS", "PHS", "PGP", "AV"))), ((F.col("id1") + F.col("id2")) % 5 + 1).cast("int"))
    train = S.pair_stats(segments, GENOME_CM).select(rel.alias("rel"), F.col("n").cast("double").alias("n"), P.kinship("ibd1", "ibd2").alias("k"))
    curve = L.nsegs_curve(L.lda_fit(train, "rel", ("n", "k")), 20, 100, 0.02)
    return curve.withColumn("p", F.when(F.col("class").isin("GP", "HS"), F.round("p", 8)).otherwise(F.round("p", 9)))


# --- pedigree ---------------------------------------------------------------------------------------------------------

CODES_SQL = ", codes(name, sexed, signature, degree, priority) AS (VALUES " + ", ".join(
    "('{}', {}, '{}', '{}', {})".format(n, s, "|".join(sorted((f"{x}:{w}" if s else w) for x, ws in p.items() for w in ws)), d, i if s else len(K.CODES) + i) for i, (n, p, s, d, _) in enumerate(K.CODES)
) + ")"
PATHS = """, walk(focal, id2, first_parent, ids, dirs) AS (
  SELECT child, parent, parent, [child, parent], [1] FROM po
  UNION ALL
  SELECT focal, nxt, first_parent, list_append(ids, nxt), list_append(dirs, d)
  FROM walk w JOIN (SELECT child AS cur, parent AS nxt, 1 AS d FROM po UNION ALL SELECT parent, child, -1 FROM po) s ON s.cur = w.id2
  WHERE (d = -1 OR dirs[len(dirs)] = 1) AND NOT list_contains(ids, nxt))"""
GROUPS = """, ways AS (SELECT focal, w.id2, f.sex, array_to_string(dirs, ',') AS way, array_to_string(list_transform(list_reverse(dirs), lambda d: -d), ',') AS back, list_sum(dirs) AS rise, pow(0.5, len(dirs) - 1) AS k
  FROM walk w JOIN fam f ON f.iid = w.first_parent),
grouped AS (SELECT focal, id2, string_agg(way, '|' ORDER BY way) AS signature, string_agg(sex || ':' || way, '|' ORDER BY sex || ':' || way) AS sexed_signature, string_agg(back, '|' ORDER BY back) AS reversed,
    max(abs(rise)) = 0 AS same_generation, coalesce(sum(k) FILTER (sex = 1), 0) AS k1, coalesce(sum(k) FILTER (sex = 2), 0) AS k2, count(*) AS n_paths FROM ways GROUP BY focal, id2),
named AS (SELECT g.*, (SELECT arg_min(name, priority) FROM codes c WHERE c.signature = CASE WHEN sexed THEN g.sexed_signature ELSE g.signature END) AS name,
    (SELECT arg_min(degree, priority) FROM codes c WHERE c.signature = CASE WHEN sexed THEN g.sexed_signature ELSE g.signature END) AS degree FROM grouped g)"""


def _groups(po, fam):
    return K.path_groups(stored(K.pedigree_paths(po), "paths"), fam)


def _codes(df):
    return K.codes_table(df.sparkSession)


@query("po", f"{PATHS} SELECT focal, id2, first_parent, array_to_string(ids, '-') AS ids, array_to_string(dirs, ',') AS dirs FROM walk")
def pedigree_paths(po):
    paths = K.pedigree_paths(po)
    return paths.select("focal", "id2", "first_parent", F.array_join(F.transform("ids", lambda i: i.cast("string")), "-").alias("ids"), K._dirs().alias("dirs"))


@query("po fam", f"{CODES_SQL}{PATHS}{GROUPS} SELECT focal, id2, name, degree FROM named WHERE name IS NOT NULL")
def relationship_names(po, fam):
    return K.name_relationships(_groups(po, fam), _codes(po)).where("name is not null").select("focal", "id2", "name", "degree")


@query("po fam", f"{CODES_SQL}{PATHS}{GROUPS} SELECT signature, count(*) AS n FROM named g WHERE name IS NULL AND (NOT same_generation OR focal < id2) AND reversed NOT IN (SELECT signature FROM codes WHERE NOT sexed) GROUP BY signature")
def unknown_relationships(po, fam):
    return K.unknown_relationships(_groups(po, fam), _codes(po))


@query("po fam", f"{PATHS}{GROUPS.split('named AS')[0].rstrip().rstrip(',')} SELECT focal, id2, k1 * (1 - k2) + k2 * (1 - k1) AS ibd1, k1 * k2 AS ibd2 FROM grouped")
def expected_kinship(po, fam):
    return K.expected_kinship(_groups(po, fam))


KNOWN = """, known AS (SELECT least(focal, n.id2) AS id1, greatest(focal, n.id2) AS id2, focal, name AS rel, degree, coalesce(ibd1seg, 0) AS k_ibd1, coalesce(ibd2seg, 0) AS k_ibd2,
    k1 * (1 - k2) + k2 * (1 - k1) AS exp_ibd1, k1 * k2 AS exp_ibd2
  FROM named n LEFT JOIN king k ON k.id1 = least(focal, n.id2) AND k.id2 = greatest(focal, n.id2) WHERE name IS NOT NULL AND (NOT same_generation OR focal < n.id2))"""


@query("po fam king", f"{CODES_SQL}{PATHS}{GROUPS}{KNOWN} SELECT * FROM known")
def known_pairs(po, fam, king):
    return K.known_pairs(_groups(po, fam), _codes(po), king)


@query("po fam king", f"{CODES_SQL}{PATHS}{GROUPS}{KNOWN} SELECT id1, id2, rel, degree, 'GPAV' AS requested FROM known WHERE rel IN ('AV', 'GP', 'PGP', 'MGP') UNION ALL SELECT id1, id2, rel, degree, '3rd' FROM known WHERE rel IN ('HAV', 'GGP', 'CO')")
def pairs_under(po, fam, king):
    known = K.known_pairs(_groups(po, fam), _codes(po), king)
    return H.pairs_under(known, H.closure(po.sparkSession), ["GPAV", "3rd"]).select("id1", "id2", "rel", "degree", "requested")


@query("po", "SELECT DISTINCT a.child AS id1, b.child AS id2 FROM po a JOIN po b ON a.parent = b.parent AND a.child < b.child")
def sib_pairs(po):
    return K.sib_pairs(po)


# --- hierarchy --------------------------------------------------------------------------------------------------------

GIVEN = ", ".join(f"('{n}', {k})" for k, (n, _) in enumerate(H.TREE))
GIVEN_SQL = f", given AS (SELECT id1, id2, node, ((id1 * 7 + id2 * 11 + nr * nr * 13) % 17) / 16.0e0 AS p_con FROM king CROSS JOIN (VALUES {GIVEN}) v(node, nr))"
TREE_SQL = ", tree(node, parent) AS (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in H.TREE) + ")"
#: Unrolled over the tree's four levels: a node's share times those of the nodes above it.
FALL = f"""{TREE_SQL}, shares AS (SELECT id1, id2, node, parent, p_con, coalesce(p_con / nullif(sum(p_con) OVER (PARTITION BY id1, id2, parent), 0), 0) AS share FROM given JOIN tree USING (node)),
fall AS (SELECT s.id1, s.id2, s.node, s.p_con, s.share * coalesce(a.share, 1) * coalesce(b.share, 1) * coalesce(c.share, 1) AS p, coalesce(c.node, b.node, a.node, s.node) AS top FROM shares s
  LEFT JOIN shares a ON a.id1 = s.id1 AND a.id2 = s.id2 AND a.node = s.parent LEFT JOIN shares b ON b.id1 = s.id1 AND b.id2 = s.id2 AND b.node = a.parent
  LEFT JOIN shares c ON c.id1 = s.id1 AND c.id2 = s.id2 AND c.node = b.parent)"""
CASCADE = GIVEN_SQL + FALL


def _given(king):
    nodes = king.sparkSession.createDataFrame([(n, k) for k, (n, _) in enumerate(H.TREE)], "node string, nr int").agg(F.collect_list(F.struct("node", "nr")).alias("nodes"))
    rows = king.withColumn("one", F.lit(1)).join(F.broadcast(nodes.withColumn("one", F.lit(1))), "one").select(*PAIR, F.inline("nodes"))  # the tree
    return rows.select(*PAIR, "node", (((F.col("id1") * 7 + F.col("id2") * 11 + F.col("nr") * F.col("nr") * 13) % 17) / F.lit(16.0)).alias("p_con"))


@query("king", f"{CASCADE} SELECT id1, id2, node, p_con, round(p, 9) AS p FROM fall")
def probability_cascade(king):
    return rounded(H.cascade(_given(king), H.tree_table(king.sparkSession)), "p", digits=9)


LEVELS = ", ".join(f"('{n}', {lv})" for n, lv in (("PGP", 0), ("MGP", 0), ("PHS", 0), ("MHS", 0), ("AV", 0), ("GP", 1), ("HS", 1), ("GPAV", 2), ("2nd", 3), ("3rd", 1), ("4th", 1), ("2nd+", 1), ("3rd+", 1), ("4th+", 1)))


def picked_sql(min_p: float) -> str:
    """``picked(id1, id2, most_probable, probability, degree)``: the best degree, or below it the best node of the lowest level over the bound."""
    return f""", levels(node, level) AS (VALUES {LEVELS}), leveled AS (SELECT f.*, coalesce(level, 0) AS level FROM fall f LEFT JOIN levels USING (node)),
tops AS (SELECT id1, id2, node AS degree, p AS top_p FROM (SELECT *, row_number() OVER (PARTITION BY id1, id2 ORDER BY round(p, 12) DESC, node) AS r FROM fall JOIN tree USING (node) WHERE parent = 'relatives') q WHERE r = 1),
picks AS (SELECT l.id1, l.id2, l.node, l.p, row_number() OVER (PARTITION BY l.id1, l.id2 ORDER BY level, round(l.p, 12) DESC, l.node) AS r FROM leveled l JOIN tops t ON t.id1 = l.id1 AND t.id2 = l.id2 AND t.degree = l.top WHERE top_p >= {min_p} AND l.p > {min_p}),
picked AS (SELECT t.id1, t.id2, coalesce(node, degree) AS most_probable, coalesce(p, top_p) AS probability, degree FROM tops t LEFT JOIN (SELECT * FROM picks WHERE r = 1) k ON k.id1 = t.id1 AND k.id2 = t.id2)"""


@query("king", f"{CASCADE}{picked_sql(0.12)} SELECT id1, id2, most_probable, round(probability, 9) AS probability, degree FROM picked")
def most_probable(king):
    tree = H.tree_table(king.sparkSession)
    return rounded(H.most_probable(H.cascaded(_given(king), tree), tree, 0.12, digits=12), "probability", digits=9)


@query("king", f"{GIVEN_SQL}, s AS (SELECT id1, id2, sum(p_con) FILTER (node IN ('PGP', 'MGP')) AS gp, sum(p_con) FILTER (node IN ('PHS', 'MHS')) AS hs, sum(p_con) FILTER (node IN ('PGP', 'MGP', 'AV')) AS gpav FROM given GROUP BY id1, id2) "
    "SELECT id1, id2, node, p_con FROM given WHERE node NOT IN ('GP', 'HS', 'GPAV') UNION ALL SELECT id1, id2, 'GP', gp FROM s UNION ALL SELECT id1, id2, 'HS', hs FROM s UNION ALL SELECT id1, id2, 'GPAV', gpav FROM s")  # fmt: skip
def children_sums(king):
    return H.sum_children(_given(king))


@query("king", f"{GIVEN_SQL} SELECT id1, id2, node, p_con AS p FROM (SELECT *, row_number() OVER (PARTITION BY id1, id2 ORDER BY p_con DESC, CASE node WHEN 'FS' THEN 1 WHEN 'PO' THEN 2 WHEN 'AV' THEN 3 ELSE 4 END) AS r FROM given WHERE node IN ('FS', 'PO', 'AV', 'CO')) q WHERE r = 1")
def most_likely_among(king):
    return H.most_likely_among(_given(king).withColumnRenamed("p_con", "p"), ["FS", "PO", "AV", "CO"])


@query("king", f"{GIVEN_SQL} SELECT id1, id2, node, CASE WHEN node = 'HS' AND id1 % 2 = 0 THEN 0.5 ELSE p_con END AS p_con, CASE WHEN node = 'HS' AND id1 % 2 = 0 THEN 'haplotype' ELSE 'degree' END AS method FROM given")
def probability_update(king):
    probs = _given(king)
    newer = probs.where("node = 'HS' and id1 % 2 = 0").withColumn("p_con", F.lit(0.5))
    return H.set_probs(probs.withColumn("method", F.lit("degree")), newer, "haplotype")


# --- graphs -----------------------------------------------------------------------------------------------------------

FAMILIES = f""", links AS (SELECT id1 AS a, id2 AS b FROM king_typed WHERE {CLOSE} UNION ALL SELECT id2, id1 FROM king_typed WHERE {CLOSE}),
reach(root, node) AS (SELECT DISTINCT a, a FROM links UNION SELECT root, b FROM reach JOIN links ON a = node),
families AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"""


@query("king_typed", f"{FAMILIES} SELECT * FROM families")
def families(king):
    return G.components(king.where(CLOSE))


def visit_sql(edges: str, order: str, nodes: str = "people", seeds: str = "(SELECT 1 AS seed)") -> str:
    """The one-by-one visit of every family (edges stay within 24 ids): a person is taken unless a neighbour was; ``taken_`` per seed and family."""
    return f""", e_ AS (SELECT id1 AS a, id2 AS b FROM {edges} q UNION ALL SELECT id2, id1 FROM {edges} q),
near_ AS (SELECT a, list(b) AS bs, count(*) AS degree FROM e_ GROUP BY a),
ordered AS (SELECT seed, iid, iid // 24 AS g, bs, row_number() OVER (PARTITION BY seed, iid // 24 ORDER BY {order}) AS r
  FROM (SELECT seed, p.iid, coalesce(degree, 0) AS degree, coalesce(bs, CAST([] AS BIGINT[])) AS bs FROM {seeds} s CROSS JOIN {nodes} p LEFT JOIN near_ ON a = p.iid) o),
visit(seed, g, r, taken) AS (SELECT DISTINCT seed, g, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM ordered
  UNION ALL SELECT v.seed, v.g, o.r, CASE WHEN len(list_intersect(o.bs, v.taken)) > 0 THEN v.taken ELSE list_append(v.taken, o.iid) END FROM visit v JOIN ordered o ON o.seed = v.seed AND o.g = v.g AND o.r = v.r + 1),
taken_ AS (SELECT seed, unnest(taken) AS iid FROM (SELECT seed, g, arg_max(taken, r) AS taken FROM visit GROUP BY seed, g) t)"""


NEAR = "(SELECT id1, id2 FROM king_typed WHERE propibd > 0.45)"
BY_DEGREE = "degree, md5(seed || ':' || iid), iid"


@query("people king_typed", f"{visit_sql(NEAR, BY_DEGREE)} SELECT iid FROM taken_")
def unrelated_set(people, king):
    return G.unrelated_set(people, stored(P.related_edges(king, "propibd > 0.45"), "edges"), seed=1)


@query("people king_typed", f"{visit_sql(NEAR, BY_DEGREE, seeds='(SELECT unnest([1, 2, 3]) AS seed)')}, best_ AS (SELECT seed FROM (SELECT seed, count(*) AS n FROM taken_ GROUP BY seed) c ORDER BY n DESC, seed LIMIT 1) SELECT iid FROM taken_ JOIN best_ USING (seed)")
def unrelated_best_of_seeds(people, king):
    return G.best_of_seeds(people, stored(P.related_edges(king, "propibd > 0.45"), "edges"), [1, 2, 3])


@query("people king_typed", f"{visit_sql(NEAR, 'degree, iid DESC')} SELECT iid FROM taken_")
def unrelated_ranked(people, king):
    edges = stored(P.related_edges(king, "propibd > 0.45"), "edges")
    return G.ranked_independent_set(stored(P.unrelated_counts(people, edges), "counts"), edges)


@query("people king_typed", f"{visit_sql(NEAR, 'degree, CAST(iid AS VARCHAR) DESC')} SELECT CAST(iid AS VARCHAR) AS iid FROM taken_")
def unrelated_ranked_text(people, king):
    """Ties of ids as text: 12 stands over 1, and 9 over 12."""
    text = lambda df, *cols: df.select(*(F.col(c).cast("string").alias(c) for c in cols))
    ids, edges = stored(text(people, "iid"), "ids"), stored(text(P.related_edges(king, "propibd > 0.45"), *PAIR), "edges")
    return G.ranked_independent_set(stored(P.unrelated_counts(ids, edges), "counts"), edges)


@query("people pairs_file", f"{visit_sql('(SELECT id1, id2 FROM pairs_file WHERE degree IN (' + chr(39) + 'FS' + chr(39) + ', ' + chr(39) + 'PO' + chr(39) + '))', 'degree, iid DESC')} SELECT iid FROM taken_")
def unrelated_by_king_class(people, pairs):
    return J.find_unrelated(people, pairs, "king", degree="2nd")


@query("king_typed people", visit_sql("(SELECT id1, id2 FROM king_typed JOIN people x ON x.iid = id1 JOIN people y ON y.iid = id2 WHERE propibd > 0.3 AND x.popl = y.popl)", BY_DEGREE, seeds="(SELECT 0 AS seed)") + " SELECT popl, iid FROM taken_ JOIN people USING (iid)")
def unrelated_founders(king, people):
    return J.unrelated_founders(king, people, 0.3)


@query("people king_typed", f"{visit_sql(NEAR, BY_DEGREE)}, reach(root, node) AS (SELECT DISTINCT a, a FROM e_ UNION SELECT root, b FROM reach JOIN e_ ON a = node), comps AS (SELECT node, min(root) AS c FROM reach GROUP BY node) "
    "SELECT (SELECT count(DISTINCT c) FROM comps) AS n_families, (SELECT count(*) FROM taken_) AS size, (SELECT round(coalesce(max(ibd2seg + ibd1seg / 2), 0), 6) FROM king_typed WHERE id1 IN (SELECT iid FROM taken_) AND id2 IN (SELECT iid FROM taken_)) AS max_kinship")  # fmt: skip
def unrelated_summary(people, king):
    edges = stored(P.related_edges(king, "propibd > 0.45"), "edges")
    return rounded(J.selected_summary(stored(G.unrelated_set(people, edges, 1), "chosen"), edges, king), "max_kinship")


@query("pairs_file", "SELECT 'float' AS mode, id1, id2 FROM pairs_file WHERE pihat > 0.25 UNION ALL SELECT 'king', id1, id2 FROM pairs_file WHERE degree IN ('2nd', 'FS', 'PO') "
    "UNION ALL SELECT 'fifth', id1, id2 FROM pairs_file WHERE pihat >= (SELECT avg(pihat) - 2 * stddev_samp(pihat) FROM pairs_file WHERE degree = '4th')")  # fmt: skip
def relatedness_modes(pairs):
    parts = [J.relatedness_edges(pairs, "float", threshold=0.25), J.relatedness_edges(pairs, "king", "3rd"), J.relatedness_edges(pairs, "fifth", training=pairs)]
    named = [p.select(F.lit(m).alias("mode"), *PAIR) for m, p in zip(("float", "king", "fifth"), parts, strict=True)]
    return named[0].union(named[1]).union(named[2])


KEPT = ", kept AS (SELECT p.* FROM pairs_file p JOIN (SELECT degree, avg(ibd1) AS mean, stddev_samp(ibd1) AS sd FROM pairs_file WHERE degree IN ('3rd', '2nd', 'FS', 'PO') GROUP BY degree) m USING (degree) WHERE abs(ibd1 - mean) < 2 * sd)"


@query("pairs_file", KEPT + lda_sql("kept", "pairs_file", "id1, id2", "ibd1", "ibd2", "degree").rpartition("SELECT")[0].replace("\nz AS", "\nz AS") + "SELECT id1, id2 FROM (SELECT *, row_number() OVER (PARTITION BY id1, id2 ORDER BY s DESC, class) AS r FROM z) q WHERE r = 1 AND class IN ('2nd', 'FS', 'PO')")
def relatedness_by_lda(pairs):
    return J.relatedness_edges(pairs, "lda", "3rd", training=pairs)


# --- siblings and assembly ----------------------------------------------------------------------------------------------


def mixture_sql(po: str, king: str) -> str:
    """Expectation maximisation over sib pairs, one state a round: weights, means, variances and mean log-likelihood of two round components."""
    density = lambda k: f"ln(w{k}) - ln(2 * pi() * v{k}) - ((x - x{k}) * (x - x{k}) + (y - y{k}) * (y - y{k})) / (2 * v{k})"
    moments = lambda k, r: f"sum({r}) AS n{k}, sum({r} * x) AS sx{k}, sum({r} * y) AS sy{k}, sum({r} * (x * x + y * y)) AS sq{k}"
    state = ", ".join(f"n{k} / (n0 + n1) AS w{k}, {{mx{k}}} AS x{k}, {{my{k}}} AS y{k}, (sq{k} / n{k} - (sx{k} / n{k}) * (sx{k} / n{k}) - (sy{k} / n{k}) * (sy{k} / n{k})) / 2 + 1e-6 AS v{k}" for k in (0, 1))
    own = state.format(mx0="sx0 / n0", my0="sy0 / n0", mx1="sx1 / n1", my1="sy1 / n1")
    given = state.format(mx0="0.5e0", my0="0.0e0", mx1="0.5e0", my1="0.25e0")
    near = "((x - kx0) * (x - kx0) + (y - ky0) * (y - ky0) <= (x - kx1) * (x - kx1) + (y - ky1) * (y - ky1))"
    centres = ", ".join(f"any_value(k{c}{k}) AS k{c}{k}, coalesce(avg({c}) FILTER ({'' if k == 0 else 'NOT '}{near}), any_value(k{c}{k})) AS n{c}{k}" for k in (0, 1) for c in "xy")
    return f""", sp AS (SELECT k.id1, k.id2, ibd1seg AS x, ibd2seg AS y FROM {king} k JOIN (SELECT DISTINCT a.child AS id1, b.child AS id2 FROM {po} a JOIN {po} b ON a.parent = b.parent AND a.child < b.child) c USING (id1, id2)),
km AS (SELECT CAST(0 AS BIGINT) AS round_, 0.5e0 AS kx0, 0.0e0 AS ky0, 0.5e0 AS kx1, 0.25e0 AS ky1, 1.0e0 AS moved
  UNION ALL SELECT round_ + 1, nx0, ny0, nx1, ny1, greatest(abs(nx0 - kx0), abs(ny0 - ky0), abs(nx1 - kx1), abs(ny1 - ky1)) FROM (SELECT round_, {centres} FROM km CROSS JOIN sp WHERE round_ < 100 AND moved > 1e-9 GROUP BY round_) k),
clusters AS (SELECT * FROM km ORDER BY round_ DESC LIMIT 1),
em AS (SELECT CAST(0 AS BIGINT) AS turn, CAST(NULL AS DOUBLE) AS ll, CAST(NULL AS DOUBLE) AS old, {given} FROM (SELECT {moments(0, f"CASE WHEN {near} THEN 1.0e0 ELSE 0.0e0 END")}, {moments(1, f"CASE WHEN {near} THEN 0.0e0 ELSE 1.0e0 END")} FROM sp CROSS JOIN clusters) a
  UNION ALL SELECT turn + 1, now, ll, {own} FROM (SELECT turn, any_value(ll) AS ll, avg(greatest(d0, d1) + ln(exp(d0 - greatest(d0, d1)) + exp(d1 - greatest(d0, d1)))) AS now, {moments(0, "1 / (1 + exp(d1 - d0))")}, {moments(1, "1 / (1 + exp(d0 - d1))")}
    FROM (SELECT em.*, x, y, {density(0)} AS d0, {density(1)} AS d1 FROM em CROSS JOIN sp WHERE turn < 20 AND (turn < 2 OR abs(ll - old) >= 1e-3)) z GROUP BY turn) b),
last_ AS (SELECT * FROM em ORDER BY turn DESC LIMIT 1),
mixed_ AS (SELECT id1, id2, x, y, {density(0)} AS d0, {density(1)} AS d1 FROM sp CROSS JOIN last_)"""


@query("po king_sibs", f"{mixture_sql('po', 'king_sibs')} SELECT id1, id2, x AS ibd1seg, y AS ibd2seg, round(1 / (1 + exp(-abs(d1 - d0))), 6) AS probability, CAST(CASE WHEN d1 > d0 THEN 1 ELSE 0 END AS INT) AS component FROM mixed_")
def sibling_mixture(po, king):
    return rounded(B.sibling_mixture(po, king), "probability")


#: Parents to add for groups ``grp(node, c)`` where each member has ``k`` of them, ``known`` being the smallest.
LACKING = """ SELECT c AS "group", node AS child, 'missing_' || c || '_' || sex AS parent, CAST(sex AS INT) AS sex
  FROM (SELECT c, node, unnest(CASE WHEN lo = 0 THEN [1, 2] ELSE [CASE s WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END] END) AS sex FROM lack JOIN grp USING (c)) z"""


@query("po_lacking fam king_sibs", f"""{mixture_sql('po_lacking', 'king_sibs')}, fs AS (SELECT id1 AS a, id2 AS b FROM mixed_ WHERE d1 > d0 UNION ALL SELECT id2, id1 FROM mixed_ WHERE d1 > d0),
reach(root, node) AS (SELECT DISTINCT a, a FROM fs UNION SELECT root, b FROM reach JOIN fs ON a = node), grp AS (SELECT node, min(root) AS c FROM reach GROUP BY node),
have AS (SELECT node, c, count(DISTINCT parent) AS k, min(parent) AS known FROM grp LEFT JOIN po_lacking ON child = node GROUP BY ALL),
lack AS (SELECT c, min(k) AS lo, arg_min(f.sex, known) AS s FROM have LEFT JOIN fam f ON f.iid = known GROUP BY c HAVING min(k) = max(k) AND max(k) < 2){LACKING}""")
def sibship_parents(po, fam, king):
    return B.resolve_sibships(po, fam, king)


SIBS = """, cand AS (SELECT DISTINCT a.child AS id1, b.child AS id2 FROM po a JOIN po b ON a.parent = b.parent AND a.child < b.child
  UNION SELECT id1, id2 FROM king WHERE ibd2seg > 0.10 AND ibd2seg < 0.50 AND id1 NOT IN (SELECT child FROM po) AND id2 NOT IN (SELECT child FROM po)),
ps AS (SELECT f.iid, list_filter([father, mother], lambda x: x IS NOT NULL) AS p FROM fam f),
sib AS (SELECT k.*, len(list_intersect(a.p, b.p)) AS n_common, len(list_distinct(list_concat(a.p, b.p))) - len(list_intersect(a.p, b.p)) AS n_other FROM king k JOIN cand USING (id1, id2) JOIN ps a ON a.iid = id1 JOIN ps b ON b.iid = id2),
sibs AS (SELECT *, CASE WHEN n_common = 2 THEN 'FS' WHEN n_other > 0 THEN '2nd' END AS given FROM sib)"""


@query("po fam king", SIBS + lda_sql("(SELECT * FROM sibs WHERE given IS NOT NULL) t", "sibs", "id1, id2", "ibd1seg", "ibd2seg", "given").rpartition("SELECT")[0] + "SELECT id1, id2, n_common, coalesce(given, class) AS half, given IS NULL AS is_predicted FROM sibs JOIN (SELECT *, row_number() OVER (PARTITION BY id1, id2 ORDER BY s DESC, class) AS r FROM z) q USING (id1, id2) WHERE r = 1")
def sibling_classes(po, fam, king):
    return B.classify_siblings(po, fam, king).select(*PAIR, "n_common", "half", "is_predicted")


CLASSED_SIBS = SIBS.replace("FROM po ", "FROM po_lacking ").replace("JOIN po ", "JOIN po_lacking ").replace("FROM po)", "FROM po_lacking)").replace("FROM king ", "FROM king_sibs ").replace(
    "ps AS (SELECT f.iid, list_filter([father, mother], lambda x: x IS NOT NULL) AS p FROM fam f)", "ps AS (SELECT f.iid, coalesce(list(parent) FILTER (parent IS NOT NULL), CAST([] AS BIGINT[])) AS p FROM fam f LEFT JOIN po_lacking ON child = f.iid GROUP BY f.iid)"
).replace("n_other FROM king k", "n_other FROM king_sibs k")


@query("po_lacking fam king_sibs", CLASSED_SIBS + lda_sql("(SELECT * FROM sibs WHERE given IS NOT NULL) t", "sibs", "id1, id2", "ibd1seg", "ibd2seg", "given").rpartition("SELECT")[0] + f"""SELECT * FROM (WITH RECURSIVE full_ AS (SELECT sibs.* FROM sibs JOIN (SELECT *, row_number() OVER (PARTITION BY id1, id2 ORDER BY s DESC, class) AS r FROM z) q USING (id1, id2) WHERE r = 1 AND given IS NULL AND class = 'FS'),
fs AS (SELECT id1 AS a, id2 AS b FROM full_ UNION ALL SELECT id2, id1 FROM full_), reach(root, node) AS (SELECT DISTINCT a, a FROM fs UNION SELECT root, b FROM reach JOIN fs ON a = node), grp AS (SELECT node, min(root) AS c FROM reach GROUP BY node),
common_ AS (SELECT id1 AS node, unnest(list_intersect(a.p, b.p)) AS parent FROM full_ JOIN ps a ON a.iid = id1 JOIN ps b ON b.iid = id2),
sized AS (SELECT c, count(DISTINCT parent) AS lo, min(parent) AS known FROM grp LEFT JOIN common_ USING (node) GROUP BY c), lack AS (SELECT c, lo, f.sex AS s FROM sized LEFT JOIN fam f ON f.iid = known WHERE lo < 2){LACKING}) out_""")
def added_parents(po, fam, king):
    return B.insert_parents(stored(B.classify_siblings(po, fam, king), "classified"), fam)


AGED = ", aged AS (SELECT CASE WHEN strength <= 15 AND parent_age < 40 THEN child ELSE parent END AS parent, CASE WHEN strength <= 15 AND parent_age < 40 THEN parent ELSE child END AS child, strength > 15 OR parent_age < 40 AS locked FROM po_file)"


@query("po_file", f"{AGED} SELECT * FROM aged")
def po_orientation(po):
    return A.orient_by_age(po, 40)


PARTNERS = ", partners AS (SELECT parent AS iid, child AS partner FROM aged UNION SELECT child, parent FROM aged)"
RULED = """, first_ AS (SELECT least(iid, partner) AS lo, greatest(iid, partner) AS hi, min(iid) AS by_, arg_min(is_parent, iid) AS is_parent FROM rulings GROUP BY ALL)
SELECT CASE WHEN locked OR by_ IS NULL THEN parent WHEN is_parent = (by_ = lo) THEN hi ELSE lo END AS parent, CASE WHEN locked OR by_ IS NULL THEN child WHEN is_parent = (by_ = lo) THEN lo ELSE hi END AS child, locked OR by_ IS NOT NULL AS locked
FROM aged a LEFT JOIN first_ f ON f.lo = least(parent, child) AND f.hi = greatest(parent, child)"""


@query("po_file king_typed", f"{AGED}{PARTNERS}, pairs_ AS (SELECT a.iid, a.partner AS p1, b.partner AS p2 FROM partners a JOIN partners b ON a.iid = b.iid AND a.partner < b.partner LEFT JOIN king_typed k ON k.id1 = a.partner AND k.id2 = b.partner WHERE coalesce(inftype, 'UN') IN ('4th', 'UN')), "
    f"chosen AS (SELECT iid, min(struct_pack(p1 := p1, p2 := p2)) AS c FROM pairs_ GROUP BY iid), rulings AS (SELECT iid, partner, partner IN (c.p1, c.p2) AS is_parent FROM partners JOIN chosen USING (iid)){RULED}")  # fmt: skip
def po_orientation_unrelated(po, king):
    return A.orient_by_unrelated(stored(A.orient_by_age(po, 40), "aged"), king)


@query("po_file king_turned")
def po_orientation_turned(po, turned):
    return A.orient_by_unrelated(stored(A.orient_by_age(po, 40), "aged"), turned)


ORACLES["po_orientation_turned"] = ORACLES["po_orientation_unrelated"]


@query("po_file king_typed", f"{AGED}{PARTNERS}, links AS (SELECT id1 AS a, id2 AS b FROM king_typed WHERE ibd2seg > 0.22 UNION ALL SELECT id2, id1 FROM king_typed WHERE ibd2seg > 0.22), reach(root, node) AS (SELECT DISTINCT a, a FROM links UNION SELECT root, b FROM reach JOIN links ON a = node), "
    "sets AS (SELECT node AS iid, min(root) AS c FROM reach GROUP BY node), sized AS (SELECT c, count(*) AS size FROM sets GROUP BY c), "
    f"common AS (SELECT c, partner FROM partners JOIN sets USING (iid) GROUP BY c, partner HAVING count(*) = (SELECT size FROM sized z WHERE z.c = sets.c)), rulings AS (SELECT iid, p.partner, m.partner IS NOT NULL AS is_parent FROM partners p JOIN sets USING (iid) LEFT JOIN common m ON m.c = sets.c AND m.partner = p.partner){RULED}")  # fmt: skip
def po_orientation_fullsibs(po, king):
    return A.orient_by_fullsibs(stored(A.orient_by_age(po, 40), "aged"), stored(A.fullsib_sets(king, 0.22), "sets"))


ASSIGNED = """, mixed_fam AS (SELECT iid, CASE WHEN iid % 5 = 0 THEN 0 ELSE sex END AS sex FROM fam),
assigned AS (SELECT child AS iid, min(parent) FILTER (sex = 1) AS father, min(parent) FILTER (sex = 2) AS mother, count(DISTINCT parent) FILTER (sex = 1) AS n_fathers,
    count(DISTINCT parent) FILTER (sex = 2) AS n_mothers, count(DISTINCT parent) FILTER (sex = 0) AS n_sexless FROM aged JOIN mixed_fam ON iid = parent GROUP BY child)"""


def _mixed(fam):
    return fam.select("iid", F.when(F.col("iid") % 5 == 0, 0).otherwise(F.col("sex")).alias("sex"))


@query("po_file fam", f"{AGED}{ASSIGNED} SELECT * FROM assigned")
def parent_assignment(po, fam):
    return A.assign_parents(A.orient_by_age(po, 40), _mixed(fam))


QC = f"""{AGED}{ASSIGNED} SELECT 'duplicate' AS kind, iid AS subject, n_fathers || ' ' || n_mothers AS detail FROM assigned WHERE n_fathers > 1 OR n_mothers > 1
UNION ALL SELECT 'sex', iid, CAST(n_sexless AS VARCHAR) FROM assigned WHERE n_sexless > 0
UNION ALL SELECT 'ageGap', child, parent || ' ' || CAST(strength AS INT) FROM po_file WHERE strength <= 15
UNION ALL SELECT 'relatedParents', iid, father || ' ' || mother || ' ' || inftype FROM assigned JOIN king_typed ON id1 = least(father, mother) AND id2 = greatest(father, mother) WHERE inftype IN ('2nd', 'FS', 'PO')"""


@query("po_file fam king_typed", QC)
def pedigree_qc(po, fam, king):
    return A.pedigree_qc(po, A.assign_parents(A.orient_by_age(po, 40), _mixed(fam)), king)


@query("po_file fam king_typed", QC)
def file_report(po, fam, king):
    """The report through its files."""
    path = scratch(po.sparkSession, "files")
    W.write_report(A.pedigree_qc(po, A.assign_parents(A.orient_by_age(po, 40), _mixed(fam)), king), path)
    return po.sparkSession.read.schema("subject bigint, detail string, kind string").option("sep", "\t").csv(path)


@query("po_file fam", f"{AGED}{ASSIGNED} SELECT f.iid, f.fid, coalesce(f.father, a.father) AS father, coalesce(f.mother, a.mother) AS mother, f.sex FROM fam f LEFT JOIN assigned a ON a.iid = f.iid")
def completed_fam(po, fam):
    return A.complete_fam(fam, A.assign_parents(A.orient_by_age(po, 40), _mixed(fam)))


#: Two colours of co-parents by the parity of the way from a family's smallest one, with known sexes and mean of min(h1, h2) of each.
COLOURED = """, sexes AS (SELECT iid, CASE WHEN iid % 5 < 3 THEN 0 ELSE sex END AS sex FROM fam), sets_ AS (SELECT child, list_sort(list_distinct(list(parent))) AS ps FROM po_file GROUP BY child),
two AS (SELECT ps[1] AS a, ps[2] AS b FROM sets_ WHERE len(ps) = 2 UNION SELECT ps[2], ps[1] FROM sets_ WHERE len(ps) = 2),
reach(root, node, par) AS (SELECT DISTINCT a, a, 0 FROM two UNION SELECT root, b, 1 - par FROM reach JOIN two ON a = node),
col AS (SELECT node, root AS c, min(par) AS colour FROM reach r WHERE root = (SELECT min(root) FROM reach q WHERE q.node = r.node) GROUP BY node, root),
low AS (SELECT parent, sum(least(h1, h2)) AS h, count(*) AS k FROM po_file GROUP BY parent)"""


@query("po_file fam", f"""{COLOURED}, stat AS (SELECT c, colour, count(DISTINCT nullif(sex, 0)) AS n, max(nullif(sex, 0)) AS s, sum(h) / sum(k) AS m FROM col JOIN sexes ON iid = node LEFT JOIN low ON parent = node GROUP BY ALL),
ruled AS (SELECT a.c, a.colour, CASE WHEN a.n = 1 AND b.n = 1 AND a.s <> b.s THEN a.s WHEN a.m > b.m OR (a.m = b.m AND a.colour = 1) THEN 1 ELSE 2 END AS sex,
  CASE WHEN a.n = 1 AND b.n = 1 AND a.s <> b.s THEN 'known' WHEN a.n > 1 OR b.n > 1 THEN 'mixed' ELSE 'mean' END AS how FROM stat a LEFT JOIN stat b ON b.c = a.c AND b.colour = 1 - a.colour),
paired AS (SELECT node AS iid, sex, how FROM col JOIN ruled USING (c, colour)),
means AS (SELECT sum(h) FILTER (sex = 1) / sum(k) FILTER (sex = 1) AS m1, sum(h) FILTER (sex = 2) / sum(k) FILTER (sex = 2) AS m2 FROM paired LEFT JOIN low ON parent = iid),
single AS (SELECT DISTINCT ps[1] AS iid FROM sets_ WHERE len(ps) = 1 AND ps[1] NOT IN (SELECT iid FROM paired)),
every AS (SELECT * FROM paired UNION ALL SELECT iid, CASE WHEN abs(h / k - m2) < abs(h / k - m1) THEN 2 ELSE 1 END, 'nearest' FROM single JOIN low ON parent = iid CROSS JOIN means)
SELECT iid, CAST(e.sex AS INT) AS sex, how FROM every e JOIN sexes USING (iid) WHERE sexes.sex = 0""")
def parent_sex(po, fam):
    sexes = fam.select("iid", F.when(F.col("iid") % 5 < 3, 0).otherwise(F.col("sex")).alias("sex"))
    return A.infer_parent_sex(po, sexes)


@query("po_file fam", f"""{COLOURED.replace("CASE WHEN iid % 5 < 3 THEN 0 ELSE sex END", "CASE WHEN iid % 7 = 0 THEN 3 - sex ELSE sex END")}, many AS (SELECT c FROM col JOIN sexes ON iid = node GROUP BY c, colour HAVING count(DISTINCT sex) > 1)
SELECT 'multipleSex' AS kind, node AS subject, c || ' ' || colour || ' ' || sex AS detail FROM col JOIN sexes ON iid = node WHERE c IN (SELECT c FROM many)""")
def mixed_sex_groups(po, fam):
    # Every seventh person's sex is entered wrongly.
    sexes = fam.select("iid", F.when(F.col("iid") % 7 == 0, 3 - F.col("sex")).otherwise(F.col("sex")).alias("sex"))
    return A.mixed_sex_groups(A.parent_colours(po), sexes)


# --- the whole job ------------------------------------------------------------------------------------------------------


SECOND = ", ".join(f"'{x}'" for x in J.SECOND)
CLOSE_SEGMENTS = ", close_ AS (SELECT s.* FROM segments s WHERE EXISTS (SELECT 1 FROM king_typed k WHERE k.id1 = s.id1 AND k.id2 = s.id2 AND propibd >= pow(2, -3.5)))"


def nested(sql: str) -> str:
    """A list of named steps that ends with a SELECT, as a table."""
    return f"(SELECT * FROM (WITH one_ AS (SELECT 1){sql}) nested_)"


def stats_sql(name: str, segments: str) -> str:
    return f", {name} AS {nested(STATS.replace('FROM segments', f'FROM {segments}') + ' SELECT * FROM stats')}"


def scored_sql(name: str, *how: str) -> str:
    """Class probabilities of a discriminant, not rounded."""
    sql = lda_sql(*how).replace("round(e / sum(e) OVER (PARTITION BY id1, id2), 9)", "e / sum(e) OVER (PARTITION BY id1, id2)")
    return f", {name} AS {nested(sql)}"


def errors_sql(segments: str) -> str:
    """``err``: statistics after switch errors, drawn with seed 0."""
    return stats_sql("err", "split").replace("(WITH one_ AS (SELECT 1)", "(WITH one_ AS (SELECT 1)" + SWITCHES.replace("'7:'", "'0:'").replace("FROM segments", f"FROM {segments}"), 1)


NAMED = CODES_SQL + PATHS + GROUPS + KNOWN.replace("LEFT JOIN king k", "LEFT JOIN king_typed k").replace("name AS rel, degree,", "name AS rel, degree, CASE WHEN degree = 'relatives' THEN name ELSE degree END AS class,")


def labels_sql(assess: bool) -> str:
    """The whole job from the steps above: known pairs, three discriminants, the cascade and the labels at one half."""
    only = "JOIN (SELECT DISTINCT id1 AS t1, id2 AS t2 FROM taught) t ON t1 = s.id1 AND t2 = s.id2" if assess else ""
    second = "SELECT DISTINCT id1, id2 FROM taught WHERE degree = '2nd'" if assess else "SELECT id1, id2 FROM deg WHERE class = '2nd' AND p > 0.2"
    sums = " UNION ALL ".join(f"SELECT id1, id2, '{n}' AS node, sum(p) AS p FROM seg WHERE class IN ({', '.join(repr(x) for x in xs)}) GROUP BY id1, id2" for n, xs in (("GP", ("PGP", "MGP")), ("HS", ("PHS", "MHS")), ("GPAV", ("PGP", "MGP", "AV"))))
    return f"""{NAMED}{CLOSE_SEGMENTS}{stats_sql("stats_", "close_")}{errors_sql("close_")},
taught AS (SELECT known.*, ibd1, ibd2, n, h1, h2 FROM known JOIN stats_ USING (id1, id2)),
rows_ AS (SELECT s.*, ibd1seg AS k_ibd1, ibd2seg AS k_ibd2 FROM stats_ s JOIN king_typed k ON k.id1 = s.id1 AND k.id2 = s.id2 {only}){scored_sql("deg", "taught", "rows_", "id1, id2", "k_ibd1", "k_ibd2", "class")},
chosen AS (SELECT rows_.* FROM rows_ JOIN ({second}) x USING (id1, id2)),
counted AS (SELECT rel, k_ibd1 + k_ibd2 AS cov, CAST(n AS DOUBLE) AS nn FROM taught WHERE rel IN ({SECOND})){scored_sql("seg", "counted", "(SELECT id1, id2, ibd1 + ibd2 AS cov, CAST(n AS DOUBLE) AS nn FROM chosen) q", "id1, id2", "cov", "nn", "rel")},
phased AS (SELECT CASE WHEN rel IN ('PHS', 'MHS') THEN 'HS' ELSE 'GPAV' END AS class, h1, h2 FROM taught WHERE rel IN ({SECOND})
  UNION ALL SELECT 'Phase error', e.h1, e.h2 FROM taught t JOIN err e ON e.id1 = t.id1 AND e.id2 = t.id2 WHERE rel IN ({SECOND})){scored_sql("hap", "phased", "(SELECT id1, id2, greatest(h1, h2) AS h1, least(h1, h2) AS h2 FROM chosen) q", "id1, id2", "h1", "h2", "class")},
sure AS (SELECT id1, id2 FROM hap WHERE class = 'Phase error' AND p < 0.2),
base_ AS (SELECT id1, id2, class AS node, p FROM deg UNION ALL SELECT id1, id2, class, p FROM seg UNION ALL {sums}),
given AS (SELECT b.id1, b.id2, b.node, coalesce(h.p, b.p) AS p_con FROM base_ b LEFT JOIN (SELECT hap.* FROM hap JOIN sure USING (id1, id2) WHERE class IN ('HS', 'GPAV')) h ON h.id1 = b.id1 AND h.id2 = b.id2 AND h.class = b.node){FALL}{picked_sql(0.5)}
SELECT id1, id2, k_ibd1, k_ibd2, round(h1, 6) AS h1, round(h2, 6) AS h2, most_probable, round(probability, 6) AS probability, degree FROM rows_ JOIN picked USING (id1, id2)"""


@query("fam po king_typed segments", labels_sql(False))
def label_pairs(fam, _, king, segments):
    return rounded(J.label_pairs(fam, king, segments, GENOME_CM, drop_twins=False), "probability", "h1", "h2")


@query("fam po king_typed segments", labels_sql(True))
def label_known_pairs(fam, _, king, segments):
    return rounded(J.label_pairs(fam, king, segments, GENOME_CM, assess=True, drop_twins=False), "probability", "h1", "h2")


@query("fam po king_typed segments king_turned segments_turned", labels_sql(False))
def label_turned_pairs(fam, _, __, ___, king, segments):
    """Kinship and segments name pairs in any order; codes and tree come from a file."""
    spark, path = fam.sparkSession, scratch(fam.sparkSession, "files")
    W.write_codes(spark, path, K.CODES, H.TREE)
    done = J.label(fam, king, segments, GENOME_CM, drop_twins=False, codes=R.load_codes(spark, path), tree=R.load_tree(spark, path))
    return rounded(done.labels(), "probability", "h1", "h2")


TWINLESS = """, twins AS (SELECT id2 AS iid FROM king_typed WHERE inftype = 'Dup/MZ'), po_kept AS (SELECT * FROM po WHERE child NOT IN (SELECT iid FROM twins)),
king_kept AS (SELECT * FROM king_typed WHERE id1 NOT IN (SELECT iid FROM twins) AND id2 NOT IN (SELECT iid FROM twins))"""


@query("fam po king_typed segments", TWINLESS + re.sub(r"\bking_typed\b", "king_kept", re.sub(r"\bpo\b", "po_kept", labels_sql(False))).replace("FROM walk w JOIN fam f ON f.iid = w.first_parent", "FROM walk w JOIN fam f ON f.iid = w.first_parent WHERE focal NOT IN (SELECT iid FROM twins) AND w.id2 NOT IN (SELECT iid FROM twins)"))
def label_without_twins(fam, _, king, segments):
    """The second of each Dup/MZ pair leaves the job, as it does by default."""
    return rounded(J.label_pairs(fam, king, segments, GENOME_CM), "probability", "h1", "h2")


TRAINED = ", ".join(f"round({c}, 6) AS {c}" if c in ("ibd1", "ibd2", "h1", "h2") else c for c in ("ibd1", "ibd2", "n_ibd1", "n_ibd2", "n", "h1", "h2"))


@query("po fam king_typed segments", f"""{NAMED}{stats_sql("stats_", "segments")}{errors_sql("segments")}
SELECT id1, id2, rel, class, {TRAINED}, 'real' AS copy FROM known JOIN stats_ USING (id1, id2) UNION ALL SELECT id1, id2, rel, class, {TRAINED}, 'error' FROM known JOIN err USING (id1, id2) WHERE rel IN ({SECOND})""")
def training_table(po, fam, king, segments):
    known = K.known_pairs(stored(J.sibship_groups(po, fam, king), "groups"), _codes(po), king)
    return rounded(J.training_table(stored(known, "known"), segments, GENOME_CM), "ibd1", "ibd2", "h1", "h2")


@query("fam po king_typed segments", labels_sql(False).replace("SELECT id1, id2, k_ibd1", "SELECT CAST(id1 AS VARCHAR) AS id1, CAST(id2 AS VARCHAR) AS id2, k_ibd1"))
def file_labels(fam, _, king, segments):
    """Models are written, and all pairs labelled by what is read again; the labels go through the readable file."""
    spark, path = fam.sparkSession, scratch(fam.sparkSession, "files")
    of = J.ready(fam, king, segments, GENOME_CM, drop_twins=False)
    J.write_models(J.train(of, J.known_relatives(of)), f"{path}-models")
    done = J.scored(of, J.read_models(spark, f"{path}-models"))
    W.write_readable(rounded(done.labels(), "probability", "h1", "h2"), path, with_h=True)
    return spark.read.schema("id1 string, id2 string, k_ibd1 double, k_ibd2 double, most_probable string, probability double, degree string, h1 double, h2 double").option("sep", "\t").option("header", True).csv(path)
