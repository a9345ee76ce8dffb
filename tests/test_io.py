"""Readers and writers on small files."""

import pytest

from kinfold.operators.hierarchy import TREE
from kinfold.operators.pairs import drop_exact_twins, fill_missing_alleles
from kinfold.operators.pedigree import CODES
from kinfold.sources import readers as R
from kinfold.sources import writers as W


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fam_round_trip(spark, tmp_path):
    fam = R.read_fam(spark, put(tmp_path / "a.fam", "F1  a 0 0 1 -9\n\nF1\tb a   c 2 -9\n"))
    assert [tuple(r) for r in fam.orderBy("iid").collect()] == [("F1", "a", None, None, 1, "-9"), ("F1", "b", "a", "c", 2, "-9")]
    assert fam.count() == 2
    W.write_fam(fam, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["F1 a 0 0 1 -9", "F1 b a c 2 -9"]


def test_king_by_header_and_position(spark, tmp_path):
    path = put(tmp_path / "k.seg", "FID1 ID1 FID2 ID2 MaxIBD1 MaxIBD2 IBD1Seg IBD2Seg PropIBD InfType\nf a f b 1 1 0.5 0.1 0.35 FS\n")
    assert tuple(R.read_king(spark, path).first()) == ("a", "b", 0.5, 0.1, 0.35, "FS")
    assert [tuple(r) for r in R.read_king_positional(spark, path).collect()] == [("a", "b", 0.5, 0.1, "FS")]


def test_segments_of_many_files(spark, tmp_path):
    head = "id1 id2 id1_haplotype id2_haplotype chromosome start_cm end_cm start_bp\n"
    for k in (1, 2):
        put(tmp_path / f"chr{k}.txt", head + f"007 b 0 1 {k} 1.5 9 100\n")
    paths = R.chromosome_paths(str(tmp_path / "chr1.txt"), 2)
    assert sorted(r.chromosome for r in R.read_segments(spark, paths).collect()) == [1, 2]
    assert R.read_segments(spark, paths).first().id1 == "007"
    assert R.chromosome_paths("chr1/a.chr1.txt", 2) == ["chr1/a.chr1.txt", "chr2/a.chr2.txt"]
    assert R.chromosome_paths("x/all.txt") == ["x/all.txt"] and len(R.chromosome_paths("x/chr1.txt")) == 22


def test_maps_and_attributes(spark, tmp_path):
    assert tuple(R.read_gmap(spark, put(tmp_path / "m.map", "1 rs1 0.5 1000\n")).first()) == (1, 0.5, 1000, "rs1")
    assert tuple(R.read_gmap(spark, put(tmp_path / "g.map", "1000 0.5 1\n"), (2, 1, 0), None).first()) == (1, 0.5, 1000, None)
    assert tuple(R.read_attribute(spark, put(tmp_path / "ages", "a 41.5\n"), "age", "double").first()) == ("a", 41.5)
    assert R.read_attribute(spark, None, "age", "double").count() == 0
    assert tuple(R.read_sites(spark, put(tmp_path / "s", "1 77\n")).first()) == (1, 77)


def test_pairs_and_po(spark, tmp_path):
    assert tuple(R.read_pairs(spark, put(tmp_path / "p", "DEGREE IBD1 IBD2 PIHAT\n4th NA 0 0.1\n")).first()) == ("4th", None, 0.0, 0.1)
    path = put(tmp_path / "po", "PAIR_ID IID1 IID2 AGE1 AGE2 H1 H2 PARENT CHILD STRENGTH METHOD\na_b a b 60 30 0.9 0.8 a b 30 AGE\n")
    assert tuple(R.read_po(spark, path).first()) == ("a", "b", 60.0, 30.0, "AGE", 0.9, 0.8)


def test_codes_and_tree(spark, tmp_path):
    said = []
    for name, paths, sexed, degree, parent in CODES:
        said += [f"{name}:", *[line for sex, ways in paths.items() for line in (f"  {sex}:", *[f"    - [{w},]" for w in ways])], f"  sex: {str(sexed).lower()}", f"  degree: {degree}", *([f"  parent: {parent}"] if parent else [])]
    path = put(tmp_path / "codes.yaml", "\n".join(said))
    assert R.load_codes(spark, path) == CODES
    tree = [f"{n}:\n  degree: {a}" if a in ("relatives", "2nd", "3rd", "4th", "2nd+", "3rd+", "4th+") else f"{n}:\n  degree: 2nd\n  parent: {a}" for n, a in TREE if n[0] not in "234"]
    got = R.load_tree(spark, put(tmp_path / "tree.yaml", "\n".join(tree)))
    assert dict(got) == dict(TREE) and len(got) == len(TREE)


def test_vcf(spark, tmp_path):
    path = put(tmp_path / "v.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t5\t.\tA\tC\t.\t.\t.\tGT\t.|1\t.|.\n")
    samples = R.vcf_samples(spark, path)
    assert [tuple(r) for r in samples.orderBy("idx").collect()] == [(0, "s1"), (1, "s2")]
    pairs = spark.createDataFrame([(0, 1, 2.5)], "id1 int, id2 int, l double")
    assert tuple(R.with_sample_ids(pairs, samples).first()) == ("s1", "s2", 2.5)
    lines = [r.line for r in fill_missing_alleles(R.read_vcf_lines(spark, path)).collect()]
    assert lines[2].endswith("1|1\t0|0") and lines[0] == "##x"


def test_outputs(spark, tmp_path):
    labels = spark.createDataFrame([(1, 2, 0.5, 0.1, "FS", 0.9, "FS", 1.0, 0.5)], "id1 int, id2 int, k_ibd1 double, k_ibd2 double, most_probable string, probability double, degree string, h1 double, h2 double")
    W.write_readable(labels, str(tmp_path / "w1"))
    assert len(spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "w1")).columns) == 7
    ids = spark.createDataFrame([("a",)], "iid string")
    W.write_ids(ids, str(tmp_path / "w2"), spark.createDataFrame([(1, 0.0)], "size int, max_kinship double"))
    assert spark.read.json(str(tmp_path / "w2-summary")).first()["size"] == 1
    W.write_map(spark.createDataFrame([(1, None, 0.5, 10, True), (1, "x", 1.0, 20, False)], "chrom int, snp string, cm double, bp long, keep boolean"), str(tmp_path / "w4"))
    assert [r.value for r in spark.read.text(str(tmp_path / "w4")).collect()] == ["1 NA 0.5 10"]
    W.write_report(spark.createDataFrame([("sex", 1, "2")], "kind string, subject long, detail string"), str(tmp_path / "w5"))
    W.write_model(ids, str(tmp_path / "w6"))
    W.write_segments(ids.withColumn("pop", ids["iid"]), str(tmp_path / "s11"))
    assert R.read_segment_table(spark, str(tmp_path / "s11")).count() == 1


def test_exact_twins_compare_as_text(spark):
    ids = spark.createDataFrame([(9,), (10,)], "iid long")
    king = spark.createDataFrame([(9, 10, 0.0, 1.0)], "id1 long, id2 long, ibd1seg double, ibd2seg double")
    assert [r.iid for r in drop_exact_twins(ids, king).collect()] == [10]


def test_each_file_has_its_own_header(spark, tmp_path):
    a, b = put(tmp_path / "a", "DEGREE IBD1 IBD2 PIHAT\n4th 0.1 0 0.2\n"), put(tmp_path / "b", "PIHAT  X DEGREE IBD2 IBD1\n0.4 9 FS 0.25 0.5\n\n")
    assert sorted(tuple(r) for r in R.read_pairs(spark, [a, b]).collect()) == [("4th", 0.1, 0.0, 0.2), ("FS", 0.5, 0.25, 0.4)]
    bare = put(tmp_path / "c", "4th 0.1 0 0.2\n")
    with pytest.raises(Exception, match="no header line"):
        R.read_pairs(spark, [a, bare]).collect()
    assert R.read_pairs(spark, put(tmp_path / "d", "DEGREE IBD1 IBD2 PIHAT\n")).count() == 0


@pytest.mark.parametrize(
    ("codes", "tree", "said"),
    [
        ((CODES[0], CODES[0]), TREE, "given twice"),
        (CODES, (*TREE, TREE[3]), "given twice"),
        (CODES, tuple(t for t in TREE if t[0] != "GPAV"), "without parent: GPAV"),
        (CODES, tuple(t for t in TREE if t[0] != "HS") + (("HS", "PHS"),), "loop"),
        ((*CODES, ("XX", {1: ["1"]}, False, "2nd", None)), TREE, "no node of the tree: XX"),
        ((("FS", {1: ["-1,1"]}, False, "relatives", None),), TREE, "up and then down"),
    ],
)
def test_codes_that_do_not_fit(codes, tree, said):
    with pytest.raises(ValueError, match=said):
        R.check_codes(codes, tree)


def test_codes_and_tree_come_back(spark, tmp_path):
    W.write_codes(spark, str(tmp_path / "codes"), CODES, TREE)
    got = {c[0]: c[1:4] for c in R.load_codes(spark, str(tmp_path / "codes"))}
    assert got == {c[0]: c[1:4] for c in CODES} and dict(R.load_tree(spark, str(tmp_path / "codes"))) == dict(TREE)
