"""Each operator and stage on null, empty, blank and very long texts, repeated rows, clashing columns and empty tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import adsearch, attnlm, common, dac, decontam, langcrf, linededup, minmax, mixing, secretscan, toxicmil

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda i: (i is None, i))


ALL = [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, None]


def test_line_dedup(odd):
    out = linededup.drop_lines(odd, linededup.line_bitmaps(odd))
    assert ids(out) == ALL and len(out.columns) == len(odd.columns) + 2
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in out.collect()}
    assert got[1] == (1, 0, "") and got[2] == (1, 0, "") and got[8] == (3, 0, "\n\n")
    assert linededup.drop_lines(odd.limit(0), linededup.line_bitmaps(odd.limit(0))).count() == 0


def test_line_dedup_of_one_row_given_twice(docs):
    line = "A line that is certainly longer than forty characters in all"
    df = docs(*[(i, f"{line}\nown {i}") for i in (1, 2, 3, 4, 5, 5)], (6, f"\t{line.upper()} "))
    got = sorted((r.doc_id, r.n_dropped) for r in linededup.drop_lines(df, linededup.line_bitmaps(df)).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (5, 1), (6, 0)]


def test_near_duplicates(odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(odd, 2, 80).collect()), key=str)
    by = {g[0]: g for g in got}
    assert len(got) == 11 and by[6] == (6, 3, 5, False) and by[5][3] and by[1] == (1, 0, 1, True) and by[None][2] is None
    assert minmax.near_duplicates(odd.limit(0)).count() == 0


def test_codes_round_trip(spark, odd):
    path = common.scratch(spark, "edge")
    dac.write_tokens(odd, path, TOKENIZER, block_tokens=1000)
    got = dac.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    from tokenizers import Tokenizer

    tok, start, texts = Tokenizer.from_file(TOKENIZER), 0, {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        want = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    last = got[-1]
    assert dac.token_at(spark.read.schema(dac.BLOCKS).parquet(path), last.part, last.seq, last["at"] + last.n_tokens - 1) == 1
    empty = common.scratch(spark, "edge")
    dac.write_tokens(odd.limit(0), empty, TOKENIZER)
    assert dac.read_tokens(spark, empty).count() == 0


def test_language_model(odd):
    out = attnlm.score_texts(odd, F.col("doc_id") != 5, TOKENIZER)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 11 and got[1].n_tokens == 1 and got[1].n_known == 1 and got[4].n_tokens == 40_001
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got.values())
    assert attnlm.score_texts(odd.limit(0), F.lit(True), TOKENIZER).count() == 0
    none = attnlm.score_texts(odd, F.lit(False), TOKENIZER).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 for r in none)


def test_secrets(odd):
    out = secretscan.scan(odd)
    assert ids(out) == ALL and all(r.spans == [] for r in out.collect())
    assert secretscan.scan(odd.limit(0)).count() == 0


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "same words again here"), (3, "same words again here"), (4, " ")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.leaks(odd, items).collect())
    assert got == [(5, 3), (5, 3), (6, 3), (6, 3), (6, 3), (6, 3)]
    assert decontam.leaks(odd.limit(0), items).count() == 0 and decontam.leaks(odd, items.limit(0)).count() == 0


def test_mixing(odd):
    out = mixing.mix(odd)
    assert set(ids(out)) >= {1, 2, 3, 8} and out.columns.count("rate") == 1
    assert mixing.mix(odd, labels=False).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


def test_language(spark, odd):
    field = langcrf.train(odd)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langcrf.label(odd, field).collect()}
    assert got[1] == ("und", 0.0) and got[9] == ("und", 0.0) and got[4] == ("en", 1.0) and len(got) == 10
    assert langcrf.label(odd.limit(0), langcrf.train(odd.limit(0))).count() == 0
    assert {r.lang_pred for r in langcrf.label(odd, langcrf.train(odd.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_toxicity(spark, odd):
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, None), (7, 3), (None, 1)], "doc_id long, toxic int")
    out = toxicmil.score(odd, toxicmil.train(odd, labels), locate=0.5)
    assert ids(out) == ALL and all(0 <= r.score <= 1 for r in out.collect())
    assert toxicmil.score(odd.limit(0), toxicmil.train(odd.limit(0), labels.limit(0))).count() == 0


def test_search(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, [2.0, 0.0]), (6, [2.0, 0.0]), (20, [1.0, 1.0]), (7, []), (8, [float("inf"), 0.0]), (None, [3.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2.0, 5) for r in rows], "vec_id long, embedding array<double>, row int, list string, v double, asked int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in adsearch.search(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 2.0), (0, 2, 6, 2.0), (0, 3, 6, 2.0), (0, 4, 20, 1.0), (20, 1, 5, 2.0), (20, 2, 6, 2.0), (20, 3, 6, 2.0), (20, 4, 0, 1.0)]
    assert adsearch.search(df.limit(0), F.lit(True)).count() == 0 and adsearch.search(df, F.lit(False)).count() == 0


def test_search_of_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0]), (1, [0.5, 0.25])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in adsearch.search(df, "vec_id % 20 = 0").collect())
    one, other = [(1.0, 20), (0.5, 1), (0.0, 20)], [(0.25, 1), (0.0, 20), (0.0, 20)]
    assert got == sorted((20, n, i, s) for found in (one, one, other) for n, (s, i) in enumerate(found, 1))


@pytest.mark.parametrize("odd_one", [[9.0], [9.0, 9.0, 9.0]])
def test_search_with_a_malformed_first_vector(spark, odd_one):
    rows = [(0, odd_one), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (20, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in adsearch.search(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 2), (20, 2, 1)]
    # Of two lengths as frequent the longer counts; alone with it, a vector has no neighbour.
    assert adsearch.search(df.where("vec_id in (0, 1)"), F.lit(True)).count() == 0


def test_stages(spark, odd, sf_dir):
    at = odd
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, at, sf_dir), "stage")
        assert name == "tokens" or out.columns == odd.columns, name
        assert stage(spark, odd.limit(0), sf_dir).count() == 0, name
        if name == "tokens":
            assert ids(out) == ids(at) and {r.doc_id: r.n_tokens for r in out.collect()}[4] > 40_000
        at = out
    every = {r.doc_id: r.n_tokens for r in corpus_pipeline.tokens(spark, odd, sf_dir).collect()}
    assert set(every) == set(ALL) and every[1] == every[2] == 1
    assert ids(corpus_pipeline.decontaminate(spark, odd, sf_dir)) == ALL
    assert 9 not in ids(at) and 4 in ids(corpus_pipeline.language(spark, odd, sf_dir))
    assert ids(corpus_pipeline.near_dedup(spark, odd, sf_dir)) == [1, 2, 3, 4, 5, 7, 8, 9, None]


def test_near_dedup_keeps_one_row_of_an_id(spark, docs, sf_dir):
    one, other = "some words that stay as they are here", "other words under the same id as before them"
    got = corpus_pipeline.near_dedup(spark, docs((1, one), (1, one), (2, other), (2, "quite another line of words that nothing else here holds"), (3, None), (3, None), (None, None), (None, None)), sf_dir)
    assert ids(got) == [1, 2, 3, None, None]
