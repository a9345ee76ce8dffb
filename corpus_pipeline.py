"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. language ID: documents that the conditional random field gives no language go;
2. near-dedup: of documents whose five-word shingle sets are linked at 0.8, the smallest doc_id stays;
3. decontamination: documents that hold a benchmark passage go;
4. mixing: documents are sampled so that source, language and topic meet their target shares of tokens;
5. tokens: what is left is encoded and written as directly addressable codes; one row a document says where it lies.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm import dac, decontam, langcrf, minmax, mixing
from kinfold.llm.common import prepare, scratch, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language; those without a letter, null and empty ones among them, are rejected.

    Texts count whole, however long; repeated rows are labelled and kept alike, rows without a doc_id like others; columns with the names used inside keep their values; an empty table stays empty.
    """
    prepare(spark)
    labelled = langcrf.label(docs, langcrf.train(docs), ("__lang_pred", "__score"))
    return labelled.where(labelled["__lang_pred"] != langcrf.UNKNOWN).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, and one row of each doc_id that stays, that of the smallest text.

    Texts without words are copies of nothing and stay; rows without a doc_id belong to no group and stay as they are.  Empty tables stay empty, texts count whole.
    """
    groups = stored(minmax.near_duplicates(docs, width=5, percent=80), "groups")
    gone = groups.where("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Ids given more than once, counted without the texts; as a rule there are none.
    often = stored(groups.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "often")
    if often.isEmpty():
        return kept
    once = kept.join(often, "doc_id", "left_anti").select(*docs.columns)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    first = kept.join(often, "doc_id", "left_semi").withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
    return once.unionByName(first)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; null and empty texts hold none and stay, as do rows without a doc_id; texts are searched whole.

    A doc_id goes with all its rows if one of them holds an item; repeated rows of a clean one all stay; an empty table stays empty.
    """
    leaked = decontam.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents by calibrated rates; null labels are a class, texts without words stay, repeated rows share their draw; texts of any length count with all their words; an empty table stays empty."""
    return mixing.mix(docs, labels=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the codes and give each document's place in them; a null or empty text is the end id alone, repeated rows are each written, an empty table gives no rows."""
    import public_tokenizers

    path = scratch(spark, "tokens")
    dac.write_tokens(docs, path, public_tokenizers.path(TOKENIZER))
    return dac.read_tokens(spark, path)


STAGES: list[tuple[str, Stage]] = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: A conditional random field, a hash search and a tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; what a stage returns is stored in the shared folder for the next."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
