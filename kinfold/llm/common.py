"""Small helpers shared by the text operators: shared storage, worker paths and words."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.plans.lineage import scratch, shared_dir, stored

__all__ = ["BLANKS", "doc_bucket", "gathered", "prepare", "scratch", "shared_dir", "stored", "table", "text_chunks", "word_numbers", "words_of"]

#: White space that separates words: space and the five ASCII controls from tab to carriage return.
BLANKS = " \t\n\x0b\f\r"

_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers of a local session import this package whatever the working folder is."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), _ROOT) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 with A-Z lower-cased; other letters stay as they are."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_numbers(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of ``words_of`` for many texts (as they stand, if not ``lower``): the distinct words, the number of each word in them, and how many words each text has."""
    texts = texts.fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    number = coded.indices.to_numpy()
    # A blank at either end leaves an empty piece.
    real = (pc.binary_length(coded.dictionary).to_numpy() > 0)[number]
    so_far = np.concatenate(([0], np.cumsum(real)))
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return coded.dictionary, number[real], np.diff(so_far[bounds])


def text_chunks(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``size`` bytes of column number ``text``, or of one longer text."""
    for batch in batches:
        total = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + size, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts`` and have ``sizes``, one after another."""
    stop = np.cumsum(sizes)
    return flat[np.repeat(starts - (stop - sizes), sizes) + np.arange(int(stop[-1]) if len(stop) else 0)]
