"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's probability is a logistic function of its words; a document's is the noisy-or of
its sentences, 1 - prod(1 - p).  Training on document labels moves the sentences that explain a toxic label and pushes down
every sentence of a clean one.  A soft threshold leaves weights only on words that matter.

At most ``TRAIN_DOCS`` labelled documents of each class are used, those with the smallest hashes of doc_id, weighted back to
the classes' true share.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import doc_bucket, prepare

TRAIN_DOCS = 2500
MIN_DOCS, ROUNDS, RATE, SHRINK = 4, 150, 0.15, 2e-4
PIECE = re.compile(r"[^\W_]+|[.!?\n]")
STOPS = frozenset(".!?\n")
#: Words remembered with their weight.
KNOWN_WORDS = 200_000


class _Weights(dict):
    """Weights by the words as they stand; those not met yet are looked up lower-cased."""

    def __init__(self, lower: dict[str, float]):
        super().__init__()
        self.lower = lower

    def __missing__(self, word: str) -> float:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = self.lower.get(word.lower(), 0.0)
        return found


class Sentences:
    """Weights of words and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known = _Weights(weights)

    def __reduce__(self):
        return Sentences, (self.weights, self.bias)

    def cut(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, sum of weights and bias) of each sentence, places in code points; a sentence has a word at least."""
        out, start, total, last, known = [], None, self.bias, 0, self.known
        for m in PIECE.finditer(text or ""):
            piece = m.group()
            if piece in STOPS:
                if start is not None:
                    out.append((start, m.end(), total))
                start, total = None, self.bias
            else:
                start, last = m.start() if start is None else start, m.end()
                total += known[piece]
        if start is not None:
            out.append((start, last, total))
        return out

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence."""
        return [(a, b, probability(z)) for a, b, z in self.cut(text)]

    def score(self, text: str | None) -> float:
        """Noisy-or of the sentences; a text without words scores 0."""
        return noisy_or(self.cut(text))


def probability(z: float) -> float:
    return float(1 / (1 + np.exp(-z)))


def noisy_or(cut: list[tuple[int, int, float]]) -> float:
    """1 - prod(1 - p) over sentences as ``cut`` gives them."""
    return float(-np.expm1(-np.logaddexp(0.0, [z for _, _, z in cut]).sum())) if cut else 0.0


def words_in(text: str) -> list[str]:
    """Words, lower-cased once they are cut, and stops, as ``Sentences.cut`` takes them."""
    return [p if p in STOPS else p.lower() for p in PIECE.findall(text)]


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Sentences:
    """Weighted maximum likelihood of the noisy-or, by Adam with a soft threshold."""
    bags, owner = [], []
    for n, text in enumerate(texts):
        held: list[str] = []
        for piece in [*words_in(text), "."]:
            if piece not in STOPS:
                held.append(piece)
            elif held:
                bags.append(held)
                owner.append(n)
                held = []
    if not bags or labels.min() == labels.max():
        share = float(np.average(labels, weights=weights)) if len(labels) else 0.0
        return Sentences({}, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))) if share < 1 else 10.0)
    seen = Counter(w for n in range(len(texts)) for w in set(words_in(texts[n])))
    vocab = {w: k for k, w in enumerate(sorted(w for w, c in seen.items() if c >= MIN_DOCS and w not in STOPS))}
    rows = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    cols = np.array([vocab.get(w, -1) for b in bags for w in b])
    rows, cols = rows[cols >= 0], cols[cols >= 0]
    owner_ = np.array(owner)
    share = np.average(labels, weights=weights)
    per_doc = len(bags) / len(texts)
    theta, bias = np.zeros(len(vocab)), float(np.log(share / per_doc))
    m, v, mb, vb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    mass = weights / weights.sum()
    for n in range(1, ROUNDS + 1):
        z = np.bincount(rows, theta[cols], len(bags)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        keep = np.exp(-np.bincount(owner_, np.logaddexp(0, z), len(texts)))
        odds = np.where(labels == 1, -keep / np.maximum(1 - keep, 1e-9), 1.0) * mass
        g = odds[owner_] * p
        slope, sb = np.bincount(cols, g[rows], len(vocab)), g.sum()
        m += 0.1 * (slope - m)
        v += 0.01 * (slope * slope - v)
        mb += 0.1 * (sb - mb)
        vb += 0.01 * (sb * sb - vb)
        scale = 1 / (np.sqrt(v / (1 - 0.99**n)) + 1e-5)
        theta -= RATE * m / (1 - 0.9**n) * scale
        theta = np.sign(theta) * np.maximum(np.abs(theta) - RATE * SHRINK * scale, 0)
        bias -= RATE * mb / (1 - 0.9**n) / (np.sqrt(vb / (1 - 0.99**n)) + 1e-5)
    return Sentences({w: float(theta[k]) for w, k in vocab.items() if theta[k]}, float(bias))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, left_out: int = 0, per_class: int = TRAIN_DOCS) -> Sentences:
    """A model from labelled documents whose crc32 bucket of doc_id isn't ``left_out``.

    Labels other than 0 and 1 are left out; of several labels of a doc_id the larger counts; null texts teach nothing.
    """
    marks = labels.where((doc_bucket("doc_id", modulus) != left_out) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids, sizes = [], {}
    for y in (0, 1):
        of = marks.where(F.col("toxic") == y)
        sizes[y] = of.count()
        ids.append(of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    chosen = F.broadcast(ids[0].union(ids[1]))  # at most 2 * per_class rows
    # One text of each id, so that repeated rows don't widen the sample.
    rows = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.toxic for r in rows], dtype=np.int64)
    got = np.bincount(y, minlength=2) if len(y) else np.zeros(2)
    weight = np.array([sizes[k] / max(1, got[k]) for k in (0, 1)])
    return fit([r.text for r in rows], y, weight[y] if len(y) else np.zeros(0))


def score(docs: DataFrame, model: Sentences, locate: float | None = None) -> DataFrame:
    """The rows of ``docs`` with ``score``; with ``locate`` also ``offending``, the sentences of at least that probability.

    Columns of these names are replaced.  Null and empty texts score 0 and have no sentences; an empty table gives no rows.  Texts of any length count with all
    their sentences.  Rows are scored one by one, so repeated rows score alike.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("score", "offending")
    names, text = docs.columns, docs.columns.index("text")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One cut of each text gives its score and its sentences.
            cuts = [shared.value.cut(t.as_py()) for t in batch.column(text)]
            extra = [pa.array([noisy_or(c) for c in cuts], pa.float64())]
            if locate is not None:
                found = [[{"start": a, "end": b, "score": p} for a, b, z in c if (p := probability(z)) >= locate] for c in cuts]
                extra.append(pa.array(found, pa.list_(span)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "score", "offending"][: len(names) + len(extra)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    more = ", offending array<struct<start: bigint, end: bigint, score: double>>" if locate is not None else ""
    return docs.mapInArrow(work, f"{fields}, score double{more}")
