"""Language of documents by a linear-chain conditional random field over their words.

Every word gets a score for each language from affixes, character n-grams, the word itself
(hashed features, learned weights) and the lexicons that hold it; learned transitions say how rarely a text switches.
Forward-backward gives each word's language probabilities; a document's are the mean over its
words with a letter.

Training uses spans of labelled documents put one after another, so that the switches are seen too.
It takes at most ``TRAIN_DOCS`` documents a language, those with the smallest hashes of doc_id, of every language,
and ``SEQUENCES`` spliced sequences.  A language's lexicon are its training words that hardly occur in the other languages' documents.
Scoring covers whole texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import doc_bucket, prepare, text_chunks, word_numbers

BUCKETS = 1 << 15
TRAIN_DOCS = 300
SEQUENCES, LENGTH, BATCH, EPOCHS = 1600, 48, 64, 3
SPAN = (4, 40)
CHUNK_BYTES, KNOWN_WORDS = 3_000_000, 300_000
#: A lexicon word occurs so often in training at least, and such a share of its occurrences is in one language.
LEXICON_COUNT, LEXICON_SHARE = 3, 0.95
UNKNOWN = "und"


def feature_ids(word: str) -> list[int]:
    """Buckets of the word, its prefixes and suffixes up to three letters, and its trigrams with ends marked."""
    raw = word.encode("utf-8", "surrogatepass")
    crc = zlib.crc32
    out = [crc(b"=" + raw)]
    for k in (1, 2, 3):
        out += (crc(b"<" + raw[:k]), crc(b">" + raw[-k:]))
    out += [crc(raw[k : k + 3]) for k in range(len(raw) - 2)]
    return [x & (BUCKETS - 1) for x in out]


def lexicons(texts: list[list[list[str]]]) -> dict[str, int]:
    """The language number of every word that belongs to one lexicon; ``texts[k]`` holds the documents of language k as word lists."""
    counts = [Counter(w for doc in docs for w in doc) for docs in texts]
    every = Counter()
    for c in counts:
        every.update(c)
    return {w: k for k, c in enumerate(counts) for w, n in c.items() if n >= LEXICON_COUNT and n >= LEXICON_SHARE * every[w]} if len(counts) > 1 else {}


class Field:
    """Weights, transitions and lexicons; scores chunks of texts."""

    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray, init: np.ndarray, lexicon: dict[str, int] | None = None):
        """Rows of ``weights``: the hash buckets, then one for each language's lexicon."""
        self.langs, self.weights, self.trans, self.init = langs, weights.astype(np.float32), trans.astype(np.float32), init.astype(np.float32)
        self.lexicon = lexicon or {}
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs) + 1), np.float32)

    def __getstate__(self):
        return {"langs": self.langs, "weights": self.weights, "trans": self.trans, "init": self.init, "lexicon": self.lexicon}

    def __setstate__(self, state):
        self.__init__(**state)

    def features(self, word: str) -> list[int]:
        """Rows of the weights for a lower-cased word."""
        k = self.lexicon.get(word)
        return feature_ids(word) if k is None else [*feature_ids(word), BUCKETS + k]

    def _learn(self, words: list[str]) -> np.ndarray:
        """Emission scores of words, and whether each holds a letter."""
        ids = [self.features(w) for w in words]
        sizes = np.array([len(x) for x in ids])
        rows = np.add.reduceat(self.weights[np.concatenate(ids)], np.cumsum(sizes) - sizes) / np.sqrt(sizes)[:, None]
        letter = np.array([w.isalpha() or any(c.isalpha() for c in w) for w in words], np.float32)
        return np.column_stack([rows, letter]).astype(np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Emission scores and the letter mark of each word; words met before are remembered."""
        if len(self.known) > KNOWN_WORDS:
            self._reset()
        missing = [w for w in dict.fromkeys(words) if w not in self.known]
        if missing:
            at = len(self.known)
            self.known.update(zip(missing, range(at, at + len(missing)), strict=True))
            self.table = np.concatenate([self.table, *(self._learn(missing[lo : lo + 20_000]) for lo in range(0, len(missing), 20_000))])
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Language probabilities of every word; texts lie one after another in ``scores``.

        Forward and backward passes of all texts advance together, longest texts first, so a
        step costs a few array operations whatever the number of texts.
        """
        e = np.exp(scores - scores.max(1, keepdims=True))
        stop = np.cumsum(lengths)
        order = np.argsort(-lengths, kind="stable")
        first, last, lens = (stop - lengths)[order], stop[order] - 1, lengths[order]
        alive = np.searchsorted(-lens, -np.arange(int(lens.max(initial=0))), side="left")
        fwd, bwd = np.empty_like(e), np.empty_like(e)
        step = np.stack([np.exp(self.trans), np.exp(self.trans).T])
        state = None
        for t, n in enumerate(alive.tolist()):
            i, j = first[:n] + t, last[:n] - t
            here = np.stack([e[i], e[j]])
            if state is None:
                here[0] *= np.exp(self.init)
            else:
                here *= state[:, :n] @ step
            here /= here.sum(2, keepdims=True)
            fwd[i], bwd[j] = here
            state = here
        both = fwd * bwd / np.maximum(e, 1e-30)
        return both / np.maximum(both.sum(1, keepdims=True), 1e-30)

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest language, -1 where a text has no letter, and its probability, for each text."""
        distinct, number, lengths = word_numbers(texts)
        best, score = np.full(len(lengths), -1), np.zeros(len(lengths))
        at = np.flatnonzero(lengths)
        if not len(at) or not self.langs:
            return best, score
        words = [w if w.isascii() else w.lower() for w in distinct.to_numpy(zero_copy_only=False)]
        rows = self.rows(words)[number]
        lengths = lengths[at]
        probs = self.marginals(rows[:, :-1], lengths) * rows[:, -1:]
        starts = np.cumsum(lengths) - lengths
        sums, letters = np.add.reduceat(probs.astype(np.float64), starts), np.add.reduceat(rows[:, -1].astype(np.float64), starts)
        some = letters > 0
        best[at[some]] = sums[some].argmax(1)
        score[at[some]] = np.minimum(1.0, sums[some].max(1) / letters[some])
        return best, score

    def segments(self, text: str) -> list[tuple[int, int, str]]:
        """Runs of words by their likeliest language: (first word, end word, language)."""
        ws = text.lower().split()
        if not ws:
            return []
        best = self.marginals(self.rows(ws)[:, :-1], np.array([len(ws)])).argmax(1)
        cuts = np.flatnonzero(np.diff(best)) + 1
        return [(int(a), int(b), self.langs[best[a]]) for a, b in zip(np.append(0, cuts), np.append(cuts, len(ws)), strict=True)]


def _spliced(texts: list[list[list[str]]], rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Words and language numbers of sequences made of spans of random documents."""
    words, labels = [], []
    for _ in range(SEQUENCES):
        held: list[str] = []
        tags: list[int] = []
        while len(held) < LENGTH:
            k = int(rng.integers(len(texts)))
            doc = texts[k][int(rng.integers(len(texts[k])))]
            size = int(rng.integers(*SPAN))
            lo = int(rng.integers(max(1, len(doc) - size + 1)))
            held += doc[lo : lo + size]
            tags += [k] * len(doc[lo : lo + size])
        words += held[:LENGTH]
        labels += tags[:LENGTH]
    return words, np.array(labels).reshape(SEQUENCES, LENGTH)


def fit(langs: list[str], texts: list[list[list[str]]], seed: int = 3) -> Field:
    """Maximum likelihood by Adam; ``texts[k]`` holds the documents of language k as word lists."""
    n, rng = len(langs), np.random.default_rng(seed)
    if not n or not all(texts):
        return Field([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0))
    words, labels = _spliced(texts, rng)
    vocab = {w: k for k, w in enumerate(dict.fromkeys(words))}
    lexicon = lexicons(texts)
    features = Field(langs, np.zeros((0, n)), np.zeros((n, n)), np.zeros(n), lexicon).features
    feats = [np.array(features(w)) for w in vocab]
    sizes = np.array([len(f) for f in feats])
    flat, begin = np.concatenate(feats), np.cumsum(sizes) - sizes
    ids = np.array([vocab[w] for w in words]).reshape(SEQUENCES, LENGTH)
    params = [np.zeros((BUCKETS + n, n)), np.zeros((n, n)), np.zeros(n)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    now, eye = 0, np.eye(n)
    for _ in range(EPOCHS):
        order = rng.permutation(SEQUENCES)
        for lo in range(0, SEQUENCES, BATCH):
            some = order[lo : lo + BATCH]
            w, y = ids[some], labels[some]
            used, back = np.unique(w, return_inverse=True)
            span = np.concatenate([flat[begin[u] : begin[u] + sizes[u]] for u in used])
            cuts = np.cumsum(sizes[used]) - sizes[used]
            emit = (np.add.reduceat(params[0][span], cuts) / np.sqrt(sizes[used])[:, None])[back.reshape(w.shape)]
            e, a = np.exp(emit - emit.max(2, keepdims=True)), np.exp(params[1])
            alpha, beta, gain = np.empty_like(e), np.empty_like(e), np.zeros_like(a)
            alpha[:, 0] = e[:, 0] * np.exp(params[2])
            alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
            for t in range(1, LENGTH):
                alpha[:, t] = e[:, t] * (alpha[:, t - 1] @ a)
                alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
            beta[:, -1] = 1.0
            for t in range(LENGTH - 1, 0, -1):
                right = e[:, t] * beta[:, t]
                pair = alpha[:, t - 1, :, None] * a * right[:, None, :]
                gain += (pair / pair.sum((1, 2), keepdims=True)).sum(0) - np.einsum("bi,bj->ij", eye[y[:, t - 1]], eye[y[:, t]])
                beta[:, t - 1] = right @ a.T
                beta[:, t - 1] /= beta[:, t - 1].sum(1, keepdims=True)
            probs = alpha * beta
            probs /= probs.sum(2, keepdims=True)
            diff = probs - eye[y]
            per = np.zeros((len(used), n))
            np.add.at(per, back.ravel(), diff.reshape(-1, n))
            slope = np.zeros_like(params[0])
            np.add.at(slope, span, np.repeat(per / np.sqrt(sizes[used])[:, None], sizes[used], axis=0))
            now += 1
            for p, g, (m, v) in zip(params, (slope / len(some) + 1e-5 * params[0], gain / len(some) + 1e-3 * params[1], diff[:, 0].mean(0)), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.05 * (m / (1 - 0.9**now)) / (np.sqrt(v / (1 - 0.99**now)) + 1e-8)
    return Field(langs, *params, lexicon)


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS, modulus: int = 4, left_out: int = 2) -> Field:
    """A field from the rows with a non-null lang and text whose crc32 bucket of doc_id isn't ``left_out``.

    Languages are the distinct labels, all of them.  Texts without words teach nothing; of rows that share doc_id and lang one teaches.
    """
    rows = docs.where((doc_bucket("doc_id", modulus) != left_out) & F.col("lang").isNotNull() & F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select("doc_id", "lang", "text")
    # Ids first, without texts, then the texts of at most per_lang ids a language.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = rows.select("lang", "doc_id").distinct().withColumn("nth", nth).where(F.col("nth") <= per_lang).drop("nth")
    found = rows.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    texts: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.doc_id)):
        texts.setdefault(r.lang, []).append(r.text.lower().split() or [r.text])
    return fit(list(texts), list(texts.values()))


def label(docs: DataFrame, field: Field, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of ``docs`` with the language and its probability; columns of the two names given are replaced.

    A null text or one without a letter is ``und`` with score 0, as is every text where nothing was learned; an empty table gives no rows.
    Texts of any length count with all their words.  Ties go to the first language in order.  Every row is labelled on its own, so repeated rows get equal labels.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(field)
    docs = docs.drop(*out)
    names = docs.columns
    text = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = pa.array([*shared.value.langs, UNKNOWN], pa.string())
        for some in text_chunks(batches, text, CHUNK_BYTES):
            best, score = shared.value.label(some.column(text))
            yield pa.RecordBatch.from_arrays([*some.columns, langs.take(pa.array(best % len(langs))), pa.array(score)], [*names, *out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{fields}, `{out[0]}` string, `{out[1]}` double")
