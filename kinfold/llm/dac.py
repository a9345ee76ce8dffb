"""Token ids as directly addressable codes.

A code splits every id into chunks of ``bits`` bits.  Level 0 holds the lowest chunk of every id;
level k holds chunk k of those ids that have one.  A continuation bitmap beside each level says
which ids go on to the next level, and a rank directory (ones before every 512th bit) turns a
position in one level into the position in the next.  Any id is thus read with a few byte
look-ups, without decoding what stands before it.

Layout of one block, all numbers little-endian:
``DAC1`` | bits u8 | levels u8 | n u64 | for each level: count u64, count chunk bytes,
ceil(count/8) bitmap bytes, ceil(count/512) u32 ranks.

Documents are range-partitioned and sorted by id; each task streams its documents into blocks of
about ``block_tokens`` ids that end with a document, one row of a Parquet table for each block.
"""

from __future__ import annotations

import gc
import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import gathered, prepare, text_chunks

MAGIC, HEAD, COUNT = b"DAC1", struct.Struct("<4sBBQ"), struct.Struct("<Q")
RANK_BITS = 512
BLOCK_TOKENS = 1 << 20
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 4_000_000
#: Pieces in one call of the pair model.
RUN = 500
BLOCKS = "part int, seq int, doc_ids array<bigint>, n_tokens array<bigint>, payload binary"


def pack(ids: np.ndarray, bits: int = 8) -> bytes:
    """One block from ids of up to 32 bits; bits is 1 to 8."""
    rest, mask, levels = np.asarray(ids, dtype=np.uint32), np.uint32((1 << bits) - 1), []
    while True:
        more = rest > mask
        packed = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(COUNT.pack(len(rest)) + (rest & mask).astype(np.uint8).tobytes() + packed.tobytes() + ranks.tobytes())
        if not more.any():
            return HEAD.pack(MAGIC, bits, len(levels), len(np.asarray(ids))) + b"".join(levels)
        rest = rest[more] >> np.uint32(bits)


class Block:
    """A packed block: ``block[i]`` reads one id, ``all()`` reads every id."""

    def __init__(self, payload: bytes):
        magic, self.bits, n_levels, self.n = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        at, self.levels = HEAD.size, []
        for _ in range(n_levels):
            (count,) = COUNT.unpack_from(payload, at)
            at += COUNT.size
            parts = []
            for kind, size in ((np.uint8, count), (np.uint8, -(-count // 8)), (np.dtype("<u4"), -(-count // RANK_BITS))):
                parts.append(np.frombuffer(payload, kind, size, at))
                at += parts[-1].nbytes
            self.levels.append(parts)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            inside = bitmap[block * RANK_BITS // 8 : (i >> 3) + 1].copy()
            inside[-1] &= (1 << (i & 7)) - 1
            i, shift = int(ranks[block]) + int(np.bitwise_count(inside).sum()), shift + self.bits
        return value

    def all(self) -> np.ndarray:
        value = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            here[np.flatnonzero(np.unpackbits(bitmap, count=len(chunks), bitorder="little"))] |= value << np.uint32(self.bits)
            value = here
        return value


class WordCoder:
    """Ids of texts by a tokenizer file, word by word where that cannot change the result.

    Where the file's steps are NFC, white space to one blank, lower case, cutting out the matches of a pattern, and byte-level
    pairs, no id reaches over a blank.  A chunk's distinct words are then normalized, cut and given to the tokenizer's own pair model
    once, and remembered until ``limit`` bytes are held.  A word that holds a special token's own text goes to the tokenizer
    as it is, and so does every text where the tokenizer has other steps.
    """

    def __init__(self, path: str, limit: int = 80_000_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        added = self.tokenizer.get_added_tokens_decoder()
        self.end_id = max(added, default=0)
        self.special = [t.content for t in added.values()]
        said = json.loads(self.tokenizer.to_str())
        pattern = self._pattern(said)
        self.pieces = regex.compile(pattern).findall if pattern else None
        if pattern:
            from tokenizers import pre_tokenizers

            # The pair model behind blanks and bytes alone, for pieces that are normalized and cut already.
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            suffix, vocab = said["model"]["end_of_word_suffix"] or "", self.tokenizer.get_vocab()
            self.final = np.zeros(max(vocab.values()) + 1, bool)
            self.final[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self._forget()

    @staticmethod
    def _pattern(said: dict) -> str | None:
        """The cutting pattern if the steps are those of the class's docstring."""
        steps = (said.get("normalizer") or {}).get("normalizers", [])
        cuts = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        space = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or steps[1] != space or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
            return None
        split, level = cuts
        letters = "[\\p{L}]+" in split["pattern"].get("Regex", "").split("|")
        plain = letters and not any(" " in t["content"] for t in said["added_tokens"]) and split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"] and said["model"]["type"] == "BPE"
        return split["pattern"].get("Regex") if plain else None

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.cut: dict[str, int] = {}
        self.flat, self.starts, self.held = array("I"), array("q", [0]), 0

    def _runs(self, held: dict[str, int], texts: list[str], ids: np.ndarray, stops: np.ndarray) -> None:
        """Remember the ids of each text, which end at ``stops``."""
        first = len(self.starts) - 1
        self.starts.frombytes((stops + len(self.flat)).astype(np.int64).tobytes())
        self.flat.frombytes(np.asarray(ids, np.uint32).tobytes())
        held.update(zip(texts, range(first, first + len(texts)), strict=True))
        self.held += 150 * len(texts) + 4 * len(ids)

    def _learn(self, words: list[str]) -> None:
        cut, counts, whole = [], [], {}
        # No word holds a blank, and a blank joins nothing in NFC, so all go at once.  Python lower-cases a capital sigma by its place, the tokenizer does not.
        lows = normalize("NFC", " ".join(words)).replace("\u03a3", "\u03c3").lower().split(" ")
        for w, low in zip(words, lows, strict=True):
            if self.pieces and low.isalpha():
                cut.append(low)
                counts.append(1)
            elif self.pieces and low[:-1].isalpha() and low[-1] in ".,;:!?":
                cut += (low[:-1], low[-1])
                counts.append(2)
            elif self.pieces is None or any(x in w for x in self.special):
                whole[len(counts)] = self.tokenizer.encode(w, add_special_tokens=False).ids
                counts.append(0)
            else:
                some = self.pieces(low)
                cut += some
                counts.append(len(some))
        fresh = list(set(cut).difference(self.cut))
        for lo in range(0, len(fresh), RUN):
            part = fresh[lo : lo + RUN]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            stops = np.flatnonzero(self.final[ids]) + 1
            if len(stops) != len(part):
                # A model that doesn't end every piece with the suffix: one by one.
                one = [self.bare.encode(p, add_special_tokens=False).ids for p in part]
                ids, stops = np.array([i for x in one for i in x]), np.cumsum([len(x) for x in one])
            self._runs(self.cut, part, ids, stops)
        at = np.fromiter(map(self.cut.__getitem__, cut), np.int64, len(cut))
        starts = np.array(self.starts, np.int64)
        sizes = starts[at + 1] - starts[at]
        ids = gathered(np.array(self.flat, np.uint32), starts[at], sizes)
        so_far = np.concatenate(([0], np.cumsum(sizes)))
        stops = so_far[np.cumsum(counts, dtype=np.int64)]
        if whole:
            parts = [whole.get(k, x) for k, x in enumerate(np.split(ids, stops[:-1]))]
            ids, stops = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        self._runs(self.known, words, ids, stops)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has; a null text has none."""
        texts = texts.fill_null("")
        if self.pieces is None:
            own = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.to_pylist()]
            return np.concatenate([*own, np.zeros(0, np.uint32)]), np.array([len(x) for x in own], np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        ids, sizes = self.encode_words(coded.dictionary, coded.indices.to_numpy())
        so_far = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.diff(so_far[lists.offsets.to_numpy() - lists.offsets[0].as_py()])

    def encode_words(self, distinct: pa.Array, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``distinct[number]`` one after another, and how many each has."""
        words = distinct.to_numpy(zero_copy_only=False).tolist()
        if self.held > self.limit:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            # Only strings and numbers are made here; the collector would look through them again and again.
            on = gc.isenabled()
            gc.disable()
            try:
                self._learn(new)
            finally:
                if on:
                    gc.enable()
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[number]
        flat, starts = np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32), np.frombuffer(self.starts, np.int64)
        sizes = starts[at + 1] - starts[at]
        return gathered(flat, starts[at], sizes), sizes

    def with_end(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with ``end_id`` after each text."""
        ids, sizes = self.encode(texts)
        out = np.full(len(ids) + len(sizes), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
        return out, sizes + 1


_CODERS: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_tokens: int = BLOCK_TOKENS, bits: int = 8) -> None:
    """Encode ``text`` of every row and write blocks in ascending ``doc_id`` order to ``path``.

    A null or empty text gives the end id alone; a text of any length is encoded whole, over as many blocks as it needs.  Rows that share a doc_id are each kept, in order
    of their texts.  A null doc_id comes first and stays null.  An empty table gives no blocks.
    Other columns are not read.
    """
    prepare(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, part = coder(tokenizer), TaskContext.get().partitionId()
        docs_, sizes, held, seq = [], [], [], 0

        def block() -> pa.RecordBatch:
            rows = [[part], [seq], [docs_], [sizes], [pack(np.concatenate(held), bits)]]
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], ["part", "seq", "doc_ids", "n_tokens", "payload"])

        for some in text_chunks(batches, 1, CHUNK_BYTES):
            ids, n = make.with_end(some.column(1), end_id)
            doc_ids, stop, lo = some.column(0).to_pylist(), np.cumsum(n), 0
            while lo < len(n):
                # As many documents as bring the block to its size.
                begin = int(stop[lo - 1]) if lo else 0
                hi = min(int(np.searchsorted(stop, begin + block_tokens - sum(sizes))) + 1, len(n))
                held.append(ids[begin : stop[hi - 1]])
                docs_ += doc_ids[lo:hi]
                sizes += n[lo:hi].tolist()
                lo = hi
                if sum(sizes) >= block_tokens:
                    yield block()
                    docs_, sizes, held, seq = [], [], [], seq + 1
        if docs_:
            yield block()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written table: doc_id, start, n_tokens, ids_crc32, and where it lies (part, seq, at)."""
    prepare(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, ids, sizes, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = memoryview(Block(payload).all().astype("<u4").tobytes())
                stop = np.cumsum(sizes)
                start = stop - sizes
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(start, pa.int64())],
                    ["doc_id", "n_tokens", "ids_crc32", "part", "seq", "at"],
                )

    docs = blocks.mapInArrow(digest, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, part int, seq int, at bigint")
    # Offsets from the index alone: the payload column is not read.  One row a task crosses the single-partition window.
    sizes = blocks.select("part", "seq", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    inside = sizes.select("part", "seq", (F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")).alias("before_block"))
    offsets = inside.join(parts, "part")
    return docs.join(offsets, ["part", "seq"]).select("doc_id", (F.col("before_part") + F.col("before_block") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "seq", "at")


def token_at(blocks: DataFrame, part: int, seq: int, i: int) -> int:
    """Random access: id number i of one block."""
    row = blocks.where((F.col("part") == part) & (F.col("seq") == seq)).select("payload").first()
    return Block(bytes(row[0]))[i]
