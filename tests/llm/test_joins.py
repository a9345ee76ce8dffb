"""The similarity join, the periodic runs and the hard negatives against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kinfold.llm import common, hardneg, minmax, queries, runs, toccur


def components_of(sets, percent=80):
    up = list(range(len(sets)))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return [find(v) for v in range(len(sets))]


def shingles(text, width):
    words = text.split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def families(rng):
    """Near copies in chains (each like the last, not like the first), passages that many share, and texts of their own."""
    passage, texts = " ".join(f"p{k}" for k in range(30)), []
    for size in (40, 25, 8, 3):
        words = [f"w{rng.randint(0, 400)}" for _ in range(120)]
        for _ in range(size):
            at = rng.randrange(110)
            words = [*words[:at], *(f"n{rng.randint(0, 10_000)}" for _ in range(rng.randint(0, 4))), *words[at + rng.randint(0, 3) :]]
            texts.append(" ".join(words))
    texts += [f"{passage} " + " ".join(f"u{rng.randint(0, 50_000)}" for _ in range(rng.randint(0, 25))) for _ in range(30)]
    texts += ["", "one", "two words", "one", *(" ".join(f"s{rng.randint(0, 3)}" for _ in range(6)) for _ in range(20))]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("pack", "most"), [(1_000_000, 1 << 18), (1500, 40), (300, 0)])
def test_join_equals_brute_force(docs, pack, most):
    texts = families(random.Random(pack))
    want = components_of([shingles(t, 2) for t in texts])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in toccur.jaccard_join(docs(*enumerate(texts)), 2, 80, pack=pack, most=most).collect()}
    assert got == {k: (len(shingles(t, 2)), want[k]) for k, t in enumerate(texts)}


def test_links_left_to_other_pieces(docs):
    # A crowd around one text, in pieces of a few documents, and some that are like members at the crowd's edge only.
    rng = random.Random(7)
    base = [f"b{k}" for k in range(100)]
    edit = lambda words, n: [f"x{rng.randint(0, 10**6)}" if i in set(rng.sample(range(100), n)) else w for i, w in enumerate(words)]
    crowd = [list(base) for _ in range(60)]
    for words in crowd:
        for at in rng.sample(range(100), rng.randint(0, 9)):
            words[at] = f"x{rng.randint(0, 10**6)}"
    edge = []
    for words in crowd[:10]:
        far = list(words)
        for at in rng.sample(range(100), 8):
            far[at] = f"y{rng.randint(0, 10**6)}"
        edge.append(far)
    texts = [" ".join(w) for w in crowd + edge]
    want = components_of([shingles(t, 1) for t in texts])
    got = {r.doc_id: r.component_id for r in toccur.jaccard_join(docs(*enumerate(texts)), 1, 80, pack=600).collect()}
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("seed", range(3))
def test_divide_skip_finds_what_is_there(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.choice(60, rng.integers(1, 40))).astype(np.uint64) for _ in range(150)]
    pack = toccur.Pack(sets, list(range(150)), 60)
    for d in range(150):
        pack.add(d)
        for other in pack.search(d):
            pack.join(d, other)
    want = components_of([set(s.tolist()) for s in sets], 60)
    assert len({(pack.root(d), want[d]) for d in range(150)}) == len(set(want)) == len({pack.root(d) for d in range(150)})


def test_join_of_odd_rows(odd):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in toccur.jaccard_join(odd, 5, 80).collect() if r.doc_id is not None)
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 6, 6, 7, 8, 9] and {g[2] for g in got if g[0] in (5, 6)} == {5}
    assert got[0] == (1, 0, 1) and got[3][1] == 39_996
    assert [r.component_id for r in toccur.jaccard_join(odd, 5, 80).collect() if r.doc_id is None] == [None]
    assert toccur.jaccard_join(odd.limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts(docs):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    df = docs((1, a), (2, a + " z"), (3, b), (4, b + " z"), (2, b))
    assert {r.component_id for r in toccur.jaccard_join(df, 2).collect()} == {1}


def test_frequent_shingles_are_bounded(docs):
    df = docs(*((k, " ".join(f"c{j}" for j in range(30 + k % 3))) for k in range(50)))
    prints = toccur.fingerprints(df, 2)
    known, power = toccur.frequent(prints, 100)
    assert len(known) == 31 and sorted(power.tolist()) == [4] + [5] * 30 and (np.diff(known.astype(int)) > 0).all()
    assert len(toccur.frequent(prints, 30)[0]) == 30 and len(toccur.frequent(prints, 0)[0]) == 0


def all_runs(w):
    """Every run of a list of words by looking at all distances."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(24, 3 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    rng, texts = random.Random(seed), [None, "", " ", "a " * 500, ("a b " * 3 + "c ") * 30, ("x y " * 9 + "z ") * 4]
    for _ in range(40):
        words = []
        for _ in range(rng.randint(0, 12)):
            kind = rng.random()
            if kind < 0.3:
                words += [str(rng.randint(0, 2)) for _ in range(rng.randint(1, 30))]
            elif kind < 0.6:
                words += [str(rng.randint(0, rng.choice([1, 2, 5, 50]))) for _ in range(rng.randint(1, 25))] * rng.randint(2, 8)
            else:
                words += [f"u{rng.randint(0, 1000)}" for _ in range(rng.randint(1, 40))]
        texts.append(" ".join(words))
    _, _, _, rows = runs.chunk_runs(pa.array(texts))
    for i, t in enumerate(texts):
        assert [(int(s), int(e - s), int(q)) for d, s, e, q in rows if d == i] == all_runs((t or "").split())


def test_grammars_of_few_words_find_the_same(monkeypatch):
    texts = pa.array([" ".join(f"w{k % (5 + n)}" for k in range(60)) + f" end{n}" for n in range(12)])
    whole = runs.chunk_runs(texts)[3].tolist()
    monkeypatch.setattr(runs, "GRAMMAR_WORDS", 100)
    assert runs.chunk_runs(texts)[3].tolist() == whole and len(whole) == 12


def test_grammar_derives_the_text():
    words = np.array([1, 2, 1, 2, 1, 2, 3, 3, 3, 3, 1, 2, 3, 9, 1, 2, 1, 2])
    symbol, start, first, length = runs.repair(words, np.zeros(len(words), np.int64))
    for s in np.unique(symbol):
        mine = {(tuple(words[b : b + n]), f) for b, f, n in zip(start[symbol == s], first[symbol == s], length[symbol == s])}
        assert len(mine) == 1
    assert length.max() == len(words) and (np.bincount(symbol)[symbol] > 1).any()


def by_hand(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = sorted(tuple(r) for r in queries.op12_repair_runs(spark, sf_dir).collect())
    assert got == sorted(by_hand(i, t) for i, t in texts.items()) and sum(r[1] for r in got) > 10


def test_runs_of_odd_rows(odd):
    got = {r.doc_id: r for r in runs.find_runs(odd).collect()}
    assert runs.find_runs(odd).count() == 11 and got[4].n_words == 40_000 and got[4].runs == []
    assert (got[1].n_words, got[1].runs, got[1].collapsed) == (0, [], "") and got[3].collapsed == "" and got[None].collapsed == "no id here"
    assert runs.find_runs(odd.limit(0)).count() == 0
    assert [r.collapsed for r in runs.find_runs(odd, collapse=False).collect()] == [None] * 11


def test_long_run_collapses(docs):
    text = "start " + "one two three " * 40 + "one END"
    row = runs.find_runs(docs((1, text))).first()
    assert [tuple(r) for r in row.runs] == [(1, 121, 3)] and row.collapsed == "start one two three END"


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, row long, x string, windows int, asked boolean")


def negatives(rows, anchors):
    """(anchor, positive, rank, negative, scores) by sorting all."""
    fine = [(i, v, b) for i, v, b, *_ in rows if b is not None and v is not None and i is not None and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v)]
    ints = [[int(np.floor(256 * x)) for x in v] for _, v, _ in fine]
    out = []
    for a, (i, _, b) in enumerate(fine):
        if i not in anchors:
            continue
        scored = sorted((-sum(p * q for p, q in zip(ints[a], ints[c])), j, c, lab) for c, (j, _, lab) in enumerate(fine) if c != a)
        for s, j, _, _ in [x for x in scored if x[3] == b][:5]:
            others = [x for x in scored if x[3] != b and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(others)]
    return sorted(out)


@pytest.mark.parametrize("piece", [8192, 40])
def test_negatives_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(hardneg, "PIECE", piece)
    monkeypatch.setattr(hardneg, "ANCHORS", 7)
    rng = random.Random(piece)
    draw = lambda: [rng.choice([0.0, 0.5, -0.5, 1.0, rng.uniform(-1, 1)]) for _ in range(3)]
    rows = [(i, draw(), rng.randint(0, 2), 0, "x", 1, False) for i in range(180)]
    rows += [(7, draw(), 1, 0, "x", 1, True), (3, None, 1, 0, "x", 1, True), (200, [0.0, None, 1.0], 1, 0, "x", 1, True), (201, [float("nan"), 0.0, 1.0], 1, 0, "x", 1, True), (202, [1.0], 0, 0, "x", 1, True)]
    rows += [(203, draw(), None, 0, "x", 1, True), (None, draw(), 1, 0, "x", 1, True), (204, [0.0, 0.0, 0.0], 2, 0, "x", 1, True), (205, [float("inf"), 0.0, 0.0], 2, 0, "x", 1, True)]
    got = sorted(tuple(r) for r in hardneg.hard_negatives(vectors(spark, rows), "vec_id % 9 = 7 or vec_id > 199").collect())
    assert got == negatives(rows, {*range(7, 180, 9), 200, 201, 202, 203, 204, 205}) and len(got) > 100
    assert hardneg.hard_negatives(vectors(spark, rows).limit(0), F.lit(True)).count() == 0


def test_negatives_of_large_components(spark):
    rows = [(i, [float(v), float(v) / 3, 1.0], i % 2, 0, "x", 1, False) for i, v in enumerate([3_000_001, 2_999_999, 2_000_003, 1_500_001, 2_500_000, 900_000])]
    got = sorted(tuple(r) for r in hardneg.hard_negatives(vectors(spark, rows), "vec_id < 2").collect())
    assert got == negatives(rows, {0, 1}) and got


def test_reading_stops_before_the_end():
    rng = np.random.default_rng(1)
    x = rng.integers(-1000, 1000, (4000, 2))
    lists, read = hardneg.Lists(np.arange(4000), np.arange(4000), np.zeros(4000, np.int64), x), []
    whole = lists._scores
    lists._scores = lambda at, anchor, small: (read.append(len(at)), whole(at, anchor, small))[1]
    (at, scores), *_ = lists.best(-1, np.array([3, -2]), 0, [None], hardneg.Wanted(5, True))
    want = np.sort(-(x @ [3, -2]), kind="stable")[:5]
    assert (-scores == want).all() and sum(read) < 2000


def test_shingle_hashes_one_by_one(monkeypatch):
    """Hashes equal those of one window after another, whatever a text's length; no set is made text by text."""
    mask, (a, b, c) = (1 << 64) - 1, (int(m) for m in minmax._MIX[:3])

    def mixed(x):
        x = ((x ^ (x >> 31)) * c) & mask
        return x ^ (x >> 29)

    rng = random.Random(3)
    texts = [None, "", " \t", *(" ".join(rng.choice(("ab", "C", "d")) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 40, 2, 0, 7))]
    monkeypatch.setattr(minmax.np, "unique", None)
    for width in (1, 2, 5):
        want = []
        for text in texts:
            words, found = [xxhash.xxh64_intdigest(w) for w in common.words_of(text)], set()
            for k in range(max(len(words) - width + 1, min(len(words), 1))):
                h, *more = words[k : k + width]
                for i, m in enumerate(more, 1):
                    h = mixed((h * a + m * b + i) & mask)
                found.add(h if len(words) >= width else mixed((h + len(words)) & mask))
            want.append(sorted(found))
        shingles, sizes = minmax.shingle_hashes(pa.array(texts, pa.string()), width)
        assert sizes.tolist() == [len(w) for w in want] and shingles.tolist() == [h for w in want for h in w]
