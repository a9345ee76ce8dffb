"""The methods against brute force, exact round trips and held-out accuracy."""

import json
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import adsearch, attnlm, common, dac, decontam, langcrf, minmax, mixing, queries, secretscan, toxicmil


@pytest.mark.parametrize("bits", [3, 8])
def test_random_access(bits):
    ids = np.random.default_rng(0).integers(0, 1 << 20, 3000).astype("u4")
    ids[::3] %= 100
    block = dac.Block(dac.pack(ids, bits))
    assert (block.all() == ids).all() and [block[i] for i in range(0, 3000, 13)] == ids[::13].tolist()
    assert len(dac.Block(dac.pack(np.zeros(0, "u4")))) == 0


def test_coder_equals_the_tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    make, rng = dac.WordCoder(path, limit=50), random.Random(1)
    ids = lambda t: make.tokenizer.encode(t, add_special_tokens=False).ids
    texts = ["".join(rng.choice("aAzÉé'sStİΣσß \t\n\x1c　٣²½.,<|endoftext|>́ǅﬁ#x_9\x07\x7f") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for lo in range(0, 2000, 7):
        got, sizes = make.encode(pa.array([*texts[lo : lo + 7], None]))
        want = [*map(ids, texts[lo : lo + 7]), []]
        assert got.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("change", [("normalizer", None), ("content", "_"), ("regex", "\\S+")])
def test_coder_of_other_steps_encodes_whole_texts(tmp_path, change):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    said = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    what, value = change
    if what == "normalizer":
        said["normalizer"] = value
    elif what == "content":
        said["normalizer"]["normalizers"][1]["content"] = value
    else:
        said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = value
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said))
    make = dac.WordCoder(str(path))
    text = "Two  words,\nand ÉTÉ's <|endoftext|>"
    assert make.encode(pa.array([text]))[0].tolist() == make.tokenizer.encode(text, add_special_tokens=False).ids and make.pieces is None


def test_word_numbers_follow_the_words():
    texts = [" a  B\x1cc\x0b\x0cd ", "", None, "ÀÉ x\xa0y\tÀÉ"]
    words, number, sizes = common.word_numbers(pa.array(["skipped", *texts]).slice(1))
    got, at = words.take(pa.array(number)).to_pylist(), 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert [w.encode() for w in got[at : at + n]] == common.words_of(t)
        at += n


def test_near_duplicates_equal_brute_force(docs):
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randint(0, 60)}" for _ in range(40)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(40)] = f"w{rng.randint(0, 60)}"
            texts.append(" ".join(words))
    df = docs(*enumerate(texts))
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    parent = list(range(len(texts)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax.near_duplicates(df, 2, 80).collect()}
    assert got == {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def test_spans_and_randomness(docs):
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(60)]
    dull = ["aaaaaaaaaaaaaaaaaaaaAAAAAAAAAAAAAAAAAAAA1", "abababababababababababababababababab12A"]
    texts = [f"é {k} token = '{k[:14]}' {dull[n % 2]} AKIA{'Q' * 16} and {'0a1b' * 5} password=short" for n, k in enumerate(keys)]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in secretscan.scan(docs(*enumerate(texts))).collect()}
    hits = 0
    for n, t in enumerate(texts):
        base = [(m.start(), 1, "assign", m.end()) for m in re.finditer(secretscan.ASSIGN.replace("(?i)", "(?i)"), t) if len(m.group(2)) >= 12]
        base += [(m.start(), 2, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t)] + [(m.start(), 3, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 16]
        assert [s for s in found[n] if s[2] != "random"] == sorted(base)
        random_ = [t[s[0] : s[3]] for s in found[n] if s[2] == "random"]
        assert not set(random_) & set(dull)
        hits += keys[n] in random_
    assert hits >= 50


@pytest.mark.parametrize("count", [1, 5, 20])
def test_random_tokens_of_thin_bands(docs, count):
    rng = random.Random(count)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    sizes = (24, 34, 48, 68, 96, 136, 190, 270)
    keys = [(f"doc {size} {n}", "".join(rng.choice(letters) for _ in range(size))) for size in sizes for n in range(count)]
    dull = " ".join(f"{'abcdefgh' * k}AB1" for k in range(3, 12))
    texts = [f"{at} {key} {dull}" for at, key in keys]
    found = {r.doc_id: [texts[r.doc_id][s["start"] : s["end"]] for s in r.spans] for r in secretscan.scan(docs(*enumerate(texts))).collect()}
    assert all(set(found[n]) <= {key} for n, (_, key) in enumerate(keys))
    assert sum(key in found[n] for n, (_, key) in enumerate(keys)) >= 0.9 * len(keys) - 1


def test_random_tokens_behind_a_path(docs):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(60)]
    fronts = ("https/registry/accounts/", "é //name_of_the_variable=", "/home/somebody/projects/readme/")
    texts = [f"{fronts[n % 3]}{key}{('', '=', '/index')[n // 3 % 3]} end" for n, key in enumerate(keys)]
    rows = {r.doc_id: r.spans for r in secretscan.scan(docs(*enumerate(texts))).collect()}
    spans = [[texts[n][s["start"] : s["end"]] for s in rows[n] if s["kind"] == "random"] for n in range(len(texts))]
    assert all(len(s) <= 1 for s in spans)
    assert sum(any(key in one for one in s) for key, s in zip(keys, spans, strict=True)) >= 54
    assert any(s == [key] for key, s in zip(keys, spans, strict=True))


def token_tests(token):
    """(alphabet size, length, p) of a token by the battery, or None."""
    t = token.rstrip("=")
    if sum(bool(re.search(c, t)) for c in ("[0-9]", "[A-Z]", "[a-z]")) < 2 or len(t) < 16:
        return None
    letters = next(abc for pattern, abc in secretscan.ENCODINGS if re.fullmatch(pattern, t))
    n, k, at = len(t), len(letters), [letters.index(c) for c in t]
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = k / n * sum(at.count(x) ** 2 for x in set(at)) - n
    half = [x >= k // 2 for x in at]
    ones, turns = sum(half), sum(x != y for x, y in zip(half, half[1:]))
    mean = 2 * ones * (n - ones) / n
    z_runs = (turns - mean) / math.sqrt(mean * (mean - 1) / (n - 1)) if mean > 1 else -math.sqrt(n)
    off = [x + 1 - (k + 1) / 2 for x in at]
    z_lag = (sum(x * y for x, y in zip(off, off[1:])) / sum(x * x for x in off) + 1 / n) * math.sqrt(n)
    ps = (tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)), 2 * tail(abs(z_runs)), 2 * tail(abs(z_lag)))
    h = -sum(math.log(max(p, 1e-7)) for p in ps)
    return k, n, math.exp(-h) * (1 + h + h * h / 2)


def test_added_spans_equal_brute_force(docs):
    """Every token tested in Python, and every band's bound from its own counts."""
    rng = random.Random(12)
    abc = {"hexup": "0123456789ABCDEF", "b36": "0123456789abcdefghijklmnopqrstuvwxyz", "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"}
    texts = []
    for _ in range(250):
        parts = ["".join(rng.choice(abc[rng.choice(list(abc))]) for _ in range(rng.randint(18, 60))), f"Name{rng.randint(0, 99)}OfSome{'Thing' * rng.randint(2, 6)}", "x" * rng.randint(0, 30) + "Y1", f"a/{'b' * 22}1/{''.join(rng.choice(abc['b36']) for _ in range(30))}=="]
        texts.append(" é ".join(rng.sample(parts, 3)))
    found = {r.doc_id: [(s["start"], s["end"]) for s in r.spans if s["kind"] == "random"] for r in secretscan.scan(docs(*enumerate(texts))).collect()}
    rows = []
    for d, text in enumerate(texts):
        for m in re.finditer(secretscan.TOKEN, text):
            rows.append((d, m.start(), True, m.start(), m.end(), token_tests(m.group())))
            if re.search("[/=]", m.group().rstrip("=")):
                at = m.start()
                for part in re.split("[/=]", m.group()):
                    if len(part) >= 20:
                        rows.append((d, m.start(), False, at, at + len(part), token_tests(part)))
                    at += len(part) + 1
    rows = [(*r[:5], (r[5][0], math.floor(2 * math.log2(r[5][1]))), min(math.floor(r[5][2] * 50), 49)) for r in rows if r[5]]
    bound = {}
    for band in {r[5] for r in rows}:
        bins = [r[6] for r in rows if r[5] == band]
        upper = sum(b >= 25 for b in bins)
        most = upper + 1 + 1.645 * math.sqrt(upper + 1)
        fine = [b for b in set(bins) if b >= 1 and 1 - min(1, 2 * most * (1 - b / 50) / sum(x >= b for x in bins)) <= 0.05]
        bound[band] = min(fine, default=99)
    over = [r for r in rows if r[6] >= bound[r[5]]]
    wholes = {r[:2] for r in over if r[2]}
    want = {d: sorted({(r[3], r[4]) for r in over if r[0] == d and (r[2] or r[:2] not in wholes)}) for d in range(len(texts))}
    assert found == want and sum(map(len, want.values())) > 200


def test_leaks_with_edits(spark, docs):
    rng = random.Random(2)
    words = [f"v{k}" for k in range(300)]
    items = [(n, " ".join(rng.choice(words) for _ in range(rng.randint(15, 50)))) for n in range(40)]
    rows, want = [], set()
    for n, (item, text) in enumerate(items):
        ws = text.split()
        for e in range(n % 4 and len(ws) // 12):
            ws[rng.randrange(len(ws))] = f"z{e}"
        noise = lambda: [rng.choice(words) for _ in range(80)]
        rows.append((n, " ".join([*noise(), *ws, *noise()]).upper()))
        want.add((n, item))
    rows += [(1000 + n, " ".join(rng.choice(words) for _ in range(200))) for n in range(40)]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs(*rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
@pytest.mark.parametrize("way", ["regular", "random", "mixed"])
def test_leaks_recall(way, share):
    """Recall at rising shares of edits, and every row that is given equals brute force over the whole text."""
    rng = random.Random(6)
    words = [f"v{k}" for k in range(400)]
    items = [[rng.choice(words) for _ in range(size)] for size in [*range(1, 60), 15, 16, 20, 39, 58, 90, 200] * 4]
    texts = []
    for item in items:
        ws, k = list(item), int(share * len(item))
        step = len(ws) // max(k, 1)
        places = [step * e + step - 1 for e in range(k)] if way == "regular" else rng.sample(range(len(ws)), k)
        for e in sorted(places, reverse=True):
            ws[e : e + 1] = {"mixed": ([], [f"z{e}", ws[e]], [f"z{e}"])[e % 3]}.get(way, [f"z{e}"])
        texts.append(" ".join([rng.choice(words) for _ in range(30)] + ws + [rng.choice(words) for _ in range(30)]))
    index = decontam.Index([(n, " ".join(item)) for n, item in enumerate(items)])
    got = {(d, i): (e, start, end) for d, i, start, end, e in index.leaks(pa.array(texts))}
    code = {w: k for k, w in enumerate({w for t in texts for w in t.split()} | set(words))}
    arrays = [np.array([code[w] for w in t.split()]) for t in texts]
    for n in range(0, len(items), 5):
        for d in {n, (n * 7) % len(texts)}:
            edits = decontam.best_place(np.array([code[w] for w in items[n]]), arrays[d])[0]
            if (d, n) in got:
                assert got[d, n][0] == edits <= int(decontam.MAX_EDITS * len(items[n]))
            elif len(items[n]) < decontam.SHORT:
                assert edits > int(decontam.MAX_EDITS * len(items[n]))
    long = [n for n, item in enumerate(items) if len(item) >= decontam.SHORT]
    assert all((n, n) in got for n in range(len(items)) if len(items[n]) < decontam.SHORT)
    assert sum((n, n) in got for n in long) >= 0.99 * len(long)


def test_leaks_of_a_benchmark_with_many_words(spark, docs, monkeypatch):
    items = [(n, " ".join(f"w{40 * n + k}" for k in range(40))) for n in range(1500)]
    rows = [(n, f"before {items[n][1]} after") for n in range(0, 1500, 100)]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = [(n, n, 1, 41, 0) for n, _ in rows]
    assert sorted(map(tuple, decontam.leaks(docs(*rows), table).collect())) == want
    monkeypatch.setattr(decontam, "SLICE_CHARS", 100_000)
    assert sorted(map(tuple, decontam.leaks(docs(*rows), table).collect())) == want


def test_leaks_of_the_query_equal_brute_force(spark):
    """Every document against every item: the least edit distance of the item to any stretch of the text."""
    sf = "/root/testdata/sf0.001"
    docs, items = common.table(spark, sf, "documents").collect(), common.table(spark, sf, "benchmark").collect()
    code: dict[str, int] = {}
    number = lambda t: np.array([code.setdefault(w, len(code)) for w in (t or "").lower().split()], np.int64)
    texts, wanted = [(d.doc_id, number(d.text)) for d in docs], [(i.item_id, number(i.text)) for i in items]
    want = set()
    for d, text in texts:
        inside = np.bincount(text, minlength=len(code) + 1)
        for i, item in wanted:
            k = int(decontam.MAX_EDITS * len(item))
            # Fewer than all but k of an item's words in the whole text: no stretch can be near.
            if np.minimum(np.bincount(item, minlength=len(inside)), inside).sum() >= len(item) - k and decontam.best_place(item, text)[0] <= k:
                want.add((d, i))
    assert want and {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, sf).collect()} == want


def test_best_place_equals_brute_force():
    rng = random.Random(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for _ in range(60):
        a = [rng.randint(0, 3) for _ in range(rng.randint(1, 6))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 9))]
        d, s, e = decontam.best_place(np.array(a), np.array(b, dtype=int))
        assert d == min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1)) == distance(a, b[s:e])


def test_raking_equals_its_formula_and_meets_the_targets(spark):
    rows = [(f"s{k % 5}", f"l{k % 3}", f"t{k % 2}", 10 + 7 * k % 23) for k in range(30)]
    cells = spark.createDataFrame(rows, "__source string, __lang string, __topic string, tokens long").groupBy("__source", "__lang", "__topic").agg(F.sum("tokens").alias("tokens"))
    targets = {d: mixing.tempered(cells, d, 0.5) for d in ("__source", "__lang", "__topic")}
    goal = [{r[0]: r.target for r in targets[d].collect()} for d in targets]
    want = {tuple(r)[:3]: float(r.tokens) for r in cells.collect()}
    got = {tuple(r)[:3]: r.w for r in mixing.rake(cells, targets).collect()}
    for _ in range(mixing.CYCLES):
        for at in range(3):
            sums = {}
            for k, w in want.items():
                sums[k[at]] = sums.get(k[at], 0.0) + w
            want = {k: w * goal[at][k[at]] / sums[k[at]] for k, w in want.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    for at in range(3):
        for name, share in goal[at].items():
            assert abs(sum(w for k, w in got.items() if k[at] == name) - share) < 1e-6


def test_sampled_tokens_meet_the_marginals(spark):
    """Of many documents, the tokens sampled have the target shares of each dimension."""
    rows = [(k, f"{'word ' * (1 + k % 7)}{('', 'x@y', '***')[k * k % 3]}", ("en", "de")[k % 5 == 0], f"s{k % 11 % 3}") for k in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {"__source": {"s0": 0.3, "s1": 0.3, "s2": 0.4}, "__lang": {"en": 0.6, "de": 0.4}, "__topic": {"prose": 0.5, "contact": 0.3, "markup": 0.2}}
    present = {r[0] for r in mixing.celled(docs).select("__topic").distinct().collect()}
    want["__topic"] = {t: p / sum(want["__topic"][x] for x in present) for t, p in want["__topic"].items() if t in present}
    targets = {d: spark.createDataFrame(list(t.items()), f"{d} string, target double") for d, t in want.items()}
    got = mixing.mix(docs, targets).toPandas()
    for dim, shares in want.items():
        sums = got.groupby(f"c_{dim[2:]}")["c_tokens"].sum()
        for name, share in shares.items():
            assert abs(sums[name] / sums.sum() - share) < 0.02


def recall(x, got, ids, k=20):
    """Share of the true nearest that were found; every score is exact and ranks follow (score, vec_id)."""
    at, hit, total = {i: n for n, i in enumerate(ids.tolist())}, 0, 0
    for q, rows in got.sort_values("rank").groupby("query_id"):
        s = x @ x[at[q]]
        s[at[q]] = -np.inf
        want = ids[np.lexsort((ids, -s))[:k]]
        assert rows["rank"].tolist() == list(range(1, k + 1)) and np.allclose(rows["score"], s[[at[i] for i in rows["vec_id"]]], rtol=1e-12)
        assert list(zip(-rows["score"], rows["vec_id"])) == sorted(zip(-rows["score"], rows["vec_id"]))
        hit, total = hit + len(set(want) & set(rows["vec_id"])), total + k
    return hit / total


@pytest.mark.parametrize("piece", [adsearch.PIECE, 100])
def test_search_recall(spark, monkeypatch, piece):
    monkeypatch.setattr(adsearch, "PIECE", piece)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.2, 2, size=(1500, 1))
    # One list holds a third of all.
    x[:500] = x[0] + 0.01 * rng.normal(size=(500, 24))
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = adsearch.search(df, "vec_id % 20 = 0").toPandas()
    assert got["query_id"].nunique() == 75 and recall(x, got, np.arange(1500)) >= 0.9


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_search_recall_on_the_table(spark, sf):
    table = common.table(spark, f"/root/testdata/sf{sf}", "embeddings").where("embedding is not null").toPandas()
    x, ids = np.stack(table["embedding"].to_numpy()).astype(float), table["vec_id"].to_numpy()
    got = queries.op1_ads_search(spark, f"/root/testdata/sf{sf}").toPandas()
    assert got["query_id"].nunique() == (ids % 20 == 0).sum() and recall(x, got, ids) >= 0.9


def test_toxicity_equals_brute_force(spark):
    """Scores and offending sentences of the query by the noisy-or, word by word."""
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents").select("doc_id", "text")
    model = toxicmil.train(docs, common.table(spark, sf, "labels"))
    rows = {r.doc_id: r for r in queries.op2_toxicity(spark, sf).collect()}
    for d in docs.collect():
        clean, spans, at, text = 1.0, [], 0, d.text or ""
        while at < len(text):
            stop = next((k for k in range(at, len(text)) if text[k] in ".!?\n"), len(text))
            found = [(m.start() + at, m.end() + at, m.group()) for m in re.finditer(r"[^\W_]+", text[at:stop])]
            if found:
                p = 1 / (1 + np.exp(-model.bias - sum(model.weights.get(w.lower(), 0.0) for _, _, w in found)))
                clean *= 1 - p
                if p >= 0.5:
                    spans.append(f"{found[0][0]}:{stop + 1 if stop < len(text) else found[-1][1]}")
            at = stop + 1
        got = rows[d.doc_id]
        assert abs(got.score - (1 - clean)) < 1e-9 and got.predicted == int(got.score >= 0.5) and got.offending == ",".join(spans)
        assert got.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op2_toxicity(spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    rank = scored["score"].rank()
    pos = scored["toxic"] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.8


def test_sentences_are_located():
    model = toxicmil.Sentences({"scum": 9.0}, -5.0)
    text = "All is well. You scum! Fine"
    found = [text[a:b] for a, b, p in model.sentences(text) if p > 0.5]
    assert found == ["You scum!"] and model.score(text) > 0.9 and model.score("All is well.") < 0.1
    # Letters whose lower case is longer are cut as they stand, for the score as for the sentences.
    model = toxicmil.Sentences({"scum": 9.0, "i̇stanbul": 9.0}, -5.0)
    for odd in ("İstanbul", "x İstanbul. ISTANBUL!", text):
        assert abs(model.score(odd) - (1 - np.prod([1 - p for _, _, p in model.sentences(odd)]))) < 1e-9
    assert model.score("İstanbul") > 0.9
    parts = [p for _, _, p in model.sentences(text)]
    assert abs(model.score(text) - (1 - np.prod([1 - p for p in parts]))) < 1e-9


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_language_id(spark, sf).join(common.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.95


def test_language_equals_brute_force(spark):
    """Labels and scores of the query by one forward and one backward pass a text, word by word in logarithms."""
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    field = langcrf.train(docs.select("doc_id", "text", "lang"))
    rows = {r.doc_id: r for r in queries.op8_language_id(spark, sf).collect()}
    trans, n = field.trans.astype(float), len(field.langs)
    assert field.lexicon
    for d in docs.orderBy("doc_id").collect()[::3]:
        words = [w.decode().lower() for w in common.words_of(d.text)]
        letter = np.array([any(c.isalpha() for c in w) for w in words], bool)
        got = rows[d.doc_id]
        if not letter.any():
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        e = [sum(field.weights[i].astype(float) for i in field.features(w)) / len(field.features(w)) ** 0.5 for w in words]
        f, b = [field.init + e[0]], [np.zeros(n)]
        for x in e[1:]:
            f.append(x + np.logaddexp.reduce(f[-1][:, None] + trans, 0))
        for x in e[:0:-1]:
            b.append(np.logaddexp.reduce(trans + x + b[-1], 1))
        both = np.array(f) + np.array(b[::-1])
        mean = np.exp(both - np.logaddexp.reduce(both, 1, keepdims=True))[letter].mean(0)
        assert got.lang_pred == field.langs[int(mean.argmax())] and abs(got.score - mean.max()) < 1e-4
        assert got.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    field = langcrf.Field(["a", "b", "c"], np.zeros((langcrf.BUCKETS, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    sizes = np.array([3, 1, 4])
    scores = rng.normal(size=(8, 3)).astype("f4")
    got, at = field.marginals(scores, sizes), 0
    for n in sizes:
        part, total = np.zeros((n, 3)), 0.0
        for way in np.ndindex(*[3] * n):
            w = np.exp(field.init[way[0]] + sum(scores[at + t, y] for t, y in enumerate(way)) + sum(field.trans[y, z] for y, z in zip(way, way[1:])))
            total += w
            for t, y in enumerate(way):
                part[t, y] += w
        assert np.allclose(got[at : at + n], part / total, atol=1e-5)
        at += n


def test_code_switching_is_seen():
    en, es = [["the", "house", "with", "water"] * 12] * 8, [["que", "los", "casas", "para"] * 12] * 8
    field = langcrf.fit(["en", "es"], [en, es])
    runs = field.segments("the house with water the house que los casas para que los")
    assert [(a, b, k) for a, b, k in runs] == [(0, 6, "en"), (6, 12, "es")]


def network(seed, n=300):
    rng = np.random.default_rng(seed)
    ids = rng.zipf(1.3, 6000) % n
    pairs, times = np.unique(np.append(7, ids[:-1]) * n + ids, return_counts=True)
    classes = attnlm.id_classes(ids, np.full(60, 100), n)
    cells, back = np.unique(pairs // n * attnlm.CLASSES + classes[pairs % n], return_inverse=True)
    often = times > 1
    return attnlm.Attention(classes, np.bincount(ids, minlength=n).astype(float), (cells, np.bincount(back, times)), (pairs[often], times[often].astype(float)), 7)


def test_windows_score_each_id_once():
    rng = np.random.default_rng(2)
    net = network(2)
    net.params["out"] += rng.normal(size=net.params["out"].shape)
    net.freeze()
    sizes = np.array([1, 5, 31, 32, 33, 56, 57, 200])
    ids = rng.integers(0, 300, sizes.sum())
    got, at = net.score(ids, sizes), 0
    for n in sizes.tolist():
        assert np.allclose(net.score(ids[at : at + n], np.array([n])), got[at : at + n], atol=1e-4)
        at += n
    # Over all ids the probabilities of the next one sum to one, whatever came before.
    for before in ([], [3, 250, 9], list(rng.integers(0, 300, 45))):
        every = np.concatenate([np.array([*before, k]) for k in range(300)])
        last = net.score(every, np.full(300, len(before) + 1)).reshape(300, -1)[:, -1]
        assert abs(np.exp(last).sum() - 1) < 1e-3


def test_attention_gradient():
    rng = np.random.default_rng(3)
    net = network(3)
    x, y = rng.integers(0, 300, (4, attnlm.WIDTH)), rng.integers(0, attnlm.CLASSES, (4, attnlm.WIDTH))
    _, slopes = net._slopes(x, y)
    for name, p in net.params.items():
        at = tuple(rng.integers(0, s) for s in p.shape)
        if name == "embed":
            at = (int(net.classes[x[0, 0]]), 0)
        p[at] += 1e-5
        up = net._slopes(x, y)[0]
        p[at] -= 2e-5
        down = net._slopes(x, y)[0]
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - slopes[name][at]) < 1e-6


def test_training_and_scoring_reuse_their_arrays():
    rng = np.random.default_rng(6)
    net = network(6)
    net.freeze()
    net.params = {k: v.astype(np.float32) for k, v in net.params.items()}
    x, y = rng.integers(0, 300, (2, 128, attnlm.WIDTH))
    y %= attnlm.CLASSES
    for call in (lambda: net._slopes(x, y, np.ones(x.shape, np.float32))[1]["embed"], lambda: net._windows(x, net.classes[x], y, 8)):
        first = call().copy()
        tracemalloc.start()
        again = call()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.array_equal(first, again) and peak < 900_000


def test_the_most_frequent_words_are_looked_up_in_memory(spark, monkeypatch):
    monkeypatch.setattr(attnlm, "HEAD", 3)
    table = lambda *n: spark.createDataFrame([(f"w{k}".encode(), v) for k, v in enumerate(n)], "word binary, n long")
    # Of 1000 tokens only one word has a third.
    assert attnlm.head_of(table(900, 50, 40, 5, 3, 2)) == (1000, 6, 40)
    assert attnlm.head_of(table(7, 7, 7, 7)) == (28, 4, 1 << 62)
    assert attnlm.head_of(table(1)) == (1, 1, 1) and attnlm.head_of(table(1).limit(0)) == (0, 0, 1 << 62)


def test_language_model_against_brute_force(spark):
    """The base by its formula; the model beats it on unseen texts, and beats itself trained without attention."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: common.words_of(r.text) + [b""] for r in common.table(spark, sf, "documents").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    count = {}
    for d, ws in texts.items():
        if not held[d]:
            for w in ws:
                count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    rows = {r.doc_id: r for r in queries.op4_attention_lm(spark, sf).collect()}
    assert rows.keys() == texts.keys()
    for d, ws in texts.items():
        r = rows[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in count for w in ws), total, held[d])
        assert abs(r.base_score - sum(np.log10((count.get(w, 0) + 1) / (total + len(count) + 1)) for w in ws)) < 1e-6 * len(ws)
    unseen = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    docs = common.table(spark, sf, "documents")
    blind = {r.doc_id: r.score for r in attnlm.score_texts(docs, common.doc_bucket("doc_id", 7) != 2, queries._tokenizer(), attends=False).collect()}
    tokens = sum(r.n_tokens for r in unseen)
    assert (sum(r.score for r in unseen) - sum(blind[r.doc_id] for r in unseen)) / tokens > 0.005


def test_pairs_out_of_memory_count_as_well(spark, monkeypatch):
    """Scores are the same however many pairs are looked up in memory."""
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    found = []
    for most in (attnlm.PAIRS, 2000, 1):
        monkeypatch.setattr(attnlm, "PAIRS", most)
        out = attnlm.score_texts(docs, common.doc_bucket("doc_id", 7) != 2, queries._tokenizer())
        found.append(np.array([r.score for r in out.orderBy("doc_id").collect()]))
    assert np.allclose(found[1], found[0], rtol=1e-5) and np.allclose(found[2], found[0], rtol=1e-5)


def test_attention_learns_from_every_text(spark):
    """Pairs of ids are counted alike in both tables; only the 600 texts that come last by the hash of their ids tell which ends go together."""
    ids = [r.doc_id for r in spark.range(1, 2001).withColumnRenamed("id", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    plain, last = ids[:1400], ids[1400:]
    score = []
    for ends in (("north", "south"), ("south", "north")):
        rows = [(d, "one two three four five six") for d in plain]
        rows += [(d, "water " * 3 + "river " + ends[0] if k % 2 else "stone " * 3 + "river " + ends[1]) for k, d in enumerate(last)]
        docs = spark.createDataFrame([*rows, (0, "water water water river north")], "doc_id long, text string")
        score.append(attnlm.score_texts(docs, F.col("doc_id") != 0, queries._tokenizer()).where("doc_id = 0").first().score)
    assert score[0] > score[1] + 0.05


def test_training_windows_hold_each_id_once(spark):
    sizes, n, end = np.array([1, 2, 31, 32, 33, 511, 512, 513, 1300]), 300, 299
    texts = [np.random.default_rng(k).integers(0, n, s).astype(attnlm.id_type(n)) for k, s in enumerate(sizes)]
    rows = spark.createDataFrame([(k, bytearray(t.tobytes())) for k, t in enumerate(texts)], "doc_id long, ids binary")
    net = network(4)
    x, y, weight = attnlm.windows_of(net, [bytes(r.ids) for r in attnlm.pieces_of(rows, n, end).collect()], attnlm.id_type(n))
    want = sorted((b, net.classes[t]) for text in texts for b, t in zip([end, *text[:-1]], text))
    assert weight.sum() == sizes.sum() and sorted(zip(x[weight > 0].tolist(), y[weight > 0].tolist())) == want


def test_training_groups_do_not_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(attnlm, "SHARE", 200)
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    found = []
    for n in (1, 7):
        out = attnlm.score_texts(docs.repartition(n), common.doc_bucket("doc_id", 7) != 2, queries._tokenizer())
        found.append([r.score for r in out.orderBy("doc_id").collect()])
    assert np.allclose(*found, rtol=1e-4)


def test_pipeline_stages_follow_their_operators(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    groups = minmax.near_duplicates(docs, 5, 80)
    assert kept.count() == groups.where("kept").count() < docs.count()
    clean = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, sf).collect()}
    bad = " ".join
    items = [bad(r.text.lower().split()) for r in common.table(spark, sf, "benchmark").collect()]
    for r in docs.collect():
        if any(f" {i} " in f" {bad(r.text.lower().split())} " for i in items):
            assert r.doc_id not in clean
    last = corpus_pipeline.run(spark, sf)
    assert last.select(F.sum("n_tokens")).first()[0] == last.select(F.max(F.col("start") + F.col("n_tokens"))).first()[0]
