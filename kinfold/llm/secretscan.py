"""Secrets in texts: fixed patterns, and tokens that pass a battery of randomness tests.

Only DataFrame functions run here.  A match's place comes from the lengths of the pieces that
``split`` leaves around the matches of the same pattern, summed along the text.

Tokens of mixed character classes get an encoding (the smallest alphabet that holds them) and
three tests of "uniform random draws from that alphabet": chi-squared over the alphabet with the exact
multinomial variance, runs above and below the alphabet's middle, and lag-1 serial correlation.
Fisher's method joins the three.  Random tokens spread their p evenly over 0 to 1, other tokens pile up near 0.
For each alphabet and length band the upper half of p estimates how many are random, and hence
the share of false discoveries among the tokens over any bound; the band takes the lowest bound
(at least ``MIN_P``) whose share isn't shown to be over ``ALPHA``: the upper half counts with its upper 95 % limit, so a band with
few tokens keeps all over ``MIN_P`` (some five false ones at most), and in a band with many the limit nears the count.
Bands are counted over the whole table; the counts are a bounded table.

Tokens that hold ``/`` or ``=`` are tested whole and in parts cut there, so a path or a name before a secret doesn't hide it;
a part is reported where the whole is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import stored

# The patterns and least lengths of the base kinds.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN = 12

TOKEN = "[A-Za-z0-9+/=_-]{20,}"
CUT, LEAST = "[/=]", 20
ALPHA, MIN_P, BINS = 0.05, 0.02, 50
#: Normal quantile of the one-sided 95 % limit of a count.
LIMIT = 1.645
UP, LOW, NUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the narrowest: a pattern and its alphabet in order.
ENCODINGS = [("[0-9a-f]+", NUM + "abcdef"), ("[0-9A-F]+", NUM + "ABCDEF"), ("[A-Z2-7]+", UP + "234567"), ("[a-z0-9]+", NUM + LOW), ("[A-Z0-9]+", NUM + UP), ("[A-Za-z0-9]+", UP + LOW + NUM), ("[A-Za-z0-9+/]+", UP + LOW + NUM + "+/"), ("[A-Za-z0-9_-]+", UP + LOW + NUM + "-_"), (".+", UP + LOW + NUM + "+/-_=")]


def _row() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _matches(docs: DataFrame) -> DataFrame:
    """``doc_id, row, kind, match, start, end``: every match, in code points, end exclusive."""
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True))
    found = docs.select("doc_id", _row().alias("row"), "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in patterns.items()])
    lengths = lambda p: F.transform(F.split("text", p, -1), F.char_length)
    parts = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("m"), F.when(F.size(k) > 0, lengths(p)).alias("gaps")) for k, p in patterns.items()]
    each = found.select("doc_id", "row", F.inline(F.array(*parts))).where("size(m) > 0").distinct()
    each = each.select("doc_id", "row", "kind", F.posexplode(F.arrays_zip("m", F.slice("gaps", F.lit(1), F.size("m")).alias("gap"))).alias("i", "z"))
    each = each.select("doc_id", "row", "kind", "i", F.col("z.m").alias("match"), F.col("z.gap").alias("gap"))
    so_far = Window.partitionBy("doc_id", "row", "kind").orderBy("i")
    size = F.char_length("match")
    end = F.sum(F.col("gap") + size).over(so_far)
    return each.select("doc_id", "row", "kind", "match", (end - size).alias("start"), end.alias("end"))


def _upper_tail(z: Column) -> Column:
    """P(normal > z), by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(F.lit(1.0) - half)


def randomness(tokens: DataFrame) -> DataFrame:
    """Adds ``k`` (alphabet size), ``len`` and ``p`` to a table with ``match``; p is null where the tests don't apply.

    They apply to tokens with at least two of: digits, capitals, small letters.  Padding ``=`` at the end is left out.
    """
    t = tokens.withColumn("tok", F.rtrim("match", F.lit("=")))
    kinds = sum((F.col("tok").rlike(c).cast("int") for c in ("[0-9]", "[A-Z]", "[a-z]")), F.lit(0))
    alphabet, halves = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, letters in reversed(ENCODINGS):
        hit = F.col("tok").rlike(f"^(?:{pattern})$")
        alphabet = F.when(hit, F.lit(letters)).otherwise(alphabet)
        halves = F.when(hit, F.translate("tok", letters, "0" * (len(letters) // 2) + "1" * (len(letters) - len(letters) // 2))).otherwise(halves)
    t = t.withColumns({"mixed": (kinds >= 2) & (F.char_length("tok") >= 16), "abc": alphabet, "halves": halves})
    t = t.withColumns({"len": F.char_length("tok"), "k": F.char_length("abc"), "codes": F.expr("transform(filter(split(tok, ''), c -> c <> ''), c -> cast(instr(abc, c) as double))")})
    n, k = F.col("len").cast("double"), F.col("k").cast("double")
    squares = F.expr("aggregate(filter(split(abc, ''), c -> c <> ''), 0D, (a, c) -> a + pow(len - char_length(replace(tok, c, '')), 2))")
    ones = F.expr("cast(char_length(replace(halves, '0', '')) as double)")
    turns = F.expr("(2 * char_length(halves) - char_length(replace(halves, '01', '')) - char_length(replace(halves, '10', ''))) / 2")
    t = t.withColumns({"chi": k / n * squares - n, "ones": ones, "turns": turns, "mid": (k + 1) / 2})
    t = t.withColumns({"lag": F.expr("aggregate(zip_with(slice(codes, 1, len - 1), slice(codes, 2, len - 1), (x, y) -> (x - mid) * (y - mid)), 0D, (a, x) -> a + x)"), "var": F.expr("aggregate(codes, 0D, (a, x) -> a + (x - mid) * (x - mid))")})
    mean = 2 * F.col("ones") * (n - F.col("ones")) / n
    spread = F.sqrt(mean * (mean - 1) / (n - 1))
    z_chi = (F.col("chi") - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    z_runs = F.when(spread > 0, F.try_divide(F.col("turns") - mean, spread)).otherwise(-F.sqrt(n))
    z_lag = F.coalesce(F.try_divide(F.col("lag"), F.col("var")) + 1 / n, F.lit(1.0)) * F.sqrt(n)
    least = F.lit(1e-7)
    ps = [F.greatest(_upper_tail(z_chi), least), F.greatest(2 * _upper_tail(F.abs(z_runs)), least), F.greatest(2 * _upper_tail(F.abs(z_lag)), least)]
    t = t.withColumn("half_x", -(F.log(ps[0]) + F.log(ps[1]) + F.log(ps[2])))
    h = F.col("half_x")
    return t.withColumn("p", F.when(F.col("mixed"), F.exp(-h) * (1 + h + h * h / 2))).select(*tokens.columns, "k", "len", "p")


def _parts(tokens: DataFrame) -> DataFrame:
    """The long enough parts of tokens that hold a slash or an equals sign, with their own places and the ``whole``'s start."""
    cut = tokens.where(F.rtrim("match", F.lit("=")).rlike(CUT)).withColumn("whole", F.col("start"))
    each = cut.select("doc_id", "row", "kind", "whole", F.posexplode(F.split("match", CUT, -1)).alias("i", "match"))
    so_far = Window.partitionBy("doc_id", "row", "whole").orderBy("i")
    end = F.col("whole") + F.sum(F.char_length("match") + 1).over(so_far) - 1
    placed = each.withColumns({"end": end, "start": end - F.char_length("match")})
    return placed.where(F.char_length("match") >= LEAST).select("doc_id", "row", "kind", "match", "start", "end", "whole")


def _random_tokens(tokens: DataFrame) -> DataFrame:
    """The tokens over their band's bound, parts only of those that aren't."""
    passed = _over_bounds(tokens)
    found = F.max("is_whole").over(Window.partitionBy("doc_id", "row", "whole"))
    return passed.withColumn("found", found).where("is_whole or not found")


def _over_bounds(tokens: DataFrame) -> DataFrame:
    """The tokens over their band's bound."""
    scored = tokens.where("p is not null").withColumns({"band": F.floor(2 * F.log2("len")).cast("int"), "bin": F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int")})
    counts = scored.groupBy("k", "band", "bin").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("k", "band")
    over = F.sum("n").over(group.orderBy(F.desc("bin")))
    upper = F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).over(group)
    most = upper + 1 + LIMIT * F.sqrt(upper + 1)
    random = 2.0 * most * (1 - F.col("bin") / BINS)
    ok = counts.withColumn("false", 1 - F.least(F.lit(1.0), random / over)).where((F.col("false") <= ALPHA) & (F.col("bin") >= MIN_P * BINS))
    bounds = ok.groupBy("k", "band").agg(F.min("bin").alias("bound"))
    return scored.join(F.broadcast(bounds), ["k", "band"]).where("bin >= bound")  # at most one row for an alphabet and band


def secret_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, row, spans``: array of (start, kind number, kind, end), sorted, for rows that hold any.

    ``row`` is xxhash64 of the text and tells rows with one doc_id apart; equal rows come once.  Places are code points, end
    exclusive.  Base spans are assign, access and hex; random spans are added and may overlap them.
    Null and empty texts hold nothing.
    """
    found = stored(_matches(docs), "matches")
    long_enough = F.char_length(F.regexp_extract("match", ASSIGN, 2)) >= MIN_ASSIGN
    base = found.where((F.col("kind") != "random") & ((F.col("kind") != "assign") | long_enough))
    wholes = found.where("kind = 'random'")
    every = wholes.withColumns({"whole": F.col("start"), "is_whole": F.lit(True)}).unionByName(_parts(wholes).withColumn("is_whole", F.lit(False)))
    random = _random_tokens(stored(randomness(every), "tokens"))
    cols = ["doc_id", "row", "kind", "start", "end"]
    every = base.select(*cols).union(random.select(*cols))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return every.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("nth"), "kind", "end"))).alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as ``doc_id, spans`` (an empty array where nothing is found).

    An empty table gives no rows; texts of any length are searched whole; rows that share a doc_id are told apart by their texts, and other columns, whatever their names, are not read.
    """
    spans = secret_spans(docs)
    rows = docs.select("doc_id", _row().alias("row"))
    both = rows.join(spans, rows["doc_id"].eqNullSafe(spans["doc_id"]) & (rows["row"] == spans["row"]), "left")
    empty = F.expr("cast(array() as array<struct<start: bigint, nth: bigint, kind: string, end: bigint>>)")
    return both.select(rows["doc_id"], F.coalesce("spans", empty).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
