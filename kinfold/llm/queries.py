"""The queries of the text operators, with production parameters, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import doc_bucket, prepare, scratch, table

#: The tokenizer file that token queries use.
TOKENIZER = "word_bpe_49k.json"


def _tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.dac import read_tokens, write_tokens

    path = scratch(prepare(spark), "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, _tokenizer())
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.linededup import drop_lines, line_bitmaps

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_lines(docs, line_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.minmax import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.secretscan import as_text, scan

    found = scan(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(number, ("assign", "access", "hex")), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.mixing import mix

    kept = mix(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("c_source").alias("source"), F.col("c_lang").alias("lang"), F.col("c_topic").alias("topic"), F.col("c_tokens").alias("tokens"), F.round("rate", 9).alias("rate"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.toxicmil import score, train

    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), locate=0.5)
    # The sentences that are toxic on their own, as start:end in code points.
    spans = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.select("doc_id", (doc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("offending"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.langcrf import label, train

    docs = table(prepare(spark), sf_dir, "documents")
    labelled = label(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return labelled.select("doc_id", (doc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.attnlm import score_texts

    out = score_texts(table(spark, sf_dir, "documents"), doc_bucket("doc_id", 7) != 2, _tokenizer())
    return out.withColumn("held_out", doc_bucket("doc_id", 7) == 2)


def op1_ads_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.adsearch import search

    return search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.toccur import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), width=5, percent=80)


def _repeating(doc_id: Column, text: Column) -> Column:
    """The text whose words from a on repeat the p words there, where the id's crc32 is divisible by 10; other texts as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    n, g = F.size(words).cast("bigint"), F.floor(h / 10).cast("bigint")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
    row = F.struct(words.alias("w"), a.alias("a"), p.alias("p"))
    # One row of values, so that the words are cut once.
    place = lambda r, i: F.when(i >= r["a"], r["a"] + (i - r["a"]) % r["p"]).otherwise(i).cast("int")
    again = F.transform(F.array(row), lambda r: F.array_join(F.transform(r["w"], lambda w, i: F.get(r["w"], place(r, i))), " "))
    return F.when((h % 10 == 0) & text.rlike(r"[^ \t\n\x0B\f\r]"), again[0]).otherwise(text)


def op12_repair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.runs import find_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", _repeating(F.col("doc_id"), F.col("text")).alias("text"))
    runs = F.col("runs")
    # Whole numbers only: of two runs, length * other period decides; ties by start and then period, which is the order of the list.
    best = F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    digest = F.sha2(F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), ""), 256)
    found = find_runs(docs).select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), best.alias("best"), digest.alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.hardneg import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, i AS pos, parts[i] AS line,
         translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) a) b),
hot AS (SELECT key, max(doc_id) AS holder FROM lines WHERE length(key) >= 40
        GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, pos, line, holder IS NOT NULL AND doc_id <> holder AS gone FROM lines LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP6_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0) x),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * inter >= 80 * (p.n + q.n - inter)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(root, node) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.root, b.y FROM reach r JOIN both_ways b ON b.x = r.node),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least l ON l.node = d.doc_id
"""

# The same with five words a shingle.
OP11_SQL = OP6_SQL.replace("CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s", "array_to_string(w[i:i + 4], ' ') AS s").replace(
    "greatest(len(w), 2)", "greatest(len(w) - 3, 2)"
).replace(", d.doc_id = component_id AS kept", "")

OP10_SQL = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
         CASE WHEN regexp_matches(coalesce(text, ''), '(License|LICENSE|Copyright|copyright)') THEN 'licence'
              WHEN regexp_matches(coalesce(text, ''), '[a-z0-9]@[a-z0-9]') THEN 'contact'
              WHEN regexp_matches(coalesce(text, ''), '([*]{3}|[#]{3}|[%]{3}|[$]{3}|[&]{3})') THEN 'markup' ELSE 'prose' END AS topic,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM documents),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM rows_ WHERE tokens > 0 GROUP BY ALL),
by_source AS (SELECT source, t / sum(t) OVER () AS ts FROM (SELECT source, pow(sum(tokens), 0.9) AS t FROM cells GROUP BY source) a),
by_lang AS (SELECT lang, t / sum(t) OVER () AS tl FROM (SELECT lang, pow(sum(tokens), 0.9) AS t FROM cells GROUP BY lang) a),
by_topic AS (SELECT topic, t / sum(t) OVER () AS tt FROM (SELECT topic, pow(sum(tokens), 0.9) AS t FROM cells GROUP BY topic) a),
aimed AS (SELECT * FROM cells JOIN by_source USING (source) JOIN by_lang USING (lang) JOIN by_topic USING (topic)),
fit AS (
  SELECT 0 AS n, source, lang, topic, tokens, ts, tl, tt, tokens AS w FROM aimed
  UNION ALL
  SELECT n + 1, source, lang, topic, tokens, ts, tl, tt, w * tt / sum(w) OVER (PARTITION BY topic)
  FROM (SELECT * REPLACE (w * tl / sum(w) OVER (PARTITION BY lang) AS w)
        FROM (SELECT * REPLACE (w * ts / sum(w) OVER (PARTITION BY source) AS w) FROM fit WHERE n < 12) a) b),
rates AS (SELECT source, lang, topic, (w / tokens) / max(w / tokens) OVER () AS rate FROM fit WHERE n = 12)
SELECT r.doc_id, r.source, r.lang, r.topic, r.tokens, round(CASE WHEN r.tokens = 0 THEN 1 ELSE coalesce(rate, 0) END, 9) AS rate
FROM rows_ r LEFT JOIN rates USING (source, lang, topic)
WHERE ('0x' || substr(md5('11:' || r.doc_id), 1, 13))::BIGINT / pow(16, 13) < CASE WHEN r.tokens = 0 THEN 1 ELSE coalesce(rate, 0) END
"""


OP13_SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ads_search, op2_toxicity, op4_attention_lm, op8_language_id, op3_token_codes, op5_line_dedup, op6_minmax_dedup, op7_secret_scan, op9_decontamination, op10_mixing, op11_ngram_join, op12_repair_runs, op13_hard_negatives, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op6_minmax_dedup": OP6_SQL, "op10_mixing": OP10_SQL, "op11_ngram_join": OP11_SQL, "op13_hard_negatives": OP13_SQL}
