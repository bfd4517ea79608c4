"""The registered queries of these operators, on whole tables, with SQL where SQL can state the result."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import attribution, bpe, decontam, extract, hmm, mixing, quality, runs, simhash, tokenfiles, toxicity, vectorcodes, warc
from skyledger.llm.text import crc_remainder
from skyledger.plans.staging import new_folder
from skyledger.sources.testdata import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Vocabulary file of a public tokenizer, installed on every machine; another path may be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.assign(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    tokenfiles.write(table(spark, folder, "documents"), path, tokenizer=tokenizer_path())
    return tokenfiles.read(spark, path).withColumnRenamed("id", "doc_id")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("at").alias("first_word"), "n_words", "edits")


def op6_hmm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    found = hmm.score(table(spark, folder, "documents"), crc_remainder(F.col("doc_id"), 7) != 2)
    return found.select(F.col("id").alias("doc_id"), (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    params = toxicity.train(docs, labels, crc_remainder(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, params).select(
        F.col("id").alias("doc_id"), (crc_remainder(F.col("id"), 5) == 0).alias("held_out"), "score", "predicted")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.derivatives(warc.responses(table(spark, folder, "pages")))
    return found.withColumnRenamed("id", "page_id").withColumn("record", F.decode("record", "UTF-8"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return attribution.sections(table(spark, folder, "documents"), tokenizer=tokenizer_path()).withColumnRenamed("id", "doc_id")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), tokenizer=tokenizer_path()).withColumnRenamed("id", "doc_id")


def _planted(key: int | None, words: np.ndarray) -> np.ndarray:
    """The contract's periodic tail in one of ten documents."""
    n, h = len(words), zlib.crc32(b"" if key is None else str(key).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    k = np.arange(n)
    return words[np.where(k < a, k, a + (k - a) % p)]


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.report(table(spark, folder, "documents"), rewrite=_planted).withColumnRenamed("id", "doc_id")


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vectorcodes.report(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_html_extraction": op2_html_extraction,
    "op3_simhash": op3_simhash,
    "op4_token_files": op4_token_files,
    "op5_decontamination": op5_decontamination,
    "op6_hmm_scoring": op6_hmm_scoring,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
    "op11_bpe": op11_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {  # the learned, approximate and file-writing operators have none
    "op1_mixing": f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, sha256(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(r % 3 + 1)::INT]::DOUBLE AS weight, CASE WHEN r % 2 = 0 THEN 0.5 ELSE -0.5 END::DOUBLE AS lean, 2 * source_size AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
  sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
g AS (SELECT *, weight * rest / weights < cap AS free FROM f),
l AS (SELECT rest AS l_rest, weights AS l_weights FROM g WHERE free ORDER BY cap / weight, r LIMIT 1),
t AS (SELECT g.source, g.source_size, g.weight, g.lean, CASE WHEN free THEN weight * l_rest / l_weights ELSE cap::DOUBLE END AS target FROM g LEFT JOIN l ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.weight, t.weight * (1 + t.lean) AS w0, t.weight * (1 - t.lean) AS w1,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - ahead)) AS u1, greatest(0, least(size, floor(target)::BIGINT - ahead - source_size)) AS u2,
  ahead / nullif(target, 0) * weight AS need FROM p)
SELECT doc_id, size, source_size, target, (u1 + u2)::BIGINT AS taken, CASE WHEN u1 > 0 THEN least(coalesce(2 * need / nullif(w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * need, 0)), 0), 0), 1)::DOUBLE END AS position FROM u""",
    "op10_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM d, unnest(range(1, len(ws) - 1)) r(i)),
c AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c) GROUP BY doc_id),
x AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, list_filter(string_split(t, chr(10)), lambda e: regexp_matches(e, '[^\x20\x09-\x0D]')) AS ls FROM d),
y AS (SELECT x.doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM x LEFT JOIN r USING (doc_id)),
z AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT 10 * n_symbols > n_words AND NOT 10 * n_dup_lines > 6 * n_lines AND word_chars BETWEEN 2 * n_words AND 14 * n_words AS kept FROM z""",
}


def _lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Each round is one table of nearest entries and one of new codebooks."""
    steps = [f"""
d AS (SELECT row_number() OVER (ORDER BY vec_id, [floor(4096 * x::DOUBLE) FOR x IN embedding]) AS r, vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, k, v[(k * (len(v) // {parts}) + 1)::INT:((k + 1) * (len(v) // {parts}))::INT] AS x FROM d, range({parts}) t(k)),
b0 AS MATERIALIZED (SELECT k, r - 1 AS e, x AS c FROM p WHERE r <= {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT r, k, min(s).e AS e, min(s).f AS f FROM (SELECT p.r, p.k,
  {{'f': list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.x, b.c)])::BIGINT, 'e': b.e}} AS s FROM p JOIN b{n} b ON p.k = b.k) GROUP BY r, k)""")
        if n < rounds:
            steps.append(f"""
m{n} AS (SELECT k, e, list(c::BIGINT ORDER BY i) AS c FROM (SELECT k, e, i, floor(sum(y)::DOUBLE / count(*)) AS c FROM
  (SELECT p.k, a.e, unnest(p.x) AS y, unnest(range(1, len(p.x) + 1)) AS i FROM p JOIN a{n} a ON p.r = a.r AND p.k = a.k) GROUP BY k, e, i) GROUP BY k, e),
b{n + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m ON b.k = m.k AND b.e = m.e)""")
    return f"""WITH {",".join(steps)},
g AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY k) AS code, sum(f)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT d.vec_id, g.code, g.error, (sum(g.error) OVER (PARTITION BY d.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) FROM b{rounds}) AS codebooks_sha256 FROM d JOIN g ON d.r = g.r"""


SQL["op13_vector_codes"] = _lloyd_sql()
