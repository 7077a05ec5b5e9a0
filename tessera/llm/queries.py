"""The queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, language, media, mixing, pii, rules, selection, sharding, tokenizer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_pii", "pii_kinds")


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return selection.importance_resampled(_table(spark, sf_dir, "documents"), good)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.balanced_shards(_table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.piece_counts(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature = F.concat_ws(":", F.size("fp_codes").cast("string"), F.lower(F.hex(F.xxhash64("fp_times", "fp_codes"))))
    return media.media_columns(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature")
    )


def op7_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_cascade(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.fair_mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.coded_digests(_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_feistel_pseudonyms, op2_importance_resampling, op3_language_id, op4_balanced_shards, op5_longest_match_counts,
        op6_wav_fingerprints, op7_rule_cascade, op8_fair_mix, op9_jaccard_join, op10_byte_bpe,
    )
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op7_rule_cascade"] = r"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS w
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) > 7)
), repeated AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS k FROM windows) WHERE k > 1
), covered AS (
    SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
    FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM repeated) GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
    FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
    SELECT d.doc_id, body, len(words)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
           (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM docs d LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > n_lines * 3 OR word_chars < n_words * 2 OR word_chars > n_words * 12
            OR (length(body) - length(replace(body, '!', ''))) * 10 > n_words * 3
            OR length(regexp_replace(body, '[^\p{L}]', '', 'g')) * 2 < word_chars
            OR length(regexp_replace(body, '[^\p{Lu}]', '', 'g')) * 2 > word_chars) AS kept
FROM b
"""

ORACLE_SQL["op8_fair_mix"] = r"""
WITH docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || doc_id::VARCHAR) AS h, doc_id::VARCHAR AS i FROM documents
), per AS (
    SELECT source, sum(size)::BIGINT AS words FROM docs GROUP BY source
), ranked AS (
    SELECT *, words * 2.0::DOUBLE AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w, 1.5::DOUBLE * sum(words) OVER () AS budget FROM per
), full_at AS ( -- the highest level that doesn't use up all, of those at which a source is full
    SELECT max(r) AS r FROM (SELECT DISTINCT x.cap / x.w AS r, x.budget FROM ranked x UNION SELECT 0.0, budget FROM ranked) b WHERE (SELECT sum(least(y.cap, b.r * y.w)) FROM ranked y) <= b.budget
), level AS (
    SELECT (max(budget) - coalesce(sum(cap) FILTER (cap / w <= r), 0)) / sum(w) FILTER (cap / w > r) AS l FROM ranked, full_at
), targets AS (SELECT source, words, least(cap, l * w)::DOUBLE AS target FROM ranked, level
), queued AS (
    SELECT d.*, t.words, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, i)::BIGINT AS upto
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0 AND target > 0
), line AS (
    SELECT q.*, p, (p * words + upto) / target AS finish FROM queued q, (VALUES (0), (1)) v(p)
), summed AS (
    SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, h, i ROWS UNBOUNDED PRECEDING) AS total FROM line
), taken AS (
    SELECT doc_id, sum(size)::BIGINT AS n FROM summed WHERE total <= (SELECT sum(target) FROM targets) GROUP BY doc_id
)
SELECT d.doc_id, d.size, coalesce(t.words, 0)::BIGINT AS source_size, coalesce(t.target, 0)::DOUBLE AS target, coalesce(k.n, 0)::BIGINT AS taken
FROM docs d LEFT JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON d.doc_id = k.doc_id
"""

ORACLE_SQL["op9_jaccard_join"] = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, list_aggregate(words[i:i + 3], 'string_agg', ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 2)) AS i FROM docs WHERE len(words) > 3)
    UNION ALL SELECT doc_id, list_aggregate(words, 'string_agg', ' ') FROM docs WHERE len(words) BETWEEN 1 AND 3
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (SELECT x AS v, x AS r FROM both_ways UNION SELECT b.y, reach.r FROM reach JOIN both_ways b ON b.x = reach.v
), least AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least ON least.v = d.doc_id
"""
