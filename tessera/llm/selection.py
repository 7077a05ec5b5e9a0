"""Operator 2: importance resampling with hashed n-gram models, by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._spark import batches_of, discard, durable, prefix_sums
from tessera.llm._words import U, ngrams, word_hashes

BUCKETS = 10_000


def bucket_counts(text: str | None, buckets: int) -> np.ndarray:
    """Counts of the hashed words and word pairs of the whole text, A-Z lower-cased."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    return np.bincount((np.concatenate([h, ngrams(h, 2)]) % U(buckets)).astype(np.int64), minlength=buckets)


def log_ratios(df: DataFrame, target_ids: list, text: str, doc_id: str, buckets: int = BUCKETS, smoothing: float = 1.0) -> np.ndarray:
    """For each bucket the log of its probability in the target texts over that in all texts.

    All rows are counted, in the tasks first; ``target_ids`` is a bounded sample.
    """
    sent = df.sparkSession.sparkContext.broadcast(frozenset(target_ids))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = bucket_counts(v.as_py(), buckets)
                raw += n
                if k in sent.value:
                    target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw[at], pa.int64()), pa.array(target[at], pa.int64())], ["bucket", "raw", "target"])

    rows = df.select(doc_id, text).mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()  # ``buckets`` rows at most
    raw, target = np.full(buckets, smoothing), np.full(buckets, smoothing)
    for bucket, r, t in rows:
        raw[bucket] += r
        target[bucket] += t
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def importance_resampled(
    df: DataFrame, target: DataFrame, keep: float = 0.8, text: str = "text", doc_id: str = "doc_id", target_rows: int = 20_000, buckets: int = BUCKETS, seed: int = 11
) -> DataFrame:
    """The id, log_ratio, gumbel_key and selected of each row of ``df``.

    ``target`` has the ids of texts that stand for the wanted distribution; at most ``target_rows`` of them, by a hash of the id, make the
    target model, and all rows the raw one. A text's log ratio is the sum over its words and word pairs. Gumbel noise hashed from the id is
    added, and the ceil(``keep`` * rows) largest sums, equal ones by id, are selected: a sample without replacement in proportion to the
    ratios. Ranks come from global prefix sums, without a sort in one task.

    A null or empty text has log ratio 0, and so has every text without a target. Rows with the same id and text have the same key.
    A table without rows gives none; other columns are left out.
    """
    batches_of(1_000, df.sparkSession)
    ids = [r[0] for r in target.select(doc_id).where(F.col(doc_id).isNotNull()).distinct().orderBy(F.xxhash64(F.lit(seed), F.col(doc_id)), doc_id).limit(target_rows).collect()]
    ratios = log_ratios(df, ids, text, doc_id, buckets) if ids else np.zeros(buckets)
    sent = df.sparkSession.sparkContext.broadcast(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [float(bucket_counts(v.as_py(), buckets) @ sent.value) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "log_ratio"])

    kind = df.schema[doc_id].dataType.simpleString()
    scored = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(score, f"id {kind}, log_ratio double")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.lit("gumbel"), F.col("id")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = durable(scored.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(uniform))).withColumn("_one", F.lit(1).cast("long")))
    rows = keyed.count()
    ranked = prefix_sums(keyed, [F.col("gumbel_key").desc(), F.col("id")], {"_rank": "_one"})
    discard(keyed)
    return ranked.select(F.col("id").alias(doc_id), "log_ratio", "gumbel_key", (F.col("_rank") < F.ceil(F.lit(keep) * rows)).alias("selected"))
