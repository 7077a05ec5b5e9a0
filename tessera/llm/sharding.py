"""Operator 4: contiguous shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._spark import discard, durable, prefix_sums


def balanced_shards(df: DataFrame, n_shards: int = 40, text: str = "text", doc_id: str = "doc_id", overhead: int = 16, keep_together: int = 20) -> DataFrame:
    """Cut the rows, in the order of (checksum of the text, its 64-bit hash, its size, id), into contiguous shards of nearly equal bytes.

    A row weighs the UTF-8 bytes of its text plus ``overhead``. Global prefix sums come from the totals of range
    partitions; a row belongs to the shard in whose equal target its first byte falls. Equal texts stand side by side; a
    group of them that a cut divides moves as a whole to the shard where it begins if it has at most 1/``keep_together``
    of a target, and is divided otherwise. So a shard is larger than a target by no more than that part of one and a row; a group of a third of all bytes kept whole
    would make one of 40 shards 13 times as large.

    Returns the id, size, text_crc32 (unsigned), shard and slot (0, 1, ... in each shard, in the order above).
    A null text has no bytes and checksum 0; repeated rows are ordered among themselves in any way; a table without rows
    gives none; other columns are left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(
        F.col(doc_id).alias("_id"),
        (F.octet_length(body) + overhead).cast("long").alias("_size"),
        F.crc32(body.cast("binary")).alias("_crc"),
        F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(body)).alias("_hash"),
        F.lit(1).cast("long").alias("_one"),
    )
    order = [F.col("_crc"), F.col("_hash"), F.col("_size"), F.col("_id")]
    base = prefix_sums(narrow, order, {"_start": "_size", "_row": "_one"})
    total = base.agg(F.sum("_size")).first()[0] or 1
    placed = base.withColumn("_shard", F.least(F.floor(F.col("_start") * n_shards / F.lit(total)), F.lit(n_shards - 1)).cast("int"))
    # Of the groups that lie across a cut there are fewer than shards; each small one goes to its first shard.
    group = placed.groupBy("_crc", "_hash").agg(F.min("_shard").alias("_first"), F.max("_shard").alias("_last"), F.sum("_size").alias("_bytes"))
    cut = group.where((F.col("_first") < F.col("_last")) & (F.col("_bytes") * n_shards * keep_together <= total)).select("_crc", "_hash", "_first")
    shard = durable(placed.join(F.broadcast(cut), ["_crc", "_hash"], "left").withColumn("_shard", F.coalesce("_first", "_shard")).drop("_first"))
    first = shard.groupBy("_shard").agg(F.min("_row").alias("_from"))
    discard(base)
    return shard.join(F.broadcast(first), "_shard").select(
        F.col("_id").alias(doc_id), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"), (F.col("_row") - F.col("_from")).alias("slot")
    )
