"""Operator 8: a mix of sources with target weights, by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._spark import discard, durable, n_words, prefix_sums, set_apart

#: Sources fewer than this are joined by broadcast (under 100 bytes each); more are joined by a shuffle.
FEW_SOURCES = 2_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows < FEW_SOURCES else df


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> tuple[DataFrame, int]:
    """(source, source_size, target) and the number of sources.

    ``sizes`` has _source and _size. Sources in code-point order, null last, take the weights in turn. They divide
    ``share`` of all words by weight; none gets over ``most`` times its own words, and what is over is divided again.
    """
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("_words")).withColumn("_one", F.lit(1).cast("long")).withColumn("_none", F.col("_source").isNull())
    ranks = prefix_sums(per, [F.col("_none"), F.col("_source")], {"_rank": "_one"})
    turn = F.array(*(F.lit(float(w)) for w in weights))
    ranked = ranks.withColumn("_weight", F.element_at(turn, (F.col("_rank") % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("_words") * float(most))
    total, count, all_weights = ranked.agg(F.coalesce(F.sum("_words"), F.lit(0)), F.count("*"), F.sum("_weight")).first()
    # The level of water, in words for each unit of weight: sources are full in the order of their caps by weight, and it stands before the first that isn't.
    filled = prefix_sums(ranked.withColumn("_full_at", F.col("_cap") / F.col("_weight")), [F.col("_full_at"), F.col("_none"), F.col("_source")], {"_caps": "_cap", "_weights": "_weight"})
    level = (F.lit(share * total) - F.col("_caps")) / (F.lit(all_weights) - F.col("_weights"))
    found = filled.where(level < F.col("_full_at")).agg(F.min_by(level, "_full_at")).first()[0]
    target = F.col("_cap") if found is None else F.least(F.col("_cap"), F.lit(found) * F.col("_weight"))
    discard(ranks)
    return filled.select("_source", F.col("_words").alias("_source_size"), target.alias("_target")), count


RESULTS = ("_size", "_source_size", "_target", "_copies")


def fair_mix(
    df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = "mix"
) -> DataFrame:
    """All rows of ``df`` with _size, _source_size, _target and _copies, the times (0 to ``most``) that the mix takes the row.

    The rows of a source stand in the order of a keyed hash of the id, and may be taken ``most`` times, one pass after
    another. A copy's virtual finish time is the source's words up to and with it, divided by the source's target. All
    copies are range-sorted by that time, equal ones by source and place, and taken up to the first that would take their words over the sum of the targets.
    A pass takes the head of a source's order, so a cut for each source and pass tells for every row whether it is taken,
    without a shuffle of the texts.

    A source without words keeps its place among the weights. A null or empty text has size 0 and, like a row of a source whose target is 0, is taken 0 times. Null is a source of
    its own. Repeated rows share one place and are taken alike. A table without rows gives none. Columns of ``df`` that
    have the names of new ones are replaced.
    """
    apart, names = set_apart(df)
    out = _fair_mix(apart, weights, share, most, names[text], names[source], names[doc_id], seed)
    return out.select(*(F.col(names[c]).alias(c) for c in df.columns if c not in RESULTS), *RESULTS)


def _fair_mix(df: DataFrame, weights: Sequence[float], share: float, most: int, text: str, source: str, doc_id: str, seed: str) -> DataFrame:
    size, place = n_words(F.col(text)), F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("h"), F.col(doc_id).cast("string").alias("i"))
    narrow = durable(df.select(F.col(source).alias("_source"), size.alias("_size"), place.alias("_place")).withColumn("_none", F.col("_source").isNull()))
    targets, count = source_targets(narrow.select("_source", "_size"), weights, share, most)
    targets = durable(targets)
    line_up = prefix_sums(narrow.where("_size > 0").groupBy("_none", "_source", "_place").agg(F.sum("_size").alias("_size")), [F.col("_none"), F.col("_source"), F.col("_place")], {"_before": "_size"}, within=["_source"])
    queued = line_up.join(_small(targets.withColumnRenamed("_source", "_s"), count), F.col("_source").eqNullSafe(F.col("_s")), "inner").drop("_s").where("_target > 0")
    copies = queued.select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("_pass")).withColumn("_finish", (F.col("_pass") * F.col("_source_size") + F.col("_before") + F.col("_size")) / F.col("_target"))
    line = [F.col("_finish"), F.col("_none"), F.col("_source"), F.col("_place")]
    sorted_ = prefix_sums(copies, line, {"_sum": "_size"})
    budget = targets.agg(F.coalesce(F.sum("_target"), F.lit(0.0))).first()[0]
    cuts = sorted_.where(F.col("_sum") + F.col("_size") <= budget).groupBy("_source").pivot("_pass", list(range(most))).agg(F.max("_place"))
    cuts = durable(targets.join(cuts.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s"))
    discard(narrow, targets, line_up, sorted_)
    taken = sum((F.when(F.col("_place") <= F.col(str(k)), 1).otherwise(0) for k in range(most)), F.lit(0))
    out = df.select("*", size.alias("_size"), place.alias("_place")).join(_small(cuts.withColumnRenamed("_source", "_s"), count), F.col(source).eqNullSafe(F.col("_s")), "left")
    return out.select(*df.columns, "_size", F.coalesce("_source_size", F.lit(0)).cast("long").alias("_source_size"), F.coalesce("_target", F.lit(0.0)).alias("_target"), F.when(F.col("_size") > 0, taken).otherwise(0).cast("int").alias("_copies"))


def mixed(
    df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = "mix"
) -> DataFrame:
    """The mix itself: every row of ``df`` as many times as fair_mix() takes it, with the columns of ``df``."""
    apart, names = set_apart(df)
    out = _fair_mix(apart, weights, share, most, names[text], names[source], names[doc_id], seed)
    taken = out.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return taken.select(*(F.col(names[c]).alias(c) for c in df.columns))
