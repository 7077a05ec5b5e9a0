"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch that goes to a Python worker; a longer text is a batch by itself.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and Spark runs on this machine alone (tests), a temporary one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("tessera.checkpoint.dir", folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: its lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what durable() wrote for frames that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_apart(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns renamed so that they clash with none of an operator's own, and the new names by the old ones."""
    names = {c: f"in{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, for use where common subexpressions are not shared."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the runs of characters other than white space; empty for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def n_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str], within: Sequence[str] = ()) -> DataFrame:
    """Exclusive running sums over the whole of ``df`` in the given order, or over each value of the ``within`` columns.

    ``sums`` maps a new column to the column that it sums. ``order`` must begin with the ``within`` columns. The rows are
    range partitioned and written; running totals of the partitions (one row for each partition, and for each
    ``within`` value in it) are added to the sums inside a partition, so that no task sees more than its range.
    The result is again written.
    """
    spark = df.sparkSession
    ranged = durable(df.repartitionByRange(partitions(spark), *order).withColumn("_pid", F.spark_partition_id()))
    # Nulls in `within` are values of their own: grouping and windows take them so, joins are null-safe.
    keys = ["_pid", *within]
    totals = ranged.groupBy(*keys).agg(*(F.sum(v).alias(f"_t_{k}") for k, v in sums.items()))
    before = Window.partitionBy(*within).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_t_{k}") for k in sums))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_w_{k}") for k, v in sums.items()))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = rows.join(totals, same, "inner").select(*df.columns, *((F.col(f"_w_{k}") + F.col(f"_t_{k}")).alias(k) for k in sums))
    out = durable(out)
    discard(ranged)
    return out


def batches_of(rows: int, spark: SparkSession) -> None:
    """Fewer rows and bytes in an Arrow batch, and fewer rows in a batch of the Parquet reader, where the session still has Spark's defaults: texts can be long."""
    for key, default, now in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", BATCH_BYTES),
        ("spark.sql.parquet.columnarReaderBatchSize", "4096", min(rows, 512)),
    ):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, str(now))
