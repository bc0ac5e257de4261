"""The folder that driver and executors share, and streams that write there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; only a local session may go without."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-cut-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def drain(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over all there is now and return its table: appended rows, or with keys the last update of each.

    Every micro-batch writes a folder of its own, overwritten when the batch is tried again, so a restart repeats nothing.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{base}/out").drop("batch")
    if not keys or _of_one_batch(out):  # a batch has one row a key
        return out.drop("__batch")
    rest = [c for c in out.columns if c not in (*keys, "__batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("r")).select(*keys, "r.*")


def _of_one_batch(out: DataFrame) -> bool:
    first, last = out.agg(F.min("__batch"), F.max("__batch")).first()
    return first == last


#: A table of under so many bytes for each core may lie in fewer parts than there are cores.
SMALL_SHARE = 32 << 20


def dealt_out(rows: DataFrame, path: str) -> DataFrame:
    """rows of a small table, dealt over all cores: a file of one row group is read by one task, whatever comes after it. A
    table of more than SMALL_SHARE bytes a core has parts enough and is not shuffled."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return rows.repartition(cores) if size < SMALL_SHARE * cores else rows
