"""What several operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Only a local session may go without the setting: there one machine does all the work, and the folder lies in the warehouse.
    """
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{os.path.abspath(spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:'))}/cut-{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Makes Spark delete the shuffle files of a finished query at once, not when its driver next collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: its lineage ends there, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")  # each table is computed once, so nothing reads its shuffles again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() has written, once all that is made from them has been written, too."""
    for t in tables:
        remove(t.sparkSession, _written.pop(t))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it is, as Hadoop's file systems do."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_key(text: Column) -> Column:
    """32 bytes that stand for a whole text; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b) of any orderable type: rows (node, root), root the least node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is one aggregation and one equi join, so
    no node's neighbours are ever gathered in one task, and the number of rounds is logarithmic in practice.
    Nulls and loops are dropped; nodes without an edge do not appear. No edges give no rows.
    """
    e = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large-star")
        drop(e, low)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "least")
        small = (
            large.join(low, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        e = cut(small, "small-star")
        drop(large, low)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
