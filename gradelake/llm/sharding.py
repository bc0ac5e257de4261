"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _shuffled(seed: str, id_col: str, crc: str) -> Column:
    """A seeded pseudo-random order of rows, the same in any engine that has md5."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), F.col(crc).cast("string")))


def _phase(seed: str, source: Column) -> Column:
    """A seeded pseudo-random number between 0 and 1 for each source."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), source)), 1, 8), 16, 10).cast("double")
    return (drawn + F.lit(0.5)) / F.lit(float(1 << 32))


def shards(
    docs: DataFrame, n_shards: int = 16, seed: str = "shard-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_per_part: int = 100_000
) -> DataFrame:
    """Per row: id, size, text_crc32, law = 'rows', shard, slot, grown_shard (null: under this law one more shard moves rows everywhere).

    Rows are put in a seeded random order within their source; the row of rank r of n has the fractional rank (r + p) / n, p a seeded random number between
    0 and 1 for each source, so that sources of one row or a few lie all over the line, not all at its middle. All rows are sorted by
    fractional rank (ties: source, then the random order) and cut into n_shards runs whose row counts differ by one at most, so each shard has
    nearly every source's share of the whole. Very long texts are measured whole. size is the text's UTF-8 bytes plus 1. A null text counts as empty; a null source is a source of its own;
    null and repeated ids are ordered like others (equal rows may swap places). Equal texts get no special place. An empty table gives no rows. Further columns,
    whatever their names, are not looked at.
    Neither a large source nor the whole table is ever sorted in one task: ranks are taken within parts of about rows_per_part rows (by the leading
    bits of the random order; by ranges of the fractional rank) and shifted by the sizes of the parts before.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col(source_col).cast("string").alias("__source")
    ).withColumn("__order", _shuffled(seed, id_col, "text_crc32"))
    total = docs.count()
    parts = 1 << max(6, min(16, (max(1, total // rows_per_part) - 1).bit_length()))  # at most 65,536: what is broadcast below
    source = F.coalesce(F.concat(F.lit("="), F.col("__source")), F.lit("-"))
    rows = rows.withColumn("__key", F.xxhash64(source)).withColumn("__phase", _phase(seed, source)).withColumn("__part", F.shiftright(F.conv(F.substring("__order", 1, 4), 16, 10).cast("int") * parts, 16))

    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__key", "__part").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(
        F.col("__key").alias("k"), F.col("__part").alias("p"), F.coalesce(F.sum("n").over(before("__key").orderBy("__part")), F.lit(0)).alias("shift"),
        F.sum("n").over(Window.partitionBy("__key")).alias("of"),
    )
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("__key", "__part").orderBy("__order", id_col)))
    ranked = ranked.join(sizes, (F.col("__key") == F.col("k")) & (F.col("__part") == F.col("p")))
    rank = F.col("r") - 1 + F.col("shift")
    placed = ranked.withColumn("__at", (rank + F.col("__phase")) / F.col("of")).withColumn("__range", F.least(F.floor(F.col("__at") * parts), F.lit(parts - 1)).cast("int"))

    ranges = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    ranges = F.broadcast(ranges.select(F.col("__range").alias("g"), F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first")))
    order = Window.partitionBy("__range").orderBy("__at", "__source", "__order", id_col)
    at = placed.withColumn("__in", F.row_number().over(order) - 1).join(ranges, F.col("__range") == F.col("g")).withColumn("pos", F.col("__in") + F.col("first"))
    low, extra = divmod(total, n_shards)  # the first `extra` shards hold one row more
    wide = F.lit(extra * (low + 1))
    shard = F.when(F.col("pos") < wide, F.floor(F.col("pos") / (low + 1))).otherwise(extra + F.floor((F.col("pos") - wide) / max(1, low)))
    slot = F.when(F.col("pos") < wide, F.col("pos") % (low + 1)).otherwise((F.col("pos") - wide) % max(1, low))
    return at.select(
        F.col(id_col), "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
