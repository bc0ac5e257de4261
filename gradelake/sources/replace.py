"""A table in plain folders that micro-batches write to, one row a key: the row of its last batch."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ReplaceByKey:
    """Under base, a folder for each batch, and merged ones.

    Writing a batch overwrites its own folder alone, so that a batch tried or delivered again changes nothing else. When
    `merge_at` batch folders have come together, all that there is up to the newest of them is merged into one folder, and
    then the parts are deleted: reading takes the newest merged folder and the batches after it, whenever a writer stops.
    One stream writes to a table at a time; batch numbers grow.
    """

    def __init__(self, spark: SparkSession, base: str, keys: tuple[str, ...], merge_at: int = 20) -> None:
        self.spark, self.base, self.keys, self.merge_at = spark, base.rstrip("/"), keys, merge_at

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Rows of a batch; of rows of one key within it any one, so keys should be distinct there."""
        rows.write.mode("overwrite").parquet(f"{self.base}/batch={batch_id}")
        merged, batches = self._parts()
        if len(batches) >= self.merge_at:
            newest = max(batches)
            self.read().write.mode("overwrite").parquet(f"{self.base}/merged={newest}")
            for old in batches:
                self._delete(f"batch={old}")
            if merged is not None and merged != newest:
                self._delete(f"merged={merged}")

    def read(self) -> DataFrame:
        """One row for each key. A table that nothing was written to can't be read."""
        merged, batches = self._parts()
        parts = [(-1, f"merged={merged}")] if merged is not None else []
        parts += [(b, f"batch={b}") for b in batches]
        if not parts:
            raise FileNotFoundError(f"nothing was written to {self.base}")
        rows = None
        for number, folder in parts:
            part = self.spark.read.parquet(f"{self.base}/{folder}").withColumn("__batch", F.lit(number))
            rows = part if rows is None else rows.unionByName(part)
        rest = [c for c in rows.columns if c not in (*self.keys, "__batch")]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__row"))
        return last.select(*self.keys, "__row.*")

    def _parts(self) -> tuple[int | None, list[int]]:
        """The newest merged folder that is whole, and the batches after it that are, by number."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return None, []
        merged, batches = None, []
        for s in files.listStatus(path):
            m = re.fullmatch(r"(batch|merged)=(\d+)", s.getPath().getName())
            if m and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                if m[1] == "batch":
                    batches.append(int(m[2]))
                else:
                    merged = int(m[2]) if merged is None else max(merged, int(m[2]))
        return merged, sorted(b for b in batches if merged is None or b > merged)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{folder}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
