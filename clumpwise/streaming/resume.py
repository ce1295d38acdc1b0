"""Resumable work: per-root output with a commit log, and snapshots as a file stream."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

LOG = "root_id long, rows long, cells_read long, envelope double, seconds double"
VERSION = 3


class RootSink:
    """Rows by root with a completion log; the log's record is the commit.

    A root's rows go to a folder of their own, overwritten whole, before its
    record is written. Rows without a record are not part of the result, so a run that
    broke off between the two is simply repeated.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def log(self) -> DataFrame:
        at = f"{self.path}/log"
        found = self.spark.read.schema(LOG).json(f"{at}/*") if self._exists(at) else self.spark.createDataFrame([], LOG)
        return found.dropDuplicates(["root_id"])

    def check(self) -> None:
        """An error if the folder holds another version or other columns."""
        at = f"{self.path}/header"
        want = (VERSION, self.schema.simpleString())
        if self._exists(at):
            have = self.spark.read.json(at).select("version", "columns").first()
            if (have[0], have[1]) != want:
                raise ValueError(f"{self.path} holds {have[0]}, {have[1]}; not {want[0]}, {want[1]}")
        else:
            self.spark.createDataFrame([want], "version long, columns string").coalesce(1).write.json(at)

    def clear(self) -> None:
        """Begin anew: without rows, records and header."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def done(self) -> set[int]:
        """Completed roots (as many as the log's records)."""
        return {r[0] for r in self.log().select("root_id").collect()}

    def write(self, root: int, rows: DataFrame, cells_read: int = 0, crash: bool = False) -> bool:
        """Write a root's rows, then its record; False if it has one already."""
        if self._exists(f"{self.path}/log/root={root}"):
            return False
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/root_id={root}")
        if crash:
            raise RuntimeError(f"stopped after the rows of root {root}")
        n = self.spark.read.parquet(f"{self.path}/rows/root_id={root}").count()
        record = self.spark.createDataFrame([(root, n, cells_read, None, None)], LOG)
        record.coalesce(1).write.mode("overwrite").json(f"{self.path}/log/root={root}")
        return True

    def write_batch(self, rows: DataFrame, metrics: DataFrame, started: float | None = None, crash: str | None = None) -> None:
        """Write the rows of many roots (``root_id`` and the sink's columns), then one file of their records (of ``metrics``: root_id, cells_read, envelope).

        Each root's folder is overwritten whole and no other is touched. The one log file is the commit of all: until it is there none of the
        roots counts as done, and another run overwrites what this one left. A root's seconds are its share of the batch's by rows.
        """
        if crash == "before":
            raise RuntimeError("stopped before the rows")
        at = f"{self.path}/rows"
        rows.repartition("root_id").write.partitionBy("root_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(at)
        if crash == "rows":
            raise RuntimeError("stopped after the rows")
        have = self.spark.read.parquet(at).withColumn("root_id", F.col("root_id").cast("long"))
        have = have.join(metrics.select("root_id"), "root_id", "left_semi").groupBy("root_id").agg(F.count("*").alias("rows"))
        took = 0.0 if started is None else time.time() - started
        share = F.col("rows") / F.sum("rows").over(Window.partitionBy())  # one row a root of the batch
        record = metrics.join(have, "root_id", "left").na.fill(0, ["rows"]).withColumn("seconds", F.when(F.col("rows") > 0, share * took).otherwise(0.0))
        record.select(*[x.split()[0] for x in LOG.split(", ")]).coalesce(1).write.json(f"{self.path}/log/batch={uuid.uuid4().hex}")

    def rows(self) -> DataFrame:
        """The committed rows, with root_id."""
        if not self._exists(f"{self.path}/rows"):
            return self.spark.createDataFrame([], self.schema).withColumn("root_id", F.lit(None).cast("long"))
        found = self.spark.read.parquet(f"{self.path}/rows").withColumn("root_id", F.col("root_id").cast("long"))
        return found.join(self.log().select("root_id"), "root_id", "left_semi")

    def totals(self) -> DataFrame:
        return self.log().agg(F.count("*").alias("n_roots"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("cells_read"), F.lit(0)).alias("cells_read"))


def process_roots(sink: RootSink, roots: Iterable[int], one: Callable[[int], DataFrame], most: int | None = None, crash_at: int | None = None) -> dict[str, list[int]]:
    """Work through the roots that have no record; stop after ``most`` of them."""
    sink.check()
    roots = [int(r) for r in roots]
    done = sink.done()
    now: list[int] = []
    for root in roots:
        if root in done:
            continue
        if most is not None and len(now) >= most:
            break
        sink.write(root, one(root), crash=root == crash_at)
        now.append(root)
    left = [r for r in roots if r not in done and r not in now]
    return {"processed": now, "skipped": [r for r in roots if r in done], "remaining": left}


def process_batches(
    sink: RootSink, roots: Iterable[int], many: Callable[[DataFrame], tuple[DataFrame, DataFrame]], size: int = 500, most: int | None = None, crash: tuple[int, str] | None = None
) -> dict[str, list[int]]:
    """Work through the roots that have no record, ``size`` of them in one plan and one commit; stop after ``most`` of them.

    ``many`` gets a table of root_id and returns the rows of these roots and their metrics (see ``RootSink.write_batch``). ``crash``
    (batch, where) stops a run on purpose. The driver holds one number a root.
    """
    sink.check()
    roots = list(dict.fromkeys(int(r) for r in roots))
    done = sink.done()
    todo = [r for r in roots if r not in done]
    now = todo if most is None else todo[:most]
    for k in range(0, len(now), size):
        started = time.time()
        part = sink.spark.createDataFrame([(r,) for r in now[k : k + size]], "root_id long")
        rows, metrics = many(part)
        sink.write_batch(rows, metrics, started, crash[1] if crash and crash[0] == k // size else None)
    return {"processed": now, "skipped": [r for r in roots if r in done], "remaining": todo[len(now) :]}


def stream_snapshots(spark: SparkSession, manifests: str, schema: str, checkpoint: str, one: Callable[[DataFrame, int], None]) -> None:
    """Work through snapshot manifests (JSON files) in order, one a batch, each exactly once across restarts.

    ``one`` gets a batch and its number; empty batches are skipped.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            one(batch, number)

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(manifests)
    query = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
