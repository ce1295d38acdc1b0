"""Versioned catalogs: snapshots that change as a whole, and members laid out for slices.

A version of a snapshot is a folder of tables that nobody reads until one manifest file names it. Manifests are only
ever added; the one of the highest version is the snapshot. A run that breaks off between tables leaves the version before
readable, and a batch that a stream replays is found in the manifests and not written again.

Members are sorted by structure and dealt to folders by ranges of (halo_id, pid), photometry and gas by ranges of id. A table of
offsets knows each structure's folders, so that one structure is read without opening those of others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from clumpwise.operators.catalog import code_units
from clumpwise.operators.graph import reliable
from clumpwise.streaming.resume import stream_snapshots

MANIFEST = "snapshot long, version long, batch long, folder string, tables array<string>, box double, units string, header map<string,string>"
#: How places and lengths of a version are held: in box units; versions without it hold physical ones.
UNITS = "v2"
#: Tables that are laid out by structure: the columns that order them, the structure's first.
SLICED = {"members": ("halo_id", "pid"), "photometry": ("id",), "gas": ("id",)}


class CatalogStore:
    """Snapshots' tables (halos, members, photometry, gas, ...) under one folder. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def manifests(self) -> DataFrame:
        """All committed versions."""
        at = f"{self.path}/manifests"
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(at)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{at}/*")

    def snapshots(self) -> DataFrame:
        """The current version of each snapshot."""
        every = F.struct(*[x.split()[0] for x in MANIFEST.split(", ")])
        return self.manifests().groupBy("snapshot").agg(F.max_by(every, "version").alias("m")).select("m.*")

    def current(self, snapshot: int) -> Row:
        """The manifest of a snapshot; an error if there is none."""
        found = self.manifests().where(F.col("snapshot") == snapshot).orderBy(F.desc("version")).first()
        if found is None:
            raise KeyError(f"{self.path} has no snapshot {snapshot}")
        return found

    def write(self, snapshot: int, tables: dict[str, DataFrame], header: dict[str, object] | None = None, box: float | None = None, units: str | None = UNITS, batch: int | None = None, crash_after: str | None = None) -> bool:
        """Write all tables, then the manifest that makes them the snapshot; False if ``batch`` has written this snapshot already.

        ``header`` keeps its values' JSON. ``crash_after`` names a table after which the run stops on purpose.
        """
        past = self.manifests().where(F.col("snapshot") == snapshot).select("version", "batch").collect()  # one a version of this snapshot
        if batch is not None and any(r.batch == batch for r in past):
            return False
        folder = f"versions/{snapshot}-{uuid.uuid4().hex}"
        names = []
        for name, df in tables.items():
            names += self._write(f"{self.path}/{folder}", name, df)
            if name == crash_after:
                raise RuntimeError(f"stopped after {name}")
        row = (snapshot, 1 + max((r.version for r in past), default=0), batch, folder, names, box, units, {k: json.dumps(v) for k, v in (header or {}).items()})
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.json(f"{self.path}/manifests/{snapshot}-{uuid.uuid4().hex}")
        return True

    def _write(self, folder: str, name: str, df: DataFrame) -> list[str]:
        if name not in SLICED:
            df.write.parquet(f"{folder}/{name}")
            return [name]
        order = SLICED[name]
        rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
        rows.write.partitionBy("part").parquet(f"{folder}/{name}")
        # from what was written, as ranges come from a sample
        back = self.spark.read.schema(StructType([*df.schema.fields, StructField("part", IntegerType())])).parquet(f"{folder}/{name}")
        parts = back.groupBy(F.col(order[0]).alias("id")).agg(F.min("part").alias("first"), F.max("part").alias("last"), F.count("*").alias("n"))
        parts.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{folder}/{name}_offsets")
        return [name, f"{name}_offsets"]

    def read(self, snapshot: int, name: str = "halos") -> DataFrame:
        """A table of the current version."""
        m = self.current(snapshot)
        if name not in m.tables:
            raise KeyError(f"snapshot {snapshot} has no table {name}")
        return self.spark.read.parquet(f"{self.path}/{m.folder}/{name}")

    def header(self, snapshot: int) -> dict[str, object]:
        """The header, with ``box`` and ``units_version``."""
        m = self.current(snapshot)
        return {**{k: json.loads(v) for k, v in m.header.items()}, "box": m.box, "units_version": m.units}

    def halos(self, snapshot: int) -> DataFrame:
        """The structures in box units, whatever units the version holds."""
        m = self.current(snapshot)
        legacy = m.units is None
        if legacy and m.box is None:
            raise ValueError(f"snapshot {snapshot} has physical units and no box")
        return code_units(self.spark.read.parquet(f"{self.path}/{m.folder}/halos"), m.box or 1.0, legacy)

    def slice_of(self, snapshot: int, name: str, structure: int) -> DataFrame:
        """One structure's rows of members, photometry or gas; only its own folders are opened."""
        at = self.read(snapshot, f"{name}_offsets").where(F.col("id") == structure).first()
        rows = self.read(snapshot, name)
        if at is None:
            return rows.limit(0).drop("part")
        rows = rows.where(F.col("part").between(at["first"], at["last"]) & (F.col(SLICED[name][0]) == structure))
        return rows.drop("part").orderBy(*SLICED[name])

    def joined(self, snapshot: int) -> DataFrame:
        """Structures in box units with the columns of photometry and gas where the version has them; nulls where a structure has no row."""
        m, out = self.current(snapshot), self.halos(snapshot)
        for name in ("photometry", "gas"):
            if name in m.tables:
                more = self.read(snapshot, name).drop("part")
                twice = [c for c in more.columns if c in out.columns and c != "id"]
                out = out.join(more.select("id", *[F.col(c).alias(f"{c}_{name}" if c in twice else c) for c in more.columns if c != "id"]), "id", "left")
        return out


Tables = tuple[dict[str, DataFrame], dict[str, object], float | None]


def stream_catalogs(spark: SparkSession, jobs: str, schema: str, checkpoint: str, store: CatalogStore, find: Callable[[Row], Tables | None], key: str = "numstep") -> None:
    """Work through job files (JSON, one a batch, each with one row a snapshot) and commit each snapshot's catalog as a whole.

    ``find`` gets a job and returns its tables, header and box, or None for a snapshot without structures. A batch that
    is replayed after a crash writes only the snapshots that it had not committed.
    """

    def each(batch: DataFrame, number: int) -> None:
        for job in reliable(batch).orderBy(key).collect():  # one row a snapshot of a job file
            found = find(job)
            if found is not None:
                tables, header, box = found
                store.write(job[key], tables, header, box, batch=number)

    stream_snapshots(spark, jobs, schema, checkpoint, each)
