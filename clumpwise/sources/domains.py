"""Snapshots of domain files as a data source whose partitions are pruned by what a read asks for.

``spark.read.format("domain_particles")`` has a partition for each domain file. Boxes that the read is given, and
comparisons of x, y and z that Spark pushes down, leave out domains whose extent they do not meet, before any file is opened.
Files lie in a folder that all executors see.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from clumpwise.operators.scaling import in_boxes
from clumpwise.sources import snapshot as S

AXES = "xyz"


@dataclass
class DomainFile(InputPartition):
    """A domain's file."""

    domain: int
    path: str


class DomainReader(DataSourceReader):
    """Reads the domain files that the boxes and the pushed comparisons leave."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.family = options["path"], options.get("family", "all")
        self.tagged = options.get("tagged", "true").lower() == "true"
        self.layout = S.read_layout(options["descriptor"]) if options.get("descriptor") else S.Layout()
        self.boxes = json.loads(options.get("boxes", "null"))
        self.extents = _extents(options["extents"]) if options.get("extents") else {}
        self.low, self.high = [float("-inf")] * 3, [float("inf")] * 3

    def _meets(self, domain: int) -> bool:
        if domain not in self.extents:
            return True
        low, high = self.extents[domain]
        meet = lambda a, b: all(low[k] <= b[k] and a[k] <= high[k] for k in range(3))
        return meet(self.low, self.high) and (self.boxes is None or any(meet(b[0], b[1]) for b in self.boxes))

    def partitions(self) -> Sequence[DomainFile]:
        found = []
        for name in sorted(os.listdir(self.folder)):
            number = re.search(r"part_\d+\.out(\d+)$", name)
            if number and self._meets(int(number[1])):
                found.append(DomainFile(int(number[1]), os.path.join(self.folder, name)))
        return found

    def read(self, partition: DomainFile) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            rows = S.parse_particles(f.read(), partition.domain, self.tagged, self.layout, self.family)
        yield from pa.Table.from_pandas(rows, preserve_index=False).cast(_arrow(self.layout.schema)).to_batches(max_chunksize=65_536)


class PushedReader(DomainReader):
    """A reader for sessions with ``spark.sql.python.filterPushdown.enabled``, without which Spark allows no ``pushFilters``."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            at = AXES.find(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute[0]) == 1 else -1
            if at >= 0 and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low[at] = max(self.low[at], f.value)
            if at >= 0 and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.high[at] = min(self.high[at], f.value)
            yield f  # whole files are read, so Spark compares the rows


class DomainParticles(DataSource):
    """Options: path (folder), family, tagged, descriptor (file), extents (JSON lines of domain, lo and hi), boxes (JSON of [lo, hi] pairs), pushdown."""

    @classmethod
    def name(cls) -> str:
        return "domain_particles"

    def schema(self) -> str:
        return (S.read_layout(self.options["descriptor"]) if self.options.get("descriptor") else S.Layout()).schema

    def reader(self, schema: object) -> DomainReader:
        kind = PushedReader if self.options.get("pushdown", "false").lower() == "true" else DomainReader
        return kind(dict(self.options))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


def _extents(path: str) -> dict[int, tuple[list[float], list[float]]]:
    with open(path) as f:
        rows = [json.loads(line) for line in f if line.strip()]
    return {r["domain"]: (r["lo"], r["hi"]) for r in rows}


def write_extents(particles: DataFrame, path: str) -> None:
    """The least and largest place of each domain as JSON lines: one line a domain file."""
    ends = [f(a).alias(f"{n}_{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES]
    rows = particles.groupBy("domain").agg(*ends).orderBy("domain").collect()
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps({"domain": r.domain, "lo": [r[f"lo_{a}"] for a in AXES], "hi": [r[f"hi_{a}"] for a in AXES]}) + "\n")


def read_domains(spark: SparkSession, folder: str, boxes: DataFrame | None = None, extents: str | None = None, tagged: bool = True, family: str = "all", descriptor: str | None = None) -> DataFrame:
    """Particles of a folder of domain files; with ``boxes`` (few rows of lo_x, hi_x, ...), those inside, from the domains that they meet."""
    spark.dataSource.register(DomainParticles)
    read = spark.read.format("domain_particles").option("family", family).option("tagged", str(tagged).lower())
    read = read.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, value in (("extents", extents), ("descriptor", descriptor)):
        if value:
            read = read.option(name, value)
    if boxes is None:
        return read.load(folder)
    few = [([r[f"lo_{a}"] for a in AXES], [r[f"hi_{a}"] for a in AXES]) for r in boxes.collect()]
    rows = read.option("boxes", json.dumps(few)).load(folder)
    return in_boxes(rows, boxes, rows.columns)
