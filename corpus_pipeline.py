"""A corpus pipeline of five stages, counted as part of the ``llm`` subpackage.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and works
on all that its predecessor kept. ``run`` writes each stage's rows as Parquet in
the shared folder and reads them again, which cuts lineage and lets a lost
executor be replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clumpwise.llm.jaccard_join import grouped
from clumpwise.llm.phrase_index import find_leaks
from clumpwise.llm.secret_scan import redacted
from clumpwise.llm.site_bayes import site_quality
from clumpwise.llm.textops import checkpoint_dir, cut, drop_folder, drop_stored, stored_places
from clumpwise.llm.trie_pieces import coded

#: The model of the last stage, by its public name.
PIECES = "piece_bpe_32k.model"


#: A row's key: two hashes of all its columns, so that only rows that are equal in all columns share one.
KEY = ("_row_a", "_row_b")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``KEY``; nulls count by column."""
    cells = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]
    return docs.withColumns({KEY[0]: F.xxhash64(*cells), KEY[1]: F.xxhash64(F.lit(17), *cells[::-1])})


#: Tables that the last stage stored for itself.
_HELD: list[str] = []


def dropped(spark: SparkSession) -> None:
    """Delete what the last stage stored; its rows must have been written."""
    drop_stored(spark, _HELD)
    _HELD.clear()


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage, which begins by deleting what the one before stored: stages follow each other with their rows written between."""

    @wraps(fn)
    def one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        dropped(spark)
        before = set(stored_places())
        out = fn(spark, docs, sf_dir)
        _HELD.extend(p for p in stored_places() if p not in before)
        return out

    return one


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; sites are sources, paths are their languages."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = tuple(docs.columns)
    found = site_quality(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"), keep=columns)
    return found.where("kept").select(*columns)


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id (then of the smallest key; ids before nulls).

    Rows are told apart by all their columns: documents that share a doc_id but no
    group stay, as does each document without words; of rows equal in all columns one stays.
    """
    rows = keyed(docs)
    found = cut(grouped(rows, ("doc_id", *KEY)))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("m")
    chosen = found.where("grp is not null").groupBy("grp").agg(first).select(*[f"m.{c}" for c in KEY])
    chosen = chosen.union(found.where("grp is null").select(*KEY).distinct())
    return rows.join(cut(chosen), list(KEY), "left_semi").dropDuplicates(list(KEY)).select(*docs.columns)


@stage
def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; a document that shares its doc_id with one that leaks stays."""
    rows = keyed(docs)
    found = find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=KEY)
    gone = cut(found.where("n_hit > 0").select(*KEY).distinct())
    return rows.join(gone, list(KEY), "left_anti").select(*docs.columns)


@stage
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return redacted(docs)


@stage
def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, exact) of all documents: their pieces, and whether these give the text back."""
    import public_tokenizers

    rows = coded(docs, public_tokenizers.path(PIECES))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "exact")


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", without_leaks),
    ("secret_scans", without_secrets),
    ("sentencepiece", in_pieces),
]

#: SQL can't express the learned classifier nor the pieces; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are removed when the next one's are written."""
    place = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, fn) in enumerate(STAGES):
        now = f"{place}/{k}-{name}"
        fn(spark, docs, sf_dir).write.parquet(now)
        docs = spark.read.parquet(now)
        dropped(spark)
        if before:
            drop_folder(spark, before)
        before = now
    return docs
