"""What the corpus operators share: ids, folds, loading and lineage cuts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: White space of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One driver table, read by Spark alone so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id written as text, modulo 5 (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the cluster's shared checkpoint folder, so that a lost
    executor costs a reread and not a recomputation of the whole lineage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, a temporary one, which
    only a local master can share with its executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="spark-checkpoint-")


def bounded(rows: DataFrame, most: int, most_bytes: int, *ties: str) -> DataFrame:
    """The first `most` distinct rows by a hash of all columns, as far as their texts together
    stay within most_bytes (the first one stays in any case). For samples that have been
    thinned to a size near `most` before."""
    order = [F.xxhash64(*rows.columns), *ties]
    first = rows.distinct().orderBy(*order).limit(most)
    before = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.octet_length("text")
    return first.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") == 0) | (F.col("_before") + F.octet_length("text") <= most_bytes)).drop("_before")


def id_range(df: DataFrame, name: str, per_share: int) -> int:
    """How many shares of about per_share bytes the text column `name` makes."""
    total = df.agg(F.sum(F.octet_length(name).cast("long"))).first()[0] or 0
    return max(1, -(-int(total) // per_share))
