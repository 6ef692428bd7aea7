"""The corpus pipeline: its stages, in order, each reading what the last one wrote.

Toxic documents go; of equal texts the smallest id stays; of each class of
near-duplicates the smallest id stays; documents that leak a benchmark item go;
what is left is packed. All stages but the last return the columns of documents.

Defined results: null and empty texts are documents like others (of all empty ones the
smallest id stays); rows with a null id are scored, deduplicated by text and packed;
repeated rows leave one; extra columns pass through, whatever their names; without labels
nothing is toxic; without benchmark items nothing leaks; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from catalith.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity as toxic
from catalith.llm.common import load, shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half, by a model of the labelled ones among docs."""
    return toxic.drop_toxic(docs, toxic.train(docs, load(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, a similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Workers stay alive between stages, so they remember fewer words than the query's."""
    return packing.pack(docs, packing.tokenizer_path(), remember=300_000)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("jaccard_join", near), ("decontaminate", benchmark), ("packing", pack)]
#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written as Parquet to the shared
    folder and read again as the next one's docs; then its own input goes from there."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    docs = load(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
            for old, _ in STAGES[number - 1 : number]:
                store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number - 1}-{old}"), True)
    return docs
