"""Queries over indexes that are built, kept and searched."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalith.operators import graph_index
from catalith.operators.similarity import cut
from catalith.plans.registry import query
from catalith.sources.tables import shared_folder


@query("graph_knn")
def graph_knn(t):
    """Every fiftieth vector against a graph of all: built of nine tenths of the rows, the rest
    inserted. Approximate, so there is no SQL; recall against knn_topk is tested."""
    base = t("embeddings")
    spark = base.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/graph-{uuid.uuid4().hex}"
    graph_index.build(base.where("vec_id % 10 <> 3"), "vec_id", "embedding", path)
    graph_index.insert(base, "vec_id", "embedding", path)
    found = cut(graph_index.search(spark, path, base.where("vec_id % 50 = 0"), "vec_id", "embedding", 10).select("vec_id", "neighbour", F.round("distance", 5).alias("distance")))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return found
