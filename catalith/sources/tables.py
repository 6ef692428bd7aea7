"""Table loading with fixed schemas, file manifests, and verified writes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Column types of the driver's tables; nothing is inferred from data.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...], settled_before: str | None = None) -> DataFrame:
    """Manifest of the files below root: path, name, extension, kind, bytes, modified, accepted.
    Unknown extensions are kept as rejected rows; the reader leaves empty files out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if settled_before:
        reader = reader.option("modifiedBefore", settled_before)
    files = reader.load(root).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.select("path", name.alias("name"), ext.alias("extension"), "bytes", "modified", (ext.isin(*extensions) & ~name.startswith(".")).alias("accepted"))


def content_digests(spark: SparkSession, root: str) -> DataFrame:
    """path and SHA-256 of every file's content, for files that fit an executor."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.sha2("content", 256).alias("digest"))


def read_recordings(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Multi-line JSON recordings with a fixed schema; rows that don't fit it keep their text
    in _corrupt_record instead of failing the read."""
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(full.add("_corrupt_record", "string")).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def write_snapshot(df: DataFrame, path: str, version: str) -> None:
    """One atomic overwrite of a Parquet snapshot that knows its version."""
    df.withColumn("snapshot_version", F.lit(version)).write.mode("overwrite").parquet(path)


def read_snapshot(spark: SparkSession, path: str, version: str) -> DataFrame:
    """A snapshot of that version; another version is an error, not a silent mix."""
    df = spark.read.parquet(path)
    wrong = F.raise_error(F.concat(F.lit("snapshot version is "), F.col("snapshot_version"))).cast("boolean")
    return df.where(F.when(F.col("snapshot_version") == version, True).otherwise(wrong)).drop("snapshot_version")


def verified_backup(df: DataFrame, path: str) -> int:
    """Write, read back and compare rows and digest; the number of rows."""
    df.write.mode("overwrite").parquet(path)
    digest = lambda x: x.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*x.columns).cast("decimal(38,0)"))).first()
    before, after = digest(df), digest(df.sparkSession.read.parquet(path))
    if before != after:
        raise OSError(f"backup differs: {before} and {after}")
    return before[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, a temporary one, which
    only a local master can share with its executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="spark-checkpoint-")
