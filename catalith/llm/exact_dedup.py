"""Exact deduplication: 128-bit content hash, smallest id stays, bytes compared.

DataFrame operations only. Texts are grouped by (MD5, normalised text): the
hash places a group, the bytes decide membership, so an MD5 collision ends in
two groups. The map-side combine leaves one row of each text and task, which
keeps a group holding a third of all rows from reaching one reducer row by
row. The way back to the single rows joins narrow columns, two digests and an
id. The groups are cut in the shared folder first: the join then deals both of
its sides itself, and AQE can split the partition of a hot group.

Defined results: a null text counts as empty; all empty and all-blank texts
fall into their groups (blank texts normalise to one space); a null doc_id
never stays while its group has any other id; repeated rows are counted as
rows; extra columns of the input are ignored; an empty table gives no rows. Where
whole rows are kept, of rows of one id and one normalised text the one with the
smallest 64-bit hash of all its columns stays (maps as JSON), so the order of the
input does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalith.llm.common import SPACES, cut, load

SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def normalised(text: str | Column) -> Column:
    """Each run of white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACES, " ")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct text: digest128, text_sha256, keep_id, group_size.

    Should two different texts ever agree in MD5 and in SHA-256, the job stops
    with an error rather than merge or multiply their rows."""
    text = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("t"))
    exact = (
        text.groupBy(F.unhex(F.md5("t")).alias("digest128"), "t")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("digest128", F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("different texts share both digests")).cast("long"))
    return exact.groupBy("digest128", "text_sha256").agg(F.coalesce(one, F.min("keep_id")).alias("keep_id"), F.min("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256."""
    text = docs.select(F.col(id_col).alias(id_col), normalised(text_col).alias("t"))
    rows = text.select(id_col, F.unhex(F.md5("t")).alias("digest128"), F.sha2("t", 256).alias("text_sha256"))
    joined = rows.join(cut(groups(docs, id_col, text_col)), ["digest128", "text_sha256"])
    return joined.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns, whatever their names; of rows of one id and one
    normalised text one, see above. The kept ids are found on narrow columns; the texts
    move once, dealt by id, so no hot group moves with its texts."""
    stays = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).distinct()
    keys = {"key": F.coalesce("id", F.xxhash64("sha")), "none": F.col("id").isNull()}
    hashable = [F.to_json(docs[f.name]) if "map<" in f.dataType.simpleString() else docs[f.name] for f in docs.schema]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(*hashable).alias("tie"), F.col(id_col).alias("id"), F.sha2(normalised(text_col), 256).alias("sha"))
    on = ["key", "none", "sha"]
    kept = rows.withColumns(keys).drop("id").join(stays.withColumns(keys).drop("id").hint("shuffle_hash"), on)
    return kept.groupBy(*on).agg(F.min_by("row", "tie").alias("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))
