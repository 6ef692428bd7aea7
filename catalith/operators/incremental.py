"""Upserts, rebuilds and histories over immutable tables: each returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W


def upsert(old: DataFrame, new: DataFrame, key: str, sticky: dict[str, Column] | None = None) -> DataFrame:
    """New rows replace old ones of the same key. `sticky` names columns that keep the old
    value where a condition on the old row (columns prefixed old_) holds."""
    columns = old.columns
    if sticky:
        prior = old.select(F.col(key), *[F.col(c).alias(f"old_{c}") for c in columns if c != key])
        joined = new.join(prior, key, "left")
        new = joined.select(*[F.when(sticky[c], F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) if c in sticky else F.col(c) for c in columns])
    return old.join(new.select(key), key, "left_anti").select(columns).unionByName(new.select(columns))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(old.columns))


def locked_rebuild(old: DataFrame, rebuilt: DataFrame, key: str, locked: str) -> DataFrame:
    """Locked rows stay as they are; all others are replaced by the rebuilt ones."""
    keep = old.where(F.col(locked))
    return keep.unionByName(rebuilt.join(keep.select(key), key, "left_anti").select(old.columns))


def work_list(scanned: DataFrame, manifest: DataFrame, key: str, fast_key: str) -> DataFrame:
    """What an incremental pass has to do with each scanned file: skip, touch or process."""
    known = manifest.select(key, F.col(fast_key).alias("_known"))
    joined = scanned.join(known, key, "left")
    action = F.when(F.col("_known").isNull(), "process").when(F.col("_known") == F.col(fast_key), "skip").otherwise("touch")
    return joined.withColumn("action", action).drop("_known")


def mark_absent(manifest: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    there = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    return manifest.join(there, key, "left").withColumn("absent", F.col("_seen").isNull()).drop("_seen")


def current(ledger: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Entries of an append-only ledger that no other entry supersedes."""
    gone = ledger.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("_gone")).distinct()
    return ledger.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def compacted(ledger: DataFrame, key: str, supersedes: str, protected: Column, old: Column) -> DataFrame:
    """The ledger without superseded entries that are old and not protected."""
    gone = ledger.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("_gone")).distinct().withColumn("_superseded", F.lit(True))
    joined = ledger.join(gone, F.col(key) == F.col("_gone"), "left")
    return joined.where(~(F.coalesce("_superseded", F.lit(False)) & ~protected & old)).drop("_gone", "_superseded")


def trimmed_history(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("_i", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_i") <= most).drop("_i")


def latest(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Last state of each key: journal phases, decisions of a subject, edits not undone."""
    return trimmed_history(rows, group, order, 1)


def quarantined(failures: DataFrame, known: DataFrame, key: str, most: int) -> DataFrame:
    """Attempts of each failed key, this round's included; beyond `most` it is given up."""
    counted = failures.groupBy(key).agg(F.count(F.lit(1)).alias("_new"))
    joined = known.select(key, "attempts").join(counted, key, "full")
    n = F.coalesce("attempts", F.lit(0)) + F.coalesce("_new", F.lit(0))
    return joined.select(key, n.cast("long").alias("attempts"), F.when(n > most, "quarantined").otherwise("retry").alias("state"))


def reclaimed(tasks: DataFrame, state: str, expires: str, now: Column) -> DataFrame:
    """Running tasks whose lease is over are ready again."""
    over = (F.col(state) == "running") & (F.col(expires) < now)
    return tasks.withColumn(state, F.when(over, "ready").otherwise(F.col(state)))


def claim(tasks: DataFrame, state: str, order: list[Column], most: int) -> DataFrame:
    """The next tasks to run; how many is the feature."""
    return tasks.where(F.col(state) == "ready").orderBy(*order).limit(most)


def cascade(tables: dict[str, tuple[DataFrame, str]], erased: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of erased keys."""
    return {name: df.join(erased.select(F.col(key).alias(column)), column, "left_anti") for name, (df, column) in tables.items()}


def merged_fields(base: DataFrame, change: DataFrame, key: str, fields: str, protected: str) -> DataFrame:
    """Field maps merged by path: a change wins unless the base row protects that field."""
    new = change.select(key, F.col(fields).alias("_new"))
    joined = base.join(new, key, "left")
    none = F.create_map().cast("map<string,string>")
    pick = F.map_zip_with(F.col(fields), F.coalesce("_new", none), lambda k, a, b: F.when(F.array_contains(protected, k) | b.isNull(), a).otherwise(b))
    return joined.withColumn(fields, pick).drop("_new")
