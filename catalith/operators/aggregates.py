"""Coverage, census and roll-up aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from catalith.functions.columns import has_bits, upper_element


def count_where(condition: Column) -> Column:
    """How many rows hold; null counts as no; 0 for no rows."""
    return F.count(F.when(condition, 1))


def pre_aggregated(parent: DataFrame, key: str, child: DataFrame, child_key: str, aggregates: list[Column], fill: dict | None = None) -> DataFrame:
    """Parent with aggregates of its children. The child is reduced to one row for each key
    before the join, so parent rows do not fan out and only reduced rows are shuffled twice."""
    reduced = child.groupBy(F.col(child_key).alias(key)).agg(*aggregates)
    joined = parent.join(reduced, key, "left")
    return joined.fillna(fill) if fill else joined


def bit_counts(rows: DataFrame, keys: list[str], flags: str, names: dict[str, int]) -> DataFrame:
    """For each group, how many rows have each named bit, in one pass."""
    return rows.groupBy(*keys).agg(*[count_where(has_bits(flags, 1 << bit)).alias(name) for name, bit in names.items()])


def census(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows for each combination of keys, null keys included."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def ordered_element(rows: DataFrame, keys: list[str], value: str, numerator: int, denominator: int, name: str) -> DataFrame:
    """Element floor(n * numerator / denominator) of each group's sorted values, by position
    in a window: no group is gathered into one array."""
    by = W.partitionBy(*keys)
    known = rows.where(F.col(value).isNotNull())
    at = known.select(*keys, value, F.row_number().over(by.orderBy(value)).alias("_i"), F.count(F.lit(1)).over(by).alias("_n"))
    return at.where(F.col("_i") == F.least(F.floor(F.col("_n") * numerator / denominator) + 1, F.col("_n"))).select(*keys, F.col(value).alias(name))


def small_ordered_element(rows: DataFrame, keys: list[str], value: str, numerator: int, denominator: int, name: str) -> DataFrame:
    """The same for groups that are known to be small."""
    return rows.groupBy(*keys).agg(upper_element(F.collect_list(value), numerator, denominator).alias(name))


def dominant(rows: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Most frequent value of each group, its rows and share; ties: the smaller value."""
    n = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *([F.avg(weight).alias("support")] if weight else []))
    by = W.partitionBy(*keys)
    ranked = n.withColumns({"share": F.col("n") / F.sum("n").over(by), "_i": F.row_number().over(by.orderBy(F.desc("n"), F.asc(value)))})
    return ranked.where("_i = 1").drop("_i")


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))


def counts_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """For each key a JSON object of its values' counts, values in order."""
    n = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(value).alias("key"), F.col("n").alias("value"))))
    return n.groupBy(key).agg(F.to_json(F.map_from_entries(pairs)).alias("counts"))


def ordered_digest(rows: DataFrame, keys: list[str], order: str, line: Column, span: int = 4096) -> DataFrame:
    """keys, digest and rows: a SHA-256 over each group's lines in the order of a whole number.
    Lines are digested by spans of that number, and a group's digest is that of its spans', so
    a task gathers the lines of one span or one digest for each span of a group."""
    part = F.floor(F.col(order) / span)
    joined = lambda a: F.sha2(F.array_join(F.transform(F.array_sort(a), lambda s: s["line"]), "\n"), 256)
    spans = rows.select(*keys, order, part.alias("_part"), line.alias("line")).groupBy(*keys, "_part").agg(joined(F.collect_list(F.struct(order, "line"))).alias("line"), F.count(F.lit(1)).alias("_n"))
    return spans.groupBy(*keys).agg(joined(F.collect_list(F.struct("_part", "line"))).alias("digest"), F.sum("_n").alias("rows"))


def vector_mean(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Component means of each group's vectors, in order."""
    parts = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
