"""Filter interaction audit: every order of five filters replayed over all documents.

Documents' flags (which filters a document fails) are crossed with the 120 orders, a literal
table that is broadcast; each order is exploded into its five steps, the first step whose
filter the document fails is its removal, and conditional sums with map-side combining
count kept, removed and redundant documents for each part, order and step.

Flags are taken where the text is read; from there on only digests travel. Labels meet
documents by id. Rows of one text, part and labels become one row with a multiplicity
before they are grouped by text, so that a text that a third of all rows share is a few rows
by then: the filter of repeated texts needs no join, and no reducer meets the copies.

Defined results: a null text is empty; a null part is the empty string; a row fails the
filter of repeated texts if some row of the whole table with a smaller id has its text, so
repeated rows of the smallest id stay, and a null id counts as larger than all others;
labels of an id count as 1 if any of its rows says so; documents without labels have none;
extra columns are ignored; an empty table gives no rows. Equal texts are those of equal
SHA-256.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from catalith.llm.common import cut, load

FILTERS = "ABCDE"
WORD_GAP = r"[\x20\x09-\x0D]+"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL)] AS fails FROM w
), l AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT f.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)
), one AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS names FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), p AS (
  SELECT list_aggregate(names, 'string_agg', '') AS filter_order, list_transform(names, lambda x: ascii(x) - 64) AS places FROM o
), r AS (
  SELECT *, coalesce(list_position(list_transform(places, lambda x: fails[x]), true), 6) AS gone FROM d, p
), s AS (
  SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM r
), c AS (
  SELECT part, filter_order, step::INTEGER AS step, count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
    count(*) FILTER (gone < step AND fails[places[step]]) AS redundant,
    count(*) FILTER (fails[places[step]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    count(*) FILTER (gone = step AND good) AS good_lost, count(*) FILTER (gone = step AND toxic) AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT *, sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM c
"""


def flags(text: Column) -> dict[str, Column]:
    """Failure conditions of A to D over a text."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]++", "")).cast("long")
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def weighted(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, fails (five bits, A the lowest), good, toxic, n: rows of one text, part and labels
    are one row of multiplicity n; those that keep the text's smallest id are apart."""
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(flags(F.col("t")).values())), F.lit(0))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), bits.alias("fails"))
    rows = rows.groupBy("id", "part", "digest", "fails").agg(F.count(F.lit(1)).alias("n"))
    # Null ids have no labels; a key of their own keeps them from being one partition of the join.
    key = {"key": F.coalesce("id", F.xxhash64("digest")), "none": F.col("id").isNull()}
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = rows.withColumns(key).join(marks.withColumn("none", F.lit(False)), ["key", "none"], "left").fillna(False, ["good", "toxic"])
    last = F.col("none").cast("int")  # a null id is larger than all others
    grouped = known.groupBy("digest", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct(last.alias("last"), "id", "n")).alias("first"))
    # The rows of a text are at most one for each part and labels.
    smallest = F.min(F.struct("first.last", "first.id")).over(W.partitionBy("digest"))
    own = F.when(F.struct("first.last", "first.id") == smallest, F.when(F.col("first.last") == 1, F.col("n")).otherwise(F.col("first.n"))).otherwise(0)
    split = grouped.withColumn("own", own.cast("long"))
    each = F.explode(F.array(F.struct("fails", F.col("own").alias("n")), F.struct(F.col("fails").bitwiseOR(F.lit(16)).alias("fails"), (F.col("n") - F.col("own")).alias("n"))))
    return split.select("part", "good", "toxic", each.alias("x")).select("part", "good", "toxic", "x.fails", "x.n").where("n > 0")


def replayed(rows: DataFrame) -> DataFrame:
    """part, filter_order, step and its counts, over rows of part, fails, good, toxic, n."""
    spark = rows.sparkSession
    orders = spark.createDataFrame([(o, [1 << FILTERS.index(x) for x in o]) for o in ORDERS], "filter_order string, bits array<int>").coalesce(1)
    crossed = rows.crossJoin(F.broadcast(orders))  # 120 literal rows
    fails, bit = F.col("fails"), lambda i: F.get("bits", F.lit(i))
    gone = F.coalesce(*[F.when(fails.bitwiseAND(bit(i)) != 0, i + 1) for i in range(5)], F.lit(6))
    steps = crossed.select("part", "filter_order", "good", "toxic", "n", "fails", gone.alias("gone"), F.posexplode("bits").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    step, this = F.col("step"), fails.bitwiseAND(F.col("bit")) != 0
    total = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0).cast("long"))).alias(name)
    here = F.col("gone") == step
    counts = steps.groupBy("part", "filter_order", "step").agg(
        total(F.col("gone") > step, "kept"), total(here, "removed"), total((F.col("gone") < step) & this, "redundant"), total(this & (fails == F.col("bit")), "unique_fails"),
        total(here & F.col("good"), "good_lost"), total(here & F.col("toxic"), "toxic_lost"))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return counts.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", letter)))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order and step: see replayed."""
    return replayed(cut(weighted(docs, labels, part)))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
