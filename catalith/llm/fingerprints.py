"""Document fingerprints by winnowing, in DataFrame functions only.

Words are hashed (CRC-32), runs of GRAM words by a polynomial that is rolled together from
shorter runs. Of every WINDOW consecutive hashes the least is kept, the rightmost of equal
ones, with its position in words: any passage of GRAM + WINDOW - 1 = REACH words that two
texts share puts the same hash into both fingerprints, at the places where the passage
stands. A run of more than LONG characters without a space counts character by character
up to its last LONG ones, so that scripts without spaces have positions too.

The next document's text comes beside a document by one shuffle: rows are dealt into ranges
of the order by approximate quantiles of the id, the first row of each range goes also to the
range before it (that of the first range to the last one), and a window within a range does
the rest. Ids that hold more than a range's share, and null ids, are split further by the
hash of their texts.

Defined results: a null text is empty; an empty or blank text has an empty fingerprint; a
text of fewer than GRAM words has the hash of all of them at place 0; one of fewer than
WINDOW hashes keeps its least one; likeness is shared over all distinct hashes, 1 for two
empty fingerprints and 0 if one is empty. Documents are ordered by descending id, null ids
last, those of one id by the hash of their text and then the text; repeated rows follow each
other; a single row follows itself. Extra columns are ignored; an empty table gives no rows.
Memory for a text is some thirty times its size.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from catalith.llm.common import load

GRAM, WINDOW, LONG = 4, 6, 16
REACH = GRAM + WINDOW - 1
TOKEN = rf"[^\x20\x09-\x0D]{{1,{LONG}}}(?=[\x20\x09-\x0D]|\z)|[^\x20\x09-\x0D]"
PRIME, BASE = (1 << 31) - 1, 1_000_003
#: A hash and its place travel as one number: the place times PLACE plus the hash.
PLACE = 1 << 31
#: While windows are gone through the hash leads and later places are smaller, so that the
#: least number is the least hash, the rightmost of equal ones.
LAST = PLACE - 1


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _doubled(hashes: Column, size: int) -> Column:
    """Hashes of runs of 2 * size words from those of runs of size words."""
    shift = F.lit(pow(BASE, size, PRIME))
    second = lambda hs, i: F.get(hs, i + F.lit(size))
    return let(hashes, lambda hs: F.transform(F.slice(hs, F.lit(1), F.size(hs) - F.lit(size)), lambda h, i: (h * shift + second(hs, i)) % F.lit(PRIME)))


def _rolled(words: Column) -> Column:
    """Hashes of every run of GRAM (4) words with their places."""
    single = F.transform(words, lambda w: F.crc32(w) % F.lit(PRIME))
    return F.transform(_doubled(_doubled(single, 1), 2), lambda h, i: h * F.lit(PLACE) + (F.lit(LAST) - i))


def _winnowed(hashes: Column) -> Column:
    """The least number of each window of WINDOW, each once."""
    of = lambda hs, at: F.least(*[F.get(hs, at + F.lit(j)) for j in range(WINDOW)])
    mins = lambda hs: F.transform(F.slice(hs, F.lit(1), F.size(hs) - F.lit(WINDOW - 1)), lambda _, at: of(hs, at))
    return let(hashes, lambda hs: F.array_distinct(mins(hs)))


def picks(text: str | Column) -> Column:
    """Ascending numbers place * PLACE + hash: what winnowing keeps of a text."""
    text = F.col(text) if isinstance(text, str) else text
    whole = lambda words: F.array(F.crc32(F.array_join(words, " ")) % F.lit(PRIME) * F.lit(PLACE) + F.lit(LAST))
    kept = lambda hs: F.when(F.size(hs) >= WINDOW, _winnowed(hs)).otherwise(F.array(F.array_min(hs)))
    found = lambda words: F.when(F.size(words) >= GRAM, let(_rolled(words), kept)).when(F.size(words) > 0, whole(words)).otherwise(F.array().cast("array<bigint>"))
    of_text = let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), found)
    return F.transform(of_text, lambda x: (F.lit(LAST) - x % F.lit(PLACE)) * F.lit(PLACE) + F.shiftright(x, 31))


def written(kept: str | Column) -> Column:
    """hash:place of each, hash as 8 hexadecimal digits, comma-joined in order of place."""
    one = lambda x: F.concat(F.lower(F.lpad(F.hex(x % F.lit(PLACE)), 8, "0")), F.lit(":"), F.shiftright(x, 31).cast("string"))
    return F.array_join(F.transform(kept, one), ",")


def hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda x: x % F.lit(PLACE)))


def likeness(one: Column, other: Column) -> Column:
    """Of two sets of hashes: shared over all."""
    every, shared = F.size(one) + F.size(other), F.size(F.array_intersect(one, other))
    return F.when(every == 0, 1.0).otherwise(shared / (every - shared))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, picks (array of place * PLACE + hash), fingerprint."""
    kept = docs.select(F.col(id_col).alias(id_col), picks(F.coalesce(text_col, F.lit(""))).alias("picks"))
    return kept.withColumn("fingerprint", written("picks"))


def dealt(docs: DataFrame, per_range: int = 64, most: int = 1 << 16, bits: int = 7) -> DataFrame:
    """id, text, what orders them (none, inverse, digest), and range and part, where a row is
    worked on; `ghost` rows are copies of the first row of the range or part that follows.
    There are about n / per_range ranges, at most `most`; hot and null ids have 2 ** bits parts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.agg(F.count("id").alias("n"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    ranges = max(1, min(most, ids["n"] // per_range))
    quantiles = [i / ranges for i in range(1, ranges)]
    found = rows.select(F.percentile_approx(F.col("id").cast("double"), quantiles, max(10_000, 4 * ranges)).alias("q")).first()["q"] if quantiles else []
    hot = sorted({x for x, y in zip(found or [], (found or [])[1:], strict=False) if x == y})
    cuts = [-float("inf"), *sorted(set(found or [])), float("inf")]
    placed = rows.withColumn("real", F.col("id").cast("double"))
    placed = Bucketizer(splits=cuts, inputCol="real", outputCol="at", handleInvalid="keep").transform(placed) if len(cuts) > 2 else placed.withColumn("at", F.lit(0.0))
    none, zero = F.col("id").isNull(), F.lit(0).cast("long")
    digest = F.shiftrightunsigned(F.xxhash64("text"), 1)
    split = none if ids["nulls"] else F.lit(False)
    for x in hot:
        split = split | (F.col("real") == x)
    tie = F.when(split, digest).otherwise(zero) if hot or ids["nulls"] else zero  # else the ranges are found without a look at the texts
    # A hot id opens its range: of the ids there it is the smallest, so its parts come last.
    place = {"range": F.when(none, len(cuts)).otherwise(F.lit(len(cuts) - 1) - F.col("at")).cast("int"), "part": F.when(split, F.shiftright(tie, 63 - bits) + 1).otherwise(zero)}
    placed = placed.select("id", "text", none.alias("none"), F.coalesce(F.bitwise_not("id"), zero).alias("inverse"), tie.alias("tie"), *[c.alias(n) for n, c in place.items()])
    first = placed.groupBy("range", "part").agg(F.min(F.struct("inverse", "tie")).alias("first"))  # one row for each range and part: bounded
    along = W.orderBy("range", "part")
    here = F.struct("range", "part")
    before = first.select("range", "part", "first", F.coalesce(F.lag(here).over(along), F.max(here).over(W.partitionBy())).alias("to"))
    joined = placed.join(F.broadcast(before), ["range", "part"])
    also = F.when(F.struct("inverse", "tie") == F.col("first"), F.struct("to.range", "to.part", F.lit(1).alias("ghost")))
    each = F.explode(F.array_compact(F.array(F.struct("range", "part", F.lit(0).alias("ghost")), also)))
    return joined.select("id", "text", "none", "inverse", digest.alias("digest"), each.alias("to")).select("id", "text", "none", "inverse", "digest", "to.*")


def neighbours(docs: DataFrame) -> DataFrame:
    """id, text, picks, next_text, next_picks: each document and the one after it."""
    placed = dealt(docs).repartition("range", "part").withColumn("picks", picks("text"))
    along = W.partitionBy("range", "part").orderBy("ghost", "none", "inverse", "digest", "text")
    both = placed.withColumns({"next_text": F.lead("text").over(along), "next_picks": F.lead("picks").over(along)})
    return both.where("ghost = 0").select("id", "text", "picks", "next_text", "next_picks")


def edited(docs: DataFrame) -> DataFrame:
    """One row for each input row: doc_id, n_chars, edited_sha256 (of the text whose last half is
    replaced by the first part of the next document), both fingerprints and the likenesses."""
    head, tail = F.expr("left(text, int(length(text) - length(text) div 2))"), F.expr("left(next_text, int(length(text) div 2))")
    rows = neighbours(docs).withColumns({"head": head, "tail": tail})
    rows = rows.withColumn("edited_picks", picks(F.concat("head", "tail")))
    rows = rows.withColumns({"mine": hashes(F.col("picks")), "theirs": hashes(F.col("edited_picks")), "of_next": hashes(F.col("next_picks"))})
    return rows.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.concat("head", "tail"), 256).alias("edited_sha256"),
        written("picks").alias("fingerprint"), written("edited_picks").alias("edited_fingerprint"),
        likeness(F.col("mine"), F.col("theirs")).alias("near_edited"), likeness(F.col("mine"), F.col("of_next")).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return edited(load(spark, sf_dir, "documents"))
