"""Spelling variants: words at a distance of one, by rolling-hash deletions.

A word with one code point left out has the hash of what stands before it plus that of what
stands behind, both from running sums of a polynomial, for all words and places of a batch at
once. Such deletion keys and the keys of whole words are dealt by their leading bits (radix
partitions) and sorted there. Words that meet in a key at the same place differ in that code
point; a whole word that meets a deletion is that word with one code point less. Both are
confirmed on the strings, and every group of equal ones gives its members their number of
near words and the best of them at once, so no pair is ever written out: the work follows the
number of deletions, not of pairs.

A word's form is its best near word (most occurrences, then the smaller in code-point order),
if that has at least RATIO times its occurrences. Forms are followed to the last by pointer
jumping; as occurrences at least double along a chain, it has no cycle.

Defined results: null texts have no words; a null id is written as an empty string where the
id is part of a hash; repeated rows count each; of a run of equal code points the first place
stands for the deletion of each (the string is the same); extra columns are ignored; an empty
table gives no rows. A word travels once to each partition that its deletions fall into, so
very long words neither multiply by their length nor are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalith.llm import text as T
from catalith.llm.common import cut, load

RUN, UPPER, LOWER = r"[A-Za-zÀ-ÿ]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RATIO = 2
#: Deletions for each radix partition.
SHARE = 1 << 17
WHOLE = -1
DEALT = "part int, word string, n long, places array<int>, keys array<long>"
FOUND = "word string, near long, best_n long, best string"

SQL = r"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, c) ORDER BY c) AS t FROM range(256) r(c)
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), counted AS (
  SELECT doc_id, w, count(*) AS c FROM runs WHERE length(w) >= 5 GROUP BY ALL
), hashed AS (
  SELECT w, c, xor(list_reduce(flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, (unicode(x) - 64)::BIGINT] END)),
    lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM counted, tab
), edited AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(c)::BIGINT AS n FROM edited WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3
), cuts AS MATERIALIZED (
  SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM cuts a JOIN words w ON a.s = w.word
  UNION SELECT w.word, a.word, a.n FROM cuts a JOIN words w ON a.s = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, (list(other ORDER BY m DESC, encode(other)))[1] AS other FROM pairs GROUP BY word
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""


def runs(docs: DataFrame) -> DataFrame:
    """id, run: every run of letters of every whole text, A-Z lower-cased."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    return docs.select(F.col("doc_id").alias("id"), F.explode(found).alias("run"))


def misspelt(found: DataFrame, every: int, least: int) -> DataFrame:
    """word: runs of at least `least` code points after one in `every`, chosen by the CRC-32 of
    id and run, has lost a code point."""
    named = found.where(F.length("run") >= least).select("run", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return named.select(F.when(F.col("h") % every == 0, lost).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def counted(words: DataFrame, least: int) -> DataFrame:
    """word, n of words that occur at least `least` times."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place, key) of each word's deletions and, at place WHOLE, of the word itself."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    up, down = T.powers(len(letters) + 2)
    total = np.zeros(len(letters) + 1, T.U)
    np.cumsum(T.mix(letters.astype(T.U) + T.U(1)) * up[: len(letters)], out=total[1:])
    owner, at = np.repeat(np.arange(len(words)), sizes), np.arange(len(letters))
    first, last = starts[owner], ends[owner]
    before, after = (total[at] - total[first]) * down[first], (total[last] - total[at + 1]) * down[first + 1]
    whole = (total[ends] - total[starts]) * down[starts]
    return np.concatenate((owner, np.arange(len(words)))), np.concatenate((at - first, np.full(len(words), WHOLE))), T.mix(np.concatenate((before + after, whole)))


def _deal(bits: int):
    """Each word's keys, gathered by radix partition."""

    def each(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            size = np.cumsum([0, *map(len, words)])
            for lo, hi in T.slices(size, T.SLICE // 8):
                owner, place, key = keys(words[lo:hi])
                part = (key >> T.U(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
                order = np.lexsort((place, owner, part))
                owner, place, key, part = owner[order], place[order], key[order], part[order]
                new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1]))))
                offsets = pa.array(np.append(new, len(owner)), pa.int32())
                mine = batch.slice(lo, hi - lo).take(pa.array(owner[new]))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (place.astype(np.int32), key.view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(part[new].astype(np.int32)), mine.column(0), mine.column(1), *lists], names=["part", "word", "n", "places", "keys"])

    return each


def _met(table: pa.Table) -> pa.Table:
    """One radix partition: what each word's equal keys say of its near words."""
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    places, held = table.column("places").combine_chunks(), table.column("keys").combine_chunks()
    owner = np.repeat(np.arange(len(words)), np.asarray(pa.compute.list_value_length(places)))
    place, key = np.asarray(places.flatten()).astype(np.int64), np.asarray(held.flatten())
    order = np.lexsort((place, key))
    owner, place, key = owner[order], place[order], key[order]
    same = lambda *xs: np.concatenate(([False], np.logical_and.reduce([x[1:] == x[:-1] for x in xs])))
    group, twin = np.cumsum(~same(key)), np.cumsum(~same(key, place))
    has_whole = np.isin(group, group[place == WHOLE])
    letter = lambda i: words[owner[i]][place[i]]
    opens = np.array([place[i] <= 0 or letter(i) != words[owner[i]][place[i] - 1] for i in np.flatnonzero(has_whole).tolist()], bool)
    beside = np.flatnonzero(has_whole)[opens] if len(opens) else np.zeros(0, np.int64)
    beside = beside[np.bincount(group[beside], minlength=group.max(initial=0) + 1)[group[beside]] > 1]
    twins = np.flatnonzero((place != WHOLE) & (np.bincount(twin)[twin] > 1))

    def strings(at: np.ndarray) -> np.ndarray:
        """What is left of the words at these places, numbered by the strings themselves."""
        left = [w if p == WHOLE else w[:p] + w[p + 1 :] for w, p in ((words[o], p) for o, p in zip(owner[at].tolist(), place[at].tolist(), strict=True))]
        return pd.factorize(np.array(left, object))[0] if left else np.zeros(0, np.int64)

    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    rows = []  # (word, near words, best of them)

    def best_two(ids: np.ndarray, at: np.ndarray, among: np.ndarray):
        """For each group id: its number of members among `among`, and the best two."""
        o = np.lexsort((rank[owner[at]], -n[owner[at]], ~among, ids))
        lead = np.searchsorted(ids[o], np.arange(ids.max(initial=-1) + 1))
        size = np.bincount(ids[among], minlength=len(lead))
        take = lambda k: np.where(size > k, owner[at][o][np.minimum(lead + k, len(o) - 1)], -1) if len(o) else np.zeros(0, np.int64)
        return size, take(0), take(1)

    if len(twins):
        ids = pd.factorize(pd.MultiIndex.from_arrays([strings(twins), place[twins]]))[0]
        size, one, two = best_two(ids, twins, np.ones(len(twins), bool))
        me = owner[twins]
        rows.append((me, size[ids] - 1, np.where(one[ids] == me, two[ids], one[ids])))
    if len(beside):
        ids, whole = strings(beside), place[beside] == WHOLE
        size, one, _ = best_two(ids, beside, ~whole)
        rows.append((owner[beside[whole]], size[ids[whole]], one[ids[whole]]))
        shorter = np.full(len(size), -1)
        shorter[ids[whole]] = owner[beside[whole]]
        met = ~whole & (shorter[ids] >= 0)
        rows.append((owner[beside[met]], np.ones(met.sum(), np.int64), shorter[ids[met]]))
    who, near, best = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    some = near > 0
    who, near, best = who[some], near[some], best[some]
    o = np.lexsort((rank[best], -n[best], who))
    top = o[np.concatenate(([True], who[o][1:] != who[o][:-1]))] if len(o) else o
    total = np.bincount(who, near, len(words)).astype(np.int64)
    take = lambda ids: pa.array([words[i] for i in ids.tolist()], pa.string())
    return pa.table([take(who[top]), pa.array(total[who[top]]), pa.array(n[best[top]], pa.int64()), take(best[top])], names=["word", "near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """word, near, best_n, best of every word of (word, n) that has a near word."""
    letters = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    bits = max(0, int(letters) // SHARE).bit_length()
    dealt = words.select("word", "n").mapInArrow(_deal(bits), DEALT)
    met = dealt.groupBy("part").applyInArrow(_met, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b")
    return met.groupBy("word").agg(F.sum("near").alias("near"), best).select("word", "near", (-F.col("b.minus")).alias("best_n"), "b.best")


def followed(links: DataFrame, rounds: int = 40) -> DataFrame:
    """word, root of (word, form): forms followed to the last, twice as far in each round."""
    found = cut(links.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = cut(found.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        found = new.select("word", "root")
        if new.where("moved").isEmpty():
            return found
    raise RuntimeError("forms do not end")


def variants(words: DataFrame) -> DataFrame:
    """One row for each row of (word, n): word, form, root, n, n_near, form_n."""
    words = cut(words)
    formed = words.join(near_words(words), "word", "left")
    take = F.col("best_n") >= RATIO * F.col("n")
    formed = cut(formed.select("word", "n", F.coalesce("near", F.lit(0).cast("long")).alias("n_near"), F.when(take, F.col("best")).alias("form"), F.when(take, F.col("best_n")).alias("form_n")))
    roots = followed(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(counted(misspelt(runs(load(spark, sf_dir, "documents")), 97, 5), 3))
