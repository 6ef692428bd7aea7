"""Language-model scores: a bigram model smoothed by deleted interpolation.

P(w | u) = l2 c(u, w) / c(u) + l1 c(w) / N + l0 / (V + 1), where the weights l
depend on the bucket (octave) of the context's frequency c(u). Counts cover all
training documents. The weights are learned by expectation-maximisation on
held-out counts: every tenth chunk of documents is deleted in turn, that is,
its own counts are subtracted, and its training tokens are predicted from the
rest. Tokens of equal bucket and (to a quarter of an octave) equal estimates
are counted together, so EM reads a table of bounded size.

Documents are dealt into chunks by a hash of id and text; the chunks ask for corpus
counts of their distinct words and word pairs (see counting). Words and pairs
are compared by hash: 64 bits for words, 48 for pairs. At cluster scale raise
`chunk_bytes` so that chunks times ranges stays near what one shuffle handles.

Tokens are words, lower-cased in A-Z, and one end token for each text; a text
starts in a context of its own. Defined results: null and empty texts are the
end token alone; with no training token P is 1 / (V + 1) = 1; rows with a null
id teach nothing, their held_out is null; repeated rows teach and are scored
one by one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from catalith.llm import counting, text as T
from catalith.llm.common import cut, fold, id_range, load

CHUNK_BYTES, DELETED, OCTAVES = 16 << 20, 10, 40
START, END = T.mix(np.array([0x51A27, 0xE4D], T.U))
#: Cells of the held-out table: estimates to a quarter of an octave; ZERO stands for no count.
STEP, ZERO = 4, -400


class Chunk:
    """The tokens of one chunk: distinct words and pairs, and how training documents use them."""

    def __init__(self, table: pa.Table):
        raw, offsets = T.flat(table.column("text"))
        hashes, row, _, _ = T.words(raw, offsets)
        n = table.num_rows
        self.ids, self.n = table.column("doc_id"), n
        teach = np.asarray(table.column("teach").combine_chunks().fill_null(False)).astype(bool)
        counts = np.bincount(row, minlength=n)
        size = len(hashes) + n
        ends = np.cumsum(counts + 1) - 1
        self.tokens, self.row = np.full(size, END), np.repeat(np.arange(n), counts + 1)
        is_word = np.ones(size, bool)
        is_word[ends] = False
        self.tokens[is_word] = hashes
        self.lengths = counts + 1
        self.teach = teach[self.row]
        before = np.empty(size, T.U)
        before[1:] = self.tokens[:-1]
        before[ends - counts] = START
        self.words, self.word = np.unique(self.tokens, return_inverse=True)
        pair = T.mix(T.mix(before) + self.tokens * T.U(5)) >> T.U(16) << T.U(16)
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        self.starts = ends - counts

    def own(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {1: (self.words, np.bincount(self.word[self.teach], minlength=len(self.words))), 2: (self.pairs, np.bincount(self.pair[self.teach], minlength=len(self.pairs)))}

    def contexts(self, word_counts: np.ndarray) -> np.ndarray:
        """c(u) of each token's context: a word precedes one token each time it occurs, the
        start precedes as many as there are end tokens."""
        of = word_counts[self.word]
        out = np.empty(len(of), np.int64)
        out[1:] = of[:-1]
        out[self.starts] = word_counts[np.searchsorted(self.words, END)] if len(self.words) else 0
        return out


def _bucket(context: np.ndarray) -> np.ndarray:
    """0: never seen; else one more than the octave."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, OCTAVES - 1), 0)


def _ask(ranges: int, held: int = 64 << 20):
    """(chunk, doc_id, teach, text) rows to what their chunks ask; a task gathers about `held`
    bytes of text at a time, so that frequent words are asked for once for each chunk."""

    def each(batches):
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= held:
                yield from asked(waiting)
                waiting, size = [], 0
        if waiting:
            yield from asked(waiting)

    def asked(waiting):
        table = pa.Table.from_batches(waiting)
        chunk = np.asarray(table.column("chunk").combine_chunks())
        order = np.argsort(chunk, kind="stable")
        bounds = np.flatnonzero(np.diff(chunk[order], prepend=-1, append=-1))
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            yield counting.asks(int(chunk[order[lo]]), Chunk(table.take(pa.array(order[lo:hi]))).own(), ranges)

    return each


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.broadcast_to(np.asarray(b) > 0, a.shape))


def _held_out(total: int):
    def each(key, docs: pa.Table, given: pa.Table) -> pa.Table:
        """The deleted chunk's training tokens by bucket and estimates from all other chunks."""
        cells, times = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        if docs.num_rows:
            c = Chunk(docs)
            own = c.own()
            words, pairs = counting.read(given, 1) - own[1][1], counting.read(given, 2) - own[2][1]
            at = np.flatnonzero(c.teach)
            context = c.contexts(words)[at]
            p1, p2 = _ratio(words[c.word[at]], total - len(at)), _ratio(pairs[c.pair[at]], context)
            q = [np.where(p > 0, np.rint(np.log2(np.maximum(p, 1e-30)) * STEP), ZERO).astype(np.int64) for p in (p1, p2)]
            cells, times = np.unique(np.stack((_bucket(context), *q), 1), axis=0, return_counts=True)
        return pa.table({"bucket": pa.array(cells[:, 0]), "q1": pa.array(cells[:, 1]), "q2": pa.array(cells[:, 2]), "times": pa.array(times.astype(np.int64))})

    return each


def learn_weights(cells: np.ndarray, times: np.ndarray, distinct: int, rounds: int = 80) -> np.ndarray:
    """EM: rows (l0, l1, l2) for each bucket. Buckets without held-out tokens take the
    weights of the nearest lower bucket that has some."""
    first = np.array([0.1, 0.5, 0.4])
    weights = np.tile(first, (OCTAVES, 1))
    weights[0] = [0.2, 0.8, 0.0]
    if len(cells):
        bucket = cells[:, 0]
        p = np.stack((np.full(len(cells), 1 / (distinct + 1)), *(np.where(cells[:, i] == ZERO, 0.0, 2.0 ** (cells[:, i] / STEP)) for i in (1, 2))), 1)
        have = np.bincount(bucket, times, OCTAVES)
        for _ in range(rounds):
            share = weights[bucket] * p
            share *= (times / share.sum(1))[:, None]
            new = np.stack([np.bincount(bucket, share[:, i], OCTAVES) for i in range(3)], 1)
            weights = np.where(have[:, None] > 0, new / np.maximum(have, 1)[:, None], weights)
        weights = np.maximum(weights, 1e-9)
        weights[0, 2] = 0.0
        for b in range(2, OCTAVES):
            if not have[b]:
                weights[b] = weights[b - 1]
        weights /= weights.sum(1, keepdims=True)
    return weights


def _score(total: int, distinct: int, weights: np.ndarray):
    def each(key, docs: pa.Table, given: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        c = Chunk(docs)
        words, pairs = counting.read(given, 1), counting.read(given, 2)
        context, mine = c.contexts(words), words[c.word]
        w = weights[_bucket(context)]
        p = w[:, 0] / (distinct + 1) + w[:, 1] * _ratio(mine, total) + w[:, 2] * _ratio(pairs[c.pair], context) if total else np.ones(len(mine))
        base = np.log10((mine + 0.5) / (total + 0.5 * (distinct + 1)))
        by_doc = lambda x: np.bincount(c.row, x, c.n)
        return pa.table({"doc_id": c.ids.cast(pa.int64()), "n_tokens": pa.array(c.lengths.astype(np.int64)), "n_known": pa.array(by_doc(mine > 0).astype(np.int64)), "base_score": pa.array(by_doc(base)), "score": pa.array(by_doc(np.log10(p)))})

    return each


def lm_score(docs: DataFrame, learns: Column | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of
    docs; `learns` is the condition under which a row teaches (unless given: fold 1 does not)."""
    learns = (fold() != 1) if learns is None else learns
    chunks = max(DELETED, id_range(docs, "text", chunk_bytes))
    dealt = docs.select(counting.chunk_of(("doc_id", "text"), chunks).alias("chunk"), "doc_id", learns.alias("teach"), "text")
    given = cut(counting.answers(dealt.mapInArrow(_ask(chunks), counting.ASK)))
    sums = given.where("chunk < 0 AND kind = 1").agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = int(sums[0] or 0), int(sums[1] or 0)
    given = given.where("chunk >= 0").select("chunk", "kind", "range", "counts").toDF("of", "kind", "range", "counts")
    deleted = dealt.where(F.col("chunk") % DELETED == 0).groupBy("chunk").cogroup(given.where(F.col("of") % DELETED == 0).groupBy("of"))
    cells = deleted.applyInArrow(_held_out(total), "bucket long, q1 long, q2 long, times long").groupBy("bucket", "q1", "q2").agg(F.sum("times").alias("times")).toArrow()
    table = np.stack([np.asarray(cells.column(i)) for i in range(4)], 1).astype(np.int64) if cells.num_rows else np.zeros((0, 4), np.int64)
    table = table[np.lexsort(table.T[::-1])]
    weights = learn_weights(table[:, :3], table[:, 3], distinct)
    scored = dealt.groupBy("chunk").cogroup(given.groupBy("of")).applyInArrow(_score(total, distinct, weights), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    scored = lm_score(load(spark, sf_dir, "documents"))
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
