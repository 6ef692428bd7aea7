"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features of a text, each present or not: its words, the first bytes of its
words (for inflected forms), its word pairs and its skip-grams (pairs with one
word between), hashed to 2**BITS coordinates. FTRL-proximal learns with a rate
for each coordinate; the L1 part leaves a few thousand weights, which travel
with the scoring tasks. A Platt curve fitted on held-back rows turns raw sums
into probabilities.

Only rows whose id is outside fold 0 teach; the fit reads a bounded sample of
the labelled rows (`max_rows` rows and `max_bytes` of text, chosen by hashes), in
one task; the driver holds no more than the weights. Scores read the text alone
and cover every whole text.

Defined results: null, empty and word-less texts get the score of the constant
feature; several labels of one id count as their mean; null labels and labels
without a document are ignored; with no labels all scores are 0, with labels of
one class all scores are that class; rows with a null id are scored, held_out
is null for them; repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalith.llm import text as T
from catalith.llm.common import bounded, fold, load
from catalith.llm.ftrl import Ftrl, platt

BITS, STEM = 20, 4
MASK, ALWAYS = T.U((1 << BITS) - 1), (1 << BITS) - 1


def features(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of the distinct features of each row; `wanted` (a flag for each
    coordinate) leaves the others out before the costly part."""
    hashes, row, starts, ends = T.words(raw, offsets, T.PLAIN)
    head = raw[np.minimum(starts[:, None] + np.arange(STEM), max(len(raw) - 1, 0))] if len(starts) else np.zeros((0, STEM), np.uint8)
    head = np.where(np.arange(STEM) < (ends - starts)[:, None], T.LOWER[head], 0).astype(np.uint32)
    stem = (head << (8 * np.arange(STEM, dtype=np.uint32))).sum(1).astype(T.U)
    found, rows = [hashes, T.mix(stem + T.U(0x77 << 40))], [row, row]
    for gap, salt in ((1, 0x11), (2, 0x22)):
        at = np.flatnonzero(row[gap:] == row[:-gap])
        found.append(T.mix(hashes[at] * T.U(3) + T.mix(hashes[at + gap]) + T.U(salt)))
        rows.append(row[at])
    n = len(offsets) - 1
    at, owner = (np.concatenate(found) & MASK).astype(np.int64), np.concatenate(rows)
    if wanted is not None:
        keep = wanted[at]
        at, owner = at[keep], owner[keep]
    both = np.unique(np.concatenate((owner << BITS | at, np.arange(n) << BITS | ALWAYS)))
    return both >> BITS, both & ALWAYS


def coordinates(column: pa.Array) -> list[np.ndarray]:
    """The distinct features of each text."""
    out: list[np.ndarray] = []
    raw, offsets = T.flat(column)
    for lo, hi in T.slices(offsets):
        row, at = features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        out += [x.astype(np.int32) for x in np.split(at, np.searchsorted(row, np.arange(1, hi - lo)))]
    return out


def fit(examples: list[np.ndarray], labels: np.ndarray, alpha: float = 0.5, l1: float = 5.0, l2: float = 0.1, rounds: int = 3, least: int = 3, seed: int = 11) -> dict:
    """Learn from the features of texts with labels 0 and 1: coordinates, weights, slope and shift."""
    often = np.zeros(1 << BITS, np.int64)
    for x in examples:
        often[x] += 1
    examples = [x[often[x] >= least] for x in examples]
    model, order = Ftrl(1 << BITS, 1, alpha=alpha, l1=l1, l2=l2), np.random.default_rng(seed)
    back = np.arange(len(examples)) % 10 == 9  # held back for the curve
    teach = np.flatnonzero(~back)
    for _ in range(rounds):
        for i in order.permutation(teach):
            model.learn(examples[i], np.ones(len(examples[i])), labels[i : i + 1])
    weights = model.weights()[:, 0]
    raw = np.array([weights[examples[i]].sum() for i in np.flatnonzero(back)])
    slope, shift = platt(raw, (labels[back] >= 0.5).astype(float))
    if slope <= 0:
        slope, shift = 1.0, 0.0
    at = np.flatnonzero(weights)
    return {"at": at, "weights": weights[at], "slope": slope, "shift": shift, "only": None}


MODEL = "only double, at binary, weights binary, slope double, shift double"


def _fit_rows(batches):
    """The whole sample, (doc_id, text, toxic) rows, to one row with the model."""
    ids, examples, toxic = [], [], []
    for batch in batches:  # a batch's texts go once their features are known
        ids += batch.column(0).to_pylist()
        examples += coordinates(batch.column(1))
        toxic += batch.column(2).to_pylist()
    if not ids:
        return
    order = sorted(range(len(ids)), key=lambda i: (ids[i], examples[i].tobytes()))
    examples, toxic = [examples[i] for i in order], np.array(toxic)[order]
    if len(np.unique(toxic >= 0.5)) < 2:
        model = {"only": float(toxic[0] >= 0.5), "at": b"", "weights": b"", "slope": 1.0, "shift": 0.0}
    else:
        model = fit(examples, toxic)
        model = model | {"at": model["at"].astype("<i4").tobytes(), "weights": model["weights"].astype("<f8").tobytes()}
    kinds = [pa.float64(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in MODEL.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([model[n]], t) for n, t in zip(names, kinds, strict=True)], names=names)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_bytes: int = 64 << 20) -> dict:
    """Fit on at most max_rows labelled documents outside fold 0, of at most max_bytes of text.
    The sample of labels holds about max_rows ids, so it is broadcast to the scan of the texts."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("toxic")).where(fold() != 0)
    n = known.count()
    if not n:
        return {"only": 0.0}
    share = min(1.0, max_rows / n)
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic")
    found = bounded(texts, max_rows, max_bytes, "doc_id").coalesce(1).mapInArrow(_fit_rows, MODEL).collect()  # one row
    if not found:
        return {"only": 0.0}
    model = found[0].asDict()
    return model | {"at": np.frombuffer(model["at"], "<i4").astype(np.int64), "weights": np.frombuffer(model["weights"], "<f8")}


def _scorer(model: dict):
    """A function from a text column to scores, with the weights laid out once for each task."""
    weights = np.zeros(1 << BITS)
    weights[model["at"]] = model["weights"]
    wanted = weights != 0

    def scores(column: pa.Array) -> np.ndarray:
        raw, offsets = T.flat(column)
        out = [np.zeros(0)]
        for lo, hi in T.slices(offsets):
            row, at = features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], wanted)
            out.append(np.bincount(row, weights[at], hi - lo))
        return 1 / (1 + np.exp(-np.clip(model["slope"] * np.concatenate(out) + model["shift"], -35, 35)))

    return scores


def drop_toxic(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold: one scan, no join."""
    if model["only"] is not None:
        return docs if model["only"] < threshold else docs.limit(0)
    at = docs.columns.index("text")

    def each(batches):
        scores = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) < threshold))

    return docs.mapInArrow(each, docs.schema)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    kind = docs.schema[id_col].dataType
    if model["only"] is not None:
        return docs.select(id_col, F.lit(model["only"]).alias("score"))

    def each(batches):
        scores = _scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(each, f"`{id_col}` {kind.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    scored = score(docs, train(docs, labels, max_rows))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
