"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; each run of other characters than letters becomes one
space. n-grams of one to three characters are hashed to 2**BITS coordinates and
valued by their share of the text's n-grams times their inverse document
frequency. Follow-the-regularised-leader with an elastic net learns one weight
vector for each language, and a temperature fitted on held-back rows calibrates
the probabilities.

Only documents outside fold 0 teach, by text and lang alone. Document frequencies
cover all of them; the fit reads a bounded sample (`max_rows` rows and `max_bytes`
of text, chosen by hashes) in which every language has an equal quota, so that
rare ones are taken whole. The fit runs in one task; the driver holds no more than
the weights. Predictions read the text alone and cover every whole text.

Defined results: `und` with score 1 for a null text and for one without
letters; with nothing to learn from every text is `und` with score 0; a single
known language is always predicted; rows with a null id are judged, held_out is
null for them, and they teach nothing; repeated rows are judged one by one;
extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalith.llm import text as T
from catalith.llm.common import bounded, fold, load
from catalith.llm.ftrl import Ftrl

BITS, LONGEST, SCALE = 18, 3, 40.0
MASK = T.U((1 << BITS) - 1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point of the basic plane: its lower-case letter, or 0."""
    out = np.zeros(1 << 16, np.uint32)
    for i in range(1 << 16):
        if unicodedata.category(chr(i))[0] == "L":
            low = chr(i).lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with single 0 for what lies between words, row of each, letters in each row)."""
    n = len(offsets) - 1
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    first = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]
    row = np.repeat(np.arange(n), np.diff(first))
    table = _letters()
    low = table[np.minimum(codes, 0xFFFF)]
    for c in np.unique(codes[codes > 0xFFFF]).tolist():
        low[codes == c] = ord(chr(c).lower()) if unicodedata.category(chr(c))[0] == "L" else 0
    count = np.bincount(row[low > 0], minlength=n)
    keep = low > 0
    keep[1:] |= (low[:-1] > 0) & (row[1:] == row[:-1])
    return low[keep].astype(T.U), row[keep], count


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n: (coordinate, row) of every n-gram; and the letters of each row."""
    low, row, count = letters(raw, offsets)
    out, whole = [], np.zeros(len(low), T.U)
    for n in range(1, LONGEST + 1):
        if len(low) < n:
            break
        whole = whole[: len(low) - n + 1] * T.U(0x100000001B3) + low[n - 1 :] + T.U(n)
        ok = row[n - 1 :] == row[: len(row) - n + 1]
        out.append(((T.mix(whole[ok]) & MASK).astype(np.int64), row[n - 1 :][ok]))
    return out, count


def shares(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The coordinates of each text and their shares of its n-grams."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    raw, offsets = T.flat(column)
    for lo, hi in T.slices(offsets):
        found, _ = grams(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        both = np.concatenate([r << BITS | at for at, r in found]) if found else np.zeros(0, np.int64)
        both, times = np.unique(both, return_counts=True)
        bounds = np.searchsorted(both >> BITS, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            t = times[bounds[i] : bounds[i + 1]]
            out.append(((both[bounds[i] : bounds[i + 1]] & int(MASK)).astype(np.int32), (t / max(1, t.sum())).astype(np.float32)))
    return out


def fit(examples: list[tuple[np.ndarray, np.ndarray]], langs: list[str], often: np.ndarray, teachers: int, alpha: float = 0.3, l1: float = 0.3, l2: float = 0.3, rounds: int = 3, least: int = 2, seed: int = 5) -> dict:
    """Learn from a sample's shares; `often` tells how many of all `teachers` documents hold each coordinate."""
    names = sorted(set(langs))
    target = np.eye(len(names))[[names.index(x) for x in langs]]
    here = np.zeros(1 << BITS, bool)
    for at, _ in examples:
        here[at] = True
    known = np.flatnonzero(here & (often >= least))
    place = np.full(1 << BITS, -1)  # weights are kept for what the sample holds
    place[known] = np.arange(len(known))
    idf = (np.log((1 + teachers) / (1 + often[known])) + 1) * SCALE
    examples = [(place[at[keep]], tf[keep]) for at, tf in examples for keep in [place[at] >= 0]]
    model, order = Ftrl(len(known), len(names), alpha=alpha, l1=l1, l2=l2), np.random.default_rng(seed)
    back = np.arange(len(examples)) % 10 == 9
    for _ in range(rounds):
        for i in order.permutation(np.flatnonzero(~back)):
            at, tf = examples[i]
            if len(at):
                model.learn(at, tf * idf[at], target[i])
    table = model.weights() * idf[:, None]
    raw = np.array([tf @ table[at] for at, tf in (examples[i] for i in np.flatnonzero(back))]).reshape(-1, len(names))
    at = np.flatnonzero(np.abs(table).sum(1))
    return {"names": names, "at": known[at], "table": table[at].astype(np.float32), "temperature": temperature(raw, target[back])}


def temperature(raw: np.ndarray, target: np.ndarray) -> float:
    """The divisor of raw scores, of a fixed grid, with the least log loss on held-back rows."""
    if not len(raw):
        return 1.0
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 121):
        z = raw / t
        z = z - z.max(1, keepdims=True)
        loss = (np.log(np.exp(z).sum(1)) - (z * target).sum(1)).mean()
        best = min(best, (float(loss), float(t)))
    return best[1]


def _frequencies(batches):
    """One row (at, docs) for each coordinate: how many of the partition's texts hold it."""
    often, place = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int32)
    for batch in batches:
        raw, offsets = T.flat(batch.column(0))
        for lo, hi in T.slices(offsets):
            found, _ = grams(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            bounds = [np.searchsorted(row, np.arange(hi - lo + 1)).tolist() for _, row in found]
            for i in range(hi - lo):
                at = np.concatenate([x[b[i] : b[i + 1]] for (x, _), b in zip(found, bounds, strict=True)] or [np.zeros(0, np.int64)])
                nth = np.arange(len(at), dtype=np.int32)
                place[at] = nth  # of equal coordinates one remains
                often[at[place[at] == nth]] += 1
    at = np.flatnonzero(often)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(often[at])], names=["at", "docs"])


def quota(counts: list[int], most: int) -> int:
    """The largest q for which the sum of min(count, q) stays within most."""
    left, rest = most, sorted(counts)
    for i, n in enumerate(rest):
        if n * (len(rest) - i) > left:
            return left // (len(rest) - i)
        left -= n
    return max(rest, default=0)


def _fit_rows(often: np.ndarray, teachers: int):
    def each(batches):
        ids, examples, langs = [], [], []
        for batch in batches:  # a batch's texts go once their shares are known
            ids += batch.column(0).to_pylist()
            examples += shares(batch.column(1))
            langs += batch.column(2).to_pylist()
        if not ids:
            return
        order = sorted(range(len(ids)), key=lambda i: (ids[i], langs[i], examples[i][0].tobytes()))
        model = fit([examples[i] for i in order], [langs[i] for i in order], often, teachers)
        columns = [pa.array([model["names"]]), pa.array([model["at"].astype("<i4").tobytes()]), pa.array([model["table"].astype("<f4").tobytes()]), pa.array([model["temperature"]])]
        yield pa.RecordBatch.from_arrays(columns, names=["names", "at", "table", "temperature"])

    return each


def train(docs: DataFrame, max_rows: int = 8_000, max_bytes: int = 64 << 20) -> dict | None:
    """Fit on at most max_rows documents outside fold 0 with a lang, of at most max_bytes of
    text; None without any. The languages must be few enough for a weight of each."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return None
    each = quota(list(counts.values()), max_rows)
    cells = known.select("text").mapInArrow(_frequencies, "at int, docs long").groupBy("at").agg(F.sum("docs").alias("docs")).toArrow()  # at most 2**BITS rows
    often = np.zeros(1 << BITS)
    often[np.asarray(cells.column("at"))] = np.asarray(cells.column("docs"))
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(max(1, int(min(1.0, each / n) * (1 << 30))))) for name, n in counts.items()])
    sample = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share)
    rows = bounded(sample, max_rows, max_bytes, "doc_id").coalesce(1).mapInArrow(_fit_rows(often, sum(counts.values())), "names array<string>, at binary, table binary, temperature double").collect()  # one row
    if not rows:
        return None
    model = rows[0].asDict()
    return model | {"at": np.frombuffer(model["at"], "<i4").astype(np.int64), "table": np.frombuffer(model["table"], "<f4").reshape(-1, len(model["names"]))}


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row."""
    kind = docs.schema[id_col].dataType
    if model is None:
        return docs.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def each(batches):
        k = len(model["names"])
        table = np.zeros((1 << BITS, k), np.float32)
        table[model["at"]] = model["table"]
        names = np.array([*model["names"], "und"], object)
        for batch in batches:
            raw, offsets = T.flat(batch.column(1))
            best, score = [], []
            for lo, hi in T.slices(offsets):
                found, count = grams(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                sums, total = np.zeros((hi - lo, k)), np.zeros(hi - lo)
                for at, row in found:
                    total += np.bincount(row, minlength=hi - lo)
                    for c in range(k):
                        sums[:, c] += np.bincount(row, table[at, c], hi - lo)
                z = sums / np.maximum(total, 1)[:, None] / model["temperature"]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best.append(np.where(count > 0, p.argmax(1), k))
                score.append(np.where(count > 0, p.max(1), 1.0))
            best = np.concatenate(best) if best else np.zeros(0, np.int64)
            score = np.concatenate(score) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(each, f"`{id_col}` {kind.simpleString()}, lang_pred string, score double")


def language_id(docs: DataFrame, max_rows: int = 8_000) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs."""
    return predict(docs, train(docs, max_rows)).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return language_id(load(spark, sf_dir, "documents"))
