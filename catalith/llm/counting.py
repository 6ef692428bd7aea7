"""Corpus-wide counts of hashed keys, asked for by chunks of documents.

A chunk asks for each distinct key it holds, and brings how often its own
documents have it. Its documents may ask from several tasks. Keys are sorted,
packed and dealt by hash range; a range adds up what all bring and answers each
chunk in the order of its distinct keys, so answers need no keys. A key that a
third of all documents hold still comes once from each task and chunk, never row
by row.
"""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from catalith.llm import text as T

ASK = "kind int, range int, chunk long, keys binary, counts binary"
ANSWER = "kind int, range int, chunk long, counts binary, total long, distinct long"


def chunk_of(names: tuple[str, ...], chunks: int) -> Column:
    """By all columns named, so that neither many rows of one (or no) id nor many copies of a
    text are one chunk."""
    return F.pmod(F.xxhash64(*names), F.lit(chunks))


def pack(counts: np.ndarray) -> bytes:
    """Counts of four bytes each, or of eight where one is too large for four; the first byte tells."""
    size = b"4" if counts.max(initial=0) < 1 << 32 else b"8"
    return size + zlib.compress(counts.astype(b"<u" + size).tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), b"<u" + packed[:1]).astype(np.int64)


def asks(chunk: int, by_kind: dict[int, tuple[np.ndarray, np.ndarray]], ranges: int) -> pa.RecordBatch:
    """by_kind: sorted distinct 64-bit keys (any kind but 1 may leave low bits 0) and own counts."""
    rows = []
    for kind, (keys, counts) in by_kind.items():
        low = T.U(0 if kind == 1 else 16)
        for r, lo, hi in runs((keys >> T.U(32)) * T.U(ranges) >> T.U(32)):
            rows.append((kind, r, chunk, T.pack_sorted(keys[lo:hi] >> low), pack(counts[lo:hi])))
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=["kind", "range", "chunk", "keys", "counts"])


def runs(values: np.ndarray):
    """(value, start, end) of each run of equal values in an ascending array."""
    if len(values):
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield int(values[lo]), lo, hi


def _answer(table: pa.Table) -> pa.Table:
    """One range: totals of every key, dealt back to who asked."""
    kinds = np.asarray(table.column("kind"))
    where, chunk = table.column("range")[0].as_py(), table.column("chunk").to_pylist()
    keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
    rows = []
    for kind in np.unique(kinds).tolist():
        at = sorted(np.flatnonzero(kinds == kind).tolist(), key=lambda i: chunk[i])
        mine = [T.unpack_sorted(keys[i]) for i in at]
        one, back = np.unique(np.concatenate(mine), return_inverse=True)
        total = np.bincount(back, np.concatenate([unpack(counts[i]) for i in at]), len(one)).astype(np.int64)
        bounds = np.cumsum([0, *map(len, mine)])
        for c, rows_of in groupby(range(len(at)), key=lambda j: chunk[at[j]]):
            rows_of = list(rows_of)
            asked = back[bounds[rows_of[0]] : bounds[rows_of[-1] + 1]]
            rows.append((kind, where, c, pack(total[np.unique(asked) if len(rows_of) > 1 else asked]), 0, 0))
        rows.append((kind, where, -1, b"", int(total.sum()), int((total > 0).sum())))
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=["kind", "range", "chunk", "counts", "total", "distinct"])


def answers(asked: DataFrame) -> DataFrame:
    """Rows of ANSWER; chunk -1 has the range's total and number of distinct counted keys."""
    return asked.groupBy("range").applyInArrow(_answer, ANSWER)


def read(table: pa.Table, kind: int) -> np.ndarray:
    """A chunk's answers of one kind, in the order of its sorted distinct keys."""
    rows = sorted((r, c) for k, r, c in zip(table.column("kind").to_pylist(), table.column("range").to_pylist(), table.column("counts").to_pylist(), strict=True) if k == kind)
    return np.concatenate([unpack(c) for _, c in rows]) if rows else np.zeros(0, np.int64)
