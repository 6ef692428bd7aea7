"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased in A-Z. Benchmark items are
read in blocks of bounded size; each block is indexed by the Karp-Rabin hashes
of its runs of MIN_MATCH words and sent to a scan of all documents. Where a
document shares enough of an item's hashes to reach the threshold, tiles are
laid: the longest common run of unmarked words is marked in both, again and
again, until none of MIN_MATCH words is left. An item is leaked when its tiles
cover at least `threshold` of its words, in whatever order they stand.

Defined results: items of fewer than MIN_MATCH words can't be tested and leak
nowhere; null texts are empty; rows with a null doc_id are tested like others;
items with a null id are reported with a null item_id; repeated rows of either
table are tested one by one; extra columns are ignored; an empty table on either
side gives no rows.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalith.llm import text as T
from catalith.llm.common import id_range, load

MIN_MATCH, BLOCK_BYTES = 5, 8 << 20
#: Pairs of equal hashes that are held at once.
PIECE = 1 << 20
OUT = "doc_id long, item_id long, item_words long, covered_words long, tiles long, coverage double"


def tiles(runs: list[tuple[int, int, int]], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling from maximal common runs (start in document, start in item,
    words): the longest unmarked one first, ties by the earlier start in the item, then in
    the document."""
    heap = [(-n, q, p) for p, q, n in runs]
    heapq.heapify(heap)
    in_doc, in_item, out = set(), bytearray(max((q + n for _, q, n in runs), default=0)), []
    while heap:
        n, q, p = heapq.heappop(heap)
        n = -n
        if in_item.find(0, q, q + n) < 0:
            continue
        free = [not in_item[q + i] and p + i not in in_doc for i in range(n)]
        if all(free):
            in_doc.update(range(p, p + n))
            in_item[q : q + n] = b"\1" * n
            out.append((p, q, n))
            continue
        at = 0
        while at < n:  # what is left of a run that is marked in part comes back as shorter runs
            to = at
            while to < n and free[to]:
                to += 1
            if to - at >= least:
                heapq.heappush(heap, (at - to, q + at, p + at))
            at = to + 1
    return out


def common_runs(doc_at: np.ndarray, doc_key: np.ndarray, item_at: np.ndarray, item_key: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Maximal common runs of a document (places ascending) and an item (keys ascending) from
    the keys of their runs of `least` words. Equal keys are paired PIECE pairs at a time, and
    neighbours on one diagonal join, across pieces too, so that memory does not follow the
    product of repeated places.

    Of runs of n words at one place of the item, only the first words + (words / least) (n - 1)
    + 1 in the document are kept (words: those of the item). Tiles mark no more words than the
    item has, so they touch fewer of these runs than that: one is untouched at any time, comes
    before all that are left out, and is laid before any part of them."""
    left = np.searchsorted(item_key, doc_key, "left")
    times = np.searchsorted(item_key, doc_key, "right") - left
    some = np.flatnonzero(times)
    if not len(some):
        return []
    doc_at, left, times = doc_at[some], left[some], times[some]
    shift, width = int(item_at.max()), int(doc_at[-1]) + 2
    words = shift + least

    def first_of_each(start, size):
        p, n = start % width, size + least - 1
        q = p + shift - start // width
        order = np.lexsort((p, q, n))
        same = (n[order][1:] == n[order][:-1]) & (q[order][1:] == q[order][:-1])
        head = np.flatnonzero(np.append(True, ~same))
        rank = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
        kept = order[rank < words + words // least * (n[order] - 1) + 1]
        return start[kept], size[kept]

    done = going = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # diagonal * width + place, hits
    for lo, hi in T.slices(np.concatenate(([0], np.cumsum(times))), PIECE):
        n = times[lo:hi]
        hit = np.repeat(left[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(doc_at[lo:hi], n)
        key = np.sort((at - item_at[hit] + shift) * width + at)
        first = np.flatnonzero(np.diff(key, prepend=-2) != 1)
        start = np.concatenate((going[0], key[first]))
        order = np.argsort(start, kind="stable")
        start, size = start[order], np.concatenate((going[1], np.diff(np.append(first, len(key)))))[order]
        first = np.flatnonzero(np.append(True, start[1:] != start[:-1] + size[:-1]))
        start, size = start[first], np.add.reduceat(size, first)
        last = start % width + size > doc_at[hi - 1]  # may go on in the next piece
        going = start[last], size[last]
        done = tuple(np.concatenate((x, y[~last])) for x, y in zip(done, (start, size), strict=True))
        if len(done[0]) > PIECE:
            done = first_of_each(*done)
    start, size = first_of_each(*(np.concatenate(x) for x in zip(done, going, strict=True)))
    p = start % width
    return list(zip(p.tolist(), (p + shift - start // width).tolist(), (size + least - 1).tolist(), strict=True))


def index(items: pa.Table) -> dict:
    """A block's distinct hashes of runs of words; for each its places (item, place), and for
    each item its places by hash. `times`: how many rows of the benchmark an item stands for."""
    raw, offsets = T.flat(items.column("text"))
    hashes, row, _, _ = T.words(raw, offsets, T.PLAIN)
    found, at = T.grams(hashes, row, MIN_MATCH)
    size = np.bincount(row, minlength=items.num_rows)
    item, place = row[at], at - np.concatenate(([0], np.cumsum(size)))[row[at]]
    one, key = np.unique(found, return_inverse=True)
    order, own = np.argsort(key, kind="stable"), np.lexsort((place, key, item))
    return {
        "hash": one, "bounds": np.searchsorted(key[order], np.arange(len(one) + 1)), "item": item[order], "place": place[order],
        "own": np.searchsorted(item[own], np.arange(items.num_rows + 1)), "own_key": key[own], "own_place": place[own],
        "size": size, "ids": items.column("item_id").to_pylist(), "times": items.column("times").to_pylist(),
    }


def _candidates(block: dict, owner: np.ndarray, key: np.ndarray, threshold: float):
    """(row, item) where the hashes that both have could cover enough of the item. Each
    distinct hash of a row meets its places in the block, about PIECE at a time; no row has
    more of them than the block has places."""
    size, bounds = block["size"], block["bounds"]
    width = int(size.max()) + 1
    has = np.unique(owner * len(block["hash"]) + key)
    owner, key = has // len(block["hash"]), has % len(block["hash"])
    times = bounds[key + 1] - bounds[key]
    rows = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
    for a, b in T.slices(np.concatenate(([0], np.cumsum(times)))[rows], PIECE):
        part = slice(rows[a], rows[b])
        n = times[part]
        hit = np.repeat(bounds[key[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        spot = np.sort((np.repeat(owner[part], n) * len(size) + block["item"][hit]) * width + block["place"][hit])
        pair, where = spot // width, spot % width
        step = np.full(len(spot), MIN_MATCH)
        same = pair[1:] == pair[:-1]
        step[:-1][same] = np.minimum(MIN_MATCH, np.diff(where)[same])
        pairs, first = np.unique(pair, return_index=True)
        most = np.add.reduceat(step, first)  # no more of the item can be covered
        yield from (divmod(x, len(size)) for x in pairs[most >= threshold * size[pairs % len(size)]].tolist())


def _leaks_of(block: dict, threshold: float, column: pa.Array):
    """(row, item, covered words, tiles) of every item of the block that a row leaks."""
    raw, offsets = T.flat(column)
    for lo, hi in T.slices(offsets) if len(block["hash"]) else ():
        hashes, row, _, _ = T.words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], T.PLAIN)
        found, at = T.grams(hashes, row, MIN_MATCH)
        key = np.minimum(np.searchsorted(block["hash"], found), len(block["hash"]) - 1)
        near = np.flatnonzero(block["hash"][key] == found)
        if not len(near):
            continue
        key, at, owner = key[near], at[near], row[at[near]]
        for doc, item in _candidates(block, owner, key, threshold):
            a, b = np.searchsorted(owner, [doc, doc + 1])
            mine = slice(*block["own"][item : item + 2])
            laid = tiles(common_runs(at[a:b], key[a:b], block["own_place"][mine], block["own_key"][mine]))
            covered = sum(n for _, _, n in laid)
            if covered >= threshold * block["size"][item]:
                yield lo + doc, item, covered, len(laid)


def _scan(block: dict, threshold: float):
    kinds, names = [pa.int64()] * 5 + [pa.float64()], [x.split()[0] for x in OUT.split(", ")]

    def each(batches):
        for batch in batches:
            docs, rows = batch.column(0), []
            for doc, item, covered, n in _leaks_of(block, threshold, batch.column(1)):
                words = int(block["size"][item])
                rows += [(docs[doc].as_py(), block["ids"][item], words, covered, n, covered / words)] * block["times"][item]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return each


def _keep(block: dict, threshold: float, at: int):
    def each(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[x[0] for x in _leaks_of(block, threshold, batch.column(at))]] = False
            yield batch.filter(pa.array(clean))

    return each


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark's index in blocks of about block_bytes of text; equal rows are one item."""
    items = benchmark.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times"))
    blocks = id_range(items, "text", block_bytes)
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield index(items.where(share == b).toArrow())


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item that it leaks: doc_id, item_id, item_words,
    covered_words, tiles, coverage. Each block of about block_bytes of items is one scan."""
    narrow = docs.select("doc_id", "text")
    return reduce(DataFrame.unionByName, [narrow.mapInArrow(_scan(block, threshold), OUT) for block in _blocks(benchmark, block_bytes)])


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that leak no item: one scan, whatever the number of blocks."""
    for block in _blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(_keep(block, threshold, docs.columns.index("text")), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
