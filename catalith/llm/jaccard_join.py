"""Exact Jaccard self-join of word-shingle sets by a token-group matrix.

Documents link when num-in-common * 100 >= percent * size-of-union. The join

1. counts, for every document, how many of its shingles occur in any other
   document. A set misses at most n - o of its n shingles in a partner (o: the
   overlap that the threshold asks for), so a document stays only if at most
   that many of the shingles it asks about are its own alone. Long sets ask only
   about a fixed lower part of the hash range, which every set sends; small ones
   ask about all, which every set of a size within reach sends. So no link is
   lost. Shingles travel sorted and packed by hash range;
2. keeps one document of each group of equal sets and fetches the whole sets of
   those that are left;
3. counts their shingles (see counting) and partitions them into groups of
   similar documents, by the most frequent shingle of each: the copies of a text
   share it, whatever else they changed. Groups are cut into blocks of bounded
   size; the matrix holds shingles against blocks. From rare to frequent, a
   document asks a block only if one of the rarest shingles that it needs (prefix
   filter) is in the block's column;
4. links the members of each block with each other, and then one leader of each
   class so far with the other leaders of its group, as long as that halves their
   number. So a group of thousands of copies becomes one class by comparing its
   members with one of them, not with each other;
5. sends each document to the blocks that hold a shingle of its prefix in a set of
   another class. There the number of its shingles in the block's union bounds its
   overlap with every member; only blocks that reach the bound are opened, and
   members of other classes are compared exactly. So no link between classes is
   lost, and a task reports links that join classes, not all pairs;
6. joins links to classes by large-star and small-star rounds.

Hot blocks are shared among tasks by splitting who asks them; hot shingles are
combined within each batch before they are sent.

Defined results: null, empty and blank texts have an empty set, link with
nothing and are their own class; fewer words than k make one shingle; repeated
rows give repeated result rows; if one doc_id has several texts they are one
node; rows with a null doc_id are returned with a null class and link with
nothing; extra columns are ignored; an empty table gives no rows. Shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from catalith.llm import counting, text as T
from catalith.llm.common import cut, id_range, load

#: Sets up to SMALL ask about every shingle, longer ones about those in the lowest SENT of the
#: hash range. Sets that may be partners of small ones send every shingle too.
SMALL, SENT = 64, 0.3
#: Bytes of text for each range of shingle hashes; shingles of a chunk and of a block; members of a block; documents that ask a block in one task.
RANGE_BYTES, CHUNK, BLOCK, ASKING = 8 << 20, 1 << 20, 512, 1024
EVERY = 0xFFFF


def needed(n: np.ndarray | int, percent: int):
    """The least overlap of a set of n with any set that it links with."""
    return -(-n * percent // 100)


def set_digest(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits of each set, zero for an empty one."""
    out = np.zeros((len(bounds) - 1, 2), T.U)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        for j, salt in enumerate((0x1234567, 0x89ABCDEF01)):
            out[full, j] = np.add.reduceat(T.mix(found ^ T.U(salt)), bounds[full])
    return out


def _sent(k: int, percent: int, ranges: int):
    """Batches to rows (origin, range, a, b). range below 0: ids and set digests, and set
    size, shingles asked about, those already known to be shared; else: packed shingles,
    and the row of the batch that asks about each (EVERY: settled here already, or nobody
    asks). An origin is a place in the input, the same whenever a task is run again."""
    schema = pa.schema([("origin", pa.int64()), ("range", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])

    def one(origin: int, ids: np.ndarray, valid: np.ndarray, raw: np.ndarray, offsets: np.ndarray):
        found, bounds = T.shingle_sets(raw, offsets, k)
        n = np.diff(bounds)
        digest = set_digest(found, bounds)
        row = np.repeat(np.arange(len(n)), n)
        low = found < T.U(int(SENT * 2.0**64))
        keep = ((n[row] <= SMALL * 100 // percent + 1) | low) & valid[row]
        found, row, own = found[keep], row[keep], ((n[row] <= SMALL) | low)[keep]
        sent = np.bincount(row[own], minlength=len(n))
        order = np.argsort(found, kind="stable")
        found, row, own = found[order], row[order], own[order]
        first = np.ones(len(found), bool)
        first[1:] = found[1:] != found[:-1]
        at = np.flatnonzero(first)
        times = np.diff(np.append(at, len(found)))
        shared = np.bincount(row[np.repeat(times > 1, times) & own], minlength=len(n))
        keys, who = found[at], np.where((times > 1) | ~own[at], EVERY, row[at]).astype("<u2")
        yield origin, -1 - origin % ranges, ids.astype("<i8").tobytes() + valid.astype(np.uint8).tobytes() + digest.tobytes(), np.stack((n, sent, shared)).astype("<i4").tobytes()
        for r, lo, hi in counting.runs(_range(keys, ranges)):
            yield origin, r, T.pack_sorted(keys[lo:hi]), who[lo:hi].tobytes()

    def each(batches):
        origin = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            ids = batch.column(0)
            valid = np.asarray(ids.is_valid())
            ids = np.asarray(ids.fill_null(0)).astype(np.int64)
            raw, offsets = T.flat(batch.column(1))
            for lo, hi in T.slices(offsets, 4 * T.SLICE):
                for at in range(lo, hi, 30_000):
                    to = min(hi, at + 30_000)
                    origin += 1
                    rows = list(one(origin, ids[at:to], valid[at:to], raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
                    for some in range(0, len(rows), 256):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[some : some + 256], strict=True), schema, strict=True)], schema=schema)

    return each


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges in the order of the keys; the lower part of the range holds more of them."""
    low = int(SENT * 2.0**64)
    split = max(1, ranges * 3 // 4)
    a = (keys.astype(np.float64) / low * split).astype(np.int64)
    b = split + ((keys.astype(np.float64) - low) / (2.0**64 - low) * (ranges - split)).astype(np.int64)
    return np.minimum(np.where(keys < T.U(low), np.minimum(a, split - 1), b), ranges - 1)


def _shared(table: pa.Table) -> pa.Table:
    """One range of hashes: for each origin, how many of each row's shingles others have
    too. Rows of ranges below 0 pass."""
    origins = np.asarray(table.column("origin"))
    out = []
    if table.column("range")[0].as_py() < 0:
        out = list(zip(origins.tolist(), [True] * len(origins), table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True))
    else:
        keys = [T.unpack_sorted(x) for x in table.column("a").to_pylist()]
        who = np.concatenate(T.arrays(table.column("b"), "<u2"))
        source = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[order][1:] == keys[order][:-1]
        hit = order[same[1:] | same[:-1]]
        hit = hit[who[hit] != EVERY]
        hit = hit[np.argsort(source[hit], kind="stable")]
        source, who = source[hit], who[hit]
        for s in np.unique(source):
            lo, hi = np.searchsorted(source, (s, s + 1))
            out.append((int(origins[s]), False, b"", zlib.compress(np.bincount(who[lo:hi]).astype("<u4").tobytes(), 1)))
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], names=["origin", "head", "a", "b"])


def _left(percent: int):
    def each(table: pa.Table) -> pa.Table:
        """One origin: its rows, and which of them may still have a partner."""
        more = []
        for head, a, b in zip(table.column("head").to_pylist(), table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
            if head:
                n = len(a) // 25
                ids, valid, digest = np.frombuffer(a, "<i8", n), np.frombuffer(a, np.uint8, n, 8 * n), np.frombuffer(a, "<u8", 2 * n, 9 * n)
                size, sent, shared = (x.astype(np.int64) for x in np.frombuffer(b, "<i4").reshape(3, -1))
            else:
                more.append(np.frombuffer(zlib.decompress(b), "<u4"))
        for x in more:
            shared[: len(x)] += x
        left = (sent - shared <= size - needed(size, percent)) & (size > 0) & (valid > 0)
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=valid == 0), "n_shingles": pa.array(size, pa.int64()), "same": T.blobs(digest, np.arange(n + 1) * 2), "left": pa.array(left)})

    return each


def _sets(k: int):
    """(doc_id, text, same) to (node, doc_id, n, tokens): the sets whose digest is wanted of
    the id."""
    names = ["node", "doc_id", "n", "tokens"]

    def each(batches):
        seen: set[int] = set()  # repeated rows count once
        for batch in batches:
            ids, wanted = batch.column(0), np.array(batch.column(2).to_pylist(), object)
            raw, offsets = T.flat(batch.column(1))
            for lo, hi in T.slices(offsets):
                found, bounds = T.shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                digest = set_digest(found, bounds)
                full = np.flatnonzero((np.diff(bounds) > 0) & (np.array([x.tobytes() for x in digest], object) == wanted[lo:hi]))
                if not len(full):
                    continue
                mine = np.asarray(ids.slice(lo, hi - lo).take(pa.array(full)).cast(pa.int64()))
                node = T.mix(mine.view(T.U) + T.mix(digest[full, 0] ^ T.mix(digest[full, 1])))
                new = [i for i, x in enumerate(node.tolist()) if not (x in seen or seen.add(x))]
                if not new:
                    continue
                full, mine, node = full[new], pa.array(mine[new]), node[new]
                parts = [found[bounds[i] : bounds[i + 1]] for i in full]
                sizes = np.array([len(x) for x in parts])
                found, starts = np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), mine, pa.array(sizes, pa.int64()), T.blobs(found, starts)], names=names)

    return each


def _ask(ranges: int):
    def each(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = np.unique(np.concatenate(T.arrays(table.column("tokens").combine_chunks(), "<u8")), return_counts=True)
        return pa.Table.from_batches([counting.asks(key[0].as_py(), {1: (keys, counts)}, ranges)])

    return each


def _prefix(percent: int):
    def each(key, table: pa.Table, given: pa.Table) -> pa.Table:
        """The rarest shared shingles of each set that a partner has to have one of, and the
        most frequent one, which names its group."""
        nodes, homes, sizes, out = [], [], [], []
        if table.num_rows:
            sets = T.arrays(table.column("tokens").combine_chunks(), "<u8")
            counts, keys = counting.read(given, 1), np.unique(np.concatenate(sets))
            for node, mine in zip(table.column("node").to_pylist(), sets, strict=True):
                c = counts[np.searchsorted(keys, mine)]
                shared = np.flatnonzero(c > 1)
                many = len(shared) - needed(len(mine), percent) + 1
                if many > 0:
                    ordered = mine[shared[np.lexsort((mine[shared], c[shared]))]]
                    out.append(ordered[:many])
                    nodes += [node] * many
                    homes += [int(ordered[-1].view(np.int64))] * many
                    sizes += [len(mine)] * many
        return pa.table({"node": pa.array(nodes, pa.int64()), "home": pa.array(homes, pa.int64()), "n": pa.array(sizes, pa.int64()), "token": pa.array(np.concatenate(out).view(np.int64) if out else [], pa.int64())})

    return each


def _find(root: dict[int, int], x: int) -> int:
    while root.setdefault(x, x) != x:
        root[x] = x = root[root[x]]
    return x


class _Union:
    """A block's matrix column: its members' shingles, with who holds each."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]

    def linked(self, mine: np.ndarray, percent: int) -> np.ndarray:
        """Members that link with a set; none where the union has too few of its shingles."""
        lo, hi = np.searchsorted(self.tokens, mine, "left"), np.searchsorted(self.tokens, mine, "right")
        hit = hi > lo
        if hit.sum() < needed(len(mine), percent):
            return np.zeros(0, np.int64)
        lo, times = lo[hit], (hi - lo)[hit]
        at = np.arange(times.sum()) + np.repeat(lo - np.cumsum(times) + times, times)
        common = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= percent * (self.sizes + len(mine) - common))


STATE = ("node", "doc_id", "home", "n", "crowd", "cuts", "block")


def _within(percent: int):
    def each(table: pa.Table) -> pa.Table:
        """One block (STATE and tokens): a class for each member, named by the smallest node it
        reaches within the block. The first member asks all; then all ask but those of the
        largest class so far: of two members in different classes one has asked the other."""
        nodes, first = np.unique(np.asarray(table.column("node")), return_index=True)
        table = table.take(pa.array(first))
        sets = T.arrays(table.column("tokens").combine_chunks(), "<u8")
        union, cls, largest = _Union(sets), np.arange(len(nodes)), 0
        for i in range(len(nodes)):
            if i == 0 or cls[i] != largest:
                for c in np.unique(cls[union.linked(sets[i], percent)]):
                    low, high = sorted((cls[i], c))
                    if i and high == largest:
                        largest = low
                    cls[cls == high] = low
            if i == 0:
                largest = np.bincount(cls).argmax()
        more = {"class": pa.array(nodes[cls]), "class_id": table.column("doc_id").take(pa.array(cls))}
        return pa.table({c: table.column(c) for c in STATE} | more)

    return each


def _open(percent: int):
    def each(table: pa.Table) -> pa.Table:
        """One block, or a share of those who ask it: bound each asking document's overlap
        by the block's union; compare with the members where the bound allows a link;
        return links between classes."""
        out: list[tuple[int, int]] = []
        asks = np.asarray(table.column("asks").combine_chunks())
        classes, sets = np.asarray(table.column("class_id")), T.arrays(table.column("tokens").combine_chunks(), "<u8")
        within, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
        if len(within) and len(asking):
            union, members, root = _Union([sets[i] for i in within]), classes[within], {}
            for i in asking:
                mine = int(classes[i])
                for other in np.unique(members[union.linked(sets[i], percent)]).tolist():
                    a, b = _find(root, mine), _find(root, other)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((mine, other))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return each


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links to (id, root), root the smallest id reachable; only linked ids occur.
    Large-star and small-star rounds until nothing changes; each is cut in the shared folder."""
    edges = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root").unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        state = now
    raise RuntimeError("components did not settle")


def links(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, n_shingles, same; sets: same, n_shingles, keep; links: a, b). `sets` has
    every set that may link or repeat, with its smallest id. Links are between those ids;
    they are enough to find the classes of near-duplicates, not all pairs."""
    ranges = id_range(docs, "text", RANGE_BYTES)
    sent = docs.select("doc_id", "text").mapInArrow(_sent(k, percent, ranges), "origin long, range int, a binary, b binary")
    counts = sent.groupBy("range").applyInArrow(_shared, "origin long, head boolean, a binary, b binary")
    rows = cut(counts.groupBy("origin").applyInArrow(_left(percent), "doc_id long, n_shingles long, same binary, left boolean"))

    left = rows.where("left").select("same", "n_shingles", "doc_id")
    first = cut(left.groupBy("same", "n_shingles").agg(F.min("doc_id").alias("keep")))
    wanted = first.select(F.col("keep").alias("doc_id"), "same")
    sets = docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "same")
    sets = cut(sets.mapInArrow(_sets(k), "node long, doc_id long, n long, tokens binary"))

    chunks = -(-(sets.agg(F.sum("n")).first()[0] or 1) // CHUNK)
    dealt = sets.select(F.pmod("node", F.lit(chunks)).alias("chunk"), "node", "tokens")
    given = counting.answers(dealt.groupBy("chunk").applyInArrow(_ask(chunks), counting.ASK)).where("chunk >= 0").select(F.col("chunk").alias("of"), "kind", "range", "counts")
    prefix = cut(dealt.groupBy("chunk").cogroup(given.groupBy("of")).applyInArrow(_prefix(percent), "node long, home long, n long, token long"))

    classes = grouped(prefix.select("node", "home", "n").distinct(), sets, percent)
    # Only sets of one class beside sets of a smaller one are asked about: one direction is enough.
    tokens = prefix.select("node", "token").join(classes.select("node", "block", "class", "class_id"), "node")
    several = tokens.groupBy("token").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most").select("token", "least")
    beside = cut(tokens.join(several, "token"))
    columns = beside.groupBy("token", F.col("block").alias("at")).agg(F.min("class").alias("there"))
    asks = beside.where("class > least").select("node", "class", "class_id", "token").join(columns, "token").where("there < class").select("node", "at", "class_id").distinct()
    busy = asks.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / ASKING).alias("shares"))
    asks = cut(asks.join(busy, "at").select("node", "class_id", "at", F.pmod(F.xxhash64("node"), F.col("shares")).alias("share"), F.lit(True).alias("asks")))
    opened = classes.select("node", "class_id", F.col("block").alias("at")).join(asks.select("at", "share").distinct(), "at").select("node", "class_id", "at", "share", F.lit(False).alias("asks"))
    sent = sets.select("node", "tokens").join(asks.unionByName(opened), "node").select("at", "share", "asks", "class_id", "tokens")
    across = sent.groupBy("at", "share").applyInArrow(_open(percent), "a long, b long")
    inside = classes.where("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    return rows.select("doc_id", "n_shingles", "same"), first, across.unionByName(inside)


def grouped(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, home, n) to node, doc_id, block, class and class_id: groups cut into blocks, and
    the classes that the blocks' members and then their leaders form among themselves. A class
    is named by its smallest node, which leads it; class_id is that node's document."""
    size = [F.count(F.lit(1)).alias("crowd"), F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / CHUNK)).alias("cuts")]
    block = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("cuts"))).alias("block")
    schema = ", ".join(f"{c} long" for c in (*STATE, "class", "class_id"))

    def compared(members: DataFrame) -> DataFrame:
        """One more level: members (node, home, n, crowd, cuts) to STATE, class and class_id."""
        full = sets.join(members.select("node", "home", "crowd", "cuts", block), "node").select(*STATE, "tokens")
        return cut(full.groupBy("block").applyInArrow(_within(percent), schema))

    level = compared(nodes.join(nodes.groupBy("home").agg(*size), "home"))
    state = level.select("node", "doc_id", "block", "class", "class_id")
    while True:
        leaders = level.where("node = class")
        led = leaders.groupBy("home").agg(F.max("crowd").alias("was"), F.max("cuts").alias("parts"), *size).where("parts > 1 AND crowd > 1 AND 2 * crowd <= was")
        again = cut(leaders.select("node", "home", "n").join(led.select("home", "crowd", "cuts"), "home"))
        many = again.agg(F.max("cuts")).first()[0]
        if many is None:
            return state
        level = compared(again)
        moved = level.where("node <> class").select(F.col("node").alias("class"), F.col("class").alias("to"), F.col("class_id").alias("to_id"))
        state = state.join(moved, "class", "left").select("node", "doc_id", "block", F.coalesce("to", "class").alias("class"), F.coalesce("to_id", "class_id").alias("class_id"))
        if many == 1:
            return cut(state)


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id. Roots go to the distinct
    sets first; then the rows of equal sets, which may be very many, are joined once, on
    narrow columns that AQE can split."""
    rows, sets, found = links(docs, k, percent)
    roots = components(found)
    named = cut(sets.join(roots.withColumnRenamed("id", "keep"), "keep", "left").select("same", "n_shingles", F.coalesce("root", "keep").alias("class")))
    out = rows.join(named, ["same", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, whose id is the smallest of its class; rows with a null
    id stay. Only ids that go are joined to the texts."""
    go = jaccard_classes(docs, k, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(go.withColumnRenamed("doc_id", "go").hint("shuffle_hash"), docs["doc_id"] == F.col("go"), "left_anti")


#: The SQL compares all pairs that share a shingle; it is meant for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS x FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT l.b, reach.r FROM reach JOIN both_ways l ON l.a = reach.a
), root AS (
  SELECT a, min(r) AS r FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, root.r AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN root ON root.a = d.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(load(spark, sf_dir, "documents"), k=4, percent=85)
