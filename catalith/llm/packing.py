"""Packing token sequences into fixed windows by minimum bin slack.

Each task tokenises its documents and packs them in batches of about
`batch_tokens` ids, so its memory is bounded and nothing is shuffled. Long
documents first give whole windows. The lengths that remain form a multiset;
for each window the longest of them is set and a bitset subset-sum program over
the others finds the sum closest to the rest of the capacity, with backtracked
counts. A window that no multiset closes is closed by cutting a document. What
a batch leaves over goes into windows of powers of two, which need no padding.

Tokens are those of whole texts: words between ASCII white space are tokenised
apart (the tokenizer never joins what white space parts) and looked up in a
table of bounded size. The tokenizer lower-cases, so words are looked up in lower
case; words that hold one of its added tokens in any case are not, as it takes
those only as they are spelt.

Defined results: null and empty texts are the end id alone; rows with a null id
are packed like others; repeated rows are packed one by one; extra columns are
ignored; an empty table gives no rows. sequence_id is unique but not gapless.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from catalith.llm import text as T
from catalith.llm.common import load

WINDOW, END_ID, BATCH_TOKENS, REMEMBER = 4096, 2, 2_000_000, 800_000
#: Punctuation (but no apostrophe, which may begin a contraction) that closes a word after an
#: ASCII letter or digit or a Latin-1 letter.
CLOSED = re.compile(rb"([!-&(-/:-@\[-`{-~](?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-&(-/:-@\[-`{-~]*)(?=[\x20\x09-\x0D]|\Z)")
BAR = "|"


class Words:
    """Ids of texts by way of their words; remembers up to `remember` words, in two halves: when
    the newer one is full, the older one goes. A word is looked up lower-cased in A-Z and
    without the punctuation that closes it, which the tokenizer splits off in any case."""

    def __init__(self, path: str, remember: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.half = (REMEMBER if remember is None else remember) // 2
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.bar = self._encode([BAR])[0]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not among the newer half, which takes them in."""
        found = {w: self.older[w] for w in words & self.older.keys()}
        unseen = list(words.difference(found))
        for at in range(0, len(unseen), 256):
            found.update(self._learn(unseen[at : at + 256]))
        if len(self.known) + len(found) > self.half:
            self.older, self.known = self.known, {}
        if len(found) <= self.half:
            self.known.update(found)
        return found

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words are tokenised many at a time, a bar after each; those that hold a bar or an
        added token, one by one."""
        apart = [w for w in words if b"|" in w]
        plain = [w for w in words if b"|" not in w] if apart else words
        ids = self._encode([" ".join(f"{w.decode('utf-8', 'replace')} {BAR}" for w in plain)])[0] if plain else self.bar[:0]
        ends = np.flatnonzero(ids == self.bar[0]).tolist()
        if len(self.bar) != 1 or len(ends) != len(plain):  # not a tokenizer that keeps bars apart
            apart, plain = words, []
        raw, starts = ids.tobytes(), [0, *(x + 1 for x in ends)]
        out = {w: raw[4 * a : 4 * b] for w, a, b in zip(plain, starts, ends, strict=False)}
        out.update((w, x.tobytes()) for w, x in zip(apart, self._encode([w.decode("utf-8", "replace") for w in apart]), strict=True))
        return out

    def _split(self, raw: bytes) -> list[bytes]:
        low = raw.lower()
        if any(token in low for token in self.added):  # rare: word by word
            return [x for w in raw.split() for x in ([w] if any(token in w.lower() for token in self.added) else CLOSED.sub(rb" \1", w.lower()).split())]
        return CLOSED.sub(rb" \1", low).split()

    def ids(self, texts: list[bytes], end: bytes) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, and the end id."""
        words = [self._split(x) for x in texts]
        found = [list(map(self.known.get, x)) for x in words]
        missing = {w for x, y in zip(words, found, strict=True) if None in y for w, one in zip(x, y, strict=True) if one is None}
        new = self.learn(missing) if missing else {}
        return [b"".join([new[w] if one is None else one for w, one in zip(x, y, strict=True)] if missing else y) + end for x, y in zip(words, found, strict=True)]


@lru_cache(maxsize=2)
def _words(path: str, remember: int) -> Words:
    """One table of words for each tokenizer and worker process; tasks of a worker share it."""
    return Words(path, remember)


def fill(lengths: dict[int, int], capacity: int) -> tuple[dict[int, int], int]:
    """The multiset of lengths (length: how many there are) whose sum comes closest to
    capacity without passing it, as counts to take, and the slack that stays."""
    reach, stack, full = 1, [], 1 << capacity
    mask = (full << 1) - 1
    for length in sorted((x for x, n in lengths.items() if n and x <= capacity), reverse=True):
        stack.append((length, reach))
        for _ in range(min(lengths[length], capacity // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            reach = more
            if reach & full:
                break
        if reach & full:
            break
    best = target = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, before in reversed(stack):
        while not before >> target & 1:
            taken[length] = taken.get(length, 0) + 1
            target -= length
    return taken, capacity - best


def windows(sizes: list[int], capacity: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every id once."""
    rest: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length: documents and starts
    for doc, size in enumerate(sizes):
        whole = size // capacity * capacity
        for at in range(0, whole, capacity):
            yield [(doc, at, capacity)]
        if size > whole:
            rest[size - whole].append((doc, whole))
    left = sum(length * len(x) for length, x in rest.items())

    def take(length: int) -> tuple[int, int, int]:
        doc, at = rest[length].pop()
        if not rest[length]:
            del rest[length]
        return doc, at, length

    while left >= capacity:
        out = [take(max(rest))]
        taken, slack = fill({x: len(y) for x, y in rest.items()}, capacity - out[0][2])
        out += [take(length) for length, n in taken.items() for _ in range(n)]
        if slack:  # every shorter length is in: cut the shortest that is left
            doc, at, length = take(min(rest))
            out.append((doc, at, slack))
            rest[length - slack].append((doc, at + slack))
        left -= capacity
        yield out
    pieces = [take(length) for length in sorted(rest, reverse=True) for _ in range(len(rest[length]))]
    size = capacity
    while pieces:
        while size > left:
            size //= 2
        out, room = [], size
        while room:
            doc, at, length = pieces.pop(0)
            if length > room:
                pieces.insert(0, (doc, at + room, length - room))
                length = room
            out.append((doc, at, length))
            room -= length
        left -= size
        yield out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", batch_tokens: int = BATCH_TOKENS, remember: int = REMEMBER) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Each worker process remembers up to `remember` words, of some 150 bytes each."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def each(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        words, end = _words(tokenizer, remember), np.array([END_ID], "<u4").tobytes()
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        kinds = [to_arrow_type(docs_type)] + [pa.int64()] * 6

        def packed(ids: list, texts: list[bytes]):
            nonlocal number
            sizes, rows = [len(x) // 4 for x in texts], []
            for pieces in windows(sizes):
                offset = 0
                for doc, at, length in pieces:
                    rows.append((ids[doc], at, length, zlib.crc32(memoryview(texts[doc])[4 * at : 4 * (at + length)]), sizes[doc], number, offset))
                    offset += length
                number += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        ids, texts, held = [], [], 0
        for batch in batches:
            raw, offsets = T.flat(batch.column(1))
            data = raw.tobytes()
            for lo, hi in T.slices(offsets):
                coded = words.ids([data[offsets[i] : offsets[i + 1]] for i in range(lo, hi)], end)
                for one, text in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), coded, strict=True):
                    texts.append(text)
                    ids.append(one)
                    held += len(text) // 4
                    if held >= batch_tokens:
                        yield from packed(ids, texts)
                        ids, texts, held = [], [], 0
        yield from packed(ids, texts)

    docs_type = docs.schema[id_col].dataType
    return docs.select(id_col, text_col).mapInArrow(each, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), tokenizer_path())
