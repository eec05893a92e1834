"""Packing into training sequences by Karmarkar-Karp multiway differencing.

A document longer than a sequence gives whole sequences first; what remains of each document is a *piece*.  Pieces are gathered in rounds and
each round is divided into ``k`` windows by differencing: every piece starts as a partial partition with one filled window, the two partial
partitions with the largest imbalance are merged so that their fullest windows meet the other's emptiest, until one is left.  The windows come
out nearly equal; if the fullest exceeds the capacity, ``k`` rises by one.  Rounds need no exchange: each task packs the documents it reads.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator, Sequence
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from stripline.llm.common import documents, flat, ids, null_ids

CAPACITY = 4096
ROUND = 64 * CAPACITY   # ids packed together
CACHED = 1_000_000      # words whose ids a worker process remembers before it starts anew
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long")


def difference(sizes: Sequence[int], k: int) -> list[list[int]]:
    """Divide item numbers into ``k`` lists of nearly equal total size (largest differencing method, k-way)."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap = []
    lists: dict[int, list] = {}
    for i, n in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = n  # descending
        lists[i] = [(i,)] + [()] * (k - 1)  # nested pairs, flattened at the end
        heap.append((-int(n), i, sums))
    heapq.heapify(heap)
    new = len(sizes)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        total = a + b[::-1]
        order = np.argsort(-total, kind="stable")
        x, y = lists.pop(i), lists.pop(j)
        y.reverse()
        lists[new] = [(x[q], y[q]) if x[q] and y[q] else x[q] or y[q] for q in order.tolist()]
        total = total[order]
        total -= total[-1]
        heapq.heappush(heap, (-int(total[0]), new, total))
        new += 1

    def leaves(node) -> list[int]:
        out, stack = [], [node]
        while stack:
            for x in stack.pop():
                out.append(x) if isinstance(x, int) else stack.append(x)
        return sorted(out)
    return [leaves(x) for x in lists.popitem()[1]] if heap else [[] for _ in range(k)]


def windows(sizes: Sequence[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Nearly equal windows of at most ``capacity``; items are at most ``capacity`` each."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        got = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in got) <= capacity:
            return [w for w in got if w]
        k += 1


#: Classes of ASCII: letters 1, digits 2, marks 3.  Apostrophes begin contractions and <|> special tokens: they, like all else, are 0.
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[48:58] = 2
KIND[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "'<|>"]] = 3
KINDS = KIND.tobytes()
SEPARATOR, SEPARATOR_ID = "<|startoftext|>", 49406
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others by number from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(SHOWN))}
PROBES = "the tokens größe élève мир 日本語 7 *** ... ,- x".split()


def parted(data: bytes) -> bytes:
    """The text with a blank between any two ASCII characters that no token spans: where letters, digits and marks meet, and between digits."""
    buf = np.frombuffer(data, np.uint8)
    if len(buf) < 2:
        return data
    k = KIND[buf]
    gap = (k[1:] != k[:-1]) | (k[1:] == 2)
    gap &= (k[1:] > 0) & (k[:-1] > 0)
    at = np.flatnonzero(gap) + 1
    if not len(at):
        return data
    out = np.empty(len(buf) + len(at), np.uint8)
    blank = at + np.arange(len(at))
    keep = np.ones(len(out), bool)
    keep[blank] = False
    out[blank] = 32
    out[keep] = buf
    return out.tobytes()


class Numbers(dict):
    """Numbers words in the order in which they are first asked for, and lists the new ones."""

    def __init__(self, fresh: list[bytes]):
        self.fresh = fresh

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.fresh.append(word)
        return i


class WordIds:
    """Ids of whole texts, remembering those of the words: no token of the vocabulary crosses ASCII white space."""

    kept: dict[tuple, WordIds] = {}  # one for each worker process and vocabulary
    STOP = b"\xff"  # no UTF-8 text holds it: the word that ends each text

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.separated = self.tokenizer.token_to_id(SEPARATOR) == SEPARATOR_ID
        # whether plain words may go to the model itself, past normalisation and splitting, which leave them as they are
        self.direct = all([t.id for t in self.tokenizer.model.tokenize(self.plain(w.encode()))] == self.tokenizer.encode(w, add_special_tokens=False).ids for w in PROBES)
        self.clear()

    @classmethod
    def of(cls, path: str, end: int) -> WordIds:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        if (path, end) not in cls.kept:
            cls.kept[path, end] = cls(path, end)
        return cls.kept[path, end]

    def clear(self) -> None:
        self.fresh: list[bytes] = []
        self.index = Numbers(self.fresh)
        self.table, self.used = np.zeros(1 << 16, np.uint32), 1
        self.first, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.index[self.STOP], self.table[0], self.count[0] = 0, self.end, 1

    @staticmethod
    def plain(word: bytes) -> str | None:
        """The word in byte-level characters if it is only lower-case letters, only marks or one digit, else None."""
        if word.isascii():
            kinds = set(word.translate(KINDS))
            ok = len(kinds) == 1 and 0 not in kinds and (2 not in kinds or len(word) == 1) and word == word.lower()
            return word.decode() if ok else None
        text = word.decode()
        if text.isalpha() and text == text.lower() and is_normalized("NFC", text):
            return "".join([BYTES[b] for b in word])
        return None

    def all_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has."""
        if not self.direct:
            return self.ids_of(words)
        tokenize = self.tokenizer.model.tokenize
        shown = [self.plain(w) for w in words]
        got = [None if x is None else [t.id for t in tokenize(x)] for x in shown]
        rest = [i for i, x in enumerate(got) if x is None]
        ids, n = self.ids_of([words[i] for i in rest])
        for i, x in zip(rest, np.split(ids, np.cumsum(n)[:-1]) if rest else []):
            got[i] = x.tolist()
        return np.fromiter((i for x in got for i in x), np.uint32), np.array([len(x) for x in got], np.int64)

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has; many words go in one call, a special token between them."""
        mark = SEPARATOR.encode()
        if not self.separated or any(mark in w for w in words):
            got = [self.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]
            return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)
        got = []
        for i in range(0, len(words), 256):
            got += self.tokenizer.encode((mark.join(words[i:i + 256]) + mark).decode(), add_special_tokens=False).ids
        ids = np.array(got, np.uint32)
        ends = np.flatnonzero(ids == SEPARATOR_ID)
        return ids[ids != SEPARATOR_ID], np.diff(ends, prepend=-1) - 1

    def learn(self) -> None:
        ids, n = self.all_ids(self.fresh)
        at, total = len(self.index) - len(n), len(ids)
        while self.used + total > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        while at + len(n) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.table[self.used:self.used + total] = ids
        self.first[at:at + len(n)] = self.used + np.cumsum(n) - n
        self.count[at:at + len(n)] = n
        self.used += total
        self.fresh.clear()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, followed by the end."""
        if len(self.index) > CACHED:
            self.clear()
        stop = b" " + self.STOP + b" "
        # the vocabulary is of lower-cased text, but for special tokens, whose case counts
        data = stop.join([t if b"<|" in t else t.lower() for t in texts]) + stop
        words = parted(data).split()  # bytes: at ASCII white space
        w = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.fresh:
            self.learn()
        n = self.count[w]
        after = np.cumsum(n)
        ids = self.table[np.arange(after[-1]) + np.repeat(self.first[w] - after + n, n)]
        return np.split(ids, after[w == 0][:-1])


def pack_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids.

    docs: ``doc_id, text``.  A text (null: empty) gives its ids and ``end``; a piece is ``length`` of them from ``start`` on, at ``offset`` of
    ``sequence_id``.  ``padded`` is the length that the sequence is padded to: ``capacity``, or its own where that is a power of two.  With
    ``with_ids`` the ids themselves are returned too.  Repeated rows and ids are packed row by row; an empty table gives no sequence.  Sequence ids are
    unique in one result; their order has no meaning.  ``tokenizer`` is the path of a ``tokenizers`` file, the same on all executors, whose vocabulary is of
    lower-cased words and whose tokens cross neither ASCII white space nor the meeting of letters, digits and marks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, context = WordIds.of(tokenizer, end), TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        rows: list[tuple] = []
        pieces: list[tuple] = []
        held = 0

        def put(doc, start, ids, doc_tokens, sequence, offset, filled):
            padded = filled if filled & (filled - 1) == 0 else capacity
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, sequence, offset, padded) + ((ids.tolist(),) if with_ids else ()))

        def flush():
            nonlocal number, pieces, held
            if pieces:
                sizes = [len(p[2]) for p in pieces]
                for window in windows(sizes, capacity):
                    filled, at = sum(sizes[i] for i in window), 0
                    for i in window:
                        doc, start, ids, n = pieces[i]
                        put(doc, start, ids, n, number, at, filled)
                        at += sizes[i]
                    number += 1
            pieces, held = [], 0

        def ready():
            cols = list(zip(*rows))
            rows.clear()
            arrays = [null_ids(np.array(cols[0], np.int64)), *[pa.array(c, pa.int64()) for c in cols[1:8]]]
            if with_ids:
                arrays.append(pa.array(cols[8], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            buf, off = flat(batch.column(1))
            data, doc = buf.tobytes(), ids(pa.Table.from_batches([batch])).tolist()
            i = 0
            while i < len(doc):
                j = max(i + 1, int(np.searchsorted(off, off[i] + (1 << 20), "right")) - 1)
                for d, x in zip(doc[i:j], words.encode([data[off[r]:off[r + 1]] for r in range(i, j)])):
                    whole = len(x) // capacity * capacity
                    for s in range(0, whole, capacity):
                        put(d, s, x[s:s + capacity], len(x), number, 0, capacity)
                        number += 1
                    if len(x) > whole:
                        pieces.append((d, whole, x[whole:], len(x)))
                        held += len(x) - whole
                        if held >= ROUND:
                            flush()
                i = j
                if len(rows) > 20_000:
                    yield ready()
        flush()
        if rows:
            yield ready()

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return documents(docs).mapInArrow(run, schema)
