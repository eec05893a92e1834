"""Removal of repeated byte strings by external induced sorting of suffixes.

Equal 50-byte strings have the same smallest 24-byte hash, so windows are brought together by it: neighbouring windows that share it form a *segment*, and
segments whose hash occurs in two documents go, each distinct one once per block, to the shard of the hash.  A hash with many distinct segments (the ends
of a passage that many documents share, each with its own text beside it) is *hot*: its windows go one by one, by the hash of their own 50 bytes, so
that they spread over all shards.  The shard sorts the suffixes of all its
segments.  Suffixes are divided by whether they are larger (L) or smaller (S) than the next; the first S of each run is sorted by
induction, named, and, where names repeat, sorted as a string of names; from their order that of all L and then all S suffixes is induced through
queues by first byte, which live on disk beyond a memory budget.  A shard reads its requests as a stream; beyond a budget it deals them by their hash
into buckets on disk and sorts these one after another, so what a task holds doesn't grow with its shard.  Neighbours in the order with a common prefix of 50 bytes are the same
string; the smallest doc_id of such a group decides which windows are repeats.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stripline.llm.common import (BLOCK_BYTES, CODES, Docs, bits, blobs, blocked, cuts, groups, meet, mix, null_ids, pack48, parts, per_block, powers, serve,
                                  slices, stream, unbits, unpack48, unpacked, windows)

WINDOW, ANCHOR = 50, 24
SHARD_BYTES = 8 << 20  # a sort takes about twenty times the bytes that a shard gathers
QUEUE_BYTES = 192 << 20  # what the queues of a sort hold in memory
SORT_BYTES = 16 << 20  # requests that a shard compares at once; those beyond go to disk by bucket
BUCKETS = 256  # by the lowest byte of a hash
STRETCH = 1 << 16  # bytes that are hashed at once, so that their arrays stay in a processor's cache
PIECE, HOT = 128, 4096  # an anchor is hot if the distinct segments that blocks would send for it have more than so many pieces of 128 bytes
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,bytes:long>>, kept binary"


class Queues:
    """One queue of suffix positions for each first byte, taken in the order of the bytes; the longest go to disk beyond the budget."""

    def __init__(self, budget: int = QUEUE_BYTES):
        self.parts: list[list] = [[] for _ in range(256)]
        self.held, self.budget, self.file, self.end = 0, budget, None, 0

    def put(self, char: int, a: np.ndarray) -> None:
        self.parts[char].append(a)
        self.held += a.nbytes
        if self.held > self.budget:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # has no name, so it goes with the task however that ends
        for q in self.parts:
            for i, a in enumerate(q):
                if isinstance(a, np.ndarray):
                    self.file.seek(self.end)
                    self.file.write(a.tobytes())
                    q[i] = (self.end, len(a), a.dtype)
                    self.end += a.nbytes
        self.held = 0

    def get(self, char: int, i: int) -> np.ndarray:
        a = self.parts[char][i]
        if isinstance(a, np.ndarray):
            return a
        self.file.seek(a[0])
        return np.frombuffer(self.file.read(a[1] * a[2].itemsize), a[2])

    def take(self, char: int) -> Iterator[np.ndarray]:
        """The queue's parts, those that wait together; also those that are put while it is read.  The order is that of one part after another."""
        i = 0
        while i < len(self.parts[char]):
            j = len(self.parts[char])
            got = [self.get(char, k) for k in range(i, j)]
            i = j
            yield np.concatenate(got) if len(got) > 1 else got[0]

    def all(self, char: int) -> np.ndarray:
        got = [self.get(char, i) for i in range(len(self.parts[char]))]
        return np.concatenate(got) if got else np.zeros(0, np.int32)


class Requests:
    """What blocks ask of a shard: block, part, windows and bytes of segments (or first halves of window hashes), doc_ids, keys (or second halves).

    Beyond the budget all is dealt into buckets in an unnamed temporary file.  A key lies in one bucket.
    """

    def __init__(self, budget: int, shards: int, window: int):
        self.budget, self.shards, self.more = budget, shards, window - 1
        self.held, self.size, self.file, self.end = [], 0, None, 0
        self.places: list[list] = [[] for _ in range(BUCKETS)]
        self.sizes = [0] * BUCKETS

    def put(self, b: int, part: int, n: np.ndarray, text: bytes, doc: np.ndarray, key: bytes) -> None:
        self.held.append((b, part, 0, BUCKETS, n, text, doc, key))
        self.size += n.nbytes + len(text) + doc.nbytes + len(key)
        if self.size > self.budget:
            self.spill()

    def split(self, b: int, part: int, n: np.ndarray, text: bytes, doc: np.ndarray, key: bytes) -> Iterator[tuple]:
        alone = part >= self.shards
        bucket = np.frombuffer(text, np.uint8)[::8] if alone else np.frombuffer(key, np.uint8)[::6]
        order = np.argsort(bucket, kind="stable")
        keys = np.frombuffer(key, np.uint8).reshape(len(bucket), -1)
        z = np.cumsum(n.astype(np.int64) + self.more) if not alone else np.arange(8, len(text) + 8, 8)
        a = np.concatenate([[0], z[:-1]]).tolist()
        z = z.tolist()
        for x in np.split(order, groups(bucket[order])[1:]):
            k = int(bucket[x[0]])
            yield b, part, k, k + 1, n if alone else n[x], b"".join([text[a[i]:z[i]] for i in x.tolist()]), doc[x], keys[x].tobytes()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        dealt: list[list] = [[] for _ in range(BUCKETS)]
        while self.held:
            b, part, _, _, *rest = self.held.pop()
            for x in self.split(b, part, *rest):
                dealt[x[2]].append(x)
        for k, items in enumerate(dealt):
            if items:
                data = pickle.dumps(items, pickle.HIGHEST_PROTOCOL)
                self.file.seek(self.end)
                self.file.write(data)
                self.places[k].append((self.end, len(data)))
                self.sizes[k] += len(data)
                self.end += len(data)
        self.size = 0

    def together(self) -> Iterator[list[tuple]]:
        """All requests, those of as many buckets at once as the budget holds (one at least)."""
        if self.file is None:
            if self.held:
                yield self.held
            return
        self.spill()
        k = 0
        while k < BUCKETS:
            size, got = 0, []
            while k < BUCKETS and (not size or size + self.sizes[k] <= self.budget):
                for at, length in self.places[k]:
                    self.file.seek(at)
                    got += pickle.loads(self.file.read(length))
                size += self.sizes[k]
                k += 1
            if got:
                yield got


def types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (the last counts as smaller)."""
    n = len(t)
    differs = np.ones(n, bool)
    differs[:-1] = t[1:] != t[:-1]
    rising = np.ones(n, bool)
    rising[:-1] = t[:-1] < t[1:]
    ends = np.flatnonzero(differs)
    return np.repeat(rising[ends], np.diff(ends, prepend=-1))


def induce(t: np.ndarray, small: np.ndarray, first: np.ndarray, budget: int = QUEUE_BYTES) -> np.ndarray:
    """Order of all suffixes, from the order of those that begin a run of S."""
    char = t[first]
    by = np.argsort(char, kind="stable")
    first = first[by]
    at = np.searchsorted(char[by], np.arange(257))
    large, lesser = Queues(budget), Queues(budget)

    def push(queues: Queues, a: np.ndarray, kind: bool) -> None:
        p = a[a > 0] - 1
        p = p[small[p] == kind]
        if len(p):
            c = t[p]
            order = np.argsort(c, kind="stable")
            c, p = c[order], p[order]
            bounds = groups(c)
            for k, i, j in zip(c[bounds].tolist(), bounds.tolist(), [*bounds[1:].tolist(), len(p)]):
                queues.put(k, p[i:j])

    for c in range(256):
        for a in large.take(c):
            push(large, a, False)
        push(large, first[at[c]:at[c + 1]], False)
    out = []
    for c in range(255, -1, -1):
        for a in lesser.take(c):
            push(lesser, a, True)
        up = large.all(c)[::-1]
        push(lesser, up, True)
        out += [lesser.all(c), up]
    return np.concatenate([*out, np.array([len(t) - 1], np.int32)])[::-1]  # the last suffix, one 0, has none to be induced from


def suffix_order(t: np.ndarray, depth: int, budget: int = QUEUE_BYTES) -> np.ndarray:
    """Positions of ``t`` (bytes that end with a 0, the smallest) sorted by the suffixes there, as far as the first ``depth`` bytes tell them apart."""
    n = len(t)
    small = types(t)
    first = np.flatnonzero(small & ~np.concatenate([[True], small[:-1]])).astype(np.int32)
    if len(first) > 1:
        order = induce(t, small, first, budget)
        is_first = np.zeros(n, bool)
        is_first[first] = True
        ranked = order[is_first[order]]  # sorted by the bytes up to the next run's begin
        number = np.zeros(n, np.int32)
        number[first] = np.arange(len(first))
        stop = np.append(first[1:], n - 1).astype(np.int64) + 1
        h = stretches(t, first.astype(np.int64), stop)
        r = number[ranked]
        name = np.empty(len(first), np.int64)
        name[r] = np.cumsum(np.concatenate([[0], h[r][1:] != h[r][:-1]]))
        rounds = max(1, (depth // 2 + 1).bit_length())  # a run has two bytes at least
        for k in range(rounds):
            if name.max() + 1 == len(name):
                break
            ahead = np.zeros(len(name), np.int64)
            ahead[:-(1 << k) or None] = name[1 << k:] + 1 if (1 << k) < len(name) else 0
            key = name * (len(name) + 1) + ahead
            o = np.argsort(key, kind="stable")
            s = key[o]
            name = np.empty_like(name)
            name[o] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        first = first[np.argsort(name, kind="stable")]
    return induce(t, small, first, budget)


def ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of byte ranges that may overlap."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(CODES[which][buf] * powers(len(buf), which), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(len(buf) + 1, which, True)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def stretches(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """The same for ranges by ascending start of which none ends before the one ahead of it, a stretch at a time."""
    out = np.empty(len(starts), np.uint64)
    for i, j in slices(np.append(starts, ends[-1:]), STRETCH):
        a = starts[i]
        out[i:j] = ranges(buf[a:ends[j - 1]], starts[i:j] - a, ends[i:j] - a, which)
    return out


def same_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` bytes (8 at least) at ``a`` and at ``b`` are equal, compared eight at a time."""
    eight = np.lib.stride_tricks.sliding_window_view(t, 8)
    same = np.ones(len(a), bool)
    for k in [*range(0, size - 7, 8), size - 8]:
        live = np.flatnonzero(same)
        same[live] = (eight[a[live] + k] == eight[b[live] + k]).all(1)
    return same


class Segments:
    """Maximal runs of windows of one text that share their smallest hash; ``start``: of the first window, ``n``: windows, ``row``, ``key``."""

    def __init__(self, d: Docs, window: int, anchor: int):
        start, n, row, key = [], [], [], []
        for i, j in slices(d.off, STRETCH):
            part, local = d.buf[d.off[i]:d.off[j]], d.off[i:j + 1] - d.off[i]
            if len(part) < window:
                continue
            h = windows(CODES[0][part], anchor)
            span, m, size = window - anchor + 1, h, 1
            while 2 * size <= span:
                m, size = np.minimum(m[:-size], m[size:]), 2 * size
            m = np.minimum(m[:len(h) - span + 1], m[span - size:])  # smallest of all hashes in the window
            long = np.flatnonzero(np.diff(local) >= window)
            new = np.ones(len(m) + 1, bool)
            new[1:-1] = m[1:] != m[:-1]
            new[local[long]] = True
            new[local[long + 1] - window + 1] = True  # here begin the windows that would reach into the next text
            f = np.flatnonzero(new)
            at, length = f[:-1], np.diff(f)
            r = np.searchsorted(local, at, "right") - 1
            inside = at + window <= local[r + 1]
            at, r = at[inside], r[inside]
            start.append(at + d.off[i])
            n.append(length[inside])
            row.append(r + i)
            key.append(mix(m[at]))
        cat = lambda x, k: np.concatenate([np.zeros(0, k), *x])
        self.start, self.n, self.row, self.key = cat(start, np.int64), cat(n, np.int64), cat(row, np.int64), cat(key, np.uint64)


def remove_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, per_block_bytes: int = BLOCK_BYTES, with_bytes: bool = True,
                      queue_bytes: int = QUEUE_BYTES, hot: int = HOT, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """Texts without the bytes covered by a ``window``-byte string that also starts in a document with a smaller doc_id.

    docs: ``doc_id, text`` as UTF-8 (null: empty); matches don't cross documents; overlaps count; strings are judged on the input.  Returns a row for each
    row: ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs), ``kept_sha256`` of the remaining bytes, the ``spans`` and, with
    ``with_bytes``, the remaining bytes, which needn't be UTF-8.  A missing doc_id is the largest; rows that share a doc_id are not smaller
    than each other, so they don't remove each other's bytes; a text shorter than the window loses nothing.  Windows of anchors with more than ``hot``
    pieces are compared by 128-bit hashes, all others byte by byte.
    """
    blocks = blocked(docs, per_block_bytes)
    shards = parts(docs, SHARD_BYTES)

    def ask_anchors(t: pa.Table) -> pa.Table:
        d = unpacked(t)
        g = Segments(d, window, anchor)
        distinct, place = np.unique(g.key, return_inverse=True)
        low, high = np.full(len(distinct), len(d)), np.full(len(distinct), -1)
        np.minimum.at(low, place, g.row)
        np.maximum.at(high, place, g.row)
        several = high > low
        size = pieces(d, g, place, len(distinct))
        c = cuts(distinct, shards)
        some = np.flatnonzero(np.diff(c)).tolist()
        b = t.column("_b")[0].as_py()
        each = lambda f: pa.array([f(slice(c[s], c[s + 1])) for s in some], pa.binary())
        return pa.table([pa.array(some, pa.int32()), pa.array([b] * len(some), pa.int64()), each(lambda x: pack48(distinct[x], n=shards)),
                         each(lambda x: bits(several[x])), each(lambda x: size[x].tobytes())],
                        names=["_s", "_b", "key", "several", "size"])

    def pieces(d: Docs, g: Segments, place: np.ndarray, n: int) -> np.ndarray:
        """Pieces that the block would send for each of its ``n`` keys: those of the distinct contents."""
        size = (g.n + window - 2) // PIECE + 1
        more = np.flatnonzero((np.bincount(place, minlength=n) > 1)[place])
        out = np.bincount(place, size, n)
        if len(more):
            one, _ = contents(d, g, more, 1)
            order = np.lexsort((one, place[more]))
            again = (one[order][1:] == one[order][:-1]) & (place[more][order][1:] == place[more][order][:-1])
            x = more[order[1:][again]]
            out -= np.bincount(place[x], size[x], n)
        return np.minimum(out, hot + 1).astype(np.uint32)

    def shared(t: pa.Table) -> Iterable[pa.Table]:
        keys = [unpack48(x) for x in blobs(t.column("key"))]
        several = np.concatenate([unbits(x, len(k)) for x, k in zip(blobs(t.column("several")), keys)])
        everything = np.concatenate(keys)
        order = np.argsort(everything, kind="stable")
        at = groups(everything[order])
        n = np.diff(np.append(at, len(order)))
        hit = np.empty(len(order), bool)
        hit[order] = np.repeat((n > 1) | np.maximum.reduceat(several[order], at), n)
        size = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs(t.column("size"))])
        many = np.empty(len(order), bool)
        many[order] = np.repeat(np.add.reduceat(size[order].astype(np.int64), at) > hot, n)
        ends = np.cumsum([len(k) for k in keys])
        yield pa.table([t.column("_s"), t.column("_b"), *[pa.array([bits(x) for x in np.split(m, ends[:-1])], pa.binary()) for m in (hit, hit & many)]],
                       names=["_s", "_b", "hit", "hot"])

    def contents(d: Docs, g: Segments, use: np.ndarray, hashes: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of the bytes of the segments ``use``, in two halves."""
        a = g.start[use]
        z = a + g.n[use] + window - 1
        one, two = np.zeros(len(use), np.uint64), np.zeros(len(use), np.uint64)
        for i, j in slices(d.off, STRETCH):
            x = slice(*np.searchsorted(a, [d.off[i], d.off[j]]))
            if x.stop > x.start:
                part = d.buf[d.off[i]:d.off[j]]
                for k, h in enumerate((one, two)[:hashes]):
                    h[x] = ranges(part, a[x] - d.off[i], z[x] - d.off[i], k)
        return one, two

    def distinct_segments(d: Docs, g: Segments, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The candidates by shard and content, where each distinct content begins in that order, and the first (smallest) row of each."""
        one, two = contents(d, g, use)
        key = g.key[use]
        order = np.lexsort((g.row[use], two, one, key))
        new = np.ones(len(order), bool)
        for x in (key, one, two):
            y = x[order]
            if len(y):
                new[1:] &= y[1:] == y[:-1]
        if len(new):
            new[1:] = ~new[1:]
        return order, np.flatnonzero(new), np.cumsum(new) - 1

    def distinct_windows(d: Docs, g: Segments, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct windows of the segments ``e``, ascending, the smallest row of each, and which of them each window of ``e`` is."""
        at = np.argsort(g.start[e], kind="stable")
        n = g.n[e][at]
        places = np.repeat(g.start[e][at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        row = np.repeat(g.row[e][at], n)
        one, two = np.zeros(len(places), np.uint64), np.zeros(len(places), np.uint64)
        for i, j in slices(d.off, STRETCH):
            x = slice(*np.searchsorted(places, [d.off[i], d.off[j]]))
            if x.stop > x.start:
                part = d.buf[d.off[i]:d.off[j]]
                one[x], two[x] = (ranges(part, places[x] - d.off[i], places[x] - d.off[i] + window, k) for k in (0, 1))
        order = np.lexsort((row, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        f = order[new]
        back = np.empty(len(at), np.int64)
        back[at] = np.cumsum(n) - n
        m = g.n[e]
        return one[f], two[f], row[f], which[np.repeat(back - np.cumsum(m) + m, m) + np.arange(m.sum())]

    def ask_segments(t: pa.Table, got: pa.Table) -> pa.Table:
        d = unpacked(t)
        g = Segments(d, window, anchor)
        distinct, place = np.unique(g.key, return_inverse=True)
        hit, many = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
        c = cuts(distinct, shards)
        for s, x, y in zip(got.column("_s").to_pylist(), blobs(got.column("hit")), blobs(got.column("hot"))):
            hit[c[s]:c[s + 1]], many[c[s]:c[s + 1]] = unbits(x, c[s + 1] - c[s]), unbits(y, c[s + 1] - c[s])
        candidate = hit[place]
        use = np.flatnonzero(candidate)
        b = t.column("_b")[0].as_py()
        rows = [(b % shards, b, k, bits(x), b"", b"", b"", b"") for k, x in ((-1, candidate), (-2, many[place]))]  # for this block itself
        if len(use):
            order, new, _ = distinct_segments(d, g, use)
            e = use[order[new]]
            alone = many[place[e]]
            if alone.any():
                one, two, least, _ = distinct_windows(d, g, e[alone])
                c = cuts(one, shards)
                for s in np.flatnonzero(np.diff(c)).tolist():
                    x = slice(c[s], c[s + 1])
                    used, row = np.unique(least[x], return_inverse=True)
                    rows.append((s, b, shards + s, b"", one[x].tobytes(), d.doc[used].tobytes(), row.astype(np.uint32).tobytes(), two[x].tobytes()))
            e = e[~alone]
            c = cuts(g.key[e], shards)
            data = d.buf.tobytes()
            shard = np.repeat(np.arange(shards), np.diff(c))
            pairs, row = np.unique(shard * len(d) + g.row[e], return_inverse=True)  # of shards and rows, for all messages at once
            least = np.searchsorted(pairs, np.arange(shards + 1) * len(d))
            used = d.doc[pairs % len(d)]
            row = (row - least[shard]).astype(np.uint32)
            for s in np.flatnonzero(np.diff(c)).tolist():
                x = e[c[s]:c[s + 1]]
                text = b"".join([data[a:a + n] for a, n in zip(g.start[x].tolist(), (g.n[x] + window - 1).tolist())])
                rows.append((s, b, s, g.n[x].astype(np.uint32).tobytes(), text, used[least[s]:least[s + 1]].tobytes(), row[c[s]:c[s + 1]].tobytes(),
                             pack48(g.key[x], n=shards)))
        kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["_s", "_b", "part", "n", "texts", "docs", "row", "key"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["_b", "part", "low", "high", "late"])

        requests = Requests(sort_bytes, shards, window)
        for batch in batches:
            cols = [batch.column(k) for k in ("_b", "part", "n", "texts", "docs", "row", "key")]
            for i in range(batch.num_rows):
                b, part, n, text, docs, row, key = (c[i].as_py() for c in cols)
                if part < 0:
                    yield answer([(b, part, 0, BUCKETS, n)])
                else:
                    requests.put(b, part, np.frombuffer(n, np.uint32), text, np.frombuffer(docs, np.int64)[np.frombuffer(row, np.uint32)], key)
            del batch, cols
        for asks in requests.together():
            for some, fn in (([x for x in asks if x[1] < shards], late_segments), ([x for x in asks if x[1] >= shards], late_windows)):
                if some:
                    yield answer([(*x[:4], late) for x, late in zip(some, fn(some))])

    def late_segments(asks: list[tuple]) -> list[bytes]:
        """Which of the blocks' windows also start in a document with a smaller doc_id."""
        n = [x[4].astype(np.int64) for x in asks]
        doc = np.concatenate([x[6] for x in asks])
        count = np.concatenate(n)
        smallest = smallest_docs(np.frombuffer(b"".join([x[5] for x in asks]), np.uint8), count, doc, np.concatenate([unpack48(x[7]) for x in asks]))
        late = smallest < np.repeat(doc, count)
        return [bits(x) for x in np.split(late, np.cumsum([x.sum() for x in n])[:-1])]

    def late_windows(asks: list[tuple]) -> list[bytes]:
        """The same for windows of hot anchors."""
        a, z = (np.frombuffer(b"".join([x[k] for x in asks]), np.uint64) for k in (5, 7))
        doc = np.concatenate([x[6] for x in asks])
        order = np.lexsort((doc, z, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (z[order][1:] != z[order][:-1])
        f = np.flatnonzero(new)
        late = np.empty(len(order), bool)
        late[order] = np.repeat(doc[order[f]], np.diff(np.append(f, len(order)))) < doc[order]
        return [bits(x) for x in np.split(late, np.cumsum([len(x[6]) for x in asks])[:-1])]

    def smallest_docs(buf: np.ndarray, count: np.ndarray, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Smallest doc_id that holds each window of the segments, which lie one after another with ``count`` windows each.

        Equal segments collapse to one, with their smallest document.  Where all segments of a key are equal that decides; the rest is sorted.
        """
        size = count + window - 1
        z = np.cumsum(size)
        one, two = (stretches(buf, z - size, z, k) for k in (0, 1))
        order = np.lexsort((doc, two, one, key))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]) | (key[order][1:] != key[order][:-1])
        keep = order[new]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        del one, two, order
        at = groups(key[keep])
        contents = np.diff(np.append(at, len(keep)))
        several = np.repeat(contents > 1, contents)
        n = count[keep]
        smallest = np.repeat(doc[keep], n)  # of each window of the distinct segments
        if several.any():
            smallest[np.repeat(several, n)] = sorted_docs(buf, (z - size)[keep[several]], n[several], doc[keep[several]])
        a = (np.cumsum(n) - n)[which]
        return smallest[np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())]

    def sorted_docs(buf: np.ndarray, first: np.ndarray, n: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Smallest doc_id of each window of some distinct segments: those that are neighbours in the order of suffixes with a common prefix of a window."""
        m = n + window - 1
        t = np.zeros(int(m.sum()) + len(m), np.uint8)  # UTF-8 has no byte 255: each is raised by one, and 0 ends a segment
        at = np.cumsum(m + 1) - m - 1
        t[np.repeat(at - np.cumsum(m) + m, m) + np.arange(m.sum())] = buf[np.repeat(first - np.cumsum(m) + m, m) + np.arange(m.sum())] + 1
        starts = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
        number = np.full(len(t), -1, np.int32)
        number[starts] = np.arange(len(starts))
        suffix = suffix_order(t, window, queue_bytes)
        suffix = suffix[number[suffix] >= 0]
        begin = np.ones(len(suffix), bool)
        begin[1:] = ~same_prefix(t, suffix[1:], suffix[:-1], window)
        place = number[suffix]
        f = np.flatnonzero(begin)
        best = np.minimum.reduceat(np.repeat(doc, n)[place], f)
        out = np.empty(len(starts), np.int64)
        out[place] = np.repeat(best, np.diff(np.append(f, len(suffix))))
        return out

    def answered(answers: dict[tuple[int, int, int], bytes], first: int, c: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The answers of all shards to requests of ``n`` windows each, as sent: shard s, part ``first + s``, got those from ``c[s]`` on."""
        ends = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros(int(ends[-1]), bool)
        for (part, low, high), x in answers.items():
            s = part - first
            if 0 <= s < shards:
                a, z = c[s], c[s + 1]
                if (low, high) == (0, BUCKETS):
                    out[ends[a]:ends[z]] = unbits(x, int(ends[z] - ends[a]))
                    continue
                its = np.flatnonzero(np.repeat((bucket[a:z] >= low) & (bucket[a:z] < high), n[a:z])) + ends[a]
                out[its] = unbits(x, len(its))
        return out

    def runs(repeat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the maximal runs of bytes begin and end that windows marked at their first byte cover; none goes on into the next text."""
        upto = np.zeros(len(repeat) + window, np.int32)
        np.cumsum(repeat, out=upto[window:])
        gone = upto[window:] > upto[:len(repeat)]
        first, last = gone.copy(), gone.copy()
        first[1:] &= ~gone[:-1]
        last[:-1] &= ~gone[1:]
        inside = off[(off > 0) & (off < len(gone))]
        first[inside], last[inside - 1] = gone[inside], gone[inside - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def finish(t: pa.Table, got: pa.Table) -> pa.Table:
        d = unpacked(t)
        answers = {x[:3]: x[3] for x in zip(*[got.column(k).to_pylist() for k in ("part", "low", "high")], blobs(got.column("late")))}
        repeat = np.zeros(len(d.buf), bool)  # at the first byte of each window
        mask, many = (answers.pop((k, 0, BUCKETS), b"") for k in (-1, -2))
        if any(mask):
            g = Segments(d, window, anchor)
            use = np.flatnonzero(unbits(mask, len(g.n)))
            order, new, which = distinct_segments(d, g, use)
            e = use[order[new]]
            n = g.n[e]
            ends = np.cumsum(n)
            alone = unbits(many, len(g.n))[e]
            late = np.zeros(int(ends[-1]), bool)
            if alone.any():
                one, _, least, of = distinct_windows(d, g, e[alone])
                before = answered(answers, shards, cuts(one, shards), one.astype(np.uint8), np.ones(len(one), np.int64))
                late[np.repeat(alone, n)] = before[of] | (d.doc[least][of] < np.repeat(d.doc[g.row[e[alone]]], n[alone]))
            key = g.key[e[~alone]]
            late[np.repeat(~alone, n)] = answered(answers, 0, cuts(key, shards), np.frombuffer(pack48(key, n=shards), np.uint8)[::6], n[~alone])
            # each occurrence of a content: all its windows are repeats, unless it is in the block's smallest document with that content
            x = use[order]
            again = d.doc[g.row[x]] > d.doc[g.row[e]][which]
            some = again | np.logical_or.reduceat(late, ends - n)[which]
            x, which, again = x[some], which[some], again[some]
            m = g.n[x]
            places = np.repeat(g.start[x] - np.cumsum(m) + m, m) + np.arange(m.sum())
            own = late[np.repeat((ends - n)[which] - np.cumsum(m) + m, m) + np.arange(m.sum())]
            repeat[places[own | np.repeat(again, m)]] = True
        begin, end = runs(repeat, d.off)
        of = np.searchsorted(begin, d.off)
        total = np.concatenate([[0], np.cumsum(end - begin)])[of]
        sha, kept = [], []
        for r, (i, j) in enumerate(zip(of.tolist(), of[1:].tolist())):
            text = d.text(r)
            if j > i:
                a, z = (begin[i:j] - d.off[r]).tolist(), (end[i:j] - d.off[r]).tolist()
                text = b"".join([text[y:x] for y, x in zip([0, *z], [*a, len(text)])])
            sha.append(hashlib.sha256(text).hexdigest())
            kept.append(text if with_bytes else None)
        first = np.repeat(d.off[:-1], np.diff(of))
        spans = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - first), pa.array(end - begin)], ["start", "bytes"]))
        return pa.table([null_ids(d.doc), pa.array(np.diff(d.off), pa.int64()), pa.array(np.diff(total), pa.int64()),
                         pa.array(np.diff(of), pa.int64()), pa.array(sha, pa.string()), spans, pa.array(kept, pa.binary())],
                        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    hit = serve(per_block(blocks, ask_anchors, "_s int, _b long, key binary, several binary, size binary"), shards, shared, "_s int, _b long, hit binary, hot binary")
    asked = meet(blocks, hit, ask_segments, "_s int, _b long, part int, n binary, texts binary, docs binary, row binary, key binary")
    return meet(blocks, stream(asked, shards, compare, "_b long, part int, low int, high int, late binary"), finish, SCHEMA)
