"""Line deduplication through a sharded minimal perfect hash.

Blocks of documents send their distinct line hashes with the number of documents and the largest doc_id; a shard merges them, builds a minimal
perfect hash over its distinct line hashes and keeps, at the place of each, a compact fingerprint, the number of documents and the largest
doc_id.  The blocks' lines then probe these arrays; no line is joined with another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stripline.llm.common import (BLOCK_BYTES, LOWER, SHARD_BYTES, SPACE, Docs, blobs, blocked, cuts, groups, meet, mix, null_ids, parts,
                                  per_block, serve, slices, span_hashes, unpacked)

LEAST_CHARS, LEAST_DOCS = 40, 5
SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, text string"


POPULATION = np.array([i.bit_count() for i in range(256)], np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a cascade of bit arrays, each holding the keys that fall alone into a place of it.

    A key's value is the rank of its bit among all levels.  About 3 bits a key and a rank a byte of bits; lookups are vectorised.
    """

    def __init__(self, keys: np.ndarray, room: float = 1.6):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        before, rest = 0, keys
        while len(rest):
            size = max(64, -(-int(room * len(rest)) // 8) * 8)
            at = self.place(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            packed = np.packbits(alone)
            count = POPULATION[packed]
            self.levels.append((size, packed, before + np.cumsum(count) - count))
            before += int(count.sum())
            rest = rest[~alone[at]]

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return ((mix(keys ^ seed) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys; -1 for those that meet no set bit (a foreign key may get any value, hence the fingerprints)."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, packed, rank) in enumerate(self.levels):
            at = self.place(keys[todo], level, size)
            byte, bit = at >> 3, at & 7
            hit = (packed[byte] >> (7 - bit)) & 1 == 1
            byte, bit = byte[hit], bit[hit]
            out[todo[hit]] = rank[byte] + POPULATION[packed[byte] >> (8 - bit)]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


class LineIndex:
    """What a shard knows of its lines: the perfect hash and, at each value, fingerprint, number of documents and largest doc_id."""

    def __init__(self, key: np.ndarray, count: np.ndarray, last: np.ndarray):
        """Keys may repeat, one entry for each block."""
        order = np.argsort(key, kind="stable")
        key, count, last = key[order], count[order], last[order]
        at = groups(key)
        distinct = key[at]
        self.hash = PerfectHash(distinct)
        place = self.hash(distinct)
        self.print = np.empty(len(at), np.uint32)
        self.count = np.empty(len(at), np.int64)
        self.last = np.empty(len(at), np.int64)
        self.print[place] = self.fingerprint(distinct)
        self.count[place] = np.add.reduceat(count, at) if len(at) else 0
        self.last[place] = np.maximum.reduceat(last, at) if len(at) else 0

    @staticmethod
    def fingerprint(key: np.ndarray) -> np.ndarray:
        return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def probe(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of documents (0: unknown line) and largest doc_id of each key."""
        if not len(self.count):
            return np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        place = self.hash(key)
        known = (place >= 0) & (self.print[place] == self.fingerprint(key))
        return np.where(known, self.count[place], 0), self.last[place]


def line_keys(d: Docs, least_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of lines before each row (rows + 1), line hashes (0: too short)."""
    buf, off = d.buf, d.off
    counts, keys = [np.zeros(1, np.int64)], [np.zeros(0, np.uint64)]
    for i, j in slices(off):
        part = buf[off[i]:off[j]]
        local = off[i:j + 1] - off[i]
        breaks = np.flatnonzero(part == 10)
        ends_ = np.sort(np.concatenate([breaks, local[1:]]), kind="stable")
        starts_ = np.sort(np.concatenate([breaks + 1, local[:-1]]), kind="stable")
        a, b = strip(part, starts_, ends_)
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        h = span_hashes(LOWER[part], a, b)
        h[chars[b] - chars[a] < least_chars] = 0
        keys.append(h)
        in_row = np.concatenate([[0], np.cumsum(part == 10)])[local]
        counts.append(np.diff(in_row) + 1)
    return np.cumsum(np.concatenate(counts)), np.concatenate(keys)


def strip(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges without ASCII white space at both ends; an empty one for a blank line."""
    ink = np.flatnonzero(~SPACE[buf])
    if not len(ink):
        return starts, starts
    i, j = np.searchsorted(ink, starts), np.searchsorted(ink, ends) - 1
    blank = i > j
    a = np.where(blank, starts, ink[np.minimum(i, len(ink) - 1)])
    return a, np.where(blank, starts, ink[j] + 1)


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, per_block_bytes: int = BLOCK_BYTES,
                        with_text: bool = True, carry: str | None = None) -> DataFrame:
    """Texts without the lines that ``least_docs`` documents share, but for those in the largest doc_id that holds them.

    docs: ``doc_id, text``.  Lines are the parts between \\n (a null or empty text is one empty line); their key is stripped of ASCII white space and
    A-Z lower-cased, and counts from ``least_chars`` code points on.  A repeated row counts as another document; rows that share the
    largest doc_id all keep the line.  A missing doc_id is the largest.  Returns ``doc_id, n_lines, n_dropped, kept_sha256, text``, a row for each row;
    ``text`` is null unless ``with_text``; a string column named by ``carry`` goes along.  Equal 64-bit hashes count as equal lines.
    """
    blocks = blocked(docs, per_block_bytes, carry)
    shards = parts(docs, 4 * SHARD_BYTES)

    schema = SCHEMA + (", carry string" if carry else "")

    def ask(t: pa.Table) -> pa.Table:
        d = unpacked(t)
        doc = d.doc
        n, key = line_keys(d, least_chars)
        row = np.repeat(np.arange(len(d)), np.diff(n))
        use = key != 0
        key, row = key[use], row[use]
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])  # a document counts once
        key, row = key[once], row[once]
        at = groups(key)
        count = np.diff(np.append(at, len(key)))
        last = np.maximum.reduceat(doc[row], at) if len(at) else np.zeros(0, np.int64)
        key = key[at]
        c = cuts(key, shards)
        some = np.flatnonzero(np.diff(c))
        pack = lambda x: pa.array([x[c[s]:c[s + 1]].tobytes() for s in some], pa.binary())
        b = t.column("_b")[0].as_py()
        return pa.table([pa.array(some, pa.int32()), pa.array([b] * len(some), pa.int64()), pack(key), pack(count.astype(np.int32)), pack(last)],
                        names=["_s", "_b", "key", "count", "last"])

    def answer(t: pa.Table) -> Iterable[pa.Table]:
        keys = [np.frombuffer(x, np.uint64) for x in blobs(t.column("key"))]
        index = LineIndex(np.concatenate(keys), np.concatenate([np.frombuffer(x, np.int32) for x in blobs(t.column("count"))]).astype(np.int64),
                          np.concatenate([np.frombuffer(x, np.int64) for x in blobs(t.column("last"))]))
        out = []
        for b, k in zip(t.column("_b").to_pylist(), keys):
            count, last = index.probe(k)
            many = count >= least_docs
            if many.any():
                out.append((b, k[many].tobytes(), last[many].tobytes()))
        if out:
            yield pa.table([pa.array(x, y) for x, y in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["_b", "key", "last"])

    def finish(t: pa.Table, got: pa.Table) -> pa.Table:
        d = unpacked(t)
        doc = d.doc
        n, key = line_keys(d, least_chars)
        many = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in blobs(got.column("key"))]])
        last = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.int64) for x in blobs(got.column("last"))]])
        order = np.argsort(many)
        many, last = many[order], last[order]
        row = np.repeat(np.arange(len(d)), np.diff(n))
        drop = np.zeros(len(key), bool)
        if len(many):
            at = np.minimum(np.searchsorted(many, key), len(many) - 1)
            drop = (many[at] == key) & (key != 0) & (last[at] != doc[row])
        dropped = np.concatenate([[0], np.cumsum(drop)])[n]
        sha, texts = [], []
        for r in range(len(d)):
            kept = d.text(r)
            if dropped[r + 1] > dropped[r]:
                kept = b"\n".join(compress(kept.split(b"\n"), (~drop[n[r]:n[r + 1]]).tolist()))
            sha.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept if with_text else None)
        cols = [null_ids(doc), pa.array(np.diff(n), pa.int64()), pa.array(np.diff(dropped), pa.int64()), pa.array(sha, pa.string()),
                pa.array(texts, pa.binary()).cast(pa.string())]
        if carry:
            cols.append(pa.array(d.carry, pa.binary()).cast(pa.string()))
        return pa.table(cols, names=[x.split()[0] for x in schema.split(", ")])

    requests = per_block(blocks, ask, "_s int, _b long, key binary, count binary, last binary")
    return meet(blocks, serve(requests, shards, answer, "_b long, key binary, last binary"), finish, schema)
