"""Fingerprints from improbable features.

Every 32-byte window of a text has an entropy level; levels that few windows of all documents have are improbable.  In each run of 16 neighbouring windows
the leftmost most improbable one gets a point, and windows with 4 points or more are features of the text.  Features are inserted into
chained Bloom filters of 2048 bits, 160 to a filter.  Two fingerprints are compared filter by filter: shared bits, normalised between what chance gives
and the most there could be, the best for each filter of the shorter chain, on average.
"""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripline.llm.common import LAST, Docs, flat, groups, null_ids, parts, serve, slices, span_hashes
from stripline.llm.suffixes import ranges

WIDTH, LEVELS, NEIGHBOURS, POINTS = 32, 1000, 16, 4
FILTER_BITS, PER_FILTER, HASHES = 2048, 160, 5
SLICE, PART_BYTES, LANES = 2 << 20, 16 << 20, 4096
CHANCE = 0.1  # share of the way from chance to certainty that counts as chance

_count = np.arange(WIDTH + 1)
_plogp = np.round(_count * np.log2(np.maximum(_count, 1)) * 1024).astype(np.int32)
RISE = np.append(_plogp[1:] - _plogp[:-1], 0).astype(np.int32)   # when a byte with so many occurrences comes in
FALL = np.append(0, _plogp[:-1] - _plogp[1:]).astype(np.int32)   # when one of so many goes
TOP = int(_plogp[-1])


def entropy_levels(buf: np.ndarray) -> np.ndarray:
    """Entropy level (0: one byte only, ``LEVELS`` - 1: all bytes differ) of the window that begins at each byte but the last ``WIDTH`` - 1.

    Many lanes of the text are scanned side by side, each with its byte counts.
    """
    n = len(buf) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint16)
    lanes = max(1, min(LANES, n // 256))
    length = -(-n // lanes)
    padded = np.zeros(lanes * length + WIDTH - 1, np.uint8)
    padded[:len(buf)] = buf
    lane = np.lib.stride_tricks.as_strided(padded, (length + WIDTH - 1, lanes), (1, length))
    text = np.ascontiguousarray(lane).astype(np.int32) + np.arange(lanes, dtype=np.int32) * 256
    count = np.zeros(lanes * 256, np.uint8)
    total = np.zeros(lanes, np.int32)
    out = np.empty((length, lanes), np.uint16)
    for j in range(length + WIDTH - 1):
        if j >= WIDTH:
            at = text[j - WIDTH]
            c = count[at]
            total += FALL[c]
            count[at] = c - 1
        at = text[j]
        c = count[at]
        total += RISE[c]
        count[at] = c + 1
        if j >= WIDTH - 1:
            out[j - WIDTH + 1] = (TOP - total).astype(np.int64) * (LEVELS - 1) // TOP
    return np.ascontiguousarray(out.T).ravel()[:n]


def inner(off: np.ndarray, n: int, size: int) -> np.ndarray:
    """Whether ``size`` bytes from each of ``n`` places on lie in one row."""
    length = np.diff(off)
    return np.repeat(off[1:], length)[:n] - np.arange(n) >= size


def level_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all documents have each level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            buf, off = flat(batch.column(0))
            for i, j in slices(off, SLICE):
                part = buf[off[i]:off[j]]
                levels = entropy_levels(part)
                total += np.bincount(levels[inner(off[i:j + 1] - off[i], len(levels), WIDTH)], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], ["level", "n"])

    got = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(LEVELS, np.int64)
    for r in got:
        total[r.level] = r.n
    return total


def precedence(counts: np.ndarray) -> np.ndarray:
    """Rank of each level: the fewer windows have it the lower; windows of hardly any content (the lowest tenth) come last."""
    plain = np.arange(LEVELS) < LEVELS // 10
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((np.arange(LEVELS), counts, plain))] = np.arange(LEVELS)
    return rank


def features(buf: np.ndarray, off: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the features of some texts, in the order of the text; each text has one at least."""
    n = np.diff(off)
    rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    levels = entropy_levels(buf)
    if len(levels):
        key = rank[levels] << 32 | np.arange(len(levels))
        low, size = key, 1
        while size < NEIGHBOURS:
            low, size = np.minimum(low[:-size], low[size:]), 2 * size
        low = low[inner(off, len(low), WIDTH + NEIGHBOURS - 1)] & 0xFFFFFFFF
        at = groups(low)
        places.append(low[at[np.diff(np.append(at, len(low))) >= POINTS]])
        rows.append(np.searchsorted(off, places[-1], "right") - 1)
        # texts without a feature, but with a window: their leftmost most improbable window
        bare = np.setdiff1d(np.flatnonzero(n >= WIDTH), rows[-1])
        if len(bare):
            bounds = np.stack([off[bare], off[bare + 1] - WIDTH + 1], 1).ravel()
            key = np.append(key, np.iinfo(np.int64).max)  # the last bound may be the end
            places.append(np.minimum.reduceat(key, bounds)[::2] & 0xFFFFFFFF)
            rows.append(bare)
    row, place = np.concatenate(rows), np.concatenate(places)
    h = ranges(buf, place, place + WIDTH) if len(place) else np.zeros(0, np.uint64)
    tiny = np.flatnonzero(n < WIDTH)  # a text of fewer bytes is one feature
    if len(tiny):
        h = np.concatenate([h, span_hashes(buf, off[tiny], off[tiny + 1])])
        row, place = np.concatenate([row, tiny]), np.concatenate([place, off[tiny]])
    order = np.lexsort((place, row))
    return row[order], h[order]


def filters(buf: np.ndarray, off: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """The chained filters of each text: an array of 32 64-bit words for each filter."""
    out: list[np.ndarray] = []
    for i, j in slices(off, SLICE):
        row, h = features(buf[off[i]:off[j]], off[i:j + 1] - off[i], rank)
        first = np.searchsorted(row, np.arange(j - i + 1))
        chain = -(-np.diff(first) // PER_FILTER)
        base = np.cumsum(chain) - chain
        which = base[row] + (np.arange(len(row)) - first[row]) // PER_FILTER
        on = np.zeros((int(chain.sum()), FILTER_BITS), bool)
        for k in range(HASHES):
            on[which, (h >> np.uint64(11 * k) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        packed = np.packbits(on, axis=1).view(np.uint64)
        out += np.split(packed, base[1:])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 (as chance has it) to 1 (equal)."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1).astype(np.float64), np.bitwise_count(b).sum(1).astype(np.float64)
    best = np.zeros(len(a))
    for i in range(len(a)):
        both = np.bitwise_count(a[i] & b).sum(1)
        most = np.minimum(na[i], nb)
        least = na[i] * nb / FILTER_BITS
        least = least + CHANCE * (most - least)
        best[i] = max(0.0, float(((both - least) / np.maximum(most - least, 1e-9)).max()))
    return float(min(1.0, best.mean()))


def written(f: np.ndarray) -> str:
    return f"{len(f)}:" + binascii.b2a_base64(f.tobytes(), newline=False).decode()


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness.

    docs: ``doc_id, text`` (null: empty).  The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document, by ascending doc_id; after the last comes the first.  A missing doc_id is the largest; rows that share one are ordered by a hash of
    their text.  Returns a row for each row; an empty table gives none; a single document is its own next.  A text of fewer than 32 bytes is one feature.
    """
    n = parts(docs, part_bytes)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    bounds = np.unique(np.array(d.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else [], float))
    bounds = np.minimum(bounds, float(1 << 62)).astype(np.int64)
    spark = docs.sparkSession

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First document of each part, among those that a task reads."""
        for batch in batches:
            doc, h = (batch.column(i).to_numpy() for i in (0, 1))
            order = np.lexsort((h, doc))
            p = np.searchsorted(bounds, doc[order], "right")
            at = groups(p)
            yield pa.RecordBatch.from_arrays([pa.array(p[at]), pa.array(doc[order][at]), pa.array(h[order][at])], ["p", "doc", "h"])

    heads = d.select("doc_id", "h").mapInArrow(edges, "p long, doc long, h long").groupBy("p").agg(F.min(F.struct("doc", "h")).alias("m")).collect()
    heads = sorted((r.p, r.m.doc, r.m.h) for r in heads)  # one a part
    before = {p: heads[i - 1][0] for i, (p, *_) in enumerate(heads)}  # the part that ends before it
    first = {p: (doc, h) for p, doc, h in heads}
    rank = precedence(level_counts(docs))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, h = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            buf, off = flat(batch.column(1))
            x, p = Docs(doc, buf, off), np.searchsorted(bounds, doc, "right")
            order = np.argsort(p, kind="stable")
            at = groups(p[order])
            rows = []

            def put(part, chosen, copy):
                rows.append((part, copy, doc[chosen].tobytes(), h[chosen].tobytes(), np.diff(off)[chosen].tobytes(),
                             codec.compress(b"".join([x.text(i) for i in chosen.tolist()]), asbytes=True)))
            for chosen in np.split(order, at[1:]):
                part = int(p[chosen[0]])
                put(part, chosen, False)
                head = chosen[(doc[chosen] == first[part][0]) & (h[chosen] == first[part][1])][:1]
                if len(head):
                    put(before[part], head, True)
            kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["p", "copy", "docs", "h", "sizes", "texts"])

    def digest(t: pa.Table):
        codec = pa.Codec("zstd")
        doc, h, texts = [], [], []
        head = None
        for copy, a, b, c, z in zip(*[t.column(k).to_pylist() for k in ("copy", "docs", "h", "sizes", "texts")]):
            size = np.frombuffer(c, np.int64)
            data = codec.decompress(z, int(size.sum()), asbytes=True) if size.sum() else b""
            ends = np.cumsum(size).tolist()
            got = [data[e - n:e] for e, n in zip(ends, size.tolist())]
            if copy:
                head = got[0]
                continue
            doc.append(np.frombuffer(a, np.int64))
            h.append(np.frombuffer(b, np.int64))
            texts += got
        doc, h = np.concatenate(doc), np.concatenate(h)
        order = np.lexsort((h, doc))
        doc = doc[order]
        texts = [texts[i] for i in order.tolist()]
        for a in range(0, len(doc), 512):  # bounded memory within the part
            z = min(len(doc), a + 512)
            here = texts[a:z] + [texts[z] if z < len(doc) else head]
            sizes = np.cumsum([0, *map(len, here)])
            buf = np.frombuffer(b"".join(here), np.uint8)
            starts = (buf & 0xC0) != 0x80
            chars = np.diff(np.concatenate([[0], np.cumsum(starts)])[sizes])
            edited = []
            for i in range(z - a):
                half = int(chars[i]) // 2
                mine = np.flatnonzero(starts[sizes[i]:sizes[i + 1]])
                end = int(mine[chars[i] - half]) if half else len(here[i])
                other = here[i + 1]
                if half < chars[i + 1]:
                    other = other[:int(np.flatnonzero(starts[sizes[i + 1]:sizes[i + 2]])[half])]
                edited.append(here[i][:end] + other)
            f = filters(buf, sizes, rank)
            e = filters(np.frombuffer(b"".join(edited), np.uint8), np.cumsum([0, *map(len, edited)]), rank)
            yield pa.table([null_ids(doc[a:z]), pa.array(chars[:z - a].astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
                            pa.array([written(x) for x in f[:z - a]]), pa.array([written(x) for x in e]),
                            pa.array([likeness(x, y) for x, y in zip(f, e)]), pa.array([likeness(x, y) for x, y in zip(f, f[1:])])],
                           names=[x.split()[0] for x in SCHEMA.split(", ")])

    if not heads:
        return spark.createDataFrame([], SCHEMA)
    dealt = d.mapInArrow(deal, "p int, copy boolean, docs binary, h binary, sizes binary, texts binary")
    return serve(dealt, len(bounds) + 1, digest, SCHEMA, key="p")
