"""Shared parts of the training-data operators: vectorised text access and packed exchanges between blocks and shards.

The operators that compare all documents follow one pattern.  Documents are dealt into *blocks* by a hash of their id (:func:`blocked`),
each a bounded share of the text.  A block sends its distinct hashes, packed, to the *shards* of the hash space (:func:`serve`); a shard
combines what all blocks sent and answers each of them; the answers meet the block's documents again (:func:`meet`).  A key that a third
of all documents hold is one entry per block, whatever its count, so no shard and no task sees a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20    # text of a block
SHARD_BYTES = 16 << 20   # text whose hashes a shard gathers, about as many bytes packed
SLICE_BYTES = 1 << 20    # text that numpy works on at once
LAST = np.iinfo(np.int64).max  # stands for a missing doc_id, which is ordered last

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
CODES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASE)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_sizes: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, counted once for each frame; it only sets numbers of blocks and shards."""
    if docs not in _sizes:
        _sizes[docs] = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return _sizes[docs]


def parts(docs: DataFrame, per: int) -> int:
    """Partitions for about ``per`` bytes of text each, at least as many as the session shuffles into."""
    return max(width(docs.sparkSession), -(-text_bytes(docs) // per))


def documents(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """The columns the operators read, whatever else there is; a null text counts as empty."""
    more = [F.coalesce(F.col(carry).cast("string"), F.lit("")).alias("carry")] if carry else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


class Docs:
    """Documents side by side: ids (``LAST`` where missing), all bytes, and the offsets of the texts in them."""

    def __init__(self, doc: np.ndarray, buf: np.ndarray, off: np.ndarray, carry: list[bytes] | None = None):
        self.doc, self.buf, self.off, self.carry = doc, buf, off, carry
        self._bytes: bytes | None = None

    def __len__(self) -> int:
        return len(self.doc)

    def text(self, i: int) -> bytes:
        if self._bytes is None:
            self._bytes = self.buf.tobytes()
        return self._bytes[self.off[i]:self.off[i + 1]]


def _packed(rows: list[bytes], codec: pa.Codec) -> tuple[bytes, bytes]:
    """Sizes of some values, and the values compressed together."""
    return np.array([len(x) for x in rows], np.int64).tobytes(), codec.compress(b"".join(rows), asbytes=True)


def _rows(sizes: list[bytes], data: list[bytes]) -> list[bytes]:
    codec, out = pa.Codec("zstd"), []
    for s, x in zip(sizes, data):
        ends = np.cumsum(np.frombuffer(s, np.int64)).tolist()
        x = codec.decompress(x, ends[-1], asbytes=True) if ends[-1] else b""
        out += [x[a:z] for a, z in zip([0, *ends], ends)]
    return out


def blocked(docs: DataFrame, per: int = BLOCK_BYTES, carry: str | None = None) -> DataFrame:
    """Documents by block ``_b``, a group of bounded size, in packed rows: the texts that one task has for one block are compressed together.

    There are several blocks to a partition so that partitions even out.  ``carry`` names a string column that goes along.
    """
    n = parts(docs, 2 * per)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            d = Docs(doc, *flat(batch.column(1)))
            c = Docs(doc, *flat(batch.column(2))) if carry else None
            block = (mix(doc.astype(np.uint64) * np.uint64(5)) % np.uint64(2 * n)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            rows = []
            for x in np.split(order, groups(block[order])[1:]):
                i = x.tolist()
                rows.append((int(block[i[0]]), doc[x].tobytes(), *_packed([d.text(k) for k in i], codec), *(_packed([c.text(k) for k in i], codec) if c else ())))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(x, pa.binary()) for x in cols[1:]]], [x.split()[0] for x in schema.split(", ")])

    schema = "_b long, docs binary, sizes binary, texts binary" + (", carry_sizes binary, carry binary" if carry else "")
    return documents(docs, carry).mapInArrow(pack, schema).repartition(n, "_b")


def unpacked(t: pa.Table) -> Docs:
    """A block's documents by ascending id, those that share an id by text: an order that doesn't depend on how rows arrived."""
    doc = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.int64) for x in blobs(t.column("docs"))]])
    text = _rows(blobs(t.column("sizes")), blobs(t.column("texts")))
    carry = _rows(blobs(t.column("carry_sizes")), blobs(t.column("carry"))) if "carry" in t.column_names else None
    order = np.argsort(doc, kind="stable")
    if (np.diff(doc[order]) == 0).any():
        order = np.array(sorted(range(len(doc)), key=lambda i: (doc[i], text[i], carry[i] if carry else b"")))
    i = order.tolist()
    text = [text[k] for k in i]
    off = np.zeros(len(text) + 1, np.int64)
    np.cumsum([len(x) for x in text], out=off[1:])
    return Docs(doc[order], np.frombuffer(b"".join(text), np.uint8), off, [carry[k] for k in i] if carry else None)


def serve(requests: DataFrame, n: int, answer: Callable[[pa.Table], Iterable[pa.Table]], schema: str, key: str = "_s") -> DataFrame:
    """Bring the requests of each of ``n`` shards into one task and answer them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got and sum(b.num_rows for b in got):
            for t in answer(pa.Table.from_batches(got)):
                yield from t.to_batches()
    return stream(requests, n, run, schema, key)


def stream(requests: DataFrame, n: int, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, key: str = "_s") -> DataFrame:
    """The same for a shard that takes its requests batch by batch."""
    return requests.repartitionById(n, F.col(key).cast("int")).mapInArrow(run, schema)


def meet(blocks: DataFrame, answers: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each block's documents together with the answers to it."""
    return blocks.groupBy("_b").cogroup(answers.groupBy("_b")).applyInArrow(fn, schema)


def per_block(blocks: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return blocks.groupBy("_b").applyInArrow(fn, schema)


def ids(t: pa.Table, name: str = "doc_id") -> np.ndarray:
    return t.column(name).fill_null(LAST).to_numpy()


def null_ids(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.int64(), mask=x == LAST)


def flat(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows, without copying rows one by one."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], col.type)
    a = a.fill_null("") if a.null_count else a
    a = a.cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2] if len(a) else None
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """``base ** i`` modulo 2 ** 64 for i < n."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        m = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        x = np.full(m, INVERSE[which] if inverse else BASE[which], np.uint64)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if m <= 4 * SLICE_BYTES:
            _powers[which, inverse] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of disjoint ascending byte ranges: a polynomial of random byte codes, mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    v = np.zeros(len(buf) + 1, np.uint64)
    np.multiply(CODES[which][buf], powers(len(buf), which), out=v[:-1])
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[::2], cuts[1::2] = starts, ends
    h = np.add.reduceat(v, cuts)[::2]
    h[ends == starts] = 0
    h = h * powers(len(buf) + 1, which, True)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+`` and the number of words before each row (rows + 1 values)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[(off > 0) & (off < len(buf))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def windows(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values, by doubling; empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    b = [int(BASE[which])]
    total, have, got = len(h) - n + 1, 0, None
    run, size = h, 1
    m = n
    while m:
        if m & 1:
            got = run[:total].copy() if got is None else got * np.uint64(pow(b[0], size, 1 << 64)) + run[have:have + total]
            have += size
        m >>= 1
        if m:
            run = run[:-size] * np.uint64(pow(b[0], size, 1 << 64)) + run[size:]
            size *= 2
    return mix(got)


def deal(h: np.ndarray, n: int) -> np.ndarray:
    """Shard of each hash: equal ranges of the hash space, so that sorted hashes are dealt in order."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def cuts(h: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the shards (n + 1) in an ascending array of hashes."""
    return np.searchsorted(deal(h, n), np.arange(n + 1))


def pack48(h: np.ndarray, s: int = 0, n: int = 1) -> bytes:
    """48 bits of each hash, below those that name the shard: what the shard already knows isn't sent."""
    k = np.uint64(max(0, min(16, (n - 1).bit_length() - 1)))
    low = (h >> (np.uint64(16) - k)) & np.uint64((1 << 48) - 1)
    return np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def blobs(col) -> list[bytes]:
    return col.to_pylist()


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    new = np.empty(len(sorted_keys), bool)
    new[0] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    return np.flatnonzero(new)
