"""How the sources of a language differ in their terms.

Terms are packed by length: one of at most 8 bytes is one uint64 word (big-endian, filled with zeros, so that words order as bytes do), one of at most 16
bytes two words; longer ones lie in buckets by length, whose bytes are sorted as they are.  A task sorts the packed terms of its documents by radix (16
bits at a time), and counts runs; the distinct terms of a stretch of text go, still packed, to the shards of the term space, which sort and count the
runs of all stretches in the same way.  A term that every document holds is one entry for each stretch and source.

Two sources are compared over all kept terms without visiting those that both lack: the terms that one of them has are summed from a histogram of
its shares, and only terms that both have are met pair by pair.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from stripline.llm.common import LOWER, blobs, deal, flat, mix, parts, serve, slices
from stripline.session import cut

LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
SHARD_BYTES = 16 << 20    # text whose distinct terms one shard counts
STRETCH_BYTES = 6 << 20   # text whose terms are sorted together
PAIRS_AT_ONCE = 1 << 20   # pairs of sources held before they are added up

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def term_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of letters and bytes above 127, none across two rows, and the number of them before each row (rows + 1)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = LETTER[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < len(buf))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """Stable ascending order by unsigned keys, the last the most significant: passes of 16 bits, those in which all are equal left out."""
    order = None
    for key in keys:
        for shift in range(0, 8 * key.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16) if key.itemsize > 2 else key.astype(np.uint16)
            if not len(digit) or (digit == digit[0]).all():
                continue
            step = np.argsort(digit if order is None else digit[order], kind="stable")  # numpy sorts 16-bit keys by radix
            order = step if order is None else order[step]
    return np.arange(len(keys[0])) if order is None else order


def words_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The (at most 8) bytes of each span as a big-endian number, filled with zeros."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[:len(buf)] = buf
    word = np.ndarray(len(buf) + 1, ">u8", padded.data, strides=(1,))[starts].astype(np.uint64)
    gone = (8 * (8 - np.clip(ends - starts, 0, 8))).astype(np.uint64)
    return np.where(gone < 64, word >> (gone & np.uint64(63)) << (gone & np.uint64(63)), np.uint64(0))


class Terms:
    """Some packed terms of one kind with a group, a count and a number of documents each.

    ``keys``: one or two arrays of words, the first the more significant, or one array of byte strings.
    """

    def __init__(self, keys: tuple[np.ndarray, ...], group: np.ndarray, count: np.ndarray, docs: np.ndarray):
        self.keys, self.group, self.count, self.docs = keys, group, count, docs

    def __len__(self) -> int:
        return len(self.group)

    def order(self, after: Sequence[np.ndarray] = (), before: Sequence[np.ndarray] = ()) -> np.ndarray:
        """Order by ``before``, then term, then ``after``, then whatever came first."""
        if self.keys[0].dtype.kind != "S":
            return radix_order(*after, *self.keys[::-1], *before)
        order = radix_order(*after) if after else np.arange(len(self))
        order = order[np.argsort(self.keys[0][order], kind="stable")]
        return order[radix_order(*[k[order] for k in before])] if before else order

    def take(self, order: np.ndarray) -> Terms:
        return Terms(tuple(k[order] for k in self.keys), self.group[order], self.count[order], self.docs[order])

    def runs(self, *more: np.ndarray) -> np.ndarray:
        """Start of each run of equal terms (and equal values of ``more``) in this order."""
        new = np.ones(len(self), bool)
        if len(self):
            new[1:] = False
            for k in (*self.keys, *more):
                new[1:] |= k[1:] != k[:-1]
        return np.flatnonzero(new)

    def added(self, at: np.ndarray) -> Terms:
        """One entry for each run."""
        if not len(at):
            return self
        return Terms(tuple(k[at] for k in self.keys), self.group[at], np.add.reduceat(self.count, at), np.add.reduceat(self.docs, at))


def width_of(size: int) -> int:
    """Bucket of a long term: the power of two that its length doesn't exceed."""
    return 1 << max(5, (size - 1).bit_length())


def packed_terms(buf: np.ndarray, off: np.ndarray, group: np.ndarray) -> dict[int, Terms]:
    """All terms of some texts by kind (1 or 2 words, or the width of a bucket), counted by term and group.

    ``group`` is ascending over the texts, so that equal terms of one group and of one text stay together.
    """
    buf = LOWER[buf]
    starts, ends, n = term_spans(buf, off)
    text = np.repeat(np.arange(len(off) - 1), np.diff(n))
    size = ends - starts
    kind = np.where(size <= 8, 1, np.where(size <= 16, 2, 0))
    long = np.flatnonzero(kind == 0)
    if len(long):
        kind[long] = [width_of(x) for x in size[long].tolist()]
    out = {}
    for k in np.unique(kind).tolist():
        i = np.flatnonzero(kind == k)
        if k == 1:
            keys = (words_of(buf, starts[i], ends[i]),)
        elif k == 2:
            keys = (words_of(buf, starts[i], starts[i] + 8), words_of(buf, starts[i] + 8, ends[i]))
        else:
            data = buf.tobytes()
            keys = (np.array([data[a:z] for a, z in zip(starts[i].tolist(), ends[i].tolist())], f"S{k}"),)
        one = np.ones(len(i), np.int64)
        t = Terms(keys, text[i], one, one)
        t = t.take(t.order())
        t = t.added(t.runs(t.group))  # a term of one text
        t = Terms(t.keys, group[t.group], t.count, np.ones(len(t), np.int64))
        out[k] = t.added(t.runs(t.group))
    return out


def shard_of(keys: tuple[np.ndarray, ...], shards: int) -> np.ndarray:
    """Shard of each term, by a hash of its words; a long term goes by its first 16 bytes and its length."""
    if keys[0].dtype.kind == "S":
        k = keys[0]
        head = np.ascontiguousarray(k).view(np.uint8).reshape(len(k), -1)[:, :16].copy().view(np.uint64)
        h = mix(head[:, 0]) * np.uint64(3) ^ head[:, 1] ^ np.char.str_len(k).astype(np.uint64)
    else:
        h = keys[0] if len(keys) == 1 else mix(keys[0]) * np.uint64(5) ^ keys[1]
    return deal(mix(h), shards)


PACKED = "_s int, kind int, groups string, terms binary, more binary, at binary, count binary, docs binary"
NAMES = [x.split()[0] for x in PACKED.split(", ")]
KINDS = [pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 5]


def stretches(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each stretch of text, packed for each shard."""
    for batch in batches:
        if not batch.num_rows:
            continue
        named = [json.dumps(x) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        names, number = np.unique(np.array(named, object), return_inverse=True)
        order = np.argsort(number, kind="stable")
        buf, off = flat(batch.column(0).take(pa.array(order)))
        number = number[order]
        for i, j in slices(off, STRETCH_BYTES):
            rows = []
            for kind, t in packed_terms(buf[off[i]:off[j]], off[i:j + 1] - off[i], number[i:j]).items():
                s = shard_of(t.keys, shards)
                order = np.argsort(s, kind="stable")
                t, bounds = t.take(order), np.searchsorted(s[order], np.arange(shards + 1))
                for k in np.flatnonzero(np.diff(bounds)).tolist():
                    x = slice(bounds[k], bounds[k + 1])
                    mine, at = np.unique(t.group[x], return_inverse=True)
                    rows.append((k, kind, "[" + ",".join(names[mine]) + "]", t.keys[0][x].tobytes(), t.keys[1][x].tobytes() if kind == 2 else b"",
                                 at.astype(np.uint32).tobytes(), t.count[x].astype(np.uint32).tobytes(), t.docs[x].astype(np.uint32).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), KINDS)], NAMES)


def kept_terms(t: pa.Table, least: int) -> Iterable[pa.Table]:
    """A shard's terms with ``least`` documents or more in a language: term, its language, its sources and their counts."""
    langs: dict[str, int] = {}
    pairs: dict[tuple[str, str], int] = {}
    for kind in sorted(set(t.column("kind").to_pylist())):
        part = t.filter(pc.equal(t.column("kind"), kind))
        group = []
        for g, at in zip(part.column("groups").to_pylist(), blobs(part.column("at"))):
            local = np.array([pairs.setdefault(tuple(x), len(pairs)) for x in json.loads(g)], np.int64)
            group.append(local[np.frombuffer(at, np.uint32)])
        dtype = np.dtype(f"S{kind}") if kind > 2 else np.dtype(np.uint64)
        read = lambda name, of: np.concatenate([np.frombuffer(x, of) for x in blobs(part.column(name))])  # noqa: E731, B023
        keys = (read("terms", dtype), read("more", dtype)) if kind == 2 else (read("terms", dtype),)
        e = Terms(keys, np.concatenate(group), read("count", np.uint32).astype(np.int64), read("docs", np.uint32).astype(np.int64))
        lang_of = np.array([langs.setdefault(lang, len(langs)) for lang, _ in pairs], np.uint32)
        e = e.take(e.order([e.group.astype(np.uint32)], [lang_of[e.group]]))
        e = e.added(e.runs(e.group))
        lang = lang_of[e.group]
        at = e.runs(lang)
        keep = np.add.reduceat(e.docs, at) >= least if len(at) else np.zeros(0, bool)
        sizes = np.diff(np.append(at, len(e)))
        inside = np.repeat(keep, sizes)
        at = at[keep]
        if kind == 1:
            raw = [x.rstrip(b"\0") for x in e.keys[0][at].astype(">u8").view("V8").tolist()]
        elif kind == 2:
            raw = [(a + b).rstrip(b"\0") for a, b in zip(e.keys[0][at].astype(">u8").view("V8").tolist(), e.keys[1][at].astype(">u8").view("V8").tolist())]
        else:
            raw = e.keys[0][at].tolist()
        lang_names, source_names = list(langs), [s for _, s in pairs]
        ends = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32)
        sources = pa.array(source_names, pa.string()).take(pa.array(e.group[inside]))
        yield pa.table([pa.array([lang_names[x] for x in lang[at].tolist()], pa.string()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string()),
                        pa.ListArray.from_arrays(ends, sources), pa.ListArray.from_arrays(ends, pa.array(e.count[inside], pa.int64()))],
                       names=["lang", "term", "sources", "counts"])


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, term, sources, counts``: the terms with at least ``least_docs`` documents in a language, and how often each of its sources has them.

    Terms are the runs of letters A-Z (lower-cased), a-z and all characters above U+007F.  A null text, language or source counts as empty; each row is
    a document of its own.  The array of a term has one entry for each source that has it.
    """
    shards = parts(docs, shard_bytes)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), name(lang), name(source))
    packed = rows.mapInArrow(lambda b: stretches(b, shards), PACKED)
    return serve(packed, shards, lambda t: kept_terms(t, least_docs), "lang string, term string, sources array<string>, counts array<bigint>")


def share(count, total, terms):
    """``1 + floor(10^9 * (count + 1) / (total + terms))``, without overflow."""
    return (F.lit(1) + F.expr(f"div(cast({count} + 1 as decimal(20, 0)) * {SCALE}, cast({total} + {terms} as decimal(20, 0)))")).cast("long")


def apart(p: str, q: str):
    """``floor((p - q)^2 / q)``; shares are at most 10^9 + 1, so the square fits a long."""
    return F.expr(f"div(({p} - {q}) * ({p} - {q}), {q})")


class Pairs:
    """Sums for ordered pairs of sources, added up whenever there are many."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> None:
        self.held.append((a, b, s))
        self.size += len(a)

    def taken(self, most: int = 0) -> Iterator[pa.RecordBatch]:
        """What is held, if it is more than ``most`` even after adding up."""
        if self.size <= most or not self.size:
            return
        a, b, s = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        self.held = [(a[at], b[at], np.add.reduceat(s[order], at))]
        self.size = len(at)
        if self.size > most // 2:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in self.held[0]], ["a", "b", "s"])
            self.held, self.size = [], 0


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is still missing from the sums of two sources because both have a term.

    Rows ``_t, _g, p, none`` (term, source, its share, the share of a term it lacks) come by term; an entry meets those after it, first the next of all
    entries, then the second next, and so on, while the term is the same.
    """
    def far(p, q):
        return (p - q) * (p - q) // q

    sums, left = Pairs(), [np.zeros(0, np.int64)] * 4
    for batch in batches:
        cols = [np.concatenate((old, batch.column(i).to_numpy())) for i, old in enumerate(left)]
        end = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last term may go on
        left = [c[end:] for c in cols]
        yield from _meet(sums, far, *[c[:end] for c in cols])
    yield from _meet(sums, far, *left)
    yield from sums.taken()


def _meet(sums: Pairs, far, term, g, p, none) -> Iterator[pa.RecordBatch]:
    at, shift = np.arange(len(term)), 1
    while True:
        at = at[at < len(term) - shift]
        at = at[term[at] == term[at + shift]]
        if not len(at):
            return
        for a, b in ((at, at + shift), (at + shift, at)):
            sums.add(g[a], g[b], far(p[a], p[b]) - far(p[a], none[b]) - far(none[a], p[b]) + far(none[a], none[b]))
        yield from sums.taken(PAIRS_AT_ONCE)
        shift += 1


def audit_sources(docs: DataFrame, lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, **sizes) -> tuple[DataFrame, DataFrame]:
    """``(pairs, terms)``: how the sources of each language differ.

    Every language keeps the terms of :func:`term_counts`, V in number; a source of it gives each of them the share p = 1 + floor(10^9 (count + 1) / (N + V)),
    N its occurrences of kept terms.  ``pairs`` has ``lang, source, item, value, rank`` for each other source of the language: the sum of
    floor((p - q)^2 / q) over all kept terms, q the other's share (0 if nothing is kept).  ``terms`` has the ``top`` terms of a source by the same value
    against the share q of the whole language, of those that it has, and has more of.  Ranks fall by value, ties by the bytes of the item.  All arithmetic
    is exact.  Sources and languages without terms occur too; without rows both are empty.  The kept terms are written once.
    """
    name = lambda c, a: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
    kept = cut(term_counts(docs, lang, source, least_docs, **sizes).withColumn("_t", F.monotonically_increasing_id()))
    one = kept.withColumn("total", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    rows = one.select("_t", "lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select(
        "_t", "lang", "term", "total", F.col("e.sources").alias("source"), F.col("e.counts").alias("count"))
    langs = one.groupBy("lang").agg(F.count(F.lit(1)).alias("_v"), F.sum("total").alias("_ln"))
    has = rows.groupBy("lang", "source").agg(F.sum("count").alias("_n"))
    g = docs.select(name(lang, "lang"), name(source, "source")).distinct().join(has, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    g = cut(g.withColumn("none", F.when(F.col("_v") > 0, share("0", "_n", "_v")).otherwise(F.lit(1).cast("long"))).withColumn("_g", F.monotonically_increasing_id()))
    entries = rows.join(g, ["lang", "source"]).withColumn("p", share("count", "_n", "_v"))

    more = entries.withColumn("q", share("total", "_ln", "_v")).filter("p > q")
    falling = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = more.select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value")).withColumn("rank", F.row_number().over(falling)).filter(F.col("rank") <= top)

    # sum over all terms = V times the value where both lack a term, what the terms that one has add to that, and what those that both have add to both
    other = g.select("lang", F.col("_g").alias("_o"), F.col("none").alias("_on"))
    both_lack = g.join(other, "lang").filter("_g <> _o").select(F.col("_g").alias("a"), F.col("_o").alias("b"), (F.col("_v") * apart("none", "_on")).alias("s"))
    by_share = entries.groupBy("lang", "_g", "none", "p").agg(F.count(F.lit(1)).alias("m"))
    lone = by_share.join(other, "lang").filter("_g <> _o")
    ahead = lone.select(F.col("_g").alias("a"), F.col("_o").alias("b"), (F.col("m") * (apart("p", "_on") - apart("none", "_on"))).alias("s"))
    behind = lone.select(F.col("_o").alias("a"), F.col("_g").alias("b"), (F.col("m") * (apart("_on", "p") - apart("_on", "none"))).alias("s"))
    by_term = entries.select("_t", "_g", "p", "none").repartition("_t").sortWithinPartitions("_t")
    both = by_term.mapInArrow(met, "a long, b long, s long")
    sums = both_lack.unionByName(ahead).unionByName(behind).unionByName(both).groupBy("a", "b").agg(F.sum("s").alias("value"))
    mine, theirs = g.select(F.col("_g").alias("a"), "lang", "source"), g.select(F.col("_g").alias("b"), F.col("source").alias("item"))
    pairs = sums.join(mine, "a").join(theirs, "b").select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(falling))
    return pairs, terms
