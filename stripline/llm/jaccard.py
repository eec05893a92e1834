"""Jaccard join of word n-gram sets, size-aware: subsets of small sets, inverted lists of large ones.

Equal sets are one class from the start.  Shingles are ordered from rare to common; two sets that are similar enough share ``c`` of the first
``size - ceil(t * size) + c``.  A *light* set enumerates all subsets of ``c = 2`` of these, a *heavy* one is posted in the inverted list of each with
``c = 1``; sets near the boundary do both.  The boundary is the size at which subsets and postings cost least, by counts over all sets.  Shingles
of one document only need neither.

In a list every set is first compared with one hub.  Components of these links leave few lists that hold several components, and there each pair across
components is compared: pair by pair in short lists, and tile by tile, through the inverted lists of the tile, in long ones, so that
a task holds two bounded tiles and returns a spanning forest of the links between them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripline.llm.common import (BLOCK_BYTES, LAST, LOWER, SHARD_BYTES, Docs, bits, blobs, blocked, cuts, groups, meet, mix, pack48, parts,
                                  per_block, serve, slices, span_hashes, unbits, unpack48, unpacked, windows, word_spans)
from stripline.operators.graph import components
from stripline.session import cut

WORDS, PERCENT = 5, 80
SHORT, TILE = 48, 512  # sets of a list compared pair by pair; sets of a tile
ROWS = "kind int, doc long, n long, rep long, tokens binary, first int, shingles binary"


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set shares with any set that is similar enough."""
    return -(-percent * size // 100)


class Sets:
    """Shingle sets of a block's documents: hash and row of each distinct shingle, ordered by hash, then row."""

    def __init__(self, d: Docs, words: int):
        hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for i, j in slices(d.off):
            part, local = LOWER[d.buf[d.off[i]:d.off[j]]], d.off[i:j + 1] - d.off[i]
            starts, ends, first = word_spans(part, local)
            word, n = span_hashes(part, starts, ends), np.diff(first)
            row = np.repeat(np.arange(j - i), n)
            room = np.repeat(first[1:], n) - np.arange(len(word))
            at = np.flatnonzero(room >= words)
            hashes.append(windows(word, words)[at])
            rows.append(row[at].astype(np.int32) + i)
            for k in range(1, words):  # a text of fewer words is one shingle
                short = np.flatnonzero(n == k)
                if len(short):
                    hashes.append(mix(windows(word, k)[first[short]] + np.uint64(k)))
                    rows.append(short.astype(np.int32) + i)
        h, row = np.concatenate(hashes), np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.h, self.row = h[new], row[new]
        self.at = groups(self.h)
        self.df = np.diff(np.append(self.at, len(self.h)))
        self.size = np.bincount(self.row, minlength=len(d))
        self.one, self.two = np.zeros(len(d), np.uint64), np.zeros(len(d), np.uint64)  # of whole sets
        np.add.at(self.one, self.row, self.h)
        np.add.at(self.two, self.row, mix(self.h ^ np.uint64(0x5851F42D4C957F2D)))
        self.one = mix(self.one ^ self.size.astype(np.uint64))


def classes(s: Sets) -> np.ndarray:
    """Rows that begin a class of equal sets in the block, ordered by the sets' hashes; empty sets have none."""
    order = np.lexsort((np.arange(len(s.size)), s.two, s.one))
    order = order[s.size[order] > 0]
    new = np.ones(len(order), bool)
    new[1:] = (s.one[order][1:] != s.one[order][:-1]) | (s.two[order][1:] != s.two[order][:-1])
    return order, new


def prefixes(docs: DataFrame, words: int, percent: int, per_block_bytes: int) -> DataFrame:
    """Kind 0: every row's document, set size and class; kind 1: the first shared shingles of each class's set, and the set."""
    blocks = blocked(docs, per_block_bytes)
    shards = parts(docs, SHARD_BYTES)

    def ask(t: pa.Table) -> pa.Table:
        d = unpacked(t)
        s = Sets(d, words)
        b = t.column("_b")[0].as_py()
        h, rows = s.h[s.at], []
        c = cuts(h, shards)
        for k in np.flatnonzero(np.diff(c)).tolist():
            x = slice(c[k], c[k + 1])
            rows.append((k, b, 0, pack48(h[x], n=shards), b"", s.df[x].astype(np.uint32).tobytes()))
        order, new = classes(s)
        first = order[new]
        c = cuts(s.one[first], shards)
        for k in np.flatnonzero(np.diff(c)).tolist():
            x = first[c[k]:c[k + 1]]
            rows.append((k, b, 1, s.one[x].tobytes(), s.two[x].tobytes(), d.doc[x].tobytes()))
        kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3)
        return pa.table([pa.array(list(x), k) for x, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=["_s", "_b", "kind", "one", "two", "n"])

    def count(t: pa.Table) -> Iterable[pa.Table]:
        out = []
        q = t.filter(pc.equal(t.column("kind"), 0))
        if q.num_rows:
            h = [unpack48(x) for x in blobs(q.column("one"))]
            n = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs(q.column("n"))]).astype(np.int64)
            everything = np.concatenate(h)
            order = np.argsort(everything, kind="stable")
            at = groups(everything[order])
            df = np.empty(len(order), np.int64)
            df[order] = np.repeat(np.add.reduceat(n[order], at), np.diff(np.append(at, len(order))))
            ends = np.cumsum([len(x) for x in h])
            for b, k, x in zip(q.column("_b").to_pylist(), q.column("_s").to_pylist(), np.split(df, ends[:-1])):
                out.append((b, k, 0, bits(x > 1), x[x > 1].astype(np.uint32).tobytes()))
        q = t.filter(pc.equal(t.column("kind"), 1))
        if q.num_rows:
            one, two, doc = ([np.frombuffer(x, k) for x in blobs(q.column(c))] for c, k in (("one", np.uint64), ("two", np.uint64), ("n", np.int64)))
            a, z, m = np.concatenate(one), np.concatenate(two), np.concatenate(doc)
            order = np.lexsort((m, z, a))
            new = np.ones(len(order), bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (z[order][1:] != z[order][:-1])
            rep = np.empty(len(order), np.int64)
            rep[order] = m[order][new][np.cumsum(new) - 1]
            ends = np.cumsum([len(x) for x in one])
            for b, k, x in zip(q.column("_b").to_pylist(), q.column("_s").to_pylist(), np.split(rep, ends[:-1])):
                out.append((b, k, 1, x.tobytes(), b""))
        yield pa.table([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                       names=["_b", "_s", "kind", "one", "df"])

    def finish(t: pa.Table, got: pa.Table) -> pa.Table:
        d = unpacked(t)
        s = Sets(d, words)
        df = np.ones(len(s.at), np.int64)
        c = cuts(s.h[s.at], shards)
        order, new = classes(s)
        first = order[new]
        e = cuts(s.one[first], shards)
        rep_of = np.zeros(len(first), np.int64)
        for k, kind, x, y in zip(got.column("_s").to_pylist(), got.column("kind").to_pylist(), blobs(got.column("one")), blobs(got.column("df"))):
            if kind == 0:
                part = df[c[k]:c[k + 1]]
                part[unbits(x, len(part))] = np.frombuffer(y, np.uint32)
            else:
                rep_of[e[k]:e[k + 1]] = np.frombuffer(x, np.int64)
        rep = d.doc.copy()  # an empty set is alone
        rep[order] = rep_of[np.cumsum(new) - 1]
        df = np.repeat(df, s.df)
        shared = df > 1
        alone = s.size - np.bincount(s.row[shared], minlength=len(d))
        longest = s.size - needed(s.size, percent) + 2
        lead = np.zeros(len(d), bool)
        lead[first] = rep_of == d.doc[first]
        lead &= (alone < longest) & (s.size > 1)
        use = lead[s.row]
        h, row, df = s.h[use], s.row[use], df[use]
        order = np.lexsort((h, df, row))
        h, row, df = h[order], row[order], df[order]
        at = groups(row)
        rows = []
        for a, z in zip(at.tolist(), np.append(at[1:], len(row)).tolist()):
            r = int(row[a])
            begin = a + int(alone[r])
            end = a + min(int(longest[r]), z - a)
            rows.append((1, int(d.doc[r]), z - a, int(rep[r]), h[begin:end].tobytes(), max(0, end - begin - (1 if end - a == longest[r] else 0)),
                         pack48(np.sort(h[a:z]))))
        n = len(d)
        cols = list(zip(*rows)) or [()] * 7
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        names = [x.split()[0] for x in ROWS.split(", ")]
        whole = pa.table([pa.array(np.zeros(n, np.int32)), pa.array(d.doc), pa.array(s.size.astype(np.int64)), pa.array(rep), pa.nulls(n, pa.binary()),
                          pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        return pa.concat_tables([whole, pa.table([pa.array(list(x), k) for x, k in zip(cols, kinds)], names=names)])

    answers = serve(per_block(blocks, ask, "_s int, _b long, kind int, one binary, two binary, n binary"), shards, count,
                    "_b long, _s int, kind int, one binary, df binary")
    return cut(meet(blocks, answers, finish, ROWS))


def boundary(sets: DataFrame, percent: int) -> int:
    """Largest light size: the one at which enumerated subsets of light sets and postings of the others (each one comparison) cost least."""
    m = F.octet_length("tokens") / 8
    step = F.floor(F.log("n") / np.log(1.05))  # sizes within 5 % of each other count together
    per = sets.groupBy(step.alias("step")).agg(F.max("n").alias("n"), F.sum(m * (m - 1) / 2).alias("subsets"), F.sum(2 * F.col("first")).alias("postings"))
    rows = sorted((r.n, r.subsets, r.postings) for r in per.collect())
    best, cost = 0, sum(r[2] for r in rows)
    for x, *_ in rows:
        now = sum(s for n, s, _ in rows if n <= x) + sum(p for n, _, p in rows if 100 * n > percent * x)
        if now < cost:
            best, cost = x, now
    return best


def postings(sets: DataFrame, light: int, percent: int) -> DataFrame:
    """``key, rep, n``: the lists of subsets of light sets and of single shingles of heavy ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, reps, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for rep, n, tokens, first in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                h = np.frombuffer(tokens, np.uint64)
                got = []
                if n <= light and len(h) > 1:
                    i, j = np.triu_indices(len(h), 1)
                    a, b = np.minimum(h[i], h[j]), np.maximum(h[i], h[j])
                    got.append(mix(a * np.uint64(0x9E3779B97F4A7C15) + b))
                if 100 * n > percent * light and first:
                    got.append(h[:first])
                for k in got:
                    keys.append(k)
                    reps.append(np.full(len(k), rep))
                    sizes.append(np.full(len(k), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(reps)), pa.array(np.concatenate(sizes))],
                                             ["key", "rep", "n"])
    return sets.select("rep", "n", "tokens", "first").mapInArrow(run, "key long, rep long, n long")


def similar(a: bytes, b: bytes, percent: int) -> bool:
    x, y = unpack48(a), unpack48(b)
    both = np.sort(np.concatenate([x, y]))
    n = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * n >= percent * (len(x) + len(y) - n)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough."""
    s = sets.select("rep", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            ok = np.array([similar(p, q, percent) for p, q in zip(x, y)], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])

    both = pairs.join(s.withColumnsRenamed({"rep": "a", "shingles": "x"}), "a").join(s.withColumnsRenamed({"rep": "b", "shingles": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def tile_links(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Spanning forest of the links between the sets of two tiles that are in different components."""
    def side(t):
        sets = [unpack48(x) for x in blobs(t.column("shingles"))]
        n = np.array([len(x) for x in sets], np.int64)
        return t.column("rep").to_numpy(), t.column("component").to_numpy(), n, np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(n)), n)
    (ra, ca, na, ha, oa), (rb, cb, nb, hb, ob) = side(left), side(right)
    order = np.argsort(hb, kind="stable")
    hb, ob = hb[order], ob[order]
    lo, hi = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
    out: list[tuple[int, int]] = []
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x
    bounds = np.concatenate([[0], np.cumsum(na)])
    for i in range(len(na)):  # scan the lists of one set's shingles
        x = slice(bounds[i], bounds[i + 1])
        n = hi[x] - lo[x]
        places = np.repeat(lo[x] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(ob[places], minlength=len(nb))
        for j in np.flatnonzero((100 * both >= percent * (na[i] + nb - both)) & (ca[i] != cb)).tolist():
            a, b = root(int(ca[i])), root(int(cb[j]))
            if a != b:
                parent[a] = b
                out.append((int(ra[i]), int(rb[j])))
    return pa.table([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, per_block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Components of the documents whose word n-gram sets have a Jaccard similarity of ``percent`` or more.

    docs: ``doc_id, text``; words are compared with A-Z lower-cased.  A set is the distinct shingles of ``words`` words; a text of fewer words is one
    shingle; an empty or null text has none and is linked with nothing.  Returns a row for each row: ``doc_id, n_shingles`` and
    ``component_id``, the smallest doc_id reachable by links.  Rows that share a doc_id are one document with several sets; those without one count as one
    document with the largest id.  Shingles are compared by 64-bit hashes, in the exact comparison by 48 of their bits.
    """
    rows = prefixes(docs, words, percent, per_block_bytes)
    sets = rows.filter("kind = 1").select("rep", "n", "tokens", "first", "shingles")
    light = boundary(sets, percent)
    entries = postings(sets, light, percent)
    hubs = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("hub"), F.min_by("n", "rep").alias("hub_n")).filter("m > 1")
    lists = cut(entries.join(hubs, "key"))

    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    tested = lists.filter((F.col("rep") != F.col("hub")) & fits(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = cut(verified(tested, sets, percent))
    found = components(links)

    placed = lists.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi").select("key")
    left = cut(placed.join(mixed, "key").select("key", "rep", "n", "m", "hub", "component"))
    short = left.filter(F.col("m") <= SHORT)
    a, b = short.alias("a"), short.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.component") != F.col("b.component"))
                   & (F.col("a.rep") != F.col("a.hub")) & fits(F.col("a.n"), F.col("b.n")))
    more = verified(pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct(), sets, percent)

    # long lists: the sets outside of a list's largest component, tile by tile, against all of the list
    long = left.filter(F.col("m") > SHORT)
    most = long.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(
        F.max_by("component", F.struct("k", F.col("component"))).alias("main"), F.sum("k").alias("all"), F.max("k").alias("k"))
    tiled = long.join(most, "key").join(sets.select("rep", "shingles"), "rep")
    rows_of = F.ceil((F.col("all") - F.col("k")) / TILE).cast("int")
    columns = F.ceil(F.col("all") / TILE).cast("int")
    here = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    up = tiled.filter("component != main").withColumn("i", here(rows_of)).withColumn("j", F.explode(F.sequence(F.lit(0), columns - 1)))
    down = tiled.withColumn("j", here(columns)).withColumn("i", F.explode(F.sequence(F.lit(0), rows_of - 1)))
    cols = ["key", "i", "j", "rep", "component", "shingles"]
    sides = up.select(*cols, F.lit(0).alias("side")).unionByName(down.select(*cols, F.lit(1).alias("side")))
    rest = sides.groupBy("key", "i", "j").applyInArrow(lambda t: tile_links(*(t.filter(pc.equal(t.column("side"), k)) for k in (0, 1)), percent), "a long, b long")

    final = components(links.unionByName(more).unionByName(rest))
    who = rows.filter("kind = 0").select("doc", "n", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    known = lambda c: F.when(c != LAST, c)
    return who.select(known(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), known(F.coalesce("component", "rep")).alias("component_id"))
