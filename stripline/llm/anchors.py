"""Removal of repeated word passages, found from fixed-block anchors.

Every text is cut into non-overlapping blocks of half a window; these are the index.  Every rolling window of that many words probes it: any passage of a
whole window that occurs earlier holds one whole block of the earlier place, so a passage without a hit is new.  Hits are extended: the full windows
around them are compared by a 128-bit hash, and all but the first place of each (smallest doc_id, then smallest start) are repeats.
Runs of repeated windows are the maximal exact repeats; their words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stripline.llm.common import (BLOCK_BYTES, SHARD_BYTES, Docs, bits, blobs, blocked, cuts, groups, meet, null_ids, pack48, parts, per_block, serve, slices,
                                  span_hashes, unbits, unpack48, unpacked, windows, word_spans)

WINDOW = 20
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,words:long>>, text string"


def word_hashes(d: Docs) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words before each text (texts + 1)."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in slices(d.off):
        part, local = d.buf[d.off[i]:d.off[j]], d.off[i:j + 1] - d.off[i]
        starts, ends, n = word_spans(part, local)
        hashes.append(span_hashes(part, starts, ends))
        counts.append(np.diff(n))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """Starts of the runs of ``size`` words that lie within one text."""
    n = np.diff(first)
    room = np.repeat(first[1:], n) - np.arange(first[-1])
    return np.flatnonzero(room >= size)


def remove_repeats(docs: DataFrame, window: int = WINDOW, per_block_bytes: int = BLOCK_BYTES, with_text: bool = True) -> DataFrame:
    """Texts without the words covered by a window of ``window`` words that also starts earlier.

    docs: ``doc_id, text``; words are compared unchanged.  Earlier is a smaller doc_id or, in the same document, a smaller start; a missing doc_id is
    the largest; rows that share a doc_id are ordered by their text.  Windows are judged on the input.  Returns a row for each row:
    ``doc_id, n_words, n_removed, kept_sha256`` of the kept words joined by a space, the removed ``spans``, and that ``text`` (null unless
    ``with_text``).  A text of fewer words than a window, an empty one or null loses nothing.
    """
    half = window // 2
    blocks = blocked(docs, per_block_bytes)
    shards = parts(docs, SHARD_BYTES)

    def probes(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all probes, their hashes' places among the distinct ones, and these."""
        at = inside(first, half)
        distinct, place = np.unique(windows(word, half)[at], return_inverse=True)
        return at, place, distinct

    def ask_index(t: pa.Table) -> pa.Table:
        word, first = word_hashes(unpacked(t))
        at, place, distinct = probes(word, first)
        aligned = (at - np.repeat(first[:-1], np.diff(first))[at]) % half == 0
        indexed = np.bincount(place[aligned], minlength=len(distinct)) > 0
        several = np.bincount(place, minlength=len(distinct)) > 1
        c = cuts(distinct, shards)
        some = np.flatnonzero(np.diff(c)).tolist()
        b = t.column("_b")[0].as_py()
        each = lambda f: pa.array([f(slice(c[s], c[s + 1])) for s in some], pa.binary())
        return pa.table([pa.array(some, pa.int32()), pa.array([b] * len(some), pa.int64()), each(lambda x: pack48(distinct[x], n=shards)),
                         each(lambda x: bits(indexed[x])), each(lambda x: bits(several[x]))], names=["_s", "_b", "probe", "indexed", "several"])

    def hits(t: pa.Table) -> Iterable[pa.Table]:
        probe = [unpack48(x) for x in blobs(t.column("probe"))]
        flags = [np.concatenate([unbits(x, len(p)) for x, p in zip(blobs(t.column(k)), probe)]) for k in ("indexed", "several")]
        everything = np.concatenate(probe)
        order = np.argsort(everything, kind="stable")
        at = groups(everything[order])
        n = np.diff(np.append(at, len(order)))
        met = np.maximum.reduceat(flags[0][order], at) & ((n > 1) | np.maximum.reduceat(flags[1][order], at))
        hit = np.empty(len(order), bool)
        hit[order] = np.repeat(met, n)
        ends = np.cumsum([len(p) for p in probe])
        yield pa.table([t.column("_s"), t.column("_b"), pa.array([bits(x) for x in np.split(hit, ends[:-1])], pa.binary())], names=["_s", "_b", "hit"])

    def ask_first(t: pa.Table, got: pa.Table) -> pa.Table:
        d = unpacked(t)
        word, first = word_hashes(d)
        at, place, distinct = probes(word, first)
        hit = np.zeros(len(distinct), bool)
        c = cuts(distinct, shards)
        for s, x in zip(got.column("_s").to_pylist(), blobs(got.column("hit"))):
            hit[c[s]:c[s + 1]] = unbits(x, c[s + 1] - c[s])
        near = np.zeros(len(word) + 1, np.int64)
        near[1:][at] = hit[place]
        near = np.cumsum(near)
        full = inside(first, window)
        full = full[near[full + half] > near[full]]  # a hit at one of the first places: there the earlier passage has a whole block
        b = t.column("_b")[0].as_py()
        mask = np.zeros(len(word), bool)
        mask[full] = True
        rows = [(b % shards, b, -1, bits(mask), b"", b"", b"", b"")]  # for this block itself
        if len(full):
            one, two = (windows(word, window, k)[full] for k in (0, 1))
            order = np.lexsort((two, one))
            new = passages(one[order], two[order])
            f = order[new]
            row = np.searchsorted(first, full[f], "right") - 1
            c2 = cuts(one[f], shards)
            for s in np.flatnonzero(np.diff(c2)).tolist():
                x = slice(c2[s], c2[s + 1])
                used, row_of = np.unique(row[x], return_inverse=True)
                rows.append((s, b, s, one[f][x].tobytes(), two[f][x].tobytes(), d.doc[used].tobytes(), row_of.astype(np.uint32).tobytes(),
                             (full[f][x] - first[row[x]]).astype(np.uint32).tobytes()))
        kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["_s", "_b", "part", "one", "two", "docs", "row", "start"])

    def passages(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Start of each run of equal hash pairs."""
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        return np.flatnonzero(new)

    def firsts(t: pa.Table) -> Iterable[pa.Table]:
        """Which of a block's passages start earlier in another block."""
        part = t.column("part").to_numpy()
        out = [(b, -1, x) for b, k, x in zip(t.column("_b").to_pylist(), part.tolist(), blobs(t.column("one"))) if k < 0]
        ask = t.filter(pa.array(part >= 0))
        if ask.num_rows:
            one, two = ([np.frombuffer(x, np.uint64) for x in blobs(ask.column(k))] for k in ("one", "two"))
            doc = np.concatenate([np.frombuffer(x, np.int64)[np.frombuffer(y, np.uint32)] for x, y in zip(blobs(ask.column("docs")), blobs(ask.column("row")))])
            start = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs(ask.column("start"))])
            a, z = np.concatenate(one), np.concatenate(two)
            order = np.lexsort((start, doc, z, a))
            new = passages(a[order], z[order])
            late = np.ones(len(order), bool)
            late[order[new]] = False
            ends = np.cumsum([len(x) for x in one])
            out += [(b, k, bits(x)) for b, k, x in zip(ask.column("_b").to_pylist(), ask.column("part").to_pylist(), np.split(late, ends[:-1]))]
        yield pa.table([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], names=["_b", "part", "late"])

    def finish(t: pa.Table, got: pa.Table) -> pa.Table:
        d = unpacked(t)
        word, first = word_hashes(d)
        answers = dict(zip(got.column("part").to_pylist(), blobs(got.column("late"))))
        full = np.flatnonzero(unbits(answers.pop(-1), len(word))) if -1 in answers else np.zeros(0, np.int64)
        covered = np.zeros(len(word) + 1, np.int64)
        if len(full):
            one, two = (windows(word, window, k)[full] for k in (0, 1))
            order = np.lexsort((two, one))
            new = passages(one[order], two[order])
            c = cuts(one[order[new]], shards)
            late = np.zeros(len(new), bool)
            for s, x in answers.items():
                late[c[s]:c[s + 1]] = unbits(x, c[s + 1] - c[s])
            repeat = np.ones(len(full), bool)
            repeat[order[new]] = late
            at = full[repeat]
            covered += np.bincount(at, minlength=len(covered))
            covered -= np.bincount(at + window, minlength=len(covered))
        gone = np.cumsum(covered)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(gone)])[first]
        sha, texts, spans = [], [], []
        for r in range(len(d.doc)):
            words = d.text(r).split()
            if total[r + 1] > total[r]:
                x = gone[first[r]:first[r + 1]]
                words = list(compress(words, (~x).tolist()))
                e = np.diff(np.concatenate([[0], x.astype(np.int8), [0]]))
                spans.append([{"start": a, "words": z - a} for a, z in zip(np.flatnonzero(e == 1).tolist(), np.flatnonzero(e == -1).tolist())])
            else:
                spans.append([])
            kept = b" ".join(words)
            sha.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept if with_text else None)
        return pa.table([null_ids(d.doc), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(total), pa.int64()), pa.array(sha, pa.string()),
                         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))), pa.array(texts, pa.binary()).cast(pa.string())],
                        names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "text"])

    index = serve(per_block(blocks, ask_index, "_s int, _b long, probe binary, indexed binary, several binary"), shards, hits, "_s int, _b long, hit binary")
    asked = meet(blocks, index, ask_first, "_s int, _b long, part int, one binary, two binary, docs binary, row binary, start binary")
    return meet(blocks, serve(asked, shards, firsts, "_b long, part int, late binary"), finish, SCHEMA)
