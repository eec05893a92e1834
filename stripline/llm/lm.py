"""Scores of an n-gram language model kept as a weighted backoff automaton.

States are the words seen before another (and the start of a text), and the empty history.  A state has an arc for each word seen after it, with the
smoothed log-probability; any other word follows the failure arc to the empty history, whose weight is the mass that smoothing set
aside, and from there the arc of the word alone.  A text is read once from left to right: each token adds the weight of its arc, or of the failure
arc and the lower arc, and moves to the token's own state.

The model is never in one place.  The shard that owns a word counts it, its successors and how many they are; a block of documents asks for the part of
the automaton that its texts walk over.  Successors of the few very frequent words are spread over all shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripline.llm.common import (BLOCK_BYTES, LOWER, blobs, blocked, cuts, deal, documents, flat, groups, meet, mix, null_ids, parts, per_block,
                                  serve, slices, span_hashes, unpack48, unpacked, word_spans)
from stripline.session import cut

DISCOUNT = 0.75
FOLDS, HELD_OUT = 7, 2
SHARD_BYTES = 8 << 20  # a shard counts arcs, which takes about ten times their packed size
FREQUENT = 1 / 1000  # words of a larger share of the tokens (so fewer than 1000) have their successors spread
START, END = np.uint64(0x5157A27), np.uint64(0xE2D0F7E)
SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: int | None, folds: int = FOLDS, fold: int = HELD_OUT) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words then the end, and the number of tokens before each text (texts + 1)."""
    hashes, counts = [], [np.zeros(1, np.int64)]
    for i, j in slices(off):
        part, local = buf[off[i]:off[j]], off[i:j + 1] - off[i]
        starts, ends, n = word_spans(part, local)
        hashes.append(np.insert(span_hashes(LOWER[part], starts, ends), n[1:], END))
        counts.append(np.diff(n) + 1)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(np.concatenate(counts))


class Walk:
    """A block's tokens and the distinct arcs they ask for, in an order that depends on the texts alone."""

    def __init__(self, t: pa.Table, frequent: np.ndarray, shards: int, folds: int, fold: int):
        d = unpacked(t)
        self.doc = d.doc
        token, self.first = tokens(d.buf, d.off)
        n = np.diff(self.first)
        self.held = np.array([held_out(None if x == np.iinfo(np.int64).max else x, folds, fold) for x in self.doc.tolist()], bool)
        train = np.repeat(~self.held, n)
        self.words, at = np.unique(np.append(token, START), return_inverse=True)
        self.start = at[-1]
        self.to = at[:-1]
        self.since = np.empty_like(self.to)  # the word before, or the start
        self.since[1:] = self.to[:-1]
        self.since[self.first[:-1]] = self.start
        w = len(self.words)
        self.count = np.bincount(self.to[train], minlength=w)
        self.count[self.start] = np.count_nonzero(~self.held)
        often = np.isin(self.words, frequent)
        # arcs: by the state's owner and the state; those of frequent words by the arc's own hash
        arc, self.arc = np.unique(self.since * w + self.to, return_inverse=True)
        n_arc = np.bincount(self.arc[train], minlength=len(arc))
        v, u = np.divmod(arc, w)
        lane = often[v]
        spread = mix(self.words[v[lane]] * np.uint64(3) ^ self.words[u[lane]])
        order = np.lexsort((u[lane], v[lane], deal(spread, shards)))
        self.own, self.lane = np.flatnonzero(~lane), np.flatnonzero(lane)[order]
        self.v, self.u, self.n_arc, self.n_arcs = v, u, n_arc, len(arc)
        self.lane_shard = deal(spread[order], shards)

    def requests(self, frequent: np.ndarray, shards: int, b: int) -> pa.Table:
        rows = []
        c = cuts(self.words, shards)
        out_degree = np.bincount(self.v[self.own], minlength=len(self.words))
        a = np.concatenate([[0], np.cumsum(out_degree)])
        target = self.words[self.u]
        six = lambda arcs: np.ascontiguousarray(target[arcs].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
        for s in np.flatnonzero(np.diff(c)).tolist():
            x, arcs = slice(c[s], c[s + 1]), self.own[a[c[s]]:a[c[s + 1]]]
            rows.append((s, b, 0, self.words[x].tobytes(), self.count[x].astype(np.uint32).tobytes(), out_degree[x].astype(np.uint32).tobytes(), six(arcs),
                         self.n_arc[arcs].astype(np.uint32).tobytes()))
        c = np.searchsorted(self.lane_shard, np.arange(shards + 1))
        number = np.searchsorted(frequent, self.words[self.v[self.lane]]).astype(np.uint16)
        for s in np.flatnonzero(np.diff(c)).tolist():
            arcs = self.lane[c[s]:c[s + 1]]
            rows.append((s, b, 1, number[c[s]:c[s + 1]].tobytes(), b"", b"", six(arcs), self.n_arc[arcs].astype(np.uint32).tobytes()))
        kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["_s", "_b", "kind", "words", "count", "degree", "arcs", "n_arcs"])


REQUESTS = "_s int, _b long, kind int, words binary, count binary, degree binary, arcs binary, n_arcs binary"
ANSWERS = "_b long, _s int, kind int, count binary, successors binary, arcs binary"
ints = lambda col, kind: [np.frombuffer(x, kind) for x in blobs(col)]


def merged(state: np.ndarray, arc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Total of each entry's arc over all blocks, and the distinct seen arcs' states (one entry each)."""
    key = mix(state.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ arc)
    order = np.argsort(key, kind="stable")
    at = groups(key[order])
    del key, arc
    total = np.add.reduceat(n[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    back = np.empty(len(order), np.int64)
    back[order] = np.repeat(total, np.diff(np.append(at, len(order))))
    return back, state[order[at]][total > 0]


def counted(t: pa.Table) -> Iterable[pa.Table]:
    """A shard's part of the model: what each block asked for; block -1 gets the totals, block -2 the successors of frequent words."""
    out = []
    s = t.column("_s")[0].as_py()
    own, lanes = (t.filter(pc.equal(t.column("kind"), k)) for k in (0, 1))
    if own.num_rows:
        words, count, degree = ints(own.column("words"), np.uint64), ints(own.column("count"), np.uint32), ints(own.column("degree"), np.uint32)
        distinct, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, np.concatenate(count), len(distinct)).astype(np.int64)
        arcs = [unpack48(x) for x in blobs(own.column("arcs"))]
        back, seen = merged(np.repeat(at, np.concatenate(degree)), np.concatenate(arcs), np.concatenate(ints(own.column("n_arcs"), np.uint32)))
        successors = np.bincount(seen, minlength=len(distinct))
        i = j = 0
        for b, w, a in zip(own.column("_b").to_pylist(), words, arcs):
            k = at[i:i + len(w)]
            out.append((b, s, 0, total[k].tobytes(), successors[k].astype(np.uint32).tobytes(), back[j:j + len(a)].astype(np.uint32).tobytes()))
            i, j = i + len(w), j + len(a)
        token = distinct != START
        out.append((-1, s, 0, np.array([total[token].sum(), np.count_nonzero(total[token])]).tobytes(), b"", b""))
    if lanes.num_rows:
        number, arcs = ints(lanes.column("words"), np.uint16), [unpack48(x) for x in blobs(lanes.column("arcs"))]
        back, seen = merged(np.concatenate(number), np.concatenate(arcs), np.concatenate(ints(lanes.column("n_arcs"), np.uint32)))
        j = 0
        for b, a in zip(lanes.column("_b").to_pylist(), arcs):
            out.append((b, s, 1, b"", b"", back[j:j + len(a)].astype(np.uint32).tobytes()))
            j += len(a)
        out.append((-2, s, 0, np.bincount(seen).tobytes(), b"", b""))
    kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3)
    yield pa.table([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in ANSWERS.split(", ")])


def frequent_words(docs: DataFrame, share: float) -> np.ndarray:
    """Hashes of the words that make up more than ``share`` of the tokens; the list only guides where arcs are counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, _ = tokens(*flat(batch.column(1)))
            word, n = np.unique(token, return_counts=True)
            big = n >= share / 2 * len(token)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(word[big].view(np.int64), 0)), pa.array(np.append(n[big], 0)),
                                              pa.array(np.append(np.zeros(big.sum(), np.int64), len(token)))], ["h", "n", "all"])
    got = documents(docs).mapInArrow(run, "h long, n long, all long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    rows = got.orderBy(F.desc("all"), F.desc("n")).limit(int(2 / share) + 1).collect()  # the total, and more words than can have that share
    total = sum(r["all"] for r in rows)
    return np.sort(np.array([r.h for r in rows if r.n > share * total], np.int64).view(np.uint64))


def score_texts(docs: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT, discount: float = DISCOUNT, per_block_bytes: int = BLOCK_BYTES,
                frequent_share: float = FREQUENT) -> DataFrame:
    """Log10 probability of every text under a bigram model with interpolated absolute discounting over an add-one unigram model.

    docs: ``doc_id, text`` (null: empty); tokens are the words, A-Z lower-cased, and one end.  Learns from the documents whose crc32 of the doc_id as text
    (null: empty) modulo ``folds`` isn't ``fold``.  Returns a row for each row: ``doc_id, held_out, n_tokens, n_known`` (tokens seen in
    training), ``train_tokens``, ``base_score`` (unigrams alone) and ``score``.  Without training documents both scores give every token
    probability 1.  Repeated rows count as often as they occur.  Each history's probabilities add up to 1 over all words and one unknown word.
    """
    shards = parts(docs, SHARD_BYTES)
    frequent = frequent_words(docs, frequent_share)
    blocks = blocked(docs, per_block_bytes)

    def ask(t: pa.Table) -> pa.Table:
        return Walk(t, frequent, shards, folds, fold).requests(frequent, shards, t.column("_b")[0].as_py())

    answers = cut(serve(per_block(blocks, ask, REQUESTS), shards, counted, ANSWERS))
    whole = answers.filter("_b < 0").select("_b", "count").collect()  # two numbers a shard, and a number for each frequent word
    sums = [np.frombuffer(r["count"], np.int64) for r in whole if r._b == -1]
    train_tokens, vocabulary = (int(sum(x[i] for x in sums)) for i in (0, 1))
    after = np.zeros(len(frequent), np.int64)
    for r in whole:
        if r._b == -2:
            x = np.frombuffer(r["count"], np.int64)
            after[:len(x)] += x

    def finish(t: pa.Table, got: pa.Table) -> pa.Table:
        walk = Walk(t, frequent, shards, folds, fold)
        count, successors = np.zeros(len(walk.words), np.int64), np.zeros(len(walk.words), np.int64)
        arcs = np.zeros(walk.n_arcs, np.int64)
        got = got.sort_by("_s")
        own, lanes = (got.filter(pc.equal(got.column("kind"), k)) for k in (0, 1))
        count[:] = np.concatenate(ints(own.column("count"), np.int64))
        successors[:] = np.concatenate(ints(own.column("successors"), np.uint32))
        arcs[walk.own] = np.concatenate([np.zeros(0, np.uint32), *ints(own.column("arcs"), np.uint32)])
        arcs[walk.lane] = np.concatenate([np.zeros(0, np.uint32), *ints(lanes.column("arcs"), np.uint32)])
        often = np.isin(walk.words, frequent)
        successors[often] = after[np.searchsorted(frequent, walk.words[often])]
        lower = (count + 1) / (train_tokens + vocabulary + 1)  # arcs of the empty history
        lower[walk.start] = 1
        state = count[walk.v] > 0
        base = lower[walk.u]
        failure = np.where(state, discount * successors[walk.v] / np.maximum(count[walk.v], 1), 1.0)
        weight = np.log10(np.where(state, np.maximum(arcs - discount, 0) / np.maximum(count[walk.v], 1), 0) + failure * base)
        one = np.log10(lower)[walk.to]
        step = weight[walk.arc]
        n, f = np.diff(walk.first), walk.first[:-1]
        known = np.add.reduceat((count[walk.to] > 0).astype(np.int64), f)
        return pa.table([null_ids(walk.doc), pa.array(walk.held), pa.array(n), pa.array(known), pa.array(np.full(len(n), train_tokens)),
                         pa.array(np.add.reduceat(one, f)), pa.array(np.add.reduceat(step, f))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return meet(blocks, answers.filter("_b >= 0"), finish, SCHEMA)
