"""Work and equality of the steps of the suffix dedup, without a session."""

import random

import numpy as np
import pyarrow as pa

from stripline.llm import suffixes
from stripline.llm.common import Docs, _packed


def words(seed, n):
    rng = random.Random(seed)
    known = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(300)]
    return " ".join(rng.choice(known) for _ in range(n)).encode()


def test_parts_of_a_queue_that_wait_are_taken_together():
    for budget in (1 << 20, 10):
        q = suffixes.Queues(budget)
        for x in ([3, 1], [2], [9, 8]):
            q.put(5, np.array(x, np.int32))
        got = []
        for a in q.take(5):
            if not got:
                q.put(5, np.array([7], np.int32))
                q.put(5, np.array([6], np.int32))
            got.append(a.tolist())
        assert got == [[3, 1, 2, 9, 8], [7, 6]] and q.all(5).tolist() == [3, 1, 2, 9, 8, 7, 6]


def test_passes_of_a_sort_follow_the_letters_and_not_the_parts(monkeypatch):
    passes, take = [], suffixes.Queues.take

    def counted(self, char):
        for a in take(self, char):
            passes.append(len(a))
            yield a

    monkeypatch.setattr(suffixes.Queues, "take", counted)
    t = np.append(np.frombuffer(words(1, 5000), np.uint8) + 1, 0).astype(np.uint8)
    order = suffixes.suffix_order(t, 50).tolist()
    text = t.tobytes()
    assert [text[i:i + 50] for i in order] == sorted(text[i:i + 50] for i in range(len(text)))
    assert len(passes) < 300


def test_segments_do_not_depend_on_stretches(monkeypatch):
    texts = [words(k, n) for k, n in enumerate((40, 0, 3, 200, 1, 9, 500, 12))] + [b"a" * 49, b"a" * 50, b"", b"a" * 300, b""]
    off = np.cumsum([0, *map(len, texts)])
    d = Docs(np.arange(len(texts)), np.frombuffer(b"".join(texts), np.uint8), off)
    want = None
    for stretch in (1 << 20, 1 << 16, 700, 1):
        monkeypatch.setattr(suffixes, "STRETCH", stretch)
        g = suffixes.Segments(d, 50, 24)
        got = [x.tolist() for x in (g.start, g.n, g.row, g.key)]
        assert want is None or got == want
        want = got
    start, n, row, _ = map(np.array, want)
    windows = np.concatenate([np.arange(a, a + k) for a, k in zip(start, n)])
    assert windows.tolist() == [off[r] + i for r, t in enumerate(texts) for i in range(len(t) - 49)]
    assert all(off[r] <= a and a + k + 49 <= off[r + 1] for a, k, r in zip(start, n, row))


def test_hashes_of_ranges_do_not_depend_on_stretches(monkeypatch):
    buf = np.frombuffer(words(3, 400), np.uint8)
    a = np.sort(np.random.default_rng(4).integers(0, len(buf) - 60, 200))
    z = np.maximum.accumulate(a + np.random.default_rng(5).integers(1, 60, 200))
    for stretch in (1, 300, 1 << 16):
        monkeypatch.setattr(suffixes, "STRETCH", stretch)
        assert suffixes.stretches(buf, a, z, 1).tolist() == suffixes.ranges(buf, a, z, 1).tolist()
    assert suffixes.stretches(buf, a[:0], z[:0]).tolist() == []


def in_process(monkeypatch, tables, shards):
    """The dedup of blocks without Spark: each step is called as the tasks would call it."""
    def dealt(t, key):
        k = np.array(t.column(key))
        return {int(v): t.take(pa.array(np.flatnonzero(k == v))) for v in np.unique(k)}

    def serve(asked, n, answer, schema):
        return pa.concat_tables([x for t in dealt(asked, "_s").values() for x in answer(t)])

    def stream(asked, n, run, schema):
        return pa.Table.from_batches([x for t in dealt(asked, "_s").values() for x in run(iter(t.combine_chunks().to_batches()))])

    def meet(blocks, answers, fn, schema):
        got = dealt(answers, "_b")
        return pa.concat_tables([fn(t, got[t.column("_b")[0].as_py()]) for t in blocks])

    for name, fn in {"blocked": lambda docs, per: tables, "parts": lambda docs, per: shards, "serve": serve, "stream": stream, "meet": meet,
                     "per_block": lambda blocks, fn, schema: pa.concat_tables([fn(t) for t in blocks])}.items():
        monkeypatch.setattr(suffixes, name, fn)
    return sorted(map(repr, suffixes.remove_substrings(None).to_pylist()))


def test_work_of_a_block_does_not_grow_with_shards(monkeypatch):
    rng, codec, tables = random.Random(7), pa.Codec("zstd", 1), []
    text = words(8, 3000)
    for b in range(3):
        rows = [text[a:a + rng.randint(0, 900)] for a in rng.choices(range(len(text) - 900), k=12)]
        sizes, data = _packed(rows, codec)
        tables.append(pa.table({"_b": [b], "docs": [np.arange(b, 36, 3).tobytes()], "sizes": [sizes], "texts": [data]}))
    calls, unique = [], np.unique
    want = in_process(monkeypatch, tables, 1)
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    assert in_process(monkeypatch, tables, 150) == want
    assert any("'n_removed': 0" not in x for x in want)
    assert len(calls) < 20
