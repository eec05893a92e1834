"""The audit of sources against a plain count, and the packing of terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stripline.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}
COLS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least=3, top=200):
    count, total, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [t.translate(LOW) for t in TERM.findall(text or "")]
        groups[lang].add(source)
        count[lang, source].update(found)
        total[lang].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + v) for t in kept}  # noqa: B023, E731
        p = {s: share(count[lang, s]) for s in sources}
        q = share(total[lang])
        far = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, far(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                for r, (i, x) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, i, x, r))
    return sorted(out)


def audit(spark, rows, schema="text string, lang string, source string", **params):
    from pyspark.sql import functions as F

    pairs, terms = D.audit_sources(spark.createDataFrame(rows, schema), **params)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return sorted(tuple(r[c] for c in COLS) for r in both.collect())


def corpus(seed, n):
    rnd = random.Random(seed)
    letters = "abcXYZéÉß中\U0001f600"
    vocab = ["".join(rnd.choice(letters) for _ in range(k)) for k in [*range(1, 20), 33, 40, 70, 200] for _ in range(3)]
    vocab += ["abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "a" * 31, "a" * 32, "a" * 33, "a" * 15 + "é", "a" * 7 + "é"]
    rows = []
    for _ in range(n):
        words = rnd.choices(vocab, [1 / (k + 1) for k in range(len(vocab))], k=rnd.choice([0, 1, 5, 60]))
        rows.append((rnd.choice([" ", ",", "\n", "1", "_"]).join(words), rnd.choice(["en", "en", "de", None]), rnd.choice(["s", "s", "s", "t", "ü", None, ""])))
    return rows + [(None, "en", "only nulls"), ("", "fr", "a"), ("x y", "fr", "b"), (None, None, None)]


@pytest.mark.parametrize("stretch", [D.STRETCH_BYTES, 300])
def test_audit_equals_counting(spark, monkeypatch, stretch):
    monkeypatch.setattr(D, "STRETCH_BYTES", stretch)
    rows = corpus(stretch, 400)
    assert audit(spark, rows, shard_bytes=1 << (12 if stretch < 1000 else 24)) == brute(rows)


def test_limits_ties_and_repeated_rows(spark):
    rows = [(" ".join(f"w{'x' * (k % 23)}{chr(97 + k % 26)}" for k in range(300)), "en", s) for s in "aab"] + [("w " * 9, "en", "c")] * 4
    assert audit(spark, rows, least_docs=2, top=5) == brute(rows, 2, 5)


def test_no_rows_no_terms_other_columns(spark):
    schema = "text string, lang string, source string"
    assert audit(spark, [], schema) == []
    assert audit(spark, [("1 2", "en", "a"), (None, "en", "b")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    rows = corpus(3, 60)
    wide = [(*r, 7, "y", 1, 2, "z", 0) for r in rows]
    assert audit(spark, wide, schema + ", p long, item string, _g long, _t long, value string, rank int") == brute(rows)


def test_sources_met_in_small_steps(spark, monkeypatch):
    import pyarrow as pa

    rnd = random.Random(1)
    rows = [(t, g, rnd.randrange(1, 10**9), rnd.randrange(1, 1000)) for t in range(200) for g in rnd.sample(range(12), rnd.randrange(1, 12))]
    none = {g: rnd.randrange(1, 1000) for g in range(12)}
    rows = [(t, g, p, none[g]) for t, g, p, _ in rows]
    far = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for t, g, p, z in rows:
        for t2, g2, p2, z2 in rows:
            if t == t2 and g != g2:
                want[g, g2] += far(p, p2) - far(p, z2) - far(z, p2) + far(z, z2)
    for most, step in ((1 << 20, 1000), (10, 7)):
        monkeypatch.setattr(D, "PAIRS_AT_ONCE", most)
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i:i + step])], ["_t", "_g", "p", "none"]) for i in range(0, len(rows), step)]
        got = Counter()
        for b in D.met(iter(batches)):
            for a, c, s in zip(*(x.to_pylist() for x in b.columns)):
                got[a, c] += s
        assert got == want


def test_packing_keeps_order_and_radix_order_is_stable():
    rnd = random.Random(2)
    words = sorted({bytes(rnd.choice(b"abz\xc3\xff") for _ in range(rnd.randrange(1, 9))) for _ in range(500)})
    buf = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    packed = D.words_of(buf, ends - [len(w) for w in words], ends)
    assert (np.diff(packed.astype(object)) > 0).all()
    key, low = np.random.default_rng(1).integers(0, 1 << 63, 4000, np.uint64) >> np.uint64(45), np.random.default_rng(2).integers(0, 9, 4000, np.uint32)
    assert (D.radix_order(low, key) == np.lexsort((low, key))).all()
    assert len(D.radix_order(np.zeros(0, np.uint64))) == 0
