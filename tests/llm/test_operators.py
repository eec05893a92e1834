"""The operators against plain brute force on a small table of planted cases, and on tables with nulls, ties, repeated rows and clashing columns."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripline.llm import anchors, digests, jaccard, licences, lines, lm, mixing, packing, quality, suffixes
from tests.llm import brute

TOKENIZER = "word_bpe_49k.json"


def corpus(n=160, seed=3):
    """Prose with copies, near copies, shared passages and lines, junk, runs of one letter, other scripts, white space of all kinds."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 8))) for _ in range(300)] + ["é", "größe", "日本", "a.b", "'s", "<|endoftext|>"]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, line = prose(45), "  A Shared line of more than forty characters, Repeated. "
    out = {}
    for i in range(n):
        kind = r.random()
        if kind < 0.12 and out:
            text = out[r.choice(list(out))]
        elif kind < 0.3 and out:
            w = out[r.choice(list(out))].split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w)
        elif kind < 0.45:
            text = prose(r.randint(0, 60)) + " " + passage + "\n" + prose(r.randint(0, 30))
        elif kind < 0.55:
            text = prose(30) + "\n" + line + "\n" + prose(5) + "\n" + line.strip().lower()
        elif kind < 0.6:
            text = r.choice(["", " ", "\n\n", "x", "one two three", "a" * 400, "ab " * 120, prose(3) + " " + "z" * 90])
        else:
            text = "\n".join(prose(r.randint(0, 40)) for _ in range(r.randint(1, 5))) + r.choice(["", "\n", "\t\x0b\x0c\r "])
        out[i * 3 + 1] = text
    return list(out.items())


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, ["en", "de", None][i % 3], [None, "s1", "s2", "s2", "s2"][i % 5], 7, "x", "y") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, size int, _b string, kind string").repartition(5).cache()


def compare(df, want, cols):
    got = {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}
    assert got == {k: tuple(v) for k, v in want.items()}


EMPTY = "doc_id long, text string, lang string, source string"
ODD = [(None, "no id here at all, " * 9, None, None), (None, None, "en", "a"), (4, None, None, None), (4, "two rows, one id", "en", "a"), (5, "twice " * 30, "de", "b"),
       (5, "twice " * 30, "de", "b"), (6, "", "de", None), (7, "w" * 70_000 + " " + "long " * 20_000, "en", "b")]


def every(spark):
    import public_tokenizers

    labels = spark.createDataFrame([(4, 1), (4, None), (None, 0), (9, 1)], "doc_id long, quality int")
    path = public_tokenizers.path(TOKENIZER)
    return {"licences": licences.scan_licences, "mixing": mixing.mixed_sizes, "mixed": mixing.mixed_documents, "packing": lambda d: packing.pack_sequences(d, path),
            "anchors": anchors.remove_repeats, "suffixes": suffixes.remove_substrings, "lines": lines.drop_repeated_lines, "jaccard": jaccard.similar_groups,
            "lm": lm.score_texts, "digests": digests.fingerprints, "quality": lambda d: quality.judge(d, labels), "good": lambda d: quality.keep_good(d, labels)}


PARTIAL = {"mixed", "packing", "good"}  # rows of their own


@pytest.mark.parametrize("name", ["licences", "mixing", "mixed", "packing", "anchors", "suffixes", "lines", "jaccard", "lm", "digests", "quality", "good"])
def test_empty_and_odd_tables(spark, name):
    fn = every(spark)[name]
    assert fn(spark.createDataFrame([], EMPTY)).count() == 0
    odd = spark.createDataFrame(ODD, EMPTY).withColumns({"_r": F.lit(1), "key": F.lit("k"), "words": F.lit(2.5), "copy": F.lit(True)})
    got = fn(odd).collect()
    if name not in PARTIAL:
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)
    if name == "packing":
        assert {r.doc_id for r in got} == {r[0] for r in ODD}


def test_substring_dedup(docs, rows):
    compare(anchors.remove_repeats(docs), brute.words(rows), ["n_words", "n_removed", "kept_sha256"])


def test_suffix_dedup(docs, rows):
    compare(suffixes.remove_substrings(docs), brute.bytes50(rows), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def test_suffix_dedup_with_queues_on_disk(docs, rows):
    compare(suffixes.remove_substrings(docs, queue_bytes=4096), brute.bytes50(rows), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def around_a_passage(n, seed=5):
    """Documents that share one passage, each with text of its own on both sides; some have the same text after it."""
    r = random.Random(seed)
    letters = lambda k: "".join(r.choice("abcdefghijklmnop ") for _ in range(k))
    passage, tails = letters(120), [letters(60) for _ in range(20)]
    return [(i, f"{letters(70)}{passage}{r.choice(tails) if i % 3 == 0 else letters(70)}") for i in range(n)]


def test_suffix_dedup_spreads_the_ends_of_a_shared_passage(spark, monkeypatch):
    rows, asked = around_a_passage(9000), []
    for name in {"serve", "stream"} & set(vars(suffixes)):
        monkeypatch.setattr(suffixes, name, lambda requests, *a, f=getattr(suffixes, name), **b: (asked.append(requests), f(requests, *a, **b))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    compare(suffixes.remove_substrings(docs), brute.bytes50(rows), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
    load = [r[1] for r in asked[1].groupBy("_s").agg(F.sum(F.octet_length("texts") + F.octet_length("key"))).collect()]
    assert max(load) < 1.5 * sum(load) / 8


@pytest.mark.parametrize("hot", [0, 3, 40])
def test_suffix_dedup_with_hot_anchors(docs, rows, hot):
    compare(suffixes.remove_substrings(docs, hot=hot), brute.bytes50(rows), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
    more = docs.select("doc_id", "text").unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("\u00fc"), "text").alias("text")))
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    lists = lambda d: sorted(d.select(*cols).collect(), key=str)
    assert lists(suffixes.remove_substrings(more, hot=hot)) == lists(suffixes.remove_substrings(more))


@pytest.mark.parametrize("hot", [3, suffixes.HOT])
def test_suffix_dedup_of_shards_beyond_memory(spark, hot, monkeypatch):
    rows = [(i * 40 + k, text) for k in range(40) for i, text in around_a_passage(30, k)]
    order = suffixes.suffix_order

    def small(t, *a):
        assert len(t) < 12_000  # a whole shard has more
        return order(t, *a)

    monkeypatch.setattr(suffixes, "suffix_order", small)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    compare(suffixes.remove_substrings(docs, hot=hot, sort_bytes=1000), brute.bytes50(rows), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


@pytest.mark.parametrize("letters", [2, 3, 5, 200])
def test_suffix_order(letters):
    rng = np.random.default_rng(letters)
    for trial in range(25):
        t = np.concatenate([np.append(rng.integers(1, letters + 1, rng.integers(1, 60)), 0) for _ in range(rng.integers(1, 10))]).astype(np.uint8)
        order = suffixes.suffix_order(t, 50, 100 if trial % 2 else 1 << 20).tolist()
        assert sorted(order) == list(range(len(t)))
        s = [t.tobytes()[i:i + 50] for i in order]
        assert s == sorted(s)


def test_line_dedup(docs, rows):
    compare(lines.drop_repeated_lines(docs), brute.lines(rows), ["n_lines", "n_dropped", "kept_sha256"])


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64))
    index = lines.LineIndex(np.concatenate([keys, keys[:50]]), np.ones(len(keys) + 50, np.int64), np.arange(len(keys) + 50))
    assert sorted(index.hash(keys).tolist()) == list(range(len(keys)))
    count, last = index.probe(keys)
    assert (count[:50] == 2).all() and (count[50:] == 1).all() and (last[:50] == np.arange(len(keys), len(keys) + 50)).all()
    assert (index.probe(keys + np.uint64(1))[0] == 0).mean() > 0.999


def test_jaccard_join(docs, rows):
    compare(jaccard.similar_groups(docs), brute.jac(rows), ["n_shingles", "component_id"])


@pytest.mark.parametrize("light", [0, 40, 10_000])
def test_jaccard_join_by_tiles_and_either_side_of_the_boundary(spark, monkeypatch, light):
    r = random.Random(1)
    base = [str(r.random()) for _ in range(60)]
    rows = []
    for i in range(90):  # a cloud of near copies of one base, and some of what is near those only
        w = list(base)
        for k in r.sample(range(60), r.randint(0, 3)):
            w[k] = f"{i}_{k}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "SHORT", 4)
    monkeypatch.setattr(jaccard, "TILE", 7)
    monkeypatch.setattr(jaccard, "boundary", lambda *a: light)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    compare(jaccard.similar_groups(df), brute.jac(rows), ["n_shingles", "component_id"])


def test_quality_base_counts(spark, docs, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    compare(quality.judge(docs, labels), brute.rules(rows), [*quality.BASE, "base_failed"])
    assert all(r.kept == (not r.base_failed) for r in quality.judge(docs, labels).collect())


def test_binomial_tail(spark):
    cases = [(k, n) for n in (1, 7, 100, 3000) for k in (0, 1, 3, 40) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.02))
    for k, n, p in df.collect():
        want = sum(math.comb(n, i) * 0.02 ** i * 0.98 ** (n - i) for i in range(k + 1))
        assert p == pytest.approx(want, rel=1e-9)


def test_quality_cutoffs_keep_the_risk(spark):
    r = random.Random(2)
    plain = lambda: " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(40))
    rows, labels = [], []
    for i in range(6000):
        bad = i % 10 == 0
        text = plain()
        if bad or r.random() < 0.0005:
            text = " ".join(w + "***" for w in text.split())
        rows.append((i, text, "en"))
        labels.append((i, 0 if bad else 1))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {x.doc_id: x.kept for x in quality.judge(d, lab).collect()}
    assert not any(kept[i] for i in range(0, 6000, 10))
    assert sum(not kept[i] for i in range(6000) if i % 10) < 0.02 * 5400
    few = quality.judge(d, lab.filter("doc_id < 200"))  # too few labels to certify anything
    assert few.filter("kept").count() == 6000


def test_mixing(docs, rows):
    size = {i: len(brute.W.findall(t)) for i, t in rows}
    source = {r.doc_id: r.source for r in docs.collect()}
    per = Counter()
    for i in size:
        per[source[i]] += size[i]
    order = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(per.values())
    while True:
        level = rest / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 2 * per[s]]
        if not full:
            break
        for s in full:
            target[s] = 2 * per[s]
            rest -= target[s]
            free.remove(s)
    target |= {s: weight[s] * level for s in free}
    runs = [sorted(tuple(r) for r in mixing.mixed_sizes(docs).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    taken = Counter()
    for doc, n, source_size, t, took in runs[0]:
        assert n == size[doc] and source_size == per[source[doc]] and t == pytest.approx(target[source[doc]]) and 0 <= took <= 2 * n
        taken[source[doc]] += took
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)


def test_splitting_tree_is_exact_and_disjoint():
    counts = np.array([0, 1, 17, 400])
    got = [mixing.split(counts, s, 13, 5) for s in range(13)]
    assert sum(n for _, n in got).tolist() == counts.tolist()
    assert max(n.sum() for _, n in got) - min(n.sum() for _, n in got) <= 4
    for k, c in enumerate(counts):
        assert sorted(x for first, n in got for x in range(first[k], first[k] + n[k])) == list(range(c))


def test_shards_of_the_mix(docs):
    draws, _ = mixing.mix(docs, block_words=64, shard_words=1024)
    got = draws.collect()
    assert len({r.shard for r in got}) > 3
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.position)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_sequences(docs, path, capacity=256, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.ids, r.doc_tokens, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length, r.padded))
    for i, t in rows:
        want = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        have = []
        for start, length, ids, total, crc in sorted(pieces.pop(i)):
            assert start == len(have) and length == len(ids) and total == len(want) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
            have += ids
        assert have == want
    assert not pieces
    for v in sequences.values():
        at = 0
        for offset, length, padded in sorted(v):
            assert offset == at
            at += length
        assert at <= 256 and v[0][2] in (256, at)


def test_windows_are_nearly_equal():
    r = random.Random(0)
    sizes = [r.randint(1, 4000) for _ in range(700)]
    got = packing.windows(sizes)
    assert sorted(i for w in got for i in w) == list(range(700))
    sums = [sum(sizes[i] for i in w) for w in got]
    assert max(sums) <= 4096 and len(got) <= 1.04 * sum(sizes) / 4096 and max(sums) - min(sums) < 200  # two pieces to a window
    small = [r.randint(1, 400) for _ in range(2000)]
    sums = [sum(small[i] for i in w) for w in packing.windows(small)]
    assert len(sums) <= sum(small) // 4096 + 2 and max(sums) - min(sums) < 8
    assert len(packing.windows([4096, 4096, 1])) == 3 and packing.difference([], 2) == [[], []]


def test_lm_scores(docs, rows):
    words = {i: [*brute.W.findall(brute.low(t)), "</s>"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    unigram, bigram = Counter(), defaultdict(Counter)
    for i, w in words.items():
        if not held[i]:
            unigram.update(w)
            for a, b in zip(["<s>", *w], w):
                bigram[a][b] += 1
    n, v, d = sum(unigram.values()), len(unigram), lm.DISCOUNT

    def p(a, b):
        low = (unigram[b] + 1) / (n + v + 1)
        if a not in bigram:
            return low
        seen, total = bigram[a], sum(bigram[a].values())
        return max(seen[b] - d, 0) / total + d * len(seen) / total * low
    for share in (lm.FREQUENT, 0.02):
        for r in lm.score_texts(docs, frequent_share=share).collect():
            w = words[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(unigram[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((unigram[x] + 1) / (n + v + 1)) for x in w))
            assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w)))
    assert sum(p("<s>", x) for x in unigram) + p("<s>", "never seen") == pytest.approx(1)


def test_entropy_levels():
    rng = np.random.default_rng(0)
    b = rng.integers(97, 112, 3000).astype(np.uint8).tobytes() + b"a" * 200
    got = digests.entropy_levels(np.frombuffer(b, np.uint8))
    assert len(got) == len(b) - digests.WIDTH + 1
    for i in range(0, len(got), 41):
        total = sum(round(c * math.log2(c) * 1024) for c in Counter(b[i:i + digests.WIDTH]).values())
        assert got[i] == (digests.TOP - total) * (digests.LEVELS - 1) // digests.TOP


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in digests.fingerprints(docs).collect()}
    rows = sorted(rows)
    rank = digests.precedence(digests.level_counts(docs))
    by_text = {}

    def features(text):
        b = text.encode()
        return digests.filters(np.frombuffer(b, np.uint8), np.array([0, len(b)]), rank)[0]
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + other[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        if k % 9 == 0:
            f, e = features(t), features(edited)
            assert r.fingerprint == f"{len(f)}:" + base64.b64encode(f.tobytes()).decode() and r.edited_fingerprint == digests.written(e)
            assert r.near_edited == digests.likeness(f, e) and r.near_next == digests.likeness(f, features(other))
    far = [r.near_edited - r.near_next for r in got.values() if r.n_chars > 200]
    assert sum(x > 0 for x in far) > 0.8 * len(far)


def test_licences_held_out(spark):
    prose = [t for _, t in corpus(300, seed=9)]
    notices = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary",
               "Copyright 2011 Acme. All rights reserved.": "proprietary", "This work is licensed under the GNU General Public License, version 3.": "gpl",
               "Licensed under the Apache License, Version 2.0 (the \"License\");": "apache-2.0"}
    rows = [(i, t) for i, t in enumerate(prose)] + [(1000 + k, f"{prose[k]}\n{x}\n{prose[k + 20]}") for k, x in enumerate(notices)]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[1000 + k].families for k in range(len(notices))] == list(notices.values())
    assert not any(got[i].n_licence for i in range(300)) and all(got[i].n_paragraphs == prose[i].count("\n") + 1 for i in range(300))


def test_licences_of_other_families(spark):
    """Templates of the caller, a family of theirs among them; built-in families that are left out are never found."""
    from stripline.llm import licences

    own = {"house": ("You may use this poem at home and read it aloud to friends, but never sing it on a stage.",), "mit": licences.TEMPLATES["mit"]}
    prose = [(i, f"line {i} of some prose about rivers and hills and number {i * 7}\nanother line {i}") for i in range(200)]
    rows = prose + [(1000, own["house"][0]), (1001, licences.TEMPLATES["mit"][0]), (1002, licences.TEMPLATES["apache-2.0"][0] if "apache-2.0" in licences.TEMPLATES else "x")]
    got = {r.doc_id: r.families for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), own).collect()}
    assert got[1000] == "house" and got[1001] == "mit" and set(got.values()) <= {"", "house", "mit"} and not any(got[i] for i in range(200))
