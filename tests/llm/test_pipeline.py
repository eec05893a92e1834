"""The pipeline stage by stage against brute force, on the smallest tables."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        got = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        texts = [(i, r.text) for i, r in rows.items()]
        if name == "quality rules":
            base = brute.rules(texts)
            kept = {r.doc_id: r for r in got}
            assert set(kept) <= {i for i, v in base.items() if not v[5]} and all(kept[i] == rows[i] for i in kept)
            assert len(kept) > 0.6 * len(rows)
        elif name == "line dedup":
            want = brute.lines(texts)
            assert {r.doc_id: sha(r.text) for r in got} == {i: v[2] for i, v in want.items()}
            assert all((r.lang, r.source) == (rows[r.doc_id].lang, rows[r.doc_id].source) and r.n_chars == len(r.text) for r in got)
        elif name == "near duplicates":
            want = brute.jac(texts)
            assert sorted(r.doc_id for r in got) == sorted(i for i, (_, c) in want.items() if c == i) and all(rows[r.doc_id] == r for r in got)
        elif name == "mixing":
            size = Counter()
            for r in got:
                words = brute.W.findall(r.text)
                mine = brute.W.findall(rows[r.doc_id].text)
                assert words == mine[:len(words)] and (len(words) < len(mine) or r.text == rows[r.doc_id].text)
                size[r.doc_id] += len(words)
            total = sum(len(brute.W.findall(t or "")) for _, t in texts)
            assert abs(sum(size.values()) - 1.5 * total) <= len({r.source for r in got})
            assert all(n <= 2 * len(brute.W.findall(rows[i].text)) for i, n in size.items())
        else:
            import public_tokenizers
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want, have = Counter(), Counter()
            for r in mixed:
                ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
                want[r.doc_id, len(ids)] += len(ids)
            for r in got:
                have[r.doc_id, r.doc_tokens] += r.length
            assert have == want and all(r.offset + r.length <= 4096 for r in got)
        mixed = got
        rows = {r.doc_id: r for r in got}


def test_near_duplicates_without_unique_ids(spark):
    text = lambda k: " ".join(f"{'abcdefgh'[k]}word{i}" for i in range(200))
    near = lambda k: text(k) + " end"
    rows = [(1, text(0)), (2, text(1)), (None, near(0)), (None, near(1)), (None, text(2)), (None, near(2)), (None, text(3)), (7, text(4)), (7, text(5)),
            (7, text(5)), (8, ""), (8, ""), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, (r.text or "")[:1]) for r in pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == {(1, "a"): 1, (2, "b"): 1, (None, "c"): 1, (None, "d"): 1, (7, "e"): 1, (7, "f"): 1, (8, ""): 1, (None, ""): 2}


def test_run_returns_pieces(spark):
    df = pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(df.columns) and df.count() > 0


def test_stages_with_nulls_repeats_and_clashing_columns(spark):
    """Every stage on rows with missing values, repeated rows, long texts and columns that are named like those the operators use."""
    import datetime

    at = datetime.datetime(2024, 5, 1, 12, 0, 0, 123456)
    prose = " ".join(f"word{k} of a plain text" for k in range(30))
    rows = [(1, prose, "en", "a"), (1, prose, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, prose + " more", "en", "b"), (None, None, None, None), (4, "x y z " * 40_000, "de", "b")]
    names = "_key long, _r long, carry string, words long, size long, _file0 long, at timestamp, _c0 string, o string, _cut_x long, source_size long"
    wide = [(*r, 777, 1, "c", 2, 3, 4, at, "d", "e", 5, 6) for r in rows]
    schema = "doc_id long, text string, lang string, source string, " + names
    docs = spark.createDataFrame(wide, schema)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        if stage is not pipeline.packing:
            assert out.columns == docs.columns and len(got) <= 2 * len(rows)
            assert all((r["_key"], r.carry, r["_file0"], r.at, r["_c0"], r["_cut_x"]) == (777, "c", 4, at, "d", 5) for r in got)
        assert stage(spark, docs.limit(0), SF).collect() == []
    kept = [r.doc_id for r in pipeline.near_duplicates(spark, docs, SF).collect()]
    assert kept.count(1) == 1 and {2, 3, 4} <= set(kept)
