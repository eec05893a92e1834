"""Queries over documents without characters, compared with their SQL: a page of height 0 is a page like any other."""

import math
import os
import random
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
import __spark_entry__ as entry  # noqa: E402

NAMES = """table_feat standardize_features regime_rupture visual_islands greedy_islands anchor_select balance_partition stack_crops_images""".split()


def pages(rng, n, change):
    """Texts whose letters change every ``change`` pages."""
    for k in range(n):
        letters = "enah. e.x"[k // change % 3 * 3:][:3] + "qan"
        yield "".join(rng.choice(letters) for _ in range(rng.randint(300, 900)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(5), []

    def chapter(source, lang, texts, heights={}):
        for k, text in enumerate(texts):
            rows.append((len(rows), text, lang, source, heights.get(k, len(text))))

    chapter("src0", "en", pages(rng, 60, 4))
    chapter("src0", "de", pages(rng, 40, 3))
    chapter("src1", "en", ["" if k in (10, 11, 17, 25) else t for k, t in enumerate(pages(rng, 30, 3))])
    chapter("src1", "de", pages(rng, 12, 3), heights={7: 0})  # text, but a height of 0
    chapter("src2", "en", ["", "", ""])
    chapter("src3", "en", [""])
    sf = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{sf}/documents.parquet")
    return sf


@pytest.fixture(scope="module")
def db(folder):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return c


def plain(rows):
    named = [tuple(v if not isinstance(v, float) else "nan" if math.isnan(v) else round(v, 9) for v in r) for r in rows]
    return sorted(named, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


@pytest.mark.parametrize("name", NAMES)
def test_empty_pages_as_in_sql(spark, folder, db, name):
    df = entry.queries()[name](spark, folder)
    r = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = plain(r.fetchall())
    assert plain(df.select(*[f"`{c}`" for c in names]).collect()) == want and want


def test_pages_that_begin_at_one_place_rank_by_number(spark, tmp_path):
    texts = ["one", "", "", "two", "three", "four"]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["regime_rupture"](spark, str(tmp_path)).collect()
    assert sorted((r["rank"], r["page_no"]) for r in got) == [(1, 2), (2, 3), (3, 4)]
