"""Registered queries against their SQL on the smallest tables, and the contract of the entry file."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "part documents events lineitem pages conversations region".split()
NAMES = """page_at_y source_spans bands_white moving_band_stats cut_decisions level1_partition coverage_check exact_retiling tile_from_cuts
sequence_gap manifest_lineage ocr_to_detection mask_intersection export_plan fingerprint chapter_transitions clean_summary trimmed_std""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rounded(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    r = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert rounded(df.select(*[f"`{c}`" for c in cols]).collect()) == rounded([tuple(x[i] for i in order) for x in r.fetchall()])


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
