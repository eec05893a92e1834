"""Files, images, manifests and sinks on small trees made here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripline.operators import compose as K
from stripline.operators import export as X
from stripline.operators import images as I
from stripline.sources import manifests as J
from stripline.sources import pages as G
from stripline.sources import sinks as N


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    chapter = root / "cap-1"
    chapter.mkdir()
    arrays = {}
    for k, name in enumerate(["page-001.png", "page-002.png", "page-010.png"]):
        a = np.zeros((30, 20, 3), np.uint8)
        a[10 + k:20] = 255
        arrays[name] = a
        df = spark.createDataFrame([(name, 20, 30, bytearray(a.tobytes()))], "name string, width int, height int, data binary")
        (chapter / name).write_bytes(bytes(N.encode_png(df, ["name"]).first().content))
    (chapter / "page-003.png").write_bytes(b"broken")
    (chapter / "page-004_old.png").write_bytes(b"backup")
    (chapter / "notes.txt").write_text("x")
    return str(root), arrays


def test_scan_pages(spark, tree):
    got = G.scan_pages(spark, tree[0]).orderBy("page_no").collect()
    assert [(r.ch, r.file, r.page_no) for r in got] == [("cap-1", "page-001.png", 1), ("cap-1", "page-002.png", 2), ("cap-1", "page-003.png", 3), ("cap-1", "page-010.png", 10)]
    size = {r.file: (r.width, r.height) for r in G.png_size(G.scan_pages(spark, tree[0], True)).collect()}
    assert size["page-001.png"] == (20, 30) and size["page-003.png"] == (None, None)


def test_scan_images_and_rows(spark, tree):
    i = G.scan_images(spark, tree[0])
    assert {r.file: r.problem for r in i.collect()}["page-003.png"] == "unreadable"
    rows = I.row_profile(i.filter("problem is null"), ["file"]).groupBy("file").agg(F.count_if(F.col("white_px") == 20).alias("n")).collect()
    assert {r.file: r.n for r in rows} == {"page-001.png": 10, "page-002.png": 9, "page-010.png": 8}
    strips = I.strip_scan(i.filter("problem is null"), ["file"], height=8).collect()
    assert {(r.file, r.y) for r in strips} >= {("page-001.png", 0), ("page-001.png", 12)}
    one = i.filter("file = 'page-001.png'").withColumns({"a": F.lit(5), "b": F.lit(12)})
    whole = I.stack_rows(I.crop_rows(one, "a", "b").select("file", F.col("a").alias("o"), "slice"), ["file"], "o").first()
    assert bytes(whole.data) == tree[1]["page-001.png"][5:12].tobytes()


def test_dark_components(spark):
    rnd = np.random.default_rng(3)
    a = np.where(rnd.random((40, 30)) < 0.45, 20, 250).astype(np.uint8)
    df = spark.createDataFrame([(1, 30, 40, bytearray(np.repeat(a[..., None], 3, 2).tobytes()))], "id long, width int, height int, data binary")
    got = sorted((r.x, r.y, r.w, r.h, r.pixels) for r in I.dark_components(df, ["id"]).collect())
    seen, want = set(), []
    for y in range(40):
        for x in range(30):
            if a[y, x] < 100 and (x, y) not in seen:
                todo, comp = [(x, y)], []
                seen.add((x, y))
                while todo:
                    p = todo.pop()
                    comp.append(p)
                    for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)):
                        if 0 <= q[0] < 30 and 0 <= q[1] < 40 and a[q[1], q[0]] < 100 and q not in seen:
                            seen.add(q)
                            todo.append(q)
                xs, ys = [p[0] for p in comp], [p[1] for p in comp]
                want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(comp)))
    assert got == sorted(want)


def test_promotion_is_all_or_nothing(spark, tmp_path):
    totals = spark.createDataFrame([("a", 300)], "ch string, total long")
    make = lambda *b: spark.createDataFrame([("a", s, e) for s, e in zip(b, b[1:])], "ch string, g_start long, g_end long")
    check = lambda df: K.coverage_errors(df, totals)
    root = str(tmp_path / "official")
    with pytest.raises(ValueError):
        N.promote_versioned(make(0, 100, 299), check, root)
    assert N.current_version(spark, root) is None
    first = N.promote_versioned(make(0, 100, 300), check, root)
    assert N.current_version(spark, root) == first
    with pytest.raises(ValueError):
        N.promote_versioned(make(0, 150, 300), check, root)
    with pytest.raises(ValueError):
        N.promote_versioned(make(0, 150), check, root, replace=True)
    assert N.current_version(spark, root) == first
    second = N.promote_versioned(make(0, 150, 300), check, root, replace=True)
    assert spark.read.parquet(N.current_version(spark, root)).count() == 2 and second != first


def test_export_copy(spark, tmp_path):
    src = spark.createDataFrame([("c/page-1.png", 3, "h1"), ("c/page-2.png", 4, "h2"), ("c/page-2_mask.png", 4, "m"), ("c/x.json", 1, "j")], "rel string, size long, hash string")
    dest = spark.createDataFrame([("c/page-1.png", 3, "h1")], "rel string, d_size long, d_hash string")
    content = spark.createDataFrame([("c/page-2.png", bytearray(b"abcd"))], "rel string, content binary")
    plan = X.export_plan(src, dest)
    assert {r.rel: r.status for r in plan.collect()} == {"c/page-1.png": "identical", "c/page-2.png": "new"}
    path = str(tmp_path / "out")
    assert X.export_copy(plan, content, path) == 1 and X.export_copy(plan, content, path) == 0
    clash = X.export_plan(src, dest.withColumn("d_hash", F.lit("other")))
    with pytest.raises(ValueError):
        X.export_copy(clash, content, path)


def test_manifest_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"algorithm": "clean_v2", "status": "EFETIVADO"}')
    (tmp_path / "b.json").write_text('{"status":')
    got = {r.path.rsplit("/", 1)[1]: r.m for r in J.read_manifest_files(spark, str(tmp_path)).collect()}
    assert got["a.json"].status == "EFETIVADO" and got["b.json"] is None


def test_object_pages(spark):
    body = b"%PDF-1.4 /Type /Pages /Type /Page << >> /Type/Page /Type  /Page"
    df = spark.createDataFrame([(1, bytearray(body)), (2, bytearray(b""))], "id long, content binary")
    got = {r.id: (r.header_ok, r.pages, r.is_empty) for r in G.object_pages(df).collect()}
    assert got == {1: (True, 3, False), 2: (False, 0, True)}


def test_channels_agree(spark):
    """Gray, colour and colour with alpha give the same rows, strips and crops of the same picture."""
    rng = np.random.default_rng(1)
    gray = np.repeat(rng.integers(0, 256, (40, 1)), 24, axis=1).astype(np.uint8)
    gray[8:30] = 200
    three = np.repeat(gray[..., None], 3, axis=2)
    four = np.concatenate([three, rng.integers(0, 256, (40, 24, 1)).astype(np.uint8)], axis=2)
    df = spark.createDataFrame([(k, 24, 40, bytearray(a.tobytes())) for k, a in enumerate((gray, three, four))], "id long, width int, height int, data binary")
    for job in (I.row_profile, I.slice_features, lambda d, k: I.strip_scan(d, k, height=8)):
        per = {}
        for r in job(df, ["id"]).collect():
            per.setdefault(r.id, []).append(tuple(r)[1:])
        assert len(per) == 3 and sorted(per[0]) == sorted(per[1]) == sorted(per[2])
    crops = {r.id: bytes(r.slice) for r in I.crop_rows(df.withColumns({"a": F.lit(5), "b": F.lit(9)}), "a", "b").collect()}
    assert crops == {0: gray[5:9].tobytes(), 1: three[5:9].tobytes(), 2: four[5:9].tobytes()}


def test_strip_scan_measures(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(90, 110, (50, 31, 3)).astype(np.uint8)
    df = spark.createDataFrame([(1, 31, 50, bytearray(a.tobytes()))], "id long, width int, height int, data binary")
    got = {r.y: r for r in I.strip_scan(df, ["id"], 99.0, 99.0, height=10, sample=12).collect()}
    assert sorted(got) == list(range(0, 41, 5))
    for y, r in got.items():
        for part, spread, edge in ((a[y:y + 10, 9:21], r.uniform_std, r.edge_mean), (a[y:y + 10], r.full_std, r.full_edge)):
            f = part.astype(float)
            assert spread == pytest.approx(max(f[..., c].std() for c in range(3)))
            assert edge == pytest.approx(max(np.abs(np.diff(f, axis=1)).mean(), np.abs(np.diff(f, axis=0)).mean()))


def test_plain_pngs_are_decoded_as_spark_does(spark, tmp_path):
    import struct
    import zlib

    rnd = np.random.default_rng(5)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def png(px, kind, rules):
        """A PNG whose lines go through the filters ``rules`` in turn."""
        lines = b""
        for y, row in enumerate(px):
            rule = rules[y % len(rules)]
            before = np.concatenate([np.zeros_like(row[:1]), row[:-1]]) if rule == 1 else px[y - 1] if rule == 2 and y else 0
            lines += bytes([rule]) + (row - before).astype(np.uint8).tobytes()
        return G.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", px.shape[1], len(px), 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    (tmp_path / "c").mkdir()
    for k, (kind, n) in enumerate([(0, 1), (2, 3), (6, 4)] * 2):
        px = rnd.integers(0, 256, (5, 7, n), dtype=np.uint8)
        (tmp_path / "c" / f"page-{k}.png").write_bytes(png(px, kind, [2, 1, 0, 2] if k > 2 else [0]))
    (tmp_path / "c" / "page-8.png").write_bytes(b"broken")
    row = lambda r: (r.ch, r.file, r.page_no, r.width, r.height, r.channels, r.data and bytes(r.data), r.problem)
    got, want = G.scan_images(spark, str(tmp_path)), G._scan_images_jvm(spark, str(tmp_path), False)
    assert got.dtypes == want.dtypes and sorted(map(row, got.collect())) == sorted(map(row, want.collect()))
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    (tmp_path / "c" / "page-9.png").write_bytes(png(px, 6, [4]))  # a filter of another kind: Spark's decoder reads all
    assert "MapInArrow" not in G.scan_images(spark, str(tmp_path))._jdf.queryExecution().toString()
