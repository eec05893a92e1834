"""Page files, images and documents as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripline.functions.names import is_active_page, page_number


def _named(files: DataFrame, path: str) -> DataFrame:
    parts = F.split(path, "/")
    return files.withColumns({"file": F.element_at(parts, -1), "ch": F.element_at(parts, -2), "page_no": page_number(F.element_at(parts, -1))})


def scan_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files below ``root`` whose name matches, with extension and size; the content column is never read."""
    f = _named(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content"), "path")
    return f.filter(F.lower("file").rlike(pattern)).select("file", F.regexp_extract("file", r"\.([^.]+)$", 1).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def scan_pages(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Page files ``<chapter>/page-<n>.<ext>`` below ``root`` with size, time and number; backups are left out.

    The bytes, and the hash of them, are read only where asked for.
    """
    f = _named(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), "path")
    f = f.filter(is_active_page("file") & F.col("page_no").isNotNull())
    cols = ["ch", "file", "page_no", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return f.select(*cols, *([F.sha2("content", 256).alias("sha256"), "content"] if content else []))


def png_size(files: DataFrame) -> DataFrame:
    """Width and height from the PNG header, without decoding the pixels."""
    n = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    ok = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    return files.withColumns({"width": F.when(ok, n(17)), "height": F.when(ok, n(21))})


PNG = b"\x89PNG\r\n\x1a\n"
FOREIGN = (b"\xff\xd8", b"GIF8", b"BM", b"II*\0", b"MM\0*", b"\0")  # how files of the other kinds begin that Spark's decoder may know
ASIDE = {b"IHDR", b"IDAT", b"IEND", b"pHYs", b"tEXt", b"tIME", b"sRGB"}  # chunks that leave the pixels as they are


def plain_png(data: bytes):
    """Pixels (height x width x channels, BGR or gray) of a PNG of 8 bits in gray, RGB or RGBA, without interlacing, palette, colour profile or averaging filters.

    None: no image.  False: another kind of image, or one that is damaged.
    """
    import struct
    import zlib

    import numpy as np

    if data[:8] != PNG:
        return False if data.startswith(FOREIGN) else None
    if len(data) < 33:
        return None
    w, h, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", data[16:29])
    if depth != 8 or kind not in (0, 2, 6) or interlace or not w or not h:
        return False
    at, body = 8, []
    while at + 12 <= len(data):
        n, name = struct.unpack(">I4s", data[at:at + 8])
        if name not in ASIDE:
            return False
        if name == b"IDAT":
            body.append(data[at + 8:at + 8 + n])
        at += n + 12
    c = {0: 1, 2: 3, 6: 4}[kind]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error:
        return False
    if lines.size != h * (w * c + 1):
        return False
    lines = lines.reshape(h, w * c + 1)
    rule, px = lines[:, 0], lines[:, 1:].reshape(h, w, c)
    if rule.any():
        if rule.max() > 2:
            return False
        px = px.copy()
        for y in np.flatnonzero(rule).tolist():
            if rule[y] == 1:
                px[y] = np.add.accumulate(px[y], axis=0, dtype=np.uint8)
            elif y:
                px[y] += px[y - 1]
    return px if c == 1 else px[..., [2, 1, 0, 3][:c]]


def scan_images(spark: SparkSession, root: str, drop_invalid: bool = False) -> DataFrame:
    """Decoded page images (rows top-down, BGR bytes); unreadable files stay as rows with null sizes unless dropped.

    Pages that are all plain PNG are decoded in Python, at a small part of the time that Spark's decoder takes for each file; if a page is of another kind,
    that decoder reads them all.  Files are dealt to a bounded number of tasks, as Spark counts each small one as 4 MB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select("path", "content").coalesce(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = _named(files, "path").filter(is_active_page("file") & F.col("page_no").isNotNull())

    def other(batches):
        import pyarrow as pa

        for batch in batches:
            n = sum(plain_png(x.as_buffer().to_pybytes()) is False for x in batch.column(0))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    if not files.select("content").mapInArrow(other, "n long").isEmpty():
        return _scan_images_jvm(spark, root, drop_invalid)

    def decode(batches):
        import numpy as np
        import pyarrow as pa
        from stripline.operators.images import BATCH_BYTES

        for batch in batches:
            rows, held, first = [], 0, 0
            for i, x in enumerate(batch.column("content")):
                px = plain_png(x.as_buffer().to_pybytes())
                rows.append((None, None, -1, None, "unreadable") if px is None else (px.shape[1], px.shape[0], px.shape[2], np.ascontiguousarray(px).tobytes(), None))
                held += len(rows[-1][3] or b"")
                if held > BATCH_BYTES or i + 1 == batch.num_rows:
                    head = [batch.column(c).slice(first, len(rows)) for c in ("ch", "file", "page_no")]
                    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
                    yield pa.RecordBatch.from_arrays([*head, *[pa.array(v, k) for v, k in zip(zip(*rows), kinds)]],
                                                     names=["ch", "file", "page_no", "width", "height", "channels", "data", "problem"])
                    rows, held, first = [], 0, i + 1

    number = dict(files.dtypes)["page_no"]
    found = files.select("ch", "file", "page_no", "content").mapInArrow(
        decode, f"ch string, file string, page_no {number}, width int, height int, channels int, data binary, problem string")
    return found.filter("problem is null") if drop_invalid else found


def _scan_images_jvm(spark: SparkSession, root: str, drop_invalid: bool) -> DataFrame:
    """:func:`scan_images` by Spark's own decoder, for all kinds of images that it knows."""
    i = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", str(drop_invalid).lower()).load(root)
    i = _named(i.select("image.*"), "origin")
    bad = F.col("width") < 0
    i = i.filter(is_active_page("file") & F.col("page_no").isNotNull())
    return i.select("ch", "file", "page_no", F.when(~bad, F.col("width")).alias("width"), F.when(~bad, F.col("height")).alias("height"), F.col("nChannels").alias("channels"),
                    F.when(~bad, F.col("data")).alias("data"), F.when(bad, "unreadable").alias("problem"))


def object_pages(files: DataFrame, content: str = "content", pattern: str = r"/Type\s*/Page(?!s)", header: str = "%PDF") -> DataFrame:
    """Page objects of documents from their bytes, whether the header is right and whether the file is empty."""
    text = F.decode(F.col(content), "ISO-8859-1")
    return files.withColumns({"header_ok": text.startswith(header), "pages": F.regexp_count(text, F.lit(pattern)), "is_empty": F.octet_length(F.col(content)) == 0})
