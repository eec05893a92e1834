"""Writers: PNG bytes, versioned promotion and append-only logs."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def encode_png(images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PNG bytes (column ``content``) of images given as BGR rows; uncompressed scan lines, RGB, 8 bit."""
    from stripline.operators.images import image_job

    def fn(px, _):
        import struct
        import zlib

        import numpy as np

        h, w = px.shape[:2]
        lines = np.zeros((h, w * 3 + 1), dtype=np.uint8)
        lines[:, 1:] = px[..., ::-1].reshape(h, w * 3)

        def chunk(kind, body):
            return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")
        return {"content": [png]}

    return image_job(images, keys, "content binary", fn)


class PromotionConflict(ValueError):
    """Another writer has made a version since this one looked."""


def _versions(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_versions")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def latest_version(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number and folder of the official version; 0 and None without one.  Every version has one small pointer file that never changes."""
    path, fs = _versions(spark, root)
    if not fs.exists(path):
        return 0, None
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    n = max((int(x) for x in names if x.isdigit()), default=0)
    return (n, spark.read.text(f"{root}/_versions/{n:012d}").first()[0]) if n else (0, None)


def current_version(spark: SparkSession, root: str) -> str | None:
    """Folder of the official version."""
    return latest_version(spark, root)[1]


def claim_version(spark: SparkSession, root: str, n: int, target: str) -> bool:
    """Make ``target`` version ``n``, unless there is one: of several writers exactly one succeeds.

    The pointer is written in full under another name; on a local disk it is then linked, on others renamed, both of which fail if the name is taken.
    """
    path, fs = _versions(spark, root)
    fs.mkdirs(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    tmp, final = hadoop(path, f".{uuid.uuid4().hex}"), hadoop(path, f"{n:012d}")
    stream = fs.create(tmp, False)
    stream.write(bytearray(target.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(tmp.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not fs.exists(final) and bool(fs.rename(tmp, final))
    finally:
        if fs.exists(tmp):
            fs.delete(tmp, False)


def promote_versioned(pieces: DataFrame, errors_of, root: str, replace: bool = False, retries: int = 0) -> str:
    """Write a new version, check it, then make it the official one; any error row leaves the official version as it was.

    ``errors_of(df)`` returns the error rows of a written version.  A valid official version is not replaced unless asked.  If another writer was faster,
    the new official version is looked at as the old one was; with ``replace`` that is refused after ``retries`` more tries, as the caller
    hasn't seen what it would replace.
    """
    spark = pieces.sparkSession

    def seen() -> int:
        n, old = latest_version(spark, root)
        if old and not replace and errors_of(spark.read.parquet(old)).isEmpty():
            raise ValueError("a valid official version exists")
        return n

    n = seen()
    target = f"{root}/v-{uuid.uuid4().hex}"
    pieces.write.mode("errorifexists").parquet(target)
    if not errors_of(spark.read.parquet(target)).isEmpty():
        raise ValueError(f"the staged version has errors: {target}")
    while not claim_version(spark, root, n + 1, target):
        if replace and retries <= 0:
            raise PromotionConflict(f"version {n + 1} of {root} was made by another writer")
        retries -= 1
        n = seen()
    return target


def update_versioned(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], retries: int = 20) -> str:
    """Make ``change(current)`` the next version; if another writer was faster, the change is applied to that one's version, so that no update is lost."""
    for _ in range(retries + 1):
        n, old = latest_version(spark, root)
        target = f"{root}/v-{uuid.uuid4().hex}"
        change(spark.read.parquet(old) if old else None).write.mode("errorifexists").parquet(target)
        if claim_version(spark, root, n + 1, target):
            return target
    raise PromotionConflict(f"{root} changed {retries + 1} times during the update")


def append_events(events: DataFrame, path: str) -> None:
    """Append events to the log as JSON lines."""
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.mode("append").text(path)


def write_files(files: DataFrame, root: str, path: str = "path", content: str = "content") -> None:
    """One file below ``root`` for each row, written by the task that holds it: under another name first, so that a file is whole or absent."""
    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from stripline.streaming.tail import open_path

        fs, base = open_path(root)
        n, made = 0, set()
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = f"{base}/{name}"
                folder = at.rsplit("/", 1)[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                tmp = f"{at}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(tmp) as out:
                    out.write(data.as_buffer())
                fs.move(tmp, at)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    files.select(path, F.col(content).cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
