"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a stream of words: its documents in a pseudo-random order, and once more in another order where its target exceeds its size.  The
first ``quota`` words of the stream are drawn, in blocks of whole documents.  The blocks of all sources are divided among the output shards by a
binary tree: a node splits its exact block counts between its halves with one multivariate-hypergeometric draw, seeded by the node, so each shard
finds its own quotas, and where its blocks begin in each source, by walking down from the root.  Blocks are numbered through a permutation
of the source, hence the shards' draws are disjoint; documents are shuffled inside their shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from stripline.operators.blocks import running
from stripline.session import cut

WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
BLOCK_WORDS, SHARD_WORDS, SLICE_ROWS = 1 << 15, 1 << 20, 2000
SPACES = "[\\x20\\x09-\\x0D]+"


def sized(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, source, size``, a row number ``_r`` and the columns to ``keep`` (as ``_c0``, ...), written once so that the numbers stay."""
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACES), ""))
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("long").alias("size"),
                           F.monotonically_increasing_id().alias("_r"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)]))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """One row per source: its number ``_k`` by code point (null last), rows, words and target.

    Targets are proportional to the weights, up to ``repeats`` times the source's words; what is above is reshared.  With the sources in the order of
    the level at which they fill up, a source is full if the level that the remaining words give the remaining weights reaches it.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    per = per.withColumn("_k", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")).withColumn("_w", w)
    per = per.withColumn("_cap", repeats * F.col("source_size")).withColumn("_fill", F.col("_cap") / F.col("_w"))
    whole, before = W.partitionBy(), W.orderBy("_fill", "_k").rowsBetween(W.unboundedPreceding, -1)
    left = min(share, repeats) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    per = per.withColumn("_level", left / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    per = per.withColumn("_free", F.col("_fill") > F.col("_level"))
    level = F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(W.orderBy("_fill", "_k").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    per = per.withColumn("_end", level)
    target = F.when(F.col("_end").isNull() | (F.col("_fill") <= F.col("_end")), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_end"))
    return per.select("source", "_k", "_rows", "source_size", target.alias("target"))


def split(counts: np.ndarray, shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source that a shard draws: the number of the first and how many, found on the way from the root to the shard."""
    lo, hi, first = 0, shards, np.zeros_like(counts)
    while hi - lo > 1:
        mid, total = (lo + hi) // 2, int(counts.sum())
        part = total * (mid - lo) // (hi - lo)
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        here = rng.multivariate_hypergeometric(counts, part, method="marginals") if 0 < part < total else counts * (part > 0)
        if shard < mid:
            hi, counts = mid, here
        else:
            lo, first, counts = mid, first + here, counts - here
    return first, counts


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 11,
        block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Draw the mix: ``(draws, sizes)``.

    docs: ``doc_id, source, text``; size counts the words of a text (null: 0).  ``draws`` has a row for each time that a document is drawn: the columns of
    ``sizes``, ``source_size``, ``target``, ``epoch``, ``words`` (all of the document's, but for the last document of a quota), ``shard`` and ``position``
    in it.  A source's words add up to its rounded target.  Empty documents are never drawn; repeated rows are documents of their own; a null source
    is a source; without rows or words there are no draws.  The driver holds one row per source.
    """
    sizes = sized(docs, keep)
    sources = cut(targets(sizes, weights, share, repeats).withColumn("_quota", F.round("target").cast("long")))
    per = {r._k: r for r in sources.collect()}
    counts = np.array([-(-per[k]._quota // block_words) for k in range(len(per))], np.int64)
    shards = max(1, -(-sum(r._quota for r in per.values()) // shard_words))
    steps = [next((a for a in range(int(n * 0.618) | 1, n + 2) if math.gcd(a, n) == 1), 1) if n > 2 else 1 for n in counts.tolist()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, n = split(counts, shard, shards, seed)
                source = np.repeat(np.arange(len(counts)), n)
                rank = np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(source))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), shard)), pa.array(source), pa.array(rank)], ["shard", "_k", "_rank"])

    spark = docs.sparkSession
    drawn = spark.range(0, shards, 1, min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(walk, "shard long, _k long, _rank long")

    numbered = spark.createDataFrame([(k, int(a), int(n)) for k, (a, n) in enumerate(zip(steps, counts.tolist()))], "_k long, _a long, _n long")
    info = sources.join(numbered, "_k")
    rows = sizes.filter("size > 0").join(info, sizes.source.eqNullSafe(info.source)).drop(info.source)
    epochs = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_quota") / F.col("source_size")).cast("int") - 1))) \
        .filter(F.col("epoch") * F.col("source_size") < F.col("_quota"))
    h = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("epoch"), F.lit(seed))
    slices = F.greatest(F.lit(1), F.floor(F.col("_rows") / SLICE_ROWS))
    epochs = epochs.withColumn("_h", h).withColumn("_b", F.floor(F.pmod("_h", F.lit(1 << 32)) * slices / (1 << 32)))
    placed = running(epochs.withColumn("_low", F.pmod("_h", F.lit(1 << 32))), ["_k", "epoch"], ["_low", "_h", "doc_id", "_r"], sums={"_at": "size"})
    at = F.col("_at") + F.col("epoch") * F.col("source_size")
    taken = placed.withColumn("_at", at).withColumn("words", F.least(F.col("size"), F.col("_quota") - F.col("_at"))).filter("words > 0")
    taken = taken.withColumn("_rank", F.pmod(F.floor(F.col("_at") / block_words) * F.col("_a"), F.col("_n")))
    out = taken.join(drawn, ["_k", "_rank"])
    local = W.partitionBy("shard").orderBy(F.xxhash64("_h", "shard", "_rank"), "_k", "_r", "epoch")
    return out.select(*sizes.columns, "source_size", "target", "epoch", "words", "shard", (F.row_number().over(local) - 1).alias("position")), sizes


def mixed_sizes(docs: DataFrame, **params) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken`` (words the mix takes, repeats counted)."""
    draws, sizes = mix(docs, **params)
    taken = draws.groupBy("_r").agg(F.sum("words").alias("taken"))
    share = {k: params[k] for k in ("weights", "share", "repeats") if k in params}
    sources = cut(targets(sizes, **share))
    s = sizes.join(sources, sizes.source.eqNullSafe(sources.source)).drop(sources.source)
    return s.join(taken, "_r", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def keyed(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with two columns that tell its rows apart: the file and the row's number in it.  Rows that don't come straight from files are written first."""
    at = [F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])]
    try:
        return docs.select("*", *at)
    except AnalysisException:
        return cut(docs).select("*", *at)


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix as documents: the columns of ``docs``, a row for each draw; a document drawn in part keeps its first words, joined by a space.

    Only keys of rows are drawn; the columns of a document are fetched once, by its key.
    """
    names = [next(n for n in (f"{c}{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for c in ("_file", "_row", "_words", "_size")]
    file, row, taken, size = names
    rows = keyed(docs, file, row)
    draws, _ = mix(rows, keep=(file, row), **params)
    picked = draws.select(F.col("_c0").alias(file), F.col("_c1").alias(row), F.col("words").alias(taken), F.col("size").alias(size))
    j = picked.join(rows, [file, row])
    words = F.array_remove(F.split(F.col("text"), SPACES), "")
    whole = F.col(taken) == F.col(size)
    text = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col(taken).cast("int")), " "))
    cols = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return j.select(*[cols[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
