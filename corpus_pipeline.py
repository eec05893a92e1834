"""Documents to training sequences: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns what is left of ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripline.session import cut

MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    have = {c.lower() for c in docs.columns}
    return next(n for n in (f"{name}{i}" for i in range(len(have) + 1)) if n not in have)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the certified cutoffs of their language reject."""
    from stripline.llm.quality import keep_good

    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that five or more of them share, but for one place of each; a null text becomes an empty one."""
    from stripline.llm.lines import drop_repeated_lines

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = docs.select("doc_id", "text", F.to_json(F.struct(*others), MICROS).alias("carry"))
    out = drop_repeated_lines(carried, carry="carry").withColumn("o", F.from_json("carry", docs.select(*others).schema, MICROS))
    cols = {c: F.col(f"o.{c}") for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("text").cast("long")
    return out.select(*[cols[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows that links join: that of the smallest doc_id (a missing one is the largest).

    Each row is a document of its own, whatever its doc_id; rows without words are linked with nothing, but those of one doc_id stay once.
    """
    from stripline.llm.jaccard import similar_groups

    key = unused(docs, "_key")
    keyed = cut(docs.withColumn(key, F.monotonically_increasing_id()))
    found = similar_groups(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("_k"), "n_shingles", "component_id")
    named = keyed.select(F.col(key).alias("_k"), "doc_id", F.sha2("text", 256).alias("_sha")).join(found, "_k")
    group = F.when(F.col("n_shingles") > 0, F.col("component_id")).when(F.col("doc_id").isNull(), F.col("_k"))
    kept = named.groupBy(group.alias("_group"), F.when(group.isNull(), F.col("doc_id")).alias("_id")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_sha", "_k"))["_k"].alias(key))
    return keyed.join(kept.select(key), key, "left_semi").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, as often as it draws them; the last of a quota in part."""
    from stripline.llm.mixing import mixed_documents

    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    import public_tokenizers
    from stripline.llm.packing import pack_sequences

    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None  # SQL has no tokenizer; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one leaves is written to the shared folder for the next, as each reads its documents more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
