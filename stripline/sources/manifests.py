"""Manifests and reports as JSON text: strict readers, permissive readers and JSON-lines writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([
    T.StructField("algorithm", T.StringType()), T.StructField("status", T.StringType()), T.StructField("integrity_ok", T.BooleanType()),
    T.StructField("source_stage", T.StringType()), T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("cleans", T.ArrayType(T.StringType())),
])


def parse(bodies: DataFrame, schema: T.StructType = MANIFEST, body: str = "body") -> DataFrame:
    """Parsed column ``m``; null where the text is not a JSON object of the schema."""
    m = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    first = schema.fields[0].name
    return bodies.withColumn("m", F.when(m[first].isNotNull(), m))


def read_manifest(bodies: DataFrame, algorithms: Sequence[str], schema: T.StructType = MANIFEST) -> tuple[DataFrame, DataFrame]:
    """Accepted manifests and the rejected rows with the reason."""
    p = parse(bodies, schema).withColumn("reject", F.when(F.col("m").isNull(), "invalid_json").when(~F.col("m.algorithm").isin(*algorithms), "unsupported_algorithm"))
    return p.filter("reject is null").drop("reject"), p.filter("reject is not null")


def read_reports(bodies: DataFrame) -> DataFrame:
    """Every report; a corrupt one becomes an ``invalid_report`` row."""
    bad = F.col("m").isNull()
    return parse(bodies).withColumns({"issue_type": F.when(bad, "invalid_report").otherwise(F.col("m.status")),
                                      "message": F.when(bad, "Relatório inválido ou ilegível.")})


def read_manifest_files(spark, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """Manifest files below a folder, one JSON object per file, with their SHA-256; corrupt files give a null ``m``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    text = files.select("path", F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("body"))
    return parse(text, schema)


def manifest_lines(header: DataFrame, parts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """A manifest as JSON lines: one header object per key and one object per child row, so that no key is gathered in memory."""
    keys = list(keys)

    def lines(df, kind):
        body = [c for c in df.columns if c not in keys]
        return df.select(*keys, F.lit(kind).alias("kind"), F.to_json(F.struct(*body)).alias("json"))

    out = lines(header, "header")
    for kind, df in parts.items():
        out = out.unionByName(lines(df, kind))
    return out


def write_lines(lines: DataFrame, path: str, keys: Sequence[str]) -> None:
    """JSON-lines files, one folder per key."""
    body = F.to_json(F.struct(F.col("kind"), F.col("json")))
    lines.select(*keys, body.alias("value")).write.mode("errorifexists").partitionBy(*keys).text(path)
