"""JSON-lines scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qassay.functions.text import strip


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Strict scan: a line that is not valid JSON fails the job. Lines end with \\n only."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str | list[str], schema: T.StructType, skip: bool = False) -> DataFrame:
    """Scan that keeps bad lines as rows with _bad_line set, or skips them. Blank lines never count."""
    lines = spark.read.option("lineSep", "\n").text(path).filter(strip(F.col("value")) != "")
    with_bad = T.StructType([*schema.fields, T.StructField("_bad_line", T.StringType())])
    rows = lines.select(
        F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad_line"}).alias("_r")
    ).select("_r.*")
    return rows.filter(F.col("_bad_line").isNull()).drop("_bad_line") if skip else rows


def bad_lines(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """file, line (from 1) and text of every line that is neither blank nor valid JSON of the schema. Blank lines count as lines.

    Lines are counted per split of a file, and a running sum over the splits of a file tells how many lines stand before each. So only bad lines
    are joined, a file in very many splits is read in parallel, and nothing of a file is gathered.
    """
    place = F.monotonically_increasing_id()
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), place.alias("place"))
    of_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    splits = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(of_file), F.lit(0)).alias("before"))
    with_bad = T.StructType([*schema.fields, T.StructField("_bad_line", T.StringType())])
    parsed = F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad_line"})
    bad = lines.filter((strip(F.col("value")) != "") & parsed["_bad_line"].isNotNull())
    return bad.join(splits, ["file", "split"]).select("file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_summary(summary: DataFrame, path: str, schema_tag: str, **settings) -> None:
    """One-row summary as a JSON document with its schema tag and settings; nothing passes the driver."""
    row = F.struct(*[F.col(c) for c in summary.columns])
    options = [F.lit(v).alias(k) for k, v in settings.items()]
    doc = summary.select(
        F.lit(schema_tag).alias("schema"), *([F.struct(*options).alias("settings")] if options else []), row.alias("stats")
    )
    doc.coalesce(1).write.mode("overwrite").json(path)
