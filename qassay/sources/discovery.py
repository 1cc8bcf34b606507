"""Finding condition folders, indexes, summaries and run artifacts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qassay.functions.text import blank_to_null

INDEX_SCHEMA = "conditions map<string,struct<predictions_jsonl:string>>"


def _path() -> Column:
    """Path of the file of a row; a plus sign in it stands for itself."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def scan_conditions(
    spark: SparkSession, folder: str, schema: T.StructType | str, file_name: str = "predictions.jsonl"
) -> DataFrame:
    """All <folder>/<condition>/<file_name> as one table with a condition column."""
    pattern = "/([^/]+)/" + file_name.replace(".", "\\.") + "(/[^/]+)?$"
    return (
        spark.read.schema(schema)
        .option("mode", "FAILFAST")
        .option("lineSep", "\n")
        .json(f"{folder}/*/{file_name}")
        .withColumn("condition", F.regexp_extract(_path(), pattern, 1))
    )


def scan_index(spark: SparkSession, index_path: str, schema: T.StructType | str) -> DataFrame:
    """Tables named by an index document {conditions: {name: {predictions_jsonl: path}}}, read in one scan.

    Only the paths (one per condition) reach the driver, which needs them to plan the scan. A path is a file or a folder
    of files; conditions that name the same path each get its rows.
    """
    entries = (
        spark.read.schema(INDEX_SCHEMA)
        .option("multiLine", "true")
        .json(index_path)
        .select(F.explode("conditions").alias("condition", "_m"))
        .select("condition", "_m.predictions_jsonl")
        .filter(F.col("predictions_jsonl").isNotNull())
        .collect()
    )
    if not entries:
        raise ValueError(f"no conditions in {index_path}")
    named = [(_qualified(spark, e["predictions_jsonl"]), e["condition"]) for e in entries]
    paths = {p for p, _ in named}
    # A file below a folder that is listed itself is read with the folder.
    scanned = sorted(p for p in paths if p.rsplit("/", 1)[0] not in paths)
    conditions = spark.createDataFrame([(_plain(p), c) for p, c in named], "_at string, condition string")
    file = F.regexp_replace(_path(), _SCHEME, "")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(scanned)
    # One row per condition on the right.
    return (
        rows.withColumn("_at", F.explode(F.array(file, F.regexp_replace(file, "/[^/]*$", ""))))
        .join(F.broadcast(conditions), "_at")
        .drop("_at")
    )


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)"


def _plain(path: str) -> str:
    return re.sub(_SCHEME, "", path)


def _qualified(spark: SparkSession, path: str) -> str:
    """Whole path with its file system, also of a relative one."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(name).toString()


def filter_conditions(rows: DataFrame, wanted: Sequence[str], condition: str = "condition") -> DataFrame:
    """Rows of the named conditions with their place in the list; a missing name is an error."""
    names = [w.strip() for w in wanted if w.strip()]
    if not names:
        return rows
    listed = F.array(*[F.lit(n) for n in names])
    kept = rows.filter(F.col(condition).isin(*names))
    found = {r[0] for r in kept.select(condition).distinct().collect()}  # at most len(names) rows
    missing = [n for n in names if n not in found]
    if missing:
        raise ValueError(f"missing conditions: {missing}")
    return kept.withColumn("condition_order", F.array_position(listed, F.col(condition)))


def summary_condition(path: Column) -> Column:
    """Condition of a summary: its own name, the folder of its input, or the folder it lies in."""

    def unless(name: Column, *generic: str) -> Column:
        return F.when(~name.isin(*generic), name)

    parent = F.element_at(F.split("input_jsonl", "/"), -2)
    many_parts = F.size(F.split("input_jsonl", "/")) >= 2
    folder = F.regexp_extract(path, "/([^/]+)/[^/]+$", 1)
    return F.coalesce(
        unless(blank_to_null(F.col("condition")), "judged", "predictions"),
        unless(blank_to_null(F.col("model_id_from_rows")), "judged", "predictions"),
        F.when(many_parts, unless(blank_to_null(parent), "judged", "predictions")),
        unless(blank_to_null(folder), "judged"),
        F.lit("unknown"),
    )


def scan_judge_summaries(
    spark: SparkSession, folder: str, schema: str, file_name: str = "judge_summary.json"
) -> DataFrame:
    """One summary per child folder, hidden folders and .bad_ backups left out.

    The schema must hold condition, model_id_from_rows and input_jsonl.
    """
    name = file_name.replace(".", "\\.")
    # A summary written by Spark is a folder of that name with part files in it.
    path = F.regexp_replace(_path(), f"/{name}/[^/]+$", f"/{file_name}")
    child = F.regexp_extract(path, f"/([^/]+)/{name}$", 1)
    return (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .json(f"{folder}/*/{file_name}")
        .withColumn("_path", path)
        .withColumn("_child", child)
        .filter(~F.col("_child").startswith(".") & ~F.contains(F.col("_child"), F.lit(".bad_")))
        .withColumn("condition", summary_condition(F.col("_path")))
        .drop("_path", "_child")
    )


def scan_runs(spark: SparkSession, root: str, schema: str, file_glob: str) -> DataFrame:
    """Artifacts at any depth under a root with the run name taken from .../runs/<run>/...; else the third-last folder."""
    path = _path()
    named = F.regexp_extract(path, "/runs/([^/]+)/", 1)
    return (
        spark.read.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", file_glob)
        .json(root)
        .withColumn("run_name", F.coalesce(F.nullif(named, F.lit("")), F.element_at(F.split(path, "/"), -4)))
    )
