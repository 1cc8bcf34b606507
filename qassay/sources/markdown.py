"""Markdown files, one row per file."""

from __future__ import annotations

import itertools
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qassay.session import ensure_checkpoint_dir

FOLDER_FILES = 4096  # files of one folder: folders are listed side by side
BATCH_FILES, BATCH_BYTES = 4096, 4 << 20  # files and bytes that a task holds at once
GROUP_FILES = 1 << 16  # files that the driver holds at once, where only Spark's reader can list them


def scan_markdown(spark: SparkSession, path: str, file_glob: str = "*.{md,markdown}") -> DataFrame:
    """Files with their stem as source, *.md and *.markdown unless told otherwise; invalid bytes become replacement characters.
    Empty files have no row, as with Spark's readers.

    The path is a file, a folder with its key=value folders, or a pattern of these (the driver holds what it stands for). On a local file system (of the driver and all executors)
    the tasks list and read the files, so the driver holds none of their paths. On others Spark's reader does, whose driver holds an
    entry per file, so it is given folders of GROUP_FILES files at a time.
    """
    found = _paths(spark, path)
    if not found:
        files = _read(spark, [path], file_glob)  # says that there is no such path
    elif _local_folder(spark, path) is None:
        files = _store_files(spark, found, file_glob)
    else:
        files = _local_files(spark, [(named.toUri().getPath(), is_folder) for named, is_folder in found], file_glob)
    return files.select(
        F.regexp_replace("name", "\\.(md|markdown)$", "").alias("source"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("md"),
    )


def _read(spark: SparkSession, paths: list[str], file_glob: str) -> DataFrame:
    """Name and content by Spark's reader; as binary files, which cost half as much a file as texts read whole."""
    files = spark.read.format("binaryFile").load(paths, pathGlobFilter=file_glob)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")


def _visible(name: str) -> bool:
    """Whether Spark's readers look at files and folders of this name."""
    return not name.startswith(".") and not (name.startswith("_") and "=" not in name) and not name.endswith("._COPYING_")


def _store_files(spark: SparkSession, found: list[tuple], file_glob: str) -> DataFrame:
    """Name and content of the files at (Hadoop path, is a folder), by Spark's reader.

    Several groups of folders are read one after another, now, and their files are kept in the checkpoint folder; Spark's own cache of
    lists (spark.sql.hive.filesourcePartitionFileCacheSize, 250 MB) holds some of the earlier ones. The files of a single folder are one group,
    however many.
    """

    def below(folder, pattern: str) -> list[tuple]:
        return [(named, is_folder) for named, is_folder in _paths(spark, f"{escaped(folder)}/{pattern}") if _visible(named.getName())]

    def escaped(named) -> str:
        return re.sub(r"([\\{}\[\]*?])", r"\\\1", named.toString())

    def leaves(folder) -> Iterator:
        folders = [named for named, is_folder in below(folder, "*=*") if is_folder]
        if not folders:
            yield folder
            return
        for named in folders:
            yield from leaves(named)
        yield from (named for named, is_folder in below(folder, file_glob) if not is_folder)

    groups, size = [[]], 0
    for named in (leaf for named, is_folder in found for leaf in (leaves(named) if is_folder else [named])):
        n = named.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(named).getFileCount()
        if groups[-1] and size + n > GROUP_FILES:
            groups.append([])
            size = 0
        groups[-1].append(escaped(named))
        size += n
    if len(groups) == 1:
        return _read(spark, groups[0], file_glob)
    kept = f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    for group in groups:
        # Spark would read few small files per task.
        _read(spark, group, file_glob).coalesce(spark.sparkContext.defaultParallelism).write.mode("append").parquet(kept)
    return spark.read.schema("name string, content binary").parquet(kept)


def _local_files(spark: SparkSession, found: list[tuple[str, bool]], file_glob: str) -> DataFrame:
    """Name and content of the files at (path, is a folder); the files that Spark's reader would read, and those beside key=value folders.

    One task lists the top of a folder and deals its key=value folders, then the files of all folders are dealt, so neither
    many folders nor many files in one stay with one task.
    """
    matches = re.compile(spark._jvm.org.apache.hadoop.fs.GlobPattern(file_glob).compiled().pattern(), re.DOTALL).fullmatch
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def walk(folder: bytes, deep: bool) -> Iterator[tuple[bytes, bool]]:
        with os.scandir(folder) as entries:
            for entry in entries:
                name = os.fsdecode(entry.name)
                if not _visible(name):
                    continue
                if entry.is_dir():
                    if "=" in name:
                        yield from walk(entry.path, True) if deep else [(entry.path, True)]
                elif entry.is_file() and matches(name):
                    yield entry.path, False

    def listing(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            rows = (row for path, folder in given for row in (walk(path, deep) if folder else [(path, False)]))
            while chunk := list(itertools.islice(rows, BATCH_FILES)):
                paths, folders = zip(*chunk)
                yield pa.record_batch([pa.array(paths, pa.binary()), pa.array(folders, pa.bool_())], names=["path", "folder"])

        return run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, contents, size = [], [], 0
        for path in (path for batch in batches for path in batch.column(0).to_pylist()):
            with open(path, "rb") as file:
                content = file.read()
            if not content:
                continue
            if names and (size + len(content) > BATCH_BYTES or len(names) == BATCH_FILES):
                yield _binary_files(names, contents)
                names, contents, size = [], [], 0
            names.append(os.path.basename(path).decode("utf-8", "replace"))
            contents.append(content)
            size += len(content)
        if names:
            yield _binary_files(names, contents)

    given = [(os.fsencode(path), folder) for path, folder in found if folder or _visible(name := os.path.basename(path)) and matches(name)]
    top = spark.createDataFrame(given, "path binary, folder boolean").mapInArrow(listing(False), "path binary, folder boolean")
    files = top.repartition(tasks).mapInArrow(listing(True), "path binary, folder boolean").select("path")
    return files.repartition(tasks).mapInArrow(read, "name string, content binary")


def _binary_files(names: list[str], contents: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])


def write_texts(texts: DataFrame, path: str, folder_files: int = FOLDER_FILES) -> None:
    """One *.txt file per row of a single text column, ended with one line break; null is written as an empty text.

    The files lie in folders part=<n>. On a local file system (of the driver and all executors) the tasks write them: Hadoop's
    starts a process for the permissions of every file. A task's folders stay hidden until all tasks are done, and only those of
    the attempts that ended well get their names.
    """
    root = _local_folder(texts.sparkSession, path)
    if root is None:
        # Folders of their own keep the lists of files short. The second algorithm moves the files in the tasks, not one by one in the driver.
        part = F.expr(f"monotonically_increasing_id() div {folder_files}").alias("part")
        writer = texts.select(F.col(f"`{texts.columns[0]}`").alias("value"), part).write.partitionBy("part")
        writer.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, n, folder = TaskContext.get().taskAttemptId(), 0, ""
        for batch in batches:
            for text in batch.column(0):
                if n % folder_files == 0:
                    folder = f"_{attempt}-{n // folder_files}"
                    os.mkdir(f"{root}/{folder}")
                    yield pa.RecordBatch.from_pydict({"folder": [folder]})
                held = text.as_buffer()
                with open(f"{root}/{folder}/{n:09d}.txt", "wb") as file:
                    file.write(b"\n" if held is None else held.to_pybytes() + b"\n")
                n += 1

    os.makedirs(root)
    # One row per folder.
    for i, row in enumerate(texts.mapInArrow(write, "folder string").collect()):
        os.rename(f"{root}/{row.folder}", f"{root}/part={i}")


def _paths(spark: SparkSession, path: str) -> list[tuple]:
    """What a path or pattern stands for: Hadoop paths, each with whether it is a folder."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = named.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(named)
    return [(status.getPath(), status.isDirectory()) for status in found or []]


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The path on the local file system, or None when it lies on another one."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None
