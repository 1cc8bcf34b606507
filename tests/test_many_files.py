"""Sources and sinks of very many small files."""

import glob
import os
import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from qassay.session import ensure_checkpoint_dir
from qassay.sources import markdown, shards
from tests.test_queries import SF_DIR, test_query_matches_sql as query_matches_sql


def test_texts_are_written_by_the_tasks(spark, tmp_path):
    texts = [f"# {i}\nline é" for i in range(23)] + ["ends\n", "", None, "a\r\nb"]
    rows = spark.createDataFrame([(t,) for t in texts], "md string").repartition(3)
    path = f"file://{tmp_path}/a b"
    markdown.write_texts(rows, path, folder_files=4)
    folders = os.listdir(tmp_path / "a b")
    assert all(f.startswith("part=") for f in folders) and len(folders) >= 27 / 4
    assert max(len(os.listdir(tmp_path / "a b" / f)) for f in folders) == 4
    got = sorted(r.md for r in markdown.scan_markdown(spark, path, "*.txt").collect())
    assert got == sorted((t or "") + "\n" for t in texts)


def test_no_texts_give_no_files(spark, tmp_path):
    markdown.write_texts(spark.createDataFrame([], "md string"), str(tmp_path / "none"))
    assert markdown.scan_markdown(spark, str(tmp_path / "none"), "*.txt").count() == 0


def test_texts_on_other_file_systems_are_written_by_spark(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(markdown, "_local_folder", lambda spark, path: None)
    markdown.write_texts(spark.createDataFrame([("a\nb",), ("",), (None,)], "md string"), str(tmp_path / "t"))
    assert sorted(r.md for r in markdown.scan_markdown(spark, str(tmp_path / "t"), "*.txt").collect()) == ["\n", "\n", "a\nb\n"]


def test_names_of_markdown_files_are_kept(spark, tmp_path):
    for name in ("a+b.md", "50%25.markdown", "ü.md"):
        (tmp_path / name).write_text("x", encoding="utf-8")
    assert {r.source for r in markdown.scan_markdown(spark, str(tmp_path)).collect()} == {"a+b", "50%25", "ü"}


def test_scan_markdown_starts_no_process_per_file(spark):
    """Files that Hadoop's local file system writes have a .crc file each, and a process for the permissions of each."""
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/markdown-*"))
    n = entry_module.queries()["scan_markdown"](spark, SF_DIR).count()
    (folder,) = set(glob.glob(f"{root}/markdown-*")) - before
    names = [f for _, _, files in os.walk(folder) for f in files]
    assert len([f for f in names if f.endswith(".txt")]) == n and not [f for f in names if f.endswith(".crc")]


def test_scan_markdown_matches_sql(spark):
    query_matches_sql(spark, "scan_markdown")


def _files_by_folder(root):
    return {os.path.basename(d): sum(f.endswith(".json") for f in files) for d, _, files in os.walk(root) if "shard=" in d}


def test_a_shard_is_one_file_wherever_its_rows_lie(spark, tmp_path):
    rows = spark.range(0, 300, 1, 6).withColumn("row", (F.col("id") * 77) % 300)
    lo = F.floor(F.col("row") / 30) * 30
    named = rows.select("row", F.format_string("shard%06d_%06d", lo, lo + 30).alias("shard")).cache()
    shards.write_shards(named, f"{tmp_path}/one")
    files = _files_by_folder(tmp_path / "one")
    assert len(files) == 10 and set(files.values()) == {1}
    shards.write_shards(named, f"{tmp_path}/pieces", piece_rows=10)
    assert all(1 <= n <= 3 for n in _files_by_folder(tmp_path / "pieces").values()) and max(_files_by_folder(tmp_path / "pieces").values()) > 1
    for folder in ("one", "pieces"):
        merged = shards.merge_shards(spark, f"{tmp_path}/{folder}", "row bigint")
        assert sorted((r.row, r.shard_start) for r in merged.collect()) == [(i, i // 30 * 30) for i in range(300)]


def test_shards_of_other_names_are_written(spark, tmp_path):
    shards.write_shards(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "x int, shard string"), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s").count() == 3


def test_shard_merge_check_matches_sql(spark):
    query_matches_sql(spark, "shard_merge_check")


def _by_sparks_reader(spark, path, file_glob):
    rows = spark.read.format("binaryFile").load(path, pathGlobFilter=file_glob).select("path", "content").collect()
    return sorted((r.path.rsplit("/", 1)[1], bytes(r.content)) for r in rows)


def _scanned(spark, path, file_glob):
    return sorted((r.source, r.md.encode()) for r in markdown.scan_markdown(spark, path, file_glob).collect())


def test_the_driver_holds_no_paths_of_files(spark, tmp_path):
    """Spark's reader keeps an entry per file in the driver, and reads few files per task."""
    for folder in range(3):
        (tmp_path / f"part={folder}").mkdir()
        for i in range(200):
            (tmp_path / f"part={folder}" / f"{i}.txt").write_text(f"{folder} {i}")
    rows = markdown.scan_markdown(spark, str(tmp_path), "*.txt")
    assert rows.inputFiles() == []
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.md for r in rows.collect()) == sorted(f"{folder} {i}" for folder in range(3) for i in range(200))


def test_scanned_files_are_those_of_sparks_reader(spark, tmp_path):
    flat, deep = tmp_path / "a [b]", tmp_path / "deep"
    for name in ("x.txt", "y.txt.log", ".x.txt", "_x.txt", "_k=v.txt", "x.txt._COPYING_", "a+%20é.txt", "empty.txt", "sub/z.txt", "_hidden=0.txt"):
        for folder in (flat,) if "/" in name else (flat, deep / "k=1" / "l=a%2Fb", deep / "k=2" / "l=c", deep / "_k" / "l=1", deep / "_k=3" / ".l=1"):
            (folder / name).parent.mkdir(parents=True, exist_ok=True)
            (folder / name).write_bytes(b"" if name == "empty.txt" else f"{folder.name}\r\n{name}".encode())
    os.symlink(flat / "x.txt", flat / "link.txt")
    os.symlink(flat / "none", flat / "broken.txt")
    escaped = str(flat).replace("[", "\\[").replace("]", "\\]")
    for path in (escaped, f"file://{tmp_path}/deep", f"{tmp_path}/{{a,b}}*", f"{deep}/k=1", f"{deep}/k=1/l=*/[xy].t*", f"{escaped}/x.txt", f"{escaped}/_x.txt"):
        for file_glob in ("*.txt", "*.{txt,log}", "?.txt", "[!x]*.txt"):
            assert _scanned(spark, path, file_glob) == _by_sparks_reader(spark, path, file_glob), (path, file_glob)
    assert len(_scanned(spark, escaped, "*.txt")) == 5 and len(_scanned(spark, str(deep), "*.txt")) == 8  # with link.txt in the first


def test_files_beside_folders_are_scanned(spark, tmp_path):
    (tmp_path / "k=1").mkdir()
    (tmp_path / "a.md").write_text("a")
    (tmp_path / "k=1" / "b.md").write_text("b")
    assert _scanned(spark, str(tmp_path), "*.md") == [("a", b"a"), ("b", b"b")]


def test_files_are_held_in_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(markdown, "BATCH_BYTES", 10)
    monkeypatch.setattr(markdown, "BATCH_FILES", 3)
    for i in range(1, 41):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * i + (b"\xff" if i % 2 else b""))
    got = {r.source: r.md for r in markdown.scan_markdown(spark, str(tmp_path), "*.txt").collect()}
    assert got == {f"{i}.txt": "x" * i + ("�" if i % 2 else "") for i in range(1, 41)}


def test_a_missing_path_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        markdown.scan_markdown(spark, str(tmp_path / "none")).count()


def _other_file_system(spark, folder):
    """The folder by the name that only Spark's readers know."""
    name = f"t{uuid.uuid4().hex}"
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./in", f"file://{folder}")
    return f"viewfs://{name}/in"


def test_other_file_systems_are_listed_by_groups_of_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(markdown, "GROUP_FILES", 25)
    for i in range(120):
        (tmp_path / f"k={i // 40}" / f"l=[{i // 10}] {{é,a}}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"k={i // 40}" / f"l=[{i // 10}] {{é,a}}" / f"{i}*=.md").write_bytes(b"x%d\xff" % i)
    for name in ("k=1/beside.md", "above.md", "_hidden/no.md", "k=1/.no=0/no.md", "k=2/l=[8] {é,a}/_no.md", "k=2/l=[8] {é,a}/no.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("beside")
    rows = markdown.scan_markdown(spark, _other_file_system(spark, tmp_path))
    assert len(rows.inputFiles()) < 120 and all(name.endswith(".parquet") for name in rows.inputFiles())
    want = sorted([(f"{i}*=", f"x{i}�".encode()) for i in range(120)] + [("above", b"beside"), ("beside", b"beside")])
    assert sorted((r.source, r.md.encode()) for r in rows.collect()) == want
    assert _scanned(spark, str(tmp_path), "*.md") == want
    monkeypatch.setattr(markdown, "GROUP_FILES", 1000)
    assert _scanned(spark, _other_file_system(spark, tmp_path), "*.{md,markdown}") == want


def test_texts_on_other_file_systems_have_short_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(markdown, "GROUP_FILES", 8)
    path = _other_file_system(spark, tmp_path) + "/t"
    markdown.write_texts(spark.range(0, 40, 1, 3).select(F.col("id").cast("string")), path, folder_files=4)
    folders = [f for f in os.listdir(tmp_path / "t") if f.startswith("part=")]
    assert len(folders) == 12 and max(len(glob.glob(f"{tmp_path}/t/{f}/*.txt")) for f in folders) == 4
    assert sorted(r.md for r in markdown.scan_markdown(spark, path, "*.txt").collect()) == sorted(f"{i}\n" for i in range(40))
