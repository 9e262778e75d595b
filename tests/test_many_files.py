"""Folders of many small files: the same files as by Spark's own source, in few tasks."""
import os
import tracemalloc

from corpusmill.functions.text import decode_text
from corpusmill.plans import workflows as W
from corpusmill.sinks import named_files as N
from corpusmill.sources import files as SF
from pyarrow.fs import FileSelector, FileType, SubTreeFileSystem


def test_tasks_do_not_grow_with_the_number_of_files(spark, tmp_path):
    root = f"file:{tmp_path}/in"
    rows = [(f"{'abc'[i % 3]}/f{i}.{'cs'[i % 2]}", f"text {i}\r\n".encode() + b"\xff") for i in range(600)]
    N.write_files(spark.createDataFrame(rows, "name string, content binary"), root)
    files = SF.load_text_files(spark, root, "f*.[cs]", recursive=True)
    assert files.rdd.getNumPartitions() <= 8  # a task of every 32 files were 19
    got = {(r.folder, r.path, r.name): r.content for r in files.collect()}
    assert got == {(f"{root}/{n[0]}", f"{root}/{n}", n[2:]): f"text {n[3:-2]}\n" for n, _ in rows}


def test_the_same_files_as_by_the_own_source(spark, tmp_path):
    for name in ("a.c", "_b.c", ".c.c", "d.s", "sub/e.c", "_sub/f.c", "k=1/g.c", "_k=1/h.c", "sub/.i/j.c", "sub/deep/k.c"):
        os.makedirs(f"{tmp_path}/{name}".rsplit("/", 1)[0], exist_ok=True)
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write(name)
    own = spark.read.format("binaryFile").option("pathGlobFilter", "*.c").option("recursiveFileLookup", "true").load(f"file:{tmp_path}")
    want = {(r.path, r.t) for r in own.select("path", decode_text("content").alias("t")).collect()}
    assert {(r.path, r.content) for r in SF.load_text_files(spark, f"file:{tmp_path}", "*.c", recursive=True).collect()} == want
    # without going down, the folders of a partitioned table are looked at all the same
    flat = {r.path[len(f"file:{tmp_path}/"):] for r in SF.load_text_files(spark, f"file:{tmp_path}", "*.c").collect()}
    assert flat == {"a.c", "k=1/g.c", "_k=1/h.c"}


def test_a_plain_path_is_read_in_few_tasks_too(spark, tmp_path):
    """a checkpoint folder without a scheme was listed in the driver, with a task of every few files."""
    root = f"{tmp_path}/a b%20#é"
    N.write_files(spark.createDataFrame([(f"{'abc'[i % 3]}/f{i}.c", f"text {i}") for i in range(600)], "name string, content string"), root)
    files = SF.load_text_files(spark, root, "f*.c", recursive=True)
    assert files.rdd.getNumPartitions() <= 8  # a task of every 32 files were 19
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "f*.c").load(root)
    want = {(r.path, r.t) for r in own.select("path", decode_text("content").alias("t")).collect()}
    assert len(want) == 600 and {(r.path, r.content) for r in files.collect()} == want
    assert {r.path for r in SF.load_text_files(spark, f"file:{root}", "f*.c", recursive=True).collect()} == {p for p, _ in want}


def test_addresses(spark, tmp_path):
    assert N.qualified(spark, "/a/b") == "file:/a/b" and N.qualified(spark, "hdfs://n/a") == "hdfs://n/a"
    assert [N.filesystem(p)[1] for p in ("/a/b", "file:/a/b", "file:///a//b%20c/")] == ["/a/b", "/a/b", "/a/b%20c"]
    for address in (f"{tmp_path}/none", "foo://x/y", f"{tmp_path}/*"):  # left to Spark's own source
        assert SF._in_tasks(spark, address, "*.c") is None


def test_rewritten_files_are_read_back_in_few_tasks(spark, tmp_path):
    """thousands of changed files in one folder, by a plain path."""
    files = spark.range(600).selectExpr("concat('f', id, '.c') as name", "'p' as path", "concat('int f', id, '; ', if(id % 2 = 0, '// x', '')) as content")
    counts = W.rewrite_corpus(files, f"{tmp_path}/out")
    assert (counts["rows"], counts["changed"], counts["files"]) == (600, 300, 300)
    back = SF.load_text_files(spark, f"{tmp_path}/out", "*.c")
    assert back.rdd.getNumPartitions() <= 8  # a task of every 32 files were 10
    assert {r.name for r in back.collect()} == {f"f{i}.c" for i in range(0, 600, 2)}


def test_a_local_folder_is_listed_without_being_held(tmp_path):
    """all of a flat folder's names in one list were 190 bytes a file in the task that lists it."""
    os.makedirs(f"{tmp_path}/sub")
    for i in range(2000):
        open(f"{tmp_path}/f{i}", "w").close()
    os.symlink(f"{tmp_path}/f0", f"{tmp_path}/link")
    os.symlink(f"{tmp_path}/gone", f"{tmp_path}/dangling")
    fs, root = N.filesystem(f"file:{tmp_path}")
    selected = {(i.base_name, i.path, i.type == FileType.Directory) for i in fs.get_file_info(FileSelector(root)) if i.type != FileType.NotFound}
    tracemalloc.start()
    got = {name for name, _, _ in N.entries_of(fs, root) if name in ("f0", "sub", "link", "dangling")}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {"f0", "sub", "link"} and peak < 50_000
    assert set(N.entries_of(fs, root)) == selected
    # where pyarrow alone knows the folder, by its own listing
    assert set(N.entries_of(SubTreeFileSystem(root, fs), "")) == {(name, name, d) for name, _, d in selected}
