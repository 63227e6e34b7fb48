"""Files read as chunks of whole lines, written trees, and what a scan leaves out."""

import io
import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import security
from codestrata.sources import corpus, tree
from codestrata.sources.lines import explode_lines


@pytest.mark.parametrize("seed", range(6))
def test_chunks_hold_every_line_once(seed):
    r = random.Random(seed)
    for _ in range(120):
        data = b"".join(r.choice((b"a", b"bb", b"\n", b"\n", b"\xc3\xa9" * 3, b"x" * 20)) for _ in range(r.randint(0, 25)))
        for chunk in (1, 2, 3, 7, 16, 1000):
            parts = [tree.lines_of_chunk(io.BytesIO(data), len(data), n * chunk, (n + 1) * chunk)
                     for n in range(max(1, -(-len(data) // chunk)))]
            assert b"\n".join(p for p in parts if p is not None) == data
            assert sum(p.count(b"\n") + 1 for p in parts if p is not None) == data.count(b"\n") + 1


def test_a_long_line_is_read_in_steps(monkeypatch):
    monkeypatch.setattr(tree, "_STEP", 10)
    data = b"a\n" + b"y" * 95 + b"\nend"
    parts = [tree.lines_of_chunk(io.BytesIO(data), len(data), n * 8, (n + 1) * 8) for n in range(-(-len(data) // 8))]
    assert [p for p in parts if p is not None] == [b"a\n" + b"y" * 95, b"end"]


CONTENTS = {
    "a.go": "h := md5.New()\n\nx", "sub/b.py": "", "sub/c.rs": "one line without end", "d.js": "\n\n\n",
    "big.go": "".join(f"line {i} é\n" for i in range(3000)) + "h := sha1.Sum(x)", "vendor/v.go": "x", "n.txt": "x",
}


@pytest.fixture
def root(spark, tmp_path):
    tree.write_files(spark.createDataFrame(list(CONTENTS.items()), "path string, content string"), str(tmp_path / "t"))
    return str(tmp_path / "t")


@pytest.mark.parametrize("chunk", (5, 64, 1 << 20))
def test_lines_of_a_tree_equal_those_of_its_files(spark, root, chunk):
    whole = explode_lines(corpus.analysable(corpus.scan_directory(spark, root)))
    chunked = corpus.scan_directory_lines(spark, root, chunk_bytes=chunk)
    assert chunked.dtypes == whole.dtypes
    assert sorted(map(tuple, chunked.collect())) == sorted(map(tuple, whole.collect()))
    rules = security.scan(chunked).select("path", "line_no", "rule_no").collect()
    assert sorted(map(tuple, rules)) == sorted(map(tuple, security.scan(whole).select("path", "line_no", "rule_no").collect())) != []


def test_chunks_of_one_file_are_read_by_many_tasks(spark, root):
    listed = corpus.list_directory(spark, root).filter("path = 'big.go'")
    chunks = tree.read_chunks(listed, root, 1000).withColumn("task", F.spark_partition_id()).collect()
    assert len(chunks) > 30 and len({c.task for c in chunks}) == 4
    assert max(len(c.content) for c in chunks) < 1100


def test_skipped_names_all_that_is_missing(spark, root, monkeypatch):
    found = {(r.path, r.reason) for r in corpus.skipped_in_directory(spark, root).collect()}
    assert found == {("n.txt", "unsupported")}  # vendor is not entered
    monkeypatch.setattr(tree, "READABLE_BYTES", 1000)
    found = {(r.path, r.reason) for r in corpus.skipped_in_directory(spark, root).collect()}
    assert found == {("n.txt", "unsupported"), ("big.go", "read as lines only")}
    assert {r.path for r in corpus.scan_directory(spark, root).collect()} == {"a.go", "sub/b.py", "sub/c.rs", "d.js"}
    assert corpus.scan_directory_lines(spark, root).filter("path = 'big.go'").count() == 3001
    found = {(r.path, r.reason) for r in corpus.skipped_in_directory(spark, root, 500).collect()}
    assert found == {("n.txt", "unsupported"), ("big.go", "too large")}


def test_what_cannot_be_opened_is_named(spark, root):
    listed = spark.createDataFrame([("a.go", 3), ("gone.go", 7), ("sub", 1)], "path string, n_bytes long")
    assert {(r.path, r.n_bytes) for r in tree.unreadable(listed, root).collect()} == {("gone.go", 7), ("sub", 1)}
    system, base = tree._opened(root)
    assert list(tree._entries(system, base, "missing")) == [("missing", False, None)]
    assert tree.read_chunks(listed, root).select("path").distinct().collect()[0].path == "a.go"


def test_chunks_share_batches(spark, root):
    import pyarrow as pa
    size = len(CONTENTS["big.go"].encode())
    rows = pa.record_batch([["big.go"] * 50, [size] * 50, list(range(50))], names=["path", "n_bytes", "chunk"])
    schema = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64())])
    found = list(tree._over_chunks(root, 100, 3, lambda x: x.count(b"\n") + 1, schema)(iter([rows])))
    assert len(found) == 1 and found[0].num_rows == 50


def test_names_of_a_directory_come_one_by_one(tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    (tmp_path / "_a.go").write_text("xyz")
    (tmp_path / "to_file").symlink_to(tmp_path / "_a.go")
    (tmp_path / "to_dir").symlink_to(tmp_path / "sub")
    (tmp_path / "to_nothing").symlink_to(tmp_path / "none")
    system, base = tree._opened(str(tmp_path))
    monkeypatch.setattr(tree.fs, "FileSelector", None)  # would hold all names at once
    assert sorted(tree._entries(system, base, "")) == [("_a.go", False, 3), ("sub", True, None), ("to_file", False, 3)]
    assert list(tree._entries(system, base, "gone")) == [("gone", False, None)]


def test_what_a_scan_leaves_out_walks_the_tree_once(spark, root, monkeypatch):
    walks = []
    walk = tree.list_entries
    monkeypatch.setattr(tree, "list_entries", lambda *args: walks.append(args) or walk(*args))
    found = corpus.skipped_in_directory(spark, root, 500)
    assert len(walks) == 1
    assert {(r.path, r.reason) for r in found.collect()} == {("big.go", "too large"), ("n.txt", "unsupported")}
