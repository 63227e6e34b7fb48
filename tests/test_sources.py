"""Scanning, selecting and storing: directories, line semantics, history, reports, streams."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from codestrata.functions import text
from codestrata.operators import churn, rollup, views
from codestrata.operators.ranking import numbered
from codestrata.operators.findings import ORDER
from codestrata.plans.analysis import Analysis
from codestrata.sources import changes, corpus, reports
from codestrata.sources.lines import explode_lines, line_count, with_line_columns
from codestrata.streaming import incremental


def test_scan_directory(spark, tmp_path):
    tree = {
        "a.go": "x", "sub/b.py": "y\n", "vendor/c.go": "x", "sub/.hid/d.go": "x", ".e.go": "x",
        "sub/node_modules/f.go": "x", "sub/vendor": "x", "g.txt": "x", "H.GO": "x", "i": "x",
        "sub/50%25 a.js": "x", "big.go": "x" * 60, "sub/bin.md": "x",
    }
    for name, content in tree.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    files = corpus.analysable(corpus.scan_directory(spark, str(tmp_path), max_bytes=50))
    assert {(r.path, r.language) for r in files.collect()} == {
        ("a.go", "Go"), ("sub/b.py", "Python"), ("sub/50%25 a.js", "JavaScript"),
        ("sub/bin.md", "Markdown")}
    assert Analysis(corpus.scan_directory(spark, str(tmp_path))).signals.count() == 5


def planted(root, names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x := 1\n")


def test_names_with_underscores_are_read(spark, tmp_path):
    names = ["src/__init__.py", "src/_helpers.py", "src/_private/b.py", "__tests__/c.js", "pkg/_x_test.go", "a.go"]
    planted(tmp_path, [*names, "__snapshots__/s.js", "_a/.git/config.go"])
    rows = corpus.scan_directory(spark, str(tmp_path)).collect()
    assert sorted(r.path for r in rows) == sorted(names)
    assert {(r.file_id == r.path, r.n_bytes, r.content) for r in rows} == {(True, 7, "x := 1\n")}


def test_the_root_may_be_relative_and_lie_below_pruned_names(spark, tmp_path, monkeypatch):
    planted(tmp_path / ".cache" / "vendor", ["a.go", "sub/b.py", "vendor/c.go"])
    monkeypatch.chdir(tmp_path / ".cache")
    for root in ("vendor", "./vendor/", f"file://{tmp_path}/.cache/vendor"):
        assert sorted(r.path for r in corpus.scan_directory(spark, root).collect()) == ["a.go", "sub/b.py"]
    with pytest.raises(NotADirectoryError):
        corpus.scan_directory(spark, "missing")


def test_unreadable_files_and_links_to_directories_are_left_out(spark, tmp_path):
    planted(tmp_path, ["a.go", "d/b.go", "gone.go"])
    os.symlink(tmp_path, tmp_path / "d" / "loop")
    os.symlink(tmp_path / "nothing", tmp_path / "dangling.go")
    files = corpus.scan_directory(spark, str(tmp_path))
    os.remove(tmp_path / "gone.go")
    assert sorted(r.path for r in files.collect()) == ["a.go", "d/b.go"]


def test_only_chosen_files_are_opened(spark, tmp_path):
    planted(tmp_path, ["a.go", "b.txt", "node_modules/m/x.js", ".git/o.go", "sub/.h.go"])
    (tmp_path / "big.go").write_text("x" * 99)
    listed = corpus.list_directory(spark, str(tmp_path))
    assert sorted(r.path for r in listed.collect()) == ["a.go", "b.txt", "big.go", "sub/.h.go"]
    assert {(r.path, r.reason) for r in corpus.skipped(listed, 50).collect()} == {
        ("b.txt", "unsupported"), ("big.go", "too large"), ("sub/.h.go", "pruned")}
    plan = corpus.scan_directory(spark, str(tmp_path), 50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("RLIKE") < plan.index("LogicalRDD")  # chosen below the read
    empty = tmp_path / "empty"
    empty.mkdir()
    assert corpus.scan_directory(spark, str(empty)).count() == 0


def test_invalid_utf8_is_read(spark, tmp_path):
    (tmp_path / "a.go").write_bytes(b"x \xff\xfe y\nz")
    files = corpus.scan_directory(spark, str(tmp_path))
    assert files.select(line_count().alias("n")).first().n == 2


def test_a_file_named_like_an_ignored_directory_stays(spark):
    df = spark.createDataFrame([("vendor",), ("a/build",), ("build/a",), ("a/.b/c",), ("a.b/c",)], "path string")
    assert [r[0] for r in df.select(corpus.is_pruned()).collect()] == [False, False, True, True, False]


@pytest.mark.parametrize("path, language", [
    ("a.tar.go", "Go"), ("a.GO", None), ("a.go/b", None), (".go", "Go"), ("a.", None), ("x/a.hpp", "C++")])
def test_language(spark, path, language):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(corpus.language_of().alias("l")).first().l == language


def test_size_limit(files):
    got = corpus.analysable(files(["a" * 10, "\u00e9" * 5, "a" * 11]), max_bytes=10)
    assert sorted(r.file_id for r in got.collect()) == [0, 1]


def test_size_limit_reaches_the_scan(spark, files, tmp_path):
    sized = files(["a", "b" * 9]).withColumn("n_bytes", F.octet_length("content"))
    sized.write.parquet(str(tmp_path / "sized"))
    kept = corpus.analysable(spark.read.parquet(str(tmp_path / "sized")), max_bytes=5)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(n_bytes,5)" in plan
    assert [r.path for r in kept.collect()] == ["f0.go"]


def test_walk_order(files):
    paths = ["b.go", "a/z.go", "a.go", "a/b/c.go", "B.go", "a-b/x.go"]
    got = corpus.first_in_walk_order(corpus.analysable(files([(p, "x") for p in paths])), 4)
    assert sorted(r.path for r in got.collect()) == ["B.go", "a-b/x.go", "a/b/c.go", "a/z.go"]


def test_numbers_run_on_over_ranges(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)] + [(3, "y")], "n int, s string")
    got = numbered(rows, ["n", F.desc("s")], "place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 1002))
    assert [(r.n, r.s) for r in got[2:6]] == [(2, "x"), (3, "y"), (3, "x"), (4, "x")]
    assert sorted(r.n for r in numbered(rows, ["n"], "place", 300).collect()) == [0, 1, 2, 3, *range(3, 299)]
    assert numbered(rows.limit(0), ["n"], "place").count() == 0


def test_lines(files):
    rows = with_line_columns(explode_lines(corpus.analysable(files(
        ["", "a\r\n\n \tb\u00a0\n", "\t  # x", "\u00e9"])))).orderBy("file_id", "line_no").collect()
    assert [(r.file_id, r.line_no, r.n_lines, r.line, r.trimmed) for r in rows] == [
        (0, 1, 1, "", ""), (1, 1, 4, "a\r", "a"), (1, 2, 4, "", ""), (1, 3, 4, " \tb\u00a0", "b"),
        (1, 4, 4, "", ""), (2, 1, 1, "\t  # x", "# x"), (3, 1, 1, "\u00e9", "\u00e9")]
    assert [(r.indent, r.is_comment, r.byte_len) for r in rows if r.file_id == 2] == [(6, True, 6)]
    assert [(r.indent, r.byte_len, r.trimmed_bytes) for r in rows if r.file_id == 1][2] == (5, 5, 1)
    assert rows[-1].byte_len == 2


def test_co_located_lines_need_one_shuffle(files):
    """Windows and aggregates by file add no exchange of their own."""
    a = Analysis(files(["x\n" * 20]), keep=False)
    plan = a.functions._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_security_scan_is_narrow(files):
    selected = corpus.analysable(files(["x"]))
    from codestrata.operators import security
    plan = security.scan(explode_lines(selected))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_bucketed_corpus_needs_no_shuffle(spark, files):
    corpus.save_bucketed(files(["func a() {\n}\n", "x"]), "bucketed_corpus", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a = Analysis(spark.table("bucketed_corpus"), co_located=True, keep=False)
        plan = a.functions._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert [r.name for r in a.functions.collect()] == ["a"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_corpus")


LOG = "commit_id long, author string, authored_at timestamp, path string"


def log(spark):
    def at(day):
        return datetime.datetime(2024, 1, day)
    return spark.createDataFrame(
        [(1, "ann", at(1), "f0.go"), (2, "bob", at(2), "f0.go"), (3, "ann", at(3), "f0.go"),
         (3, "ann", at(3), "f1.go"), (4, "cy", at(3), "f1.go")], LOG)


def test_churn(spark):
    rows = {r.path: r for r in churn.churn(log(spark)).collect()}
    assert (rows["f0.go"].commit_count, rows["f0.go"].author_count) == (3, 2)
    assert (rows["f1.go"].last_author, rows["f1.go"].last_modified) == ("cy", "2024-01-03")
    info = {r.path: r.git_info for r in churn.git_info(log(spark)).collect()}
    assert info["f0.go"].authors == ["ann", "bob"] and info["f1.go"].authors == ["cy", "ann"]
    assert info["f0.go"].last_modified == "2024-01-03" and info["f0.go"].commit_count == 3
    newest = changes.newest_commits(log(spark), 2).collect()
    assert sorted((r.commit_id, r.path) for r in newest) == [(3, "f0.go"), (3, "f1.go"), (4, "f1.go")]
    assert [tuple(r) for r in churn.high_churn(log(spark), 1).collect()] == [("f0.go", 3)]
    ranks = churn.author_ranks(log(spark)).filter("path = 'f1.go'").collect()
    assert sorted((r.author_no, r.author) for r in ranks) == [(1, "cy"), (2, "ann")]


def test_files_without_history(spark, files):
    report = churn.apply_git_info(files(["x", "y", "z"]), churn.git_info(log(spark)))
    assert {r.path: r.git_info and r.git_info.commit_count for r in report.collect()} == {
        "f0.go": 3, "f1.go": 2, "f2.go": None}


def test_reports(spark, files, tmp_path):
    a = Analysis(files(["h := md5.New()\n// todo: x", "x"]), log(spark))
    out = str(tmp_path)
    reports.write_json_report(a.summary, a.file_report, a.issues, out)
    stored = [json.loads(x) for f in os.listdir(f"{out}/files") if f.endswith(".json")
              for x in open(f"{out}/files/{f}")]
    assert [(f["path"], [i["severity"] for i in f["issues"]]) for f in stored] == [
        ("f0.go", ["error", "info"])]

    reports.write_dump(reports.full_dump(a.file_report, a.functions, a.issues), f"{out}/dump")
    dump = reports.read_dump(spark, f"{out}/dump")
    assert reports.issues_of_dump(dump).count() == 2
    assert dump.filter("path = 'f0.go'").first().git_info.authors == ["ann", "bob"]

    lines = [r.value for r in reports.markdown_report(
        a.summary, a.file_report, a.issues, "/root/x").orderBy("line_no").collect()]
    assert lines[0] == "# Analysis Report" and "| Total Issues | 2 |" in lines
    assert "| `f0.go` | 1 | insecure_crypto | MD5 is cryptographically broken |" in lines
    assert lines.index("## \U0001f7e0 Errors") < lines.index("## \U0001f535 Info")
    assert not any("Critical" in x or "Suspected Files" in x and x.startswith("##") for x in lines)
    a.release()


def test_json_document(spark, files, tmp_path):
    """One valid document, read back from its part files, with the findings of a file in their order."""
    many = "x := 1 // TODO: a\n" * 500
    a = Analysis(files([("b.go", "h := md5.New()\n// todo: x\nvalue = 4711"), ("a \"q\".py", many), ("clean.go", "x"), ("c/d.go", "FIXME: y")]))
    document = reports.json_document(a.summary, a.file_report, a.issues)
    reports.write_lines(document, f"{tmp_path}/doc")
    parts = sorted(f for f in os.listdir(f"{tmp_path}/doc") if f.startswith("part-"))
    stored = json.loads("".join(open(f"{tmp_path}/doc/{f}").read() for f in parts))
    assert stored["summary"]["files_analyzed"] == 4 and stored["summary"]["total_issues"] == a.issues.count()
    assert [f["path"] for f in stored["files"]] == ['a "q".py', "b.go", "c/d.go"]
    for f in stored["files"]:
        rows = a.issues.filter(F.col("path") == f["path"]).orderBy(*ORDER).collect()
        assert [(i["line"], i["type"]) for i in f["issues"]] == [(r.line_no, r.type) for r in rows] != []
    plan = document._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    nothing = Analysis(files([]))
    lines = [r.value for r in reports.json_document(nothing.summary, nothing.file_report, nothing.issues).orderBy("line_no").collect()]
    assert json.loads("".join(lines))["files"] == []


def test_snippets_and_views(files):
    a = Analysis(files(["  h := md5.New() // " + "x" * 90]))
    row = views.security_view(a.security_findings).first()
    assert row.label == "ERROR" and len(row.snippet) == 70 and row.snippet.endswith("...")
    order = [r.severity for r in views.by_severity(a.issues).collect()]
    assert order == sorted(order, reverse=True)


def test_tree_order(files):
    rows = rollup.tree_listing(files([("b.go", ""), ("A.go", ""), ("z/c.go", ""), ("z/y/d.go", "")]))
    assert [(r.parent, r.name) for r in rows.collect()] == [
        ("", "z"), ("", "A.go"), ("", "b.go"), ("z", "y"), ("z", "c.go"), ("z/y", "d.go")]


def test_bar(spark):
    df = spark.createDataFrame([(0.0,), (0.55,), (1.2,)], "r double")
    assert [r[0] for r in df.select(text.bar(F.col("r"), 10)).collect()] == [
        "░" * 10, "█" * 5 + "░" * 5, "█" * 10]


def test_streams(spark, files, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    files(["h := md5.New()"]).write.parquet(landing)
    stream = incremental.landed_files(spark, landing)
    query = incremental.analyse_landing(
        stream, out, incremental.checkpoint_folder(spark, "landing")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.read.parquet(f"{out}/issues").count() == 1
    assert spark.read.parquet(f"{out}/file_report").count() == 1
    found = incremental.security_stream(stream)
    memory = found.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    assert memory.awaitTermination(120)
    assert spark.table("found").count() == 1


def test_log_order_and_time_order_are_kept_apart(spark):
    """After a rebase the head of the log may be older than what is below it."""
    def at(day):
        return datetime.datetime(2024, 1, day)
    table = spark.createDataFrame(
        [(1, 2, "ann", at(9), "a"), (2, 1, "bob", at(3), "a"), (3, 3, "cy", at(5), "a")], "commit_id long, seq long, author string, authored_at timestamp, path string")
    row = churn.churn(table).first()
    assert (row.last_author, row.last_modified) == ("bob", "2024-01-09")
    info = churn.git_info(table).first().git_info
    assert (info.last_author, info.last_modified, info.authors) == ("bob", "2024-01-09", ["bob", "ann", "cy"])
    assert [r.commit_id for r in changes.newest_commits(table, 1).collect()] == [2]
    assert changes.newest_commits(table).count() == 3


def test_repositories_have_their_own_history(spark):
    def at(day):
        return datetime.datetime(2024, 1, day)
    table = spark.createDataFrame(
        [("r", 1, "ann", at(1), "a/f.go"), ("r", 2, "bob", at(2), "a/f.go"), ("r", 3, "bob", at(3), "a/f.go"),
         ("s", 1, "cy", at(1), "a/f.go"), ("s", 2, "di", at(4), "a/g.go")],
        "root string, commit_id long, author string, authored_at timestamp, path string")
    newest = changes.newest_commits(table, 1).collect()
    assert sorted((r.root, r.commit_id) for r in newest) == [("r", 3), ("s", 2)]
    assert {(r.root, r.path): (r.commit_count, r.last_author) for r in churn.churn(table).collect()} == {
        ("r", "a/f.go"): (3, "bob"), ("s", "a/f.go"): (1, "cy"), ("s", "a/g.go"): (1, "di")}
    assert [tuple(r) for r in churn.high_churn(table, 2).collect()] == [("r", "a/f.go", 3), ("s", "a/f.go", 1)]
    assert sorted((r.root, r.author_no, r.author) for r in churn.author_ranks(table).filter("path = 'a/f.go'").collect()) == [
        ("r", 1, "bob"), ("r", 2, "ann"), ("s", 1, "cy")]
    files = spark.createDataFrame([(0, "r", "a/f.go", "x"), (1, "s", "a/f.go", "y\nz"), (2, "t", "a/f.go", "")],
                                  "file_id long, root string, path string, content string")
    a = Analysis(files, table)
    assert {r.root: r.git_info and r.git_info.authors for r in a.file_report.collect()} == {
        "r": ["bob", "ann"], "s": ["cy"], "t": None}
    assert {(r.root, r.directory): r.line_count for r in a.directories.collect()} == {
        (root, d): n for root, n in (("r", 1), ("s", 2), ("t", 1)) for d in ("", "a")}
    first = corpus.analysable(files, max_files=2)
    assert sorted(r.root for r in first.collect()) == ["r", "s"]
    a.release()


def test_large_files_are_analysed_unless_a_limit_is_given(spark, files):
    big = files([("big.go", "x := 1\n" * 100_000), ("vendor/a.go", "x"), ("b.txt", "x"), ("c.go", "y")])
    assert {r.path for r in corpus.analysable(big).collect()} == {"big.go", "c.go"}
    assert {r.path for r in corpus.analysable(big, 512 * 1024).collect()} == {"c.go"}
    assert {(r.path, r.reason) for r in corpus.skipped(big, 512 * 1024).collect()} == {
        ("big.go", "too large"), ("vendor/a.go", "pruned"), ("b.txt", "unsupported")}


def test_snippets_are_cut_by_bytes(spark):
    from pyspark.sql import functions as F

    from codestrata.functions import text
    rows = spark.createDataFrame([("é" * 60,), ("a" * 81,), ("é" * 40,)], "line string")
    assert [r[0] for r in rows.select(text.cut(F.col("line"), 80, 77)).collect()] == ["é" * 38 + "...", "a" * 77 + "...", "é" * 40]
