"""Roll-ups after edits, moves and deletions equal those of a batch run over what is left."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codestrata.functions.text import bound
from codestrata.operators.findings import ISSUE_COLUMNS
from codestrata.plans.analysis import Analysis
from codestrata.streaming import incremental
from codestrata.streaming.corrections import CHANGES_SCHEMA, SUMS, Corrected, follow, newer_than

LINES = ("h := md5.New()", "// TODO: later", "value = 4711", 'password = "Tr0ub4dor-and-3"', "x := 1", "", "if a && b {", "}")


def rows(table, *columns):
    return sorted(map(repr, table.select(*columns).collect()))


def same_as_batch(spark, state, left):
    a = Analysis(spark.createDataFrame(left, "file_id long, path string, content string"), keep=False)
    assert rows(state.directories, "directory", *SUMS) == rows(a.directories, "directory", *SUMS)
    assert rows(state.issues, *ISSUE_COLUMNS) == rows(a.issues, *ISSUE_COLUMNS)
    assert state.gate.collect() == a.gate.collect()
    assert rows(state.files, "file_id", "path", "line_count") == rows(a.file_counts, "file_id", "path", "line_count")


@pytest.fixture
def feed(spark):
    return lambda changes: spark.createDataFrame(changes, CHANGES_SCHEMA)


def test_edits_moves_and_deletions_in_any_order(spark, feed, tmp_path):
    r = random.Random(5)
    history = []
    for file_id in range(12):
        for version in range(1, r.randint(2, 6)):
            path = f"{r.choice('abc')}/{r.choice('xyz')}/f{file_id}{r.choice(['.go', '.go', '.py', '.unknown'])}"
            history.append((file_id, version, path, "\n".join(r.choices(LINES, k=r.randint(0, 9))), r.random() < 0.2))
    r.shuffle(history)
    newest = {}
    for x in history:
        newest[x[0]] = max(newest.get(x[0], x), x, key=lambda c: c[1])
    left = [(x[0], x[2], x[3]) for x in newest.values() if not x[4]]
    state = Corrected(spark, str(tmp_path / "state"))
    third = len(history) // 3
    parts = [history[:third], history[third:2 * third] + history[:3], history[2 * third:] + history[-2:]]  # with repeats
    for n, part in enumerate(parts):
        state.apply(feed(part), n)
    same_as_batch(spark, state, left)
    state.apply(feed(parts[2]), 2)  # run again
    state.apply(feed(history), 3)  # nothing new
    same_as_batch(spark, state, left)
    assert spark.read.parquet(f"{state.folder}/figures").filter("batch = 3").count() == 0
    assert spark.read.schema("directory string").parquet(f"{state.folder}/corrections/batch=3").count() == 0
    other = state.compact(str(tmp_path / "compact"))
    same_as_batch(spark, other, left)
    gone = left[0][0]
    other.apply(feed([(gone, 99, None, None, True), (gone, 98, "late.go", "h := md5.New()", False)]), 4)
    same_as_batch(spark, other, left[1:])


def test_last_file_gone_empty_and_odd_rows(spark, feed, tmp_path):
    state = Corrected(spark, str(tmp_path / "state"))
    assert state.directories.count() == state.issues.count() == state.files.count() == 0
    assert state.gate.first().verdict == "PASS"
    state.apply(feed([]), 0)
    state.apply(feed([(1, 1, "a/f.go", "h := md5.New()", None), (None, 1, "n.go", "x", False), (2, None, "m.go", "x", False),
                      (3, 1, "null.go", None, False)]), 1)
    assert state.gate.first().verdict == "FAIL" and [r.path for r in state.issues.collect()] == ["a/f.go"]
    state.apply(feed([(1, 2, "a/f.go", "h := md5.New()", True), (1, 2, "a/f.go", "x", False), (3, 2, None, None, True)]), 2)
    assert state.directories.count() == state.issues.count() == 0 and state.gate.first().verdict == "PASS"
    state.apply(feed([(1, 2, "a/f.go", "x", False)]), 3)  # the deletion stands
    assert state.files.count() == 0


def test_follows_a_stream(spark, feed, tmp_path):
    state = Corrected(spark, str(tmp_path / "state"))
    checkpoint = incremental.checkpoint_folder(spark, "corrections-" + tmp_path.name)
    landing = str(tmp_path / "landing")
    for batch in ([(1, 1, "a.go", "h := md5.New()", False), (2, 1, "b.go", "x", False)], [(1, 2, "a.go", "x", False)]):
        feed(batch).write.mode("append").parquet(landing)
        query = follow(incremental.landed_files(spark, landing, CHANGES_SCHEMA), state, checkpoint).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    same_as_batch(spark, state, [(1, "a.go", "x"), (2, "b.go", "x")])
    changed = spark.read.parquet(f"{state.folder}/corrections").filter("batch = 1").agg(F.sum("issue_count")).first()[0]
    assert changed == -1


def test_a_batch_is_read_once(spark, feed, tmp_path):
    """Its rows may be costly to derive; the figures and the facts share them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(content):
        seen.add(1)
        return content

    changes = feed([(n, 1, f"f{n}.go", "h := md5.New()", False) for n in range(30)])
    Corrected(spark, str(tmp_path / "state")).apply(changes.withColumn("content", counted("content")), 0)
    assert seen.value == 30


def test_contents_are_derived_once_and_of_late_versions_never(spark, feed, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(content):
        seen.add(1)
        return content

    def costly(versions):
        rows = feed([(n, version, f"f{n}.go", f"x := {version}" + "0" * n, False) for n, version in versions])
        return rows.select("file_id", "version", "path", bound(counted("content")).alias("content"), "deleted")

    state = Corrected(spark, str(tmp_path / "state"))
    state.apply(costly([(n, 3) for n in range(30)]), 0)
    assert seen.value == 30
    state.apply(costly([(n, 4 if n < 10 else 2) for n in range(30)]), 1)  # ten edits among late versions
    assert seen.value == 40
    state.apply(costly([(n, 1) for n in range(30)]), 2)
    assert seen.value == 40
    same_as_batch(spark, state, [(n, f"f{n}.go", f"x := {4 if n < 10 else 3}" + "0" * n) for n in range(30)])


def test_contents_of_the_history_are_derived_after_late_versions_are_dropped(spark, tmp_path):
    from codestrata.sources import derived
    spark.createDataFrame([(n, "a b c d e f g h") for n in range(20)] + [(20, None)], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    changes = derived.file_changes(spark, str(tmp_path))
    files = {r.file_id: (r.path, r.content) for r in derived.code_files(spark, str(tmp_path)).collect()}
    drafted = lambda n: n % 10 in (2, 3, 4)
    for r in changes.collect():
        path, content = files[r.file_id]
        assert r.path == ("moved/" + path if r.version == 3 and r.file_id % 10 == 1 else path)
        assert r.content == (derived.FIRST_DRAFT + content if r.version < 3 and drafted(r.file_id) else content)
        assert r.deleted == (r.version == 3 and r.file_id % 10 == 0)
    known = changes.filter("arrival < 2").select("file_id", "version", "deleted").localCheckpoint()
    left = newer_than(changes.filter("arrival = 2"), known)
    nodes = re.findall(r"^[ :+-]*(Generate|Join)\b", left._jdf.queryExecution().optimizedPlan().toString(), re.M)
    assert nodes == ["Generate", "Join"], nodes  # the join stands below
    assert left.count() == 0 and newer_than(changes, known.filter("version < 3")).filter("version < 3").count() == 6 + 3


def test_only_the_files_of_an_arrival_are_derived(spark):
    from codestrata.sources import derived
    late = derived.file_changes(spark, "/root/testdata/sf0.001").filter("arrival = 2")
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    nodes = re.findall(r"^[ :+-]*(Generate|Filter|Union)\b", plan, re.M)
    assert nodes == ["Generate", "Filter"], nodes  # the files are chosen below, before contents are derived
    assert {r.file_id % 10 for r in late.collect()} == {0, 2, 3, 4}
