"""Signals, scores and roll-ups on small files."""

import pytest
from pyspark.sql import functions as F

from codestrata import fixed_values as fv
from codestrata.operators import ai, rollup
from codestrata.plans.analysis import Analysis


def signals_of(corpus):
    rows = Analysis(corpus).signals.collect()
    return {r.file_id: r for r in rows}


def test_weights_add_up():
    assert sum(fv.SIGNAL_WEIGHTS.values()) == pytest.approx(1.0)
    assert list(ai.SIGNALS) == list(fv.SIGNAL_WEIGHTS)


def test_files_under_five_lines_have_no_score(files):
    got = signals_of(files(["// Loop through data\n" * 3, "// Loop through data\n" * 4]))
    assert got[0].readme_comments == 0.0 and got[0].generic_naming == 0.0
    assert got[1].readme_comments == 1.0 and got[1].generic_naming == 1.0
    assert Analysis(files(["// Loop through data\n" * 3])).ai_issues.count() == 0


@pytest.mark.parametrize("words, score", [
    ("a b c d e f g h i j", 0.0), ("a a a a a a", 1.0), ("a a a a a b b b b b", 1 - 0.2 / 0.6),
    ("", 0.0), ("a A a A a b c d e f", 0.0)])
def test_token_diversity(files, words, score):
    got = signals_of(files([words + "\n" * 5]))[0]
    if words == "a A a A a b c d e f":
        assert got.token_diversity == pytest.approx(0.0)  # 6 of 10: not above 0.6
    else:
        assert got.token_diversity == pytest.approx(score)


def test_comment_quality_and_ratio_differ(files):
    got = signals_of(files(["// a\n" * 2 + "x\n" * 4, "// a\n" * 6]))
    assert got[0].comment_quality == 0.6 and got[0].comment_ratio == pytest.approx(1 / 3)
    assert got[1].comment_quality == 0.0 and got[1].comment_ratio == 0.0


def test_markers(files):
    def content(hits, others):
        return "# Note that x\n" * hits + "# x y z w\n" * others + "\n\n\n"
    got = signals_of(files([("a.py", content(1, 1)), ("b.py", content(1, 5)), ("c.py", content(1, 9)),
                            ("d.py", content(1, 19)), ("e.py", content(1, 39))]))
    assert [got[n].marker_phrases for n in range(5)] == [0.0, 1.0, 0.7, 0.4, 0.2]


def test_uniform_functions(files):
    def content(*sizes):
        return "\n".join(f"func f{n}() {{" + "\nx" * (s - 1) for n, s in enumerate(sizes))
    got = signals_of(files([content(5, 5), content(5, 5, 5), content(2, 2, 11), content(2, 2, 20)]))
    assert [got[n].function_uniformity for n in range(4)] == [0.0, 0.8, 0.4, 0.0]


def test_error_blocks_must_repeat(files):
    block = "if err != nil {\n  return err\n}\n"
    other = "if err != nil {\n  panic(%d)\n}\n"
    got = signals_of(files([block * 2 + "x\n", "x\n" + block * 3 + "\n\n", block + other % 1 + other % 2]))
    assert [got[n].error_boilerplate for n in range(3)] == [0.0, 0.5, 0.0]


def test_structure(files):
    numbered = "// 1. Aa\nx\n// 2. Bb\ny\n"
    alternating = "// a\nx\n" * 6
    got = signals_of(files([numbered, numbered + "// 3. Cc\n", alternating, "x\n" * 9]))
    assert [got[n].structural_pattern for n in range(4)] == [0.6, 0.9, 1.0, 0.0]


def test_line_lengths(files):
    even = "abcde\n" * 20
    skewed = "a\n" * 19 + "b" * 200
    got = signals_of(files([even, skewed, "abcde\n" * 19]))
    assert [got[n].line_length_dist for n in range(3)] == [0.8, 0.0, 0.0]


def test_repetition(files):
    lua = "vim.cmd('x')\n" * 5 + "\n" * 50
    shapes = 'register("a", 1)\nregister("b", 1)\n' * 3 + "\n" * 10
    got = signals_of(files([("a.lua", lua), shapes, 'register("a", 1)\n' * 4 + "\n" * 10]))
    assert [got[n].repetitive_structure for n in range(3)] == [0.7, 0.8, 0.0]


def test_score_is_the_weighted_sum(files):
    a = Analysis(files(["// Note that x\nfunc f(data int) {\n" * 9]))
    row = a.signals.withColumn("score", ai.ai_score()).first()
    want = 100 * sum(row[s] * w for s, w in fv.SIGNAL_WEIGHTS.items())
    assert row.score == pytest.approx(want) and 0 < row.score <= 100


def test_generic_name_inside_a_longer_word(files):
    content = "mydata = 1\nx = Data\ny = data\nz = DATA\nw"
    rows = Analysis(files([("a.py", content)])).ai_issues.orderBy("ord").collect()
    assert [(r.line_no, r.message.split("'")[1]) for r in rows] == [(2, "Data")]
    lower = Analysis(files([("a.py", "mydata = 1\nx = data\n\n\n")])).ai_issues.collect()
    assert [r.line_no for r in lower] == [1]


REPORT = "file_id long, complexity int, ai_score double, issue_count long, security_issues long"


@pytest.mark.parametrize("rows, summary, verdict", [
    ([(1, 3, 60.0, 0, 0), (2, 4, 60.5, 2, 0), (3, 1, 0.0, 1, 1)], (3, 2, 8 / 3, 3, 1, 1), ("FAIL", 2)),
    ([(1, 3, 60.0, 0, 0), (2, 4, 60.5, 2, 0)], (2, 1, 3.5, 2, 1, 0), ("WARN", 1)),
    ([(1, 3, 60.0, 0, 0)], (1, 0, 3.0, 0, 0, 0), ("PASS", 0)),
    ([], (0, 0, 0.0, 0, 0, 0), ("PASS", 0))])
def test_summary_and_gate(spark, rows, summary, verdict):
    got = rollup.summary(spark.createDataFrame(rows, REPORT))
    r = got.first()
    assert (r.files_analyzed, r.files_flagged, r.avg_complexity, r.total_issues, r.ai_suspected,
            r.security_issues) == summary
    gate = rollup.gate(got).first()
    assert (gate.verdict, gate.exit_code) == verdict


def test_whole_analysis(files):
    a = Analysis(files(["x\n", "h := md5.New()", "// todo: x"]))
    s = a.summary.first()
    assert (s.files_analyzed, s.files_flagged, s.total_issues, s.security_issues) == (3, 2, 2, 1)
    assert a.gate.first().verdict == "FAIL"
    a.release()


@pytest.mark.parametrize("figures, score, grade", [
    ((0, 0, 0, 0, 1.0), 100, "Excellent"), ((5, 0, 0, 0, 1.0), 85, "Excellent"),
    ((5, 0, 0, 1, 1.0), 84, "Good"), ((0, 7, 1, 0, 15.5), 69, "Fair"), ((9, 9, 9, 9, 90.0), 0, "Needs Work")])
def test_grade(spark, figures, score, grade):
    metrics = spark.createDataFrame(
        [figures], "long_functions long, complex_functions long, duplications long,"
        " unused_imports long, avg_complexity double")
    row = rollup.quality_grade(metrics).first()
    assert (row.score, row.grade) == (score, grade)


def test_directories(spark):
    report = spark.createDataFrame(
        [("a/b/x.go", 1, 1, 0, 0), ("a/y.go", 2, 4, 1, 1), ("z.go", 1, 1, 0, 0)],
        "path string, line_count int, complexity int, issue_count long, security_issues long")
    rows = rollup.directory_rollup(report).collect()
    assert {r.directory: (r.files, r.line_count, r.complexity, r.issue_count) for r in rows} == {
        "": (3, 4, 6, 1), "a": (2, 3, 5, 1), "a/b": (1, 1, 1, 0)}


def test_uniform_note(spark):
    rows = [(1, "a", s) for s in (10, 12, 8, 15)] + [(2, "b", s) for s in (10, 10, 10, 17)] + [
        (3, "c", s) for s in (5, 5, 5)]
    functions = spark.createDataFrame(rows, "file_id long, path string, line_count int")
    assert [tuple(r) for r in rollup.uniform_sizes(functions).collect()] == [(1, "a", 4, 11)]


def test_skew_of_findings(spark):
    """One file with a third of all findings is counted like the others."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("file_id"),
        F.lit(0).alias("category"))
    counts = rollup.issues_per_file(rows)
    assert counts.filter("file_id = 0").first().issue_count == 1000 and counts.count() == 2001
