"""Window forms against a sequential restatement, on random files."""

import random
from collections import Counter, defaultdict

import pytest

import model
from codestrata import fixed_values as fv
from codestrata.operators import ai, complexity, quality
from codestrata.plans.analysis import Analysis

PIECES = (
    "", "", "   ", "\t", "}", "{", "  }", "end", "  end", "});", "x := 1", "    y()", "return x",
    "  return", "break", "throw e", "case 1:", "default:", "func a(x int) {", "func (s *S) b() {",
    "  cb := func(x int) {", "go func() {", "def f(a):", "  def g(b):", "def h", "z = 3", "local function q(a)",
    "function r(a, b) {", "const s = async (a) => {", "public static void t(int a) {",
    "fn u(a: T) {", "fun v(a) {", "int w(int a) {", "static func x(a) {", "if (a && b || c) {",
    "else if x {", "elif x:", "for x in y {", "while x:", "import (", ")", '\t"fmt"', '\t"net/http"',
    '\tal "a/b"', '\t_ "c/d"', 'import "os"', 'import "a/_x"', "fmt.Println()", "http.Get()", "al.Do()",
    "os.Exit(1)", "// note", "# data", "result = Data", "myresult = TMP", "\u00a0return\u00a0", "caf\u00e9 { }",
    "if err != nil {", "  return err", "} catch (Exception e) {", ".catch(err => x)",
    "except ValueError as e:", "same one", "same two", "same one", "same two", "\r",
)
EXTENSIONS = [".go", ".go", ".py", ".rb", ".lua", ".js", ".ts", ".java", ".rs", ".php", ".dart",
              ".kt", ".swift", ".c", ".sql"]


@pytest.fixture(scope="module")
def random_files():
    rng = random.Random(11)
    out = []
    for n in range(600):
        few = rng.sample(PIECES, rng.choice((4, 12, len(PIECES))))
        lines = [rng.choice(few) for _ in range(rng.choice((1, 3, 9, 12, 25, 60)))]
        out.append((n, f"f{n}{EXTENSIONS[n % len(EXTENSIONS)]}", "\n".join(lines)))
    return out


@pytest.fixture(scope="module")
def analysis(spark, random_files):
    a = Analysis(
        spark.createDataFrame(random_files, "file_id long, path string, content string"))
    yield a
    a.release()


def expected(random_files, f):
    out = {}
    for n, path, content in random_files:
        language = fv.LANGUAGE_BY_EXTENSION["." + path.rsplit(".", 1)[1]]
        out[n] = f(content, content.split("\n"), language)
    return out


def grouped(rows):
    out = defaultdict(list)
    for key, *values in rows:
        out[key].append(tuple(values) if len(values) > 1 else values[0])
    return out


def assert_same(random_files, rows, f):
    got, want = grouped(rows), expected(random_files, f)
    for n, path, content in random_files:
        assert sorted(got.get(n, [])) == sorted(want[n]), (path, content)
    assert any(want.values())


def test_functions(analysis, random_files):
    rows = analysis.functions.select(
        "file_id", "name", "start_line", "end_line", "complexity").collect()
    assert_same(random_files, rows, lambda c, lines, lang: model.functions(lines, lang))


def test_file_complexity(analysis, random_files):
    rows = complexity.file_complexity(analysis.lines).select("file_id", "complexity").collect()
    assert_same(random_files, rows,
                lambda c, lines, lang: [1 + sum(model.branches(x, lang) for x in lines)])


def test_dead_code(analysis, random_files):
    seen = quality.with_closure_flag(quality.with_following_lines(analysis.lines))
    rows = quality.emit(seen, quality.dead_code()).select("file_id", "line_no").collect()
    assert_same(random_files, rows, lambda c, lines, lang: model.dead_code(lines))


def test_unused_imports(analysis, random_files):
    rows = quality.unused_imports(analysis.lines, analysis.files).select(
        "file_id", "line_no").collect()
    assert_same(random_files, rows,
                lambda c, lines, lang: model.unused_imports(lines) if lang == "Go" else [])


def test_duplicates(analysis, random_files):
    rows = quality.duplicate_windows(analysis.lines).select(
        "file_id", "line_no", "first_line").collect()
    assert_same(random_files, rows, lambda c, lines, lang: model.duplicates(lines))


def test_transitions(analysis, random_files):
    rows = analysis.file_stats.select("file_id", "n_transitions").collect()
    assert_same(random_files, rows, lambda c, lines, lang: [model.transitions(lines)])


def test_error_blocks(analysis, random_files):
    rows = ai.error_blocks(analysis.lines).collect()
    assert_same(random_files, rows, lambda c, lines, lang: model.error_blocks(lines, lang))


def test_generic_names(analysis, random_files):
    rows = ai.generic_names(analysis.files).select("file_id", "name", "line_no").collect()
    assert_same(random_files, rows, lambda c, lines, lang: model.generic_names(c))


def test_partitioning_changes_nothing(spark, random_files):
    """Other partition counts and a shuffled input give the same findings."""
    def found(rows, partitions):
        files = spark.createDataFrame(rows, "file_id long, path string, content string")
        issues = Analysis(files.repartition(partitions)).issues
        return Counter(tuple(r) for r in issues.collect())

    shuffled = random_files[:]
    random.Random(5).shuffle(shuffled)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = found(random_files, 1)
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        assert found(shuffled, 5) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
