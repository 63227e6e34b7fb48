"""The one pass over the lines against the operators one by one, and its plan."""

import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import ai, complexity, one_pass, quality, rollup, security, views
from codestrata.plans.analysis import Analysis
from codestrata.sources import derived
from codestrata.sources.lines import per_file
from test_against_model import EXTENSIONS, PIECES

MORE = (
    "x = call(4711, 777)", "y = 4711 + 99", "                        deep()", "\t\t\t\t\t\tdeeper(7777)", "pwd = 'h3kf83jf02kdj4'",
    "h := md5.New() // TODO: x", "# HACK: y", "// This function handles the z", "# First, we load a", "// 1. Setup the b", "# 2. Load the c",
    "userName = firstName", "user_name = first_name", "_ = doThing(a)", "except Exception:", "pass", 'const a = "quoted text here"',
    "vim.keymap.set('n', 'x')", "café := data // ſecret", "a" * 120 + " = md5.New(", "if err != nil {",
)
TYPES = "file_id long, path string, content string"


def random_rows(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        few = r.sample(PIECES + MORE, r.choice((3, 8, 25, len(PIECES))))
        rows.append((i, f"d{i % 3}/f{i}{EXTENSIONS[i % len(EXTENSIONS)]}", "\n".join(r.choice(few) for _ in range(r.choice((0, 1, 4, 5, 6, 11, 12, 13, 40, 90))))))
    block = "\n".join(f"step_{i}()" for i in range(6))
    rows.append((n, "copies.go", "\n".join([block] * 40)))
    rows.append((n + 1, "blank.py", "\n" * 40))
    rows.append((n + 2, "long.js", "\n".join(f"line_{i} = camelCase{i}" for i in range(700))))
    rows.append((n + 3, "imports.go", 'import (\n\t"a/b"\n\tc "d/e"\n\t. "f"\n)\nimport "g"\n' + "x\n" * 12 + "b.Do()\nc.Do()\n" + '"q"\n)\nimport (\n"late/one"'))
    return rows


def as_bag(table, columns):
    rounded = [F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in table.dtypes if c in columns]
    return sorted(map(tuple, table.select(*rounded).select(*columns).collect()), key=repr)


@pytest.fixture(scope="module", params=("random", "derived"))
def analysis(request, spark):
    files = (spark.createDataFrame(random_rows(3), TYPES) if request.param == "random"
             else derived.code_files(spark, "/root/testdata/sf0.001"))
    a = Analysis(files)
    yield a
    a.release()


def test_functions(analysis):
    old = complexity.functions(analysis.lines)
    assert as_bag(analysis.functions, old.columns) == as_bag(old, old.columns)


def test_findings(analysis):
    lines, files, functions = analysis.lines, analysis.files, complexity.functions(analysis.lines)
    stats = per_file(lines, quality.naming_stats())
    for new, old in (
        (analysis.security_issues, security.scan(lines)),
        (analysis.ai_issues, ai.findings(lines, files)),
        (analysis.quality_issues, quality.scan(lines, files, functions, stats)),
    ):
        assert as_bag(new, old.columns) == as_bag(old, old.columns)
        assert new.dtypes == old.dtypes


def test_signals(analysis):
    lines = analysis.lines
    stats = per_file(lines, ai.line_stats(), ai.comment_stats(), complexity.branch_stats(), quality.naming_stats())
    old = ai.signals(ai.file_stats(analysis.files, lines, complexity.functions(lines), stats), "complexity")
    assert as_bag(analysis.signals, old.columns) == as_bag(old, old.columns)


def test_snippets_are_those_of_the_lines(analysis):
    found = analysis.security_findings
    joined = found.join(analysis.lines.select("file_id", "line_no", "line"), ["file_id", "line_no"])
    wrong = joined.filter(~F.col("snippet").eqNullSafe(views.snippet(F.col("line"))))
    assert wrong.count() == 0 and joined.count() == found.count() > 0


def test_one_explode_one_line_sort_one_inline(files):
    facts = Analysis(files(["x\n" * 20]), co_located=True, keep=False).facts
    executed = facts._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Generate posexplode") == 1 and executed.count("Generate inline") == 1
    sorts = [x for x in executed.split("\n") if " Sort [" in x]
    assert len([x for x in sorts if "line_no#" in x]) == 1  # the lines
    assert len([x for x in sorts if "tag#" in x]) == 1  # the keys of a file
    assert len(sorts) == 2 and "Join" not in executed


def test_all_tables_read_the_stored_facts_alone(files):
    a = Analysis(files(["h := md5.New()\nfunc a() {\n}\n"]))
    for table in (a.file_report, a.issues, a.functions, a.gate, a.directories, a.quality_metrics, a.security_findings,
                  rollup.uniform_sizes(a.functions), views.security_view(a.security_findings)):
        leaves = table._jdf.queryExecution().optimizedPlan().collectLeaves()
        kinds = {leaves.apply(i).nodeName() for i in range(leaves.size())}
        assert {k.split(" ")[0] for k in kinds} == {"InMemoryRelation"}, kinds
    a.release()


def test_the_trie_finds_every_literal(spark):
    """Candidates of a line are the rules of which it holds a literal, overlaps and all."""
    from codestrata import fixed_values as fv
    r = random.Random(4)
    literals = sorted({x for rule in fv.SECURITY_RULES for x in rule.needs})
    texts = ["".join(r.choice((r.choice(literals), r.choice(literals)[:-1], "x", " ")) for _ in range(r.randint(0, 6))) for _ in range(2000)] + literals
    table = spark.createDataFrame([(t,) for t in texts], "low string")
    got = table.select("low", F.expr(security.candidate_rules(fv.SECURITY_RULES)).alias("c")).collect()
    for row in got:
        assert sorted(row.c) == [n for n, rule in enumerate(fv.SECURITY_RULES, 1) if any(x in row.low for x in rule.needs)], row.low


def test_file_stats_of_an_empty_corpus(files):
    a = Analysis(files([]), keep=False)
    assert a.issues.count() == 0 and a.file_stats.count() == 0
    assert a.gate.first().verdict == "PASS"


def test_facts_are_few(spark):
    """What is stored grows with the findings, not with the lines."""
    files = spark.createDataFrame([(0, "a.go", "\n".join(f"value{i} := other{i}" for i in range(20_000)))], TYPES)
    assert one_pass.facts(Analysis(files, keep=False).files).count() < 10


def test_lines_that_give_nothing_build_no_items():
    sql = one_pass._items()
    assert sql.startswith("CASE WHEN ") and sql.index(" THEN concat(array_compact(") > sql.index("size(fired) > 0")


def test_the_facts_are_stored_by_one_job_before_they_are_read(spark, files):
    """Several readers of an empty store start several jobs over it, in each of which executors may compute it."""
    a = Analysis(files(["h := md5.New()\nfunc a() {\n}\n"] * 20))
    a.facts
    stored = [x for x in spark.sparkContext._jsc.sc().getRDDStorageInfo() if x.isCached()]
    assert any(x.numCachedPartitions() == x.numPartitions() for x in stored)
    a.release()


def test_the_pass_is_parted_by_cores_not_by_bytes(spark, files):
    facts = Analysis(files(["h := md5.New()"] * 400), keep=False).facts
    facts.count()
    assert facts.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_counts_and_folding_keep_nulls_and_absent_pieces(spark):
    from codestrata.functions import text
    table = spark.createDataFrame([(0, None), (1, ""), (2, "\u017fA{{"), (3, "&&x&&&"), (4, "caf\u00c9")], "n int, x string").select(
        "n", text.count_of("x", "{"), text.count_of("x", "&&"), text.folded("x"))
    assert [tuple(r) for r in table.orderBy("n").collect()] == [
        (0, None, None, None), (1, 0, 0, ""), (2, 2, 0, "sa{{"), (3, 0, 2, "&&x&&&"), (4, 0, 0, "caf\u00e9")]
