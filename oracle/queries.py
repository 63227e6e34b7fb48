"""The oracle statement of every registered query."""

from __future__ import annotations

from codestrata import fixed_values as fv
from codestrata.queries import NEWEST_OF_ROOT, REPORT_ROOT, SMALL_FILE_BYTES, TEXT_CHECKS, TEXT_TABLES, TOP_CHURN, WALK_FIRST
from codestrata.sources.derived import TEXT_EXTENSIONS
from oracle.base import CTES, has, names, query
from oracle.tables import (
    AI_SCORE, COMMENT_TEXT, GENERIC_REPETITION, ISSUE, PRUNED, SIGNALS, trim,
)

SQL: dict[str, str] = {}


#: The plain texts as files.
TEXTS = {
    t: f"""SELECT {key} AS file_id, '{t}/' || {key} || ([{names(TEXT_EXTENSIONS[t])}])[{key} % {len(TEXT_EXTENSIONS[t])} + 1]
    AS path, {text} AS content FROM {t}"""
    for t, key, text in (("documents", "doc_id", "text"), ("pages", "page_id", "html"))
}


def add(name: str, sql: str, *needs: str) -> None:
    SQL[name] = query(sql, *needs)
    if name in TEXT_CHECKS:
        derived_files = CTES["raw_files"]
        for t in TEXT_TABLES:
            CTES["raw_files"] = ((), TEXTS[t])
            SQL[f"{t}_{name}"] = query(sql, *needs)
        CTES["raw_files"] = derived_files


def r6(x: str) -> str:
    """Rounded as the queries round, with ties out of the way."""
    return f"round(({x})::DOUBLE + 1e-9, 6)"


def case_of(column: str, values) -> str:
    return f"[{names(values)}][{column} + 1]"


# -- corpus
add("corpus_scan", "SELECT file_id, path, language, strlen(content)::INT AS n_bytes FROM files", "files")
add("skipped_files",
    f"""SELECT * FROM (SELECT file_id, path, strlen(content)::INT AS n_bytes, CASE WHEN {PRUNED} THEN 'pruned'
      WHEN language IS NULL THEN 'unsupported' WHEN strlen(content) > {SMALL_FILE_BYTES} THEN 'too large' END AS reason
      FROM tagged) WHERE reason IS NOT NULL""", "tagged")
add("directory_scan",
    "SELECT path, strlen(content) AS n_bytes, language, md5(content) AS content_md5 FROM files", "files")
add("directory_lines",
    """SELECT path, len(ls)::INT AS n_lines, n::INT AS line_no, md5(ls[n]) AS line_md5 FROM (
      SELECT path, ls, unnest(range(1, len(ls) + 1)) AS n FROM (SELECT path, string_split(content, chr(10)) AS ls FROM files))""",
    "files")
add("directory_skipped",
    f"""SELECT path, strlen(content) AS n_bytes, CASE WHEN {PRUNED} THEN 'pruned'
      WHEN language IS NULL THEN 'unsupported' ELSE 'too large' END AS reason
    FROM tagged WHERE ({PRUNED} OR language IS NULL OR strlen(content) > {SMALL_FILE_BYTES})
      AND file_id NOT IN (SELECT file_id FROM (SELECT file_id, regexp_extract(path, '^(.*/)', 1) AS path FROM raw_files) WHERE {PRUNED})""",
    "tagged", "raw_files")
add("walk_prune", f"SELECT file_id, path, {PRUNED} AS pruned FROM raw_files", "raw_files")
add("language_tagging", "SELECT file_id, path, language FROM tagged", "tagged")
add("size_filter",
    f"""SELECT file_id, strlen(content)::INT AS n_bytes FROM files
    WHERE strlen(content) <= {SMALL_FILE_BYTES}""", "files")
add("file_cap",
    f"SELECT file_id, path FROM files ORDER BY string_split(path, '/') LIMIT {WALK_FIRST}", "files")
add("line_count",
    """SELECT file_id, len(string_split(content, chr(10)))::INT AS line_count,
    (strlen(content) // 35)::INT AS est_lines FROM files""", "files")
add("line_explode",
    """SELECT file_id, line_no, trimmed, byte_len::INT AS byte_len,
    trimmed_bytes::INT AS trimmed_bytes, indent::INT AS indent, is_blank, is_comment
    FROM described""", "described")
add("json_report",
    f"""SELECT path, round((ai_score / 100)::DOUBLE + 1e-9, 6) AS ai_probability, complexity, coalesce(i, '') AS issues
    FROM file_report LEFT JOIN (SELECT file_id, string_agg(line_no || ':' || type || ':' ||
      {case_of('severity', fv.SEVERITY_NAMES)}, ';' ORDER BY pass_no, check_no, ord, rule_no) AS i
      FROM issues GROUP BY file_id) USING (file_id)
    WHERE issue_count > 0 OR ai_score >= 30""", "file_report", "issues")
NO_ORDER = "0 AS pass_no, 0 AS check_no, 0 AS ord, 0 AS rule_no"
add("json_document",
    f"""SELECT row_number() OVER o AS line_no, CASE WHEN kind = 1 AND row_number() OVER o > 2
        OR kind = 2 AND lag(kind) OVER o = 2 THEN ',' ELSE '' END || text AS value FROM (
      SELECT 1 AS part, '' AS path, NULL AS file_id, 0 AS kind, 0 AS pass_no, 0 AS check_no, 0 AS ord, 0 AS rule_no,
        printf('{{"summary":{{"files_analyzed":%d,"files_flagged":%d,"avg_complexity":%.6f,"total_issues":%d}},"files":[',
          files_analyzed, files_flagged, avg_complexity::DOUBLE + 1e-9, total_issues) AS text FROM summary
      UNION ALL SELECT 2, path, file_id, 1, {NO_ORDER}, '{{"path":' || to_json(path)
        || printf(',"ai_probability":%.6f,"complexity":%d,"issues":[', ai_score::DOUBLE / 100 + 1e-9, complexity)
        FROM file_report WHERE issue_count > 0 OR ai_score >= {fv.JSON_KEEP_FROM}
      UNION ALL SELECT 2, path, file_id, 2, pass_no, check_no, ord, rule_no,
        printf('{{"line":%d,"type":"%s","severity":"%s"}}', line_no, type, {case_of('severity', fv.SEVERITY_NAMES)}) FROM issues
      UNION ALL SELECT 2, path, file_id, 3, {NO_ORDER}, ']}}' FROM file_report
        WHERE issue_count > 0 OR ai_score >= {fv.JSON_KEEP_FROM}
      UNION ALL SELECT 3, '', NULL, 0, {NO_ORDER}, ']}}')
    WINDOW o AS (ORDER BY part, string_split(path, '/'), file_id, kind, pass_no, check_no, ord, rule_no)""",
    "summary", "issues", "file_report")
BAR = "repeat('█', least(floor(ai_score / 10), 10)::INT) || repeat('░', 10 - least(floor(ai_score / 10), 10)::INT)"
add("markdown_report",
    f"""SELECT 1 AS part, 0 AS severity, '' AS path, unnest([
      printf('| Files Analyzed | %d |', files_analyzed), printf('| Files Flagged | %d |', files_flagged),
      printf('| Average Complexity | %.1f |', avg_complexity), printf('| Total Issues | %d |', total_issues),
      printf('| AI-Suspected Files | %d |', ai_suspected), printf('| Security Issues | %d |', security_issues)
    ]) AS text FROM summary
    UNION ALL SELECT 2, severity, path, '| `' || path || '` | ' || line_no || ' | ' || type || ' | ' || message || ' |'
    FROM issues
    UNION ALL SELECT 3, 0, path, '| `' || path || '` | ' || {BAR} || ' ' || printf('%.0f', ai_score)
      || '% | ' || complexity || ' |' FROM file_report WHERE ai_score > 50""",
    "summary", "issues", "file_report")


def report_lines(part: int, severity: int, texts, condition: str = "true") -> str:
    """Fixed lines of the report as a SELECT."""
    return (f"SELECT {part} AS part, {severity} AS severity, 0 AS block, unnest(range({len(texts)})) AS n, '' AS path,"
            f" {NO_ORDER}, unnest([{names(texts)}]) AS text WHERE {condition}")


add("markdown_document",
    f"""SELECT row_number() OVER (ORDER BY part, severity DESC, block, n, string_split(path, '/'),
      pass_no, check_no, ord, rule_no, text) AS line_no, text AS value FROM (
    {report_lines(1, 0, ["# " + fv.REPORT_TITLE, "", f"**Directory:** `{REPORT_ROOT}`", "", *fv.REPORT_SUMMARY_HEAD])}
    UNION ALL SELECT 1, 0, 1, unnest(range(6)), '', 0, 0, 0, 0, unnest([
      printf('| Files Analyzed | %d |', files_analyzed), printf('| Files Flagged | %d |', files_flagged),
      printf('| Average Complexity | %.1f |', avg_complexity), printf('| Total Issues | %d |', total_issues),
      printf('| AI-Suspected Files | %d |', ai_suspected), printf('| Security Issues | %d |', security_issues)
    ]) FROM summary
    {" ".join("UNION ALL " + report_lines(2, s, ["", name, "", *fv.REPORT_ISSUE_HEAD],
                                          f"EXISTS (FROM issues WHERE severity = {s})")
              for s, name in fv.REPORT_SECTIONS.items())}
    UNION ALL SELECT 2, severity, 1, 0, path, pass_no, check_no, ord, rule_no,
      '| `' || path || '` | ' || line_no || ' | ' || type || ' | ' || message || ' |' FROM issues
    UNION ALL {report_lines(3, 0, ["", *fv.REPORT_SUSPECT_HEAD], "EXISTS (FROM file_report WHERE ai_score > 50)")}
    UNION ALL SELECT 3, 0, 1, 0, path, {NO_ORDER}, '| `' || path || '` | ' || {BAR} || ' '
      || printf('%.0f', ai_score) || '% | ' || complexity || ' |' FROM file_report WHERE ai_score > 50
    UNION ALL {report_lines(4, 0, fv.REPORT_FOOT)})""",
    "summary", "issues", "file_report")
add("report_source",
    """SELECT f.path, language, line_count, round((ai_score)::DOUBLE + 1e-9, 6) AS ai_probability, complexity,
    n_functions, issue_count::INT AS n_issues, commit_count, round((comment_ratio)::DOUBLE + 1e-9, 6) AS comment_ratio
    FROM file_report f LEFT JOIN git_info USING (path)""", "file_report", "git_info")
add("newest_commits", "SELECT commit_id, author, path FROM newest", "newest")

# -- predicates
add("comment_lines", "SELECT file_id, line_no FROM described WHERE is_comment", "described")
add("security_comment_lines",
    f"SELECT file_id, line_no FROM lines WHERE {has('line', fv.SECURITY_COMMENT_PATTERN)}", "lines")
add("comment_text",
    f"SELECT file_id, line_no, {COMMENT_TEXT} AS comment FROM described WHERE is_comment", "described")
add("test_paths", f"SELECT file_id, path FROM raw_files WHERE {has('path', fv.TEST_PATH_PATTERN)}",
    "raw_files")
add("definition_lines",
    f"SELECT file_id, line_no FROM lines WHERE {has('line', fv.DEFINITION_LINE_PATTERN)}", "lines")
add("security_eligible_lines", "SELECT file_id, line_no FROM eligible", "eligible")
add("category_filter", f"SELECT {ISSUE} FROM ai_issues", "ai_issues")
add("relative_path",
    """SELECT file_id, substr('/corpus/root/' || path, strlen('/corpus/root/') + 1) AS path
    FROM raw_files""", "raw_files")

# -- security
add("security_scan", f"SELECT {ISSUE} FROM security_issues", "security_issues")
offset = 0
for name, rules in (
    ("secret_rules", fv.SECRET_RULES), ("injection_rules", fv.INJECTION_RULES),
    ("crypto_rules", fv.CRYPTO_RULES), ("auth_rules", fv.AUTH_RULES),
):
    add(name,
        f"""SELECT file_id, line_no, type, severity, message, (rule_no - {offset})::INT AS rule_no
        FROM security_issues WHERE rule_no > {offset} AND rule_no <= {offset + len(rules)}""",
        "security_issues")
    offset += len(rules)
add("entropy_gate",
    """SELECT file_id, line_no, rule_no::INT AS rule_no, value, round((entropy)::DOUBLE + 1e-9, 6) AS entropy,
    entropy >= 3.5 AS kept FROM rule_values WHERE value IS NOT NULL""", "rule_values")
add("test_downgrade",
    f"""SELECT file_id, path, line_no, CASE WHEN {has('path', fv.TEST_PATH_PATTERN)} THEN 0
    ELSE severity END::INT AS severity, rule_no FROM security_issues
    WHERE rule_no <= {len(fv.SECRET_RULES)}""", "security_issues")

# -- complexity
add("branch_counts", "SELECT file_id, line_no, branches FROM branches", "branches")
add("file_complexity", "SELECT * FROM file_complexity", "file_complexity")
add("function_starts",
    "SELECT file_id, line_no, started AS name FROM starts WHERE started IS NOT NULL", "starts")
add("function_segments", "SELECT file_id, name, start_line, end_line FROM measured", "measured")
add("function_metrics",
    "SELECT file_id, name, start_line, complexity, line_count FROM measured", "measured")

# -- quality
add("complex_functions", f"SELECT {ISSUE} FROM q_complexity", "q_complexity")
add("long_functions", f"SELECT {ISSUE} FROM q_length", "q_length")
add("long_files", f"SELECT {ISSUE} FROM q_long_file", "q_long_file")
add("deep_nesting", f"SELECT {ISSUE} FROM q_nesting", "q_nesting")
add("long_parameter_lists", f"SELECT {ISSUE} FROM q_parameters", "q_parameters")
add("dead_code", f"SELECT {ISSUE} FROM q_dead_code", "q_dead_code")
add("closure_lines", "SELECT file_id, line_no FROM closures WHERE in_closure", "closures")
add("empty_error_handlers", f"SELECT {ISSUE} FROM q_empty_handler", "q_empty_handler")
add("error_swallowing", f"SELECT {ISSUE} FROM q_swallowing", "q_swallowing")
add("magic_numbers", f"SELECT {ISSUE} FROM q_magic", "q_magic")
add("naming_inconsistency", f"SELECT {ISSUE} FROM q_naming", "q_naming")
add("unused_imports", f"SELECT {ISSUE} FROM q_imports", "q_imports")
add("todo_markers", f"SELECT {ISSUE} FROM q_todo", "q_todo")
add("code_duplication", f"SELECT {ISSUE} FROM q_duplication", "q_duplication")
add("quality_scan", f"SELECT {ISSUE} FROM quality_issues", "quality_issues")


# -- signals
def score(name: str) -> str:
    return f"{r6(SIGNALS[name])} AS score"


add("token_diversity",
    f"""SELECT file_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_distinct, 0) AS n_distinct,
    {score('token_diversity')} FROM stats""", "stats")
add("identifier_tokens", "SELECT * FROM tokens", "tokens")
add("naming_entropy",
    f"""SELECT file_id, coalesce(n_snake, 0) AS n_snake, coalesce(n_camel, 0) AS n_camel,
    {score('naming_entropy')} FROM stats""", "stats")
add("generic_naming", f"SELECT {ISSUE} FROM a_generic", "a_generic")
for name in ("formatting", "comment_quality", "structural_pattern", "line_length_dist",
             "repetitive_structure"):
    add(name, f"SELECT file_id, {score(name)} FROM stats", "stats")
add("generic_repetition",
    f"SELECT file_id, {r6(GENERIC_REPETITION)} AS score FROM stats", "stats")
add("comment_ratio", "SELECT file_id, round((comment_ratio)::DOUBLE + 1e-9, 6) AS score FROM signals", "signals")
add("function_uniformity",
    f"SELECT file_id, n_functions, {score('function_uniformity')} FROM stats WHERE n_functions > 0",
    "stats")
add("marker_phrases", f"SELECT {ISSUE} FROM a_marker", "a_marker")
add("marker_phrase_score",
    f"""SELECT file_id, n_comments, n_markers, {score('marker_phrases')} FROM stats
    WHERE n_comments > 0""", "stats")
add("readme_comments", f"SELECT {ISSUE} FROM a_readme", "a_readme")
add("readme_comment_score",
    f"""SELECT file_id, n_comments, n_readme, {score('readme_comments')} FROM stats
    WHERE n_comments > 0""", "stats")
add("error_boilerplate",
    f"""SELECT file_id, n_blocks, n_top_block, {score('error_boilerplate')} FROM stats
    WHERE n_blocks > 0""", "stats")
add("ai_signals",
    "SELECT file_id, " + ", ".join(f"{r6(n)} AS {n}" for n in fv.SIGNAL_WEIGHTS)
    + " FROM signals", "signals")
add("ai_score", f"SELECT file_id, {r6(AI_SCORE)} AS ai_score FROM signals", "signals")

# -- joins
add("file_churn_join",
    """SELECT file_id, commit_count, last_author, last_modified, authors
    FROM files LEFT JOIN git_info USING (path)""", "files", "git_info")


def cut(x: str, over: int, keep: int) -> str:
    n = f"list_max([n for n in range(0, {keep} + 1) if strlen(substr({x}, 1, n)) <= {keep}])"
    return f"CASE WHEN strlen({x}) > {over} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"


SNIPPETS = f"""(SELECT *, {cut('shown', 70, 67)} AS snippet FROM (
    SELECT i.*, {trim(cut('line', 80, 77))} AS shown FROM security_issues i
    JOIN lines l USING (file_id, line_no)))"""
add("issue_snippets", f"SELECT file_id, line_no, rule_no, snippet FROM {SNIPPETS}",
    "security_issues", "lines")
add("function_start_lines",
    """SELECT f.file_id, l.line_no, f.name, md5(l.line) AS line_hash FROM functions f
    JOIN lines l ON l.file_id = f.file_id AND l.line_no = f.start_line""", "functions", "lines")
add("import_lookup",
    "SELECT file_id, line_no, pkg, name, body_from::INT AS body_from FROM go_imports", "go_imports")
add("generic_name_lookup",
    f"""SELECT lower(token) AS name, count(*) AS uses FROM tokens
    WHERE lower(token) IN ({names(fv.GENERIC_NAMES)}) GROUP BY 1""", "tokens")

# -- roll-ups
add("file_report",
    """SELECT file_id, path, language, line_count, round((ai_score)::DOUBLE + 1e-9, 6) AS ai_score, complexity,
    round((comment_ratio)::DOUBLE + 1e-9, 6) AS comment_ratio, issue_count, commit_count
    FROM file_report LEFT JOIN git_info USING (path)""", "file_report", "git_info")
add("project_summary",
    """SELECT files_analyzed, files_flagged, round((avg_complexity)::DOUBLE + 1e-9, 6) AS avg_complexity,
    total_issues, ai_suspected, security_issues FROM summary""", "summary")
add("severity_counts",
    """SELECT count(*) AS total, count(*) FILTER (severity = 3) AS critical,
    count(*) FILTER (severity = 2) AS error, count(*) FILTER (severity = 1) AS warning,
    count(*) FILTER (severity = 0) AS info FROM security_issues""", "security_issues")
TIER = """CASE WHEN ai_score > 35 THEN 'high' WHEN ai_score > 20 THEN 'moderate'
    WHEN ai_issues > 0 THEN 'low' ELSE 'none' END"""
add("ai_tiers", f"SELECT {TIER} AS tier, count(*) AS files FROM file_report GROUP BY 1", "file_report")
UNIFORM = """(SELECT file_id, path, n AS functions, mean_size FROM (
    SELECT *, count(*) OVER f AS n, sum(line_count) OVER f // count(*) OVER f AS mean_size
    FROM measured WINDOW f AS (PARTITION BY file_id))
    WHERE n > 3 GROUP BY ALL HAVING bool_and(abs(line_count - mean_size) <= mean_size // 2))"""
add("uniform_sizes", f"SELECT file_id, path, functions, mean_size::BIGINT AS mean_size FROM {UNIFORM}",
    "measured")
add("quality_metrics",
    """SELECT * REPLACE (round((avg_complexity)::DOUBLE + 1e-9, 6) AS avg_complexity,
    round((avg_comment_percent)::DOUBLE + 1e-9, 6) AS avg_comment_percent) FROM quality_metrics""", "quality_metrics")
add("quality_grade",
    """SELECT score, CASE WHEN score < 50 THEN 'Needs Work' WHEN score < 70 THEN 'Fair'
      WHEN score < 85 THEN 'Good' ELSE 'Excellent' END AS grade
    FROM (SELECT round((greatest(0.0::DOUBLE, 100 - 3 * long_functions - 4 * complex_functions
      - 2 * duplications - unused_imports - 2 * greatest(0, avg_complexity - 15)))::DOUBLE + 1e-9, 6) AS score
    FROM quality_metrics)""", "quality_metrics")
add("issue_breakdown",
    """SELECT label, n AS issue_count, round((n / total_quality_issues)::DOUBLE + 1e-9, 6) AS share FROM (
      SELECT total_quality_issues, unnest(['Complex Functions', 'Long Functions', 'Code Duplication',
        'Unused Imports', 'TODO Markers', 'Dead Code', 'Deep Nesting', 'Error Handling']) AS label,
        unnest([complex_functions, long_functions, duplications, unused_imports, todos, dead_code,
        deep_nesting, error_handling]) AS n FROM quality_metrics) WHERE n > 0""", "quality_metrics")
add("gate_verdict",
    """SELECT files_analyzed, total_issues, security_issues,
    CASE WHEN security_issues > 0 THEN 'FAIL' WHEN total_issues > 0 THEN 'WARN' ELSE 'PASS' END AS verdict,
    CASE WHEN security_issues > 0 THEN 2 WHEN total_issues > 0 THEN 1 ELSE 0 END AS exit_code
    FROM summary""", "summary")
add("directory_rollup",
    """SELECT directory, count(*) AS files, sum(line_count)::BIGINT AS line_count,
      sum(complexity)::BIGINT AS complexity, sum(issue_count)::BIGINT AS issue_count,
      sum(security_issues)::BIGINT AS security_issues
    FROM (SELECT *, array_to_string(parts[1:n], '/') AS directory FROM (
      SELECT *, string_split(path, '/') AS parts, unnest(range(0, len(string_split(path, '/')))) AS n
      FROM file_report)) GROUP BY directory""", "file_report")
AFTER_CHANGES = "(SELECT * REPLACE (CASE WHEN file_id % 10 = 1 THEN 'moved/' || path ELSE path END AS path) FROM {} WHERE file_id % 10 <> 0)"
add("corrected_directories",
    f"""SELECT directory, count(*)::BIGINT AS files, sum(line_count)::BIGINT AS line_count,
      sum(complexity)::BIGINT AS complexity, sum(issue_count)::BIGINT AS issue_count,
      sum(security_issues)::BIGINT AS security_issues
    FROM (SELECT *, array_to_string(parts[1:n], '/') AS directory FROM (
      SELECT *, string_split(path, '/') AS parts, unnest(range(0, len(string_split(path, '/')))) AS n
      FROM {AFTER_CHANGES.format('file_report')})) GROUP BY directory""", "file_report")
add("corrected_issues",
    f"SELECT file_id, path, category, count(*) AS issue_count FROM {AFTER_CHANGES.format('issues')} GROUP BY ALL", "issues")
add("file_churn",
    """SELECT path, count(*)::INT AS commit_count, count(DISTINCT author)::INT AS author_count,
      arg_max(author, (authored_at, commit_id)) AS last_author,
      strftime(max(authored_at), '%Y-%m-%d') AS last_modified
    FROM change_log GROUP BY path""", "change_log")
add("newest_commits_of_roots",
    f"""SELECT root, commit_id, author, path FROM ordered_log WHERE commit_id IN (
      SELECT commit_id FROM (SELECT DISTINCT root, seq, commit_id FROM ordered_log)
      QUALIFY row_number() OVER (PARTITION BY root ORDER BY seq) <= {NEWEST_OF_ROOT})""", "ordered_log")
add("file_churn_of_roots",
    """SELECT root, path, count(*)::INT AS commit_count, count(DISTINCT author)::INT AS author_count,
      arg_min(author, seq) AS last_author, strftime(max(authored_at), '%Y-%m-%d') AS last_modified
    FROM ordered_log GROUP BY root, path""", "ordered_log")
add("file_authors_of_roots",
    """SELECT root, path, row_number() OVER (PARTITION BY root, path ORDER BY first_seq)::INT AS author_no, author
    FROM (SELECT root, path, author, min(seq) AS first_seq FROM ordered_log GROUP BY ALL)""", "ordered_log")
add("file_authors",
    """SELECT path, row_number() OVER (PARTITION BY path ORDER BY first_seq)::INT AS author_no, author
    FROM (SELECT path, author, min(seq) AS first_seq FROM history GROUP BY ALL)""", "history")
add("author_activity",
    """SELECT path, author, count(*) AS commits, arg_max(commit_id, (authored_at, commit_id)) AS newest_commit
    FROM change_log GROUP BY ALL""", "change_log")
add("issue_counts",
    """SELECT file_id, path, type, severity, category, count(*) AS issue_count FROM issues
    GROUP BY ALL""", "issues")

# -- order
add("tree_order",
    f"""SELECT DISTINCT array_to_string(parts[1:n-1], '/') AS parent, parts[n] AS name,
      n < len(parts) AS is_dir, (n - 1)::INT AS depth FROM (
      SELECT string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')) + 1)) AS n
      FROM raw_files WHERE NOT {PRUNED})""", "raw_files")
add("high_churn",
    f"""SELECT path, count(*) AS commit_count FROM change_log GROUP BY path
    ORDER BY commit_count DESC, path LIMIT {TOP_CHURN}""", "change_log")
add("issue_order",
    f"SELECT {ISSUE} FROM issues ORDER BY path, pass_no, check_no, ord, rule_no", "issues")
add("issues_by_severity",
    f"""SELECT path, line_no, {case_of('severity', fv.SEVERITY_NAMES)} AS severity_name,
    {case_of('severity', fv.SEVERITY_LABELS)} AS severity_label,
    {case_of('category', fv.CATEGORY_NAMES)} AS category_name, type FROM issues
    ORDER BY severity DESC, path, pass_no, check_no, ord, rule_no""", "issues")
add("all_issues", f"SELECT {ISSUE} FROM issues", "issues")

# -- views
add("security_view",
    f"""SELECT path, line_no, {case_of('severity', fv.SEVERITY_LABELS)} AS label, type, snippet,
    message, fix, pass_no, check_no, ord, rule_no FROM {SNIPPETS}""", "security_issues", "lines")
add("ai_view",
    f"""SELECT path, tier, printf('%.0f%%', ai_score) AS score, coalesce(reason, '') AS reason,
      pass_no FROM (SELECT file_id, path, ai_score, {TIER} AS tier FROM file_report)
    LEFT JOIN (SELECT file_id, message AS reason, 1 AS pass_no FROM ai_issues UNION ALL
      SELECT file_id, 'Functions uniformly sized (~' || mean_size || ' lines) — typical AI pattern', 9
      FROM {UNIFORM}) USING (file_id)
    WHERE tier IN ('high', 'moderate')""", "file_report", "ai_issues", "measured")
add("quality_view",
    f"""SELECT path, line_no, {case_of('severity', fv.SEVERITY_LABELS)} AS label, message, fix,
    pass_no, check_no, ord, rule_no FROM quality_issues""", "quality_issues")
