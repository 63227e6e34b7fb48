"""Table expressions of the oracle: corpus, lines, functions, findings, signals."""

from __future__ import annotations

from codestrata import fixed_values as fv
from codestrata.functions.text import WHITE_SPACE
from codestrata.sources import derived
from oracle.base import define, has, hits, names, occurrences, part, q, starts

NL = "chr(10)"
WS = q(WHITE_SPACE)


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


# -- corpus ----------------------------------------------------------------

size = derived.WORDS_PER_CHUNK
define("templates", "SELECT [" + names(derived.TEMPLATES) + "] AS t")
define(
    "chunks",
    f"""SELECT doc_id, i, array_to_string(w[i*{size}+1 : i*{size}+{size}], ' ') AS t
    FROM (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // {size} + 1)) AS i
          FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))""",
)


def corpus_path(key: str) -> str:
    def pick(values) -> str:
        return f"(list_value({names(values)}))[({key} % {len(values)}) + 1]"

    return (
        f"{pick(derived.DIRECTORIES)} || CASE WHEN {key} % 29 = 0 THEN '.f' ELSE 'f' END"
        f" || {key} || {pick(derived.EXTENSIONS)}"
    )


def hex_number(first: int, digits: int) -> str:
    return f"('0x' || substr(h, {first}, {digits}))::INT"


line = f"(SELECT t FROM templates)[{hex_number(1, 6)} % {len(derived.TEMPLATES)} + 1]"
for mark, value in (
    ("@H@", "h"), ("@U@", "upper(substr(h, 1, 16))"), ("@N@", f"{hex_number(7, 3)}::VARCHAR"),
    ("@W@", "'v' || substr(h, 11, 5)"), ("@T@", "t"),
):
    line = f"replace({line}, '{mark}', {value})"
define(
    "raw_files",
    f"""SELECT doc_id AS file_id, {corpus_path('doc_id')} AS path,
        string_agg({line}, {NL} ORDER BY i) AS content
    FROM (SELECT *, md5(t) AS h FROM chunks) GROUP BY doc_id""",
    "templates", "chunks",
)
define(
    "languages",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({q(e)}, {q(n)})" for e, n in fv.LANGUAGE_BY_EXTENSION.items())
    + ") v(ext, language)",
)
define(
    "tagged",
    r"""SELECT r.*, l.language FROM (SELECT *, regexp_extract(path, '(\.[^./]*)$', 1) AS ext
    FROM raw_files) r LEFT JOIN languages l USING (ext)""",
    "raw_files", "languages",
)
PRUNED = (
    "(len(list_filter(string_split(path, '/')[1 : len(string_split(path, '/')) - 1],"
    f" lambda p: p IN ({names(fv.IGNORED_DIRECTORIES)}))) > 0"
    " OR len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.'))) > 0)"
)
define(
    "files",
    f"""SELECT file_id, path, language, content FROM tagged
    WHERE language IS NOT NULL AND NOT {PRUNED}""",
    "tagged",
)
define(
    "lines",
    f"""SELECT *, {trim('line')} AS trimmed FROM (
      SELECT file_id, path, language, len(l)::INT AS n_lines,
        unnest(range(1, len(l) + 1))::INT AS line_no, unnest(l) AS line
      FROM (SELECT *, string_split(content, {NL}) AS l FROM files))""",
    "files",
)
leading = "regexp_extract(line, '^[ \\t]*')"
INDENT = f"(length({leading}) + 3 * {occurrences(leading, chr(9))})"
COMMENT = starts("trimmed", fv.COMMENT_PREFIXES)
COMMENT_TEXT = "CASE " + " ".join(
    f"WHEN starts_with(trimmed, {q(p)}) THEN {trim(f'substr(trimmed, {len(p) + 1})')}"
    for p in fv.COMMENT_TEXT_PREFIXES
) + " ELSE trimmed END"
define(
    "described",
    f"""SELECT *, strlen(line) AS byte_len, strlen(trimmed) AS trimmed_bytes, {INDENT} AS indent,
        trimmed = '' AS is_blank, {COMMENT} AS is_comment FROM lines""",
    "lines",
)
ELIGIBLE = (
    f"trimmed <> '' AND NOT {has('line', fv.SECURITY_COMMENT_PATTERN)}"
    f" AND NOT {has('line', fv.DEFINITION_LINE_PATTERN)}"
)
define("eligible", f"SELECT * FROM lines WHERE {ELIGIBLE}", "lines")

# -- security --------------------------------------------------------------

ENTROPY = (
    "round(list_sum(list_transform(list_distinct(regexp_extract_all(value, '(?s).')), lambda c:"
    " -((strlen(value) - strlen(replace(value, c, ''))) / strlen(c) / strlen(value))"
    " * log2((strlen(value) - strlen(replace(value, c, ''))) / strlen(c) / strlen(value)))), 9)"
)


def _rule(n: int, r: fv.Rule) -> str:
    value = "NULL"
    if r.entropy_groups:
        value = "CASE " + " ".join(
            f"WHEN strlen({part('line', r.pattern, g)}) > 4 THEN {part('line', r.pattern, g)}"
            for g in range(r.entropy_groups, 0, -1)
        ) + f" ELSE {part('line', r.pattern, 0)} END"
    return (
        f"SELECT file_id, path, line_no, {n} AS rule_no, {value} AS value"
        f" FROM eligible WHERE {has('line', r.pattern)}"
    )


define(
    "rule_matches",
    "\nUNION ALL ".join(_rule(n, r) for n, r in enumerate(fv.SECURITY_RULES, start=1)),
    "eligible",
)
define(
    "rule_values",
    f"SELECT *, CASE WHEN value IS NOT NULL THEN {ENTROPY} END AS entropy FROM rule_matches",
    "rule_matches",
)
define(
    "rules",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({n}, {q(r.type)}, {r.severity}, {q(r.message)}, {q(r.fix)})"
        for n, r in enumerate(fv.SECURITY_RULES, start=1))
    + ") v(rule_no, type, severity, message, fix)",
)
ISSUE = "file_id, path, line_no, type, severity, category, message, fix, pass_no, check_no, ord, rule_no"
define(
    "security_issues",
    f"""SELECT file_id, path, line_no::INT AS line_no, type, severity::INT AS severity,
        0 AS category, message, fix, 2 AS pass_no, 1 AS check_no, line_no::BIGINT AS ord,
        rule_no::INT AS rule_no
    FROM rule_values JOIN rules USING (rule_no)
    WHERE entropy IS NULL OR entropy >= {fv.MIN_SECRET_ENTROPY}""",
    "rule_values", "rules",
)

# -- complexity ------------------------------------------------------------

define(
    "keywords",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({q(lang)}, [{names(words)}])" for lang, words in fv.BRANCH_KEYWORDS.items())
    + ") v(language, words)",
)
fallback = f"[{names(fv.BRANCH_KEYWORDS[fv.FALLBACK_KEYWORD_LANGUAGE])}]"
define(
    "branches",
    f"""SELECT lines.*, (len(list_filter(coalesce(words, {fallback}), lambda k: contains(trimmed, k)))
        + {occurrences('trimmed', '&&')} + {occurrences('trimmed', '||')})::INT AS branches,
        {occurrences('trimmed', '{')} - {occurrences('trimmed', '}')} AS braces
    FROM lines LEFT JOIN keywords USING (language)""",
    "lines", "keywords",
)
name_cases = " ".join(
    f"WHEN language = {q(lang)} AND {has('trimmed', pattern)} THEN coalesce("
    + ", ".join(f"nullif({part('trimmed', pattern, g)}, '')" for g in groups) + ")"
    for lang, (pattern, groups) in fv.FUNCTION_PATTERNS.items()
)
define(
    "starts",
    f"""SELECT *, sum(braces) OVER f AS depth,
        CASE {name_cases} END AS started
    FROM branches WINDOW f AS (PARTITION BY file_id ORDER BY line_no)""",
    "branches",
)
define(
    "spans",
    """SELECT file_id, path, language, started AS name, line_no AS start_line,
        depth - braces AS depth_before,
        coalesce(lead(line_no) OVER (PARTITION BY file_id ORDER BY line_no) - 1, n_lines) AS last_line
    FROM starts WHERE started IS NOT NULL""",
    "starts",
)
define(
    "closes",
    """SELECT s.file_id, s.start_line, min(l.line_no) AS close_line
    FROM spans s JOIN starts l ON l.file_id = s.file_id
      AND l.line_no BETWEEN s.start_line AND s.last_line AND l.depth <= s.depth_before
    WHERE (s.language IN ('Python', 'Ruby') AND l.trimmed <> '' AND l.line_no > s.start_line + 1
           AND l.line[1] <> ' ' AND l.line[1] <> chr(9))
       OR (s.language = 'Lua' AND l.trimmed = 'end' AND l.line_no > s.start_line)
    GROUP BY ALL""",
    "spans", "starts",
)
define(
    "functions",
    """SELECT s.file_id, s.path, s.name, s.start_line::INT AS start_line,
        any_value(coalesce(close_line - CASE WHEN s.language = 'Lua' THEN 0 ELSE 1 END, last_line))::INT
          AS end_line,
        (1 + sum(l.branches))::INT AS complexity
    FROM spans s LEFT JOIN closes c USING (file_id, start_line)
    JOIN starts l ON l.file_id = s.file_id
      AND l.line_no BETWEEN s.start_line AND coalesce(close_line, last_line)
    GROUP BY ALL""",
    "spans", "closes", "starts",
)
define(
    "measured",
    "SELECT *, (end_line - start_line + 1)::INT AS line_count FROM functions",
    "functions",
)

# -- quality ---------------------------------------------------------------


def quality(type_sql, severity, message, fix, check, source, *, line="line_no", ord=None, rule="0"):
    return f"""SELECT file_id, path, ({line})::INT AS line_no, {type_sql} AS type,
      ({severity})::INT AS severity, 1 AS category, {message} AS message, {fix} AS fix,
      3 AS pass_no, {check} AS check_no, ({ord or line})::BIGINT AS ord, ({rule})::INT AS rule_no
    FROM {source}"""


cx = f"complexity >= {fv.COMPLEXITY_CRITICAL}"
define(
    "q_complexity",
    quality(
        f"CASE WHEN {cx} THEN 'high_complexity' ELSE 'moderate_complexity' END",
        f"CASE WHEN {cx} THEN 2 ELSE 1 END",
        f"""'Function ''' || name || ''' has cyclomatic complexity ' || complexity ||
        CASE WHEN {cx} THEN ' (critical threshold: 20)' ELSE ' (warning threshold: 10)' END""",
        f"""CASE WHEN {cx} THEN 'Break this function into smaller, focused functions. Extract conditional logic into helper functions.'
        ELSE 'Consider refactoring — extract branches into helper functions or use early returns.' END""",
        1, f"measured WHERE complexity >= {fv.COMPLEXITY_WARNING}", line="start_line",
    ),
    "measured",
)
god = f"line_count > {fv.GOD_FUNCTION_LINES} AND complexity > {fv.GOD_FUNCTION_COMPLEXITY}"
define(
    "q_length",
    quality(
        f"CASE WHEN {god} THEN 'god_function' ELSE 'long_function' END",
        f"CASE WHEN {god} THEN 2 ELSE 1 END",
        f"""CASE WHEN {god} THEN 'God function ''' || name || ''' — ' || line_count || ' lines with complexity ' || complexity
        ELSE 'Function ''' || name || ''' is ' || line_count || ' lines (recommended max: 50)' END""",
        f"""CASE WHEN {god} THEN 'This function does too much. Split into focused functions with single responsibilities.'
        ELSE 'Break into smaller functions. Functions should ideally fit on one screen.' END""",
        2, f"measured WHERE line_count > {fv.MAX_FUNCTION_LINES}", line="start_line",
    ),
    "measured",
)
define(
    "q_long_file",
    quality(
        "'long_file'", 0, "'File is ' || n || ' lines (recommended max: 500)'",
        "'Split into multiple files by responsibility. Group related functions together.'", 3,
        "(SELECT file_id, path, 1 AS line_no, max(line_no) AS n FROM lines GROUP BY ALL)"
        f" WHERE n > {fv.MAX_FILE_LINES}",
    ),
    "lines",
)
define(
    "q_nesting",
    quality(
        "'deep_nesting'", 1,
        "'Code nested ' || level || ' levels deep (max recommended: 4)'",
        "'Use early returns (guard clauses) to reduce nesting. Extract nested logic into helper functions.'",
        4,
        "(SELECT file_id, path, indent // 4 AS level, min(line_no) AS line_no FROM described"
        f" WHERE indent // 4 > {fv.MAX_NESTING} GROUP BY ALL)",
    ),
    "described",
)
params = part("line", fv.PARAMETER_LIST_PATTERN, 1)
define(
    "q_parameters",
    quality(
        "'long_param_list'", 1,
        "'Function ''' || name || ''' has ' || n || ' parameters (max recommended: 5)'",
        "'Group related parameters into a struct/object. Consider using options pattern or builder.'",
        5,
        f"""(SELECT f.file_id, f.path, f.name, l.line_no, len(list_filter(string_split({params}, ','),
            lambda p: {trim('p')} <> '')) AS n
          FROM functions f JOIN lines l ON l.file_id = f.file_id AND l.line_no = f.start_line)
        WHERE n > {fv.MAX_PARAMETERS}""",
    ),
    "functions", "lines",
)
define(
    "followed",
    """SELECT *, lead(trimmed) OVER f AS next_trimmed,
        lead(CASE WHEN trimmed <> '' THEN line_no END IGNORE NULLS) OVER f AS next_no,
        lead(CASE WHEN trimmed <> '' THEN trimmed END IGNORE NULLS) OVER f AS next_filled
    FROM lines WINDOW f AS (PARTITION BY file_id ORDER BY line_no)""",
    "lines",
)
define(
    "closing",
    f"""SELECT file_id, line_no, sum({occurrences('line', '}')} - {occurrences('line', '{')})
        OVER (PARTITION BY file_id ORDER BY line_no) AS closed,
        {occurrences('line', '}')} - {occurrences('line', '{')} AS own,
        {has('line', fv.CLOSURE_PATTERN)} AND (NOT starts_with(trimmed, 'func ')
          OR contains(trimmed, '= func(') OR contains(trimmed, '(func(')) AS candidate
    FROM lines""",
    "lines",
)
define(
    "closures",
    """SELECT i.file_id, i.line_no, bool_or(i.closed - (k.closed - k.own) <= 0) AS in_closure
    FROM closing i JOIN closing k ON k.file_id = i.file_id AND k.candidate AND k.line_no <= i.line_no
    GROUP BY ALL""",
    "closing",
)
define(
    "q_dead_code",
    quality(
        "'dead_code'", 1, "'Unreachable code after ' || trimmed",
        "'Remove this unreachable code or restructure the control flow.'", 6,
        f"""followed LEFT JOIN closures USING (file_id, line_no)
        WHERE {has('trimmed', fv.JUMP_PATTERN)} AND next_no IS NOT NULL
          AND NOT coalesce(in_closure, false) AND next_filled NOT IN ({names(fv.LONE_CLOSERS)})
          AND NOT starts_with(next_filled, 'case ') AND NOT starts_with(next_filled, 'default:')""",
        line="next_no", ord="line_no",
    ),
    "followed", "closures",
)
define(
    "q_empty_handler",
    quality(
        "'empty_error_handler'", 2, "'Empty ' || kind || ' — errors silently swallowed'",
        "'At minimum, log the error. Consider returning it or wrapping with context.'", 7,
        """(SELECT *, CASE
            WHEN contains(trimmed, 'catch') AND suffix(trimmed, '{')
              THEN CASE WHEN next_filled = '}' THEN 'catch block' END
            WHEN contains(trimmed, 'except') AND suffix(trimmed, ':')
              THEN CASE WHEN next_trimmed IN ('pass', '') THEN 'except block' END
            WHEN language = 'Go' AND contains(trimmed, 'if err != nil') AND suffix(trimmed, '{')
              THEN CASE WHEN next_filled = '}' THEN 'error handler' END
          END AS kind FROM followed WHERE next_trimmed IS NOT NULL) WHERE kind IS NOT NULL""",
    ),
    "followed",
)
define(
    "q_swallowing",
    quality(
        "'error_swallowing'", 1, "'Return value discarded with _ — possible error swallowing'",
        "'Handle the error: check it, wrap it, or explicitly document why it''s safe to ignore.'", 8,
        f"lines WHERE language = 'Go' AND {has('line', fv.SWALLOW_PATTERN)}"
        f" AND NOT {has('line', fv.SWALLOW_ALLOWED_PATTERN)}",
    ),
    "lines",
)
ticks = occurrences("line", "`")
define(
    "numbers",
    f"""SELECT * FROM (SELECT file_id, path, line_no, unnest(m) AS token,
          unnest(range(len(m)))::INT AS pos
        FROM (SELECT *, {hits('line', fv.MAGIC_NUMBER_PATTERN, 1)} AS m FROM lines
          WHERE NOT {has('trimmed', fv.CONSTANT_LINE_PATTERN)}
            AND NOT {starts('trimmed', ('//', '#', 'import'))}
            AND NOT {has('line', fv.HEX_COLOUR_PATTERN)}
            AND NOT ({ticks} > 0 AND {ticks} % 2 = 0)))
    WHERE token NOT IN ({names(fv.ALLOWED_NUMBERS)})""",
    "lines",
)
define(
    "q_magic",
    quality(
        "'magic_number'", 0, "'Magic number ' || token || ' — consider defining as a named constant'",
        "'Extract to a named constant for readability: const someName = ' || token", 9,
        """(SELECT *, row_number() OVER (PARTITION BY file_id, token ORDER BY line_no, pos) AS nth
        FROM numbers) WHERE nth = 1""",
        rule="pos",
    ),
    "numbers",
)
define(
    "name_counts",
    f"""SELECT file_id, path, sum(len({hits('line', fv.CAMEL_PATTERN)}))::BIGINT AS camel,
        sum(len({hits('line', fv.SNAKE_PATTERN)}))::BIGINT AS snake,
        min(line_no) FILTER ({has('line', fv.CAMEL_PATTERN)}) AS first_camel,
        min(line_no) FILTER ({has('line', fv.SNAKE_SEARCH_PATTERN)}) AS first_snake
    FROM lines WHERE language NOT IN ({names(fv.MIXED_NAMING_LANGUAGES)}) GROUP BY ALL""",
    "lines",
)
define(
    "q_naming",
    quality(
        "'naming_inconsistency'", 0,
        """CASE WHEN snake < camel
        THEN 'Mixed naming conventions — file uses mostly camelCase but also contains snake_case'
        ELSE 'Mixed naming conventions — file uses mostly snake_case but also contains camelCase' END""",
        "'Pick one convention and use it consistently throughout the file.'", 10,
        f"""(SELECT *, CASE WHEN snake < camel THEN first_snake ELSE first_camel END AS line_no
          FROM name_counts WHERE camel + snake >= {fv.MIN_NAMES}
            AND least(camel, snake) / (camel + snake) > {fv.MAX_MINORITY_SHARE})
        WHERE line_no IS NOT NULL""",
    ),
    "name_counts",
)
define(
    "import_lines",
    f"""SELECT file_id, path, line_no, pkg, single,
        CASE WHEN NOT single AND alias <> '' THEN alias ELSE string_split(pkg, '/')[-1] END AS name,
        CASE WHEN single THEN line_no + 1 ELSE opened + {fv.IMPORT_BODY_OFFSET} END AS body_from
    FROM (SELECT *, CASE WHEN single THEN {part('trimmed', fv.SINGLE_IMPORT_PATTERN, 1)}
          WHEN opened IS NULL OR coalesce(shut, 0) > opened THEN ''
          WHEN alias <> '' THEN {part('line', fv.IMPORT_ALIAS_PATTERN, 2)}
          ELSE {part('line', fv.IMPORT_PATTERN, 1)} END AS pkg
        FROM (SELECT *, starts_with(trimmed, 'import "') AS single,
            {part('line', fv.IMPORT_ALIAS_PATTERN, 1)} AS alias,
            max(CASE WHEN trimmed = 'import (' THEN line_no END) OVER f AS opened,
            max(CASE WHEN trimmed = ')' THEN line_no END) OVER f AS shut
          FROM lines WHERE language = 'Go'
          WINDOW f AS (PARTITION BY file_id ORDER BY line_no
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        WHERE trimmed NOT IN ('import (', ')'))
    WHERE pkg <> ''""",
    "lines",
)
define(
    "go_imports",
    """SELECT * FROM import_lines WHERE CASE WHEN single THEN NOT starts_with(name, '_')
       ELSE name NOT IN ('_', '.') END""",
    "import_lines",
)
define(
    "q_imports",
    quality(
        "'unused_import'", 1, "'Import ''' || pkg || ''' may be unused'",
        "'Remove unused imports to keep code clean.'", 11,
        """go_imports i WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.file_id = i.file_id
          AND l.line_no >= i.body_from AND contains(l.line, i.name || '.'))""",
    ),
    "go_imports", "lines",
)
define(
    "q_todo",
    quality(
        "'todo_marker'", 0,
        f"upper({part('line', fv.TODO_PATTERN, 1)}) || ': ' || {trim(part('line', fv.TODO_PATTERN, 2))}",
        "'Resolve this TODO before merging to main branch.'", 12,
        f"lines WHERE {has('line', fv.TODO_PATTERN)}",
    ),
    "lines",
)
define(
    "blocks",
    f"""SELECT file_id, path, line_no, first_value(line_no) OVER (
          PARTITION BY file_id, block ORDER BY line_no) AS first_line
    FROM (SELECT *, array_to_string(list(trimmed) OVER (PARTITION BY file_id ORDER BY line_no
            ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), {NL}) AS block FROM lines)
    WHERE n_lines >= 12 AND line_no <= n_lines - 5 AND replace(block, {NL}, '') <> ''""",
    "lines",
)
define(
    "q_duplication",
    quality(
        "'code_duplication'", 0,
        "'Duplicate code block (also at line ' || first_line || ')'",
        "'Extract duplicated code into a shared function.'", 13,
        "blocks WHERE line_no > first_line",
    ),
    "blocks",
)
QUALITY_CHECKS = (
    "q_complexity", "q_length", "q_long_file", "q_nesting", "q_parameters", "q_dead_code",
    "q_empty_handler", "q_swallowing", "q_magic", "q_naming", "q_imports", "q_todo",
    "q_duplication",
)
define(
    "quality_issues",
    " UNION ALL ".join(f"SELECT {ISSUE} FROM {c}" for c in QUALITY_CHECKS),
    *QUALITY_CHECKS,
)

# -- signals ---------------------------------------------------------------

define(
    "tokens",
    f"""SELECT file_id, unnest(m) AS token, unnest(range(len(m)))::INT AS pos
    FROM (SELECT file_id, {hits('content', fv.IDENTIFIER_PATTERN)} AS m FROM files)""",
    "files",
)
define(
    "token_stats",
    """SELECT file_id, count(*) AS n_tokens, count(DISTINCT lower(token)) AS n_distinct,
        count(*) FILTER (strlen(token) >= 3 AND contains(token, '_') AND token <> upper(token))
          AS n_snake,
        count(*) FILTER (strlen(token) >= 3 AND NOT contains(token, '_')
          AND token <> upper(token) AND token <> lower(token)) AS n_camel
    FROM tokens GROUP BY file_id""",
    "tokens",
)
define(
    "generic_names",
    f"""SELECT t.file_id, t.name, l.path, min(l.line_no)::INT AS line_no, any_value(l.n_lines) AS n_lines,
        t.nth
    FROM (SELECT file_id, name, row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS nth
          FROM (SELECT file_id, arg_min(token, pos) AS name, min(pos) AS pos FROM tokens
                WHERE lower(token) IN ({names(fv.GENERIC_NAMES)}) GROUP BY file_id, lower(token))) t
    JOIN lines l ON l.file_id = t.file_id AND contains(l.line, t.name)
    GROUP BY ALL""",
    "tokens", "lines",
)


def ai(type_, message, check, source, ord="line_no"):
    return f"""SELECT file_id, path, line_no, {q(type_)} AS type, 0 AS severity, 2 AS category,
      {message} AS message, '' AS fix, 1 AS pass_no, {check} AS check_no, ({ord})::BIGINT AS ord,
      0 AS rule_no FROM {source}"""


define(
    "a_generic",
    ai("generic_naming", "'Generic identifier ''' || name || ''' — common in AI-generated code'",
       1, f"generic_names WHERE n_lines >= {fv.MIN_AI_LINES}", "nth"),
    "generic_names",
)


def first_of(patterns) -> str:
    return "CASE WHEN strlen(c) < 5 THEN NULL " + " ".join(
        f"WHEN {has('c', p)} THEN {n}" for n, p in enumerate(patterns, start=1)) + " END"


define(
    "comments",
    f"""SELECT *, {first_of([p for p, _ in fv.MARKER_PHRASES])} AS marker_no,
        {first_of(fv.README_PHRASES)} AS readme_no
    FROM (SELECT *, {COMMENT_TEXT} AS c FROM described WHERE is_comment)""",
    "described",
)
define(
    "a_marker",
    ai("ai_marker_phrase", f"[{names([m for _, m in fv.MARKER_PHRASES])}][marker_no]", 2,
       f"comments WHERE marker_no IS NOT NULL AND n_lines >= {fv.MIN_AI_LINES}"),
    "comments",
)
define(
    "a_readme",
    ai("readme_comment", q(fv.README_MESSAGE), 3,
       f"comments WHERE readme_no IS NOT NULL AND n_lines >= {fv.MIN_AI_LINES}"),
    "comments",
)
define(
    "ai_issues",
    " UNION ALL ".join(f"SELECT {ISSUE} FROM {c}" for c in ("a_generic", "a_marker", "a_readme")),
    "a_generic", "a_marker", "a_readme",
)
define(
    "issues",
    " UNION ALL ".join(
        f"SELECT {ISSUE} FROM {c}" for c in ("ai_issues", "security_issues", "quality_issues")),
    "ai_issues", "security_issues", "quality_issues",
)
calls = [
    (lang, n, p) for lang, patterns in fv.REPEATED_CALL_PATTERNS.items()
    for n, p in enumerate(patterns)
]
call_counts = ", ".join(
    f"count(*) FILTER (language = {q(lang)} AND {has('line', p)}) AS c_{lang}_{n}"
    for lang, n, p in calls)
call_sum = " + ".join(
    f"CASE WHEN c_{lang}_{n} >= {fv.MIN_REPEATS} THEN c_{lang}_{n} ELSE 0 END"
    for lang, n, _ in calls)
define(
    "filled",
    """SELECT *, lag(is_comment) OVER (PARTITION BY file_id ORDER BY line_no) AS after_comment,
        avg(trimmed_bytes) OVER (PARTITION BY file_id) AS mean_bytes,
        stddev_pop(trimmed_bytes) OVER (PARTITION BY file_id) AS sd_bytes
    FROM described WHERE NOT is_blank""",
    "described",
)
define(
    "line_stats",
    f"""SELECT *, {call_sum} AS n_calls FROM (SELECT file_id, count(*) AS n_filled,
        count(*) FILTER (is_comment) AS n_comment_lines, count(*) FILTER (NOT is_comment) AS n_code,
        count(*) FILTER (indent % 2 = 0) AS n_even, var_pop(byte_len) AS length_variance,
        min(trimmed_bytes) = max(trimmed_bytes) AS same_length,
        abs(avg(pow((trimmed_bytes - mean_bytes) / nullif(sd_bytes, 0), 3))) AS skew,
        count(*) FILTER ({has('line', fv.SECTION_HEADER_PATTERN)}) AS n_sections,
        count(*) FILTER (NOT is_comment AND after_comment) AS n_transitions, {call_counts}
    FROM filled GROUP BY file_id)""",
    "filled",
)
define(
    "comment_stats",
    """SELECT file_id, count(*) AS n_comments, count(marker_no) AS n_markers,
        count(readme_no) AS n_readme FROM comments GROUP BY file_id""",
    "comments",
)
define(
    "size_stats",
    """SELECT file_id, count(*) AS n_functions,
        count(*) * sum(line_count::BIGINT * line_count) - sum(line_count) * sum(line_count) AS spread
    FROM measured GROUP BY file_id""",
    "measured",
)
block_hit = " OR ".join(
    f"(language = {q(lang)} AND {has('line', p)})" for lang, p in fv.ERROR_BLOCK_PATTERNS.items())
define(
    "error_blocks",
    f"""SELECT file_id, block FROM (SELECT file_id, language, line, line || coalesce({NL} || lead(trimmed, 1) OVER f, '')
        || coalesce({NL} || lead(trimmed, 2) OVER f, '') || coalesce({NL} || lead(trimmed, 3) OVER f, '')
        AS block FROM lines WINDOW f AS (PARTITION BY file_id ORDER BY line_no)) WHERE {block_hit}""",
    "lines",
)
define(
    "block_stats",
    """SELECT file_id, sum(n)::BIGINT AS n_blocks, max(n) AS n_top_block
    FROM (SELECT file_id, block, count(*) AS n FROM error_blocks GROUP BY ALL) GROUP BY file_id""",
    "error_blocks",
)
define(
    "shapes",
    f"""SELECT file_id, regexp_replace(regexp_replace(trimmed, '"[^"]*"', '""', 'g'),
        '''[^'']*''', '''''', 'g') AS shape FROM lines WHERE strlen(trimmed) >= {fv.MIN_SHAPE_BYTES}""",
    "lines",
)
define(
    "shape_stats",
    f"""SELECT file_id, sum(n)::BIGINT AS n_repeated FROM (SELECT file_id, shape, count(*) AS n
      FROM shapes GROUP BY ALL HAVING count(*) >= {fv.MIN_REPEATS}) GROUP BY file_id""",
    "shapes",
)
define(
    "stats",
    """SELECT f.file_id, f.path, f.language, n.n_lines, t.* EXCLUDE (file_id),
        l.* EXCLUDE (file_id), c.* EXCLUDE (file_id), s.* EXCLUDE (file_id),
        b.* EXCLUDE (file_id), h.* EXCLUDE (file_id)
    FROM files f
    JOIN (SELECT file_id, max(line_no) AS n_lines FROM lines GROUP BY file_id) n USING (file_id)
    LEFT JOIN token_stats t USING (file_id) LEFT JOIN line_stats l USING (file_id)
    LEFT JOIN comment_stats c USING (file_id) LEFT JOIN size_stats s USING (file_id)
    LEFT JOIN block_stats b USING (file_id) LEFT JOIN shape_stats h USING (file_id)""",
    "files", "lines", "token_stats", "line_stats", "comment_stats", "size_stats", "block_stats",
    "shape_stats",
)


def steps(value: str, *pairs, otherwise="0.0") -> str:
    return "CASE " + " ".join(f"WHEN {value} > {a} THEN {s}" for a, s in pairs) + f" ELSE {otherwise} END"


generic_repetition = (
    "CASE WHEN coalesce(n_repeated, 0) = 0 THEN 0.0 ELSE "
    + steps("n_repeated / n_lines", (0.15, 0.8), (0.08, 0.5), otherwise="0.2") + " END"
)
GENERIC_REPETITION = generic_repetition
SIGNALS = {
    "token_diversity": """CASE WHEN coalesce(n_tokens, 0) = 0 OR n_distinct / n_tokens > 0.6 THEN 0.0
        WHEN n_distinct / n_tokens < 0.2 THEN 1.0 ELSE 1.0 - (n_distinct / n_tokens) / 0.6 END""",
    "formatting": """CASE WHEN n_lines < 10 OR coalesce(n_filled, 0) = 0 THEN 0.0 ELSE
        (CASE WHEN n_even / n_filled > 0.95 THEN 1.0 ELSE 0.0 END) * 0.5
        + (CASE WHEN length_variance < 100 THEN 1.0 - length_variance / 100 ELSE 0.0 END) * 0.5 END""",
    "generic_naming": "CASE WHEN file_id IN (SELECT file_id FROM generic_names) THEN 1.0 ELSE 0.0 END",
    "comment_quality": "CASE WHEN coalesce(n_code, 0) = 0 THEN 0.0 ELSE "
        + steps("n_comment_lines / n_code", (0.5, 0.9), (0.3, 0.6), (0.2, 0.3)) + " END",
    "function_uniformity": """CASE WHEN coalesce(n_functions, 0) < 3 THEN 0.0
        WHEN spread < 10 * n_functions * n_functions THEN 0.8
        WHEN spread < 25 * n_functions * n_functions THEN 0.4 ELSE 0.0 END""",
    "marker_phrases": "CASE WHEN coalesce(n_comments, 0) < 3 THEN 0.0 ELSE "
        + steps("n_markers / n_comments", (0.15, 1.0), (0.08, 0.7), (0.03, 0.4),
                otherwise="CASE WHEN n_markers > 0 THEN 0.2 ELSE 0.0 END") + " END",
    "error_boilerplate": "CASE WHEN coalesce(n_blocks, 0) < 3 THEN 0.0 ELSE "
        + steps("n_top_block / n_blocks", (0.7, 0.9), (0.5, 0.5)) + " END",
    "naming_entropy": """CASE WHEN coalesce(n_tokens, 0) < 10 OR n_camel + n_snake < 5 THEN 0.0 ELSE """
        + steps("greatest(n_camel, n_snake) / (n_camel + n_snake)", (0.95, 0.6), (0.85, 0.3)) + " END",
    "structural_pattern": """greatest(CASE WHEN n_sections >= 3 THEN 0.9 WHEN n_sections >= 2 THEN 0.6
        ELSE 0.0 END, CASE WHEN n_code > 5 AND n_transitions / n_code > 0.4
        THEN least(1.0, n_transitions / n_code) ELSE 0.0 END)""",
    "line_length_dist": """CASE WHEN coalesce(n_filled, 0) < 20 THEN 0.0 WHEN same_length THEN 0.8
        WHEN skew < 0.3 THEN 0.7 WHEN skew < 0.7 THEN 0.3 ELSE 0.0 END""",
    "readme_comments": "CASE WHEN coalesce(n_comments, 0) < 2 THEN 0.0 ELSE "
        + steps("n_readme / n_comments", (0.2, 1.0), (0.1, 0.6),
                otherwise="CASE WHEN n_readme > 0 THEN 0.3 ELSE 0.0 END") + " END",
    "repetitive_structure": f"CASE WHEN coalesce(n_calls, 0) = 0 THEN {generic_repetition} ELSE "
        + steps("n_calls / n_lines", (0.15, 1.0), (0.08, 0.7), (0.04, 0.4)) + " END",
}
define(
    "signals",
    "SELECT file_id, path, language, n_lines, "
    + ", ".join(
        f"CASE WHEN n_lines < {fv.MIN_AI_LINES} THEN 0.0::DOUBLE ELSE ({sql})::DOUBLE END AS {name}"
        for name, sql in SIGNALS.items())
    + """, CASE WHEN coalesce(n_code, 0) = 0 THEN 0.0::DOUBLE
           ELSE n_comment_lines / (n_comment_lines + n_code) END AS comment_ratio,
         coalesce(n_functions, 0)::INT AS n_functions FROM stats""",
    "stats", "generic_names",
)
AI_SCORE = (
    "least(100.0::DOUBLE, greatest(0.0::DOUBLE, ("
    + " + ".join(f"{n} * {w}::DOUBLE" for n, w in fv.SIGNAL_WEIGHTS.items()) + ") * 100))"
)

# -- report ----------------------------------------------------------------

define(
    "issue_totals",
    """SELECT file_id, count(*) AS issue_count, count(*) FILTER (category = 0) AS security_issues,
        count(*) FILTER (category = 1) AS quality_issues, count(*) FILTER (category = 2) AS ai_issues
    FROM issues GROUP BY file_id""",
    "issues",
)
define(
    "file_complexity",
    "SELECT file_id, path, (1 + sum(branches))::INT AS complexity FROM branches GROUP BY ALL",
    "branches",
)
define(
    "file_report",
    f"""SELECT s.file_id, s.path, s.language, n_lines::INT AS line_count, {AI_SCORE} AS ai_score,
        comment_ratio, n_functions, complexity, coalesce(issue_count, 0) AS issue_count,
        coalesce(security_issues, 0) AS security_issues,
        coalesce(quality_issues, 0) AS quality_issues, coalesce(ai_issues, 0) AS ai_issues
    FROM signals s JOIN file_complexity USING (file_id) LEFT JOIN issue_totals USING (file_id)""",
    "signals", "file_complexity", "issue_totals",
)
define(
    "summary",
    """SELECT count(*) AS files_analyzed, count(*) FILTER (issue_count > 0) AS files_flagged,
        coalesce(avg(complexity), 0) AS avg_complexity,
        coalesce(sum(issue_count), 0)::BIGINT AS total_issues,
        count(*) FILTER (ai_score > 60) AS ai_suspected,
        coalesce(sum(security_issues), 0)::BIGINT AS security_issues
    FROM file_report""",
    "file_report",
)
define(
    "quality_metrics",
    """SELECT * FROM (SELECT count(*) AS total_files, coalesce(sum(line_count), 0)::BIGINT AS total_lines,
        coalesce(sum(n_functions), 0)::BIGINT AS total_functions,
        count(*) FILTER (quality_issues > 0) AS files_with_issues,
        coalesce(avg(complexity), 0.0) AS avg_complexity,
        coalesce(avg(comment_ratio) * 100, 0.0) AS avg_comment_percent FROM file_report),
      (SELECT count(*) FILTER (category = 1) AS total_quality_issues,
        count(*) FILTER (type = 'long_function') AS long_functions,
        count(*) FILTER (type IN ('high_complexity', 'moderate_complexity')) AS complex_functions,
        count(*) FILTER (type = 'code_duplication') AS duplications,
        count(*) FILTER (type = 'unused_import') AS unused_imports,
        count(*) FILTER (type = 'todo_marker') AS todos,
        count(*) FILTER (type = 'dead_code') AS dead_code,
        count(*) FILTER (type = 'deep_nesting') AS deep_nesting,
        count(*) FILTER (type IN ('empty_error_handler', 'error_swallowing')) AS error_handling
      FROM issues)""",
    "file_report", "issues",
)

# -- change history --------------------------------------------------------

define(
    "change_log",
    f"""SELECT DISTINCT o_orderkey AS commit_id, 'c' || o_custkey AS author,
        o_orderdate AS authored_at, {corpus_path('l_partkey')} AS path
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
define(
    "history",
    """SELECT c.*, seq FROM change_log c JOIN (SELECT commit_id, row_number() OVER (
        ORDER BY authored_at DESC, commit_id DESC) AS seq
      FROM (SELECT DISTINCT commit_id, authored_at FROM change_log)) USING (commit_id)""",
    "change_log",
)
define(
    "ordered_log",
    f"""SELECT *, 'r' || (commit_id % {derived.ROOTS}) AS root, (commit_id * 7919) % 1000003 * 1000000 + commit_id AS seq
    FROM change_log""",
    "change_log",
)
define("newest", "SELECT * FROM history WHERE seq <= 100", "history")
define(
    "git_info",
    """SELECT path, count(*)::INT AS commit_count, arg_min(author, seq) AS last_author,
        strftime(max(authored_at), '%Y-%m-%d') AS last_modified,
        (SELECT string_agg(author, ',' ORDER BY s) FROM (SELECT author, min(seq) AS s
          FROM history n WHERE n.path = o.path GROUP BY author)) AS authors
    FROM history o GROUP BY path""",
    "history",
)
