"""Every check of an analysis in one pass over the lines.

``facts`` splits each file once and sorts its lines once.  Expressions of single lines come first and
reduce the text to flags, counts and hashes; one chain of windows then looks along the file; one
``inline`` turns what it found into rows.  A row is a finding, a function, the figures of a file, or
the key of something that counts by where it occurs first in the file (a number, a nesting level, an
error block, a repeated window of six lines).  These keys meet in one more window by (file, tag, key),
which leaves the first of each, or the later ones of a repeated window.  Windows and line shapes that
a file holds once never become rows: their hashes are sorted within the file, next to its lines.

So the table of facts holds a few rows a file where the lines are many.  All else of an analysis is
read from it, no text is moved again, and findings carry their snippet with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata import fixed_values as fv
from codestrata.functions import text
from codestrata.functions.text import sql_string
from codestrata.operators import ai, complexity, quality, security
from codestrata.operators.findings import ISSUE_COLUMNS, emit
from codestrata.operators.views import snippet
from codestrata.sources.changes import roots
from codestrata.sources.lines import (
    LineStats, earlier, in_file, line_count, next_non_null, previous_non_null, so_far,
)

#: What a row tells of: keys that count by place or number, then findings, functions and files.
BLOCK, NUMBER, LEVEL, COPY, FINDING, FUNCTION, FILE = range(1, 8)
#: Findings of single lines and of whole contents, the ``key`` of a FINDING row.
DEAD, HANDLER, DISCARDED, MARKED, PHRASE, README, RULE, GENERIC, IMPORT = range(1, 10)
#: ``at`` is a line number times this, plus a position within the line.
LINE = 1 << 31

_ITEM = "struct<tag:int,key:bigint,at:bigint,a:bigint,b:bigint,c:bigint,text:string>"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound once to ``value``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _identifier_figures() -> str:
    generic = f"array({', '.join(sql_string(n) for n in fv.GENERIC_NAMES)})"
    lower = "array_distinct(transform(identifiers, t -> lower(t)))"

    def n_of(test: str) -> str:
        return f"size(filter(identifiers, t -> octet_length(t) >= 3 AND {test} AND t RLIKE '[a-z]'))"

    snake, camel = n_of("contains(t, '_')"), n_of("NOT contains(t, '_') AND t RLIKE '[A-Z]'")
    figures = (
        f"named_struct('n_tokens', size(identifiers), 'n_distinct', size(low), 'n_snake', {snake}, 'n_camel', {camel},"
        f" 'has_generic', arrays_overlap(low, {generic}),"
        f" 'generic', IF(arrays_overlap(low, {generic}), {ai.generic_places()}, NULL))")
    found = f"regexp_extract_all(content, {sql_string(text.to_java(fv.IDENTIFIER_PATTERN))}, 0)"
    return _let("identifiers", found, _let("low", lower, figures))


def _repeated_windows() -> str:
    """SQL for the windows of lines that ``parts`` holds twice or more, as an array of (hash, line_no)."""
    size = fv.DUPLICATE_WINDOW
    blank = f"xxhash64({', '.join(['xxhash64(' + sql_string('') + ')'] * size)})"
    window = f"xxhash64({', '.join(f'get(hashes, i + {n})' for n in range(size))})"
    windows = _let(
        "hashes", "transform(parts, e -> xxhash64(e.trimmed))",
        f"sort_array(filter(transform(sequence(0, n_lines - {size}), i -> named_struct('hash', {window}, 'line_no', i + 1)),"
        f" w -> w.hash <> {blank}))")
    twice = _let(
        "windows", windows,
        "filter(windows, (w, i) -> coalesce(get(windows, i - 1).hash = w.hash, false) OR coalesce(get(windows, i + 1).hash = w.hash, false))")
    return f"CASE WHEN n_lines >= {2 * size} THEN {twice} END"


def _repeated_shapes() -> str:
    """SQL for how many longer lines of ``parts`` have one of the shapes that occur often enough."""
    often = fv.MIN_REPEATS - 1
    shape = "xxhash64(regexp_replace(regexp_replace(e.trimmed, '\"[^\"]*\"', '\"\"'), '\\'[^\\']*\\'', '\\'\\''))"
    shapes = f"sort_array(transform(filter(parts, e -> octet_length(e.trimmed) >= {fv.MIN_SHAPE_BYTES}), e -> {shape}))"
    # in a sorted array a shape is frequent if some stretch around the line begins and ends with it
    around = " OR ".join(
        f"coalesce(get(shapes, i - {n}) = s AND get(shapes, i + {often - n}) = s, false)" for n in range(often + 1))
    return _let("shapes", shapes, f"size(filter(shapes, (s, i) -> {around}))")


def numbered_lines(files: DataFrame) -> DataFrame:
    """The lines of the files; the last line of a file brings what its whole content tells (``of_file``)."""
    counted = files.select("file_id", *roots(files), "path", "language", line_count().alias("n_lines"), "content")
    parts = f"transform(split(content, '\\n', -1), x -> named_struct('line', x, 'trimmed', btrim(x, {sql_string(text.WHITE_SPACE)})))"
    of_file = (
        f"named_struct('names', {_identifier_figures()}, 'imports', {quality.unused_imports_of()},"
        f" 'copies', {_repeated_windows()}, 'n_repeated', {_repeated_shapes()})")
    lines = _let("parts", parts, (
        "transform(parts, (e, at) -> named_struct('line', e.line, 'trimmed', e.trimmed,"
        f" 'of_file', IF(at + 1 = n_lines, {of_file}, NULL)))"))
    key = ["file_id", *roots(files), "path", "language", "n_lines"]
    return counted.select(*key, F.posexplode_outer(F.expr(lines)).alias("pos", "l")).select(
        *key, (F.col("pos") + 1).alias("line_no"), "l.line", "l.trimmed", "l.of_file")


def _of_line(stats: LineStats) -> dict[str, Column]:
    """All that is known of a line by itself, without its text but where a finding shows it."""
    filled, t = F.col("trimmed") != "", F.col("trimmed")
    go = F.col("language") == "Go"
    may_close = F.when(
        F.col("language").isin("Python", "Ruby"), filled & ~text.starts_with_any("line", (" ", "\t")),
    ).otherwise((F.col("language") == "Lua") & (t == "end"))
    blocks = None
    for language, pattern in fv.ERROR_BLOCK_PATTERNS.items():
        hit = (F.col("language") == language) & text.matches("line", pattern)
        blocks = hit if blocks is None else blocks | hit
    return {
        **stats.columns,
        "branches": complexity.branch_count(),
        "started": F.when(F.col("language").isin(list(fv.FUNCTION_PATTERNS)), complexity.function_name()),
        "braces": complexity.brace_change("trimmed"),
        "may_close": may_close,
        "closing": -complexity.brace_change("line"),
        "opens_closure": quality.opens_closure(),
        "follows": F.when(filled, quality.may_follow_jump("trimmed").cast("int") + 2 * (t == "}").cast("int")),
        "filled_no": F.when(filled, F.col("line_no")),
        "passes": t.isin("pass", ""),
        "jump": F.when(quality.is_jump(), t),
        "handler": F.expr(quality.handler_kind()),
        "discards": quality.discards(),
        "to_do": F.when(
            text.holds_any(F.col("low"), quality.TODO_WORDS) & text.matches("line", fv.TODO_PATTERN),
            F.expr(quality.todo_text())),
        "numbers": F.when(
            ~quality.holds_no_magic_number(), text.all_matches("line", fv.MAGIC_NUMBER_PATTERN, 1)),
        "level": F.when(quality.nesting_level() > fv.MAX_NESTING, quality.nesting_level()),
        "hash": F.xxhash64("trimmed"),
        "block_hash": F.when(blocks, F.xxhash64("line")),
        "fired": F.when(F.expr(security.ELIGIBLE), F.expr(security.fired_rules(fv.SECURITY_RULES))),
    }


def _all_stats() -> LineStats:
    """The stats of all signals and checks; calls are counted one by one."""
    parts = (ai.line_stats(), ai.comment_stats(), quality.naming_stats())
    columns = {k: c for p in parts for k, c in p.columns.items()}
    aggregates = {k: c for p in parts for k, c in p.aggregates.items() if k != "n_calls"}
    calls = {f"n_{c}": F.count(F.when(F.col(c), 1)) for c in columns if c.startswith("call_")}
    return LineStats(columns, aggregates | calls)


def _along_the_file(lines: DataFrame, stats: LineStats) -> DataFrame:
    """The windows, in a chain over one order of the lines."""
    starts, lua = F.col("started").isNotNull(), F.col("language") == "Lua"
    first = lines.withColumns({
        "after_comment": previous_non_null("comment"),
        "next_passes": F.lead("passes").over(in_file()),
        "next_follows": next_non_null("follows"),
        "next_filled_no": next_non_null("filled_no"),
        "closed": F.sum("closing").over(so_far()),
        "depth": F.sum("braces").over(so_far()),
        "branches_so_far": F.sum("branches").over(so_far()),
        "start_line": F.max(F.when(starts, F.col("line_no"))).over(so_far()),
        "name": F.last("started", ignorenulls=True).over(so_far()),
        "params": F.last("n_params", ignorenulls=True).over(so_far()),
        "next_starts": F.lead(starts).over(in_file()),
        **{f"hash_{n}": F.lead("hash", n).over(in_file()) for n in (1, 2, 3)},
    }).drop("passes", "filled_no", "n_params")
    second = first.withColumns({
        "error_block": F.when(F.col("block_hash").isNotNull(), F.xxhash64("block_hash", "hash_1", "hash_2", "hash_3")),
        "depth_before": F.last(F.when(starts, F.col("depth") - F.col("braces")), ignorenulls=True).over(so_far()),
        "branches_before": F.last(F.when(starts, F.col("branches_so_far") - F.col("branches")), ignorenulls=True).over(so_far()),
        "open_closure": F.max(F.when(F.col("opens_closure"), F.col("closed") - F.col("closing"))).over(so_far()),
    }).drop("hash", "block_hash", "hash_1", "hash_2", "hash_3", "braces", "started", "closing", "opens_closure")
    closes = (F.col("may_close") & (F.col("depth") <= F.col("depth_before"))
              & (F.col("line_no") >= F.col("start_line") + F.when(lua, 1).otherwise(2)))
    third = second.withColumn("closes", closes).withColumn(
        "last_close", F.max(F.when(F.col("closes"), F.col("line_no"))).over(earlier()))
    closes_first = F.col("closes") & (F.coalesce("last_close", F.lit(0)) < F.col("start_line"))
    return third.withColumn("closes_first", closes_first).withColumns({
        "close_line": F.max(F.when(F.col("closes_first"), F.col("line_no"))).over(so_far()),
        "branches_at_close": F.last(F.when(F.col("closes_first"), F.col("branches_so_far")), ignorenulls=True).over(so_far()),
        # running aggregates, of which the last line has those of the file
        **{k: c.over(so_far()) for k, c in stats.aggregates.items()},
    })


def _item(tag: int, key: str, at: str = f"line_no * {LINE}", a: str = "0", b: str = "0", c: str = "0", shown: str = "NULL") -> str:
    return (f"named_struct('tag', {tag}, 'key', cast({key} AS bigint), 'at', cast({at} AS bigint), 'a', cast({a} AS bigint),"
            f" 'b', cast({b} AS bigint), 'c', cast({c} AS bigint), 'text', cast({shown} AS string))")


def _items() -> str:
    """SQL for the array of all that a line gives; most lines give nothing."""
    tests = []

    def when(test: str, item: str) -> str:
        tests.append(f"coalesce({test}, false)")
        return f"CASE WHEN {test} THEN {item} END"

    in_closure = "coalesce(open_closure >= closed, false)"
    empty = "CASE WHEN handler = 2 THEN next_passes WHEN handler IN (1, 3) THEN next_follows >= 2 END"
    ended = "coalesce(close_line >= start_line, false)"
    end = f"IF({ended}, close_line - IF(language = 'Lua', 0, 1), line_no)"
    singles = [
        when("error_block IS NOT NULL", _item(BLOCK, "error_block")),
        when("level IS NOT NULL", _item(LEVEL, "level")),
        when(f"jump IS NOT NULL AND next_follows % 2 = 0 AND NOT {in_closure}", _item(FINDING, str(DEAD), a="next_filled_no", shown="jump")),
        when(f"handler IS NOT NULL AND next_passes IS NOT NULL AND {empty}", _item(FINDING, str(HANDLER), b="handler")),
        when("discards", _item(FINDING, str(DISCARDED))),
        when("to_do IS NOT NULL", _item(FINDING, str(MARKED), shown="to_do")),
        when("marker_no IS NOT NULL", _item(FINDING, str(PHRASE), b="marker_no")),
        when("readme_no IS NOT NULL", _item(FINDING, str(README), b="readme_no")),
        when("start_line IS NOT NULL AND (next_starts OR line_no = n_lines)", _item(
            FUNCTION, end, a="start_line", b="params",
            c=f"IF({ended}, branches_at_close, branches_so_far) - branches_before + 1", shown="name")),
        when("line_no = n_lines", _item(FILE, "0")),
    ]
    allowed = ", ".join(sql_string(n) for n in fv.ALLOWED_NUMBERS)
    numbers = f"filter(transform(numbers, (t, i) -> {_item(NUMBER, 'xxhash64(t)', f'line_no * {LINE} + i', shown='t')}), e -> e.text NOT IN ({allowed}))"
    rules = f"transform(fired, r -> {_item(FINDING, str(RULE), b='r', shown='snippet')})"
    generic = f"transform(of_file.names.generic, (g, i) -> {_item(FINDING, str(GENERIC), f'g.line_no * {LINE} + i', shown='g.name')})"
    imports = f"transform(of_file.imports, i -> {_item(FINDING, str(IMPORT), f'i.line_no * {LINE}', shown='i.pkg')})"
    copies = f"transform(of_file.copies, w -> {_item(COPY, 'w.hash', f'w.line_no * {LINE}')})"
    none = f"cast(array() AS array<{_ITEM}>)"
    lists = [f"CASE WHEN size({column}) > 0 THEN {found} ELSE {none} END" for column, found in (
        ("numbers", numbers), ("fired", rules), ("of_file.names.generic", generic), ("of_file.imports", imports),
        ("of_file.copies", copies))]
    # array_compact is interpreted, item by item; the compiled test keeps it off the many lines that give nothing
    # (what rides on the last line comes with its FILE item)
    some = " OR ".join([*tests, "size(numbers) > 0", "size(fired) > 0"])
    return f"CASE WHEN {some} THEN concat(array_compact(array({', '.join(singles)})), {', '.join(lists)}) ELSE {none} END"


def facts(files: DataFrame) -> DataFrame:
    """Findings, functions, figures and keys of the files, a row each.

    ``(file_id[, root], path, language, n_lines, tag, key, line_no, pos, first_line, n, a, b, c, text, figures)``
    with ``files`` at the partitions of their ``file_id``; nothing is shuffled.
    """
    key = ["file_id", *roots(files), "path", "language", "n_lines"]
    lines = numbered_lines(files).withColumn("low", text.folded("line"))
    stats = _all_stats()
    described = lines.select(*key, "line_no", "line", "of_file", *[c.alias(k) for k, c in _of_line(stats).items()])
    shown = described.withColumns({
        "snippet": F.when(F.size("fired") > 0, snippet(F.col("line"))),
        "n_params": F.when(F.col("started").isNotNull(), complexity.parameter_count()),
    }).drop("line")
    seen = _along_the_file(shown, stats)
    calls = [c for c in stats.aggregates if c.startswith("n_call_")]
    often = " + ".join(f"IF({c} >= {fv.MIN_REPEATS}, {c}, 0)" for c in calls)
    names = [c for c in stats.aggregates if c not in calls]
    identifiers = ("n_tokens", "n_distinct", "n_snake", "n_camel", "has_generic")
    figures = F.when(F.col("line_no") == F.col("n_lines"), F.struct(
        *names, F.expr(often).alias("n_calls"), (F.col("branches_so_far") + 1).cast("int").alias("complexity"),
        *[F.col(f"of_file.names.{n}").alias(n) for n in identifiers], F.col("of_file.n_repeated").alias("n_repeated")))
    rows = (
        seen.select(*key, figures.alias("figures"), F.expr(_items()).alias("items"))
        .select(*key, "figures", F.inline_outer("items"))
        .filter(F.col("tag").isNotNull())
        .withColumn("figures", F.when(F.col("tag") == FILE, F.col("figures")))
    )
    same = Window.partitionBy("file_id", "tag", "key")
    counted = rows.withColumns({"first": F.min("at").over(same), "n": F.count(F.lit(1)).over(same)})
    once, tag = F.col("at") == F.col("first"), F.col("tag")
    return (
        counted.filter(
            F.when(tag == COPY, ~once).when(tag < COPY, once).otherwise(True))
        .select(
            *key, "tag", "key", F.expr(f"cast(at div {LINE} AS int)").alias("line_no"),
            F.expr(f"cast(at % {LINE} AS int)").alias("pos"), F.expr(f"cast(first div {LINE} AS int)").alias("first_line"),
            "n", "a", "b", "c", "text", "figures")
    )


# -- what is read from the facts --------------------------------------------


def functions(found: DataFrame) -> DataFrame:
    """As ``complexity.functions``."""
    return found.filter(F.col("tag") == FUNCTION).select(
        "file_id", "path", F.col("text").alias("name"), F.col("a").cast("int").alias("start_line"),
        F.col("key").cast("int").alias("end_line"), F.col("c").cast("int").alias("complexity"),
        (F.col("key") - F.col("a") + 1).cast("int").alias("line_count"), F.col("b").cast("int").alias("n_params"))


def file_stats(found: DataFrame) -> DataFrame:
    """All that the signals are computed from, a row per file, in one aggregate of numbers."""
    tag, size = F.col("tag"), F.col("key") - F.col("a") + 1
    figures = found.schema["figures"].dataType.names
    of = lambda t, c: F.when(tag == t, c)
    return found.groupBy("file_id", *roots(found), "path", "language", "n_lines").agg(
        *[F.max(f"figures.{c}").alias(c) for c in figures],
        F.count(of(FUNCTION, 1)).alias("n_functions"), F.sum(of(FUNCTION, size)).alias("size_sum"),
        F.sum(of(FUNCTION, size * size)).alias("size_squares"),
        F.sum(of(BLOCK, F.col("n"))).alias("n_blocks"), F.max(of(BLOCK, F.col("n"))).alias("n_top_block"))


def security_issues(found: DataFrame, path_aware: bool = False) -> DataFrame:
    """The findings of the rules, each with the ``snippet`` of its line."""
    hits = found.filter((F.col("tag") == FINDING) & (F.col("key") == RULE)).select(
        "file_id", "path", "line_no", F.col("b").cast("int").alias("rule_no"), F.col("text").alias("snippet"))
    return security.described(hits, path_aware).select(*ISSUE_COLUMNS, "snippet")


def _named(found: DataFrame) -> DataFrame:
    """The rows with the names that findings are made of."""
    tag = F.col("tag")
    function = lambda c: F.when(tag == FUNCTION, c.cast("int"))
    stats = found.withColumns({c: F.col(f"figures.{c}") for c in ("n_camel_names", "n_snake_names", "first_camel", "first_snake")})
    return stats.select(
        "file_id", "path", "n_lines", "tag", "key", "line_no", "pos", "first_line",
        F.when((tag == FINDING) & (F.col("key") == PHRASE), F.col("b")).cast("int").alias("marker_no"),
        F.when((tag == FINDING) & (F.col("key") == README), F.col("b")).cast("int").alias("readme_no"),
        F.when(tag == LEVEL, F.col("key").cast("int")).alias("level"), F.col("a").cast("int").alias("next_filled_no"),
        F.col("a").cast("int").alias("start_line"), F.col("b").alias("handler"), function(F.col("b")).alias("n_params"),
        function(F.col("c")).alias("complexity"), function(F.col("key") - F.col("a") + 1).alias("line_count"),
        *[F.col("text").alias(c) for c in ("token", "trimmed", "name", "pkg", "to_do")],
        *[c.alias(k) for k, c in quality.naming_columns().items()])


def _findings(found: DataFrame, kinds: dict[int, Column], *more: Column) -> DataFrame:
    """Findings by the key of their rows, and ``more`` that are NULL but where they belong."""
    is_finding = F.col("tag") == FINDING
    return emit(_named(found), *[F.when(is_finding & (F.col("key") == k), c) for k, c in kinds.items()], *more)


def ai_issues(found: DataFrame) -> DataFrame:
    generic = F.when(F.col("n_lines") >= fv.MIN_AI_LINES, ai.generic_name())
    rows = found.filter((F.col("tag") == FINDING) & F.col("key").isin(GENERIC, PHRASE, README))
    return _findings(rows, {GENERIC: generic, PHRASE: ai.marker_phrase(), README: ai.readme_comment()})


def quality_issues(found: DataFrame) -> DataFrame:
    tag = F.col("tag")
    rows = found.filter(
        tag.isin(NUMBER, LEVEL, COPY, FUNCTION, FILE)
        | ((tag == FINDING) & F.col("key").isin(DEAD, HANDLER, DISCARDED, MARKED, IMPORT)))
    return _findings(
        rows,
        {DEAD: quality.unreachable(), HANDLER: quality.swallows_silently("handler"), DISCARDED: quality.discarded(),
         MARKED: quality.to_do("to_do"), IMPORT: quality.unused_import()},
        quality.function_complexity(), quality.function_length(), quality.long_parameter_list(),
        F.when(tag == NUMBER, quality.magic_number()), F.when(tag == LEVEL, quality.nested_too_deep()),
        F.when(tag == COPY, quality.duplicate()),
        F.when(tag == FILE, quality.long_file()), F.when(tag == FILE, quality.mixed_names()))
