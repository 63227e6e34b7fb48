"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from codestrata.llm import quality_rules as q

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {}

SQL["op1_minhash_near_dedup"] = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE
        WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * k >= 85 * (x.n_shingles + y.n_shingles - k)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, both_ways.b FROM r JOIN both_ways ON r.seen = both_ways.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM n JOIN c ON node = doc_id
"""

SQL["op8_cover_tree_top_k"] = """
WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.w, b.w) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def _quality() -> str:
    def value(m: str) -> str:
        above, below, units, _ = q.MEASURES[m]
        return f"CASE WHEN {below} > 0 THEN {units} * {above} // {below} ELSE 0 END"

    def quartiles(name: str, keys: str) -> str:
        by, on = (f"{keys}, measure", f"{keys}, measure") if keys else ("measure", "measure")
        return f"""{name}_below AS (
  SELECT {on}, bin, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS below, sum(n) OVER (PARTITION BY {by}) AS total
  FROM (SELECT {on}, bin, sum(n) AS n FROM sketch GROUP BY {by}, bin)),
{name} AS (SELECT {on}, max(total) AS total, min(bin) FILTER (4 * below >= total) AS q1,
  min(bin) FILTER (4 * below >= 3 * total) AS q3 FROM {name}_below GROUP BY {by})"""

    slack = "CASE measure " + " ".join(f"WHEN '{m}' THEN {v[3]}" for m, v in q.MEASURES.items()) + " END"
    two_sided = ", ".join(f"'{m}'" for m in q.TWO_SIDED)
    tests = " AND ".join(
        f"coalesce({value(m)} <= t.{m}_high, true) AND coalesce({value(m)} >= t.{m}_low, true)" for m in q.MEASURES)
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
lines AS (SELECT doc_id, [x for x in string_split(text, chr(10)) if regexp_matches(x, '{WORD}')] AS ls FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 5) AS t(j) GROUP BY doc_id),
counts AS (SELECT w.doc_id, lang, source, len(ws) AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words
  FROM w JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN cover ON cover.doc_id = w.doc_id),
measured AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {value(m)} AS v FROM counts WHERE n_words > 0" for m in q.MEASURES)}),
sketch AS (SELECT lang, source, measure, CASE WHEN v < 1024 THEN v ELSE (v >> (length(bin(v)) - 10)) << (length(bin(v)) - 10) END AS bin,
  count(*) AS n FROM measured GROUP BY ALL),
{quartiles("g2", "lang, source")},
{quartiles("g1", "lang")},
{quartiles("g0", "")},
chosen AS (SELECT g2.lang, g2.source, g2.measure, g.total, g.q1, g.q3 FROM g2
  LEFT JOIN g1 ON g1.lang IS NOT DISTINCT FROM g2.lang AND g1.measure = g2.measure
  LEFT JOIN g0 ON g0.measure = g2.measure,
  LATERAL (SELECT CASE WHEN g2.total >= {q.LEAST_DOCUMENTS} THEN g2.total WHEN g1.total >= {q.LEAST_DOCUMENTS} THEN g1.total ELSE g0.total END AS total,
    CASE WHEN g2.total >= {q.LEAST_DOCUMENTS} THEN g2.q1 WHEN g1.total >= {q.LEAST_DOCUMENTS} THEN g1.q1 ELSE g0.q1 END AS q1,
    CASE WHEN g2.total >= {q.LEAST_DOCUMENTS} THEN g2.q3 WHEN g1.total >= {q.LEAST_DOCUMENTS} THEN g1.q3 ELSE g0.q3 END AS q3) AS g),
fence AS (SELECT lang, source, measure,
  CASE WHEN total >= {q.LEAST_DOCUMENTS} AND measure IN ({two_sided}) THEN q1 - greatest({q.SPREAD} * (q3 - q1), {slack}) END AS low,
  CASE WHEN total >= {q.LEAST_DOCUMENTS} THEN q3 + greatest({q.SPREAD} * (q3 - q1), {slack}) END AS high FROM chosen),
limits AS (SELECT lang, source, {", ".join(f"max(low) FILTER (measure = '{m}') AS {m}_low, max(high) FILTER (measure = '{m}') AS {m}_high" for m in q.MEASURES)}
  FROM fence GROUP BY lang, source),
judged AS (SELECT c.*, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed, {tests} AS inside
  FROM counts c LEFT JOIN limits t ON t.lang IS NOT DISTINCT FROM c.lang AND t.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM judged
"""


SQL["op4_adaptive_quality"] = _quality()

# CRC-32 of a short text: its bytes one by one, eight halvings (-1) after each
_CRC = """xor(4294967295, list_reduce(flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(x, '')]),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295))"""


def _merkle() -> str:
    def field(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    return f"""
WITH RECURSIVE
x AS (SELECT *, doc_id::VARCHAR AS x FROM documents),
f AS (SELECT doc_id, source, {leaf('text')} AS leaf,
  CASE WHEN {_CRC} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM x),
r AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
  count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM f),
nodes(tree, level, rank, n, digest) AS (SELECT tree, 0, rank, n, leaf FROM r
  UNION ALL SELECT tree, max(level) + 1, rank // 16, max((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY rank))
  FROM nodes WHERE n > 1 GROUP BY tree, rank // 16),
upper(level, rank, n, digest) AS (SELECT 0, tree, (SELECT count(*) FROM nodes WHERE n = 1), digest FROM nodes WHERE n = 1
  UNION ALL SELECT max(level) + 1, rank // 16, max((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY rank))
  FROM upper WHERE n > 1 GROUP BY rank // 16),
every AS (SELECT tree, level, rank, n, digest FROM nodes UNION ALL SELECT -1, level, rank, n, digest FROM upper),
step AS (SELECT a.tree, a.level, a.rank, coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS before,
  coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS after
  FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.rank // 16 = b.rank // 16 WHERE a.n > 1 GROUP BY ALL),
low(id, tree, level, rank, acc, proof) AS (SELECT id, tree, 0, rank, coalesce(changed, leaf), '' FROM r
  UNION ALL SELECT id, tree, level + 1, rank // 16, sha256(before || acc || after), proof || before || after
  FROM low JOIN step USING (tree, level, rank)),
high(id, level, rank, acc, proof) AS (SELECT id, 0, tree, acc, proof FROM (SELECT * FROM low QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1)
  UNION ALL SELECT id, level + 1, rank // 16, sha256(before || acc || after), proof || before || after
  FROM high JOIN (SELECT level, rank, before, after FROM step WHERE tree = -1) USING (level, rank)),
ends AS (SELECT * FROM high QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1),
roots AS (SELECT digest AS root FROM upper WHERE n = 1)
SELECT doc_id, leaf, nodes.digest AS subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM r JOIN ends USING (id) JOIN nodes ON nodes.tree = r.tree AND nodes.n = 1, roots
"""


SQL["op11_merkle_manifest"] = _merkle()

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SQL["op13_hybrid_ranked_search"] = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS ts
  FROM documents WHERE text IS NOT NULL),
n AS (SELECT row, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, docs),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (row), total GROUP BY item_id, doc_id, row),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
