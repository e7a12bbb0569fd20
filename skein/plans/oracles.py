"""DuckDB SQL with the answers the registered queries must give, over the same tables."""

from __future__ import annotations

from skein.plans.derived import CUSTOMERS_PER_BLOCK

BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

ENTITY_SYMBOLS = """
symbols AS (
  SELECT name, qualified_name, kind, file_path, CAST(k % 1000 AS INTEGER) AS line_start, tab || ' ' || name AS summary,
         CAST(k AS BIGINT) AS ordinal
  FROM (
    SELECT r_name AS name, 'region.' || r_regionkey AS qualified_name, 'file' AS kind, 'region' AS file_path, r_regionkey AS k, 'region' AS tab FROM region
    UNION ALL SELECT n_name, 'nation.' || n_nationkey, 'model', 'nation_' || n_nationkey, n_nationkey, 'nation' FROM nation
    UNION ALL SELECT s_name, 'supplier.' || s_suppkey, 'class', 'nation_' || s_nationkey, s_suppkey, 'supplier' FROM supplier
    UNION ALL SELECT c_name, 'customer.' || c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'view' ELSE 'function' END,
                     'nation_' || c_nationkey, c_custkey, 'customer' FROM customer
    UNION ALL SELECT p_name, 'part.' || p_partkey, 'import', 'brand_' || p_brand, p_partkey, 'part' FROM part
    UNION ALL SELECT o_orderpriority, 'order.' || o_orderkey, 'method', 'orders', o_orderkey, 'orders' FROM orders
  )
)"""

ENTITY_EDGES = """
edges AS (
  SELECT 'order.' || o_orderkey AS from_qualified, 'customer.' || o_custkey AS to_qualified, 'calls' AS relation FROM orders
  UNION SELECT 'order.' || l_orderkey, 'part.' || l_partkey, 'references' FROM lineitem
  UNION SELECT 'supplier.' || l_suppkey, 'part.' || l_partkey, 'calls' FROM lineitem
  UNION SELECT 'part.' || l_partkey, 'supplier.' || l_suppkey, 'calls' FROM lineitem
  UNION SELECT 'customer.' || c_custkey, 'nation.' || c_nationkey,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'registers' WHEN 'MACHINERY' THEN 'handles_signal' ELSE 'references' END FROM customer
  UNION SELECT 'supplier.' || s_suppkey, 'nation.' || s_nationkey, 'inherits' FROM supplier
  UNION SELECT 'nation.' || n_nationkey, 'region.' || n_regionkey, 'imports' FROM nation
)"""

TEXT_FILES = """
text_files AS (
  SELECT source || '/' || lang || '/doc_' || doc_id || '.' || (['py', 'js', 'md', 'html'])[CAST(doc_id % 4 + 1 AS INTEGER)] AS file_path, text FROM documents
  UNION ALL SELECT 'conv_' || conv_id || '/turn_' || turn || '.txt', text FROM conversations
  UNION ALL SELECT 'pages/page_' || page_id || '.html', html FROM pages
)"""

BASE_NAME = "regexp_extract(file_path, '[^/]*$')"


def lines_of(files: str, name: str = "lines") -> str:
    """Numbered lines of a table of ``file_path, text``; binary files give none."""
    return f"""
{name} AS (
  SELECT file_path, CAST(UNNEST(generate_series(1, n)) AS INTEGER) AS line_no, UNNEST(parts[1:n]) AS text
  FROM (SELECT file_path, parts, len(parts) - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END AS n
        FROM (SELECT file_path, string_split(text, chr(10)) AS parts FROM {files}))
)"""


def stripped(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{BLANK}+', ''), '{BLANK}+$', '')"


def ranked(source: str, keys: str, order: str, limit: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM ({source})) WHERE rn <= {limit}"


def requests(*parts: tuple[str, str, str, str | None]) -> str:
    rows = [
        f"SELECT DISTINCT '{prefix} ' || {name} AS request_id, {name} AS name, {'CAST(NULL AS VARCHAR)' if not kind else repr(kind)} AS kind FROM {table}"
        for prefix, table, name, kind in parts
    ]
    return "requests AS (" + " UNION ALL ".join(rows) + ")"


def words(table: str, column: str) -> str:
    return f"(SELECT DISTINCT unnest(regexp_extract_all({column}, '[A-Za-z]+')) AS word FROM {table})"


PART_WORDS, PASSAGE_WORDS = words("part", "p_name"), words("benchmark", "text")

EXACT_REQUESTS = requests(
    ("nation", "nation", "n_name", None),
    ("region", "region", "r_name", None),
    ("priority", "orders", "o_orderpriority", None),
    ("part", "part", "p_name", None),
)
_SUBSTRINGS = (
    ("nation", "nation", "lower(n_name)", None),
    ("region", "region", "lower(r_name)", None),
    ("priority", "orders", "lower(o_orderpriority)", None),
    ("word", PART_WORDS, "word", None),
    ("pattern", "nation", "('_us%#%' || n_nationkey)", None),
)
SUBSTRING_REQUESTS = requests(*_SUBSTRINGS)
INDEXED_REQUESTS = requests(
    *_SUBSTRINGS,
    ("two", "nation", "lower(substr(n_name, 1, 2))", None),
    ("one", "customer", "lower(substr(c_mktsegment, 1, 1))", "view"),
    ("any", "customer", "repeat('_', length(c_mktsegment))", "model"),
    ("all", "region", "'%'", "class"),
)
KIND_REQUESTS = requests(
    ("model", "nation", "n_name", "model"),
    ("no view", "nation", "n_name", "view"),
    ("import", PART_WORDS, "word", "import"),
    ("no model", PART_WORDS, "word", "model"),
    ("view", "customer", "lower(c_name)", "view"),
)
TIERED_REQUESTS = requests(
    ("exact", "nation", "n_name", None),
    ("hot", "orders", "o_orderpriority", None),
    ("substring", PART_WORDS, "word", None),
    ("text", PASSAGE_WORDS, "word", "model"),
)

KIND_FITS = "(r.kind IS NULL OR s.kind = r.kind)"
HIT = "request_id, qualified_name, kind, file_path, line_start, summary, 'graph' AS source"
FOUND = "r.request_id, s.qualified_name, s.kind, s.file_path, s.line_start, s.summary"


def exact_tier(limit: int = 10) -> str:
    found = f"SELECT {FOUND} FROM requests r JOIN symbols s ON s.name = r.name AND {KIND_FITS}"
    return f"exact AS ({ranked(found, 'request_id', 'qualified_name', limit)})"


def substring_tier(of: str, wildcards: bool = True, limit: int = 10) -> str:
    test = "s.name ILIKE '%' || r.name || '%'" if wildcards else "contains(lower(s.name), lower(r.name))"
    found = f"SELECT {FOUND} FROM {of} r JOIN symbols s ON {test} AND {KIND_FITS}"
    return f"loose AS ({ranked(found, 'request_id', 'qualified_name', limit)})"


OPEN_AFTER_EXACT = "open AS (SELECT * FROM requests WHERE request_id NOT IN (SELECT request_id FROM exact))"


# ---- the generated code corpus ----------------------------------------------------------------


def code(v: int) -> str:
    """CTEs ``files{v}``, ``symbols{v}`` and ``raw{v}`` of a corpus version."""
    moved = "r_name = 'AFRICA'" if v == 2 else "FALSE"
    shift = v - 1
    extra_file = "UNION ALL SELECT 'shop/extra.py', 'import shop.base' || chr(10)" if v == 2 else ""
    extra_symbols = (
        """
  UNION ALL SELECT 'shop.base', 'shop.extra.__import__.1.0.shop.base.shop.base', 'import', 'shop/extra.py', 1, 1, '', 0, 'shop.base', NULL
  UNION ALL SELECT 'extra.py', 'shop.extra', 'file', 'shop/extra.py', 1, 1, '', 1, NULL, NULL"""
        if v == 2
        else ""
    )
    extra_raw = "UNION ALL SELECT 'shop/extra.py', 'shop.extra', 'shop.base', 'imports'" if v == 2 else ""
    comment = "'# shared' || chr(10) || " if v == 2 else ""
    q = "chr(34) || chr(34) || chr(34)"
    return f"""
cust{v} AS (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey, block ORDER BY c_custkey) - 1 AS i FROM (
    SELECT c_custkey, c_nationkey, n_name, n_regionkey, c_custkey // {CUSTOMERS_PER_BLOCK} AS block,
           n_name || CASE WHEN {moved} THEN ' renewed' ELSE '' END || ' entity.' AS doc
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE NOT ({moved} AND c_mktsegment = 'BUILDING'))
),
block{v} AS (
  SELECT *, 'shop/nation_' || k || '_' || block || '.py' AS file_path, 'shop.nation_' || k || '_' || block AS m FROM (
    SELECT c_nationkey AS k, block, any_value(n_regionkey) AS r, any_value(doc) AS doc, count(*) AS n,
      string_agg('def customer_' || c_custkey || '(x):' || chr(10) || '    ' || {q} || 'Customer ' || c_custkey || '.' || {q} || chr(10)
        || '    return Nation' || c_nationkey || '().greet()' || chr(10) || chr(10), '' ORDER BY c_custkey) AS bodies
    FROM cust{v} GROUP BY c_nationkey, block)
),
files{v} AS (
  SELECT file_path, 'import shop.base' || chr(10) || 'from shop.region_' || r || ' import Region' || r || ' as Parent' || chr(10) || chr(10)
    || 'class Nation' || k || '(Parent):' || chr(10) || '    ' || {q} || doc || {q} || chr(10)
    || '    def greet(self):' || chr(10) || '        return shop.base.helper()' || chr(10) || chr(10) || bodies AS content FROM block{v}
  UNION ALL SELECT 'shop/region_' || r_regionkey || '.py', 'import shop.base' || chr(10) || 'class Region' || r_regionkey || '(shop.base.Missing):'
    || chr(10) || '    ' || {q} || r_name || '.' || {q} || chr(10) FROM region
  UNION ALL SELECT 'shop/draft_' || n_nationkey || '.py', 'class ' || n_name || '(:' || chr(10) FROM nation
  UNION ALL SELECT 'shop/note_' || n_nationkey || '.md', n_name FROM nation
  UNION ALL SELECT 'shop/base.py', {comment}'def helper():' || chr(10) || '    return 1' || chr(10)
  {extra_file}
),
symbols{v}(name, qualified_name, kind, file_path, line_start, line_end, summary, ordinal, module, original_name) AS (
  SELECT 'shop.base', m || '.__import__.1.0.shop.base.shop.base', 'import', file_path, 1, 1, '', 0, 'shop.base', NULL FROM block{v}
  UNION ALL SELECT 'Parent', m || '.__import__.2.0.shop.region_' || r || '.Parent', 'import', file_path, 2, 2, '', 1, 'shop.region_' || r, 'Region' || r FROM block{v}
  UNION ALL SELECT 'Nation' || k, m || '.Nation' || k, 'class', file_path, 4, 7, doc, 2, NULL, NULL FROM block{v}
  UNION ALL SELECT 'greet', m || '.Nation' || k || '.greet', 'method', file_path, 6, 7, '', 3, NULL, NULL FROM block{v}
  UNION ALL SELECT 'customer_' || c_custkey, m || '.customer_' || c_custkey, 'function', file_path, 9 + 4 * i, 11 + 4 * i,
    'Customer ' || c_custkey || '.', 4 + i, NULL, NULL FROM cust{v} c JOIN block{v} b ON c.c_nationkey = b.k AND c.block = b.block
  UNION ALL SELECT 'nation_' || k || '_' || block || '.py', m, 'file', file_path, 1, 8 + 4 * n, '', 4 + n, NULL, NULL FROM block{v}
  UNION ALL SELECT 'shop.base', 'shop.region_' || r_regionkey || '.__import__.1.0.shop.base.shop.base', 'import',
    'shop/region_' || r_regionkey || '.py', 1, 1, '', 0, 'shop.base', NULL FROM region
  UNION ALL SELECT 'Region' || r_regionkey, 'shop.region_' || r_regionkey || '.Region' || r_regionkey, 'class',
    'shop/region_' || r_regionkey || '.py', 2, 3, r_name || '.', 1, NULL, NULL FROM region
  UNION ALL SELECT 'region_' || r_regionkey || '.py', 'shop.region_' || r_regionkey, 'file', 'shop/region_' || r_regionkey || '.py', 1, 3, '', 2, NULL, NULL FROM region
  UNION ALL SELECT 'helper', 'shop.base.helper', 'function', 'shop/base.py', {1 + shift}, {2 + shift}, '', 0, NULL, NULL
  UNION ALL SELECT 'base.py', 'shop.base', 'file', 'shop/base.py', 1, {2 + shift}, '', 1, NULL, NULL
  {extra_symbols}
),
raw{v}(file_path, from_qualified, to_qualified, relation) AS (
  SELECT file_path, m, 'shop.base', 'imports' FROM block{v}
  UNION ALL SELECT file_path, m, 'shop.region_' || r || '.Region' || r, 'imports' FROM block{v}
  UNION ALL SELECT file_path, m || '.Nation' || k, 'Parent', 'inherits' FROM block{v}
  UNION ALL SELECT file_path, m || '.Nation' || k || '.greet', 'shop.base.helper', 'calls' FROM block{v}
  UNION ALL SELECT file_path, m || '.customer_' || c_custkey, 'Nation' || k, 'calls'
    FROM cust{v} c JOIN block{v} b ON c.c_nationkey = b.k AND c.block = b.block
  UNION ALL SELECT 'shop/region_' || r_regionkey || '.py', 'shop.region_' || r_regionkey, 'shop.base', 'imports' FROM region
  UNION ALL SELECT 'shop/region_' || r_regionkey || '.py', 'shop.region_' || r_regionkey || '.Region' || r_regionkey, 'shop.base.Missing', 'inherits' FROM region
  {extra_raw}
)"""


CHANGED = """
changed AS (SELECT file_path, sha256(content) AS content_hash FROM files2 WHERE file_path LIKE '%.py'
            EXCEPT SELECT file_path, sha256(content) FROM files1)"""

# A path that version 2 no longer has keeps its rows.
AFTER = """
stale AS (SELECT file_path FROM files1 EXCEPT SELECT file_path FROM files2),
symbols_after AS (SELECT * FROM symbols2 UNION ALL SELECT * FROM symbols1 WHERE file_path IN (FROM stale)),
raw_after AS (SELECT * FROM raw2 UNION ALL SELECT * FROM raw1 WHERE file_path IN (FROM stale)),
files_after AS (SELECT * FROM files2 UNION ALL SELECT * FROM files1 WHERE file_path IN (FROM stale))"""

SYMBOL_COLUMNS = """name, qualified_name, kind, file_path, CAST(line_start AS INTEGER) AS line_start,
  CAST(line_end AS INTEGER) AS line_end, summary, CAST(ordinal AS INTEGER) AS ordinal"""


def resolved(raw: str, symbols: str) -> str:
    return f"""SELECT DISTINCT from_qualified, to_qualified, relation FROM {raw}
WHERE from_qualified IN (SELECT qualified_name FROM {symbols}) AND to_qualified IN (SELECT qualified_name FROM {symbols})"""


def resolved_in_order(raw: str, symbols: str, seen_from: str = "file_path") -> str:
    return f"""SELECT DISTINCT e.from_qualified, e.to_qualified, e.relation FROM {raw} e
JOIN {symbols} t ON t.qualified_name = e.to_qualified AND t.{seen_from} <= e.file_path
JOIN {symbols} f ON f.qualified_name = e.from_qualified AND f.{seen_from} <= e.file_path"""


# ---- shortest paths -----------------------------------------------------------------------------


def paths(asked: str, depth: int) -> str:
    """Level-by-level search: smallest path per (source, node), a node belongs to its first level."""
    known = "(SELECT qualified_name FROM symbols)"
    ctes = [
        ENTITY_SYMBOLS.strip(),
        ENTITY_EDGES.strip(),
        f"asked AS ({asked})",
        f"pending AS (SELECT DISTINCT source, target FROM asked WHERE source IN {known} AND target IN {known})",
        "n0 AS (SELECT DISTINCT source, source AS node, '' AS path FROM pending)",
        "seen0 AS (SELECT source, node FROM n0)",
    ]
    for d in range(1, depth + 1):
        ctes += [
            f"""l{d} AS (SELECT source, to_qualified AS node, min(path || chr(1) || to_qualified || chr(1) || relation) AS path
  FROM n{d - 1} JOIN edges ON node = from_qualified GROUP BY source, to_qualified)""",
            f"n{d} AS (SELECT * FROM l{d} ANTI JOIN seen{d - 1} USING (source, node))",
            f"seen{d} AS (SELECT * FROM seen{d - 1} UNION ALL SELECT source, node FROM n{d})",
        ]
    hits = " UNION ALL ".join(
        f"SELECT p.source, p.target, l.path, {d} AS d FROM l{d} l JOIN pending p ON p.source = l.source AND p.target = l.node"
        for d in range(1, depth + 1)
    )
    shown = "substr(regexp_replace(path, chr(1) || '([^' || chr(1) || ']+)' || chr(1) || '([^' || chr(1) || ']+)', ' > \\1 \\2', 'g'), 4)"
    return f"""WITH {', '.join(ctes)}, hits AS ({hits}),
best AS (SELECT source, target, arg_min(path, d) AS path FROM hits GROUP BY source, target)
SELECT request_id, coalesce({shown}, '') AS path FROM asked LEFT JOIN best USING (source, target)"""


# ---- the queries --------------------------------------------------------------------------------

LINES = lines_of("text_files").strip()
TEXT = f"WITH {TEXT_FILES.strip()}, {LINES}"
GREP = f"file_path, line_no AS line_start, {stripped('text')} AS match_text, 'grep' AS source"
GRAPH = f"WITH {ENTITY_SYMBOLS.strip()}, {ENTITY_EDGES.strip()}"
CODE1 = f"WITH {code(1).strip()}"
CODE12 = f"WITH {code(1).strip()}, {code(2).strip()}, {CHANGED.strip()}, {AFTER.strip()}"

SYMBOL_EXACT = f"WITH {ENTITY_SYMBOLS.strip()}, {EXACT_REQUESTS}, {exact_tier()} SELECT {HIT} FROM exact"

USAGES_ALL = ranked(
    """SELECT e.to_qualified AS request_id, e.from_qualified, e.relation, s.file_path, s.line_start
FROM edges e JOIN symbols s ON s.qualified_name = e.from_qualified""",
    "request_id",
    "from_qualified, relation",
    20,
)


def _grep_in(of: str, pattern: str, limit: int, where: str = "TRUE") -> str:
    found = f"SELECT r.request_id, l.file_path, l.line_no AS line_start, {stripped('l.text')} AS match_text FROM {of} r JOIN lines l ON contains(l.text, {pattern}) WHERE {where}"
    return ranked(found, "request_id", "file_path, line_start", limit)


ORACLES: dict[str, str] = {
    "symbol_exact": SYMBOL_EXACT,
    "symbol_substring": f"WITH {ENTITY_SYMBOLS.strip()}, {SUBSTRING_REQUESTS}, {substring_tier('requests')} SELECT {HIT} FROM loose",
    "symbol_indexed": f"WITH {ENTITY_SYMBOLS.strip()}, {INDEXED_REQUESTS}, {substring_tier('requests')} SELECT {HIT} FROM loose",
    "symbol_substring_literal": f"WITH {ENTITY_SYMBOLS.strip()}, {SUBSTRING_REQUESTS}, {substring_tier('requests', False)} SELECT {HIT} FROM loose",
    "symbol_kind": f"""WITH {ENTITY_SYMBOLS.strip()}, {KIND_REQUESTS}, {exact_tier()}, {OPEN_AFTER_EXACT}, {substring_tier('open')}
SELECT {HIT} FROM exact UNION ALL SELECT {HIT} FROM loose""",
    "symbol_tiered": f"""WITH {ENTITY_SYMBOLS.strip()}, {TEXT_FILES.strip()}, {LINES}, {TIERED_REQUESTS}, {exact_tier()}, {OPEN_AFTER_EXACT},
{substring_tier('open')}, left_over AS (SELECT * FROM open WHERE request_id NOT IN (SELECT request_id FROM loose))
SELECT {HIT}, NULL AS match_text FROM exact UNION ALL SELECT {HIT}, NULL FROM loose
UNION ALL SELECT request_id, NULL, NULL, file_path, line_start, NULL, 'grep', match_text
FROM ({_grep_in('left_over', 'r.name', 10, "regexp_matches(l.file_path, '[.](py|js|ts|html)$')")})""",
    "hit_display": f"""{GRAPH}, {EXACT_REQUESTS}, {exact_tier()}
SELECT request_id, '[graph] ' || qualified_name || ' - ' || kind || ' @ ' || line_start AS line FROM exact
UNION ALL SELECT request_id, '[graph] ' || from_qualified || ' - ' || relation || ' @ ' || line_start FROM ({USAGES_ALL})""",
    "usages": f"{GRAPH} SELECT request_id, from_qualified, relation, file_path, line_start, 'graph' AS source FROM ({USAGES_ALL})",
    "usages_fallback": f"""{GRAPH}, {TEXT_FILES.strip()}, {LINES}, requests AS (
  SELECT 'passage.' || word AS request_id, word FROM {PASSAGE_WORDS}
  UNION ALL SELECT 'nation.' || n_nationkey, CAST(n_nationkey AS VARCHAR) FROM nation),
hits AS (SELECT * FROM ({USAGES_ALL}) WHERE request_id IN (SELECT request_id FROM requests)),
left_over AS (SELECT * FROM requests WHERE request_id NOT IN (SELECT request_id FROM hits))
SELECT request_id, from_qualified, relation, file_path, line_start, NULL AS match_text, 'graph' AS source FROM hits
UNION ALL SELECT request_id, NULL, NULL, file_path, line_start, match_text, 'grep' FROM ({_grep_in('left_over', 'r.word', 20)})""",
    "file_summary": f"""WITH {ENTITY_SYMBOLS.strip()},
paths AS (SELECT DISTINCT file_path FROM symbols)
SELECT p.file_path, regexp_replace(replace(p.file_path, '/', '.'), '([^.])[.][^.]*$', '\\1') AS module_path, CAST(NULL AS VARCHAR) AS summary,
  CASE s.kind WHEN 'class' THEN 'classes' WHEN 'function' THEN 'functions' WHEN 'import' THEN 'imports' END AS section,
  s.ordinal, s.name, 'graph' AS source
FROM paths p LEFT JOIN symbols s ON s.file_path = p.file_path AND s.kind IN ('class', 'function', 'import')""",
    "file_head": f"""WITH {TEXT_FILES.strip()}, parts AS (
  SELECT file_path, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS p FROM text_files WHERE NOT file_path LIKE '%.py'),
sized AS (SELECT file_path, p, len(p) - CASE WHEN p[len(p)] = '' THEN 1 ELSE 0 END AS n FROM parts)
SELECT file_path, CASE WHEN n >= 5 THEN 'File not indexed' ELSE 'Could not read file: ' END AS error,
  CASE WHEN n >= 5 THEN {' || chr(10) || '.join(stripped(f'p[{i}]') for i in range(1, 6))} END AS head,
  CASE WHEN n >= 5 THEN 'fallback' END AS source FROM sized
UNION ALL SELECT 'lost/doc_' || doc_id || '.py', 'Could not read file: [Errno 2] No such file or directory: ''lost/doc_' || doc_id || '.py''', NULL, NULL FROM labels""",
    "touches_model": f"""{GRAPH}
SELECT DISTINCT m.name AS request_id, CASE WHEN u.kind = 'view' THEN 'views' WHEN relation = 'registers' THEN 'admin'
  WHEN relation = 'handles_signal' THEN 'signals' ELSE 'references' END AS bucket, u.qualified_name, relation
FROM edges JOIN symbols m ON m.qualified_name = to_qualified AND m.kind = 'model' JOIN symbols u ON u.qualified_name = from_qualified""",
    "graph_stats": f"""{GRAPH} SELECT (SELECT count(DISTINCT file_path) FROM symbols) AS files, (SELECT count(*) FROM symbols) AS symbols,
  (SELECT count(*) FROM edges) AS edges""",
    "stats_by_kind": f"WITH {ENTITY_SYMBOLS.strip()} SELECT kind, count(*) AS n_symbols FROM symbols GROUP BY kind",
    "stats_by_language": f"""{TEXT} SELECT regexp_extract(file_path, '[.]([^./]*)$', 1) AS extension, count(DISTINCT file_path) AS n_files, count(*) AS n_symbols
FROM lines GROUP BY 1""",
    "corpus_lines": f"{TEXT} SELECT file_path, line_no, text FROM lines",
    "line_context": f"""WITH {TEXT_FILES.strip()}, asked AS (
  SELECT 'first ' || file_path AS request_id, file_path, 1 AS line, 0 AS radius FROM text_files
  UNION ALL SELECT 'third ' || file_path, file_path, 3, 2 FROM text_files
  UNION ALL SELECT 'deep ' || file_path, file_path, length(text) // 400, 4 FROM text_files
  UNION ALL SELECT 'beyond ' || file_path, file_path, 1000000, 30 FROM text_files
  UNION ALL SELECT 'lost ' || doc_id, 'lost/doc_' || doc_id || '.py', 1, 30 FROM labels),
parts AS (SELECT file_path, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS p FROM text_files),
ctx_lines AS (
  SELECT file_path, UNNEST(generate_series(1, n)) AS line_no, UNNEST(p[1:n]) AS text
  FROM (SELECT file_path, p, len(p) - CASE WHEN p[len(p)] = '' THEN 1 ELSE 0 END AS n FROM parts)),
found AS (
  SELECT a.request_id, string_agg(l.line_no || ': ' || regexp_replace(l.text, '{BLANK}+$', ''), chr(10) ORDER BY l.line_no) AS context
  FROM asked a JOIN ctx_lines l ON l.file_path = a.file_path AND l.line_no BETWEEN a.line - a.radius AND a.line + a.radius GROUP BY a.request_id)
SELECT a.request_id, coalesce(f.context, CASE WHEN t.file_path IS NULL THEN 'Error reading file: [Errno 2] No such file or directory: ''' || a.file_path || '''' ELSE '' END) AS context
FROM asked a LEFT JOIN found f USING (request_id) LEFT JOIN text_files t ON t.file_path = a.file_path""",
    "grep_lines": f"{TEXT} SELECT {GREP} FROM lines WHERE regexp_matches(text, '[aeiou]{{3}}n[a-z]*(tion|ing)')",
    "grep_first": f"{TEXT} SELECT {GREP} FROM lines WHERE contains(text, 'tion') ORDER BY file_path, line_no LIMIT 30",
    "grep_basic": f"{TEXT} SELECT {GREP} FROM lines WHERE regexp_matches(text, '^The*(re|nd){{1,2}}[a-z]* ')",
    "grep_include_exclude": f"""{TEXT} SELECT {GREP} FROM lines WHERE regexp_matches(text, '(ing|ment)[.,]')
AND ({BASE_NAME} LIKE '%.py' OR {BASE_NAME} LIKE 'page__.html')
AND NOT regexp_matches(file_path, '(^|/)f[qr]/') AND NOT regexp_matches(file_path, '(^|/)src1[^/]*/')""",
    "grep_many": f"""{TEXT}, asked AS (SELECT 'word ' || word AS request_id, word FROM {PASSAGE_WORDS})
SELECT request_id, file_path, line_start, match_text, 'grep' AS source FROM ({_grep_in('asked', 'r.word', 20)})""",
    "grep_expressions": f"""{TEXT}, asked AS (
  SELECT '^' || word || ' ' AS request_id, word || ' ' AS word, 0 AS kind FROM {PASSAGE_WORDS}
  UNION ALL SELECT word || '[,;] [a-z]*', word, 1 FROM {PASSAGE_WORDS} UNION ALL SELECT '[A-Z][0-9]', '', 2)
SELECT request_id, file_path, line_start, match_text, 'grep' AS source FROM (
  {_grep_in('asked', 'r.word', 5, "CASE r.kind WHEN 0 THEN starts_with(l.text, r.word) WHEN 1 THEN contains(l.text, r.word || ', ') OR contains(l.text, r.word || '; ') ELSE regexp_matches(l.text, '[A-Z][0-9]') END")})""",
    "listing_scan": f"""WITH {TEXT_FILES.strip()}, flat AS (SELECT {BASE_NAME} AS file_path, text FROM text_files)
SELECT file_path, length(text) AS n_chars FROM flat
WHERE file_path LIKE 'doc%' AND CAST(regexp_extract(file_path, 'doc_([0-9]+)', 1) AS BIGINT) IN (SELECT doc_id FROM labels)""",
    "tree_prune": """SELECT url AS file_path, page_id FROM pages
WHERE NOT regexp_matches(url, '^[^/]*/([^/]*/)*((fr|es)|[.][^/]*)/')""",
    "exclude_filter": "SELECT url AS file_path, page_id FROM pages WHERE NOT (contains(url, '.net') OR contains(url, '/fr/') OR contains(url, '?page'))",
    "exclude_defaults": """SELECT * FROM (SELECT c_mktsegment || '/' || c_name || '/' || lower(c_mktsegment) || '.py' AS file_path FROM customer)
WHERE NOT regexp_matches(file_path, '[.]git|node_modules|__pycache__|[.]venv|dist|build|[.]tox|[.]pytest_cache|migrations')""",
    "handler_dispatch": f"""WITH {TEXT_FILES.strip()} SELECT file_path, CASE WHEN file_path LIKE '%.py' THEN 'python'
WHEN file_path LIKE '%.js' OR file_path LIKE '%.html' THEN 'web' END AS handler FROM text_files""",
    "module_path": f"""WITH {TEXT_FILES.strip()}, p AS (SELECT file_path FROM text_files UNION ALL SELECT url FROM pages)
SELECT file_path, replace(regexp_replace(file_path, '([^/.][^/]*)[.][^/.]*$', '\\1'), '/', '.') AS module_path FROM p""",
    "content_hash": f"WITH {TEXT_FILES.strip()} SELECT file_path, sha256(text) AS content_hash FROM text_files",
    "extract_symbols": f"{CODE1} SELECT {SYMBOL_COLUMNS}, module, original_name FROM symbols1",
    "extract_edges": f"{CODE1} SELECT file_path, from_qualified, to_qualified, relation FROM raw1",
    "extract_rejects": "SELECT 'shop/draft_' || n_nationkey || '.py' AS file_path FROM nation",
    "retag_kinds": f"""WITH {ENTITY_SYMBOLS.strip()}, p AS (SELECT qualified_name, kind, file_path || CASE WHEN file_path LIKE 'nation#_1%' ESCAPE '#' THEN '/models.py'
  WHEN file_path LIKE 'nation#_2%' ESCAPE '#' THEN '/views.py' ELSE '/urls.py' END AS file_path FROM symbols)
SELECT qualified_name, file_path, CASE WHEN kind = 'class' AND contains(file_path, 'models.py') THEN 'model'
  WHEN kind IN ('class', 'function') AND contains(file_path, 'views.py') THEN 'view' ELSE kind END AS kind FROM p""",
    "dedupe_symbols": f"""WITH {ENTITY_SYMBOLS.strip()} SELECT file_path, name AS qualified_name, min(ordinal) AS ordinal, arg_min(kind, ordinal) AS kind
FROM symbols GROUP BY file_path, name""",
    "name_conflicts": f"""WITH {ENTITY_SYMBOLS.strip()} SELECT name AS qualified_name, count(DISTINCT file_path) AS n_files FROM symbols
GROUP BY name HAVING count(DISTINCT file_path) > 1""",
    "resolve_edges": f"{CODE1} {resolved('raw1', 'symbols1')}",
    "resolve_as_indexed": f"{CODE1} {resolved_in_order('raw1', 'symbols1')}",
    "changed_files": f"{CODE12} SELECT * FROM changed",
    "upsert_files": f"""{CODE12} SELECT file_path, replace(regexp_replace(file_path, '[.]py$', ''), '/', '.') AS module_path,
  CAST(coalesce(n, 0) AS INTEGER) AS symbol_count, sha256(content) AS content_hash
FROM files_after LEFT JOIN (SELECT file_path, count(*) AS n FROM symbols_after GROUP BY 1) USING (file_path) WHERE file_path LIKE '%.py'""",
    "replace_symbols": f"{CODE12} SELECT {SYMBOL_COLUMNS} FROM symbols_after",
    "update_edges": f"{CODE12} {resolved('raw_after', 'symbols_after')}",
    "cascade_edges": f"""{CODE12}, gone AS (SELECT qualified_name FROM symbols1 WHERE file_path IN (SELECT file_path FROM changed)),
before AS ({resolved_in_order('raw1', 'symbols1')}),
visible AS (SELECT *, CASE WHEN file_path IN (SELECT file_path FROM changed) THEN file_path ELSE '' END AS seen_from FROM symbols_after),
new_raw AS (SELECT * FROM raw2 WHERE file_path IN (SELECT file_path FROM changed))
SELECT * FROM before WHERE from_qualified NOT IN (FROM gone) AND to_qualified NOT IN (FROM gone)
UNION {resolved_in_order('new_raw', 'visible', 'seen_from')}""",
    "run_summary": f"{CODE12} SELECT (SELECT count(*) FROM files2) AS scanned, (SELECT count(*) FROM changed) AS indexed",
    "shortest_paths": paths(
        """SELECT 'customer.' || c_custkey AS request_id, 'customer.' || c_custkey AS source, 'region.0' AS target FROM customer
  UNION ALL SELECT 'supplier.' || s_suppkey, 'supplier.' || s_suppkey, 'region.0' FROM supplier
  UNION ALL SELECT 'planet.' || r_regionkey, 'planet.' || r_regionkey, 'region.0' FROM region""",
        3,
    ),
    "shortest_cycle": paths(
        "SELECT 'supplier.' || s_suppkey AS request_id, 'supplier.' || s_suppkey AS source, 'supplier.' || s_suppkey AS target FROM supplier", 3
    ),
    "shortest_deep": paths(
        """SELECT source || ' to ' || target AS request_id, source, target FROM (
    SELECT 'part.' || p_partkey AS source, 'nation.' || c_nationkey AS target FROM part JOIN customer ON c_custkey = p_partkey
    UNION ALL SELECT 'supplier.' || s_suppkey, 'supplier.' || (s_suppkey + 1) FROM supplier
    UNION ALL SELECT 'supplier.' || s_suppkey, 'customer.' || s_suppkey FROM supplier)""",
        6,
    ),
    "semantic_topk": """WITH dims AS (SELECT label, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
q AS (SELECT label, list(x ORDER BY d) AS e FROM (SELECT label, d, avg(x) AS x FROM dims GROUP BY label, d) GROUP BY label),
s AS (SELECT q.label, vec_id, round(list_cosine_similarity(e, CAST(embedding AS DOUBLE[])), 12) AS score FROM q CROSS JOIN embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT 'label ' || label AS request_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
    "feed_update": """SELECT 'user_' || user_id AS file_path, arg_max(event_type || props, (ts, event_id)) AS content,
  arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""",
}
ORACLES["feed_batch"] = ORACLES["feed_update"]
