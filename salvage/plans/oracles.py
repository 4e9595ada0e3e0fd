"""The registered queries as plain SQL over the given tables, to check results against."""

from __future__ import annotations

from salvage.plans.shapes import DECLARED_KEYS, DECLARED_LINKS, GIVEN, UNKNOWN_KEYS, shape_sql

# The given tables' columns: name and whether text, integer or anything else.
COLUMNS = {
    "region": "r_regionkey:int r_name:text",
    "nation": "n_nationkey:int n_name:text n_regionkey:int",
    "customer": "c_custkey:int c_name:text c_nationkey:int c_acctbal:any c_mktsegment:text",
    "supplier": "s_suppkey:int s_name:text s_nationkey:int s_acctbal:any",
    "part": "p_partkey:int p_name:text p_brand:text p_type:text p_size:int p_retailprice:any",
    "orders": "o_orderkey:int o_custkey:int o_orderstatus:text o_totalprice:any o_orderdate:any o_orderpriority:text",
    "lineitem": "l_orderkey:int l_partkey:int l_suppkey:int l_linenumber:int l_quantity:any l_extendedprice:any "
    "l_discount:any l_tax:any l_returnflag:text l_linestatus:text l_shipdate:any",
    "events": "event_id:int ts:any user_id:int event_type:text value:any props:text",
    "documents": "doc_id:int text:text lang:text source:text n_chars:int",
    "embeddings": "vec_id:int embedding:any label:int",
    "pages": "page_id:int url:text html:text",
    "benchmark": "item_id:int text:text",
    "labels": "doc_id:int quality:int toxic:int",
    "conversations": "conv_id:int turn:int role:text text:text",
}
KEYS = [
    # table, key, columns, unique, primary
    ("region", "pk_region", "r_regionkey", True, True),
    ("nation", "pk_nation", "n_nationkey", True, True),
    ("customer", "pk_customer", "c_custkey", True, True),
    ("supplier", "pk_supplier", "s_suppkey", True, True),
    ("part", "pk_part", "p_partkey", True, True),
    ("orders", "pk_orders", "o_orderkey", True, True),
    ("lineitem", "pk_lineitem", "l_orderkey, l_linenumber", True, True),
    ("lineitem", "ix_lineitem_part", "l_partkey", False, False),
    ("events", "pk_events", "event_id", True, True),
    ("documents", "pk_documents", "doc_id", True, True),
    ("documents", "uq_documents_text", "text", True, False),
    ("pages", "pk_pages", "page_id", True, True),
    ("benchmark", "pk_benchmark", "item_id", True, True),
    ("labels", "pk_labels", "doc_id", True, True),
    ("embeddings", "pk_embeddings", "vec_id", True, True),
    ("conversations", "pk_conversations", "conv_id, turn", True, True),
]
RELATIONSHIPS = [
    ("nation_region", "nation", "n_regionkey", "region", "r_regionkey"),
    ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier_nation", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders_customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels_documents", "labels", "doc_id", "documents", "doc_id"),
    ("documents_labels", "documents", "doc_id", "labels", "doc_id"),
]


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _columns(table: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in COLUMNS[table].split()]


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({shape_sql(name)})" for name in names) + "\n"


# Building blocks over an ``sql`` column.
LOWER = "lower(coalesce(sql, ''))"
TRIMMED = r"regexp_replace(lower(coalesce(sql, '')), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
TYPE = f"""CASE WHEN starts_with({TRIMMED}, 'select') THEN 'select' WHEN starts_with({TRIMMED}, 'insert') THEN 'append'
WHEN starts_with({TRIMMED}, 'update') THEN 'update' WHEN starts_with({TRIMMED}, 'delete') THEN 'delete'
WHEN starts_with({TRIMMED}, 'transform') THEN 'crosstab' WHEN starts_with({TRIMMED}, 'create table') THEN 'make-table'
WHEN starts_with({TRIMMED}, 'parameter') THEN 'parameter' WHEN contains({TRIMMED}, ' union ') THEN 'union'
WHEN starts_with({TRIMMED}, 'pass-through') THEN 'pass-through'
WHEN regexp_matches({TRIMMED}, '^(create|alter|drop) ') THEN 'ddl' ELSE 'unknown' END"""
HAS_COND = rf"regexp_matches({LOWER}, 'iif\(|nz\(|switch\(')"
HAS_DOMAIN = rf"regexp_matches({LOWER}, 'dlookup\(|dsum\(|dcount\(')"
HAS_WILD = f"(contains({LOWER}, ' like ') AND contains({LOWER}, '*'))"
HAS_CALL = rf"regexp_matches({LOWER}, 'iif\(|nz\(|dlookup\(|format\$\(|date\(\)|now\(\)')"
WARNINGS = f"""list_filter([CASE WHEN {HAS_COND} THEN 'Access-specific conditional function detected' END,
CASE WHEN {HAS_DOMAIN} THEN 'Domain aggregate function detected' END,
CASE WHEN contains({LOWER}, '#') THEN 'Access date literal syntax detected' END,
CASE WHEN {HAS_WILD} THEN 'Access wildcard syntax detected' END], lambda x: x IS NOT NULL)"""
NAMES = r"list_transform(regexp_extract_all(coalesce(sql, ''), '(?i)(from|join|update|into)\s+\[?([\p{L}\p{N}_ ]+)\]?', 2), lambda x: trim(x))"
DEPENDENCIES = f"list_filter({NAMES}, lambda x, i: list_position({NAMES}, x) = i)"
BLANK = r"(sql IS NULL OR regexp_matches(sql, '^\s*$'))"
CONFIDENCE = f"""CASE WHEN {BLANK} THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), CAST(0.45 AS DOUBLE)
- CASE WHEN {HAS_CALL} THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
- CASE WHEN {HAS_WILD} THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) END"""
TRANSLATED = f"""CASE WHEN NOT {BLANK} THEN replace(replace(sql, '[', '"'), ']', '"') END"""
T_WARNINGS = f"""CASE WHEN {BLANK} THEN ['Translation disabled or empty SQL'] ELSE
list_filter([CASE WHEN {HAS_CALL} THEN 'Access-specific function detected; translation left conservative' END,
CASE WHEN {HAS_WILD} THEN 'Wildcard semantics may differ outside Access' END], lambda x: x IS NOT NULL) END"""


def _slug(text: str) -> str:
    dashed = rf"regexp_replace(nfc_normalize({text}), '[^\p{{L}}\p{{N}}]+', '-', 'g')"
    return f"coalesce(nullif(lower(trim({dashed}, '-')), ''), 'unnamed')"


def _extension(name: str) -> str:
    return f"CASE WHEN contains({name}, '.') THEN lower(regexp_extract({name}, '[^.]*$')) ELSE 'unknown' END"


DUMP_CLASS = """CASE WHEN contains(upper(file_name), 'SYS') THEN 'likely-front-end'
WHEN contains(upper(file_name), 'TBL') THEN 'likely-data' ELSE 'unknown' END"""
HEADLINE = """CASE WHEN contains(upper(file_name), 'SYS') THEN 'This file looks like a front-end/control database'
WHEN contains(upper(file_name), 'TBL') THEN 'This file looks like a data database'
ELSE 'Database type is not obvious from the filename' END"""
SIBLINGS = f"""
classed AS (SELECT *, {DUMP_CLASS} AS classification, {HEADLINE} AS headline FROM dump_files),
asked AS (SELECT *, CASE classification
WHEN 'likely-front-end' THEN nullif(replace(replace(file_name, 'SYS', 'TBL'), 'sys', 'tbl'), file_name)
WHEN 'likely-data' THEN nullif(replace(replace(file_name, 'TBL', 'SYS'), 'tbl', 'sys'), file_name) END AS wanted FROM classed),
siblings AS (SELECT a.* EXCLUDE (wanted), f.file_name AS suggested_alternative, CASE classification
WHEN 'likely-front-end' THEN CASE WHEN f.file_name IS NULL
THEN 'Front-end databases often point at linked tables. Keep an eye out for stale paths.'
ELSE 'If extraction fails because of linked tables, try the sibling data file: ' || f.file_name END
WHEN 'likely-data' THEN 'This is the best input when you want cross-platform schema and table export.'
ELSE 'Use the preflight results below to decide whether this is a front-end shell or a data file.' END AS recommendation
FROM asked a LEFT JOIN dump_files f ON f.dir = a.dir AND f.file_name = a.wanted)"""
RESOLVED = r"""
resolved AS (SELECT l.*, coalesce(d.dir || '/' || d.file_name, b.dir || '/' || b.file_name) AS resolved_path,
CASE WHEN d.dir IS NOT NULL THEN 'direct' WHEN b.dir IS NOT NULL THEN 'remapped' ELSE 'unresolved' END AS resolution
FROM links l LEFT JOIN dump_files d ON d.dir || '/' || d.file_name = l.linked_path
LEFT JOIN dump_files b ON b.dir = l.source_dir AND b.file_name = regexp_extract(l.linked_path, '[^/\\]*$'))"""
STALE = r"""(contains(message, 'C:\') AND (contains(message, '.mdb') OR contains(message, '.accdb')))"""
STALE_ON_OPEN = "Database open failed because a linked Access file points to a Windows-only path that is not present here"
STALE_PATH = "This looks like a front-end database with a stale linked-table path"
ISO = "replace(CAST({0} AS VARCHAR), ' ', 'T') || 'Z'"
ORDER_COLUMNS = f"""CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
CAST(o_totalprice AS VARCHAR) AS o_totalprice, {ISO.format('o_orderdate')} AS o_orderdate, o_orderpriority"""

UNRECOVERED_REASON = (
    "Cross-platform file parsing ran, but these artifacts were not recoverable without helper-backed extraction"
)
UNRECOVERED = _union(
    f"SELECT '{kind}', '*', 'UNSUPPORTED', CAST(0 AS DOUBLE), '{UNRECOVERED_REASON}', NULL, NULL, NULL, NULL, NULL"
    for kind in ("forms", "reports", "macros", "vba")
)
UNRECOVERED_KINDS = "(VALUES ('forms'), ('reports'), ('macros'), ('vba')) u(kind)"
COVERAGE_HEAD = '(category, name, status, confidence, reason, "schemaPath", "rowCount", type, dialect, "fromTable")'
LISTED_TABLES = """SELECT 'table', name, CASE WHEN row_count < 0 THEN 'FAILED' ELSE 'SUCCESS' END,
CAST(CASE WHEN row_count < 0 THEN 0 ELSE 0.95 END AS DOUBLE),
CASE WHEN row_count < 0 THEN 'Table could not be read' ELSE 'Schema and row export completed' END,
'schema/tables/slug=' || slug, CAST(row_count AS VARCHAR), NULL, NULL, NULL FROM """
QUERY_ROWS = f"""SELECT 'query', name, 'SUCCESS', CAST(0.85 AS DOUBLE),
'Access SQL preserved and normalized query model written', NULL, NULL, {TYPE}, NULL, NULL FROM saved_queries"""
COVERAGE = f"""
coverage{COVERAGE_HEAD} AS ({LISTED_TABLES} lake_tables
UNION ALL SELECT 'relationship', name, 'SUCCESS', CAST(0.9 AS DOUBLE), 'Relationship extracted',
NULL, NULL, NULL, NULL, from_table FROM lake_relationships
UNION ALL {QUERY_ROWS}
UNION ALL SELECT 'query-translation', name, CASE WHEN {CONFIDENCE} >= 0.5 THEN 'SUCCESS' ELSE 'PARTIAL' END,
{CONFIDENCE}, 'SQL translation generated conservatively', NULL, NULL, NULL, 'POSTGRES', NULL FROM saved_queries
UNION ALL {UNRECOVERED})"""
MISSING = """
missing AS (SELECT 'table' AS category, name, 'schema/tables/slug=' || slug AS path FROM lake_tables t
WHERE NOT EXISTS (SELECT 1 FROM lake_tables w WHERE w.slug = t.slug AND w.column_count % 9 <> 0))"""
DIAGNOSTICS = rf"""
diagnostics AS (SELECT CASE resolution WHEN 'remapped' THEN 'LINKED_DB_REMAP' ELSE 'DATABASE_OPEN_FAILED' END AS code,
CASE resolution WHEN 'remapped' THEN 'warning' ELSE 'error' END AS severity,
CASE resolution WHEN 'remapped' THEN 'Linked database path was remapped to a local sibling file'
ELSE 'Linked database could not be resolved: ' || linked_path END AS message, 'linked-table' AS object_type,
regexp_extract(linked_path, '[^/\\]*$') AS object_name, resolved_path AS details, NULL AS "count"
FROM resolved WHERE resolution <> 'direct'
UNION ALL SELECT 'QUERY_TRANSLATION_WARNING', 'warning', unnest({T_WARNINGS}), 'query', name, NULL, NULL FROM saved_queries
UNION ALL SELECT 'VALIDATION_MISSING_ARTIFACTS', 'warning', 'Validation found missing referenced artifacts: ' || count(*),
'validation', 'artifacts', NULL, CAST(count(*) AS VARCHAR) FROM missing HAVING count(*) > 0
UNION ALL SELECT 'FULL_FIDELITY_UNAVAILABLE', 'warning',
'Full-fidelity extraction requested but Microsoft Access automation is unavailable', 'environment', 'windows-helper', NULL, NULL)"""
PROPERTIES = """
properties AS (SELECT source, scope, key, json_extract_string(props, '$.' || key) AS value FROM (
SELECT 'db' || CAST(user_id AS VARCHAR) AS source, event_type AS scope, props, unnest(json_keys(props)) AS key FROM events))"""
MODEL = f"""SELECT query_id, name, {_slug('name')} AS slug, {TYPE} AS type, coalesce(sql, '') AS sql, 0 AS n_parameters,
array_to_string({DEPENDENCIES}, '|') AS dependencies, array_to_string({WARNINGS}, '|') AS warnings FROM saved_queries"""
ASCII_ONLY = r"regexp_replace(text, '[^\x00-\x7F]', '?', 'g')"


def _tagged(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(length({text}) AS VARCHAR) || ':' || {text}, '~')"


def _fingerprint(source: str, columns: list[str]) -> str:
    row = " || ".join(_tagged(c) for c in columns)
    return f"""SELECT count(*) AS n, CAST(coalesce(sum(CAST('0x' || substr(sha256({row}), 1, 15) AS BIGINT)), 0) AS VARCHAR) AS h
FROM {source}"""


def _column_inventory() -> str:
    parts = []
    for table in GIVEN:
        for position, (name, kind) in enumerate(_columns(table), start=1):
            length = f"max(strlen({name}))" if kind == "text" else "max(NULL)"
            numbered = f"count(*) > 0 AND count(DISTINCT {name}) = count(*)" if kind == "int" else "false"
            parts.append(
                f"SELECT '{table}' AS \"table\", {position} AS position, '{name}' AS name, "
                f"CAST({length} AS BIGINT) AS length, {numbered} AS auto_number FROM {table}"
            )
    return _union(parts)


def _key_audit() -> str:
    parts = []
    for table, key, columns, unique, primary in KEYS:
        null = " OR ".join(f"{c.strip()} IS NULL" for c in columns.split(","))
        dup = f"count(*) FILTER (NOT ({null})) - count(DISTINCT ({columns})) FILTER (NOT ({null}))"
        holds = "true" if not unique else f"{dup} = 0" + (f" AND count(*) FILTER ({null}) = 0" if primary else "")
        parts.append(
            f"SELECT '{table}' AS \"table\", '{key}' AS key, count(*) AS n_rows, {dup} AS n_dup, "
            f"count(*) FILTER ({null}) AS n_null, {holds} AS holds FROM {table}"
        )
    return _union(parts)


def _relationship_audit() -> str:
    parts = []
    for name, child, column, parent, target in RELATIONSHIPS:
        orphan = f"(c.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{target} = c.{column}))"
        parts.append(
            f"SELECT '{name}' AS name, count(*) AS n_child, count(*) FILTER (o) AS n_orphan, "
            f"count(*) FILTER (o) = 0 AS holds FROM (SELECT {orphan} AS o FROM {child} c)"
        )
    return _union(parts)


def _table_schemas() -> str:
    parts = []
    for table in GIVEN:
        columns = ",".join(name for name, _ in _columns(table))
        indexes = ",".join(sorted(key for t, key, *_ in KEYS if t == table)) or None
        shown = f"'{indexes}'" if indexes else "NULL"
        parts.append(
            f"SELECT '{table}' AS name, '{table}' AS slug, false AS system_object, count(*) AS row_count, "
            f"'{columns}' AS columns, {shown} AS indexes FROM {table}"
        )
    return _union(parts)


def _unpacked(queries: bool) -> str:
    rows = [
        f"SELECT 'table', '{t}', 'SUCCESS', CAST(0.95 AS DOUBLE), 'Schema and row export completed', "
        f"'schema/tables/slug={t}', CAST(count(*) AS VARCHAR), NULL, NULL, NULL FROM {t}"
        for t in GIVEN
    ]
    rows += [
        f"SELECT 'relationship', '{name}', 'SUCCESS', CAST(0.9 AS DOUBLE), 'Relationship extracted', "
        f"NULL, NULL, NULL, NULL, '{child}'"
        for name, child, *_ in RELATIONSHIPS
    ]
    if queries:
        rows.append(QUERY_ROWS)
    return f"{_with('saved_queries')}, coverage{COVERAGE_HEAD} AS ({_union([*rows, UNRECOVERED])}) SELECT * FROM coverage"


LAKE_RELATIONSHIPS = "SELECT 'db' || CAST(CAST(substr(name, 4) AS BIGINT) % 100 AS VARCHAR) AS source_id FROM lake_relationships"
LAKE_ENTRIES = f"""entries AS (
SELECT source_id, CASE WHEN row_count < 0 THEN 'failed' ELSE 'success' END AS status FROM lake_tables
UNION ALL SELECT 'db' || CAST((query_id % 100 + 100) % 100 AS VARCHAR), unnest(['success',
CASE WHEN {CONFIDENCE} >= 0.5 THEN 'success' ELSE 'partial' END]) FROM saved_queries
UNION ALL SELECT source_id, 'success' FROM ({LAKE_RELATIONSHIPS})
UNION ALL SELECT source_id, unnest(['unsupported', 'unsupported', 'unsupported', 'unsupported'])
FROM (SELECT DISTINCT source_id FROM lake_tables))"""

LAKE_TABLES = [
    *(("one", t, "parquet", "true") for t in ("nation", "customer", "orders", "events")),
    ("two", "customer", "parquet", "c_custkey % 2 = 0"), ("two", "conversations", "csv", "true"), ("two", "part", "json", "true"),
]



def _lake_run() -> str:
    rows = [
        f"SELECT '{source}' AS source_id, 'table' AS category, '{t}' AS name, 'SUCCESS' AS status, CAST(0.95 AS DOUBLE) AS confidence, "
        f"CAST(count(*) AS VARCHAR) AS \"rowCount\", true AS hashed FROM {t} WHERE {kept}"
        for source, t, _, kept in LAKE_TABLES
    ]
    rows += [
        "SELECT 'two', 'table', 'broken', 'FAILED', 0.0, '-1', false",
        "SELECT CASE WHEN query_id % 2 = 0 THEN 'one' ELSE 'two' END, 'query', name, 'SUCCESS', 0.85, NULL, false FROM saved_queries",
        "SELECT CASE WHEN CAST(substr(name, 4) AS BIGINT) % 2 = 0 THEN 'one' ELSE 'two' END, 'relationship', name, 'SUCCESS', 0.9, NULL, false "
        "FROM lake_relationships",
        "SELECT s, unnest(['forms', 'reports', 'macros', 'vba']), '*', 'UNSUPPORTED', 0.0, NULL, false FROM (VALUES ('one'), ('two')) v(s)",
    ]
    return f"{_with('saved_queries', 'lake_relationships')} {_union(rows)}"


def _unpack_translated() -> str:
    nulls = ", ".join(["NULL"] * 5)
    rows = [
        f"""SELECT 'table' AS category, '{t}' AS name, 'SUCCESS' AS status, CAST(0.95 AS DOUBLE) AS confidence,
'Schema and row export completed' AS reason, '{t}' AS slug, 'schema/tables/slug={t}' AS "schemaPath",
CAST(count(*) AS VARCHAR) AS "rowCount", NULL AS type, NULL AS dialect, NULL AS "fromTable", NULL AS "toTable", NULL AS dependencies,
NULL AS "fromColumns", NULL AS "toColumns", true AS hashed FROM {t}"""
        for t in GIVEN
    ]
    rows += [
        f"SELECT 'relationship', '{name}', 'SUCCESS', 0.9, 'Relationship extracted', {nulls}, '{child}', '{parent}', NULL, "
        f"'{ours}', '{theirs}', NULL"
        for name, child, ours, parent, theirs in RELATIONSHIPS
    ]
    rows += [
        f"SELECT 'query', name, 'SUCCESS', 0.85, 'Access SQL preserved and normalized query model written', NULL, NULL, NULL, {TYPE}, "
        f"NULL, NULL, NULL, array_to_string({DEPENDENCIES}, '|'), NULL, NULL, NULL FROM saved_queries",
        f"SELECT 'query-translation', name, CASE WHEN {CONFIDENCE} >= 0.5 THEN 'SUCCESS' ELSE 'PARTIAL' END, {CONFIDENCE}, "
        f"'SQL translation generated conservatively', NULL, NULL, NULL, NULL, 'POSTGRES', {nulls}, NULL FROM saved_queries",
        f"SELECT kind, '*', 'UNSUPPORTED', 0.0, '{UNRECOVERED_REASON}', {nulls}, {nulls}, NULL FROM {UNRECOVERED_KINDS}",
    ]
    return f"{_with('saved_queries')} {_union(rows)}"


def _unpack_with_failures() -> str:
    rows = [
        f"SELECT 'coverage' AS ledger, 'table' AS kind, '{t}' AS name, 'SUCCESS' AS status, CAST(0.95 AS DOUBLE) AS confidence, "
        f"'Schema and row export completed' AS reason FROM {t} HAVING count(*) >= 0"
        for t in ("nation", "orders")
    ]
    rows += [
        "SELECT 'coverage', 'table', 'broken', 'FAILED', 0.0, 'Table could not be read'",
        "SELECT 'coverage', 'relationship', 'orders_customer', 'SUCCESS', 0.9, 'Relationship extracted'",
        "SELECT 'coverage', 'query', name, 'SUCCESS', 0.85, 'Access SQL preserved and normalized query model written' FROM saved_queries",
        f"SELECT 'coverage', 'query-translation', name, CASE WHEN {CONFIDENCE} >= 0.5 THEN 'SUCCESS' ELSE 'PARTIAL' END, {CONFIDENCE}, "
        "'SQL translation generated conservatively' FROM saved_queries",
        f"SELECT 'coverage', kind, '*', 'UNSUPPORTED', 0.0, '{UNRECOVERED_REASON}' FROM {UNRECOVERED_KINDS}",
        "SELECT 'diagnostics', code, object_name, severity, NULL, message FROM diagnostics WHERE code <> 'VALIDATION_MISSING_ARTIFACTS'",
        "SELECT 'diagnostics', 'PREFLIGHT_SCAN_FAILED', 'broken', 'warning', NULL, NULL",
        "SELECT 'diagnostics', 'AUDIT_NOT_POSSIBLE', 'orders_customer', 'warning', NULL, 'A table or column it names is not there'",
        "SELECT 'diagnostics', 'KEY_DOES_NOT_HOLD', 'uq_orders_customer', 'warning', NULL, 'The data does not keep to uq_orders_customer' "
        "FROM orders HAVING count(o_custkey) > count(DISTINCT o_custkey)",
    ]
    return f"{_with('dump_files', 'links', 'saved_queries', 'lake_tables')}, {RESOLVED}, {MISSING}, {DIAGNOSTICS} {_union(rows)}"


def _lake_key_audit() -> str:
    rows = []
    for source, table, name, columns, primary in DECLARED_KEYS:
        kept = next(k for s, t, _, k in LAKE_TABLES if (s, t) == (source, table))
        keys = ", ".join(columns)
        missing = " OR ".join(f"{c} IS NULL" for c in columns)
        holds = "n_dup = 0 AND n_null = 0" if primary else "n_dup = 0"
        rows.append(f"""SELECT '{source}' AS source_id, '{table}' AS "table", '{name}' AS key, n_rows, n_dup, n_null, {holds} AS holds,
CAST(NULL AS VARCHAR) AS reason FROM (SELECT count(*) AS n_rows, count(*) FILTER ({missing}) AS n_null, CAST(count(*) FILTER (NOT ({missing}))
- (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {table} WHERE ({kept}) AND NOT ({missing}))) AS BIGINT) AS n_dup
FROM {table} WHERE {kept})""")
    rows += [
        f"SELECT '{source}', '{table}', '{name}', NULL, NULL, NULL, NULL, 'A table or column it names is not there'"
        for source, table, name, *_ in UNKNOWN_KEYS
    ]
    return _union(rows)


def _lake_relationship_audit() -> str:
    rows = []
    for source, name, child, parent, (a,), (b,) in DECLARED_LINKS:
        ours, theirs = (next(k for s, t, _, k in LAKE_TABLES if (s, t) == (source, table)) for table in (child, parent))
        rows.append(f"""SELECT '{source}' AS source_id, '{name}' AS name, n_child, n_orphan, n_orphan = 0 AS holds,
CAST(NULL AS VARCHAR) AS reason FROM (SELECT count(*) AS n_child, count(*) FILTER ({a} IS NOT NULL AND NOT EXISTS
(SELECT 1 FROM {parent} p WHERE ({theirs}) AND p.{b} = c.{a})) AS n_orphan FROM {child} c WHERE {ours})""")
    return _union(rows)


ORACLES = {
    "dump_classes": f"{_with('dump_files')} SELECT *, {DUMP_CLASS} AS classification, {HEADLINE} AS headline FROM dump_files",
    "dump_siblings": f"""{_with('dump_files')}, {SIBLINGS}
SELECT source_id, dir, file_name, suggested_alternative, recommendation FROM siblings""",
    "link_resolution": f"{_with('dump_files', 'links')}, {RESOLVED} SELECT * FROM resolved",
    "stale_links": f"""{_with('failures')} SELECT *, {STALE} AS is_stale_windows_path,
CASE WHEN {STALE} THEN 'PREFLIGHT_LINKED_PATH_UNAVAILABLE' ELSE 'PREFLIGHT_SCAN_FAILED' END AS code,
CASE WHEN {STALE} THEN '{STALE_PATH}' ELSE message END AS scan_message,
CASE WHEN {STALE} THEN 'LINKED_DB_PATH_UNAVAILABLE' END AS extract_code,
CASE WHEN {STALE} THEN '{STALE_ON_OPEN}' ELSE message END AS extract_message FROM failures""",
    "table_inventory": _union(
        f"SELECT '{t}' AS name, '{t}' AS slug, false AS system_object, false AS linked, count(*) AS row_count, "
        f"{len(_columns(t))} AS column_count FROM {t}"
        for t in GIVEN
    ),
    "column_inventory": _column_inventory(),
    "query_inventory": rf"""{_with('saved_queries')} SELECT query_id, name, {_slug('name')} AS slug, {TYPE} AS type,
CASE WHEN regexp_matches(sql, '(?is)^\s*parameters\s+[^;]+;') THEN
len(string_split(regexp_extract(sql, '(?is)^\s*parameters\s+([^;]*);', 1), ',')) ELSE 0 END AS parameter_count,
coalesce(sql, '') AS sql FROM saved_queries""",
    "preflight": f"""{_with('dump_files', 'lake_tables', 'failures', 'saved_queries')}, {SIBLINGS},
t AS (SELECT source_id, count(*) AS n FROM lake_tables GROUP BY 1),
q AS (SELECT 'db' || CAST((query_id % 60 + 60) % 60 AS VARCHAR) AS source_id, count(*) AS n FROM saved_queries GROUP BY 1),
w AS (SELECT source_id, min(CASE WHEN {STALE} THEN '{STALE_PATH}' ELSE message END) AS first_warning FROM failures GROUP BY 1)
SELECT s.*, coalesce(t.n, 0) AS table_count, coalesce(q.n, 0) AS query_count, w.source_id IS NULL AS openable, first_warning
FROM siblings s LEFT JOIN t USING (source_id) LEFT JOIN q USING (source_id) LEFT JOIN w USING (source_id)""",
    "normalize_events": f"SELECT event_id, {ISO.format('ts')} AS ts, user_id, event_type, value, props FROM events",
    "normalize_embeddings": """SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS position, CAST(embedding[i] AS DOUBLE) AS value
FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "normalize_nested": f"""SELECT CAST(event_id AS VARCHAR) AS event_id,
'["' || base64(encode(event_type)) || '","' || base64(encode(props)) || '"]' AS blobs,
'{{"' || CAST(user_id AS VARCHAR) || '":"' || {ISO.format('ts')} || '"}}' AS seen,
'{{"ts":"' || {ISO.format('ts')} || '","whole":' || CAST(CAST(trunc(value) AS INTEGER) AS VARCHAR) || '}}' AS pair FROM events""",
    "stringify_orders": f"SELECT {ORDER_COLUMNS} FROM orders",
    "safe_columns": """SELECT o_orderkey AS order_key, o_custkey AS order_key_2, o_orderstatus AS _1st_status,
o_totalprice AS total, o_orderdate AS "Total_2", o_orderpriority AS order_key_2_2 FROM orders""",
    "slug_parts": f"""SELECT p_partkey AS id, {_slug("p_type || ' / ' || p_name || ' / ' || p_brand")} AS slug FROM part
UNION ALL SELECT -1 - doc_id, {_slug('text')} FROM documents""",
    "selected_tables": f"""{_with('lake_tables', 'table_selection')}
SELECT * FROM lake_tables WHERE name IN (SELECT name FROM table_selection)""",
    "visible_tables": f"{_with('lake_tables')} SELECT * FROM lake_tables WHERE NOT system_object",
    "relationships_in_scope": f"""{_with('lake_relationships', 'end_selection')} SELECT name, from_table, to_table
FROM lake_relationships WHERE from_table IN (SELECT name FROM end_selection) AND to_table IN (SELECT name FROM end_selection)""",
    "redact_documents": r"""SELECT doc_id, regexp_replace(regexp_replace(
'PassWord=' || source || ';User ID=' || lang || ';' || text || ';pwd=x' || text,
'(?i)(password|pwd)=([^;]+)', '\1=<redacted>', 'g'), '(?i)(user id|uid)=([^;]+)', '\1=<redacted>', 'g') AS text FROM documents""",
    "csv_roundtrip": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, nullif(lang, '') AS lang,
nullif(source, '') AS source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents""",
    "csv_bom_roundtrip": """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, nullif(role, '') AS role,
nullif(text, '') AS text FROM conversations""",
    # No character of the given texts beyond ASCII is in the character set.
    "csv_charset_roundtrip": f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, {ASCII_ONLY} AS text, lang, source,
CAST(n_chars AS VARCHAR) AS n_chars FROM documents""",
    "json_roundtrip": f"SELECT event_id, {ISO.format('ts')} AS ts, user_id, event_type, value, props FROM events",
    "parquet_roundtrip": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name AS c_custkey_2, CAST(c_nationkey AS VARCHAR) AS __,
CAST(c_acctbal AS VARCHAR) AS field, c_mktsegment AS c_custkey_3 FROM customer""",
    "export_ledger": _union(
        f"SELECT '{t}' AS \"table\", '{t}' AS slug, '{f}' AS format, 'data/{t}.{f.lower()}' AS path, "
        f"'SUCCESS' AS status, count(*) AS row_count, CAST(NULL AS VARCHAR) AS reason FROM {t}"
        for t in GIVEN
        for f in ("CSV", "JSON", "PARQUET")
    ),
    "export_checksums": _union(
        f"SELECT '{t}' AS \"table\", '{f}' AS format, true AS agrees, count(*) >= 0 AS has_bytes FROM {t}"
        for t in GIVEN
        for f in ("CSV", "JSON", "PARQUET")
    ),
    "dump_hashes": _union(
        f"SELECT '{t}' AS table_name, true AS hash_form, true AS agrees, count(*) >= 0 AS same_size FROM {t}" for t in GIVEN
    ),
    "lake_tables_inventory": _union(
        f"SELECT '{source}' AS source_id, '{t}' AS name, '{t}' AS slug, '{kind}' AS format, count(*) AS row_count, "
        f"true AS has_bytes, CAST(NULL AS VARCHAR) AS reason FROM {t} WHERE {kept}"
        for source, t, kind, kept in LAKE_TABLES
    ),
    "lake_columns": _union(
        f"SELECT '{source}' AS source_id, '{t}' AS \"table\", {i} AS position, '{c}' AS name, '{c.replace('_', '-')}' AS slug"
        for source, t, kind, _ in LAKE_TABLES if kind == "parquet"
        for i, (c, _) in enumerate(_columns(t), 1)
    ),
    "unpack_of_lake": _lake_run(),
    "encode_texts": f"""SELECT 'UTF8' AS encoding, doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, text AS decoded FROM documents
UNION ALL SELECT 'UTF8_BOM', doc_id, strlen(text) + 3, text FROM documents
UNION ALL SELECT unnest(['WINDOWS_31J', 'SHIFT_JIS']), doc_id, length(text), {ASCII_ONLY} FROM documents""",
    "fingerprint_saved_queries": _with("saved_queries") + _fingerprint("saved_queries", ["query_id", "name", "sql"]),
    "fingerprint_roundtrip": _fingerprint(
        f"(SELECT * REPLACE ({ISO.format('ts')} AS ts) FROM events)",
        ["event_id", "ts", "user_id", "event_type", "value", "props"],
    ),
    "query_types": f"{_with('saved_queries')} SELECT query_id, {TYPE} AS type FROM saved_queries",
    "query_warnings": f"{_with('saved_queries')} SELECT query_id, unnest({WARNINGS}) AS warning FROM saved_queries",
    "query_dependencies": f"""{_with('saved_queries')}
SELECT query_id, array_to_string({DEPENDENCIES}, '|') AS dependencies FROM saved_queries""",
    "query_dependencies_strict": _with("hidden_names") + r"""
, tokens AS (SELECT query_id, list_filter(
    regexp_extract_all(sql, '''[^'']*''|"[^"]*"|--[^\n]*|/\*(?s:.*?)\*/|\[[^\]]*\]|[\p{L}\p{N}_]+|[^\s]'),
    lambda t: NOT regexp_matches(t, '^(--|/\*.)')) AS t FROM hidden_names),
named AS (SELECT query_id, i, trim(CASE WHEN starts_with(t[i + 1], '[') THEN t[i + 1][2:-2] ELSE t[i + 1] END) AS name
    FROM tokens, unnest(range(1, len(t))) AS u(i)
    WHERE lower(t[i]) IN ('from', 'join', 'update', 'into') AND regexp_full_match(t[i + 1], '\[[^\]]+\]|[\p{L}\p{N}_]+')),
firsts AS (SELECT query_id, name, min(i) AS i FROM named GROUP BY 1, 2)
SELECT h.query_id, CAST(CASE WHEN name IS NOT NULL THEN row_number() OVER (PARTITION BY h.query_id ORDER BY i) - 1 END AS INTEGER) AS place, name
FROM hidden_names h LEFT JOIN firsts f ON f.query_id = h.query_id""",
    "dependency_edges": f"""{_with('saved_queries')} SELECT query_id, name AS "from", unnest({DEPENDENCIES}) AS "to",
'query-depends-on' AS type FROM saved_queries""",
    "query_translations": f"""{_with('saved_queries')} SELECT query_id, {TRANSLATED} AS translated, {CONFIDENCE} AS confidence,
array_to_string({T_WARNINGS}, '|') AS warnings FROM saved_queries""",
    "translation_ledger": f"""{_with('saved_queries')} SELECT query_id, 'QUERY_TRANSLATION_WARNING' AS code, 'warning' AS status,
unnest({T_WARNINGS}) AS text, CAST(NULL AS DOUBLE) AS confidence FROM saved_queries
UNION ALL SELECT query_id, 'query-translation', CASE WHEN {CONFIDENCE} >= 0.5 THEN 'SUCCESS' ELSE 'PARTIAL' END, 'POSTGRES',
{CONFIDENCE} FROM saved_queries""",
    "query_models": _with("saved_queries") + MODEL,
    "streamed_query_models": _with("saved_queries") + MODEL,
    "sql_workbench": f"""{_with('saved_queries')} SELECT query_id, name, CASE WHEN {BLANK} THEN '-- empty SQL --' ELSE sql END AS raw,
coalesce({TRANSLATED}, '-- no translation --') AS translated, {CONFIDENCE} AS confidence,
array_to_string({T_WARNINGS}, '|') AS warnings FROM saved_queries""",
    "declared_keys": f"""{_with('lake_keys', 'end_selection')} SELECT "table", name, primary_key, "unique",
array_to_string(columns, ',') AS columns FROM lake_keys WHERE "table" IN (SELECT name FROM end_selection)""",
    "key_audit": _key_audit(),
    "declared_relationships": f"""{_with('lake_relationships', 'end_selection')} SELECT name, from_table, to_table,
array_to_string(from_columns, ',') AS from_columns, array_to_string(to_columns, ',') AS to_columns, cascade_deletes, cascade_updates
FROM lake_relationships WHERE from_table IN (SELECT name FROM end_selection) AND to_table IN (SELECT name FROM end_selection)""",
    "constraints": f"""{_with('lake_relationships')} SELECT name, from_table, to_table,
array_to_string(from_columns, ',') AS from_columns, array_to_string(to_columns, ',') AS to_columns, cascade_deletes, cascade_updates
FROM lake_relationships""",
    "relationship_audit": _relationship_audit(),
    "linked_tables": f"{_with('lake_tables')} SELECT name, 'linked' AS type FROM lake_tables WHERE linked",
    "system_objects": f"{_with('lake_tables')} SELECT name, 'table' AS type FROM lake_tables WHERE system_object",
    "property_rows": f"WITH {PROPERTIES} SELECT * FROM properties",
    "coverage_ledger": f"{_with('lake_tables', 'lake_relationships', 'saved_queries')}, {COVERAGE} SELECT * FROM coverage",
    "coverage_summary": f"""{_with('lake_tables', 'lake_relationships', 'saved_queries')}, {COVERAGE}
SELECT lower(status) AS status, count(*) AS n FROM coverage GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM coverage""",
    "lake_counts": f"""{_with('lake_tables', 'saved_queries', 'lake_relationships')}, counted AS (
SELECT source_id, unnest(['tables', 'queries', 'relationships', 'forms', 'reports', 'macros', 'modules']) AS kind, 0 AS n
FROM (SELECT DISTINCT source_id FROM lake_tables)
UNION ALL SELECT source_id, 'tables', 1 FROM lake_tables WHERE NOT system_object
UNION ALL SELECT 'db' || CAST((query_id % 100 + 100) % 100 AS VARCHAR), 'queries', 1 FROM saved_queries
UNION ALL SELECT source_id, 'relationships', 1 FROM ({LAKE_RELATIONSHIPS}))
SELECT source_id, kind, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY 1, 2""",
    "lake_objects": f"""{_with('lake_tables')} SELECT source_id, printf('- `table` `%s` `%s` confidence=%.2f', name,
CASE WHEN row_count < 0 THEN 'FAILED' ELSE 'SUCCESS' END, CASE WHEN row_count < 0 THEN 0.0 ELSE 0.95 END) AS line FROM lake_tables""",
    "lake_summary": f"""{_with('lake_tables', 'saved_queries', 'lake_relationships')}, {LAKE_ENTRIES}, incomplete AS (
SELECT DISTINCT source_id AS id FROM lake_tables t WHERE NOT EXISTS (SELECT 1 FROM lake_tables p
WHERE p.source_id = t.source_id AND p.slug = t.slug AND p.column_count % 9 <> 0)),
sizes AS (SELECT source_id, count(*) AS coverage_entries FROM entries GROUP BY 1)
SELECT source_id, coverage_entries, CAST(CASE WHEN id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS warnings,
CAST(0 AS BIGINT) AS errors, 0 AS exit_code,
CASE WHEN id IS NULL THEN 'Completed cleanly' ELSE 'Completed with warnings' END AS status
FROM sizes LEFT JOIN incomplete ON id = source_id""",
    "lake_coverage": f"""{_with('lake_tables', 'saved_queries', 'lake_relationships')}, {LAKE_ENTRIES}
SELECT source_id, status, count(*) AS n FROM entries GROUP BY 1, 2
UNION ALL SELECT source_id, 'total', count(*) FROM entries GROUP BY 1""",
    "diagnostics_ledger": f"""{_with('dump_files', 'links', 'saved_queries', 'lake_tables')}, {RESOLVED}, {MISSING}, {DIAGNOSTICS}
SELECT * FROM diagnostics""",
    "inventory_counts": f"""{_with('lake_tables', 'saved_queries', 'lake_relationships')}
SELECT 'tables' AS kind, count(*) AS n FROM lake_tables WHERE NOT system_object
UNION ALL SELECT 'queries', count(*) FROM saved_queries UNION ALL SELECT 'relationships', count(*) FROM lake_relationships
UNION ALL SELECT unnest(['forms', 'reports', 'macros', 'modules']), 0""",
    "missing_artifacts": f"{_with('lake_tables')}, {MISSING} SELECT * FROM missing",
    "object_inventory": f"""{_with('lake_tables', 'lake_relationships', 'saved_queries')}, {COVERAGE}
SELECT printf('- `%s` `%s` `%s` confidence=%.2f', category, name, status, confidence) AS line FROM coverage""",
    "run_summary": f"""{_with('lake_tables', 'lake_relationships', 'saved_queries', 'dump_files', 'links')}, {COVERAGE}, {RESOLVED},
{MISSING}, {DIAGNOSTICS}, sizes AS (SELECT (SELECT count(*) FROM coverage) AS coverage_entries,
count(*) FILTER (severity <> 'error') AS warnings, count(*) FILTER (severity = 'error') AS errors FROM diagnostics)
SELECT *, CASE WHEN errors = 0 THEN 0 ELSE 2 END AS exit_code, CASE WHEN errors > 0 THEN 'Completed with issues'
WHEN warnings > 0 THEN 'Completed with warnings' ELSE 'Completed cleanly' END AS status FROM sizes""",
    "manifest": f"""{_with('lake_tables', 'saved_queries', 'lake_relationships')} SELECT 'lake' AS input, 'out' AS output,
'UTF8' AS text_encoding, true AS schema, true AS data, true AS queries, true AS docs, 0 AS n_selected_tables, 0 AS n_selected_queries,
(SELECT count(*) FROM lake_tables WHERE NOT system_object) AS tables, (SELECT count(*) FROM lake_relationships) AS relationships,
CAST(0 AS BIGINT) AS forms, (SELECT count(*) FROM saved_queries) AS n_queries""",
    "db_info": f"""{_with('dump_files')}, {PROPERTIES} SELECT source_id AS source, file_name, {_extension('file_name')} AS extension,
scope, key, value FROM dump_files LEFT JOIN properties ON source = source_id""",
    "table_schemas": _table_schemas(),
    "unpack": _unpacked(True),
    "unpack_schema_only": _unpacked(False),
    "unpack_translated": _unpack_translated(),
    "unpack_with_failures": _unpack_with_failures(),
    "lake_key_audit": _lake_key_audit(),
    "lake_relationship_audit": _lake_relationship_audit(),
}
