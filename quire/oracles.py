"""The registered queries again, as SQL over the star-schema tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# What the rendered estate holds, computed from the tables it is rendered from.
_ESTATE = """
pairs AS (
  SELECT l_orderkey AS o, l_suppkey AS s, l_partkey AS p, bool_or(l_returnflag = 'R') AS has_r
  FROM lineitem GROUP BY 1, 2, 3
),
doc_rows AS (
  SELECT *, 'estate/' || o || '-' || ((row_number() OVER (PARTITION BY o ORDER BY p, s) - 1) // 1000) || '.twb' AS path
  FROM pairs
),
wb AS (
  SELECT DISTINCT path, o, CASE o_orderstatus WHEN 'F' THEN '18.1' WHEN 'O' THEN '17.0' END AS version,
    o_orderpriority AS platform
  FROM doc_rows JOIN orders ON o_orderkey = o
),
ds AS (
  SELECT path, o, s, 'federated.s' || s AS name, s_name AS caption, has_r,
    row_number() OVER (PARTITION BY path ORDER BY s) - 1 AS ds_pos,
    CASE WHEN n_nationkey % 2 = 0 THEN replace(lower(r_name), ' ', '') || '.internal.example.com'
         ELSE 'n' || n_nationkey || '.vendor.example.net' END AS server,
    CASE WHEN n_nationkey BETWEEN 10 AND 19 THEN 'dbx1' ELSE 'db_' || n_nationkey END AS dbname,
    CASE WHEN s % 7 = 0 THEN 'C:\\Users\\u' || s || '\\x.csv' END AS filename
  FROM (SELECT path, o, s, bool_or(has_r) AS has_r FROM doc_rows GROUP BY 1, 2, 3)
  JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey
),
plain AS (
  SELECT path, o, s, p, '[p' || p || ']' AS name,
    CASE p % 10 WHEN 0 THEN 'Customer Email' WHEN 1 THEN 'SSN' WHEN 2 THEN 'Cost Center' ELSE p_name END AS caption
  FROM doc_rows JOIN part ON p_partkey = p
),
calc AS (
  SELECT path, o, s, p, '[c' || p || ']' AS name,
    CASE WHEN p % 20 = 0 THEN 'ATTR([p' || p || ']) * 2'
         WHEN p % 20 = 4 THEN '[gone' || p || '] + 1'
         WHEN p % 20 = 8 THEN 'IF USERNAME() = "a" THEN [p' || p || '] END'
         WHEN p % 40 = 12 THEN '1 + 1'
         WHEN p % 40 = 32 THEN ' 1  +  1 '
         ELSE '[p' || p || '] * 2' END AS formula
  FROM doc_rows WHERE p % 4 = 0
)
"""


def _on_estate(sql: str, more: str = "") -> str:
    return f"WITH {_ESTATE}{', ' + more if more else ''} {sql}"


ORACLES["inv_embedded_credentials"] = _on_estate("""
SELECT DISTINCT path, version, name AS datasource, server, dbname
FROM ds JOIN wb USING (path) WHERE has_r
""")

ORACLES["inv_references_table"] = _on_estate("""
SELECT DISTINCT path, name AS datasource, server, dbname, 'connection' AS matched_via
FROM ds WHERE contains(dbname, 'db_1')
""")

ORACLES["inv_references_formula"] = _on_estate("""
SELECT DISTINCT ds.path, ds.name AS datasource, server, dbname, 'formula' AS matched_via
FROM ds WHERE EXISTS (SELECT 1 FROM calc
  WHERE calc.path = ds.path AND calc.s = ds.s AND contains(lower(formula), 'gone1'))
""")

ORACLES["inv_references_datasource"] = _on_estate("""
SELECT DISTINCT path, name AS datasource, server, dbname, 'datasource' AS matched_via
FROM ds WHERE contains(lower(name), 'federated.s1')
""")

ORACLES["inv_references_unconnected"] = """
SELECT 'parts/' || p_partkey || '.twb' AS path, 'bare' AS datasource,
  CAST(NULL AS VARCHAR) AS server, CAST(NULL AS VARCHAR) AS dbname, 'datasource' AS matched_via
FROM part WHERE p_partkey % 17 <> 7
"""

ORACLES["inv_user_identity_fields"] = _on_estate("""
SELECT DISTINCT path, 'federated.s' || s AS datasource, name AS field
FROM calc WHERE contains(formula, 'USERNAME()')
""")

ORACLES["inv_server_summary"] = _on_estate("""
SELECT server, count(DISTINCT path) AS workbook_count, count(*) AS connection_count FROM ds GROUP BY server
""")

_LIST = """
SELECT wb.path, version, CAST(NULL AS VARCHAR) AS source_build, platform AS source_platform,
  {size}
  (SELECT count(*) FROM {ds} d WHERE d.path = wb.path) AS datasource_count,
  (SELECT count(*) FROM ds d WHERE d.path = wb.path) AS worksheet_count,
  CAST(o % 3 <> 0 AS BIGINT) AS dashboard_count,
  (SELECT count(*) FROM {ds} d WHERE d.path = wb.path AND has_r) AS embedded_cred_count
FROM wb
"""


def _xml_attr(name: str, value: str) -> str:
    escaped = f"replace(replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    return f"coalesce(' {name}=\"' || {escaped} || '\"', '')"


def _documents(later: bool) -> str:
    """CTE ``doc (path, xml)``: the text of each document, for its size."""
    datatype = "CASE WHEN p % 6 = 0 THEN 'integer' ELSE 'string' END" if later else "'string'"
    formula = "CASE WHEN p % 20 = 16 THEN name_p || ' * 3' ELSE formula END" if later else "formula"
    sheet = "'ws_' || s || CASE WHEN s % 9 = 0 THEN '_v2' ELSE '' END" if later else "'ws_' || s"
    shown = "CASE WHEN s % 5 = 0 THEN '' ELSE src END" if later else "src"
    return f"""
cols AS (
  SELECT path, s, string_agg(
      '<column' || {_xml_attr('name', 'name')} || {_xml_attr('datatype', datatype)}
      || ' role="dimension" type="nominal"' || {_xml_attr('caption', 'caption')} || '/>', '' ORDER BY p) AS x
  FROM plain GROUP BY 1, 2
),
calcs AS (
  SELECT path, s, string_agg(
      '<column' || {_xml_attr('name', 'name')} || ' datatype="real" role="measure"><calculation class="tableau"'
      || {_xml_attr('formula', formula)} || '/></column>', '' ORDER BY p) AS x
  FROM (SELECT *, '[p' || p || ']' AS name_p FROM calc) GROUP BY 1, 2
),
pieces AS (
  SELECT path, s, o,
    '<datasource' || {_xml_attr('name', 'name')} || {_xml_attr('caption', 'caption')}
    || '><connection class="sqlserver"' || {_xml_attr('server', 'server')} || {_xml_attr('dbname', 'dbname')}
    || CASE WHEN has_r THEN ' password="hunter2-secret"' ELSE '' END || {_xml_attr('filename', 'filename')}
    || '/>' || cols.x || coalesce(calcs.x, '') || '</datasource>' AS src,
    {sheet} AS sheet, name
  FROM ds JOIN cols USING (path, s) LEFT JOIN calcs USING (path, s)
),
bodies AS (
  SELECT path, any_value(o) AS o, string_agg({shown}, '' ORDER BY s) AS sources,
    string_agg('<worksheet' || {_xml_attr('name', 'sheet')} || '><table><view><datasources>'
      || CASE WHEN s % 4 = 0 THEN '' ELSE '<datasource' || {_xml_attr('name', 'name')} || '/>' END
      || '</datasources></view></table></worksheet>', '' ORDER BY s) AS sheets,
    coalesce(string_agg('<zone id="' || s || '" type="worksheet"' || {_xml_attr('name', 'sheet')} || '/>', ''
      ORDER BY s) FILTER (s % 2 = 0), '') AS zones
  FROM pieces GROUP BY path
),
doc AS (
  SELECT path, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<workbook' || {_xml_attr('version', 'version')}
    || {_xml_attr('source-platform', 'platform')} || '>' || chr(10) || '<datasources>' || sources
    || '</datasources>' || chr(10) || '<worksheets>' || sheets || '</worksheets>' || chr(10) || '<dashboards>'
    || CASE WHEN bodies.o % 3 <> 0 THEN '<dashboard name="Overview"><zones><zone id="0" type="layout-basic">'
         || zones || '</zone></zones></dashboard>' ELSE '' END
    || '</dashboards>' || chr(10) || '</workbook>' || chr(10) AS xml
  FROM bodies JOIN wb USING (path)
)"""


_SIZE = "(SELECT CAST(strlen(xml) AS BIGINT) FROM doc WHERE doc.path = wb.path) AS size_bytes,"

ORACLES["inv_list_workbooks"] = _on_estate(_LIST.format(ds="ds", size=_SIZE), _documents(False))

ORACLES["inv_upsert_then_list"] = f"""
SELECT * FROM (WITH {_ESTATE}, {_documents(False)} {_LIST.format(ds='ds', size=_SIZE)} WHERE o % 2 <> 0)
UNION ALL
SELECT * FROM (WITH {_ESTATE}, {_documents(True)}
  {_LIST.format(ds='(SELECT * FROM ds WHERE s % 5 <> 0)', size=_SIZE)} WHERE o % 2 = 0)
"""

ORACLES["inv_upsert_repeated_paths"] = f"""
WITH {_ESTATE}, {_documents(True)}
  {_LIST.format(ds='(SELECT * FROM ds WHERE s % 5 <> 0)', size=_SIZE)}
"""

ORACLES["inv_stats"] = _on_estate("""
SELECT 'workbooks' AS metric, count(*) AS count FROM wb
UNION ALL SELECT 'datasources', count(*) FROM ds
UNION ALL SELECT 'connections', count(*) FROM ds
UNION ALL SELECT 'fields', (SELECT count(*) FROM plain) + (SELECT count(*) FROM calc)
UNION ALL SELECT 'worksheets', count(*) FROM ds
UNION ALL SELECT 'dashboards', count(*) FROM wb WHERE o % 3 <> 0
UNION ALL SELECT 'with_embedded_creds', count(DISTINCT path) FROM ds WHERE has_r
""")

ORACLES["inv_adhoc_sql"] = _on_estate("""
SELECT caption, count(DISTINCT ds.path) AS workbooks, count(calc.name) AS fields
FROM ds JOIN wb USING (path) LEFT JOIN calc ON calc.path = ds.path AND calc.s = ds.s
WHERE version = '18.1' AND server LIKE '%.vendor.example.net' GROUP BY caption
""")

ORACLES["table_fields"] = _on_estate("""
SELECT f.path, CAST(ds_pos AS INTEGER) AS ds_pos,
  CAST(row_number() OVER (PARTITION BY f.path, f.s ORDER BY is_calculated, p) - 1 AS INTEGER) AS field_pos,
  'federated.s' || f.s AS datasource, f.name, f.caption,
  CASE WHEN is_calculated THEN 'real' ELSE 'string' END AS datatype,
  CASE WHEN is_calculated THEN 'measure' ELSE 'dimension' END AS role,
  is_calculated, formula AS calc_formula,
  coalesce(contains(formula, 'USERNAME('), false) AS references_username
FROM (SELECT path, s, p, name, caption, NULL AS formula, false AS is_calculated FROM plain
      UNION ALL SELECT path, s, p, name, NULL, formula, true FROM calc) f
JOIN ds ON ds.path = f.path AND ds.s = f.s
""")

ORACLES["table_dashboards"] = _on_estate("""
SELECT wb.path, 0 AS dash_pos, 'Overview' AS name,
  coalesce((SELECT string_agg('ws_' || s, ',' ORDER BY 'ws_' || s) FROM ds
            WHERE ds.path = wb.path AND s % 2 = 0), '') AS referenced_worksheets
FROM wb WHERE o % 3 <> 0
""")

ORACLES["table_zones"] = _on_estate("""
SELECT path, 0 AS dash_pos, '1' AS zone_path, 0 AS depth, '0' AS id, 'layout-basic' AS zone_type,
  CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS worksheet_ref
FROM wb WHERE o % 3 <> 0
UNION ALL
SELECT path, 0, '1/' || row_number() OVER (PARTITION BY path ORDER BY s), 1, CAST(s AS VARCHAR), 'worksheet',
  'ws_' || s, 'ws_' || s
FROM ds WHERE s % 2 = 0 AND o % 3 <> 0
""")

ORACLES["table_nested_zones"] = """
SELECT 'parts/' || p_partkey || '.twb' AS path, 0 AS dash_pos, z.*
FROM part, (VALUES
  ('1', 0, '1', 'layout-flow', NULL, NULL), ('1/1', 1, '2', 'layout-basic', NULL, NULL),
  ('1/1/1', 2, '3', 'worksheet', 'w1', 'w1'), ('1/2', 1, '4', 'worksheet', 'w2', 'w2'), ('2', 0, '5', 'text', NULL, NULL)
) z(zone_path, depth, id, zone_type, name, worksheet_ref)
"""

ORACLES["scan_summary"] = _on_estate("""
SELECT count(*) AS scanned, count(*) FILTER (o % 50 <> 0) AS indexed, count(*) FILTER (o % 50 = 0) AS skipped FROM wb
""")

ORACLES["scan_errors_first"] = _on_estate(
    "SELECT path, 'parse: unclosed token' AS message FROM wb WHERE o % 50 = 0 ORDER BY path LIMIT 3")

ORACLES["scan_tree_files"] = """
WITH books AS (
  SELECT s_suppkey AS k, 'n' || s_nationkey || '/s' || s_suppkey || '.twb' AS name,
    '<workbook version="18.1"><datasources><datasource name="s' || s_suppkey || '"><connection class="sqlserver" server="n'
      || s_nationkey || '.example.net"/></datasource>'
      || CASE WHEN s_suppkey % 4 = 1 THEN '<datasource name="later"/>' ELSE '' END || '</datasources></workbook>' AS xml
  FROM supplier)
SELECT name, sha256(xml) AS sha256, CAST(strlen(xml) AS BIGINT) AS size_bytes, CASE WHEN k % 4 = 1 THEN 2 ELSE 1 END::BIGINT AS sources,
  true AS dated, '' AS message
FROM books WHERE k % 20 <> 17
UNION ALL
SELECT name, '', 0, 0, false, 'parse: unclosed token: line 1, column 0' FROM books WHERE k % 20 = 17
"""

ORACLES["zip_ingest"] = _on_estate("""
SELECT CASE WHEN o % 41 = 0 THEN 'no workbook document' WHEN o % 40 = 0 THEN 'several workbook documents'
            ELSE 'indexed' END AS outcome,
  count(*) AS files, CAST(sum(CASE WHEN o % 41 = 0 OR o % 40 = 0 THEN 0 ELSE n END) AS BIGINT) AS fields
FROM wb JOIN (SELECT path, count(*) + count(*) FILTER (p % 4 = 0) AS n FROM doc_rows GROUP BY path) USING (path)
GROUP BY 1
""")

ORACLES["zip_ingest_files"] = _on_estate("""
SELECT path || 'x' AS path,
  CASE WHEN o % 41 = 0 THEN 'holds no workbook document'
       WHEN o % 40 = 0 THEN 'holds several workbook documents: book.twb, copy.TWB' ELSE '' END AS said,
  CASE WHEN o % 41 = 0 OR o % 40 = 0 THEN 0 ELSE sources END AS sources,
  CASE WHEN o % 41 = 0 OR o % 40 = 0 THEN 0 ELSE fields END AS fields
FROM wb JOIN (SELECT path, count(DISTINCT s) AS sources, count(*) + count(*) FILTER (p % 4 = 0) AS fields
              FROM doc_rows GROUP BY path) USING (path)
""")

# ---- audit ----------------------------------------------------------------------
_FIELD = "'datasource:federated.s' || s || '/field:' || name"
_CONN = "'datasource:' || name || '/connection:sqlserver'"
_OF_FIELD = "name || ''' on ''federated.s' || s || '''"
# Severity, title, message, location, remediation, properties and the rows they are about.
_RULES = {
    "AUD001": ("warn", "Unused worksheet", "'No dashboard shows worksheet ''ws_' || s || '''.'", "'worksheet:ws_' || s",
               "Put it on a dashboard or delete it.", "''", "ds WHERE o % 3 <> 0 AND s % 2 <> 0"),
    "AUD002": ("warn", "Orphan data source", "'No worksheet uses data source ''' || name || '''.'",
               "'datasource:' || name", "Use it in a worksheet or remove it.", "''", "ds WHERE s % 4 = 0"),
    "AUD003": ("warn", "Deprecated function", f"'Formula of ''' || {_OF_FIELD} calls ATTR(), which is deprecated.'",
               _FIELD, "Use MIN or MAX where one value per partition is meant.", "'function=ATTR'",
               "calc WHERE p % 20 = 0"),
    "AUD004": ("info", "Repeated formula",
               "'The same formula stands in ' || n || ' places: ' || listed || '.'", "location",
               "Keep it once, as a parameter or in a shared data source.", "'count=' || n", """(
        SELECT path, count(*) AS n,
          string_agg('federated.s' || s || ':' || name, ', ' ORDER BY s, p) AS listed,
          arg_min('federated.s' || s || '/' || name, s * 1000000000 + p) AS location
        FROM calc GROUP BY path, lower(regexp_replace(trim(formula), ' +', ' ', 'g')) HAVING count(*) > 1)"""),
    "AUD005": ("error", "Broken column reference",
               "'Formula of ''' || name || ''' refers to [gone' || p || '], which data source ''federated.s' || s"
               " || ''' does not have.'", _FIELD, "Correct the reference or bring the column back.",
               "'referenced=[gone' || p || ']'", "calc WHERE p % 20 = 4"),
    "AUD006": ("info", "Old workbook version", "'Saved as version ''' || version || ''', below 18.'", "'workbook'",
               "Open it in a current release and save it again.", "'version=' || version", "wb WHERE version = '17.0'"),
    "GOV001": ("error", "Embedded password", "'A connection of data source ''' || name || ''' stores a password.'",
               _CONN, "Remove the password; let the server, the user''s login or a prompt supply it.", "''",
               "ds WHERE has_r"),
    "GOV002": ("warn", "Unapproved server", "'Data source ''' || name || ''' connects to ''' || server"
               " || ''', which is not an approved server.'", _CONN, "Connect to an approved server, or approve this one.",
               "'server=' || server", "ds WHERE server LIKE '%.vendor.example.net'"),
    "GOV003": ("warn", "Personal data in field name",
               "'The name of field ''' || name || ''' on ''federated.s' || s || ''' reads like personal data ('"
               " || CASE p % 10 WHEN 0 THEN 'email' ELSE 'ssn' END || ').'", _FIELD,
               "Check that it may be published, or take it out.",
               "'pattern=' || CASE p % 10 WHEN 0 THEN 'email' ELSE 'ssn' END", "plain WHERE p % 10 IN (0, 1)"),
    "GOV004": ("warn", "Access control in a formula",
               f"'Formula of ''' || {_OF_FIELD} decides by who is looking.'", _FIELD,
               "Filter rows in the data source; a formula in the workbook can be bypassed.", "''", "calc WHERE p % 20 = 8"),
    "GOV005": ("warn", "File in a user profile", "'Data source ''' || name || ''' reads ''' || filename"
               " || ''' from a user''s own folder.'", _CONN, "Move the file to a shared place, or use an extract.",
               "'path=' || filename", "ds WHERE filename IS NOT NULL"),
}


def _rule(rule_id: str) -> str:
    severity, title, message, location, remediation, properties, rows = _RULES[rule_id]
    return (
        f"SELECT '{rule_id}' AS rule_id, '{severity}' AS severity, '{title}' AS title, {message} AS message, "
        f"path AS workbook_path, {location} AS location, '{remediation}' AS remediation, {properties} AS properties "
        f"FROM {rows}"
    )


for _id in _RULES:
    ORACLES[f"audit_{_id.lower()}"] = _on_estate(_rule(_id))

_FINDINGS = "findings AS (" + " UNION ALL ".join(_rule(i) for i in _RULES) + ")"
_COUNTS = """count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warn') AS warn_count,
  count(*) FILTER (severity = 'info') AS info_count, count(*) AS total_count"""

ORACLES["audit_all"] = _on_estate("SELECT * FROM findings", _FINDINGS)
# By remainders of the part's key, as the workbooks of parts are rendered.
ORACLES["audit_wordings"] = """
WITH books AS (SELECT p_partkey AS k, 'parts/' || p_partkey || '.twb' AS path FROM part),
labels AS (SELECT * FROM (VALUES (0, 'ssn'), (1, 'dob'), (2, 'email'), (3, 'phone'), (4, 'address'), (5, 'credit_card'),
  (6, 'medical'), (7, 'personal_name'), (8, 'ip_address'), (9, 'phone')) t(m, label)),
files AS (SELECT * FROM (VALUES (0, 'C:\\Users\\u\\x.csv'), (1, 'd:\\USERS\\u\\y.csv'), (2, '/home/u/z.csv'),
  (3, '/Users/u/z.csv')) t(m, filename))
SELECT 'AUD003' AS rule_id, 'warn' AS severity, 'Deprecated function' AS title,
  'Formula of ''[calc]'' on ''main'' calls ATTR(), which is deprecated.' AS message, path AS workbook_path,
  'datasource:main/field:[calc]' AS location, 'Use MIN or MAX where one value per partition is meant.' AS remediation,
  'function=ATTR' AS properties
FROM books WHERE k % 9 = 7
UNION ALL SELECT 'GOV003', 'warn', 'Personal data in field name',
  'The name of field ''[id]'' on ''main'' reads like personal data (' || label || ').', path,
  'datasource:main/field:[id]', 'Check that it may be published, or take it out.', 'pattern=' || label
FROM books JOIN labels ON m = k % 13
UNION ALL SELECT 'GOV004', 'warn', 'Access control in a formula',
  'Formula of ''[calc]'' on ''main'' decides by who is looking.', path, 'datasource:main/field:[calc]',
  'Filter rows in the data source; a formula in the workbook can be bypassed.', ''
FROM books WHERE k % 9 < 5
UNION ALL SELECT 'GOV005', 'warn', 'File in a user profile',
  'Data source ''main'' reads ''' || filename || ''' from a user''s own folder.', path,
  'datasource:main/connection:sqlserver', 'Move the file to a shared place, or use an extract.', 'path=' || filename
FROM books JOIN files ON m = k % 6
"""
ORACLES["audit_gravest"] = _on_estate("""
SELECT * FROM findings
ORDER BY CASE severity WHEN 'error' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END DESC, rule_id, workbook_path, location LIMIT 50
""", _FINDINGS)
ORACLES["audit_findings_by_workbook"] = _on_estate(
    f"SELECT workbook_path, {_COUNTS} FROM findings GROUP BY workbook_path", _FINDINGS)
ORACLES["audit_severity_counts"] = _on_estate(f"SELECT {_COUNTS} FROM findings", _FINDINGS)
ORACLES["audit_gate"] = _on_estate("""
SELECT path, coalesce(max(CASE severity WHEN 'error' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END), 0) AS exit_code
FROM wb LEFT JOIN findings ON workbook_path = path GROUP BY path
""", _FINDINGS)
ORACLES["audit_pack_config"] = _on_estate(
    _rule("GOV002") + " AND server <> 'n1.vendor.example.net'")
ORACLES["audit_pack_pii_disabled"] = _on_estate(_rule("GOV003") + " AND p % 10 = 1")

# ---- diff -----------------------------------------------------------------------
_CHANGES = """
changes AS (
  SELECT path AS a_path, 'removed' AS kind, 'datasource' AS category, name AS identifier, '' AS detail
  FROM ds WHERE s % 5 = 0
  UNION ALL
  SELECT path, 'modified', 'field', 'federated.s' || s || '/' || name, 'datatype ''string''→''integer'''
  FROM plain WHERE s % 5 <> 0 AND p % 6 = 0
  UNION ALL
  SELECT path, 'modified', 'field', 'federated.s' || s || '/' || name, 'calculation formula changed'
  FROM calc WHERE s % 5 <> 0 AND p % 20 = 16
  UNION ALL
  SELECT path, k.kind, 'worksheet', 'ws_' || s || k.suffix, ''
  FROM ds, (VALUES ('removed', ''), ('added', '_v2')) k(kind, suffix) WHERE s % 9 = 0
  UNION ALL
  SELECT path, 'modified', 'dashboard', 'Overview',
    'worksheet set changed: [' || string_agg('ws_' || s, ', ' ORDER BY 'ws_' || s) || '] → ['
    || string_agg('ws_' || s || CASE WHEN s % 9 = 0 THEN '_v2' ELSE '' END, ', '
                  ORDER BY 'ws_' || s || CASE WHEN s % 9 = 0 THEN '_v2' ELSE '' END) || ']'
  FROM ds WHERE o % 3 <> 0 AND s % 2 = 0 GROUP BY path HAVING bool_or(s % 9 = 0)
)"""

ORACLES["diff_workbooks"] = _on_estate("SELECT * FROM changes", _CHANGES)

ORACLES["diff_summary"] = _on_estate("""
SELECT path AS a_path, CASE WHEN count(kind) = 0 THEN 'no semantic differences' ELSE concat_ws(', ',
    CASE WHEN count(*) FILTER (kind = 'added') > 0 THEN count(*) FILTER (kind = 'added') || ' added' END,
    CASE WHEN count(*) FILTER (kind = 'removed') > 0 THEN count(*) FILTER (kind = 'removed') || ' removed' END,
    CASE WHEN count(*) FILTER (kind = 'modified') > 0 THEN count(*) FILTER (kind = 'modified') || ' modified' END)
  END AS summary
FROM wb LEFT JOIN changes ON a_path = path GROUP BY path
""", _CHANGES)

ORACLES["diff_keyed_table"] = """
WITH later AS (
  SELECT CASE WHEN o_orderkey % 13 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS k,
    CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS st,
    CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS tp
  FROM orders WHERE o_orderkey % 7 <> 0
)
SELECT CASE WHEN k IS NULL THEN 'removed' WHEN o_orderkey IS NULL THEN 'added' ELSE 'modified' END AS kind,
  coalesce(o_orderkey, k) AS o_orderkey,
  CASE WHEN k IS NULL OR o_orderkey IS NULL THEN '' ELSE concat_ws(',',
    CASE WHEN o_orderstatus IS DISTINCT FROM st THEN 'o_orderstatus' END,
    CASE WHEN o_totalprice IS DISTINCT FROM tp THEN 'o_totalprice' END) END AS changed_cols
FROM orders FULL JOIN later ON o_orderkey = k
WHERE k IS NULL OR o_orderkey IS NULL OR o_orderstatus IS DISTINCT FROM st OR o_totalprice IS DISTINCT FROM tp
"""

_PART_CHANGES = """
books AS (SELECT 'parts/' || p_partkey || '.twb' AS path, p_partkey % 17 AS m,
  CASE p_partkey % 6 WHEN 0 THEN 'C:\\Users\\u\\x.csv' WHEN 1 THEN 'd:\\USERS\\u\\y.csv' WHEN 2 THEN '/home/u/z.csv'
    WHEN 3 THEN '/Users/u/z.csv' WHEN 4 THEN '/var/home/u/z.csv' ELSE 'C:\\Data\\Users\\q.csv' END AS filename FROM part),
-- One change per remainder; 0, 1 (version) and 5 (user name) change nothing that counts.
kinds AS (SELECT * FROM (VALUES
  (2, 'removed', 'connection', 'main::sqlserver|old.internal.example.com|d|', ''),
  (2, 'added', 'connection', 'main::sqlserver|new.internal.example.com|d|', ''),
  (3, 'added', 'connection', 'bare::excel-direct|||', ''),
  (4, 'removed', 'connection', 'main::sqlserver|old.internal.example.com|d|', ''),
  (6, 'added', 'datasource', 'extra', ''),
  (7, 'removed', 'datasource', 'bare', ''),
  (8, 'added', 'field', 'bare/[more]', ''),
  (9, 'removed', 'field', 'bare/[x]', ''),
  (10, 'modified', 'field', 'main/[id]', 'role ''dimension''→''measure'''),
  (11, 'modified', 'field', 'main/[calc]', 'datatype ''real''→''string''; role ''measure''→''dimension''; calculation removed'),
  (12, 'modified', 'field', 'bare/[x]', 'calculation added'),
  (13, 'modified', 'field', 'main/[id]', 'fields differ'),
  (14, 'removed', 'dashboard', 'Main', ''),
  (14, 'added', 'dashboard', 'Next', ''),
  (15, 'removed', 'worksheet', 'w2', ''),
  (15, 'modified', 'dashboard', 'Main', 'worksheet set changed: [w1, w2] → [w1]'),
  (16, 'modified', 'field', 'main/[id]', 'role ''dimension''→''''')
) t(m, kind, category, identifier, detail)),
changes AS (SELECT path AS a_path, kind, category,
  identifier || CASE WHEN starts_with(identifier, 'main::') THEN filename ELSE '' END AS identifier, detail
  FROM books JOIN kinds USING (m))
"""

ORACLES["diff_every_kind"] = f"WITH {_PART_CHANGES} SELECT * FROM changes"

ORACLES["diff_every_kind_summary"] = f"""
WITH {_PART_CHANGES}
SELECT path AS a_path, CASE WHEN count(kind) = 0 THEN 'no semantic differences' ELSE concat_ws(', ',
    CASE WHEN count(*) FILTER (kind = 'added') > 0 THEN count(*) FILTER (kind = 'added') || ' added' END,
    CASE WHEN count(*) FILTER (kind = 'removed') > 0 THEN count(*) FILTER (kind = 'removed') || ' removed' END,
    CASE WHEN count(*) FILTER (kind = 'modified') > 0 THEN count(*) FILTER (kind = 'modified') || ' modified' END)
  END AS summary
FROM books LEFT JOIN changes ON a_path = path GROUP BY path
"""

ORACLES["diff_duplicate_names"] = _on_estate("""
SELECT changes.* FROM changes JOIN wb ON path = a_path WHERE o % 10 <> 0
UNION ALL SELECT path, 'error', 'datasource', 'twin', 'name is not unique' FROM wb WHERE o % 10 = 0
""", _CHANGES)

# ---- canonical forms --------------------------------------------------------------
ORACLES["norm_duplicates"] = _on_estate("""
SELECT min(path) AS first_path, 2 * count(*) AS copies FROM doc GROUP BY xml
""", _documents(False))


# Text of the canonical lines that go and come. Lines of equal text in one document are counted together.
_LINES = """
kept AS (SELECT path, bool_or(s % 5 <> 0) AS any_kept FROM ds GROUP BY path),
moved AS (
  SELECT path, 'removed' AS kind, 'open' || s AS line FROM ds WHERE s % 5 = 0
  UNION ALL SELECT path, 'removed', 'connection' || coalesce(server, '') || coalesce(dbname, '') || has_r || coalesce(filename, '')
    FROM ds WHERE s % 5 = 0
  UNION ALL SELECT path, 'removed', 'close' FROM ds WHERE s % 5 = 0
  UNION ALL SELECT path, 'removed', 'plain' || p FROM plain WHERE s % 5 = 0 OR p % 6 = 0
  UNION ALL SELECT path, 'added', 'plain' || p FROM plain WHERE s % 5 <> 0 AND p % 6 = 0
  UNION ALL SELECT path, 'removed', unnest(['calc' || p, formula, 'end']) FROM calc WHERE s % 5 = 0
  UNION ALL SELECT path, 'removed', formula FROM calc WHERE s % 5 <> 0 AND p % 20 = 16
  UNION ALL SELECT path, 'added', formula FROM calc WHERE s % 5 <> 0 AND p % 20 = 16
  UNION ALL SELECT path, unnest(['removed', 'added']), 'sheet' || s FROM ds WHERE s % 9 = 0
  UNION ALL SELECT path, unnest(['removed', 'added']), 'zone' || s FROM ds WHERE s % 9 = 0 AND s % 2 = 0 AND o % 3 <> 0
  UNION ALL SELECT path, 'removed', unnest(['sources', 'end of sources']) FROM kept WHERE NOT any_kept
  UNION ALL SELECT path, 'added', 'no sources' FROM kept WHERE NOT any_kept
)"""

ORACLES["diff_lines"] = _on_estate("""
SELECT path, kind, count(*) AS lines, count(DISTINCT line) AS different FROM moved GROUP BY path, kind
""", _LINES)

ORACLES["diff_document_lines"] = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
cut AS (SELECT *, (doc_id % len(lines))::BIGINT AS k FROM docs),
kept AS (
  SELECT doc_id, k, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM cut)
SELECT doc_id, i + CASE WHEN i > k THEN 2 ELSE 1 END AS at, ' ' AS kind, line,
  i + CASE WHEN i > k THEN 1 ELSE 0 END AS old_at, i + 1 AS new_at FROM kept
UNION ALL SELECT doc_id, CASE WHEN k = 0 THEN 1 ELSE k + 2 END, '-', '# old ' || doc_id, k + 1, 0 FROM cut
UNION ALL SELECT doc_id, CASE WHEN k = 0 THEN 2 ELSE 1 END, '+', '# new ' || doc_id, 0, 1 FROM cut
"""

ORACLES["conformance"] = _on_estate("""
SELECT count(*) AS documents, count(*) FILTER (version IS NOT NULL AND o % 50 <> 0) AS valid,
  count(*) - count(*) FILTER (version IS NOT NULL AND o % 50 <> 0) AS errors
FROM wb
""")

ORACLES["conformance_documents"] = _on_estate("""
SELECT path, version IS NOT NULL AND o % 50 <> 0 AS is_valid, CASE WHEN version IS NOT NULL AND o % 50 <> 0 THEN 0 ELSE 1 END AS error_count
FROM wb
""")

ORACLES["dup_text_documents"] = """
SELECT min(doc_id) AS first_doc_id, count(*) AS copies FROM documents
GROUP BY sha256(lower(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')))
HAVING count(*) > 1
"""

# ---- export -----------------------------------------------------------------------
ORACLES["export_json"] = _on_estate("SELECT * FROM findings", _FINDINGS)
ORACLES["export_sarif"] = _on_estate("""
SELECT rule_id, CASE severity WHEN 'info' THEN 'note' WHEN 'warn' THEN 'warning' ELSE 'error' END AS level, message,
  message || chr(10) || chr(10) || '**Remediation:** ' || remediation AS markdown, workbook_path AS uri, location,
  array_to_string(list_sort(list_filter([properties, 'remediation=' || remediation], lambda x: x <> '')), ',') AS properties,
  array_to_string(list_transform(string_split_regex(rule_id || ' ' || title, '[^A-Za-z0-9]+'),
    lambda w: upper(w[1]) || w[2:]), '') AS slug
FROM findings
""", _FINDINGS)

# ---- pipelines --------------------------------------------------------------------
ORACLES["pipe_cast_filter"] = """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
  CAST(round_even(o_totalprice, 0) AS BIGINT) AS o_totalprice, o_orderdate, o_orderpriority
FROM orders
WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus <> 'P' AND o_custkey BETWEEN 11 AND 900
  AND round_even(o_totalprice, 0) > 100000
"""
ORACLES["pipe_rename_select_drop"] = "SELECT l_orderkey AS order_id, l_quantity AS qty, l_shipdate FROM lineitem"
ORACLES["pipe_metrics"] = """
SELECT 'metrics' AS name, count(*) AS rows_in, count(*) FILTER (l_quantity > 25) AS rows_out,
  count(*) FILTER (l_quantity > 25) AS stored, 'l_orderkey' AS columns FROM lineitem
"""
ORACLES["pipe_in_notin_nulls"] = """
WITH r AS (SELECT event_id, nullif(event_type, 'click') AS kind,
  CASE WHEN event_id % 7 <> 0 THEN value END AS amount FROM events)
SELECT 'in' AS test, event_id FROM r WHERE kind IN ('view', 'error')
UNION ALL SELECT 'in_null', event_id FROM r WHERE kind = 'view' OR kind IS NULL
UNION ALL SELECT 'not_in', event_id FROM r WHERE kind IS DISTINCT FROM 'view'
UNION ALL SELECT 'not_in_null', event_id FROM r WHERE kind IS NOT NULL AND kind <> 'view'
UNION ALL SELECT 'below', event_id FROM r WHERE amount IS NULL OR amount < 5
UNION ALL SELECT 'not_below', event_id FROM r WHERE amount >= 5
UNION ALL SELECT 'unequal', event_id FROM r WHERE kind IS DISTINCT FROM 'view'
UNION ALL SELECT 'is_null', event_id FROM r WHERE amount IS NULL
UNION ALL SELECT 'above_null', event_id FROM r WHERE amount IS NOT NULL AND (kind IS NULL OR kind <= 'purchase')
"""
ORACLES["pipe_text_ladder"] = """
WITH r AS (SELECT c_custkey, c_custkey % 6 AS m, 1 + c_custkey % 28 AS day FROM customer)
SELECT 'number' AS test, c_custkey FROM r WHERE (m = 0 AND c_custkey >= 100) OR m IN (2, 3)
UNION ALL SELECT 'time', c_custkey FROM r
  WHERE (m = 0 AND CAST(c_custkey AS VARCHAR) < '2024-01-15') OR m IN (1, 5) OR (m IN (3, 4) AND day < 15)
UNION ALL SELECT 'text', c_custkey FROM r WHERE NOT (m = 2 AND c_custkey = 2)
UNION ALL SELECT 'list', c_custkey FROM r
  WHERE (m = 0 AND c_custkey = 100) OR (m = 1 AND c_custkey = 7) OR (m = 2 AND c_custkey = 8) OR m = 5
     OR (m IN (3, 4) AND day = 5)
UNION ALL SELECT 'negative', c_custkey FROM r WHERE (m = 1 AND c_custkey > 5) OR m = 5
"""
ORACLES["pipe_csv_roundtrip"] = "SELECT * FROM supplier WHERE s_acctbal > 0"
ORACLES["pipe_parquet_roundtrip"] = """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, p_size,
  CAST(round_even(p_retailprice, 0) AS INTEGER) AS p_retailprice FROM part
"""
ORACLES["pipe_table_append"] = "SELECT * FROM nation UNION ALL SELECT * FROM nation"
ORACLES["result_any_column_filter"] = "SELECT * FROM supplier WHERE contains(lower(s_name), 'r#00000000')"
ORACLES["result_export_csv"] = _on_estate("""
SELECT DISTINCT path, coalesce(version, '') AS version, name AS datasource, server, dbname
FROM ds JOIN wb USING (path) WHERE has_r AND server LIKE 'asia.internal%'
""")
