"""DuckDB SQL for the results of the queries, written apart from them; only the derived tables are shared."""

from __future__ import annotations

import re

from ..sources.star import VIEWS

ORACLES: dict[str, str] = {}


def _view(name: str) -> str:
    sql = re.sub(r"<<(.*?)>>", r"substr(sha256(\1), 1, 16)", VIEWS[name], flags=re.S)
    return re.sub(r"\{(\w+)\}", lambda m: "src_" + m[1] if m[1] in VIEWS else m[1], sql)


def _needs(text: str) -> list[str]:
    """Views that a text names, and those that they are made of, in order."""
    found: set[str] = set()
    todo = set(re.findall(r"src_(\w+)", text)) & set(VIEWS)
    while todo:
        v = todo.pop()
        found.add(v)
        todo |= (set(re.findall(r"src_(\w+)", _view(v))) & set(VIEWS)) - found
    return [v for v in VIEWS if v in found]


def oracle(name: str, body: str) -> None:
    """body: WITH-less SQL; {{more}} CTEs may come before a line `---`. @t is a derived table."""
    body = re.sub(r"@(\w+)", r"src_\1", body)
    ctes, _, last = body.rpartition("---")
    parts = [f"src_{v} AS ({_view(v)})" for v in _needs(body)] + ([ctes.strip().rstrip(",")] if ctes.strip() else [])
    ORACLES[name] = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + last


SYMBOL = "s.id, s.fqn, s.kind, s.accessibility, s.file_path, s.line_start"
TOP_REF = "top AS (SELECT symbol_id AS id FROM @refs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
TOP_CALLEE = "top AS (SELECT callee_symbol_id AS id FROM @call_graph GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
BIG = "big AS (SELECT project_id AS id FROM @symbols GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
REFS = "SELECT r.symbol_id, p.canonical_id AS project, r.file_path, r.line, r.reference_kind, r.access_kind FROM @refs r JOIN top ON r.symbol_id = top.id JOIN @projects p ON p.id = r.in_project_id"

oracle("find_unreferenced", f"SELECT {SYMBOL}, p.canonical_id AS project FROM @symbols s JOIN @projects p ON p.id = s.project_id WHERE NOT p.is_test_project AND NOT EXISTS (SELECT 1 FROM @refs r WHERE r.symbol_id = s.id)")
oracle("find_unreferenced_filtered", f"SELECT {SYMBOL}, p.canonical_id AS project FROM @symbols s JOIN @projects p ON p.id = s.project_id WHERE s.kind = 'method' AND s.accessibility = 'public' AND s.id NOT IN (SELECT symbol_id FROM @refs)")
oracle("index_status", "SELECT canonical_id, is_test_project::INT AS is_test_project, last_indexed_at, (SELECT count(*) FROM @symbols s WHERE s.project_id = p.id) AS symbol_count, (SELECT count(*) FROM @refs r WHERE r.in_project_id = p.id) AS reference_count FROM @projects p")
oracle("freshness", "SELECT min(last_indexed_at) AS index_freshness FROM @symbols")
oracle("find_symbol_exact", f"{TOP_REF} --- SELECT {SYMBOL}, p.canonical_id AS project FROM @symbols s JOIN top ON s.id = top.id JOIN @projects p ON p.id = s.project_id")
oracle("file_symbols", f"SELECT {SYMBOL} FROM @symbols s WHERE file_path = (SELECT file_path FROM @symbols GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
MEMBER = "('method', 'constructor', 'property', 'field', 'event', 'indexer')"
oracle("type_members", f"t AS (SELECT * FROM @symbols WHERE kind = 'class' ORDER BY id LIMIT 1) --- SELECT s.id, s.fqn, s.kind, 0 AS inherited FROM @symbols s, t WHERE s.file_path = t.file_path AND starts_with(s.fqn, t.fqn || '.') AND s.kind IN {MEMBER}")
oracle("type_members_inherited", f"""
  t AS (SELECT * FROM @symbols WHERE id = (SELECT min(from_symbol_id) FROM @relationships WHERE kind = 'inherits')),
  w AS (SELECT fqn, file_path, 0 AS inherited FROM t UNION ALL SELECT b.fqn, b.file_path, 1 FROM @relationships r JOIN t ON r.from_symbol_id = t.id JOIN @symbols b ON b.id = r.to_symbol_id WHERE r.kind = 'inherits')
  --- SELECT s.id, s.fqn, s.kind, w.inherited FROM @symbols s JOIN w ON s.file_path = w.file_path WHERE starts_with(s.fqn, w.fqn || '.') AND s.kind IN {MEMBER}""")
oracle("find_references_flat", f"{TOP_REF} --- {REFS}")
oracle("find_references_access_filter", f"{TOP_REF} --- {REFS} WHERE r.access_kind = 'read'")
oracle("find_references_scope_project", f"{TOP_REF} --- {REFS} WHERE r.in_project_id = (SELECT min(in_project_id) FROM @refs x JOIN top ON x.symbol_id = top.id)")
oracle("find_references_scope_solution", f"{TOP_REF} --- {REFS} WHERE p.n_regionkey = 1")
oracle("find_references_include_projects", f"{TOP_REF} --- {REFS} WHERE p.id <= 12")
oracle("find_references_grouped_counts", "SELECT p.canonical_id AS project, r.reference_kind, grouping(p.canonical_id, r.reference_kind)::BIGINT AS level, count(*) AS count FROM @refs r JOIN @projects p ON p.id = r.in_project_id GROUP BY GROUPING SETS ((p.canonical_id, r.reference_kind), (p.canonical_id), ())")
oracle("find_references_nested", f"{TOP_REF}, x AS ({REFS}) --- SELECT reference_kind AS kind, sum(count(*)) OVER (PARTITION BY reference_kind)::BIGINT AS total, file_path AS file, count(*) AS count, count(*) AS items FROM x GROUP BY 1, 3")
oracle("implementors", "top AS (SELECT to_symbol_id AS id FROM @relationships WHERE kind = 'implements' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) --- SELECT s.id AS symbol_id, s.fqn, r.kind AS relationship FROM @relationships r JOIN top ON r.to_symbol_id = top.id JOIN @symbols s ON s.id = r.from_symbol_id WHERE r.kind IN ('implements', 'overrides')")
oracle("type_dependents", """
  top AS (SELECT to_symbol_id AS id FROM @relationships WHERE kind <> 'parameterof' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  x AS (SELECT r.kind, s.fqn, s.line_start, CASE WHEN contains(s.fqn, '(') THEN regexp_replace(split_part(s.fqn, '(', 1), '\\.[^.]*$', '') END AS holder
        FROM @relationships r JOIN top ON r.to_symbol_id = top.id JOIN @symbols s ON s.id = r.from_symbol_id)
  --- SELECT coalesce(t.fqn, x.fqn) AS dependent, x.kind AS dependency, count(*) AS count, count(t.fqn) AS members, min(x.line_start)::BIGINT AS first_line FROM x LEFT JOIN @symbols t ON t.fqn = x.holder GROUP BY 1, 2""")
ORIGINS = f"{TOP_CALLEE}, f AS (SELECT a.*, c.call_site_line, s.fqn AS caller FROM @call_graph c JOIN top ON c.callee_symbol_id = top.id JOIN @argument_flow a ON a.call_graph_id = c.id JOIN @symbols s ON s.id = c.caller_symbol_id)"
oracle("trace_origins", f"{ORIGINS} --- SELECT parameter_name, first_value(parameter_ordinal) OVER w::BIGINT AS ordinal, count(*) OVER (PARTITION BY parameter_name) AS count, caller, call_site_line::BIGINT AS line, argument_expression, argument_kind FROM f WINDOW w AS (PARTITION BY parameter_name ORDER BY call_graph_id, parameter_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
oracle("trace_origins_ordinal", f"{ORIGINS} --- SELECT parameter_name, count(*) AS count FROM f GROUP BY 1 HAVING bool_or(parameter_ordinal = 1)")
oracle("trace_destinations", f"{TOP_CALLEE} --- SELECT c.id AS call_graph_id, s.fqn AS caller, c.call_site_line::BIGINT AS line, coalesce(r.destination_kind, 'unknown') AS destination_kind, r.destination_variable FROM @call_graph c JOIN top ON c.callee_symbol_id = top.id JOIN @symbols s ON s.id = c.caller_symbol_id LEFT JOIN @return_flow r ON r.call_graph_id = c.id")


def _walk(edges: str, root: str, levels: int) -> str:
    """CTE walk(src, dst, e, depth): edges of each node at its smallest depth; edges is a query (src, dst, e)."""
    return f"""edges AS MATERIALIZED ({edges}),
      reach(node, d) AS (SELECT ({root}), 0 UNION SELECT edges.dst, d + 1 FROM reach JOIN edges ON edges.src = node WHERE d < {levels - 1}),
      least_d AS (SELECT node, min(d) AS d FROM reach GROUP BY node),
      walk AS (SELECT src, dst, e, d + 1 AS depth FROM least_d JOIN edges ON src = node)"""


for _name, _src, _dst, _levels in (("call_hierarchy_callees", "caller", "callee", 5), ("call_hierarchy_callers", "callee", "caller", 5), ("call_hierarchy_callees_depth1", "caller", "callee", 1)):
    _root = f"SELECT {_src}_symbol_id FROM @call_graph GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"
    oracle(_name, _walk(f"SELECT {_src}_symbol_id AS src, {_dst}_symbol_id AS dst, id AS e FROM @call_graph", _root, _levels) + " --- SELECT e AS edge_id, dst AS symbol_id, fqn, depth::BIGINT AS depth FROM walk JOIN @symbols s ON s.id = dst")
oracle("call_reach_all", """
  e AS MATERIALIZED (SELECT caller_symbol_id AS src, callee_symbol_id AS dst FROM @call_graph),
  l0 AS (SELECT id AS root, id AS node FROM @symbols WHERE kind = 'constructor'),
  l1 AS (SELECT DISTINCT root, dst AS node FROM l0 JOIN e ON src = node EXCEPT SELECT * FROM l0),
  l2 AS (SELECT DISTINCT root, dst AS node FROM l1 JOIN e ON src = node EXCEPT (SELECT * FROM l0 UNION SELECT * FROM l1)),
  m AS (SELECT root, dst FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) JOIN e ON src = node)
  --- SELECT root, count(DISTINCT dst) AS reached, count(*) AS edges FROM m GROUP BY root""")
for _name, _src, _dst, _pick in (("type_hierarchy_up", "from", "to", "max(from_symbol_id)"), ("type_hierarchy_down", "to", "from", "min(to_symbol_id)")):
    oracle(_name, _walk(f"SELECT {_src}_symbol_id AS src, {_dst}_symbol_id AS dst, 0 AS e FROM @relationships WHERE kind = 'inherits'", f"SELECT {_pick} FROM @relationships WHERE kind = 'inherits'", 21) + " --- SELECT dst AS symbol_id, fqn, depth::BIGINT AS depth FROM walk JOIN @symbols s ON s.id = dst")
oracle("project_deps_direct", "SELECT consumer_project_id AS from_project_id, dependency_project_id AS to_project_id, reference_kind, 0::BIGINT AS depth FROM @project_dependencies WHERE consumer_project_id = (SELECT consumer_project_id FROM @project_dependencies GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
oracle("project_deps_transitive", _walk("SELECT consumer_project_id AS src, dependency_project_id AS dst, reference_kind AS e FROM @project_dependencies", "SELECT max(consumer_project_id) FROM @project_dependencies", 60) + " --- SELECT src AS from_project_id, dst AS to_project_id, e AS reference_kind, (depth - 1)::BIGINT AS depth FROM walk")
for _name, _src, _dst, _table in (("relationship_levels", "from_symbol_id", "to_symbol_id", "relationships"), ("dependency_levels", "consumer_project_id", "dependency_project_id", "project_dependencies")):
    oracle(_name, f"""
  e AS MATERIALIZED (SELECT DISTINCT {_src} AS src, {_dst} AS dst FROM @{_table}),
  reach(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst),
  ring AS (SELECT a.src AS node, min(a.dst) AS cycle FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY 1),
  grp AS MATERIALIZED (SELECT node, cycle, coalesce(cycle, node) AS g FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) LEFT JOIN ring USING (node)),
  between AS MATERIALIZED (SELECT DISTINCT a.g AS src, b.g AS dst FROM e JOIN grp a ON a.node = e.src JOIN grp b ON b.node = e.dst WHERE a.g <> b.g),
  ways(g, d) AS (SELECT DISTINCT g, 0 FROM grp UNION SELECT between.src, d + 1 FROM ways JOIN between ON between.dst = g),
  highest AS (SELECT g, max(d)::BIGINT AS level FROM ways GROUP BY 1)
  --- SELECT node, level, cycle FROM grp JOIN highest USING (g)""")
oracle("dependent_files", "c AS (SELECT DISTINCT file_path FROM @symbols WHERE id <= 10) --- SELECT DISTINCT r.file_path FROM @refs r JOIN @symbols s ON s.id = r.symbol_id WHERE s.file_path IN (SELECT file_path FROM c) AND r.file_path NOT IN (SELECT file_path FROM c)")
oracle("api_surface", f"{BIG} --- SELECT s.id, s.fqn, s.accessibility FROM @symbols s JOIN big ON s.project_id = big.id WHERE s.accessibility IN ('public', 'protected')")
RANK = "CASE {} WHEN 'public' THEN 5 WHEN 'protected_internal' THEN 4 WHEN 'protected' THEN 3 WHEN 'internal' THEN 2 WHEN 'private_protected' THEN 1 WHEN 'private' THEN 0 ELSE -1 END"


def _diff(where: str) -> str:
    return f"""d AS (SELECT coalesce(o.fqn, n.fqn) AS fqn,
        CASE WHEN n.fqn IS NULL THEN 'Symbol removed' WHEN o.fqn IS NULL THEN 'Symbol added' WHEN o.signature_hash <> n.signature_hash THEN 'Signature changed'
             WHEN {RANK.format('n.accessibility')} < {RANK.format('o.accessibility')} THEN 'Accessibility reduced' END AS reason
      FROM (SELECT * FROM @snapshots WHERE git_commit = 'c1' {where}) o FULL JOIN (SELECT * FROM @snapshots WHERE git_commit = 'c2' {where}) n ON o.fqn = n.fqn),
      diff AS (SELECT fqn, CASE reason WHEN 'Symbol added' THEN 'additive' ELSE 'breaking' END AS classification, reason FROM d WHERE reason IS NOT NULL)"""


oracle("api_surface_diff", _diff("") + " --- SELECT * FROM diff")
oracle("api_overall", f"{BIG}, {_diff('AND project_id = (SELECT id FROM big)')} --- SELECT CASE WHEN bool_or(classification = 'breaking') THEN 'breaking' WHEN count(*) > 0 THEN 'additive' ELSE 'nonbreaking' END AS overall FROM diff")
oracle("latest_snapshot", "SELECT project_id, git_commit, count(*) AS count FROM @snapshots s WHERE captured_at = (SELECT max(captured_at) FROM @snapshots x WHERE x.project_id = s.project_id) GROUP BY 1, 2")
oracle("previous_commit", f"{BIG} --- SELECT git_commit, max(captured_at) AS captured_at FROM @snapshots JOIN big ON project_id = big.id WHERE git_commit <> 'c2' GROUP BY 1 ORDER BY 2 DESC LIMIT 1")
oracle("snapshot_capture", """
  n AS (SELECT project_id, 'c2' AS git_commit, 3000::BIGINT AS captured_at FROM @symbols WHERE accessibility IN ('public', 'protected') AND project_id IN (SELECT dependency_project_id FROM @project_dependencies)),
  u AS (SELECT * FROM n UNION ALL SELECT project_id, git_commit, captured_at FROM @snapshots WHERE git_commit <> 'c2' OR project_id NOT IN (SELECT project_id FROM n))
  --- SELECT *, count(*) AS count FROM u GROUP BY 1, 2, 3""")
oracle("impact_consumers", f"""
  dc AS (SELECT dependency_project_id AS pid, count(*) AS n FROM @project_dependencies GROUP BY 1),
  root AS (SELECT s.id, s.project_id FROM @symbols s JOIN dc ON dc.pid = s.project_id WHERE kind = 'method' AND accessibility = 'public' ORDER BY dc.n DESC, s.id LIMIT 1),
  {_diff('AND project_id = (SELECT project_id FROM root)')},
  api AS (SELECT count(*) AS n FROM @snapshots WHERE git_commit = 'c2' AND symbol_id = (SELECT id FROM root))
  --- SELECT d.consumer_project_id, p.canonical_id AS project, (SELECT count(*) FROM @refs r WHERE r.symbol_id = root.id AND r.in_project_id = d.consumer_project_id AND r.in_project_id <> root.project_id) AS reference_count,
      d.submodule_pinned_commit, (d.submodule_pinned_commit IS NOT NULL)::INT AS pin_includes_current, (api.n > 0)::INT AS is_api_surface,
      CASE WHEN api.n > 0 THEN (SELECT CASE WHEN bool_or(classification = 'breaking') THEN 'breaking' WHEN count(*) > 0 THEN 'additive' ELSE 'nonbreaking' END FROM diff) END AS change_classification
    FROM @project_dependencies d JOIN root ON d.dependency_project_id = root.project_id JOIN @projects p ON p.id = d.consumer_project_id CROSS JOIN api""")
HAS = "attributes IS NOT NULL AND list_contains(CAST(json_extract_string(attributes, '$[*]') AS VARCHAR[]), '{}')"
oracle("find_by_attribute", f"SELECT {SYMBOL} FROM @symbols s WHERE {HAS.format('global::NUnit.Framework.TestAttribute')}")
oracle("find_by_attribute_scope", f"SELECT {SYMBOL} FROM @symbols s JOIN @projects p ON p.id = s.project_id WHERE p.n_regionkey = 2 AND {HAS.format('global::Xunit.FactAttribute')}")
#: Parameters of a signature of the derived tables: generic arguments go first, then commas are counted.
COUNT = "CASE WHEN signature IS NULL OR NOT contains(signature, '(') OR contains(signature, '()') THEN 0 ELSE len(regexp_replace(regexp_extract(signature, '\\((.*)\\)', 1), '<[^>]*>', '', 'g')) - len(replace(regexp_replace(regexp_extract(signature, '\\((.*)\\)', 1), '<[^>]*>', '', 'g'), ',', '')) + 1 END"
oracle("find_by_signature", f"x AS (SELECT id, fqn, signature FROM @symbols WHERE kind IN ('method', 'constructor') AND signature ILIKE '%Task %' AND signature ILIKE '%(%string%' ORDER BY id LIMIT 800) --- SELECT * FROM x WHERE {COUNT} = 3 ORDER BY id LIMIT 400")
oracle("find_by_signature_strict", f"SELECT id, fqn, signature FROM @symbols WHERE kind IN ('method', 'constructor') AND signature ILIKE '%void %' AND {COUNT} = 2 ORDER BY id LIMIT 50")
XU, NU = HAS.format("global::Xunit.FactAttribute"), HAS.format("global::NUnit.Framework.TestAttribute")
TESTS = f"tests AS (SELECT s.*, CASE WHEN {XU} THEN 'xunit' ELSE 'nunit' END AS framework FROM @symbols s WHERE ({XU}) OR ({NU}))"
oracle("find_tests_all", f"{TESTS} --- SELECT id, fqn, framework FROM tests")
oracle("find_tests_framework", f"{TESTS} --- SELECT id, fqn, framework FROM tests WHERE framework = 'nunit'")
USED = "used AS (SELECT r.symbol_id, t.id AS test FROM @refs r JOIN tests t ON t.file_path = r.file_path AND r.line BETWEEN t.line_start AND t.line_end)"
oracle("find_tests_for_symbol", f"{TESTS}, {USED} --- SELECT id, fqn, framework FROM tests WHERE id IN (SELECT test FROM used WHERE symbol_id = (SELECT min(symbol_id) FROM used)) ORDER BY id LIMIT 50")
oracle("find_tests_fallback", f"{TESTS} --- SELECT id, fqn, framework FROM tests WHERE contains(lower(display_name), 'type1') OR contains(lower(split_part(split_part(fqn, '(', 1), '.', -2)), 'type1') ORDER BY id LIMIT 500")
oracle("test_references", f"{TESTS}, {USED} --- SELECT test AS test_id, count(*) AS count FROM used GROUP BY 1")
NAMED = "SELECT c.id, c.file_path, c.line, c.tag, c.text, s.fqn AS enclosing_symbol FROM @comments c LEFT JOIN @symbols s ON s.id = c.enclosing_symbol_id"
oracle("find_comments_tag", f"{NAMED} WHERE tag = 'TODO' ORDER BY c.file_path, c.line, c.id LIMIT 40")
oracle("find_comments_search", f"{BIG} --- SELECT id, file_path, line, tag FROM @comments c WHERE text ILIKE '%%B%' AND project_id = (SELECT id FROM big) ORDER BY file_path, line, id LIMIT 30")
oracle("find_comments_in_symbol", "SELECT c.id, c.line, c.tag, s.fqn AS enclosing_symbol FROM @comments c JOIN @symbols s ON s.id = c.enclosing_symbol_id WHERE s.id = (SELECT min(enclosing_symbol_id) FROM @comments)")
oracle("comment_enclosing_symbol", "SELECT c.id, c.line, (SELECT s.id FROM @symbols s WHERE s.project_id = c.project_id AND s.file_path = c.file_path AND c.line BETWEEN s.line_start AND s.line_end ORDER BY s.line_start DESC, s.id LIMIT 1) AS enclosing_symbol_id FROM @comments c")
NS = "ns AS (SELECT regexp_extract(fqn, '^(.*)\\.[^.]*$', 1) AS ns FROM @symbols WHERE kind IN ('class', 'interface', 'struct', 'enum', 'delegate', 'record'))"


def _tree(depth: int, prefix: str | None) -> str:
    level = depth + (prefix.count(".") + 1 if prefix else 0)
    only = f"WHERE starts_with(ns, '{prefix}.')" if prefix else "WHERE ns <> ''"
    child = f"array_to_string(string_split(ns, '.')[1:{level}], '.')"
    return f"SELECT c.namespace, (SELECT count(*) FROM ns WHERE ns = c.namespace OR starts_with(ns, c.namespace || '.')) AS type_count FROM (SELECT DISTINCT {child} AS namespace FROM ns {only}) c"


oracle("namespace_tree", f"{NS} --- {_tree(1, None)}")
oracle("namespace_tree_depth2", f"{NS} --- {_tree(2, 'global::Org1')} UNION ALL {_tree(3, None)}")
oracle("namespace_symbols", "n AS (SELECT regexp_extract(fqn, '^(.*)\\.[^.]*$', 1) AS ns FROM @symbols WHERE kind = 'class' ORDER BY id LIMIT 1) --- SELECT s.id, s.fqn, s.kind FROM @symbols s, n WHERE regexp_extract(s.fqn, '^(.*)\\.[^.]*$', 1) = n.ns")


def _bm25(rows: str, text: str, words: list[str], every: bool) -> str:
    """CTE hits(id, score) over rows (a query of id, and text as a string)."""
    tests = ", ".join(f"'{w}'" for w in words)
    return f"""base AS MATERIALIZED ({rows}),
      tok AS MATERIALIZED (SELECT id, list_filter(regexp_split_to_array(lower(strip_accents({text})), '[^\\pL\\pN\\p{{Co}}]+'), lambda x: x <> '') AS ts FROM base),
      st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM tok),
      q AS (SELECT unnest([{tests}]) AS w),
      tf AS MATERIALIZED (SELECT id, w, len(list_filter(ts, lambda x: x = w)) AS f, len(ts) AS len FROM tok, q WHERE list_contains(ts, w)),
      df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
      hits AS (SELECT id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))) AS score
               FROM tf JOIN df USING (w), st GROUP BY id {f'HAVING count(*) = {len(words)}' if every else ''})"""


TEXT = "coalesce(display_name, '') || ' ' || coalesce(doc_comment, '')"
oracle("bm25_symbols", _bm25("SELECT * FROM @symbols", TEXT, ["widget", "economy"], True) + " --- SELECT id, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, id LIMIT 20")
oracle("bm25_kind_filter", _bm25("SELECT * FROM @symbols", TEXT, ["m1", "type1", "type2"], False) + " --- SELECT id, kind, round(score, 6) AS score FROM hits JOIN @symbols s USING (id) WHERE kind = 'class' ORDER BY hits.score DESC, id LIMIT 20")
oracle("find_symbol_fuzzy", _bm25("SELECT * FROM @symbols", TEXT, ["m1", "m2", "type1"], False) + " --- SELECT s.id, fqn, p.canonical_id AS project, round(score, 6) AS score FROM (SELECT * FROM hits ORDER BY score DESC, id LIMIT 20) h JOIN @symbols s ON s.id = h.id JOIN @projects p ON p.id = s.project_id")
oracle("bm25_documents", _bm25("SELECT doc_id AS id, text FROM documents", "text", ["the", "with"], True) + " --- SELECT id AS doc_id, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, id LIMIT 25")
for _name in ("bm25_indexed", "bm25_indexed_update"):
    ORACLES[_name] = ORACLES["bm25_documents"]
oracle("bm25_expression", r"""
  tok AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\pL\pN\p{Co}]+'), lambda x: x <> '') AS ts FROM documents),
  places AS MATERIALIZED (
    SELECT doc_id, len(ts) AS len, coalesce(ts[1] LIKE 'th%', false)::INT AS p1, len(list_filter(range(1, len(ts)), lambda i: ts[i] = 'of' AND ts[i + 1] = 'the')) AS p0,
           list_filter(range(1, len(ts) + 1), lambda i: ts[i] = 'with') AS w, list_filter(range(1, len(ts) + 1), lambda i: ts[i] = 'was') AS s, len(list_filter(ts, lambda x: x = 'that')) AS p4 FROM tok),
  near AS MATERIALIZED (
    SELECT *, (SELECT count(DISTINCT a.x) FROM unnest(w) a(x), unnest(s) b(x) WHERE abs(a.x - b.x) <= 4) AS p2, (SELECT count(DISTINCT b.x) FROM unnest(w) a(x), unnest(s) b(x) WHERE abs(a.x - b.x) <= 4) AS p3 FROM places),
  c AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (p0 > 0) AS d0, count(*) FILTER (p1 > 0) AS d1, count(*) FILTER (len(w) > 0) AS d2, count(*) FILTER (len(s) > 0) AS d3 FROM near),
  weighed AS (
    SELECT doc_id, p0 > 0 AND p1 > 0 AS l, p2 > 0 AND p3 > 0 AND p4 = 0 AS r, 1.2 * (0.25 + 0.75 * len / mean) AS k,
           greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) AS i0, greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) AS i1,
           greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) AS i2, greatest(ln((n - d3 + 0.5) / (d3 + 0.5)), 1e-6) AS i3, p0, p1, p2, p3 FROM near, c),
  hits AS (
    SELECT doc_id, CASE WHEN l THEN i0 * p0 * 2.2 / (p0 + k) + i1 * p1 * 2.2 / (p1 + k) ELSE 0 END + CASE WHEN r THEN i2 * p2 * 2.2 / (p2 + k) + i3 * p3 * 2.2 / (p3 + k) ELSE 0 END AS score
    FROM weighed WHERE l OR r)
  --- SELECT doc_id, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, doc_id LIMIT 200""")
oracle("debounce_sessions", """
  e AS (SELECT 'u' || user_id AS root, '/src/' || lower(event_type) || '.cs' AS path, epoch_us(ts) AS us FROM events),
  m AS (SELECT *, CASE WHEN us < lag(us) OVER (PARTITION BY root ORDER BY us) + 1800000000 THEN 0 ELSE 1 END AS fresh FROM e),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY root ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM m)
  --- SELECT root, min(us) AS start_us, max(us) + 1800000000 AS end_us, array_to_string(list_sort(list_distinct(list(path))), ',') AS paths FROM g GROUP BY root, s""")
oracle("changed_files", """
  SELECT project_id, file_path, CASE WHEN id % 11 = 0 THEN 'deleted' ELSE 'changed' END AS change FROM @file_index WHERE id % 11 = 0 OR id % 7 = 0
  UNION ALL SELECT project_id, file_path || '.new', 'added' FROM @file_index WHERE id % 13 = 0""")
oracle("signature_changed", "SELECT project_id, fqn, file_path FROM @symbols WHERE id % 17 = 0")
oracle("upsert_last_wins", "SELECT id, project_id, file_path, CASE WHEN id % 5 = 0 THEN 'new' ELSE content_hash END AS content_hash FROM @file_index")
oracle("insert_or_ignore", "SELECT solution_id, project_id FROM @solution_projects UNION SELECT solution_id % 3 + 1, project_id FROM @solution_projects")
oracle("cascade_delete", """
  s AS (SELECT id FROM @symbols WHERE id % 3 <> 0), c AS (SELECT id FROM @call_graph WHERE caller_symbol_id % 3 <> 0 AND callee_symbol_id % 3 <> 0)
  --- SELECT 'symbols' AS table_name, count(*) AS rows FROM s UNION ALL SELECT 'refs', count(*) FROM @refs WHERE symbol_id % 3 <> 0
  UNION ALL SELECT 'relationships', count(*) FROM @relationships WHERE from_symbol_id % 3 <> 0 AND to_symbol_id % 3 <> 0 UNION ALL SELECT 'call_graph', count(*) FROM c
  UNION ALL SELECT 'argument_flow', count(*) FROM @argument_flow WHERE call_graph_id IN (SELECT id FROM c) UNION ALL SELECT 'return_flow', count(*) FROM @return_flow WHERE call_graph_id IN (SELECT id FROM c)
  UNION ALL SELECT 'comments', count(*) FROM @comments""")
oracle("set_null_comments", "SELECT id, CASE WHEN enclosing_symbol_id % 3 <> 0 THEN enclosing_symbol_id END AS enclosing_symbol_id FROM @comments")
oracle("cascade_files", "c AS (SELECT DISTINCT file_path FROM @symbols WHERE id % 97 = 0) --- SELECT DISTINCT r.file_path, 'background' AS priority FROM @refs r JOIN @symbols s ON s.id = r.symbol_id WHERE s.file_path IN (SELECT file_path FROM c) AND r.file_path NOT IN (SELECT file_path FROM c)")
oracle("canonical_ids", "SELECT n_nationkey, substr(sha256('https://example.com/org' || n_regionkey || '|src/' || n_name), 1, 16) AS canonical_id FROM nation")
oracle("url_normalise", r"""
  SELECT page_id, 0::BIGINT AS form, regexp_replace(regexp_replace(regexp_replace(url, '\.git$', ''), '[?#].*$', ''), '/$', '') AS url FROM pages WHERE url IS NOT NULL
  UNION ALL SELECT page_id, 1, 'https://github.com/' || page_id FROM pages WHERE url IS NOT NULL UNION ALL SELECT page_id, 2, 'https://github.com/Org/' || page_id FROM pages WHERE url IS NOT NULL""")
oracle("strip_xml", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages")
oracle("source_context", r"""
  b AS (SELECT doc_id, regexp_replace(text, '(\r\n|\r|\n)$', '') AS body FROM documents WHERE text <> ''),
  l AS (SELECT doc_id, unnest(string_split_regex(body, '\r\n|\r|\n')) AS text, generate_subscripts(string_split_regex(body, '\r\n|\r|\n'), 1) AS line FROM b)
  --- SELECT doc_id, line::BIGINT AS line, text FROM l WHERE line BETWEEN 1 AND 5""")
oracle("count_parameters", f"SELECT id, ({COUNT})::BIGINT AS parameters FROM @symbols")
oracle("name_parts", f"""
  SELECT id, regexp_extract(fqn, '^(.*)\\.[^.]*$', 1) AS namespace, split_part(split_part(fqn, '(', 1), '.', -1) AS simple, regexp_extract(split_part(fqn, '(', 1), '^(.*)\\.[^.]*$', 1) AS holder,
         regexp_replace(split_part(file_path, '/', -1), '\\.[^.]*$', '') AS stem, ({RANK.format('accessibility')})::BIGINT AS rank FROM @symbols""")

#: CTE l(file_path, content, k): lines of the files, numbered.
FILES = "t AS (SELECT file_path, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM @file_texts), ls AS (SELECT file_path, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS ls FROM t), l AS (SELECT file_path, unnest(ls) AS content, unnest(generate_series(1, len(ls))) AS k FROM ls)"
oracle("find_symbol_source", f"{FILES} --- SELECT s.id, p.canonical_id AS project, s.line_end, l.k AS line_number, l.content FROM (SELECT * FROM @symbols WHERE kind = 'class' ORDER BY id LIMIT 1) s JOIN @projects p ON p.id = s.project_id JOIN l ON l.file_path = s.file_path AND l.k BETWEEN s.line_start AND s.line_end")
oracle("find_references_source", f"{TOP_REF}, {FILES} --- SELECT r.file_path, r.line, r.reference_kind, r.access_kind, l.k AS line_number, l.content FROM @refs r JOIN top ON r.symbol_id = top.id JOIN l ON l.file_path = r.file_path AND abs(l.k - r.line) <= 3")
oracle("call_hierarchy_source", _walk("SELECT callee_symbol_id AS src, caller_symbol_id AS dst, id AS e FROM @call_graph", "SELECT callee_symbol_id FROM @call_graph GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1", 2) + f", {FILES} --- SELECT e AS edge_id, l.k AS line_number, l.content FROM walk JOIN @call_graph c ON c.id = e JOIN l ON l.file_path = c.call_site_file AND abs(l.k - c.call_site_line) <= 3")
oracle("test_projects", "SELECT id, canonical_id, (id IN (SELECT project_id FROM @assemblies WHERE reference ILIKE '%xunit%' OR reference ILIKE '%nunit%' OR reference ILIKE '%mstest.testframework%' OR reference ILIKE '%microsoft.net.test.sdk%'))::INT AS is_test_project FROM @projects")
oracle("dependency_kinds", """
  SELECT d.consumer_project_id, d.dependency_project_id, CASE WHEN p.n_regionkey = 1 THEN 'submodule_ref' ELSE 'project_ref' END AS reference_kind, CASE WHEN p.n_regionkey = 1 THEN 'c0ffee' || p.id END AS submodule_pinned_commit
  FROM @project_dependencies d JOIN @projects p ON p.id = d.dependency_project_id
  UNION ALL SELECT project_id, 0, 'nuget_ref', regexp_extract(reference, '(?i)/packages/([^/]+)/', 1) FROM @assemblies WHERE reference ILIKE '%/packages/%'""")
oracle("submodule_report", "SELECT 'lib/' || n_name AS path, md5(n_name) AS commit FROM nation WHERE n_nationkey % 4 <> 3")
oracle("file_submodules", "SELECT f.file_path, 'SRC/' || upper(p.assembly_name) || '/' AS submodule FROM (SELECT DISTINCT file_path FROM @symbols) f LEFT JOIN @projects p ON p.id % 2 = 0 AND starts_with(lower(f.file_path), 'src/' || lower(p.assembly_name) || '/')")
oracle("comment_extract", """
  SELECT p_partkey::VARCHAR AS file_path, c.line::BIGINT AS line, c.tag, CASE c.line WHEN 2 THEN p_name WHEN 3 THEN p_type WHEN 5 THEN p_name WHEN 6 THEN 'a b' ELSE p_brand END AS text
  FROM part, (VALUES (2, 'TODO'), (3, 'FIXME'), (5, 'TODO'), (6, 'HACK'), (8, 'NOTE')) c(line, tag)""")
oracle("context_snippets", r"d AS (SELECT doc_id, text, greatest(length(text) // 10 - 60, 0) AS a, least(length(text) // 5 + 60, length(text)) AS b FROM documents) --- SELECT doc_id, substr(trim(regexp_replace(substr(text, a + 1, b - a), '\s+', ' ', 'g')), 1, 120) AS snippet FROM d")
oracle("cited_names", "SELECT id, split_part(fqn, '(', 1) AS name FROM @symbols UNION ALL SELECT id, 'global::Org0.None' FROM @symbols")
oracle("cited_symbols", "SELECT fqn AS citation, min(id) AS id, min_by(file_path, id) AS file_path FROM @symbols WHERE NOT contains(fqn, '(') GROUP BY fqn")
oracle("profile_names", "n AS (SELECT unnest([p_name, p_brand, p_type, p_type || '_' || p_size, '']) AS name FROM part) --- SELECT name, count(*) AS count, regexp_full_match(name, '[a-zA-Z0-9_-]+')::INT AS valid FROM n GROUP BY 1")
oracle("target_frameworks", "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'net' || p_size || '.0' END AS framework FROM part")
oracle("generated_files", r"SELECT p_partkey, p_brand || '/' || e.path AS path, e.generated, e.ignored FROM part, (VALUES ('a/b.cs', 0, 0), ('a/b.G.cs', 1, 0), ('a/B.Designer.cs', 1, 0), ('a/obj/b.cs', 1, 1), ('a\OBJ\b.cs', 1, 1), ('a/bin/b.cs', 0, 1), ('a/.git/x', 0, 1), ('object/b.cs', 0, 0)) e(path, generated, ignored)")
oracle("resolved_names", "SELECT r.from_symbol_id, r.kind, (SELECT max(x.id) FROM @symbols x WHERE x.fqn = s.fqn) AS to_symbol_id FROM @relationships r JOIN @symbols s ON s.id = r.to_symbol_id WHERE r.to_symbol_id % 7 <> 0")
oracle("append_rows", "SELECT kind, count(*) AS count FROM (SELECT kind FROM @relationships UNION ALL SELECT kind || '2' FROM @relationships) GROUP BY 1")
QUEUE = "q AS (SELECT event_id AS seq, CASE WHEN event_type = 'click' THEN 'immediate' ELSE 'background' END AS priority FROM events)"
oracle("queue_head", f"{QUEUE} --- SELECT * FROM q ORDER BY priority DESC, seq LIMIT 100")
oracle("service_report", f"{QUEUE} --- SELECT 'indexing' AS state, count(*) FILTER (priority = 'immediate') AS queued_files, count(*) FILTER (priority <> 'immediate') AS background_tasks, (SELECT max(last_indexed_at) FROM @projects) AS last_indexed_at, (SELECT count(*) FROM @projects) AS project_count, 'extract' AS phase, NULL::BIGINT AS indexing_started_at, NULL::BIGINT AS elapsed_ms FROM q")
oracle("apply_changes_counts", """
  f AS (SELECT project_id, file_path FROM @symbols WHERE kind IN ('class', 'interface') AND id % 5 = 1),
  own AS (SELECT s.id FROM @symbols s JOIN f USING (project_id, file_path)),
  gone AS (SELECT id FROM own WHERE id % 3 = 0),
  r AS (SELECT r.*, f.file_path IS NOT NULL AS changed FROM @refs r LEFT JOIN f ON f.project_id = r.in_project_id AND f.file_path = r.file_path)
  --- SELECT 'symbols' AS table_name, count(*) AS rows FROM @symbols WHERE id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'refs', count(*) FROM r WHERE CASE WHEN changed THEN line <= 100 AND symbol_id % 3 <> 0 ELSE symbol_id NOT IN (SELECT id FROM gone) END
  UNION ALL SELECT 'relationships', count(*) FROM @relationships WHERE from_symbol_id NOT IN (SELECT id FROM own) AND to_symbol_id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'call_graph', count(*) FROM @call_graph WHERE caller_symbol_id NOT IN (SELECT id FROM own) AND callee_symbol_id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'comments', count(*) FROM @comments WHERE (project_id, file_path) NOT IN (SELECT (project_id, file_path) FROM f)""")
ORACLES["published_changes_counts"] = ORACLES["apply_changes_counts"]
