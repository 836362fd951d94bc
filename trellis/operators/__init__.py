"""Query operators: functions of an index that return DataFrames."""

from .api import api_surface, capture_snapshot, diff_surfaces, impact, latest_snapshot, overall_change, previous_commit, surface_changes
from .graph import bfs_edges, call_hierarchy, call_reach, cycles, dependency_levels, dependent_files, implementors, project_dependencies, type_dependents, type_hierarchy
from .maintenance import append, cascade_delete, delete_keys, insert_ignore, set_null, upsert
from .references import find_references, group_counts, grouped_references, trace_destinations, trace_origins
from .scope import with_scope
from .search import bm25, match_terms, semantic_search
from .source import with_context, with_declaration
from .symbols import (
    daemon_status,
    enclosing_symbols,
    file_symbols,
    find_by_attribute,
    find_by_signature,
    find_comments,
    find_symbol,
    find_tests,
    find_unreferenced,
    freshness,
    index_status,
    service_status,
    namespace_symbols,
    namespace_tree,
    resolve_citations,
    source_context,
    type_members,
)

__all__ = [n for n in dir() if not n.startswith("_")]
