"""A code index derived from star-schema tables, as plain views that two SQL dialects share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Index
from ..config import Config
from ..schemas import TABLES
from .versions import materialize, tasks_for


def _t(sql: str) -> str:
    """#x# is x as text."""
    return re.sub(r"#([^#]+)#", lambda m: f"cast({m[1]} as varchar(20))", sql)


#: Every row of the tables counts; references go to every third member, so that the others have none.
#: Views in order of use. {name} is a table or an earlier view, <<x>> the first 16 digits of x's SHA-256.
VIEWS: dict[str, str] = {k: _t(v) for k, v in {
    "projects": """
        select cast(n_nationkey + 1 as bigint) as id,
               <<'https://example.com/org' || #n_regionkey# || '|src/' || n_name || '/' || n_name || '.csproj'>> as canonical_id,
               'https://example.com/org' || #n_regionkey# as git_remote_url,
               'src/' || n_name || '/' || n_name || '.csproj' as repo_relative_path, n_name as assembly_name,
               n_regionkey, n_nationkey, case when n_nationkey % 5 = 4 then true else false end as is_test_project,
               cast(1704067200000 + n_nationkey as bigint) as last_indexed_at
        from {nation}""",
    "types": """
        select cast(s_suppkey + 1 as bigint) as id, p.id as project_id,
               'global::Org' || #n_regionkey# || '.' || assembly_name || '.Type' || #s_suppkey# as fqn,
               'Type' || #s_suppkey# as display_name,
               case when s_suppkey % 4 = 0 then 'interface' else 'class' end as kind,
               case s_suppkey % 3 when 0 then 'public' when 1 then 'internal' else 'protected' end as accessibility,
               cast(null as varchar(200)) as signature, s_name as doc_comment,
               'src/' || assembly_name || '/Type' || #s_suppkey# || '.cs' as file_path,
               1 as line_start, 100000 as line_end, cast(null as varchar(200)) as attributes, s_suppkey
        from {supplier} join {projects} p on p.id = s_nationkey + 1""",
    "members": """
        select cast(1000000 + p_partkey as bigint) as id, t.project_id,
               t.fqn || '.M' || #p_partkey# || '(' || case p_size % 4 when 0 then '' when 1 then 'string' when 2 then 'string, int' else 'string, Dictionary<string, int>, bool' end || ')' as fqn,
               'M' || #p_partkey# as display_name,
               case when p_partkey % 10 = 9 then 'constructor' else 'method' end as kind,
               case p_partkey % 4 when 0 then 'public' when 1 then 'private' when 2 then 'protected' else 'internal' end as accessibility,
               'public ' || case p_size % 3 when 0 then 'void' when 1 then 'Task' else 'string' end || ' M' || #p_partkey# || '(' || case p_size % 4 when 0 then '' when 1 then 'string input' when 2 then 'string data, int count' else 'string key, Dictionary<string, int> values, bool overwrite' end || ')' as signature,
               p_name || ' ' || p_brand || ' ' || p_type as doc_comment, t.file_path,
               cast(2 + 10 * p.slot as int) as line_start, cast(9 + 10 * p.slot as int) as line_end,
               case when p_size % 10 = 0 then '["global::Xunit.FactAttribute"]' when p_size % 10 = 5 then '["global::System.ObsoleteAttribute","global::NUnit.Framework.TestAttribute"]' else null end as attributes,
               t.s_suppkey, p_partkey
        from (select p_partkey, p_name, p_brand, p_type, p_size, p_partkey % k.n as own, (p_partkey - p_partkey % k.n) / k.n as slot
              from {part} cross join (select count(*) as n from {supplier}) k) p
        join {types} t on t.s_suppkey = p.own""",
    "symbols": """
        select id, project_id, fqn, display_name, kind, accessibility, signature, doc_comment, file_path, line_start, line_end, attributes, 1704067200000 + id as last_indexed_at from {types}
        union all
        select id, project_id, fqn, display_name, kind, accessibility, signature, doc_comment, file_path, line_start, line_end, attributes, 1704067200000 + id from {members}""",
    "refs": """
        select distinct 1000000 + l_partkey - l_partkey % 3 as symbol_id, t.project_id as in_project_id, t.file_path, cast(l_orderkey % 200 + 1 as int) as line,
               case l_linenumber % 3 when 0 then 'invocation' when 1 then 'typeref' else 'objectcreation' end as reference_kind,
               case l_linenumber % 4 when 0 then 'read' when 1 then 'write' when 2 then 'readwrite' else null end as access_kind
        from {lineitem} join {types} t on t.s_suppkey = l_suppkey""",
    "call_graph": """
        select caller_symbol_id, callee_symbol_id, m.file_path as call_site_file, call_site_line, caller_symbol_id * 100000000000 + callee_symbol_id * 1000 + call_site_line as id
        from (select distinct 1000000 + l_partkey as caller_symbol_id, 1000000 + (l_partkey * 7 + l_linenumber * 13) % k.n as callee_symbol_id, cast(l_orderkey % 200 + 1 as int) as call_site_line
              from {lineitem} cross join (select count(*) as n from {part}) k) x
        join {members} m on m.id = x.caller_symbol_id""",
    "relationships": """
        select c.id as from_symbol_id, b.id as to_symbol_id, 'inherits' as kind from {types} c join {types} b on b.s_suppkey * 3 + 1 = c.s_suppkey
        union all select c.id, b.id, 'inherits' from {types} c join {types} b on b.s_suppkey * 3 + 2 = c.s_suppkey
        union all select c.id, b.id, 'implements' from {types} c join {types} b on b.s_suppkey = (c.s_suppkey % 5) * 4 where b.kind = 'interface' and c.kind = 'class'
        union all select m.id, t.id, 'returns' from {members} m join {types} t on t.s_suppkey = m.p_partkey % 7 where m.p_partkey % 3 = 0
        union all select t.id, m.id, 'parameterof' from {members} m join {types} t on t.s_suppkey = m.p_partkey % 11 where m.p_partkey % 5 = 0
        union all select m.id, t.id, 'instantiates' from {members} m join {types} t on t.s_suppkey = m.p_partkey % 13 where m.p_partkey % 4 = 1""",
    "project_dependencies": """
        select cast(c.n_nationkey + 1 as bigint) as consumer_project_id, cast(d.n_nationkey + 1 as bigint) as dependency_project_id,
               case when c.n_nationkey % 4 = 0 then 'submodule_ref' else 'project_ref' end as reference_kind,
               case when c.n_nationkey % 4 = 0 then 'c0ffee' || #d.n_nationkey# else null end as submodule_pinned_commit
        from {nation} c join {nation} d on d.n_nationkey * 2 = c.n_nationkey - c.n_nationkey % 2 and d.n_nationkey < c.n_nationkey
             or (d.n_nationkey = c.n_nationkey - 3 and c.n_nationkey % 3 = 0)""",
    "snapshots": """
        select s.project_id, s.id as symbol_id, s.fqn, s.accessibility,
               <<coalesce(s.signature, s.fqn) || case when v.c = 'c1' and s.id % 17 = 0 then 'old' else '' end>> as signature_hash, v.c as git_commit, v.t as captured_at
        from {symbols} s cross join (select 'c1' as c, cast(1000 as bigint) as t union all select 'c2', cast(2000 as bigint)) v
        where s.accessibility in ('public', 'protected') and not (v.c = 'c1' and s.id % 19 = 0) and not (v.c = 'c2' and s.id % 23 = 0)""",
    "comments": """
        select p_partkey as id, project_id, file_path, cast(line_start + p_partkey % 12 as int) as line,
               case p_partkey % 4 when 0 then 'TODO' when 1 then 'HACK' when 2 then 'FIXME' else 'NOTE' end as tag, doc_comment as text,
               case when p_partkey % 12 < 8 then id else null end as enclosing_symbol_id
        from {members}""",
    "argument_flow": """
        select id as call_graph_id, 0 as parameter_ordinal, 'input' as parameter_name,
               case call_site_line % 3 when 0 then 'literal' when 1 then 'variable' else 'method_call' end as argument_kind, 'a' || #call_site_line# as argument_expression from {call_graph}
        union all select id, 1, 'count', 'literal', #call_site_line# from {call_graph} where call_site_line % 2 = 0""",
    "return_flow": """
        select id as call_graph_id, id as id, case call_site_line % 4 when 0 then 'assignment' when 1 then 'discard' when 2 then 'return' else 'await' end as destination_kind,
               case when call_site_line % 4 = 0 then 'v' else null end as destination_variable from {call_graph} where call_site_line % 5 <> 0""",
    "solutions": "select cast(r_regionkey + 1 as bigint) as id, 'org' || #r_regionkey# || '.sln' as file_path, r_name as name from {region}",
    "solution_projects": "select cast(n_regionkey + 1 as bigint) as solution_id, id as project_id from {projects}",
    "file_texts": "select t.file_path, d.text from {types} t join {documents} d on d.doc_id = t.s_suppkey",
    "assemblies": """
        select p_partkey % 25 + 1 as project_id, case p_partkey % 3 when 0 then 'C:/Users/u/.nuget/packages/' when 1 then '/root/.nuget/Packages/' else '/usr/lib/' end
               || case when p_partkey % 97 = 0 then 'XUnit.Core' else replace(p_name, ' ', '.') end || '/1.' || #p_size# || '/lib/a.dll' as reference
        from {part}""",
    "file_index": "select doc_id as id, doc_id % 25 + 1 as project_id, 'doc' || #doc_id# as file_path, <<text>> as content_hash from {documents}",
}.items()}

SOURCES = ("region", "nation", "supplier", "part", "lineitem", "documents")

#: Views that are written when first asked for: queries and other views read calls several times, and each time would derive them
#: anew from all of lineitem. Types are few, and once written their size is known to whoever joins them.
WRITTEN = ("types", "call_graph")

#: How a view wants a table dealt: by what it groups or joins first, so that neither the distinct nor the join in it shuffles the rows again.
DEALT = {("call_graph", "lineitem"): "1000000 + l_partkey", ("refs", "lineitem"): "1000000 + l_partkey - l_partkey % 3"}


def spark_sql(view: str) -> str:
    return re.sub(r"<<(.*?)>>", r"substr(sha2(\1, 256), 1, 16)", VIEWS[view], flags=re.S)


def _views(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """The derived tables by name, each planned when it is first asked for."""
    made: dict[str, DataFrame] = {}

    def used(view: str, name: str) -> DataFrame:
        df, by = get(name), DEALT.get((view, name))
        return df if by is None else df.repartition(tasks_for(spark, df.count()), F.expr(by))

    def get(name: str) -> DataFrame:
        if name not in made:
            if name in SOURCES:
                made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            else:
                uses = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
                view = spark.sql(spark_sql(name), **{u: used(name, u) for u in uses})
                made[name] = materialize(view) if name in WRITTEN else view
        return made[name]

    return get


def from_star(spark: SparkSession, sf_dir: str, config: Config | None = None) -> Index:
    """The index of the star-schema tables under a folder."""
    get = _views(spark, sf_dir)
    return Index(spark, {n: (lambda n=n: get(n)) for n in VIEWS if n in TABLES}, config)


def star_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table that is none of an index's."""
    return _views(spark, sf_dir)(name)
