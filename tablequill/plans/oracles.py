"""DuckDB SQL for every registered query, over the same fixtures."""

from __future__ import annotations

from tablequill import constants as K
from tablequill.operators.prompts import STYLE_TEXTS
from tablequill.plans.fixtures import NL, PER_TABLE, RUNS, oracle
from tablequill.plans.queries import (
    FIRST_N,
    MAX_LENGTH,
    MAX_PER_DB,
    SAMPLE,
    TOP_DATABASES,
    VECTOR_THRESHOLD,
)

ORACLES: dict[str, str] = {}

SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _text(value: str) -> str:
    """A string literal that may hold line breaks."""
    return "'" + value.replace("'", "''").replace("\n", f"' || {NL} || '") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"


def occurrences(x: str, needle: str) -> str:
    return f"((length({x}) - length(replace({x}, '{needle}', ''))) // {len(needle)})"


def pct(part: str, total: str) -> str:
    return f"case when {total} > 0 then 100 * {part} / {total} else 0.0::double end"


def lines(*parts: str) -> str:
    return f" || {NL} || ".join(parts)


STOP = _list(K.STOP_WORDS)
WEAK = _list(K.WEAK_WORDS)

# --- sources and sinks ---------------------------------------------------------------

ORACLES["src_jsonl_roundtrip"] = oracle(
    "select cast(example_id as varchar) as example_id, dataset, schema_id, question, sql,"
    " complexity, source from fx_corpora"
)
ORACLES["src_last_by_key"] = """
select id, ord, page_title, segment from (
  select 'n' || cast(c_nationkey as varchar) as id, c_custkey as ord, c_name as page_title,
    c_mktsegment as segment,
    row_number() over (partition by c_nationkey order by c_custkey desc) as rn
  from customer) where rn = 1
"""
ORACLES["src_json_array"] = oracle(
    f"select schema_id as db_id, cast(table_ord * {PER_TABLE} + col_ord + 1 as int) as idx,"
    " table_ord, col_name from fx_columns"
    " union all select distinct schema_id, 0, -1, '*' from fx_columns"
)
ORACLES["src_json_array_cut"] = ORACLES["src_json_array"]
ORACLES["src_rename_corpora"] = oracle("""
select example_id, dataset, question, sql, ddl, complexity, source, instruction from (
  select example_id, dataset, question, sql, ddl, null as complexity, null as source,
    null as instruction from fx_corpora_ddl where dataset = 'ddl_context'
  union all
  select example_id, dataset, question, sql, ddl, complexity, null, null
  from fx_corpora_ddl where dataset = 'synthetic'
  union all
  select example_id, dataset, null, sql, null, null, coalesce(source, 'unknown'), question
  from fx_corpora_ddl where dataset = 'instruction') u
""")
ORACLES["src_first_schema_per_db"] = oracle("""
select db_id, payload from (
  select schema_id as db_id, question as payload,
    row_number() over (partition by schema_id order by
      case when contains(question, '?') then 1 else 2 end, example_id) as rn
  from fx_questions) where rn = 1
""")

SPLIT = (
    "split as (select *, case when row_number() over (partition by dataset order by example_id)"
    " <= count(*) over (partition by dataset) * 9 // 10 then 'train' else 'dev' end as split"
    " from fx_corpora)"
)
ORACLES["src_counts"] = oracle(
    "select dataset, split, count(*) as rows from split group by dataset, split", SPLIT
)
ORACLES["src_file_counts"] = (
    "select 'documents.parquet' as file_name, count(*) as rows from documents"
    " union all select 'conversations.parquet', count(*) from conversations"
)
# the documents are stored in the order of their ids
ORACLES["src_ordinal"] = "select doc_id, row_number() over (order by doc_id) - 1 as ord from documents"
ORACLES["src_ordinal_lines"] = oracle(
    "select example_id, question, row_number() over (order by example_id) - 1 as ord from fx_corpora"
)
ORACLES["src_schema_counts"] = oracle(
    "select count(distinct schema_id) + (select count(*) from region) as schemas,"
    " count(distinct schema_id) as with_tables from fx_columns"
)
ORACLES["sink_jsonl"] = oracle(
    "select cast(example_id as varchar) as example_id, question,"
    " cast(case when source is null then 6 else 7 end as int) as keys from fx_corpora_ddl"
)
USER_TEXT = f"ddl || {NL} || {NL} || 'Question: ' || question"
ORACLES["sink_alpaca"] = oracle(
    f"select {_text(K.INSTRUCTION)} as instruction, {USER_TEXT} as input, sql as output"
    " from fx_corpora_ddl"
)
ORACLES["sink_chat"] = oracle(
    f"select 0 as place, 'system' as role, {_text(K.CHAT_SYSTEM)} as content from fx_corpora_ddl"
    f" union all select 1, 'user', {USER_TEXT} from fx_corpora_ddl"
    " union all select 2, 'assistant', sql from fx_corpora_ddl"
)
_PARTS = "case when complexity = 'subqueries' then 'dev' else 'train' end"
ORACLES["sink_corpus"] = oracle(
    "select format, split, row_number() over (partition by format, split order by place, example_id) - 1 as ord,"
    " text from (select *, case split when 'train' then md5('42:' || cast(example_id as varchar)) else dataset end"
    " as place from (select *, {parts} as split from fx_corpora_ddl) x cross join ("
    "select 'lines' as format union all select 'instruction' union all select 'chat') f"
    " cross join lateral (select sql || ':' || case format when 'lines' then question else {user} end as text) t) y"
    .format(parts=_PARTS, user=USER_TEXT)
)
ORACLES["sink_partitioned"] = oracle("select example_id, dataset, split, sql from split", SPLIT)

# --- schema graph ------------------------------------------------------------------------

IDX = f"cast(table_ord * {PER_TABLE} + col_ord + 1 as int)"
ORACLES["graph_nodes_from_catalog"] = oracle(f"""
select schema_id, table_ord, table_name, {IDX} as col_ord, col_name,
  case when schema_id like '%4' and {IDX} = max({IDX}) over (partition by schema_id)
    then 'text' else dtype end as dtype, is_pk
from fx_columns
""")
ORACLES["graph_tables_from_catalog"] = oracle(
    "select schema_id, table_ord, table_name from fx_tables"
)
ORACLES["graph_fk_resolve"] = oracle("select * from fx_fks")
ORACLES["graph_nodes_single_table"] = oracle(r"""
select id as schema_id,
  case when coalesce(page_title, '') = '' then 'table'
    else regexp_replace(replace(replace(page_title, ' ', '_'), '-', '_'), '[^\p{L}\p{N}_]', '', 'g')
  end as table_name,
  cast(i as int) as col_ord, [h1, h2, h3, h4, h5][i + 1] as col_name,
  ['text', 'real', 'text', 'text', 'real'][i + 1] as dtype, i = 0 as is_pk
from (select *, unnest(range(0, n_types)) as i from fx_single_tables)
""")

DDL = r"(?i)CREATE\s+TABLE\s+(\w+)\s*\(([^)]+)\)"
_TYPES = (
    f"case when w[2] is null then 'text' when lower(w[2]) in {tuple(K.TEXT_TYPES)} then 'text'"
    f" when lower(w[2]) in {tuple(K.NUMBER_TYPES)} then 'number' else lower(w[2]) end"
)
DDL_CTES = [
    f"""defs as (
      select schema_id, cast(i as int) as def_ord, names[i + 1] as table_name, bodies[i + 1] as body
      from (select schema_id, names, bodies, unnest(range(0, len(names))) as i from (
        select schema_id, regexp_extract_all(ddl, '{DDL}', 1) as names,
          regexp_extract_all(ddl, '{DDL}', 2) as bodies from fx_ddl)))""",
    rf"""every as (
      select schema_id, def_ord, table_name, cast(j as int) as col_ord, w[1] as col_name,
        {_TYPES} as dtype,
        contains(upper(part), 'PRIMARY') and contains(upper(part), 'KEY') as is_pk
      from (select *, {words('part')} as w from (
        select schema_id, def_ord, table_name, j, parts[j + 1] as part from (
          select *, unnest(range(0, len(parts))) as j from (
            select *, string_split(body, ',') as parts from defs))))
      where len(w) > 0)""",
    """nodes as (
      select schema_id, table_name, min(def_ord) as table_ord, max(def_ord) as last_def
      from defs group by schema_id, table_name)""",
    """cols as (
      select e.schema_id, n.table_ord, e.table_name, e.col_ord, e.col_name, e.dtype, e.is_pk
      from every e join nodes n
        on n.schema_id = e.schema_id and n.table_name = e.table_name and n.last_def = e.def_ord)""",
    """fks as (
      select schema_id, def_ord, col_ord, from_table, from_column, to_table, to_column from (
        select r.schema_id, r.def_ord, r.col_ord, r.table_name as from_table,
          r.col_name as from_column, t.table_name as to_table,
          coalesce(
            (select arg_min(c.col_name, c.col_ord) from cols c
             where c.schema_id = r.schema_id and c.table_name = t.table_name and c.is_pk),
            (select arg_max(c.col_name, c.col_ord) from cols c
             where c.schema_id = r.schema_id and c.table_name = t.table_name
               and lower(c.col_name) in ('id', lower(r.col_name)))) as to_column
        from every r join (
          select schema_id, lower(table_name) as low, arg_min(table_name, table_ord) as table_name
          from nodes group by all) t
          on t.schema_id = r.schema_id
            and t.low || '_id' = lower(r.col_name)
      ) where to_column is not null and from_table <> to_table)""",
]
ORACLES["graph_nodes_from_ddl"] = oracle("""
select c.schema_id, c.table_ord, c.table_name, c.col_ord, c.col_name, c.dtype, c.is_pk,
  f.ref is not null and c.col_ord = m.first_ord as is_fk,
  case when c.col_ord = m.first_ord then f.ref.t end as fk_table,
  case when c.col_ord = m.first_ord then f.ref.c end as fk_column
from cols c
join (select schema_id, table_name, col_name, min(col_ord) as first_ord from cols group by all) m
  on m.schema_id = c.schema_id and m.table_name = c.table_name and m.col_name = c.col_name
left join (
  select schema_id, from_table, from_column,
    arg_max({'t': to_table, 'c': to_column}, def_ord * 100000 + col_ord) as ref
  from fks group by all) f
  on f.schema_id = c.schema_id and f.from_table = c.table_name and f.from_column = c.col_name
""", *DDL_CTES)
_NO_TYPE = "cast('0x' || substr(md5(col_name), 1, 7) as int) % 7 = 0"
ORACLES["graph_nodes_from_strict_ddl"] = oracle(f"""
select schema_id, table_ord, table_name, col_ord, col_name,
  case when dtype <> 'time' then dtype when {_NO_TYPE} then 'text' else 'timestamp' end as dtype,
  is_pk, is_fk, fk_table, fk_column
from fx_columns
""")
ORACLES["graph_fk_declared"] = oracle(
    "select schema_id, from_table, from_column, to_table, to_column from fx_fks"
)
ORACLES["graph_fk_infer"] = oracle(
    "select schema_id, from_table, from_column, to_table, to_column from fks", *DDL_CTES
)


def _edges(columns: str, fks: str) -> str:
    return f"""
    select schema_id, table_name as source, table_name || '.' || col_name as target,
      'table_column' as edge_type from {columns}
    union all
    select schema_id, from_table || '.' || from_column, to_table || '.' || to_column, 'foreign_key'
    from {fks}
    union all
    select schema_id, from_table, to_table, 'table_table' from {fks}
    """


ORACLES["graph_edges"] = oracle(_edges("fx_columns", "fx_fks"))
ORACLES["graph_edges_from_ddl"] = oracle(_edges("every", "fks"), *DDL_CTES)
ORACLES["graph_mark_keys"] = oracle("""
select c.schema_id, c.table_ord, c.table_name, c.col_ord, c.col_name, c.dtype,
  c.col_name like '%\\_status' escape '\\' and c.col_ord = (
    select min(d.col_ord) from fx_columns d where d.schema_id = c.schema_id
      and d.table_name = c.table_name and d.col_name = c.col_name) as is_pk,
  c.is_fk, c.fk_table,
  case when c.is_fk then (
    select case when f.fk_ord > 1 then 'moved' else c.fk_column end from fx_fks f
    where f.schema_id = c.schema_id and f.from_table = c.table_name
      and f.from_column = c.col_name) end as fk_column
from fx_columns c
""".replace("\\\\", "\\"))
ORACLES["graph_lookups"] = oracle("""
select 'primary_key' as kind, schema_id, table_name as source, col_name as target
from fx_columns where is_pk
union all select 'foreign_key', schema_id, table_name, col_name from fx_columns where is_fk
union all select 'fk_edge', schema_id, from_table || '.' || from_column,
  to_table || '.' || to_column from fx_fks
union all select 'relation', schema_id, from_table, to_table from fx_fks
""")
ORACLES["graph_summary"] = oracle(f"""
select t.schema_id, t.n_tables, e.n_edges from
  (select schema_id, count(*) as n_tables from fx_tables group by all) t
  join (select schema_id, count(*) as n_edges from ({_edges('fx_columns', 'fx_fks')}) x
        group by all) e using (schema_id)
""")

# --- schema text ----------------------------------------------------------------------------


def _cols_cte(column: str, sep: str) -> str:
    return (
        f"tab as (select schema_id, table_ord, table_name, string_agg({column}, {sep} order by col_ord)"
        " as cols from fx_columns group by all)"
    )


def _body_cte(line: str, sep: str) -> str:
    return (
        f"body as (select schema_id, string_agg({line}, {sep} order by table_ord) as body"
        " from tab group by all)"
    )


def _fk_cte(line: str) -> str:
    return (
        f"fkt as (select schema_id, string_agg({line}, {NL} order by fk_ord) as fk_text"
        " from fx_fks group by all)"
    )


SRC, TGT = "from_table || '.' || from_column", "to_table || '.' || to_column"


def _schema_oracle(column, col_sep, line, line_sep, fk_line, text) -> str:
    return oracle(
        f"select b.schema_id, {text} as text from body b left join fkt using (schema_id)",
        _cols_cte(column, col_sep), _body_cte(line, line_sep), _fk_cte(fk_line),
    )


ORACLES["text_basic"] = _schema_oracle(
    "col_name", "', '", "'Table: ' || table_name || '(' || cols || ')'", NL,
    f"'Foreign Key: ' || {SRC} || ' -> ' || {TGT}",
    f"concat_ws({NL}, 'Schema Graph:', body, fk_text)",
)
DETAIL = (
    "col_name || ' (' || dtype || case when is_pk then ', PK' else '' end"
    " || case when is_fk then ', FK->' || fk_table || '.' || fk_column else '' end || ')'"
)
ORACLES["text_detailed"] = _schema_oracle(
    DETAIL, "', '", f"'Table: ' || table_name || {NL} || '  Columns: ' || cols", NL,
    f"'  ' || {SRC} || ' = ' || {TGT}",
    f"'Schema:' || {NL} || body || coalesce({NL} || 'Relations:' || {NL} || fk_text, '')",
)
ORACLES["text_typed"] = _schema_oracle(
    "'  [' || case when is_pk then 'column_primary' when is_fk then 'column_foreign'"
    " else 'column' end || '] ' || col_name", NL,
    f"'[table] ' || table_name || {NL} || cols", NL,
    f"'[foreign_key_edge] ' || {SRC} || ' -> ' || {TGT}",
    f"concat_ws({NL}, body, fk_text)",
)
COMPACT = (
    "col_name || case when is_pk then '*' else '' end"
    " || case when is_fk then '^' || fk_table || '.' || fk_column else '' end"
)
ORACLES["text_compact"] = _schema_oracle(
    COMPACT, "', '", "table_name || '(' || cols || ')'", "' | '", "''", "'Tables: ' || body"
)
STRUCTURED_COL = (
    "'    ' || col_name || case when is_pk and is_fk then ' (PK, FK)' when is_pk then ' (PK)'"
    " when is_fk then ' (FK)' else '' end"
)
SECTIONS = (
    f"'[DATABASE]' || {NL} || schema_id || {NL} || {NL} || '[TABLES]' || {NL} || body"
    f" || coalesce({NL} || {NL} || '[FOREIGN KEYS]' || {NL} || fk_text, '')"
)
STRUCTURED_CTES = [
    _cols_cte(STRUCTURED_COL, NL),
    _body_cte(f"table_name || ':' || {NL} || cols", NL),
    _fk_cte(f"{SRC} || ' -> ' || {TGT}"),
]
STRUCTURED_TEXT = (
    f"texts as (select schema_id, {SECTIONS} as text from body left join fkt using (schema_id))"
)
ORACLES["text_structured"] = oracle("select schema_id, text from texts", *STRUCTURED_CTES, STRUCTURED_TEXT)

_HEADER = (
    "select id as schema_id, {head} || case when n_types > 2"
    " then array_to_string([h1, h2, h3, h4, h5], {sep})"
    " when coalesce(page_title, '') = '' then array_to_string([h1, h2, h3, h4, h5][1:n_types], {sep})"
    " else '(unknown)' end as text from fx_single_tables"
)
ORACLES["text_header"] = oracle(_HEADER.format(head="'Table columns: '", sep="', '"))
ORACLES["text_header_structured"] = oracle(
    _HEADER.format(head=f"{lines(_text('[TABLES]'), _text('table:'), _text('    '))}", sep=f"{NL} || '    '")
)

PARTS = f"""(case when len(list_filter(string_split(lower(replace(col_name, ' ', '_')), '_'),
    lambda p: p <> '' and not list_contains({WEAK}, p))) > 0
  then list_filter(string_split(lower(replace(col_name, ' ', '_')), '_'),
    lambda p: p <> '' and not list_contains({WEAK}, p))
  else string_split(lower(replace(col_name, ' ', '_')), '_') end)"""
SEM_CTES = [
    f"named as (select schema_id, table_name, table_ord, col_ord, table_name || '.' || col_name as full_name,"
    f" {PARTS} as parts from fx_columns)",
    "vec as (select term, vector::double[] as v from fx_term_vectors)",
    "part as (select distinct schema_id, unnest(parts) as term from named)",
    """sim as (select a.schema_id, a.term as p, b.term as q, list_cosine_similarity(va.v, vb.v) as s
      from part a join part b on a.schema_id = b.schema_id
      join vec va on va.term = a.term join vec vb on vb.term = b.term)""",
    """cand as (select a.schema_id, a.full_name as source, b.full_name as target,
        a.parts as ap, b.parts as bp, a.table_ord as o1, a.col_ord as o2, b.table_ord as o3, b.col_ord as o4
      from named a join named b on a.schema_id = b.schema_id
        and (a.table_ord, a.col_ord) < (b.table_ord, b.col_ord) and a.table_name <> b.table_name)""",
    """one as (select c.schema_id, c.source, c.target, o1, o2, o3, o4, max(s.s) as score
      from (select *, unnest(ap) as p from cand where len(ap) = 1 or len(bp) = 1) c
      join sim s on s.schema_id = c.schema_id and s.p = c.p and list_contains(c.bp, s.q)
      group by all)""",
    """both_ends as (select c.schema_id, c.source, c.target, o1, o2, o3, o4, (f.s + l.s) / 2 as score,
        f.s as fs, l.s as ls
      from cand c
      join sim f on f.schema_id = c.schema_id and f.p = c.ap[1] and f.q = c.bp[1]
      join sim l on l.schema_id = c.schema_id and l.p = c.ap[-1] and l.q = c.bp[-1]
      where len(c.ap) > 1 and len(c.bp) > 1)""",
    f"""pairs as (
      select p.schema_id, p.source, p.target, round(p.score, 6) as score, o1, o2, o3, o4 from (
        select schema_id, source, target, o1, o2, o3, o4, score from one
          where score >= {VECTOR_THRESHOLD}
        union all
        select schema_id, source, target, o1, o2, o3, o4, score from both_ends
          where fs >= {VECTOR_THRESHOLD} and ls >= {VECTOR_THRESHOLD}) p
      where not exists (select 1 from fx_fks f where f.schema_id = p.schema_id
        and ((f.from_table || '.' || f.from_column = p.source and f.to_table || '.' || f.to_column = p.target)
          or (f.from_table || '.' || f.from_column = p.target and f.to_table || '.' || f.to_column = p.source))))""",
    f"""top5 as (select * from (select *, cast(row_number() over (partition by schema_id
      order by score desc, o1, o2, o3, o4) as int) as rank from pairs)
      where rank <= {K.SEMANTIC_LINKS_PER_SCHEMA})""",
]
ORACLES["sem_name_parts"] = oracle(
    f"select schema_id, table_name, col_ord, array_to_string({PARTS}, '|') as parts from fx_columns"
)
ORACLES["sem_pairs"] = oracle("select schema_id, source, target, score from pairs", *SEM_CTES)
ORACLES["sem_top5"] = oracle("select schema_id, source, target, score, rank from top5", *SEM_CTES)
ORACLES["sem_top5_of_pairs"] = ORACLES["sem_top5"]
ORACLES["text_dispatch"] = oracle(
    f"""
    select 'structured' as style, schema_id,
      text || coalesce({NL} || {NL} || '[SEMANTIC LINKS]' || {NL} || sem, '') as text
    from texts left join (select schema_id, string_agg(source || ' ≈ ' || target, {NL} order by rank) as sem
      from top5 group by all) s using (schema_id)
    union all
    select 'compact', schema_id, 'Database: ' || schema_id || {NL} || 'Tables: ' || cbody
      || coalesce({NL} || sem, '')
    from (select schema_id, string_agg(table_name || '(' || cols || ')', ' | ' order by table_ord) as cbody
      from (select schema_id, table_ord, table_name, string_agg({COMPACT}, ', ' order by col_ord) as cols
        from fx_columns group by all) group by all) c
    left join (select schema_id, string_agg('Semantic Link: ' || source || ' ≈ ' || target, {NL} order by rank) as sem
      from top5 group by all) s using (schema_id)
    """,
    *STRUCTURED_CTES, STRUCTURED_TEXT, *SEM_CTES,
)

UNQUOTED = "case when {x} like '\"%\"' and length({x}) > 1 then substr({x}, 2, length({x}) - 2) else {x} end"
ORACLES["text_to_catalog"] = oracle(
    """
    select schema_id, table_name, line_ord, col_name from prim
    union all
    select schema_id, table_name, line_ord, col_name from (
      select schema_id, line_ord, trim(parts[1]) as table_name,
        trim(string_split(trim(parts[2]), '(')[1]) as col_name
      from (select *, string_split(line, ':') as parts from raw) r
      where len(parts) = 2 and not starts_with(line, '[') and not starts_with(line, '#')
        and not exists (select 1 from prim p where p.schema_id = r.schema_id))
    where table_name <> '' and col_name <> ''
    """,
    f"""raw as (select schema_id, cast(i - 1 as int) as line_ord, {strip('ls[i]')} as line from (
      select schema_id, string_split(schema, {NL}) as ls, unnest(generate_series(1, len(ls))) as i
      from fx_schema_text))""",
    """sect as (select *, sum(case when starts_with(line, '[') and ends_with(line, ']') and line <> '[TABLES]'
      then 1 else 0 end) over (partition by schema_id order by line_ord) as sec
      from raw where line <> '')""",
    """ins as (select *, max(case when line = '[TABLES]' then 1 else 0 end)
      over (partition by schema_id, sec order by line_ord) as inside from sect)""",
    """opn as (select *, max(case when inside = 1 and ends_with(line, ':') then line_ord end)
      over (partition by schema_id, sec order by line_ord) as opened from ins)""",
    f"""colrows as (select o.schema_id, o.opened, o.line_ord,
        {UNQUOTED.format(x="trim(substr(t.line, 1, length(t.line) - 1))")} as table_name,
        {UNQUOTED.format(x="trim(string_split(o.line, '(')[1])")} as col_name
      from opn o join opn t on t.schema_id = o.schema_id and t.line_ord = o.opened
      where o.inside = 1 and not ends_with(o.line, ':') and o.line <> '[TABLES]'
        and not (starts_with(o.line, '[') and ends_with(o.line, ']')))""",
    """prim as (select * from (
      select *, max(opened) over (partition by schema_id, table_name) as last_open from colrows
      where col_name <> '' and not starts_with(col_name, '#') and not starts_with(col_name, '--')
        and table_name <> '') where opened = last_open)""",
)

# --- schema linking ---------------------------------------------------------------------------


def _link_ctes(questions: str) -> list[str]:
    """String links to tables (tl) and columns (cl) with their place in the list."""
    return [
        f"q as (select example_id, schema_id, question, lower(question) as low, {words('lower(question)')} as ws"
        f" from {questions})",
        """qt as (select q.*, t.table_name, lower(t.table_name) as tlow, t.table_ord
          from q join fx_tables t using (schema_id))""",
        f"""tl as (
          select example_id, substr(question, strpos(low, tlow), length(table_name)) as question_text,
            table_name as schema_element, 'table' as link_type, 1.0::double as confidence,
            strpos(low, tlow) - 1 as span_start, strpos(low, tlow) - 1 + length(table_name) as span_end,
            0 as stage, table_ord as o1, 0 as o2, 0 as o3
          from qt where contains(low, tlow)
          union all
          select example_id, ws[i], table_name, 'table', {K.TABLE_PARTIAL_CONFIDENCE}::double,
            strpos(low, ws[i]) - 1, strpos(low, ws[i]) - 1 + length(ws[i]), 0, table_ord, i - 1, 0
          from (select *, unnest(generate_series(1, len(ws))) as i from qt where not contains(low, tlow))
          where length(ws[i]) > 3 and contains(tlow, ws[i]))""",
        f"""qc as (select q.*, c.table_name || '.' || c.col_name as element, c.col_name,
            lower(c.col_name) as clow, c.table_ord, c.col_ord, c.dtype,
            {words("replace(lower(c.col_name), '_', ' ')")} as cw
          from q join fx_columns c using (schema_id))""",
        f"""cl as (
          select example_id, substr(question, strpos(low, clow), length(col_name)) as question_text,
            element as schema_element, 'column' as link_type, 1.0::double as confidence,
            strpos(low, clow) - 1 as span_start, strpos(low, clow) - 1 + length(col_name) as span_end,
            0 as stage, table_ord as o1, col_ord as o2, 0 as o3
          from qc where contains(low, clow)
          union all
          select example_id, cw[i], element, 'column', {K.COLUMN_WORD_CONFIDENCE}::double,
            strpos(low, cw[i]) - 1, strpos(low, cw[i]) - 1 + length(cw[i]), 0, table_ord, col_ord, i - 1
          from (select *, unnest(generate_series(1, len(cw))) as i from qc where not contains(low, clow))
          where length(cw[i]) > 2 and contains(low, cw[i]))""",
    ]


LINK_OUT = (
    "select example_id, question_text, schema_element, link_type, round(confidence, 6) as confidence,"
    " cast(span_start as int) as span_start, cast(span_end as int) as span_end from "
)
ORACLES["link_table_exact"] = oracle(LINK_OUT + "tl where confidence = 1", *_link_ctes("fx_questions")[:3])
ORACLES["link_table_partial"] = oracle(LINK_OUT + "tl where confidence < 1", *_link_ctes("fx_questions")[:3])
ORACLES["link_column_exact"] = oracle(LINK_OUT + "cl where confidence = 1", *_link_ctes("fx_questions"))
ORACLES["link_table_grams"] = oracle(LINK_OUT + "tl", *_link_ctes("fx_questions")[:3])
ORACLES["link_column_grams"] = oracle(LINK_OUT + "cl", *_link_ctes("fx_questions"))
ORACLES["link_column_word"] = oracle(LINK_OUT + "cl where confidence < 1", *_link_ctes("fx_questions"))


def _content_cte(gate: str, longer_than: int) -> str:
    return f"""cw as (select distinct example_id, schema_id, low, w from (
      select example_id, schema_id, low, unnest(ws) as w from q where {gate})
      where length(w) > {longer_than} and not list_contains({STOP}, w))"""


VEC = "vec as (select term, vector::double[] as v from fx_term_vectors)"
VARIANTS = f"""variants as (select schema_id, element, table_ord, col_ord, j, vs[j] as variant from (
  select *, unnest(generate_series(1, len(vs))) as j from (
    select schema_id, table_name || '.' || col_name as element, table_ord, col_ord,
      list_concat([lower(col_name)], list_filter({words("replace(lower(col_name), '_', ' ')")},
        lambda w: length(w) > 2)) as vs from fx_columns)))"""
ORACLES["link_table_vector"] = oracle(
    f"""
    select example_id, w as question_text, table_name as schema_element, 'table' as link_type,
      round(s, 6) as confidence,
      cast(strpos(low, w) - 1 as int) as span_start, cast(strpos(low, w) - 1 + length(w) as int) as span_end
    from cw join near using (schema_id, w)
    """,
    *_link_ctes("fx_questions")[:3], VEC,
    _content_cte("example_id not in (select example_id from tl)", 3),
    # every product of two distinct terms once, the questions are joined to what is left
    "said as materialized (select distinct schema_id, w from cw)",
    f"""near as materialized (select schema_id, w, table_name, s from (
      select schema_id, w, table_name, list_dot_product(a.v, b.v) as s
      from said join fx_tables t using (schema_id)
      join vec a on a.term = w join vec b on b.term = lower(t.table_name)) x where s >= {VECTOR_THRESHOLD})""",
)
ORACLES["link_column_vector"] = oracle(
    f"""
    select example_id, w as question_text, element as schema_element, 'column' as link_type,
      round(arg_min(s, j), 6) as confidence,
      cast(strpos(low, w) - 1 as int) as span_start, cast(strpos(low, w) - 1 + length(w) as int) as span_end
    from (
      select cw.*, x.element, x.j, list_dot_product(a.v, b.v) as s
      from cw join variants x using (schema_id)
      join vec a on a.term = w join vec b on b.term = x.variant)
    where s >= {VECTOR_THRESHOLD}
      and not exists (select 1 from cl where cl.example_id = example_id
        and cl.schema_element = element and cl.question_text = w)
    group by example_id, low, w, element
    """.replace("cl.example_id = example_id", "cl.example_id = z.example_id")
    .replace("    where s >=", "    z where s >="),
    *_link_ctes("fx_questions"), VEC,
    _content_cte(
        "example_id not in (select example_id from cl group by example_id having count(*) >= 3)", 2
    ),
    VARIANTS,
)

VALUE_CTES = [
    rf"""vals as (select example_id, schema_id, question, lower(question) as low,
        cast(i - 1 as int) as value_ord, vs[i] as value from (
      select *, unnest(generate_series(1, len(vs))) as i from (
        select *, list_concat(
          list_transform(regexp_extract_all(question, '"([^"]+)"|''([^'']+)'''), lambda x: substr(x, 2, length(x) - 2)),
          list_filter(regexp_extract_all(question, '[\p{{L}}\p{{N}}_]+'),
            lambda x: regexp_matches(x, '^[A-Z][a-z]+$') and not list_contains({STOP}, lower(x)))) as vs
        from fx_value_questions))
      where not regexp_matches(vs[i], '^\p{{Nd}}+$'))""",
    rf"""vl as (select example_id, value as question_text, table_name || '.' || col_name as schema_element,
        'value' as link_type, conf as confidence,
        strpos(low, lower(value)) - 1 as span_start, strpos(low, lower(value)) - 1 + length(value) as span_end,
        0 as stage, value_ord as o1, table_ord as o2, col_ord as o3
      from (select v.*, c.*, case
          when contains(lower(col_name), 'name') and regexp_matches(value, '^\p{{Lu}}') then 0.8::double
          when contains(lower(col_name), 'date') and (contains(value, '/') or contains(value, '-')) then 0.7::double
          when dtype = 'text' then 0.5::double else 0.0::double end as conf
        from vals v join fx_columns c using (schema_id))
      where conf >= {K.VALUE_THRESHOLD})""",
]
ORACLES["link_value_candidates"] = oracle(
    "select example_id, schema_id, value_ord, value from vals", VALUE_CTES[0]
)
ORACLES["link_value_columns"] = oracle(LINK_OUT + "vl", *VALUE_CTES)
BEST_CTES = [
    *_link_ctes("fx_value_questions"),
    *VALUE_CTES,
    """alls as (select *, row_number() over (partition by example_id order by type_rank, stage, o1, o2, o3) as seq
      from (select *, 0 as type_rank from tl union all select *, 1 from cl union all select *, 2 from vl))""",
    f"""best as (select * from (
      select *, row_number() over (partition by example_id, span_start, span_end
          order by confidence desc, seq) as rn,
        min(seq) over (partition by example_id, span_start, span_end) as first_seq
      from alls) where rn = 1 and confidence >= {K.MIN_CONFIDENCE})""",
]
# the same without value links
BEST_LINKS_NO_VALUES = [
    cte.replace(" union all select *, 2 from vl", "") for cte in BEST_CTES if not cte.startswith(("vals", "vl"))
]
ORACLES["link_best_per_span"] = oracle(LINK_OUT + "best", *BEST_CTES)


def _placed_words(name: str, gate: str, longer_than: int) -> str:
    return f"""{name} as (select distinct example_id, schema_id, low, w, list_position(ws, w) as wpos from (
      select example_id, schema_id, low, ws, unnest(ws) as w from q where {gate})
      where length(w) > {longer_than} and not list_contains({STOP}, w))"""


_SPAN = "strpos(low, w) - 1 as span_start, strpos(low, w) - 1 + length(w) as span_end"
ORACLES["link_best_with_vectors"] = oracle(
    LINK_OUT + "best",
    *_link_ctes("fx_questions"), VEC, VARIANTS,
    _placed_words("tw", "example_id not in (select example_id from tl)", 3),
    _placed_words(
        "kw", "example_id not in (select example_id from cl group by example_id having count(*) >= 3)", 2
    ),
    f"""tv as (select example_id, w as question_text, table_name as schema_element, 'table' as link_type,
        round(list_dot_product(a.v, b.v), 6) as confidence, {_SPAN},
        1 as stage, wpos as o1, table_ord as o2, 0 as o3
      from tw join fx_tables t using (schema_id)
      join vec a on a.term = w join vec b on b.term = lower(t.table_name)
      where list_dot_product(a.v, b.v) >= {VECTOR_THRESHOLD})""",
    f"""cv as (select example_id, w as question_text, element as schema_element, 'column' as link_type,
        round(arg_min(s, j), 6) as confidence, {_SPAN},
        1 as stage, wpos as o1, table_ord as o2, col_ord as o3
      from (select kw.*, x.element, x.j, x.table_ord, x.col_ord, list_dot_product(a.v, b.v) as s
        from kw join variants x using (schema_id)
        join vec a on a.term = w join vec b on b.term = x.variant) z
      where s >= {VECTOR_THRESHOLD} and not exists (select 1 from cl where cl.example_id = z.example_id
        and cl.schema_element = z.element and cl.question_text = z.w)
      group by example_id, low, w, wpos, element, table_ord, col_ord)""",
    """alls as (select *, row_number() over (partition by example_id order by type_rank, stage, o1, o2, o3) as seq
      from (select *, 0 as type_rank from tl union all select *, 0 from tv
        union all select *, 1 from cl union all select *, 1 from cv))""",
    f"""best as (select * from (
      select *, row_number() over (partition by example_id, span_start, span_end
          order by confidence desc, seq) as rn from alls)
      where rn = 1 and confidence >= {VECTOR_THRESHOLD})""",
)
LINKS_TEXT = f"""ltext as (select example_id, coalesce('[SCHEMA LINKS]' || {NL} || body, '') as links_text
  from fx_value_questions left join (
    select example_id, string_agg('Question word "' || question_text || '" → '
      || case link_type when 'table' then 'table' else 'column' end || ': ' || schema_element || ' ('
      || case link_type when 'value' then 'value, ' else '' end
      || 'confidence: ' || printf('%.2f', confidence) || ')', {NL}
      order by type_rank, confidence desc, first_seq) as body
    from best group by example_id) using (example_id))"""
ORACLES["link_text"] = oracle("select example_id, links_text from ltext", *BEST_CTES, LINKS_TEXT)

# --- logical forms -----------------------------------------------------------------------------


def _rendered(header: str) -> str:
    def name(i: str) -> str:
        return f"coalesce(({header})[{i} + 1], '?')"

    aggs = f"{_list(K.AGGREGATES)}[agg + 1]"

    def cond(n: str, value: str) -> str:
        op = f"coalesce({_list(K.CONDITION_OPS)}[{n}_op + 1], '=')"
        return f"'\"' || {name(n + '_col')} || '\" ' || {op} || ' ' || {value}"

    c1, c2 = cond("c1", "'''' || c1_value || ''''"), cond("c2", "c2_value")
    return (
        f"'SELECT ' || case when agg = 0 then '\"' || {name('sel')} || '\"'"
        f" else {aggs} || '(\"' || {name('sel')} || '\")' end || ' FROM \"table\"'"
        f" || case n_conds when 0 then '' when 1 then ' WHERE ' || {c1}"
        f" else ' WHERE ' || {c1} || ' AND ' || {c2} end"
    )


ORACLES["lf_render_sql"] = oracle(
    f"select example_id, {_rendered(_list(['Player', 'No.', 'Team', 'Name', 'Years']))} as sql"
    " from fx_logical_form"
)
PATTERN = (
    "pat as (select example_id, case agg when 1 then 'max' when 2 then 'min' when 3 then 'count'"
    " when 4 then 'sum' when 5 then 'avg' else case when n_conds > 0 then 'where_only'"
    " else 'select_only' end end as pattern from fx_logical_form)"
)
ORACLES["lf_classify"] = oracle("select example_id, pattern from pat", PATTERN)
ORACLES["lf_histogram"] = oracle(
    "select pattern, count(*) as examples from pat group by pattern", PATTERN
)


def _sample(total: int, seed: int) -> str:
    return oracle(
        f"""
        select example_id, pattern from (
          select p.*, row_number() over (partition by pattern
            order by md5('{seed}:' || cast(example_id as varchar)), example_id) as rn
          from pat p) join quota using (pattern)
        where rn <= {total} // n_patterns + case when place < {total} % n_patterns then 1 else 0 end
        """,
        PATTERN,
        f"""quota as (select pattern, list_position({_list(K.PATTERNS)}, pattern) - 1 as place,
          (select count(distinct pattern) from pat) as n_patterns from (select distinct pattern from pat))""",
    )


ORACLES["lf_balanced_sample"] = _sample(SAMPLE, 42)
ORACLES["lf_balanced_dev"] = _sample(min(SAMPLE // 5, 1000), 43)
LOGICAL = rf"""logical as (select example_id, id as schema_id, question, {_rendered('[h1, h2, h3, h4, h5]')} as sql,
  '[TABLES]' || {NL} || case when coalesce(page_title, '') = '' then 'table'
    else regexp_replace(replace(replace(page_title, ' ', '_'), '-', '_'), '[^\p{{L}}\p{{N}}_]', '', 'g') end
  || ':' || {NL} || '    ' || array_to_string(list_concat([h1 || ' (PK)'], [h2, h3, h4, h5][1:n_types - 1]), {NL} || '    ') as schema
  from fx_logical_form join fx_single_tables on id = table_id)"""
ORACLES["corpus_logical_form"] = oracle("select * from logical", LOGICAL)

# --- corpora ---------------------------------------------------------------------------------------

ORACLES["split_positional"] = oracle("select example_id, dataset, split from split", SPLIT)
ORACLES["filter_complexity"] = oracle("""
select example_id, dataset, complexity,
  case when row_number() over (partition by dataset order by example_id)
    <= count(*) over (partition by dataset) * 9 // 10 then 'train' else 'dev' end as split
from fx_corpora where complexity in ('single join', 'subqueries')
""")


def _first(fixture: str, group: str, columns: str, n: int) -> str:
    return oracle(
        f"select {columns} from (select *, row_number() over (partition by {group}"
        f" order by example_id) as rn from {fixture}) where rn <= {n}"
    )


ORACLES["limit_first_n"] = _first("fx_corpora", "dataset", "example_id, dataset, sql", FIRST_N)
ORACLES["limit_first_n_large"] = _first(
    "fx_orders_eval", "has_join", "example_id, has_join, gold_sql", 10_000
)
ORACLES["split_instruction"] = oracle(
    f"""
    select example_id,
      case when len(parts) = 1 or first = 0 then instruction
        else coalesce(array_to_string(parts[1:first - 1], {NL} || {NL}), '') end as ddl,
      case when starts_with(asked, '--')
        then {strip("regexp_replace(asked, '^-+', '')")} else asked end as question
    from (select *, case when len(parts) = 1 or first = 0 then 'Generate SQL query'
        else array_to_string(parts[first:], {NL} || {NL}) end as asked
      from (select *, coalesce(list_position(list_transform(parts, lambda p:
          contains(upper(p), 'CREATE TABLE') or {strip('p')} = ''), false), 0) as first
        from (select *, string_split(instruction, {NL} || {NL}) as parts from fx_instructions)))
    """
)
RECORD_TABLES = "ntab as (select schema_id, cast(count(distinct table_name) as int) as num_tables from fx_tables group by all)"
CATALOG_EXAMPLES = """cat as (select s.*, text as schema, num_tables, contains(upper(sql), 'JOIN') as has_join
  from split s join texts using (schema_id) join ntab using (schema_id))"""
CATALOG_CTES = [SPLIT, *STRUCTURED_CTES, STRUCTURED_TEXT, RECORD_TABLES, CATALOG_EXAMPLES]
ORACLES["corpus_catalog"] = oracle(
    "select example_id, split, schema_id, question, sql, schema from cat", *CATALOG_CTES
)
ORACLES["corpus_flags"] = oracle("select example_id, num_tables, has_join from cat", *CATALOG_CTES)
ORACLES["corpus_skipped"] = oracle("""
select dataset, schema_id, count(*) as skipped from fx_corpora
where schema_id not in (select schema_id from fx_tables where table_ord = 0
  and not starts_with(table_name, 'a'))
group by all
""")
DDL_EXAMPLE_CTES = [
    *DDL_CTES,
    """marked as (select c.*, f.from_table is not null and c.col_ord = (
        select min(d.col_ord) from cols d where d.schema_id = c.schema_id
          and d.table_name = c.table_name and d.col_name = c.col_name) as is_fk
      from cols c left join (select distinct schema_id, from_table, from_column from fks) f
        on f.schema_id = c.schema_id and f.from_table = c.table_name and f.from_column = c.col_name)""",
    f"""dtab as (select n.schema_id, n.table_ord, n.table_name, string_agg({STRUCTURED_COL}, {NL} order by col_ord) as cols
      from nodes n left join marked m on m.schema_id = n.schema_id and m.table_name = n.table_name group by all)""",
    f"""dbody as (select schema_id, count(*) as n, string_agg(concat_ws({NL}, table_name || ':', cols), {NL}
      order by table_ord) as body from dtab group by all)""",
    f"""dfk as (select schema_id, string_agg({SRC} || ' -> ' || {TGT}, {NL} order by def_ord, col_ord) as fk_text
      from fks group by all)""",
    f"""dtext as (select b.schema_id, ddl, cast(n as int) as num_tables, '[TABLES]' || {NL} || body
        || coalesce({NL} || {NL} || '[FOREIGN KEYS]' || {NL} || fk_text, '') as schema
      from dbody b left join dfk using (schema_id) join fx_ddl using (schema_id))""",
    """dsplit as (select *, case when row_number() over (partition by dataset order by example_id)
      <= count(*) over (partition by dataset) * 9 // 10 then 'train' else 'dev' end as split
      from fx_corpora_ddl)""",
    """dex as (select example_id, dataset, split, question, sql, complexity, source,
        coalesce(schema, '[TABLES]') as schema,
        coalesce(num_tables, 0) as num_tables, contains(upper(sql), 'JOIN') as has_join
      from dsplit left join dtext using (ddl)
      where schema is not null or dataset <> 'instruction')""",
]
ORACLES["corpus_ddl"] = oracle(
    "select example_id, dataset, split, question, sql, schema, num_tables, has_join from dex",
    *DDL_EXAMPLE_CTES,
)
ORACLES["corpus_ddl_reused"] = ORACLES["corpus_ddl"]
COUNTS = (
    "count(*) as examples, count(*) filter (coalesce(num_tables, 1) > 1) as multi_table,"
    " count(*) filter (coalesce(has_join, false)) as with_join"
)
COMBINED_CTES = [
    *DDL_EXAMPLE_CTES,
    *CATALOG_CTES,
    LOGICAL,
    """combined as (
      select example_id, dataset, split, sql, num_tables, has_join, complexity, source from dex
        where dataset <> 'catalog'
      union all
      select example_id, dataset, split, sql, num_tables, has_join, complexity, source from cat
        where dataset = 'catalog'
      union all
      select -example_id - 1, 'single_table', 'train', sql, null, null, null, null from logical)""",
]
ORACLES["corpus_stats"] = oracle(
    f"select dataset, {COUNTS} from combined group by dataset", *COMBINED_CTES
)
ORACLES["corpus_union"] = oracle("select * from combined", *COMBINED_CTES)
ORACLES["corpus_summary"] = oracle(
    f"""select dataset, examples, multi_table, with_join, multi_table * 100 / examples as multi_table_share,
      with_join * 100 / examples as with_join_share from (
      select dataset, {COUNTS} from combined where split = 'train' group by rollup (dataset))""",
    *COMBINED_CTES,
)
ORACLES["corpus_semantic"] = oracle(
    f"""select example_id, split, schema || coalesce({NL} || {NL} || '[SEMANTIC LINKS]' || {NL} || sem, '') as schema
    from cat left join (select schema_id, string_agg(source || ' ≈ ' || target, {NL} order by rank) as sem
      from top5 group by all) s using (schema_id)""",
    *CATALOG_CTES, *SEM_CTES,
)


ORACLES["job_prepare_all"] = oracle(
    """select example_id, dataset, split, sql, schema, num_tables from dex where dataset <> 'catalog'
    union all select example_id, dataset, split, sql, schema, num_tables from cat where dataset = 'catalog'
    union all select -example_id - 1 as example_id, 'single_table' as dataset, 'train' as split,
      sql, schema, cast(null as int) as num_tables from logical""",
    *DDL_EXAMPLE_CTES, *CATALOG_CTES, LOGICAL,
)
ORACLES["job_prepare"] = oracle(
    f"""select 'lines' as format, split, example_id, dataset, num_tables, has_join, complexity, source, schema,
      cast(null as varchar) as instruction, question as input, sql as output from records
    union all select format, split, null, null, null, null, null, null, null, system,
      schema || {NL} || {NL} || 'Question: ' || question, sql from records cross join (
      values ('instruction', {_text(K.INSTRUCTION)}), ('chat', {_text(K.CHAT_SYSTEM)})) as f(format, system)""",
    *DDL_EXAMPLE_CTES, *CATALOG_CTES, LOGICAL,
    """records as (
      select example_id, dataset, split, question, sql, schema, num_tables, has_join, complexity, source
        from dex where dataset <> 'catalog'
      union all
      select example_id, dataset, split, question, sql, schema, num_tables, has_join, complexity, source
        from cat where dataset = 'catalog'
      union all
      select -example_id - 1, 'single_table', 'train', question, sql, schema, null, null, null, null from logical)""",
)
ORACLES["corpus_shuffle_order"] = oracle(
    "select example_id, row_number() over (order by md5('42:' || cast(example_id as varchar)), example_id)"
    " as position from split where split = 'train'",
    SPLIT,
)
ORACLES["corpus_phase"] = oracle(
    "select 'synthetic' as phase, example_id, dataset, split from combined"
    " where split = 'train' and dataset = 'synthetic'"
    " union all select 'combined', example_id, dataset, split from combined where split = 'dev'",
    *COMBINED_CTES,
)

# --- prompts ------------------------------------------------------------------------------------------


def _styles() -> str:
    rows = ", ".join(
        f"('{s}', {_text(m)}, {_text(g) if g else 'null'})" for s, (m, g) in STYLE_TEXTS.items()
    )
    return f"styles as (select * from (values {rows}) as t(style, system_message, guidelines))"


ORACLES["prompt_styles"] = oracle(
    f"""select example_id, style, system_message, {_text(K.INSTRUCTION)}
      || case when style = 'simple' then '' else coalesce(guidelines, '') end as instruction
    from (select *, case complexity when 'basic SQL' then 'simple' when 'single join' then 'detailed'
      when 'subqueries' then 'expert' else 'few_shot' end as style from fx_corpora_ddl)
    join styles using (style)""",
    _styles(),
)
ORACLES["prompt_few_shot"] = oracle(f"""
select dataset, {NL} || {NL} || '[EXAMPLES]' || {NL} || {NL} || string_agg(
    {lines("'Example ' || cast(rn as varchar) || ':'", "'[SCHEMA]'", "ddl", "''", "'[QUESTION]'",
           "question", "''", "'[SQL]'", "sql", "''", "''")}, '' order by rn)
  || '[END EXAMPLES]' || {NL} || {NL} as few_shot
from (select *, row_number() over (partition by dataset order by example_id) as rn from fx_corpora_ddl)
where rn <= 2 group by dataset
""")
ASKED = """asked as (select v.*, text as schema, case when contains(question, '?') then '' else 'SELECT 1' end as sql
  from fx_value_questions v join texts using (schema_id))"""
ASKED_CTES = [*STRUCTURED_CTES, STRUCTURED_TEXT, ASKED]
ORACLES["prompt_build"] = oracle(
    f"""select example_id, {lines(_text(K.INSTRUCTION), "'[SCHEMA]'", "schema")}
      || case when links_text = '' then '' else {NL} || {NL} || links_text end
      || {NL} || {lines("''", "'[QUESTION]'", "question")} as input,
      '[SQL]' || {NL} || sql as output
    from asked join ltext using (example_id)""",
    *ASKED_CTES, *BEST_CTES, LINKS_TEXT,
)
ORACLES["corpus_records"] = oracle(
    f"""select example_id, schema_id, {_text(K.INSTRUCTION)} || {_text(STYLE_TEXTS['detailed'][1])}
      || {NL} || {lines("'[SCHEMA]'", "schema")}
      || case when links_text = '' then '' else {NL} || {NL} || links_text end
      || {NL} || {lines("''", "'[QUESTION]'", "question")} as input,
      '[SQL]' || {NL} || 'SELECT 1' as output, num_tables
    from asked join ltext using (example_id) join ntab using (schema_id)""",
    *ASKED_CTES, *BEST_LINKS_NO_VALUES, LINKS_TEXT, RECORD_TABLES,
)
ORACLES["prompt_simple"] = oracle(
    f"""select example_id, {lines(_text(K.INSTRUCTION), "''", "schema")}
      || case when sql = '' then '' else {NL} || {NL} || '[SCHEMA LINKS]' || {NL} || 'x' end
      || {NL} || {lines("''", "'[QUESTION]'", "question")} as input,
      case when sql <> '' then '[SQL]' || {NL} || sql end as output, nullif(sql, '') as sql
    from asked""",
    *ASKED_CTES,
)
ORACLES["prompt_legacy"] = oracle(
    f"""select example_id, {lines(_text(K.INSTRUCTION), "''", "schema", "''", "'Question: ' || question")} as input,
      nullif(sql, '') as output, nullif(sql, '') as sql from asked""",
    *ASKED_CTES,
)
CHAT = f"""chat as (select example_id, {lines("'<|im_start|>system'", _text(K.CHATML_SYSTEM) + " || '<|im_end|>'",
  "'<|im_start|>user'", "question || '<|im_end|>'", "'<|im_start|>assistant'", "sql || '<|im_end|>'")} as text
  from fx_corpora_ddl)"""
ORACLES["prompt_chatml"] = oracle("select example_id, text from chat", CHAT)
MARKED = "string_split(string_split(generated, '[SQL]')[-1], '<|im_end|>')[1]"
ORACLES["extract_sql"] = oracle(f"""
select example_id,
  {strip(f"case when contains(generated, '[SQL]') then {MARKED} else generated end")} as sql,
  {strip(f"case when contains(generated, '[SQL]') then {MARKED} else string_split(generated, '<|im_start|>assistant')[-1] end")} as sql_after_tag
from fx_generated
""")
VOCAB_CTES = [
    CHAT,
    f"toks as (select example_id, {words('text')} as ws from chat)",
    """vocab as (select word, occurrences, row_number() over (order by occurrences desc, word) as word_id
      from (select word, count(*) as occurrences from (select unnest(ws) as word from toks) group by word))""",
]
ORACLES["seq_vocab"] = oracle("select word, occurrences, word_id from vocab", *VOCAB_CTES)
ORACLES["seq_encode"] = oracle(
    f"""
    select example_id, ids as input_ids, mask as attention_mask, ids as labels from (
      select example_id, string_agg(cast(coalesce(word_id, 0) as varchar), ' ' order by pos) as ids,
        string_agg(case when word_id is null then '0' else '1' end, ' ' order by pos) as mask
      from (select example_id, pos, ws[pos] as word from (
        select *, unnest(generate_series(1, {MAX_LENGTH})) as pos from toks)) t
      left join vocab using (word) group by example_id)
    """,
    *VOCAB_CTES,
)

# --- evaluation ---------------------------------------------------------------------------------------


def normal(x: str, quotes: bool = True) -> str:
    low = f"replace(lower({x}), '\"', '''')" if quotes else f"lower({x})"
    return collapse(low)


def _scored(fixture: str, start_from_exact: bool = True) -> str:
    em = f"({normal('gold_sql')} = {normal('pred_sql')})"
    ran = "(gold_ran and pred_ran and same_result)"
    ex = f"(em or {ran})" if start_from_exact else ran
    err = "(not em and not gold_ran and not pred_ran)" if start_from_exact else "false"
    return (
        f"scored as (select *, em as exact_match, {ex} as execution_match, {err} as exec_error"
        f" from (select *, {em} as em from {fixture}) x)"
    )


SCORED = _scored("fx_orders_eval")
ORACLES["eval_normalize"] = oracle(
    f"select example_id, {normal('pred_sql')} as normal, {normal('pred_sql', False)} as normal_keep_quotes"
    " from fx_orders_eval"
)
ORACLES["eval_exact_match"] = oracle("select example_id, exact_match from scored", SCORED)
ORACLES["eval_result_sets"] = oracle("""
select r.example_id, r.gold_ran and r.pred_ran and d.example_id is null as same_result
from fx_result_runs r left join (
  select distinct example_id from (
    (select example_id, a, b, c from fx_result_rows where side = 'gold'
     except select example_id, a, b, c from fx_result_rows where side = 'pred')
    union all
    (select example_id, a, b, c from fx_result_rows where side = 'pred'
     except select example_id, a, b, c from fx_result_rows where side = 'gold'))) d
  on d.example_id = r.example_id
""")

# What the order of a set of lines decides: see ``fixtures.typed_result_rows``.
ORACLES["eval_result_sets_typed"] = """
select o_orderkey as example_id,
  o_custkey % 7 <> 0 and o_custkey % 5 <> 0 and coalesce(same, true) as same_result
from orders left join (
  select l_orderkey, not case l_orderkey % 10
      when 2 then true when 3 then bool_or(l_linenumber = 1) when 5 then bool_or(l_linenumber = 2)
      when 7 then bool_or(l_linenumber = 3) else false end as same
  from lineitem group by l_orderkey) on l_orderkey = o_orderkey
"""

VERDICT = "select example_id, exact_match, execution_match, exec_error from scored"
ORACLES["eval_verdict"] = oracle(VERDICT, SCORED)
ORACLES["eval_verdict_egd"] = oracle(VERDICT, _scored("fx_orders_eval", False))


def _flag(words_: list[str]) -> str:
    return "(" + " or ".join(f"contains(upper(gold_sql), '{w}')" for w in words_) + ")"


FLAGS = {name: _flag(ws) for name, ws in K.OPERATION_KEYWORDS.items()}
FLAGS["has_subquery"] = f"({occurrences('upper(gold_sql)', 'SELECT')} > 1)"
ORACLES["eval_operations"] = oracle(
    "select example_id, " + ", ".join(f"{f} as {n}" for n, f in FLAGS.items()) + " from fx_orders_eval"
)
ORACLES["eval_table_count"] = oracle(
    f"select example_id, cast(greatest(1, {occurrences('upper(gold_sql)', ' FROM ')}"
    f" + {occurrences('upper(gold_sql)', ' JOIN ')}) as int) as tables from fx_orders_eval"
)
LEVEL = (
    f"case when num_tables <= 1 and not has_join then '{K.COMPLEXITY_LABELS[0]}'"
    f" when num_tables <= 2 and not {FLAGS['has_subquery']} then '{K.COMPLEXITY_LABELS[1]}'"
    f" when num_tables <= 4 and not {FLAGS['has_subquery']} then '{K.COMPLEXITY_LABELS[2]}'"
    f" else '{K.COMPLEXITY_LABELS[3]}' end"
)
ORACLES["eval_complexity"] = oracle(f"select example_id, {LEVEL} as complexity from fx_orders_eval")
SCORES = (
    "count(*) as total, count(*) filter (exact_match) as em_correct,"
    " count(*) filter (execution_match) as ex_correct"
)
RATES = f"{pct('em_correct', 'total')} as em_accuracy, {pct('ex_correct', 'total')} as ex_accuracy"
ORACLES["eval_overall"] = oracle(
    f"""select *, {RATES} from (select {SCORES}, count(*) filter (exec_error) as execution_errors,
      count(*) filter (execution_match and not exact_match) as ex_only from scored)""",
    SCORED,
)
TRAIN = (
    "trained as (select coalesce(db_id, 'unknown') as db_id, count(*) as train_samples"
    " from fx_train group by 1)"
)
BY_DB = f"""by_db as (
  select db_id, total as eval_samples, coalesce(train_samples, 0) as train_samples, em_correct, ex_correct,
    {RATES}
  from (select coalesce(db_id, 'unknown') as db_id, {SCORES} from scored group by 1)
  left join trained using (db_id))"""
BY_OP = f"""by_op as (
  select operation, total, em_correct, ex_correct, {RATES} from (
    select operation, {SCORES} from ({" union all ".join(
      f"select '{n}' as operation, exact_match, execution_match from scored where {f}"
      for n, f in FLAGS.items())}) group by operation))"""
ORACLES["eval_by_database"] = oracle("select * from by_db", SCORED, TRAIN, BY_DB)
ORACLES["eval_by_operation"] = oracle("select * from by_op", SCORED, BY_OP)
ORACLES["eval_by_complexity"] = oracle(
    f"select *, {RATES} from (select {LEVEL} as complexity, {SCORES} from scored group by 1)", SCORED
)
ORACLES["eval_worst"] = oracle(
    """select * from (select 'database' as kind, db_id as name, em_accuracy, ex_accuracy from by_db
      order by em_accuracy, db_id limit 3)
    union all
    select * from (select 'operation', operation, em_accuracy, ex_accuracy from by_op
      order by em_accuracy, operation limit 3)""",
    SCORED, TRAIN, BY_DB, BY_OP,
)
ORACLES["eval_filter_db"] = oracle("""
select 'exclude' as mode, example_id from fx_orders_eval
where coalesce(db_id, 'unknown') not in ('db1', 'db2', 'unknown', 'db99')
union all
select 'include', example_id from fx_orders_eval where db_id in ('db1', 'db5')
""")
ORACLES["eval_filter_removed"] = oracle("""
select coalesce(db_id, 'unknown') as db_id, count(*) as removed from fx_orders_eval
where coalesce(db_id, 'unknown') in ('db1', 'db2', 'unknown', 'db99') group by 1
""")
ORACLES["eval_db_distribution"] = oracle(f"""
select db_id, samples, 100 * samples / sum(samples) over () as share,
  greatest(count(*) over () - {TOP_DATABASES}, 0) as databases_left
from (select coalesce(db_id, 'unknown') as db_id, count(*) as samples from fx_orders_eval group by 1)
order by samples desc, db_id limit {TOP_DATABASES}
""")
ORACLES["eval_by_db_capped"] = oracle(
    f"""select db_id, total, em_correct, ex_correct, train_samples, {RATES} from (
      select db_id, cast(sum(total) as bigint) as total, cast(sum(em_correct) as bigint) as em_correct,
        cast(sum(ex_correct) as bigint) as ex_correct,
        case when grouping(db_id) = 1 then (select count(*) from fx_train)
          else cast(coalesce(sum(train_samples), 0) as bigint) end as train_samples
      from (select db_id, {SCORES} from (
          select coalesce(db_id, 'unknown') as db_id, exact_match, execution_match,
            row_number() over (partition by coalesce(db_id, 'unknown') order by example_id) as rn
          from scored) where rn <= {MAX_PER_DB} group by db_id)
      left join trained using (db_id) group by rollup (db_id))""",
    SCORED, TRAIN,
)
ORACLES["eval_by_db_em"] = oracle(
    "select db_id, eval_samples, train_samples, em_correct, em_accuracy from by_db", SCORED, TRAIN, BY_DB
)
ORACLES["eval_alignment"] = oracle("""
select example_id, 'prediction' as missing from fx_orders_eval where gold_ran and not pred_ran
union all select example_id, 'gold' from fx_orders_eval where pred_ran and not gold_ran
""")
SUMMARY = f"""summary as (
  select run_id, coalesce(total, 0) as total, coalesce(em_correct, 0) as em_count,
    coalesce(ex_correct, 0) as ex_count,
    case when total is null then 'no predictions' end as error,
    case when run_id like 'checkpoint-%' then substr(run_id, 12) else 'final' end as step,
    {pct('coalesce(em_correct, 0)', 'coalesce(total, 0)')} as em_accuracy,
    {pct('coalesce(ex_correct, 0)', 'coalesce(total, 0)')} as ex_accuracy
  from fx_run_list left join (select run_id, {SCORES} from scored group by run_id) using (run_id))"""
RUN_SCORED = _scored("fx_runs")
ORACLES["eval_rank_runs"] = oracle(
    """select *, row_number() over (order by em_accuracy desc, rank) = 1 as best_em, rank = 1 as best_ex
    from (select *, cast(row_number() over (order by ex_accuracy desc, em_accuracy desc,
      try_cast(step as bigint) nulls last, run_id) as int) as rank from summary)""",
    RUN_SCORED, SUMMARY,
)
ORACLES["eval_best_run"] = oracle(
    """select run_id, ex_accuracy as metric, em_accuracy from summary
    where error is null and run_id like 'checkpoint-%' order by ex_accuracy desc, run_id limit 1""",
    RUN_SCORED, SUMMARY,
)
ORACLES["eval_show_examples"] = oracle(
    """select * from (select example_id, gold_sql, pred_sql, exact_match from scored where exact_match
      order by example_id limit 3)
    union all
    select * from (select example_id, gold_sql, pred_sql, exact_match from scored where not exact_match
      order by example_id limit 4)""",
    SCORED,
)
ORACLES["eval_running"] = oracle(
    f"""select run_id, rows_seen, em_correct, ex_correct, {pct('em_correct', 'rows_seen')} as em_accuracy,
      {pct('ex_correct', 'rows_seen')} as ex_accuracy from (
      select run_id, row_number() over w as rows_seen,
        cast(sum(exact_match::int) over w as bigint) as em_correct,
        cast(sum(execution_match::int) over w as bigint) as ex_correct
      from scored window w as (partition by run_id order by example_id)) where rows_seen % 10 = 0""",
    RUN_SCORED,
)

# --- candidate selection ------------------------------------------------------------------------------

VALID = f"""(case when sql = '' then '{K.ERROR_EMPTY}'
  when not contains(upper(sql), 'SELECT') then '{K.ERROR_NO_SELECT}'
  when not contains(upper(sql), 'FROM') and not contains(upper(sql), 'COUNT(') then '{K.ERROR_NO_FROM}'
  else '' end)"""
DISTINCT = f"""dist as (select example_id, ord, sql, executed,
    case when ord = 0 then 1.0::double else 1.0::double - (ord - 1) * 0.1::double end as score,
    {VALID} = '' as valid from (
  select *, row_number() over (partition by example_id, {collapse('lower(sql)')} order by ord) as rn
  from fx_candidates) where rn = 1)"""
ORACLES["egd_candidates"] = oracle(
    "select example_id, ord, sql, round(score, 6) as score from dist", DISTINCT
)
ORACLES["egd_syntax"] = oracle(
    f"select example_id, ord, {VALID} = '' as syntax_valid, {VALID} as syntax_error from fx_candidates"
)
CHOSEN = """chosen as (
  select example_id, coalesce(sql, '') as sql, case when prio is null then 'none'
    when prio = 0 then case when executed then 'first_valid' else 'first_syntax_valid' end
    when prio = 1 then 'executed' when prio = 2 then 'syntax_valid' else 'highest_score' end as method
  from fx_decoded left join (
    select *, row_number() over (partition by example_id order by prio, place) as pick from (
      select *, case when place = 1 and valid then 0 when valid and executed then 1
        when valid then 2 else 3 end as prio
      from (select *, row_number() over (partition by example_id order by score desc, ord) as place
        from dist))) c using (example_id)
  where pick is null or pick = 1)"""
ORACLES["egd_select"] = oracle("select example_id, sql, method from chosen", DISTINCT, CHOSEN)
ORACLES["job_candidates"] = oracle(
    f"""select method, examples, em_correct, {pct('em_correct', 'examples')} as em_accuracy from (
      select method, count(*) as examples, count(*) filter ({normal('sql')} = {normal('gold')}) as em_correct
      from (select *, 'SELECT V FROM T WHERE v > ' || cast((example_id % 8 + 8) % 8 as varchar) as gold from chosen)
      group by rollup (method))""",
    DISTINCT, CHOSEN,
)
ORACLES["egd_rates"] = oracle(
    f"""select method, examples, {pct('examples', '(select count(*) from chosen)')} as share
    from (select method, count(*) as examples from chosen group by method)""",
    DISTINCT, CHOSEN,
)
