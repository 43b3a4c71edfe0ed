"""Input tables for the registered queries, derived from the driver tables.

Each fixture is one SELECT that both Spark and DuckDB can run, so a query and
its oracle start from the same rows. The few functions that differ between the
two go through ``Dialect``. Fixtures named in SETTLED are small catalog tables:
they are written once per session and read back.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablequill.session import settle

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SCHEMAS = 40
PER_TABLE = 5


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def h(self, x: str) -> str:
        """A 28-bit integer out of a string."""
        if self.spark:
            return f"cast(conv(substr(md5({x}), 1, 7), 16, 10) as int)"
        return f"cast('0x' || substr(md5({x}), 1, 7) as int)"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def each(self, pattern: str, text: str) -> str:
        if self.spark:
            return f"explode(regexp_extract_all({text}, '{pattern}', 0))"
        return f"unnest(regexp_extract_all({text}, '{pattern}'))"

    def upto(self, n: int) -> str:
        return f"explode(sequence(1, {n}))" if self.spark else f"unnest(range(1, {n + 1}))"

    def join(self, value: str, order: str, sep: str) -> str:
        """Ordered string aggregate."""
        if self.spark:
            return (
                f"array_join(transform(array_sort(collect_list(struct({order}, {value} as v))),"
                f" x -> x.v), {sep})"
            )
        return f"string_agg({value}, {sep} order by {order})"


def _db(key: str) -> str:
    return f"'db' || lpad(cast({key} % {SCHEMAS} as string), 2, '0')"


def _cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"


NL = "chr(10)"


def _terms(d: Dialect) -> str:
    return (
        f"select term, {d.h('term')} as h from (select distinct term from "
        f"(select {d.each('[a-z]{3,}', 'lower(text)')} as term from benchmark) w) t"
    )


def _slots(d: Dialect) -> str:
    pos = f"row_number() over (partition by h % {SCHEMAS} order by term) - 1"
    return (
        f"select schema_id, term, h, pos, cast({d.div('pos', PER_TABLE)} as int) as table_ord"
        f" from (select {_db('h')} as schema_id, term, h, {pos} as pos from fx_terms) p"
    )


def _tables(d: Dialect) -> str:
    name = f"case when {d.h('head')} % 4 = 0 then {_cap('head')} else head end"
    return (
        f"select schema_id, table_ord, head, {name} as table_name from"
        " (select schema_id, table_ord, min(term) as head from fx_slots"
        " group by schema_id, table_ord) g"
    )


def _columns(d: Dialect) -> str:
    place = f"s.pos - {PER_TABLE} * s.table_ord"
    return f"""
    select s.schema_id, s.table_ord, t.table_name, cast({place} as int) as col_ord,
      case {place}
        when 0 then s.term || '_id'
        when 1 then case when s.h % 2 = 0 then {_cap('s.term')} else s.term end
        when 2 then s.term || '_' || t.head
        when 3 then case when p.table_name is null then s.term || '_date'
                         else p.table_name || '_id' end
        else case when s.h % 2 = 0 then s.term || '_name' else s.term || '_status' end
      end as col_name,
      case s.h % 3 when 0 then 'text' when 1 then 'number' else 'time' end as dtype,
      {place} = 0 as is_pk,
      {place} = 3 and p.table_name is not null as is_fk,
      case when {place} = 3 then p.table_name end as fk_table,
      case when {place} = 3 then p.head || '_id' end as fk_column
    from fx_slots s
    join fx_tables t on t.schema_id = s.schema_id and t.table_ord = s.table_ord
    left join fx_tables p on p.schema_id = s.schema_id and p.table_ord = s.table_ord - 1
    """


def _fks(d: Dialect) -> str:
    return """
    select schema_id,
      cast(row_number() over (partition by schema_id order by table_ord, col_ord) as int) as fk_ord,
      table_name as from_table, col_name as from_column,
      fk_table as to_table, fk_column as to_column
    from fx_columns where is_fk
    """


def _ddl(d: Dialect) -> str:
    h = d.h("col_name")
    typ = f"""case dtype
        when 'text' then case when {h} % 11 = 0 then ' VARCHAR(255)' else ' VARCHAR' end
        when 'number' then case when {h} % 2 = 0 then ' INT' else ' real' end
        else case when {h} % 7 = 0 then '' else ' TIMESTAMP' end end"""
    key = "case when is_pk and table_ord % 2 = 0 then ' PRIMARY KEY' else '' end"
    cols = d.join(f"col_name || {typ} || {key}", "col_ord", "', '")
    head = "case when table_ord % 3 = 0 then 'create  table ' else 'CREATE TABLE ' end"
    body = d.join("stmt", "table_ord", "' '")
    return f"""
    select schema_id, {body} as ddl from (
      select schema_id, table_ord, {head} || table_name || ' (' || {cols} || ');' as stmt
      from fx_columns group by schema_id, table_ord, table_name
      union all
      select a.schema_id, 1000000 + a.table_ord,
        'CREATE TABLE ' || a.table_name || ' (note TEXT, ' || b.table_name || '_id INT);'
      from fx_tables a join fx_tables b
        on b.schema_id = a.schema_id and b.table_ord = a.table_ord + 1
      where a.table_ord = 0 and a.schema_id like '%0'
    ) s group by schema_id
    """


def _ddl_strict(d: Dialect) -> str:
    """The tables of the catalog as DDL with nested parentheses, quotes, comments and key clauses."""
    h = d.h("col_name")
    typ = f"""case dtype
        when 'text' then ' VARCHAR(255) DEFAULT ''a, (b'' /* c, d) */'
        when 'number' then case when {h} % 2 = 0 then ' DECIMAL(10, 2) CHECK (x IN (1, (2)))' else ' DOUBLE PRECISION' end
        else case when {h} % 7 = 0 then '' else ' TIMESTAMP(6) NOT NULL' end end"""
    inline = (
        "case when is_pk and table_ord % 2 = 1 then ' PRIMARY KEY' else '' end"
        " || case when is_fk and table_ord % 2 = 0 then ' REFERENCES \"' || fk_table || '\" (\"' || fk_column || '\")' else '' end"
    )
    cols = d.join(f"'\"' || col_name || '\"' || {typ} || {inline}", "col_ord", "', '")
    head = """case table_ord % 3 when 0 then 'CREATE TABLE IF NOT EXISTS "main"."' || table_name || '" ('
        when 1 then 'create table `' || table_name || '`(' else 'CREATE TABLE [dbo].[' || table_name || '] (' end"""
    keys = (
        "case when table_ord % 2 = 0 then ', PRIMARY KEY (\"' || max(case when is_pk then col_name end) || '\")' else"
        " coalesce(', CONSTRAINT f FOREIGN KEY (\"' || max(case when is_fk then col_name end) || '\") REFERENCES '"
        " || max(fk_table) || ' (' || max(fk_column) || ') ON DELETE CASCADE', '') end"
    )
    body = d.join("stmt", "table_ord", "' '")
    return f"""
    select schema_id, {body} as ddl from (
      select schema_id, table_ord, {head} || {cols} || {keys} || ', CHECK (a IN (1, 2)));' as stmt
      from fx_columns group by schema_id, table_ord, table_name
    ) s group by schema_id
    """


def _questions(d: Dialect) -> str:
    return (
        f"select conv_id * 1000 + turn as example_id, {_db('conv_id')} as schema_id,"
        " text as question from conversations where role = 'user'"
    )


def _value_questions(d: Dialect) -> str:
    return f"""
    select conv_id * 1000 + turn as example_id, {_db('conv_id')} as schema_id,
      text || ' in "' || n_name || '" of ' || substr(r_name, 1, 1) || lower(substr(r_name, 2))
        || ' at "' || cast(turn as string) || '/' || cast(conv_id as string) || '" or "'
        || cast(conv_id as string) || '"' as question
    from conversations
    join nation on n_nationkey = conv_id % 25
    join region on r_regionkey = n_regionkey
    where role = 'user'
    """


def _term_vectors(d: Dialect) -> str:
    return (
        "select t.term, e.embedding as vector from fx_terms t"
        " join (select vec_id, embedding, (select count(*) from embeddings) as n"
        " from embeddings) e on e.vec_id = t.h % e.n"
    )


def _logical_form(d: Dialect) -> str:
    return """
    select event_id as example_id, 't' || cast(user_id * 13 as string) as table_id,
      event_type || ' ' || props as question,
      cast(event_id % 6 as int) as sel, cast(event_id % 7 % 6 as int) as agg,
      cast(user_id % 3 as int) as n_conds,
      cast(user_id % 6 as int) as c1_col, cast(event_id % 7 as int) as c1_op, event_type as c1_value,
      cast(event_id % 4 as int) as c2_col, 1 as c2_op, cast(value as string) as c2_value
    from events
    """


def _single_tables(d: Dialect) -> str:
    title = (
        "case when c_nationkey = 0 then null when c_nationkey = 1 then '' else"
        " c_name || ' - ' || c_mktsegment || ' (Liste no. ' || cast(c_nationkey as string)"
        " || ', été)' end"
    )
    return f"""
    select 't' || cast(c_custkey as string) as id, {title} as page_title,
      'Player' as h1, 'No.' as h2, c_mktsegment as h3, c_name as h4,
      'Years in ' || cast(c_nationkey as string) as h5,
      cast(1 + c_custkey % 5 as int) as n_types
    from customer
    """


def _orders_eval(d: Dialect) -> str:
    status, priority = "o_orderstatus", "o_orderpriority"
    return f"""
    select example_id, db_id, gold_sql,
      case change
        when 0 then gold_sql
        when 1 then upper(gold_sql)
        when 2 then replace(replace(gold_sql, '''', '"'), ' ', ' ' || chr(9))
        when 3 then gold_sql || ' LIMIT 1'
        else gold_sql || ';' end as pred_sql,
      num_tables, upper(gold_sql) like '%JOIN%' as has_join,
      custkey % 7 <> 0 as gold_ran, custkey % 5 <> 0 as pred_ran, custkey % 3 = 0 as same_result
    from (
      select o_orderkey as example_id, o_custkey as custkey,
        case when o_custkey % 20 = 7 then null
             else 'db' || cast(o_custkey % 20 as string) end as db_id,
        {d.div('o_orderkey', 10)} % 5 as change,
        cast(1 + o_custkey % 6 as int) as num_tables,
        case o_orderkey % 10
          when 0 then 'SELECT name FROM customer WHERE status = "' || {status} || '"'
          when 1 then 'SELECT COUNT(*) FROM orders WHERE priority = ''' || {priority} || ''''
          when 2 then 'SELECT a.name FROM customer AS a JOIN orders AS b ON a.id = b.cid WHERE b.status = '''
            || {status} || ''''
          when 3 then 'SELECT status, COUNT(*) FROM orders GROUP BY status HAVING COUNT(*) > '
            || cast(o_custkey % 10 as string)
          when 4 then 'SELECT name FROM customer ORDER BY balance DESC LIMIT '
            || cast(o_custkey % 10 as string)
          when 5 then 'SELECT DISTINCT priority FROM orders'
          when 6 then 'SELECT name FROM customer WHERE id IN (SELECT cid FROM orders WHERE status = '''
            || {status} || ''')'
          when 7 then 'SELECT id FROM orders WHERE status = ''' || {status}
            || ''' UNION SELECT id FROM orders WHERE priority = ''' || {priority} || ''''
          when 8 then 'SELECT MAX(total), MIN(total) FROM orders WHERE custkey = '
            || cast(o_custkey as string)
          else 'SELECT a.id FROM a JOIN b ON a.id = b.id JOIN c ON b.id = c.id' end as gold_sql
      from orders
    ) o
    """


def _train(d: Dialect) -> str:
    return (
        "select c_custkey as example_id, case when c_custkey % 23 = 3 then null"
        " else 'db' || cast(c_custkey % 23 as string) end as db_id from customer"
    )


def _result_rows(d: Dialect) -> str:
    def row(quantity: str) -> str:
        return (
            "cast(l_partkey as string) as a, cast(cast(" + quantity + " as int) as string) as b,"
            " l_returnflag as c from lineitem"
        )

    changed = "case when l_tax > 0.07 and l_discount > 0.08 then l_quantity + 1 else l_quantity end"
    return f"""
    select l_orderkey as example_id, 'gold' as side, {row('l_quantity')}
    union all
    select l_orderkey, 'pred', {row(changed)} where not (l_tax < 0.01 and l_discount < 0.02)
    union all
    select l_orderkey, 'pred', {row('l_quantity')} where l_returnflag = 'R'
    """


def _result_runs(d: Dialect) -> str:
    return (
        "select o_orderkey as example_id, o_custkey % 7 <> 0 as gold_ran,"
        " o_custkey % 11 <> 0 as pred_ran from orders"
    )


def _candidates(d: Dialect) -> str:
    level = "cast(cast(floor(value / 50) as int) as string)"
    return f"""
    select {d.div('event_id', 5)} as example_id, cast(event_id % 5 as int) as ord,
      case event_type
        when 'view' then 'SELECT v FROM t WHERE v > ' || {level}
        when 'click' then 'select V  from T' || chr(10) || 'where v > ' || {level}
        when 'purchase' then 'SELECT COUNT(' || {level} || ')'
        when 'signup' then 'SHOW TABLES ' || {level}
        else case when value < 20 then '' else 'SELECT ' || {level} end end as sql,
      user_id % 3 <> 0 as executed
    from events
    """


def _decoded(d: Dialect) -> str:
    """Examples that were decoded; some of them gave no candidate at all."""
    return (
        "select distinct example_id from fx_candidates"
        " union all select -1 - r_regionkey from region"
    )


RUNS = ["checkpoint-100", "checkpoint-200", "checkpoint-1000", "checkpoint-300", "final"]


def _runs(d: Dialect) -> str:
    names = " ".join(f"when {i} then '{r}'" for i, r in enumerate(RUNS, 1))
    return f"""
    select case run_no {names} end as run_id, example_id, db_id, gold_sql,
      case when example_id % (run_no + 2) = 0 then gold_sql else pred_sql end as pred_sql,
      num_tables, has_join, gold_ran, pred_ran, same_result
    from (select *, {d.upto(len(RUNS))} as run_no from fx_orders_eval) r
    """


def _run_list(d: Dialect) -> str:
    return "select distinct run_id from fx_runs union all select 'checkpoint-500'"


def _corpora(d: Dialect) -> str:
    return f"""
    select doc_id as example_id,
      case cast(substr(source, 4) as int) % 4
        when 0 then 'catalog' when 1 then 'ddl_context' when 2 then 'synthetic'
        else 'instruction' end as dataset,
      {_db('doc_id')} as schema_id, text as question,
      case doc_id % 4
        when 0 then 'SELECT * FROM ' || source
        when 1 then 'select a.x from ' || lang || ' a join ' || source || ' b on a.id = b.id'
        when 2 then 'SELECT count(*) FROM ' || source || ' WHERE lang = ''' || lang || ''''
        else 'SELECT max(n_chars) FROM ' || source end as sql,
      case lang when 'en' then 'basic SQL' when 'de' then 'single join' when 'fr' then 'subqueries'
        else 'window functions' end as complexity,
      case when doc_id % 6 = 0 then null else source end as source
    from documents
    """


def _corpora_ddl(d: Dialect) -> str:
    return f"""
    select c.example_id, c.dataset, c.question, c.sql, c.complexity, c.source,
      case when c.example_id % 9 = 4 then 'no tables here' else f.ddl end as ddl
    from fx_corpora c join fx_ddl f on f.schema_id = c.schema_id
    """


def _instructions(d: Dialect) -> str:
    gap = f"{NL} || {NL}"
    return f"""
    select example_id, 'SELECT 1' as sql,
      case example_id % 5
        when 0 then ddl
        when 1 then ddl || {gap} || question
        when 2 then ddl || {gap} || '  ' || {gap} || '-- ' || question || {gap} || ddl
        when 3 then question
        else ddl || {gap} || ddl || {gap} || '---' || question end as instruction
    from fx_questions q join fx_ddl f on f.schema_id = q.schema_id
    """


def _schema_text(d: Dialect) -> str:
    mark = "case when is_pk then ' (PK)' else '' end"
    cols = d.join(f"'    ' || col_name || {mark}", "col_ord", NL)
    pairs = d.join("table_name || ': ' || col_name || ' (x)'", "table_ord, col_ord", NL)
    body = d.join("txt", "table_ord", NL)
    name = "case when table_ord % 5 = 2 then '\"' || table_name || '\"' else table_name end"
    return f"""
    select schema_id, '[DATABASE]' || {NL} || schema_id || ':' || {NL} || {NL} || '[TABLES]' || {NL}
      || body || {NL} || {NL} || '[FOREIGN KEYS]' || {NL} || 'a.b -> c.d' as schema
    from (
      select schema_id, {body} as body from (
        select schema_id, table_ord, {name} || ':' || {NL} || '# note' || {NL} || {cols} as txt
        from fx_columns group by schema_id, table_ord, table_name
        union all
        select schema_id, 1000000, table_name || ':' || {NL} || chr(9) || 'again (FK)'
        from fx_tables where table_ord = 1
        union all
        select schema_id, 1000001, table_name || ':' from fx_tables where table_ord = 2
      ) t group by schema_id
    ) b
    union all
    select 'flat_' || schema_id, '# tables' || {NL} || {pairs} || {NL} || 'a:b:c' || {NL} || 'x:'
    from fx_columns group by schema_id
    """


def _generated(d: Dialect) -> str:
    return f"""
    select example_id,
      case example_id % 4
        when 0 then '<|im_start|>user' || {NL} || '[SQL]<|im_end|>' || {NL} || '<|im_start|>assistant'
          || {NL} || '[SQL]' || {NL} || pred_sql || ' ' || {NL} || '<|im_end|>tail<|im_end|>'
        when 1 then '[SQL]' || chr(9) || pred_sql
        when 2 then 'x<|im_start|>assistant' || {NL} || pred_sql || ' '
        else ' ' || pred_sql || {NL} end as generated
    from fx_orders_eval
    """


FIXTURES: dict[str, Callable[[Dialect], str]] = {
    "fx_terms": _terms,
    "fx_slots": _slots,
    "fx_tables": _tables,
    "fx_columns": _columns,
    "fx_fks": _fks,
    "fx_ddl": _ddl,
    "fx_ddl_strict": _ddl_strict,
    "fx_questions": _questions,
    "fx_value_questions": _value_questions,
    "fx_term_vectors": _term_vectors,
    "fx_logical_form": _logical_form,
    "fx_single_tables": _single_tables,
    "fx_orders_eval": _orders_eval,
    "fx_train": _train,
    "fx_result_rows": _result_rows,
    "fx_result_runs": _result_runs,
    "fx_candidates": _candidates,
    "fx_decoded": _decoded,
    "fx_runs": _runs,
    "fx_run_list": _run_list,
    "fx_corpora": _corpora,
    "fx_corpora_ddl": _corpora_ddl,
    "fx_instructions": _instructions,
    "fx_schema_text": _schema_text,
    "fx_generated": _generated,
}
SETTLED = {"fx_slots", "fx_tables", "fx_columns", "fx_fks", "fx_ddl", "fx_term_vectors", "fx_terms"}


def _needs(text: str) -> list[str]:
    return [n for n in FIXTURES if re.search(rf"\b{n}\b", text)]


def with_chain(text: str, dialect: Dialect) -> str:
    """``WITH`` clause that defines every fixture ``text`` needs, in order."""
    chain: dict[str, str] = {}

    def add(names: list[str]) -> None:
        for name in names:
            if name not in chain:
                body = FIXTURES[name](dialect)
                add(_needs(body))
                chain[name] = body

    add(_needs(text))
    return ", ".join(f"{name} as ({body})" for name, body in chain.items())


def oracle(text: str, *ctes: str) -> str:
    """DuckDB SQL: the fixtures that ``text`` and ``ctes`` need, the CTEs, the query."""
    own = ", ".join(ctes)
    chain = with_chain(" ".join([*ctes, text]), Dialect(spark=False))
    clauses = ", ".join(c for c in (chain, own) if c)
    return f"with {clauses} {text}" if clauses else text


# --- Spark side -----------------------------------------------------------------

_settled: dict[tuple[str, str, str], DataFrame] = {}


def stored(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    build: Callable[[], DataFrame],
    partition_by: tuple[str, ...] = (),
) -> DataFrame:
    """A table that an earlier step of the work leaves behind, built once per session."""
    key = (spark.conf.get("spark.app.id"), sf_dir, name)
    if key not in _settled:
        _settled[key] = settle(build(), name, partition_by)
    return _settled[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a frame."""
    name = f"fx_{name}"
    if name in SETTLED:
        return stored(spark, sf_dir, name, lambda: _select(spark, sf_dir, name))
    return _select(spark, sf_dir, name)


def _select(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    body = FIXTURES[name](Dialect(spark=True))
    inputs = {n: fx(spark, sf_dir, n[3:]) for n in _needs(body)}
    inputs |= {
        t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(from|join) {t}\b", body)
    }
    # Plain braces of patterns are doubled; the names of inputs become parameters.
    body = body.replace("{", "{{").replace("}", "}}")
    for n in inputs:
        body = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", body)
    return spark.sql(body, **inputs)


def catalog_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as nested records, with ``*`` at index 0, a foreign key that
    points at it, some short type lists, and some records without tables."""
    return stored(spark, sf_dir, "records", lambda: _records(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = fx(spark, sf_dir, "columns").withColumn(
        "idx", F.col("table_ord") * PER_TABLE + F.col("col_ord") + 1
    )

    def listed(value, when=None):
        row = F.struct("idx", value.alias("v"))
        rows = F.collect_list(row if when is None else F.when(when, row))
        return F.transform(F.array_sort(rows), lambda r: r["v"])

    pair = F.array(F.col("table_ord").cast("string"), F.col("col_name"))
    target = (F.col("table_ord") - 1) * PER_TABLE + 1
    by_schema = cols.groupBy(F.col("schema_id").alias("db_id")).agg(
        listed(F.col("table_name"), F.col("col_ord") == 0).alias("table_names_original"),
        F.concat(F.array(F.array(F.lit("-1"), F.lit("*"))), listed(pair)).alias(
            "column_names_original"
        ),
        F.concat(F.array(F.lit("text")), listed(F.col("dtype"))).alias("column_types"),
        listed(F.col("idx"), F.col("is_pk")).alias("primary_keys"),
        F.concat(
            F.array(F.array(F.lit(1), F.lit(0))),
            listed(F.array(F.col("idx"), target), F.col("is_fk")),
        ).alias("foreign_keys"),
    )
    short = F.when(
        F.col("db_id").endswith("4"),
        F.slice("column_types", F.lit(1), F.size("column_types") - 1),
    ).otherwise(F.col("column_types"))
    full = by_schema.withColumn("column_types", short)
    void = table(spark, sf_dir, "region").select(
        F.concat(F.lit("void"), F.col("r_regionkey").cast("string")).alias("db_id"),
        *[
            F.array().cast(full.schema[c].dataType).alias(c)
            for c in full.columns if c != "db_id"
        ],
    )
    return full.unionByName(void)


def logical_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = fx(spark, sf_dir, "logical_form")

    def cond(n: str, is_str: bool):
        return F.struct(
            F.col(f"{n}_col").alias("col"), F.col(f"{n}_op").alias("op"),
            F.col(f"{n}_value").alias("value"), F.lit(is_str).alias("is_str"),
        )

    conds = F.slice(F.array(cond("c1", True), cond("c2", False)), F.lit(1), F.col("n_conds"))
    return flat.select(
        "example_id", F.lit("single_table").alias("dataset"), "table_id", "question", "sel", "agg",
        conds.alias("conds"),
    )


def single_table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array(*[F.lit(t) for t in ("text", "real", "text", "text", "real")])
    return fx(spark, sf_dir, "single_tables").select(
        "id", "page_title",
        F.array("h1", "h2", "h3", "h4", "h5").alias("header"),
        F.slice(types, F.lit(1), F.col("n_types")).alias("types"),
    )


def typed_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of both sides as typed values: the lines of every order, which the predicted
    side has in other types, with other values, or not comparable at all."""
    lines = table(spark, sf_dir, "lineitem").withColumn("m", F.pmod("l_orderkey", F.lit(10)))
    number, quantity = F.col("l_linenumber"), F.col("l_quantity")
    m, pred = F.col("m"), F.col("side") == "pred"

    def variant(c, kind=None):
        return (c.cast(kind) if kind else c).cast("variant")

    first = (
        F.when(pred & (m == 0), variant(number, "double"))
        .when(pred & (m == 1), variant(number, "decimal(20,6)"))
        .when(pred & (m == 2), variant(number, "string"))
        .when((m == 3) & (number == 1), variant(F.lit("NaN"), "double"))
        .when((m == 4) & (number == 1), F.lit(None).cast("variant"))
        .when((m == 6) & (number == 1) & pred, variant(F.lit(True)))
        .otherwise(variant(number))
    )
    second = F.when(pred & (m == 5) & (number == 2), variant(quantity + 1)).when(
        pred, variant(quantity, "decimal(12,2)")
    ).otherwise(variant(quantity))
    nested = F.array(number, F.when(pred & (m == 7) & (number == 3), -number).otherwise(number)).cast("variant")
    third = F.when(m == 7, nested).otherwise(variant(F.col("l_shipdate")))
    sides = lines.withColumn("side", F.explode(F.array(F.lit("gold"), F.lit("pred"))))
    return sides.select(F.col("l_orderkey").alias("example_id"), "side", F.array(first, second, third).alias("row"))


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx(spark, sf_dir, "result_rows").select(
        "example_id", "side", F.array("a", "b", "c").alias("row")
    )
