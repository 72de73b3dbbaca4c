"""Shared CTE text for the DuckDB oracles (fixtures, token relation, feature rows)."""

from sqlprism.functions import vocab
from sqlprism.sources.fixtures import DICTIONARY_EXTRA, N_DATABASES, SCHEMA_TABLES


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


DATAPOINTS = """
uq AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS turn_no,
         count(*) OVER (PARTITION BY conv_id) AS turns, text AS question
  FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL
),
nconv AS (SELECT max(conv_id) + 1 AS n_conv FROM uq),
dp0 AS (
  SELECT o_orderkey AS datapoint_id, o_orderstatus AS dataset,
         CASE WHEN o_orderkey % 10 = 0 THEN 'test' WHEN o_orderkey % 10 = 1 THEN 'dev' ELSE 'train' END AS split,
         concat('db_', CAST(o_custkey % 5 AS VARCHAR)) AS db_id,
         o_orderkey % n_conv AS conv_id, o_orderkey // n_conv AS pass_no,
         CASE o_orderkey % 20
         WHEN 0 THEN concat('select count(*) from orders where o_custkey = ', o_custkey)
         WHEN 1 THEN concat('select o_orderkey, o_totalprice from orders where o_totalprice > ', cast(floor(o_totalprice) as bigint), ' and o_orderstatus = ''', o_orderstatus, ''' order by o_totalprice desc limit 5')
         WHEN 2 THEN concat('select c.c_name, sum(o.o_totalprice) from customer as c join orders as o on c.c_custkey = o.o_custkey where c.c_custkey = ', o_custkey, ' group by c.c_name')
         WHEN 3 THEN concat('select c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice >= ', cast(floor(o_totalprice) as bigint), ')')
         WHEN 4 THEN concat('select distinct c_mktsegment from customer where c_acctbal between ', o_custkey, ' and ', cast(floor(o_totalprice) as bigint), ' and c_nationkey != 3')
         WHEN 5 THEN concat('select n.n_name, count(*) from customer c, nation n where c.c_nationkey = n.n_nationkey group by n.n_name having count(*) > ', o_custkey % 20)
         WHEN 6 THEN concat('select c_name from customer where c_nationkey = ', o_custkey % 25, ' union select s_name from supplier where s_nationkey = ', o_custkey % 25)
         WHEN 7 THEN 'select max(t.total) from (select sum(o_totalprice) as total from orders group by o_custkey) as t'
         WHEN 8 THEN concat('select p_name from part where p_name like ''%ring%'' and p_size <> ', o_custkey % 50)
         WHEN 9 THEN concat('select l.l_orderkey from lineitem l left join orders o on l.l_orderkey = o.o_orderkey where o.o_orderkey is null or l.l_quantity * l.l_extendedprice > ', cast(floor(o_totalprice) as bigint))
         WHEN 10 THEN 'select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > (select avg(c_acctbal) from customer)) order by o_orderdate asc limit 3'
         WHEN 11 THEN 'select count( from orders where'
         WHEN 12 THEN concat('with big as (select o_custkey from orders where o_totalprice > ', cast(floor(o_totalprice) as bigint), ') select c.c_name from customer c inner join big b on c.c_custkey = b.o_custkey where c.c_acctbal < ', o_custkey)
         WHEN 13 THEN concat('select p_name from part where p_size <= ', o_custkey % 50, ' and not (p_retailprice not between 10 and ', o_custkey, ') and p_brand ilike ''b%'' intersect select p_name from part where p_type not like ''%''''s%'' or p_retailprice / 2 > ', o_custkey)
         WHEN 14 THEN 'select "c"."c_name", min(c.c_acctbal - 1.5e1), max(c.c_acctbal + .5) from customer "c" cross join region r group by "c"."c_name" order by "c"."c_name" desc, c.c_acctbal'
         WHEN 15 THEN concat('select s_name from supplier where s_name is not null except select s_name from supplier where exists (select n_nationkey from nation where n_name = " RUSSIA " -- isn''t read', chr(10), ')')
         WHEN 16 THEN concat('select o_orderkey, case when o_totalprice > ', cast(floor(o_totalprice) as bigint), ' then ''big'' else ''small'' end as größe from orders o left outer join customer c on o.o_custkey = c.c_custkey group by o_orderkey, c.c_name')
         WHEN 17 THEN 'select count(distinct o_custkey) from orders /* all''s well */ union all select upper(c_name) from customer'
         WHEN 18 THEN 'select count(*) from customer group by c_nationkey + 1'
         ELSE 'select c_name from customer where c_custkey = ?' END AS sql_query
  FROM orders, nconv
),
datapoints AS (
  SELECT d.datapoint_id, d.dataset, d.split, d.db_id, concat('databases/', d.db_id, '.json') AS db_path,
         uq.question, d.sql_query
  FROM dp0 d LEFT JOIN uq ON d.conv_id = uq.conv_id AND d.pass_no % uq.turns = uq.turn_no
)"""

PREDICTIONS = """
models AS (SELECT * FROM (VALUES (0), (1), (2)) v(m)),
predictions AS (
  SELECT d.datapoint_id, d.dataset, d.split, d.db_id, d.db_path, d.question, concat('m', CAST(m AS VARCHAR)) AS model, m,
         d.sql_query AS gold,
         CASE (cast(floor(d.datapoint_id / 12) as bigint) + m) % 5
           WHEN 0 THEN d.sql_query
           WHEN 1 THEN replace(replace(d.sql_query, ' > ', ' >= '), ' = ', ' != ')
           WHEN 2 THEN replace(replace(d.sql_query, ' and ', ' or '), 'count(*)', 'sum(o_custkey)')
           WHEN 3 THEN concat(d.sql_query, ' limit 3')
           ELSE replace(replace(d.sql_query, 'select ', 'select distinct '), ' asc', ' desc') END AS predicted
  FROM datapoints d, models
)"""


def schema_ctes() -> str:
    counts = " UNION ALL ".join(f"SELECT {q(t)} AS table_name, {i} AS table_idx, count(*) AS n_rows FROM {t}" for i, t in enumerate(SCHEMA_TABLES))
    extra = ", ".join(f"({q(w)})" for w in DICTIONARY_EXTRA)
    n = len(SCHEMA_TABLES)
    return f"""
tcounts AS ({counts}),
dbs AS (SELECT k, 'db_' || k AS db_id FROM range({N_DATABASES}) r(k)),
schema_tables AS (SELECT db_id, table_idx, table_name, n_rows FROM tcounts, dbs WHERE table_idx < {n} - k),
dbcols AS (
  SELECT c.table_name, t.table_idx, c.column_name, row_number() OVER (ORDER BY t.table_idx, c.ordinal_position) AS col_idx,
         CASE c.data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(c.data_type) END AS column_type
  FROM information_schema.columns c JOIN tcounts t USING (table_name)
),
schema_columns AS (
  SELECT db_id, 0 AS col_idx, -1 AS table_idx, '*' AS column_name, 'text' AS column_type FROM dbs
  UNION ALL SELECT db_id, col_idx, table_idx, column_name, column_type FROM dbcols, dbs WHERE table_idx < {n} - k
),
keycols AS (SELECT table_name, column_name, regexp_extract(column_name, '_([a-z]+)key$', 1) AS stem FROM dbcols),
schema_fk_names AS (
  SELECT db_id, f.table_name AS fk_table, f.column_name AS fk_column, p.table_name AS pk_table, p.column_name AS pk_column
  FROM keycols f JOIN keycols p ON f.stem = p.stem AND f.stem <> '' AND starts_with(p.table_name, p.stem) AND f.table_name <> p.table_name, dbs
),
dict_words AS (
  SELECT DISTINCT word FROM (
    SELECT unnest(regexp_extract_all(lower(r_name), '\\p{{L}}+')) AS word FROM region
    UNION ALL SELECT unnest(regexp_extract_all(lower(n_name), '\\p{{L}}+')) FROM nation
    UNION ALL SELECT * FROM (VALUES {extra}) e(word))
)"""


def _map_case(col: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {q(k)} THEN {q(v)}" for k, v in mapping.items()) + " END"


def token_ctes(src: str, key: str = "datapoint_id", sql_col: str = "sql_query", prefix: str = "") -> str:
    """CTEs ``{prefix}tok`` (token relation with roles and operators) over relation ``src``."""
    P = prefix
    kw = in_list(vocab.KEYWORDS)
    pat, sym = q(vocab.TOKEN_PATTERN), q(vocab.SYMBOL_PATTERN)
    K = key
    w = f"PARTITION BY {K} ORDER BY pos"
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    join_name = ("CASE WHEN prev1 = 'left' THEN 'left join' WHEN prev1 = 'inner' THEN 'inner join' "
                 "WHEN prev1 = 'cross' THEN 'cross join' WHEN prev1 = 'outer' AND prev2 = 'left' THEN 'left outer join' "
                 "WHEN prev1 IN ('right', 'full', 'outer', 'natural') THEN prev1 || ' join' ELSE 'join' END")
    return f"""
{P}t0 AS (
  SELECT {K}, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos
  FROM (SELECT {K}, list_filter(regexp_extract_all({sql_col}, {pat}),
                                lambda x: NOT starts_with(x, '--') AND NOT starts_with(x, '/*')) AS toks FROM {src})
),
{P}t1 AS (
  SELECT {K}, pos, tok,
    CASE WHEN tok IN ('''', '"', '`') OR left(tok, 1) = '''' THEN tok
         WHEN regexp_matches(tok, '^["`\\p{{L}}_]') THEN replace(replace(lower(tok), '"', ''), '`', '')
         ELSE lower(tok) END AS lt,
    CASE WHEN tok IN ('''', '"', '`') THEN 'quote'
         WHEN left(tok, 1) = '''' THEN 'str'
         WHEN left(tok, 1) IN ('"', '`') THEN 'ident'
         WHEN regexp_matches(tok, '^\\.?[0-9]') THEN 'num'
         WHEN regexp_matches(tok, '^[\\p{{L}}_]') THEN (CASE WHEN lower(tok) IN {kw} THEN 'kw' ELSE 'ident' END)
         WHEN regexp_full_match(tok, {sym}) THEN 'sym' ELSE 'other' END AS kind
  FROM {P}t0
),
{P}t2a AS (
  SELECT *,
    lag(lt, 1) OVER ({w}) AS prev1, lag(lt, 2) OVER ({w}) AS prev2, lag(kind, 1) OVER ({w}) AS prev_kind,
    lead(lt, 1) OVER ({w}) AS next1, lead(lt, 2) OVER ({w}) AS next2, lead(kind, 1) OVER ({w}) AS next_kind,
    sum(CASE WHEN lt = '(' THEN 1 WHEN lt = ')' THEN -1 ELSE 0 END) OVER ({w} {run}) AS p
  FROM {P}t1
),
{P}t2 AS (
  SELECT * REPLACE (CASE WHEN dq THEN 'str' ELSE kind END AS kind, CASE WHEN dq THEN replace(tok, '"', chr(39)) ELSE lt END AS lt)
  FROM (SELECT *, tok LIKE '"%"' AND length(tok) > 1 AND NOT contains(tok[2:-2], '"')
        AND coalesce(prev1 IN ('=', '!=', '<>', '<', '>', '<=', '>=', 'like', 'ilike', 'between'), false) AS dq FROM {P}t2a)
),
{P}t3 AS (
  SELECT *, CASE WHEN lt = ')' THEN p + 1 ELSE p END AS lvl,
         (lt = '(' AND coalesce(next1 = 'select', false)) AS sub_open
  FROM {P}t2
),
{P}t4 AS (
  SELECT *, (lt = ')' AND coalesce(last_value(CASE WHEN lt = '(' THEN sub_open END IGNORE NULLS)
            OVER (PARTITION BY {K}, lvl ORDER BY pos {run}), false)) AS sub_close
  FROM {P}t3
),
{P}t5 AS (
  SELECT *, sum(CASE WHEN sub_open THEN 1 WHEN sub_close THEN -1 ELSE 0 END) OVER ({w} {run})
            - CASE WHEN sub_open THEN 1 ELSE 0 END AS depth0
  FROM {P}t4
),
{P}t6 AS (
  SELECT *, CASE WHEN sub_open THEN depth0 + 1 ELSE depth0 END AS depth FROM {P}t5
),
{P}t7 AS (
  SELECT *, coalesce(max(CASE WHEN sub_open THEN pos END) OVER (PARTITION BY {K}, depth ORDER BY pos {run}), -1) AS scope
  FROM {P}t6
),
{P}t8 AS (
  SELECT *, first_value(p) OVER (PARTITION BY {K}, scope ORDER BY pos {run}) AS base_p FROM {P}t7
),
{P}t9 AS (
  SELECT *, (lt IN ('intersect', 'union', 'except') AND p = base_p) AS is_setop FROM {P}t8
),
{P}t10 AS (
  SELECT *, sum(CASE WHEN is_setop THEN 1 ELSE 0 END) OVER (PARTITION BY {K}, scope ORDER BY pos {run}) AS branch,
    CASE WHEN p = base_p AND kind = 'kw' THEN
      CASE WHEN lt IN ('select', 'from', 'where', 'having', 'limit') THEN lt
           WHEN lt = 'group' AND next1 = 'by' THEN 'groupby'
           WHEN lt = 'order' AND next1 = 'by' THEN 'orderby' END END AS clause_kw
  FROM {P}t9
),
{P}t11 AS (
  SELECT *, last_value(clause_kw IGNORE NULLS) OVER (PARTITION BY {K}, scope, branch ORDER BY pos {run}) AS clause,
         lt IN ('and', 'between') AS is_ab
  FROM {P}t10
),
{P}t11b AS (
  SELECT *,
    (CASE WHEN clause_kw IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY {K}, scope, branch, clause_kw ORDER BY pos {run}) END) > 1 AS dup_clause,
    sum(CASE WHEN lt = ',' AND p = base_p AND clause = 'orderby' THEN 1 ELSE 0 END)
      OVER (PARTITION BY {K}, scope, branch ORDER BY pos {run}) AS ob_item
  FROM {P}t11
),
{P}t12 AS (
  SELECT *, (lt = 'and' AND coalesce(lag(lt, 1) OVER (PARTITION BY {K}, scope, p, is_ab ORDER BY pos) = 'between', false)) AS between_and,
         coalesce((lt IN ('from', 'join') AND kind = 'kw') OR (lt = ',' AND clause = 'from' AND p = base_p), false) AS from_sep
  FROM {P}t11b
),
{P}t13 AS (
  SELECT *,
    CASE
      WHEN lt = 'join' AND kind = 'kw' THEN {join_name}
      WHEN lt = ',' AND clause = 'from' AND p = base_p THEN 'join'
      WHEN lt IN ('count', 'min', 'max', 'sum', 'avg') AND next1 = '(' AND kind = 'kw' THEN lt
      WHEN kind = 'sym' AND lt IN ('>', '>=', '<', '<=', '=', '!=', '<>') THEN {_map_case('lt', vocab.COMPARISON_SYMBOLS)}
      WHEN lt = 'between' AND kind = 'kw' THEN (CASE WHEN prev1 = 'not' THEN 'not_between' ELSE 'between' END)
      WHEN lt = 'and' AND kind = 'kw' THEN (CASE WHEN between_and THEN NULL ELSE 'and' END)
      WHEN lt = 'or' AND kind = 'kw' THEN 'or'
      WHEN lt = 'not' AND kind = 'kw' AND NOT coalesce(next1 IN ('in', 'like', 'between', 'null'), false)
           AND NOT coalesce(prev1 = 'is', false) THEN 'not'
      WHEN lt = 'like' AND kind = 'kw' THEN (CASE WHEN prev1 = 'not' THEN 'not_like' ELSE 'like' END)
      WHEN lt = 'ilike' AND kind = 'kw' THEN 'ilike'
      WHEN kind = 'sym' AND lt IN ('-', '+', '*', '/') AND coalesce(prev_kind IN ('ident', 'num', 'str') OR prev1 = ')', false)
           THEN {_map_case('lt', vocab.ARITHMETIC_SYMBOLS)}
      WHEN lt = 'in' AND kind = 'kw' THEN (CASE WHEN prev1 = 'not' THEN 'nin' ELSE 'in' END)
      WHEN lt = 'is' AND next1 = 'null' THEN 'is null'
      WHEN lt = 'is' AND next1 = 'not' AND next2 = 'null' THEN 'is not null'
      WHEN lt = 'exists' AND kind = 'kw' THEN 'exists'
    END AS op,
    coalesce(kind = 'ident' AND clause = 'from' AND lag(from_sep, 1) OVER ({w}), false) AS is_table
  FROM {P}t12
),
{P}t14 AS (
  SELECT *,
    CASE
      WHEN is_table THEN 'table'
      WHEN kind = 'ident' AND clause = 'from' AND (coalesce(lag(is_table, 1) OVER ({w}), false)
           OR (prev1 = 'as' AND coalesce(lag(is_table, 2) OVER ({w}), false))) THEN 'table_alias'
      WHEN kind = 'ident' AND (coalesce(lag(sub_close, 1) OVER ({w}), false)
           OR (prev1 = 'as' AND coalesce(lag(sub_close, 2) OVER ({w}), false))
           OR (next1 = 'as' AND next2 = '(' AND clause IS NULL)) THEN 'query_alias'
      WHEN kind = 'ident' AND prev1 = 'as' AND NOT coalesce(lag(is_table, 2) OVER ({w}), false)
           AND NOT coalesce(lag(sub_close, 2) OVER ({w}), false) THEN 'column_alias'
      WHEN kind = 'ident' AND next1 = '(' THEN 'function'
      WHEN kind = 'ident' THEN 'column'
      WHEN kind IN ('num', 'str') AND coalesce(clause <> 'limit', true) THEN 'value'
    END AS role,
    CASE WHEN sub_open THEN lag(scope, 1) OVER ({w}) END AS parent_scope,
    CASE WHEN sub_open THEN lag(branch, 1) OVER ({w}) END AS parent_branch
  FROM {P}t13
),
{P}tok AS (
  SELECT *, CASE WHEN role = 'table_alias' THEN (CASE WHEN prev1 = 'as' THEN prev2 ELSE prev1 END) END AS alias_of
  FROM {P}t14
)"""


def parse_error_ctes(src: str, key: str = "datapoint_id", sql_col: str = "sql_query", prefix: str = "") -> str:
    P, K = prefix, key
    return f"""
{P}pq AS (
  SELECT {K}, min(p) AS min_p, arg_max(p, pos) AS last_p, max(CASE WHEN lt = 'select' THEN 1 ELSE 0 END) AS has_select,
         max(CASE WHEN lt = 'distinct' AND next1 = 'distinct' THEN 1 ELSE 0 END) AS dup_distinct,
         bool_or(kind = 'quote') AS lone_quote, bool_or(kind = 'other') AS unknown,
         bool_or(coalesce(clause = 'groupby', false) AND clause_kw IS NULL AND (sub_close OR NOT (
           lt IN ('by', ',', ';', '(', ')') OR coalesce(role = 'column', false)))) AS group_expr,
         bool_or(lt = 'distinct' AND coalesce(prev1 = '(' AND prev2 IN ('count', 'min', 'max', 'sum', 'avg'), false)
           AND NOT coalesce(next_kind = 'ident' AND next2 IN (')', ','), false)) AS distinct_expr
  FROM {P}tok GROUP BY {K}
),
{P}rep AS (
  SELECT DISTINCT {K}, 1 AS dup_clause FROM (
    SELECT {K} FROM {P}tok WHERE clause_kw IS NOT NULL GROUP BY {K}, scope, branch, clause_kw HAVING count(*) > 1)
),
{P}errs AS (
  SELECT s.{K},
    CASE WHEN coalesce(min_p < 0, false) OR coalesce(last_p <> 0, false) THEN 'unbalanced parentheses'
         WHEN lone_quote THEN 'unbalanced quotes' WHEN unknown THEN 'unknown token'
         WHEN coalesce(has_select, 0) = 0 THEN 'no select'
         WHEN dup_distinct = 1 THEN 'repeated distinct'
         WHEN dup_clause = 1 THEN 'repeated clause' WHEN group_expr THEN 'group by on an expression'
         WHEN distinct_expr THEN 'distinct on an expression' END AS parse_error
  FROM {src} s LEFT JOIN {P}pq USING ({K}) LEFT JOIN {P}rep USING ({K})
)"""


OP_NAMES = vocab.operator_names()
OP_COLS = [vocab.operator_column(n) for n in OP_NAMES]
CLAUSE_ABBRS = [a for _, a in vocab.CLAUSES]
TYPE_ABBRS = [a for _, a, _ in vocab.OPERATOR_TYPES]
STRUCT = CLAUSE_ABBRS + ["SO", "N"]


def _name_cat(cols):
    parts = ", ".join(f"CASE WHEN {c} > 0 THEN '{c}' END" for c in cols)
    return f"concat_ws('-', {parts})"


def _counter_cat(cols):
    return "concat_ws('.', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"


def feature_ctes(src: str = "datapoints", key: str = "datapoint_id", sql_col: str = "sql_query",
                 carry=("dataset", "split", "db_id"), prefix: str = "") -> str:
    """CTE ``{prefix}features``: the queries frame (see sqlprism.operators.sqlfeatures.feature_rows)."""
    P, K = prefix, key
    op_sums = ",\n    ".join(f'sum(CASE WHEN op = {q(n)} THEN 1 ELSE 0 END) AS "{c}"' for n, c in zip(OP_NAMES, OP_COLS))
    cl_sums = ",\n    ".join(f"sum(CASE WHEN clause_kw = {q(n)} THEN 1 ELSE 0 END) AS {a}" for n, a in vocab.CLAUSES)
    count_cols = OP_COLS + CLAUSE_ABBRS + ["SO", "columns", "tables", "values"]
    deep_sums = ", ".join(f'sum(d."{c}") AS "{c}"' for c in count_cols)
    types = ", ".join(
        "(" + " + ".join(f'"{vocab.operator_column(m)}"' for m in members) + f") AS {abbr}"
        for _, abbr, members in vocab.OPERATOR_TYPES)
    carry_sel = ", ".join(f"m.{c}" for c in carry)
    feat_cols = (["structural_category_name", "operatorTypes_category_name", "structural_category_counter",
                  "operatorTypes_category_counter", "select_columns", "where_conditions", "groupby_columns",
                  "sql_query_depth"]
                 + OP_COLS + CLAUSE_ABBRS + ["columns", "tables", "values", "SO", "N"] + TYPE_ABBRS)
    fsel = ", ".join(f'r."{c}"' for c in feat_cols)
    is33 = in_list(OP_NAMES)
    return token_ctes(src, K, sql_col, P) + "," + parse_error_ctes(src, K, sql_col, P) + f""",
{P}sstats AS (
  SELECT {K}, scope,
    {op_sums},
    {cl_sums},
    sum(CASE WHEN is_setop THEN 1 ELSE 0 END) AS SO,
    sum(CASE WHEN role = 'column' THEN 1 ELSE 0 END) AS columns,
    sum(CASE WHEN role = 'table' THEN 1 ELSE 0 END) AS tables,
    sum(CASE WHEN role = 'value' THEN 1 ELSE 0 END) AS "values",
    sum(CASE WHEN lt = ',' AND clause = 'select' AND p = base_p AND branch = 0 THEN 1 ELSE 0 END) + 1 AS select_items,
    sum(CASE WHEN op IN {is33} AND clause = 'where' THEN 1 ELSE 0 END) AS where_ops,
    sum(CASE WHEN lt = ',' AND clause = 'groupby' AND p = base_p AND branch = 0 THEN 1 ELSE 0 END) + 1 AS groupby_items,
    max(depth) AS depth, max(pos) AS hi
  FROM {P}tok GROUP BY {K}, scope
),
{P}deep AS (
  SELECT a.{K}, a.scope, a.depth, a.SO AS sh_SO, a.select_items AS sh_select_items, a.where_ops AS sh_where_ops, a.W AS sh_W,
    a.groupby_items AS sh_groupby_items, a.G AS sh_G,
    {deep_sums},
    count(*) - 1 AS N, max(d.depth) - a.depth AS sql_query_depth
  FROM {P}sstats a JOIN {P}sstats d ON a.{K} = d.{K} AND d.scope >= a.scope AND d.scope <= a.hi
  GROUP BY a.{K}, a.scope, a.depth, a.SO, a.select_items, a.where_ops, a.W, a.hi, a.groupby_items, a.G
),
{P}deep2 AS (
  SELECT *, {types}, row_number() OVER (PARTITION BY {K}, depth ORDER BY scope) - 1 AS subquery_no FROM {P}deep
),
{P}frows AS (
  SELECT {K}, depth AS current_depth, subquery_no,
    {_name_cat(STRUCT)} AS structural_category_name,
    coalesce(nullif({_name_cat(TYPE_ABBRS)}, ''), 'None') AS operatorTypes_category_name,
    {_counter_cat(STRUCT)} AS structural_category_counter,
    {_counter_cat(TYPE_ABBRS)} AS operatorTypes_category_counter,
    CAST(CASE WHEN sh_SO = 0 THEN sh_select_items END AS BIGINT) AS select_columns,
    CAST(CASE WHEN sh_SO = 0 AND sh_W > 0 THEN sh_where_ops END AS BIGINT) AS where_conditions,
    CAST(CASE WHEN sh_SO = 0 AND sh_G > 0 THEN sh_groupby_items END AS BIGINT) AS groupby_columns,
    CAST(sql_query_depth AS BIGINT) AS sql_query_depth,
    {", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in OP_COLS + CLAUSE_ABBRS)},
    CAST(columns AS BIGINT) AS columns, CAST(tables AS BIGINT) AS tables, CAST("values" AS BIGINT) AS "values",
    CAST(SO AS BIGINT) AS SO, CAST(N AS BIGINT) AS N,
    {", ".join(f"CAST({a} AS BIGINT) AS {a}" for a in TYPE_ABBRS)}
  FROM {P}deep2 WHERE {K} IN (SELECT {K} FROM {P}errs WHERE parse_error IS NULL)
),
{P}allrows AS (
  SELECT * FROM {P}frows
  UNION ALL SELECT * REPLACE (-1 AS current_depth) FROM {P}frows WHERE current_depth = 0
  UNION ALL BY NAME SELECT {K}, -1 AS current_depth, 0 AS subquery_no FROM {P}errs WHERE parse_error IS NOT NULL
),
{P}features AS (
  SELECT r.{K}, CAST(r.current_depth AS INTEGER) AS current_depth, CAST(r.subquery_no AS INTEGER) AS subquery_no,
    CASE WHEN r.current_depth = -1 THEN m.{sql_col} END AS {sql_col}, {carry_sel}, e.parse_error, {fsel}
  FROM {P}allrows r JOIN {src} m ON r.{K} = m.{K} JOIN {P}errs e ON r.{K} = e.{K}
)"""


def with_ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip().rstrip(",") for p in parts if p.strip())
