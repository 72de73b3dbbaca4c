"""DuckDB SQL for the lists of query parts and the text-feature distributions."""

from sqlprism.functions import vocab

from . import base
from . import text as text_oracle
from .match import JOIN_OPS

TYPE_OF = {m: name for name, _, members in vocab.OPERATOR_TYPES for m in members}
TYPES = "CASE op " + " ".join(f"WHEN {base.q(m)} THEN {base.q(t)}" for m, t in TYPE_OF.items()) + " END"
LISTED = base.in_list(TYPE_OF)


def tok(body: str, *extra: str) -> str:
    return base.with_ctes(base.DATAPOINTS, base.token_ctes("datapoints"), *extra) + "\n" + body


def oracles() -> dict:
    shallow = ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in base.OP_COLS + base.CLAUSE_ABBRS + ["SO", "columns", "tables", "values"])
    dd = "dd AS (SELECT d.*, x.dataset FROM dep d JOIN texts x USING (text_id))"
    ann, rar = text_oracle.ANN, text_oracle.RAR

    def shares(src, col, *ctes):
        return text_oracle.t(text_oracle.pct(src, col, "pct_texts"), *ctes)

    def of_texts(name):
        return f"(SELECT r.*, x.dataset FROM {name} r JOIN texts x USING (text_id))"

    pct_sql = text_oracle.oracles()["question_schema_reference_pct"]
    referenced = f"(SELECT p.*, d.dataset FROM ({pct_sql}) p JOIN (SELECT o_orderkey AS datapoint_id, o_orderstatus AS dataset FROM orders) d USING (datapoint_id))"
    return {
        "sql_operator_lists": tok(f"""
SELECT datapoint_id, CAST(scope AS INTEGER) AS scope, CAST(depth AS BIGINT) AS depth, clause,
       string_agg(op, ',' ORDER BY pos) AS operators, string_agg({TYPES}, ',' ORDER BY pos) AS operator_types,
       coalesce(string_agg({TYPES}, ',' ORDER BY pos) FILTER ({TYPES} <> 'aggregate'), '') AS conditions
FROM tok WHERE op IN {LISTED} GROUP BY ALL"""),
        "sql_operator_lists_deep": tok(f"""
SELECT datapoint_id, clause, string_agg(op, ',' ORDER BY pos) AS operators,
       string_agg({TYPES}, ',' ORDER BY pos) AS operator_types
FROM tok WHERE op IN {LISTED} GROUP BY ALL"""),
        "sql_variables": tok("""
SELECT t.datapoint_id, CAST(t.scope AS INTEGER) AS scope, CAST(t.depth AS BIGINT) AS depth, t.clause,
  CAST(t.pos AS INTEGER) AS pos, t.role,
  CASE WHEN t.role = 'column' THEN string_split(t.lt, '.')[-1]
       WHEN t.role = 'value' AND t.kind = 'str' THEN substr(t.lt, 2, length(t.lt) - 2) ELSE t.lt END AS name,
  CASE WHEN t.role = 'table' THEN t.lt
       WHEN t.role = 'column' AND contains(t.lt, '.') THEN coalesce(a.real, split_part(t.lt, '.', 1)) || '.' || string_split(t.lt, '.')[-1]
       WHEN t.role = 'column' THEN coalesce(s.lone || '.', '') || t.lt END AS complete_name, t.alias_of
FROM tok t
LEFT JOIN al a ON a.datapoint_id = t.datapoint_id AND a.scope = t.scope AND a.lt = split_part(t.lt, '.', 1)
LEFT JOIN lone s ON s.datapoint_id = t.datapoint_id AND s.scope = t.scope
WHERE t.role IS NOT NULL AND t.role <> 'function'""", """
al AS (SELECT datapoint_id, scope, lt, min(alias_of) AS real FROM tok WHERE role = 'table_alias' GROUP BY ALL)""", f"""
lone AS (SELECT datapoint_id, scope, coalesce(max(lt) FILTER (role = 'table'), max(lt) FILTER (role = 'query_alias')) AS lone
         FROM tok GROUP BY ALL HAVING count(*) FILTER (role IN ('table', 'query_alias')) = 1
                              AND count(*) FILTER (op IN {base.in_list(JOIN_OPS)}) = 0)"""),
        "sql_query_flags": tok("""
SELECT s.*, coalesce(o.orderby_directions, '') AS orderby_directions FROM (
  SELECT datapoint_id, CAST(scope AS INTEGER) AS scope, CAST(depth AS BIGINT) AS depth,
    coalesce(bool_or(lt = 'distinct' AND prev1 = 'select'), false) AS select_distinct,
    coalesce(bool_or(lt = 'distinct' AND prev1 = '(' AND prev2 IN ('count', 'min', 'max', 'sum', 'avg')), false) AS aggregate_distinct,
    coalesce(bool_or(is_setop AND lt = 'union' AND next1 = 'all'), false) AS union_all,
    coalesce(bool_or(role = 'function'), false) AS has_unlisted_function,
    coalesce(bool_or(clause_kw = 'limit'), false) AS has_limit,
    coalesce(string_agg(lt, ',' ORDER BY pos) FILTER (role = 'column' AND clause = 'groupby'), '') AS groupby_columns
  FROM tok GROUP BY ALL) s
LEFT JOIN (
  SELECT datapoint_id, scope, string_agg(d, ',' ORDER BY branch, ob_item) AS orderby_directions FROM (
    SELECT datapoint_id, scope, branch, ob_item, CASE WHEN bool_or(lt = 'desc') THEN 'desc' ELSE 'asc' END AS d
    FROM tok WHERE clause = 'orderby' AND p = base_p AND lt NOT IN ('order', 'by', ',') GROUP BY ALL)
  GROUP BY ALL) o USING (datapoint_id, scope)"""),
        "sql_normalized": tok("""
SELECT datapoint_id, string_agg(CASE WHEN lt = ',' AND op = 'join' THEN 'join' WHEN lt = '<>' THEN '!='
         WHEN kind = 'ident' THEN replace(tok, '`', '"') ELSE tok END, ' ' ORDER BY pos) AS sql
FROM tok LEFT JOIN wrapped w USING (datapoint_id, scope, branch)
WHERE NOT coalesce(lt = 'inner' AND next1 = 'join', false)
  AND NOT coalesce(w.closing = w.ending AND pos IN (w.opening, w.closing), false)
GROUP BY datapoint_id""", """
opened AS (SELECT datapoint_id, scope, branch, max(pos) AS opening FROM tok
           WHERE lt = '(' AND prev1 = 'where' AND clause = 'where' AND NOT sub_open AND p = base_p + 1 GROUP BY ALL)""", """
wrapped AS (SELECT datapoint_id, scope, branch, any_value(opening) AS opening, max(pos) FILTER (clause = 'where') AS ending,
                   min(pos) FILTER (lt = ')' AND p = base_p AND pos > opening) AS closing
            FROM tok JOIN opened USING (datapoint_id, scope, branch) GROUP BY ALL)"""),
        "sql_shallow_counts": base.with_ctes(base.DATAPOINTS, base.feature_ctes()) + f"""
SELECT datapoint_id, CAST(scope AS INTEGER) AS scope, CAST(depth AS BIGINT) AS depth, {shallow} FROM sstats""",
        "question_schema_reference_shares": text_oracle.pct(referenced, "referenced_schema_elements_percentage", "pct_questions"),
        "question_schema_reference_statistics": text_oracle.summary(referenced, "referenced_schema_elements_percentage", "schema_reference"),
        "text_flesch_shares": shares("rd2", "flesch_reading_ease", text_oracle.READ),
        "text_eflaw_shares": shares("rd2", "mcalpine_eflaw", text_oracle.READ),
        "text_eflaw_statistics": text_oracle.t(text_oracle.summary("rd2", "mcalpine_eflaw", "eflaw"), text_oracle.READ),
        "text_rarity_shares": shares(of_texts("rar"), "rarity", ann, rar),
        "text_lexical_density_shares": shares(of_texts("dens"), "lexical_density", ann, rar),
        **{name: text_oracle.rec(shares("dd", col, ann, text_oracle.DEP, dd)) for name, col in (
            ("text_dependency_distance_shares", "avg_dependency_distance"), ("text_dependency_depth_shares", "depth"),
            ("text_dependencies_num_shares", "dependencies_num"))},
    }


def more() -> dict:
    """Q4, Q27, T10 and D2 as rows of their own."""
    names = [*[(a, n) for n, a in vocab.CLAUSES], ("SO", "set_operator"), ("N", "nesting")]
    repeated = ", ".join(f"list_transform(range(coalesce({a}, 0)), lambda i: '{n}')" for a, n in names)
    types = "CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower(data_type) END"
    tables = ["customer", "lineitem", "nation", "orders", "part", "region", "supplier"]
    sizes = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in tables)
    return {
        "sql_structural_components": base.with_ctes(base.DATAPOINTS, base.feature_ctes()) + f"""
SELECT datapoint_id, current_depth, subquery_no,
       CASE WHEN parse_error IS NULL THEN array_to_string(flatten([{repeated}]), ',') END AS components FROM features""",
        "sql_column_equivalences": tok("""
SELECT datapoint_id, CAST(scope AS INTEGER) AS scope, col AS "column", coalesce(string_agg(other, ',' ORDER BY other) FILTER (other <> col), '') AS equals
FROM reach GROUP BY datapoint_id, scope, col""", """
al AS (SELECT datapoint_id, scope, lt, min(alias_of) AS real FROM tok WHERE role = 'table_alias' GROUP BY ALL)""", f"""
lone AS (SELECT datapoint_id, scope, coalesce(max(lt) FILTER (role = 'table'), max(lt) FILTER (role = 'query_alias')) AS lone
         FROM tok GROUP BY ALL HAVING count(*) FILTER (role IN ('table', 'query_alias')) = 1
                              AND count(*) FILTER (op IN {base.in_list(JOIN_OPS)}) = 0),
names AS (SELECT t.datapoint_id, t.scope, t.pos,
                 CASE WHEN contains(t.lt, '.') THEN coalesce(a.real, split_part(t.lt, '.', 1)) || '.' || string_split(t.lt, '.')[-1] ELSE coalesce(s.lone || '.', '') || t.lt END AS name
          FROM tok t LEFT JOIN al a ON a.datapoint_id = t.datapoint_id AND a.scope = t.scope AND a.lt = split_part(t.lt, '.', 1)
          LEFT JOIN lone s ON s.datapoint_id = t.datapoint_id AND s.scope = t.scope WHERE t.role = 'column'),
equal AS (SELECT DISTINCT e.datapoint_id, e.scope, unnest([l.name, r.name]) AS col, unnest([r.name, l.name]) AS other
          FROM tok e JOIN names l ON l.datapoint_id = e.datapoint_id AND l.scope = e.scope AND l.pos = e.pos - 1
          JOIN names r ON r.datapoint_id = e.datapoint_id AND r.scope = e.scope AND r.pos = e.pos + 1 WHERE e.op = 'eq'),
reach AS (SELECT * FROM equal
          UNION SELECT r.datapoint_id, r.scope, r.col, e.other FROM reach r JOIN equal e ON e.datapoint_id = r.datapoint_id AND e.scope = r.scope AND e.col = r.other)"""),
        "text_closeness_centralization": text_oracle.rec(text_oracle.t("""
SELECT text_id, round(avg(spread / nullif(n - 1, 0)), 9) AS closeness_centralization
FROM (SELECT s.text_id, s.sent_id, s.n, s.n * coalesce(max(c), 0.0) - coalesce(sum(c), 0.0) AS spread
      FROM (SELECT text_id, sent_id, count(*) AS n FROM ann GROUP BY ALL) s LEFT JOIN (
        SELECT text_id, sent_id, node, count(*) / CAST(sum(dist) AS DOUBLE) AS c FROM up WHERE node > 0 GROUP BY ALL) k USING (text_id, sent_id)
      GROUP BY s.text_id, s.sent_id, s.n)
GROUP BY text_id""", text_oracle.ANN, """
up AS (SELECT text_id, sent_id, tok_id, head AS node, 1 AS dist FROM ann
       UNION ALL SELECT u.text_id, u.sent_id, u.tok_id, a.head, u.dist + 1 FROM up u
       JOIN ann a ON a.text_id = u.text_id AND a.sent_id = u.sent_id AND a.tok_id = u.node)""")),
        "schema_from_catalog": f"""
SELECT 'given' AS db_id, 0 AS col_idx, NULL AS table_name, NULL AS n_rows, '*' AS column_name, 'text' AS column_type
UNION ALL SELECT 'given', CAST(row_number() OVER (ORDER BY table_name, ordinal_position) AS INTEGER), table_name, n_rows, column_name, {types}
FROM information_schema.columns JOIN ({sizes}) USING (table_name)""",
    }
