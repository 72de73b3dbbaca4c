"""DuckDB SQL for each registered query (same names, same output columns)."""

from __future__ import annotations

from . import base
from . import match as match_oracle
from .base import OP_COLS, TYPE_ABBRS

ORACLES: dict[str, str] = {}


def feat(body: str, *extra: str) -> str:
    return base.with_ctes(base.DATAPOINTS, base.feature_ctes(), *extra) + "\n" + body


def dps(body: str, *extra: str) -> str:
    return base.with_ctes(base.DATAPOINTS, *extra) + "\n" + body


def _summary(expr: str, name: str, where: str = "current_depth = -1") -> str:
    return feat(f"""
SELECT dataset, round_even(avg(v), 2) AS {name}_mean, min(v) AS {name}_min, max(v) AS {name}_max
FROM (SELECT dataset, CAST({expr} AS DOUBLE) AS v FROM features WHERE {where})
WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY dataset""")


def _pct(value_expr: str, name: str, where: str) -> str:
    return feat(f"""
SELECT dataset, {name}, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY dataset) AS pct_queries, -1 AS depth
FROM (SELECT dataset, {value_expr} AS {name}, count(*) AS n FROM features WHERE {where} GROUP BY ALL)
WHERE {name} IS NOT NULL""")


OPS_TOTAL = "CAST(" + " + ".join(f'"{c}"' for c in OP_COLS) + " AS BIGINT)"
OPS_UNIQUE = "CAST(" + " + ".join(f'(CASE WHEN "{c}" > 0 THEN 1 ELSE 0 END)' for c in OP_COLS) + " AS BIGINT)"
TYPES_PRESENT = "CAST(" + " + ".join(f"(CASE WHEN {a} > 0 THEN 1 ELSE 0 END)" for a in TYPE_ABBRS) + " AS BIGINT)"
ROOT = "current_depth = -1"
PARSED_ROOT = "current_depth = -1 AND parse_error IS NULL"

CATEGORY_COUNTS = """
cc_counts AS (SELECT dataset, current_depth, {col} AS category, count(*) AS n FROM features
              WHERE {col} IS NOT NULL GROUP BY ALL),
cc_cats AS (SELECT DISTINCT dataset, category FROM cc_counts),
cc_depths AS (SELECT dataset, current_depth, sum(n) AS depth_total FROM cc_counts GROUP BY ALL),
cc AS (SELECT c.dataset, c.category, d.current_depth AS depth, coalesce(k.n, 0) AS n, d.depth_total
       FROM cc_cats c JOIN cc_depths d USING (dataset)
       LEFT JOIN cc_counts k ON k.dataset = c.dataset AND k.category = c.category AND k.current_depth = d.current_depth)"""


def _shares(col: str) -> str:
    return feat("SELECT dataset, category, depth, 100.0::DOUBLE * n / depth_total AS pct_queries FROM cc",
                CATEGORY_COUNTS.format(col=col))


def _top(col: str, k: int) -> str:
    return f"""
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, category) AS rk
        FROM cc WHERE depth = -1) WHERE rk <= {k})"""


def _variety(col: str, name: str) -> str:
    return feat(f"""
SELECT dataset, CAST(sum(n * (depth_total - n)) AS DOUBLE) / CAST(first(depth_total) * first(depth_total) AS DOUBLE) AS {name}
FROM cc WHERE depth = -1 GROUP BY dataset""", CATEGORY_COUNTS.format(col=col))


ORACLES.update({
    "sql_feature_rows": feat("SELECT * FROM features"),
    "sql_token_relation": base.with_ctes(base.DATAPOINTS, base.token_ctes("datapoints")) + """
SELECT datapoint_id, CAST(pos AS INTEGER) AS pos, tok, kind, CAST(p AS BIGINT) AS p, CAST(depth AS INTEGER) AS depth,
       CAST(scope AS INTEGER) AS scope, CAST(branch AS BIGINT) AS branch, clause, op, role FROM tok""",
    "sql_parse_errors": base.with_ctes(base.DATAPOINTS, base.token_ctes("datapoints"),
                                       base.parse_error_ctes("datapoints")) + """
SELECT datapoint_id, parse_error FROM errs WHERE parse_error IS NOT NULL""",
    "unique_sql_queries": feat(
        "SELECT dataset, count(DISTINCT sql_query) AS unique_sql_queries FROM features WHERE current_depth = -1 "
        "GROUP BY dataset"),
    "unique_questions": dps("SELECT dataset, count(DISTINCT question) AS unique_questions FROM datapoints "
                            "GROUP BY dataset"),
    "templates_by_name": feat(
        "SELECT dataset, count(DISTINCT structural_category_name || operatorTypes_category_name) AS templates_name "
        "FROM features GROUP BY dataset"),
    "templates_by_counter": feat(
        "SELECT dataset, count(DISTINCT structural_category_counter || operatorTypes_category_counter) "
        "AS templates_counter FROM features GROUP BY dataset"),
    "unique_question_sql_pairs": feat(
        "SELECT f.dataset, count(DISTINCT f.sql_query || ' ' || d.question) AS unique_question_sql "
        "FROM features f JOIN datapoints d USING (datapoint_id) WHERE f.current_depth = -1 GROUP BY f.dataset"),
    "depth_statistics": _summary("sql_query_depth", "depth"),
    "operators_statistics": _summary(OPS_TOTAL, "operators", PARSED_ROOT),
    "values_statistics": _summary('"values"', "values"),
    "joins_statistics": _summary("CAST(split_part(operatorTypes_category_counter, '.', 1) AS BIGINT)", "joins"),
    "select_columns_statistics": _summary("select_columns", "select_columns"),
    "where_conditions_statistics": _summary("where_conditions", "where_conditions"),
    "databases_per_dataset": dps("SELECT dataset, count(DISTINCT db_id) AS databases FROM datapoints "
                                 "GROUP BY dataset"),
    "structural_category_shares": _shares("structural_category_name"),
    "operator_type_category_shares": _shares("operatorTypes_category_name"),
    "structural_top5": feat("""
SELECT dataset, category, depth, 100.0::DOUBLE * n / depth_total AS pct_queries FROM top
UNION ALL
SELECT dataset, 'Other', -1, 100.0::DOUBLE * (first(depth_total) - sum(n)) / first(depth_total) FROM top GROUP BY dataset""",
                            CATEGORY_COUNTS.format(col="structural_category_name"),
                            _top("structural_category_name", 5)),
    "operator_type_top3_other_members": feat("""
SELECT f.dataset, f.datapoint_id FROM features f
WHERE f.current_depth = -1 AND f.operatorTypes_category_name IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM top t WHERE t.dataset = f.dataset AND t.category = f.operatorTypes_category_name)""",
                                             CATEGORY_COUNTS.format(col="operatorTypes_category_name"),
                                             _top("operatorTypes_category_name", 3)),
    "operators_per_query": _pct(OPS_TOTAL, "operators", PARSED_ROOT),
    "unique_operators_per_query": _pct(OPS_UNIQUE, "unique_operators", PARSED_ROOT),
    "operator_types_per_query": _pct(TYPES_PRESENT, "operator_types", PARSED_ROOT),
    "tables_per_query": _pct("tables", "tables", ROOT),
    "columns_per_query": _pct("columns", "columns", ROOT),
    "values_per_query": _pct('"values"', "values", ROOT),
    "tables_statistics": _summary("tables", "tables"),
    "columns_statistics": _summary("columns", "columns"),
    "columns_boxplot": feat("""
, d AS (SELECT dataset, CAST(columns AS DOUBLE) AS v FROM features WHERE current_depth = -1 AND columns IS NOT NULL),
b AS (SELECT dataset, avg(v) AS mean, count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med,
             quantile_cont(v, 0.75) AS q3 FROM d GROUP BY dataset),
b2 AS (SELECT *, q3 - q1 AS iqr FROM b)
SELECT b2.dataset, mean, med, q1, q3, iqr,
       min(CASE WHEN v >= q1 - 1.5 * iqr THEN v END) AS whislo, max(CASE WHEN v <= q3 + 1.5 * iqr THEN v END) AS whishi,
       med - 1.57 * iqr / sqrt(n) AS cilo, med + 1.57 * iqr / sqrt(n) AS cihi,
       sum(CASE WHEN v < q1 - 1.5 * iqr OR v > q3 + 1.5 * iqr THEN 1 ELSE 0 END) AS n_fliers,
       (SELECT coalesce(string_agg(CAST(x.v AS VARCHAR) || 'x' || CAST(x.c AS VARCHAR), ',' ORDER BY x.v), '')
        FROM (SELECT dataset, v, count(*) AS c FROM d GROUP BY dataset, v) x
        WHERE x.dataset = b2.dataset AND (x.v < b2.q1 - 1.5 * b2.iqr OR x.v > b2.q3 + 1.5 * b2.iqr)) AS fliers
FROM d JOIN b2 USING (dataset) GROUP BY b2.dataset, mean, n, q1, med, q3, iqr"""),
    "structural_variety": _variety("structural_category_name", "structural_variety"),
    "operator_variety": _variety("operatorTypes_category_name", "operator_variety"),
})

ORACLES.update({
    "partial_match": match_oracle.partial_match_sql(),
    "partial_match_by_model": match_oracle.partial_match_by_model_sql(),
})

ORACLES.update({
    "evaluation_long": match_oracle.evaluation_long_sql(),
    "metric_errors": match_oracle.metric_errors_sql(),
    "success_rates": match_oracle.success_rates_sql(),
    "structural_category_errors": match_oracle.category_errors_sql("structural_category_name", 5),
    "operator_type_category_errors": match_oracle.category_errors_sql("operatorTypes_category_name", 3),
    "parsing_errors_per_model": match_oracle.parsing_errors_sql(),
    "models_disagreement_pm": match_oracle.disagreement_sql("PM"),
})

from . import text as text_oracle  # noqa: E402

ORACLES.update(text_oracle.oracles())

ORACLES.update({
    "deduplicated_datapoints": dps("""
SELECT datapoint_id, dataset, split FROM datapoints WHERE datapoint_id IN (
  SELECT min(datapoint_id) FROM datapoints GROUP BY dataset, split, question, sql_query, db_id)"""),
    "duplicates_removed": dps("""
SELECT dataset, split, count(*) - count(DISTINCT (question, sql_query, db_id)) AS duplicates_removed
FROM datapoints GROUP BY dataset, split"""),
    "sql_replaced": dps("""
SELECT datapoint_id, CASE WHEN sql_query = 'select count( from orders where' THEN 'select count(*) from orders'
                          ELSE sql_query END AS sql_query FROM datapoints"""),
    "sql_text_repairs": base.with_ctes(base.DATAPOINTS, base.PREDICTIONS) + """
SELECT datapoint_id, model,
  regexp_replace(regexp_replace(regexp_replace(predicted, '" (.*?) "', '"\\1"', 'g'),
                 '(RESTAURANT\\S*)\\.ID', '\\1.RESTAURANT_ID', 'g'), '\\."(.*?)"', '.\\1', 'g') AS predicted
FROM predictions""",
    "predictions_attached_by_position": base.with_ctes(base.DATAPOINTS, base.PREDICTIONS) + """
SELECT d.datapoint_id, p.model, p.predicted
FROM (SELECT datapoint_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY datapoint_id) - 1 AS position
      FROM datapoints) d
JOIN (SELECT dataset, model, predicted,
             row_number() OVER (PARTITION BY dataset, model ORDER BY datapoint_id) - 1 AS position FROM predictions) p
  ON p.dataset = d.dataset AND p.position = d.position""",
    "rejected_queries": feat("""
SELECT datapoint_id, dataset, sql_query, 'Error from parser: ' || parse_error AS error FROM features
WHERE current_depth = -1 AND parse_error IS NOT NULL"""),
    "rejected_counts": feat("""
SELECT dataset, CAST(sum(CASE WHEN parse_error IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS rejected, count(*) AS total
FROM features WHERE current_depth = -1 GROUP BY dataset"""),
})

ORACLES.update(text_oracle.report_oracles())

ORACLES.update({
    "query_hardness": match_oracle.hardness_sql(),
    "component_accuracy": match_oracle.component_accuracy_sql(),
    "metric_error_records": match_oracle.error_records_sql(),
})

ORACLES["text_dispersion"] = text_oracle.dispersion_sql()

from . import lists as lists_oracle  # noqa: E402

ORACLES.update(lists_oracle.oracles())
ORACLES.update(lists_oracle.more())

ORACLES.update({
    "value_by_depth": match_oracle.value_by_depth_sql(),
    "partial_scores": match_oracle.partial_scores_sql(),
})


def _rows(report: dict[str, tuple[str, str, str]], depth: bool) -> str:
    """The tables of a report as one relation, from the SQL of each: name -> (query, what it is about, percentage)."""
    text = ("category",)
    return " UNION ALL ".join(f"""
SELECT '{table}' AS "table", dataset, {"CAST(depth AS INTEGER)" if depth else "CAST(NULL AS INTEGER)"} AS depth, {about if about in text else "CAST(NULL AS VARCHAR)"} AS category,
       {"CAST(NULL AS DOUBLE)" if about in text else f"CAST({about} AS DOUBLE)"} AS x, {pct} AS pct FROM ({ORACLES[name]})""" for table, (name, about, pct) in report.items())


ORACLES.update({
    "sql_report": _rows({
        "structural_categories": ("structural_category_shares", "category", "pct_queries"), "operator_type_categories": ("operator_type_category_shares", "category", "pct_queries"),
        "operators": ("operators_per_query", "operators", "pct_queries"), "unique_operators": ("unique_operators_per_query", "unique_operators", "pct_queries"),
        "tables": ("tables_per_query", "tables", "pct_queries"), "columns": ("columns_per_query", "columns", "pct_queries"), "values": ("values_per_query", '"values"', "pct_queries")}, True),
    "questions_report": _rows({
        "length": ("question_length_shares", "length", "pct_questions"),
        "schema_references": ("question_schema_reference_shares", "referenced_schema_elements_percentage", "pct_questions")}, False),
    "databases_report": _rows({
        "tables": ("databases_by_tables", "tables_num", "pct_databases"), "columns": ("databases_by_columns", "columns_num", "pct_databases"),
        "fk_relations": ("databases_by_fk_relations", "foreign_primary_key_relations_num", "pct_databases"), "rows": ("databases_by_total_rows", "total_rows", "pct_databases"),
        "explainable": ("databases_by_explainable_pct", "explainable_schema_elements_percentage", "pct_databases")}, False),
    "evaluation_report": f"""
SELECT 'total_errors' AS "table", CAST(NULL AS VARCHAR) AS category, metric, model, errors, round(100.0 - success_pct, 9) AS pct_errors FROM ({ORACLES["success_rates"]})
UNION ALL SELECT 'structural_category_errors', category, metric, model, errors, round(pct_errors, 9) FROM ({ORACLES["structural_category_errors"]})
UNION ALL SELECT 'operator_type_category_errors', category, metric, model, errors, round(pct_errors, 9) FROM ({ORACLES["operator_type_category_errors"]})""",
    "schema_from_descriptors": base.with_ctes(base.schema_ctes()) + """
SELECT db_id, CAST(col_idx AS INTEGER) AS col_idx, table_idx, column_name, column_type FROM schema_columns""",
    "question_rows": text_oracle.question_rows_sql(),
})

ORACLES["datasets_from_registry"] = dps(r"""
SELECT dataset, split, count(*) AS datapoints, count(*) AS ids, CAST(CASE WHEN dataset = 'P' THEN count(*) ELSE 0 END AS BIGINT) AS alternatives,
       count(DISTINCT CASE WHEN dataset = 'P' THEN trim(regexp_replace(sql_query, '[\s|]+', ' ', 'g')) WHEN dataset = 'O' THEN regexp_replace(sql_query, '\."(.*?)"', '.\1', 'g') ELSE sql_query END) AS texts,
       count(DISTINCT CASE WHEN dataset = 'F' THEN db_id ELSE '-' END) AS databases, count(CASE WHEN dataset = 'P' THEN '' ELSE question END) AS questions
FROM (SELECT * REPLACE (CASE WHEN dataset = 'O' THEN 'all' ELSE split END AS split) FROM datapoints) GROUP BY dataset, split""")
