"""DuckDB oracles for the question / text features and the schema profile."""

from sqlprism.operators.text import HDD_SAMPLE, VOWELS
from sqlprism.sources.fixtures import CLOSED_CLASS

from . import base
from .base import q

W = r"'\p{L}+'"
TEXTS = """
texts AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS text_id, lang AS dataset, source AS split, text FROM documents
  UNION ALL
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), 'conversations', 'user', text
  FROM conversations WHERE role = 'user'
)"""
ANN = f"""
ref_words AS (
  SELECT form, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), {W})) AS form FROM documents) GROUP BY form
),
sents AS (
  SELECT text_id, unnest(s) AS sent, generate_subscripts(s, 1) - 1 AS sent_id
  FROM (SELECT text_id, regexp_split_to_array(text, '[.!?\\n]+') AS s FROM texts)
),
ann0 AS (
  SELECT text_id, sent_id, unnest(f) AS form, generate_subscripts(f, 1) - 1 AS p
  FROM (SELECT text_id, sent_id, regexp_extract_all(sent, {W}) AS f FROM sents)
),
ann AS (
  SELECT a.text_id, a.sent_id, a.p + 1 AS tok_id, a.form, lower(a.form) AS lemma,
         CASE WHEN lower(a.form) IN {base.in_list(CLOSED_CLASS)} THEN 'CLOSED' ELSE 'OPEN' END AS upos, CAST(floor((a.p + 1) / 2) AS INTEGER) AS head
  FROM ann0 a
)"""


def t(body, *extra):
    return base.with_ctes(TEXTS, *extra) + "\n" + body


def ln(x):
    return f"(CASE WHEN ({x}) > 0 THEN ln({x}) END)"


def nz(x):
    return f"nullif({x}, 0.0)"


LEX = f"""
wf AS (
  SELECT text_id, dataset, split, word, count(*) AS f
  FROM (SELECT text_id, dataset, split, unnest(regexp_extract_all(lower(text), {W})) AS word FROM texts)
  GROUP BY text_id, dataset, split, word
),
wf2 AS (
  SELECT *, sum(f) OVER (PARTITION BY text_id) AS n_text,
    CASE WHEN sum(f) OVER (PARTITION BY text_id) >= {HDD_SAMPLE} THEN
      list_reduce(range(0, {HDD_SAMPLE}), lambda acc, j: acc * (n_text - f - j) / (n_text - j), 1.0::DOUBLE) END AS absent
  FROM (SELECT *, sum(f) OVER (PARTITION BY text_id) AS n_text FROM wf)
),
lagg AS (
  SELECT text_id, dataset, split, CAST(sum(f) AS DOUBLE) AS N, CAST(count(*) AS DOUBLE) AS V,
    CAST(sum(CASE WHEN f = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS V1, CAST(sum(CASE WHEN f = 2 THEN 1 ELSE 0 END) AS DOUBLE) AS V2,
    CAST(sum(f * f) AS DOUBLE) AS S2, CAST(sum(f * (f - 1)) AS DOUBLE) AS S11, sum(f * log2(f)) AS flogf,
    stddev_pop(f) AS sd_f, CAST(sum(length(word) * f) AS DOUBLE) AS chars, sum(1 - absent) AS hdd_sum
  FROM wf2 GROUP BY text_id, dataset, split
)"""


def lexical_sql():
    ent = "(log2(N) - flogf / N)"
    m = {
        "ttr": f"V / {nz('N')}",
        "guiraud_r": f"V / {nz('sqrt(N)')}",
        "herdan_c": f"{ln('V')} / {nz(ln('N'))}",
        "dugast_k": f"{ln('V')} / {nz(ln(ln('N')))}",
        "maas_a2": f"({ln('N')} - {ln('V')}) / {nz(ln('N') + ' * ' + ln('N'))}",
        "dugast_u": f"({ln('N')} * {ln('N')}) / {nz(ln('N') + ' - ' + ln('V'))}",
        "tuldava_ln": f"(1 - V * V) / {nz('V * V * ' + ln('N'))}",
        "brunet_w": "pow(N, pow(V, -0.172))",
        "cttr": f"V / {nz('sqrt(2 * N)')}",
        "summer_s": f"{ln(ln('V'))} / {nz(ln(ln('N')))}",
        "sichel_s": f"V2 / {nz('V')}",
        "michea_m": f"V / {nz('V2')}",
        "honore_h": f"100 * {ln('N')} / {nz('1 - V1 / V')}",
        "entropy": ent,
        "evenness": f"{ent} / {nz('log2(V)')}",
        "jarvis_evenness": "sd_f",
        "yule_k": f"10000.0 * (S2 - N) / {nz('N * N')}",
        "simpson_d": f"S11 / {nz('N * (N - 1)')}",
        "herdan_vm": "sqrt(greatest(S2 / (N * N) - 1 / V, 0.0))",
        "hdd": f"CASE WHEN N >= {HDD_SAMPLE} THEN hdd_sum / {HDD_SAMPLE} END",
        "avg_token_length": f"chars / {nz('N')}",
    }
    cols = ", ".join(f"round(CAST({v} AS DOUBLE), 9) AS {k}" for k, v in m.items())
    return t(f"SELECT text_id, dataset, split, CAST(N AS BIGINT) AS n_tokens, CAST(V AS BIGINT) AS n_types, {cols} "
             "FROM lagg", LEX)


READ = f"""
rd AS (
  SELECT text_id, dataset, split, len(w) AS nw,
    len(list_filter(regexp_split_to_array(text, '[.!?\\n]+'), lambda s: regexp_matches(s, {W}))) AS ns,
    list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(x, {q(VOWELS)})), 1))) AS syl,
    len(list_filter(w, lambda x: length(x) <= 3)) AS mini
  FROM (SELECT *, regexp_extract_all(lower(text), {W}) AS w FROM texts)
),
rd2 AS (
  SELECT text_id, dataset, split,
    round(CASE WHEN nw > 0 AND ns > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * (nw / ns) - 84.6::DOUBLE * (syl / nw) END, 9)
      AS flesch_reading_ease,
    round(CASE WHEN nw > 0 AND ns > 0 THEN (nw + mini) / ns END, 9) AS mcalpine_eflaw
  FROM rd
)"""

DEP = """
sent_nodes AS (
  SELECT text_id, sent_id, count(*) AS n, sum(CASE WHEN head <> 0 THEN 1 ELSE 0 END) AS edges,
         sum(CASE WHEN head <> 0 THEN abs(tok_id - head) ELSE 0 END) AS add_sum
  FROM ann GROUP BY text_id, sent_id
),
depths(text_id, sent_id, tok_id, depth) AS (
  SELECT text_id, sent_id, tok_id, 0 FROM ann WHERE head = 0
  UNION ALL
  SELECT a.text_id, a.sent_id, a.tok_id, d.depth + 1 FROM ann a JOIN depths d
  ON a.text_id = d.text_id AND a.sent_id = d.sent_id AND a.head = d.tok_id
),
sent_depth AS (SELECT text_id, sent_id, max(depth) AS depth, sum(depth) AS dist_sum FROM depths GROUP BY text_id, sent_id),
sent_kids AS (
  SELECT text_id, sent_id, count(*) AS internal, max(c) AS max_outdeg, sum(c) AS outdeg_sum
  FROM (SELECT text_id, sent_id, head, count(*) AS c FROM ann WHERE head <> 0 GROUP BY text_id, sent_id, head)
  GROUP BY text_id, sent_id
),
sent_tree AS (
  SELECT s.text_id, s.sent_id, s.n, d.depth, s.edges, s.add_sum, d.dist_sum,
         s.n - coalesce(k.internal, 0) AS leaves, coalesce(k.max_outdeg, 0) AS max_outdeg, coalesce(k.outdeg_sum, 0) AS outdeg_sum
  FROM sent_nodes s JOIN sent_depth d USING (text_id, sent_id) LEFT JOIN sent_kids k USING (text_id, sent_id)
),
dep AS (
  SELECT text_id,
    round(avg(add_sum / nullif(edges, 0)), 9) AS avg_dependency_distance, CAST(max(depth) AS BIGINT) AS depth,
    CAST(sum(edges) AS BIGINT) AS dependencies_num, CAST(sum(leaves) AS BIGINT) AS leaves,
    round(avg((n - 1) / n), 9) AS dependents_per_word,
    round(avg((n - 1) / nullif(CAST(dist_sum AS DOUBLE), 0.0)), 9) AS closeness_centrality,
    round(avg((max_outdeg * n - outdeg_sum) / nullif(CAST((n - 1) * (n - 1) AS DOUBLE), 0.0)), 9) AS outdegree_centralization
  FROM sent_tree GROUP BY text_id
)"""

RAR = """
rar AS (
  SELECT a.text_id, round(avg(CASE WHEN a.upos <> 'OPEN' THEN NULL WHEN r.form IS NULL THEN 1.0 ELSE 0.0 END), 9) AS rarity,
         CAST(sum(CASE WHEN a.upos = 'OPEN' AND r.form IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS rare_words
  FROM ann a LEFT JOIN ref_words r ON lower(a.form) = r.form GROUP BY a.text_id
),
dens AS (SELECT text_id, round(avg(CASE WHEN upos = 'OPEN' THEN 1.0 ELSE 0.0 END), 9) AS lexical_density
         FROM ann GROUP BY text_id)"""


def rec(sql: str) -> str:
    return "WITH RECURSIVE " + sql[len("WITH RECURSIVE "):]


def summary(src: str, col: str, name: str) -> str:
    return f"""SELECT dataset, round_even(avg(v), 2) AS {name}_mean, min(v) AS {name}_min, max(v) AS {name}_max
FROM (SELECT dataset, CAST({col} AS DOUBLE) AS v FROM {src}) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY dataset"""


SCHEMA_EL = """
s_elements AS (
  SELECT db_id, row_number() OVER (PARTITION BY db_id ORDER BY part, table_idx, idx) - 1 AS element_no, element, kind FROM (
    SELECT db_id, 0 AS part, table_idx, col_idx AS idx, column_name AS element, 'column' AS kind FROM schema_columns
    WHERE table_idx >= 0
    UNION ALL SELECT db_id, 1, table_idx, table_idx, table_name, 'table' FROM schema_tables)
),
s_fks AS (
  SELECT n.db_id, fc.col_idx AS fk_col_idx, pc.col_idx AS pk_col_idx
  FROM schema_fk_names n
  JOIN schema_tables ft ON ft.db_id = n.db_id AND ft.table_name = n.fk_table
  JOIN schema_columns fc ON fc.db_id = n.db_id AND fc.table_idx = ft.table_idx AND fc.column_name = n.fk_column
  JOIN schema_tables pt ON pt.db_id = n.db_id AND pt.table_name = n.pk_table
  JOIN schema_columns pc ON pc.db_id = n.db_id AND pc.table_idx = pt.table_idx AND pc.column_name = n.pk_column
),
s_counts AS (
  SELECT t.db_id, t.tables_num, t.avg_table_rows, t.min_table_rows, t.max_table_rows, t.total_rows, c.columns_num,
         CAST(coalesce(f.n, 0) AS BIGINT) AS foreign_primary_key_relations_num
  FROM (SELECT db_id, count(*) AS tables_num, round(avg(n_rows), 9) AS avg_table_rows, min(n_rows) AS min_table_rows,
               max(n_rows) AS max_table_rows, sum(n_rows) AS total_rows FROM schema_tables GROUP BY db_id) t
  LEFT JOIN (SELECT db_id, count(*) AS columns_num FROM schema_columns WHERE table_idx >= 0 GROUP BY db_id) c USING (db_id)
  LEFT JOIN (SELECT db_id, count(*) AS n FROM s_fks GROUP BY db_id) f USING (db_id)
),
s_expl AS (
  SELECT db_id, round(100.0 * avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 9) AS explainable_schema_elements_percentage
  FROM (SELECT e.db_id, e.element_no, bool_and(d.word IS NOT NULL) AS ok
        FROM (SELECT db_id, element_no, unnest(string_split(lower(element), '_')) AS word FROM s_elements) e
        LEFT JOIN (SELECT DISTINCT lower(word) AS word FROM dict_words) d ON e.word = d.word
        WHERE e.word <> '' GROUP BY e.db_id, e.element_no)
  GROUP BY db_id
),
s_dbrows AS (
  SELECT x.db_id, c.tables_num, c.avg_table_rows, c.min_table_rows, c.max_table_rows, c.total_rows, c.columns_num,
         c.foreign_primary_key_relations_num, n.schema_elements, e.explainable_schema_elements_percentage
  FROM (SELECT DISTINCT db_id FROM datapoints) x
  LEFT JOIN s_counts c USING (db_id)
  LEFT JOIN (SELECT db_id, string_agg(element, ',' ORDER BY element_no) AS schema_elements FROM s_elements GROUP BY db_id) n
    USING (db_id)
  LEFT JOIN s_expl e USING (db_id)
),
s_dataset_dbs AS (SELECT d.dataset, r.* FROM (SELECT DISTINCT dataset, db_id FROM datapoints) d JOIN s_dbrows r USING (db_id))"""


def sch(body: str, *extra: str) -> str:
    return base.with_ctes(base.DATAPOINTS, base.schema_ctes(), SCHEMA_EL, *extra) + "\n" + body


def pct(src: str, col: str, pct_name: str) -> str:
    return f"""SELECT dataset, {col}, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY dataset) AS {pct_name}
FROM (SELECT dataset, {col}, count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY dataset, {col})"""


E = r"'[\p{L}\p{N}]+'"
REFS = f"""
r_q AS (SELECT datapoint_id, db_id, ' ' || array_to_string(regexp_extract_all(lower(replace(question, '_', ' ')), {E}), ' ') || ' ' AS qtext
        FROM datapoints),
r_el AS (SELECT DISTINCT db_id, lower(element) AS element,
                ' ' || array_to_string(regexp_extract_all(lower(replace(element, '_', ' ')), {E}), ' ') || ' ' AS pat FROM s_elements),
r_hits AS (SELECT q.datapoint_id, list_sort(list_distinct(list(e.element))) AS refs
           FROM r_q q JOIN r_el e USING (db_id) WHERE e.pat <> '  ' AND contains(q.qtext, e.pat) GROUP BY q.datapoint_id),
refs AS (
  SELECT d.datapoint_id,
    CAST(CASE WHEN s.db_id IS NOT NULL THEN len(coalesce(h.refs, [])) END AS BIGINT) AS referenced_schema_elements,
    CASE WHEN s.db_id IS NOT NULL THEN coalesce(h.refs, []) END AS referenced
  FROM datapoints d LEFT JOIN r_hits h USING (datapoint_id)
  LEFT JOIN (SELECT DISTINCT db_id FROM s_elements) s USING (db_id)
)"""


def oracles() -> dict:
    o = {
        "text_length_words": t(f"SELECT text_id, dataset, split, CAST(len(regexp_extract_all(text, {W})) AS BIGINT) "
                               "AS length FROM texts"),
        "text_length_chars": t("SELECT text_id, dataset, split, CAST(length(text) AS BIGINT) AS length FROM texts"),
        "text_readability": t("SELECT * FROM rd2", READ),
        "text_lexical_richness": lexical_sql(),
        "text_lexical_density": t("SELECT * FROM dens", ANN, RAR),
        "text_rarity": t("SELECT * FROM rar", ANN, RAR),
        "text_word_frequency": t("""
SELECT a.text_id, round(avg(CASE WHEN a.upos = 'OPEN' THEN CAST(coalesce(r.freq, 0) AS DOUBLE) END), 9) AS words_freq
FROM ann a LEFT JOIN ref_words r ON lower(a.form) = r.form GROUP BY a.text_id""", ANN),
        "text_dependency_metrics": rec(t("SELECT * FROM dep", ANN, DEP)),
        "text_longest_shortest_path": rec(t(
            "SELECT text_id, round(avg(depth), 9) AS longest_shortest_path FROM sent_tree GROUP BY text_id", ANN, DEP)),
        "text_variability": t(f"""
SELECT dataset, round(count(DISTINCT w) / count(*), 9) AS variability
FROM (SELECT dataset, unnest(regexp_extract_all(lower(text), {W})) AS w FROM texts) GROUP BY dataset"""),
        "text_complexity": rec(t("""
SELECT l.text_id, round(l.V / nullif(l.N, 0.0), 9) AS ttr,
       round(CAST((log2(N) - flogf / N) / nullif(log2(V), 0.0) AS DOUBLE), 9) AS evenness,
       dens.lexical_density, rar.rarity, dep.avg_dependency_distance, dep.dependents_per_word
FROM lagg l LEFT JOIN dens USING (text_id) LEFT JOIN rar USING (text_id) LEFT JOIN dep USING (text_id)""",
                                 ANN, RAR, DEP, LEX)),
        "question_length_shares": base.with_ctes(base.DATAPOINTS, f"""
ql AS (SELECT dataset, CAST(len(regexp_extract_all(question, {W})) AS BIGINT) AS length FROM datapoints)""")
        + "\n" + pct("ql", "length", "pct_questions"),
        "question_length_statistics": base.with_ctes(base.DATAPOINTS, f"""
ql AS (SELECT dataset, CAST(len(regexp_extract_all(question, {W})) AS BIGINT) AS length FROM datapoints)""")
        + "\n" + summary("ql", "length", "length"),
        "text_readability_statistics": t(summary("rd2", "flesch_reading_ease", "flesch"), READ),
        "text_rarity_statistics": t(summary("(SELECT r.*, x.dataset FROM rar r JOIN texts x USING (text_id))",
                                            "rarity", "rarity"), ANN, RAR),
        "text_lexical_density_statistics": t(summary("(SELECT r.*, x.dataset FROM dens r JOIN texts x USING (text_id))",
                                                     "lexical_density", "lexical_density"), ANN, RAR),
        "text_dependency_statistics": rec(t(f"""
SELECT * FROM ({summary("dd", "avg_dependency_distance", "add")}) a
JOIN ({summary("dd", "depth", "depth")}) b USING (dataset)
JOIN ({summary("dd", "dependencies_num", "dependencies")}) c USING (dataset)""", ANN, DEP,
                                            "dd AS (SELECT d.*, x.dataset FROM dep d JOIN texts x USING (text_id))")),
        "question_schema_references": sch(
            "SELECT datapoint_id, referenced_schema_elements, array_to_string(referenced, ',') AS referenced FROM refs", REFS),
        "question_schema_reference_pct": base.with_ctes(
            base.DATAPOINTS, base.schema_ctes(), SCHEMA_EL, REFS, base.token_ctes("datapoints"),
            base.parse_error_ctes("datapoints"), """
sqlel AS (SELECT DISTINCT datapoint_id, string_split(lt, '.')[-1] AS element FROM tok WHERE role IN ('table', 'column')),
refel AS (SELECT datapoint_id, unnest(referenced) AS element FROM refs WHERE referenced IS NOT NULL)""")
        + """
SELECT r.datapoint_id,
  round(CASE WHEN r.referenced IS NOT NULL AND e.parse_error IS NULL AND coalesce(n.n_sql, 0) > 0
        THEN 100.0::DOUBLE * coalesce(i.inter, 0) / n.n_sql END, 9) AS referenced_schema_elements_percentage
FROM refs r LEFT JOIN errs e USING (datapoint_id)
LEFT JOIN (SELECT datapoint_id, count(*) AS n_sql FROM sqlel GROUP BY datapoint_id) n USING (datapoint_id)
LEFT JOIN (SELECT s.datapoint_id, count(*) AS inter FROM sqlel s JOIN refel f USING (datapoint_id, element)
           WHERE f.element <> '' GROUP BY s.datapoint_id) i USING (datapoint_id)""",
        "schema_json": sch("""
SELECT t.db_id, CAST(to_json({'db_id': t.db_id, 'table_names': t.names, 'column_names': c.names, 'column_types': c.types,
                              'foreign_keys': coalesce(f.keys, [])}) AS VARCHAR) AS schema_json
FROM (SELECT db_id, list(table_name ORDER BY table_idx) AS names FROM schema_tables GROUP BY db_id) t
LEFT JOIN (SELECT db_id, list([CAST(table_idx AS VARCHAR), column_name] ORDER BY col_idx) AS names, list(column_type ORDER BY col_idx) AS types
           FROM schema_columns GROUP BY db_id) c USING (db_id)
LEFT JOIN (SELECT db_id, list([fk_col_idx, pk_col_idx] ORDER BY fk_col_idx, pk_col_idx) AS keys FROM s_fks GROUP BY db_id) f USING (db_id)"""),
        "schema_foreign_keys": sch("SELECT * FROM s_fks"),
        "schema_columns_per_table": sch("""
SELECT t.db_id, lower(t.table_name) AS table_name, c.columns FROM schema_tables t
LEFT JOIN (SELECT db_id, table_idx, string_agg(lower(column_name), ',' ORDER BY col_idx) AS columns FROM schema_columns
           WHERE table_idx >= 0 GROUP BY db_id, table_idx) c USING (db_id, table_idx)"""),
        "schema_elements": sch("SELECT db_id, CAST(element_no AS INTEGER) AS element_no, element, kind FROM s_elements"),
        "schema_counts": sch("SELECT * FROM s_counts"),
        "schema_explainable": sch("SELECT * FROM s_expl"),
        "database_rows": sch("SELECT * FROM s_dbrows"),
        "databases_by_tables": sch(pct("s_dataset_dbs", "tables_num", "pct_databases")),
        "databases_by_columns": sch(pct("s_dataset_dbs", "columns_num", "pct_databases")),
        "databases_by_fk_relations": sch(pct("s_dataset_dbs", "foreign_primary_key_relations_num", "pct_databases")),
        "databases_by_explainable_pct": sch(pct("s_dataset_dbs", "explainable_schema_elements_percentage",
                                                "pct_databases")),
        "databases_by_total_rows": sch(pct("s_dataset_dbs", "total_rows", "pct_databases")),
        "databases_explainable_statistics": sch(summary("s_dataset_dbs", "explainable_schema_elements_percentage",
                                                        "explainable")),
        "databases_table_rows_statistics": sch(summary("s_dataset_dbs", "avg_table_rows", "avg_table_rows")),
    }
    return o


def report_oracles() -> dict:
    from .catalog import CATEGORY_COUNTS  # noqa: F401

    def summ(src, col, name, by="dataset, split"):
        return f"""(SELECT {by}, round_even(avg(v), 2) AS {name}_mean, min(v) AS {name}_min, max(v) AS {name}_max
  FROM (SELECT {by}, CAST({col} AS DOUBLE) AS v FROM {src}) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY {by})"""

    ops = "CAST(" + " + ".join(f'"{c}"' for c in base.OP_COLS) + " AS BIGINT)"
    roots = "(SELECT * FROM features WHERE current_depth = -1)"
    proots = "(SELECT * FROM features WHERE current_depth = -1 AND parse_error IS NULL)"
    general = base.with_ctes(
        base.DATAPOINTS, base.feature_ctes(), base.schema_ctes(), SCHEMA_EL, REFS, f"""
sqlel AS (SELECT DISTINCT datapoint_id, string_split(lt, '.')[-1] AS element FROM tok WHERE role IN ('table', 'column')),
refel AS (SELECT datapoint_id, unnest(referenced) AS element FROM refs WHERE referenced IS NOT NULL),
rpct AS (
  SELECT r.datapoint_id,
    round(CASE WHEN r.referenced IS NOT NULL AND e.parse_error IS NULL AND coalesce(n.n_sql, 0) > 0
          THEN 100.0::DOUBLE * coalesce(i.inter, 0) / n.n_sql END, 9) AS pct
  FROM refs r LEFT JOIN errs e USING (datapoint_id)
  LEFT JOIN (SELECT datapoint_id, count(*) AS n_sql FROM sqlel GROUP BY datapoint_id) n USING (datapoint_id)
  LEFT JOIN (SELECT s.datapoint_id, count(*) AS inter FROM sqlel s JOIN refel f USING (datapoint_id, element)
             WHERE f.element <> '' GROUP BY s.datapoint_id) i USING (datapoint_id)
),
qlen AS (SELECT d.dataset, d.split, CAST(len(regexp_extract_all(d.question, {W})) AS BIGINT) AS length FROM datapoints d),
rp AS (SELECT d.dataset, d.split, r.pct FROM rpct r JOIN datapoints d USING (datapoint_id))""") + f"""
SELECT * FROM (SELECT DISTINCT dataset, split FROM datapoints) k
LEFT JOIN (SELECT dataset, split, count(DISTINCT sql_query) AS unique_sql_queries FROM {roots} GROUP BY ALL) USING (dataset, split)
LEFT JOIN (SELECT dataset, split, count(DISTINCT question) AS unique_questions FROM datapoints GROUP BY ALL) USING (dataset, split)
LEFT JOIN (SELECT f.dataset, f.split, count(DISTINCT f.sql_query || ' ' || d.question) AS unique_question_sql
           FROM {roots} f JOIN datapoints d USING (datapoint_id) GROUP BY ALL) USING (dataset, split)
LEFT JOIN (SELECT dataset, split, count(DISTINCT structural_category_name || operatorTypes_category_name) AS templates_name
           FROM features GROUP BY ALL) USING (dataset, split)
LEFT JOIN (SELECT dataset, split, count(DISTINCT structural_category_counter || operatorTypes_category_counter)
           AS templates_counter FROM features GROUP BY ALL) USING (dataset, split)
LEFT JOIN (SELECT dataset, split, count(DISTINCT db_id) AS databases FROM datapoints GROUP BY ALL) USING (dataset, split)
LEFT JOIN {summ(roots, "sql_query_depth", "depth")} USING (dataset, split)
LEFT JOIN {summ(proots, ops, "operators")} USING (dataset, split)
LEFT JOIN {summ(roots, "CAST(split_part(operatorTypes_category_counter, '.', 1) AS BIGINT)", "joins")} USING (dataset, split)
LEFT JOIN {summ(roots, "select_columns", "select_columns")} USING (dataset, split)
LEFT JOIN {summ(roots, "where_conditions", "where_conditions")} USING (dataset, split)
LEFT JOIN {summ("qlen", "length", "question_length")} USING (dataset, split)
LEFT JOIN {summ("rp", "pct", "schema_references")} USING (dataset, split)"""
    qlen_shares = f"""
ql AS (SELECT dataset, CAST(len(regexp_extract_all(question, {W})) AS BIGINT) AS length FROM datapoints),
shares AS (SELECT dataset, length, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY dataset) AS pct_questions
           FROM (SELECT dataset, length, count(*) AS n FROM ql WHERE length IS NOT NULL GROUP BY dataset, length)),
rx AS (SELECT dataset, round(CAST(length AS DOUBLE), 2) AS x, pct_questions AS y FROM shares),
edges AS (SELECT count(DISTINCT x) AS n_distinct,
                 quantile_cont(x, [{", ".join(str(i / 10) for i in range(11))}]) AS e FROM rx),
rb AS (SELECT rx.*, edges.*, greatest(len(list_filter(e, lambda v: v < x)), 1) AS idx FROM rx, edges)"""
    from .catalog import CATEGORY_COUNTS as CC
    return {
        "general_info_report": general,
        "question_length_chart_bins": base.with_ctes(base.DATAPOINTS, qlen_shares) + """
SELECT dataset, CASE WHEN n_distinct > 15 THEN e[idx] ELSE x END AS x_lo,
       CASE WHEN n_distinct > 15 THEN e[idx + 1] ELSE x END AS x_hi, sum(y) AS pct_questions
FROM rb GROUP BY ALL""",
        "structural_shares_depth_labels": base.with_ctes(base.DATAPOINTS, base.feature_ctes(),
                                                         CC.format(col="structural_category_name")) + """
SELECT s.*, CASE WHEN (SELECT count(DISTINCT depth) FROM cc) > 1
                 THEN (CASE WHEN depth = -1 THEN 'No depth considered' ELSE 'Subqueries at depth ' || CAST(depth AS VARCHAR) END)
                 ELSE CAST(depth AS VARCHAR) END AS depth_label
FROM (SELECT dataset, category, depth, 100.0::DOUBLE * n / depth_total AS pct_queries FROM cc) s""",
        "structural_category_stack": base.with_ctes(base.DATAPOINTS, base.feature_ctes()) + """
SELECT structural_category_name, dataset, n, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY structural_category_name) AS pct
FROM (SELECT structural_category_name, dataset, count(*) AS n FROM features
      WHERE current_depth = -1 AND structural_category_name IS NOT NULL GROUP BY ALL)""",
    }


def dispersion_sql() -> str:
    return t(f"""
SELECT x.text_id, x.dataset, x.split, d.gini_dispersion, d.evenness_dispersion FROM texts x LEFT JOIN (
  SELECT text_id, round(avg(1 - (2 * kg / (f * N) - (f + 1) / f)), 9) AS gini_dispersion,
         round(avg(ent / log2(f)), 9) AS evenness_dispersion
  FROM (SELECT text_id, word, f, N, sum(k * gap) AS kg, sum(-(gap / N) * log2(gap / N)) AS ent
        FROM (SELECT *, row_number() OVER (PARTITION BY text_id, word ORDER BY gap) AS k FROM (
          SELECT text_id, word, N,
                 coalesce(lead(pos) OVER (PARTITION BY text_id, word ORDER BY pos) - pos,
                          N - pos + min(pos) OVER (PARTITION BY text_id, word)) AS gap,
                 count(*) OVER (PARTITION BY text_id, word) AS f
          FROM (SELECT *, count(*) OVER (PARTITION BY text_id) AS N FROM (
                  SELECT text_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
                  FROM (SELECT text_id, regexp_extract_all(lower(text), {W}) AS w FROM texts))))
          WHERE f >= 2)
        GROUP BY text_id, word, f, N)
  GROUP BY text_id) d USING (text_id)""")


def question_rows_sql() -> str:
    """The questions frame: every part over the questions instead of the texts."""
    pct_sql = oracles()["question_schema_reference_pct"]
    return rec(base.with_ctes(base.DATAPOINTS, """
texts AS (SELECT datapoint_id AS text_id, dataset, split, question AS text FROM datapoints)""", READ, ANN, RAR, DEP, base.schema_ctes(), SCHEMA_EL, REFS) + f"""
SELECT d.datapoint_id, CAST(len(regexp_extract_all(d.question, {W})) AS BIGINT) AS length, r.flesch_reading_ease, r.mcalpine_eflaw,
       s.referenced_schema_elements, array_to_string(s.referenced, ',') AS "references", p.referenced_schema_elements_percentage,
       dens.lexical_density, dep.* EXCLUDE (text_id), l.longest_shortest_path, rar.rarity, rar.rare_words
FROM datapoints d LEFT JOIN rd2 r ON r.text_id = d.datapoint_id LEFT JOIN refs s USING (datapoint_id) LEFT JOIN ({pct_sql}) p USING (datapoint_id)
LEFT JOIN dens ON dens.text_id = d.datapoint_id LEFT JOIN dep ON dep.text_id = d.datapoint_id LEFT JOIN rar ON rar.text_id = d.datapoint_id
LEFT JOIN (SELECT text_id, round(avg(depth), 9) AS longest_shortest_path FROM sent_tree GROUP BY text_id) l ON l.text_id = d.datapoint_id""")
