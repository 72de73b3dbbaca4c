"""Database schema profile (D1-D10) over normalised schema relations.

schema_tables(db_id, table_idx, table_name, n_rows)
schema_columns(db_id, col_idx, table_idx, column_name, column_type)  -- col_idx 0 is (-1, '*')
schema_fk_names(db_id, fk_table, fk_column, pk_table, pk_column)     -- named foreign keys
schema_fks(db_id, fk_col_idx, pk_col_idx)                            -- resolved (D3)

All operators are group-bys keyed by db_id; schemas are small per database, so the
ordered lists below hold one database's elements (bounded by its schema size).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRECISION = 9


def schema_from_json(desc: DataFrame, prefer_original: bool = True):
    """Schema relations from JSON descriptors (one row per database).

    ``desc`` columns: db_id, table_names[, table_names_original], column_names[, column_names_original]
    (arrays of [table_idx, name]), column_types, foreign_keys (arrays of [fk_col, pk_col]).
    The ``*_original`` names win when present and ``prefer_original`` is set.
    """
    def pick(name):
        if prefer_original and f"{name}_original" in desc.columns:
            return F.coalesce(F.col(f"{name}_original"), F.col(name))
        return F.col(name)

    d = desc.select("db_id", pick("table_names").alias("tn"), pick("column_names").alias("cn"),
                    F.col("column_types").alias("ct"), F.col("foreign_keys").alias("fk"))
    tables = d.select("db_id", F.posexplode("tn").alias("table_idx", "table_name")).withColumn(
        "n_rows", F.lit(None).cast("long"))
    cols = d.select("db_id", "ct", F.posexplode("cn").alias("col_idx", "c")).select(
        "db_id", "col_idx", F.col("c")[0].cast("int").alias("table_idx"), F.col("c")[1].alias("column_name"),
        F.col("ct")[F.col("col_idx")].alias("column_type"))
    fks = d.select("db_id", F.explode("fk").alias("k")).select(
        "db_id", F.col("k")[0].cast("int").alias("fk_col_idx"), F.col("k")[1].cast("int").alias("pk_col_idx"))
    return tables, cols, fks


def schema_from_dataframes(spark: SparkSession, db_id: str, tables: dict[str, DataFrame]):
    """Schema relations of a database given as named DataFrames (or catalog tables).

    Columns and types come from each DataFrame's schema (metadata only); row counts are
    one ``count(*)`` aggregate per table, unioned into one relation.
    """
    trows, crows = [], [(db_id, 0, -1, "*", "text")]
    counts = None
    ci = 1
    for ti, (name, df) in enumerate(tables.items()):
        trows.append((db_id, ti, name))
        for f in df.schema.fields:
            crows.append((db_id, ci, ti, f.name, f.dataType.simpleString()))
            ci += 1
        c = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        counts = c if counts is None else counts.unionByName(c)
    st = spark.createDataFrame(trows, "db_id string, table_idx int, table_name string")
    st = st.join(counts, "table_name", "left").select("db_id", "table_idx", "table_name", "n_rows")
    sc = spark.createDataFrame(crows, "db_id string, col_idx int, table_idx int, column_name string, "
                                      "column_type string")
    return st, sc


def schema_from_catalog(spark: SparkSession, db_id: str, database: str | None = None, prefix: str = ""):
    """Schema relations of a database of the session's catalog (of the session's temporary views, where no
    database is given), of the tables whose names begin with ``prefix``; in name order.

    Names, columns and types are metadata. Rows are counted by one union of ``count(*)`` aggregates; a table that can't be
    resolved has no columns and a null count, and where one can't be read the counts are taken table by table, null for it."""
    listed = spark.catalog.listTables(database) if database else [t for t in spark.catalog.listTables() if t.isTemporary]
    trows, crows, frames, ci = [], [(db_id, 0, -1, "*", "text")], {}, 1
    for ti, name in enumerate(sorted(t.name for t in listed if t.name.startswith(prefix))):
        short = name[len(prefix):]
        trows.append((db_id, ti, short))
        try:
            df = spark.table(f"{database}.`{name}`" if database else f"`{name}`")
            fields = df.schema.fields
        except Exception:  # noqa: BLE001 - a view on something that is gone
            continue
        frames[short] = df
        for f in fields:
            crows.append((db_id, ci, ti, f.name, f.dataType.simpleString()))
            ci += 1
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in frames.items()]
    rows = []
    if counts:
        try:
            rows = functools.reduce(DataFrame.unionByName, counts).collect()  # a row per table
        except Exception:  # noqa: BLE001 - a table that can't be read
            for c in counts:
                try:
                    rows += c.collect()
                except Exception:  # noqa: BLE001
                    pass
    known = {r.table_name: r.n_rows for r in rows}
    st = spark.createDataFrame([(*t, known.get(t[2])) for t in trows], "db_id string, table_idx int, table_name string, n_rows long")
    sc = spark.createDataFrame(crows, "db_id string, col_idx int, table_idx int, column_name string, column_type string")
    return st, sc


def resolve_fks(tables: DataFrame, columns: DataFrame, fk_names: DataFrame) -> DataFrame:
    """D3: named foreign keys -> (db_id, fk_col_idx, pk_col_idx); unresolvable ones are dropped."""
    cols = columns.join(tables.select("db_id", "table_idx", "table_name"), ["db_id", "table_idx"])
    fk_side = cols.select("db_id", F.col("table_name").alias("fk_table"), F.col("column_name").alias("fk_column"),
                          F.col("col_idx").alias("fk_col_idx"))
    pk_side = cols.select("db_id", F.col("table_name").alias("pk_table"), F.col("column_name").alias("pk_column"),
                          F.col("col_idx").alias("pk_col_idx"))
    return (fk_names.join(fk_side, ["db_id", "fk_table", "fk_column"])
            .join(pk_side, ["db_id", "pk_table", "pk_column"])
            .select("db_id", "fk_col_idx", "pk_col_idx"))


def columns_per_table(tables: DataFrame, columns: DataFrame, lowercase: bool = False) -> DataFrame:
    """(db_id, table_name, columns) with the table's column names in schema order, comma-joined."""
    name = F.lower("column_name") if lowercase else F.col("column_name")
    c = columns.where(F.col("table_idx") >= 0).select("db_id", "table_idx", "col_idx", name.alias("c"))
    g = c.groupBy("db_id", "table_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "c"))).alias("cs"))
    t = tables.select("db_id", "table_idx", F.lower("table_name") if lowercase else F.col("table_name"))
    return t.join(g, ["db_id", "table_idx"], "left").select(
        "db_id", F.col(t.columns[2]).alias("table_name"),
        F.array_join(F.transform("cs", lambda x: x["c"]), ",").alias("columns"))


def schema_elements(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(db_id, element_no, element, kind): columns table by table in schema order, then tables."""
    c = columns.where(F.col("table_idx") >= 0).select(
        "db_id", F.lit(0).alias("part"), "table_idx", F.col("col_idx").alias("idx"),
        F.col("column_name").alias("element"), F.lit("column").alias("kind"))
    t = tables.select("db_id", F.lit(1).alias("part"), "table_idx", F.col("table_idx").alias("idx"),
                      F.col("table_name").alias("element"), F.lit("table").alias("kind"))
    u = c.unionByName(t)
    w = Window.partitionBy("db_id").orderBy("part", "table_idx", "idx")
    return u.select("db_id", (F.row_number().over(w) - 1).alias("element_no"), "element", "kind")


def schema_counts(tables: DataFrame, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """D6 + D7: tables, columns (without '*'), FK relations, rows per table (avg/min/max) and total."""
    t = tables.groupBy("db_id").agg(
        F.count(F.lit(1)).alias("tables_num"), F.round(F.avg("n_rows"), PRECISION).alias("avg_table_rows"),
        F.min("n_rows").alias("min_table_rows"), F.max("n_rows").alias("max_table_rows"),
        F.sum("n_rows").alias("total_rows"))
    c = columns.where(F.col("table_idx") >= 0).groupBy("db_id").agg(F.count(F.lit(1)).alias("columns_num"))
    f = fks.groupBy("db_id").agg(F.count(F.lit(1)).alias("foreign_primary_key_relations_num"))
    return (t.join(c, "db_id", "left").join(f, "db_id", "left")
            .withColumn("foreign_primary_key_relations_num",
                        F.coalesce("foreign_primary_key_relations_num", F.lit(0)).cast("long")))


def explainable_percentage(elements: DataFrame, dictionary: DataFrame) -> DataFrame:
    """% of schema elements whose every '_'-separated word is a dictionary word.

    ``dictionary`` (word) is a word list (an input table); it is joined by word, not broadcast
    blindly, since dictionaries can be large.
    """
    w = elements.select("db_id", "element_no", F.explode(F.split(F.lower("element"), "_")).alias("word"))
    w = w.where(F.col("word") != "")
    d = dictionary.select(F.lower("word").alias("word"), F.lit(True).alias("known")).distinct()
    j = w.join(d, "word", "left")
    per_el = j.groupBy("db_id", "element_no").agg(F.bool_and(F.col("known").isNotNull()).alias("ok"))
    return per_el.groupBy("db_id").agg(
        F.round(100.0 * F.avg(F.col("ok").cast("double")), PRECISION).alias("explainable_schema_elements_percentage"))


def schema_as_json(tables: DataFrame, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """One JSON document per database (table names, [table_idx, column] pairs, types, FK pairs)."""
    t = tables.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("table_idx", "table_name"))).alias("t"))
    c = columns.groupBy("db_id").agg(F.array_sort(F.collect_list(
        F.struct("col_idx", "table_idx", "column_name", "column_type"))).alias("c"))
    f = fks.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("fk_col_idx", "pk_col_idx"))).alias("f"))
    j = t.join(c, "db_id", "left").join(f, "db_id", "left")
    doc = F.struct(
        F.col("db_id"),
        F.transform("t", lambda x: x["table_name"]).alias("table_names"),
        F.transform("c", lambda x: F.array(x["table_idx"].cast("string"), x["column_name"])).alias("column_names"),
        F.transform("c", lambda x: x["column_type"]).alias("column_types"),
        F.transform(F.coalesce("f", F.array().cast(T.ArrayType(T.StructType([
            T.StructField("fk_col_idx", T.IntegerType()), T.StructField("pk_col_idx", T.IntegerType())])))),
            lambda x: F.array(x["fk_col_idx"], x["pk_col_idx"])).alias("foreign_keys"))
    return j.select("db_id", F.to_json(doc).alias("schema_json"))


def database_rows(db_ids: DataFrame, tables: DataFrame, columns: DataFrame, fks: DataFrame,
                  dictionary: DataFrame) -> DataFrame:
    """One feature row per referenced database; a database without schema gets null features."""
    el = schema_elements(tables, columns)
    names = el.groupBy("db_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("element_no", "element"))), lambda x: x["element"]), ",").alias("schema_elements"))
    feats = schema_counts(tables, columns, fks).join(names, "db_id", "left").join(
        explainable_percentage(el, dictionary), "db_id", "left")
    return db_ids.select("db_id").distinct().join(feats, "db_id", "left")
