"""Dataset statistics over the queries, databases and questions frames.

Every statistic is a grouped aggregate keyed by ``by`` (default: the
``dataset`` column), so one job answers it for every dataset of the corpus at
once. Percentages divide a per-value count by a per-group total taken from a
window over the already-aggregated (tiny) distribution, never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import bround2
from ..session import materialize
from .sqlfeatures import OP_COLS, TYPE_ABBRS

BY = ("dataset",)


def _by(by):
    return [by] if isinstance(by, str) else list(by)


def roots(features: DataFrame) -> DataFrame:
    """Rows of whole queries (current_depth = -1)."""
    return features.where(F.col("current_depth") == -1)


def parsed_roots(features: DataFrame) -> DataFrame:
    return roots(features).where(F.col("parse_error").isNull())


def operators_total(unique: bool = False) -> Column:
    """Row sum of the 33 operator counts, or the number of distinct operators present."""
    cols = [F.when(F.col(c) > 0, 1).otherwise(0) if unique else F.col(c) for c in OP_COLS]
    expr = cols[0]
    for c in cols[1:]:
        expr = expr + c
    return expr.cast("long")


def operator_types_present() -> Column:
    expr = None
    for a in TYPE_ABBRS:
        c = F.when(F.col(a) > 0, 1).otherwise(0)
        expr = c if expr is None else expr + c
    return expr.cast("long")


def _per_query(features: DataFrame, value: Column, name: str, by) -> DataFrame:
    """(by..., name): ``value`` of every parsed whole query. A generator makes it, since a filter on it must not be moved below the
    columns it is made of: the optimizer writes such a condition anew for every choice of columns and what they stand for,
    2^33 conditions for a sum of 33."""
    return parsed_roots(features).select(*_by(by), F.explode(F.array(value)).alias(name))


# --- A1-A4, A11: distinct counts ---------------------------------------------------------------

def unique_sql_queries_num(features: DataFrame, by=BY) -> DataFrame:
    """A1."""
    return roots(features).groupBy(*_by(by)).agg(F.countDistinct("sql_query").alias("unique_sql_queries"))


def unique_questions_num(datapoints: DataFrame, by=BY) -> DataFrame:
    """A2."""
    return datapoints.groupBy(*_by(by)).agg(F.countDistinct("question").alias("unique_questions"))


def templates_num(features: DataFrame, template_type: str = "name", by=BY) -> DataFrame:
    """A3: distinct (structural, operator-type) category pairs over all depth rows."""
    t = F.concat(F.col(f"structural_category_{template_type}"), F.col(f"operatorTypes_category_{template_type}"))
    return features.groupBy(*_by(by)).agg(F.countDistinct(t).alias(f"templates_{template_type}"))


def unique_question_sql_queries_num(features: DataFrame, datapoints: DataFrame, key: str = "datapoint_id",
                                    by=BY) -> DataFrame:
    """A4: distinct 'sql question' strings (inner join of questions and whole-query rows)."""
    q = datapoints.select(key, "question")
    s = roots(features).select(key, *_by(by), "sql_query")
    j = s.join(q, key)
    return j.groupBy(*_by(by)).agg(
        F.countDistinct(F.concat(F.col("sql_query"), F.lit(" "), F.col("question"))).alias("unique_question_sql"))


def databases_num(datapoints: DataFrame, by=BY) -> DataFrame:
    """Distinct databases referenced by the datapoints."""
    return datapoints.groupBy(*_by(by)).agg(F.countDistinct("db_id").alias("databases"))


# --- A24: summary statistics -------------------------------------------------------------------

def summary(df: DataFrame, value: Column | str, by=BY, extended: bool = False,
            name: str = "value") -> DataFrame:
    """(mean to 2 places, min, max) or the box-plot record, nulls dropped.

    The box-plot record is mean, median, q1, q3, iqr, whislo, whishi (furthest values
    within 1.5 IQR), cilo/cihi (notch: median -/+ 1.57 IQR / sqrt(n)), the number of
    fliers and every flier value with its count. Quantiles are exact with linear interpolation; rows are
    counted per value before anything else, and ranks are looked up range by range (``exact_quantiles``), so neither a dataset's
    rows nor its distinct values meet in one task; only its fliers do, which are the report.
    """
    v = value if isinstance(value, Column) else F.col(value)
    keys = _by(by)
    d = df.select(*keys, v.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    if not extended:
        return d.groupBy(*keys).agg(bround2(F.avg("v")).alias(f"{name}_mean"), F.min("v").alias(f"{name}_min"),
                                    F.max("v").alias(f"{name}_max"))
    # everything from the counts of distinct values: quantiles by selection over value ranges, fliers with their counts
    g = d.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    g = materialize(g)  # read many times below: what it is computed from must not run as often
    base = g.groupBy(*keys).agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.sum("c").alias("total"))
    base = base.join(exact_quantiles(g, {"q1": 0.25, "med": 0.5, "q3": 0.75}, keys), keys).withColumn("iqr", F.col("q3") - F.col("q1"))
    j = g.select(*keys, "v", "c").join(base, keys)
    lo = F.col("q1") - 1.5 * F.col("iqr")
    hi = F.col("q3") + 1.5 * F.col("iqr")
    flier = (F.col("v") < lo) | (F.col("v") > hi)
    out = j.groupBy(*keys, "mean", F.col("total").alias("n"), "q1", "med", "q3", "iqr").agg(
        F.min(F.when(F.col("v") >= lo, F.col("v"))).alias("whislo"),
        F.max(F.when(F.col("v") <= hi, F.col("v"))).alias("whishi"),
        F.sum(F.when(flier, F.col("c")).otherwise(0)).alias("n_fliers"),
        F.array_sort(F.collect_list(F.when(flier, F.struct(F.col("v").alias("value"), F.col("c").alias("times"))))).alias("fliers"),
    )
    notch = 1.57 * F.col("iqr") / F.sqrt("n")
    return out.select(*keys, "mean", "med", "q1", "q3", "iqr", "whislo", "whishi",
                      (F.col("med") - notch).alias("cilo"), (F.col("med") + notch).alias("cihi"),
                      "n_fliers", "fliers")


def _ordered_bits(v: Column) -> Column:
    """A 64-bit integer that grows with a double: its bits, negative numbers mirrored."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(bits)


RADIX_BITS = 16


def values_at(counts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, v): the value of every wanted 0-based rank among ``counts`` (keys, v double, c times).

    Radix selection: values are counted by the upper 16 bits of their order, the range that holds a rank is kept, and
    only its values are counted by the next 16 bits, four times in all. A key has at most 65,536 ranges in a window; counts are
    pre-aggregated before every exchange, and exact."""
    bits = counts.select(*keys, "v", "c", _ordered_bits(F.col("v")).alias("_bits"))
    state = wanted.select(*keys, "rank", F.lit(0).cast("long").alias("_range"), F.lit(0).cast("long").alias("_below"))
    for shift in range(64 - RADIX_BITS, -1, -RADIX_BITS):
        part = F.shiftright("_bits", shift)
        above = F.lit(0).cast("long") if shift == 64 - RADIX_BITS else F.shiftright("_bits", shift + RADIX_BITS)
        held = bits.withColumn("_range", above).join(state.select(*keys, "_range").distinct(), [*keys, "_range"])
        sizes = held.groupBy(*keys, "_range", part.alias("_next")).agg(F.sum("c").alias("_n"), F.min("v").alias("v"))
        upto = F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_next"))
        sizes = sizes.withColumn("_lo", upto - F.col("_n")).withColumn("_hi", upto)
        found = state.join(sizes, [*keys, "_range"]).where((F.col("rank") - F.col("_below") >= F.col("_lo")) & (F.col("rank") - F.col("_below") < F.col("_hi")))
        state = found.select(*keys, "rank", F.col("_next").alias("_range"), (F.col("_below") + F.col("_lo")).alias("_below"), "v")
        if shift:
            state = state.drop("v")
    return state.select(*keys, "rank", "v")


def exact_quantiles(counts: DataFrame, probabilities: dict[str, float], keys: list[str]) -> DataFrame:
    """(keys, one column per name): quantiles with linear interpolation among ``counts`` (keys, v, c times)."""
    n = counts.groupBy(*keys).agg(F.sum("c").alias("_total"))
    at = {name: (F.col("_total") - 1) * F.lit(p) for name, p in probabilities.items()}
    places = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), x.alias("at")) for name, x in at.items()]))
    places = n.select(*keys, places.alias("q")).select(*keys, "q.*").withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    values = values_at(counts, places.select(*keys, "rank").distinct(), keys)
    low, high = F.min("v"), F.max("v")
    each = places.join(values, [*keys, "rank"]).groupBy(*keys, "name").agg((low + (high - low) * (F.max("at") - F.floor(F.max("at")))).alias("v"))
    pick = [F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in probabilities]
    return each.groupBy(*keys).agg(*pick)


def depth_statistics(features: DataFrame, by=BY) -> DataFrame:
    """A5."""
    return summary(roots(features), "sql_query_depth", by, name="depth")


def operators_statistics(features: DataFrame, by=BY, extended: bool = False) -> DataFrame:
    """Statistics of the total operator count per parsed query."""
    return summary(_per_query(features, operators_total(), "operators", by), "operators", by, extended, name="operators")


def values_statistics(features: DataFrame, by=BY, extended: bool = False) -> DataFrame:
    """A7."""
    return summary(roots(features), "values", by, extended, name="values")


def joins_statistics(features: DataFrame, by=BY) -> DataFrame:
    """First field of the operator-type counter (joins)."""
    j = F.split(F.col("operatorTypes_category_counter"), r"\.")[0].cast("long")
    return summary(roots(features), j, by, name="joins")


def select_columns_statistics(features: DataFrame, by=BY) -> DataFrame:
    """A9."""
    return summary(roots(features), "select_columns", by, name="select_columns")


def where_conditions_statistics(features: DataFrame, by=BY) -> DataFrame:
    """A10."""
    return summary(roots(features), "where_conditions", by, name="where_conditions")


def tables_num_statistics(features: DataFrame, by=BY, extended: bool = False, distinct_values: bool = False
                          ) -> DataFrame:
    """A19.1: per-query table-count statistics (``distinct_values`` reproduces the variant over distinct counts)."""
    return _variable_statistics(features, "tables", by, extended, distinct_values)


def columns_num_statistics(features: DataFrame, by=BY, extended: bool = False, distinct_values: bool = False
                           ) -> DataFrame:
    """A19.2."""
    return _variable_statistics(features, "columns", by, extended, distinct_values)


def _variable_statistics(features, variable, by, extended, distinct_values):
    r = roots(features).select(*_by(by), variable)
    if distinct_values:
        r = r.distinct()
    return summary(r, variable, by, extended, name=variable)


# --- A20: percentage distribution of an attribute ---------------------------------------------

def attr_percentages(df: DataFrame, attr: Column | str, by=BY, name: str | None = None,
                     pct_name: str = "pct") -> DataFrame:
    """Share (%) of each non-null value of ``attr`` within each group."""
    keys = _by(by)
    a = attr if isinstance(attr, Column) else F.col(attr)
    name = name or (attr if isinstance(attr, str) else "value")
    counts = df.select(*keys, a.alias(name)).where(F.col(name).isNotNull()).groupBy(*keys, name).agg(
        F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.select(*keys, name, (100.0 * F.col("n") / total).alias(pct_name))


# --- A12-A15: category shares per depth and top-k ---------------------------------------------

def _category_counts(features: DataFrame, category_col: str, by, max_depth: int | None) -> DataFrame:
    """(by..., category, depth, n, depth_total) over the full category x depth grid of each group.

    The rows of ``features`` are read once: what follows works on the counts alone. The depths of a group (a few)
    travel beside every category, which is spread over them.
    """
    keys = _by(by)
    rows = features.where(F.col(category_col).isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    if max_depth is not None:
        rows = rows.where(F.col("current_depth") <= max_depth)
    counts = rows.groupBy(*keys, "current_depth", category_col).agg(F.count(F.lit(1)).alias("n"))
    depth_total = F.sum("n").over(Window.partitionBy(*keys, "current_depth"))
    counts = counts.withColumn("depth_total", depth_total)
    depths = F.collect_set(F.struct("current_depth", "depth_total")).over(Window.partitionBy(*keys))
    counts = counts.withColumn("depths", depths)
    cats = counts.groupBy(*keys, category_col).agg(F.map_from_entries(F.collect_list(F.struct("current_depth", "n"))).alias("at"), F.first("depths").alias("depths"))
    grid = cats.select(*keys, category_col, "at", F.explode("depths").alias("d"))
    return grid.select(*keys, F.col(category_col).alias("category"), F.col("d.current_depth").alias("depth"),
                       F.coalesce(F.try_element_at("at", F.col("d.current_depth")), F.lit(0)).cast("long").alias("n"), F.col("d.depth_total").alias("depth_total"))


def categories_per_depth(features: DataFrame, category_col: str, by=BY, max_depth: int | None = None
                         ) -> DataFrame:
    """Share (%) of every category at every depth, zeros kept."""
    keys = _by(by)
    c = _category_counts(features, category_col, by, max_depth)
    return c.select(*keys, "category", "depth", (100.0 * F.col("n") / F.col("depth_total")).alias("pct_queries"))


def most_common_categories(features: DataFrame, category_col: str, k: int, by=BY, key: str = "datapoint_id"
                           ) -> tuple[DataFrame, DataFrame]:
    """Top-k categories of whole queries plus 'Other' (100 - their share).

    Returns (table, other_members): the share table at depth -1 and the datapoint ids
    of queries outside the top k (anti join on the id, never collected). Ties at the
    k-th place are broken by category name. 'Other' is computed from counts,
    100 * (total - top counts) / total, which equals 100 minus the top shares.
    """
    keys = _by(by)
    c = _category_counts(features, category_col, by, None).where(F.col("depth") == -1)
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("category"))
    top = c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # the last of the top rows brings 'Other' with it
    whole = Window.partitionBy(*keys)
    top = top.withColumn("_top", F.sum("n").over(whole)).withColumn("_last", F.max("rank").over(whole))
    entry = lambda name, n: F.struct(name.alias("category"), n.alias("n"))
    rows = F.when(F.col("rank") == F.col("_last"), F.array(entry(F.col("category"), F.col("n")), entry(F.lit("Other"), F.col("depth_total") - F.col("_top")))) \
        .otherwise(F.array(entry(F.col("category"), F.col("n"))))
    table = top.select(*keys, "depth", "depth_total", F.explode(rows).alias("e")).select(
        *keys, "e.category", "depth", (100.0 * F.col("e.n") / F.col("depth_total")).alias("pct_queries"))
    r = roots(features).where(F.col(category_col).isNotNull())
    top_keys = top.select(*keys, F.col("category").alias(category_col))
    members = r.join(top_keys, keys + [category_col], "left_anti").select(*keys, key)
    return table, members


def structural_categories(features: DataFrame, k: int | None = None, by=BY, max_depth: int | None = None,
                          grouped: bool = True) -> DataFrame:
    """Structural category shares (grouped) or the raw (category, depth) rows."""
    return _category_table(features, "structural_category_name", k, by, max_depth, grouped)


def operator_type_categories(features: DataFrame, k: int | None = None, by=BY, max_depth: int | None = None,
                             grouped: bool = True) -> DataFrame:
    """A15."""
    return _category_table(features, "operatorTypes_category_name", k, by, max_depth, grouped)


def _category_table(features, col, k, by, max_depth, grouped):
    if not grouped:
        rows = features if max_depth is None else features.where(F.col("current_depth") <= max_depth)
        return rows.select(*_by(by), F.col(col).alias("category"), F.col("current_depth").alias("depth"))
    if k is None:
        return categories_per_depth(features, col, by, max_depth)
    return most_common_categories(features, col, k, by)[0]


# --- A16-A18: distributions of per-query counts ------------------------------------------------

def operators_num(features: DataFrame, unique: bool = False, grouped: bool = True, by=BY) -> DataFrame:
    """Distribution of the (distinct) operator count per whole query."""
    name = "unique_operators" if unique else "operators"
    r = _per_query(features, operators_total(unique), name, by)
    if not grouped:
        return r.withColumn("depth", F.lit(-1))
    return attr_percentages(r, name, by, pct_name="pct_queries").withColumn("depth", F.lit(-1))


def operator_types_num(features: DataFrame, by=BY) -> DataFrame:
    """Distribution of the number of operator types present per whole query."""
    r = _per_query(features, operator_types_present(), "operator_types", by)
    return attr_percentages(r, "operator_types", by, pct_name="pct_queries").withColumn("depth", F.lit(-1))


def variable_type_num(features: DataFrame, variable_type: str, grouped: bool = True, by=BY) -> DataFrame:
    """Distribution of tables / columns / values per whole query."""
    if variable_type not in ("tables", "columns", "values"):
        raise ValueError(f"{variable_type} is not a valid variable type")
    r = roots(features).select(*_by(by), variable_type).where(F.col(variable_type).isNotNull())
    if not grouped:
        return r.withColumn("depth", F.lit(-1))
    return attr_percentages(r, variable_type, by, pct_name="pct_queries").withColumn("depth", F.lit(-1))


# --- A25: variety -----------------------------------------------------------------------------

def variety(features: DataFrame, category_col: str = "structural_category_name", by=BY) -> DataFrame:
    """Sum over categories of p(1-p), p the share of whole queries in the category.

    Computed exactly as sum(n (N - n)) / N^2 from integer counts.
    """
    keys = _by(by)
    c = _category_counts(features, category_col, by, None).where(F.col("depth") == -1)
    num = F.sum(F.col("n") * (F.col("depth_total") - F.col("n")))
    tot = F.first("depth_total")
    return c.groupBy(*keys).agg((num.cast("double") / (tot * tot).cast("double")).alias("variety"))


def structural_variety(features: DataFrame, by=BY) -> DataFrame:
    return variety(features, "structural_category_name", by).withColumnRenamed("variety", "structural_variety")


def operator_variety(features: DataFrame, by=BY) -> DataFrame:
    return variety(features, "operatorTypes_category_name", by).withColumnRenamed("variety", "operator_variety")
