"""SQL text features over the token relation (Q3-Q31).

A query's features are counts over its tokens. "Shallow" counts cover one
scope; "deep" counts cover a scope and every scope nested in it. Scopes nest
as position ranges, so the deep tokens of a scope are those whose scope lies in
its range. All of it is computed from the token array within a query's row:
nothing is exchanged, sorted or held beyond one query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import category, let
from . import sqltokens

OP_NAMES = vocab.operator_names()
OP_COLS = [vocab.operator_column(n) for n in OP_NAMES]
CLAUSE_ABBRS = [abbr for _, abbr in vocab.CLAUSES]
TYPE_ABBRS = [abbr for _, abbr, _ in vocab.OPERATOR_TYPES]
STRUCT_ABBRS = CLAUSE_ABBRS + ["SO", "N"]
COUNT_COLS = OP_COLS + CLAUSE_ABBRS + ["SO", "columns", "tables", "values"]


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def _held(values: Column, wanted: str) -> Column:
    return F.size(F.filter(values, lambda v: v == wanted)).cast("long")


def _counts(tokens: Column, body) -> Column:
    """``body`` of the counts by name (``COUNT_COLS``) over bound tokens: operators, clauses, set operators, variables."""
    def known(name):
        return F.filter(F.transform(tokens, lambda t: t[name]), lambda v: v.isNotNull())

    def counts(of):
        out = {c: _held(of["ops"], n) for n, c in zip(OP_NAMES, OP_COLS)}
        out |= {abbr: _held(of["clauses"], name) for name, abbr in vocab.CLAUSES}
        out["SO"] = F.size(F.filter(tokens, lambda t: t["is_setop"])).cast("long")
        out |= {f"{r}s": _held(of["roles"], r) for r in ("column", "table", "value")}
        return body(out)

    return let(F.struct(known("op").alias("ops"), known("clause_kw").alias("clauses"), known("role").alias("roles")), counts)


def _scopes(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: t["scope"])))


def _deepest(tokens: Column) -> Column:
    return F.array_max(F.transform(tokens, lambda t: t["depth"]))


def scope_stats(tokens: DataFrame, key="datapoint_id") -> DataFrame:
    """Shallow counts per (query, scope): operators, clauses, set operators, variables, and the scope's depth (scope = -1 for the root)."""
    def rows(ts):
        return F.transform(_scopes(ts), lambda s: let(F.filter(ts, lambda t: t["scope"] == s), lambda own: _counts(own, lambda counts: F.struct(
            s.alias("scope"), _deepest(own).alias("depth"), *[counts[c].alias(c) for c in COUNT_COLS]))))

    return sqltokens.per_query(tokens, rows, key)


SCOPE_FIELDS = ["scope", "depth", "subquery_no", "N", "sql_query_depth", "sh_SO", "sh_select_items", "sh_where_ops", "sh_W", "sh_groupby_items", "sh_G"]


def deep_rows(tokens: Column, nested: bool = True) -> Column:
    """Array of struct(parse_error, f): deep counts per scope of one query (the scope plus every scope whose opener lies in
    its range [scope, position of its last token]), from its bound tokens.

    f holds ``SCOPE_FIELDS`` and ``COUNT_COLS``: subquery_no counts the subqueries of a depth, N the nested scopes,
    sql_query_depth is the largest relative depth; the shallow SO / select_items / where_ops / W / groupby_items / G
    are ``sh_*``. A query failing Q32 has one row, whose f is null.
    Without ``nested`` there is the whole query's row only (scope -1)."""
    heads = F.filter(tokens, lambda t: t["sub_open"])

    def items(own, clause):
        return F.size(F.filter(own, lambda t: (t["lt"] == ",") & (t["clause"] == clause) & (t["p"] == t["base_p"]) & (t["branch"] == 0))).cast("long") + 1

    def words(own, name):
        return F.size(F.filter(own, lambda t: t["clause_kw"] == name)).cast("long")

    def row(s, scopes, heads):
        def with_own(own):
            hi, depth = F.get(own, F.size(own) - 1)["pos"], _deepest(own)
            fields = {
                "scope": s, "depth": depth, "subquery_no": let(depth, lambda d: F.size(F.filter(heads, lambda h: (h["depth"] == d) & (h["pos"] < s)))),
                "sh_SO": F.size(F.filter(own, lambda t: t["is_setop"])).cast("long"), "sh_select_items": items(own, "select"),
                "sh_where_ops": F.size(F.filter(own, lambda t: (t["clause"] == "where") & t["op"].isin(OP_NAMES))).cast("long"),
                "sh_W": words(own, "where"), "sh_groupby_items": items(own, "groupby"), "sh_G": words(own, "groupby")}

            def with_range(hi):
                def counted(inner):
                    deep = {"N": F.size(F.filter(scopes, lambda d: (d >= s) & (d <= hi))).cast("long") - 1, "sql_query_depth": _deepest(inner) - depth}
                    return _counts(inner, lambda counts: F.struct(*[(fields | deep)[c].alias(c) for c in SCOPE_FIELDS], *[counts[c].alias(c) for c in COUNT_COLS]))

                return let(F.filter(tokens, lambda t: (t["scope"] >= s) & (t["scope"] <= hi)), counted)

            return let(hi, with_range)

        return let(F.filter(tokens, lambda t: t["scope"] == s), with_own)

    shape = "struct<" + ",".join(f"`{c}`:{'int' if c in ('scope', 'subquery_no') else 'bigint'}" for c in SCOPE_FIELDS + COUNT_COLS) + ">"
    whole = let(_scopes(tokens), lambda scopes: let(heads, lambda hs: F.transform(scopes if nested else F.array(F.lit(-1)), lambda s: F.struct(
        F.lit(None).cast("string").alias("parse_error"), row(s, scopes, hs).alias("f")))))
    return let(sqltokens.text_error(tokens), lambda error: F.when(error.isNull(), whole).otherwise(
        F.array(F.struct(error.alias("parse_error"), F.lit(None).cast(shape).alias("f")))))


def type_counts(of=F.col) -> list[Column]:
    """Operator-type counts (J, Ag, C, Lo, Li, Ar, Me, Nu) from the 33 operator columns, which ``of`` gives by name."""
    out = []
    for _, abbr, members in vocab.OPERATOR_TYPES:
        expr = None
        for m in members:
            c = of(vocab.operator_column(m))
            expr = c if expr is None else expr + c
        out.append(expr.alias(abbr))
    return out


def categories(of=F.col) -> dict[str, Column]:
    """Q5 by column name: structural and operator-type category of counts that ``of`` gives by name, null for a rejected query."""
    def types(fmt):
        return category(TYPE_ABBRS, fmt, of)

    out = {
        "structural_category_name": category(STRUCT_ABBRS, "name", of),
        "operatorTypes_category_name": F.coalesce(F.nullif(types("name"), F.lit("")), F.lit("None")),
        "structural_category_counter": category(STRUCT_ABBRS, "counter", of),
        "operatorTypes_category_counter": types("counter")}
    return {name: F.when(of("S").isNotNull(), c) for name, c in out.items()}


def query_categories(tokens: Column, names: list[str]) -> Column:
    """struct(names...): categories of a whole query from its bound tokens, as in its row of the queries frame (current_depth -1)."""
    def of_row(f):
        types = dict(zip(TYPE_ABBRS, type_counts(f.__getitem__), strict=True))
        found = categories(lambda c: types[c] if c in types else f[c])
        return F.struct(*[found[n].alias(n) for n in names])

    return let(F.get(deep_rows(tokens, nested=False), F.lit(0))["f"], of_row)


def feature_rows(datapoints: DataFrame, key: str = "datapoint_id", sql_col: str = "sql_query",
                 carry: tuple[str, ...] = ("dataset", "split", "db_id"), tokens: DataFrame | None = None
                 ) -> DataFrame:
    """Q31: the queries frame, one row per query (current_depth -1) and per (sub)query at depth 0, 1, ...

    A query that fails Q32 keeps only its -1 row with every feature null. Every query is analysed within its own row, whose
    carried columns go along: equal texts never meet and nothing is joined back. Where the caller brings ``tokens``
    these are counted by ``key`` instead.
    """
    keys = _keys(key)
    dp = datapoints.select(*keys, sql_col, *carry)
    if tokens is None:
        array, dp = sqltokens.token_array(sql_col), sqltokens.spread(dp)
    else:
        array = F.coalesce("tokens", F.filter(sqltokens.token_array(F.lit("")), lambda t: F.lit(False)))
        dp = dp.join(sqltokens.gathered(tokens, keys), keys, "left")
    deep = dp.select(*keys, sql_col, *carry, F.explode(let(array, lambda ts: deep_rows(ts))).alias("_r")).select(*keys, sql_col, *carry, "_r.parse_error", "_r.f.*")
    deep = deep.select("*", *type_counts())
    is_set = F.col("sh_SO") > 0

    depth_rows = F.when(F.col("depth").isNull(), F.array(F.lit(-1))) \
        .when(F.col("depth") == 0, F.array(F.lit(-1), F.lit(0))).otherwise(F.array(F.col("depth")))
    rows = deep.select(
        *keys, sql_col, *carry, F.explode(depth_rows).alias("current_depth"), F.coalesce("subquery_no", F.lit(0)).alias("subquery_no"), "parse_error",
        *[c.alias(name) for name, c in categories().items()],
        F.when(~is_set, F.col("sh_select_items")).cast("long").alias("select_columns"),
        F.when(~is_set & (F.col("sh_W") > 0), F.col("sh_where_ops")).cast("long").alias("where_conditions"),
        F.when(~is_set & (F.col("sh_G") > 0), F.col("sh_groupby_items")).cast("long").alias("groupby_columns"),
        F.col("sql_query_depth").cast("long").alias("sql_query_depth"),
        *[F.col(c).cast("long").alias(c) for c in OP_COLS + CLAUSE_ABBRS],
        *[F.col(c).cast("long").alias(c) for c in ("columns", "tables", "values", "SO", "N")],
        *[F.col(c).cast("long").alias(c) for c in TYPE_ABBRS],
    )
    return rows.withColumn(sql_col, F.when(F.col("current_depth") == -1, F.col(sql_col))).select(
        *keys, "current_depth", "subquery_no", sql_col, *carry, "parse_error", *[c for c in rows.columns if c not in [*keys, "current_depth", "subquery_no", sql_col, *carry, "parse_error"]])
