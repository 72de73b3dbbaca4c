"""Lists of a query's parts from the token relation (Q8, Q9, Q18, Q20-Q24, Q30) and SQL text normalisation (Q33).

Every relation has one row per (query, scope) or finer; scope -1 is the whole query's outermost level. Lists of a scope are
shallow (its own tokens). All are generated from the token array within a query's row (``sqltokens.per_query``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import let
from . import match, sqltokens

UNLISTED = "other"


def _lookup(mapping: dict[str, str], c: Column | str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c if isinstance(c, Column) else F.col(c))


def operator_type(c: Column | str, with_names: bool = True) -> Column:
    """Q20: type name (or abbreviation) of an operator name; null for an unknown one."""
    return _lookup({m: name if with_names else abbr for name, abbr, members in vocab.OPERATOR_TYPES for m in members}, c)


def condition_type(c: Column | str, with_names: bool = True) -> Column:
    """Q20: as ``operator_type`` but null for aggregates, which are no conditions."""
    t = operator_type(c, with_names)
    return F.when(operator_type(c) != "aggregate", t)


def _operator_groups(tokens: Column, parts: list[str], conditions: bool) -> Column:
    """Rows of ``parts``, operators and operator_types (and conditions) per distinct ``parts`` of the tokens with an operator."""
    place = lambda t: F.struct(*[t[c].alias(c) for c in parts])

    def rows(ops):
        def row(g):
            names = F.transform(F.filter(ops, lambda t: place(t).eqNullSafe(g)), lambda t: t["op"])
            return let(names, lambda n: F.struct(
                *[g[c].alias(c) for c in parts], n.alias("operators"), F.transform(n, lambda o: operator_type(o)).alias("operator_types"),
                *[F.filter(F.transform(n, lambda o: condition_type(o)), lambda c: c.isNotNull()).alias("conditions")] * conditions))

        return F.transform(F.array_distinct(F.transform(ops, place)), row)

    return let(F.filter(tokens, lambda t: t["op"].isin(vocab.operator_names())), rows)


def operator_lists(tokens: DataFrame, key="datapoint_id") -> DataFrame:
    """Q8 + Q9: (key, scope, depth, clause, operators, operator_types, conditions) per scope and clause with an operator, in
    text order; operators outside the fixed 33 (``right join`` and so on) are left out."""
    return sqltokens.per_query(tokens, lambda ts: _operator_groups(ts, ["scope", "depth", "clause"], True), key)


def deep_operator_lists(tokens: DataFrame, key="datapoint_id") -> DataFrame:
    """Q8 + Q9, deep: (key, clause, operators, operator_types) over a whole query, nested scopes included."""
    return sqltokens.per_query(tokens, lambda ts: _operator_groups(ts, ["clause"], False), key)


def variable_rows(tokens: DataFrame, key="datapoint_id") -> DataFrame:
    """Q21-Q24: (key, scope, depth, clause, pos, role, name, complete_name, alias_of) per table, column, value and alias.

    ``name`` is a column without its qualifier, a value without its quotes; ``complete_name`` carries the real
    table of a column (aliases resolved, a lone FROM table filled in); ``alias_of`` is the table behind a table
    alias, null for the alias of a subquery or expression.
    """
    def rows(ts):
        def row(t, complete):
            name = F.when(t["role"] == "column", F.substring_index(t["lt"], ".", -1)) \
                .when((t["role"] == "value") & (t["kind"] == "str"), t["lt"].substr(F.lit(2), F.length(t["lt"]) - 2)).otherwise(t["lt"])
            return F.when(t["role"].isNotNull() & (t["role"] != "function"), F.struct(
                *[t[c].alias(c) for c in ("scope", "depth", "clause", "pos", "role")], name.alias("name"),
                F.when(t["role"] == "column", complete).when(t["role"] == "table", t["lt"]).alias("complete_name"), t["alias_of"].alias("alias_of")))

        return let(match.complete_names(ts), lambda ns: F.filter(F.transform(ts, lambda t, i: row(t, F.get(ns, i))), lambda r: r.isNotNull()))

    return sqltokens.per_query(tokens, rows, key)


def query_flags(tokens: DataFrame, key="datapoint_id") -> DataFrame:
    """Q18 + Q30 per (key, scope): select_distinct, aggregate_distinct, union_all, has_unlisted_function flags, ORDER BY
    directions (one per item, ``asc`` by default), GROUP BY columns and has_limit."""
    def rows(ts):
        places = F.array_distinct(F.transform(ts, lambda t: F.struct(t["scope"].alias("scope"), t["depth"].alias("depth"))))

        def row(g, own):
            any_ = lambda c: F.exists(own, lambda t: F.coalesce(c(t), F.lit(False)))
            items = F.filter(own, lambda t: (t["clause"] == "orderby") & (t["p"] == t["base_p"]) & ~t["lt"].isin("order", "by", ","))
            items = F.array_sort(F.transform(items, lambda t: F.struct(t["branch"].alias("branch"), t["ob_item"].alias("ob_item"), t["pos"].alias("pos"), (t["lt"] == "desc").alias("is_desc"))))
            numbers = lambda xs: F.array_distinct(F.transform(xs, lambda x: F.struct(x["branch"].alias("b"), x["ob_item"].alias("i"))))
            directions = let(items, lambda xs: F.transform(numbers(xs), lambda n: F.when(
                F.exists(xs, lambda x: (x["branch"] == n["b"]) & (x["ob_item"] == n["i"]) & x["is_desc"]), "desc").otherwise("asc")))
            return F.struct(
                g["scope"].alias("scope"), g["depth"].alias("depth"),
                any_(lambda t: (t["lt"] == "distinct") & (t["prev1"] == "select")).alias("select_distinct"),
                any_(lambda t: (t["lt"] == "distinct") & (t["prev1"] == "(") & t["prev2"].isin(vocab.AGGREGATE_NAMES)).alias("aggregate_distinct"),
                any_(lambda t: t["is_setop"] & (t["lt"] == "union") & (t["next1"] == "all")).alias("union_all"),
                any_(lambda t: t["role"] == "function").alias("has_unlisted_function"),
                any_(lambda t: t["clause_kw"] == "limit").alias("has_limit"),
                F.transform(F.filter(own, lambda t: (t["role"] == "column") & (t["clause"] == "groupby")), lambda t: t["lt"]).alias("groupby_columns"),
                directions.alias("orderby_directions"))

        return F.transform(places, lambda g: let(F.filter(ts, lambda t: (t["scope"] == g["scope"]) & (t["depth"] == g["depth"])), lambda own: row(g, own)))

    return sqltokens.per_query(tokens, rows, key)


def normalized_sql(tokens: DataFrame, key="datapoint_id") -> DataFrame:
    """Q33: (key, sql) rebuilt from the tokens, joined by one space: a comma in FROM and INNER JOIN become JOIN, ``<>`` becomes
    ``!=``, backquotes become double quotes, parentheses around a whole WHERE condition go (one pair)."""
    same = lambda t, o: (t["scope"] == o["scope"]) & (t["branch"] == o["branch"])
    none = F.array().cast("array<int>")

    def rows(ts):
        # the parenthesis that opens right after WHERE (the last of its scope and branch), and the first return to the base level after it
        def opens(t, i):
            before = F.get(ts, i - 1)
            return F.when((t["lt"] == "(") & (before["clause_kw"] == "where") & same(t, before) & ~t["sub_open"], t)

        def outer(o):
            own = F.filter(ts, lambda t: same(t, o) & (t["pos"] > o["pos"]))
            last = F.array_max(F.transform(F.filter(ts, lambda t: same(t, o) & (t["clause"] == "where")), lambda t: t["pos"]))
            close = F.get(F.filter(own, lambda t: (t["lt"] == ")") & (t["p"] == t["base_p"])), F.lit(0))["pos"]
            return let(close, lambda c: F.when(c == last, F.array(o["pos"], c)).otherwise(none))

        def text(t):
            return (F.when((t["lt"] == ",") & (t["op"] == "join"), "join").when(t["lt"] == "<>", "!=")
                    .when(t["kind"] == "ident", F.regexp_replace(t["tok"], "`", '"')).otherwise(t["tok"]))

        def joined(gone):
            inner = lambda t: F.coalesce((t["lt"] == "inner") & (t["next1"] == "join"), F.lit(False))
            kept = F.filter(ts, lambda t: ~F.array_contains(gone, t["pos"]) & ~inner(t))
            return F.when(F.size(ts) > 0, F.array(F.struct(F.array_join(F.transform(kept, text), " ").alias("sql"))))

        found = F.filter(F.transform(ts, opens), lambda o: o.isNotNull())
        gone = let(found, lambda xs: F.flatten(F.transform(F.filter(xs, lambda o: ~F.exists(xs, lambda x: same(x, o) & (x["pos"] > o["pos"]))), outer)))
        return let(gone, joined)

    return sqltokens.per_query(tokens, rows, key)


def structural_components(features: DataFrame, with_names: bool = False) -> DataFrame:
    """Q4: the queries frame's rows with ``components``: every clause, set operator and nesting as often as it occurs, in
    category order, as abbreviations or names; null for a rejected query."""
    names = [*vocab.CLAUSES, vocab.SET_OPERATOR, vocab.NESTING]
    lists = [F.array_repeat(F.lit(name if with_names else abbr), F.col(abbr).cast("int")) for name, abbr in names]
    keys = [c for c in ("datapoint_id", "current_depth", "subquery_no") if c in features.columns]
    return features.select(*keys, F.when(F.col("parse_error").isNull(), F.concat(*lists)).alias("components"))


def column_equivalences(tokens: DataFrame, key="datapoint_id") -> DataFrame:
    """Q27: (key, scope, column, equals) per column of a ``column = column`` condition: ``equals`` are the other members of its
    connected class within the scope (chains included), sorted; names carry their real tables."""
    def rows(ts):
        def pair(ns):
            def side(t, i, d):
                o = F.get(ts, i + d)
                return F.when((o["scope"] == t["scope"]) & (o["role"] == "column"), F.get(ns, i + d))

            both = F.transform(ts, lambda t, i: F.when(t["op"] == "eq", F.struct(t["scope"].alias("scope"), side(t, i, -1).alias("l"), side(t, i, 1).alias("r"))))
            return F.filter(both, lambda x: x["l"].isNotNull() & x["r"].isNotNull())

        def classes(pairs):
            def of_scope(s):
                own = F.transform(F.filter(pairs, lambda x: x["scope"] == s), lambda x: F.array(x["l"], x["r"]))
                return F.flatten(F.transform(match.connected_classes(own), lambda members: F.transform(members, lambda c: F.struct(
                    s.alias("scope"), c.alias("column"), F.array_sort(F.filter(members, lambda m: m != c)).alias("equals")))))

            return F.flatten(F.transform(F.array_distinct(F.transform(pairs, lambda x: x["scope"])), of_scope))

        return let(let(match.complete_names(ts), pair), classes)

    return sqltokens.per_query(tokens, rows, key)
