"""Partial and exact match of predicted SQL against gold SQL.

Both sides go through the same token relation. Each (sub)query becomes a set of
*elements* per family:

* SM (structural): clause names (``orderby`` carries its directions, e.g.
  ``orderby_asc_desc``), the set-operator keyword, ``nesting`` per nested query;
  branch b >= 1 of a set operation suffixes its elements with ``_b``.
* OM (operators): ``{op}_{clause}_{k}``, k the occurrence of (op, clause) in the
  subquery; the clause of every operator of a set operation is ``set_operator``.
* VM (variables): ``columns/{name}/{k}``, ``tables/{name}/{k}``, ``values/{v}/{k}``.
  Columns carry their real table (aliases resolved in the scope, a lone FROM table
  filled in). The column = column conditions of both sides of an aligned pair, taken
  together, put columns into classes; on either side a repeated column (k >= 1) is
  replaced by the smallest member of its class.
* EM (exact match only): per clause, columns with the aggregate around them (and their
  position in ORDER BY), and conditions as (operator, column before it, column after it
  or ``value``, ``or`` if an OR comes before), each with its occurrence number.

The i-th subquery at each depth of the gold query is aligned with the i-th of the
prediction (a missing one meets the empty set); per aligned pair the Jaccard of
the element sets is taken per family and per component (both empty -> 1); a
family's score is the mean over depths of the mean over aligned pairs.

The texts of a datapoint's gold and predictions meet in one row; tokens and elements are computed from them within that
row by higher-order functions, so nothing but the texts is shuffled or sorted. A datapoint's own SQL strings bound every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import let, safe_div
from . import sqltokens

GOLD = "__gold__"
SM_COMPONENTS = [c for c, _ in vocab.CLAUSES] + ["set_operator"]
OM_COMPONENTS = vocab.operator_names()
VM_COMPONENTS = ["columns", "tables", "values"]
FAMILIES = {"SM": SM_COMPONENTS, "OM": OM_COMPONENTS, "VM": VM_COMPONENTS}
JOIN_OPS = vocab.OPERATOR_TYPES[0][2]
AGGREGATES = vocab.AGGREGATE_NAMES
CONDITIONS = [op for i in (2, 4, 6) for op in vocab.OPERATOR_TYPES[i][2]]
PRECISION = 9  # reported scores are rounded to 9 decimals


def sql_sides(gold: DataFrame, predictions: DataFrame, key: str = "datapoint_id", gold_col: str = "sql_query",
              pred_col: str = "predicted") -> DataFrame:
    """(key, model, sql) for gold (model = __gold__) and every prediction, partitioned by key (``sqltokens.tasks``)."""
    g = gold.select(key, F.lit(GOLD).alias("model"), F.col(gold_col).alias("sql"))
    p = predictions.select(key, "model", F.col(pred_col).alias("sql"))
    return g.unionByName(p).repartition(sqltokens.tasks(gold), key)


def _last(values: Column) -> Column:
    return let(values, lambda xs: F.get(xs, F.size(xs) - 1))


def _occurrences(names: Column, sep: str) -> Column:
    """struct(component, element) of every struct(component, name): the name with its occurrence number from 0 on."""
    return let(F.array_sort(names), lambda xs: F.transform(xs, lambda x, i: F.struct(
        x["component"].alias("component"), F.concat_ws(sep, x["name"], (i + 1 - F.array_position(xs, x)).cast("string")).alias("element"))))


def _marked(tokens: Column) -> Column:
    """Bound tokens as struct(t, column, agg): the complete name of a column, the aggregate right around the token."""
    def aggregate(t, i):
        op = lambda d: F.get(tokens, i - d)["op"]
        return F.when((t["prev1"] == "(") & op(2).isin(AGGREGATES), op(2)) \
                .when((t["prev1"] == "distinct") & (t["prev2"] == "(") & op(3).isin(AGGREGATES), op(3))

    return let(complete_names(tokens), lambda ns: F.transform(tokens, lambda t, i: F.struct(
        t.alias("t"), F.get(ns, i).alias("column"), F.when(t["role"] == "column", aggregate(t, i)).alias("agg"))))


def scope_elements(tokens: Column) -> Column:
    """Of every scope of bound tokens a struct(scope, depth, parent_scope, parent_branch, is_set, SM, OM, VM, pairs, cols, parts) with
    the elements that its tokens stand for, each struct(component, element). What depends on the equalities of the other side
    stays open until gold meets the prediction (``_finished``): cols, a column as struct(pos, name, again), again if it is
    repeated in its scope; pairs, the equalities of two columns; parts, EM parts with the columns on their sides."""
    def of_scope(s, own, marked):
        at_base = lambda t: t["p"] == t["base_p"]
        toks = lambda cond, value: F.transform(F.filter(own, lambda m: cond(m["t"])), lambda m: value(m["t"]))
        is_set = F.exists(own, lambda m: m["t"]["is_setop"])

        # SM: clause keywords with the directions of their ORDER BY, set-operator keywords
        def clause(t):
            items = toks(lambda o: (o["branch"] == t["branch"]) & (o["clause"] == "orderby") & at_base(o) & ~o["lt"].isin("order", "by", ","),
                         lambda o: F.struct(o["ob_item"].alias("ob_item"), (o["lt"] == "desc").alias("is_desc")))
            dirs = lambda xs: F.concat_ws("_", F.transform(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["ob_item"]))), lambda i: F.when(
                F.exists(xs, lambda x: (x["ob_item"] == i) & x["is_desc"]), "desc").otherwise("asc")))
            name = F.when(t["clause_kw"] == "orderby", let(items, lambda xs: F.when(F.size(xs) > 0, F.concat(F.lit("orderby_"), dirs(xs))).otherwise("orderby"))) \
                    .otherwise(t["clause_kw"])
            return F.struct(t["clause_kw"].alias("component"), _branched(name, t["branch"]).alias("element"))

        sm = F.concat(toks(lambda t: t["clause_kw"].isNotNull(), clause),
                      toks(lambda t: t["is_setop"], lambda t: F.struct(F.lit("set_operator").alias("component"), t["lt"].alias("element"))))

        # OM: operator occurrences per clause
        def operators(is_set):
            place = lambda t: F.when(is_set, "set_operator").otherwise(F.coalesce(t["clause"], F.lit("none")))
            return _occurrences(toks(lambda t: t["op"].isin(OM_COMPONENTS), lambda t: F.struct(
                t["op"].alias("component"), F.concat_ws("_", t["op"], place(t)).alias("name"))), "_")

        # VM: tables and values, columns, equalities of columns
        value = lambda t: F.when((t["role"] == "value") & (t["kind"] == "str"), t["lt"].substr(F.lit(2), F.length(t["lt"]) - 2)).otherwise(t["lt"])
        vm = _occurrences(toks(lambda t: t["role"].isin("table", "value"), lambda t: F.struct(
            F.concat(t["role"], F.lit("s")).alias("component"), F.concat_ws("/", F.concat(t["role"], F.lit("s")), value(t)).alias("name"))), "/")
        names = F.transform(F.filter(own, lambda m: m["column"].isNotNull()), lambda m: F.struct(m["t"]["pos"].alias("pos"), m["column"].alias("name")))
        columns = let(names, lambda xs: let(F.transform(xs, lambda x: x["name"]), lambda ns: F.transform(xs, lambda x, i: F.struct(
            x["pos"].alias("pos"), x["name"].alias("name"), (F.array_position(ns, x["name"]) <= i).alias("again")))))

        def pair(m):
            sides = [F.get(marked, m["t"]["pos"] + d) for d in (-1, 1)]
            left, right = (F.when(x["t"]["scope"] == s, x["column"]) for x in sides)
            return F.when(left.isNotNull() & right.isNotNull(), F.array(left, right))

        pairs = F.filter(F.transform(F.filter(own, lambda m: m["t"]["op"] == "eq"), pair), lambda x: x.isNotNull())

        # EM: columns with their aggregate, conditions with their sides
        def part(m, i, cols):
            t = m["t"]
            is_column = (t["role"] == "column").eqNullSafe(True)
            where = [F.coalesce(t["clause"], F.lit("none")), t["branch"].cast("string")]
            place = F.when(t["clause"] == "orderby", t["ob_item"].cast("string"))
            head = F.when(is_column, F.concat_ws("|", F.lit("column"), *where, F.coalesce(place, F.lit("")), F.coalesce(m["agg"], F.lit("")))) \
                    .otherwise(F.concat_ws("|", F.lit("condition"), *where, t["op"]))
            at = lambda pos: F.get(F.filter(cols, lambda c: c["pos"] == pos), F.lit(0))
            left = F.when(is_column, at(t["pos"])).otherwise(_last(F.filter(cols, lambda c: c["pos"] < t["pos"])))
            connective = _last(F.filter(own, lambda o: o["t"]["op"].isin("and", "or") & (o["t"]["pos"] < t["pos"]) & (o["t"]["branch"] == t["branch"])
                                        & o["t"]["clause"].eqNullSafe(t["clause"])))["t"]["op"]
            return F.when(is_column | t["op"].isin(CONDITIONS), F.struct(
                t["pos"].alias("pos"), head.alias("head"), is_column.alias("is_column"), left.alias("left"),
                F.when(~is_column, at(F.get(own, i + 1)["t"]["pos"])).alias("right"),
                F.when(~is_column & F.coalesce(connective == "or", F.lit(False)), "or").otherwise("").alias("tail")))

        def with_columns(cols):
            parts = F.filter(F.transform(own, lambda m, i: part(m, i, cols)), lambda x: x.isNotNull())
            largest = lambda name: F.array_max(F.transform(own, lambda m: m["t"][name]))
            return F.struct(
                s.alias("scope"), largest("depth").alias("depth"), largest("parent_scope").alias("parent_scope"), largest("parent_branch").alias("parent_branch"),
                is_set.alias("is_set"), sm.alias("SM"), let(is_set, operators).alias("OM"), vm.alias("VM"), pairs.alias("pairs"), cols.alias("cols"), parts.alias("parts"))

        return let(columns, with_columns)

    scopes = F.array_sort(F.array_distinct(F.transform(tokens, lambda t: t["scope"])))
    return let(_marked(tokens), lambda marked: F.transform(scopes, lambda s: let(F.filter(marked, lambda m: m["t"]["scope"] == s), lambda own: of_scope(s, own, marked))))


def connected_classes(pairs: Column) -> Column:
    """Connected classes of equal columns, each an array of names."""
    def join(classes, pair):
        met = lambda c: F.arrays_overlap(c, pair)
        return F.concat(F.filter(classes, lambda c: ~met(c)), F.array(F.array_distinct(F.flatten(F.concat(F.filter(classes, met), F.array(pair))))))

    return F.aggregate(F.array_distinct(pairs), F.array().cast("array<array<string>>"), join)


def _numbered(names: Column, sep: str) -> Column:
    """Every name with its occurrence number from 0 on."""
    return let(F.array_sort(names), lambda xs: F.transform(xs, lambda x, i: F.concat_ws(sep, x, (i + 1 - F.array_position(xs, x)).cast("string"))))


def _finished(scope: str, classes: Column) -> Column:
    """One side's subquery with VM and EM whole: repeated columns replaced by the smallest member of their class, then
    numbered. Null where the side lacks the subquery."""
    def name(c):
        own = F.get(F.filter(classes, lambda m: F.array_contains(m, c["name"])), F.lit(0))
        return F.when(c["again"], F.coalesce(F.array_min(own), c["name"])).otherwise(c["name"])

    def part(x):
        return F.when(x["is_column"], F.concat_ws("|", x["head"], name(x["left"]))).otherwise(F.concat_ws(
            "|", x["head"], F.coalesce(name(x["left"]), F.lit("")), F.coalesce(name(x["right"]), F.lit("value")), x["tail"]))

    def elements(component, names, sep):
        return F.transform(_numbered(names, sep), lambda e: F.struct(F.lit(component).alias("component"), e.alias("element")))

    columns = F.transform(f"{scope}.cols", lambda c: F.concat_ws("/", F.lit("columns"), name(c)))
    return F.when(F.col(scope).isNotNull(), F.struct(
        f"{scope}.SM", f"{scope}.OM", F.concat(f"{scope}.VM", elements("columns", columns, "/")).alias("VM"),
        elements("exact", F.transform(f"{scope}.parts", part), "|").alias("EM")))


def _branched(name: Column, branch: Column) -> Column:
    return F.when(branch >= 1, F.concat(name, F.lit("_"), branch.cast("string"))).otherwise(name)


def complete_names(tokens: Column) -> Column:
    """Q22/Q25/Q26: of every bound token, a column's name with its real table, else null. A qualifier that is a table alias of
    the scope becomes the table; an unqualified column takes the table when the scope's FROM holds exactly one
    table (or one subquery, by its alias) and no join."""
    def of_scope(s, own):
        names = lambda role: F.transform(F.filter(own, lambda t: t["role"] == role), lambda t: t["lt"])
        tables, queries = names("table"), names("query_alias")
        aliases = F.transform(F.filter(own, lambda t: t["role"] == "table_alias"), lambda t: F.struct(t["lt"].alias("alias"), t["alias_of"].alias("alias_of")))
        lone = (F.size(tables) + F.size(queries) == 1) & ~F.exists(own, lambda t: F.coalesce(t["op"].isin(JOIN_OPS), F.lit(False)))
        return F.struct(s.alias("scope"), aliases.alias("aliases"), F.when(lone, F.coalesce(F.array_max(tables), F.array_max(queries))).alias("implicit"))

    scopes = F.transform(F.array_distinct(F.transform(tokens, lambda t: t["scope"])), lambda s: let(F.filter(tokens, lambda t: t["scope"] == s), lambda own: of_scope(s, own)))

    def name(t, scope):
        qualifier = F.when(t["lt"].contains("."), F.substring_index(t["lt"], ".", 1))
        real = let(qualifier, lambda q: F.coalesce(F.array_min(F.transform(F.filter(scope["aliases"], lambda x: x["alias"] == q), lambda x: x["alias_of"])), q))
        table = F.when(t["lt"].contains("."), real).otherwise(scope["implicit"])
        column = F.substring_index(t["lt"], ".", -1)
        return let(table, lambda tb: F.when(tb.isNotNull(), F.concat(tb, F.lit("."), column)).otherwise(column))

    return let(scopes, lambda all_: F.transform(tokens, lambda t: F.when(t["role"] == "column", name(t, F.get(F.filter(all_, lambda s: s["scope"] == t["scope"]), F.lit(0))))))


def query_scopes(tokens: Column) -> Column:
    """struct(parse_error, scopes) of a text's bound tokens, null without a token: the array of its (sub)queries as struct(depth, i, SM, OM, VM, ...),
    i counting the subqueries of one depth in order; every family is an array of struct(component, element), and what
    ``_finished`` needs follows as pairs, cols and parts."""
    def scopes(every):
        def nested(x):
            return F.transform(F.filter(every, lambda c: c["parent_scope"] == x["scope"]), lambda c: F.struct(
                F.lit(None).cast("string").alias("component"),
                _branched(F.when(c["is_set"], F.lit("set_operator")).otherwise(F.lit("nesting")), c["parent_branch"]).alias("element")))

        return F.transform(every, lambda x: F.struct(
            x["depth"].alias("depth"), F.size(F.filter(every, lambda c: (c["depth"] == x["depth"]) & (c["scope"] < x["scope"]))).alias("i"),
            F.concat(x["SM"], nested(x)).alias("SM"), x["OM"].alias("OM"), x["VM"].alias("VM"), *[x[c].alias(c) for c in ("pairs", "cols", "parts")]))

    return F.when(F.size(tokens) > 0, F.struct(sqltokens.text_error(tokens).alias("parse_error"), let(scope_elements(tokens), scopes).alias("scopes")))


def aligned_scopes(gold: DataFrame | None, predictions: DataFrame, key: str = "datapoint_id",
                   gold_col: str = "sql_query", pred_col: str = "predicted", labels=None, beside: DataFrame | None = None) -> DataFrame:
    """(key, model, parse_error, depth, i, g, p): the aligned subqueries of every (datapoint, model) pair, g and p struct of
    element arrays (null where a side lacks the subquery). A pair without any subquery keeps one row with a
    null depth. One exchange of the SQL strings by the key. Without ``gold`` every prediction brings its gold text.
    A text that several of a datapoint's sides share is analysed once. ``labels`` adds a column of that name, made of the gold text's bound tokens,
    ``beside`` the columns of a DataFrame by key. It is merged in while there is one row per key: what the planner expects of its size comes
    from the files it is read from, which says nothing of the rows made of them, so it must not be broadcast."""
    if gold is None:
        sides = predictions.select(key, "model", F.col(pred_col).alias("sql"), F.col(gold_col).alias("_g")).repartition(sqltokens.tasks(predictions), key)
        texts = sides.groupBy(key).agg(F.concat(F.array(F.struct(F.lit(GOLD).alias("model"), F.first("_g").alias("sql"))),
                                                F.array_sort(F.collect_list(F.struct("model", "sql")))).alias("texts"))
    else:
        sides = sql_sides(gold, predictions, key, gold_col, pred_col)
        texts = sides.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("model", "sql"))).alias("texts"))

    if beside is not None:
        texts = texts.join(beside.hint("merge"), key, "left")
    own = [c for c in texts.columns if c not in (key, "texts")]

    # every text of the datapoint once, its tokens, what they stand for; a null text has no place among them
    sqls = F.array_distinct(F.filter(F.transform("texts", lambda x: x["sql"]), lambda s: s.isNotNull()))
    at = lambda c, x: F.get(c, F.array_position("sqls", x["sql"]).cast("int") - 1)
    gold_sql = F.get(F.filter("texts", lambda x: x["model"] == GOLD), F.lit(0))["sql"]

    def found(sql):
        # the tokens of a text are bound, not kept: an array of them would be copied, written to a row and read again
        def of_tokens(ts):
            more = [] if labels is None else [F.when(sql == F.col("gold_sql"), labels(ts)).alias("labels")]
            return F.struct(query_scopes(ts).alias("q"), *more)

        return let(sqltokens.token_array(sql), of_tokens)

    texts = texts.select(key, "texts", sqls.alias("sqls"), gold_sql.alias("gold_sql"), *own)
    texts = texts.select(key, "texts", "sqls", "gold_sql", F.transform("sqls", found).alias("found"), *own)
    kept = []
    if labels is not None:  # a missing gold text has those of no tokens
        none = let(sqltokens.token_array(F.lit(None).cast("string")), labels)
        kept = [F.coalesce(F.get("found", F.array_position("sqls", F.col("gold_sql")).cast("int") - 1)["labels"], none).alias("labels")]
    texts = texts.select(key, "texts", "sqls", "found", *kept, *own)
    kept = ["labels"] * len(kept) + own

    def analysed(x):
        return let(at("found", x)["q"], lambda q: F.struct(x["model"].alias("model"), q["parse_error"].alias("parse_error"), q["scopes"].alias("scopes")))

    def pairs_of(q):
        side = lambda m: F.get(F.filter(q, lambda x: x["model"] == m), F.lit(0))
        models = F.array_distinct(F.filter(F.transform(q, lambda x: x["model"]), lambda m: m != GOLD))
        return let(side(F.lit(GOLD)), lambda g: F.transform(models, lambda m: F.struct(m.alias("model"), g.alias("g"), side(m).alias("p"))))

    rows = texts.select(key, *kept, F.explode(let(F.transform("texts", analysed), pairs_of)).alias("r")).select(key, *kept, "r.model", "r.g", "r.p")
    error = F.coalesce(F.concat(F.lit("gold: "), "g.parse_error"), F.concat(F.lit("predicted: "), "p.parse_error"))
    empty = F.array().cast("array<struct<depth:int,i:int>>")
    places = [F.coalesce(F.transform(f"{x}.scopes", lambda s: F.struct(s["depth"].cast("int").alias("depth"), s["i"].cast("int").alias("i"))), empty) for x in "gp"]
    rows = rows.select(key, "model", *kept, error.alias("parse_error"), "g", "p", F.explode_outer(F.array_union(*places)).alias("at"))

    def scope(x):
        return F.get(F.filter(f"{x}.scopes", lambda s: (s["depth"] == F.col("at.depth")) & (s["i"] == F.col("at.i"))), F.lit(0))

    rows = rows.select(key, "model", *kept, "parse_error", "at.depth", "at.i", scope("g").alias("g"), scope("p").alias("p"))
    pairs = [F.coalesce(f"{x}.pairs", F.array().cast("array<array<string>>")) for x in "gp"]
    rows = rows.withColumn("classes", connected_classes(F.concat(*pairs)))
    return rows.select(key, "model", "parse_error", "depth", "i", *[_finished(x, F.col("classes")).alias(x) for x in "gp"], *kept)


def _names(side: str, family: str, component: str = "total") -> Column:
    """Distinct elements of one side's family (or of one of its components)."""
    c = F.col(f"{side}.{family}")
    if component != "total":
        c = F.filter(c, lambda x: x["component"] == component)
    return F.coalesce(F.transform(c, lambda x: x["element"]), F.array().cast("array<string>"))


def _jaccard(family: str, component: str = "total") -> Column:
    g, p = _names("g", family, component), _names("p", family, component)
    union = F.size(F.array_union(g, p))
    return F.when(F.col("depth").isNotNull(), F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(g, p)) / union))


def _scores(aligned: DataFrame, components: list[tuple[str, str]], key: str) -> DataFrame:
    """(key, model, parse_error, exact, one column per (family, component)): means over depths of the means over
    aligned subqueries; exact is 1 where all exact-match parts agree everywhere. Labels go along."""
    pair = [key, "model", "parse_error", *[c for c in aligned.columns if c == "labels"]]
    same = F.when(F.col("depth").isNotNull(), F.least(*[(_jaccard(f, c) == 1).cast("int") for f, c in EM_COMPONENTS]))
    names = [f"{f}_{c}" for f, c in components]
    per_depth = aligned.select(*pair, "depth", same.alias("exact"), *[_jaccard(f, c).alias(n) for (f, c), n in zip(components, names)]) \
        .groupBy(*pair, "depth").agg(F.min("exact").alias("exact"), *[F.avg(n).alias(n) for n in names])
    return per_depth.groupBy(*pair).agg(F.min("exact").alias("exact"), *[F.avg(n).alias(n) for n in names])


def component_scores(gold: DataFrame, predictions: DataFrame, key: str = "datapoint_id",
                     gold_col: str = "sql_query", pred_col: str = "predicted") -> DataFrame:
    """M1-M3: (key, model, parse_error, family, component, score) for every component, 'total' for a whole family."""
    components = [(f, c) for f, cs in FAMILIES.items() for c in ["total", *cs]]
    wide = _scores(aligned_scopes(gold, predictions, key, gold_col, pred_col), components, key)
    long = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(c).alias("component"), F.col(f"`{f}_{c}`").alias("score")) for f, c in components])
    return wide.select(key, "model", "parse_error", F.explode(long).alias("s")).select(key, "model", "parse_error", "s.*")


def value_by_depth(gold: DataFrame, predictions: DataFrame, key: str = "datapoint_id",
                   gold_col: str = "sql_query", pred_col: str = "predicted") -> DataFrame:
    """M3: (model, family, component, depth, score, pairs): mean over pairs of a component's value at a depth, and with a null depth
    of its mean over depths; component ``total`` is a whole family. One pass by grouping sets; pairs of which a side is
    rejected (Q32) are left out."""
    components = [(f, c) for f, cs in FAMILIES.items() for c in ["total", *cs]]
    names = [f"{f}_{c}" for f, c in components]
    aligned = aligned_scopes(gold, predictions, key, gold_col, pred_col).where("parse_error IS NULL AND depth IS NOT NULL")
    # a component that neither side has agrees; most are of that kind, so only those there are compared
    there = [F.array_distinct(F.transform(F.concat(*[F.coalesce(f"{x}.{f}", F.array().cast("array<struct<component:string,element:string>>")) for x in "gp"]),
                                          lambda e: e["component"])).alias(f"_{f}") for f in FAMILIES]
    value = lambda f, c: _jaccard(f, c) if c == "total" else F.when(F.array_contains(f"_{f}", c), _jaccard(f, c)).otherwise(1.0)
    aligned = aligned.select(key, "model", "depth", "g", "p", *there).select(key, "model", "depth", *[value(f, c).alias(n) for (f, c), n in zip(components, names)])
    # a pair's components stay in one row until only a row per model and depth is left
    means = [F.avg(n).alias(n) for n in names]
    pair = [F.col(key), F.col("model")]
    sets = aligned.groupBy(key, "model", "depth").agg(*means).groupingSets([[*pair, F.col("depth")], pair], *pair, F.col("depth")).agg(*means)
    wide = sets.groupBy("model", "depth").agg(*means, F.count(F.lit(1)).alias("pairs"))
    long = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(c).alias("component"), F.round(n, PRECISION).alias("score")) for (f, c), n in zip(components, names)])
    return wide.select("model", "depth", "pairs", F.explode(long).alias("s")).select("model", "s.family", "s.component", "depth", "s.score", "pairs")


def with_execution(scores: DataFrame, executed: DataFrame, key: str = "datapoint_id", not_run: int | None = None) -> DataFrame:
    """The scores of every pair with EX next to them: ``executed`` is ``execution.execution_match`` of the pairs that were run;
    others get ``not_run`` (null unless given: an execution that didn't happen isn't a match)."""
    ex = executed.select(key, "model", F.col("EX").cast("int").alias("EX"))
    return scores.join(ex, [key, "model"], "left").withColumn("EX", F.coalesce("EX", F.lit(not_run).cast("int")))


EM_COMPONENTS = [("SM", "total"), ("OM", "total"), ("VM", "tables"), ("EM", "total")]


def partial_match(gold: DataFrame | None, predictions: DataFrame, key: str = "datapoint_id",
                  gold_col: str = "sql_query", pred_col: str = "predicted", boolean: bool = False,
                  report_components: bool = False, labels=None) -> DataFrame:
    """One row per (key, model): PM, SM, OM, VM (and, optionally, every component).

    A pair where either side fails Q32 scores 0 on every metric (M9). ``boolean``
    adds ``*_boolean`` columns: 1 when the score is 1, else 0; ``labels`` a column of that name (see ``aligned_scopes``).
    """
    components = [(f, "total") for f in FAMILIES]
    if report_components:
        components += [(f, c) for f, cs in FAMILIES.items() for c in cs]
    sc = _scores(aligned_scopes(gold, predictions, key, gold_col, pred_col, labels), components, key)
    kept = [c for c in sc.columns if c == "labels"]
    failed = F.col("parse_error").isNotNull()

    def scored(name):
        return F.when(failed, 0.0).otherwise(F.coalesce(F.col(f"`{name}`"), F.lit(0.0)))

    # Exact where structure, operators per clause, tables and the parts of every clause agree; values don't count
    out = sc.select(key, "model", "parse_error", F.when(failed, 0).otherwise(F.coalesce("exact", F.lit(0))).alias("EM"),
                    *[scored(f"{f}_total").alias(f) for f in FAMILIES], *[scored(f"{f}_{c}").alias(f"{f}_{c}") for f, c in components if c != "total"], *kept)
    out = out.withColumn("PM", (F.col("SM") + F.col("OM") + F.col("VM")) / 3)
    metric_cols = ["PM", "SM", "OM", "VM"] + [f"{f}_{c}" for f, c in components if c != "total"]
    out = out.select(key, "model", "parse_error", "EM", *[F.round(F.col(f"`{c}`"), PRECISION).alias(c) for c in metric_cols], *kept)
    if boolean:
        out = out.select("*", *[F.when(F.col(c) == 1, 1).otherwise(0).alias(f"{c}_boolean")
                                for c in ["PM", "SM", "OM", "VM"]])
    return out


def _text(c: Column | str) -> Column:
    """A text as a key: null and empty differ."""
    return F.coalesce(F.concat(F.lit("t"), F.col(c) if isinstance(c, str) else c), F.lit(""))


def text_hash(c: Column | str) -> Column:
    """16 bytes that stand for a gold text in ``distinct_pairs``."""
    return F.unhex(F.md5(_text(c).cast("binary")))


def over_distinct_pairs(score, gold: DataFrame | None, predictions: DataFrame, key: str = "datapoint_id", gold_col: str = "sql_query",
                        pred_col: str = "predicted", carry: tuple[str, ...] = (), with_text: bool = False, **options) -> DataFrame:
    """``score`` (``partial_match`` and the like) of every (key, model) pair, computed once per distinct (gold text, predicted text).

    Without ``gold`` every prediction brings its gold text as ``gold_col`` and nothing is joined for it. Texts are exchanged
    once each distinct pair, and once more to meet the other predictions of their gold text, which is analysed once; a pair's
    own row travels with a 16-byte hash only, to which the scores are joined back (a merge join: the size of the scores, estimated
    from the files read, would let them be broadcast). ``carry`` are columns of ``predictions`` to
    keep; ``with_text`` keeps the predicted text, which comes from the distinct pairs. Predictions without a datapoint are scored against a missing gold text."""
    sides, scores = distinct_pairs(score, gold, predictions, key, gold_col, pred_col, carry, with_text, **options)
    return sides.join(scores.drop("_gold").hint("merge"), "_pair").drop("_pair")


def distinct_pairs(score, gold: DataFrame | None, predictions: DataFrame, key: str = "datapoint_id", gold_col: str = "sql_query",
                   pred_col: str = "predicted", carry: tuple[str, ...] = (), with_text: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """The two sides of ``over_distinct_pairs``: every pair as (key, model, carry..., _pair), and the scores of distinct pairs by _pair and
    _gold, the hash of their gold text (``text_hash``)."""
    gold_hash = text_hash("_g")
    pair = lambda g, p: F.unhex(F.md5(F.concat(g, p.cast("binary"))))
    sides = predictions.select(key, "model", *carry, F.col(pred_col).alias("_p"), *[F.col(gold_col).alias("_g")] * (gold is None))
    if gold is not None:
        sides = sides.join(gold.select(key, F.col(gold_col).alias("_g")), key, "left")
    distinct = sides.select("_g", "_p").distinct()
    scores = score(None, distinct.select(gold_hash.alias(key), _text("_p").alias("model"), F.col("_g").alias(gold_col), F.col("_p").alias(pred_col)),
                   key, gold_col, pred_col, **options)
    prediction = F.when(F.col("model") != "", F.col("model").substr(F.lit(2), F.length("model")))
    back = scores.select(F.col(key).alias("_gold"), pair(F.col(key), F.col("model")).alias("_pair"), *[c for c in scores.columns if c not in (key, "model")],
                         *[prediction.alias(pred_col)] * with_text)
    return sides.select(key, "model", *carry, pair(gold_hash, _text("_p")).alias("_pair")), back


def best_of_alternatives(golds: DataFrame, predictions: DataFrame, key: str = "datapoint_id", gold_col: str = "sql_query",
                         pred_col: str = "predicted") -> DataFrame:
    """S3 with M8: the scores of every (key, model) pair against the best of the gold texts of its key (a row each in ``golds``):
    by EM, then PM, then the family scores; ``golds`` tells how many there were. Every distinct pair of texts is scored once."""
    scores = over_distinct_pairs(partial_match, golds, predictions, key, gold_col, pred_col)
    metrics = ["EM", "PM", "SM", "OM", "VM"]
    best = F.max_by(F.struct("parse_error", *metrics), F.struct(*metrics, F.col("parse_error").isNull()))
    return scores.groupBy(key, "model").agg(best.alias("best"), F.count(F.lit(1)).alias("golds")).select(key, "model", "golds", "best.*")


def corpus_partial_match(scores: DataFrame, by=("model",)) -> DataFrame:
    """M9 (aggregated): mean of each metric per model (failures count as 0)."""
    metrics = [c for c in scores.columns if c in ("EM", "EX", "PM", "SM", "OM", "VM") or c.endswith("_boolean")]
    return scores.groupBy(*by).agg(*[F.round(F.avg(c), PRECISION).alias(c) for c in metrics])


def hardness(features: DataFrame, key: str = "datapoint_id") -> DataFrame:
    """Hardness (easy / medium / hard / extra) of each query from its whole-query feature row;
    'NA' when the query fails Q32.

    c1 = [where] + [group by] + [order by] + [limit] + (tables - 1) + #or + #like;
    c2 = nested queries + set operations; oth = [aggregates > 1] + [select items > 1]
    + [where conditions > 1] + [group-by columns > 1]. First matching level wins:
    easy c1<=1, oth=0, c2=0; medium (oth<=2, c1<=1, c2=0) or (c1<=2, oth<2, c2=0);
    hard (oth>2, c1<=2, c2=0) or (2<c1<=3, oth<=2, c2=0) or (c1<=1, oth=0, c2<=1); else extra.
    """
    r = features.where(F.col("current_depth") == -1)

    def flag(c):
        return F.when(c, 1).otherwise(0)

    c1 = (flag(F.col("W") > 0) + flag(F.col("G") > 0) + flag(F.col("O") > 0) + flag(F.col("L") > 0)
          + F.greatest(F.col("tables") - 1, F.lit(0)) + F.col("or") + F.col("like") + F.col("not_like"))
    c2 = F.col("N") + F.col("SO")
    oth = (flag(F.col("Ag") > 1) + flag(F.coalesce(F.col("select_columns"), F.lit(0)) > 1)
           + flag(F.coalesce(F.col("where_conditions"), F.lit(0)) > 1)
           + flag(F.coalesce(F.col("groupby_columns"), F.lit(0)) > 1))
    level = (F.when(F.col("parse_error").isNotNull(), "NA")
             .when((c1 <= 1) & (oth == 0) & (c2 == 0), "easy")
             .when(((oth <= 2) & (c1 <= 1) & (c2 == 0)) | ((c1 <= 2) & (oth < 2) & (c2 == 0)), "medium")
             .when(((oth > 2) & (c1 <= 2) & (c2 == 0)) | ((c1 > 2) & (c1 <= 3) & (oth <= 2) & (c2 == 0))
                   | ((c1 <= 1) & (oth == 0) & (c2 <= 1)), "hard")
             .otherwise("extra"))
    return r.select(key, level.alias("hardness"))


def component_accuracy(gold: DataFrame, predictions: DataFrame, levels: DataFrame, key: str = "datapoint_id",
                       gold_col: str = "sql_query", pred_col: str = "predicted") -> DataFrame:
    """Per model, family and component: accuracy (matched / predicted, over pairs that
    predict something), recall (matched / gold, over pairs whose gold has something) and F1,
    per hardness level and overall ('all'). Elements are counted over all aligned subqueries of pairs of
    which both sides can be represented (Q32). One pass: overall figures are made of the sums per level."""
    aligned = aligned_scopes(gold, predictions, key, gold_col, pred_col, beside=levels).where("parse_error IS NULL AND depth IS NOT NULL")
    empty = F.array().cast("array<struct<component:string,element:string>>")
    both = F.array(*[F.struct(F.lit(f).alias("family"), *[F.coalesce(F.array_distinct(f"{x}.{f}"), empty).alias(x) for x in "gp"]) for f in FAMILIES])
    el = aligned.select(key, "model", "hardness", F.explode(both).alias("b")).select(key, "model", "hardness", "b.*")
    el = el.select(key, "model", "hardness", "family", "g", "p", F.explode(F.array_union("g", "p")).alias("e")).where("e.component IS NOT NULL")
    el = el.select(key, "model", "hardness", "family", "e.component", *[F.array_contains(x, F.col("e")).cast("int").alias(x) for x in "gp"])
    c = el.groupBy(key, "model", "hardness", "family", "component").agg(
        F.sum("g").alias("label_total"), F.sum("p").alias("pred_total"), F.sum(F.col("g") * F.col("p")).alias("matched"))
    acc = F.when(F.col("pred_total") > 0, F.col("matched") / F.col("pred_total"))
    rec = F.when(F.col("label_total") > 0, F.col("matched") / F.col("label_total"))
    sums = c.groupBy("model", "family", "component", "hardness").agg(
        F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{name}_{s}") for name, x in (("acc", acc), ("rec", rec)) for s, f in (("sum", F.sum), ("n", F.count))])
    of = [F.col(x) for x in ("model", "family", "component")]
    out = sums.groupingSets([[*of, F.col("hardness")], of], *of, F.col("hardness")).agg(
        *[safe_div(F.sum(f"{x}_sum"), F.sum(f"{x}_n")).alias(x) for x in ("acc", "rec")], F.sum("n").alias("pairs"), F.grouping("hardness").alias("overall"))
    out = out.withColumn("hardness", F.when(F.col("overall") == 1, "all").otherwise(F.col("hardness")))
    f1 = F.when((F.col("acc") + F.col("rec")) > 0, 2 * F.col("acc") * F.col("rec") / (F.col("acc") + F.col("rec")))
    return out.select("model", "family", "component", "hardness", F.round("acc", PRECISION).alias("acc"),
                      F.round("rec", PRECISION).alias("rec"), F.round(f1, PRECISION).alias("f1"), "pairs")


#: Component types of partial scores, in report order (fixed values)
PARTIAL_TYPES = ["select", "select(no AGG)", "where", "where(no OP)", "group(no Having)", "group", "order", "and/or", "IUEN", "keywords"]
KEYWORD_OPERATORS = ["or", "not", "in", "nin", "like", "not_like"]


def clause_units(side: str) -> Column:
    """Array of struct(type, units) of one side's outermost (sub)query, from its matching elements: select items with and
    without their aggregate, conditions with and without their operator, GROUP BY columns without and with the HAVING
    conditions (one unit), the ORDER BY list with directions and LIMIT (one unit), connectives, set operators, keywords."""
    texts = lambda family: F.coalesce(F.transform(f"{side}.{family}", lambda x: x["element"]), F.array().cast("array<string>"))
    em, sm, om = texts("EM"), texts("SM"), texts("OM")
    part = lambda e, i: F.get(F.split(e, r"\|"), F.lit(i))
    kind = lambda head, clause: F.filter(em, lambda e: (part(e, 0) == head) & (part(e, 1) == clause))
    each = lambda xs, *places: F.transform(xs, lambda e: F.concat_ws("|", *[part(e, i) for i in places]))
    select, where = kind("column", "select"), kind("condition", "where")
    group, having = each(kind("column", "groupby"), 2, 5), each(kind("condition", "having"), 2, 3, 4, 5)
    orders = F.filter(sm, lambda e: e.startswith("orderby"))
    order = F.concat(orders, each(kind("column", "orderby"), 2, 3, 4, 5), F.filter(sm, lambda e: e.startswith("limit")))
    one = lambda there, xs: F.when(F.size(there) > 0, F.array(F.array_join(F.array_sort(xs), ";"))).otherwise(F.array().cast("array<string>"))
    connectives = F.array_distinct(F.transform(F.filter(om, lambda e: e.rlike("^(and|or)_where_")), lambda e: F.split(e, "_")[0]))
    setops = F.transform(F.filter(f"{side}.SM", lambda x: x["component"] == "set_operator"), lambda x: x["element"])
    clauses = F.filter(F.array_distinct(F.transform(sm, lambda e: F.regexp_extract(e, "^[a-z]+", 0))), lambda e: e.isin("where", "groupby", "having", "orderby", "limit"))
    directions = F.array_distinct(F.flatten(F.transform(orders, lambda e: F.filter(F.split(e, "_"), lambda d: d.isin("asc", "desc")))))
    words = F.array_distinct(F.transform(F.filter(f"{side}.OM", lambda x: x["component"].isin(KEYWORD_OPERATORS)), lambda x: x["component"]))
    units = [each(select, 2, 4, 5), each(select, 2, 5), each(where, 2, 3, 4, 5, 6), each(where, 2, 4), group, one(group, F.concat(group, having)), one(orders, order),
             connectives, F.coalesce(setops, F.array().cast("array<string>")), F.concat(clauses, directions, words)]
    return F.array(*[F.struct(F.lit(t).alias("type"), F.array_sort(u).alias("units")) for t, u in zip(PARTIAL_TYPES, units, strict=True)])


def partial_scores(gold: DataFrame, predictions: DataFrame, levels: DataFrame, key: str = "datapoint_id",
                   gold_col: str = "sql_query", pred_col: str = "predicted") -> DataFrame:
    """(model, type, hardness, acc, rec, f1, acc_pairs, rec_pairs) of the ten component types per hardness level and
    overall (``all``), by one rollup. A pair's units of a type count as matched when both sides have the same ones;
    accuracy is the share of matched pairs among those whose prediction has units, recall among those whose gold has."""
    aligned = aligned_scopes(gold, predictions, key, gold_col, pred_col, beside=levels).where("parse_error IS NULL AND depth = 0 AND i = 0")
    both = F.explode(F.arrays_zip(clause_units("g").alias("g"), clause_units("p").alias("p"))).alias("u")
    rows = aligned.select("model", "hardness", both).select("model", "hardness", F.col("u.g.type").alias("type"), F.col("u.g.units").alias("g"), F.col("u.p.units").alias("p"))
    same = (F.col("g") == F.col("p")).cast("int")
    rows = rows.withColumn("acc", F.when(F.size("p") > 0, same)).withColumn("rec", F.when(F.size("g") > 0, same))
    out = rows.withColumn("hardness", F.coalesce("hardness", F.lit("NA"))).groupingSets(
        [[F.col("model"), F.col("type"), F.col("hardness")], [F.col("model"), F.col("type")]], F.col("model"), F.col("type"), F.col("hardness")).agg(
        F.avg("acc").alias("acc"), F.avg("rec").alias("rec"), F.count("acc").alias("acc_pairs"), F.count("rec").alias("rec_pairs"))
    f1 = F.when(F.col("acc") + F.col("rec") > 0, 2 * F.col("acc") * F.col("rec") / (F.col("acc") + F.col("rec")))
    return out.select("model", "type", F.coalesce("hardness", F.lit("all")).alias("hardness"), F.round("acc", PRECISION).alias("acc"),
                      F.round("rec", PRECISION).alias("rec"), F.round(f1, PRECISION).alias("f1"), "acc_pairs", "rec_pairs")


def error_records(scores: DataFrame, predictions: DataFrame, key: str = "datapoint_id") -> DataFrame:
    """One record per failed pair: gold query, prediction, db_path and the error
    (prefixed 'gold:' or 'predicted:')."""
    p = predictions.select(key, "model", F.col("gold").alias("query"), F.col("predicted").alias("prediction"),
                           "db_path")
    return scores.where(F.col("parse_error").isNotNull()).select(key, "model", F.col("parse_error").alias("error")) \
        .join(p, [key, "model"]).select(key, "model", "query", "prediction", "db_path", "error")
