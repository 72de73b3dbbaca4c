"""SQL token relation (Q1) with nesting scope, set branch and clause (Q2).

No parser and no tree: a SQL string becomes an array of tokens, and every
structural attribute is a running value over the tokens of one query, computed by
higher-order functions within the query's own row (``token_array``):

* ``p``      running paren level (``(`` counts after it opens, ``)`` before it closes)
* ``sub_open``/``sub_close`` a paren pair that wraps ``( select ...)`` delimits a scope;
  at one paren level parens alternate, so the last ``(`` at the level of a ``)`` is its match
* ``depth``  running opens minus closes of scope parens
* ``scope``  position of the ``(`` that opened the innermost scope, -1 for the root
* ``branch`` running count of set-operator keywords in the scope
* ``clause`` the last clause keyword at the scope's base paren level
* ``op``     operator name of the token (multi-word operators by the tokens before and after)
* ``role``   table / column / value / alias / function for identifiers and literals

Nothing is exchanged, sorted or kept beyond one query's tokens, so work and memory grow with the texts only.
``token_relation`` generates one row per token from the array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import cases, let

QUOTED_VALUE_AFTER = [*vocab.COMPARISON_SYMBOLS, "like", "ilike", "between"]


def _isin(c: Column, values) -> Column:
    return c.isin(list(values))


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(c: Column) -> Column:
    """``lower`` of a short string. Spark lowers by the rules of all languages, which takes most of the time of reading a
    text; a string without capitals stays as it is, and only what isn't ASCII needs those rules."""
    return cases((~c.rlike(r"[^\x00-@\[-\x7F]"), c), (~c.rlike(r"[^\x00-\x7F]"), F.translate(c, _CAPITALS, _CAPITALS.lower())), otherwise=F.lower(c))


def _tokens(sql: Column) -> Column:
    """Q1: array of struct(pos, tok, lt, kind) of a text, empty for null.

    Comments are no tokens. A quote without its partner has kind ``quote``, any other unknown character ``other``.
    """
    pieces = F.filter(F.regexp_extract_all(sql, F.lit(vocab.TOKEN_PATTERN), 0), lambda x: ~x.startswith("--") & ~x.startswith("/*"))

    def token(tok, pos):
        return let(lowered(tok), lambda low: of_token(tok, low, pos))

    def of_token(tok, low, pos):
        first = F.substring(tok, 1, 1)
        kind = cases((_isin(tok, ["'", '"', "`"]), "quote"),
                     (first == "'", "str"),
                     (_isin(first, ['"', "`"]), "ident"),
                     (tok.rlike(r"^\.?[0-9]"), "num"),
                     (tok.rlike(r"^[\p{L}_]"), F.when(_isin(low, vocab.KEYWORDS), "kw").otherwise("ident")),
                     (tok.rlike(f"^(?:{vocab.SYMBOL_PATTERN})$"), "sym"), otherwise="other")

        def with_kind(k):
            lt = cases((first == "'", tok), ((k == "ident") & (tok.contains('"') | tok.contains("`")), F.regexp_replace(low, '["`]', "")), otherwise=low)
            return F.struct(pos.alias("pos"), tok.alias("tok"), lt.alias("lt"), k.alias("kind"))

        return let(kind, with_kind)

    return F.transform(F.coalesce(pieces, F.array().cast("array<string>")), token)


def _clause_keyword(lt: Column, following: Column) -> Column:
    """Number of the clause that a keyword opens."""
    return cases(((lt == "group") & (following == "by"), CLAUSE_NAMES.index("groupby")), ((lt == "order") & (following == "by"), _ORDERBY),
                 *[(lt == name, CLAUSE_NAMES.index(name)) for name in ("select", "from", "where", "having", "limit")])


def _neighbours(tokens: Column) -> Column:
    """Tokens with the two before and after; a double-quoted name right after a comparison, LIKE or BETWEEN is a string."""
    def token(x, i):
        prev1, next1 = F.get(tokens, i - 1), F.get(tokens, i + 1)
        quoted = x["tok"].startswith('"') & F.coalesce(_isin(prev1["lt"], QUOTED_VALUE_AFTER), F.lit(False)) & x["tok"].rlike('^"[^"]*"$')

        def settled(q):
            text = x["tok"].substr(F.lit(2), F.length(x["tok"]) - 2)
            return F.struct(
                x["pos"].alias("pos"), x["tok"].alias("tok"), cases((q, F.concat(F.lit("'"), text, F.lit("'"))), otherwise=x["lt"]).alias("lt"),
                cases((q, "str"), otherwise=x["kind"]).alias("kind"), prev1["lt"].alias("prev1"), F.get(tokens, i - 2)["lt"].alias("prev2"),
                prev1["kind"].alias("prev_kind"), next1["lt"].alias("next1"), F.get(tokens, i + 2)["lt"].alias("next2"), next1["kind"].alias("next_kind"),
                cases((x["lt"] == "(", 1), (x["lt"] == ")", -1), otherwise=0).alias("step"),
                cases((~q & (x["kind"] == "kw"), _clause_keyword(x["lt"], next1["lt"]))).alias("clause_kw"))

        return let(quoted, settled)

    return F.transform(tokens, token)


_OPENED = "array<struct<at:bigint,sub:boolean>>"
_SCOPES = "array<struct<at:bigint,scope:int>>"
_PLACE = "struct<scope:int,base_p:bigint,branch:bigint,clause:int,seen:array<int>,ob_item:bigint>"
_BETWEEN = "array<struct<scope:int,p:bigint,lt:string>>"
_FLAGS = ("p:bigint,lvl:bigint,sub_open:boolean,sub_close:boolean,depth:bigint,scope:int,base_p:bigint,is_setop:boolean,"
          "branch:bigint,clause_kw:int,clause:int,dup_clause:boolean,ob_item:bigint,between_and:boolean,from_sep:boolean")
_PLACED = f"array<struct<own:struct<{_FLAGS}>,after:struct<{_FLAGS}>>>"
_STATE = {"p": "bigint", "depth": "bigint", "opened": _OPENED, "scopes": _SCOPES, "place": _PLACE, "places": f"array<{_PLACE}>", "between": _BETWEEN}
# tokens that may change the running state, beside the first one, parentheses and clause keywords
_MARKS = [*vocab.SET_OPERATORS, "and", "between", "from", "join", ","]
CLAUSE_NAMES = [name for name, _ in vocab.CLAUSES]
_FROM, _ORDERBY, _LIMIT = (CLAUSE_NAMES.index(n) for n in ("from", "orderby", "limit"))


def _placed(tokens: Column) -> Column:
    """Q2: p, depth, scope, base_p, branch, clause (by number) and helper flags of every token, by one running pass.

    The pass keeps, per paren level, what its last ``(`` opened, per depth its last scope, and of every scope its branch,
    clause, clause keywords seen and ORDER BY items (running count of base-level commas in the clause). It runs over the
    tokens that may change any of it, since its state, results included, is copied at every step; those in between repeat
    what holds after the last of these."""
    changing = F.filter(tokens, lambda x: (x["pos"] == 0) | (x["step"] != 0) | x["clause_kw"].isNotNull() | _isin(x["lt"], _MARKS))
    return let(changing, lambda marks: let(_running(marks), lambda runs: F.flatten(F.transform(runs, lambda r, k: F.concat(
        F.array(r["own"]), F.array_repeat(r["after"], (F.coalesce(F.get(marks, k + 1)["pos"], F.size(tokens)) - F.get(marks, k)["pos"] - 1).cast("int")))))))


def _running(marks: Column) -> Column:
    """Flags of every bound mark (``own``) and of the tokens right after it (``after``); see ``_placed``."""
    empty = {n: F.array().cast(t) if t.startswith("array") else F.lit(0 if t == "bigint" else None).cast(t) for n, t in _STATE.items()}
    start = F.struct(*[c.alias(n) for n, c in empty.items()], F.array().cast(_PLACED).alias("out"))

    def place(scope, base_p, branch, clause, seen, ob_item):
        return F.struct(scope.cast("int").alias("scope"), base_p.alias("base_p"), branch.alias("branch"), clause.alias("clause"), seen.alias("seen"), ob_item.alias("ob_item"))

    def fresh(scope, p):
        return place(scope, p, F.lit(0).cast("bigint"), F.lit(None).cast("int"), F.array().cast("array<int>"), F.lit(0).cast("bigint"))

    no = F.lit(False)

    def step(acc, x):
        lt, pos = x["lt"], x["pos"]

        def with_parens(a):
            p, sub_open, sub_close = a["p"], a["sub_open"], a["sub_close"]
            depth = acc["depth"] + cases((sub_open, 1), (sub_close, -1), otherwise=0)

            def with_depth(depth):
                known = F.when(acc["place"].isNotNull(), F.concat(F.filter(acc["places"], lambda r: r["scope"] != acc["place"]["scope"]), F.array(acc["place"]))) \
                         .otherwise(acc["places"])
                outer = let(F.coalesce(F.get(F.filter(acc["scopes"], lambda c: c["at"] == depth), F.lit(0))["scope"], F.lit(-1)),
                            lambda s: F.coalesce(F.get(F.filter(known, lambda r: r["scope"] == s), F.lit(0)), fresh(s, p)))
                own = cases((sub_open, fresh(pos, p)), (sub_close, outer), (acc["place"].isNull(), fresh(F.lit(-1), p)), otherwise=acc["place"])

                def with_place(r):
                    at_base = p == r["base_p"]
                    is_setop = _isin(lt, vocab.SET_OPERATORS) & at_base
                    keyword = F.when(at_base, x["clause_kw"])

                    def with_keyword(b):
                        setop, kw = b["is_setop"], b["kw"]
                        clause = F.coalesce(kw, F.when(~setop, r["clause"]))
                        seen = F.when(setop, F.array().cast("array<int>")).otherwise(r["seen"])

                        def with_clause(clause):
                            comma = (lt == ",") & at_base
                            item = F.when(setop, F.lit(0).cast("bigint")).otherwise(r["ob_item"]) \
                                + F.when(comma & F.coalesce(clause == _ORDERBY, F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
                            new = place(r["scope"], r["base_p"], r["branch"] + setop.cast("bigint"), clause,
                                        F.when(kw.isNotNull(), F.concat(seen, F.array(kw))).otherwise(seen), item)

                            def finish(n):
                                same = lambda c: (c["scope"] == n["scope"]) & (c["p"] == p)
                                is_ab = _isin(lt, ["and", "between"])
                                # the AND of a BETWEEN: previous and/between token in the same scope and paren level is a between
                                between_and = (lt == "and") & F.coalesce(F.get(F.filter(acc["between"], same), F.lit(0))["lt"] == "between", F.lit(False))
                                from_sep = (_isin(lt, ["from", "join"]) & (x["kind"] == "kw")) | (comma & F.coalesce(n["clause"] == _FROM, F.lit(False)))
                                out = F.struct(
                                    p.alias("p"), F.when(lt == ")", p + 1).otherwise(p).alias("lvl"), sub_open.alias("sub_open"), sub_close.alias("sub_close"),
                                    depth.alias("depth"), n["scope"].alias("scope"), n["base_p"].alias("base_p"), setop.alias("is_setop"), n["branch"].alias("branch"),
                                    kw.alias("clause_kw"), n["clause"].alias("clause"),
                                    # a clause keyword seen before in the same (scope, branch): the query repeats a clause
                                    (kw.isNotNull() & F.coalesce(F.array_contains(seen, kw), F.lit(False))).alias("dup_clause"), n["ob_item"].alias("ob_item"),
                                    between_and.alias("between_and"), from_sep.alias("from_sep"))
                                return F.struct(
                                    p.alias("p"), depth.alias("depth"),
                                    F.when((lt == "(") & sub_open.isNotNull(), F.concat(F.filter(acc["opened"], lambda o: o["at"] != p),
                                           F.array(F.struct(p.alias("at"), sub_open.alias("sub"))))).otherwise(acc["opened"]).alias("opened"),
                                    F.when(sub_open, F.concat(F.filter(acc["scopes"], lambda c: c["at"] != depth),
                                           F.array(F.struct(depth.alias("at"), pos.alias("scope"))))).otherwise(acc["scopes"]).alias("scopes"),
                                    n.alias("place"), F.when(sub_open | sub_close, known).otherwise(acc["places"]).alias("places"),
                                    F.when(is_ab, F.concat(F.filter(acc["between"], lambda c: ~same(c)),
                                           F.array(F.struct(n["scope"].alias("scope"), p.alias("p"), lt.alias("lt"))))).otherwise(acc["between"]).alias("between"),
                                    F.concat(acc["out"], F.array(F.struct(out.alias("own"), F.struct(
                                        p.alias("p"), p.alias("lvl"), no.alias("sub_open"), no.alias("sub_close"), depth.alias("depth"), n["scope"].alias("scope"),
                                        n["base_p"].alias("base_p"), no.alias("is_setop"), n["branch"].alias("branch"), F.lit(None).cast("int").alias("clause_kw"),
                                        n["clause"].alias("clause"), no.alias("dup_clause"), n["ob_item"].alias("ob_item"), no.alias("between_and"),
                                        no.alias("from_sep")).alias("after")))).alias("out"))

                            return let(new, finish)

                        return let(clause, with_clause)

                    return let(F.struct(is_setop.alias("is_setop"), keyword.alias("kw")), with_keyword)

                return let(own, with_place)

            return let(depth, with_depth)

        def parens(p):
            matched = F.coalesce(F.get(F.filter(acc["opened"], lambda o: o["at"] == p + 1), F.lit(0))["sub"], F.lit(False))
            return F.struct(p.alias("p"), ((lt == "(") & (x["next1"] == "select")).alias("sub_open"), ((lt == ")") & matched).alias("sub_close"))

        return let(let(acc["p"] + x["step"], parens), with_parens)

    return F.aggregate(marks, start, step, lambda acc: acc["out"])


def _operator(x: Column, t: Column) -> Column:
    """Operator name of a token (null when the token is no operator)."""
    lt, prev1, prev2, next1, next2 = (x[c] for c in ("lt", "prev1", "prev2", "next1", "next2"))
    kind, prev_kind = x["kind"], x["prev_kind"]
    operand_before = _isin(prev_kind, ["ident", "num", "str"]) | (prev1 == ")")
    join = cases((prev1 == "left", "left join"), (prev1 == "inner", "inner join"),
                 (prev1 == "cross", "cross join"),
                 ((prev1 == "outer") & (prev2 == "left"), "left outer join"),
                 (_isin(prev1, ["right", "full", "outer", "natural"]), F.concat(prev1, F.lit(" join"))), otherwise="join")
    word = cases(
        (lt == "join", join),
        (_isin(lt, vocab.AGGREGATE_NAMES) & (next1 == "("), lt),
        (lt == "between", F.when(prev1 == "not", "not_between").otherwise("between")),
        (lt == "and", F.when(t["between_and"], None).otherwise("and")),
        (lt == "or", F.lit("or")),
        ((lt == "not") & ~F.coalesce(_isin(next1, ["in", "like", "between", "null"]), F.lit(False))
         & ~F.coalesce(prev1 == "is", F.lit(False)), "not"),
        (lt == "like", F.when(prev1 == "not", "not_like").otherwise("like")),
        (lt == "ilike", "ilike"),
        (lt == "in", F.when(prev1 == "not", "nin").otherwise("in")),
        (lt == "exists", "exists"))
    # most keywords name no operator
    word = F.when(_isin(lt, ["join", "between", "and", "or", "not", "like", "ilike", "in", "exists", *vocab.AGGREGATE_NAMES]), word)
    symbol = (
        F.when(lt == ",", F.when((t["clause"] == _FROM) & (t["p"] == t["base_p"]), "join"))
        .when(_isin(lt, list(vocab.COMPARISON_SYMBOLS)), F.element_at(F.create_map(*[F.lit(x) for kv in vocab.COMPARISON_SYMBOLS.items() for x in kv]), lt))
        .when(_isin(lt, list(vocab.ARITHMETIC_SYMBOLS)) & F.coalesce(operand_before, F.lit(False)),
              F.element_at(F.create_map(*[F.lit(x) for kv in vocab.ARITHMETIC_SYMBOLS.items() for x in kv]), lt)))
    quoted = F.when((lt == ",") & (t["clause"] == _FROM) & (t["p"] == t["base_p"]), "join")
    null = (F.when((lt == "is") & (next1 == "null"), "is null").when((lt == "is") & (next1 == "not") & (next2 == "null"), "is not null"))
    return F.coalesce(cases((kind == "kw", word), (kind == "sym", symbol), otherwise=quoted), F.when(lt == "is", null))


def _finished(tokens: Column, placed: Column) -> Column:
    """Tokens with operator names and with the roles of identifiers and literals: table, alias, column, function, value."""
    def token(x, i):
        t = F.get(placed, i)
        before = lambda d: F.get(placed, i - d)
        false = F.lit(False)

        def table(d):
            return (F.get(tokens, i - d)["kind"] == "ident") & (before(d)["clause"] == _FROM) & F.coalesce(before(d + 1)["from_sep"], false)

        prev_table, prev2_table = (F.coalesce(table(d), false) for d in (1, 2))
        prev_sub_close, prev2_sub_close = (F.coalesce(before(d)["sub_close"], false) for d in (1, 2))
        prev1 = x["prev1"]
        in_from = t["clause"] == _FROM
        table_alias = in_from & (prev_table | ((prev1 == "as") & prev2_table))
        sub_alias = prev_sub_close | ((prev1 == "as") & prev2_sub_close)
        col_alias = (prev1 == "as") & ~prev2_table & ~prev2_sub_close
        # ``with x as (select``: x names a subquery
        cte = (x["next1"] == "as") & (x["next2"] == "(") & t["clause"].isNull()
        function = x["next1"] == "("
        ident = cases((table(0), "table"), (table_alias, "table_alias"), (sub_alias | cte, "query_alias"),
                      (col_alias, "column_alias"), (function, "function"), otherwise="column")
        role = cases((x["kind"] == "ident", ident), (_isin(x["kind"], ["num", "str"]) & F.coalesce(t["clause"] != _LIMIT, F.lit(True)), "value"))

        def with_role(r):
            # the opener of a scope records the scope and branch it is nested in
            return F.struct(
                *[x[c].alias(c) for c in ("pos", "tok", "lt", "kind", "prev1", "prev2", "prev_kind", "next1", "next2", "next_kind")],
                *[t[c].alias(c) for c in ("p", "lvl", "sub_open", "sub_close", "depth", "scope", "base_p", "is_setop", "branch")],
                *[F.get(F.array(*[F.lit(n) for n in CLAUSE_NAMES]), t[c]).alias(c) for c in ("clause_kw", "clause")],
                *[t[c].alias(c) for c in ("dup_clause", "ob_item", "between_and")],
                _operator(x, t).alias("op"), (r == "table").eqNullSafe(True).alias("is_table"),
                F.when(t["sub_open"], before(1)["scope"]).alias("parent_scope"), F.when(t["sub_open"], before(1)["branch"]).alias("parent_branch"),
                r.alias("role"),
                # table an alias stands for (null for a subquery alias)
                cases((r == "table_alias", cases((prev1 == "as", x["prev2"]), otherwise=prev1))).alias("alias_of"))

        return let(role, with_role)

    return F.transform(tokens, token)


def tasks(df: DataFrame) -> int:
    """Number of tasks that analyse texts: four a core, since a few texts are a lot of work, and the session's shuffle
    partitions where they are more. A number of partitions isn't coalesced again by their bytes."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """The texts dealt over ``tasks``."""
    return df.repartition(tasks(df))


def token_array(sql: Column | str) -> Column:
    """Q1 + Q2 + operator names + roles of one text: its tokens in order, as structs (see module docstring); empty for null."""
    sql = F.col(sql) if isinstance(sql, str) else sql
    return let(let(_tokens(sql), _neighbours), lambda ts: let(_placed(ts), lambda placed: _finished(ts, placed)))


def token_relation(df: DataFrame, key: str | list[str] = "datapoint_id", sql_col: str = "sql_query") -> DataFrame:
    """One row per token (see module docstring): generated within the row of each text, without an exchange."""
    keys = [key] if isinstance(key, str) else list(key)
    return spread(df.select(*keys, sql_col)).select(*keys, F.explode(token_array(sql_col)).alias("_t")).select(*keys, "_t.*")


def token_arrays(df: DataFrame, key: str | list[str] = "datapoint_id", sql_col: str = "sql_query") -> DataFrame:
    """(key..., tokens): the tokens of every text in one array, in order, without an exchange beyond ``spread``."""
    keys = [key] if isinstance(key, str) else list(key)
    return spread(df.select(*keys, sql_col)).select(*keys, token_array(sql_col).alias("tokens"))


def gathered(tokens: DataFrame, key: str | list[str] = "datapoint_id") -> DataFrame:
    """(key..., tokens): a token relation's rows back in one array per query, in order; ``token_arrays`` as they are."""
    keys = [key] if isinstance(key, str) else list(key)
    if "tokens" in tokens.columns:
        return tokens
    own = [c for c in tokens.columns if c not in keys]
    own.sort(key=lambda c: c != "pos")
    return tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("tokens"))


def per_query(tokens: DataFrame, rows, key: str | list[str] = "datapoint_id") -> DataFrame:
    """Rows generated from each query's tokens: ``rows`` makes an array of structs of the bound token array. ``tokens`` is a
    ``token_relation`` or, without an exchange, ``token_arrays``. The generator reads the array once, so its steps
    aren't repeated by a filter or a second reference above."""
    keys = [key] if isinstance(key, str) else list(key)
    return gathered(tokens, keys).select(*keys, F.explode(let(F.col("tokens"), rows)).alias("_r")).select(*keys, "_r.*")


def query_signals(tokens: DataFrame, key: str | list[str] = "datapoint_id") -> DataFrame:
    """Per-query validity signals of Q32 from the token relation (one aggregate, no join)."""
    keys = [key] if isinstance(key, str) else list(key)
    return tokens.groupBy(*keys).agg(*signal_aggs())


SIGNALS = ["has_select", "dup_distinct", "dup_clause", "lone_quote", "unknown", "group_expr", "distinct_expr"]


def _rules(of) -> dict[str, Column]:
    """Q32 signals of a token; ``of`` gives its attributes by name."""
    lt = of("lt")
    in_aggregate = (of("prev1") == "(") & _isin(of("prev2"), vocab.AGGREGATE_NAMES)
    column_follows = (of("next_kind") == "ident") & _isin(of("next2"), [")", ","])
    allowed = _isin(lt, ["by", ",", ";", "(", ")"]) | F.coalesce(of("role") == "column", F.lit(False))
    rules = {
        "has_select": lt == "select",
        "dup_distinct": (lt == "distinct") & (of("next1") == "distinct"),
        "dup_clause": of("dup_clause"),
        "lone_quote": of("kind") == "quote",
        "unknown": of("kind") == "other",
        "group_expr": (of("clause") == "groupby") & of("clause_kw").isNull() & (~allowed | of("sub_close")),
        "distinct_expr": (lt == "distinct") & in_aggregate & ~column_follows,
    }
    return {n: F.coalesce(c, F.lit(False)) for n, c in rules.items()}


def signal_aggs() -> list[Column]:
    """Aggregates of the Q32 signals over tokens."""
    return [F.min("p").alias("min_p"), F.max_by("p", "pos").alias("last_p"), F.max("pos").alias("hi"),
            *[F.max(c.cast("int")).alias(s) for s, c in _rules(F.col).items()]]


def query_signal_aggs() -> list[Column]:
    """The same signals of a query over its per-scope rows."""
    return [F.min("min_p").alias("min_p"), F.max_by("last_p", "hi").alias("last_p"), *[F.max(s).alias(s) for s in SIGNALS]]


def parse_error_expr(of=F.col) -> Column:
    """Q32 rule over the signal columns; first match wins. No tokens at all -> 'no select'."""
    return (F.when(F.coalesce(of("min_p") < 0, F.lit(False)) | F.coalesce(of("last_p") != 0, F.lit(False)),
                   "unbalanced parentheses")
            .when(of("lone_quote") == 1, "unbalanced quotes")
            .when(of("unknown") == 1, "unknown token")
            .when(F.coalesce(of("has_select"), F.lit(0)) == 0, "no select")
            .when(of("dup_distinct") == 1, "repeated distinct")
            .when(of("dup_clause") == 1, "repeated clause")
            .when(of("group_expr") == 1, "group by on an expression")
            .when(of("distinct_expr") == 1, "distinct on an expression"))


def text_error(tokens: Column) -> Column:
    """Q32 rule over the tokens of one text (a bound array): null when the feature model can represent it."""
    def any_(name):
        return F.exists(tokens, lambda t: _rules(t.__getitem__)[name]).cast("int")

    signals = {"min_p": F.when(F.exists(tokens, lambda t: t["p"] < 0), -1), "last_p": F.get(tokens, F.size(tokens) - 1)["p"], **{s: any_(s) for s in SIGNALS}}
    return parse_error_expr(signals.__getitem__)


def text_errors(df: DataFrame, key: str | list[str] = "datapoint_id", sql_col: str = "sql_query") -> DataFrame:
    """Q32: (key..., parse_error) for every query, within its row; null when the feature model can represent it."""
    keys = [key] if isinstance(key, str) else list(key)
    return spread(df.select(*keys, sql_col)).select(*keys, F.explode(F.array(let(token_array(sql_col), text_error))).alias("parse_error"))


def parse_errors(df: DataFrame, tokens: DataFrame, key: str | list[str] = "datapoint_id") -> DataFrame:
    """Q32: (key..., parse_error) for every query; null when the feature model can represent it.

    Rules, first match wins: unbalanced parentheses, unbalanced quotes, an unknown token, no SELECT,
    repeated DISTINCT, a clause repeated within one (scope, branch), GROUP BY on something else than
    columns, DISTINCT inside an aggregate on something else than one or more columns.
    """
    keys = [key] if isinstance(key, str) else list(key)
    sig = query_signals(tokens, keys)
    return df.select(*keys).join(sig.hint("merge"), keys, "left").select(*keys, parse_error_expr().alias("parse_error"))
